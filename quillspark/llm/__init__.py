"""Training-data operators: near-dedup, fingerprints, token counts, mixing and formatting.

Every operator takes DataFrames and returns DataFrames.  The subpackage is
optional: nothing else in the library imports it.
"""
