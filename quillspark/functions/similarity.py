"""Title similarity: the Dice coefficient over sets of character bigrams.

Scores are 32-bit floats, as the thresholds are; folding is ASCII only, so
``É`` and ``é`` differ.  Two titles without bigrams are alike (1.0), one
without and one with are not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.bound import let

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def folded(title: Column) -> Column:
    """Letters and digits of a title, A-Z in lower case."""
    return ascii_lower(F.regexp_replace(title, r"[^\p{IsAlphabetic}\p{N}]", ""))


def bigrams(title: Column) -> Column:
    """Distinct bigrams; empty for titles of fewer than two letters or digits."""

    def pairs(text: Column) -> Column:
        places = F.when(F.length(text) > 1, F.sequence(F.lit(1), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(2))))

    return let(folded(title), pairs)


def dice_of(a: Column, b: Column) -> Column:
    """Dice coefficient of two bigram sets."""

    def score(sets: Column) -> Column:
        total = F.size(sets["a"]) + F.size(sets["b"])
        shared = F.size(F.array_intersect(sets["a"], sets["b"]))
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * shared / total).cast("float")

    return let(F.struct(a.alias("a"), b.alias("b")), score)


def dice(a: Column, b: Column) -> Column:
    return dice_of(bigrams(a), bigrams(b))


def best_dice(query: Column, titles: Column) -> Column:
    """Best score of a title against an array of titles; 0.0 for an empty or null array.

    The bigrams of ``query`` are made once a row, outside the loop over titles
    (a literal query's are folded to a constant).
    """
    known = F.array(F.struct(bigrams(query).alias("grams")))
    scores = F.flatten(F.transform(known, lambda k: F.transform(F.filter(titles, lambda t: t.isNotNull()), lambda t: dice_of(k["grams"], bigrams(t)))))
    return F.coalesce(F.array_max(scores), F.lit(0.0).cast("float"))
