"""All registered queries, by name, with the SQL that checks them."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans.views import duck_sql, spark_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of views as a query.

    Parameters named after views or tables get those; ``spark`` and ``sf_dir``
    get themselves.  ``sql`` is the DuckDB statement for the same rows.
    """

    def register(f):
        names = list(inspect.signature(f).parameters)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            given = {"spark": spark, "sf_dir": sf_dir}
            return f(**{n: given[n] if n in given else spark_view(spark, sf_dir, n) for n in names})

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = duck_sql(sql)
        return f

    return register


from quillspark.plans import catalog, edits, metrics, providers, reruns, resolving, text  # noqa: E402, F401  (they register their queries)
