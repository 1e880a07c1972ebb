"""The registry of queries and of the SQL that gives the same rows.

A query is given once: its columns with their kinds (l long, d double of six places, s string, b boolean), a function of
(spark, sf_dir), and DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SPARK = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
_DUCK = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


def query(columns: str, views: str, sql: str):
    kinds = dict(c.split(":") for c in columns.split())

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c).cast("double"), 6) if k == "d" else F.col(c).cast(_SPARK[k])).alias(c) for c, k in kinds.items()])

        QUERIES[f.__name__] = run
        outer = ", ".join((f"round({c}::DOUBLE, 6)" if k == "d" else f"{c}::{_DUCK[k]}") + f" AS {c}" for c, k in kinds.items())
        body = f"q AS ({sql}) SELECT {outer} FROM q"
        ORACLES[f.__name__] = ("WITH " + ",\n".join([X.SQL[n] for n in views.split()] + [body])) if views else "WITH " + body
        return run

    return put
