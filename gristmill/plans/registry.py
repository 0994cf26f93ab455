"""Names of queries, their functions and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, days: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; its date columns ``days`` come out as text, in both forms."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = function(spark, sf_dir)
            return out.withColumns({d: out[d].cast("string") for d in days}) if days else out

        QUERIES[name] = run
        if sql is not None:
            texts = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in days)
            SQL[name] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if days else sql
        return function

    return add
