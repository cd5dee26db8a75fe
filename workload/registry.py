"""Registry of queries: the operator they exercise, their Spark form, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from workload.tables import Tables, with_tables


@dataclass(frozen=True)
class Query:
    operators: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(operators: str, sql: str | None = None, tables: str = ""):
    """Register a function of ``Tables`` under its own name.

    ``sql`` may use the tables named in ``tables`` besides the given ones.
    """

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        text = with_tables(tables, " ".join(sql.split())) if sql else None
        QUERIES[build.__name__] = Query(operators, build, text)
        return build

    return register
