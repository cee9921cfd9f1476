"""Answers from Parquet footers: row counts, and least and greatest dates and numbers.

Spark's V2 Parquet source pushes COUNT, MIN and MAX of a whole table into the scan, which then reads
the files' footers and no column page. That takes no filter but on partition folders, no
grouping but by them, and types that footers hold exact bounds of (dates and numbers). It finds a
column of a footer by its place, so a table's files must all have the same columns, as those of
one writer do; their schema is read from a footer, not assumed.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PUSH = "spark.sql.parquet.aggregatePushdown"
_V1 = "spark.sql.sources.useV1SourceList"


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def from_footers(spark: SparkSession, path: str, *aggregates) -> DataFrame:
    """One row of COUNT, MIN and MAX aggregates over the table at ``path``, planned on its footers."""
    others = ",".join(x for x in spark.conf.get(_V1).split(",") if x.strip() != "parquet")
    with _set(spark, {_PUSH: "true", _V1: others}):
        out = spark.read.parquet(path).agg(*aggregates)
        # The settings count when the plan is made.
        out._jdf.queryExecution().executedPlan()
    return out


def q01_total_records(spark: SparkSession, path: str) -> DataFrame:
    return from_footers(spark, path, F.count(F.lit(1)).alias("Total_Records"))


def q02_date_span(spark: SparkSession, path: str) -> DataFrame:
    return from_footers(spark, path, F.min("TradeDate").alias("StartingDate"), F.max("TradeDate").alias("EndDate"))


def last_price_id(spark: SparkSession, path: str) -> int:
    """The table's greatest PriceID, 0 if it has none."""
    return from_footers(spark, path, F.max("PriceID")).first()[0] or 0
