"""Daily aggregates that are kept up to date: only days with changed orders are computed again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY, MONTH = "day", "month"


def _unit_start(date: str, unit: str) -> Column:
    return F.col(date) if unit == DAY else F.trunc(date, "month")


def _unit_bounds(first: dt.date, last: dt.date, unit: str) -> tuple[dt.date, dt.date]:
    """First day of the first unit and last day of the last one."""
    if unit == DAY:
        return first, last
    after = dt.date(last.year + last.month // 12, last.month % 12 + 1, 1)
    return first.replace(day=1), after - dt.timedelta(days=1)


def watermark(spark: SparkSession, path: str) -> dt.date | dt.datetime | None:
    """The latest change that the aggregates under `path` know of."""
    marks = f"{path.rstrip('/')}-watermark"
    where = spark._jvm.org.apache.hadoop.fs.Path(marks)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(marks).agg(F.max("until")).first()[0]


def touched(orders: DataFrame, since: dt.date | dt.datetime | None, updated_at: str, date: str, unit: str) -> DataFrame | None:
    """All orders of the days, or months, in which an order has changed since; None where none has.

    The range of those days is a filter on the scan, the days themselves a semi join.
    """
    changed = orders if since is None else orders.filter(F.col(updated_at) >= F.lit(since))
    if since is None:
        return orders
    first, last = changed.agg(F.min(date), F.max(date)).first()
    if first is None:
        return None
    low, high = _unit_bounds(first, last, unit)
    days = changed.select(_unit_start(date, unit).alias("_unit")).distinct()
    inside = orders.filter(F.col(date).between(F.lit(low), F.lit(high)))
    return inside.join(days, _unit_start(date, unit) == F.col("_unit"), "left_semi")


def refresh_daily(
    orders: DataFrame,
    aggregate: Callable[[DataFrame], DataFrame],
    path: str,
    updated_at: str = "updated_at",
    date: str = "created_date",
    unit: str = DAY,
) -> None:
    """Brings the aggregates under `path` up to date with the orders.

    ``aggregate`` turns orders into rows with ``date`` that depend on the orders of that
    day alone. The result is partitioned by day or month; partitions without a change stay
    as they are. The watermark beside the path is written last and changes at it are read
    again, so a run that was cut off, or repeated, does no harm. An order keeps its day: one
    that moves to another day has to be stamped on an order of the old day, too.
    """
    spark, since = orders.sparkSession, watermark(orders.sparkSession, path)
    until = orders.agg(F.max(updated_at)).first()[0]
    again = touched(orders, since, updated_at, date, unit)
    if until is None or again is None:
        return
    rows = aggregate(again).withColumn(unit, _unit_start(date, unit).cast("string"))
    rows = rows.hint("rebalance", F.col(unit))  # a partition comes to few files, however many tasks made its rows
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(unit).parquet(path)
    spark.range(1).select(F.lit(until).alias("until")).write.mode("append").parquet(f"{path.rstrip('/')}-watermark")


def read_daily(spark: SparkSession, path: str, unit: str = DAY) -> DataFrame:
    return spark.read.parquet(path).drop(unit)
