"""Reads: tables, parameterised queries and the CSV feeds."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise import schemas

FETCH_SIZE = 1000


def scan_parquet(spark: SparkSession, directory: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{directory.rstrip('/')}/{table}.parquet")


def scan_table(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """A canonical table under its declared schema; columns the files lack are null."""
    return spark.read.schema(schemas.TABLES[table]).parquet(f"{directory.rstrip('/')}/{table}")


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    fetch_size: int = FETCH_SIZE,
    **options: str,
) -> DataFrame:
    """A database table read in parallel ranges of a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower, upperBound=upper)
        .options(numPartitions=partitions, fetchsize=fetch_size, **options)
        .load()
    )


def scan_query(
    spark: SparkSession, query: str, parameters: Mapping[str, Any], **tables: DataFrame
) -> DataFrame:
    """A SQL text over named frames with bound parameters; nothing is pasted into the text."""
    return spark.sql(query, args=dict(parameters), **tables)


def _csv(spark: SparkSession, path: str, schema: str, **options: Any) -> DataFrame:
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def scan_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.DAILY_FEED, dateFormat="yyyy-MM-dd")


def two_digit_year_date(text: Column) -> Column:
    """``dd/MM/yy`` with years 69–99 in the last century, as the feeds mean them; null where it is no date."""
    date = F.try_to_date(text, "dd/MM/yy")
    return F.when(F.year(date) >= 2069, F.add_months(date, -1200)).otherwise(date)


def scan_order_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.ORDER_FEED).withColumn("created_date", two_digit_year_date(F.col("created_date")))


def scan_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """Review feed; comments may hold commas, doubled quotes and line breaks."""
    feed = _csv(spark, path, schemas.REVIEW_FEED, quote='"', escape='"', multiLine=True)
    return feed.withColumn("date", F.try_to_date(F.col("date"), "yyyy-MM-dd"))


def scan_prompt_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.PROMPT_FEED, quote='"', escape='"', multiLine=True)


def prompt_by_id(prompts: DataFrame, prompt_id: int) -> DataFrame:
    """The prompt row of an id; the job fails with a message where there is none."""
    found = prompts.filter(F.col("prompt_id") == prompt_id)
    missing = F.raise_error(F.lit(f"No prompt found for prompt_id: {prompt_id}"))
    return found.agg(F.first("prompt").alias("prompt")).select(
        F.lit(prompt_id).alias("prompt_id"), F.coalesce("prompt", missing.cast("string")).alias("prompt")
    )


def scan_root_items(spark: SparkSession, path: str) -> DataFrame:
    """Master catalogue with the text each item is indexed under."""
    items = _csv(spark, path, schemas.ROOT_ITEM_FEED, quote='"', escape='"')
    return items.withColumn("document", F.concat_ws(",", "id", "name"))
