"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise import schemas


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row; nested columns stay nested."""
    df.write.mode(mode).json(path)


def write_lines(items: DataFrame, path: str, header: str | None = None, mode: str = "errorifexists") -> None:
    """``id,name`` lines; a header goes to the first file."""
    lines = items.select(F.concat_ws(",", F.col("id").cast("string"), "name").alias("value"))
    if header is not None:
        lines = items.sparkSession.createDataFrame([(header,)], "value string").unionAll(lines)
    lines.write.mode(mode).text(path)


def _conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns cast to a table's schema; a column the frame lacks is null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.struct_of(ddl).fields
        ]
    )


def write_predictions(predictions: DataFrame, path: str) -> None:
    _conform(predictions, schemas.MENU_MAPPING_PREDICTIONS).write.mode("append").parquet(path)


def write_model_logs(logs: DataFrame, path: str) -> None:
    _conform(logs, schemas.MODEL_LOGS).write.mode("append").parquet(path)


def write_daily(daily: DataFrame, path: str, date: str = "created_date", mode: str = "errorifexists") -> None:
    """Daily aggregates by month, so that a trailing window reads its months only."""
    daily.withColumn("month", F.date_format(date, "yyyy-MM")).write.partitionBy("month").mode(mode).parquet(path)
