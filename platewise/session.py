"""Session helpers shared by every job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import platewise

# Runtime SQL options the jobs rely on. A skewed join is split even where that
# costs an extra exchange, because one vendor or item may hold most rows. Shuffles
# start from 200 partitions and are joined again to a few compressed megabytes, and
# Arrow batches end at a size, because blocks of vectors are rows of half a megabyte.
SQL_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SQL_OPTIONS.items():
        spark.conf.set(key, value)
    # Helpers travel with their functions, so executors need no installed package.
    cloudpickle.register_pickle_by_value(platewise)
    return spark


def scratch_path(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A fresh folder under ``base``, or under the cluster's shared checkpoint folder.

    A machine-local folder would give executors different files, so without a
    shared one this fails, unless everything runs on one machine. That folder is
    removed when the process ends; no option of the session changes.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share, as base or in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="platewise-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/platewise/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """A frame written once to the scratch folder and read back: several branches then read it, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(key: Column, parts: Column) -> Column:
    """Part number of a key, spread evenly whatever step the keys of a group keep."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % parts
