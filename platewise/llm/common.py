"""Helpers of the text operators: shared scratch tables, Arrow batches, hashing of bytes and words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import platewise

# A batch of Python work holds at most so many rows and about so many bytes of text.
BATCH_ROWS = 2000
SLICE_BYTES = 2_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Session options of the text operators; helpers travel with their functions."""
    for key, value in OPTIONS.items():
        spark.conf.set(key, value)
    cloudpickle.register_pickle_by_value(platewise)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="platewise-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage: what was computed survives lost executors, and several
    branches read it without computing it again. Shuffle files of the write go when it
    has ended; Spark would keep them until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/platewise-llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete what `stored` wrote for a frame that no result needs any more."""
    session = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = session._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet")


def plain(docs: DataFrame) -> DataFrame:
    """Just the two columns the operators need; a null text is empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes of one column, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(start, end - start)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column laid end to end, and the offset of each row; null is empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


# ---- compact columns ----------------------------------------------------------


def packed(parts: list[np.ndarray], pack: zstandard.ZstdCompressor) -> bytes:
    """Arrays of unsigned 32-bit numbers as one blob, byte planes apart, which compresses well."""
    planes = [p.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for p in parts]
    return np.asarray([len(parts), *map(len, parts)], "<u4").tobytes() + pack.compress(b"".join(planes))


def unpacked(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    sizes = np.frombuffer(blob, "<u4", n, 4).astype(np.int64)
    data, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 + 4 * n :]), np.uint8), 0, []
    for size in sizes:
        out.append(np.ascontiguousarray(data[at : at + 4 * size].reshape(4, -1).T).view("<u4").ravel())
        at += 4 * size
    return out


def gathered(values: np.ndarray, edges: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries' values one after another in the order `at`, and where each one ends."""
    length = np.diff(edges)[at]
    ends = np.cumsum(length)
    index = np.repeat(edges[:-1][at] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    return values[index], ends


# ---- hashing -----------------------------------------------------------------

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_PRIME), -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 8 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash modulo 2**64, one entry more than there are bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _PRIME, len(data)), out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; equal bytes give equal hashes wherever they stand."""
    down = _power("down", _INVERSE, len(running))
    return mix((running[end] - running[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words up to each row.

    `inside` marks the bytes of words; words never cross rows.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words within a row, in order, and how many there are up to each row.

    A row with fewer words, but one at least, gives its whole sequence as one
    shingle, which differs from every full one.
    """
    count = np.diff(bounds)
    full = np.maximum(count - n + 1, 0)
    made = np.where((count > 0) & (full == 0), 1, full)
    upto = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(upto[-1], np.uint64)
    row = np.repeat(np.arange(len(count)), made)
    first = bounds[:-1][row] + np.arange(len(row)) - upto[:-1][row]
    length = np.minimum(count, n)[row]
    for i in range(n):
        have = i < length
        out[have] = mix(out[have] * _U(0xD6E8FEB86659FD93) + words[first[have] + i])
    return mix(out + length.astype(np.uint64)), upto


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
