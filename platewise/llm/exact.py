"""Exact duplicates by content-defined chunk recipes.

Texts are cut where their content says so, chunks of equal hash are compared byte
by byte and get a verified identifier, and documents are compared by their ordered
lists of identifiers. A long text moves once, as chunks; from then on only lists of
numbers move, and equal chunks are joined into one before they do.

Defined results: a null text is the empty text; empty texts equal each other and have
an empty recipe; rows repeated with the same doc_id count as rows of their group; a
null doc_id is never kept if its group has another one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import flat, mix, plain, prefix_hash, signed, slices, span_hash, stored

# A cut falls after a byte whose last 32 bytes hash to 0 in these low bits, 1 KB apart on average.
MASK, LOOK, LEAST, MOST = np.uint64(1023), 32, 256, 8192


def _ends(at: np.ndarray, size: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of one text: cuts by content, no chunk shorter or longer than allowed."""
    ends, last = [], 0
    for cut in [*at.tolist(), size]:
        while cut - last > most:
            last += most
            ends.append(last)
        if cut - last >= least:
            ends.append(cut)
            last = cut
    if last < size:
        ends.append(size)
    return ends


def _chunks(column: pa.Array, least: int, most: int) -> tuple[pa.Array, pa.Array]:
    """The hashes of each text's chunks, and the chunks themselves."""
    data, offsets = flat(column)
    running = prefix_hash(data)
    at = np.arange(LOOK, len(data) + 1)
    cuts = at[(span_hash(running, at - LOOK, at) & MASK) == 0] if len(at) else at
    bound = np.searchsorted(cuts, offsets)
    ends = [
        _ends(cuts[bound[i] : bound[i + 1]] - offsets[i], int(offsets[i + 1] - offsets[i]), least, most) for i in range(len(column))
    ]
    upto = pa.array(np.cumsum([0, *map(len, ends)]), pa.int32())
    stop = np.concatenate([np.zeros(0, np.int64), *(np.asarray(e, np.int64) + offsets[i] for i, e in enumerate(ends))])
    edges = np.concatenate([[0], stop])
    hashes = pa.array(signed(mix(span_hash(running, edges[:-1], edges[1:]))))
    chunks = pa.BinaryArray.from_buffers(
        pa.binary(), len(stop), [None, pa.array(edges, pa.int32()).buffers()[1], pa.py_buffer(data.tobytes())]
    )
    return pa.ListArray.from_arrays(upto, hashes), pa.ListArray.from_arrays(upto, chunks)


def _chunked(keep: list[str], least: int, most: int, names: list[str]):
    """Replaces the text of each batch by the hashes of its chunks and, where named, the chunks."""

    def run(batches):
        for batch in slices(batches):
            made = _chunks(batch.column("text"), least, most)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made[: len(names)]], [*keep, *names])

    return run


def recipes(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, text_sha256, recipe: the verified identifiers of each text's chunks, in order."""
    texts = plain(docs)
    kept = texts.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    listed = kept.mapInArrow(
        _chunked(["doc_id", "text_sha256"], least, most, ["recipe"]), f"doc_id {id_type}, text_sha256 string, recipe array<bigint>"
    )
    chunks = texts.select("text").mapInArrow(
        _chunked([], least, most, ["hashes", "chunks"]), "hashes array<bigint>, chunks array<binary>"
    )
    chunks = chunks.select(F.explode(F.arrays_zip("hashes", "chunks")).alias("c")).select(
        F.col("c.hashes").alias("hash"), F.col("c.chunks").alias("chunk")
    )
    # Equal chunks become one row, within a task first; then contents of one hash are told apart.
    contents = chunks.groupBy("hash", "chunk").agg(F.count("*").alias("n"))
    clashing = Window.partitionBy("hash").orderBy("chunk")
    later = contents.withColumn("nth", F.row_number().over(clashing)).where("nth > 1").select("hash", "chunk", "nth")
    later = stored(later, "clashes")
    if later.isEmpty():
        return listed  # each hash stands for one content: the hash is a verified identifier
    return _renumbered(texts, later, least, most, id_type)


def _renumbered(texts: DataFrame, later: DataFrame, least: int, most: int, id_type: str) -> DataFrame:
    """Recipes in which the second and further contents of a hash have identifiers of their own."""
    rows = texts.withColumn("text_sha256", F.sha2(F.encode("text", "UTF-8"), 256))
    whole = rows.mapInArrow(
        _chunked(["doc_id", "text_sha256"], least, most, ["hashes", "chunks"]),
        f"doc_id {id_type}, text_sha256 string, hashes array<bigint>, chunks array<binary>",
    )
    each = whole.select("doc_id", "text_sha256", F.posexplode_outer(F.arrays_zip("hashes", "chunks")).alias("at", "c"))
    each = each.select("doc_id", "text_sha256", "at", F.col("c.hashes").alias("hash"), F.col("c.chunks").alias("chunk"))
    # Rows that are equal in all of this have the same text, and go on as one with a count.
    each = each.groupBy("doc_id", "text_sha256", "at", "hash", "chunk").agg(F.count("*").alias("copies"))
    named = each.join(later, ["hash", "chunk"], "left").withColumn(
        "id", F.when(F.col("nth").isNotNull(), F.xxhash64("hash", F.sha2("chunk", 256), "nth")).otherwise(F.col("hash"))
    )
    at = F.when(F.col("at").isNotNull(), F.struct("at", "id"))
    ordered = named.groupBy("doc_id", "text_sha256", "copies").agg(F.sort_array(F.collect_list(at)).alias("l"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    return ordered.select("doc_id", "text_sha256", F.col("l.id").alias("recipe"), copy).drop("copy")


def exact_duplicates(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays.
    """
    made = recipes(docs, least, most)
    by = ["recipe", "text_sha256"]
    groups = made.groupBy(*by).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    joined = made.join(groups, by)
    return joined.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
