"""Mixing sources to target weights.

Each source's words are packed into blocks of fixed length. Every output shard draws
multinomial counts of blocks per source. The slots a source gets are numbered through
all shards, mapped through pseudorandom permutations of its block numbers, one per
pass over the source, and joined to the blocks by number.

Defined results: a null source is a source of its own, last in order; a null or
empty text has size 0 and is never taken; sources without words have target 0; rows
repeated with the same doc_id are mixed as further documents of the same id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import SPACE, flat, slices, spare, stored, word_spans

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK_WORDS, SHARD_BLOCKS, SEED = 128, 4096, 11
# Documents of a source are laid end to end bucket by bucket, so that no running sum spans a whole source.
BUCKETS = 1024


def _place() -> Column:
    """A number of a row; rows equal in doc_id, text and source share it."""
    return F.xxhash64("doc_id", "text", F.col("source").isNull(), "source", F.lit(SEED))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, place: the words of each document; place orders equal keys."""

    def run(batches):
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            _, _, upto = word_spans(data, offsets, ~SPACE[data])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(np.diff(upto), pa.int64()), batch.column("place")],
                ["doc_id", "source", "size", "place"],
            )

    rows = docs.select("doc_id", "source", "text", _place().alias("place"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, source string, size bigint, place bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """source, rank, source_size, target for every source.

    Reshares above the limit by sorting sources once by size per weight: a source is
    full when the level (target per weight) reaches `MOST` times its size over its
    weight, so the level follows from running sums over that order.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(MOST))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(after))
    per = per.withColumn("want", F.sum("source_size").over(Window.partitionBy()) * F.lit(SHARE))
    per = per.withColumn("level", (F.col("want") - F.col("used")) / F.col("open"))
    per = per.withColumn("full", F.col("limit") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * level)
    return per.select("source", "rank", "source_size", target.alias("target"))


def laid_out(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """Every document with the number of its first word within its source."""
    rows = sizes.where("size > 0").withColumn("bucket", F.pmod("place", F.lit(BUCKETS)))
    bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.select("source", "bucket", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = rows["source"].eqNullSafe(bucket["source"]) & (rows["bucket"] == bucket["bucket"])
    rows = rows.join(bucket, same).select(rows["doc_id"], rows["source"], "size", "place", (F.col("base") + F.col("inner")).alias("first"))
    return rows.join(per.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0 … size-1 for each row: four Feistel rounds, walked until within size."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    x, left = index.astype(np.uint64), np.arange(len(index))
    while len(left):
        a, b = x[left] >> half[left], x[left] & low[left]
        for turn in range(4):
            z = (b + key[left] + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((z >> np.uint64(32)) & low[left])
        x[left] = (a << half[left]) | b
        left = left[x[left] >= size[left].astype(np.uint64)]
    return x.astype(np.int64)


def drawn(per: DataFrame, block_words: int, seed: int) -> DataFrame:
    """rank, block, times: how often the mix takes each block of each source."""
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / block_words)).where("blocks > 0")
    per = per.withColumn("slots", F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"))
    slots = F.sum("slots").over(Window.partitionBy())
    per = per.withColumn("p", F.col("slots") / slots).withColumn("shards", F.ceil(slots / SHARD_BLOCKS))
    # A shard's random generator is seeded by its number: the draw is the same on every run.
    sources = stored(per.withColumn("all", slots).select("rank", "blocks", "p", "shards", "all"), "sources")

    def multinomial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        size, shard = int(pdf["size"].iloc[0]), int(pdf["shard"].iloc[0])
        share = pdf["p"].to_numpy()
        # Whole parts of the expected counts are certain; only the rest is drawn, which keeps sources near their targets.
        expected = size * share / share.sum()
        counts = np.floor(expected).astype(np.int64)
        rest = np.maximum(expected - counts, 0)
        left = size - int(counts.sum())
        if left > 0:
            counts += np.random.default_rng([seed, shard]).multinomial(left, rest / rest.sum() if rest.sum() > 0 else share / share.sum())
        return pd.DataFrame({"shard": shard, "rank": pdf["rank"], "n": counts})

    size = F.least(F.lit(SHARD_BLOCKS), F.col("all") - F.col("shard") * SHARD_BLOCKS)
    per_shard = sources.select("rank", "p", "all", F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard"))
    per_shard = per_shard.select("shard", "rank", "p", size.alias("size"))
    counts = per_shard.groupBy("shard").applyInPandas(multinomial, "shard long, rank int, n long")
    # Numbering slots of a source through the shards: first within runs of shards, then over the runs.
    counts = counts.withColumn("run", F.expr("shard div 512"))
    runs = counts.groupBy("rank", "run").agg(F.sum("n").alias("total"))
    upto = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("rank", "run", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))
    inner = Window.partitionBy("rank", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(runs, ["rank", "run"])
    counts = counts.join(sources.select("rank", "blocks"), "rank").withColumn("from", F.col("base") + F.col("inner"))
    # A source that is drawn more often than twice in full ends there.
    counts = counts.withColumn("to", F.least(F.col("from") + F.col("n"), F.col("blocks") * MOST)).where("to > from")
    numbered = counts.select("rank", "blocks", F.explode(F.expr("sequence(from, to - 1)")).alias("slot"))

    def placed(batches):
        for batch in batches:
            slot, blocks, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("slot", "blocks", "rank"))
            turn = slot // blocks
            key = ((rank * 4 + turn + 1) * np.int64(1_000_003) + seed).astype(np.uint64)
            block = _permuted(slot % blocks, blocks, key)
            yield pa.RecordBatch.from_arrays([pa.array(rank.astype(np.int32)), pa.array(block)], ["rank", "block"])

    return numbered.mapInArrow(placed, "rank int, block long").groupBy("rank", "block").agg(F.count("*").alias("times"))


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes, source targets, and the pieces the mix takes: doc_id, place, from_word, to_word, times."""
    sizes = stored(sized(docs), "sizes")
    per = stored(targets(sizes), "targets")
    rows = laid_out(sizes, per)
    last = F.expr(f"(first + size - 1) div {block_words}")
    pieces = rows.withColumn("block", F.explode(F.sequence(F.expr(f"first div {block_words}"), last)))
    pieces = pieces.join(drawn(per, block_words, seed), ["rank", "block"])
    start = F.greatest(F.col("block") * block_words - F.col("first"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_words - F.col("first"), F.col("size"))
    return sizes, per, pieces.select("doc_id", "place", start.alias("from_word"), end.alias("to_word"), "times")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of columns in which null equals null."""
    both = F.lit(True)
    for name in names:
        both = both & left[name].eqNullSafe(right[name])
    return both


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sizes, per, pieces = taken(docs, block_words, seed)
    words = pieces.groupBy("doc_id", "place").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("words"))
    sizes = sizes.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "place").orderBy("size")))
    copies = sizes.groupBy("doc_id", "place").agg(F.max("nth").alias("copies"))
    words = words.join(copies, same(words, copies, "doc_id", "place")).select(words["doc_id"], words["place"], "words", "copies")
    rows = sizes.join(words, same(sizes, words, "doc_id", "place"), "left").select(
        sizes["doc_id"], "size", "source", "nth", "words", "copies"
    )
    rows = rows.join(per, same(rows, per, "source"))
    # Equal rows of one document share its pieces evenly.
    share = F.expr("words div copies") + F.when(F.col("nth") <= F.col("words") % F.col("copies"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce(share, F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The documents of the mix, with the columns of the input.

    A document whose words are all taken stands there whole, a second time if all are
    taken twice; of others, the taken pieces stand in order, separated as they were.
    """
    _, _, pieces = taken(docs, block_words, seed)
    lists = pieces.groupBy("doc_id", "place").agg(F.collect_list(F.struct("from_word", "to_word", "times")).alias("pieces"))
    key, many, turn, found = (spare(docs, c) for c in ("place", "pieces", "turn", "id"))
    lists = lists.select(F.col("doc_id").alias(found), F.col("place").alias("at"), F.col("pieces").alias(many))
    keyed = docs.withColumn(key, _place()).dropDuplicates(["doc_id", key])
    rows = keyed.join(lists, keyed["doc_id"].eqNullSafe(lists[found]) & (keyed[key] == lists["at"]))
    rows = rows.select(*[keyed[c] for c in docs.columns], many).withColumn(turn, F.explode(F.array(F.lit(1), F.lit(2))))
    wanted = F.array_sort(F.filter(many, lambda p: p["times"] >= F.col(turn)))
    rows = rows.withColumn(many, wanted).where(F.size(many) > 0)

    def cut(batches):
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            starts, ends, upto = word_spans(data, offsets, ~SPACE[data])
            texts = []
            for i, pieces in enumerate(batch.column(many).to_pylist()):
                runs: list[list[int]] = []
                for p in pieces:
                    if runs and runs[-1][1] == p["from_word"]:
                        runs[-1][1] = p["to_word"]
                    else:
                        runs.append([p["from_word"], p["to_word"]])
                a, b, n = offsets[i], offsets[i + 1], upto[i + 1] - upto[i]
                out = []
                for first, last in runs:
                    s = a if first == 0 else starts[upto[i] + first]
                    e = b if last == n else ends[upto[i] + last - 1]
                    out.append(data[s:e].tobytes().decode())
                texts.append("\n".join(out))
            columns = [c for c in batch.schema.names if c not in (many, turn)]
            arrays = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return rows.mapInArrow(cut, docs.schema).select(
        *[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns]
    )
