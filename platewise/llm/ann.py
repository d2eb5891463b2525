"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. Blocks of vectors post
these permutations in one inverted file per pivot. A query adds up, over the files of
its own pivots, what its permutation shares with those posted; that ranks a block by
footrule distance, and the best part of each block is reranked by inner product.

With places 0 … l-1 and l for a pivot not among the nearest, the footrule distance of
two permutations is a constant less twice the sum of min(l - a, l - b) over shared
pivots, so only shared pivots need be visited.

The pivots are a bounded sample (`pivots`); every vector is indexed. Equal vectors
are one entry that knows its smallest ids, so copies neither crowd a block nor get lost.

Defined results: vectors that are null, zero, hold a null or non-finite component, or
have another length than most take no part, nor do rows without an id; repeated rows
count once; an id with several vectors is a candidate with each and a query with its
smallest; fewer candidates than k give fewer rows; an empty table gives no rows; other
columns are ignored. Blocks of at most `sure` vectors are reranked whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import stored

K, PIVOTS, PLACES, BLOCK, QUERIES, SURE, PART = 20, 512, 64, 4096, 1024, 256, 0.15
EVERY = 20


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the vectors that take part, as doubles, each row once."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & sound).select("vec_id", v.alias("v")).distinct()
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _permutations(vectors: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each vector in order, ties to the earlier pivot."""
    near = np.round(vectors @ pivots.T, 12)
    return np.argsort(-near, axis=1, kind="stable")[:, :places]


def _searched(pivots: np.ndarray, places: int, k: int, part: float, sure: int):
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        none = {"query_id": [], "vec_id": [], "score": []}
        if not entries.num_rows or not queries.num_rows:
            return pa.table(none, schema)
        matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)
        order = np.argsort(np.asarray([i[0].as_py() for i in entries.column("ids")]))
        stored_vectors, ids = matrix(entries)[order], [entries.column("ids")[int(i)].as_py() for i in order]
        asked, names = matrix(queries), queries.column("query_id").to_pylist()
        n = len(ids)
        # Inverted files: for each pivot the entries that have it among their nearest, and the weight of its place.
        posted = _permutations(stored_vectors, pivots, places)
        by = np.argsort(posted.ravel(), kind="stable")
        edges = np.searchsorted(posted.ravel()[by], np.arange(len(pivots) + 1))
        entry, weight = by // places, (places - by % places).astype(np.int64)
        keep = min(n, max(sure, int(np.ceil(part * n))))
        out: dict[str, list] = none
        for name, vector, permutation in zip(names, asked, _permutations(asked, pivots, places), strict=True):
            shared = np.zeros(n)
            if keep < n:
                files = [slice(edges[p], edges[p + 1]) for p in permutation]
                w = np.concatenate([np.minimum(weight[f], places - at) for at, f in enumerate(files)])
                shared = np.bincount(np.concatenate([entry[f] for f in files]), w, n)
            best = np.sort(np.argpartition(-shared, keep - 1)[:keep])
            score = (stored_vectors[best] * vector).sum(axis=1)
            # The query's own entry may stand among the first, hence one more.
            top = np.lexsort([best, -score])[: k + 1]
            found = [(float(score[t]), i) for t in top for i in ids[best[t]] if i != name]
            found = sorted(set(found), key=lambda f: (-f[0], f[1]))[:k]
            out["query_id"] += [name] * len(found)
            out["vec_id"] += [i for _, i in found]
            out["score"] += [s for s, _ in found]
        return pa.table(out, schema)

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    return run


def nearest(
    vectors: DataFrame, every: int = EVERY, k: int = K, pivots: int = PIVOTS, places: int = PLACES,
    block: int = BLOCK, part: float = PART, sure: int = SURE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each id divisible by `every`."""
    rows = stored(usable(vectors), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    # Only the k + 1 smallest ids of equal vectors can be found; Spark applies this limit before the shuffle, too.
    few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stored(entries.withColumn("key", F.xxhash64("v")), "entries")
    total = entries.count()
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    chosen = np.asarray([r["v"] for r in entries.orderBy("key").limit(pivots).collect()], float).reshape(-1, 1 if not total else len(entries.first()["v"]))
    blocks, chunks = max(1, -(-total // block)), max(1, -(-rows.where(F.col("vec_id") % every == 0).count() // QUERIES))
    asked = asked.select(F.col("vec_id").cast("long").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    entries = entries.select(F.col("ids").cast("array<long>").alias("ids"), "v", F.pmod("key", F.lit(blocks)).cast("int").alias("block"))
    entries = entries.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    run = _searched(chosen, min(places, max(1, len(chosen))), k, part, sure)
    found = entries.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(
        run, "query_id bigint, vec_id bigint, score double"
    )
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # An id with several vectors may be found more than once; its best counts.
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
