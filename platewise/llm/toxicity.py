"""Toxicity from the nearest labelled examples.

A text's terms are its lower-cased words and their first three to eight bytes, each
once more if it occurs at least twice, and again if at least four times. The terms
that mark toxic examples best form the feature space. Labelled examples stand
in a block-max inverted index over that space; each text gets its exact nearest
examples by TF-IDF cosine, which vote by similarity.

What is fitted comes from a bounded sample of labelled rows (`Limits`); term counts
behind the idf weights cover all documents. A row is held out, and its label never
read, if the crc32 of its doc_id as text leaves 2 modulo 4.

Defined results: a text without any feature, an empty or a null one has no neighbours
and gets the share of toxic rows among labelled ones, or 0 without labels; a label
that is null counts as no label; of several labels of one doc_id the largest counts;
rows repeated with the same doc_id are scored each; a null doc_id is scored and never
an example; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import LOWER, flat, gathered, plain, prefix_hash, signed, slices, span_hash, stored, word_spans

THRESHOLD = 0.3
# Blocks of the index that are visited first; each further round visits twice as many.
VISIT = 16
# Least log-likelihood ratio of a feature: among some hundred thousand terms, few reach it by chance.
SURE = 20.0


@dataclass(frozen=True)
class Limits:
    """Bounds of what is fitted: examples of each label, features, and neighbours that vote."""

    toxic: int = 3000
    clean: int = 5000
    features: int = 512
    neighbours: int = 15
    block: int = 64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


PREFIXES = range(3, 9)
# A term that occurs so often in a text is a term of its own, told apart by its salt.
OFTEN = {2: np.int64(0x51ED2701A3B9C64F), 4: np.int64(0x2C4A96B1D7F0E853)}


def _occurrences(column: pa.Array, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct term of each text; only of terms whose low bits are in `near`, if given."""
    inside = np.zeros(256, bool)
    inside[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    data, offsets = flat(column)
    data = LOWER[data]
    running = prefix_hash(data)
    starts, ends, upto = word_spans(data, offsets, inside[data])
    rows = np.repeat(np.arange(len(column)), np.diff(upto))
    hashes, where = [], []
    for n in (0, *PREFIXES):  # 0 is the whole word; a prefix is told from a word by its salt
        long = np.flatnonzero(ends - starts > n)
        found = signed(span_hash(running, starts[long], starts[long] + n if n else ends[long]) ^ np.uint64(n))
        if near is not None:
            keep = near[found & 0xFFFF]
            long, found = long[keep], found[keep]
        hashes.append(found)
        where.append(rows[long])
    hashes, rows = np.concatenate(hashes), np.concatenate(where)
    order = np.lexsort([hashes, rows])
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(rows), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(first)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def _distinct_terms(batches):
    for batch in slices(batches):
        rows, hashes, counts = _occurrences(batch.column("text"))
        more = [(rows, hashes)] + [(rows[counts >= n], hashes[counts >= n] ^ salt) for n, salt in OFTEN.items()]
        rows, hashes = np.concatenate([r for r, _ in more]), np.concatenate([h for _, h in more])
        order = np.argsort(rows, kind="stable")
        upto = np.searchsorted(rows[order], np.arange(batch.num_rows + 1))
        made = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(hashes[order]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), made], ["doc_id", "toxic", "terms"])


def _counted(features: np.ndarray):
    """Positions and counts of the features in each text; features are sorted hashes."""
    near = np.zeros(1 << 16, bool)
    for salt in (np.int64(0), *OFTEN.values()):
        near[(features ^ salt) & 0xFFFF] = True

    def run(batches):
        for batch in slices(batches):
            rows, hashes, counts = _occurrences(batch.column("text"), near)
            found = []
            for n, salt in {1: np.int64(0), **OFTEN}.items():
                at = np.searchsorted(features, hashes ^ salt)
                at[at == len(features)] = 0
                hit = (counts >= n) & (features[at] == hashes ^ salt) if len(features) else np.zeros(len(at), bool)
                found.append(np.stack([rows[hit], at[hit], counts[hit] // n]))
            rows, at, counts = np.concatenate(found, axis=1)
            order = np.lexsort([at, rows])
            upto = pa.array(np.searchsorted(rows[order], np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(upto, pa.array(at[order].astype(np.int32))),
                    pa.ListArray.from_arrays(upto, pa.array(counts[order].astype(np.int32))),
                ],
                ["doc_id", "at", "counts"],
            )

    return run


def _surprise(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Log-likelihood ratio of a term's rows being shared a : b among n1 toxic and n0 clean rows; 0 for a clean mark."""
    n, rows = max(1, n1 + n0), a + b
    part = [(a, n1, rows), (b, n0, rows), (n1 - a, n1, n - rows), (n0 - b, n0, n - rows)]
    terms = [F.when(x > 0, x * F.log(x * n / (F.lit(max(1, m)) * total))).otherwise(0.0) for x, m, total in part]
    return F.when(a * n0 > b * n1, 2 * sum(terms[1:], terms[0])).otherwise(0.0)


class Index:
    """Inverted lists of examples by feature, cut into blocks, with the largest weight of each block."""

    def __init__(self, ids, toxic, vote, rows, at, weights, features: int, block: int):
        norm = np.sqrt(np.bincount(rows, weights**2, len(ids)))
        weights = weights / norm[rows]
        # Examples whose heaviest features agree share blocks, so that block bounds are tight.
        heavy = np.full(len(ids), features)
        for r in np.argsort(weights, kind="stable"):
            heavy[rows[r]] = at[r]
        place = np.empty(len(ids), np.int64)
        place[np.lexsort([ids, heavy])] = np.arange(len(ids))
        order = np.lexsort([place[rows], at])
        self.example, self.weight, feature = place[rows][order], weights[order], at[order]
        back = np.argsort(place)
        self.ids, self.toxic, self.vote = ids[back], toxic[back], vote[back]
        self.block, self.blocks = block, -(-len(ids) // block)
        self.edge = np.searchsorted(feature * self.blocks + self.example // block, np.arange(features * self.blocks + 1))
        self.posting = np.arange(len(self.example))
        self.most = np.zeros(features * self.blocks)
        np.maximum.at(self.most, feature * self.blocks + self.example // block, self.weight)
        self.most = self.most.reshape(features, self.blocks)

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The cosines and places of the k nearest examples of cosine above 0, ties to the smaller doc_id.

        Blocks are visited by falling bound, in rounds, until no bound reaches the k-th cosine.
        """
        weights = weights / np.sqrt((weights**2).sum())
        bound = weights @ self.most[at]
        visit = np.argsort(-bound, kind="stable")
        visit = visit[bound[visit] > 0]
        score = np.zeros(len(self.ids))
        done, step, kth = 0, VISIT, 0.0
        while done < len(visit) and bound[visit[done]] >= kth - 1e-9:
            blocks = visit[done : done + step]
            done, step = done + step, 2 * step
            first = (at[:, None] * self.blocks + blocks).ravel()
            places, ends = gathered(self.posting, self.edge, first)
            size = np.diff(ends, prepend=0)
            score += np.bincount(self.example[places], np.repeat(np.repeat(weights, len(blocks)), size) * self.weight[places], len(score))
            if k < len(score):
                kth = np.partition(score, len(score) - k)[len(score) - k]
        score = np.round(score, 12)
        near = np.flatnonzero(score >= max(round(kth, 12), 1e-12))
        near = near[np.lexsort([self.ids[near], -score[near]])][:k]
        return score[near], near


def examples(docs: DataFrame, labels: DataFrame, limits: Limits) -> tuple[DataFrame, dict[int, int]]:
    """The sampled labelled texts (doc_id, text, toxic), and how many labelled rows there are by label."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    present = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    total = {r["toxic"]: r["count"] for r in present.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id", F.lit(9)), F.col("doc_id")]
    some = present.where("toxic = 1").orderBy(*order).limit(limits.toxic)
    some = some.unionByName(present.where("toxic = 0").orderBy(*order).limit(limits.clean))
    chosen = plain(docs).join(F.broadcast(some), "doc_id")  # bounded by the limits
    return chosen.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")), total


def scored(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (neighbours with their cosine and label).

    With another `key` column the rows are named by that one, and held_out is left out.
    """
    chosen, total = examples(docs, labels, limits)
    chosen = stored(chosen, "examples")
    terms = chosen.select("doc_id", "toxic", "text").mapInArrow(_distinct_terms, "doc_id bigint, toxic int, terms array<bigint>")
    terms = stored(terms, "terms")
    sampled = {r["toxic"]: r["count"] for r in terms.groupBy("toxic").count().collect()}
    n1, n0 = sampled.get(1, 0), sampled.get(0, 0)
    count = terms.select("toxic", F.explode("terms").alias("term")).groupBy("term")
    count = count.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    marks = count.select("term", _surprise(F.col("a"), F.col("b"), n1, n0).alias("g"))
    marks = marks.where(F.col("g") >= SURE).orderBy(F.desc("g"), "term").limit(limits.features)
    features = np.sort(np.asarray([r["term"] for r in marks.collect()], np.int64))

    id_type = docs.schema[key].dataType.simpleString()
    form = f"doc_id {id_type}, at array<int>, counts array<int>"
    texts = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    vectors = stored(texts.mapInArrow(_counted(features), form), "vectors")
    hits = vectors.select(F.explode("at").alias("f")).groupBy("f").count().collect()  # as many rows as features
    everything = vectors.count()
    df = np.zeros(len(features))
    for r in hits:
        df[r["f"]] = r["count"]
    idf = np.log((1 + everything) / (1 + df)) + 1

    known = chosen.select("doc_id", "toxic").join(chosen.select("doc_id", "text").mapInArrow(_counted(features), "doc_id bigint, at array<int>, counts array<int>"), "doc_id")
    known = known.where(F.size("at") > 0).orderBy("doc_id").collect()  # bounded by the limits
    index = None
    if known:
        ids, toxic = np.asarray([r["doc_id"] for r in known]), np.asarray([r["toxic"] for r in known])
        rows = np.repeat(np.arange(len(known)), [len(r["at"]) for r in known])
        at = np.concatenate([r["at"] for r in known]).astype(np.int64)
        weights = (1 + np.log(np.concatenate([r["counts"] for r in known]))) * idf[at]
        # A sampled example votes for as many labelled rows as it stands for.
        vote = np.asarray([total[t] / sampled[t] for t in toxic])
        index = Index(ids, toxic, vote, rows, at, weights, len(features), limits.block)
    prior = total.get(1, 0) / max(1, sum(total.values()))

    def run(batches):
        for batch in batches:
            scores, evidence, known = [], [], {}
            for at, counts in zip(batch.column("at").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                key = (*at, *counts)
                if key not in known:
                    known[key] = (prior, [])
                    if at and index is not None:
                        f = np.asarray(at)
                        cosine, near = index.nearest(f, (1 + np.log(np.asarray(counts, float))) * idf[f], limits.neighbours)
                        weight = cosine * index.vote[near]
                        # The share of toxic rows counts as half a neighbour of cosine 1.
                        score = (weight[index.toxic[near] == 1].sum() + 0.5 * prior) / (weight.sum() + 0.5) if len(near) else prior
                        proof = zip(index.ids[near].tolist(), cosine.tolist(), index.toxic[near].tolist(), strict=True)
                        known[key] = (float(score), [{"doc_id": d, "cosine": c, "toxic": t} for d, c, t in proof])
                scores.append(known[key][0])
                evidence.append(known[key][1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, neighbours)], ["doc_id", "score", "evidence"]
            )

    neighbours = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    form = f"doc_id {id_type}, score double, evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>"
    found = vectors.mapInArrow(run, form)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    if key != "doc_id":
        return found.select(F.col("doc_id").alias(key), "score", predicted, "evidence")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "evidence")
