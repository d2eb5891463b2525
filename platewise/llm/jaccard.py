"""Join of documents by the Jaccard similarity of their word shingles.

Shingles are ordered from rare to frequent by their exact number of texts. A text's
prefix is the shortest beginning that it must share with any similar text, extended by
one shingle where frequent ones are in it. Rare shingles of the prefix are indexed
singly. A text whose prefix has frequent ones is indexed by combinations of its
shingles, of which any two similar texts share one. Texts that share a signature are
verified on their whole sets; verified links are joined by distributed union-find.

Links inside a group of many copies are not expanded: frequent shingles first link
each text with the first text that has them and with its neighbour in size, and only
pairs that are then still in different components need a combination. Of those that share
one, only pairs are read whole whose parities differ in no more bits than similar sets can.

Defined results: words are lower-cased (A-Z) runs of non-blanks; a text with fewer words
than a shingle is one shingle; a text without words, an empty or a null one links with
nothing; rows repeated with the same doc_id are documents each; a null doc_id never
names a component unless it has no other; an empty table gives no rows; other columns
are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import LOWER, SPACE, flat, mix, packed, partitions, plain, prefix_hash, shingle_hashes, signed, slices, span_hash, spare, stored, unpacked, word_spans
from platewise.llm.union import components

BLOCK_BYTES = 4_000_000
# Up to so many texts a shingle is rare.
RARE = 16
# Bits of the parity of a set, in numbers of 64.
PARITY = 512 // 64
PARITIES = [f"odd{i}" for i in range(PARITY)]
_U = np.uint64


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, end to end, and the offset of each text."""
    sets, counts = [np.zeros(0, np.uint64)], []
    for batch in slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])]):
        data, offsets = flat(batch.column("text"))
        data = LOWER[data]
        starts, ends, upto = word_spans(data, offsets, ~SPACE[data])
        hashes, bounds = shingle_hashes(span_hash(prefix_hash(data), starts, ends), upto, words)
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        order = np.lexsort([hashes, row])
        hashes, row = hashes[order], row[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        sets.append(hashes[fresh])
        counts.append(np.bincount(row[fresh], minlength=batch.num_rows))
    return np.concatenate(sets), np.concatenate([[0], *counts]).cumsum()


def _compressed(blocks: int):
    """block, th, ztext of each distinct text of a task."""

    def run(batches):
        pack, seen = zstandard.ZstdCompressor(3), set()
        for batch in slices(batches):
            keys, out = batch.column("th").to_numpy(), ([], [])
            data, offsets = flat(batch.column("text"))
            for i, key in enumerate(keys.tolist()):
                if key in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                out[0].append(key)
                out[1].append(pack.compress(data[offsets[i] : offsets[i + 1]].tobytes()))
            keys = np.asarray(out[0], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys % blocks), pa.array(keys), pa.array(out[1], pa.binary())], ["block", "th", "ztext"])

    return run


class _Block:
    """The distinct texts of a block, their sets, and the block's shingles dealt to buckets."""

    def __init__(self, block: pa.Table, words: int, bits: int, buckets: int):
        keys = block.column("th").to_numpy()
        self.keys, first = np.unique(keys, return_index=True)
        unpack = zstandard.ZstdDecompressor()
        column = block.column("ztext")
        self.sets, self.offsets = shingle_sets([unpack.decompress(column[int(i)].as_py()) for i in first], words)
        short = (self.sets >> _U(64 - bits)).astype(np.int64)
        # Distinct shingles by bucket, then value; where each text's shingles stand among them.
        dealt = (short % buckets << bits) | short // buckets
        self.dealt, self.where, self.counts = np.unique(dealt, return_inverse=True, return_counts=True)
        self.bounds = np.searchsorted(self.dealt >> bits, np.arange(buckets + 1))


def _counted_shingles(words: int, bits: int, buckets: int):
    """A block's distinct shingles and their numbers of texts, bucket by bucket."""

    def run(block: pa.Table) -> pa.Table:
        made, pack, rows = _Block(block, words, bits, buckets), zstandard.ZstdCompressor(3), []
        number = block.column("block")[0].as_py()
        for i, (a, b) in enumerate(zip(made.bounds[:-1], made.bounds[1:], strict=True)):
            if b > a:
                step = np.diff(made.dealt[a:b] & ((1 << bits) - 1), prepend=0)
                rows.append({"bucket": i, "block": number, "shingles": packed([step & 0xFFFFFFFF, step >> 32, made.counts[a:b]], pack)})
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("shingles", pa.binary())]))

    return run


def _frequencies(bucket: pa.Table) -> pa.Table:
    """For each block's shingles of a bucket, in order, how many texts of the corpus have them (255 or more: 255)."""
    pack, values, counts = zstandard.ZstdCompressor(3), [], []
    for blob in bucket.column("shingles"):
        low, high, n = unpacked(blob.as_py())
        values.append(np.cumsum(low.astype(np.int64) + (high.astype(np.int64) << 32)))
        counts.append(n)
    _, where = np.unique(np.concatenate(values), return_inverse=True)
    total = np.minimum(np.bincount(where, np.concatenate(counts)), 255).astype(np.uint8)[where]
    edges = np.cumsum([0, *map(len, values)])
    codes = [pack.compress(total[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"block": bucket.column("block"), "bucket": bucket.column("bucket"), "codes": pa.array(codes, pa.binary())})


def _prefixes(words: int, bits: int, buckets: int, least: int):
    """th, n, digest and the indexed shingles of each text: those of its prefix that other texts have, too."""

    def run(block: pa.Table, codes: pa.Table) -> pa.Table:
        made, unpack = _Block(block, words, bits, buckets), zstandard.ZstdDecompressor()
        df = np.zeros(len(made.dealt), np.uint8)
        for bucket, blob in zip(codes.column("bucket").to_pylist(), codes.column("codes").to_pylist(), strict=True):
            df[made.bounds[bucket] : made.bounds[bucket + 1]] = np.frombuffer(unpack.decompress(blob), np.uint8)
        df = df[made.where]
        out: dict[str, list] = {"th": [], "n": [], "digest": [], "shingles": [], "frequent": []}
        for key, a, b in zip(made.keys.tolist(), made.offsets[:-1], made.offsets[1:], strict=True):
            tokens, often, n = made.sets[a:b], df[a:b], int(b - a)
            order = np.argsort(often, kind="stable")  # within a frequency, by hash
            need = n - -(-least * n // 100) + 1
            rare = int((often <= RARE).sum())
            chosen = order[: need if rare >= need else need + 1]
            chosen = chosen[often[chosen] > 1]
            out["th"].append(key)
            out["n"].append(n)
            out["digest"].append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
            out["shingles"].append(signed(tokens[chosen]))
            out["frequent"].append(often[chosen] > RARE)
        return pa.table(out, schema)

    lists = [("shingles", pa.list_(pa.int64())), ("frequent", pa.list_(pa.bool_()))]
    schema = pa.schema([("th", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), *lists])
    return run


def _parity(tokens: np.ndarray) -> np.ndarray:
    """For each of some hash values, whether an odd number of a set's shingles has it, as bits.

    The bits of two sets differ in no more places than the sets do in shingles.
    """
    odd = np.bincount((mix(tokens ^ _U(0x5BD1E995)) >> _U(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _combined(words: int, least: int):
    """Combinations of a text's shingles: those that fall in the same hash class; and the set's parity.

    Two similar sets differ in a bounded number of shingles. With one class more than
    that, some class holds the same shingles in both. The number of classes goes by a
    scale of sizes; similar sets stand on the same or neighbouring steps, so each text
    takes part on its own step and the next.
    """
    ratio, apart = 100 / least, 2 * (100 - least) / (100 + least)

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "ztext", 500_000):
            sets, offsets = shingle_sets([unpack.decompress(z) for z in batch.column("ztext").to_pylist()], words)
            out: list[list[np.ndarray]] = [[], []]
            parity = np.zeros((PARITY, batch.num_rows), np.int64)
            for i in range(batch.num_rows):
                tokens = sets[offsets[i] : offsets[i + 1]]
                parity[:, i] = _parity(tokens)
                level = int(np.floor(np.log(max(1, len(tokens))) / np.log(ratio) + 1e-9))
                for step in (level, level + 1):
                    classes = int(ratio ** (step + 1) * apart + 1e-6) + 1
                    which = (mix(tokens ^ _U(step)) % _U(classes)).astype(np.int64)
                    total = np.zeros(classes, np.uint64)
                    np.add.at(total, which, mix(tokens))
                    key = mix(total ^ mix(np.arange(classes, dtype=np.uint64) * _U(4096) + _U(step)))
                    out[0].append(signed(key))
                    out[1].append(np.full(classes, i))
            row = pa.array(np.concatenate(out[1]))
            facts = [c.take(row) for c in (*map(batch.column, ("th", "n", "node")), *map(pa.array, parity))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), *facts], ["signature", "th", "n", "node", *PARITIES])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        last: dict[int, np.ndarray] = {}
        for batch in slices(batches, "two"):
            new = {}
            for key, blob in zip(("a", "b"), ("one", "two"), strict=True):
                for i, k in enumerate(batch.column(key).to_pylist()):
                    if k not in new:
                        new[k] = last.get(k)
                        if new[k] is None:
                            new[k] = unpack.decompress(batch.column(blob)[i].as_py())
            fresh = [k for k, v in new.items() if isinstance(v, bytes)]
            sets, offsets = shingle_sets([new[k] for k in fresh], words)
            for i, k in enumerate(fresh):
                new[k] = sets[offsets[i] : offsets[i + 1]]
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = new[a], new[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= least * (len(x) + len(y) - both))
            last = {a: new[a] for a in batch.column("a").to_pylist()[-1:]}
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("th").alias("a"), F.col("ztext").alias("one"))
    two = texts.select(F.col("th").alias("b"), F.col("ztext").alias("two"))
    # A table of pairs may be small; what is joined to it, texts, is not.
    rows = pairs.hint("merge").join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "one", "two").sortWithinPartitions("a")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _pairs(rows: DataFrame, least: int) -> DataFrame:
    """Distinct pairs (a, b) of th with each of its mates (th, n) that is not too small for it."""
    pair = rows.select("th", "n", F.explode("mates").alias("m"))
    fits = (F.col("m.th") != F.col("th")) & (100 * F.least("n", "m.n") >= least * F.greatest("n", "m.n"))
    return pair.where(fits).select(F.least("th", "m.th").alias("a"), F.greatest("th", "m.th").alias("b")).distinct()


def linked(docs: DataFrame, words: int = 3, least: int = 90) -> tuple[DataFrame, DataFrame]:
    """Every text (th, n) and the component of each linked one (node, root); th is `text_key`."""
    texts = plain(docs).select(text_key().alias("th"), "text").where("text != ''")
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, buckets = max(1, total // BLOCK_BYTES), 4 * partitions(docs.sparkSession)
    # Enough bits that few shingles are counted together.
    bits = min(62 - buckets.bit_length(), max(24, int(total).bit_length() + 8))
    # One exchange of the texts serves counting and choosing prefixes.
    dealt = texts.mapInArrow(_compressed(blocks), "block bigint, th bigint, ztext binary").repartition("block")
    counts = dealt.groupBy("block").applyInArrow(_counted_shingles(words, bits, buckets), "bucket bigint, block bigint, shingles binary")
    codes = counts.groupBy("bucket").applyInArrow(_frequencies, "block bigint, bucket bigint, codes binary")
    form = "th bigint, n bigint, digest binary, shingles array<bigint>, frequent array<boolean>"
    sets = dealt.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(_prefixes(words, bits, buckets, least), form)
    sets = stored(sets, "sets")

    equal = sets.where("n > 0").groupBy("digest").agg(F.min("th").alias("b"), F.count("*").alias("c")).where("c > 1")
    equal = sets.join(equal, "digest").select(F.col("th").alias("a"), "b").where("a != b")
    index = sets.select("th", "n", F.explode(F.arrays_zip("shingles", "frequent")).alias("s"))
    index = index.select("th", "n", F.col("s.shingles").alias("token"), F.col("s.frequent").alias("often"))
    order = Window.partitionBy("token").orderBy("n", "th")
    me = F.struct("th", "n")
    near = F.collect_list(me).over(order.rowsBetween(1 - RARE, -1))
    mates = F.when(F.col("often"), F.array_compact(F.array(F.first(me).over(order), F.lag(me).over(order)))).otherwise(near)
    pairs = stored(_pairs(index.withColumn("mates", mates), least), "pairs")
    ztexts = texts.mapInArrow(_compressed(blocks), "block bigint, th bigint, ztext binary")
    edges = stored(_verified(pairs, _wanted(ztexts, _ends(pairs)), words, least).unionByName(equal), "edges")
    roots = stored(components(edges), "roots")

    # Frequent shingles of several components: combinations, and pairs across components.
    often = index.where("often").join(roots.select(F.col("node").alias("th"), "root"), "th", "left")
    often = often.select("token", "th", "n", F.coalesce("root", "th").alias("node"))
    several = often.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("token")
    open_ = stored(often.join(several, "token").select("th", "n", "node").distinct(), "open")
    sources = open_.hint("merge").join(_wanted(ztexts, open_.select("th")), "th")
    combos = sources.mapInArrow(_combined(words, least), ", ".join(f"{c} bigint" for c in ("signature", "th", "n", "node", *PARITIES)))
    across = _across(combos, least)
    across = stored(across, "across")
    if not across.isEmpty():
        later = _verified(across, _wanted(ztexts, _ends(across)), words, least)
        roots = components(stored(later.unionByName(edges), "edges"))
    return sets.select("th", "n"), roots


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("th")).union(pairs.select("b")).distinct()


def _wanted(ztexts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some ids, each once."""
    return ztexts.join(ids.hint("merge"), "th", "left_semi").groupBy("th").agg(F.first("ztext").alias("ztext"))


def _across(combos: DataFrame, least: int) -> DataFrame:
    """Pairs of different components that share a combination and can be similar by size and parity."""
    counted = Window.partitionBy("signature")
    rows = combos.withColumn("x", F.min("node").over(counted)).withColumn("y", F.max("node").over(counted)).where("x != y")
    rows = rows.select("signature", "th", "n", "node", *PARITIES)
    other = rows.select("signature", *(F.col(c).alias(c + "2") for c in ("th", "n", "node", *PARITIES)))
    apart = reduce(add, (F.bit_count(F.col(c).bitwiseXOR(F.col(c + "2"))) for c in PARITIES))
    pair = rows.join(other, "signature").where("th < th2 and node != node2")
    pair = pair.where(100 * F.least("n", "n2") >= least * F.greatest("n", "n2"))
    # Similar sets differ in so many shingles at most.
    pair = pair.where((100 + least) * apart <= (100 - least) * (F.col("n") + F.col("n2")))
    return pair.select(F.col("th").alias("a"), F.col("th2").alias("b")).distinct()


def text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def similarity_groups(docs: DataFrame, words: int = 3, least: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    sets, roots = linked(docs, words, least)
    facts = sets.join(roots, sets["th"] == roots["node"], "left").select("th", "n", F.when(F.col("n") > 0, F.coalesce("root", "th")).alias("root"))
    rows = docs.select("doc_id", text_key().alias("th")).join(facts, "th", "left")
    rows = rows.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), "root")
    smallest = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    rows = rows.join(smallest, "root", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_per_group(docs: DataFrame, words: int = 5, least: int = 80) -> DataFrame:
    """The documents with one row of each group of similar ones, columns as they came.

    Rows are judged each by its own text: of a group, the row of the smallest doc_id stays
    (a null one only if there is no other), of its rows the text with the least key, and of
    rows equal in both any one. Documents without words all stay.
    """
    sets, roots = linked(docs, words, least)
    facts = sets.where("n > 0").join(roots, sets["th"] == roots["node"], "left").select("th", F.coalesce("root", "th").alias("root"))
    rows = docs.select("doc_id", text_key().alias("th")).groupBy("doc_id", "th").agg(F.count("*").alias("copies")).join(facts, "th")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")
    best = rows.groupBy("root").agg(F.min(first).alias("best"))
    rows = rows.join(best, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th")))
    key, id_, text = (spare(docs, c) for c in ("text_key", "id", "of"))
    judged = stored(rows.select(F.col("doc_id").alias(id_), F.col("th").alias(text), "stays", "copies"), "judged")
    keyed = docs.withColumn(key, text_key())
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(text))
    kept = keyed.join(judged.where("NOT stays OR copies > 1").select(id_, text), same, "left_anti")
    several = keyed.join(judged.where("stays AND copies > 1").select(id_, text), same, "left_semi").dropDuplicates(["doc_id", key])
    return kept.select(*docs.columns).union(several.select(*docs.columns))


OP2_SQL = """
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c
    FROM items x JOIN items y ON x.t = y.t AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
    GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 90 * (n + m - c)),
reach AS (
    WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a)
    SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN reach ON a = doc_id
"""
