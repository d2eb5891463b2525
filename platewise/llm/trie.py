"""The prefix trie of conversations, screened by a count-min sketch.

A prefix of d turns is known by a 128-bit digest: the exclusive or of one hash per turn
and position, so digests of all prefixes come from a running sum and a long conversation
need not lie in one task. A count-min sketch over the digests overestimates only: where
it says one, the prefix has a single member, and so has everything below it. Such tails
are finished where they lie. Only prefixes that may be shared are shuffled and grouped.

Everything about a subtree is a sum over the members of its top. A member is the
smallest one of all its nodes from some depth on; the code points it has between a node
and that depth are what the node saves, and the nodes without children are counted at
their smallest member.

Defined results: turns go by `turn`, null first, and ties by the hash of role and text;
a null role or text is empty; rows without conv_id are no conversation; a conversation
without turns is a member of the root; an empty table has no nodes; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import dropped, mix, partitions, stored
from platewise.llm.manifest import CRC32
from platewise.llm.ranks import ranked

# A conversation takes its first turns from the one that opens its hundred.
FAMILY, MOST_STEM = 100, 5
# Turns are summed up in runs of so many, then runs.
RUN = 4096
# Rows of the sketch, and the bounds of their cells: it has ROWS * cells / 8 bytes, 32 MB at most.
ROWS, LEAST_CELLS, MOST_CELLS = 4, 1 << 16, 1 << 26
SEGMENT = 1 << 16
NODE = ["depth", "p1", "p2"]
_U = np.uint64


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest and chars of every turn."""
    role, text = _or_empty("role"), _or_empty("text")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(digest).alias("digest"), F.char_length(text).alias("chars")
    )
    turns = stored(turns, "turns")
    out = ranked(turns, "conv_id", ["turn", "digest"], "turns").drop("turn")
    dropped(turns)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (conv_id, place, digest, chars, size), and their conversations (conv_id, size)."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    stem = F.crc32(F.col("conv_id").cast("string")) % (MOST_STEM + 1)
    convs = convs.select("conv_id", "own", stem.alias("stem"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("stem", F.coalesce("there", F.lit(0))))
    convs = stored(convs.withColumn("size", F.col("taken") + F.greatest(F.col("own") - F.col("stem"), F.lit(0))), "conversations")
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < MOST_STEM))
    first = first.withColumnRenamed("conv_id", "base")
    taken = convs.join(first, "base").where("place < stem").select("conv_id", "place", "digest", "chars", "size")
    rest = turns.join(convs, "conv_id").where("place >= stem")
    rest = rest.select("conv_id", (F.col("place") - F.col("stem") + F.col("taken")).alias("place"), "digest", "chars", "size")
    return taken.union(rest), convs.select("conv_id", "size")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every prefix of every conversation, also the empty one: its digest, its parent's, and the code points before its last turn."""
    rows = turns.select(
        "conv_id", "size", "chars", (F.col("place") + 1).alias("depth"), F.floor(F.col("place") / RUN).alias("run"),
        F.xxhash64("place", "digest").alias("z1"), F.xxhash64("digest", "place", F.lit(1)).alias("z2"),
    )
    upto = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"p1": F.bit_xor("z1"), "p2": F.bit_xor("z2"), "upto": F.sum("chars")}
    within = rows.withColumns({c: s.over(upto) for c, s in sums.items()})
    # What came before a run, for the few conversations of several runs.
    runs = rows.where(F.col("size") > RUN).groupBy("conv_id", "run").agg(*(s.alias(c) for c, s in sums.items()))
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "conv_id", "run", F.bit_xor("p1").over(earlier).alias("b1"), F.bit_xor("p2").over(earlier).alias("b2"),
        F.sum("upto").over(earlier).alias("b3"),
    )
    none = F.lit(0).cast("long")
    whole = within.join(runs, ["conv_id", "run"], "left").fillna(0, ["b1", "b2", "b3"]).select(
        "conv_id", "size", "depth", "chars", "z1", "z2",
        F.col("p1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("b2")).alias("p2"),
        (F.col("upto") + F.col("b3") - F.col("chars")).alias("before"),
    )
    whole = whole.select(
        "conv_id", "size", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("z1")).alias("q1"),
        F.col("p2").bitwiseXOR(F.col("z2")).alias("q2"), "before", F.col("chars").cast("long").alias("chars"),
    )
    roots = convs.select("conv_id", "size", *(none.alias(c) for c in ("depth", "p1", "p2", "q1", "q2", "before", "chars")))
    return whole.union(roots)


# ---- the sketch ----------------------------------------------------------------


def _cells(batch: pa.RecordBatch, one: str, two: str, cells: int) -> np.ndarray:
    """The cell of each digest in each row of the sketch."""
    a, b = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (one, two))
    return np.stack([mix(a ^ mix(b + _U(r + 1))) & _U(cells - 1) for r in range(ROWS)]).astype(np.int64)


def _counted(cells: int):
    """Per task: which cells were met once at least and which twice, in segments."""

    def run(batches):
        counts = np.zeros((ROWS, cells), np.uint8)
        for batch in batches:
            for r, at in enumerate(_cells(batch, "p1", "p2", cells)):
                at, n = np.unique(at, return_counts=True)
                counts[r, at] = np.minimum(counts[r, at] + n, 2)
        pack, flat = zstandard.ZstdCompressor(1), counts.reshape(-1, SEGMENT)
        for segment in np.flatnonzero(flat.any(axis=1)):
            met = [pack.compress(np.packbits(flat[segment] >= k).tobytes()) for k in (1, 2)]
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "once": [met[0]], "twice": [met[1]]})

    return run


def _merged(batches):
    """Adds up the segments of all tasks."""
    unpack, known = zstandard.ZstdDecompressor().decompress, {}
    for batch in batches:
        for segment, *met in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
            once, twice = (np.frombuffer(unpack(m), np.uint8) for m in met)
            have = known.setdefault(segment, [np.zeros_like(once), np.zeros_like(once)])
            have[1] |= twice | (have[0] & once)
            have[0] |= once
    for segment, (_, twice) in known.items():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "twice": [twice.tobytes()]})


def sketch(rows: DataFrame, cells: int) -> np.ndarray:
    """One bit per cell: whether its estimate is above one. Has ROWS * cells bits whatever the input."""
    counted = rows.select("p1", "p2").mapInArrow(_counted(cells), "segment int, once binary, twice binary")
    merged = counted.repartition(partitions(rows.sparkSession), "segment").mapInArrow(_merged, "segment int, twice binary")
    bits = np.zeros((ROWS * cells // SEGMENT, SEGMENT // 8), np.uint8)
    for row in merged.toLocalIterator():
        bits[row["segment"]] = np.frombuffer(row["twice"], np.uint8)
    return bits.reshape(ROWS, cells // 8)


def screened(rows: DataFrame, cells: int) -> DataFrame:
    """The rows with `shared` and `parent_shared`: false only where the prefix is proven to have one member."""
    known = rows.sparkSession.sparkContext.broadcast(sketch(rows, cells))

    def run(batches):
        bits = known.value
        for batch in batches:
            out = []
            for one, two in (("p1", "p2"), ("q1", "q2")):
                at = _cells(batch, one, two, cells)
                out.append(np.logical_and.reduce([bits[r, c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1 for r, c in enumerate(at)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], [*batch.schema.names, "shared", "parent_shared"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, shared boolean, parent_shared boolean")


# ---- nodes ---------------------------------------------------------------------

NOBODY = hashlib.sha256(b"").hexdigest()


def _listed(batches):
    """Digests of the members of each node, read in order: only the running hash is kept."""
    now, digest = None, None

    def row():
        return pa.RecordBatch.from_pydict({c: [v] for c, v in zip(NODE, now, strict=True)} | {"ends_sha256": [digest.hexdigest()]})

    for batch in batches:
        for *node, conv in zip(*(batch.column(c).to_pylist() for c in [*NODE, "conv_id"]), strict=True):
            if node != now:
                if now is not None:
                    yield row()
                now, digest = node, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
    if now is not None:
        yield row()


def _ends(shared: DataFrame) -> DataFrame:
    ends = shared.where("depth = size").select(*NODE, "conv_id")
    ordered = ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    return ordered.mapInArrow(_listed, "depth long, p1 long, p2 long, ends_sha256 string")


def _parents(groups: DataFrame) -> DataFrame:
    """The key under which a node's children find it, and its conv_id."""
    return groups.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations."""
    turns = ordered_turns(conversations)
    rows = stored(prefixes(*rebuilt(turns)), "prefixes")
    cells = min(max(LEAST_CELLS, 1 << (4 * rows.count()).bit_length()), MOST_CELLS)
    rows = screened(rows, cells)
    # Proven singletons are nodes already; but the first of a tail asks the group above it for its name.
    alone = rows.where("NOT shared")
    shared = stored(rows.where("shared"), "shared")
    groups = shared.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("size")).alias("ends"),
        *(F.max(c).alias(c) for c in ("q1", "q2", "before")), F.bool_or("parent_shared").alias("parent_shared"),
    )
    groups = stored(groups, "groups")
    heads = stored(alone.where("parent_shared"), "heads")
    # Per conversation: the code points before the depth from which on it is the smallest member, and whether it ends a branch.
    mark = F.struct("depth", "before")
    last = rows.where("depth = size").select(
        "conv_id", F.struct((F.col("depth") + 1).alias("depth"), (F.col("before") + F.col("chars")).alias("before")).alias("mark"),
        (~F.col("shared")).cast("long").alias("leaf"),
    )
    marks = last.union(groups.select("conv_id", mark.alias("mark"), (F.col("ends") == F.col("n_convs")).cast("long").alias("leaf")))
    marks = marks.union(heads.select("conv_id", mark.alias("mark"), F.lit(0).cast("long").alias("leaf")))
    marks = marks.groupBy("conv_id").agg(F.min("mark")["before"].alias("kept_from"), F.max("leaf").alias("leaf"))
    sums = shared.join(marks, "conv_id").groupBy(*NODE).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("kept_from") - F.col("before"), F.lit(0))).alias("saved_tokens")
    )
    below = groups.where("parent_shared AND depth > 0").select("depth", "q1", "q2").union(heads.where("depth > 0").select("depth", "q1", "q2"))
    below = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = groups.join(sums, NODE).join(below, NODE, "left").join(_ends(shared), NODE, "left")
    nodes = nodes.join(_parents(groups), ["depth", "q1", "q2"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )
    one = F.lit(1).cast("long")

    def tail(df: DataFrame, parent: Column) -> DataFrame:
        end = F.col("depth") == F.col("size")
        return df.select(
            "conv_id", "depth", F.when(F.col("depth") > 0, parent).alias("parent_conv_id"), one.alias("n_convs"),
            (~end).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
            F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOBODY).alias("ends_sha256"),
        )

    first = tail(heads.join(_parents(groups), ["depth", "q1", "q2"], "left"), F.coalesce("parent", "conv_id"))
    return nodes.union(first).union(tail(alone.where("NOT parent_shared"), F.col("conv_id")))


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32.format("conv_id")} % 6 AS stem FROM turns GROUP BY conv_id
), mixed AS (
  SELECT c.conv_id, 0 AS own, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < c.stem
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.stem
), rebuilt AS (
  SELECT conv_id, text, sha256(strlen(role) || ':' || role || text) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth
  FROM mixed
), prefixes AS (
  SELECT conv_id, depth, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, length(text) AS chars FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM convs
), sized AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM prefixes
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saves,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM sized GROUP BY prefix, depth
), tied AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.prefix AS above
  FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND p.prefix = left(n.prefix, 64 * (n.depth::INT - 1))
), counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM tied n
  LEFT JOIN (SELECT above, count(*) AS n FROM tied WHERE depth > 0 GROUP BY above) c ON c.above = n.prefix
), below AS (
  SELECT s.prefix, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum(x.saves)::BIGINT AS saved_tokens
  FROM counted x JOIN sized s ON s.conv_id = x.conv_id AND s.depth <= x.depth GROUP BY s.prefix
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM counted JOIN below USING (prefix)
"""
