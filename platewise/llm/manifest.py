"""A Merkle manifest of a table, with a proof for every row, by pivoting slots.

Leaves get their place within their language; a place divided by the fanout is the
place of the parent, the remainder the slot. Conditional aggregates spread the children
of a parent into one column per slot: concatenating the columns and hashing gives the
parent, leaving out a row's own slot gives its siblings. `LEVELS` levels are spread at
once (fanout ** LEVELS columns), so a shuffle serves several levels and the next one
moves that many times fewer rows. On the way down each block hands the path above it to
its slots; the only rows that carry a whole path are those that are returned.

Defined results: a null column of a leaf is `-`; a null `lang` is a group of its own and
comes first; leaves of one language ascend by doc_id, null first, and rows of one doc_id
by their hash, so repeated rows are leaves side by side; a null doc_id is never tampered
with; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import dropped, stored
from platewise.llm.ranks import ranked

FANOUT, LEVELS = 2, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_hash(**values: Column) -> Column:
    """Hash of the fields, each with its length before it; `values` stand in for columns."""

    def part(field: str) -> Column:
        value = values.get(field, F.col(field)).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(part, FIELDS)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path of siblings."""
    return F.aggregate(path, leaf, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def proof_hash(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _height(rows: Column, fanout: int) -> Column:
    """Levels above the leaves: how often `rows` nodes become runs of `fanout` until one node is left."""
    powers = [fanout**i for i in range(64) if fanout**i < 1 << 62]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < rows))


def _joined(nodes: list[Column]) -> Column:
    return F.concat(F.lit(""), *(F.coalesce(n, F.lit("")) for n in nodes))


def _pivoted(nodes: DataFrame, done: int, fanout: int, levels: int) -> DataFrame:
    """One row per block: the nodes in its slots (s0, s1, ...) and the hashes of each level above (h<level>_<place>)."""
    width = fanout**levels
    slot = F.col("place") % width
    slots = [F.max(F.when(slot == i, F.col("node"))).alias(f"s{i}") for i in range(width)]
    blocks = nodes.groupBy("key", F.expr(f"place div {width}").alias("place")).agg(F.max("height").alias("height"), *slots)
    blocks = blocks.withColumns({f"h0_{i}": F.col(f"s{i}.hash") for i in range(width)})
    for level in range(levels):
        made = {}
        for i in range(fanout ** (levels - level - 1)):
            run = [F.col(f"h{level}_{i * fanout + k}") for k in range(fanout)]
            parent = F.when(run[0].isNotNull(), F.sha2(_joined(run), 256))
            # A node that is alone in its tree is the top already.
            made[f"h{level + 1}_{i}"] = F.when(F.col("height") > done + level, parent).otherwise(run[0])
        blocks = blocks.withColumns(made)
    return blocks


def _steps(slot: int, done: int, fanout: int, levels: int) -> Column:
    """The path from a slot to the top of its block: what stands left and right of it on each level."""
    steps = []
    for level in range(levels):
        at = slot // fanout**level
        first = at - at % fanout
        left = _joined([F.col(f"h{level}_{i}") for i in range(first, at)])
        right = _joined([F.col(f"h{level}_{i}") for i in range(at + 1, first + fanout)])
        steps.append(F.when(F.col("height") > done + level, F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda step: step.isNotNull())


def _grown(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of all rounds, lowest first, and the top of each tree. `nodes`: key, place, node with a field `hash`."""
    counts = nodes.groupBy("key").agg(F.count("*").alias("n"))
    counts = stored(counts.select("key", _height(F.col("n"), fanout).alias("height")), "heights")
    most = counts.agg(F.max("height")).first()[0] or 0
    rounds, done, now = [], 0, nodes.join(counts, "key")
    while not rounds or done < most:
        rounds.append(stored(_pivoted(now, done, fanout, levels), "blocks"))
        done += levels
        top = F.col(f"h{levels}_0")
        now = rounds[-1].select("key", "place", "height", F.struct(top.alias("hash")).alias("node"), top.alias("top"))
    dropped(counts)
    return rounds, now.select("key", "top")


def _descended(rounds: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Every lowest node with its path. `tops`: key, the path above the tree, and what all its nodes are given along."""
    along = [c for c in tops.columns if c not in ("key", "path")]
    paths = tops.withColumn("place", F.lit(0).cast("long"))
    for i in reversed(range(len(rounds))):
        blocks, width = rounds[i].join(paths, ["key", "place"]), fanout**levels
        slots = [
            F.struct(
                (F.col("place") * width + s).alias("place"),
                F.col(f"s{s}").alias("node"),
                F.concat(_steps(s, i * levels, fanout, levels), F.col("path")).alias("path"),
            )
            for s in range(width)
        ]
        each = blocks.select("key", *along, F.explode(F.array(*slots)).alias("slot")).where("slot.node IS NOT NULL")
        paths = each.select("key", *along, "slot.place", "slot.path", *(["slot.node"] if i == 0 else []))
    return paths


def manifest(leaves: DataFrame, carry: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Every leaf with its subroot, the root, and `path`, its siblings from the leaf to the root.

    `leaves`: lang, leaf, and `carry`, columns that go along; the first of them orders the
    leaves of a language.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # orders like lang, null first
    rows = stored(leaves.select(key.alias("key"), "leaf", *carry), "leaves")
    placed = ranked(rows, "key", [carry[0], "leaf"], "places")
    dropped(rows)
    low, subroots = _grown(
        placed.select("key", "place", F.struct(F.col("leaf").alias("hash"), *carry).alias("node")), fanout, levels
    )
    subroots = stored(subroots.withColumn("all", F.lit("all")), "subroots")
    langs = ranked(subroots, "all", ["key"], "langs").select(
        F.col("all").alias("key"), "place", F.struct(F.col("top").alias("hash"), "key").alias("node")
    )
    high, roots = _grown(langs, fanout, levels)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    above = _descended(high, roots.select("key", F.col("top").alias("root"), nothing.alias("path")), fanout, levels)
    above = stored(above.select(F.col("node.key").alias("key"), F.col("node.hash").alias("subroot"), "root", "path"), "above")
    found = _descended(low, above, fanout, levels)
    return found.select(*(F.col(f"node.{c}").alias(c) for c in carry), F.col("node.hash").alias("leaf"), "subroot", "root", "path")


def proofs(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of the table as it is; folded_root and verified after tampering.

    Tampering adds 1 to n_chars of every row whose doc_id, as decimal text, has an
    unsigned crc32 that 7 divides; its root is then folded from the changed leaf.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    altered = F.when(hit, leaf_hash(n_chars=F.col("n_chars") + 1))
    leaves = docs.select("doc_id", "lang", leaf_hash().alias("leaf"), altered.alias("altered"))
    made = manifest(leaves, ["doc_id", "altered"], fanout, levels)
    made = made.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return made.select(
        "doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


# crc32 bit by bit, of the decimal text of a number {0}.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({0}::VARCHAR) + 1),
  lambda i: ascii(substr({0}::VARCHAR, i::INT, 1))::BIGINT)), lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
  lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(f) for f in ["doc_id", "source", "lang", "{n_chars}", "text"])
# Trees of all languages first, then the tree of their tops, whose key is 'all'.
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS key, sha256({_LEAF.format(n_chars="n_chars")}) AS leaf,
         CASE WHEN {CRC32.format("doc_id")} % 7 = 0 THEN sha256({_LEAF.format(n_chars="(n_chars + 1)")}) END AS altered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY key) AS n
  FROM leaves
), low AS (
  SELECT key, 0 AS level, place, leaf AS hash, n FROM placed
  UNION ALL
  SELECT key, level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (n + 1) // 2
  FROM low WHERE n > 1 GROUP BY key, level, place // 2, n
), subroots AS (
  SELECT key, hash, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, place, hash, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (n + 1) // 2
  FROM high WHERE n > 1 GROUP BY level, place // 2, n
), upper AS (
  SELECT place, 0 AS level, hash AS top, place AS at, '' AS siblings, [] :: STRUCT(l VARCHAR, r VARCHAR)[] AS path FROM subroots
  UNION ALL
  SELECT u.place, u.level + 1, u.top, u.at // 2, siblings || coalesce(s.hash, ''),
         list_append(path, CASE WHEN u.at % 2 = 1 THEN {{'l': s.hash, 'r': ''}} ELSE {{'l': '', 'r': coalesce(s.hash, '')}} END)
  FROM upper u JOIN high own ON own.level = u.level AND own.place = u.at AND own.n > 1
  LEFT JOIN high s ON s.level = u.level AND s.place = xor(u.at, 1)
), lower_path AS (
  SELECT key, place AS leaf_place, 0 AS level, place AS at, '' AS siblings, [] :: STRUCT(l VARCHAR, r VARCHAR)[] AS path FROM placed
  UNION ALL
  SELECT u.key, u.leaf_place, u.level + 1, u.at // 2, siblings || coalesce(s.hash, ''),
         list_append(path, CASE WHEN u.at % 2 = 1 THEN {{'l': s.hash, 'r': ''}} ELSE {{'l': '', 'r': coalesce(s.hash, '')}} END)
  FROM lower_path u JOIN low own ON own.key = u.key AND own.level = u.level AND own.place = u.at AND own.n > 1
  LEFT JOIN low s ON s.key = u.key AND s.level = u.level AND s.place = xor(u.at, 1)
), whole AS (
  SELECT p.doc_id, p.leaf, p.altered, s.hash AS subroot, (SELECT hash FROM high WHERE n = 1) AS root,
         l.siblings || u.siblings AS siblings, list_concat(l.path, u.path) AS path
  FROM placed p
  JOIN (SELECT * FROM lower_path QUALIFY row_number() OVER (PARTITION BY key, leaf_place ORDER BY level DESC) = 1) l
    ON l.key = p.key AND l.leaf_place = p.place
  JOIN subroots s ON s.key = p.key
  JOIN (SELECT * FROM upper QUALIFY row_number() OVER (PARTITION BY place ORDER BY level DESC) = 1) u ON u.place = s.place
), folded AS (
  SELECT *, list_reduce(list_concat([coalesce(altered, leaf)], list_transform(path, lambda s: s.l || '/' || s.r)),
                        lambda h, s: sha256(split_part(s, '/', 1) || h || split_part(s, '/', 2))) AS folded_root
  FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
