"""Nearest root items by cosine similarity, exactly or through an index, without a cross join.

The catalogue is divided into cells around centroids and packed into blocks of bounded
size; queries are packed likewise. A block of queries is joined with the blocks of the
cells it has to visit and reads them as a stream, keeping its k best so far, so a query
emits a fixed number of rows however large the catalogue and its cells are.

* Exact search is a threshold join in two passes. The first looks into one block of the
  nearest cells and gives each query a lower bound of its k-th similarity; the second
  visits the cells whose upper bound, from the angle to the centroid and the cell's
  radius, reaches it.
* Approximate search replaces the radius by what neighbours need: the spread of a cell
  times a reach that is fitted to find a given share of the neighbours of a sample. Rows
  are scored by product-quantised residuals, and the shortlist again by exact similarity.
  Centroids and codebooks are trained by rounds of aggregates, or given.

Ids may be of any type that can be ordered; they are unique on either side. Rows without
a vector are left out. A zero vector is similar to nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import ClassVar, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
MAX_CELLS = 1024
# Rows compared with all cells, codes or rows of a block at a time, which bounds a task's memory.
CHUNK_ROWS = 512
# A block of queries holds so many blocks' rows: the catalogue is read that much less often.
QUERY_BLOCKS = 2
# A block of queries is searched in so many tasks, each with a share of the catalogue's blocks.
SLABS = 4
# Similarities are whole millionths, ranked and compared as such.
DIGITS = 6
SCALE = 10**DIGITS
LEAST, MOST = -(1 << 62), 1 << 62
ROUNDS = 3
PART_DIMS, CODES = 4, 256
# The reach of an index is fitted to so many queries, to find this share of their neighbours.
FITTED, SHARE = 256, 0.95


@dataclass(frozen=True)
class Index:
    """What an approximate search knows of a catalogue; it may also be given by hand.

    Centroids (cells × dimensions, length 1), codebooks of the residuals (parts × codes ×
    dimensions of a part, at most 256 codes), and how far above a query's similarity to
    its centroid a cell is worth a visit.
    """

    centroids: np.ndarray
    codebooks: np.ndarray
    reach: np.ndarray


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    matrix = matrix.astype("float64")
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype("float32")
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _bytes(blob: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(blob, "float32").reshape(rows, -1)


def _angles(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centroids.T, -1.0, 1.0))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK_ROWS):
            yield batch.slice(start, CHUNK_ROWS)


def _rows(df: DataFrame) -> DataFrame:
    return df.filter("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<float>").alias("embedding"))


def cells_for(rows: int) -> int:
    """Cells grow with the square root of the catalogue."""
    return max(1, min(MAX_CELLS, math.isqrt(max(rows - 1, 0)) + 1))


def seeds(catalogue: DataFrame, n: int) -> np.ndarray:
    """The n rows with the least hashes of their ids: bounded, and the same on every run."""
    rows = _rows(catalogue).orderBy(F.xxhash64("id"), "id").limit(n).collect()
    return _unit(np.array([r["embedding"] for r in rows], "float32")) if rows else np.zeros((0, 0))


# ---- training ------------------------------------------------------------------


def _split(residuals: np.ndarray, parts: int) -> np.ndarray:
    """Residuals as parts of equal width, the last one filled up with zeros."""
    width = -(-residuals.shape[1] // parts)
    filled = np.zeros((len(residuals), parts * width))
    filled[:, : residuals.shape[1]] = residuals
    return filled.reshape(len(residuals), parts, width)


def _codes(split: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """The nearest code of every part of every row."""
    distance = (codebooks**2).sum(axis=2)[None] - 2 * np.einsum("npd,pcd->npc", split, codebooks, optimize=True)
    return distance.argmin(axis=2)


def _lloyd(rows: DataFrame, split: Callable[[np.ndarray], np.ndarray], books: np.ndarray) -> np.ndarray:
    """One round: every row joins its nearest code in every part, and the code moves to their mean.

    Tasks add up whole millionths, so the result does not depend on their order, and
    emit one row per code; a code that nobody joins stays.
    """
    parts, codes, width = books.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, "int64"), np.zeros((parts, codes), "int64")
        for batch in _chunks(batches):
            pieces = split(_unit(_matrix(batch.column("embedding"))))
            for p, nearest in enumerate(_codes(pieces, books).T):
                np.add.at(total[p], nearest, np.rint(pieces[:, p] * SCALE).astype("int64"))
                np.add.at(count[p], nearest, 1)
        met = np.argwhere(count > 0)
        columns = [pa.array(met[:, 0], pa.int32()), pa.array(met[:, 1], pa.int32()), pa.array(count[count > 0], pa.int64())]
        sums = pa.array(list(total[count > 0]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*columns, sums], ["part", "code", "n", "sums"])

    def merged(table: pa.Table) -> pa.Table:
        sums = table.column("sums").combine_chunks().flatten().to_numpy().reshape(table.num_rows, width).sum(axis=0)
        first = [table.column(c)[0].as_py() for c in ("part", "code")]
        n = int(table.column("n").to_numpy().sum())
        return pa.table({"part": pa.array([first[0]], pa.int32()), "code": pa.array([first[1]], pa.int32()), "n": [n], "sums": [sums]})

    schema = "part int, code int, n long, sums array<long>"
    found = rows.select("embedding").mapInArrow(partial, schema).groupBy("part", "code").applyInArrow(merged, schema)
    moved = books.copy()
    for row in found.collect():  # parts × codes rows at most
        moved[row["part"], row["code"]] = np.array(row["sums"]) / row["n"] / SCALE
    return moved


def train_index(
    catalogue: DataFrame,
    cells: int | None = None,
    rounds: int = ROUNDS,
    part_dims: int = PART_DIMS,
    codes: int = CODES,
    neighbours: int = 10,
    share: float = SHARE,
) -> Index:
    """An index from the whole catalogue: k-means of the directions, then of the parts of what is left.

    The reach is fitted last, to the exact neighbours of the ``FITTED`` rows with the
    least hashes of their ids: with it, ``share`` of them lie in cells that are visited.
    """
    rows = _rows(catalogue)
    cells = cells or cells_for(rows.count())
    first = seeds(catalogue, max(cells, codes))
    if not len(first):
        return Index(first, np.zeros((1, codes, 0)), np.zeros(0))
    centroids = first[:cells]
    for _ in range(rounds):
        centroids = _unit(_lloyd(rows, lambda v: v[:, None], centroids[None])[0])
    parts = -(-centroids.shape[1] // part_dims)

    def residuals(v: np.ndarray) -> np.ndarray:
        return _split(v - centroids[(v @ centroids.T).argmax(axis=1)], parts)

    books = np.ascontiguousarray(residuals(first[-codes:]).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _lloyd(rows, residuals, books)
    return Index(centroids, books, _fitted_reach(rows, centroids, neighbours, share))


def _fitted_reach(rows: DataFrame, centroids: np.ndarray, neighbours: int, share: float) -> np.ndarray:
    """Per cell its spread times the least factor that lets `share` of the sample's neighbours be found."""
    assigned = _assigned(rows, centroids)
    spread = np.full(len(centroids), 1e-6)
    for cell, squares in assigned.groupBy("cell").agg(F.avg(2 - 2 * F.cos("angle"))).collect():
        spread[cell] = math.sqrt(max(squares, 0.0) / centroids.shape[1]) + 1e-6
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FITTED)
    found = cosine_topk(sample, rows, neighbours).join(assigned.select("id", "cell"), "id")
    found = found.select(F.col("query_id").alias("id"), "similarity", "cell").join(sample, "id").collect()
    asked = _unit(np.array([r["embedding"] for r in found], "float32"))
    cell, similarity = np.array([r["cell"] for r in found]), np.array([r["similarity"] for r in found])
    last: dict = {}
    for r in found:
        last[r["id"]] = min(last.get(r["id"], 1.0), r["similarity"])
    least = np.array([last[r["id"]] for r in found])
    needed = (least - np.einsum("nd,nd->n", asked, centroids[cell])) / spread[cell]
    return spread * np.quantile(needed[similarity >= least], share)


# ---- blocks --------------------------------------------------------------------


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, the vector's bytes, the nearest cell and the angle to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            matrix = _matrix(batch.column("embedding"))
            angles = _angles(_unit(matrix), centroids)
            blobs = pa.array([row.tobytes() for row in matrix], pa.binary())
            cell, angle = pa.array(angles.argmin(axis=1), pa.int32()), pa.array(angles.min(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), blobs, cell, angle], ["id", "vector", "cell", "angle"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vector binary, cell int, angle double")


def _cell_sizes(assigned: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    counts, radius = np.zeros(cells, "int64"), np.zeros(cells)
    for cell, n, angle in assigned.groupBy("cell").agg(F.count("*"), F.max("angle")).collect():
        counts[cell], radius[cell] = n, angle
    return counts, radius


def _shared_cells(centroids: np.ndarray, counts: np.ndarray, block_rows: int) -> tuple[Column, np.ndarray]:
    """Cells in order of their angle to the first one, joined until they hold a block's rows: the new cell, and the rows of each."""
    order = np.argsort(-(centroids @ centroids[0]), kind="stable")
    cell = np.zeros(len(counts), "int64")
    cell[order] = (np.cumsum(counts[order]) - counts[order]) // block_rows
    rows = np.bincount(cell, counts).astype("int64")
    return F.get(F.array(*[F.lit(int(c)) for c in cell]), F.col("cell")), rows


def _packed(assigned: DataFrame, counts: np.ndarray, block_rows: int, encode: Callable[[np.ndarray, int], bytes] | None = None) -> DataFrame:
    """One row per block: cell, number, the ids in order, and their vectors, or codes, one after another."""
    numbers = F.array(*[F.lit(int(n)) for n in np.maximum(-(-counts // block_rows), 1)])
    number = F.pmod(F.xxhash64("id"), F.get(numbers, F.col("cell"))).cast("int")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        blob, cell = b"".join(table.column("vector").to_pylist()), table.column("cell")[0].as_py()
        if encode is not None:
            blob = encode(_bytes(blob, table.num_rows), cell)
        ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("id").combine_chunks())
        columns = [table.column("cell").slice(0, 1).combine_chunks(), table.column("number").slice(0, 1).combine_chunks(), ids]
        return pa.table([*columns, pa.array([blob], pa.binary())], ["cell", "number", "ids", "block"])

    kind = assigned.schema["id"].dataType.simpleString()
    rows = assigned.select("id", "vector", "cell", number.alias("number"))
    return rows.groupBy("cell", "number").applyInArrow(pack, f"cell int, number int, ids array<{kind}>, block binary")


# ---- search --------------------------------------------------------------------


class Strategy(Protocol):
    strict: bool  # whether no row of a cell exceeds its bound

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The best score each query can find in each cell; LEAST where it does not look."""

    def scores(self, queries: np.ndarray, cell: int, block: bytes, rows: int) -> np.ndarray:
        """The score of each query with each row of a block."""


def _nearest_cells(angles: np.ndarray, counts: np.ndarray, rows: int) -> np.ndarray:
    """MOST for the nearest cells that hold enough rows between them."""
    angles = np.where(counts > 0, angles, np.inf)
    order = np.argsort(angles, axis=1, kind="stable")
    before = np.cumsum(counts[order], axis=1) - counts[order]
    bounds = np.full(angles.shape, LEAST)
    np.put_along_axis(bounds, order, np.where((before < rows) & (counts[order] > 0), MOST, LEAST), axis=1)
    return bounds


@dataclass(frozen=True)
class _First:
    """One block of the nearest cells, as many as hold k rows."""

    centroids: np.ndarray
    counts: np.ndarray
    k: int
    strict: ClassVar[bool] = False

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return _nearest_cells(_angles(queries, self.centroids), self.counts, self.k)

    def scores(self, queries: np.ndarray, cell: int, block: bytes, rows: int) -> np.ndarray:
        return np.rint(queries @ _unit(_bytes(block, rows)).T * SCALE).astype("int64")


@dataclass(frozen=True)
class _Exact(_First):
    """Every cell that may hold a row as near as a query's bound."""

    radius: np.ndarray
    strict: ClassVar[bool] = True

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        nearest = np.maximum(_angles(queries, self.centroids) - self.radius, 0.0)
        # Two millionths of slack for rounding on either side.
        return np.where(self.counts > 0, np.floor(np.cos(nearest) * SCALE).astype("int64") + 2, LEAST)


@dataclass(frozen=True)
class _CodedFirst(_First):
    """As _First, by the codes of the residuals."""

    codebooks: np.ndarray

    def scores(self, queries: np.ndarray, cell: int, block: bytes, rows: int) -> np.ndarray:
        codes = np.frombuffer(block, "uint8").reshape(rows, len(self.codebooks))
        split = _split(queries, len(self.codebooks))
        score = np.repeat((queries @ self.centroids[cell])[:, None], rows, axis=1)
        for part, book in enumerate(self.codebooks):
            score += (split[:, part] @ book.T)[:, codes[:, part]]
        return np.rint(score * SCALE).astype("int64")


@dataclass(frozen=True)
class _Coded(_CodedFirst):
    """The cells within reach of a query's bound, and the nearest ones in any case."""

    reach: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        likely = np.rint((queries @ self.centroids.T + self.reach) * SCALE).astype("int64")
        return np.where(self.counts > 0, np.maximum(likely, super().bounds(queries)), LEAST)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of every row, by score and then lower id."""
    order = np.unique(ids, return_inverse=True)[1].reshape(ids.shape)
    best = np.lexsort((order, -score), axis=1)[:, :k]
    return np.take_along_axis(score, best, axis=1), np.take_along_axis(ids, best, axis=1)


class _Running:
    """A block of queries with the k best rows met so far."""

    def __init__(self, row: dict, strategy: Strategy, k: int, kinds: list[pa.DataType]):
        self.key, self.ids, self.k, self.strategy, self.kinds = (row["qcell"], row["qnumber"]), row["ids"], k, strategy, kinds
        self.queries = _unit(_bytes(row["block"], len(row["ids"])))
        self.bounds = strategy.bounds(self.queries)
        self.floor = np.frombuffer(row["floor"], "int64") if row["floor"] else np.full(len(row["ids"]), LEAST)
        self.score, self.found = np.zeros((len(row["ids"]), 0), "int64"), None

    def least(self) -> np.ndarray:
        """What a row must reach to matter: the bound, or the k-th best so far.

        Cells that only probably hold nothing better are judged by the bound alone, so
        that the order of blocks does not change the result.
        """
        full = self.strategy.strict and self.score.shape[1] == self.k
        return np.maximum(self.floor, self.score[:, -1]) if full else self.floor

    def read(self, row: dict) -> None:
        live = np.flatnonzero((self.bounds[:, row["cell"]] >= self.least()) & (self.bounds[:, row["cell"]] > LEAST))
        ids = row["ids"]
        if not len(live) or not len(ids):
            return
        if self.found is None:
            self.found = np.full((len(self.ids), 0), ids[0], ids.dtype)
        n, kept = len(ids), min(self.k, len(ids))
        width = self.score.shape[1] + kept
        new, found = np.full((len(self.ids), width), LEAST), np.full((len(self.ids), width), ids[0], ids.dtype)
        new[:, : self.score.shape[1]], found[:, : self.score.shape[1]] = self.score, self.found
        for some in np.split(live, range(CHUNK_ROWS, len(live), CHUNK_ROWS)):
            score = self.strategy.scores(self.queries[some], row["cell"], row["block"], n)
            # The ids of a block are in order: one number orders by score, then lower id.
            best = np.argpartition(score * n + np.arange(n - 1, -1, -1), n - kept, axis=1)[:, n - kept :]
            new[some, self.score.shape[1] :] = np.take_along_axis(score, best, axis=1)
            found[some, self.score.shape[1] :] = ids[best]
        self.score, self.found = _best(new, found, self.k)


def _stream(strategy: Strategy, k: int, finish: Callable[[_Running], pa.RecordBatch]):
    """Reads blocks in order: each block of queries, then the blocks of the catalogue it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Running | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("qcell", "qnumber", "cell", "floor", "block")}
                side = "query_ids" if row["cell"] < 0 else "ids"
                row["ids"] = batch.column(side)[i].values.to_numpy(zero_copy_only=False)
                if row["cell"] < 0:
                    if now is not None:
                        yield finish(now)
                    kinds = [batch.schema.field(c).type.value_type for c in ("query_ids", "ids")]
                    now = _Running(row, strategy, k, kinds)
                else:
                    now.read(row)
        if now is not None:
            yield finish(now)

    return run


def _bounds_met(done: _Running) -> pa.RecordBatch:
    floor = done.score[:, -1] if done.score.shape[1] == done.k else np.full(len(done.ids), LEAST)
    columns = [pa.array([done.key[0]], pa.int32()), pa.array([done.key[1]], pa.int32()), pa.array([floor.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["cell", "number", "floor"])


def _listed(done: _Running) -> pa.RecordBatch:
    # Below a strict bound of its k-th score nothing is among a query's k best.
    least = done.floor[:, None] if done.strategy.strict else LEAST
    which, place = np.nonzero((done.score > LEAST) & (done.score >= least))
    found = [] if done.found is None else done.found[which, place]
    columns = [pa.array(done.ids[which], done.kinds[0]), pa.array(found, done.kinds[1]), pa.array(done.score[which, place] / SCALE)]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "id", "similarity"])


def _searched(queries: DataFrame, blocks: DataFrame, strategy: Strategy, k: int, slabs: int, finish, schema: str) -> DataFrame:
    """`queries`: packed blocks with `floor`; each meets the catalogue's blocks of the cells where it may find something."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for i in range(batch.num_rows):
                ids, block, floor = (batch.column(c)[i] for c in ("ids", "block", "floor"))
                bounds = strategy.bounds(_unit(_bytes(block.as_py(), len(ids))))
                floor = np.frombuffer(floor.as_py(), "int64")[:, None] if floor.is_valid else LEAST
                cells.append(np.flatnonzero(((bounds >= floor) & (bounds > LEAST)).any(axis=0)).astype("int32"))
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("number"), pa.array(cells, pa.list_(pa.int32()))], ["cell", "number", "cells"])

    block_of = [F.col("cell").alias("qcell"), F.col("number").alias("qnumber")]
    wanted = queries.mapInArrow(visits, "cell int, number int, cells array<int>").select(*block_of, F.explode("cells").alias("cell"))
    slab = F.pmod(F.xxhash64("cell", "number"), F.lit(slabs)).cast("int")
    met = wanted.join(blocks, "cell").select("qcell", "qnumber", slab.alias("slab"), "cell", "number", "ids", "block")
    asked = queries.select(
        *block_of, F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), F.lit(-1).alias("cell"), F.lit(-1).alias("number"),
        F.col("ids").alias("query_ids"), "block", "floor",
    )
    rows, group = asked.unionByName(met, allowMissingColumns=True), ["qcell", "qnumber", "slab"]
    return rows.repartition(*group).sortWithinPartitions(*group, "cell", "number").mapInArrow(_stream(strategy, k, finish), schema)


def _result(queries: DataFrame, catalogue: DataFrame) -> str:
    return f"query_id {queries.schema['id'].dataType.simpleString()}, id {catalogue.schema['id'].dataType.simpleString()}, similarity double"


def _nothing(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], f"{_result(queries, catalogue)}, rank int")


def _blocks_of_queries(queries: DataFrame, centroids: np.ndarray, block_rows: int) -> DataFrame:
    assigned = _assigned(_rows(queries), centroids)
    block_rows *= QUERY_BLOCKS
    cell, rows = _shared_cells(centroids, _cell_sizes(assigned, len(centroids))[0], block_rows)
    return _packed(assigned.withColumn("cell", cell.cast("int")), rows, block_rows)


def _rank(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _held(counts: np.ndarray, block_rows: int) -> np.ndarray:
    """Rows that one block of each cell holds; blocks are cut by hash, so of several half an even share is counted on."""
    blocks = np.maximum(-(-counts // block_rows), 1)
    return np.where(blocks > 1, counts // blocks // 2, counts)


def _floored(asked: DataFrame, blocks: DataFrame, first: _First, k: int) -> DataFrame:
    """Packed queries with a lower bound of the k-th score of each, from the first block of the nearest cells."""
    floors = _searched(
        asked.withColumn("floor", F.lit(None).cast("binary")), blocks.filter("number = 0"), first, k, 1, _bounds_met,
        "cell int, number int, floor binary",
    )
    return asked.join(floors, ["cell", "number"], "left")


def cosine_topk(
    queries: DataFrame, catalogue: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, cells: int | None = None
) -> DataFrame:
    """The k most similar catalogue rows of every query, exactly; ties by id.

    Both sides have ``id`` and ``embedding``; the result has ``query_id``, ``id``,
    ``similarity`` (6 places) and ``rank``. At most k rows a query and slab are emitted.
    """
    centroids = seeds(catalogue, cells or cells_for(_rows(catalogue).count()))
    if not len(centroids):
        return _nothing(queries, catalogue)
    assigned = _assigned(_rows(catalogue), centroids)
    counts, radius = _cell_sizes(assigned, len(centroids))
    blocks = _packed(assigned, counts, block_rows)
    asked = _floored(_blocks_of_queries(queries, centroids, block_rows), blocks, _First(centroids, _held(counts, block_rows), k), k)
    found = _searched(asked, blocks, _Exact(centroids, counts, k, radius), k, SLABS, _listed, _result(queries, catalogue))
    return _rank(found, k)


def _exact_similarity(pairs: DataFrame, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_unit(_matrix(batch.column(c))) for c in ("asked", "stored"))
                score = np.rint(np.einsum("nd,nd->n", a, b) * SCALE) / SCALE
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(score)], ["query_id", "id", "similarity"])

    return pairs.mapInArrow(run, schema)


def ann_topk(
    queries: DataFrame,
    catalogue: DataFrame,
    k: int = 10,
    block_rows: int = BLOCK_ROWS,
    index: Index | None = None,
    shortlist: int | None = None,
) -> DataFrame:
    """Approximate form of :func:`cosine_topk` through an index, by default one trained on the catalogue.

    The k-th best score by code in a query's nearest cells is its bound; cells whose reach
    exceeds it are visited, too. The ``shortlist`` best by code (10 k by default) are
    ranked by their exact similarity. Every query gets k rows, or as many as there are.
    """
    index, shortlist = index or train_index(catalogue, neighbours=k), max(shortlist or 10 * k, k)
    if not len(index.centroids):
        return _nothing(queries, catalogue)
    assigned = _assigned(_rows(catalogue), index.centroids)
    counts, _ = _cell_sizes(assigned, len(index.centroids))

    def encode(vectors: np.ndarray, cell: int) -> bytes:
        return _codes(_split(_unit(vectors) - index.centroids[cell], len(index.codebooks)), index.codebooks).astype("uint8").tobytes()

    blocks = _packed(assigned, counts, block_rows, encode)
    first = _CodedFirst(index.centroids, _held(counts, block_rows), k, index.codebooks)
    asked = _floored(_blocks_of_queries(queries, index.centroids, block_rows), blocks, first, k)
    coded = _Coded(index.centroids, counts, k, index.codebooks, index.reach)
    near = _rank(_searched(asked, blocks, coded, shortlist, SLABS, _listed, _result(queries, catalogue)), shortlist)
    pairs = near.select("query_id", "id").join(_rows(catalogue).withColumnRenamed("embedding", "stored"), "id")
    pairs = pairs.join(_rows(queries).select(F.col("id").alias("query_id"), F.col("embedding").alias("asked")), "query_id")
    return _rank(_exact_similarity(pairs.select("query_id", "id", "asked", "stored"), _result(queries, catalogue)), k)
