import numpy as np
import pytest

from platewise.operators import vectors

SCHEMA = "id bigint, embedding array<float>"


def frame(spark, matrix, first=0):
    rows = [(first + i, [float(x) for x in row]) for i, row in enumerate(matrix.astype("float32"))]
    return spark.createDataFrame(rows, SCHEMA)


def unit(matrix):
    m = matrix.astype("float32").astype("float64")
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def brute_force(queries, catalogue, k):
    similar = np.rint(unit(queries) @ unit(catalogue).T * 10**6) / 10**6
    best = np.argsort(-similar, axis=1, kind="stable")[:, :k]
    return {(q, rank + 1): (int(i), similar[q, i]) for q, row in enumerate(best) for rank, i in enumerate(row)}


def found(df):
    return {(r["query_id"], r["rank"]): (r["id"], r["similarity"]) for r in df.collect()}


def clustered(rng, n, centres=6, spread=0.05, dims=8):
    middle = rng.normal(size=(centres, dims))
    return middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))


@pytest.mark.parametrize("block_rows", [10, 37, 1000])
@pytest.mark.parametrize("shape", ["random", "clustered", "copies"])
def test_exact_search_matches_brute_force(spark, shape, block_rows):
    rng = np.random.default_rng(3)
    queries = rng.normal(size=(60, 8)) if shape == "random" else clustered(rng, 60)
    catalogue = rng.normal(size=(200, 8)) if shape == "random" else clustered(rng, 200)
    if shape == "copies":  # a third of either side is one vector, and some vectors are zero
        catalogue[:70] = catalogue[0]
        catalogue[70:75] = 0
        queries[:20] = catalogue[0]
        queries[20] = 0
    result = vectors.cosine_topk(frame(spark, queries), frame(spark, catalogue), 7, block_rows)
    assert found(result) == brute_force(queries, catalogue, 7)


def test_more_wanted_than_stored(spark):
    rng = np.random.default_rng(5)
    queries, catalogue = rng.normal(size=(5, 4)), rng.normal(size=(30, 4))
    result = vectors.cosine_topk(frame(spark, queries), frame(spark, catalogue), 50, 10)
    assert found(result) == brute_force(queries, catalogue, 50)


def test_empty_catalogue(spark):
    queries = frame(spark, np.ones((2, 3)))
    assert vectors.cosine_topk(queries, queries.filter("id > 5"), 3).count() == 0


def test_ids_of_any_type(spark):
    """Text ids, which order as text."""
    rng = np.random.default_rng(13)
    queries, catalogue = clustered(rng, 40), clustered(rng, 120)
    catalogue[:30] = catalogue[0]
    order = sorted(range(120), key=lambda i: f"r{i}")
    named = frame(spark, catalogue).selectExpr("concat('r', id) AS id", "embedding")
    got = found(vectors.cosine_topk(frame(spark, queries), named, 5, 16))
    expected = brute_force(queries, catalogue[order], 5)
    assert got == {key: (f"r{order[i]}", similarity) for key, (i, similarity) in expected.items()}
    near = vectors.ann_topk(named, frame(spark, queries), 3).collect()
    assert {r["query_id"] for r in near} == {f"r{i}" for i in range(120)}


def test_rows_without_a_vector_are_left_out(spark):
    rng = np.random.default_rng(17)
    rows = frame(spark, rng.normal(size=(20, 4)))
    more = rows.unionByName(spark.createDataFrame([(99, None)], SCHEMA))
    assert found(vectors.cosine_topk(more, more, 3, 5)) == found(vectors.cosine_topk(rows, rows, 3, 5))


@pytest.mark.parametrize("shape", ["random", "clustered", "copies"])
def test_approximate_recall(spark, shape):
    rng = np.random.default_rng(7)
    if shape == "random":
        queries, catalogue = rng.normal(size=(80, 8)), rng.normal(size=(900, 8))
    else:
        both = clustered(rng, 980, 12)
        queries, catalogue = both[:80], both[80:]
    if shape == "copies":
        catalogue[:300] = catalogue[0]
    exact = brute_force(queries, catalogue, 10)
    near = found(vectors.ann_topk(frame(spark, queries), frame(spark, catalogue), 10, block_rows=50))
    assert set(near) == set(exact)
    # Equal vectors may stand for each other.
    hits = [near[key][1] >= exact[(key[0], 10)][1] for key in near]
    assert sum(hits) / len(hits) >= 0.9


@pytest.mark.parametrize("scale", ["0.001", "0.1"])
def test_recall_on_the_driver_tables(spark, scale):
    every = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    exact = {(r["query_id"], r["id"]) for r in vectors.cosine_topk(every, every, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in vectors.ann_topk(every, every, 10).collect()}
    assert len(near) == len(exact)
    assert near != exact  # it is approximate on the smallest tables, too
    assert len(near & exact) / len(exact) >= 0.9


@pytest.mark.parametrize("rows", [5, 60])
def test_approximate_search_gives_k_rows(spark, rows):
    rng = np.random.default_rng(11)
    frames = frame(spark, rng.normal(size=(rows, 8)))
    counts = vectors.ann_topk(frames, frames, 10, block_rows=2, shortlist=10).groupBy("query_id").count().collect()
    assert [r["count"] for r in counts] == [min(rows, 10)] * rows


def test_training_is_repeatable_and_reduces_the_error(spark):
    rng = np.random.default_rng(19)
    rows = clustered(rng, 600, 9, 0.1)
    table = frame(spark, rows)
    error = []
    for rounds in (0, 3):
        index = vectors.train_index(table.repartition(5), cells=12, rounds=rounds, part_dims=3, codes=8)
        again = vectors.train_index(table.repartition(2), cells=12, rounds=rounds, part_dims=3, codes=8)
        assert np.array_equal(index.centroids, again.centroids) and np.array_equal(index.codebooks, again.codebooks)
        v = unit(rows)
        rest = vectors._split(v - index.centroids[(v @ index.centroids.T).argmax(axis=1)], 3)
        codes = vectors._codes(rest, index.codebooks)
        error.append(sum(((rest[:, p] - index.codebooks[p][codes[:, p]]) ** 2).sum() for p in range(3)))
    assert error[1] < 0.8 * error[0]


def emitted(spark, queries, catalogue, k, **options):
    """Rows that leave the tasks of the second pass, per query."""
    import unittest.mock

    with unittest.mock.patch.object(vectors, "_rank", lambda df, k: df):
        rows = vectors.cosine_topk(frame(spark, queries), frame(spark, catalogue), k, **options)
        return max(r["count"] for r in rows.groupBy("query_id").count().collect())


@pytest.mark.parametrize("rows", [200, 3000])
def test_rows_emitted_do_not_grow(spark, rows):
    rng = np.random.default_rng(23)
    assert emitted(spark, rng.normal(size=(30, 8)), rng.normal(size=(rows, 8)), 5, block_rows=20) <= 5 * vectors.SLABS


def test_far_cells_are_skipped(spark):
    """With a bound of their own, queries near one cluster look into few of the cells."""
    rng = np.random.default_rng(9)
    catalogue = clustered(rng, 400, 8, 0.01)
    centroids = unit(catalogue[:8])
    assigned = vectors._assigned(vectors._rows(frame(spark, catalogue)), centroids)
    counts, radius = vectors._cell_sizes(assigned, 8)
    queries = unit(catalogue[:50])
    floor = np.sort(np.rint(queries @ unit(catalogue).T * vectors.SCALE), axis=1)[:, -3]
    looked = vectors._Exact(centroids, counts, 3, radius).bounds(queries) >= floor[:, None]
    assert looked.sum() < 50 * (counts > 0).sum() * 0.75


def test_blocks_are_scored_in_chunks(spark):
    """However large blocks and batches are, so many rows are compared at a time; nothing below a strict bound is emitted."""
    import pyarrow as pa

    centroids = unit(np.random.default_rng(3).normal(size=(4, 8)))
    widest = []

    class Counted(vectors._Exact):
        def scores(self, queries, *more):
            widest.append(len(queries))
            return super().scores(queries, *more)

    rng, n = np.random.default_rng(5), 2 * vectors.CHUNK_ROWS + 1
    asked, stored = rng.normal(size=(n, 8)).astype("float32"), rng.normal(size=(40, 8)).astype("float32")
    strategy = Counted(centroids, np.array([40, 0, 0, 0]), 3, np.full(4, np.pi))
    exact = np.rint(unit(asked) @ unit(stored).T * vectors.SCALE).astype("int64")
    floor = np.sort(exact, axis=1)[:, -2]
    row = {"qcell": 0, "qnumber": 0, "ids": np.arange(n), "block": asked.tobytes(), "floor": floor.tobytes()}
    running = vectors._Running(row, strategy, 3, [pa.int64(), pa.int64()])
    running.read({"cell": 0, "ids": np.arange(40), "block": stored.tobytes()})
    assert max(widest) <= vectors.CHUNK_ROWS and sum(widest) == n
    listed = vectors._listed(running).to_pydict()
    assert len(listed["id"]) == (exact >= floor[:, None]).sum() and len(listed["id"]) < 3 * n
    batch = pa.RecordBatch.from_pydict({"id": range(n)})
    assert [b.num_rows for b in vectors._chunks(iter([batch]))] == [vectors.CHUNK_ROWS] * 2 + [1]
