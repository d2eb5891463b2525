"""Vector search, the pipeline, and every registered query on the driver's smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from platewise.llm import ann, queries
from platewise.llm.common import prepare

DIRECTORY = "/root/testdata/sf0.001"


def brute(rows, every, k):
    out = {}
    for q, v in rows:
        if q % every == 0:
            score = sorted((-float(np.dot(np.asarray(v, float), np.asarray(u, float))), i) for i, u in rows if i != q)
            out[q] = [(i, round(-s, 9)) for s, i in score[:k]]
    return out


@pytest.mark.parametrize("n", [30, 700])
def test_nearest(spark, n):
    prepare(spark)
    rng = np.random.default_rng(n)
    vectors = rng.normal(size=(n, 12)).astype("float32")
    vectors[: n // 3] = vectors[0]  # a third of all rows is one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(9000, None), (9020, [0.0] * 12), (9040, [float("nan")] * 12), (9060, [None] + [1.0] * 11), (None, [1.0] * 12), (9080, [1.0, 2.0]), rows[5], rows[20]]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int")
    found = {}
    for r in ann.nearest(frame, k=10, block=200).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    expected = brute(rows, 20, 10)
    assert set(found) == set(expected)
    if n <= 256:
        assert found == expected
    else:
        same = [len(set(found[q]) & set(expected[q])) for q in expected]
        assert sum(same) >= 0.9 * 10 * len(expected)
        assert all(found[q] == expected[q] for q in expected if q < n // 3)
    assert ann.nearest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n in queries.REGISTRY if n in queries.SQL])
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIRECTORY}/{table}.parquet'")
    cursor = connection.execute(queries.SQL[name])
    names = [c[0] for c in cursor.description]
    found = queries.REGISTRY[name](spark, DIRECTORY)
    assert sorted(found.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_registered():
    assert {n.split("_")[0] for n in queries.REGISTRY} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.REGISTRY) | {"pipeline"} <= set(entry_points.queries())


def test_one_row_of_each_group_stays(spark):
    """Rows are judged by their own texts, also where they share a doc_id or have none."""
    prepare(spark)
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"w{rng.integers(10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    near = b.rsplit(" ", 1)[0]
    rows = [(1, a, 1), (1, a, 2), (2, b, 3), (3, near, 4), (3, c, 5), (None, a, 6), (4, None, 7), (5, "", 8), (5, "", 9), (None, "lone words here", 10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, text_key int")
    kept = corpus_pipeline.join_ngrams(spark, frame, DIRECTORY)
    assert kept.columns == frame.columns
    found = sorted((tuple(r)[:2] for r in kept.collect()), key=repr)
    assert found == sorted([(1, a), (2, b), (3, c), (4, None), (5, ""), (5, ""), (None, "lone words here")], key=repr)


def test_pipeline(spark):
    docs = prepare(spark).read.parquet(f"{DIRECTORY}/documents.parquet").cache()
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DIRECTORY).cache()
        seen[name] = after
        if name != "bpe":
            assert after.columns == columns
        before = after
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(seen["line_dedup"]) == ids(seen["toxicity"]) >= ids(seen["ngram_jaccard"]) >= ids(seen["mixing"])
    assert seen["bpe"].count() == seen["mixing"].count()
    again = {tuple(r) for r in corpus_pipeline.run(spark, DIRECTORY).collect()}
    assert again == {tuple(r) for r in seen["bpe"].collect()}
    for _, stage in corpus_pipeline.STAGES:  # a stage may be left with nothing
        assert stage(spark, docs.limit(0), DIRECTORY).count() == 0
