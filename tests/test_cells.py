"""Dense search by cells against all products, and how many vectors it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import cells as K
from lodestone.operators import retrieval as R


def frames(spark, x, q):
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id long, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(-1, None)], "query_id long, vector array<double>")
    return vectors, queries


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Sixty tight groups; a third of all vectors are one vector."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 12))
    x = np.concatenate([centres[rng.integers(0, 60, 2000)] + 0.02 * rng.standard_normal((2000, 12)), np.repeat(centres[:1], 1000, axis=0)])
    vectors, queries = frames(spark, x, np.concatenate([x[:25] * 1.5, np.zeros((1, 12)), -x[5:7]]))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(K, "CELL", 128)
        yield K.write_cells(vectors, str(tmp_path_factory.mktemp("cells"))), vectors, queries


@pytest.mark.parametrize(("k", "first", "group"), [(1, 1, 1024), (7, 4, 1024), (7, 2, 9), (400, 3, 1024), (5000, 4, 1024)])
def test_best_equal_all_products(clustered, monkeypatch, k, first, group):
    index, vectors, queries = clustered
    monkeypatch.setattr(K, "QUERIES", group)
    got = {(r.query_id, r.id): r.score for r in K.search_cells(index, queries, k, first).collect()}
    want = {(r.query_id, r.id): r.score for r in R.dense_scores(vectors, queries, k).collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_cells_are_bounded_and_left_unread(clustered):
    index, vectors, queries = clustered
    stored = index.bounds.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("cells")).first()
    assert stored.n == 3000 and stored.most < 300 and stored.cells == index.cells.count()  # the shared vector is cut
    read = {r.q: r.vectors for r in K.vectors_read(index, queries.where("query_id BETWEEN 0 AND 24"), 5, 1).collect()}
    assert len(read) == 25 and np.median(list(read.values())) < 3000 / 4
    for cell in index.cells.join(index.bounds, "cell").collect():
        x = np.array(cell.vectors).reshape(-1, 12)
        assert len(x) == cell.n == len(cell.ids) and (np.linalg.norm(x - np.array(cell.mean), axis=1) <= cell.radius + 1e-9).all()


def test_random_vectors_and_odd_inputs(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors, queries = frames(spark, rng.standard_normal((300, 8)), rng.standard_normal((6, 8)))
    index = K.write_cells(vectors, str(tmp_path / "a"))
    best = lambda df: sorted((r.query_id, r.id) for r in df.collect())
    assert best(K.search_cells(index, queries, 4)) == best(R.dense_scores(vectors, queries, 4))
    assert K.search_cells(index, queries.where("query_id < 0"), 4).count() == 0
    assert K.search_cells(K.write_cells(vectors.where("id < 0"), str(tmp_path / "b")), queries, 4).count() == 0
    for bad in ([1.0], [float("nan")] * 8, [None] * 8):
        with pytest.raises(ValueError):
            K.write_cells(vectors.union(spark.createDataFrame([(9999, bad)], vectors.schema)), str(tmp_path / "c"))
