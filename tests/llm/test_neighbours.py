import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsight.llm import neighbours as A

VECTORS = "vec_id long, embedding array<float>, label int"


def by_hand(rows, k, ask):
    rows = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows]
    out = []
    for q, x in rows:
        if ask(q):
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in rows if i != q)[:k]
            out += [(q, rank + 1, i, d) for rank, (d, i) in enumerate(near)]
    return sorted(set(out))


def clusters(n, seed=0, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d)) * 4
    return [(i, (centres[rng.integers(9)] + rng.normal(size=d)).tolist()) for i in range(n)]


def search(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).repartition(4)
    return sorted(tuple(r) for r in A.tree_search(df, F.col("vec_id") % 10 == 0, **kw).collect())


def test_recall_is_reached(spark):
    rows = clusters(1500)
    got = search(spark, rows, leaf_vectors=20)
    true = by_hand(rows, 10, lambda i: i % 10 == 0)
    assert [g[:2] for g in got] == [t[:2] for t in true]
    assert len({(g[0], g[2]) for g in got} & {(t[0], t[2]) for t in true}) >= 0.9 * len(true)
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert all(abs(np.linalg.norm(vectors[q] - vectors[i]) - d) < 1e-12 for q, _, i, d in got)


def test_visits_are_fewer_than_leaves(spark):
    rows = clusters(1200, 3)
    x = np.array([v for _, v in rows])
    tree = A.grow(x, 60)
    assert tree.leaves == 60 and sorted(A.best_bins(tree, x[0])) == list(range(60))
    leaf = A.assign(tree, x)
    first = [next(A.best_bins(tree, v)) for v in x[:200]]
    assert np.mean(np.array(first) == leaf[:200]) > 0.95


def test_ties_copies_and_hot_leaves(spark, monkeypatch):
    monkeypatch.setattr(A, "CELL_VECTORS", 50)
    monkeypatch.setattr(A, "CELL_QUERIES", 7)
    monkeypatch.setattr(A, "BLOCK", 16)
    rows = clusters(300, 5) + [(1000 + i, [1.0] * 12) for i in range(400)]
    got = search(spark, rows, leaf_vectors=30)
    own = [g for g in got if g[0] >= 1000]
    expected = [t for t in by_hand(rows, 10, lambda i: i % 10 == 0) if t[0] >= 1000]
    assert own == expected and all(d == 0 for *_, d in own)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_fewer_candidates_than_asked(spark, n):
    rows = clusters(n)
    got, true = search(spark, rows), by_hand(rows, 10, lambda i: i % 10 == 0)
    assert [g[:3] for g in got] == [t[:3] for t in true]
    assert np.allclose([g[3] for g in got], [t[3] for t in true], rtol=1e-12)


def test_unusable_vectors_take_no_part(spark):
    rows = clusters(60)
    bad = [(100, None), (110, [0.0] * 12), (120, [float("nan")] * 12), (130, [float("inf")] + [1.0] * 11), (140, [None] + [1.0] * 11), (150, [1.0] * 5), (160, []), (None, [1.0] * 12)]
    got, true = search(spark, rows + bad), by_hand(rows, 10, lambda i: i % 10 == 0)
    assert [g[:3] for g in got] == [t[:3] for t in true]
    assert search(spark, []) == [] and search(spark, bad) == []
    assert search(spark, [(i, v) for i, v in rows if i % 10]) == []


def test_repeated_rows_are_candidates_each(spark):
    rows = clusters(30)
    got = search(spark, [*rows, rows[1], rows[1], rows[0]])
    assert len(got) == 30
    true = by_hand([*rows, rows[1], rows[1], rows[0]], 10, lambda i: i % 10 == 0)
    assert [g[:3] for g in got] == [t[:3] for t in true]


def test_the_bound_on_fitted_vectors_holds_for_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)] + [(7, rng.normal(size=4).tolist()) for _ in range(2000)]
    seen, grow = [], A.grow
    monkeypatch.setattr(A, "grow", lambda x, leaves: seen.append(len(x)) or grow(x, leaves))
    monkeypatch.setattr(A, "FIT_VECTORS", 100)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    A.tree_search(vectors, F.col("vec_id") % 50 == 0).count()
    assert seen[0] <= 100
