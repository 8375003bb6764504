import brute
import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import embedding_dedup as ed


def expected(rows):
    unit = []
    for i, v, label in rows:
        x = None if v is None or any(e is None for e in v) or not len(v) else np.array(v, float)
        ok = x is not None and np.isfinite(x).all() and x.any() and label is not None
        unit.append(x / np.linalg.norm(x) if ok else None)
    near = lambda i, j: unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93
    comp = brute.components([r[0] for r in rows], near)
    links = [sum(near(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    return sorted((r[0], n, c) for r, n, c in zip(rows, links, comp))


def clusters(seed, n, dim=16, noise=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    return [(i, (centres[k % 12] + noise * rng.standard_normal(dim)).astype(np.float32).tolist() if k % 3 else rng.standard_normal(dim).astype(np.float32).tolist(), k % 2) for i, k in enumerate(rng.integers(0, 36, n).tolist())]


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    return sorted((r.vec_id, r.n_links, r.component_id) for r in ed.dedup_vectors(df).collect())


def test_equals_brute_force(spark):
    rows = clusters(1, 400)
    assert run(spark, rows) == expected(rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 16)
    rows = clusters(2, 300, noise=0.001)
    assert run(spark, rows) == expected(rows)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v, 1), (1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, None), (4, None, 1), (5, [0.0] * 3, 1), (6, [float("nan"), 1.0, 1.0], 1), (7, [float("inf"), 1.0, 1.0], 1), (8, [], 1), (9, v, 2), (10, [1.0, 2.0], 1), (11, [0.0] * 3, 1)]
    assert run(spark, rows) == expected(rows)
    assert ed.dedup_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    kept = {r.vec_id: r.kept for r in ed.dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert [i for i, k in kept.items() if not k] == [1, 2] or sorted(i for i, k in kept.items() if not k) == [1, 2]


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = rng.standard_normal((3000, 64))
    d -= (d * x).sum(axis=1, keepdims=True) * x
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * d
    assert (ed.buckets(x) == ed.buckets(y)).any(axis=1).mean() > 0.995
