import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def expected(rows, k=4):
    """id, component, n, deviation, whitened up to sign, explained: by exact integers and LAPACK."""
    xs = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in {len(x) for _, x in xs if x}:
        fit = np.array(sorted({tuple(x) for _, x in xs if len(x) == d}))
        n, sums = len(fit), [sum(map(int, c)) for c in fit.T]
        centred = fit - np.array(sums) / n
        e, q = np.linalg.eigh(centred.T @ centred / n)
        e, q = e[::-1], q[:, ::-1]
        for i, x in xs:
            if len(x) != d:
                continue
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            for c in range(min(k, d)):
                flat = e[c] <= d * 1e-15 * max(e[0], 0) or n == 1
                white = None if flat else abs((np.array(x) - np.array(sums) / n) @ q[:, c] / math.sqrt(e[c]))
                out.append((i, c + 1, n, deviation, white, e[c] / e.sum() if n > 1 else None))
    return sorted(out, key=lambda r: (repr(r[0]), r[1], r[3]))


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit("clash") for c in ("x", "d", "state", "n", "component")})
    return sorted(wh.whiten(df).collect(), key=lambda r: (repr(r.vec_id), r.component, int(r.deviation_digits)))


def close(got, want):
    assert [(r.vec_id, r.component, r.n, int(r.deviation_digits)) for r in got] == [w[:4] for w in want]
    for r, w in zip(got, want):
        assert r.deviation == (w[3] if w[3] < 2**63 else None)
        assert (r.whitened is None and w[4] is None) or abs(abs(r.whitened) - w[4]) < 1e-6 * (1 + w[4])
        assert (r.explained is None and w[5] is None) or abs(r.explained - w[5]) <= 1e-4 * w[5] + 1e-15
        assert r.identity_error is None or r.identity_error < 1e-8


def test_equals_exact_integers_and_lapack(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = run(spark, rows)
    close(got, expected(rows))
    signs = {}
    for r, w in zip(got, expected(rows)):  # one sign a component, the same for all rows
        signs.setdefault(r.component, []).append(r)
    x = {r[0]: np.floor(256 * np.array(r[1], np.float32).astype(float)) for r in rows}
    for c, rs in signs.items():
        v = np.linalg.lstsq(np.array([x[r.vec_id] for r in rs]) - np.mean(np.unique(list(map(tuple, x.values())), axis=0), axis=0), np.array([r.whitened for r in rs]), rcond=None)
        assert v[3][0] > 0 and (len(v[1]) == 0 or v[1][0] < 1e-6)


def test_many_partitions_give_the_same(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 1, 0.5, 0.1] + 40).tolist()) for i in range(700)]
    close(run(spark, rows, 40), expected(rows))


def test_odd_rows(spark):
    v = [1.0, 2.0, -3.0]
    rows = [(0, v), (0, v), (None, v), (1, [2.0, 4.0, 6.0]), (2, [1.5, 2.0, 7.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [1.0, float("-inf"), 1.0]), (7, []), (8, [1.0, 2.0]), (9, [3.0, 2.0])]
    close(run(spark, rows), expected(rows))
    close(run(spark, rows[:2]), expected(rows[:2]))  # one distinct vector: nothing varies
    assert all(r.whitened is None and r.explained is None and r.identity_error is None for r in run(spark, rows[:2]))
    assert run(spark, []) == [] and run(spark, rows[5:6]) == []
    huge = [(0, [1e15, 1.0]), (1, [-1e15, 2.0]), (2, [3e15, 5.0])]
    got = run(spark, huge)
    assert [int(r.deviation_digits) for r in got] == [w[3] for w in expected(huge)] and all(r.deviation is None for r in got)
    assert {r.n for r in run(spark, [(0, [3e38, 0.0]), (1, [3e38, 1.0])])} == {2}


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64, 150])
def test_symmetric_qr(d):
    rng = np.random.default_rng(d)
    for a in (rng.standard_normal((d, d)), np.outer(rng.standard_normal(d), np.ones(d)), np.diag(rng.integers(0, 3, d)).astype(float), np.zeros((d, d)), 1e-200 * rng.standard_normal((d, d))):
        a = a @ a.T if abs(a).max() > 1e-100 else (a + a.T)
        e, q = wh.symmetric_qr(a)
        size = max(abs(a).max(), 1e-300)
        assert np.allclose(q.T @ q, np.eye(d), atol=1e-12) and np.allclose(e / size, np.linalg.eigvalsh(a)[::-1] / size, atol=1e-11)
        assert np.allclose(a @ q / size, q * e / size, atol=1e-11)
