from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long, part long"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA).repartition(parts)


def brute(vectors):
    """Exact sums, exact deviations and the eigenvectors of the exact covariance."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    total = [sum(row[j] for row in x) for j in range(d)]
    deviation = [sum((n * row[j] - total[j]) ** 2 for j in range(d)) for row in x]
    away = np.array([[float(Fraction(n * row[j] - total[j], n)) for j in range(d)] for row in x])
    values, basis = np.linalg.eigh(away.T @ away / n)
    return n, deviation, away, values[::-1], basis[:, ::-1]


def compare(got, rows, k=8):
    n, deviation, away, values, basis = brute([v for _, v in rows])
    by_id = {}
    for row in got:
        by_id.setdefault(row.vec_id, {})[row.component] = row
    assert set(by_id) == {i for i, _ in rows}
    sign = None
    for at, (i, _) in enumerate(rows):
        found = by_id[i]
        assert sorted(found) == list(range(1, min(k, len(values)) + 1))
        assert {r.deviation for r in found.values()} == {deviation[at]} and found[1].n == n
        white = np.array([found[c].whitened for c in sorted(found)])
        want = away[at] @ basis[:, : len(white)] / np.sqrt(values[: len(white)])
        if sign is None and np.abs(want).min() > 1e-3:
            sign = np.sign(white / want)
        if sign is not None:
            assert np.allclose(white, want * sign, atol=1e-8)
        for c, row in found.items():
            assert row.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-10)
            assert row.identity_error < 1e-10
    assert sign is not None


def test_as_the_exact_covariance(spark):
    rng = np.random.default_rng(3)
    spread = np.exp(-np.arange(12) / 3.0)
    rows = [(i, [float(v) for v in rng.normal(size=12) * spread]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # one very common vector
    compare(whitening.whiten(table(spark, rows, 9)).collect(), rows)


def test_whole_table(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.orderBy("vec_id").collect()]
    compare(whitening.whiten(vectors.repartition(5)).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(30)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]),
           (104, [1.0, float("inf"), 2.0]), (105, [1.0, 2.0]), (106, [float("-inf")] * 3)]
    got = whitening.whiten(table(spark, good + odd))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), good)
    twice = good + [(None, good[0][1]), (5, good[5][1])]
    rows = whitening.whiten(table(spark, twice)).groupBy("vec_id").count()
    assert {r.vec_id: r["count"] for r in rows.collect()} == {None: 3, 5: 6} | {
        i: 3 for i in range(30) if i != 5
    }


def test_empty_single_and_constant_tables(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    for rows in ([(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(20)]):
        got = whitening.whiten(table(spark, rows)).collect()
        assert len(got) == 2 * len(rows)
        assert all(r.whitened is None and r.identity_error is None and r.deviation == 0 for r in got)
    flat = [(i, [float(i), 1.0]) for i in range(10)]  # variance in one dimension only
    got = whitening.whiten(table(spark, flat)).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in got] == [False, True] * 10
    assert got[0].identity_error < 1e-12


def test_huge_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [3.0, 2.0])]
    got = whitening.whiten(table(spark, rows)).filter(F.col("component") == 1).collect()
    assert {r.vec_id: r.deviation for r in got}[1] is None
    assert all(np.isfinite(r.whitened) for r in got)


def test_updates_of_a_spectrum():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 20):
        rows = np.floor(rng.normal(size=(120, size)) * 300)
        rows[30:90] = rows[0]
        if size > 2:
            rows[:, 1] = rows[:, 2]
        parts = [whitening.Spectrum.empty(size) for _ in range(4)]
        for part, cut in zip(parts, np.split(rows, [40, 41, 100]), strict=True):
            part.add(cut)
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.combine(part)
        away = rows - rows.mean(0)
        scatter = away.T @ away
        assert whole.n == 120 and list(whole.total) == [int(v) for v in rows.sum(0) + 120 * 100_000]
        assert np.allclose(whole.basis @ np.diag(whole.values) @ whole.basis.T, scatter, atol=1e-9 * scatter.max())
        assert np.allclose(whole.basis.T @ whole.basis, np.eye(size), atol=1e-12)
