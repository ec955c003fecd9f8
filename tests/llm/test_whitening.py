import numpy as np
import pytest

from cellspark.llm import whitening


def plain(x):
    """(n, deviations, whitened up to sign, shares, largest entry that differs from the identity), by the library's eigenvectors."""
    x = np.floor(1024 * np.asarray(x, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors.T[::-1]
    k = min(8, x.shape[1])
    return n, [sum(int(n * a - b) ** 2 for a, b in zip(r, sums, strict=True)) for r in x], (centred @ vectors[:k].T) / np.sqrt(values[:k]), values[:k] / values.sum()


def test_eigenvectors_against_the_library():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 9, 40):
        a = r.normal(size=(n, n))
        a = a + a.T
        values, vectors = whitening.symmetric_qr(a)
        assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1], abs=1e-12 * n)
        assert np.abs(vectors @ vectors.T - np.eye(n)).max() < 1e-13 and np.abs(vectors @ a @ vectors.T - np.diag(values)).max() < 1e-11
    for a in (np.zeros((4, 4)), np.eye(3), np.ones((5, 5)), np.zeros((0, 0)), np.diag([3.0, 1, 2])):
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(vectors.T * values @ vectors, a, atol=1e-14)


def test_merged_moments_are_those_of_all_rows():
    x = np.random.default_rng(2).normal(size=(300, 5)) * 40 + 7
    parts = []
    for block in np.split(x, [1, 1, 90, 200]):
        m = whitening.Moments.none(5)
        m.add(block)
        parts.append(m)
    whole = parts[0]
    for m in parts[1:]:
        whole.merge(m)
    centred = x - x.mean(axis=0)
    assert whole.n == 300 and np.allclose(whole.mean, x.mean(axis=0), atol=1e-12) and np.allclose(whole.scatter, centred.T @ centred, atol=1e-8)


def test_whitening_against_plain(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)  # several rounds of the tree
    r = np.random.default_rng(1)
    good = [[float(np.float32(c)) for c in v] for v in r.normal(size=(120, 12)) * np.linspace(0.3, 0.05, 12)]
    short = r.normal(size=(20, 3)).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(500 + i, v) for i, v in enumerate(short)]
    odd = [(901, None), (902, []), (903, [None] * 12), (904, [float("nan")] * 12), (905, [float("inf")] + [0.0] * 11), (906, [1e300] * 12)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + odd], "vec_id long, embedding array<double>, n int, whitened double").repartition(7)  # clashing names
    got = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    for ids, vectors in ((range(120), good), (range(500, 520), short)):
        n, deviation, white, shares = plain(vectors)
        part = got[got.vec_id.isin(ids)]
        k = len(shares)
        assert len(part) == k * n and set(part.n) == {n} and part.deviation.tolist() == np.repeat(deviation, k).tolist() and [int(x) for x in part.deviation_exact] == part.deviation.tolist()
        assert np.abs(part.whitened.to_numpy().reshape(n, k)) == pytest.approx(np.abs(white), abs=1e-10)
        assert part.explained.to_numpy()[:k] == pytest.approx(shares, rel=1e-10) and part.identity_error.nunique() == 1 and part.identity_error.iloc[0] < 1e-12
        for c in range(1, k + 1):  # one sign a component
            assert abs(np.dot(part[part.component == c].whitened, white[:, c - 1])) == pytest.approx(n, rel=1e-9)
    assert len(got) == 120 * 8 + 20 * 3


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0])], kind)).collect()
    assert len(same) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(3, 0, None, 0.0, 0.0)}
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], kind)).collect()
    assert len(line) == 30 and all((r.whitened is None) == (r.component > 1) for r in line) and all(r.explained == pytest.approx(float(r.component == 1)) for r in line)


def test_deviations_beyond_64_bits(spark):
    x = np.array([[2**40, -(2**40)], [0, 5]])
    sums = x.sum(axis=0).tolist()
    assert whitening.deviations(x, 2, sums) == [sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    got = whitening.whiten(spark.createDataFrame([(1, [2.0**50]), (2, [-(2.0**50)])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {None} and all(0 < int(r.deviation_exact) < 10**38 for r in got) and {round(r.whitened, 9) for r in got} == {1.0, -1.0}
