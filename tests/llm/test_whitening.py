import numpy as np
import pytest

from spanweave.llm import whitening as W

NAN, INF = float("nan"), float("inf")


def turned(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(np.array(values, dtype=float)) @ q.T
    return (a + a.T) / 2


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 40):
        a = rng.standard_normal((d, d))
        a += a.T
        for shift in (0.0, *rng.standard_normal(6)):
            assert W.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert W.above(np.zeros((4, 4)), 0.0) == 0 and W.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


SPECTRA = [[5, 5, 5, 3, 3, 1] + [0] * 14, [1] * 20, list(range(20, 0, -1)), [1 + 1e-13 * i for i in range(20)], [1e6, 1e6 - 1e-6] + [1] * 18, [3] + [0] * 19, [2.0**-k for k in range(40)], [7], [0, 0]]


@pytest.mark.parametrize("values", SPECTRA)
def test_leading_eigenpairs(values):
    a = turned(values)
    found, vectors = W.leading_eigenpairs(a)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    norm = max(np.abs(a).max(), 1e-300)
    assert len(found) == min(16, (np.array(values) > 1e-12 * max(values)).sum())
    assert np.abs(found - want[: len(found)]).max(initial=0) <= 1e-13 * norm
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max(initial=0) < 1e-12
    assert np.abs(a @ vectors.T - vectors.T * found).max(initial=0) < 1e-12 * norm
    assert all(v[np.abs(v).argmax()] > 0 for v in vectors)


def test_wrong_numbers_are_not_certified():
    a = turned([4, 3, 2, 1])
    W.certify(a, [4.0, 3.0], 0, 1e-12)
    with pytest.raises(ArithmeticError):
        W.certify(a, [4.0, 2.0], 1, 1e-12)


def written(spark, place, rows, schema="vec_id long, embedding array<float>, label int, x string"):
    spark.createDataFrame([(*r, 1, "y") for r in rows], schema).repartition(3).write.parquet(f"{place}/embeddings.parquet")
    return W.op11_embedding_whitening(spark, str(place)).toPandas()


def check(got, rows):
    """Against numpy on the same rows."""
    ids = np.array([r[0] for r in rows])
    x = np.floor(64 * np.array([r[1] for r in rows], dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    v = (fit - sums / n).T @ (fit - sums / n) / n
    values, vectors = (z[..., ::-1] for z in np.linalg.eigh(v))
    k = min(16, (values > 1e-12 * values[0]).sum())
    assert len(got) == k * len(rows) and set(got["component"]) == set(range(1, k + 1)) and (got["n"] == n).all()
    want = (x - sums / n) @ vectors[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        mine = got[got["component"] == c + 1].sort_values(["vec_id", "deviation", "whitened"])
        sign = np.sign(np.dot(*(np.sort(s) for s in (mine["whitened"], want[:, c]))))
        both = sorted(zip(ids, want[:, c] * sign), key=lambda p: p[0])
        if len(set(ids)) == len(ids):
            off = min(np.abs(mine["whitened"].to_numpy() - s * np.array([b[1] for b in both])).max() for s in (1, -1))
            assert off < 1e-8
            assert (mine["deviation"].to_numpy() == ((n * x - sums) ** 2).sum(axis=1)[np.argsort(ids)]).all()
        assert mine["explained"].iloc[0] == pytest.approx(values[c] / np.trace(v), rel=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-8


def test_query_equals_numpy(spark, sf_dir):
    got = W.op11_embedding_whitening(spark, sf_dir)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(got.toPandas(), rows)


def test_unusable_rows_are_left_out_and_copies_count_once(spark, tmp_path):
    rng = np.random.default_rng(4)
    good = [(i, [float(c) for c in rng.standard_normal(20)]) for i in range(60)]
    good += [(100 + i, good[7][1]) for i in range(40)]
    bad = [(200, None), (201, [None] * 20), (202, [NAN] + [0.0] * 19), (203, [0.0] * 19 + [-INF]), (204, []), (205, [1.0] * 3), (206, [0.5] * 19 + [None]), (207, [1e30] + [0.0] * 19)]
    check(written(spark, tmp_path, good + bad), good)


def test_few_components(spark, tmp_path):
    flat = [(i, [i % 5 / 4, i % 7 / 4, 1.0, 2.0]) for i in range(35)]
    check(written(spark, tmp_path / "a", flat), flat)
    assert len(written(spark, tmp_path / "b", [(i, [1.0, 2.0]) for i in range(5)])) == 0
    assert len(written(spark, tmp_path / "c", [])) == 0
    assert len(written(spark, tmp_path / "d", [(1, None), (None, [NAN])])) == 0
