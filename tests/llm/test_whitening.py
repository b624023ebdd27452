"""Whitening: eigenvectors of hard matrices, rows against numpy, odd rows."""

import numpy as np
import pytest

from geotrail.llm import queries, whitening

rng = np.random.default_rng(5)
TURN = np.linalg.qr(rng.normal(size=(40, 40)))[0]
SPECTRA = {
    "apart": np.arange(40) + 1.0,
    "two values": np.r_[np.ones(15), 2 * np.ones(25)],
    "cluster": np.r_[1 + np.arange(8) * 1e-9, np.arange(32) + 2.0],
    "tight": 1 + np.arange(40) * 1e-12,
    "falling": 10.0 ** -np.arange(40),
    "singular": np.r_[np.zeros(30), np.arange(10) + 1.0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenvectors(name):
    matrix = TURN @ np.diag(SPECTRA[name]) @ TURN.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.eigenvectors(matrix)
    size = np.abs(matrix).max()
    assert (np.diff(values) <= 0).all() and np.abs(values - np.linalg.eigvalsh(matrix)[::-1]).max() < 1e-14 * size * 40
    assert np.abs(vectors.T @ vectors - np.eye(40)).max() < 4e-15
    assert np.abs(matrix.astype(np.longdouble) @ vectors - vectors * values).max() < 1e-14 * size


def test_single_precision_start_is_corrected():
    matrix = TURN @ np.diag(SPECTRA["apart"]) @ TURN.T
    _, rough = np.linalg.eigh(matrix.astype(np.float32))
    _, vectors = whitening.eigenvectors(matrix)
    exact = TURN[:, ::-1] * np.sign((TURN[:, ::-1] * vectors).sum(0))
    assert np.abs(vectors - exact).max() < 1e-13 < 1e-9 < np.abs(np.abs(rough[:, ::-1]) - np.abs(exact)).max()


def plain(rows, k=4):
    """(vec_id, component, n, deviation, |whitened|, explained) in numpy and Python numbers."""
    whole = [(i, np.floor(256 * np.asarray(v, float)).astype(np.int64)) for i, v in rows]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in whole}))
    n, sums = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    return [
        (i, c + 1, n, sum(int(d) ** 2 for d in n * x - sums), abs((x - sums / n) @ vectors[:, c] / np.sqrt(values[c])), values[c] / values.sum())
        for i, x in whole
        for c in range(k)
    ]


def same(got, want):
    got = sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got)
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in sorted(want)], rtol=1e-9, atol=1e-9)


def test_rows_of_the_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.op13_whitening(spark, sf_dir).collect()
    same(got, plain(rows))
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-9
    signs = {}
    vectors = {i: np.floor(256 * np.asarray(v, float)) for i, v in rows}
    for r in got:
        signs.setdefault(r["component"], []).append((r["vec_id"], r["whitened"]))
    for own in signs.values():  # one sign for all rows: whitened is one linear map of the vectors
        x, w = np.array([vectors[i] for i, _ in own]), np.array([v for _, v in own])
        fitted, *_ = np.linalg.lstsq(np.c_[x, np.ones(len(x))], w, rcond=None)
        assert np.abs(np.c_[x, np.ones(len(x))] @ fitted - w).max() < 1e-8


def test_odd_rows(spark):
    vectors = (rng.normal(size=(60, 5)) * [5, 4, 3, 2, 1]).tolist()
    rows = [(k % 50, v) for k, v in enumerate(vectors)] + [(7, vectors[0])] * 30 + [(None, vectors[1]), (90, [0.0] * 5)]
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, [1.0]), (105, [])]
    table = spark.createDataFrame([(*r, 3) for r in rows + odd], "vec_id long, embedding array<double>, whitened int").repartition(40)
    got = whitening.whiten(table, whitening.fit_whitening(table)).collect()
    ids = lambda i: -1 if i is None else i
    same([{**r.asDict(), "vec_id": ids(r["vec_id"])} for r in got], plain([(ids(i), v) for i, v in rows]))
    for few in (table.limit(0), table.where("vec_id >= 100"), spark.createDataFrame([(1, [0.5, 0.5])] * 3, "vec_id long, embedding array<float>")):
        assert whitening.whiten(few, whitening.fit_whitening(few)).collect() == []
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(line, whitening.fit_whitening(line)).collect()} == {1}


def test_numbers_beyond_64_bits(spark):
    rows = [(k, [float(k) * 1e14, 1.0 - k]) for k in range(6)] + [(9, [1e300, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(table, whitening.fit_whitening(table)).collect()
    assert len({r["vec_id"] for r in got}) == 7 and {r["deviation"] for r in got} == {None} and all(np.isfinite(r["whitened"]) for r in got)
