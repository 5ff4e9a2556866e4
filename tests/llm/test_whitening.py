"""Whitening against numpy's eigenvalues."""

import math
from collections import defaultdict

import numpy as np
import pytest

from listforge.llm import whitening

KIND = "vec_id long, embedding array<double>, x string, v string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "v", "id") for i, v in rows], KIND)


def brute(rows, k=16):
    """{row number: (deviation, [whitened up to sign])}, explained shares, n."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    fit = np.array(sorted({tuple(r) for r in x}))
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return dev, np.abs((np.array(x) - s / n) @ u / np.sqrt(e)), e / (z * z).sum() * n, n


def test_factorisation_and_rotation():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (5, 5), (12, 4), (30, 30), (6, 0)):
        b = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-1, 2, size=rank)
        a = b @ b.T
        lower, order = whitening.pivoted_cholesky(a)
        assert lower.shape == (d, rank)
        assert np.allclose(lower @ lower.T, a[np.ix_(order, order)], atol=1e-10 * max(1.0, np.abs(a).max()))
        assert np.allclose(np.triu(lower[:rank], 1), 0)
        values, parts = whitening.eigen_of(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9)
        assert np.allclose(parts @ parts.T, np.eye(rank), atol=1e-12)


def test_equals_eigh_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    dev, white, share, n = brute(rows)
    got = defaultdict(dict)
    for r in whitening.whitened_embeddings(df).collect():
        got[r["vec_id"]][r["component"]] = r
    assert len(got) == len(rows)
    signs = defaultdict(set)
    for a, (i, _) in enumerate(rows):
        assert sorted(got[i]) == list(range(1, 17))
        for c, r in got[i].items():
            assert (r["n"], r["deviation"], int(r["deviation_exact"])) == (n, dev[a], dev[a])
            assert abs(abs(r["whitened"]) - white[a, c - 1]) < 1e-8
            assert abs(r["explained"] / share[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-10
            signs[c].add(r["whitened"] > 0)
    assert all(s == {True, False} for s in signs.values())


def test_copies_bad_vectors_and_other_lengths(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=5).tolist()) for i in range(20)]
    rows = good + [(30 + i, good[3][1]) for i in range(9)] + good[:2] + [(None, good[4][1])]
    bad = [(50, None), (51, [None] * 5), (52, [float("nan")] * 5), (53, [1.0, 2.0, float("-inf"), 0.0, 0.0]), (54, []),
           (55, [1.0, 2.0])]
    dev, white, _, n = brute(rows, 5)
    got = sorted(((str(r["vec_id"]), r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6))
                  for r in whitening.whitened_embeddings(frame(spark, rows + bad)).collect()))
    want = sorted((str(i), c + 1, 20, dev[a], round(white[a, c], 6)) for a, (i, _) in enumerate(rows) for c in range(5))
    assert n == 20 and got == want


def test_low_rank_equal_and_no_vectors(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)]
    got = whitening.whitened_embeddings(frame(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 6 and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    assert whitening.whitened_embeddings(frame(spark, [(1, [1.0]), (2, [1.0])])).count() == 0
    assert whitening.whitened_embeddings(frame(spark, [])).count() == 0
    assert whitening.whitened_embeddings(frame(spark, [(1, None)])).count() == 0


def test_deviation_beyond_a_long_and_entries_too_large(spark):
    big = [(i, [1e11 * i, -1e11 * i]) for i in range(8)]
    dev, _, _, _ = brute(big)
    got = {r["vec_id"]: (r["deviation"], int(r["deviation_exact"])) for r in
           whitening.whitened_embeddings(frame(spark, big)).collect()}
    assert got == {i: (d if d < 2 ** 63 else None, d) for (i, _), d in zip(big, dev, strict=True)}
    assert None in {d for d, _ in got.values()}
    with pytest.raises(ValueError):
        whitening.whitened_embeddings(frame(spark, [(1, [1e17]), (2, [2.0])]))
