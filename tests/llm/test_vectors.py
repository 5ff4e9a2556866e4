"""The multi-index against brute force."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from listforge.llm import multi_index

NAN, INF = float("nan"), float("inf")


def exact(rows, queries, k=5):
    """[(id, vector)] -> [(query, rank, id)]: by cosine, ties to the smaller id."""
    x, ids = np.array([v for _, v in rows], dtype=np.float64), np.array([i for i, _ in rows])
    norm, out = np.sqrt((x * x).sum(axis=1)), []
    for q in sorted(queries):
        a = int(np.flatnonzero(ids == q)[0])
        s = (x * x[a]).sum(axis=1) / (norm * norm[a])
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out += [(int(q), r + 1, int(ids[i])) for r, i in enumerate(best)]
    return out


def test_recall_of_the_index(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = exact(rows, [i for i, _ in rows if i % 50 == 0])
    got = multi_index.nearest(df, F.col("vec_id") % 50 == 0).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(got) == len(want)
    assert len(found & {(q, v) for q, _, v in want}) >= 0.9 * len(want)


def test_full_share_is_exact_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_ENTRIES", 7)
    monkeypatch.setattr(multi_index, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=6).round(1).tolist()) for i in range(60)]
    good += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(30)]  # copies: ties
    bad = [(200, None), (205, [0.0] * 6), (210, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (215, [NAN] * 6), (220, [INF] * 6),
           (225, [1.0, 2.0]), (230, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<double>, score string")
    got = multi_index.nearest(df, F.col("vec_id") % 5 == 0, codes=4, share=1.0)
    want = exact(good, [i for i, _ in good if i % 5 == 0])
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == want


def test_query_blocks_are_spread_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_QUERIES", 10)
    rng = np.random.default_rng(6)
    rows = [(50 * i, rng.normal(size=4).tolist()) for i in range(100)]  # 10 cuts, all ids divisible by 50
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.nearest(df, F.lit(True), codes=4, share=1.0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == exact(rows, [i for i, _ in rows])
    seen = [multi_index.crc32(i.to_bytes(8, "little", signed=True)) % 10 for i, _ in rows]
    assert max(map(seen.count, range(10))) <= 25


def test_fewer_candidates_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 0.5])], kind)
    got = multi_index.nearest(few, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1)]  # a repeated id once, by its best row
    one = spark.createDataFrame([(0, [1.0, 0.0])], kind)
    assert multi_index.nearest(one, F.col("vec_id") == 0).count() == 0
    assert multi_index.nearest(spark.createDataFrame([], kind), F.lit(True)).count() == 0


def test_more_copies_of_a_row_than_places(spark):
    kind = "vec_id long, embedding array<double>"
    others = [(10 + i, [1.0, 0.1 * (i + 2)]) for i in range(7)]
    copies = [(1, [1.0, 0.1])] * 40
    versions = [(2, [1.0, 0.15 + 1e-4 * i]) for i in range(20)]  # one id, near vectors of its own
    df = spark.createDataFrame([(0, [1.0, 0.0]), *copies, *versions, *others], kind)
    for share in (1.0, 0.01):
        got = multi_index.nearest(df, F.col("vec_id") == 0, codes=1, share=share).collect()
        assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2), (3, 10), (4, 11), (5, 12)]
    # far copies that hold most rows do not end the walk before k ids are found
    got = multi_index.nearest(df, F.col("vec_id") == 0, codes=8, share=0.01).collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and len({r["vec_id"] for r in got}) == 5


def test_cells_come_in_ascending_order():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.random(7), rng.random(5)
        counts = rng.integers(0, 3, (7, 5))
        got = multi_index.cells_by_distance(a, b, counts, 10 ** 6)
        want = sorted((a[i] + b[j], (i, j)) for i, j in itertools.product(range(7), range(5)) if counts[i, j])
        assert got == [c for _, c in want]
        some = multi_index.cells_by_distance(a, b, counts, 4)
        assert some == got[:len(some)] and sum(counts[c] for c in some) >= min(4, counts.sum())
