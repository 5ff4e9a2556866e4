"""Heap-ordered clustering against plain rounds over all vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from listforge.llm import heap_clusters as H

KIND = "vec_id long, embedding array<double>, x string, cluster string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "c", "v") for i, v in rows], KIND)


def brute(rows, clusters, rounds, scale=256):
    x = [tuple(math.floor(scale * c) for c in v) for _, v in rows]
    name = ["" if i is None else str(i) for i, _ in rows]
    seeds = sorted(range(len(rows)), key=lambda a: (hashlib.sha256(f"2:{name[a]}".encode()).hexdigest(), x[a]))[:clusters]
    centres = [x[a] for a in seeds]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(p)[1] for p in x]
        for j in range(len(centres)):
            mine = [p for p, o in zip(x, own, strict=True) if o == j]
            if mine:
                centres[j] = tuple(sum(col) // len(mine) for col in zip(*mine, strict=True))
    last = [nearest(p) for p in x]
    by = {j: sum(d for d, o in last if o == j) for j in range(len(centres))}
    return sorted(((i, o, d, by[o], sum(by.values()), hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest())
                   for (i, _), (d, o) in zip(rows, last, strict=True)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_plain_rounds_with_copies_ties_and_bad_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(4 * (i % 3), 1) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + rows[:3] + [(None, rows[9][1]), (None, rows[9][1])]
    rows += [(300 + i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(20)]
    bad = [(400, None), (401, [None] * 4), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (404, [1.0] * 5), (405, [])]
    for scale in (256, 2):  # coarse: many ties
        df = H.cluster(frame(spark, rows + bad), clusters=12, rounds=5, dims=4, scale=scale, block_rows=17)
        assert got(df) == brute(rows, 12, 5, scale)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [-2.0, 7.0])]
    assert got(H.cluster(frame(spark, rows), dims=2)) == brute(rows, 40, 5)
    assert got(H.cluster(frame(spark, rows), clusters=1, dims=2)) == brute(rows, 1, 5)
    for none in ([], [(1, None)], [(1, [1.0])]):
        df = H.cluster(frame(spark, none), dims=2)
        assert df.count() == 0 and df.columns[0] == "vec_id"


def test_the_table_and_only_expired_members_are_scanned(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert got(H.cluster(df)) == brute(rows, 40, 5)
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, size=(6, 4))
    x = np.concatenate([c + rng.integers(-9, 9, size=(50, 4)) for c in centres])
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, x array<long>")
    first = H.packed_blocks(vectors, centres)
    assert sum(r["scanned"] for r in first.select("scanned").collect()) == 300
    near = H.settled_blocks(first, centres + 1, [4.0] * 6)
    assert sum(r["scanned"] for r in near.select("scanned").collect()) == 0
    far = H.settled_blocks(first, -centres, [1000.0] * 6)
    assert sum(r["scanned"] for r in far.select("scanned").collect()) == 300


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [1e3 * i * i, -1e3 * i]) for i in range(30)]
    assert got(H.cluster(frame(spark, rows), clusters=4, dims=2)) == brute(rows, 4, 5)
    with pytest.raises(Exception, match="too large"):
        H.cluster(frame(spark, [(1, [1e15]), (2, [-1e15])]), dims=1).collect()
