"""Approximate nearest neighbours by cosine with an inverted multi-index.

A unit vector is cut into two halves, each quantised by its own k-means codebook; an entry
lies in the cell of its two codes.  A query walks the cells in ascending order of the summed
half distances (a heap over the two sorted code lists) until the cells it passed hold a
stated share of all entries; those entries are reranked by their exact cosine.

The work is cut by the first code and, where one code holds many entries or there are many
queries, into blocks of bounded size, so a task sees a bounded part whatever the skew.
"""

from __future__ import annotations

import heapq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listforge.llm.common import batches
from listforge.session import materialize, ship_package

CODES = 64               # per half
SAMPLE_ROWS = 20_000     # expected rows the codebooks are fitted on
SHARE = 0.5              # of all entries that a query reranks
BLOCK_ENTRIES = 20_000
BLOCK_QUERIES = 4_000
K = 5


def fit_codebook(x: np.ndarray, codes: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means; fewer distinct rows than codes give fewer codes."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:codes]].copy()
    for _ in range(rounds):
        code = nearest_code(x, centres)
        n = np.bincount(code, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, code, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest_code(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ (-2.0 * centres.T) + (centres ** 2).sum(axis=1)).argmin(axis=1)


def cells_by_distance(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Non-empty cells in ascending order of d1[i] + d2[j], until they hold ``enough`` entries."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap, reached, out, have = [(a[0] + b[0], 0, 0)], [0] * len(a), [], 0
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        n = counts[o1[i], o2[j]]
        if n:
            out.append((o1[i], o2[j]))
            have += int(n)
        reached[i] = j + 1
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return out


def _matrix(col) -> np.ndarray:
    return np.array(col.to_pylist(), dtype=np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>): no null, zero, null-holding or non-finite vectors, no null ids.

    Vectors of another length than the commonest (ties: the longest) take no part either.
    """
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        sound & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
            codes: int = CODES, share: float = SHARE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k nearest rows found, by cosine.

    ``is_query`` is a condition on vec_id; every usable row is a candidate, but those with
    the query's own id.  Ties go to the smaller id; a repeated id counts once, by its best
    row.  Score is the cosine of the original vectors in double precision.  No usable
    vectors give an empty result.
    """
    spark = df.sparkSession
    ship_package(spark)
    # equal rows are one entry, so copies take neither a place among the k nor a share of the walk
    rows = materialize(usable_vectors(df, id_col, vec_col).dropDuplicates(["vec_id", "v"]), "imi-vectors")
    total = rows.count()
    out_schema = "query_id long, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    place = F.shiftrightunsigned(F.xxhash64(F.lit("imi"), "vec_id", "v"), 24)
    sample = rows if total <= sample_rows else rows.where(place < int(sample_rows / total * (1 << 40)))
    x = _unit(_matrix(sample.select("v").toArrow().column(0)))
    half = x.shape[1] // 2
    books = [fit_codebook(x[:, :half], codes), fit_codebook(x[:, half:], codes)]
    shared = spark.sparkContext.broadcast(books)  # 2 x codes half vectors: a parameter

    def quantise(parts):
        make = batches({"vec_id": pa.int64(), "v": pa.list_(pa.float64()), "c1": pa.int32(), "c2": pa.int32()})
        for batch in parts:
            if batch.num_rows:
                u = _unit(_matrix(batch.column(1)))
                c1, c2 = nearest_code(u[:, :half], shared.value[0]), nearest_code(u[:, half:], shared.value[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(c1.astype(np.int32)), pa.array(c2.astype(np.int32))],
                    schema=make([]).schema)

    entries = materialize(rows.mapInArrow(quantise, "vec_id long, v array<double>, c1 int, c2 int"), "imi-entries")
    counts = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
    for r in entries.groupBy("c1", "c2").count().collect():  # at most codes x codes rows
        counts[r["c1"], r["c2"]] = r["count"]
    # more rows than the k commonest ids have hold k + 1 ids: the query's own and k others
    commonest = rows.groupBy("vec_id").count().orderBy(F.desc("count")).limit(k).collect()
    enough = max(1 + sum(r["count"] for r in commonest), int(np.ceil(share * total)))
    queries = entries.where(is_query)
    cuts = np.maximum(1, -(-counts.sum(axis=1) // BLOCK_ENTRIES)).tolist()
    query_cuts = max(1, -(-queries.count() // BLOCK_QUERIES))

    def walk(parts):
        schema = pa.schema([("c1", pa.int32()), ("eb", pa.int32()), ("qb", pa.int32()), ("query_id", pa.int64()),
                            ("v", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32()))])
        for batch in parts:
            if not batch.num_rows:
                continue
            ids, vs, u = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unit(_matrix(batch.column(1)))
            d = [((u[:, sl] ** 2).sum(axis=1)[:, None] - 2 * u[:, sl] @ b.T + (b ** 2).sum(axis=1))
                 for sl, b in ((slice(0, half), shared.value[0]), (slice(half, None), shared.value[1]))]
            for lo in range(0, len(ids), 500):
                out = []
                for q in range(lo, min(lo + 500, len(ids))):
                    seen: dict[int, list[int]] = {}
                    for i, j in cells_by_distance(d[0][q], d[1][q], counts, enough):
                        seen.setdefault(i, []).append(j)
                    block = crc32(ids[q].to_bytes(8, "little", signed=True)) % query_cuts  # spread, whatever the ids
                    out += [(i, eb, block, ids[q], vs[q], js) for i, js in seen.items()
                            for eb in range(cuts[i])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    probes = queries.select("vec_id", "v").mapInArrow(
        walk, "c1 int, eb int, qb int, query_id long, v array<double>, cells array<int>")
    by_code = F.element_at(F.array(*[F.lit(int(c)) for c in cuts]), F.col("c1") + 1)
    blocks = entries.withColumn("eb", F.pmod(F.xxhash64("vec_id", "v"), by_code).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(int(query_cuts - 1)))))

    def rerank(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and asked.num_rows:
            own = own.sort_by("vec_id")
            c2, ids = np.array(own["c2"]), np.array(own["vec_id"])
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])  # of each id
            x, q, qid = _matrix(own["v"]), _matrix(asked["v"]), np.array(asked["query_id"])
            norm, qnorm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            wanted = np.zeros((len(q), counts.shape[1]), dtype=bool)
            for i, cells in enumerate(asked["cells"].to_pylist()):
                wanted[i, cells] = True
            for lo in range(0, len(q), 256):
                part = slice(lo, lo + 256)
                s = (q[part] @ x.T) / qnorm[part, None] / norm
                s[~wanted[part][:, c2] | (qid[part, None] == ids)] = -np.inf
                by_id = np.maximum.reduceat(s, first, axis=1) if len(first) < s.shape[1] else s
                kth = np.partition(by_id, -k, axis=1)[:, -k] if len(first) > k else np.full(len(s), -np.inf)
                # all that could tie with the k-th, then the same sum for every row
                for a, row in enumerate(s):
                    at = np.flatnonzero((row >= kth[a] - 1e-12) & (row > -np.inf))
                    exact = (x[at] * q[lo + a]).sum(axis=1) / (norm[at] * qnorm[lo + a])
                    best = np.lexsort((ids[at], -exact))
                    best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])[:k]]  # an id once
                    found.append((np.full(len(best), qid[lo + a]), ids[at][best], exact[best]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})

    key = ["c1", "eb", "qb"]
    found = blocks.groupBy(*key).cogroup(probes.groupBy(*key)).applyInArrow(rerank, out_schema)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def exact_nearest(pdf: pd.DataFrame, query_ids: set, k: int = K) -> list[tuple]:
    """Brute force over a small table, for measuring recall."""
    x, ids = np.array(pdf["embedding"].tolist(), dtype=np.float64), pdf["vec_id"].to_numpy()
    norm, out = np.sqrt((x * x).sum(axis=1)), []
    for q in sorted(query_ids):
        a = int(np.flatnonzero(ids == q)[0])
        s = (x * x[a]).sum(axis=1) / (norm * norm[a])
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out += [(int(q), r + 1, int(ids[i]), float(s[i])) for r, i in enumerate(order)]
    return out
