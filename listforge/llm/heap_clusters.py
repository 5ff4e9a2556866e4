"""Centroid clustering with heap-ordered bounds, exact in integers.

For its vector's distances u to the own and l to the next centroid, l - u is how far the
centroids may move together before the vector can change sides.  Each cluster of a block of
vectors keeps a heap of these gaps, entered with the drift that the cluster had gathered by
then; a round pops only the vectors whose entry the drift has reached, scans all centroids
for them exactly and enters them anew.  The others cost nothing.

A block is one row: its vectors and its heaps.  A round is one pass without a shuffle that
writes the blocks again; what leaves the tasks is the change of every cluster's sums, added
by position, so the driver holds clusters x dimensions numbers whatever the data.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import matrix_of, summed
from listforge.session import scratch_path, ship_package

CLUSTERS, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
BLOCK_ROWS = 4096
_BLOCK = ("ids array<long>, vectors binary, width int, sizes array<int>, keys binary, members binary, "
          "touched array<int>, change array<long>, scanned long")


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact, as int64; ValueError where 62 bits do not hold them."""
    if not len(x):
        return np.zeros((0, len(centres)), dtype=np.int64)
    most = (int(np.abs(x).max()) + int(np.abs(centres).max())) ** 2 * x.shape[1]
    if most < 1 << 52:  # every product and sum is a whole number that a double holds
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    if most >= 1 << 62:
        raise ValueError("components are too large for exact squared distances")
    out = np.empty((len(x), len(centres)), dtype=np.int64)
    for j, centre in enumerate(centres):
        out[:, j] = ((x - centre) ** 2).sum(axis=1)
    return out


class Heaps:
    """The gap heaps of one block: per cluster a heap of (entry, member)."""

    def __init__(self, lists: list[list[tuple[float, int]]]):
        self.lists = lists

    @classmethod
    def load(cls, sizes: list[int], keys: bytes, members: bytes) -> Heaps:
        pairs, out, at = list(zip(np.frombuffer(keys).tolist(), np.frombuffer(members, "<i4").tolist(), strict=True)), [], 0
        for n in sizes:
            out.append(pairs[at:at + n])  # written in heap order
            at += n
        return cls(out)

    def dump(self) -> tuple[list[int], bytes, bytes]:
        flat = [p for h in self.lists for p in h]
        return ([len(h) for h in self.lists], np.array([k for k, _ in flat], dtype="<f8").tobytes(),
                np.array([m for _, m in flat], dtype="<i4").tobytes())

    def expired(self, drift: list[float]) -> list[tuple[int, int]]:
        """Pop (cluster, member) of every entry that its cluster's drift has reached."""
        out = []
        for c, (heap, reached) in enumerate(zip(self.lists, drift, strict=True)):
            while heap and heap[0][0] <= reached:
                out.append((c, heapq.heappop(heap)[1]))
        return out

    def enter(self, members: list[int], x: np.ndarray, centres: np.ndarray, drift: list[float]) -> np.ndarray:
        """Scan the members' vectors exactly, push each to its cluster's heap; their clusters."""
        d = squared_distances(x, centres)
        own = d.argmin(axis=1)  # the first of equal ones: the smaller number
        near = np.sqrt(d[np.arange(len(d)), own].astype(np.float64))
        d[np.arange(len(d)), own] = np.iinfo(np.int64).max
        far = np.sqrt(d.min(axis=1).astype(np.float64)) if len(centres) > 1 else np.full(len(d), np.inf)
        gap = far - near - 1e-9 * (near + 1.0)  # below the true gap, whatever the rounding
        for c, g, m in zip(own.tolist(), gap.tolist(), members, strict=True):
            heapq.heappush(self.lists[c], (g + drift[c], m))
        return own


def kept_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS,
                 scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * component) of vectors with exactly ``dims`` finite components."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & (F.size("v") == dims)
                      & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``2:<vec_id>`` (a null id as empty text), ties by components."""
    name = F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [list(r["x"]) for r in vectors.select("x", F.sha2(name, 256).alias("h")).orderBy("h", "x").limit(
        clusters).collect()]


def _write(blocks: DataFrame, name: str) -> DataFrame:
    """One folder a round; small row groups, since a row is a whole block."""
    path = scratch_path(blocks.sparkSession, name)
    blocks.write.option("parquet.block.size", 16 << 20).parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def _block_row(ids: list, x: np.ndarray, heaps: Heaps, touched: dict[int, np.ndarray], scanned: int) -> dict:
    width = next(w for w in (2, 4, 8) if w == 8 or int(np.abs(x).max(initial=0)) < 1 << (8 * w - 1))
    sizes, keys, members = heaps.dump()
    return {"ids": ids, "vectors": x.astype(f"<i{width}").tobytes(), "width": width, "sizes": sizes, "keys": keys,
            "members": members, "touched": list(touched), "scanned": scanned,
            "change": np.concatenate([*touched.values(), []]).astype(np.int64).tolist()}


_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("width", pa.int32()),
                     ("sizes", pa.list_(pa.int32())), ("keys", pa.binary()), ("members", pa.binary()),
                     ("touched", pa.list_(pa.int32())), ("change", pa.list_(pa.int64())), ("scanned", pa.int64())])


def _unpacked(row: dict, dims: int) -> np.ndarray:
    return np.frombuffer(row["vectors"], f"<i{row['width']}").astype(np.int64).reshape(-1, dims)


def packed_blocks(vectors: DataFrame, centres: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The first assignment: every vector scanned, the blocks with their heaps."""
    k, dims = centres.shape

    def task(parts):
        for batch in parts:
            for lo in range(0, batch.num_rows, block_rows):
                part = batch.slice(lo, block_rows)
                x = matrix_of(part.column(1), dims)
                heaps = Heaps([[] for _ in range(k)])
                own = heaps.enter(range(len(x)), x, centres, [0.0] * k)
                touched = {int(c): np.r_[(own == c).sum(), x[own == c].sum(axis=0)] for c in np.unique(own)}
                yield pa.RecordBatch.from_pylist([_block_row(part.column(0).to_pylist(), x, heaps, touched, len(x))], _SCHEMA)

    return vectors.mapInArrow(task, _BLOCK)


def settled_blocks(blocks: DataFrame, centres: np.ndarray, drift: list[float]) -> DataFrame:
    """The next assignment: only members whose gap the drift has reached are scanned."""
    dims = centres.shape[1]

    def task(parts):
        for batch in parts:
            for row in batch.to_pylist():
                x, heaps = _unpacked(row, dims), Heaps.load(row["sizes"], row["keys"], row["members"])
                popped = heaps.expired(drift)
                at = [m for _, m in popped]
                own, touched = heaps.enter(at, x[at], centres, drift), {}
                for (old, m), new in zip(popped, own.tolist(), strict=True):
                    if old != new:
                        for c, sign in ((old, -1), (new, 1)):
                            touched.setdefault(c, np.zeros(dims + 1, dtype=np.int64))
                            touched[c] += sign * np.r_[1, x[m]]
                yield pa.RecordBatch.from_pylist([_block_row(row["ids"], x, heaps, touched, len(at))], _SCHEMA)

    return blocks.mapInArrow(task, _BLOCK)


def _changes(blocks: DataFrame, k: int, dims: int) -> list[int]:
    def value(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((k, dims + 1), dtype=np.int64)
        for touched, change in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if touched:
                np.add.at(total, touched, change.values.to_numpy().reshape(-1, dims + 1))
        return total.ravel()

    return [s for s, _ in summed(blocks.select("touched", "change"), value, k * (dims + 1))]


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS,
            rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per kept row: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors are integers floor(scale * component); vectors that are null, of another length than
    ``dims`` or hold null or non-finite components take no part.  Every round assigns all vectors
    to the nearest centroid (ties: the smaller number) and moves non-empty centroids to the
    floored mean.  Repeated rows and null ids count like others; fewer rows than ``clusters``
    give as many clusters as rows; no rows give an empty result.  Components so large that a
    squared distance leaves 62 bits fail the job with ValueError.
    """
    spark = df.sparkSession
    ship_package(spark)
    vectors = kept_vectors(df, id_col, vec_col, dims, scale)
    centres = np.array(first_centroids(vectors, clusters), dtype=np.int64).reshape(-1, dims)
    k = len(centres)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string")
    blocks = _write(packed_blocks(vectors, centres, block_rows), "heap-blocks-0")
    drift, totals = [0.0] * k, [0] * (k * (dims + 1))
    for r in range(1, rounds + 1):
        totals = [a + b for a, b in zip(totals, _changes(blocks, k, dims), strict=True)]
        moved = centres.copy()
        for c in range(k):
            n, *sums = totals[c * (dims + 1):(c + 1) * (dims + 1)]
            if n:
                moved[c] = [s // n for s in sums]
        steps = [math.dist(a, b) * (1 + 1e-9) for a, b in zip(centres.tolist(), moved.tolist(), strict=True)]
        # what the own centroid and the fastest of the others can take off a gap
        drift = [d + s + max((t for j, t in enumerate(steps) if j != c), default=0.0)
                 for c, (d, s) in enumerate(zip(drift, steps, strict=True))]
        centres = moved
        blocks = _write(settled_blocks(blocks, centres, drift), f"heap-blocks-{r}")
    final = centres

    def assigned(parts):
        for batch in parts:
            for row in batch.to_pylist():
                x, own = _unpacked(row, dims), np.empty(len(row["ids"]), dtype=np.int32)
                own[np.frombuffer(row["members"], "<i4")] = np.repeat(np.arange(k), row["sizes"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(own), pa.array(((x - final[own]) ** 2).sum(axis=1))],
                    names=["vec_id", "cluster", "distance"])

    found = _write(blocks.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "heap-assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a cluster
    of_cluster = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(k)])
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    at = F.col("cluster") + 1
    return found.select("vec_id", "cluster", "distance", F.element_at(of_cluster, at).alias("cluster_inertia"),
                        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                        F.element_at(F.array(*map(F.lit, digests)), at).alias("centroid_sha256"))
