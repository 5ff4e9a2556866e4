"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from listforge.functions.memory import give_back, keep_only, kept  # noqa: F401

BROADCAST_ROWS = 200_000  # narrow tables of more rows are joined by a shuffle
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(col.cast("string"), F.lit("")), UPPER, UPPER.lower())


def fold_of(col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null ids: the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same with a broadcast hint if it has at most ``rows`` rows (counted)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """The name for a new column: the first of name, name_, name__ ... that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column_of(df: DataFrame, col: str, row_value, kind: str):
    """A column by ``row_value(text)`` in Arrow batches, one text at a time in Python's memory."""
    from pyspark.sql.functions import arrow_udf

    arrow = to_arrow_type(_parse_datatype_string(kind))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep_only()
        value = row_value()
        for texts in parts:
            yield pa.array([value(t.as_py()) for t in texts], type=arrow)
            give_back()

    return arrow_udf(run, kind)(F.col(col).cast("string"))


def batches(columns: dict[str, pa.DataType]):
    """A function that turns row tuples into one record batch of these columns."""
    schema = pa.schema(list(columns.items()))

    def make(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return make


def matrix_of(col: pa.Array, dims: int, kind=np.int64) -> np.ndarray:
    """A list column whose lists all have ``dims`` entries."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)


def summed(rows: DataFrame, value, size: int) -> list:
    """Element sums of ``value(batch) -> array of ``size`` `` over all batches: one short list a task,
    added by position.  Long results are added exactly."""
    def task(parts):
        total = None
        for batch in parts:
            if batch.num_rows:
                v = value(batch)
                total = v if total is None else total + v
        if total is not None:
            exact = np.issubdtype(total.dtype, np.integer)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size, dtype=np.int32)),
                 pa.array(total if exact else np.zeros(size, dtype=np.int64)),
                 pa.array(np.zeros(size) if exact else total)], names=["i", "whole", "real"])

    added = rows.mapInArrow(task, "i int, whole long, real double").groupBy("i").agg(
        F.sum(F.col("whole").cast("decimal(38,0)")).alias("whole"), F.sum("real").alias("real"))
    out = [(0, 0.0)] * size
    for r in added.collect():  # one row a position, whatever the data
        out[r["i"]] = (int(r["whole"]), r["real"])
    return out
