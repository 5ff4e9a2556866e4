"""Pfair interleaving of sources to target weights, in DataFrame operations only.

A source with p of q parts has weight p/q.  Its j-th block (from 1) is a subtask with
release floor((j-1) q/p) and deadline ceil(j q/p); earliest deadline first over the
released blocks gives every block a slot inside its window, so after t slots each source
has had t p/q blocks, give or take less than one.  The schedule repeats after q slots, so
only one period is computed (q rows: a parameter, whatever the data); block j takes the
slot of block j mod p, moved by whole periods.  A source that has run out leaves its slots
empty; the order of the others does not change.  Every document appears exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listforge.llm.common import small
from listforge.session import materialize

PERIOD = 1000          # parts to share among the sources
BLOCK_DOCS = 16        # documents of one block
BUCKETS = 1024         # ranges of the shuffled order a source is numbered in


def _source_key(source_col: str) -> Column:
    """The source as a join key; rows without one share the key 'n'."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))


def target_parts(docs: DataFrame, source_col: str = "source", period: int = PERIOD,
                 temperature: float = 0.5) -> DataFrame:
    """(source, parts): weights proportional to documents ** temperature, at least one part."""
    n = docs.groupBy(_source_key(source_col).alias("_src")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.pow("_n", F.lit(temperature))
    total = n.agg(F.sum(share)).scalar()
    return n.select("_src", F.greatest(F.lit(1), F.round(share / total * period)).cast("int").alias("parts"))


def period_schedule(parts: DataFrame) -> DataFrame:
    """One period of the schedule: _src, parts, period, k (block, from 0), slot, release, deadline.

    ``parts`` has one row per source.  The slots of a period are dealt one after the other in one
    row, since each depends on those before: as many steps as the period has slots, over the
    sources: right for any number, but slow beyond some hundreds (1,500 take over a minute).
    """
    one = parts.agg(F.array_sort(F.collect_list(F.struct("_src", "parts"))).alias("s"))
    one = one.withColumn("q", F.aggregate("s", F.lit(0), lambda a, x: a + x["parts"]))
    step = """
      aggregate(sequence(0, q - 1),
        named_struct('done', transform(s, x -> 0), 'picked', cast(array() as array<int>)),
        (acc, t) -> transform(array(array_min(transform(s, (x, i) ->
              if(acc.done[i] * q div x.parts <= t,
                 named_struct('deadline', ((acc.done[i] + 1) * q + x.parts - 1) div x.parts, 'i', i),
                 cast(null as struct<deadline: bigint, i: int>))))),
            best -> named_struct('done', transform(acc.done, (d, i) -> if(i = best.i, d + 1, d)),
                                 'picked', array_append(acc.picked, best.i)))[0],
        acc -> acc.picked)"""
    picked = one.where("q > 0").select("s", "q", F.expr(step).alias("p"))
    slots = picked.select("s", "q", F.posexplode("p").alias("slot", "i"))
    k = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    at = F.expr("s[i]")
    out = slots.select(at["_src"].alias("_src"), at["parts"].cast("long").alias("parts"),
                       F.col("q").cast("long").alias("period"), k.cast("long").alias("k"),
                       F.col("slot").cast("long").alias("slot"))
    return out.withColumn("release", F.expr("k * period div parts")).withColumn(
        "deadline", F.expr("((k + 1) * period + parts - 1) div parts"))


def interleave(docs: DataFrame, parts: DataFrame | None = None, id_col: str = "doc_id",
               source_col: str = "source", block_docs: int = BLOCK_DOCS,
               buckets: int = BUCKETS, tie: Column | None = None) -> DataFrame:
    """The input with block, release, deadline, slot and pos (place inside the block) as ``_mix``.

    Inside a source documents follow the md5 of their id (ties: the id, then the row's
    hash, or ``tie``).  The position is found in two levels, bucket totals and row numbers inside a
    bucket, so a source with a third of all rows is spread over ``buckets`` tasks.  A null
    source is a source of its own; null ids and repeated rows are numbered like others.
    ``parts`` must name every source of the input; without it ``target_parts`` decides.  An
    empty table gives an empty result.
    """
    parts = target_parts(docs, source_col) if parts is None else parts
    plan = materialize(period_schedule(parts), "mix-period")
    cols = docs.columns
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    keyed = docs.select(
        F.struct(*[F.col(c) for c in cols]).alias("_row"),
        _source_key(source_col).alias("_src"), order.alias("_o"),
        (F.xxhash64(F.struct(*cols)) if tie is None else tie).alias("_tie"))
    keyed = keyed.withColumn("_b", (F.conv(F.substring("_o", 1, 6), 16, 10).cast("long")
                                    * buckets / (1 << 24)).cast("int"))
    totals = keyed.groupBy("_src", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_src", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_src", "_b").orderBy(
        "_o", F.col(f"_row.{id_col}"), "_tie")
    placed = keyed.withColumn("_rn", F.row_number().over(inside) - 1).join(totals, ["_src", "_b"])
    placed = placed.withColumn("_at", F.col("_rn") + F.col("_off")).withColumn(
        "_j", F.floor(F.col("_at") / block_docs)).withColumn("_pos", F.col("_at") % block_docs)
    sizes = plan.select("_src", "parts").distinct()
    placed = placed.join(small(sizes), "_src")  # a row per source
    placed = placed.withColumn("k", F.col("_j") % F.col("parts")).withColumn(
        "_round", F.floor(F.col("_j") / F.col("parts")))
    placed = placed.drop("parts").join(small(plan), ["_src", "k"])
    turn = F.col("_round") * F.col("period")
    return placed.select("_row", F.struct(
        F.col("_j").alias("block"), (F.col("release") + turn).alias("release"),
        (F.col("deadline") + turn).alias("deadline"), (F.col("slot") + turn).alias("slot"),
        F.col("_pos").cast("long").alias("pos"), "parts", "period").alias("_mix"))


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The input sorted into the interleaved order, columns as they are."""
    rows = interleave(docs, **options)
    return rows.orderBy("_mix.slot", "_mix.pos").select("_row.*")
