"""Queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listforge.llm import heap_clusters, multi_index, whitening
from listforge.llm.common import table


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_embeddings(table(spark, sf_dir, "embeddings"))


def op13_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_clusters.cluster(table(spark, sf_dir, "embeddings"))


def _clusters_sql(clusters: int = heap_clusters.CLUSTERS, rounds: int = heap_clusters.ROUNDS) -> str:
    """Plain rounds of assignment and means, one pair of CTEs each."""
    ctes = ["""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v
  QUALIFY c < {clusters})"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, any_value(v.x) AS x, min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))
                               * 1000 + c.c) AS best
  FROM v, c{i} AS c GROUP BY r, vec_id)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} AS c LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
      SELECT best % 1000 AS c, i, sum(e) AS s, count(*) AS n
      FROM (SELECT best, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY 1, 2) GROUP BY c) AS m
  ON m.c = c.c)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(best % 1000 AS INTEGER) AS cluster, CAST(best // 1000 AS BIGINT) AS distance,
       CAST(sum(best // 1000) OVER (PARTITION BY best % 1000) AS BIGINT) AS cluster_inertia,
       CAST(sum(best // 1000) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON c.c = a.best % 1000
"""


QUERIES = {f.__name__: f for f in (op2_multi_index, op11_whitening, op13_heap_clusters)}
ORACLE: dict[str, str] = {"op13_heap_clusters": _clusters_sql()}
