"""Queries over dataset sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import sampling as O
from docketry.registry import register

from .fixtures import table


@register("d1_ratio_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat('s1', doc_id)), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) q WHERE rn <= round_even(n * 0.25, 0)")
def d1(spark, sf):
    return O.ratio_sample(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 0.25, "s1")


_D2_SQL = """WITH s AS (SELECT * FROM (VALUES (0, 320, 32, 0, 64), (1, 256, 32, 64, 80), (2, 160, 48, 144, 85)) v(k, w, h, a, c)),
p AS (SELECT p_partkey AS id, (1 + p_partkey % 97) / 4.0 AS ratio, row_number() OVER (ORDER BY p_partkey) - 1 AS n, count(*) OVER () // 3 AS own FROM part),
r AS (SELECT n % 3 AS replica, n // 3 AS t, ratio, own FROM p WHERE n // 3 < own),
b AS (SELECT DISTINCT replica, (t // 229) * 3 + k AS batch, k, w, h, a + (t // 229) * 229 AS a, c, own FROM (SELECT DISTINCT replica, t - t % 229 AS t, own FROM r) q, s),
m AS (SELECT b.replica, batch, w, h, r.t, false AS padded, ratio FROM b JOIN r ON r.replica = b.replica AND r.t >= a AND r.t < a + c
  UNION ALL SELECT b.replica, batch, w, h, r.t, true, ratio FROM b JOIN r ON r.replica = b.replica AND r.t < c - greatest(0, least(a + c, b.own) - a))
SELECT CAST(replica AS BIGINT) AS replica, CAST(batch AS BIGINT) AS batch, w, h, count(*) AS n, count(*) FILTER (WHERE padded) AS n_padded, CAST(sum(t) AS BIGINT) AS places, round(CASE WHEN avg(ratio) * h < 400 THEN avg(ratio) ELSE 400.0 / h END, 6) AS ratio FROM m GROUP BY 1, 2, 3, 4"""


@register("d2_bucket_batches", _D2_SQL)
def d2(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), ((1 + F.col("p_partkey") % 97) / 4.0).alias("ratio"))
    b = O.bucket_batches(rows, "id", "ratio", [(320, 32), (256, 32), (160, 48)], 3, 320 * 32 * 64, 400)
    return b.groupBy("replica", "batch", "w", "h").agg(F.count("*").alias("n"), F.count_if("padded").alias("n_padded"), F.sum("t").alias("places"), F.round(F.first("batch_ratio"), 6).alias("ratio"))
