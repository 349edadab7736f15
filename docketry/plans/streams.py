"""Streaming jobs over the given tables, run to the end of what is there and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketry.operators.boxes import shared_dir
from docketry.registry import register
from docketry.streaming import jobs as J

from .fixtures import table


def _place(spark, df, name):
    """A folder of the shared place: df as stream input, and where to write."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/in")
    return root


@register("x1_arrivals", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[ \\t\\r\\n\\f]+', '', 'g')) >= 80 THEN 'direct' ELSE 'scanned' END AS route, CAST(NULL AS VARCHAR) AS error FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'failed', 'no text' FROM documents WHERE text IS NULL")
def x1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    root = _place(spark, docs.repartition(6, "doc_id"), "x1")
    J.run_once(J.routed(J.arrivals(spark, f"{root}/in", docs.schema)), f"{root}/out", f"{root}/ck")
    return spark.read.schema("doc_id long, route string, error string").parquet(f"{root}/out")


@register("x2_latest_state", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def x2(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    root = _place(spark, e.repartitionByRange(4, "event_id"), "x2")
    stream = J.arrivals(spark, f"{root}/in", e.schema, 1)
    J.run_once(stream, "", f"{root}/ck", "update", J.latest_state("user_id", "event_id", f"{root}/state"))
    return J.current_state(spark, f"{root}/state", e.schema)


@register("x3_epoch_metrics", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x3(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    root = _place(spark, e.repartitionByRange(4, "ts"), "x3")
    J.run_once(J.epoch_metrics(J.arrivals(spark, f"{root}/in", e.schema, 100)), "", f"{root}/ck", "update", J.each_version(f"{root}/out"))
    out = J.newest(spark, f"{root}/out", "start timestamp, event_type string, n long, total double", ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_LOOKS = ", ".join(map(str, J.poll_offsets()))


@register("x4_job_polling", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS job_id, epoch_us(ts) AS tm, event_id, CASE WHEN event_id % 5 = 0 THEN 'done' WHEN event_id % 17 = 0 THEN 'failed' ELSE 'running' END AS state FROM events),
u AS (SELECT job_id, tm, arg_max(state, event_id) AS state FROM e GROUP BY 1, 2),
o AS (SELECT unnest([{_LOOKS}]) AS off, unnest(range(1, {len(J.poll_offsets())} + 1)) AS looks),
l AS (SELECT u.job_id, u.tm AS began, off, looks, u.tm + off AS look FROM u, o),
s AS (SELECT l.*, CASE WHEN off = {J.poll_offsets()[-1]} THEN 'timeout' ELSE p.state END AS state FROM l ASOF JOIN u p ON l.job_id = p.job_id AND l.look >= p.tm),
f AS MATERIALIZED (SELECT job_id, began, arg_min(state, looks) AS state, CAST(min(looks) - CAST(arg_min(state, looks) = 'timeout' AS INT) AS INTEGER) AS looks, arg_min(look, looks) AS ended FROM s WHERE state <> 'running' GROUP BY 1, 2),
x AS MATERIALIZED (SELECT f.*, n.tm AS next FROM f ASOF LEFT JOIN u n ON f.job_id = n.job_id AND f.ended < n.tm),
r AS (SELECT x.* FROM x JOIN (SELECT job_id, min(tm) AS tm FROM u GROUP BY 1) m ON x.job_id = m.job_id AND x.began = m.tm UNION ALL SELECT x.* FROM r JOIN x ON x.job_id = r.job_id AND x.began = r.next)
SELECT job_id, began, state, looks, ended FROM r""")
def x4(spark, sf):
    """Events as states of the job `user_id`, looked at with growing pauses until it is done, has failed or has timed out."""
    state = F.when(F.col("event_id") % 5 == 0, "done").when(F.col("event_id") % 17 == 0, "failed").otherwise("running")
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"), state.alias("state"))
    root = _place(spark, J.with_end(e, "ts", job_id=-1, ord=-1, state="running"), "x4")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        J.run_once(J.polled(J.arrivals(spark, f"{root}/in", e.schema, 100)), f"{root}/out", f"{root}/ck")
    finally:
        spark.conf.set(store, before)
    return spark.read.schema("job_id long, began long, state string, looks int, ended long").parquet(f"{root}/out")


@register("x4_job_timeouts", "WITH e AS (SELECT user_id AS job_id, ts, CASE WHEN event_id % 5 = 0 THEN 'done' WHEN event_id % 17 = 0 THEN 'failed' ELSE 'running' END AS state FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts) <= INTERVAL 600 SECOND THEN 0 ELSE 1 END AS nw FROM e), s AS (SELECT *, sum(nw) OVER (PARTITION BY job_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM g) SELECT job_id, CASE WHEN max(struct_pack(a := ts, b := state)).b IN ('done', 'failed') THEN max(struct_pack(a := ts, b := state)).b ELSE 'timeout' END AS state, count(*) AS n FROM s GROUP BY job_id, run")
def x4_sessions(spark, sf):
    state = F.when(F.col("event_id") % 5 == 0, "done").when(F.col("event_id") % 17 == 0, "failed").otherwise("running")
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), state.alias("state"), F.col("ts").cast("timestamp").alias("ts"))
    root = _place(spark, J.with_end(e, "ts"), "x4")
    J.run_once(J.timeouts(J.arrivals(spark, f"{root}/in", e.schema, 100)), f"{root}/out", f"{root}/ck")
    return spark.read.schema("job_id long, state string, n long").parquet(f"{root}/out")


@register("x5_placeholders", "SELECT event_id AS token, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '[pending]' END AS text FROM events")
def x5(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("token"), F.col("ts").cast("timestamp").alias("ts"))
    r = table(spark, sf, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("rtoken"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 5 MINUTES")).alias("rts"), F.col("event_type").alias("text"))
    a, b = _place(spark, J.with_end(e, "ts", token=-1), "x5"), _place(spark, J.with_end(r, "rts", rtoken=-2), "x5r")
    J.run_once(J.filled_placeholders(J.arrivals(spark, f"{a}/in", e.schema, 100), J.arrivals(spark, f"{b}/in", r.schema, 100)), f"{a}/out", f"{a}/ck")
    return spark.read.schema("token long, text string").parquet(f"{a}/out")


@register("x6_progress", "SELECT user_id, count(*) AS done, max(event_id) AS last FROM events GROUP BY 1")
def x6(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id")
    root = _place(spark, e.repartition(4, "event_id"), "x6")
    counts = J.arrivals(spark, f"{root}/in", e.schema, 100).groupBy("user_id").agg(F.count("*").alias("done"), F.max("event_id").alias("last"))

    J.run_once(counts, "", f"{root}/ck", "update", J.each_version(f"{root}/out"))
    return J.newest(spark, f"{root}/out", "user_id long, done long, last long", ["user_id"])
