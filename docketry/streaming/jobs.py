"""Incremental jobs as Structured Streaming. Sources are file streams; each function takes a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor


def arrivals(spark: SparkSession, path: str, schema, per_trigger: int = 4) -> DataFrame:
    """Files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def routed(files: DataFrame) -> DataFrame:
    """Route of each arrived document; rows that can't be routed keep an error instead of failing the query."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    return files.select("doc_id", F.when(F.col("text").isNull(), "failed").when(n >= 80, "direct").otherwise("scanned").alias("route"), F.when(F.col("text").isNull(), "no text").alias("error"))


def current_state(spark: SparkSession, to: str, schema, before: int | None = None) -> DataFrame:
    """The state that `latest_state` keeps in `to`, as it was before the batch `before`: of each bucket the latest version."""
    kept = spark.read.option("basePath", to).schema(T.StructType([*schema.fields, T.StructField("version", T.IntegerType()), T.StructField("bucket", T.IntegerType())])).parquet(to)
    kept = kept if before is None else kept.where(F.col("version") < before)
    last = kept.groupBy("bucket").agg(F.max("version").alias("version"))  # a row a bucket
    return kept.join(F.broadcast(last), ["bucket", "version"]).select(*schema.fieldNames())


def latest_state(key: str, seq: str, to: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: last patch of each key by seq (X2). The state is cut into buckets by the key's hash, and a batch writes
    those it touches anew, as `to`/version=batch/bucket=b. A batch that runs again writes the same version again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        fresh = batch
        if batch_id > 0:
            touched = [r[0] for r in batch.select(at.alias("b")).distinct().collect()]  # `buckets` numbers at most
            fresh = current_state(batch.sparkSession, to, batch.schema, batch_id).where(at.isin(touched)).unionByName(batch)
        row = F.struct(*batch.columns)
        new = fresh.groupBy(key).agg(F.max_by(row, seq).alias("r")).select("r.*").withColumn("bucket", at)
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{to}/version={batch_id}")

    return write


def with_end(rows: DataFrame, ts: str, after: str = "2 days", **keys: object) -> DataFrame:
    """rows and one more with a time `after` the last, `keys` and nothing else: the end of the input, past which the watermark lets
    everything before it come out. The closing row itself never does. A key that a join asks for needs a value that meets nothing: rows
    whose key is null are dropped before they can move the watermark."""
    end = rows.agg((F.max(ts) + F.expr(f"INTERVAL {after}")).alias("end"))
    return rows.union(end.select(*[F.col("end").alias(f.name) if f.name == ts else F.lit(keys.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))


def epoch_metrics(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sums of each window and type (X3, X6): an epoch is a window, so each begins at zero. In update mode every batch gives the sums so far
    of the windows it touched, the last windows included; in append mode a window comes out once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def each_version(to: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: each batch's rows under `to`/batch=id. A batch that runs again writes the same folder again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    return write


def newest(spark: SparkSession, to: str, schema: str, keys: list[str]) -> DataFrame:
    """Of the rows that `each_version` wrote, each key's of the latest batch."""
    rows = spark.read.option("basePath", to).schema(f"{schema}, batch int").parquet(to)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__v")).select(*keys, *[F.col("__v").getField(c).alias(c) for c in values])


#: Seconds: first pause, its growth, longest pause, limit.
POLLING = (3.0, 1.5, 15.0, 600.0)


def poll_offsets(polling: tuple[float, float, float, float] = POLLING) -> list[int]:
    """Microseconds from a job's start to each look at it; the last is the limit, at which it times out unseen."""
    pause, growth, longest, limit = polling
    out, at = [], 0.0
    while at < limit:
        out.append(round(at * 1e6))
        at, pause = at + min(pause, limit - at), min(pause * growth, longest)
    return [*out, round(limit * 1e6)]


def poller(offsets: list[int]) -> StatefulProcessor:
    """A processor of its own class, which travels to the executors by value: they need no copy of this package."""

    class Poller(StatefulProcessor):
        """State of one job: its unread events (time in microseconds, order, state), when the run began, how many looks it has had.

        An event-time timer stands at the next look. A look sees the last event up to its time: done or failed ends the run, else the
        next look is after a longer pause, up to the limit, where the run has timed out. The first event after a run's end begins the next run."""

        def init(self, handle) -> None:
            self.handle = handle
            self.unread = handle.getListState("unread", "at long, ord long, state string")
            self.run = handle.getValueState("run", "began long, looks int, last string")

        def handleInputRows(self, key, rows, timerValues):
            for pdf in rows:
                at = pdf["ts"].astype("datetime64[us]").astype("int64")
                self.unread.appendList([(int(a), int(o), s) for a, o, s in zip(at, pdf["ord"], pdf["state"], strict=True)])
            if not self.run.exists():
                first = min(self.unread.get())[0]
                self.run.update((first, 0, None))
                self._wake(first)
            yield pd.DataFrame()

        def _wake(self, at: int) -> None:
            self.handle.registerTimer(-(-at // 1000))  # in milliseconds, not before the look

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentWatermarkInMs() * 1000
            events, place, (began, looks, last) = sorted(self.unread.get()), 0, self.run.get()
            out = []
            while began is not None and (look := began + offsets[looks]) <= now:
                if looks == len(offsets) - 1:
                    last = "timeout"
                else:
                    while place < len(events) and events[place][0] <= look:
                        last = events[place][2]
                        place += 1
                looks += 1
                if last in ("done", "failed", "timeout"):
                    out.append((key[0], began, last, looks - (last == "timeout"), look))
                    while place < len(events) and events[place][0] <= look:
                        place += 1
                    began, looks, last = (events[place][0] if place < len(events) else None), 0, None
            self.unread.clear()
            if events[place:]:
                self.unread.put([tuple(e) for e in events[place:]])
            if began is None:
                self.run.clear()
            else:
                self.run.update((began, looks, last))
                self._wake(began + offsets[looks])
            yield pd.DataFrame(out, columns=["job_id", "began", "state", "looks", "ended"])

        def close(self) -> None:
            pass

    return Poller()


def polled(events: DataFrame, polling: tuple[float, float, float, float] = POLLING, late: str = "10 minutes") -> DataFrame:
    """Runs of jobs as a poller sees them (X4). events: job_id, ts, ord (order of events of one time), state. Gives job_id, began and ended
    (microseconds), state (done, failed or timeout) and looks. The session's state store must be the RocksDB one."""
    keyed = events.withWatermark("ts", late).groupBy("job_id")
    return keyed.transformWithStateInPandas(poller(poll_offsets(polling)), "job_id long, began long, state string, looks int, ended long", "Append", "EventTime")


def timeouts(events: DataFrame, limit_s: int = 600, late: str = "10 minutes") -> DataFrame:
    """Jobs (job_id, state, ts) that end, or time out without news for `limit_s` (X4): a session a job closes after
    the gap; one whose last state is not done or failed has timed out."""
    s = events.withWatermark("ts", late).groupBy("job_id", F.session_window("ts", f"{limit_s} seconds").alias("s"))
    last = F.max(F.struct("ts", "state"))
    return s.agg(last.alias("l"), F.count("*").alias("n")).select("job_id", F.when(F.col("l.state").isin("done", "failed"), F.col("l.state")).otherwise("timeout").alias("state"), "n")


def filled_placeholders(placeholders: DataFrame, results: DataFrame, within: str = "1 hour") -> DataFrame:
    """Placeholders with the result of the same token that comes within the bound, else kept as they are."""
    p, r = placeholders.withWatermark("ts", "10 minutes").alias("p"), results.withWatermark("rts", "10 minutes").alias("r")
    on = F.expr(f"p.token = r.rtoken AND r.rts >= p.ts AND r.rts <= p.ts + INTERVAL {within}")
    return p.join(r, on, "leftOuter").select("p.token", F.coalesce("r.text", F.lit("[pending]")).alias("text"))


def run_once(df: DataFrame, to: str, checkpoint: str, mode: str = "append", each: Callable | None = None) -> None:
    """Everything that is there, then stop."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    q = (w.foreachBatch(each) if each else w.format("parquet").option("path", to)).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
