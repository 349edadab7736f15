"""Sharding by balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, hash_bucket, read, running_total, stored, with_uid

#: Nodes and whole groups above this share of a shard's even load are dealt singly; there are fewer than shards / SHARE.
SHARE = 1 / 256
#: Groups (the nodes of one link in one shard) up to this share of an even load move whole.
WHOLE = 1 / 32
PER_SALT = 256  # rows of one link that meet its votes in one place, or are sorted there


def propagate(nodes: DataFrame, links: DataFrame, n_shards: int = 16, rounds: int = 12, slack: float = 0.5) -> DataFrame:
    """Move linked nodes towards their neighbours' shards.

    nodes: uid long (unique), size long (>= 1). links: uid, link_id; nodes that share a link_id are
    neighbours. Both stored tables. Returns uid, size, shard, near (one of the node's links) for the linked nodes only.

    Every node starts in a shard by hash. A round sums each link's mass per shard (at most n_shards rows
    a link, however many nodes it has), gives every node the shard around it with most mass, among those with room under the
    quota (an even share of all sizes and `slack` of it more, so that full shards can still exchange nodes), and lets moves in,
    link by link, until a shard's room is used. Equal masses are decided by an order of the shards that is the link's own, so that nodes of one
    link agree and links spread. It ends when nothing moves, or after `rounds`.
    """
    spark = nodes.sparkSession
    total = nodes.agg(F.sum("size")).first()[0] or 0
    quota = int(-(-total // n_shards) * (1 + slack))
    linked = links.dropDuplicates(["uid", "link_id"])
    many = linked.groupBy("link_id").count().where("count > 1")
    many = many.select("link_id", F.ceil(F.col("count") / PER_SALT).alias("salts"))
    member = linked.join(many, "link_id").join(nodes.select("uid", "size"), "uid")
    member = stored(member.withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts"))), "shard-links")  # a large link's rows stand under many salts
    near = F.min(F.struct(F.xxhash64("link_id").alias("near"), F.col("salts").alias("fan")))
    state = stored(
        member.groupBy("uid").agg(F.first("size").alias("size"), near.alias("l")).select("uid", "size", "l.near", "l.fan", hash_bucket(n_shards, "uid").alias("shard")),
        "shard-state",
    )
    # small links stand whole in one of `wide` buckets, a large one in as many of its own as its rows need
    wide = buckets_for(state.count())
    bucket = F.pmod(F.col("near"), F.lit(wide)) * (1 << 32) + F.pmod(F.xxhash64("uid"), F.col("fan"))
    for _ in range(rounds):
        load = dict(state.groupBy("shard").agg(F.sum("size")).collect())  # n_shards rows
        room = {s: quota - load.get(s, 0) for s in range(n_shards)}
        rooms = F.create_map(*[F.lit(x) for s in room for x in (s, max(0, room[s]))])
        now = member.join(state.select("uid", "shard"), "uid")
        mass = now.groupBy("link_id", "salts", "shard").agg(F.sum("size").alias("m")).withColumnRenamed("shard", "to")
        open_ = mass.groupBy("link_id", "salts").agg(F.collect_list(F.struct("to", "m")).alias("around"))  # at most n_shards entries
        open_ = open_.select("link_id", "around", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        votes = now.join(open_, ["link_id", "salt"]).select("uid", F.explode("around").alias("v")).groupBy("uid", F.col("v.to").alias("to")).agg(F.sum("v.m").alias("m"))
        seen = votes.join(state, "uid").where((F.col("to") == F.col("shard")) | (rooms[F.col("to")] >= F.col("size")))
        best = seen.groupBy("uid").agg(
            F.max(F.struct("m", F.pmod(F.xxhash64("near") + F.col("to"), F.lit(n_shards)).alias("favour"), "to")).alias("b"), F.first("shard").alias("shard"), F.first("size").alias("size"), F.first("near").alias("near"), F.first("fan").alias("fan")
        )
        want = stored(best.select("uid", "size", "near", "fan", "shard", F.col("b.to").alias("to"), bucket.alias("bucket"), F.col("b.m").alias("m")), "shard-want")
        moving = running_total(want.where("to <> shard"), ["to"], "bucket", ["near", "uid"], "size", "before")
        let = moving.where(F.col("before") + F.col("size") <= rooms[F.col("to")]).select("uid", F.col("to").alias("new"))
        new = stored(want.join(let, "uid", "left").select("uid", "size", "near", "fan", F.coalesce("new", "shard").alias("shard"), F.col("new").isNotNull().alias("moved")), "shard-state")
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return state.select("uid", "size", "shard", "near")


def shard(nodes: DataFrame, links: DataFrame, n_shards: int = 16, rounds: int = 12) -> DataFrame:
    """All nodes to shards 0..n_shards-1 of near equal size: uid, size, shard.

    Linked nodes are placed by `propagate`. What a shard then holds over an even share goes back to a pool: whole
    groups where they are under WHOLE of an even share, single nodes of the larger ones, small groups before large ones and those before
    nodes of a group that is split. The pool, and the nodes that no edge ties, even the sizes out: what is above SHARE of an even
    share (fewer than n_shards / SHARE things, so they fit in the driver) goes singly to the
    shard that lacks most, the rest by running total along the shards' lacks. So shards end within the largest node or the largest
    whole group of each other, and only groups above WHOLE are split. No nodes: no rows.
    """
    spark = nodes.sparkSession
    placed = stored(propagate(nodes, links, n_shards, rounds), "shard-placed")
    n, total = nodes.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return placed.select("uid", "size", "shard")
    level = total / n_shards
    part = level * SHARE
    units = stored(placed.groupBy("shard", "near").agg(F.sum("size").alias("mass")), "shard-units")
    large = F.broadcast(units.where(F.col("mass") > level * WHOLE).select("shard", "near", F.lit(False).alias("whole")))  # fewer than n_shards / WHOLE
    tied = placed.join(large, ["shard", "near"], "left").withColumn("whole", F.coalesce("whole", F.lit(True)))
    item = F.when(F.col("whole"), F.col("near")).otherwise(F.col("uid")).alias("item")
    singles = tied.where("not whole").select("shard", "whole", item, "size")
    items = stored(units.where(F.col("mass") <= level * WHOLE).select("shard", F.lit(True).alias("whole"), F.col("near").alias("item"), F.col("mass").alias("size")).union(singles), "shard-items")
    bucket = hash_bucket(buckets_for(n), "item")
    keep = F.when(F.col("size") > part, 0).when(~F.col("whole"), 1).otherwise(2).cast("long") * (1 << 32)  # what stays first
    out = running_total(items.withColumn("bucket", keep + bucket), ["shard"], "bucket", ["whole", "item"], "size", "before")
    out = stored(out.where(F.col("before") + F.col("size") > level).select("shard", "whole", "item", "size"), "shard-out")
    free = nodes.select("uid", "size").join(placed.select("uid"), "uid", "left_anti").select(F.lit(-1).alias("shard"), F.lit(False).alias("whole"), F.col("uid").alias("item"), "size")
    pool = stored(out.union(free), "shard-pool")

    load = dict(placed.groupBy("shard").agg(F.sum("size")).collect())  # n_shards rows, and so the next
    gone = dict(out.groupBy("shard").agg(F.sum("size")).collect())
    lack = [level - load.get(s, 0) + gone.get(s, 0) for s in range(n_shards)]
    heavy = pool.where(F.col("size") > part)
    deal = []
    for r in sorted(heavy.collect(), key=lambda r: (-r["size"], r["item"])):
        s = max(range(n_shards), key=lambda k: (lack[k], -k))
        lack[s] -= r["size"]
        deal.append((r["shard"], r["whole"], r["item"], s))
    dealt = spark.createDataFrame(deal, "shard int, whole boolean, item long, new int")
    light = pool.where(F.col("size") <= part).withColumn("bucket", bucket).withColumn("all", F.lit(0))
    spare = light.agg(F.sum("size")).first()[0] or 0
    lack = _fill(lack, spare)
    at, shards = 0.0, F.lit(n_shards - 1)
    ends = []
    for s in range(n_shards):
        at += lack[s]
        ends.append(at)
    middle = F.col("before") + F.col("size") / 2
    for s in reversed(range(n_shards - 1)):
        shards = F.when(middle < F.lit(float(ends[s])), s).otherwise(shards)
    filled = running_total(light, ["all"], "bucket", ["whole", "item", "shard"], "size", "before").select("shard", "whole", "item", shards.cast("int").alias("new"))
    new = stored(dealt.union(filled), "shard-new")
    again = tied.select("uid", "size", "shard", "whole", item).join(new.where("shard >= 0"), ["shard", "whole", "item"], "left")
    first = nodes.select("uid", "size").join(new.where("shard < 0").select(F.col("item").alias("uid"), "new"), "uid")
    return again.select("uid", "size", F.coalesce("new", "shard").cast("int").alias("shard")).union(first.select("uid", "size", F.col("new").alias("shard")))


def _fill(lack: list[float], spare: int) -> list[float]:
    """What each shard takes of `spare`, so that all end at one level as nearly as they can."""
    low, high = min(lack) - spare - 1, max(lack)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(max(0.0, x - mid) for x in lack) > spare else (low, mid)
    return [max(0.0, x - high) for x in lack]


def slots(df: DataFrame, rows: int) -> DataFrame:
    """Add slot: the row's place in its shard, gapless from 0. df: a stored table with uid, shard."""
    df = df.withColumn("bucket", hash_bucket(buckets_for(rows), "uid")).withColumn("one", F.lit(1))
    return running_total(df, ["shard"], "bucket", ["uid"], "one", "slot").drop("bucket", "one")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to 16 shards of near equal bytes, equal texts together where the quota allows.

    A null text counts 1 and is linked with nothing; empty texts are equal texts; repeated rows are rows
    of their own; an empty table gives no rows; other columns are not read.
    """
    text = F.col("text")
    docs = with_uid(
        read(spark, sf_dir, "documents").select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("link_id"),
        ),
        "shard-docs",
    )
    placed = stored(shard(docs, docs.where("link_id is not null").select("uid", "link_id")).drop("size").join(docs.drop("link_id"), "uid"), "shard-all")
    return slots(placed, docs.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
