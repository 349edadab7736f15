"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.operators.batches import numbered_by

from .common import SPACE, buckets_for, carried, hash_bucket, read, released, running_total, stored, totals_before, with_uid

BLOCK, SHARDS, EPOCHS, SEED = 64, 16, 3, 17
BROADCAST = 1_000_000  # sources at most whose few numbers are sent to every task


def n_words(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE, -1), "")).cast("long")


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size: a row a source) with number, weight, target.

    Sources in order of code points, null last, weigh 1, 2, 3, repeating, and share all words; none gets
    more than `epochs` times its own, what is over going to the others by weight. Sorted by cap / weight
    the capped sources come first, so totals over the sources before give the water level without a loop. Sources are
    numbered and summed inside ranges, as there may be as many of them as documents.
    """
    one = F.lit(1).cast("long")
    counted = totals_before(stored(sizes.withColumn("one", one), "mix-sizes"), [F.col("source").asc_nulls_last()], {"earlier": "one"}, "mix-numbered")
    weighed = counted.withColumn("number", (F.col("earlier") + 1).cast("int")).withColumn("weight", F.col("earlier") % 3 + 1).withColumn("cap", epochs * F.col("source_size"))
    rising = weighed.withColumn("rise", F.col("cap") / F.col("weight")).drop("one", "earlier")
    summed = totals_before(rising, ["rise", "number"], {"caps": "cap", "weights": "weight"}, "mix-rising")
    all_ = summed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all_weights"))
    level = (F.col("words") - F.col("caps")) / (F.col("all_weights") - F.col("weights"))
    marked = summed.crossJoin(F.broadcast(all_)).withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))  # one row
    marked = stored(marked.drop("words", "all_weights", "caps", "weights"), "mix-level")
    water = marked.where("not capped").agg(F.min(F.struct("rise", "number", "level")).alias("first")).select(F.col("first.level").alias("water"))
    return marked.crossJoin(F.broadcast(water)).select(
        "source", "number", "weight", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight")).alias("target")
    )


def quotas(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """Blocks of each source in each shard: number, shard, first (its blocks before), blocks.

    After shard j the mix holds floor(total * (j + 1) / (shards * block)) blocks, given out by highest
    quotients target / (2k + 1), ties to the source that comes first. As seats never go back when the
    house grows, a shard's quota is the difference of two houses. Of a house of h seats, x = (h - s/2) / total gives each
    source floor(x * target + 1/2) seats for certain, and (h + s/2) / total more than it can have; only the few seats between are listed
    and ranked, inside ranges of (shard, quotient), as there may be any number of sources.
    """
    paid = sources.where(F.col("target") > 0)
    sums = paid.agg(F.sum("target").alias("total"), F.count("*").alias("s"))
    houses = sums.select("total", "s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).withColumn("h", F.floor(F.col("total") * (F.col("shard") + 1) / (shards * block)))
    each = paid.select("number", "target").join(F.broadcast(houses))  # a row a shard
    low = F.floor(F.greatest(F.lit(0.0), (F.col("h") - F.col("s") / 2) / F.col("total")) * F.col("target") + 0.5)
    high = F.floor((F.col("h") + F.col("s") / 2) / F.col("total") * F.col("target") + 0.5)
    sure = each.withColumn("low", low).withColumn("seat", F.explode_outer(F.when(high >= low, F.sequence(low, high))))
    base = sure.groupBy("shard", "number").agg(F.first("low").alias("low")).groupBy("shard").agg(F.sum("low").alias("base"))
    between = sure.where("seat is not null").withColumn("quotient", (2 * F.col("seat") + 1) / F.col("target"))
    won = numbered_by(between, ["shard"], ["quotient", "number"], "rank").join(F.broadcast(base), "shard").withColumn("won", (F.col("rank") <= F.col("h") - F.col("base")).cast("long"))
    total = won.groupBy("number", "shard").agg((F.first("low") + F.sum("won")).alias("seats"))
    before = F.coalesce(F.lag("seats").over(Window.partitionBy("number").orderBy("shard")), F.lit(0))
    return total.select("number", "shard", before.alias("first"), (F.col("seats") - before).alias("blocks"))


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shards: int = SHARDS, epochs: int = EPOCHS) -> DataFrame:
    """docs (a stored table with source, size, order long and uid) with source_size, target, place, taken.

    A source's documents in order of a seeded hash make its stream of words, read at most `epochs` times
    and cut into blocks; shard j's quota is the next run of blocks (`quotas`). A document at `place`
    gives all its words in each whole pass, and in the last, partial one those before the cut. A source may hold any share of
    the rows: places are running totals over hash buckets.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(sizes, epochs), "mix-sources")
    plan = quotas(sources, block, shards).groupBy("number").agg(F.sum("blocks").alias("blocks"))
    reach = sources.join(plan, "number", "left").withColumn("reach", F.least(F.coalesce("blocks", F.lit(0)) * block, epochs * F.col("source_size")))
    few = sources.count() <= BROADCAST
    known = reach.select(F.col("source").alias("__source"), "number", "source_size", "target", "reach")
    dealt = docs.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    n = buckets_for(docs.count())
    placed = running_total(dealt.withColumn("bucket", hash_bucket(n, "order")), ["number"], "bucket", ["order", "doc_id", "uid"], "size", "place")
    whole = F.floor(F.col("reach") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.col("reach") - whole * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("place"), F.lit(0)), F.col("size"))
    return placed.withColumn("whole", whole.cast("int")).withColumn("part", part.cast("long")).withColumn("taken", (F.col("whole") * F.col("size") + F.col("part")).cast("long")).drop("bucket", "number", "reach")


def order_of(seed: int = SEED) -> Column:
    """The seeded place of a document in its source's stream; rows alike in id and text may change places."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix with the columns of docs: each as often as it is taken whole, and one more
    time cut after its last taken word where the mix ends inside it. n_chars, where there is one, follows the text. Documents of which no word
    is taken go, those without words included. Repeated rows are documents each; columns may have any names."""
    rows = with_uid(carried(docs, F.col("doc_id"), F.col("source"), n_words().alias("size"), order_of(seed).alias("order")), "mix-docs")
    taken = mix(rows.select("uid", "doc_id", "source", "size", "order"), seed).where("taken > 0").select("uid", "whole", "part")
    held = rows.join(taken, "uid")
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")
    last = F.when(F.col("part") == F.col("size"), F.array("row.text")).when(F.col("part") > 0, F.array(cut)).otherwise(F.array().cast("array<string>"))
    copies = held.select("row", F.explode(F.concat(F.array_repeat("row.text", F.col("whole")), last)).alias("copy"))
    return released(copies, docs, text=F.col("copy"), n_chars=F.length("copy"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each of all documents.

    Null texts have size 0 and give 0; a null source is a source; repeated rows count each; an empty
    table gives no rows."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words().alias("size"), order_of().alias("order"))
    return mix(with_uid(docs, "mix-docs")).select("doc_id", "size", "source_size", "target", "taken")
