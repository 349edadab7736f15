"""Dataset sampling and batching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import numbered

DIGITS = 4  # of the hash, whose 65,536 beginnings cut a key's rows into even parts


def ratio_sample(rows: DataFrame, key: str, ident: str, ratio: float, seed: str) -> DataFrame:
    """Exactly round-half-even(n * ratio) rows of each key, those of the smallest seeded hash (D1). With epoch in the seed the draw changes.

    Rows are counted by key and beginning of the hash; running sums say in which part the draw ends. Parts before it are taken whole, and only the rows of that part are sorted,
    so a key may hold any share of the rows.
    """
    hashed = F.md5(F.concat(F.lit(seed), F.col(ident).cast("string")).cast("binary"))
    keyed = rows.withColumn("__h", hashed).withColumn("__part", F.substring("__h", 1, DIGITS))
    counts = keyed.groupBy(F.col(key).alias("__k"), F.col("__part").alias("p")).agg(F.count("*").alias("c"))
    by = Window.partitionBy("__k").orderBy("p")  # at most 65,536 rows a key
    upto = F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = counts.withColumns({"upto": upto, "n": F.sum("c").over(Window.partitionBy("__k"))}).withColumn("q", F.bround(F.col("n") * ratio))
    ends = sums.where((F.col("upto") >= F.col("q")) & (F.col("upto") - F.col("c") < F.col("q"))).select("__k", F.col("p").alias("__end"), (F.col("q") - F.col("upto") + F.col("c")).alias("__rest"))
    met = keyed.join(ends, keyed[key].eqNullSafe(F.col("__k")))
    whole = met.where("__part < __end")
    last = met.where("__part = __end").withColumn("__rn", F.row_number().over(Window.partitionBy(key, "__part").orderBy("__h", ident))).where("__rn <= __rest").drop("__rn")
    return whole.unionByName(last).select(*rows.columns)


def bucket_batches(rows: DataFrame, ident: str, ratio: str, sizes: list[tuple[int, int]], replicas: int, base: int, max_w: int) -> DataFrame:
    """Rows to batches of images of alike size (D2): replica, batch, w, h, t (place in the replica), padded, ratio (of the batch), and the columns of rows.

    Rows in order of `ident` go to the replicas in turn; the replicas take n div replicas rows each. A replica's batches take the sizes in turn, over and over, each max(1, base div (w * h)) rows: which batch a
    row is in follows from its place and the running sums of one turn's batch sizes, without any loop. The last turn is completed: batches that the rows do not fill are padded with the replica's
    first rows. A batch's ratio is its rows' mean of `ratio`, at most max_w / h.
    """
    counts = [max(1, base // (w * h)) for w, h in sizes]
    starts = [sum(counts[:k]) for k in range(len(counts))]
    turn = sum(counts)
    placed = numbered(rows, [ident], "__n")
    n = placed.agg(F.max("__n")).first()[0] or 0
    own = n // replicas
    t = F.floor((F.col("__n") - 1) / replicas)
    placed = placed.withColumns({"replica": ((F.col("__n") - 1) % replicas).cast("long"), "t": t}).where(F.col("t") < own).drop("__n")
    within = F.col("t") % turn
    slot = sum(((within >= s).cast("int") for s in starts[1:]), F.lit(0))
    filled = placed.withColumns({"batch": F.floor(F.col("t") / turn) * len(sizes) + slot, "padded": F.lit(False)})
    turns = -(-own // turn)
    missing = {}  # how many rows each batch of the last turn lacks
    for k, (c, s) in enumerate(zip(counts, starts, strict=True)):
        lacks = c - max(0, min((turns - 1) * turn + s + c, own) - ((turns - 1) * turn + s)) if own else 0
        if lacks:
            missing[(turns - 1) * len(sizes) + k] = min(lacks, own)
    again = filled
    if missing:
        pads = F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("b"), F.lit(m).alias("m")) for b, m in missing.items()]))
        more = placed.where(F.col("t") < max(missing.values())).withColumn("__p", pads).where(F.col("t") < F.col("__p.m"))
        again = filled.unionByName(more.withColumns({"batch": F.col("__p.b"), "padded": F.lit(True)}).drop("__p"))
    kind = F.col("batch") % len(sizes)
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in sizes]), (kind + 1).cast("int"))
    sized = again.withColumns({"w": pick(0), "h": pick(1)})
    means = sized.groupBy("replica", "batch").agg(F.avg(ratio).alias("mean"), F.first("h").alias("hh")).select("replica", "batch", F.when(F.col("mean") * F.col("hh") < max_w, F.col("mean")).otherwise(F.lit(float(max_w)) / F.col("hh")).alias("batch_ratio"))
    return sized.join(means, ["replica", "batch"])
