"""Row batches with overlap, and merging what batches gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.columns import blank

from .boxes import cut


def batched(rows: DataFrame, keys: list[str], order: list[str], size: int = 50, overlap: int = 5) -> DataFrame:
    """Rows to batches of `size` with `overlap` more on each side (W1): a row goes to at most two batches. Batches are
    numbered, so they sort past 999 (A13)."""
    by = Window.partitionBy(*keys)
    n = rows.withColumn("rn", F.row_number().over(by.orderBy(*order))).withColumn("n", F.count("*").over(by))
    last = F.floor((F.col("n") - 1) / size)
    low = F.greatest(F.lit(0), F.floor((F.col("rn") - 1 - overlap) / size))
    high = F.least(last, F.floor((F.col("rn") - 1 + overlap) / size))
    return n.withColumn("batch", F.explode(F.sequence(low + 1, high + 1))).drop("n")


def fullest(rows: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """The row of each key with most filled fields, the first of equals."""
    filled = sum(((~blank(c)).cast("int") for c in fields), F.lit(0))
    row = F.struct(*rows.columns, filled.alias("filled"))
    best = rows.groupBy(*keys).agg(F.min_by(row, F.struct(-filled, F.col(order))).alias("r"), F.count("*").alias("n_seen"))
    return best.select("r.*", "n_seen")


def merged(rows: DataFrame, keys: list[str], fields: list[str], place: str, order: str) -> DataFrame:
    """One row a key: the first filled value of each field, and how many places it came from."""
    first = [F.min_by(F.when(~blank(c), F.col(c)), F.when(~blank(c), F.col(order))).alias(c) for c in fields]
    return rows.groupBy(*keys).agg(*first, F.count_distinct(place).alias("files"))


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with its row number in `order`, counted inside ranges of it and added to the rows of the ranges before."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(base), "__part").withColumn(out, (F.col("__base") + within).cast("int")).drop("__part", "__base")


def _ranged(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """df cut into ranges of (keys, order), stored with the number of its range: a key of any size stands in as many ranges as it fills."""
    return cut(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), name)


def _with_base(ranged: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """ranged with what each key brings along from the ranges before. Only the first key of a range can have begun before it, so base has at most a row a range."""
    named = base.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__{k}") for k in keys], "__base")
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return ranged.join(F.broadcast(named), same, "left").drop("__p", *[f"__{k}" for k in keys])


def numbered_by(df: DataFrame, keys: list[str], order: list[Column | str], out: str) -> DataFrame:
    """df with its row number in `order` among the rows of its keys, counted inside ranges, so that a key may hold any share of the rows."""
    ranged = _ranged(df, keys, order, "numbered")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("__part", *keys).agg(F.count("*").alias("n")).withColumn("__base", F.sum("n").over(before)).where("__base > 0")
    within = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order))
    return _with_base(ranged, base, keys).withColumn(out, (F.coalesce("__base", F.lit(0)) + within).cast("int")).drop("__part", "__base")


def carried_last(df: DataFrame, keys: list[str], order: list[Column | str], value: str, out: str) -> DataFrame:
    """df with the last value that isn't null up to each row of its keys, in `order`, carried on inside ranges and from the ranges before."""
    ranged = _ranged(df, keys, order, "carried")
    ends = ranged.where(F.col(value).isNotNull()).groupBy("__part", *keys).agg(F.max_by(value, F.struct(*order)).alias("end"))
    parts = ranged.select("__part", *keys).distinct()
    same = [parts[k].eqNullSafe(ends[k]) for k in keys]
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    on = parts["__part"] == ends["__part"]
    for x in same:
        on = on & x
    base = parts.join(ends, on, "left").select(parts["__part"], *[parts[k] for k in keys], "end").withColumn("__base", F.last("end", True).over(before)).where("__base is not null").drop("end")
    within = F.last(value, True).over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _with_base(ranged, base, keys).withColumn(out, F.coalesce(within, "__base")).drop("__part", "__base")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its input has fewer parts than there are cores, for work that is dear by the row; otherwise as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
