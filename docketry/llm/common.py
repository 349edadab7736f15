"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application, and see to it that a batch of texts takes some MB: Arrow's
    default of 10,000 rows a batch is made for short rows. A session that sets its own number keeps it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        to = Path(tempfile.mkdtemp(prefix="docketry-")) / "docketry-lib.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted((root / "docketry").rglob("*.py")):
                z.write(p, p.relative_to(root))
        spark.sparkContext.addPyFile(str(to))
        _SHIPPED.add(app)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one in local mode, which has no
    other executors, and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/docketry-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table of its own in the shared folder and read it back: lineage ends there, and
    every later use sees the same rows whatever executors are lost."""
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one struct column `row` with the columns `more` beside it, so that no name of docs can clash."""
    return docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("row"), *more)


def released(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs out of `row`, those named in `new` with new values of the old types."""
    return df.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col("row").getField(f.name)).alias(f.name) for f in docs.schema.fields])


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.casefold() in {c.casefold() for c in docs.columns}:
        name += "_"
    return name


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_uid(df: DataFrame, name: str, uid: str = "uid") -> DataFrame:
    """df stored with a row number of its own, so that repeated rows stay apart."""
    return stored(df.withColumn(uid, F.monotonically_increasing_id()), name)


def buckets_for(rows: int, per: int = 5_000, least: int = 256, most: int = 1 << 20) -> int:
    """How many hash buckets hold about `per` rows each."""
    return int(min(most, max(least, rows // per)))


def hash_bucket(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same keys that come before this one, in the
    order bucket, then order. A key may hold any share of the rows: sums are taken per (keys, bucket),
    their prefix over the few bucket rows, and only one bucket is sorted at a time. df must give the
    same rows each time it runs (a stored table); keys and bucket must not be null."""
    by = [*keys, bucket]
    sums = df.groupBy(*by).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(base, by)
        .withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("__base")
    )


def totals_before(df: DataFrame, order: list[Column | str], sums: dict[str, str], name: str) -> DataFrame:
    """df with, for each `out: column` of sums, the sum of the column over all rows before this one in `order`: inside ranges of it, and
    added to what the ranges before hold, so no task sorts more than a range."""
    ranged = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    by_part = ranged.groupBy("__part").agg(*[F.sum(c).alias(out) for out, c in sums.items()])  # a row a range
    base = by_part.select("__part", *[F.coalesce(F.sum(out).over(before), zero).alias(f"__{out}") for out in sums])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = {out: F.col(f"__{out}") + F.coalesce(F.sum(c).over(within), zero) for out, c in sums.items()}
    return ranged.join(F.broadcast(base), "__part").withColumns(added).select(*df.columns, *sums)


def components(spark: SparkSession, links: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b: long) by joins: (id, component), component the smallest id
    reachable. Each round joins every vertex to the smallest label around it and then to that label's
    own label (pointer jumping), so chains close in about log rounds. A hub's votes are summed on the
    map side before they move. Fails loudly when `rounds` does not suffice."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = stored(both, f"{name}-edges")
    state = stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), f"{name}-label")
    for _ in range(rounds):
        around = edges.join(state.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("cb"))
        nearer = state.join(around, "a").select("a", F.least("c", "cb").alias("n"), F.col("c").alias("old"))
        jump = state.select(F.col("a").alias("n"), F.col("c").alias("cn"))
        new = stored(nearer.join(jump, "n").select("a", F.least("n", "cn").alias("c"), "old"), f"{name}-label")
        state = new.select("a", "c")
        if new.where("c <> old").isEmpty():
            return state.select(F.col("a").alias("id"), F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
