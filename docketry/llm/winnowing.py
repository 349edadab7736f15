"""Benchmark decontamination by winnowing. DataFrame functions only.

A fingerprint is the smallest hash of the GRAM-word runs inside a window of WINDOW words, so each window that a document and an
item share gives both the same fingerprint: no shared span of WINDOW words or more is missed. Documents and items meet on fingerprints;
a hit is then extended to every window that holds it, and windows are compared by their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

WINDOW, GRAM = 10, 4  # words of a window and of a hashed run; the minimum is over WINDOW - GRAM + 1 = 7 runs
BROADCAST, BYTES = 500_000, 64 << 20  # rows (fingerprints, windows, hit documents) and bytes of their texts or lists at most that are sent to every task
SALTS = 16  # parts of a fingerprint beyond that

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text, A-Z lower-cased; none for null. ASCII words are lower-cased as a whole."""
    low = F.transform(F.split(F.coalesce(text, F.lit("")), _BETWEEN, -1), lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER)))
    return F.filter(low, lambda x: x != "")


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once a row, however often f names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _paired(values: Column, by: int, f) -> Column:
    """f over the elements of an array and those `by` places on."""

    def pairs(a: Column) -> Column:
        n = F.greatest(F.size(a) - by, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + by), n), f)

    return _let(values, pairs)


def fingerprints(words: Column) -> Column:
    """The fingerprint of the window from each place on. Runs of 4 words are two of 2, minima over 7 are made of those over 2 and 4."""
    mix, least = (lambda x, y: F.xxhash64(x, y)), (lambda x, y: F.least(x, y))
    runs = _paired(_paired(F.transform(words, lambda x: F.xxhash64(x)), 1, mix), 2, mix)
    return _paired(_paired(_paired(runs, 1, least), 2, least), 3, least)


def _runs(words: Column, n: int) -> Column:
    """The texts of the runs of n words from each place on."""
    return _let(words, lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda _, i: F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))


def _short_print(text: Column) -> Column:
    return F.xxhash64(F.lit("short"), text)


def _places(words: Column, lengths: list[int]) -> Column:
    """Fingerprint, first word, number of words and text of every window, and of every run as long as a short item."""

    def place(fp: Column, i: Column, n: int, t: Column) -> Column:
        return F.struct(fp.alias("fp"), i.cast("long").alias("at"), F.lit(n).cast("long").alias("len"), t.alias("t"))

    def all_of(w: Column) -> Column:
        pairs = F.zip_with(fingerprints(w), _runs(w, WINDOW), lambda fp, t: F.struct(fp.alias("fp"), t.alias("t")))
        full = F.transform(pairs, lambda x, i: place(x["fp"], i, WINDOW, x["t"]))
        of_length = lambda n: lambda t, i: place(_short_print(t), i, n, t)
        return F.concat(full, *[F.transform(_runs(w, n), of_length(n)) for n in lengths])

    return _let(words, all_of)


def windows(items: DataFrame) -> DataFrame:
    """item_id, fp, len, t of the distinct windows of each item: WINDOW words from each place on, or all words of a shorter one."""

    def own(w: Column) -> Column:
        whole = F.array_join(w, " ")
        short = F.array(F.struct(_short_print(whole).alias("fp"), F.lit(0).cast("long").alias("at"), F.size(w).cast("long").alias("len"), whole.alias("t")))
        return F.when(F.size(w) >= WINDOW, _places(w, [])).when(F.size(w) > 0, short)

    each = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(_let(words_of(F.col("text")), own)).alias("w"))
    return each.select("item_id", "w.fp", "w.len", "w.t").distinct()


def _light(df: DataFrame, size: Column | None = None) -> bool:
    """The stored table df is small enough to be sent to every task; size: the bytes of a row beside its few numbers."""
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))).first()
    return n <= BROADCAST and held <= BYTES


def _held(rows: DataFrame, keys: DataFrame, by: list[str], how: str = "inner", size: Column | None = None) -> DataFrame:
    """rows joined with the stored table keys (distinct by): sent to every task while it is light; beyond that a key's rows meet it in SALTS parts."""
    if _light(keys, size):
        return rows.join(F.broadcast(keys), by, how)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    many = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(many, [*by, "__salt"], how).drop("__salt")


def hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three stored tables: one row per document (doc_id, key: the text's hash, n_words), the places of documents that stand in items (doc_id,
    key, at, len, t: the window's text) and the items' windows (item_id, fp, len, t).

    Documents are read whole: their fingerprints, a third of their words, are looked up; only documents with a hit are read
    again, and of these only the windows of a hit's fingerprint are compared. Rows alike in id and text are one document here.
    """
    grams = stored(windows(items), "winnow-windows")
    prints = stored(grams.select("fp").distinct(), "winnow-prints")
    texts = stored(grams.select("fp", "t").distinct(), "winnow-texts")
    lengths = [r[0] for r in grams.where(F.col("len") < WINDOW).select("len").distinct().collect()]  # 9 at most
    key = F.xxhash64("text").alias("key")

    def told(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.array_distinct(F.concat(fingerprints(w), *[F.transform(_runs(w, n), _short_print) for n in lengths])).alias("fps"))

    each = docs.select("doc_id", key, F.monotonically_increasing_id().alias("row"), _let(words_of(F.col("text")), told).alias("w")).select("doc_id", "key", "row", F.col("w.n").alias("n_words"), F.col("w.fps").alias("fps"))
    probed = _held(each.select("doc_id", "key", "row", "n_words", F.explode_outer("fps").alias("fp")), prints.withColumn("met", F.lit(True)), ["fp"], "left")
    base = stored(probed.groupBy("row", "doc_id", "key", "n_words").agg(F.max("met").alias("met")).drop("row"), "winnow-documents")

    suspects = stored(base.where("met").select(F.col("doc_id").alias("id"), F.col("key").alias("k")).distinct(), "winnow-suspects")
    some = F.broadcast(suspects) if suspects.count() <= BROADCAST else suspects
    again = docs.select("doc_id", key, "text").join(some, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left_semi")
    placed = again.select("doc_id", "key", F.explode(_places(words_of(F.col("text")), lengths)).alias("p"))
    found = _held(placed.select("doc_id", "key", "p.*"), texts, ["fp", "t"], size=F.octet_length("t")).select("doc_id", "key", "at", "len", "t")
    return base, stored(found.distinct(), "winnow-hits"), grams


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_words, n_hit (words inside a window of an item), item_ids (sorted strings of the items
    with such windows), contaminated.

    A null or empty text has no words and no hit; an item without words has no window; rows of items under one id are one item, those without id one
    more, whose id is written as an empty string; repeated documents are judged each; without items, or without documents, nothing is hit. Other columns are not read.
    """
    base, found, grams = hits(docs, items)
    by = Window.partitionBy("doc_id", "key").orderBy("at", F.desc("len"))  # one document's windows
    reach = F.coalesce(F.max(F.col("at") + F.col("len")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gain = F.greatest(F.lit(0), F.col("at") + F.col("len") - F.greatest(reach, F.col("at")))
    covered = found.withColumn("gain", gain).groupBy("doc_id", "key").agg(F.sum("gain").alias("n_hit"))
    named = grams.select("t", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    items_of = found.select("doc_id", "key", "t").distinct().join(named, "t").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    told = stored(covered.join(items_of, covered["doc_id"].eqNullSafe(items_of["doc_id"]) & (covered["key"] == items_of["key"])).select(covered["doc_id"].alias("id"), covered["key"].alias("k"), "n_hit", "item_ids"), "winnow-told")
    some = F.broadcast(told) if _light(told, F.aggregate("item_ids", F.lit(0).cast("long"), lambda n, i: n + F.octet_length(i) + 16)) else told
    met = base.join(some, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key").eqNullSafe(F.col("k"))), "left")
    return met.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text and any more columns) without the documents that hold a window of an item."""
    _, found, _ = hits(docs.select("doc_id", "text"), items)
    gone = stored(found.select(F.col("doc_id").alias("__id"), F.col("key").alias("__k")).distinct(), "winnow-gone")
    some = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    return docs.join(some, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__k")), "left_anti")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits and items of all documents."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return contamination(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i))),
h AS MATERIALIZED (SELECT p.doc_id, p.n, p.k, i.item_id FROM p JOIN i ON p.n = i.n AND p.t = i.t),
c AS (SELECT doc_id, count(DISTINCT o) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS o FROM (SELECT DISTINCT doc_id, n, k FROM h)) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""
