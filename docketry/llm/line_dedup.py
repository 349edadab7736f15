"""Line dedup by distinct-site spread. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, read, released, stored

SITES = 5  # distinct sites from which on a line is boilerplate
WORDS = 4  # words from which on a line is looked at
LG_K = 12  # size of a sketch: 2**LG_K registers
BROADCAST = 1_000_000  # keys at most that are sent to every task (about 32 MB)
NEAR = 0.25  # estimates this near the threshold are counted exactly; a sketch of 2**12 errs by 0.05 in 3 standard errors

_INNER = r"[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){%d}"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """A line's hash, without white space at its ends; null for lines too short to judge."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.regexp_like(line, F.lit(_INNER % (WORDS - 1))), F.xxhash64(bare))


def _small(keys: DataFrame) -> DataFrame:
    """A stored table of keys, sent to every task while it has at most BROADCAST rows (then a line that a third of all texts
    have moves nothing and skews nothing); beyond that it is joined by a shuffle, whose skew AQE splits."""
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """key, first (doc, uid, at: the smallest standing of it) of the lines on `sites` or more distinct sites. lines: a stored
    table with key, site, doc, uid, at.

    A HyperLogLog sketch of the sites is built for each key and merged by aggregation, so a line that
    everyone has costs no more than another. Keys whose estimate lies near the threshold are counted
    exactly, so the answer is exact.
    """
    sketched = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min(F.struct("doc", "uid", "at")).alias("first"), F.count("*").alias("n"))
    spread = stored(sketched.where((F.col("n") > 1) & (F.col("sites") >= sites * (1 - NEAR))), "line-spread")
    sure, near = F.col("sites") > sites * (1 + NEAR), spread.where(F.col("sites") <= sites * (1 + NEAR))
    exact = lines.join(_small(near.select("key")), "key").select("key", "site").distinct().groupBy("key").count().where(F.col("count") >= sites).select("key")
    return spread.where(sure).select("key", "first").union(near.join(exact, "key").select("key", "first"))


def _cleaned(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """row (the columns of docs), text (without the boilerplate lines), n_lines, n_removed."""
    uid = F.xxhash64("doc_id", "text").alias("uid")
    stand = docs.where("text is not null").select(F.col("doc_id").alias("doc"), uid, F.coalesce("source", F.lit("\x00")).alias("site"), F.posexplode(F.transform(_lines(F.col("text")), _key)).alias("at", "key"))
    lines = stored(stand.where("key is not null"), "line-keys")
    common = stored(boilerplate(lines, sites), "line-common")
    again = ~F.col("first.doc").eqNullSafe(F.col("doc")) | (F.col("first.uid") != F.col("uid")) | (F.col("first.at") != F.col("at"))
    goes = lines.join(_small(common), "key").where(again).groupBy("doc", "uid").agg(F.array_sort(F.collect_set("at")).alias("gone"))  # one text's own places
    rows = carried(docs, F.col("doc_id"), uid.alias("id"))
    met = rows.join(goes, rows["doc_id"].eqNullSafe(goes["doc"]) & (rows["id"] == goes["uid"]), "left")
    # a mark for each line, built from the gaps between the places that go, so that no place is searched for
    gaps = F.transform("gone", lambda at, i: at - F.when(i == 0, 0).otherwise(F.get(F.col("gone"), i - 1) + 1))
    marks = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True)))))
    marked = F.filter(F.arrays_zip(_lines(F.col("row.text")).alias("line"), marks.alias("goes")), lambda x: F.coalesce(~x["goes"], F.lit(True)))
    new = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(marked, lambda x: x["line"]), "\n"))
    total = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(_lines(F.col("row.text"))))
    return met.select("row", new.alias("text"), total.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


def cleaned(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs (doc_id, text, source and any more columns, whatever their names) with the boilerplate lines taken out of text.

    A line counts once for each site (source; a null source is a site). Of a boilerplate line the first stays: where it first stands in the document with the
    smallest (doc_id, hash), so that no content is lost altogether. Lines of under WORDS words stay. A null text
    stays null with no lines; an empty one has one empty line; rows alike in id and text are one document, which stands in each of
    them. Only line hashes move, and the texts once to meet what goes.
    """
    return released(_cleaned(docs, sites), docs, text=F.col("text"))


def deduped_documents(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """`cleaned` with n_chars, where there is one, to match; documents of which nothing but white space is left go."""
    out = _cleaned(docs, sites).where((F.col("n_removed") == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return released(out, docs, **new)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without cross-site boilerplate lines: doc_id, text, n_lines, n_removed."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return _cleaned(docs).select("row.doc_id", "text", "n_lines", "n_removed")


OP10_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]+([\x20\x09-\x0D]+[^\x20\x09-\x0D]+){3}') THEN regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') END AS key FROM l),
b AS (SELECT key, min(doc_id) AS d FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT site) >= 5),
f AS (SELECT k.doc_id, k.key, min(k.i) AS i FROM k JOIN b ON k.key = b.key AND k.doc_id = b.d GROUP BY 1, 2),
m AS (SELECT k.doc_id, k.i, k.line, b.key IS NOT NULL AND f.key IS NULL AS gone FROM k LEFT JOIN b ON k.key = b.key LEFT JOIN f ON f.doc_id = k.doc_id AND f.key = k.key AND f.i = k.i)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""
