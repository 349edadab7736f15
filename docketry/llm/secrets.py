"""Secret scan with multipart credential linking. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, with_uid

# The base patterns, and the weak parts that count only together.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # as AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"  # as [0-9a-f]+ of 32 characters or more
IDENT = r"""(?i:user(?:_?name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
OPAQUE = r"[A-Za-z0-9+/]{40,}={0,2}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""
KINDS = ["assign", "access", "hex", "ident", "opaque", "endpoint"]  # in the order of equal starts
OPAQUE_ORD = KINDS.index("opaque")
SPANS = "array<struct<start:int,ord:int,end:int>>"
SCOPE = 400  # code points between parts of one credential


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative `join`, itself included: pass j joins each value with the one 2**j before
    it, and only arrays longer than that take part. 28 passes are enough for any text, as a match has 8 characters at least and a
    text under 2**31, and n values cost n * log(n) steps."""

    def once(step: int) -> Callable[[Column], Column]:
        return lambda a: F.when(F.size(a) > step, F.transform(a, lambda x, i: F.when(i < step, x).otherwise(join(x, F.get(a, i - step))))).otherwise(a)

    for j in range(28):
        values = F.get(F.transform(F.array(values), once(1 << j)), F.lit(0))
    return values


def spans(text: Column, pattern: str, kind: str, value: int = 0, least: int = 0) -> Column:
    """array<struct<start, ord, end>> of the leftmost non-overlapping matches, code points, end exclusive.
    Matches whose group `value` is shorter than `least` are taken and then dropped.

    split() gives what lies between the matches and regexp_extract_all() the matches; running totals of their lengths
    give the places. Texts without a match cost one search."""
    p, order = F.lit(pattern), KINDS.index(kind)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    whole = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.length(m))
    group = F.transform(F.regexp_extract_all(text, p, F.lit(value)), lambda m: F.length(m)) if value else whole

    def placed(w: Column) -> Column:
        ends = running(F.zip_with(w, F.slice(gaps, F.lit(1), F.size(w)), lambda m, g: m + g), lambda x, y: x + y)
        return F.zip_with(ends, w, lambda b, m: F.struct((b - m).alias("start"), F.lit(order).alias("ord"), b.alias("end")))

    found = F.get(F.transform(F.array(whole), placed), F.lit(0))
    if least:
        long = F.filter(F.zip_with(found, group, lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: x["v"] >= least)
        found = F.transform(long, lambda x: x["s"])
    return F.when(F.regexp_like(text, p), found).otherwise(F.lit(None).cast(SPANS))


def _clear(opaque: Column, other: Column) -> Column:
    """The opaque spans that overlap none of the others. Sorted by start, a span is clear when the others up to it have ended and the next
    has not begun before it ends."""

    def test(all_: Column) -> Column:
        until = running(F.transform(all_, lambda x: F.when(x["ord"] == OPAQUE_ORD, -1).otherwise(x["end"])), lambda x, y: F.greatest(x, y))
        ahead = F.reverse(F.transform(all_, lambda x: F.when(x["ord"] == OPAQUE_ORD, (1 << 31) - 1).otherwise(x["start"])))
        held = F.zip_with(until, F.reverse(running(ahead, lambda x, y: F.least(x, y))), lambda u, n: F.struct(u.alias("until"), n.alias("next")))
        fine = F.filter(F.zip_with(all_, held, lambda s, h: F.struct(s.alias("s"), h.alias("h"))), lambda x: (x["s"]["ord"] == OPAQUE_ORD) & (x["h"]["until"] <= x["s"]["start"]) & (x["h"]["next"] >= x["s"]["end"]))
        return F.transform(fine, lambda x: x["s"])

    return F.when(F.size(opaque) > 0, F.get(F.transform(F.array(F.sort_array(F.concat(opaque, other))), test), F.lit(0))).otherwise(opaque)


def parts(docs: DataFrame) -> DataFrame:
    """One pass over the texts (doc_id, text): doc_id with `base` and `weak` span arrays. Opaque strings that
    overlap a base span or an endpoint are no parts of their own. A text of n matches costs n * log(n) steps."""
    t = F.coalesce("text", F.lit(""))
    none = F.array().cast(SPANS)
    kinds = [("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 0), ("hex", HEX, 0, 0), ("ident", IDENT, 0, 0), ("opaque", OPAQUE, 0, 0), ("endpoint", ENDPOINT, 0, 0)]
    found = docs.select("doc_id", *[F.coalesce(spans(t, pattern, kind, value, least), none).alias(kind) for kind, pattern, value, least in kinds])
    clear = _clear(F.col("opaque"), F.concat("assign", "access", "hex", "endpoint"))
    return found.select(
        "doc_id",
        F.sort_array(F.concat("assign", "access", "hex")).alias("base"),
        F.when(F.size("opaque") + F.size("ident") + F.size("endpoint") > 0, F.sort_array(F.concat("ident", clear, "endpoint"))).otherwise(none).alias("weak"),
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complementary part at most `scope` code points away: uid, added (their spans).

    An identifier or endpoint needs a secret (assign, hex or opaque), an opaque string an identifier or an
    endpoint. The interval join runs over cells of `scope` code points: parts are reduced to the first
    start and last end for each (text, cell, role) before they move, and a weak part looks into the cells
    that its widened interval touches. There, last end >= start - scope and first start <= end + scope hold exactly when
    some part of the cell is near enough, as cells are no wider than the widening on either side. So no
    pairs are listed however many parts a text has.
    """
    some = found.where(F.size("weak") > 0)

    def cells(a: Column, b: Column) -> Column:
        return F.sequence(F.floor(F.greatest(a, F.lit(0)) / scope), F.floor(b / scope))

    role = F.when(F.col("s.ord").isin(KINDS.index("assign"), KINDS.index("hex"), KINDS.index("opaque")), "secret").otherwise("other")
    every = some.select("uid", F.explode(F.concat("base", "weak")).alias("s")).select("uid", role.alias("role"), "s.start", "s.end", F.explode(cells(F.col("s.start"), F.col("s.end") - 1)).alias("cell"))
    held = every.groupBy("uid", "cell", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    ask = some.select("uid", F.explode("weak").alias("s"))
    ask = ask.select("uid", "s", F.when(role == "secret", "other").otherwise("secret").alias("role"), F.explode(cells(F.col("s.start") - scope, F.col("s.end") + scope)).alias("cell"))
    met = ask.join(held, ["uid", "cell", "role"]).where((F.col("last") >= F.col("s.start") - scope) & (F.col("first") <= F.col("s.end") + scope))
    return met.groupBy("uid").agg(F.collect_set("s").alias("added"))  # at most the text's own weak parts


def _text(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """All findings of every whole text: doc_id, base, added (arrays of struct<start, ord, end>; ord is
    the place in KINDS). Null text: no findings; repeated rows: each."""
    found = with_uid(parts(docs.select("doc_id", "text")), "secret-parts")
    none = F.array().cast(SPANS)
    return found.join(linked(found), "uid", "left").select("doc_id", "base", F.array_sort(F.coalesce("added", none)).alias("added"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, base counts and digests beside all spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["ord"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return scan(read(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("long").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
