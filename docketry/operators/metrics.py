"""Evaluation metrics: texts, boxes, labels, triage, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.columns import edits, let


# First and last code point of each script bucket; all else is `other`.
SCRIPTS = [
    (0x0000, 0x007F, "latin-basic"),
    (0x0080, 0x024F, "latin-ext"),
    (0x0250, 0x02FF, "ipa"),
    (0x0300, 0x036F, "combining"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x04FF, "cyrillic"),
    (0x0600, 0x06FF, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x1800, 0x18AF, "mongolian"),
    (0x2000, 0x206F, "general-punct"),
    (0x2070, 0x209F, "super-sub"),
    (0x20A0, 0x20CF, "currency"),
    (0x2100, 0x214F, "letterlike"),
    (0x2150, 0x218F, "numforms"),
    (0x2190, 0x21FF, "arrows"),
    (0x2200, 0x22FF, "math-ops"),
    (0x2300, 0x23FF, "misc-tech"),
    (0x2400, 0x243F, "control-pics"),
    (0x2440, 0x245F, "ocr"),
    (0x2460, 0x24FF, "enclosed-alpha"),
    (0x2500, 0x257F, "box-drawing"),
    (0x2580, 0x259F, "block-elements"),
    (0x25A0, 0x25FF, "geom-shapes"),
    (0x2600, 0x27FF, "misc-symbols"),
    (0x2800, 0x28FF, "braille"),
    (0x2E80, 0x2FFF, "cjk-radicals"),
    (0x3000, 0x303F, "cjk-symbols"),
    (0x3040, 0x309F, "hiragana"),
    (0x30A0, 0x30FF, "katakana"),
    (0x3100, 0x312F, "bopomofo"),
    (0x3190, 0x319F, "kanbun"),
    (0x3200, 0x32FF, "enclosed-cjk"),
    (0x3300, 0x33FF, "cjk-compat"),
    (0x3400, 0x9FFF, "cjk-unified"),
    (0xA000, 0xA4CF, "yi"),
    (0xE000, 0xF8FF, "pua"),
    (0xFB00, 0xFDFF, "arabic-pres"),
    (0xFE00, 0xFEFF, "halfwidth"),
    (0xFFF0, 0xFFFF, "specials"),
    (0xF0000, 0x10FFFF, "pua-supp"),
]
SUSPICIOUS = ["braille", "mongolian", "cjk-radicals", "cjk-symbols", "hiragana", "katakana", "enclosed-cjk", "cjk-compat", "cjk-unified", "pua", "pua-supp", "specials", "yi", "misc-symbols", "control-pics"]
PRIVATE = ["pua", "pua-supp", "specials"]
LATIN = ["latin-basic", "latin-ext"]


def script(cp: Column) -> Column:
    """Script bucket of a code point."""
    out = F.when(cp.isNull(), None)
    for first, last, name in SCRIPTS:
        out = out.when(cp.between(first, last), name)
    return out.otherwise("other")


def in_scripts(names: list[str]) -> str:
    """A pattern for one visible character of the named buckets."""
    return "[" + "".join(rf"\x{{{max(first, 0x21):X}}}-\x{{{last:X}}}" for first, last, name in SCRIPTS if name in names) + "]"


def wild(text: Column, pattern: str) -> Column:
    """Whole-word match with * and ?."""
    body = "".join("[a-z]*" if c == "*" else "." if c == "?" else c for c in pattern)
    return F.regexp_like(text, F.lit(rf"\b{body}\b"))


def recognition(pairs: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Exact rate and 1 - mean normalised edit distance of gt and pred."""
    longest = F.greatest(F.length("gt"), F.length("pred"))
    d = F.when(longest == 0, 0.0).otherwise(edits("gt", "pred") / longest)
    return pairs.agg(F.count("*").alias("n"), F.round(F.count_if(F.col("gt") == F.col("pred")) / (F.count("*") + eps), 6).alias("acc"), F.round(1 - F.sum(d) / (F.count("*") + eps), 6).alias("norm_edit"))


def mteval_tokens(text: str, rules: list[tuple[str, str]]) -> Column:
    """Tokens of a text, padded with blanks, after the rules in order (P25)."""
    out = F.concat(F.lit(" "), F.col(text), F.lit(" "))
    for pattern, new in rules:
        out = F.regexp_replace(out, pattern, new)
    return F.array_remove(F.split(out, r"[\x20\x09-\x0D]+", -1), "")


def token_edits(pairs: DataFrame) -> DataFrame:
    """Token edit distance of each pair (doc_id, n, gt, pred) (A23): the distinct tokens of a pair are numbered, each number becomes one
    character, and the edits are those between the texts of these. The characters leave out surrogates; a pair may have up to 1,000,000 distinct tokens. All is worked out inside the pair's row."""
    none = F.array().cast("array<string>")
    g, p = F.coalesce(F.split("gt", " "), none), F.coalesce(F.split("pred", " "), none)

    def char(no: Column) -> Column:
        point = F.when(no >= 0xD800, no + 0x800).otherwise(no)  # past the surrogates
        return F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")

    def coded(words: Column) -> Column:
        chars = F.transform(words, lambda w, i: char(i + 0x21))
        text = lambda ts, cs: F.array_join(F.transform(ts, lambda t: F.get(cs, (F.array_position(words, t) - 1).cast("int"))), "")
        return let(chars, lambda cs: F.struct(text(F.col("tg"), cs).alias("g"), text(F.col("tp"), cs).alias("p")))

    split = pairs.where("gt is not null or pred is not null").select("doc_id", "n", F.col("gt").eqNullSafe(F.col("pred")).alias("same"), g.alias("tg"), p.alias("tp"))
    both = split.withColumn("c", F.when(~F.col("same"), let(F.array_distinct(F.concat("tg", "tp")), coded)))
    both = both.select("doc_id", "n", F.size("tg").alias("n_gt"), F.size("tp").alias("n_pred"), F.col("c.g").alias("g"), F.col("c.p").alias("p"))
    return both.select("doc_id", "n", "n_gt", "n_pred", F.coalesce(edits("g", "p"), F.lit(0)).alias("edits"))


def _standings(grams: Column) -> Column:
    """Gram hashes with the second and later standings of a gram as hashes of their own: two arrays share as many elements as their gram counts share. Arrays
    whose grams all differ need no sort."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        standing = lambda g, k: F.when(k == 0, g).otherwise(F.xxhash64(g, k))
        return let(starts, lambda at: F.flatten(F.transform(at, lambda a, j: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(at, j + 1), F.size(s)) - a - 1), lambda k: standing(F.get(s, a), k)))))

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), g).otherwise(let(F.sort_array(g), counted)))


def _grams(tokens: Column, most: int) -> Column:
    """Arrays of the standings of a text's n-grams, n from 1 to `most`. A gram's hash is made of that of the gram without its last word and that word's."""

    def longer(h: Column, g: Column, n: int) -> Column:
        rest = F.greatest(F.size(h) - n, F.lit(0))
        more = F.zip_with(F.slice(g, F.lit(1), rest), F.slice(h, F.lit(n + 1), rest), lambda a, b: F.xxhash64(a, b))
        return F.concat(F.array(_standings(g)), let(more, lambda m: longer(h, m, n + 1))) if n < most else F.array(_standings(g))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: longer(h, h, 1))


def bleu(pairs: DataFrame, most: int = 4) -> DataFrame:
    """Corpus BLEU with brevity penalty of pred (a text) against refs (texts) (A25): matches, total (of all lengths up to `most`), r, h, bleu, smooth.

    A gram counts as often as pred has it, up to the most that one reference has it. The reference length is that of each pair's shortest reference. Without
    smoothing a length without matches makes the score 0; with it every precision is (matches + 1) / (total + 1). Everything is worked out inside the pair's row: no gram is moved.
    """
    tokens = lambda t: F.array_remove(F.split(t, " "), "")
    none = F.array().cast("array<bigint>")

    def told(p: Column) -> Column:
        rs = F.transform("refs", tokens)
        sets = lambda mine, theirs: F.transform(mine, lambda g, i: F.size(F.array_intersect(g, F.aggregate(theirs, none, lambda a, r: F.array_union(a, F.get(r, i))))))
        each = lambda ts: let(F.transform(ts, lambda t: _grams(t, most)), lambda theirs: let(_grams(p, most), lambda mine: sets(mine, theirs)))
        return let(rs, lambda ts: F.concat(each(ts), F.array(F.size(p), F.array_min(F.transform(ts, lambda t: F.size(t))))))

    row = pairs.select(let(tokens(F.col("pred")), told).alias("x"))
    ns = range(1, most + 1)
    at = lambda i: F.get(F.col("x"), F.lit(i))
    c = row.agg(*[F.sum(at(n - 1)).alias(f"m{n}") for n in ns], *[F.sum(F.greatest(F.lit(0), at(most) - (n - 1))).alias(f"t{n}") for n in ns], F.sum(at(most + 1)).alias("r"), F.sum(at(most)).alias("h"))
    plain = F.when(F.least(*[F.col(f"m{n}") for n in ns]) > 0, F.exp(sum(F.ln(F.col(f"m{n}") / F.col(f"t{n}")) for n in ns) / most)).otherwise(0.0)
    smooth = F.exp(sum(F.ln((F.col(f"m{n}") + 1) / (F.col(f"t{n}") + 1)) for n in ns) / most)
    penalty = F.when(F.col("h") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return c.select(sum(F.col(f"m{n}") for n in ns).alias("matches"), sum(F.col(f"t{n}") for n in ns).alias("total"), "r", "h", F.round(penalty * plain, 6).alias("bleu"), F.round(penalty * smooth, 6).alias("smooth"))


def confusion_f1(pairs: DataFrame, ignore: list[int] | None = None) -> DataFrame:
    """F1 of each class from counts of (gt, pred), ignored classes out."""
    cell = pairs.groupBy("gt", "pred").agg(F.count("*").alias("n"))
    rows = cell.groupBy(F.col("gt").alias("c")).agg(F.sum("n").alias("row_n"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cell.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("col_n"))
    out = rows.join(cols, "c", "full").fillna(0, ["row_n", "col_n", "tp"])
    if ignore:
        out = out.where(~F.col("c").isin(ignore))
    recall, precision = F.col("tp") / F.greatest("row_n", F.lit(1)), F.col("tp") / F.greatest("col_n", F.lit(1))
    return out.select("c", "tp", F.round(2 * recall * precision / F.greatest(recall + precision, F.lit(1e-8)), 6).alias("f1"))


def spans(tags: DataFrame) -> DataFrame:
    """Entity spans of BIO tags (doc_id, i, tag) (A33): doc_id, kind, first, last. I after another kind starts anew."""
    by = Window.partitionBy("doc_id").orderBy("i")
    kind, head = F.substring("tag", 3, 100), F.substring("tag", 1, 1)
    prev = F.lag("tag").over(by)
    start = (head == "B") | ((head == "I") & (F.coalesce(F.substring(prev, 3, 100), F.lit("")) != kind))
    flagged = tags.withColumns({"kind": kind, "start": start})
    run = flagged.withColumn("s", F.sum(F.col("start").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.where(head != "O").groupBy("doc_id", "s").agg(F.first("kind").alias("kind"), F.min("i").alias("first"), F.max("i").alias("last")).drop("s")


def set_scores(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of two sets of tuples."""
    both = gt.select(*keys).distinct().withColumn("g", F.lit(1)).join(pred.select(*keys).distinct().withColumn("p", F.lit(1)), keys, "full")
    tp, fp, fn = F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()), F.count_if(F.col("g").isNull()), F.count_if(F.col("p").isNull())
    n = both.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return n.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def relation_scores(gt: DataFrame, pred: DataFrame, place: list[str], span: list[str], kinds: list[str]) -> DataFrame:
    """Relation extraction scores (A32): mode, type (null: all), tp, fp, fn, precision, recall, f1, and over all types the means of the types' scores (macro_*).

    gt and pred: place (a document's columns), type, span (of head and tail) and kinds (of their entities). Relations are sets: in mode strict they are equal when span and
    kinds are, in mode boundaries when span is. Both modes are counted at once, over the sets of (mode, type) and (mode).
    """

    def keyed(df: DataFrame, side: str) -> DataFrame:
        modes = F.array(*[F.struct(F.lit(m).alias("mode"), *[(F.col(k) if m == "strict" else F.lit(None)).cast("string").alias(k) for k in kinds]) for m in ("strict", "boundaries")])
        return df.select(*place, "type", *span, F.explode(modes).alias("m")).select("m.mode", *place, "type", *span, *[F.col(f"m.{k}").alias(k) for k in kinds], F.lit(side).alias("side"))

    both = keyed(gt, "g").unionByName(keyed(pred, "p")).groupBy("mode", *place, "type", *span, *kinds).agg(F.bool_or(F.col("side") == "g").alias("g"), F.bool_or(F.col("side") == "p").alias("p"))
    n = both.groupingSets([["mode", "type"], ["mode"]], "mode", "type").agg(F.grouping("type").alias("all"), F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g")).alias("fp"), F.count_if(~F.col("p")).alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    scored = n.withColumns({"p": p, "r": r}).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    means = {f"macro_{name}": F.when(F.col("all") == 1, F.round(F.avg(F.when(F.col("all") == 0, F.col(c))).over(Window.partitionBy("mode")), 6)) for c, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))}  # a row a type
    return scored.withColumns(means).select("mode", "type", "tp", "fp", "fn", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round("f", 6).alias("f1"), *means)


def step_timings(events: DataFrame, key: str, value: str) -> DataFrame:
    """Total, mean and count of each step to four places (A36); a step without a value has a mean of 0."""
    v = F.col(value)
    return events.groupBy(key).agg(F.round(F.coalesce(F.sum(v), F.lit(0.0)), 4).alias("total"), F.round(F.coalesce(F.avg(v), F.lit(0.0)), 4).alias("mean"), F.count(v).alias("n"))


def benchmark(events: DataFrame, key: str, value: str, skip: int = 0, batch: int = 1, salts: int = 64) -> DataFrame:
    """Count, mean, population deviation, least, most and throughput (`batch` over the mean) of each key past the first `skip` by (ts, event_id), and mean and
    throughput of all (A37). The last of the first `skip` is found among the first of `salts` parts of a key, so a key may hold any share of the rows."""
    rows = events.where(F.col(value).isNotNull())
    order = F.struct("ts", "event_id")
    if skip:
        part = F.pmod(F.xxhash64("event_id"), F.lit(salts))
        early = rows.select(key, order.alias("o"), part.alias("part")).withColumn("rn", F.row_number().over(Window.partitionBy(key, "part").orderBy("o"))).where(F.col("rn") <= skip)
        first = early.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("o"))).where(F.col("rn") <= skip)  # skip * salts rows a key
        cuts = first.groupBy(F.col(key).alias("k")).agg(F.max("o").alias("cut"))
        rows = rows.join(cuts, rows[key].eqNullSafe(F.col("k")), "left").withColumn("later", order > F.col("cut")).drop("k", "cut")
    else:
        rows = rows.withColumn("later", F.lit(True))
    v = F.when(F.col("later"), F.col(value))
    out = rows.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(value).alias("ma")).where("n > 0")
    return out.select(key, "n", F.round("m", 4).alias("mean"), F.round("s", 4).alias("std"), "least", "most", F.round(F.try_divide(F.lit(float(batch)), "m"), 3).alias("fps"), F.round("ma", 4).alias("mean_all"), F.round(F.try_divide(F.lit(float(batch)), "ma"), 3).alias("fps_all"))


def close_to(a: DataFrame, b: DataFrame, keys: list[str], value: str, atol: float, rtol: float) -> DataFrame:
    """Rows of a and b that disagree: missing on a side, or apart by more than atol + rtol * |b|."""
    met = a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), keys, "full")
    return met.where(F.col("va").isNull() | F.col("vb").isNull() | (F.abs(F.col("va") - F.col("vb")) > atol + rtol * F.abs("vb")))
