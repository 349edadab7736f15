"""Text corpora: lines, chapters, tokens, chunks, cleaning, retrieval cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.columns import estimate_tokens

# Fixed values.
CHAPTER_WORDS = ["chapter", "capitulo", "capítulo", "ch", "ch."]
MOST_ROMAN, LONGEST_HEADING = 200, 80
PII = [  # placeholder, pattern: our own, readable by RE2 too
    ("<email>", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("<url>", r"https?://[^\s]+"),
    ("<ip>", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("<card>", r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b"),
    ("<phone>", r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}(?:[ -][0-9]{4})?\b"),
]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out, n = out + sign * (n // value), n % value
    return out


def chapter_no(line: str | Column) -> Column:
    """Number of a chapter heading, else null (P19), for lines of at most 80 characters.

    Explicit: a chapter word, one or two digits, and then nothing, a separator, or blanks before a capital, a digit or an opening mark. Roman: a
    numeral that is canonical (looked up in the table of those from 1 to 200), a colon or full stop, blanks, and a capital or an opening mark.
    """
    s = F.trim(F.regexp_replace(line, r"\s", " "))
    opens, digits = "[A-ZÀ-Ú\"“(]", "0-9"
    # explicit: the head is what stands before the first digit, the rest is what follows the number
    head = F.lower(F.trim(F.regexp_substr(s, F.lit("^[^0-9]+"))))
    number = F.regexp_extract(s, "^[^0-9]+([0-9]{1,2})(?![0-9A-Za-z_À-ÖØ-öø-ÿ])", 1)
    rest = F.regexp_extract(s, "^[^0-9]+[0-9]{1,2}(.*)$", 1)
    begins = F.substring(F.ltrim(rest), 1, 1)
    tail = (begins == "") | begins.isin(".", ":", "-", "—", "–") | ((F.substring(rest, 1, 1) == " ") & F.regexp_like(begins, F.lit(opens[:-1] + digits + "]")))
    explicit = F.when(head.isin(CHAPTER_WORDS) & (number != "") & tail, number.cast("int"))
    # roman: the numeral stands before the first separator
    numeral = F.rtrim(F.substring_index(F.translate(s, ".", ":"), ":", 1))
    after = F.substring(F.translate(s, ".", ":"), F.instr(F.translate(s, ".", ":"), ":") + 1, F.length(s))
    table = F.create_map(*[F.lit(x) for n in range(1, MOST_ROMAN + 1) for x in (roman(n), n)])
    title = (F.substring(after, 1, 1) == " ") & F.regexp_like(F.substring(F.ltrim(after), 1, 1), F.lit(opens))
    return F.when(F.length(s) <= LONGEST_HEADING, F.coalesce(explicit, F.when((F.instr(F.translate(s, ".", ":"), ":") > 1) & title, F.try_element_at(table, numeral))))


def head_of(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key, with their place from 1 (T8). Spark keeps only those while it sorts."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def segments(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, n, line) to segments at heading lines (W2): doc_id, seg_no (0: front matter), chapter_no,
    heading, body, tokens."""
    by = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = lines.withColumn("no", chapter_no("line")).withColumn("seg_no", F.count("no").over(by))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    made = cut.groupBy("doc_id", "seg_no").agg(F.max("no").alias("chapter_no"), F.max(F.when(F.col("no").isNotNull(), F.trim("line"))).alias("heading"), body.alias("body"))
    return made.withColumn("tokens", estimate_tokens("body"))


def retrieval_cost(docs: DataFrame, segs: DataFrame, target: int = 2, core: int = 4000, compiled: int = 1000) -> DataFrame:
    """Tokens to answer one question by whole text, by best chapter, with the one before, and compiled (A20,
    T3). The best occurrence of a chapter is the one with most tokens, the first of equals."""
    best = segs.where("chapter_no is not null").groupBy("doc_id", "chapter_no").agg(F.max("tokens").alias("tokens"))
    front = segs.where("seg_no = 0").select("doc_id", F.col("tokens").alias("front"))
    t = best.where(F.col("chapter_no") == target).select("doc_id", F.col("tokens").alias("target"))
    p = best.where(F.col("chapter_no") == target - 1).select("doc_id", F.col("tokens").alias("prior"))
    all_ = docs.join(t, "doc_id").join(front, "doc_id", "left").join(p, "doc_id", "left")
    f, prior, skill = F.coalesce("front", F.lit(0)), F.coalesce("prior", F.lit(0)), core + compiled
    return all_.select("doc_id", F.col("tokens").alias("dump"), (f + F.col("target")).alias("best"), (f + F.col("target") + prior).alias("loop"), F.lit(skill).alias("compiled"), F.round(F.col("tokens") / skill, 1).alias("ratio"))


def document_stats(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Characters, words, tokens, chapters and the first ten headings of each document."""
    heads = lines.withColumn("no", chapter_no("line")).where("no is not null")
    found = heads.groupBy("doc_id").agg(F.count_distinct("no").alias("chapters"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("n", F.trim("line").alias("l")))), 1, 10), lambda x: x["l"]), "|").alias("sample"))
    return docs.join(found, "doc_id", "left").withColumns({"chapters": F.coalesce("chapters", F.lit(0)), "sample": F.coalesce("sample", F.lit(""))})


def repeated_lines(pages: DataFrame, sampled: int = 12) -> DataFrame:
    """Lines that recur over the first pages of a document of three pages or more (W3): 3 to 120 characters,
    at least half of the pages and twice. Occurrences count, not pages."""
    first = pages.where(F.col("page") <= sampled).withColumn("line", F.trim("line"))
    n = first.groupBy("doc_id").agg(F.max("page").alias("pages")).where("pages >= 3")
    counted = first.where(F.length("line").between(3, 120)).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return counted.join(n, "doc_id").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2))).select("doc_id", "line", "n")


def page_specs(specs: DataFrame) -> DataFrame:
    """Page specs (doc_id, spec) such as 1,3,5-7 to pages; a spec with a bad part gives one error row.
    Pages named twice come twice."""
    part = specs.select("doc_id", "spec", F.posexplode(F.split("spec", ",", -1)).alias("i", "p"))
    a, b = F.split_part("p", F.lit("-"), F.lit(1)).try_cast("int"), F.when(F.contains("p", F.lit("-")), F.split_part("p", F.lit("-"), F.lit(2)).try_cast("int")).otherwise(F.split_part("p", F.lit("-"), F.lit(1)).try_cast("int"))
    read = part.withColumns({"a": a, "b": b}).withColumn("ok", F.coalesce(F.regexp_like("p", F.lit(r"^[0-9]+(-[0-9]+)?$")) & (F.col("a") >= 1) & (F.col("a") <= F.col("b")), F.lit(False)))
    good = read.withColumn("all_ok", F.min("ok").over(Window.partitionBy("doc_id", "spec")))
    pages = good.where("all_ok").select("doc_id", F.explode(F.sequence("a", "b")).alias("page"), F.lit(None).cast("string").alias("error"))
    return pages.union(good.where("not all_ok").select("doc_id", F.lit(None).cast("int"), F.lit("bad page spec")).distinct())


def page_ranges(pages: DataFrame) -> DataFrame:
    """Distinct pages to maximal consecutive ranges."""
    one = pages.select("doc_id", "page").distinct()
    island = F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return one.withColumn("g", island).groupBy("doc_id", "g").agg(F.min("page").alias("first"), F.max("page").alias("last")).drop("g")


def chunk_ranges(pages: DataFrame, size: int = 10) -> DataFrame:
    """Fixed-size ranges that cover the wanted pages, each once."""
    last = pages.groupBy("doc_id").agg(F.max("page").alias("total"))
    first = (F.floor((F.col("page") - 1) / size) * size + 1).alias("first")
    return pages.join(last, "doc_id").select("doc_id", first, "total").distinct().select("doc_id", "first", F.least(F.col("first") + size - 1, F.col("total")).alias("last"))


def failed_pages(present: DataFrame, errors: DataFrame, expected: DataFrame) -> DataFrame:
    """Pages named by `Page N:` errors and expected ones that are missing, each once."""
    named = errors.select("doc_id", F.explode(F.regexp_extract_all("message", F.lit(r"Page ([0-9]+):"), F.lit(1))).alias("p")).select("doc_id", F.col("p").cast("long").alias("page"))
    gaps = expected.select("doc_id", F.explode(F.sequence(F.col("first"), F.col("last"))).alias("page")).join(present.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return named.union(gaps).distinct()


def sanitised(docs: DataFrame) -> DataFrame:
    """Personal data to placeholders, with counts by kind."""
    out, counts = F.col("text"), []
    for name, pattern in PII:
        sign = {"<email>": F.contains(out, F.lit("@")), "<url>": F.contains(out, F.lit("://"))}.get(name, F.regexp_like(out, F.lit("[0-9]")))  # what every match holds
        counts.append(F.when(sign, F.regexp_count(out, F.lit(pattern))).otherwise(0).cast("long").alias("n_" + name.strip("<>")))
        out = F.when(sign, F.regexp_replace(out, pattern, name)).otherwise(out)
    return docs.select("doc_id", out.alias("text"), *counts)


def html_text(html: str | Column) -> Column:
    """Page to text: scripts, styles and head out, block ends to line breaks, tags out, entities back."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>", "")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|tr|h[1-6]|ul|ol|table|section|article)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for entity, sign in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n[ \n]*", "\n"), F.lit(" \n"))


def clean_markdown(text: str | Column) -> Column:
    """Hyphenated line ends joined, stray quotes out, blank lines to one."""
    t = F.regexp_replace(text, r"-\n", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?m)^[\"“”]$", ""), r"\n{3,}", "\n\n")


def char_chunks(lines: DataFrame, size: int = 5000) -> DataFrame:
    """Paragraphs to chunks by the characters before them."""
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    return lines.withColumn("chunk", F.floor(at / size)).groupBy("doc_id", "chunk").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def section_chunks(elements: DataFrame) -> DataFrame:
    """Elements to sections that start at headings and carry them."""
    by = Window.partitionBy("doc_id").orderBy("elem_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = elements.withColumn("section", F.count_if(F.col("type") == "heading").over(by))
    head = F.max(F.when(F.col("type") == "heading", F.col("text")))
    return at.groupBy("doc_id", "section").agg(head.alias("heading"), F.count("*").alias("n_elements"), F.min("elem_ord").alias("first"), F.max("elem_ord").alias("last"))


def citation_pages(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """Pages and elements behind each chunk (J18). Chunks of a document never overlap, so each element has one: the
    last chunk that starts at or before it, found in one ordered pass instead of a range join."""
    starts = chunks.select("doc_id", F.col("first").alias("elem_ord"), F.lit(0).alias("o"), F.col("section"), "last")
    both = starts.unionByName(elements.select("doc_id", "elem_ord", F.lit(1).alias("o"), "page"), allowMissingColumns=True)
    by = Window.partitionBy("doc_id").orderBy("elem_ord", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumns({"section": F.last("section", True).over(by), "last": F.last("last", True).over(by)}).where("o = 1 and elem_ord <= last")
    return found.groupBy("doc_id", "section").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n"))


def ordered_join(rows: DataFrame, keys: list[str], order: list[str], text: str, sep: str, out: str = "text") -> DataFrame:
    """Texts of each key in order, joined (P35, S13, S16): a key's rows are one document's."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda x: x["__t"])
    return rows.groupBy(*keys).agg(F.array_join(parts, sep).alias(out))


def citations(lines: DataFrame) -> DataFrame:
    """Items of the reference list (W15): open at a References line, closed at a Chapter heading, a new item at
    [n] or n., other lines go on with it."""
    s = F.trim("line")
    mark = F.when(F.regexp_like(s, F.lit(r"(?i)^(references|bibliography)$")), 1).when(chapter_no("line").isNotNull(), 0)
    by = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = lines.withColumn("mark", mark).withColumn("open", F.last("mark", True).over(by)).where("open = 1 and mark is null").where(s != "")
    start = F.regexp_like(F.trim("line"), F.lit(r"^(\[[0-9]+\]|[0-9]+\.)\s"))
    return state.withColumn("item", F.count_if(start).over(by)).where("item > 0").groupBy("doc_id", "item").agg(F.count("*").alias("n_lines"))


def audit_skill(docs: DataFrame) -> DataFrame:
    """Rule rows for front matter of Markdown documents (P38): doc_id, severity, rule."""
    name, about = F.regexp_extract("text", r"(?m)^name:\s*(.*)$", 1), F.regexp_extract("text", r"(?m)^description:\s*(.*)$", 1)

    def rule(severity: str, name: str) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule"))

    rules = F.array(
        F.when(name == "", rule("ERROR", "name missing")),
        F.when((name != "") & (~F.regexp_like(name, F.lit("^[a-z0-9-]+$")) | (F.length(name) > 64)), rule("ERROR", "bad name")),
        F.when(F.length(about) > 1024, rule("ERROR", "description too long")),
        F.when(F.size(F.split("text", "\n", -1)) > 500, rule("WARN", "over 500 lines")),
    )
    return docs.select("doc_id", F.explode(F.array_compact(rules)).alias("r")).select("doc_id", "r.severity", "r.rule")
