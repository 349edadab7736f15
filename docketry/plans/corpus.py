"""Queries over text corpora."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions import columns as C
from docketry.operators.batches import numbered
from docketry.operators import corpus as O
from docketry.operators import casework as CW
from docketry.operators import metrics as M
from docketry.registry import register

from .fixtures import duck, table, view

TOK = "CAST(floor(len(list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) / 0.75) AS BIGINT)"
WORDS = "len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))"
NO = "CASE WHEN length(trim(line)) <= 80 AND regexp_matches(trim(line), '(?i)^chapter\\s*[0-9]{1,2}(\\s*$|\\s*[.:—–-]|\\s+[A-ZÀ-Ú0-9\"“(])') THEN CAST(regexp_extract(trim(line), '(?i)^chapter\\s*([0-9]{1,2})', 1) AS INTEGER) END"
SEG = f"c AS (SELECT doc_id, n, line, {NO} AS no FROM planted), g AS (SELECT *, count(no) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS seg_no FROM c), seg AS (SELECT doc_id, seg_no, max(no) AS chapter_no, max(CASE WHEN no IS NOT NULL THEN trim(line) END) AS heading, string_agg(line, chr(10) ORDER BY n) AS body FROM g GROUP BY 1, 2), sg AS (SELECT *, {TOK.format('body')} AS tokens FROM seg)"


def docs(spark, sf):
    return table(spark, sf, "documents").where("text is not null")


@register("p17_tokens", f"SELECT doc_id, {TOK.format('text')} AS tokens FROM documents WHERE text IS NOT NULL")
def p17(spark, sf):
    return docs(spark, sf).select("doc_id", C.estimate_tokens("text").alias("tokens"))


@register("p18_char_tokens", "SELECT doc_id, CAST(floor(length(text) / 4 + 0.5) AS BIGINT) + 258 AS by_chars, 850 * (1 + length(text) // 3000) AS by_pages FROM documents WHERE text IS NOT NULL")
def p18(spark, sf):
    return docs(spark, sf).select("doc_id", (F.floor(F.length("text") / 4 + 0.5) + 258).alias("by_chars"), (850 * (1 + F.floor(F.length("text") / 3000))).alias("by_pages"))


@register("p19_chapter_numbers", duck("planted", f"SELECT doc_id, n, {NO} AS no FROM planted WHERE {NO} IS NOT NULL"))
def p19(spark, sf):
    return view(spark, sf, "planted").select("doc_id", "n", O.chapter_no("line").alias("no")).where("no is not null")


@register("p20_toc_flag", duck("planted", "SELECT doc_id, regexp_matches(substring(string_agg(line, chr(10) ORDER BY n), 1, 30000), '(?im)^(table of contents|contents)$') AS has_toc FROM planted GROUP BY 1"))
def p20(spark, sf):
    text = O.ordered_join(view(spark, sf, "planted"), ["doc_id"], ["n"], "line", "\n")
    return text.select("doc_id", F.regexp_like(F.substring("text", 1, 30000), F.lit(r"(?im)^(table of contents|contents)$")).alias("has_toc"))


@register("w2_segments", duck("planted", f"WITH {SEG} SELECT doc_id, seg_no, chapter_no, heading, tokens, length(body) AS n_chars FROM sg"))
def w2(spark, sf):
    return O.segments(view(spark, sf, "planted")).select("doc_id", "seg_no", "chapter_no", "heading", "tokens", F.length("body").cast("long").alias("n_chars"))


@register("t3_best_chapters", duck("planted", f"WITH {SEG} SELECT doc_id, chapter_no, max(tokens) AS tokens, arg_min(seg_no, -tokens * 100000 + seg_no) AS seg_no FROM sg WHERE chapter_no IS NOT NULL GROUP BY 1, 2"))
def t3(spark, sf):
    s = O.segments(view(spark, sf, "planted")).where("chapter_no is not null")
    return s.groupBy("doc_id", "chapter_no").agg(F.max("tokens").alias("tokens"), F.max_by("seg_no", F.struct("tokens", -F.col("seg_no"))).alias("seg_no"))


@register("a20_retrieval_cost", duck("planted", f"WITH {SEG}, b AS (SELECT doc_id, chapter_no, max(tokens) AS t FROM sg WHERE chapter_no IS NOT NULL GROUP BY 1, 2) SELECT d.doc_id, dump, f + t.t AS best, f + t.t + coalesce(p.t, 0) AS loop, 5000 AS compiled, round(dump / 5000, 1) AS ratio FROM (SELECT doc_id, {TOK.format('text')} AS dump FROM documents WHERE text IS NOT NULL) d JOIN b t ON t.doc_id = d.doc_id AND t.chapter_no = 2 LEFT JOIN b p ON p.doc_id = d.doc_id AND p.chapter_no = 1 LEFT JOIN (SELECT doc_id, tokens AS f FROM sg WHERE seg_no = 0) z ON z.doc_id = d.doc_id".replace("f + t.t", "coalesce(f, 0) + t.t")))
def a20(spark, sf):
    d = docs(spark, sf).select("doc_id", C.estimate_tokens("text").alias("tokens"))
    return O.retrieval_cost(d, O.segments(view(spark, sf, "planted")))


@register("a18_document_stats", duck("planted", f"SELECT d.doc_id, length(text) AS chars, {WORDS} AS words, coalesce(chapters, 0) AS chapters, coalesce(sample, '') AS sample FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT no) AS chapters, array_to_string((list(trim(line) ORDER BY n))[1:10], '|') AS sample FROM (SELECT *, {NO} AS no FROM planted) q WHERE no IS NOT NULL GROUP BY 1) h USING (doc_id) WHERE text IS NOT NULL"))
def a18(spark, sf):
    d = docs(spark, sf).select("doc_id", F.length("text").cast("long").alias("chars"), F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")).cast("long").alias("words"))
    return O.document_stats(d, view(spark, sf, "planted"))


@register("a19_corpus_totals", f"SELECT coalesce(source, 'all') AS source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({WORDS}) AS BIGINT) AS words FROM documents WHERE text IS NOT NULL GROUP BY ROLLUP (source)")
def a19(spark, sf):
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), ""))
    return docs(spark, sf).select("source", F.length("text").alias("c"), words.alias("w")).rollup("source").agg(F.count("*").alias("n"), F.sum("c").alias("chars"), F.sum("w").alias("words")).withColumn("source", F.coalesce("source", F.lit("all")))


@register("w3_repeated_lines", duck("page_text", "WITH f AS (SELECT doc_id, page, trim(line) AS line FROM page_text WHERE page <= 12), p AS (SELECT doc_id, max(page) AS pages FROM f GROUP BY 1 HAVING max(page) >= 3) SELECT doc_id, line, count(*) AS n FROM f JOIN p USING (doc_id) WHERE length(line) BETWEEN 3 AND 120 GROUP BY doc_id, line, pages HAVING count(*) >= greatest(2, pages // 2)"))
def w3(spark, sf):
    return O.repeated_lines(view(spark, sf, "page_text"))


@register("f11_header_footer_lines", duck("page_text", "WITH f AS (SELECT doc_id, page, line_no, trim(line) AS line FROM page_text), p AS (SELECT doc_id, max(page) AS pages FROM f WHERE page <= 12 GROUP BY 1 HAVING max(page) >= 3), r AS (SELECT doc_id, line FROM f JOIN p USING (doc_id) WHERE page <= 12 AND length(line) BETWEEN 3 AND 120 GROUP BY doc_id, line, pages HAVING count(*) >= greatest(2, pages // 2)) SELECT f.doc_id, f.page, count(*) AS kept FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = f.doc_id AND r.line = f.line) AND NOT ((line_no < 4 OR line_no >= 36) AND regexp_matches(line, '^[0-9]+$')) GROUP BY 1, 2"))
def f11(spark, sf):
    pages = view(spark, sf, "page_text").withColumn("line", F.trim("line"))
    kept = pages.join(O.repeated_lines(pages), ["doc_id", "line"], "left_anti")
    edge = (F.col("line_no") < 4) | (F.col("line_no") >= 36)
    return kept.where(~(edge & F.regexp_like("line", F.lit("^[0-9]+$")))).groupBy("doc_id", "page").agg(F.count("*").alias("kept"))


SPEC = "CASE doc_id % 4 WHEN 0 THEN '1,3,5-7' WHEN 1 THEN '2-1' WHEN 2 THEN '1,,2' ELSE '2,2-4' END"


@register("f5_page_selection", "SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN [1, 3, 5, 6, 7] WHEN 3 THEN [2, 2, 3, 4] ELSE [NULL] END) AS page, CASE WHEN doc_id % 4 IN (1, 2) THEN 'bad page spec' END AS error FROM documents")
def f5(spark, sf):
    return O.page_specs(table(spark, sf, "documents").select("doc_id", F.expr(SPEC).alias("spec")))


@register("f6_page_ranges", duck("page_text", "SELECT doc_id, min(page) AS first, max(page) AS last FROM (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM (SELECT DISTINCT doc_id, page FROM page_text WHERE page % 3 <> 0) a) b GROUP BY doc_id, g"))
def f6(spark, sf):
    return O.page_ranges(view(spark, sf, "page_text").where("page % 3 <> 0"))


@register("f7_chunk_ranges", duck("page_text", "SELECT DISTINCT doc_id, (page - 1) // 2 * 2 + 1 AS first, least((page - 1) // 2 * 2 + 2, total) AS last FROM page_text JOIN (SELECT doc_id, max(page) AS total FROM page_text GROUP BY 1) t USING (doc_id)"))
def f7(spark, sf):
    return O.chunk_ranges(view(spark, sf, "page_text"), 2)


@register("a35_u3_u4_failed_pages", duck("page_text", "WITH e AS (SELECT doc_id, max(page) + 1 AS last FROM page_text GROUP BY 1) SELECT DISTINCT doc_id, page FROM (SELECT doc_id, CAST(2 AS BIGINT) AS page FROM e WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, unnest(range(1, last + 1)) AS page FROM e) q WHERE (doc_id % 5 = 0 AND page = 2) OR NOT EXISTS (SELECT 1 FROM page_text p WHERE p.doc_id = q.doc_id AND p.page = q.page AND p.page % 4 <> 0)"))
def a35(spark, sf):
    pages = view(spark, sf, "page_text")
    expected = pages.groupBy("doc_id").agg(F.lit(1).cast("long").alias("first"), (F.max("page") + 1).alias("last"))
    errors = expected.where("doc_id % 5 = 0").select("doc_id", F.lit("Page 2: broken").alias("message"))
    return O.failed_pages(pages.where("page % 4 <> 0"), errors, expected)


_PII = [(n, p.replace("\\", "\\")) for n, p in O.PII]


def _sanitise_sql() -> str:
    t, cols = "text", []
    for name, p in _PII:
        q = p.replace("'", "''")
        cols.append(f"CAST(len(regexp_extract_all({t}, '{q}')) AS BIGINT) AS n_{name.strip('<>')}")
        t = f"regexp_replace({t}, '{q}', '{name}', 'g')"
    return f"SELECT doc_id, md5({t}) AS digest, {', '.join(cols)} FROM documents WHERE text IS NOT NULL"


@register("f15_sanitise", _sanitise_sql())
def f15(spark, sf):
    return O.sanitised(docs(spark, sf)).withColumn("digest", F.md5("text")).drop("text")


@register("p13_safe_filename", "SELECT page_id, ltrim(regexp_replace(regexp_replace(regexp_replace(url, '[\\\\/:*?\"<>|]+', '_', 'g'), '\\s+', ' ', 'g'), '_+', '_', 'g'), '.') AS name FROM pages")
def p13(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.safe_filename("url").alias("name"))


@register("p15_p16_invalid_chars", "SELECT doc_id, length(replace(replace(text, chr(1), '?'), '�', '?')) AS n, md5(replace(text, chr(1), '?')) AS digest FROM documents WHERE text IS NOT NULL")
def p15(spark, sf):
    return docs(spark, sf).select("doc_id", F.length(F.translate("text", "\x01�", "??")).cast("long").alias("n"), F.md5(F.translate("text", "\x01", "?")).alias("digest"))


@register("p23_half_width", "SELECT doc_id, replace(text, chr(12288), ' ') AS t FROM documents WHERE text IS NOT NULL")
def p23(spark, sf):
    """Widens each text and narrows it again."""
    ascii_, wide = "".join(chr(0x21 + i) for i in range(94)), "".join(chr(0xFF01 + i) for i in range(94))
    return docs(spark, sf).select("doc_id", C.half_width(F.translate("text", ascii_ + " ", wide + "　")).alias("t"))


@register("p32_clean_markdown", "SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, '-' || chr(10), ''), '(?m)^[\"“”]$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def p32(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(O.clean_markdown("text")).alias("digest"))


@register("p33_markdown_escape", "SELECT doc_id, md5(replace(replace(replace(replace(text, '*', '\\*'), '`', '\\`'), '~', '\\~'), '$', '\\$')) AS digest FROM documents WHERE text IS NOT NULL")
def p33(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(C.markdown_escape(F.col("text"))).alias("digest"))


def _html_sql() -> str:
    t = "regexp_replace(html, '<(script|style|head)[^>]*>.*?</(script|style|head)>', '', 'gis')"
    t = f"regexp_replace({t}, '</?(p|div|br|li|tr|h[1-6]|ul|ol|table|section|article)[^>]*>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'gs')"
    for e, s in O.ENTITIES:
        s = s.replace("'", "''")
        t = f"replace({t}, '{e}', '{s}')"
    t = f"trim(regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
    return f"SELECT page_id, md5({t}) AS digest, length({t}) AS n FROM pages WHERE html IS NOT NULL"


@register("p34_html_text", _html_sql())
def p34(spark, sf):
    t = O.html_text("html")
    return table(spark, sf, "pages").where("html is not null").select("page_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@register("p35_section_text", duck("page_text", "SELECT doc_id, md5(string_agg(concat('[text page=', page, ']', chr(10), t), chr(10) || chr(10) ORDER BY page)) AS digest FROM (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS t FROM page_text GROUP BY 1, 2) q WHERE trim(t) <> '' GROUP BY 1"))
def p35(spark, sf):
    pages = O.ordered_join(view(spark, sf, "page_text"), ["doc_id", "page"], ["line_no"], "line", "\n").where(F.trim("text") != "")
    labelled = pages.withColumn("text", F.concat(F.lit("[text page="), F.col("page"), F.lit("]\n"), F.col("text")))
    return O.ordered_join(labelled, ["doc_id"], ["page"], "text", "\n\n").select("doc_id", F.md5("text").alias("digest"))


@register("p38_skill_audit", "WITH d AS (SELECT doc_id, concat('name: ', CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN concat('skill-', doc_id) ELSE 'Bad Name' END) AS h, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, 'ERROR' AS severity, 'name missing' AS rule FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'ERROR', 'bad name' FROM d WHERE doc_id % 3 = 2 UNION ALL SELECT doc_id, 'WARN', 'over 500 lines' FROM d WHERE len(string_split(text, chr(10))) + 2 > 500")
def p38(spark, sf):
    name = F.when(F.col("doc_id") % 3 == 0, F.lit("name:\n")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("name: skill-"), "doc_id", F.lit("\n"))).otherwise("name: Bad Name\n")
    return O.audit_skill(docs(spark, sf).select("doc_id", F.concat(F.replace(name, F.lit("name:\n"), F.lit("title: x\n")), F.lit("\n"), "text").alias("text")))


@register("w15_citations", duck("doc_lines", "WITH l AS (SELECT doc_id, n * 3 AS n, line FROM doc_lines UNION ALL SELECT doc_id, n * 3 + 1, CASE WHEN n % 30 = 3 THEN 'References' WHEN n % 30 = 17 THEN 'Chapter 3: Next' ELSE concat('[', n, '] item') END FROM doc_lines WHERE n % 30 = 3 OR n % 30 = 17 OR n % 4 = 1), m AS (SELECT *, CASE WHEN regexp_matches(trim(line), '(?i)^(references|bibliography)$') THEN 1 WHEN line = 'Chapter 3: Next' THEN 0 END AS mark FROM l), o AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS open FROM m), i AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(trim(line), '^(\\[[0-9]+\\]|[0-9]+\\.)\\s')) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS item FROM o WHERE open = 1 AND mark IS NULL AND trim(line) <> '') SELECT doc_id, item, count(*) AS n_lines FROM i WHERE item > 0 GROUP BY 1, 2"))
def w15(spark, sf):
    lines = view(spark, sf, "doc_lines")
    k = F.col("n") % 30
    more = lines.where((k == 3) | (k == 17) | (F.col("n") % 4 == 1)).select("doc_id", (F.col("n") * 3 + 1).alias("n"), F.when(k == 3, "References").when(k == 17, "Chapter 3: Next").otherwise(F.concat(F.lit("["), "n", F.lit("] item"))).alias("line"))
    return O.citations(lines.select("doc_id", (F.col("n") * 3).alias("n"), "line").union(more))


@register("w23_char_chunks", duck("doc_lines", "SELECT doc_id, CAST(so_far // 5000 AS BIGINT) AS chunk, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM doc_lines) q GROUP BY 1, 2"))
def w23(spark, sf):
    return O.char_chunks(view(spark, sf, "doc_lines"))


_SECTION = "s AS (SELECT *, count(*) FILTER (WHERE type = 'heading') OVER (PARTITION BY doc_id ORDER BY elem_ord ROWS UNBOUNDED PRECEDING) AS section FROM elements)"


@register("w24_section_chunks", duck("elements", f"WITH {_SECTION} SELECT doc_id, section, max(CASE WHEN type = 'heading' THEN text END) AS heading, count(*) AS n_elements, min(elem_ord) AS first, max(elem_ord) AS last FROM s GROUP BY 1, 2"))
def w24(spark, sf):
    return O.section_chunks(view(spark, sf, "elements"))


@register("j18_citation_pages", duck("elements", f"WITH {_SECTION} SELECT doc_id, section, min(page) AS first_page, max(page) AS last_page, count(*) AS n FROM s GROUP BY 1, 2"))
def j18(spark, sf):
    e = view(spark, sf, "elements")
    return O.citation_pages(O.section_chunks(e), e)


@register("f17_header_switch", duck("elements", "SELECT doc_id, count(*) AS n FROM elements WHERE type <> 'heading' GROUP BY 1"))
def f17(spark, sf):
    return view(spark, sf, "elements").where("type <> 'heading'").groupBy("doc_id").agg(F.count("*").alias("n"))


@register("p39_region_markdown", duck("elements", "SELECT doc_id, page, md5(string_agg(CASE type WHEN 'heading' THEN concat(repeat('#', level), ' ', text) WHEN 'table cell' THEN concat('| ', text, ' |') ELSE text END, chr(10) ORDER BY elem_ord)) AS digest FROM elements GROUP BY 1, 2"))
def p39(spark, sf):
    e = view(spark, sf, "elements")
    md = F.when(F.col("type") == "heading", F.concat(F.expr("repeat('#', CAST(level AS INT))"), F.lit(" "), "text")).when(F.col("type") == "table cell", F.concat(F.lit("| "), "text", F.lit(" |"))).otherwise(F.col("text"))
    return O.ordered_join(e.withColumn("md", md), ["doc_id", "page"], ["elem_ord"], "md", "\n").select("doc_id", "page", F.md5("text").alias("digest"))


_CASE = "CASE " + " ".join(f"WHEN c BETWEEN {a} AND {b} THEN '{name}'" for a, b, name in M.SCRIPTS) + " ELSE 'other' END"


@register("p21_script_buckets", f"SELECT bucket, count(*) AS n FROM (SELECT {_CASE} AS bucket FROM (SELECT unicode(unnest(string_split(text, ''))) AS c FROM documents WHERE text IS NOT NULL) a) b GROUP BY 1")
def p21(spark, sf):
    chars = docs(spark, sf).select(F.explode(F.split("text", "", -1)).alias("c")).where("c <> ''")
    return chars.groupBy("c").agg(F.count("*").alias("k")).groupBy(M.script(F.ascii("c")).alias("bucket")).agg(F.sum("k").alias("n"))


@register("t8_first_headings", duck("planted", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS place, trim(line) AS heading FROM (SELECT *, {NO} AS no FROM planted) q WHERE no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) <= 10"))
def t8(spark, sf):
    heads = view(spark, sf, "planted").withColumn("no", O.chapter_no("line")).where("no is not null")
    return O.head_of(heads, ["doc_id"], ["n"], 10).select("doc_id", "place", F.trim("line").alias("heading"))


@register("p26_word_runs", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+([.''-][A-Za-z0-9]+)*')) AS latin, len(regexp_extract_all(text, '[À-ÿ]+')) AS other FROM documents WHERE text IS NOT NULL")
def p26(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]+([.'-][A-Za-z0-9]+)*"), F.lit(0))).cast("long").alias("latin"), F.size(F.regexp_extract_all("text", F.lit("[À-ÿ]+"), F.lit(0))).cast("long").alias("other"))


@register("p27_bidi_reverse", "SELECT doc_id, array_to_string(list_reverse(regexp_extract_all(text, '[A-Za-z0-9 ]+|[^A-Za-z0-9 ]')), '') AS t FROM documents WHERE text IS NOT NULL")
def p27(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(F.reverse(F.regexp_extract_all("text", F.lit("[A-Za-z0-9 ]+|[^A-Za-z0-9 ]"), F.lit(0))), "").alias("t"))


@register("p37_cell_text", "SELECT doc_id, regexp_replace(replace(text, '</b><b>', ''), ' +', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL")
def p37(spark, sf):
    return docs(spark, sf).select("doc_id", F.regexp_replace(F.replace("text", F.lit("</b><b>"), F.lit("")), " +", " ").alias("t"))


@register("a39_log_values", duck("doc_lines", "SELECT doc_id, count(*) AS n, CAST(sum(TRY_CAST(regexp_extract(line, '([0-9]+)', 1) AS BIGINT) % 1000) AS BIGINT) AS total FROM doc_lines WHERE contains(line, ' = ') AND length(regexp_extract(line, '([0-9]+)', 1)) BETWEEN 1 AND 9 GROUP BY 1"))
def a39(spark, sf):
    number = F.regexp_extract("line", "([0-9]+)", 1)
    return view(spark, sf, "doc_lines").where(F.contains("line", F.lit(" = ")) & F.length(number).between(1, 9)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(number.try_cast("long") % 1000).alias("total"))


@register("l20_boolean_search", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\\bth[a-z]*ing\\b') AND (contains(lower(text), 'tion') OR contains(lower(text), 'ment')) AND NOT regexp_matches(lower(text), '\\bidio.\\b')")
def l20(spark, sf):
    t = F.lower("text")
    return docs(spark, sf).where(M.wild(t, "th*ing") & (F.contains(t, F.lit("tion")) | F.contains(t, F.lit("ment"))) & ~M.wild(t, "idio?")).select("doc_id")


@register("l17_consensus", "SELECT lang, source, count(DISTINCT quality) AS views, max(n) AS strongest, round(max(n) / sum(n), 6) AS strength FROM (SELECT lang, source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) q GROUP BY 1, 2")
def l17(spark, sf):
    n = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").groupBy("lang", "source", "quality").agg(F.count("*").alias("n"))
    return n.groupBy("lang", "source").agg(F.count_distinct("quality").alias("views"), F.max("n").alias("strongest"), F.round(F.max("n") / F.sum("n"), 6).alias("strength"))


@register("l17_conflicts", "WITH v AS (SELECT lang, source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), t AS (SELECT lang, source, arg_max(quality, n * 10 - quality) AS va, max(n) AS na FROM v GROUP BY 1, 2) SELECT v.lang, v.source, va AS view_a, quality AS view_b, na AS docs_a, n AS docs_b, CASE WHEN n / (n + na) >= 1 / 3 THEN 'core' ELSE 'minor' END AS weight FROM v JOIN t ON v.lang = t.lang AND v.source = t.source AND quality <> va")
def l17_conflicts(spark, sf):
    n = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").groupBy("lang", "source", "quality").agg(F.count("*").alias("n"))
    return CW.conflicts(n, ["lang", "source"], "quality")


@register("f2_triage", duck("page_text", "SELECT doc_id, state, CAST(row_number() OVER (ORDER BY CASE state WHEN 'native' THEN 1 WHEN 'ocr' THEN 2 ELSE 0 END, doc_id) AS INTEGER) AS place FROM (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'password' WHEN doc_id % 23 = 0 THEN 'corrupted' WHEN sum(CASE WHEN page = 1 THEN length(trim(line)) ELSE 0 END) = 0 THEN 'ocr' ELSE 'native' END AS state FROM page_text GROUP BY 1) q"))
def f2(spark, sf):
    """The queue's place counts on over ranges of (rank, doc_id)."""
    first = F.sum(F.when(F.col("page") == 1, F.length(F.trim("line"))).otherwise(0))
    state = F.when(F.col("doc_id") % 19 == 0, "password").when(F.col("doc_id") % 23 == 0, "corrupted").when(first == 0, "ocr").otherwise("native")
    rank = F.when(F.col("state") == "native", 1).when(F.col("state") == "ocr", 2).otherwise(0)
    return numbered(view(spark, sf, "page_text").groupBy("doc_id").agg(state.alias("state")).withColumn("rank", rank), ["rank", "doc_id"], "place").drop("rank")
