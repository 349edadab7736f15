"""Derived views over the given tables: for each a SQL text that both engines read (tables in braces), or a
DataFrame and the other engine's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.columns import let, sums_before

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()

#: SQL that reads the same in Spark and DuckDB.
SHARED = {
    "ledger_rows": """
WITH b AS (
  SELECT l_orderkey*20 + l_linenumber AS src_ord, l_linenumber AS ln,
    concat('case_', o_custkey % 50) AS case_id, concat('file_', l_orderkey % 500) AS file_id,
    CASE WHEN l_partkey % 37 = 0 THEN '' ELSE concat('A', o_custkey % 40) END AS securities_account,
    CASE WHEN l_suppkey % 41 = 0 THEN '' ELSE 'A' END AS account_type,
    CASE l_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'cash_dividend' WHEN 2 THEN 'bonus_share'
         WHEN 3 THEN 'unknown_event' WHEN 4 THEN 'no_trade_record' ELSE 'ordinary_trade' END AS event_type,
    CAST(CAST(l_shipdate AS DATE) AS STRING) AS event_date,
    concat('S', l_partkey % 25) AS security_code, concat('N', l_partkey % 25) AS security_name,
    CASE l_returnflag WHEN 'A' THEN 'sell' WHEN 'N' THEN 'buy' ELSE '' END AS direction,
    CAST(CAST(l_quantity AS INT) AS STRING) AS quantity_raw,
    CASE l_suppkey % 6 WHEN 0 THEN '买入' WHEN 1 THEN '卖出' WHEN 2 THEN '红利'
         WHEN 3 THEN '转入' ELSE '' END AS transfer_type_raw
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey)
SELECT *, concat('e', src_ord) AS event_id FROM b
UNION ALL
SELECT src_ord + 10, ln, case_id, file_id, securities_account, account_type, event_type, event_date,
       security_code, security_name, direction, quantity_raw, transfer_type_raw, concat('e', src_ord + 10) FROM b WHERE ln = 1
UNION ALL
SELECT src_ord + 10, ln, case_id, file_id, securities_account, account_type, event_type, event_date,
       security_code, security_name, direction, concat(quantity_raw, '1'), transfer_type_raw, concat('e', src_ord + 10)
  FROM b WHERE ln = 2 AND src_ord % 3 = 0""",
    "boxes_gt": """
SELECT l_orderkey AS image_id, l_linenumber AS box_id,
  CAST((l_partkey % 20) * 40 AS DOUBLE) AS x1, CAST((l_suppkey % 15) * 30 AS DOUBLE) AS y1,
  CAST((l_partkey % 20) * 40 + 36 AS DOUBLE) AS x2, CAST((l_suppkey % 15) * 30 + 24 AS DOUBLE) AS y2,
  l_returnflag = 'R' AS ignore, concat('t', l_partkey % 97) AS text
FROM {lineitem}""",
    "boxes_pred": """
SELECT l_orderkey AS image_id, l_linenumber AS box_id,
  CAST((l_partkey % 20) * 40 + (l_partkey % 7) - 3 AS DOUBLE) AS x1, CAST((l_suppkey % 15) * 30 + (l_suppkey % 5) - 2 AS DOUBLE) AS y1,
  CAST((l_partkey % 20) * 40 + 36 + (l_partkey % 7) - 3 AS DOUBLE) AS x2, CAST((l_suppkey % 15) * 30 + 24 + (l_suppkey % 5) - 2 AS DOUBLE) AS y2,
  CAST(1 - l_discount AS DOUBLE) AS score, CASE WHEN l_partkey % 11 = 0 THEN 'x' ELSE concat('t', l_partkey % 97) END AS text
FROM {lineitem} WHERE l_linenumber % 6 <> 0""",
    "norm_versions": """
SELECT o_custkey AS norm_id, o_orderkey AS version_id, CAST(o_orderdate AS DATE) AS valid_from,
  lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS level
FROM {orders}""",
    "files": """
SELECT concat('file_', k) AS file_id, min(concat('case_', o_custkey % 50)) AS case_id, concat('No', k) AS file_no,
  concat('statement ', k, CASE k % 7 WHEN 0 THEN '.png' WHEN 1 THEN '.docx' ELSE '.pdf' END) AS original_file_name, concat('/out/', k) AS output_dir,
  CASE k % 4 WHEN 0 THEN 'account_info' WHEN 1 THEN 'broker' WHEN 2 THEN '' ELSE 'identity_info' END AS module,
  CASE k % 3 WHEN 0 THEN 'chinaclear' WHEN 1 THEN 'identity' ELSE 'unknown' END AS content_type
FROM (SELECT o_orderkey % 500 AS k, o_custkey FROM {orders}) o GROUP BY k""",
    "deadlines": """
SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start_date, o_orderpriority AS kind, o_custkey AS client
FROM {orders}""",
    "timesheets": """
SELECT l_orderkey AS case_id, l_linenumber AS ln, CASE l_suppkey % 4 WHEN 0 THEN 'partner' WHEN 1 THEN 'associate' WHEN 2 THEN 'counsel' ELSE 'paralegal' END AS role,
  l_quantity / 10 AS hours, CAST(l_shipdate AS DATE) AS day, CASE l_returnflag WHEN 'A' THEN 'court fee' WHEN 'N' THEN 'travel' ELSE 'expert' END AS expense_type,
  CAST(l_extendedprice AS DOUBLE) AS amount, l_linestatus = 'O' AS billable, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE concat('r', l_partkey) END AS receipt
FROM {lineitem}""",
    "links": "SELECT conv_id, turn AS a, turn + 1 AS b FROM {conversations}",
}

#: DuckDB's text for views that Spark builds with DataFrames.
DUCK = {
    "doc_lines": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL",
    "text_pairs": """SELECT doc_id, n, gt, CASE WHEN doc_id % 5 = 0 AND length(p) > 0 THEN substring(p, 1, CAST(length(p) AS INT) - 1) ELSE p END AS pred
FROM (SELECT doc_id, n, gt, CASE WHEN doc_id % 3 = 0 THEN replace(gt, 'e', '3') ELSE gt END AS p
  FROM (SELECT doc_id, CAST(n AS INTEGER) AS n, regexp_replace(lower(line), '[^a-z0-9 ]', '', 'g') AS gt FROM doc_lines) a) b""",
    "page_text": "SELECT doc_id, CAST(n // 40 AS BIGINT) + 1 AS page, CAST(n % 40 AS BIGINT) AS line_no, line FROM doc_lines",
    "word_raw": "SELECT doc_id, page, line_no, unnest(list_filter(string_split(line, ' '), lambda x: x <> '')) AS str, generate_subscripts(list_filter(string_split(line, ' '), lambda x: x <> ''), 1) - 1 AS k FROM page_text",
    "word_items": """SELECT doc_id, page, line_no, CAST(k AS BIGINT) AS k, str, CAST(5 * coalesce(sum(length(str)) OVER (PARTITION BY doc_id, page, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 5 * k AS DOUBLE) AS x,
  CAST(800 - 14 * line_no AS DOUBLE) AS y, CAST(5 * length(str) AS DOUBLE) AS w, 10.0::DOUBLE AS h, CASE WHEN line_no = 0 THEN 18.0::DOUBLE ELSE 10.0::DOUBLE END AS font_size, CASE WHEN doc_id % 17 = 0 THEN 'ABCDEF+Sub' ELSE 'F1' END AS font_name FROM word_raw""",
    "planted0": "SELECT doc_id, n, line FROM doc_lines",
    "planted": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o, s) - 1 AS n, line FROM (
  SELECT doc_id, n AS o, 1 AS s, line FROM doc_lines
  UNION ALL SELECT doc_id, n, 0, concat('Chapter ', n // 30 + 1, ': Title') FROM doc_lines WHERE n % 30 = 0
  UNION ALL SELECT DISTINCT doc_id, -2, 0, 'Table of Contents' FROM doc_lines WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, -1, n // 30, concat('Chapter ', n // 30 + 1, ': Title') FROM doc_lines WHERE n % 30 = 0 AND doc_id % 2 = 0) p""",
    "elements": """SELECT p.doc_id, p.page, p.line_no, p.page * 40 + p.line_no AS elem_ord, p.line AS text,
  CASE WHEN p.line_no = 0 THEN 'heading' WHEN p.line_no % 11 = 0 THEN 'table cell' ELSE 'paragraph' END AS type, CASE WHEN p.line_no = 0 THEN 1 + p.page % 3 END AS level FROM page_text p""",
}
NEEDS = {"text_pairs": ["doc_lines"], "page_text": ["doc_lines"], "word_raw": ["page_text"], "word_items": ["word_raw"], "planted": ["doc_lines"], "elements": ["page_text"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    if name == "ledger_rows":
        return _ledger_rows(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    if name in SHARED:
        text = SHARED[name]
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    if name == "doc_lines":
        return lines
    if name == "text_pairs":  # a line of a document against the same line misread
        gt = lines.select("doc_id", "n", F.regexp_replace(F.lower("line"), "[^a-z0-9 ]", "").alias("gt"))
        misread = F.when(F.col("doc_id") % 3 == 0, F.replace("gt", F.lit("e"), F.lit("3"))).otherwise(F.col("gt"))
        return gt.withColumn("p", misread).select("doc_id", "n", "gt", F.when((F.col("doc_id") % 5 == 0) & (F.length("p") > 0), F.substring("p", F.lit(1), F.length("p") - 1)).otherwise(F.col("p")).alias("pred"))
    if name == "planted":
        k = (F.floor(F.col("n") / 30) + 1).cast("int")
        title = F.concat(F.lit("Chapter "), k, F.lit(": Title"))
        heads = lines.where("n % 30 = 0")
        even = F.col("doc_id") % 2 == 0
        parts = lines.select("doc_id", F.col("n").alias("o"), F.lit(1).alias("s"), "line")
        parts = parts.union(heads.select("doc_id", "n", F.lit(0), title)).union(lines.where(even).select("doc_id", F.lit(-2), F.lit(0), F.lit("Table of Contents")).distinct())
        parts = parts.union(heads.where(even).select("doc_id", F.lit(-1), k - 1, title))
        return parts.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("o", "s")) - 1).alias("n"), "line")
    pages = lines.select("doc_id", (F.floor(F.col("n") / 40) + 1).alias("page"), (F.col("n") % 40).cast("long").alias("line_no"), "line")
    if name == "page_text":
        return pages
    if name == "elements":
        no = F.col("line_no")
        kind = F.when(no == 0, "heading").when(no % 11 == 0, "table cell").otherwise("paragraph")
        return pages.select("doc_id", "page", "line_no", (F.col("page") * 40 + no).alias("elem_ord"), F.col("line").alias("text"), kind.alias("type"), F.when(no == 0, 1 + F.col("page") % 3).alias("level"))
    if name == "word_texts":  # word_items without their places
        each = pages.where("replace(line, ' ', '') <> ''").select("doc_id", "page", "line_no", F.posexplode_outer(F.array_remove(F.split("line", " ", -1), "")).alias("k", "str"))
        return each.withColumns({"k": F.col("k").cast("long"), "font_name": _font()})
    if name == "line_words":  # word_items with a line's words in its row: no word is moved, for more work a row
        # filtered by the line: a filter on the words would work them out once more
        return pages.where("replace(line, ' ', '') <> ''").select("doc_id", "page", "line_no", let(F.array_remove(F.split("line", " ", -1), ""), placed).alias("ws"))
    # exploded from the line's row, where each word has its place already: nothing is moved or sorted; outer, as a filter on the array would work it out once more
    words = view(spark, sf_dir, "line_words").select("doc_id", "page", "line_no", F.explode_outer("ws").alias("word"))
    return words.select(
        "doc_id", "page", "line_no", "word.k", "word.str", "word.x", (800 - 14 * F.col("line_no")).cast("double").alias("y"), "word.w",
        F.lit(10.0).alias("h"), F.when(F.col("line_no") == 0, 18.0).otherwise(10.0).alias("font_size"), _font().alias("font_name"),
    )


def _ledger_rows(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """ledger_rows with its tables joined once: a line's planted copies come from its row."""
    b = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.expr("l_orderkey*20 + l_linenumber").alias("src_ord"), F.col("l_linenumber").alias("ln"), F.expr("concat('case_', o_custkey % 50)").alias("case_id"), F.expr("concat('file_', l_orderkey % 500)").alias("file_id"),
        F.expr("CASE WHEN l_partkey % 37 = 0 THEN '' ELSE concat('A', o_custkey % 40) END").alias("securities_account"), F.expr("CASE WHEN l_suppkey % 41 = 0 THEN '' ELSE 'A' END").alias("account_type"),
        F.expr("CASE l_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'cash_dividend' WHEN 2 THEN 'bonus_share' WHEN 3 THEN 'unknown_event' WHEN 4 THEN 'no_trade_record' ELSE 'ordinary_trade' END").alias("event_type"),
        F.expr("CAST(CAST(l_shipdate AS DATE) AS STRING)").alias("event_date"), F.expr("concat('S', l_partkey % 25)").alias("security_code"), F.expr("concat('N', l_partkey % 25)").alias("security_name"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'sell' WHEN 'N' THEN 'buy' ELSE '' END").alias("direction"), F.expr("CAST(CAST(l_quantity AS INT) AS STRING)").alias("quantity_raw"),
        F.expr("CASE l_suppkey % 6 WHEN 0 THEN '买入' WHEN 1 THEN '卖出' WHEN 2 THEN '红利' WHEN 3 THEN '转入' ELSE '' END").alias("transfer_type_raw"),
    )
    copies = F.explode(F.expr("CASE WHEN ln = 1 THEN array(0, 1) WHEN ln = 2 AND src_ord % 3 = 0 THEN array(0, 2) ELSE array(0) END")).alias("copy")
    each = b.select("*", copies).withColumns({"src_ord": F.expr("src_ord + CASE WHEN copy > 0 THEN 10 ELSE 0 END"), "quantity_raw": F.expr("CASE WHEN copy = 2 THEN concat(quantity_raw, '1') ELSE quantity_raw END")})
    return each.drop("copy").withColumn("event_id", F.concat(F.lit("e"), "src_ord"))


def _font() -> Column:
    return F.when(F.col("doc_id") % 17 == 0, "ABCDEF+Sub").otherwise("F1")


def placed(words: Column) -> Column:
    """Words as structs k, str, x, w, five wide a character and five between two."""
    x = sums_before(F.transform(words, lambda w: 5 * (F.length(w) + 1)))
    return let(x, lambda at: F.transform(words, lambda w, i: F.struct(i.cast("long").alias("k"), w.alias("str"), F.get(at, i).cast("double").alias("x"), (5 * F.length(w)).cast("double").alias("w"))))


def duck(names: str, body: str) -> str:
    """DuckDB SQL: the views that `names` lists, then body."""
    made: dict[str, str] = {}

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in made:
            text = DUCK.get(name) or SHARED[name]
            for t in TABLES:
                text = text.replace(f"{{{t}}}", t)
            made[name] = text

    for n in names.split():
        add(n)
    body = body.strip()
    head = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in made.items())
    return head + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
