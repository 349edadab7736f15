"""Case files: routing, classification, roll-ups of rows and issues, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.batches import numbered_by
from docketry.operators.boxes import cut
from docketry.functions.columns import blank, has_any

# Fixed values.
IMAGE_TYPES = ["jpg", "jpeg", "png", "tif", "tiff"]
MODULE_OF_LEGACY = {"broker": "account_info"}
MODULE_OF_CONTENT = {"identity": "identity_info", "guangfa": "account_info", "chinaclear": "account_info", "unknown": "unknown"}
NO_RECORD = ["共0条", "共 0 条", "没有相应的查询信息", "没有相应查询信息", "暂无记录", "无记录", "没有持仓", "无持仓", "暂无持仓", "未持仓"]
NO_ACCOUNT = ["未开立账户", "未开立证券账户", "未开通账户", "未开通证券账户", "未开户", "没有开立证券账户", "无证券账户", "无账户"]
TRADE_QUERY = ["历史成交", "成交日期", "成交时间", "成交编号", "买卖标志", "成交金额", "交易流水", "持有变更", "证券持有变更"]
HOLDING_QUERY = ["持仓信息", "我的持仓", "证券持有信息", "当前数量", "持有数量", "没有持仓", "无持仓", "暂无持仓", "未持仓"]
ACCOUNT_LABELS = r"(?:证券账户|证券账号|资金账号|资金帐号|一码通账户|一码通账号|股东代码)[:：\s]*([A-Za-z0-9\-]{5,})"
ACCOUNT_PLAIN = r"多帐号\s*([A-Za-z0-9]{5,})"
LANGUAGE_WORDS = {"en": ["the", "tion", "ing"], "fr": ["eau", "ment", "tre"], "de": ["ung", "keit", "sch"], "es": ["ción", "mente", "ado"]}


def route(files: DataFrame, pages: DataFrame, least: int = 80, first: int = 3) -> DataFrame:
    """image, unsupported, direct (`least` characters or more on the first pages) or scanned (F1)."""
    ext = F.regexp_extract(F.lower("original_file_name"), r"\.([a-z0-9]+)$", 1)
    chars = pages.where(F.col("page") <= first).groupBy("file_id").agg(F.sum(F.length(F.regexp_replace("text", r"\s+", ""))).alias("chars"))
    n = F.coalesce("chars", F.lit(0))
    kind = F.when(ext.isin(IMAGE_TYPES), "image").when(ext != "pdf", "unsupported").when(n >= least, "direct").otherwise("scanned")
    return files.join(chars, "file_id", "left").select("file_id", kind.alias("route"), n.alias("chars"))


def with_module(files: DataFrame) -> DataFrame:
    """Legacy module names mapped, blank ones told from the content type."""
    legacy = F.create_map(*[F.lit(x) for kv in MODULE_OF_LEGACY.items() for x in kv])
    content = F.create_map(*[F.lit(x) for kv in MODULE_OF_CONTENT.items() for x in kv])
    told = F.coalesce(F.try_element_at(content, F.col("content_type")), F.lit("unknown"))
    return files.withColumn("module", F.when(blank("module"), told).otherwise(F.coalesce(F.try_element_at(legacy, F.col("module")), F.col("module"))))


def module_counts(files: DataFrame) -> DataFrame:
    """Files of each module beside each other."""
    return files.groupBy("case_id").agg(*[F.count_if(F.col("module") == m).alias(m) for m in ("identity_info", "account_info", "unknown")])


def classify(docs: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """Keyword scores of doc_id, body, name: 1 for a word in the body, 2 in the name; best class, ties to the
    earlier one; review when the lead is under 2 (A12). The words are a parameter, so scores are one
    projection and nothing is joined."""
    body, name = F.lower("body"), F.lower("name")
    scores = F.array(*[F.struct(sum((F.contains(body, F.lit(w.lower())).cast("long") + 2 * F.contains(name, F.lit(w.lower())).cast("long") for w in ws), F.lit(0).cast("long")).alias("score"), F.lit(-i).alias("o"), F.lit(k).alias("kind")) for i, (k, ws) in enumerate(words.items())])
    ranked = docs.select("doc_id", F.sort_array(scores, asc=False).alias("r"))
    best, second = F.col("r")[0], F.get(F.col("r"), F.lit(1))["score"]
    total = F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["score"])
    none = best["score"] == 0
    return ranked.select("doc_id", F.when(none, "unknown").otherwise(best["kind"]).alias("kind"), best["score"].alias("score"), (none | (best["score"] - F.coalesce(second, F.lit(0)) < 2)).alias("needs_review"), F.when(none, 0.0).otherwise(F.round(best["score"] / total, 4)).alias("confidence"))


def export_audit(resolved: DataFrame) -> DataFrame:
    """Full, final and excluded rows of each case; warn when nothing was excluded."""
    full, final = F.count_if(F.col("status") == "verified"), F.count_if("is_final")
    return resolved.groupBy("case_id").agg(full.alias("full_rows"), final.alias("final_rows"), F.count_if((F.col("status") == "verified") & ~F.col("is_final")).alias("excluded_rows"), ((full == final) & (final > 0)).alias("warn"))


def case_summary(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Counters of each case."""
    rows = resolved.groupBy("case_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == "pending").alias("pending"))
    n = files.groupBy("case_id").agg(F.count("*").alias("n_files"))
    return rows.join(n, "case_id", "left").select("case_id", "n_rows", "pending", F.coalesce("n_files", F.lit(0)).alias("n_files"), (F.col("pending") > 0).alias("needs_review"))


def checklist(resolved: DataFrame, trade: Column, holding: Column) -> DataFrame:
    """Cases with both trades and holdings need a look."""
    t, h = F.count_if(trade), F.count_if(holding)
    return resolved.groupBy("case_id").agg(t.alias("trades"), h.alias("holdings"), F.when((t > 0) & (h > 0), "needs_review").otherwise("exempt").alias("state"))


def with_file(rows: DataFrame, files: DataFrame) -> DataFrame:
    """File fields where the row has none (J1, J2). The files table is joined by size, not by hint."""
    f = files.select("file_id", *[F.col(c).alias(f"f_{c}") for c in files.columns if c != "file_id"])
    out = rows.join(f, "file_id", "left")
    for c in files.columns:
        if c != "file_id":
            out = out.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"f_{c}")) if c in rows.columns else F.col(f"f_{c}"))
    return out.drop(*[f"f_{c}" for c in files.columns])


def new_items(items: DataFrame, raised: DataFrame) -> DataFrame:
    """Review items that were not raised, the first of each signature; checklist items are none."""
    fresh = items.where("category <> 'checklist'").join(raised, ["case_id", "record_id", "field"], "left_anti")
    return fresh.withColumn("rn", F.row_number().over(Window.partitionBy("case_id", "record_id", "field").orderBy("src_ord"))).where("rn = 1").drop("rn")


def issue_files(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Issues to the known files they name, their own file without any."""
    ids = F.when(F.size("file_ids") > 0, F.col("file_ids")).otherwise(F.array("file_id"))
    return issues.select("case_id", "event_id", F.explode(ids).alias("file_id")).join(files.select("file_id"), "file_id").select("case_id", "event_id", "file_id").distinct()


def known_summaries(told: DataFrame, files: DataFrame, types: list[str]) -> DataFrame:
    """Summaries of known files with known types only."""
    return told.join(files, "file_id", "left_semi").withColumn("types", F.array_intersect("types", F.array(*[F.lit(t) for t in types])))


def roll_up(issues: DataFrame, many: int = 5) -> DataFrame:
    """Issues of each file: kinds, worst severity, how many, last filled action; `many` pending rows are one issue more."""
    worst = F.max("severity")
    more = F.count_if(F.col("kind") == "pending_record") >= many
    kinds = F.array_union(F.collect_set("kind"), F.when(more, F.array(F.lit("many_pending"))).otherwise(F.array().cast("array<string>")))
    return issues.groupBy("file_id").agg(
        F.array_join(F.array_sort(kinds), ",").alias("kinds"), F.when(worst == 2, "error").when(worst == 1, "warning").otherwise("normal").alias("severity"),
        (F.count("*") + more.cast("int")).alias("n"), F.max_by(F.when(F.col("action") != "", F.col("action")), F.when(F.col("action") != "", F.col("ord"))).alias("action"),
    )


def file_summary(issues: DataFrame) -> DataFrame:
    """Counts and the first three names, 等 when there are more (A17, T8). A file may have any share of the issues: they are counted and ranked, never gathered."""
    kept = cut(issues.select("file_id", "severity", "ord", "name"), "issues")  # read twice
    n = kept.groupBy("file_id").agg(F.count_if(F.col("severity") == 2).alias("errors"), F.count_if(F.col("severity") == 1).alias("warnings"), F.count("*").alias("n"))
    ranked = kept.withColumn("rn", F.row_number().over(Window.partitionBy("file_id").orderBy("ord", "name"))).where("rn <= 3")
    first = ranked.groupBy(F.col("file_id").alias("fid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), "、").alias("names"))
    both = n.join(first, F.col("file_id").eqNullSafe(F.col("fid")))
    return both.select("file_id", "errors", "warnings", F.concat("names", F.when(F.col("n") > 3, "等").otherwise("")).alias("sample"))


def next_ids(rows: DataFrame, taken: DataFrame, prefix: str, width: int = 3) -> DataFrame:
    """The next numbers of each case after the largest taken one, zero-padded."""
    last = taken.groupBy("case_id").agg(F.max(F.regexp_extract("id", r"(\d+)$", 1).try_cast("long")).alias("last"))
    n = F.coalesce("last", F.lit(0)) + F.col("__rn")
    return numbered_by(rows, ["case_id"], ["src_ord"], "__rn").join(last, "case_id", "left").withColumn("id", F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))).drop("last", "__rn")


def labelled(values: str, labels: dict[str, str]) -> Column:
    """Values replaced by their labels, unknown ones as they are."""
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.transform(values, lambda x: F.coalesce(F.try_element_at(m, x), x))


def description(conflict: Column, missing: Column) -> Column:
    """Why a row needs review, and a line of the row."""
    return F.concat_ws("；", F.when(conflict, "冲突"), F.when(missing, "缺失"), F.concat(F.lit("日期 "), "event_date"), F.concat(F.lit("代码 "), "security_code"))


def union_sources(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows of several sources in one table; ids by source and place in the file, a default type each."""
    out = None
    for name, (df, kind) in sources.items():
        place = F.row_number().over(Window.partitionBy("file_id").orderBy("src_ord", "event_type"))
        one = df.withColumns({"event_id": F.concat(F.lit(f"{name}_"), place), "event_type": F.when(blank("event_type"), kind).otherwise(F.col("event_type"))})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def empty_records(files: DataFrame, rows: DataFrame) -> DataFrame:
    """A zero row for each file without rows whose text says that there are none."""
    t = F.col("text")
    kind = F.when(has_any(t, NO_ACCOUNT), "no_account_record").when(has_any(t, TRADE_QUERY), "no_trade_record").when(has_any(t, HOLDING_QUERY), "no_holding_record").otherwise("unknown_event")
    bare = files.join(rows.select("file_id"), "file_id", "left_anti").where(has_any(t, NO_RECORD + NO_ACCOUNT))
    return bare.withColumns({"event_type": kind, "quantity_raw": F.lit("0"), "price_raw": F.lit("0"), "amount_raw": F.lit("0"), "security_code": F.lit("0")})


def account(fields: list[str], text: str) -> Column:
    """The first filled field, else an account number after its label in the text, else '' (P8)."""
    found = [F.nullif(F.trim(F.col(f)), F.lit("")) for f in fields]
    return F.coalesce(*found, F.nullif(F.regexp_extract(text, ACCOUNT_LABELS, 1), F.lit("")), F.nullif(F.regexp_extract(text, ACCOUNT_PLAIN, 1), F.lit("")), F.lit(""))
