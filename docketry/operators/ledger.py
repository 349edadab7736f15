"""Ledger rows of case files: normalise, merge duplicates, flag conflicts, validate, audit.

Every operator is keyed by case, so one job resolves all cases. src_ord is the rows' order in their source;
`first` always means first by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.columns import blank, first_filled, has_any, text_of

# Fixed values.
FINAL_TYPES = ["ordinary_trade", "security_registration", "bonus_share", "new_share_subscription", "new_bond_subscription", "no_trade_record", "no_holding_record", "no_account_record"]
FINAL_DIRECTIONS = ["buy", "sell", "transfer_in", "transfer_out", "registration_in", "rights_event", "subscribe"]
EXCLUDED_TYPES = ["cash_dividend", "bond_interest", "cash_flow", "bank_transfer", "fund_transfer", "interest"]
EXCLUDED_WORDS = ["红利", "分红", "股息", "派息", "兑息", "利息", "资金流水", "资金存取", "银证转账", "银行转账", "转入", "转出"]
EMPTY_TYPES = ["no_trade_record", "no_holding_record", "no_account_record"]
TRADE_NAMES = ["买入", "卖出", "证券买入", "证券卖出", "交易过户"]
TYPE_WORDS = [
    (["股份登记", "申购中签", "新股入账"], "security_registration"),
    (["送股", "转增", "红股"], "bonus_share"),
    (["分红", "红利", "股息", "派息"], "cash_dividend"),
    (["兑息", "利息", "付息"], "bond_interest"),
    (["银证", "资金", "银行"], "cash_flow"),
]
DIRECTION_WORDS = [
    (["买入"], "buy"),
    (["卖出"], "sell"),
    (["股份登记", "中签", "新股"], "registration_in"),
    (["送股", "转增", "红股"], "rights_event"),
    (["分红", "红利", "股息", "派息"], "cash_income"),
]
BUY_NAMES = ["买", "买入", "证券买入", "申购", "转入"]
SELL_NAMES = ["卖", "卖出", "证券卖出", "赎回", "转出"]
REQUIRED = ["account_type", "securities_account", "event_type", "event_date", "security_code", "security_name"]
EXACT_KEY = ["securities_account", "account_type", "event_type", "event_date", "security_code", "security_name", "direction", "quantity_raw", "price_raw", "amount_raw", "balance_after_raw"]
CONFLICT_KEY = ["securities_account", "event_type", "event_date", "security_code", "security_name"]
CONFLICT_FIELDS = ["direction", "quantity_raw", "price_raw", "amount_raw", "balance_after_raw"]
#: column -> the names it may go by, the row's own first, then the document's and the file's.
EVENT_ALIASES = {
    "event_id": ["event_id", "trade_id", "transaction_id", "cash_flow_id"],
    "event_date": ["event_date", "trade_date", "transaction_date", "business_date"],
    "quantity_raw": ["quantity_raw", "quantity", "volume_raw", "share_quantity_raw"],
    "price_raw": ["price_raw", "price", "trade_price_raw"],
    "amount_raw": ["amount_raw", "amount", "settlement_amount_raw", "settlement_amount", "clearing_amount_raw", "clearing_amount", "net_amount_raw", "net_amount"],
    "balance_after_raw": ["balance_after_raw", "holding_balance_raw", "stock_balance_raw"],
    "transfer_type_raw": ["transfer_type_raw", "transaction_type_raw", "business_type_raw", "event_type_raw"],
    "securities_account": ["securities_account", "fund_account", "document_securities_account", "document_fund_account", "file_securities_account"],
    "account_type": ["account_type", "document_account_type", "file_account_type"],
}
HOLDING_ALIASES = {
    "holding_date": ["holding_date", "event_date", "period_end"],
    "quantity_raw": ["quantity_raw", "holding_quantity_raw", "balance_after_raw"],
    "securities_account": EVENT_ALIASES["securities_account"],
    "account_type": EVENT_ALIASES["account_type"],
}


def alias(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each column from the first filled one of its names that rows has; '' without."""
    have = set(rows.columns)
    return rows.withColumns({c: first_filled(*[n for n in names if n in have]) for c, names in aliases.items()})


def event_type(kind: str = "event_type", raw: str = "transfer_type_raw") -> Column:
    """Explicit type, else by exact names, else by the first group of words found, else unknown."""
    r = F.coalesce(F.col(raw), F.lit(""))
    out = F.when(text_of(kind) != "", text_of(kind)).when(r.isin(TRADE_NAMES), "ordinary_trade")
    for words, name in TYPE_WORDS:
        out = out.when(has_any(r, words), name)
    return out.otherwise("unknown_event")


def direction(given: str = "direction", raw: str = "transfer_type_raw") -> Column:
    """Given direction with synonyms mapped (unknown ones pass), else by words of the raw type."""
    d, r = text_of(given), F.coalesce(F.col(raw), F.lit(""))
    out = F.when(d.isin(BUY_NAMES), "buy").when(d.isin(SELL_NAMES), "sell").when(d != "", d)
    for words, name in DIRECTION_WORDS:
        out = out.when(has_any(r, words), name)
    return out.otherwise("")


def movement_type() -> Column:
    return F.coalesce(*[F.nullif(text_of(c), F.lit("")) for c in ("transfer_type_raw", "event_type", "direction")], F.lit("unknown"))


def is_final() -> Column:
    """Belongs in the final declaration (F8). 转入 and 转出 in the raw type exclude whatever the direction."""
    t, d, r = (F.coalesce(F.col(c), F.lit("")) for c in ("event_type", "direction", "transfer_type_raw"))
    return F.when(t.isin(EXCLUDED_TYPES) | has_any(r, EXCLUDED_WORDS), False).otherwise(t.isin(FINAL_TYPES) | d.isin(FINAL_DIRECTIONS))


def is_uncertain() -> Column:
    """Type needs a look."""
    t, r = (F.coalesce(F.col(c), F.lit("")) for c in ("event_type", "transfer_type_raw"))
    return ~t.isin(EXCLUDED_TYPES) & ~has_any(r, EXCLUDED_WORDS) & t.isin("", "unknown_event")


def normalise(rows: DataFrame) -> DataFrame:
    """Rows to the event columns: aliases, then type and direction."""
    have = alias(rows, EVENT_ALIASES)
    return have.withColumns({"event_type": event_type(), "direction": direction()})


def evidence(more: tuple[str, ...] = ()) -> Column:
    return F.struct("file_id", F.col("event_id").alias("source_row_id"), F.col("ln").cast("string").alias("row_no"), *more)


#: where a row stands: rows of one exact key, and of one conflict key, stand together
_PLACE = ["case_id", *CONFLICT_KEY]
_WHOLE = [*_PLACE, *[c for c in EXACT_KEY if c not in CONFLICT_KEY], "__own"]


def _keyed(events: DataFrame) -> DataFrame:
    """events with the columns of their keys trimmed; __given holds them as they were where trimming changed one, so that no value is moved twice. Rows whose exact key is blank throughout have
    __own. Rows that name no account, date, code and name stand together in their case: they may be full by white space."""
    blank_key = F.lit(True)
    changed = F.lit(False)
    for c in EXACT_KEY:
        blank_key = blank_key & blank(c)
        changed = changed | ~F.col(c).eqNullSafe(text_of(c))
    own = F.when(blank_key, F.col("src_ord"))
    return events.withColumns({"__given": F.when(changed, F.struct(*EXACT_KEY)), "__own": own}).withColumns({c: text_of(c) for c in EXACT_KEY})


def _as_given(c: str, given: Column) -> Column:
    return F.when(given.isNotNull(), given[c]).otherwise(F.col(c))


def _restored(keyed: DataFrame, given: str = "__given") -> DataFrame:
    return keyed.withColumns({c: _as_given(c, F.col(given)) for c in EXACT_KEY}).drop("__given", "__own")


def merge_duplicates(events: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each case and 11-field key, the first; adds merged (rows it stands for) and evidence of
    all of them, in order, each once (A1), with the columns `more`. Rows whose key is blank throughout stay as they are: their key
    takes in src_ord. Rows are moved once, plain; the evidence of a key is one list, as long as what is asked for."""
    keyed = _keyed(events)
    rest = [c for c in keyed.columns if c not in _WHOLE and c not in more]
    listed = F.array_sort(F.collect_list(F.struct("src_ord", evidence(more).alias("v"))))
    merged = keyed.repartition(*_PLACE).groupBy(*_WHOLE).agg(F.min_by(F.struct(*rest), "src_ord").alias("__row"), F.count("*").alias("merged"), F.array_distinct(F.transform(listed, lambda p: p["v"])).alias("evidence"))
    plain = merged.select("*", *[F.col("__row")[c].alias(c) for c in rest])
    return _restored(plain).select(*[c for c in events.columns if c not in more], "merged", "evidence")


def _firsts(keyed: DataFrame) -> DataFrame:
    """The first row of each exact key, with how many it stands for."""
    same = Window.partitionBy(*_WHOLE)
    return keyed.repartition(*_PLACE).withColumns({"merged": F.count("*").over(same), "__rn": F.row_number().over(same.orderBy("src_ord"))}).where("__rn = 1").drop("__rn")


def _conflicts(keyed: DataFrame) -> DataFrame:
    given = F.col("__given")
    full = F.lit(True)
    for c in CONFLICT_KEY:
        full = full & ~blank(_as_given(c, given))
    by = Window.partitionBy(*_PLACE)
    many = []
    for c in CONFLICT_FIELDS:
        value = F.when(full & ~blank(_as_given(c, given)), F.col(c))
        many.append(F.when(full & (F.min(value).over(by) != F.max(value).over(by)), F.lit(c)))
    return keyed.withColumn("conflict_fields", F.array_compact(F.array(*many)))


def mark_conflicts(events: DataFrame) -> DataFrame:
    """Adds conflict_fields: those of CONFLICT_FIELDS with more than one value among the rows of one case and
    5-field key (A2). Rows with a blank key field are in no group. Blank is tested before trimming, so a
    value of white space counts as one more. Values differ where the least is not the greatest, so no set is gathered."""
    return _restored(_conflicts(_keyed(events))).select(*events.columns, "conflict_fields")


def validate(events: DataFrame) -> DataFrame:
    """Adds issue_types and missing_fields (A3): required fields, account, type; empty records need only
    an account (but for no_account_record) and a date. A conflict is an issue too."""
    no_account, no_type = blank("securities_account"), blank("account_type")
    untyped = F.coalesce(F.col("event_type"), F.lit("")).isin("", "unknown_event")
    missing = F.array(*[F.when(blank(c), F.lit(c)) for c in REQUIRED])
    more = F.array(F.when(no_account, F.lit("securities_account")), F.when(no_account | no_type, F.lit("account_type")), F.when(untyped, F.lit("event_type")))
    any_missing = F.size(F.array_compact(missing)) > 0
    issues = F.array(F.when(any_missing, F.lit("missing_required_fields")), F.when(no_account, F.lit("securities_account_missing")), F.when(no_account | no_type, F.lit("account_type_missing")), F.when(untyped, F.lit("unknown_event_type")))
    lost = (F.col("event_type") != "no_account_record") & no_account
    e_issues = F.array(F.when(lost, F.lit("empty_record_account_missing")), F.when(blank("event_date"), F.lit("empty_record_period_missing")))
    e_missing = F.array(F.when(lost, F.lit("securities_account")), F.when(blank("event_date"), F.lit("event_date")))
    is_empty = F.col("event_type").isin(EMPTY_TYPES)
    conflict = F.when(F.size("conflict_fields") > 0, F.array(F.lit("conflict_between_sources"))).otherwise(F.array().cast("array<string>"))
    return events.withColumns(
        {
            "issue_types": F.array_distinct(F.concat(conflict, F.array_compact(F.when(is_empty, e_issues).otherwise(issues)))),
            "missing_fields": F.array_distinct(F.array_compact(F.when(is_empty, e_missing).otherwise(F.concat(missing, more)))),
        }
    )


def resolve(rows: DataFrame, with_evidence: bool = True) -> DataFrame:
    """The whole chain: normalise, merge, mark, validate; adds status pending or verified and is_final (A4). Without evidence, rows are moved and sorted once for merging and
    marking."""
    events = normalise(rows)
    marked = mark_conflicts(merge_duplicates(events)) if with_evidence else _restored(_conflicts(_firsts(_keyed(events)))).select(*events.columns, "merged", "conflict_fields")
    return validate(marked).withColumn("status", F.when(F.size("issue_types") > 0, "pending").otherwise("verified")).withColumn("is_final", (F.col("status") == "verified") & is_final())


def data_source(files: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence labels of each merged row, in order, each once, joined (P10). events: not merged yet; a row takes its file's name along, so that nothing is put together twice."""
    named = events.join(files.select("file_id", "original_file_name"), "file_id", "left")
    labels = F.transform("evidence", lambda e: F.concat_ws(" ", e["original_file_name"], F.concat(F.lit("行"), e["row_no"])))
    said = F.array_distinct(F.filter(labels, lambda v: v != ""))
    return merge_duplicates(named, ("original_file_name",)).select("case_id", "event_id", F.array_join(said, "；").alias("data_source"))


def reconcile(holdings: DataFrame, trades: DataFrame) -> DataFrame:
    """Previous holding + signed trades since = this holding? (R1). holdings: account, security, day, quantity; trades:
    account, security, day, signed. Adds previous, moved, difference (null for an account's first holding)."""
    by = Window.partitionBy("account", "security").orderBy("day")
    spans = holdings.withColumn("from_day", F.lag("day").over(by)).withColumn("previous", F.lag("quantity").over(by))
    # one pass: trades and holdings in one order, running sums instead of a range join
    run = Window.partitionBy("account", "security").orderBy("day", "is_holding").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = trades.select("account", "security", "day", F.lit(0).alias("is_holding"), "signed").unionByName(spans.select("account", "security", "day", F.lit(1).alias("is_holding"), F.lit(0).cast("long").alias("signed"), "quantity", "previous"), True)
    summed = both.withColumn("total", F.sum("signed").over(run)).where("is_holding = 1")
    moved = summed.withColumn("moved", F.col("total") - F.lag("total").over(by))
    return moved.select("account", "security", "day", "quantity", "previous", F.when(F.col("previous").isNotNull(), F.col("moved")).alias("moved"), (F.col("previous") + F.col("moved") - F.col("quantity")).alias("difference"))
