"""Record resolution on hand-made rows."""

from pyspark.sql import functions as F

from docketry.operators import files as FO
from docketry.operators import ledger as L

COLS = "src_ord long, ln int, case_id string, file_id string, event_id string, account_type string, securities_account string, event_type string, event_date string, security_code string, security_name string, direction string, quantity_raw string, price_raw string, amount_raw string, balance_after_raw string, transfer_type_raw string"


def rows(spark, *over):
    base = dict(src_ord=1, ln=1, case_id="c", file_id="f1", event_id="e1", account_type="A", securities_account="A1", event_type="ordinary_trade", event_date="2020-01-01", security_code="S", security_name="N", direction="buy", quantity_raw="10", price_raw="", amount_raw="", balance_after_raw="", transfer_type_raw="")
    return spark.createDataFrame([tuple((base | o)[c.split()[0]] for c in COLS.split(", ")) for o in over], COLS)


def test_exact_duplicates_merge_with_evidence(spark):
    out = L.resolve(rows(spark, {}, {"src_ord": 2, "event_id": "e2", "file_id": "f2"})).collect()
    assert len(out) == 1 and out[0]["event_id"] == "e1" and out[0]["merged"] == 2
    assert [e["source_row_id"] for e in out[0]["evidence"]] == ["e1", "e2"]


def test_cases_are_apart(spark):
    assert L.resolve(rows(spark, {}, {"src_ord": 2, "case_id": "d"})).count() == 2


def test_conflict_flags_every_row(spark):
    out = L.resolve(rows(spark, {}, {"src_ord": 2, "quantity_raw": "11"})).collect()
    assert [r["status"] for r in out] == ["pending"] * 2 and all(r["conflict_fields"] == ["quantity_raw"] for r in out)


def test_white_space_counts_as_a_value(spark):
    out = L.resolve(rows(spark, {"price_raw": "5"}, {"src_ord": 2, "price_raw": " "})).collect()
    assert all(r["conflict_fields"] == ["price_raw"] for r in out)


def test_blank_keys_do_not_merge(spark):
    empty = {c: "" for c in L.EXACT_KEY}
    out = L.merge_duplicates(rows(spark, empty, {"src_ord": 2} | empty))
    assert out.count() == 2


def test_unknown_event_is_one_issue(spark):
    r = L.resolve(rows(spark, {"event_type": "", "transfer_type_raw": "x"})).first()
    assert r["event_type"] == "unknown_event" and "unknown_event_type" in r["issue_types"] and not r["is_final"]


def test_transfer_words_exclude_whatever_the_direction(spark):
    r = L.normalise(rows(spark, {"transfer_type_raw": "转入", "direction": "transfer_in"})).select(L.is_final().alias("x")).first()
    assert r["x"] is False


def test_empty_record_needs_account_and_date(spark):
    r = L.resolve(rows(spark, {"event_type": "no_trade_record", "securities_account": "", "event_date": ""})).first()
    assert r["issue_types"] == ["empty_record_account_missing", "empty_record_period_missing"]


def test_resolution_is_idempotent_and_ignores_partitioning(spark):
    r = rows(spark, *[{"src_ord": i, "event_id": f"e{i}", "quantity_raw": str(i % 3)} for i in range(30)])
    once = L.merge_duplicates(L.normalise(r))
    again = L.merge_duplicates(L.normalise(once.drop("merged", "evidence").repartition(5)))
    assert sorted(x["event_id"] for x in once.collect()) == sorted(x["event_id"] for x in again.collect())


def test_empty_files_get_a_zero_row(spark):
    files = spark.createDataFrame([("a", "未开户"), ("b", "共0条 成交日期"), ("c", "我的持仓 暂无持仓"), ("d", "text"), ("e", "未开户")], "file_id string, text string")
    have = spark.createDataFrame([("e",)], "file_id string")
    got = {r["file_id"]: r["event_type"] for r in FO.empty_records(files, have).collect()}
    assert got == {"a": "no_account_record", "b": "no_trade_record", "c": "no_holding_record"}


def test_nulls_are_blank(spark):
    r = rows(spark, {"direction": None, "price_raw": None, "event_type": None, "transfer_type_raw": None})
    assert L.resolve(r).first()["event_type"] == "unknown_event"
    assert L.resolve(r.where(F.lit(False))).count() == 0
