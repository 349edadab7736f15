"""What queries move and read, told by their plans, beside the values that test_oracles compares."""

import re

import pytest

from docketry import registry

Q = registry.queries()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def scans(df):
    return len(re.findall(r"FileScan parquet", plan(df)[1]))


@pytest.mark.parametrize("query", ["f10_margin_filter", "p22_a41_garbage_pages"])
def test_words_are_read_once_and_not_windowed(spark, sf_dir, query):
    """Words were numbered by a window over all of them, and read twice for their fonts."""
    df = Q[query](spark, sf_dir)
    assert "Window" not in plan(df)[0] and scans(df) == 1


def test_a_score_looks_once_at_a_plain_word(spark):
    """F8: every word was cleaned for each of some twenty patterns."""
    from docketry.operators import layout as L

    df = spark.createDataFrame([("plain",), ("a⠿",), ("",), ("a⠿漢b",), (None,), ("　",), ("",)], "str string").select("str", L.gibberish().alias("s"))
    assert [r["s"] if r["s"] is None else round(r["s"], 6) for r in df.collect()] == [0.0, 0.6, 1.0, 1.0, None, 0.0, 0.0]
    assert plan(df)[0].count("regexp_replace") == 1


def exchanges(df):
    return plan(df)[1].count("Join"), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ledger_rows_join_their_tables_once(spark, sf_dir):
    """the three parts of the union each joined lines and orders."""
    from docketry.plans.fixtures import view

    assert exchanges(view(spark, sf_dir, "ledger_rows"))[0] == 1


def test_merging_and_marking_share_a_shuffle(spark, sf_dir):
    """rows were moved for merging and again for marking conflicts."""
    from docketry.operators import ledger as L

    rows = spark.createDataFrame([("c", 1, "f", "e1", 1, " A ", "A", "t", "2020-01-01", "S", "N", "buy", "1", "", "", ""), ("c", 2, "f", "e2", 2, "A", "A", "t", "2020-01-01", "S", "N", "buy", "1", "", "", ""), ("c", 3, "f", "e3", 3, "A", "A", "t", "2020-01-01", "S", "N", "buy", "2", "", "", "")],
        "case_id string, src_ord long, file_id string, event_id string, ln int, securities_account string, account_type string, event_type string, event_date string, security_code string, security_name string, direction string, quantity_raw string, price_raw string, amount_raw string, balance_after_raw string")
    rows = rows.withColumn("transfer_type_raw", rows.price_raw)
    out = L.resolve(rows, with_evidence=False)
    assert exchanges(out)[1] == 1
    assert [(r["event_id"], r["securities_account"], r["merged"], list(r["conflict_fields"])) for r in out.orderBy("src_ord").collect()] == [("e1", " A ", 2, ["quantity_raw"]), ("e3", "A", 1, ["quantity_raw"])]
    once = L.merge_duplicates(rows)
    assert exchanges(once)[1] == 1
    assert [(r["event_id"], r["securities_account"], [e["row_no"] for e in r["evidence"]]) for r in once.orderBy("src_ord").collect()] == [("e1", " A ", ["1", "2"]), ("e3", "A", ["3"])]


def test_file_summary_gathers_no_file(spark):
    """all issues of a file were one list."""
    from docketry.operators import files as FO

    df = FO.file_summary(spark.createDataFrame([("f", 1, i, f"n{i}") for i in range(5)] + [("g", 2, 1, "m")], "file_id string, severity int, ord long, name string"))
    assert sorted(tuple(r) for r in df.collect()) == [("f", 0, 5, "n0、n1、n2等"), ("g", 1, 0, "m")]
    assert "<= 3" in plan(df)[0]


def test_a_round_of_matching_is_stored_once(spark, monkeypatch):
    """each round stored what it took and what it left apart, and joined both."""
    from docketry.operators import boxes as B

    stored = []
    whole = B.cut
    monkeypatch.setattr(B, "cut", lambda df, name="rounds": stored.append(name) or whole(df, name))
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.7), (1, 2, 2, 0.6), (2, 1, 1, 0.5)], "image_id long, a_box_id long, b_box_id long, iou double")
    import pyspark.sql.functions as F

    got = B.greedy_match(pairs, [F.desc("iou"), F.col("a_box_id"), F.col("b_box_id")])
    assert sorted((r["image_id"], r["a_box_id"], r["b_box_id"]) for r in got.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]
    assert len(stored) == 2


def test_cascade_pairs_boxes_once(spark, monkeypatch):
    """pairs were worked out for each rule."""
    from docketry.operators import boxes as B

    met = []
    whole = B.overlapping
    monkeypatch.setattr(B, "overlapping", lambda *a: met.append(1) or whole(*a))
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 8.0, 0.0, 30.0, 10.0), (1, 3, 500.0, 0.0, 510.0, 10.0)], "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double")
    cells = boxes.where("box_id = 1")
    got = B.cascade(boxes, cells)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, 1), (1, 2, 1, 2), (1, 3, 1, 3)]
    assert len(met) == 1 and "Join" not in plan(got)[0]


def test_cells_of_a_line_are_counted_in_its_row(spark, sf_dir):
    """a line's words were put in lists by a shuffle to be counted."""
    from docketry.operators import layout as L

    rows = spark.createDataFrame([(1, 1, 0, 10.0, [(0.0, 20.0), (40.0, 5.0), (24.0, 3.0), (25.0, 30.0)])], "doc_id long, page long, line_no long, h double, ws array<struct<x double, w double>>")
    assert L.cell_counts(rows, 0.5).first()["cells"] == 1 and L.cell_counts(rows, 0.4).first()["cells"] == 2
    assert "Exchange" not in Q["w8_cells"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_page_classes_read_words_once(spark, sf_dir):
    """words were worked out for the pages, for their edges, for those with enough words and for the coverage."""
    df = Q["w17_page_classes"](spark, sf_dir)
    assert scans(df) == 1 and exchanges(df) == (0, 1)


def test_tables_work_their_cells_out_once(spark, sf_dir):
    """the words were read and put together anew for lines, blocks and columns."""
    df = Q["j14_continued_tables"](spark, sf_dir)
    assert "documents.parquet" not in plan(df)[1] and "Generate" not in plan(df)[1]
