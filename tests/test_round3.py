"""Tables row by row, limits on shares, bounds of edit distances, pages of many lines."""

import random
import re

from pyspark.sql import functions as F

from docketry.functions import columns as C
from docketry.operators import files as FO
from docketry.operators import layout as L
from docketry.operators import metrics as M
from docketry.plans import layout as PY
from docketry.plans import ledger as PL
from docketry.plans import sources as PS
from docketry.sources import records as S


def test_tables_stand_row_by_row(spark, sf_dir):
    rows = [("a", 0, ["no", "x"]), ("a", 5, ["1", "p"]), ("a", 7, ["", " "]), ("a", 9, ["2"]), ("b", 3, ["no", "x"]), ("c", 2, ["x"]), ("c", 4, ["q"])]
    flat = S.flatten_rows(spark.createDataFrame(rows, "file_id string, i long, cells array<string>"))
    assert sorted(tuple(r) for r in S.bind(flat, ["x", "y"]).collect()) == [("a", 5, "p", ""), ("a", 9, "", ""), ("c", 4, "q", "")]
    assert "collect_list" not in PS.s6(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_flattened_rows_do_not_carry_their_table(spark):
    tables = spark.createDataFrame([("a", [["no", "x"], ["1", "p"], ["2", "q"]])], "file_id string, rows array<array<string>>")
    flat = S.bind(S.flatten_tables(tables), ["x"])
    assert sorted(tuple(r) for r in flat.collect()) == [("a", 0, "p"), ("a", 1, "q")]
    generate = [x for x in flat._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]
    assert re.search(r"posexplode\(.*\), \[\d+\], false", generate[0]), generate  # the array is left behind


def test_issues_name_their_own_file(spark, monkeypatch):
    evidence = [("f1", "e1", "1"), ("f2", "e9", "2")]
    resolved = spark.createDataFrame([("c", "e1", "pending", "f1", evidence)], "case_id string, event_id string, status string, file_id string, evidence array<struct<file_id string, source_row_id string, row_no string>>")
    monkeypatch.setattr(PL, "_resolved", lambda s, d: resolved)
    monkeypatch.setattr(PL, "view", lambda s, d, n: spark.createDataFrame([("f1",), ("f2",)], "file_id string"))
    assert [tuple(r) for r in PL.j4(spark, "").collect()] == [("c", "e1", "f1")]
    assert FO.issue_files(spark.createDataFrame([("c", "e", ["f1", "f2"], "f3")], "case_id string, event_id string, file_ids array<string>, file_id string"), PL.view(spark, "", "files")).count() == 2


def test_a_table_at_the_limit_of_crossed_places_counts(spark):
    """60 rows of 3 columns, 63 of 180 places crossed: .35 exactly."""
    cells = []
    for n in range(60):
        ends = [90.0, 190.0 if n < 3 else 120.0, 250.0]
        cells += [(1, 1, n, x, end, 800.0 - 12 * n, 10.0, "t") for x, end in zip((0.0, 100.0, 200.0), ends, strict=True)]
    found = L.tables(spark.createDataFrame(cells, "doc_id long, page long, line_no long, x1 double, x2 double, y double, h double, text string"))
    assert [(r["n_rows"], r["columns"]) for r in found.collect()] == [(60, 3)]


def test_edits_are_those_of_levenshtein(spark):
    r = random.Random(3)
    rows = []
    for _ in range(300):
        a = "".join(r.choice("abcdeé漢\U0001f600 ") for _ in range(r.randrange(0, 120)))
        b = list(a)
        for _ in range(r.choice([0, 1, 2, 10, 60])):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choice(["", "e", "3", "xy"])
        rows.append((a, r.choice(["".join(b), a.replace("e", "3"), a[:-1], a[5:], a[::-1]])))
    rows += [(None, "a"), ("", "b" * 70), ("ab" * 50, "ba" * 50), ("".join(chr(0x4E00 + i) for i in range(90)), "".join(chr(0x4E05 + i) for i in range(90)))]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", C.edits("a", "b", 10).alias("e"), F.levenshtein("a", "b").alias("l")).collect()
    assert [x for x in got if x["e"] != x["l"]] == []
    tokens = M.token_edits(spark.createDataFrame([(1, 0, "a b a c", "a a c"), (2, 0, "", "x y"), (3, 0, "q q", "q q"), (4, 0, None, "z")], "doc_id long, n int, gt string, pred string"))
    assert sorted(tuple(x) for x in tokens.collect()) == [(1, 0, 4, 3, 1), (2, 0, 1, 2, 2), (3, 0, 2, 2, 0), (4, 0, 0, 1, 1)]
    assert "Window" not in tokens._jdf.queryExecution().optimizedPlan().toString()


def test_sums_before(spark):
    df = spark.createDataFrame([([],), ([4],), (list(range(200)),)], "v array<long>").select("v", C.sums_before(F.col("v"), 8).alias("s"))
    assert [r["s"] for r in df.collect()] == [[sum(r["v"][:i]) for i in range(len(r["v"]))] for r in df.collect()]


def test_blocks_of_lines_in_any_order(spark):
    """Lines side by side and under each other, so that runs are put together, against all pairs in a loop; and no word is moved for set lines."""
    r = random.Random(8)
    rows = [(1, p, i, 0, float(r.randrange(0, 400)), float(r.randrange(0, 700)), float(r.randrange(20, 150)), r.choice([8.0, 10.0, 18.0])) for p in range(6) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, page long, row long, part int, x1 double, y double, w double, h double").withColumn("x2", F.col("x1") + F.col("w"))
    got = sorted((b["page"], b["n_lines"], b["x1"], b["y1"], b["x2"], b["y2"], b["box_id"]) for b in L.blocks(df).collect())

    def meets(a, b):
        height, gap, shared = b[3] - b[1], b[1] - a[3], min(a[2], b[2]) - max(a[0], b[0])
        reach = (gap < 0 and a[1] < b[3]) or (-0.5 * height <= gap < 2.5 * height)
        return reach and (shared > 0.3 * min(a[2] - a[0], b[2] - b[0]) or (abs(a[0] - b[0]) < 20 and abs(a[2] - b[2]) < 20))

    want = []
    for page in range(6):
        ls = sorted((-y, i << 20, x, x + w, h - y) for _, p, i, _, x, y, w, h in rows if p == page)
        ls = [(x1, y1, x2, y2, i) for y1, i, x1, x2, y2 in ls]
        name = list(range(len(ls)))
        for j, b in enumerate(ls):
            for a_no, a in enumerate(ls[:j]):
                if meets(a, b):
                    name = [name[a_no] if n == name[j] else n for n in name]
        for n in set(name):
            g = [x for x, m in zip(ls, name, strict=True) if m == n]
            want.append((page, len(g), min(x[0] for x in g), min(x[1] for x in g), max(x[2] for x in g), max(x[3] for x in g), min(x[4] for x in g)))
    assert got == sorted(want) and len(want) < len(rows)


def test_set_lines_move_no_words(spark, sf_dir):
    plan = PY.set_lines(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan
