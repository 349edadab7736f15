"""Chapters, boxes, suppression and matching on small inputs, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from docketry.functions import columns as C
from docketry.operators import boxes as B
from docketry.operators import corpus as O
from docketry.operators import metrics as M


@pytest.mark.parametrize(
    "line, number",
    [("Chapter 5", 5), ("chapter 6 explores the sea", None), ("II. The Carpet-Bag", 2), ("IIII: Wrong", None), ("I", None), ("1. item", None), ("In 1999 we", None), ("Capítulo 5: El mar", 5), ("Chapter 12: " + "x" * 90, None), ("CC. Last", 200)],
)
def test_chapter_numbers(spark, line, number):
    assert spark.createDataFrame([(line,)], "t string").select(O.chapter_no(F.col("t")).alias("n")).first()["n"] == number


def test_dates_and_widths(spark):
    d = spark.createDataFrame([("2021/3/9",), ("2021.3",)], "t string").select(C.iso_date("t").alias("d")).collect()
    assert [r["d"] for r in d] == ["2021-03-09", "2021-3"]
    assert spark.createDataFrame([("ＡＢ１　x",)], "t string").select(C.half_width("t").alias("d")).first()["d"] == "AB1 x"


def boxes(seed, images=3, n=14):
    r = random.Random(seed)
    return [(i, b, x := float(r.randrange(0, 300)), y := float(r.randrange(0, 200)), x + r.randrange(20, 120), y + r.randrange(20, 80), round(r.random(), 3)) for i in range(images) for b in range(n)]


SCHEMA = "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double, score double"


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    i = max(0.0, w) * max(0.0, h)
    return i / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - i)


def test_suppression_is_the_greedy_loop(spark):
    data, want = boxes(1), set()
    for i in range(3):
        kept = []
        for b in sorted((b for b in data if b[0] == i), key=lambda b: (-b[6], b[1])):
            if all(iou(b, k) <= 0.3 for k in kept):
                kept.append(b)
        want |= {(b[0], b[1]) for b in kept}
    got = {(r["image_id"], r["box_id"]) for r in B.suppress(spark.createDataFrame(data, SCHEMA), 0.3).collect()}
    assert got == want


def test_matching_is_the_greedy_loop(spark):
    gt, pred, want = boxes(2), boxes(3), set()
    for i in range(3):
        pairs = sorted(((-round(iou(a, b), 9), a[1], b[1]) for a in gt for b in pred if a[0] == b[0] == i and iou(a, b) >= 0.1))
        left, right = set(), set()
        for _, a, b in pairs:
            if a not in left and b not in right:
                left.add(a), right.add(b)
                want.add((i, a, b))
    pairs = B.pairs_over(spark.createDataFrame(gt, SCHEMA), spark.createDataFrame(pred, SCHEMA), 0.1).withColumn("iou", F.round("iou", 9))
    got = B.greedy_match(pairs, [F.desc("iou"), F.col("a_box_id"), F.col("b_box_id")])
    assert {(r["image_id"], r["a_box_id"], r["b_box_id"]) for r in got.collect()} == want


def test_components_close_over_chains(spark):
    links = spark.createDataFrame([(0, i, i + 1) for i in range(20)] + [(0, 50, 51), (1, 3, 4)], "k long, a long, b long")
    got = {(r["k"], r["id"]): r["component"] for r in B.components(links, ["k"]).collect()}
    assert all(got[(0, i)] == 0 for i in range(21)) and got[(0, 51)] == 50 and got[(1, 4)] == 3


def test_token_edits_count_tokens(spark):
    r = M.token_edits(spark.createDataFrame([(1, 0, "a bb c d", "a c d e")], "doc_id long, n int, gt string, pred string")).first()
    assert r["edits"] == 2
