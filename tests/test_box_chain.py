"""Queries that SQL can't say, on the whole small tables, against plain loops."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from docketry import registry
from docketry.operators import boxes as B
from docketry.operators import metrics as M
from docketry.plans import evaluation as E
from docketry.plans.fixtures import view

Q = registry.queries()


def by_image(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r["image_id"]].append(r.asDict())
    return {k: sorted(v, key=lambda b: b["box_id"]) for k, v in out.items()}


@pytest.fixture(scope="module")
def gt(spark, sf_dir):
    return by_image(E._all_gt(spark, sf_dir).collect())


@pytest.fixture(scope="module")
def pred(spark, sf_dir):
    return by_image(E._all_pred(spark, sf_dir).collect())


def area(b):
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def shared(a, b):
    return max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])) * max(0.0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))


def iou(a, b):
    i = shared(a, b)
    return i / (area(a) + area(b) - i)


def greedy(pairs):
    left, right, out = set(), set(), []
    for *_, a, b in sorted(pairs):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b))
    return out


def by_iou(gt, pred):
    """{(image, a, b)}: the most overlapping pair first, from 0.5 on."""
    found = set()
    for i in gt:
        pairs = [(-round(iou(a, b), 9), a["box_id"], b["box_id"]) for a in gt[i] for b in pred.get(i, []) if shared(a, b) > 0 and iou(a, b) >= 0.5]
        found |= {(i, a, b) for a, b in greedy(pairs)}
    return found


def by_truth(gt, pred):
    found = set()
    for i in gt:
        real = [a for a in gt[i] if not a["ignore"]]
        free = [b for b in pred.get(i, []) if not any(shared(a, b) / area(b) > 0.5 for a in gt[i] if a["ignore"])]
        found |= {(i, a, b) for a, b in greedy([(a["box_id"], b["box_id"]) for a in real for b in free if iou(a, b) > 0.5])}
    return found


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_matches(spark, sf_dir, gt, pred):
    assert {(r["image_id"], r["a_box_id"], r["b_box_id"]) for r in Q["j7_greedy_match"](spark, sf_dir).collect()} == by_iou(gt, pred)
    want = by_truth(gt, pred)
    assert {(r["image_id"], r["a_box_id"], r["b_box_id"]) for r in Q["j8_detection_match"](spark, sf_dir).collect()} == want
    r = Q["a28_detection_hmean"](spark, sf_dir).first()
    n, m = sum(not b["ignore"] for v in gt.values() for b in v), sum(map(len, pred.values()))
    assert (r["gt"], r["pred"], r["matched"]) == (n, m, len(want))
    assert r["hmean"] == pytest.approx(2 * len(want) / (n + m), abs=1e-6) and r["recall"] == pytest.approx(len(want) / n, abs=1e-6)


@pytest.mark.parametrize("query", ["a26_spotting", "a27_kie_scores"])
def test_end_to_end_scores(spark, sf_dir, gt, pred, query):
    if query.startswith("a27"):
        gt = {i: [b for b in v if b["text"] != "t0"] for i, v in gt.items()}
        pred = {i: [b for b in v if b["text"] != "t0"] for i, v in pred.items()}
    truth, told = ({(i, b["box_id"]): b for i, v in t.items() for b in v} for t in (gt, pred))
    matched = by_iou(gt, pred)
    counted = [(truth[i, a], told[i, b]) for i, a, b in matched if not truth[i, a]["ignore"]]
    free = [b for k, b in told.items() if k not in {(i, b) for i, _, b in matched}]
    hit, dt, n = sum(a["text"] == b["text"] for a, b in counted), len(counted) + len(free), sum(not b["ignore"] for b in truth.values())
    r = Q[query](spark, sf_dir).first()
    assert (r["hit"], r["dt"], r["gt"], r["edits"]) == (hit, dt, n, sum(edits(a["text"], b["text"]) for a, b in counted) + sum(len(b["text"]) for b in free))
    assert r["precision"] == pytest.approx(hit / dt, abs=1e-6) and r["recall"] == pytest.approx(hit / n, abs=1e-6) and r["f"] == pytest.approx(2 * hit / (dt + n), abs=1e-5)


def test_cascade(spark, sf_dir, gt, pred):
    want = set()
    for i, boxes in pred.items():
        for p in boxes:
            x, y = (p["x1"] + p["x2"]) / 2, (p["y1"] + p["y2"]) / 2
            inside = [c for c in gt[i] if shared(p, c) > 0 and c["x1"] <= x <= c["x2"] and c["y1"] <= y <= c["y2"]]
            met = [c for c in gt[i] if shared(p, c) > 0]
            if inside:
                want |= {(i, p["box_id"], c["box_id"], 1) for c in inside}
            elif met:
                want.add((i, p["box_id"], min(met, key=lambda c: (-round(iou(p, c), 9), c["box_id"]))["box_id"], 2))
            else:
                want.add((i, p["box_id"], None, 3))  # which cell is looked at below
    got = Q["j10_cascade"](spark, sf_dir).collect()
    assert {(r["image_id"], r["box_id"], r["cell_id"] if r["rule"] < 3 else None, r["rule"]) for r in got} == want
    nearest = B.prefixed(E._all_pred(spark, sf_dir), "a_", ["image_id"]).join(B.prefixed(E._all_gt(spark, sf_dir), "b_", ["image_id"]), "image_id")
    d = {(r["image_id"], r["a_box_id"], r["b_box_id"]): r["d"] for r in nearest.select("image_id", "a_box_id", "b_box_id", F.round(B.corner_distance("a_", "b_"), 6).alias("d")).collect()}
    for r in got:
        if r["rule"] == 3:
            assert (d[r["image_id"], r["box_id"], r["cell_id"]], r["cell_id"]) == min((d[r["image_id"], r["box_id"], c["box_id"]], c["box_id"]) for c in gt[r["image_id"]])


def components(n, pairs):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return [top(i) for i in range(n)]


def outer(boxes):
    return {"box_id": min(b["box_id"] for b in boxes), "x1": min(b["x1"] for b in boxes), "y1": min(b["y1"] for b in boxes), "x2": max(b["x2"] for b in boxes), "y2": max(b["y2"] for b in boxes)}


def key(image, b):
    return (image, b["box_id"], b["x1"], b["y1"], b["x2"], b["y2"])


def test_fragments_merge_to_the_fixpoint(spark, sf_dir, pred):
    want = set()
    for i, boxes in pred.items():
        now = boxes
        while True:
            pairs = [
                (j, k) for j, a in enumerate(now) for k, b in enumerate(now)
                if j < k and abs(a["y1"] - b["y1"]) <= 3 and abs(a["y2"] - b["y2"]) <= 3 and min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]) > -6 and min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]) > -6
            ]
            if not pairs:
                break
            groups = collections.defaultdict(list)
            for b, c in zip(now, components(len(now), pairs), strict=True):
                groups[c].append(b)
            now = [outer(g) for g in groups.values()]
        want |= {key(i, b) for b in now}
    assert {key(r["image_id"], r) for r in Q["w20_merge_fragments"](spark, sf_dir).collect()} == want


def test_token_edits_of_lines(spark, sf_dir):
    pairs = {(r["doc_id"], r["n"]): (r["gt"].split(" "), r["pred"].split(" ")) for r in view(spark, sf_dir, "text_pairs").where("length(gt) < 2000").collect()}
    got = {(r["doc_id"], r["n"]): (r["n_gt"], r["n_pred"], r["edits"]) for r in Q["a23_token_edits"](spark, sf_dir).collect()}
    assert set(pairs) <= set(got)
    for k in random.Random(1).sample(sorted(pairs), 300):
        g, p = pairs[k]
        assert got[k] == (len(g), len(p), edits(g, p))


def test_token_edits_of_many_tokens(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    r = M.token_edits(spark.createDataFrame([(1, 0, long, "t0 x t59999")], "doc_id long, n int, gt string, pred string")).first()
    assert (r["n_gt"], r["n_pred"], r["edits"]) == (60_000, 3, 59_998)


def test_regions_that_touch(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, "a"), (1, 2, 20.0, 0.0, 30.0, 10.0, "b"), (1, 3, 11.0, 11.0, 12.0, 12.0, "c"), (2, 1, 0.0, 0.0, 9.0, 9.0, "d")], "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double, text string")
    regions = spark.createDataFrame([(1, 7, 10.0, 5.0, 20.0, 6.0), (1, 8, 500.0, 500.0, 501.0, 501.0)], "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in B.region_text(boxes, regions).collect()] == [(1, 7, 2, "a b")]
