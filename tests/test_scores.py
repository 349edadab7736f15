"""Scores, batches and helpers against plain loops."""

import collections
import random

from docketry import registry
from docketry.operators import batches as BA
from docketry.operators import boxes as B
from docketry.operators import metrics as M
from docketry.operators import sampling as SA
from docketry.plans import evaluation as E
from docketry.streaming import jobs as J

Q = registry.queries()


def credit(gt, pred, tr=0.7, tp=0.6, k=2, part=0.8):
    """Sums and matches of one image."""
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    both = lambda a, b: max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])) * max(0.0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
    half_up = lambda v: int(v * 100 + 0.5 + 1e-9) / 100
    sigma = [[half_up(both(g, d) / area(g)) for d in pred] for g in gt]
    tau = [[half_up(both(g, d) / area(d)) for d in pred] for g in gt]
    gs, ds, ones, split, merged, parts, whole = set(), set(), 0, 0, 0, 0, 0
    for i in range(len(gt)):
        s, t = [j for j in range(len(pred)) if sigma[i][j] > tr], [j for j in range(len(pred)) if tau[i][j] > tp]
        if len(s) == len(t) == 1 and sum(sigma[x][s[0]] > tr for x in range(len(gt))) == 1 and sum(tau[x][t[0]] > tp for x in range(len(gt))) == 1:
            ones += 1
            gs.add(i)
            ds.add(s[0])
    for i in range(len(gt)):
        if i not in gs and sum(x > 0 for x in sigma[i]) >= k:
            q = [j for j in range(len(pred)) if tau[i][j] >= tp and j not in ds]
            if len(q) == 1 and sigma[i][q[0]] >= tr:
                ones += 1
            elif len(q) > 1 and round(sum(sigma[i][j] for j in q), 6) >= tr:
                split, parts = split + 1, parts + len(q)
            else:
                continue
            gs.add(i)
            ds.update(q)
    for j in range(len(pred)):
        if j not in ds and sum(tau[i][j] > 0 for i in range(len(gt))) >= k:
            q = [i for i in range(len(gt)) if sigma[i][j] >= tp and i not in gs]
            if len(q) == 1 and tau[q[0]][j] >= tp and sigma[q[0]][j] >= tr:
                ones += 1
            elif len(q) > 1 and round(sum(tau[i][j] for i in q), 6) >= tp:
                merged, whole = merged + 1, whole + len(q)
            else:
                continue
            ds.add(j)
            gs.update(q)
    return ones, split, merged, ones + part * (split + whole), ones + part * (parts + merged)


def by_image(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["image_id"]].append(r)
    return {k: sorted(v, key=lambda r: r["box_id"]) for k, v in out.items()}


def check_credit(spark, gt, pred, row):
    g, p = by_image(gt), by_image(pred)
    sums = [credit(g[i], p.get(i, [])) for i in g]
    total = [sum(x[c] for x in sums) for c in range(5)]
    assert (row["one_to_one"], row["split"], row["merged"]) == tuple(total[:3])
    assert abs(row["recall_sum"] - total[3]) < 1e-3 and abs(row["precision_sum"] - total[4]) < 1e-3
    assert abs(row["recall"] - total[3] / gt.count()) < 1e-6 and abs(row["precision"] - total[4] / pred.count()) < 1e-6
    return total


def test_area_credit_of_the_tables(spark, sf_dir):
    gt, pred = E._all_gt(spark, sf_dir), E._split_and_joined(E._all_pred(spark, sf_dir))
    total = check_credit(spark, gt, pred, Q["a30_area_scores"](spark, sf_dir).first())
    assert total[0] > 100 and total[1] > 100


def test_area_credit_of_made_boxes(spark):
    r = random.Random(3)
    gt, pred = [], []
    for image in range(80):
        for k in range(r.randrange(1, 7)):
            x, y = r.randrange(0, 60, 5), r.randrange(0, 20, 10)
            gt.append((image, k, float(x), float(y), float(x + r.choice([10, 20, 40])), float(y + 10)))
        for k in range(r.randrange(0, 8)):
            x, y = r.randrange(0, 60, 5), r.randrange(0, 20, 10)
            pred.append((image, k, float(x), float(y), float(x + r.choice([5, 10, 20, 40])), float(y + 10)))
    box = "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double"
    g, p = spark.createDataFrame(gt, box), spark.createDataFrame(pred, box)
    total = check_credit(spark, g, p, B.area_credit(g, p).first())
    assert total[1] > 0 and total[2] > 0
    none = B.area_credit(g, p.where("box_id < 0")).first()
    assert (none["recall"], none["precision"], none["f"]) == (0.0, 0.0, 0.0)


def test_nearest_cell_looks_as_far_as_it_must(spark):
    r = random.Random(9)
    box = "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double"
    make = lambda n, span: [(i, k, float(x := r.randrange(span)), float(y := r.randrange(span)), float(x + r.randrange(1, 60)), float(y + r.randrange(1, 60))) for i in range(3) for k in range(n)]
    a, b = make(40, 9000), make(5, 9000)
    b = [x for x in b if x[0] != 2]  # an image without cells
    got = {(x["image_id"], x["a_box_id"]): x["b_box_id"] for x in B.nearest_by_corners(spark.createDataFrame(a, box), spark.createDataFrame(b, box)).collect()}
    want = {x[:2]: min((sum(abs(p - q) for p, q in zip(x[2:], y[2:], strict=True)), y[1]) for y in b if y[0] == x[0])[1] for x in a if x[0] != 2}
    assert got == want


def test_bleu_of_several_references(spark):
    pairs = [("the cat sat on the mat", ["the cat is on the mat", "a cat sat on a mat there"]), ("the the the the", ["the cat the", "x"]), ("", ["a b"]), ("one", ["one"])]
    counts = lambda t, n: collections.Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    matches = total = r = h = 0
    for p, refs in pairs:
        p, refs = p.split(), [x.split() for x in refs]
        r, h = r + min(map(len, refs)), h + len(p)
        for n in range(1, 5):
            most = collections.Counter()
            for x in refs:
                most |= counts(x, n)
            matches, total = matches + sum((counts(p, n) & most).values()), total + max(0, len(p) - n + 1)
    row = M.bleu(spark.createDataFrame(pairs, "pred string, refs array<string>")).first()
    assert (row["matches"], row["total"], row["r"], row["h"]) == (matches, total, r, h) and row["bleu"] == 0 < row["smooth"]
    assert M.bleu(spark.createDataFrame([("a b c d e", ["x a b c d", "a b c d e"])], "pred string, refs array<string>")).first()["bleu"] == 1
    assert M.bleu(spark.createDataFrame([("a b", ["c d"])], "pred string, refs array<string>")).first()["bleu"] == 0


def test_batches_are_padded_from_the_start(spark):
    for n in (0, 1, 5, 16, 23):
        rows = spark.createDataFrame([(i, float(i % 5)) for i in range(n)], "id long, ratio double")
        got = collections.defaultdict(list)
        for r in SA.bucket_batches(rows, "id", "ratio", [(4, 1), (2, 1)], 2, 12, 2).collect():
            got[r["replica"], r["batch"]].append((r["padded"], r["id"], r["batch_ratio"]))
        want, own = {}, n // 2
        for replica in range(2):
            ids, at, batch = list(range(n))[replica::2][:own], 0, 0
            while at < own:
                for size in (3, 6):
                    held = ids[at : at + size]
                    pads = ids[: size - len(held)]
                    mean = sum(i % 5 for i in held + pads) / len(held + pads)
                    want[replica, batch] = sorted([(False, i, min(mean, 2.0)) for i in held] + [(True, i, min(mean, 2.0)) for i in pads])
                    at, batch = at + size, batch + 1
        assert {k: sorted(v) for k, v in got.items()} == want


def test_numbers_and_values_go_on_over_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.randrange(10**6), r.choice([None, None, k])) for k in range(2000)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(4)
    numbered = collections.defaultdict(list)
    for x in sorted(BA.numbered_by(df, ["k"], ["o", "v"], "n").collect(), key=lambda x: x["n"]):
        numbered[x["k"]].append((x["o"], x["n"]))
    for k, v in numbered.items():
        assert v == [(o, i + 1) for i, o in enumerate(sorted(x[1] for x in rows if x[0] == k))]
    for k in ("hot", "b", None):
        last, want = None, []
        for _, o, v in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2] is not None, x[2] or 0)):
            last = v if v is not None else last
            want.append((o, last))
        got = [(x["o"], x["now"]) for x in sorted((x for x in BA.carried_last(df, ["k"], ["o", "v"], "v", "now").collect() if x["k"] == k), key=lambda x: (x["o"], x["v"] is not None, x["v"] or 0))]
        assert got == want


def test_a_poller_waits_longer_each_time():
    at = J.poll_offsets()
    assert at[:6] == [0, 3_000_000, 7_500_000, 14_250_000, 24_375_000, 39_375_000] and at[-1] == 600_000_000
    assert max(b - a for a, b in zip(at, at[1:], strict=False)) == 15_000_000


def test_streams_lose_nothing(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    tokens = [r["token"] for r in Q["x5_placeholders"](spark, sf_dir).collect()]
    assert len(tokens) == n == len(set(tokens)) and min(tokens) >= 0
    assert sum(r["n"] for r in Q["x3_epoch_metrics"](spark, sf_dir).collect()) == n
