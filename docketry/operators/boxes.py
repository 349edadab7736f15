"""Boxes of images: pairing, matching, suppression, merging, ordering. Axis-aligned rectangles x1 y1 x2 y2.

Pairs meet inside one image only. Images hold up to some thousands of boxes; pairing goes through grid cells, so
boxes far apart never meet. Rounds end when nothing is left to decide and fail loudly at a cap.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.columns import area, corner_distance, iou, let, overlap

CELL = 128.0
ROUNDS = 100


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one in local mode, which has no other
    executors, and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/docketry-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "rounds") -> DataFrame:
    """df written to the shared folder and read again: rounds restart from files when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prefixed(df: DataFrame, p: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(p + c) for c in df.columns if c not in keep])


def cells(df: DataFrame, p: str, size: float = CELL) -> DataFrame:
    """df with a row for each grid cell that its box touches."""
    cx = F.explode(F.sequence(F.floor(F.col(f"{p}x1") / size), F.floor(F.col(f"{p}x2") / size))).alias("cx")
    cy = F.explode(F.sequence(F.floor(F.col(f"{p}y1") / size), F.floor(F.col(f"{p}y2") / size))).alias("cy")
    return df.select("*", cx).select("*", cy)


def overlapping(a: DataFrame, b: DataFrame, size: float = CELL) -> DataFrame:
    """Pairs of boxes of one image that overlap (columns a_*, b_*), each once: in the cell that holds the corner of
    their intersection."""
    left, right = cells(prefixed(a, "a_", ["image_id"]), "a_", size), cells(prefixed(b, "b_", ["image_id"]), "b_", size)
    met = left.join(right, ["image_id", "cx", "cy"])
    home = (F.col("cx") == F.floor(F.greatest("a_x1", "b_x1") / size)) & (F.col("cy") == F.floor(F.greatest("a_y1", "b_y1") / size))
    return met.where(home & (overlap("a_", "b_") > 0)).drop("cx", "cy")


def pairs_over(gt: DataFrame, pred: DataFrame, least: float, eps: float = 0.0) -> DataFrame:
    """Pairs with IoU of `least` or more."""
    return overlapping(gt, pred).withColumn("iou", iou("a_", "b_", eps)).where(F.col("iou") >= least)


def greedy_match(pairs: DataFrame, order: list[Column], keys: tuple[str, str] = ("a_box_id", "b_box_id")) -> DataFrame:
    """One-to-one matching, the first pair in a total order first (J7, J8). Each round takes the pairs that come
    first for both their sides and drops what they touch: just what the loop over all pairs takes."""
    left, taken = pairs, None
    a, b = keys
    for _ in range(ROUNDS):
        # an image's pairs stand together, so that its windows move nothing more; a round is stored once, with what it takes and what it leaves
        by_a, by_b = Window.partitionBy("image_id", a), Window.partitionBy("image_id", b)
        ranked = left.repartition("image_id").withColumn("__ra", F.row_number().over(by_a.orderBy(*order))).withColumn("__rb", F.row_number().over(by_b.orderBy(*order)))
        best = ranked.withColumn("__best", (F.col("__ra") == 1) & (F.col("__rb") == 1)).drop("__ra", "__rb")
        told = best.withColumn("__a", F.max("__best").over(by_a)).withColumn("__b", F.max("__best").over(by_b))
        now = cut(told.where("__best or not (__a or __b)").drop("__a", "__b"), "match")
        found, left = now.where("__best").drop("__best"), now.where("not __best").drop("__best")
        taken = found if taken is None else taken.unionByName(found)
        if left.isEmpty():
            return taken
    raise RuntimeError(f"matching did not end in {ROUNDS} rounds")


def suppress(boxes: DataFrame, most_iou: float = 0.5, top: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Boxes that greedy suppression by falling score keeps (T4 with top, T5 without). A box is dropped when a
    kept one before it overlaps too much, kept when all such ones before it are dropped; rounds decide all
    boxes whose turn has come, in every image at once."""
    keys = by or ["image_id"]
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "box_id")
    ranked = boxes.withColumn("rank", F.row_number().over(order))
    ranked = cut(ranked.where(F.col("rank") <= top) if top else ranked, "nms")
    edges = overlapping(ranked, ranked).where("b_rank < a_rank").withColumn("iou", iou("a_", "b_")).where(F.col("iou") > most_iou)
    for k in keys:
        if k != "image_id":
            edges = edges.where(F.col(f"a_{k}") == F.col(f"b_{k}"))
    edges = cut(edges.select("image_id", "a_box_id", "b_box_id"), "nms")
    state = cut(ranked.select("image_id", "box_id", F.lit(None).cast("boolean").alias("kept")), "nms")
    for _ in range(ROUNDS):
        if state.where("kept is null").isEmpty():
            return boxes.join(state.where("kept").select("image_id", "box_id"), ["image_id", "box_id"], "left_semi")
        before = edges.join(state.select("image_id", F.col("box_id").alias("b_box_id"), F.col("kept").alias("k")), ["image_id", "b_box_id"])
        seen = before.groupBy("image_id", F.col("a_box_id").alias("box_id")).agg(F.bool_or(F.coalesce("k", F.lit(False))).alias("beaten"), F.bool_or(F.col("k").isNull()).alias("waits"))
        now = state.join(seen, ["image_id", "box_id"], "left")
        verdict = F.when(F.col("beaten"), False).when(~F.coalesce("waits", F.lit(False)), True)
        state = cut(now.select("image_id", "box_id", F.coalesce("kept", verdict).alias("kept")), "nms")
    raise RuntimeError(f"suppression did not end in {ROUNDS} rounds")


def nearest_by_corners(boxes: DataFrame, cells_: DataFrame, size: float = CELL) -> DataFrame:
    """For each box the cell of its image with the least corner distance, the first of equals: image_id, a_box_id, b_box_id.

    A grid over upper left corners is looked at round each box, three squares by three, on squares of twice the size each round, until the best found is nearer than anything outside can be: a
    cell beyond the nine squares is over a square's size away by its corner alone. So a box only ever meets the cells round it.
    """
    left = cut(prefixed(boxes, "a_", ["image_id"]).join(cells_.select("image_id").distinct(), "image_id", "left_semi"), "nearest")
    right = prefixed(cells_, "b_", ["image_id"])
    out = None
    while not left.isEmpty():
        at = lambda c: F.floor(F.col(c) / size)  # noqa: B023, E731
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        asks = left.withColumn("dx", around).withColumn("dy", around).withColumns({"cx": at("a_x1") + F.col("dx"), "cy": at("a_y1") + F.col("dy")})
        met = asks.join(right.withColumns({"cx": at("b_x1"), "cy": at("b_y1")}), ["image_id", "cx", "cy"])
        best = F.min(F.struct(F.round(corner_distance("a_", "b_"), 6).alias("d"), "b_box_id"))
        found = cut(met.groupBy("image_id", "a_box_id").agg(best.alias("m")).where(F.col("m.d") < size - 1e-5).select("image_id", "a_box_id", "m.b_box_id"), "nearest")
        out = found if out is None else out.unionByName(found)
        left = cut(left.join(found, ["image_id", "a_box_id"], "left_anti"), "nearest")
        size *= 2
        if size > 1e15:
            raise RuntimeError("boxes without finite corners have no nearest cell")
    return out if out is not None else left.join(right, "image_id").select("image_id", "a_box_id", "b_box_id")


def nearest_cell(boxes: DataFrame, cells_: DataFrame) -> DataFrame:
    """Each box to the cell of its image with least (1 - IoU, corner distance), the first of equals (J9). Boxes that overlap a cell choose among those; the others by distance."""
    met = overlapping(boxes, cells_)
    best = F.min_by("b_box_id", F.struct(F.round(1 - iou("a_", "b_"), 9), F.round(corner_distance("a_", "b_"), 6), "b_box_id"))
    over = cut(met.where(F.round(1 - iou("a_", "b_"), 9) < 1).groupBy("image_id", F.col("a_box_id").alias("box_id")).agg(best.alias("cell_id")), "nearest")
    far = nearest_by_corners(boxes.join(over, ["image_id", "box_id"], "left_anti"), cells_)
    return over.unionByName(far.select("image_id", F.col("a_box_id").alias("box_id"), F.col("b_box_id").alias("cell_id")))


def cascade(boxes: DataFrame, cells_: DataFrame) -> DataFrame:
    """Boxes to cells by three rules (J10): centre inside; else best IoU over 0 (plain IoU); else nearest."""
    cx, cy = (F.col("a_x1") + F.col("a_x2")) / 2, (F.col("a_y1") + F.col("a_y2")) / 2
    sides = ["image_id", "box_id", "x1", "y1", "x2", "y2"]
    within = cx.between(F.col("b_x1"), F.col("b_x2")) & cy.between(F.col("b_y1"), F.col("b_y2"))
    met = overlapping(boxes.select(*sides), cells_.select(*sides)).select("image_id", "a_box_id", "b_box_id", F.round(iou("a_", "b_"), 9).alias("iou"), within.alias("inside"))
    mine = Window.partitionBy("image_id", "a_box_id")
    ranked = met.withColumns({"any": F.max("inside").over(mine), "rn": F.row_number().over(mine.orderBy(F.desc("iou"), "b_box_id"))})
    decided = cut(ranked.where("inside or (not any and rn = 1)").select("image_id", "a_box_id", "b_box_id", F.when(F.col("inside"), 1).otherwise(2).alias("rule")), "cascade")
    rest = boxes.select(*sides).join(decided.select("image_id", F.col("a_box_id").alias("box_id")), ["image_id", "box_id"], "left_anti")
    last = nearest_by_corners(rest, cells_.select(*sides)).withColumn("rule", F.lit(3))
    return decided.union(last.select(*decided.columns)).select("image_id", F.col("a_box_id").alias("box_id"), F.col("b_box_id").alias("cell_id"), "rule")


def rows_of(boxes: DataFrame, gap: float, y: str = "y1") -> DataFrame:
    """Adds row: a new one starts where y grows by `gap` or more over the box before (islands)."""
    by = Window.partitionBy("image_id").orderBy(y, "x1", "box_id")
    new = (F.col(y) - F.lag(y).over(by) >= gap).cast("int")
    return boxes.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn("row", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def reading_order(boxes: DataFrame, gap: float = 10.0) -> DataFrame:
    """Place of each box by row and x."""
    return rows_of(boxes, gap).withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("row", "x1", "y1", "box_id")))


def two_columns(boxes: DataFrame, width: float) -> DataFrame:
    """Layout order of two-column pages (T2): boxes that are neither left nor right end a group; in a group the left
    ones come before the right ones."""
    left = (F.col("x1") < width / 4) & (F.col("x2") < 3 * width / 5)
    right = F.col("x1") > 2 * width / 5
    side = F.when(left, 0).when(right, 1).otherwise(2)
    by = Window.partitionBy("image_id").orderBy("y1", "x1", "box_id")
    flush = F.count_if(F.col("side") == 2).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    grouped = boxes.withColumn("side", side).withColumn("grp", flush)
    first = F.when(F.col("side") == 2, -1).otherwise(F.col("side"))
    return grouped.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("grp", first, "y1", "x1", "box_id")))


def components(links: DataFrame, keys: list[str]) -> DataFrame:
    """Connected components of links (keys, a, b) by least label and pointer jumping (T7): keys, id, component."""
    edges = cut(links.select(*keys, "a", "b").union(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc")
    state = cut(edges.groupBy(*keys, "a").agg(F.least(F.col("a"), F.min("b")).alias("c")), "cc")
    for _ in range(ROUNDS):
        near = edges.join(state.withColumnsRenamed({"a": "b", "c": "cb"}), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("cb").alias("cb"))
        low = state.join(near, [*keys, "a"]).select(*keys, "a", F.least("c", "cb").alias("n"), F.col("c").alias("old"))
        new = cut(low.join(state.withColumnsRenamed({"a": "n", "c": "cn"}), [*keys, "n"]).select(*keys, "a", F.least("n", "cn").alias("c"), "old"), "cc")
        state = new.select(*keys, "a", "c")
        if new.where("c <> old").isEmpty():
            return state.select(*keys, F.col("a").alias("id"), F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def merge_fragments(boxes: DataFrame, near: float = 3.0) -> DataFrame:
    """Boxes whose y edges agree within `near` and that touch in x become one, to the fixpoint (W20): the components of
    mergeable pairs, and their outer boxes, again until no pair is left."""
    now = boxes.select("image_id", "box_id", "x1", "y1", "x2", "y2")
    for _ in range(ROUNDS):
        wide = now.withColumns({c: F.col(c) + d for c, d in (("x1", -near), ("x2", near), ("y1", -near), ("y2", near))})
        pairs = overlapping(wide, wide).where((F.col("a_box_id") < F.col("b_box_id")) & (F.abs(F.col("a_y1") - F.col("b_y1")) <= near) & (F.abs(F.col("a_y2") - F.col("b_y2")) <= near))
        links = cut(pairs.select("image_id", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b")), "merge")
        if links.isEmpty():
            return now
        named = now.join(components(links, ["image_id"]).withColumnRenamed("id", "box_id"), ["image_id", "box_id"], "left")
        now = cut(named.groupBy("image_id", F.coalesce("component", "box_id").alias("box_id")).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")), "merge")
    raise RuntimeError(f"merging did not end in {ROUNDS} rounds")


def region_text(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Texts of the boxes that meet each region, touching included (F13): image_id, region_id, n, text in reading order. They meet
    through the cells that both touch, each pair once: in the cell of their intersection's corner."""
    a, b = cells(prefixed(boxes, "a_", ["image_id"]), "a_"), cells(prefixed(regions, "b_", ["image_id"]), "b_")
    home = (F.col("cx") == F.floor(F.greatest("a_x1", "b_x1") / CELL)) & (F.col("cy") == F.floor(F.greatest("a_y1", "b_y1") / CELL))
    touch = (F.col("a_x1") <= F.col("b_x2")) & (F.col("a_x2") >= F.col("b_x1")) & (F.col("a_y1") <= F.col("b_y2")) & (F.col("a_y2") >= F.col("b_y1"))
    met = a.join(b, ["image_id", "cx", "cy"]).where(home & touch)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("a_y1", "a_x1", "a_box_id", "a_text"))), lambda x: x["a_text"])
    return met.groupBy("image_id", F.col("b_box_id").alias("region_id")).agg(F.count("*").alias("n"), F.array_join(ordered, " ").alias("text"))


def tiles(sizes: DataFrame, tile: int, step: int) -> DataFrame:
    """Tiles of each image (image_id, w, h) with their offsets."""
    xs = F.explode(F.sequence(F.lit(0), F.col("w").cast("int"), F.lit(step))).alias("ox")
    ys = F.explode(F.sequence(F.lit(0), F.col("h").cast("int"), F.lit(step))).alias("oy")
    return sizes.select("image_id", "w", "h", xs).select("*", ys).where("ox < w and oy < h").withColumns({"tw": F.least(F.lit(tile), F.col("w") - F.col("ox")), "th": F.least(F.lit(tile), F.col("h") - F.col("oy"))})


def spotting(gt: DataFrame, pred: DataFrame, matched: DataFrame, eps: float = 1e-9) -> DataFrame:
    """End-to-end scores (A26): hits are matched pairs with equal text; pairs of ignored boxes add nothing;
    unmatched predictions count and add their length as edits."""
    m = matched.where(~F.col("a_ignore"))
    pairs = m.agg(F.count_if(F.col("a_text") == F.col("b_text")).alias("hit"), F.sum(F.levenshtein("a_text", "b_text")).alias("e1"))
    free = pred.join(matched.select("image_id", F.col("b_box_id").alias("box_id")), ["image_id", "box_id"], "left_anti").agg(F.count("*").alias("fp"), F.sum(F.length("text")).alias("e2"))
    real = gt.where(~F.col("ignore")).agg(F.count("*").alias("gt"), F.sum(F.length("text")).alias("chars"))
    n = m.agg(F.count("*").alias("mt"))
    all_ = pairs.crossJoin(free).crossJoin(real).crossJoin(n)  # one row each
    dt = F.col("mt") + F.col("fp")
    p, r = F.col("hit") / (dt + eps), F.col("hit") / (F.col("gt") + eps)
    return all_.select("hit", dt.alias("dt"), "gt", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r + eps), 6).alias("f"), (F.coalesce("e1", F.lit(0)) + F.coalesce("e2", F.lit(0))).cast("long").alias("edits"))


def area_credit(gt: DataFrame, pred: DataFrame, tr: float = 0.7, tp: float = 0.6, k: int = 2, part: float = 0.8) -> DataFrame:
    """Recall and precision by areas (A30): one_to_one, split, merged (matches of the three phases), recall_sum, precision_sum, gt, pred, recall, precision, f.

    sigma is the share of a truth that a prediction covers, tau the share of the prediction inside it, to two places. First pairs that are the only ones over tr and over tp for both their sides count 1. Then each
    truth left, in order of its id, with sigma over 0 for k predictions or more, takes the unclaimed predictions of tau from tp on: a single one counts 1 if its sigma reaches tr, several whose sigmas sum to tr or more count `part`
    for recall and `part` each for precision. Then each prediction left does the same with the unclaimed truths of sigma from tp on, their taus summing to tp or more. Phases two and three are folds over an image's truths
    and predictions, which carry along what is claimed.
    """
    p = overlapping(gt, pred).select("image_id", F.col("a_box_id").alias("g"), F.col("b_box_id").alias("d"), F.round(overlap("a_", "b_") / area("a_"), 2).alias("sigma"), F.round(overlap("a_", "b_") / area("b_"), 2).alias("tau"))
    truth, found = Window.partitionBy("image_id", "g"), Window.partitionBy("image_id", "d")
    s, t = F.col("sigma") > tr, F.col("tau") > tp
    c = p.withColumns({"s": F.count_if(s).over(found), "t": F.count_if(t).over(found)})
    alone = (F.count_if(s) == 1) & (F.count_if(t) == 1) & (F.max(F.when(s, F.col("s"))) == 1) & (F.max(F.when(t, F.col("t"))) == 1)
    by_g = c.groupBy("image_id", "g").agg(F.when(alone, F.max(F.when(s, F.col("d")))).alias("d"), F.array_sort(F.collect_list(F.struct("d", "sigma", "tau"))).alias("ps"))
    by_d = c.groupBy("image_id", "d").agg(F.array_sort(F.collect_list(F.struct("g", "sigma", "tau"))).alias("ps"))
    gs = by_g.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("g", "d", "ps"))).alias("gs"))
    ds = by_d.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("d", "ps"))).alias("ds"))

    def claims(items: Column, own: str, other: str, start: Column, share: str, back: str, enough: float) -> Column:
        """A fold over items (of `own` ids): state mine (own ids done), theirs (other ids claimed), one, many, n (claimed by many)."""

        def step(a: Column, x: Column) -> Column:
            free = F.filter(x["ps"], lambda q: (F.round(q[back], 2) >= tp) & ~F.array_contains(a["theirs"], q[other]))

            def take(f: Column) -> Column:
                first = F.get(f, F.lit(0))
                single = (F.size(f) == 1) & (first["tau"] >= tp) & (first["sigma"] >= tr)
                total = F.round(F.aggregate(f, F.lit(0.0), lambda z, q: z + q[share]), 6)
                many = (F.size(f) > 1) & (total >= enough)
                done = F.struct(F.concat(a["mine"], F.array(x[own])).alias("mine"), F.concat(a["theirs"], F.transform(f, lambda q: q[other])).alias("theirs"), (a["one"] + single.cast("int")).alias("one"), (a["many"] + many.cast("int")).alias("many"), (a["n"] + F.when(many, F.size(f)).otherwise(0)).alias("n"))
                return F.when(single | many, done).otherwise(a)

            looks = ~F.array_contains(a["mine"], x[own]) & (F.size(F.filter(x["ps"], lambda q: q[share] > 0)) >= k)
            return F.when(looks, let(free, take)).otherwise(a)

        return F.aggregate(items, start, step)

    def state(mine: Column, theirs: Column) -> Column:
        return F.struct(mine.alias("mine"), theirs.alias("theirs"), F.lit(0).alias("one"), F.lit(0).alias("many"), F.lit(0).alias("n"))

    matched = F.filter("gs", lambda x: x["d"].isNotNull())
    both = gs.join(ds, "image_id").withColumn("first", matched).withColumn("two", claims(F.col("gs"), "g", "d", state(F.transform("first", lambda x: x["g"]), F.transform("first", lambda x: x["d"])), "sigma", "tau", tr))
    three = claims(F.col("ds"), "d", "g", state(F.col("two.theirs"), F.col("two.mine")), "tau", "sigma", tp)
    n = both.withColumn("three", three).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(a) for a, c in {"one": F.size("first"), "one2": F.col("two.one"), "split": F.col("two.many"), "parts": F.col("two.n"), "one3": F.col("three.one"), "merged": F.col("three.many"), "whole": F.col("three.n")}.items()])
    all_ = n.crossJoin(gt.agg(F.count("*").alias("gt"))).crossJoin(pred.agg(F.count("*").alias("pred")))  # one row each
    ones = F.col("one") + F.col("one2") + F.col("one3")
    r, q = ones + part * (F.col("split") + F.col("whole")), ones + part * (F.col("parts") + F.col("merged"))
    rr, pp = F.coalesce(F.try_divide(r, "gt"), F.lit(0.0)), F.coalesce(F.try_divide(q, "pred"), F.lit(0.0))
    return all_.select(ones.alias("one_to_one"), "split", "merged", F.round(r, 4).alias("recall_sum"), F.round(q, 4).alias("precision_sum"), "gt", "pred", F.round(rr, 6).alias("recall"), F.round(pp, 6).alias("precision"), F.round(F.coalesce(F.try_divide(2 * rr * pp, rr + pp), F.lit(0.0)), 6).alias("f"))
