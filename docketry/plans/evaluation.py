"""Queries over metrics, labels and boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions.columns import area, edits, iou, overlap
from docketry.operators import boxes as B
from docketry.operators import metrics as M
from docketry.operators.batches import spread
from docketry.registry import register

from .fixtures import duck, table, view

W = "greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1))"
U = "((g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - i)"
PAIRS = f"pr AS (SELECT *, i / {U.replace('g.x2 - g.x1', 'gx').replace('g.y2 - g.y1', 'gy').replace('p.x2 - p.x1', 'px').replace('p.y2 - p.y1', 'py')} AS iou FROM (SELECT g.image_id, g.box_id AS a, p.box_id AS b, g.x2 - g.x1 AS gx, g.y2 - g.y1 AS gy, p.x2 - p.x1 AS px, p.y2 - p.y1 AS py, g.ignore, g.text AS gt, p.text AS pt, {W} AS i FROM gt1 g JOIN pred1 p USING (image_id)) q WHERE i > 0)"
#: box ids repeat inside an image of the given tables; each box gets an id of its own
ONE = "gt1 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY image_id ORDER BY box_id, x1, y1, x2, y2, ignore, text) AS box_id) FROM boxes_gt), pred1 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY image_id ORDER BY box_id, x1, y1, x2, y2, score, text) AS box_id) FROM boxes_pred)"


def _numbered(df):
    """All boxes, each with a box_id of its own in its image."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("box_id", *[c for c in df.columns if c not in ("image_id", "box_id")]))
    return df.withColumn("box_id", place.cast("long"))


def _all_gt(spark, sf):
    return _numbered(view(spark, sf, "boxes_gt"))


def _all_pred(spark, sf):
    return _numbered(view(spark, sf, "boxes_pred"))


@register("a21_recognition", duck("text_pairs", "SELECT count(*) AS n, round(count(*) FILTER (WHERE gt = pred) / (count(*) + 1e-5), 6) AS acc, round(1 - sum(CASE WHEN greatest(length(gt), length(pred)) = 0 THEN 0.0 ELSE levenshtein(gt, pred) / greatest(length(gt), length(pred)) END) / (count(*) + 1e-5), 6) AS norm_edit FROM text_pairs"))
def a21(spark, sf):
    return M.recognition(spread(view(spark, sf, "text_pairs")))


@register("p24_scoring_text", duck("text_pairs", "SELECT doc_id, n, replace(gt, ' ', '') = replace(pred, ' ', '') AS same FROM text_pairs"))
def p24(spark, sf):
    return view(spark, sf, "text_pairs").select("doc_id", "n", (F.replace("gt", F.lit(" "), F.lit("")) == F.replace("pred", F.lit(" "), F.lit(""))).alias("same"))


_MTEVAL = [  # the tokenizer's rules in order: pattern, replacement
    (r"<skipped>", ""), (r"-\n", ""), (r"\n", " "), (r"&quot;", '"'), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"),
    (r"([!-+:-@\[-`{-~/])", " {1} "), (r"([^0-9])([.,])", "{1} {2} "), (r"([.,])([^0-9])", " {1} {2}"), (r"([0-9])(-)", "{1} {2} "),
]


def _mteval_sql() -> str:
    t = "concat(' ', text, ' ')"
    for pattern, new in _MTEVAL:
        t = f"regexp_replace({t}, '{pattern}', '{new.replace('{', chr(92)).replace('}', '')}', 'g')"
    return f"SELECT doc_id, n, md5(t) AS digest FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, array_to_string(w, ' ') AS t FROM (SELECT doc_id, list_filter(regexp_split_to_array({t}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) a) b"


@register("p25_mteval_tokens", _mteval_sql())
def p25(spark, sf):
    w = M.mteval_tokens("text", [(pattern, new.replace("{", "$").replace("}", "")) for pattern, new in _MTEVAL])
    return table(spark, sf, "documents").where("text is not null").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@register("a22_exact_accuracy", "SELECT round(count(*) FILTER (WHERE quality = 1 - toxic) / (count(*) + 1e-5), 6) AS acc, count(*) AS n FROM labels")
def a22(spark, sf):
    return table(spark, sf, "labels").agg(F.round(F.count_if(F.col("quality") == 1 - F.col("toxic")) / (F.count("*") + 1e-5), 6).alias("acc"), F.count("*").alias("n"))


@register("a23_token_edits")
def a23(spark, sf):
    return M.token_edits(spread(view(spark, sf, "text_pairs")))


_GRAMS = " UNION ALL ".join(f"SELECT doc_id, line, {n} AS n, side, array_to_string(t[i:i + {n - 1}], ' ') AS gram FROM (SELECT *, unnest(range(1, len(t) - {n - 2})) AS i FROM tk WHERE len(t) >= {n}) q" for n in (1, 2, 3, 4))
_BLEU_SQL = f"""WITH tk AS (SELECT doc_id, n AS line, side, list_filter(string_split(t, ' '), lambda x: x <> '') AS t FROM (SELECT doc_id, n, 'g' AS side, gt AS t FROM text_pairs UNION ALL SELECT doc_id, n, 'g2', concat(replace(gt, 'e', '3'), ' end') FROM text_pairs WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, n, 'p', pred FROM text_pairs) u),
gr AS ({_GRAMS}),
c AS (SELECT n, gram, greatest(count(*) FILTER (WHERE side = 'g'), count(*) FILTER (WHERE side = 'g2')) AS g, count(*) FILTER (WHERE side = 'p') AS p FROM gr GROUP BY doc_id, line, n, gram),
m AS (SELECT n, CAST(sum(least(g, p)) AS BIGINT) AS matches, CAST(sum(p) AS BIGINT) AS total FROM c GROUP BY 1),
z AS (SELECT CAST(sum(CASE WHEN side = 'g' THEN len(t) ELSE 0 END) AS BIGINT) AS r, CAST(sum(CASE WHEN side = 'p' THEN len(t) ELSE 0 END) AS BIGINT) AS h FROM tk)
SELECT CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(total) AS BIGINT) AS total, any_value(r) AS r, any_value(h) AS h, round(CASE WHEN any_value(h) > any_value(r) THEN 1.0 ELSE exp(1 - any_value(r) / any_value(h)) END * exp(avg(ln(matches / total))), 6) AS bleu, round(CASE WHEN any_value(h) > any_value(r) THEN 1.0 ELSE exp(1 - any_value(r) / any_value(h)) END * exp(avg(ln((matches + 1) / (total + 1)))), 6) AS smooth FROM m, z"""


@register("a25_bleu", duck("text_pairs", _BLEU_SQL))
def a25(spark, sf):
    """Even documents have a second reference, misread and a word longer."""
    second = F.concat(F.replace("gt", F.lit("e"), F.lit("3")), F.lit(" end"))
    refs = F.when(F.col("doc_id") % 2 == 0, F.array("gt", second)).otherwise(F.array("gt"))
    return M.bleu(spread(view(spark, sf, "text_pairs")).select("pred", refs.alias("refs")))


@register("a31_confusion_f1", "WITH c AS (SELECT quality AS c, count(*) AS row_n, count(*) FILTER (WHERE quality = toxic) AS tp FROM labels GROUP BY 1), p AS (SELECT toxic AS c, count(*) AS col_n FROM labels GROUP BY 1) SELECT c, coalesce(tp, 0) AS tp, round(2 * r * q / greatest(r + q, 1e-8), 6) AS f1 FROM (SELECT coalesce(c.c, p.c) AS c, coalesce(tp, 0) AS tp, coalesce(tp, 0) / greatest(coalesce(row_n, 0), 1) AS r, coalesce(tp, 0) / greatest(coalesce(col_n, 0), 1) AS q FROM c FULL JOIN p ON c.c = p.c) x")
def a31(spark, sf):
    return M.confusion_f1(table(spark, sf, "labels").select(F.col("quality").alias("gt"), F.col("toxic").alias("pred")))


_LINKP = "gt2 AS (SELECT DISTINCT conv_id, a, b FROM links), pr2 AS (SELECT DISTINCT conv_id, a, CASE WHEN conv_id % 5 = 0 THEN b + 1 ELSE b END AS b FROM links WHERE conv_id % 7 <> 0), n AS (SELECT count(*) AS g, (SELECT count(*) FROM pr2) AS p, (SELECT count(*) FROM gt2 JOIN pr2 USING (conv_id, a, b)) AS tp FROM gt2)"


@register("a32_relation_f1", duck("links", f"WITH {_LINKP} SELECT tp, p - tp AS fp, g - tp AS fn, round(tp / p, 6) AS precision, round(tp / g, 6) AS recall, round(2 * (tp / p) * (tp / g) / (tp / p + tp / g), 6) AS f1 FROM n"))
def a32(spark, sf):
    gt = view(spark, sf, "links")
    pred = gt.where("conv_id % 7 <> 0").withColumn("b", F.when(F.col("conv_id") % 5 == 0, F.col("b") + 1).otherwise(F.col("b")))
    return M.set_scores(gt, pred, ["conv_id", "a", "b"])


_RELS = """gt3 AS (SELECT DISTINCT conv_id, 1 + a % 2 AS type, a, b, CAST(a % 3 AS VARCHAR) AS ka, CAST(b % 3 AS VARCHAR) AS kb FROM links),
pr3 AS (SELECT DISTINCT conv_id, 1 + a % 2 AS type, a, CASE WHEN conv_id % 5 = 0 THEN b + 1 ELSE b END AS b, CAST(CASE WHEN conv_id % 11 = 0 THEN 7 ELSE a % 3 END AS VARCHAR) AS ka, CAST(b % 3 AS VARCHAR) AS kb FROM links WHERE conv_id % 7 <> 0),
u AS (SELECT mode, conv_id, type, a, b, CASE WHEN mode = 'strict' THEN ka END AS ka, CASE WHEN mode = 'strict' THEN kb END AS kb, side FROM (SELECT *, 'g' AS side FROM gt3 UNION ALL SELECT *, 'p' FROM pr3) q, (SELECT unnest(['strict', 'boundaries']) AS mode) m),
s AS (SELECT mode, type, bool_or(side = 'g') AS g, bool_or(side = 'p') AS p FROM u GROUP BY mode, conv_id, type, a, b, ka, kb),
c AS (SELECT mode, type, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g) AS fp, count(*) FILTER (WHERE NOT p) AS fn FROM s GROUP BY GROUPING SETS ((mode, type), (mode))),
f AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pc, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM c),
k AS (SELECT *, coalesce(2 * pc * rc / nullif(pc + rc, 0), 0) AS f1x FROM f)
SELECT mode, type, tp, fp, fn, round(pc, 6) AS precision, round(rc, 6) AS recall, round(f1x, 6) AS f1, CASE WHEN type IS NULL THEN round(avg(CASE WHEN type IS NOT NULL THEN pc END) OVER w, 6) END AS macro_precision, CASE WHEN type IS NULL THEN round(avg(CASE WHEN type IS NOT NULL THEN rc END) OVER w, 6) END AS macro_recall, CASE WHEN type IS NULL THEN round(avg(CASE WHEN type IS NOT NULL THEN f1x END) OVER w, 6) END AS macro_f1 FROM k WINDOW w AS (PARTITION BY mode)"""


@register("a32_relation_scores", duck("links", "WITH " + _RELS))
def a32_scores(spark, sf):
    """Strict and boundaries modes, each type and all: some predictions miss, some end a turn late, some have another kind."""
    links = view(spark, sf, "links")
    gt = links.select("conv_id", (1 + F.col("a") % 2).alias("type"), "a", "b", (F.col("a") % 3).alias("ka"), (F.col("b") % 3).alias("kb"))
    pred = links.where("conv_id % 7 <> 0").select("conv_id", (1 + F.col("a") % 2).alias("type"), "a", F.when(F.col("conv_id") % 5 == 0, F.col("b") + 1).otherwise(F.col("b")).alias("b"), F.when(F.col("conv_id") % 11 == 0, 7).otherwise(F.col("a") % 3).alias("ka"), (F.col("b") % 3).alias("kb"))
    return M.relation_scores(gt, pred, ["conv_id"], ["a", "b"], ["ka", "kb"])


_TAG = "CASE l_returnflag WHEN 'A' THEN 'B-X' WHEN 'N' THEN 'I-X' ELSE 'O' END"


_SEEN = "CASE WHEN l_partkey % 13 = 0 THEN 'O' WHEN l_partkey % 17 = 0 THEN 'B-X' WHEN l_partkey % 19 = 0 THEN 'B-Y' ELSE " + _TAG + " END"


def _span_sql(name: str, tag: str) -> str:
    return f"""{name}0 AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, {tag} AS tag FROM lineitem),
{name}1 AS (SELECT *, tag[1] = 'B' OR (tag[1] = 'I' AND coalesce(substring(lag(tag) OVER (PARTITION BY doc_id ORDER BY i), 3), '') <> substring(tag, 3)) AS st FROM {name}0),
{name} AS (SELECT doc_id, any_value(substring(tag, 3)) AS kind, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last FROM (SELECT *, sum(CAST(st AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM {name}1) q WHERE tag <> 'O' GROUP BY doc_id, s)"""


def _tags(spark, sf, tag):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), place.alias("i"), F.expr(tag).alias("tag"))


@register("a33_entity_spans", f"WITH {_span_sql('sp', _TAG)} SELECT * FROM sp")
def a33(spark, sf):
    return M.spans(_tags(spark, sf, _TAG))


@register("a33_entity_scores", f"WITH {_span_sql('gs', _TAG)}, {_span_sql('ps', _SEEN)}, n AS (SELECT count(*) AS g, (SELECT count(*) FROM ps) AS p, (SELECT count(*) FROM gs JOIN ps USING (doc_id, kind, first, last)) AS tp FROM gs) SELECT tp, p - tp AS fp, g - tp AS fn, round(tp / p, 6) AS precision, round(tp / g, 6) AS recall, round(2 * (tp / p) * (tp / g) / (tp / p + tp / g), 6) AS f1 FROM n")
def a33_scores(spark, sf):
    """Entities of the tags against those of tags with planted misses, breaks and other kinds."""
    return M.set_scores(M.spans(_tags(spark, sf, _TAG)), M.spans(_tags(spark, sf, _SEEN)), ["doc_id", "kind", "first", "last"])


@register("a36_step_timings", "SELECT event_type, round(coalesce(sum(value), 0), 4) AS total, round(coalesce(avg(value), 0), 4) AS mean, count(value) AS n FROM events GROUP BY 1")
def a36(spark, sf):
    return M.step_timings(table(spark, sf, "events"), "event_type", "value")


@register("a36_a37_benchmark", "WITH q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) FILTER (WHERE rn > 5) AS n, round(avg(value) FILTER (WHERE rn > 5), 4) AS mean, round(stddev_pop(value) FILTER (WHERE rn > 5), 4) AS std, min(value) FILTER (WHERE rn > 5) AS least, max(value) FILTER (WHERE rn > 5) AS most, round(8 / avg(value) FILTER (WHERE rn > 5), 3) AS fps, round(avg(value), 4) AS mean_all, round(8 / avg(value), 3) AS fps_all FROM q GROUP BY 1 HAVING count(*) > 5")
def a37(spark, sf):
    return M.benchmark(table(spark, sf, "events"), "event_type", "value", 5, 8)


@register("a38_regression_compare", "SELECT l_orderkey AS k, va, vb FROM (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS va, round(sum(l_extendedprice) * CASE WHEN l_orderkey % 10 = 0 THEN 1.01 ELSE 1.0 END, 2) AS vb FROM lineitem GROUP BY 1) q WHERE abs(va - vb) > 0.01 + 0.001 * abs(vb)")
def a38(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("s"))
    a, b = s.select("k", F.round("s", 2).alias("v")), s.select("k", F.round(F.col("s") * F.when(F.col("k") % 10 == 0, 1.01).otherwise(1.0), 2).alias("v"))
    return M.close_to(a, b, ["k"], "v", 0.01, 0.001)


@register("j13_truth_prediction", duck("text_pairs", "SELECT g.doc_id, g.n, CASE WHEN p.doc_id IS NULL THEN 0.0 ELSE round(1 - levenshtein(g.gt, p.pred) / greatest(length(g.gt), length(p.pred), 1), 6) END AS score FROM text_pairs g LEFT JOIN (SELECT doc_id, n, pred FROM text_pairs WHERE doc_id % 7 <> 0) p ON p.doc_id = g.doc_id AND p.n = g.n"))
def j13(spark, sf):
    t = view(spark, sf, "text_pairs")
    met = t.select("doc_id", "n", "gt").join(t.where("doc_id % 7 <> 0").select("doc_id", "n", "pred"), ["doc_id", "n"], "left")
    return met.select("doc_id", "n", F.when(F.col("pred").isNull(), 0.0).otherwise(F.round(1 - edits("gt", "pred") / F.greatest(F.length("gt"), F.length("pred"), F.lit(1)), 6)).alias("score"))


@register("p28_collapse_ids", "SELECT l_orderkey AS k, list_aggregate(list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] <> 0 AND (i = 1 OR a[i] <> a[i - 1]) THEN a[i] END), lambda x: x IS NOT NULL), 'string_agg', ',') AS ids FROM (SELECT l_orderkey, list(l_suppkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS a FROM lineitem GROUP BY 1) q")
def p28(spark, sf):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))), lambda x: x["l_suppkey"] % 3)
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(ids.alias("a"))
    kept = F.filter("a", lambda x, i: (x != 0) & ((i == 0) | (x != F.get("a", i - 1))))
    return a.select("k", F.when(F.size(kept) > 0, F.array_join(kept, ",")).alias("ids"))


@register("p30_box_forms", duck("boxes_gt", "SELECT image_id, box_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM boxes_gt"))
def p30(spark, sf):
    return view(spark, sf, "boxes_gt").select("image_id", "box_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


@register("a40_outer_boxes", duck("boxes_gt", "SELECT image_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM boxes_gt GROUP BY 1"))
def a40(spark, sf):
    return view(spark, sf, "boxes_gt").groupBy("image_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


@register("p31_j6_pairs", duck("boxes_gt boxes_pred", f"WITH {ONE}, {PAIRS} SELECT image_id, a, b, round(iou, 6) AS iou, round(i / (gx * gy), 6) AS contained FROM pr WHERE iou >= 0.3"))
def j6(spark, sf):
    p = B.pairs_over(_all_gt(spark, sf), _all_pred(spark, sf), 0.3)
    return p.select("image_id", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), F.round("iou", 6).alias("iou"), F.round(overlap("a_", "b_") / area("a_"), 6).alias("contained"))


_SIDES = ["image_id", "box_id", "x1", "y1", "x2", "y2"]


def _greedy(gt, pred, text: bool):
    """Pairs of 0.5 on, the best first. Boxes bring along their sides, and what is scored."""
    more = ["text"] if text else []
    pairs = B.pairs_over(gt.select(*_SIDES, *more, *(["ignore"] if text else [])), pred.select(*_SIDES, *more), 0.5)
    kept = [f"{side}_{c}" for side in "ab" for c in ("box_id", *more)] + (["a_ignore"] if text else [])
    return B.greedy_match(pairs.select("image_id", *kept, F.round("iou", 9).alias("iou")), [F.desc("iou"), F.col("a_box_id"), F.col("b_box_id")])


def _matched(spark, sf, text: bool = False):
    return _greedy(_all_gt(spark, sf), _all_pred(spark, sf), text)


@register("j7_greedy_match")
def j7(spark, sf):
    return _matched(spark, sf).select("image_id", "a_box_id", "b_box_id", F.round("iou", 6).alias("iou"))


@register("j8_detection_match")
def j8(spark, sf):
    """Greedy by ground truth and not by IoU; predictions mostly inside an ignored box take no part."""
    gt, pred = _all_gt(spark, sf), _all_pred(spark, sf)
    care = B.overlapping(gt.where("ignore"), pred).where(overlap("a_", "b_") / area("b_") > 0.5).select("image_id", F.col("b_box_id").alias("box_id")).distinct()
    pairs = B.pairs_over(gt.where("not ignore"), pred.join(care, ["image_id", "box_id"], "left_anti"), 0.5).where("iou > 0.5")
    return B.greedy_match(pairs, [F.col("a_box_id"), F.col("b_box_id")]).select("image_id", "a_box_id", "b_box_id")


@register("a26_spotting")
def a26(spark, sf):
    return B.spotting(_all_gt(spark, sf), _all_pred(spark, sf), _matched(spark, sf, True))


@register("a27_kie_scores")
def a27(spark, sf):
    """As a26 with case and blanks ignored and background texts dropped."""
    flat = F.lower(F.replace("text", F.lit(" "), F.lit("")))
    gt = _all_gt(spark, sf).where("text <> 't0'").withColumn("text", flat)
    pred = _all_pred(spark, sf).where("text <> 't0'").withColumn("text", flat)
    return B.spotting(gt, pred, _greedy(gt, pred, True))


@register("a28_detection_hmean")
def a28(spark, sf):
    g, p, m = _all_gt(spark, sf).where("not ignore"), _all_pred(spark, sf), j8(spark, sf)
    n = g.agg(F.count("*").alias("gt")).crossJoin(p.agg(F.count("*").alias("pred"))).crossJoin(m.agg(F.count("*").alias("matched")))  # one row each
    r, q = F.col("matched") / F.col("gt"), F.col("matched") / F.col("pred")
    return n.select("gt", "pred", "matched", F.round(r, 6).alias("recall"), F.round(q, 6).alias("precision"), F.round(2 * r * q / (r + q), 6).alias("hmean"))


@register("a29_threshold_sweep", duck("boxes_gt boxes_pred", f"WITH {ONE}, {PAIRS}, t AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS least), n AS (SELECT (SELECT count(*) FROM gt1) AS g, (SELECT count(*) FROM pred1) AS p) SELECT least, count(DISTINCT image_id * 10000 + a) AS hit, round(count(DISTINCT image_id * 10000 + a) / any_value(g), 6) AS recall, round(count(DISTINCT image_id * 10000 + b) / any_value(p), 6) AS precision FROM pr, t, n WHERE iou >= least GROUP BY 1"))
def a29(spark, sf):
    gt, pred = _all_gt(spark, sf), _all_pred(spark, sf)
    pairs = B.pairs_over(gt, pred, 0.3).withColumn("least", F.explode(F.array(*[F.lit(x) for x in (0.3, 0.5, 0.7)]))).where("iou >= least")
    n = gt.agg(F.count("*").alias("g")).crossJoin(pred.agg(F.count("*").alias("p")))
    by = pairs.groupBy("least").agg(F.count_distinct("image_id", "a_box_id").alias("hit"), F.count_distinct("image_id", "b_box_id").alias("hp")).crossJoin(n)
    return by.select("least", "hit", F.round(F.col("hit") / F.col("g"), 6).alias("recall"), F.round(F.col("hp") / F.col("p"), 6).alias("precision"))


@register("a30_area_credit", duck("boxes_gt boxes_pred", f"WITH {ONE}, {PAIRS}, q AS (SELECT *, round(i / (gx * gy), 2) AS sigma, round(i / (px * py), 2) AS tau FROM pr), k AS (SELECT *, count(*) OVER (PARTITION BY image_id, a) AS na, count(*) OVER (PARTITION BY image_id, b) AS nb FROM q WHERE sigma >= 0.7 AND tau >= 0.6) SELECT count(*) FILTER (WHERE na = 1 AND nb = 1) AS one_to_one, count(*) FILTER (WHERE na > 1) AS one_to_many, count(*) FILTER (WHERE nb > 1 AND na = 1) AS many_to_one FROM k"))
def a30(spark, sf):
    p = B.overlapping(_all_gt(spark, sf), _all_pred(spark, sf)).select("image_id", "a_box_id", "b_box_id", F.round(overlap("a_", "b_") / area("a_"), 2).alias("sigma"), F.round(overlap("a_", "b_") / area("b_"), 2).alias("tau")).where("sigma >= 0.7 and tau >= 0.6")
    k = p.withColumns({"na": F.count("*").over(Window.partitionBy("image_id", "a_box_id")), "nb": F.count("*").over(Window.partitionBy("image_id", "b_box_id"))})
    return k.agg(F.count_if((F.col("na") == 1) & (F.col("nb") == 1)).alias("one_to_one"), F.count_if(F.col("na") > 1).alias("one_to_many"), F.count_if((F.col("nb") > 1) & (F.col("na") == 1)).alias("many_to_one"))


@register("a30_area_scores")
def a30_scores(spark, sf):
    """All boxes; predictions of every fifth image are also cut in two, and every seventh one's neighbours put together, so that the later phases have work."""
    gt, pred = _all_gt(spark, sf), _split_and_joined(_all_pred(spark, sf))
    return B.area_credit(gt, pred)


def _split_and_joined(pred):
    middle = (F.col("x1") + F.col("x2")) / 2
    halves = F.explode(F.when(F.col("image_id") % 5 == 0, F.array(F.struct(F.col("x1").alias("x1"), middle.alias("x2"), F.lit(0).alias("k")), F.struct(middle.alias("x1"), F.col("x2").alias("x2"), F.lit(1).alias("k")))).otherwise(F.array(F.struct("x1", F.when(F.col("image_id") % 7 == 0, F.col("x2") + 40).otherwise(F.col("x2")).alias("x2"), F.lit(0).alias("k")))))
    return pred.withColumn("half", halves).select("image_id", (F.col("box_id") * 2 + F.col("half.k")).alias("box_id"), F.col("half.x1").alias("x1"), "y1", F.col("half.x2").alias("x2"), "y2", "score", "text")


@register("f12_f19_score_filters", duck("boxes_pred", "SELECT image_id, count(*) AS n FROM boxes_pred WHERE score >= 0.95 GROUP BY 1"))
def f12(spark, sf):
    return view(spark, sf, "boxes_pred").where("score >= 0.95").groupBy("image_id").agg(F.count("*").alias("n"))


_REGIONS = "rg AS (SELECT image_id, k AS region_id, CASE k WHEN 0 THEN x1 ELSE (x1 + x2) / 2 END AS x1, y1, CASE k WHEN 0 THEN (x1 + x2) / 2 ELSE x2 END AS x2, y2 FROM (SELECT image_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM boxes_pred GROUP BY 1) o, (SELECT unnest([0, 1]) AS k) h)"


@register("f13_region_text", duck("boxes_gt boxes_pred", f"WITH {ONE}, {_REGIONS} SELECT g.image_id, r.region_id, count(*) AS n, string_agg(g.text, ' ' ORDER BY g.y1, g.x1, g.box_id) AS text FROM gt1 g JOIN rg r ON g.image_id = r.image_id AND g.x1 <= r.x2 AND g.x2 >= r.x1 AND g.y1 <= r.y2 AND g.y2 >= r.y1 GROUP BY 1, 2"))
def f13(spark, sf):
    """Regions: the left and the right half of what the predictions of an image cover."""
    o = view(spark, sf, "boxes_pred").groupBy("image_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    middle = (F.col("x1") + F.col("x2")) / 2
    halves = [o.select("image_id", F.lit(k).alias("box_id"), (F.col("x1") if k == 0 else middle).alias("x1"), "y1", (middle if k == 0 else F.col("x2")).alias("x2"), "y2") for k in (0, 1)]
    return B.region_text(_all_gt(spark, sf), halves[0].union(halves[1]))


@register("f14_header_zone", duck("boxes_gt boxes_pred", "SELECT p.image_id, p.box_id FROM boxes_pred p JOIN (SELECT image_id, min(y1) AS top FROM boxes_gt GROUP BY 1) g USING (image_id) WHERE p.y2 >= top"))
def f14(spark, sf):
    top = view(spark, sf, "boxes_gt").groupBy("image_id").agg(F.min("y1").alias("top"))
    return view(spark, sf, "boxes_pred").join(top, "image_id").where("y2 >= top").select("image_id", "box_id")


@register("f18_d3_label_admission", duck("boxes_gt", "SELECT image_id, box_id, CASE text WHEN 't1' THEN 0 WHEN 't2' THEN 1 WHEN 't3' THEN 2 END AS label, ignore OR text = 't3' AS ignored FROM boxes_gt WHERE text IN ('t1', 't2', 't3')"))
def f18(spark, sf):
    labels = F.create_map(*[F.lit(x) for kv in {"t1": 0, "t2": 1, "t3": 2}.items() for x in kv])
    b = view(spark, sf, "boxes_gt").withColumn("label", F.try_element_at(labels, F.col("text"))).where("label is not null")
    return b.select("image_id", "box_id", "label", (F.col("ignore") | (F.col("text") == "t3")).alias("ignored"))


_DIST = "abs(g.x1 - p.x1) + abs(g.y1 - p.y1) + abs(g.x2 - p.x2) + abs(g.y2 - p.y2)"


@register("j9_nearest_cell", duck("boxes_gt boxes_pred", f"WITH {ONE} SELECT image_id, box_id, cell_id FROM (SELECT image_id, p.box_id, g.box_id AS cell_id, row_number() OVER (PARTITION BY image_id, p.box_id ORDER BY round(1 - ({W}) / ((g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - ({W})), 9), round({_DIST}, 6), g.box_id) AS rn FROM pred1 p JOIN gt1 g USING (image_id)) q WHERE rn = 1"))
def j9(spark, sf):
    return B.nearest_cell(_all_pred(spark, sf), _all_gt(spark, sf))


@register("j10_cascade")
def j10(spark, sf):
    return B.cascade(_all_pred(spark, sf), _all_gt(spark, sf))


@register("j11_w6_leftovers", duck("boxes_gt boxes_pred", f"WITH {ONE}, {PAIRS}, l AS (SELECT p.* FROM pred1 p WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.image_id = p.image_id AND pr.b = p.box_id)), w AS (SELECT *, CASE WHEN y1 - lag(y1) OVER (PARTITION BY image_id ORDER BY y1, x1, box_id) >= 3 THEN 1 ELSE 0 END AS nw FROM l), r AS (SELECT *, sum(nw) OVER (PARTITION BY image_id ORDER BY y1, x1, box_id ROWS UNBOUNDED PRECEDING) AS rw FROM w), n AS (SELECT image_id, count(*) AS cells FROM gt1 GROUP BY 1) SELECT image_id, box_id, cells + row_number() OVER (PARTITION BY image_id ORDER BY rw, x1, y1, box_id) AS cell_id FROM r JOIN n USING (image_id)"))
def j11(spark, sf):
    gt, pred = _all_gt(spark, sf), _all_pred(spark, sf)
    met = B.overlapping(gt, pred).select("image_id", F.col("b_box_id").alias("box_id")).distinct()
    left = B.reading_order(pred.join(met, ["image_id", "box_id"], "left_anti"), 3.0)
    n = gt.groupBy("image_id").agg(F.count("*").alias("cells"))
    return left.join(n, "image_id").select("image_id", "box_id", (F.col("cells") + F.col("place")).alias("cell_id"))


@register("j12_link_remap", duck("links", "SELECT conv_id, a * 10 + x AS a, b * 10 + y AS b FROM links, (SELECT unnest([0, 1]) AS x) p, (SELECT unnest([0, 1]) AS y) q WHERE a % 3 <> 0 AND b % 3 <> 0"))
def j12(spark, sf):
    """Each id stands for two new ones; ids divisible by 3 have none, so their links go."""
    links = view(spark, sf, "links")
    ids = links.select("conv_id", F.col("a").alias("old")).union(links.select("conv_id", "b")).distinct().where("old % 3 <> 0").withColumn("new", F.explode(F.array(F.col("old") * 10, F.col("old") * 10 + 1)))
    src = links.join(ids.withColumnsRenamed({"old": "a", "new": "na"}), ["conv_id", "a"])
    return src.join(ids.withColumnsRenamed({"old": "b", "new": "nb"}), ["conv_id", "b"]).select("conv_id", F.col("na").alias("a"), F.col("nb").alias("b"))


_ROW = "w AS (SELECT *, CASE WHEN y1 - lag(y1) OVER (PARTITION BY image_id ORDER BY y1, x1, box_id) >= 10 THEN 1 ELSE 0 END AS nw FROM gt1), r AS (SELECT *, sum(nw) OVER (PARTITION BY image_id ORDER BY y1, x1, box_id ROWS UNBOUNDED PRECEDING) AS rw FROM w)"


@register("t1_reading_order", duck("boxes_gt boxes_pred", f"WITH {ONE}, {_ROW} SELECT image_id, box_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY rw, x1, y1, box_id) AS INTEGER) AS place FROM r"))
def t1(spark, sf):
    return B.reading_order(_all_gt(spark, sf)).select("image_id", "box_id", "place")


@register("t2_two_columns", duck("boxes_gt boxes_pred", f"WITH {ONE}, s AS (SELECT *, CASE WHEN x1 < 200 AND x2 < 480 THEN 0 WHEN x1 > 320 THEN 1 ELSE 2 END AS side FROM gt1), g AS (SELECT *, count(*) FILTER (WHERE side = 2) OVER (PARTITION BY image_id ORDER BY y1, x1, box_id ROWS UNBOUNDED PRECEDING) AS grp FROM s) SELECT image_id, box_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY grp, CASE WHEN side = 2 THEN -1 ELSE side END, y1, x1, box_id) AS INTEGER) AS place FROM g"))
def t2(spark, sf):
    return B.two_columns(_all_gt(spark, sf), 800.0).select("image_id", "box_id", "place")


@register("t4_hard_nms")
def t4(spark, sf):
    return B.suppress(_all_pred(spark, sf), 0.5, 200).select("image_id", "box_id")


@register("t5_standard_nms")
def t5(spark, sf):
    return B.suppress(_all_pred(spark, sf), 0.3).select("image_id", "box_id")


@register("t7_link_components", duck("links", "SELECT DISTINCT conv_id, id, (id - 1) // 4 * 4 + 1 AS component FROM (SELECT conv_id, a AS id FROM links WHERE a % 4 <> 0 UNION SELECT conv_id, b FROM links WHERE a % 4 <> 0) u"))
def t7(spark, sf):
    """Chains of turns, broken after every turn divisible by 4; a chain's ids follow each other."""
    return B.components(view(spark, sf, "links").where("a % 4 <> 0"), ["conv_id"])


@register("w20_merge_fragments")
def w20(spark, sf):
    return B.merge_fragments(_all_pred(spark, sf))


@register("w22_tiles", duck("boxes_gt", "WITH s AS (SELECT image_id, max(x2) AS w, max(y2) AS h FROM boxes_gt GROUP BY 1), t AS (SELECT image_id, w, h, CAST(unnest(range(0, CAST(w AS BIGINT) + 1, 320)) AS INTEGER) AS ox FROM s), u AS (SELECT *, CAST(unnest(range(0, CAST(h AS BIGINT) + 1, 320)) AS INTEGER) AS oy FROM t) SELECT image_id, ox, oy, least(320, w - ox)::DOUBLE AS tw, least(320, h - oy)::DOUBLE AS th FROM u WHERE ox < w AND oy < h"))
def w22(spark, sf):
    s = view(spark, sf, "boxes_gt").groupBy("image_id").agg(F.max("x2").alias("w"), F.max("y2").alias("h"))
    return B.tiles(s, 320, 320).select("image_id", "ox", "oy", "tw", "th")


@register("j17_grid_points", duck("boxes_gt", "SELECT DISTINCT h.image_id, round(v.x) AS x, round(h.y) AS y FROM (SELECT image_id, y1 AS y, x1, x2 FROM boxes_gt) h JOIN (SELECT image_id, x1 AS x, y1, y2 FROM boxes_gt) v ON h.image_id = v.image_id AND v.x BETWEEN h.x1 - 4 AND h.x2 + 4 AND h.y BETWEEN v.y1 - 4 AND v.y2 + 4"))
def j17(spark, sf):
    """Top edges against left edges; both meet through the cells they run through."""
    b = view(spark, sf, "boxes_gt")
    h = b.select("image_id", "box_id", (F.col("x1") - 4).alias("x1"), (F.col("y1") - 0.5).alias("y1"), (F.col("x2") + 4).alias("x2"), (F.col("y1") + 0.5).alias("y2"))
    v = b.select("image_id", "box_id", (F.col("x1") - 0.5).alias("x1"), (F.col("y1") - 4).alias("y1"), (F.col("x1") + 0.5).alias("x2"), (F.col("y2") + 4).alias("y2"))
    met = B.overlapping(h, v).withColumns({"x": F.col("b_x1") + 0.5, "y": F.col("a_y1") + 0.5})
    return met.where("x between a_x1 and a_x2 and y between b_y1 and b_y2").select("image_id", F.round("x").alias("x"), F.round("y").alias("y")).distinct()
