"""Queries over case management rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.operators import casework as O
from docketry.operators.batches import numbered_by
from docketry.registry import register

from .fixtures import duck, table, view

AS_OF = "1998-01-01"
_TERM = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.TERMS.items()) + " END"
DUE = f"du AS (SELECT *, CAST(start_date + CAST({_TERM} AS INTEGER) AS DATE) AS due, start_date IS NULL AS needs_input FROM deadlines)"


def due(spark, sf):
    return O.deadlines(view(spark, sf, "deadlines"))


@register("l1_deadlines", duck("deadlines", f"WITH {DUE} SELECT case_id, due, needs_input FROM du"))
def l1(spark, sf):
    return due(spark, sf).select("case_id", "due", "needs_input")


@register("l2_upcoming", duck("deadlines", f"WITH {DUE} SELECT case_id, due, CAST(due - DATE '{AS_OF}' AS INTEGER) AS days_left FROM du WHERE due > DATE '{AS_OF}' AND due <= DATE '{AS_OF}' + 30"))
def l2(spark, sf):
    return O.upcoming(due(spark, sf), AS_OF).select("case_id", "due", "days_left")


@register("l3_reminders", duck("deadlines", f"WITH {DUE} SELECT case_id, concat('case ', case_id, ' due in ', due - DATE '{AS_OF}', ' days') AS message FROM du WHERE due - DATE '{AS_OF}' IN (3, 5)"))
def l3(spark, sf):
    d = O.upcoming(due(spark, sf), AS_OF).where("days_left in (3, 5)")
    return d.select("case_id", F.format_string("case %d due in %d days", "case_id", "days_left").alias("message"))


@register("l4_one_type", duck("deadlines", f"WITH {DUE} SELECT case_id, due FROM du WHERE kind = '2-HIGH' AND due > DATE '{AS_OF}'"))
def l4(spark, sf):
    return due(spark, sf).where((F.col("kind") == "2-HIGH") & (F.col("due") > F.to_date(F.lit(AS_OF)))).select("case_id", "due")


_RATE = "CASE role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.RATES.items()) + " END"


@register("l5_timesheet", duck("timesheets", f"WITH t AS (SELECT case_id, day, sum(ceil(hours * 10) / 10 * {_RATE}) AS fee FROM timesheets GROUP BY 1, 2) SELECT case_id, day, round(fee, 2) AS fee, round(sum(fee) OVER (PARTITION BY case_id ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS running FROM t"))
def l5(spark, sf):
    fee = F.ceil(F.col("hours") * 10) / 10 * O.lookup(O.RATES, F.col("role"))
    t = view(spark, sf, "timesheets").groupBy("case_id", "day").agg(F.sum(fee).alias("f"))
    run = F.sum("f").over(Window.partitionBy("case_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return t.select("case_id", "day", F.round("f", 2).alias("fee"), F.round(run, 2).alias("running"))


@register("l6_expenses", duck("timesheets", "SELECT expense_type, round(sum(amount) FILTER (WHERE billable), 2) AS billable, round(sum(amount) FILTER (WHERE NOT billable), 2) AS internal, count(*) FILTER (WHERE receipt IS NULL) AS no_receipt FROM timesheets GROUP BY 1"))
def l6(spark, sf):
    amount = F.col("amount")
    return view(spark, sf, "timesheets").groupBy("expense_type").agg(F.round(F.sum(F.when(F.col("billable"), amount)), 2).alias("billable"), F.round(F.sum(F.when(~F.col("billable"), amount)), 2).alias("internal"), F.count_if(F.col("receipt").isNull()).alias("no_receipt"))


_USE = "u AS (SELECT o_orderkey AS case_id, o_totalprice AS budget, coalesce(s, 0) AS spent FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) * 0.6 AS s FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)"


def _used(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg((F.sum("l_extendedprice") * 0.6).alias("s"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("budget"))
    return o.join(s, "case_id", "left").withColumn("spent", F.coalesce("s", F.lit(0.0)))


@register("l7_budget_bands", duck("deadlines", f"WITH {_USE} SELECT case_id, round(spent / budget * 100, 4) AS pct, CASE WHEN spent / budget * 100 < 70 THEN 'green' WHEN spent / budget * 100 <= 90 THEN 'yellow' ELSE 'red' END AS band, round(budget - spent, 2) AS remaining FROM u"))
def l7(spark, sf):
    pct = F.col("spent") / F.col("budget") * 100
    return _used(spark, sf).select("case_id", F.round(pct, 4).alias("pct"), F.when(pct < 70, "green").when(pct <= 90, "yellow").otherwise("red").alias("band"), F.round(F.col("budget") - F.col("spent"), 2).alias("remaining"))


@register("l8_economics", "SELECT o_orderkey AS case_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(o_orderkey % 10 AS DECIMAL(4,0)) * 0.1 - coalesce(s, 0) * 0.72 AS DOUBLE) AS value FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS s FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def l8(spark, sf):
    """Claim x chance - (spent + expected), in exact decimals."""
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("s"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("claim"))
    value = F.expr("claim * CAST(case_id % 10 AS DECIMAL(4,0)) * 0.1 - coalesce(s, 0) * 0.72")
    return o.join(s, "case_id", "left").select("case_id", value.cast("double").alias("value"))


@register("l9_risk_register", "WITH r AS (SELECT p_partkey AS id, 1 + p_partkey % 5 AS p, 1 + p_partkey // 5 % 5 AS i, 0.8 + p_partkey % 3 * 0.2 AS t, 1.0 + p_partkey % 2 * 0.5 AS c, 1.0 + p_partkey % 4 * 0.1 AS r FROM part) SELECT id, p * i AS base, CASE WHEN p * i < 3 THEN 'very low' WHEN p * i < 6 THEN 'low' WHEN p * i < 11 THEN 'medium' WHEN p * i < 17 THEN 'high' ELSE 'critical' END AS band, round(p * i * t * c * r, 6)::DOUBLE AS adjusted, CAST(row_number() OVER (ORDER BY round(p * i * t * c * r, 6) DESC, i DESC, p DESC, id) AS INTEGER) AS rank FROM r")
def l9(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("id"), (1 + k % 5).alias("p"), (1 + F.floor(k / 5) % 5).alias("i"), (0.8 + k % 3 * 0.2).alias("t"), (1.0 + k % 2 * 0.5).alias("c"), (1.0 + k % 4 * 0.1).alias("r"))
    return O.risk(rows).select("id", "base", "band", "adjusted", "rank")


@register("l9_critical_share", "WITH b AS (SELECT (1 + p_partkey % 5) * (1 + p_partkey // 5 % 5) AS base FROM part) SELECT count(*) AS n, count(*) FILTER (WHERE base >= 17) AS critical, round(count(*) FILTER (WHERE base >= 17) / count(*), 6) AS share, count(*) FILTER (WHERE base >= 17) / count(*) <= 0.2 AS plausible FROM b")
def l9_share(spark, sf):
    return O.critical_share(l9(spark, sf))


@register("l10_severity", "WITH s AS (SELECT CASE WHEN (s_suppkey % 3 + 1) * (s_suppkey // 3 % 3 + 1) >= 6 THEN 'high' WHEN (s_suppkey % 3 + 1) * (s_suppkey // 3 % 3 + 1) >= 3 THEN 'medium' ELSE 'low' END AS level FROM supplier) SELECT level, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY 1")
def l10(spark, sf):
    k = F.col("s_suppkey")
    g = (k % 3 + 1) * (F.floor(k / 3) % 3 + 1)
    s = table(spark, sf, "supplier").groupBy(F.when(g >= 6, "high").when(g >= 3, "medium").otherwise("low").alias("level")).agg(F.count("*").alias("n"))
    return s.select("level", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@register("l11_arguments", "WITH s AS (SELECT o_orderkey AS id, o_orderkey % 2 AS kind, o_orderkey % 11 AS a, o_custkey % 11 AS b, (o_orderkey // 11) % 11 AS c, (o_custkey // 7) % 11 AS d FROM orders), w AS (SELECT *, CASE WHEN kind = 0 THEN 0.30 * a + 0.25 * b + 0.25 * c + 0.20 * d ELSE 0.35 * a + 0.30 * b + 0.20 * c + 0.15 * d END AS score, (a < 4)::INT + (b < 4)::INT + (c < 4)::INT + (d < 4)::INT AS weak FROM s) SELECT id, round(score, 4)::DOUBLE AS score, CASE WHEN a = 0 THEN 'fatal' WHEN weak >= 2 THEN 'weak' WHEN score < 5 THEN 'weak' WHEN score < 7.5 THEN 'medium' ELSE 'strong' END AS band FROM w")
def l11(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = [k % 11, c % 11, F.floor(k / 11) % 11, F.floor(c / 7) % 11]
    score = F.when(k % 2 == 0, O.weighted(s, O.WEIGHTS["civil"])).otherwise(O.weighted(s, O.WEIGHTS["criminal"]))
    weak = sum(((x < 4).cast("int") for x in s), F.lit(0))
    rows = table(spark, sf, "orders").select(k.alias("id"), F.round(score, 4).alias("score"), weak.alias("weak"), (s[0] == 0).alias("fatal"))
    return rows.select("id", "score", F.when(F.col("fatal"), "fatal").when(F.col("weak") >= 2, "weak").otherwise(O.banded(F.col("score"), (5, "weak"), (7.5, "medium"), top="strong")).alias("band"))


_SIM = "round(0.30 * (k % 101) + 0.25 * (k * 7 % 101) + 0.25 * (k * 13 % 101) + 0.15 * (k * 17 % 101) + 0.05 * (k * 19 % 101), 4)::DOUBLE"


@register("l12_similarity", f"SELECT k AS id, {_SIM} AS score, CASE WHEN k % 23 = 0 THEN 'D' WHEN {_SIM} >= 80 THEN 'A' WHEN {_SIM} >= 60 THEN 'B' WHEN {_SIM} >= 40 THEN 'C' ELSE 'none' END AS grp FROM (SELECT o_orderkey AS k FROM orders) q")
def l12(spark, sf):
    k = F.col("o_orderkey")
    score = F.round(O.weighted([k % 101, k * 7 % 101, k * 13 % 101, k * 17 % 101, k * 19 % 101], O.SIMILARITY), 4)
    return table(spark, sf, "orders").select(k.alias("id"), score.alias("score"), F.when(k % 23 == 0, "D").otherwise(O.banded(score, (40, "none"), (60, "C"), (80, "B"), top="A")).alias("grp"))


_L13_SQL = """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderkey % 4 AS authority, n.n_regionkey AS locality, CASE WHEN o_orderkey % 25 = c_nationkey THEN 0 WHEN m.n_regionkey = n.n_regionkey THEN 1 ELSE 2 END AS line, o_custkey % 2 * 2 + o_orderkey // 4 % 2 AS proc
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation n ON n.n_nationkey = c_nationkey JOIN nation m ON m.n_nationkey = o_orderkey % 25)
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY line, authority, locality, o_orderdate DESC, proc, o_orderkey) AS INTEGER) AS place FROM o"""


@register("l13_precedents", _L13_SQL)
def l13(spark, sf):
    """A precedent's court is a nation; courts of one region are beside each other."""
    nations = table(spark, sf, "nation")
    own, other = nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("locality")), nations.select(F.col("n_nationkey").alias("court"), F.col("n_regionkey").alias("region"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").withColumn("court", F.col("o_orderkey") % 25)
    met = o.join(F.broadcast(own), "c_nationkey").join(F.broadcast(other), "court")  # 25 nations
    line = F.when(F.col("court") == F.col("c_nationkey"), "direct").when(F.col("region") == F.col("locality"), "collateral").otherwise("outside")
    names = F.array(*[F.lit(p) for p in O.PROCEDURES])
    procedure = F.element_at(names, (F.col("o_custkey") % 2 * 2 + F.floor(F.col("o_orderkey") / 4) % 2 + 1).cast("int"))
    cases = met.select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("precedent"), line.alias("court_line"), (F.col("o_orderkey") % 4).alias("authority"), "locality", F.col("o_orderdate").alias("decided"), procedure.alias("procedure"))
    return O.ranked_precedents(cases, "o_custkey").select("o_custkey", "o_orderkey", "place")


_RET = "WITH g AS (SELECT l.doc_id, source FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1), p AS (SELECT doc_id, source FROM documents WHERE length(text) > 300), f AS (SELECT coalesce(g.source, p.source) AS source, count(*) FILTER (WHERE g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(g.doc_id) AS g, count(p.doc_id) AS p FROM g FULL JOIN p ON g.doc_id = p.doc_id GROUP BY 1)"


def _retrieval(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    g = table(spark, sf, "labels").where("quality = 1").select("doc_id").join(d.select("doc_id", "source"), "doc_id").withColumnsRenamed({"source": "gs"}).withColumn("g", F.lit(1))
    p = d.where(F.length("text") > 300).select("doc_id", F.col("source").alias("ps"), F.lit(1).alias("p"))
    both = g.join(p, "doc_id", "full").withColumn("source", F.coalesce("gs", "ps"))
    return both.groupBy("source").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count("g").alias("g"), F.count("p").alias("p"))


@register("l14_retrieval_quality", _RET + " SELECT source, round(tp / g, 6) AS recall, round(tp / p, 6) AS precision, CASE WHEN tp / g >= 0.85 AND tp / p >= 0.7 THEN 'accept' WHEN tp / g >= 0.85 THEN 'narrow' WHEN tp / p >= 0.7 THEN 'widen' ELSE 'redo' END AS action FROM f")
def l14(spark, sf):
    r, p = F.try_divide("tp", "g"), F.try_divide("tp", "p")
    return _retrieval(spark, sf).select("source", F.round(r, 6).alias("recall"), F.round(p, 6).alias("precision"), F.when((r >= 0.85) & (p >= 0.7), "accept").when(r >= 0.85, "narrow").when(p >= 0.7, "widen").otherwise("redo").alias("action"))


@register("u5_result_overlap", _RET + " SELECT source, round(tp / (g + p - tp), 6) AS overlap, g - tp AS only_first, p - tp AS only_second, abs(g - p) > 0.2 * greatest(g, p) AS differs FROM f")
def u5(spark, sf):
    g, p, tp = F.col("g"), F.col("p"), F.col("tp")
    return _retrieval(spark, sf).select("source", F.round(tp / (g + p - tp), 6).alias("overlap"), (g - tp).alias("only_first"), (p - tp).alias("only_second"), (F.abs(g - p) > 0.2 * F.greatest(g, p)).alias("differs"))


_V = "CASE WHEN valid_from > DATE '1997-01-01' THEN 'not yet' WHEN valid_to IS NULL THEN 'in force' WHEN valid_to > DATE '1997-01-01' THEN 'in force, to be replaced' WHEN level = 1 THEN 'repealed by law' ELSE 'replaced' END"


@register("l15_validity", duck("norm_versions", f"SELECT version_id, {_V} AS verdict FROM norm_versions"))
def l15(spark, sf):
    day = F.to_date(F.lit("1997-01-01"))
    v = F.when(F.col("valid_from") > day, "not yet").when(F.col("valid_to").isNull(), "in force").when(F.col("valid_to") > day, "in force, to be replaced").when(F.col("level") == 1, "repealed by law").otherwise("replaced")
    return view(spark, sf, "norm_versions").select("version_id", v.alias("verdict"))


@register("j15_in_force", duck("norm_versions", "WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS fact_id, o_custkey AS norm_id, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT fact_id, f.norm_id, day, version_id FROM f LEFT JOIN norm_versions v ON v.norm_id = f.norm_id AND day >= valid_from AND (valid_to IS NULL OR day < valid_to)"))
def j15(spark, sf):
    f = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    facts = f.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.col("o_custkey").alias("norm_id"), F.col("l_shipdate").cast("date").alias("day"))
    return O.in_force(facts, view(spark, sf, "norm_versions")).drop("level")


@register("j16_norm_conflicts", duck("norm_versions", "SELECT a.norm_id, a.version_id AS a, b.version_id AS b, CASE WHEN a.level < b.level THEN 'a: hierarchy' WHEN a.level > b.level THEN 'b: hierarchy' WHEN a.version_id % 7 = 0 AND b.version_id % 7 = 0 THEN 'refer' WHEN a.valid_from > b.valid_from THEN 'a: newer' WHEN a.valid_from < b.valid_from THEN 'b: newer' ELSE 'refer' END AS verdict FROM norm_versions a JOIN norm_versions b ON a.norm_id = b.norm_id AND a.version_id < b.version_id"))
def j16(spark, sf):
    """Pairs of one norm's versions: a norm has a bounded history."""
    v = view(spark, sf, "norm_versions")
    a, b = v.select("norm_id", *[F.col(c).alias(f"a_{c}") for c in ("version_id", "level", "valid_from")]), v.select("norm_id", *[F.col(c).alias(f"b_{c}") for c in ("version_id", "level", "valid_from")])
    m = a.join(b, "norm_id").where("a_version_id < b_version_id")
    verdict = F.when(F.col("a_level") < F.col("b_level"), "a: hierarchy").when(F.col("a_level") > F.col("b_level"), "b: hierarchy").when((F.col("a_version_id") % 7 == 0) & (F.col("b_version_id") % 7 == 0), "refer").when(F.col("a_valid_from") > F.col("b_valid_from"), "a: newer").when(F.col("a_valid_from") < F.col("b_valid_from"), "b: newer").otherwise("refer")
    return m.select("norm_id", F.col("a_version_id").alias("a"), F.col("b_version_id").alias("b"), verdict.alias("verdict"))


@register("l16_evidence_coverage", "SELECT o_orderkey AS claim, o_orderkey % 4 AS element, count(l_orderkey) AS evidence, repeat('*', CAST(least(5, count(l_orderkey)) AS INTEGER)) AS stars, count(l_orderkey) = 0 AS gap FROM orders LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') l ON l_orderkey = o_orderkey GROUP BY 1, 2")
def l16(spark, sf):
    e = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("claim")).agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim"), (F.col("o_orderkey") % 4).alias("element"))
    n = F.coalesce("n", F.lit(0))
    return o.join(e, "claim", "left").select("claim", "element", n.alias("evidence"), F.expr("repeat('*', CAST(least(5, coalesce(n, 0)) AS INT))").alias("stars"), (n == 0).alias("gap"))


@register("l18_damages", "WITH r AS (SELECT c_custkey AS id, 30000.0::DOUBLE + c_custkey % 100 * 100 AS income, (1 + c_custkey % 10) / 10.0 AS degree, 20 + c_custkey % 70 AS age, c_custkey % 4 / 10.0 AS fault FROM customer), y AS (SELECT *, CASE WHEN age >= 75 THEN 5 WHEN age >= 60 THEN 80 - age ELSE 20 END AS years FROM r) SELECT id, CAST(years AS BIGINT) AS years, round(income * years * degree, 2)::DOUBLE AS disability, round((income * years * degree + income / 2) * (1 - fault), 2)::DOUBLE AS total FROM y")
def l18(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("id"), (F.lit(30000.0) + k % 100 * 100).alias("income"), ((1 + k % 10) / 10).alias("degree"), (20 + k % 70).alias("age"), (k % 4 / 10).alias("fault"))
    return O.damages(rows).select("id", F.col("years").cast("long").alias("years"), "disability", "total")


@register("l19_fine_bands", "SELECT o_orderkey AS id, CASE WHEN o_totalprice < 20000 THEN 'mitigated' WHEN (o_totalprice - 20000) / 200000 <= 0.3 THEN 'lenient' WHEN (o_totalprice - 20000) / 200000 >= 0.7 THEN 'severe' ELSE 'medium' END AS band FROM orders")
def l19(spark, sf):
    at = (F.col("o_totalprice") - 20000) / 200000
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(at < 0, "mitigated").when(at <= 0.3, "lenient").when(at >= 0.7, "severe").otherwise("medium").alias("band"))


@register("l21_compliance", "WITH h AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT p_partkey AS item, CASE WHEN n IS NULL THEN 'missing' WHEN n < 3 THEN 'partial' ELSE 'covered' END AS state, CAST(row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY coalesce(n, 0), p_partkey) AS INTEGER) AS finding FROM part LEFT JOIN h ON l_partkey = p_partkey")
def l21(spark, sf):
    h = table(spark, sf, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("n"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item")).join(h, "item", "left")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") < 3, "partial").otherwise("covered")
    found = numbered_by(p.select("item", state.alias("state"), (F.col("item") % 5).alias("level"), F.coalesce("n", F.lit(0)).alias("n")), ["level"], ["n", "item"], "finding")
    return found.select("item", "state", "finding")


@register("l21_findings", "WITH h AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT p_partkey % 5 AS level, count(*) AS items, count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE n < 3) AS partial, count(*) FILTER (WHERE n >= 3) AS covered, round(count(*) FILTER (WHERE n >= 3) / count(*), 6) AS share FROM part LEFT JOIN h ON l_partkey = p_partkey GROUP BY 1")
def l21_findings(spark, sf):
    """Findings of each level by state."""
    by = l21(spark, sf).groupBy((F.col("item") % 5).alias("level")).agg(F.count("*").alias("items"), *[F.count_if(F.col("state") == s).alias(s) for s in ("missing", "partial", "covered")])
    return by.select("*", F.round(F.col("covered") / F.col("items"), 6).alias("share"))


@register("l22_timeline", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place, min(event_type) OVER f <> max(event_type) OVER f AS disputed FROM events WINDOW f AS (PARTITION BY user_id, CAST(ts AS DATE))")
def l22(spark, sf):
    fact = Window.partitionBy("user_id", F.to_date("ts"))
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("place"), (F.min("event_type").over(fact) != F.max("event_type").over(fact)).alias("disputed"))
