"""Case management rules: deadlines, budgets, risk, scoring, precedent, norms. Rule tables are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import carried_last, numbered

# Fixed values.
TERMS = {"1-URGENT": 5, "2-HIGH": 15, "3-MEDIUM": 30, "4-NOT SPECIFIED": 60, "5-LOW": 90}
RATES = {"partner": 500.0, "associate": 250.0, "counsel": 350.0, "paralegal": 120.0}
WEIGHTS = {"civil": (0.30, 0.25, 0.25, 0.20), "criminal": (0.35, 0.30, 0.20, 0.15)}
SIMILARITY = (0.30, 0.25, 0.25, 0.15, 0.05)


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def banded(value: Column, *steps: tuple[float, str], top: str) -> Column:
    """The name of the first step that value is under, else top."""
    out = None
    for limit, name in steps:
        out = F.when(value < limit, name) if out is None else out.when(value < limit, name)
    return out.otherwise(top)


def deadlines(cases: DataFrame, terms: dict[str, int] = TERMS) -> DataFrame:
    """Adds due and needs_input, for cases without a start (L1)."""
    return cases.withColumn("due", F.date_add("start_date", lookup(terms, F.col("kind")))).withColumn("needs_input", F.col("start_date").isNull())


def upcoming(due: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Due after as_of and at most `days` later (L2)."""
    left = F.datediff("due", F.to_date(F.lit(as_of)))
    return due.withColumn("days_left", left).where((left > 0) & (left <= days))


def risk(rows: DataFrame) -> DataFrame:
    """p, i, t, c, r to base, band, adjusted and rank by adjusted, i, p, id."""
    base = F.col("p") * F.col("i")
    adjusted = base * F.col("t") * F.col("c") * F.col("r")
    out = rows.withColumn("base", base).withColumn("band", banded(base, (3, "very low"), (6, "low"), (11, "medium"), (17, "high"), top="critical")).withColumn("adjusted", F.round(adjusted, 6))
    return numbered(out, [F.desc("adjusted"), F.desc("i"), F.desc("p"), F.asc("id")], "rank")


def weighted(scores: list[Column], weights: tuple[float, ...]) -> Column:
    return sum((s * w for s, w in zip(scores, weights, strict=True)), F.lit(0.0))


def critical_share(bands: DataFrame, most: float = 0.2) -> DataFrame:
    """How many risks are critical, their share, and whether it is at most `most`."""
    n = bands.agg(F.count("*").alias("n"), F.count_if(F.col("band") == "critical").alias("critical"))
    share = F.coalesce(F.try_divide("critical", "n"), F.lit(0.0))
    return n.select("n", "critical", F.round(share, 6).alias("share"), (share <= most).alias("plausible"))


#: Procedures by the weight of their reasons.
PROCEDURES = {"retrial": 0, "second instance": 1, "first instance": 2, "review": 3}


def ranked_precedents(cases: DataFrame, key: str) -> DataFrame:
    """Place of each precedent of a case (L13): those of the courts above its own come before those beside it and those of other lines; then by authority, locality, the newer, and procedure.

    cases: key, precedent, court_line (direct, collateral, else outside), authority and locality (ranks), decided, procedure. A case's precedents are a bounded list.
    """
    line = F.when(F.col("court_line") == "direct", 0).when(F.col("court_line") == "collateral", 1).otherwise(2)
    by = Window.partitionBy(key).orderBy(line, "authority", "locality", F.desc("decided"), F.coalesce(lookup(PROCEDURES, F.col("procedure")), F.lit(len(PROCEDURES))), "precedent")
    return cases.withColumn("place", F.row_number().over(by))


def conflicts(views: DataFrame, topic: list[str], view: str, core: float = 1 / 3) -> DataFrame:
    """Conflicts of each topic (L17): its commonest view (the smaller of equals) against each other one, with their documents and whether the conflict is a core one, that is the other
    view has `core` or more of the two's documents. views: topic, view, n."""
    best = F.max_by(F.struct(F.col(view).alias("v"), "n"), F.struct("n", -F.col(view)))
    top = views.groupBy(*topic).agg(best.alias("a"))
    other = views.join(top, topic).where(F.col(view) != F.col("a.v"))
    share = F.col("n") / (F.col("n") + F.col("a.n"))
    return other.select(*topic, F.col("a.v").alias("view_a"), F.col(view).alias("view_b"), F.col("a.n").alias("docs_a"), F.col("n").alias("docs_b"), F.when(share >= core, "core").otherwise("minor").alias("weight"))


def in_force(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """The version of each norm in force at the fact's day (J15). Versions of a norm follow each other, so one ordered pass with the
    last version carried along replaces an interval join; it runs in ranges, so a norm may have any number of facts."""
    v = versions.select("norm_id", F.col("valid_from").alias("day"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("fact_id"), F.struct("version_id", "valid_to", "level").alias("v"))
    f = facts.select("norm_id", "day", F.lit(1).alias("o"), "fact_id", F.lit(None).cast(v.schema["v"].dataType).alias("v"))
    both = v.unionByName(f).withColumn("version", F.col("v.version_id"))
    carried = carried_last(both, ["norm_id"], ["day", "o", "version", "fact_id"], "v", "now")
    return carried.where("o = 1").where(F.col("now").isNull() | F.col("now.valid_to").isNull() | (F.col("day") < F.col("now.valid_to"))).select("fact_id", "norm_id", "day", F.col("now.version_id").alias("version_id"), F.col("now.level").alias("level"))


def damages(rows: DataFrame) -> DataFrame:
    """income, degree, age, fault to disability compensation and total (L18): 20 years, a year less for each from 60, 5 from 75."""
    years = F.when(F.col("age") >= 75, 5).when(F.col("age") >= 60, 20 - (F.col("age") - 60)).otherwise(20)
    disability = F.col("income") * years * F.col("degree")
    funeral = F.col("income") / 12 * 6
    return rows.withColumns({"years": years, "disability": F.round(disability, 2), "total": F.round((disability + funeral) * (1 - F.col("fault")), 2)})
