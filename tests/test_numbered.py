"""A number over all rows is counted in ranges and not in one task."""

import random

from docketry.plans import corpus


def test_number_is_the_place_in_order(spark):
    r = random.Random(1)
    rows = list({(r.randrange(3), r.randrange(10**6)) for _ in range(3000)}) + [(1, None)]
    out = corpus.numbered(spark.createDataFrame(rows, "rank int, doc_id long"), ["rank", "doc_id"], "place")
    want = sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    assert [(x["rank"], x["doc_id"]) for x in sorted(out.collect(), key=lambda x: x["place"])] == want
    assert sorted(x["place"] for x in out.collect()) == list(range(1, len(rows) + 1))


def test_triage_numbers_inside_ranges(spark, sf_dir):
    plan = corpus.f2(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(__part" in plan
