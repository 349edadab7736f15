"""Boxes that share an id inside an image all take part in the queries without SQL."""

import pytest
from pyspark.sql import functions as F

from docketry.plans import evaluation as E


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """One image whose boxes all have the same id and stand apart."""
    p = str(tmp_path_factory.mktemp("boxes"))
    for t in ("orders", "customer"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(1).write.parquet(f"{p}/{t}.parquet")
    first = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(1)
    rows = first.drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").crossJoin(spark.range(6)).withColumns(
        {"l_orderkey": F.lit(1).cast("long"), "l_linenumber": F.lit(1), "l_partkey": F.col("id") * 3 + 1, "l_suppkey": F.col("id") * 2, "l_returnflag": F.lit("N")}
    )
    rows.drop("id").write.parquet(f"{p}/lineitem.parquet")
    return p


def test_every_box_has_its_own_id(spark, folder):
    for boxes in (E._all_gt(spark, folder), E._all_pred(spark, folder)):
        assert sorted(r["box_id"] for r in boxes.collect()) == [1, 2, 3, 4, 5, 6]


def test_all_boxes_count(spark, folder):
    assert E.j7(spark, folder).count() == E.j8(spark, folder).count() == E.j10(spark, folder).count() == 6
    assert E.t4(spark, folder).count() == E.t5(spark, folder).count() == 6
    assert E.a28(spark, folder).select("gt", "pred", "matched").collect() == [(6, 6, 6)]
    assert not E.a26(spark, folder).isEmpty() and not E.a27(spark, folder).isEmpty() and not E.w20(spark, folder).isEmpty()
