"""Views cover their tables whole, whatever the ids."""

import os

import pytest

from quillgrade.plans.views import keyed, table, view

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The smallest tables, with order ids far from one."""
    path = str(tmp_path_factory.mktemp("far"))
    for name in ("lineitem", "part"):
        t = table(spark, SF, name)
        (t.withColumn("l_orderkey", t["l_orderkey"] + 100_000) if name == "lineitem" else t).write.parquet(f"{path}/{name}.parquet")
    return path


def test_every_order_is_a_sheet(spark, far):
    n = table(spark, far, "lineitem").count()
    orders = table(spark, far, "lineitem").select("l_orderkey").distinct().count()
    assert n > 0 and keyed(spark, far).count() == n
    assert view(spark, far, "answer_key").select("sheet_id").distinct().count() == orders
    assert view(spark, far, "answers").count() > n * 3 // 4


def test_every_line_is_a_word_and_a_rect(spark, far):
    n = table(spark, far, "lineitem").count()
    assert view(spark, far, "words").count() == view(spark, far, "rects").count() == n
    assert view(spark, far, "words").groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 10 * 7 * 2
