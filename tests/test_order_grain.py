"""Kept order totals: the same rows, no line items read, stale after appends."""
import pytest

from basketry.plans import customer, operations, revenue
from basketry.plans.common import order_totals
from basketry.sources import order_grain
from basketry.sources.fixture import DRIVER_TABLES, load

SF = "/root/testdata/sf0.001"


@pytest.fixture
def grown(spark, tmp_path):
    """A shop whose line items are a folder that files can be added to."""
    for name in DRIVER_TABLES:
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        (df.where("l_orderkey % 4 < 3") if name == "lineitem" else df).write.parquet(f"{tmp_path}/sf/{name}.parquet")
    return f"{tmp_path}/sf", f"{tmp_path}/kept"


def rows(df):
    return sorted(map(str, df.collect()))


def test_kept_totals_serve_the_analyses(spark, grown):
    sf, kept = grown
    assert load(spark, sf, kept).kept_order_totals() is None  # nothing kept yet
    order_grain.write(load(spark, sf), order_totals(load(spark, sf)), kept, buckets=4)
    for build in (customer.clv_ranking, revenue.monthly_trend, customer.new_vs_returning, operations.order_funnel):
        made = build(load(spark, sf, kept))
        assert rows(made) == rows(build(load(spark, sf)))
        assert "lineitem" not in made._jdf.queryExecution().executedPlan().toString()


def test_appended_files_make_them_stale(spark, grown):
    sf, kept = grown
    order_grain.write(load(spark, sf), order_totals(load(spark, sf)), kept, buckets=4)
    before = rows(revenue.monthly_trend(load(spark, sf, kept)))
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 4 = 3").write.mode("append").parquet(f"{sf}/lineitem.parquet")
    assert load(spark, sf, kept).kept_order_totals() is None
    after = rows(revenue.monthly_trend(load(spark, sf, kept)))
    assert after == rows(revenue.monthly_trend(load(spark, SF))) != before
    order_grain.write(load(spark, sf), order_totals(load(spark, sf)), kept, buckets=4)
    assert rows(revenue.monthly_trend(load(spark, sf, kept))) == after and load(spark, sf, kept).kept_order_totals() is not None


def test_a_writer_that_fails_leaves_the_older_totals(spark, grown):
    sf, kept = grown
    shop = load(spark, sf)
    order_grain.write(shop, order_totals(shop), kept, buckets=4)
    broken = order_totals(shop).selectExpr("order_id", "revenue", "profit", "assert_true(order_id < 0) IS NULL AS n_items", "units")
    with pytest.raises(Exception):
        order_grain.write(shop, broken, kept, buckets=4)
    assert rows(load(spark, sf, kept).kept_order_totals()) == rows(order_totals(shop))


def test_another_application_finds_the_buckets(spark, grown):
    sf, kept = grown
    shop = load(spark, sf)
    order_grain.write(shop, order_totals(shop), kept, buckets=4)
    for t in spark.catalog.listTables():
        if t.name.startswith("order_totals_") and t.tableType == "EXTERNAL":
            spark.sql(f"DROP TABLE {t.name}")  # external: the files stay
    again = load(spark, sf, kept).kept_order_totals()
    assert rows(again) == rows(order_totals(shop))
    plan = again.groupBy("order_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
