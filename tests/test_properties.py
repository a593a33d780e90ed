"""Properties of the analyses on the driver fixture."""
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators.global_window import GlobalSpec, asc, desc, global_windows
from basketry.plans import operations, operator_keys, revenue
from basketry.plans.common import CANCELLED


def test_shares_sum_to_100(shop):
    total = operator_keys.op_share_of_total(shop).agg(F.sum("share_pct")).first()[0]
    assert abs(total - 100.0) < 0.0001 * 2000


def test_cohort_month_zero_is_cohort_size(shop):
    cells = {(r.cohort_month, r.months_since_join): r.active_customers
             for r in operations.cohort_retention(shop, k=None).collect()}
    first = (shop.orders_where(not_status=CANCELLED).groupBy("customer_id")
             .agg(F.date_format(F.min("order_date"), "yyyy-MM").alias("m")).groupBy("m").count().collect())
    assert {r.m: r["count"] for r in first} == {m: n for (m, k), n in cells.items() if k == 0}


def test_pivot_columns_add_up_to_total(shop):
    for r in revenue.city_payment_pivot(shop).collect():
        parts = r.upi_revenue + r.card_revenue + r.netbanking_revenue + r.cod_revenue + r.wallet_revenue
        assert abs(parts - r.total_revenue) <= 2.5


def test_funnel_counts_add_up(shop):
    for r in operations.order_funnel(shop, k=1000).collect():
        assert r.delivered + r.in_transit + r.cancelled + r.returned == r.total_orders


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(-3, 3), st.integers(-10**6, 10**6)), min_size=0, max_size=120),
       buckets=st.integers(1, 9))
def test_global_windows_equal_native(spark, values, buckets):
    df = spark.createDataFrame([(i, v, Decimal(i % 7)) for i, v in enumerate(values)], "id long, v long, d decimal(10,2)")
    out = global_windows(df, [GlobalSpec((desc("v"),), ("id",), rank="rk", ntile=("nt", 3), running_sum=("rs", "d")),
                              GlobalSpec((asc("v"),), ("id",), row_number="rn")],
                         buckets=buckets, materialize=False)
    w = Window.orderBy(F.col("v").desc_nulls_last(), "id")
    ref = (df.withColumn("rk2", F.rank().over(Window.orderBy(F.col("v").desc_nulls_last())))
           .withColumn("nt2", F.ntile(3).over(w))
           .withColumn("rs2", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("rn2", F.row_number().over(Window.orderBy(F.col("v").asc_nulls_first(), "id"))))
    got = {r.id: (r.rk, r.nt, r.rs, r.rn) for r in out.collect()}
    exp = {r.id: (r.rk2, r.nt2, r.rs2, r.rn2) for r in ref.collect()}
    assert got == exp
