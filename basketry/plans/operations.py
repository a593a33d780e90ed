"""Operational metrics: order funnel, monthly seasonality, cohort retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.expr import big, count_if, month_diff, month_name, pct, rnd
from basketry.plans.common import CANCELLED
from basketry.sources.fixture import Shop

STATUS_COLUMNS = [("Delivered", "delivered"), ("Shipped", "in_transit"),
                  ("Cancelled", "cancelled"), ("Returned", "returned")]


def order_funnel(shop: Shop, k: int = 20) -> DataFrame:
    """Q12: order counts by (order city, payment) and status rates.

    Counts are first taken per (customer, payment), which shrinks the input
    of the customer -> region join, then summed per (city, payment)."""
    st = F.col("status")
    per_key = (shop.orders.groupBy(shop.city_key, "payment")
               .agg(F.count(F.lit(1)).alias("total"),
                    *[count_if(st == F.lit(s)).alias(n) for s, n in STATUS_COLUMNS]))
    lookup = shop.city_lookup()
    with_city = per_key if lookup is None else per_key.join(lookup, shop.city_key, "left")
    agg = (with_city.groupBy("city", "payment")
           .agg(big(F.sum("total")).alias("total_orders"),
                *[big(F.sum(n)).alias(n) for _, n in STATUS_COLUMNS]))
    out = agg.select("city", "payment", "total_orders", "delivered", "in_transit", "cancelled", "returned",
                     rnd(pct("cancelled", "total_orders"), 1).alias("cancellation_rate_pct"),
                     rnd(pct("returned", "total_orders"), 1).alias("return_rate_pct"),
                     rnd(pct("delivered", "total_orders"), 1).alias("delivery_success_pct"))
    return out.orderBy(F.desc("total_orders"), "city", "payment").limit(k)


def monthly_seasonality(shop: Shop, share_within_year: bool = False) -> DataFrame:
    """Q13 ('Peak Sales Hours'): orders by year and month, all statuses, with
    the month's share of *all* orders (quirk 3; ``share_within_year=True``
    gives the share of the month's own year instead).  The share is a window
    over the aggregated months, a calendar-bounded handful of rows."""
    o = shop.orders
    agg = (o.groupBy(F.date_format("order_date", "yyyy").alias("year"),
                     F.date_format("order_date", "MM").alias("month"))
           .agg(F.count(F.lit(1)).alias("total_orders"),
                count_if(F.col("status") == F.lit("Delivered")).alias("delivered_orders"),
                F.min("order_date").alias("any_day")))
    total = F.sum("total_orders").over(Window.partitionBy("year") if share_within_year else Window.partitionBy())
    return (agg.select("year", "month", month_name("any_day").alias("month_name"),
                       big("total_orders").alias("total_orders"), big("delivered_orders").alias("delivered_orders"),
                       rnd(pct("total_orders", total), 2).alias("pct_of_annual_orders"))
            .orderBy("year", "month"))


def cohort_retention(shop: Shop, max_months: int = 6, k: int | None = 42) -> DataFrame:
    """Q14: customers active n calendar months after their first
    non-cancelled month, n = 0..max_months.

    Orders are reduced to distinct (customer, month) first; the cohort month
    is a window min over that grain, which is bounded per customer by the
    calendar, so a hot customer never loads one task."""
    cm = (shop.orders_where(not_status=CANCELLED)
          .select("customer_id", F.trunc("order_date", "month").alias("m")).distinct())
    with_cohort = cm.withColumn("cohort", F.min("m").over(Window.partitionBy("customer_id")))
    diff = month_diff("m", "cohort")
    out = (with_cohort.where(diff.between(0, max_months))
           .groupBy(F.date_format("cohort", "yyyy-MM").alias("cohort_month"), diff.alias("months_since_join"))
           .agg(big(F.count(F.lit(1))).alias("active_customers"))
           .select("cohort_month", big("months_since_join").alias("months_since_join"), "active_customers")
           .orderBy("cohort_month", "months_since_join"))
    return out.limit(k) if k else out
