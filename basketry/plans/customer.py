"""Customer analyses: CLV ranking, RFM segments, new vs returning, churn.

All customer-level numbers come from the order-grain pre-aggregate
(``valued_orders``), aggregated by customer with map-side combine, so a
customer with a third of all orders is reduced before any shuffle.  Global
windows over customers use ``selection`` / ``topk`` (no single task).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.expr import big, days_between, ratio, rnd, rnd_dec
from basketry.operators.global_window import asc, desc
from basketry.operators.selection import Tiles, exact_ntiles
from basketry.operators.topk import topk
from basketry.plans.common import DELIVERED, FIXTURE_AS_OF, order_totals, valued_orders
from basketry.sources.fixture import Shop


def customer_metrics(shop: Shop) -> DataFrame:
    """Per customer with delivered, itemised orders (inner joins, as the
    reference): orders, revenue, line count, first and last order date,
    with the customer's city and segment."""
    per = (valued_orders(shop, DELIVERED).groupBy("customer_id")
           .agg(F.count(F.lit(1)).alias("total_orders"), F.sum("revenue").alias("rev"),
                F.sum("n_items").alias("n_items"),
                F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order")))
    return per.join(shop.customers.select("customer_id", "city", "segment"), "customer_id")


def clv_ranking(shop: Shop, k: int = 20, true_aov: bool = False) -> DataFrame:
    """Q5: top-k customers by lifetime revenue with global RANK and NTILE(4).

    ``avg_order_value`` is, as in the reference, the average per line item
    (quirk 2); ``true_aov=True`` adds ``true_aov``, revenue per order."""
    cm = customer_metrics(shop).select(
        "customer_id", "city", "segment", big("total_orders").alias("total_orders"),
        F.round("rev", 2).alias("lifetime_revenue"),
        rnd(ratio("rev", "n_items"), 2).alias("avg_order_value"),
        big(days_between("last_order", "first_order")).alias("customer_lifespan_days"),
        rnd(ratio("rev", "total_orders"), 2).alias("true_aov"))
    top = topk(cm, k, [desc("lifetime_revenue")], ["customer_id"],
               rank="revenue_rank", ntile=("revenue_quartile", 4))
    return top.select(
        "customer_id", "city", "segment", "total_orders",
        F.col("lifetime_revenue").cast("double").alias("lifetime_revenue"),
        "avg_order_value", "customer_lifespan_days", "revenue_rank", "revenue_quartile",
        rnd(ratio("lifetime_revenue", F.nullif(F.col("customer_lifespan_days"), F.lit(0))) * F.lit(30), 2)
        .alias("monthly_clv"), *(["true_aov"] if true_aov else [])).orderBy("revenue_rank", "customer_id")


def clv_rank_full(shop: Shop, k: int = 20) -> DataFrame:
    """Q20 (script variant): all CTE columns incl. first/last order date."""
    cm = customer_metrics(shop).select(
        "customer_id", "city", "segment", big("total_orders").alias("total_orders"),
        F.round("rev", 2).alias("lifetime_revenue"), "first_order", "last_order")
    top = topk(cm, k, [desc("lifetime_revenue")], ["customer_id"],
               rank="revenue_rank", ntile=("revenue_quartile", 4))
    return top.select("customer_id", "city", "segment", "total_orders",
                      F.col("lifetime_revenue").cast("double").alias("lifetime_revenue"),
                      "first_order", "last_order", "revenue_rank", "revenue_quartile"
                      ).orderBy("revenue_rank", "customer_id")


# RFM segment rule, first match wins (fixed values of the reference).
def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    return (F.when((r >= 4) & (f >= 4), "Champions")
            .when((r >= 3) & (f >= 3), "Loyal Customers")
            .when((r >= 4) & (f < 3), "Promising")
            .when((r <= 2) & ((r + f + m) >= 8), "At Risk")
            .when((r <= 2) & (f <= 2), "Lost")
            .otherwise("Needs Attention"))


def rfm_customers(shop: Shop, as_of: dt.date = FIXTURE_AS_OF, high_is_good: bool = False) -> DataFrame:
    """Per-customer RFM scores (the reference's rfm_segments CTE).

    NTILE(5) over recency ASC, frequency DESC, monetary DESC, ties broken by
    customer_id.  As in the reference, score 1 goes to the most recent /
    most frequent / highest spender while 'Champions' needs scores >= 4
    (literal reading); ``high_is_good=True`` flips scores to the
    conventional direction (6 - score)."""
    base = (valued_orders(shop, DELIVERED).groupBy("customer_id")
            .agg(F.max("order_date").alias("last"), F.count(F.lit(1)).alias("frequency"),
                 F.sum("revenue").alias("rev"))
            .select("customer_id",
                    big(days_between(F.lit(as_of), "last")).alias("recency_days"),
                    big("frequency").alias("frequency"),
                    F.round("rev", 2).alias("monetary")))
    s = exact_ntiles(base, [Tiles("r_score", 5, (asc("recency_days"),), ("customer_id",)),
                            Tiles("f_score", 5, (desc("frequency"),), ("customer_id",)),
                            Tiles("m_score", 5, (desc("monetary"),), ("customer_id",))])
    if high_is_good:
        for c in ("r_score", "f_score", "m_score"):
            s = s.withColumn(c, F.lit(6) - F.col(c))
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return s.select("customer_id", "recency_days", "frequency",
                    F.col("monetary").cast("double").alias("monetary"),
                    big(r).alias("r_score"), big(f).alias("f_score"), big(m).alias("m_score"),
                    big(r + f + m).alias("rfm_total"), rfm_segment(r, f, m).alias("segment"))


def rfm(shop: Shop, as_of: dt.date = FIXTURE_AS_OF, full: bool = True, high_is_good: bool = False) -> DataFrame:
    """Q6 (and Q21 with ``full=False``): segment summary of the RFM scores."""
    per = rfm_customers(shop, as_of, high_is_good)
    aggs = [big(F.count(F.lit(1))).alias("customers")]
    if full:
        aggs += [rnd(ratio(F.sum("recency_days"), F.count(F.lit(1))), 0).alias("avg_recency_days"),
                 rnd(ratio(F.sum("frequency"), F.count(F.lit(1))), 1).alias("avg_orders")]
    # monetary is a 2-dp value: sum it exactly as DECIMAL
    money = F.col("monetary").cast("decimal(18,2)")
    aggs += [rnd(ratio(F.sum(money), F.count(F.lit(1))), 0).alias("avg_revenue"),
             rnd_dec(F.sum(money), 0).alias("total_revenue")]
    return per.groupBy("segment").agg(*aggs).orderBy(F.desc("total_revenue"), "segment")


def new_vs_returning(shop: Shop) -> DataFrame:
    """Q7: delivered revenue by month, split by whether the order fell on the
    customer's first order date (taken over all statuses, quirk 4).

    One pass over all orders: each (customer, date), bounded per customer by
    the calendar, carries its delivered measures, and the customer's first
    date is a window minimum over these rows."""
    delivered = F.col("status") == DELIVERED
    cd = (shop.orders.join(order_totals(shop), "order_id", "left").groupBy("customer_id", "order_date")
          .agg(F.count(F.when(delivered, F.col("revenue"))).alias("n_orders"),
               F.sum(F.when(delivered, F.col("revenue"))).alias("rev"),
               F.sum(F.when(delivered, F.col("n_items"))).alias("n_items")))
    first = F.min("order_date").over(Window.partitionBy("customer_id"))
    typed = (cd.withColumn("first_date", first).where(F.col("n_orders") > 0)
             .withColumn("customer_type", F.when(F.col("order_date") == F.col("first_date"), "New Customer")
                         .otherwise("Returning Customer"))
             .withColumn("month", F.date_format("order_date", "yyyy-MM")))
    per_cust = (typed.groupBy("customer_type", "month", "customer_id")
                .agg(F.sum("n_orders").alias("n_orders"), F.sum("rev").alias("rev"),
                     F.sum("n_items").alias("n_items")))
    return (per_cust.groupBy("customer_type", "month")
            .agg(big(F.sum("n_orders")).alias("orders"), big(F.count(F.lit(1))).alias("customers"),
                 rnd_dec(F.sum("rev"), 2).alias("revenue"),
                 rnd(ratio(F.sum("rev"), F.sum("n_items")), 2).alias("avg_order_value"))
            .orderBy("month", "customer_type"))


def churn_status(days: Column) -> Column:
    # Thresholds in days, fixed values of the reference.
    return (F.when(days > 180, "Churned").when(days > 90, "At Risk")
            .when(days > 30, "Cooling Off").otherwise("Active"))


def churn(shop: Shop, as_of: dt.date = FIXTURE_AS_OF, k: int = 25) -> DataFrame:
    """Q8: the k customers longest inactive (delivered, itemised orders)."""
    cm = customer_metrics(shop)
    days = big(days_between(F.lit(as_of), "last_order"))
    out = cm.select("customer_id", "city", "segment", F.col("last_order").alias("last_order_date"),
                    big("total_orders").alias("total_orders"), rnd_dec("rev", 2).alias("total_revenue"),
                    days.alias("days_since_last_order"), churn_status(days).alias("churn_status"))
    return out.orderBy(F.desc("days_since_last_order"), "customer_id").limit(k)


def churn_basic(shop: Shop, as_of: dt.date = FIXTURE_AS_OF) -> DataFrame:
    """Q22 (script variant): every customer with a delivered order (items
    not required), full sort by inactivity."""
    last = (shop.orders_where(DELIVERED)
            .groupBy("customer_id").agg(F.max("order_date").alias("last_order_date")))
    days = big(days_between(F.lit(as_of), "last_order_date"))
    return (last.join(shop.customers.select("customer_id", "city", "segment"), "customer_id")
            .select("customer_id", "city", "segment", "last_order_date", days.alias("days_inactive"),
                    churn_status(days).alias("churn_status"))
            .orderBy(F.desc("days_inactive"), "customer_id"))
