"""Advanced SQL: the window-function showcase and the order journey."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.expr import big, ratio, rnd, rnd_dec
from basketry.operators.recursion import best_chains, reach
from basketry.plans.common import DELIVERED, SHOWCASE_CUSTOMERS, order_totals, valued_orders
from basketry.sources.fixture import Shop

FULL_NAMES = {"row_num": "row_num", "rank": "rank_with_gaps", "dense_rank": "dense_rank_no_gaps",
              "ntile": "spend_quartile", "lag": "prev_month_spend", "lead": "next_month_spend",
              "cumulative": "cumulative_spend", "rolling": "rolling_3m_avg"}
SCRIPT_NAMES = {"row_num": "row_num", "rank": "rank_with_gaps", "dense_rank": "dense_rank",
                "ntile": "quartile", "lag": "prev_month", "lead": "next_month",
                "cumulative": "cumulative", "rolling": "rolling_3m_avg"}


def window_showcase(shop: Shop, customers: Sequence = tuple(SHOWCASE_CUSTOMERS),
                    names: dict | None = None) -> DataFrame:
    """Q15 / Q23: monthly spend of a few customers with every window kind.

    The customer filter is applied first (SQL evaluates WHERE before the
    windows); it reaches the orders scan, and the line items join the few
    matching orders, so the work is proportional to those customers."""
    n = names or FULL_NAMES
    o = (shop.orders_where(DELIVERED).where(F.col("customer_id").isin(list(customers)))
         .select("order_id", "customer_id", F.date_format("order_date", "yyyy-MM").alias("month")))
    mc = (o.join(shop.order_items.select("order_id", "revenue"), "order_id")
          .groupBy("customer_id", "month").agg(F.round(F.sum("revenue"), 2).alias("monthly_spend")))
    by_month = Window.partitionBy("month").orderBy(F.desc("monthly_spend"))
    by_month_total = Window.partitionBy("month").orderBy(F.desc("monthly_spend"), "customer_id")
    by_cust = Window.partitionBy("customer_id").orderBy("month")
    rows3 = by_cust.rowsBetween(-2, Window.currentRow)
    spend = F.col("monthly_spend")
    return (mc.select(
        "customer_id", "month", spend.cast("double").alias("monthly_spend"),
        F.row_number().over(by_month_total).cast("bigint").alias(n["row_num"]),
        F.rank().over(by_month).cast("bigint").alias(n["rank"]),
        F.dense_rank().over(by_month).cast("bigint").alias(n["dense_rank"]),
        F.ntile(4).over(by_month_total).cast("bigint").alias(n["ntile"]),
        F.lag(spend).over(by_cust).cast("double").alias(n["lag"]),
        F.lead(spend).over(by_cust).cast("double").alias(n["lead"]),
        rnd_dec(F.sum(spend).over(by_cust.rangeBetween(Window.unboundedPreceding, Window.currentRow)), 2)
        .alias(n["cumulative"]),
        rnd(ratio(F.sum(spend).over(rows3), F.count(spend).over(rows3)), 2).alias(n["rolling"]))
        .orderBy("customer_id", "month"))


def journey_sequence(shop: Shop, depth: int = 5) -> DataFrame:
    """Q16, intended reading: the n-th delivered order of each customer,
    n <= depth.  ``row_number <= depth`` per customer is planned as a
    WindowGroupLimit, which keeps only the first ``depth`` orders of each
    customer on the map side before the shuffle."""
    vo = valued_orders(shop, DELIVERED).select("customer_id", "order_id", "order_date", "revenue")
    w = Window.partitionBy("customer_id").orderBy("order_date", "order_id")
    nth = vo.withColumn("order_number", F.row_number().over(w)).where(F.col("order_number") <= depth)
    return (nth.groupBy("order_number")
            .agg(big(F.count(F.lit(1))).alias("customers"),
                 rnd(ratio(F.sum("revenue"), F.count(F.lit(1))), 2).alias("avg_order_value"),
                 rnd_dec(F.sum("revenue"), 2).alias("total_revenue"))
            .select(big("order_number").alias("order_number"), "customers", "avg_order_value", "total_revenue")
            .orderBy("order_number"))


def journey_paths(shop: Shop, depth: int = 5) -> DataFrame:
    """Q16, literal reading of the recursive CTE: every chain of delivered
    orders with strictly increasing dates that starts on the customer's
    first delivered date, up to ``depth`` orders, summarised per length.

    Only counts and sums are needed, so instead of materialising paths each
    (customer, date) carries the number of chains of length k ending there:
    n1 = orders on the first date, n(k+1) = orders that day x sum of nk over
    earlier dates.  Work is one shuffle by customer over (customer, date)
    rows, bounded per customer by the calendar; no row per path exists.

    Chains multiply with a customer's days and orders beyond any DECIMAL, so
    counts and values are DOUBLE."""
    orders = shop.orders_where(DELIVERED).join(order_totals(shop), "order_id", "left")
    # every delivered order counts for the first date, those with items as steps
    cd = (orders.groupBy("customer_id", "order_date")
          .agg(F.count("revenue").cast("double").alias("m"), F.sum("revenue").cast("double").alias("v"))
          .withColumn("first_date", F.min("order_date").over(Window.partitionBy("customer_id"))))
    # c_k: chains of length k-1 ending before this date (c_1: 1 on the first
    # date); the day's m orders each extend them, so n_k = m * c_k paths of
    # length k end here, worth c_k * (sum of the day's order values).
    earlier = Window.partitionBy("customer_id").orderBy("order_date").rowsBetween(Window.unboundedPreceding, -1)
    cd = cd.withColumn("c1", (F.col("order_date") == F.col("first_date")).cast("double"))
    for k in range(2, depth + 1):
        cd = cd.withColumn(f"c{k}", F.coalesce(F.sum(F.col("m") * F.col(f"c{k - 1}")).over(earlier), F.lit(0.0)))
    levels = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("c")) for k in range(1, depth + 1)])
    per_level = (cd.select("customer_id", "m", "v", F.explode(levels).alias("l"))
                 .where((F.col("l.c") > 0) & (F.col("m") > 0))
                 .select("customer_id", F.col("l.k").alias("k"), (F.col("m") * F.col("l.c")).alias("n"),
                         (F.col("l.c") * F.col("v")).alias("value")))
    per_cust = (per_level.groupBy("customer_id", "k")
                .agg(F.sum("n").alias("paths"), F.sum("value").alias("value")))
    return (per_cust.groupBy("k")
            .agg(big(F.count(F.lit(1))).alias("customers"),
                 rnd(ratio(F.sum("value"), F.sum("paths")), 2).alias("avg_order_value"),
                 F.round(F.sum("value"), 2).alias("total_revenue"))
            .select(big("k").alias("order_number"), "customers", "avg_order_value", "total_revenue")
            .orderBy("order_number"))


def _delivered_steps(shop: Shop) -> DataFrame:
    """Delivered orders with their value and the customer's first delivered
    date; orders without items have no value, but count for that date."""
    orders = shop.orders_where(DELIVERED).join(order_totals(shop), "order_id", "left")
    firsts = orders.groupBy("customer_id").agg(F.min("order_date").alias("first_date"))
    return orders.select("customer_id", "order_id", "order_date", "revenue").join(firsts, "customer_id")


def journey_chains(shop: Shop, depth: int = 5) -> DataFrame:
    """The chains of ``journey_paths`` as rows: for each customer and length,
    the one worth most, with its orders."""
    steps = _delivered_steps(shop).withColumn("starts", F.col("order_date") == F.col("first_date"))
    best = best_chains(steps, "customer_id", "order_date", "order_id", "revenue", "starts", depth)
    return best.select("customer_id", big("length").alias("n_orders"), rnd_dec("total", 2).alias("total_revenue"),
                       F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("orders"))


def journey_months(shop: Shop, depth: int = 6) -> DataFrame:
    """Recursion over links: from the month of a customer's first delivered
    order to the next month with one, as long as at most three months lie
    between, up to ``depth`` months.  One row per customer and step."""
    month = F.month("order_date") + 12 * F.year("order_date")
    active = (shop.orders_where(DELIVERED).select("customer_id", month.alias("month"))
              .groupBy("customer_id", "month").agg(F.count(F.lit(1)).alias("orders")))
    per_customer = Window.partitionBy("customer_id").orderBy("month")
    links = (active.select("customer_id", "month", F.col("customer_id").alias("next_customer_id"), F.lead("month").over(per_customer).alias("next_month"))
             .where("next_month - month <= 3"))
    seed = active.groupBy("customer_id").agg(F.min("month").alias("month"))
    return (reach(seed, links, ["customer_id", "month"], depth).join(active, ["customer_id", "month"])
            .select("customer_id", big("depth").alias("step"), big("month").alias("month_number"), big("orders").alias("orders")))
