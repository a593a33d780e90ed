"""Revenue & sales analyses (catalogue category 1 and the revenue script)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.expr import big, pct, ratio, rnd, rnd_dec
from basketry.operators.pivot import pivot_sum
from basketry.operators.salted import hot_keys, salted_join
from basketry.plans.common import CANCELLED, DELIVERED, delivered_lines, order_totals, valued_orders
from basketry.sources.fixture import Shop
from basketry.sources.schemas import PAYMENTS


def revenue_by_category(shop: Shop, with_avg_price: bool = True) -> DataFrame:
    """Q1 (and Q17 without avg_price): delivered lines per product category.

    COUNT(DISTINCT order_id) is a two-level aggregate: (category, order)
    first, then category, both with map-side combine, so no Expand node and
    no single hot order or category reaches one task unreduced.  Lines of
    hot products meet the products by salted keys, so a product on a third of
    all lines is spread over many tasks."""
    lines = salted_join(delivered_lines(shop), shop.products.select("product_id", "category"), "product_id", "order_id",
                        hot_keys(shop.order_items, "product_id"))
    per_order = (lines.groupBy("category", "order_id")
                 .agg(F.sum("quantity").alias("units"), F.sum("revenue").alias("rev"),
                      F.sum("profit").alias("prof"), F.sum("unit_price").alias("price_sum"),
                      F.count(F.lit(1)).alias("n_lines")))
    agg = (per_order.groupBy("category")
           .agg(F.count(F.lit(1)).alias("total_orders"), F.sum("units").alias("units"),
                F.sum("rev").alias("rev"), F.sum("prof").alias("prof"),
                F.sum("price_sum").alias("price_sum"), F.sum("n_lines").alias("n_lines")))
    cols = [F.col("category"), big("total_orders").alias("total_orders"),
            big("units").alias("units_sold"), rnd_dec("rev", 2).alias("total_revenue")]
    if with_avg_price:
        cols.append(rnd(ratio("price_sum", "n_lines"), 2).alias("avg_price"))
    cols += [rnd_dec("prof", 2).alias("total_profit"),
             rnd(pct("prof", "rev"), 1).alias("profit_margin_pct")]
    return agg.select(*cols).orderBy(F.desc("total_revenue"), "category")


def monthly_trend(shop: Shop, with_unique_customers: bool = True) -> DataFrame:
    """Q2 (and Q18): month revenue of non-cancelled orders with LAG growth
    and a 3-row rolling average over the rounded revenue.

    The window runs after aggregation over one row per month, so its single
    partition holds a calendar-bounded number of rows."""
    vo = valued_orders(shop, not_status=CANCELLED).withColumn("month", F.date_format("order_date", "yyyy-MM"))
    if with_unique_customers:
        per_cust = (vo.groupBy("month", "customer_id")
                    .agg(F.sum("revenue").alias("rev"), F.count(F.lit(1)).alias("n_orders")))
        months = (per_cust.groupBy("month")
                  .agg(F.round(F.sum("rev"), 2).alias("revenue"), F.sum("n_orders").alias("orders"),
                       F.count(F.lit(1)).alias("unique_customers")))
    else:
        months = vo.groupBy("month").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count(F.lit(1)).alias("orders"))
    w = Window.orderBy("month")
    prev = F.lag("revenue").over(w)
    roll = w.rowsBetween(-2, Window.currentRow)
    cols = [F.col("month"), F.col("revenue").cast("double").alias("revenue"), big("orders").alias("orders")]
    if with_unique_customers:
        cols.append(big("unique_customers").alias("unique_customers"))
    cols += [prev.cast("double").alias("prev_month_revenue"),
             rnd(pct(F.col("revenue") - prev, prev), 1).alias("mom_growth_pct"),
             rnd(ratio(F.sum("revenue").over(roll), F.count("revenue").over(roll)), 2).alias("rolling_3m_avg")]
    return months.select(*cols).orderBy("month")


def top_products(shop: Shop, k: int = 10) -> DataFrame:
    """Q3: top-k delivered products by revenue.  Aggregated to product grain
    before the product dimension is joined; the top-k is a
    TakeOrderedAndProject (per-partition top-k, then a k-way merge)."""
    per_product = (delivered_lines(shop).groupBy("product_id")
                   .agg(F.sum("quantity").alias("units"), F.sum("revenue").alias("rev"),
                        F.sum("profit").alias("prof"), F.sum("discount").alias("disc_sum"),
                        F.count(F.lit(1)).alias("n_lines")))
    joined = per_product.join(shop.products, "product_id")
    out = joined.select(
        "product_id", "product_name", "category",
        F.col("price").cast("double").alias("list_price"),
        big("units").alias("units_sold"),
        rnd_dec("rev", 2).alias("total_revenue"),
        rnd_dec("prof", 2).alias("total_profit"),
        rnd(ratio("disc_sum", "n_lines") * F.lit(100.0), 1).alias("avg_discount_pct"))
    return out.orderBy(F.desc("total_revenue"), "product_id").limit(k).drop("product_id")


def city_payment_pivot(shop: Shop, payments: Sequence[str] = tuple(PAYMENTS)) -> DataFrame:
    """Q4 / Q19: delivered revenue by order city, one column per payment.

    Revenue is first summed per (customer, payment) from the order-grain
    totals, so the customer -> region lookup joins far fewer rows than there
    are orders; the pivot is a single conditional aggregate."""
    delivered = shop.orders_where(DELIVERED)
    per_key = (delivered.join(order_totals(shop), "order_id")
               .groupBy(shop.city_key, "payment").agg(F.sum("revenue").alias("rev")))
    lookup = shop.city_lookup()
    with_city = per_key if lookup is None else per_key.join(lookup, shop.city_key, "left")
    out = pivot_sum(with_city, ["city"], "payment", payments, "rev",
                    name=lambda v: f"{v.lower()}_revenue", total="total_revenue",
                    finish=lambda c: F.round(c, 0).cast("double"))
    return out.orderBy(F.desc("total_revenue"), "city")
