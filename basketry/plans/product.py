"""Product intelligence: Pareto with running share, category cross-sell,
discount impact."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.expr import big, bucketize, pct, ratio, rnd, rnd_dec
from basketry.operators.global_window import desc
from basketry.operators.materialize import materialize
from basketry.operators.pairs import item_counts, pair_counts
from basketry.operators.salted import hot_keys, salted_join
from basketry.operators.topk import topk
from basketry.plans.common import DELIVERED, delivered_lines
from basketry.sources.fixture import Shop


def product_revenue(shop: Shop) -> DataFrame:
    per = (delivered_lines(shop).groupBy("product_id")
           .agg(F.sum("revenue").alias("rev"), F.sum("quantity").alias("units"),
                F.sum("profit").alias("prof"), F.sum("discount").alias("disc_sum"),
                F.count(F.lit(1)).alias("n_lines")))
    return (per.join(shop.products.select("product_id", "product_name", "category"), "product_id")
            .select("product_id", "product_name", "category", F.round("rev", 2).alias("revenue"),
                    big("units").alias("units_sold"), rnd_dec("prof", 2).alias("profit"),
                    rnd(ratio("disc_sum", "n_lines") * F.lit(100.0), 1).alias("avg_discount")))


def product_pareto(shop: Shop, k: int = 20) -> DataFrame:
    """Q9: top-k products with global rank, share of total and cumulative
    share.  The top k hold every row before them in the order, so rank and
    running sum over the k rows are global; the total is a scalar subquery."""
    pr = materialize(product_revenue(shop))
    top = topk(pr, k, [desc("revenue")], ["product_id"], rank="revenue_rank")
    top = top.withColumn("total", pr.select(F.sum("revenue")).scalar())
    run = F.sum("revenue").over(Window.orderBy(F.desc("revenue"), "product_id")
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.col("total")
    return (top.select("product_id", "product_name", "category",
                       F.col("revenue").cast("double").alias("revenue"), "units_sold", "profit", "avg_discount",
                       "revenue_rank",
                       rnd(pct("revenue", total), 2).alias("revenue_share_pct"),
                       rnd(pct(run, total), 1).alias("cumulative_revenue_pct"))
            .orderBy(F.desc("revenue"), "product_id").drop("product_id"))


def customer_items(shop: Shop, item: str = "category", items: DataFrame | None = None) -> DataFrame:
    """Distinct (customer, item) of delivered lines; ``items`` maps
    product_id -> item when the item is not a products column.  Lines become
    distinct (customer, product) first, so a product on a third of all lines
    meets the mapping once per customer."""
    o = shop.orders_where(DELIVERED).select("order_id", "customer_id")
    p = items if items is not None else shop.products.select("product_id", F.col(item).alias("item"))
    bought = (shop.order_items.select("order_id", "product_id").join(o, "order_id")
              .select("customer_id", "product_id").distinct())
    hot = hot_keys(shop.order_items, "product_id")
    return salted_join(bought, p, "product_id", "customer_id", hot).select("customer_id", "item").distinct()


def cross_sell(shop: Shop, item: str = "category", a: str = "category_a", b: str = "category_b",
               items: DataFrame | None = None) -> DataFrame:
    """Q10: customers who bought both items of a pair (a < b), and that as a
    share of item a's customers (directional base, quirk 9)."""
    held = materialize(customer_items(shop, item, items))
    pairs = pair_counts(held, "customer_id", "item", a, b, "both")
    base = item_counts(held, "item", a, "holders")
    return (pairs.join(base, a)
            .select(a, b, big("both").alias("customers_bought_both"),
                    rnd(pct("both", "holders"), 1).alias("cross_sell_rate_pct"))
            .orderBy(F.desc("customers_bought_both"), a, b))


# Discount buckets, fixed values of the reference (first match wins).
DISCOUNT_BUCKETS = [
    ("==", Decimal("0"), "0% — No Discount"),
    ("<=", Decimal("0.05"), "1-5% — Minimal"),
    ("<=", Decimal("0.10"), "6-10% — Moderate"),
    ("<=", Decimal("0.15"), "11-15% — Significant"),
]
DISCOUNT_OTHER = "16-20% — Heavy"


def discount_impact(shop: Shop) -> DataFrame:
    """Q11: delivered lines with revenue > 0 by discount bucket; distinct
    orders via a (bucket, order) pre-aggregate; sorted by the bucket's
    smallest discount (the reference sorts by a bare column)."""
    lines = (delivered_lines(shop).where(F.col("revenue") > 0)
             .withColumn("discount_bucket", bucketize("discount", DISCOUNT_BUCKETS, DISCOUNT_OTHER)))
    per_order = (lines.groupBy("discount_bucket", "order_id")
                 .agg(F.count(F.lit(1)).alias("n"), F.sum("unit_price").alias("price_sum"),
                      F.sum("revenue").alias("rev"), F.sum("profit").alias("prof"),
                      F.sum(ratio("profit", "revenue").cast("decimal(18,8)")).alias("margin_sum"),
                      F.min("discount").alias("min_disc")))
    agg = (per_order.groupBy("discount_bucket")
           .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("orders"),
                F.sum("price_sum").alias("price_sum"), F.sum("rev").alias("rev"),
                F.sum("prof").alias("prof"), F.sum("margin_sum").alias("margin_sum"),
                F.min("min_disc").alias("min_disc")))
    return (agg.orderBy("min_disc", "discount_bucket")
            .select("discount_bucket", big("n").alias("line_items"), big("orders").alias("orders"),
                    rnd(ratio("price_sum", "n"), 0).alias("avg_unit_price"),
                    rnd_dec("rev", 0).alias("total_revenue"), rnd_dec("prof", 0).alias("total_profit"),
                    rnd(ratio("margin_sum", "n") * F.lit(100.0), 1).alias("avg_margin_pct")))
