"""One query per generic operator of the inventory,
each over the whole shop tables so its work grows with them.  The named
analyses use the same operators; these keys check each one on its own."""

from __future__ import annotations

import datetime as dt
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.expr import (big, bucketize, days_between, dbl, month_diff, month_key,
                                     month_name, month_text, pct, ratio, rnd, rnd_dec, year_text)
from basketry.operators.bitmaps import countable, distinct_counts, id_bitmaps, merged
from basketry.operators.events import argmin_rows
from basketry.operators.materialize import materialize
from basketry.operators.global_window import asc, desc, global_window
from basketry.operators.pivot import pivot_sum
from basketry.operators.topk import topk
from basketry.plans import adhoc
from basketry.plans.common import CANCELLED, DELIVERED, FIXTURE_AS_OF, order_totals, valued_orders
from basketry.plans.product import cross_sell, product_revenue
from basketry.session import checkpoint_dir, configure
from basketry.sources import order_grain
from basketry.sources.fixture import Shop, load
from basketry.sources.schemas import STATUSES

ORDER_SIZE_BUCKETS = [("<", Decimal("10000"), "small"), ("<", Decimal("100000"), "medium"),
                      ("<", Decimal("250000"), "large")]


# ------------------------------------------------------------ sources (S)

def op_scan(shop: Shop) -> DataFrame:
    return shop.orders_with_city().select("order_id", "customer_id", "order_date", "status", "payment", "city")


def op_line_measures(shop: Shop) -> DataFrame:
    return shop.order_items.select("order_id", big("line_no").alias("line_no"), "product_id",
                                   big("quantity").alias("quantity"), dbl("unit_price").alias("unit_price"), dbl("discount").alias("discount"),
                                   dbl("revenue").alias("revenue"), dbl("profit").alias("profit"))


def op_preview(shop: Shop, n: int = 5) -> DataFrame:
    return shop.customers.orderBy("customer_id").limit(n)


# ------------------------------------------------------- projection / CASE

def op_bucketize(shop: Shop) -> DataFrame:
    vo = valued_orders(shop)
    return (vo.withColumn("order_size", bucketize("revenue", ORDER_SIZE_BUCKETS, "very large"))
            .groupBy("order_size").agg(big(F.count(F.lit(1))).alias("orders"), rnd_dec(F.sum("revenue"), 2)
                                       .alias("revenue")))


# ------------------------------------------------------------------ joins

def op_join_inner(shop: Shop) -> DataFrame:
    return (shop.orders.join(shop.order_items, "order_id")
            .select("order_id", big("line_no").alias("line_no"), "customer_id", "status", "product_id",
                    dbl("revenue").alias("revenue")))


def op_first_event(shop: Shop) -> DataFrame:
    first = argmin_rows(shop.orders, "customer_id", "order_date")
    return (first.groupBy("customer_id")
            .agg(F.min("order_date").alias("first_order_date"), big(F.count(F.lit(1))).alias("first_day_orders")))


def op_argmin_rows(shop: Shop) -> DataFrame:
    d = shop.orders_where(DELIVERED)
    return argmin_rows(d, "customer_id", "order_date").select("order_id", "customer_id", "order_date")


def op_pairs(shop: Shop) -> DataFrame:
    brands = shop.raw("part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("item"))
    return cross_sell(shop, a="brand_a", b="brand_b", items=brands)


# ------------------------------------------------------------ aggregation

def op_agg_basic(shop: Shop) -> DataFrame:
    lines = shop.order_items.join(shop.orders, "order_id")
    return (lines.groupBy("status")
            .agg(big(F.count(F.lit(1))).alias("line_items"), big(F.sum("quantity")).alias("units"),
                 rnd_dec(F.sum("revenue"), 2).alias("revenue"),
                 rnd(ratio(F.sum("revenue"), F.count(F.lit(1))), 2).alias("avg_line_revenue"),
                 F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date")))


def op_count_distinct(shop: Shop) -> DataFrame:
    """Two COUNT(DISTINCT) of different columns per payment: each line gives
    a row (payment, kind, id) of either kind, these are made distinct and then
    counted, so the facts are joined once and nothing is kept at line grain."""
    lines = shop.order_items.select("order_id", "product_id").join(shop.orders.select("order_id", "customer_id", "payment"), "order_id")
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id")) for kind, c in enumerate(("customer_id", "product_id"))])
    ids = lines.select("payment", F.explode(kinds).alias("x")).select("payment", "x.kind", "x.id").where(F.col("id").isNotNull()).distinct()
    return ids.groupBy("payment").agg(*[big(F.count_if(F.col("kind") == kind)).alias(name) for kind, name in enumerate(("customers", "products"))])


def op_distinct_rollup(shop: Shop) -> DataFrame:
    """Unique customers by month, year and in all: the bitmaps of the months
    are made once and merge to the others; ids that are no whole numbers are
    counted anew at each level."""
    month = F.date_format("order_date", "yyyy-MM")
    rows = shop.orders_where(not_status=CANCELLED).select(month.alias("month"), "customer_id").withColumn("year", F.substring("month", 1, 4))
    rows = rows.withColumn("all", F.lit("all"))
    levels = ("month", "year", "all")
    if not countable(rows, "customer_id"):
        found = [rows.select(level, "customer_id").distinct().groupBy(level).agg(big(F.count("customer_id")).alias("customers")) for level in levels]
    else:
        made = materialize(id_bitmaps(rows, levels, "customer_id"))
        found = [distinct_counts(merged(made, [level]), [level], "customers") for level in levels]
    found = [x.select(F.lit(level).alias("level"), F.col(level).alias("period"), "customers") for x, level in zip(found, levels)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def op_order_grain(shop: Shop) -> DataFrame:
    """Order totals are kept once, bucketed by order, and the orders by
    status are valued from them, without the line items."""
    folder = f"{checkpoint_dir(shop.spark)}/order-grain-{uuid.uuid4().hex}"
    order_grain.write(shop, order_totals(shop), folder)
    kept = load(shop.spark, shop.sf_dir, order_grain=folder)
    return (valued_orders(kept).groupBy("status")
            .agg(big(F.count(F.lit(1))).alias("orders"), big(F.sum("n_items")).alias("line_items"), big(F.sum("units")).alias("units"),
                 rnd_dec(F.sum("revenue"), 2).alias("revenue"), rnd_dec(F.sum("profit"), 2).alias("profit")))


def op_pivot(shop: Shop) -> DataFrame:
    vo = valued_orders(shop).withColumn("year", year_text("order_date"))
    return pivot_sum(vo, ["year"], "status", STATUSES, "revenue",
                     name=lambda v: f"{v.lower()}_revenue", total="total_revenue",
                     finish=lambda c: F.round(c, 0).cast("double"))


# ---------------------------------------------------------------- windows

def _customer_metrics_all(shop: Shop) -> DataFrame:
    return (valued_orders(shop, DELIVERED).groupBy("customer_id")
            .agg(F.round(F.sum("revenue"), 2).alias("lifetime_revenue")))


def op_global_rank(shop: Shop) -> DataFrame:
    out = global_window(_customer_metrics_all(shop), [desc("lifetime_revenue")], ["customer_id"],
                        rank="revenue_rank", row_number="row_number")
    return out.select("customer_id", dbl("lifetime_revenue").alias("lifetime_revenue"), "revenue_rank", "row_number")


def op_global_ntile(shop: Shop) -> DataFrame:
    per = shop.orders.groupBy("customer_id").agg(big(F.count(F.lit(1))).alias("orders"))
    return global_window(per, [desc("orders")], ["customer_id"], rank="orders_rank", ntile=("decile", 10))


def op_running_total(shop: Shop) -> DataFrame:
    pr = materialize(product_revenue(shop).select("product_id", "revenue"))
    out = global_window(pr, [desc("revenue")], ["product_id"], running_sum=("running", "revenue"),
                        materialize=False)
    out = out.withColumn("total", pr.select(F.sum("revenue")).scalar())
    return out.select("product_id", dbl("revenue").alias("revenue"), dbl("running").alias("running_revenue"),
                      rnd(pct("running", "total"), 2).alias("cumulative_pct"))


def op_share_of_total(shop: Shop) -> DataFrame:
    pr = materialize(product_revenue(shop).select("product_id", "revenue"))
    return (pr.withColumn("total", pr.select(F.sum("revenue")).scalar())
            .select("product_id", dbl("revenue").alias("revenue"), rnd(pct("revenue", "total"), 4).alias("share_pct")))


def _monthly_spend(shop: Shop) -> DataFrame:
    return (valued_orders(shop, DELIVERED).withColumn("month", month_key("order_date"))
            .groupBy("customer_id", "month").agg(F.round(F.sum("revenue"), 2).alias("spend"),
                                                 F.min("order_date").alias("day")))


def op_lag_lead(shop: Shop) -> DataFrame:
    """LAG/LEAD per customer over monthly spend: at (customer, month) grain a
    customer's window holds at most one row per calendar month."""
    w = Window.partitionBy("customer_id").orderBy("month")
    return _monthly_spend(shop).select(
        "customer_id", "month", dbl("spend").alias("monthly_spend"),
        dbl(F.lag("spend").over(w)).alias("prev_month_spend"),
        dbl(F.lead("spend").over(w)).alias("next_month_spend"),
        big(month_diff("day", F.lag("day").over(w))).alias("months_since_prev"))


def op_rolling_avg(shop: Shop) -> DataFrame:
    w = Window.partitionBy("customer_id").orderBy("month")
    rows3 = w.rowsBetween(-2, Window.currentRow)
    return _monthly_spend(shop).select(
        "customer_id", "month",
        rnd(ratio(F.sum("spend").over(rows3), F.count("spend").over(rows3)), 2).alias("rolling_3m_avg"),
        rnd_dec(F.sum("spend").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), 2)
        .alias("cumulative_spend"))


def op_window_dist(shop: Shop) -> DataFrame:
    """PERCENT_RANK and CUME_DIST over all products by revenue, from one
    global running count over the distinct revenues: a product's rank follows
    the products below its revenue, its share those up to it."""
    pr = materialize(product_revenue(shop).select("product_id", "revenue"))
    level = materialize(pr.groupBy("revenue").agg(F.count(F.lit(1)).alias("held")))
    run = global_window(level, [asc("revenue")], running_sum=("upto", "held"), materialize=False)
    run = run.withColumnRenamed("revenue", "level").withColumn("n", level.select(F.sum("held")).scalar())
    return pr.join(run, F.col("revenue").eqNullSafe(F.col("level"))).select(
        "product_id", dbl("revenue").alias("revenue"),
        rnd(ratio(F.col("upto") - F.col("held"), F.col("n") - 1), 6).alias("pct_rank"),
        rnd(ratio(F.col("upto"), F.col("n")), 6).alias("cume_dist"))


def op_window_first_last(shop: Shop) -> DataFrame:
    w = Window.partitionBy("customer_id").orderBy("month")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _monthly_spend(shop).select(
        "customer_id", "month",
        dbl(F.first("spend").over(whole)).alias("first_month_spend"),
        dbl(F.last("spend").over(whole)).alias("last_month_spend"))


# ------------------------------------------------------- sort / set / misc

def op_topk(shop: Shop, k: int = 10) -> DataFrame:
    vo = valued_orders(shop).select("order_id", "customer_id", "order_date", "revenue")
    return topk(vo, k, [desc("revenue")], ["order_id"]).select(
        "order_id", "customer_id", "order_date", dbl("revenue").alias("revenue"))


def op_union_all(shop: Shop) -> DataFrame:
    """Months by status are summed once, into a checkpoint of a few rows;
    each branch takes its status."""
    months = materialize(valued_orders(shop).groupBy("status", month_key("order_date").alias("month"))
                         .agg(rnd_dec(F.sum("revenue"), 2).alias("revenue"), big(F.count(F.lit(1))).alias("orders")))

    def branch(status: str, kind: str) -> DataFrame:
        return months.where(F.col("status") == status).select(F.lit(kind).alias("kind"), "month", "revenue", "orders")
    return branch("Delivered", "delivered").unionByName(branch("Returned", "returned"))


def op_scalar_dates(shop: Shop, as_of: dt.date = FIXTURE_AS_OF) -> DataFrame:
    d = F.col("order_date")
    return shop.orders.select(
        "order_id", month_key(d).alias("month_key"), year_text(d).alias("year"), month_text(d).alias("month"),
        month_name(d).alias("month_name"), big(days_between(F.lit(as_of), d)).alias("days_to_as_of"),
        big(month_diff(d, F.lit(dt.date(1995, 1, 1)))).alias("months_from_start"),
        (d > F.lit(dt.date(2000, 1, 1))).alias("after_2000"),
        F.to_date(F.concat(month_key(d), F.lit("-01"))).alias("month_start"))


def op_scalar_numeric(shop: Shop) -> DataFrame:
    it = shop.order_items
    return it.select(
        "order_id", big("line_no").alias("line_no"),
        rnd_dec("revenue", 0).alias("revenue_0dp"), rnd_dec("revenue", 1).alias("revenue_1dp"),
        rnd("unit_price", 2).alias("unit_price_2dp"),
        dbl(F.nullif(F.col("discount"), F.lit(Decimal("0.00")))).alias("discount_or_null"),
        rnd(ratio("revenue", "quantity"), 2).alias("revenue_per_unit"),
        rnd(ratio("profit", F.nullif(F.col("quantity") - 1, F.lit(0))) * F.lit(30), 2).alias("profit_scaled"),
        rnd(pct("profit", "revenue"), 1).alias("margin_pct"))


# ------------------------------------------- reachable only via ad-hoc SQL

def _delivered_per_customer(shop: Shop) -> DataFrame:
    return (shop.orders_where(DELIVERED).groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("n")))


def op_join_left(shop: Shop) -> DataFrame:
    return (shop.customers.select("customer_id").join(_delivered_per_customer(shop), "customer_id", "left")
            .select("customer_id", big(F.coalesce("n", F.lit(0))).alias("delivered_orders")))


def op_join_right(shop: Shop) -> DataFrame:
    last = shop.orders_where("Returned").groupBy("customer_id").agg(F.max("order_date").alias("last_returned"))
    return (last.join(shop.customers.select("customer_id", "segment"), "customer_id", "right")
            .select("customer_id", "segment", "last_returned"))


def op_join_full(shop: Shop) -> DataFrame:
    rev = (valued_orders(shop, DELIVERED).groupBy("customer_id")
           .agg(rnd_dec(F.sum("revenue"), 2).alias("delivered_revenue")))
    canc = (shop.orders_where("Cancelled").groupBy("customer_id")
            .agg(big(F.count(F.lit(1))).alias("cancelled_orders")))
    return rev.join(canc, "customer_id", "full").select("customer_id", "delivered_revenue", "cancelled_orders")


def op_semi(shop: Shop) -> DataFrame:
    # distinct first: a customer with a third of all orders is one row here
    ret = shop.orders_where("Returned").select("customer_id").distinct()
    return shop.customers.join(ret, "customer_id", "left_semi").select("customer_id", "segment")


def op_anti(shop: Shop) -> DataFrame:
    d = shop.orders_where(DELIVERED).select("customer_id").distinct()
    return shop.customers.join(d, "customer_id", "left_anti").select("customer_id", "city")


def op_union_distinct(shop: Shop) -> DataFrame:
    a = shop.orders_where("Returned").select("customer_id")
    b = shop.orders_where("Cancelled").select("customer_id")
    return a.union(b).distinct()


def op_having(shop: Shop, min_orders: int = 10) -> DataFrame:
    return (_delivered_per_customer(shop).where(F.col("n") > min_orders)
            .select("customer_id", big("n").alias("delivered_orders")))


def op_predicates(shop: Shop) -> DataFrame:
    p = shop.products
    cond = (F.col("product_name").like("%red%") | (F.col("price") > Decimal("1900"))) & F.col("cost").isNotNull()
    return p.where(cond).select(
        "product_id", "product_name",
        F.coalesce(F.nullif(F.col("category"), F.lit("SMALL")), F.lit("OTHER")).alias("category_label"),
        dbl("price").alias("price"))


ADHOC_TEXT = """SELECT strftime('%Y', order_date) AS year, status,
       CAST(COUNT(*) AS BIGINT) AS orders,
       CAST(SUM(CAST(julianday(DATE '2001-08-02') - julianday(order_date) AS INT)) AS BIGINT) AS days_to_as_of
FROM orders
GROUP BY 1, 2"""


ADHOC_WINDOW_TEXT = """WITH per AS (SELECT customer_id, COUNT(*) AS orders FROM orders GROUP BY customer_id)
SELECT customer_id, orders,
       CAST(RANK() OVER (ORDER BY orders DESC) AS BIGINT) AS orders_rank,
       CAST(DENSE_RANK() OVER (ORDER BY orders DESC) AS BIGINT) AS dense_rank,
       CAST(ROW_NUMBER() OVER (ORDER BY orders DESC, customer_id) AS BIGINT) AS place,
       CAST(NTILE(4) OVER (ORDER BY orders DESC, customer_id) AS BIGINT) AS quartile,
       SUM(orders) OVER (ORDER BY orders DESC, customer_id ROWS UNBOUNDED PRECEDING) AS running_orders,
       SUM(orders) OVER (ORDER BY orders DESC) AS orders_with_peers,
       CUME_DIST() OVER (ORDER BY orders DESC) AS cume_dist,
       SUM(orders) OVER () AS all_orders
FROM per"""


def _typed(shop: Shop, text: str, **options) -> DataFrame:
    """In a session of its own, so the caller's views and functions stay."""
    session = configure(shop.spark.newSession())
    adhoc.prepare(Shop(session, shop.sf_dir))
    df, err = adhoc.run_sql(session, text, **options)
    if err:
        raise RuntimeError(err)
    return df


def op_adhoc_sql(shop: Shop) -> DataFrame:
    return _typed(shop, ADHOC_TEXT)


def op_adhoc_window(shop: Shop) -> DataFrame:
    """Windows without PARTITION BY typed as SQL; none may be left to one task."""
    return _typed(shop, ADHOC_WINDOW_TEXT, single_task_rows=0)
