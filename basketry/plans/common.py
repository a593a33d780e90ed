"""Building blocks shared by the named analyses.

The key one is the **order-grain pre-aggregate** (SURVEY §4.3.4): line items
summed per order once, map-side combined, so every customer- or month-level
analysis joins orders to one row per order.  COUNT(DISTINCT order_id) then
becomes COUNT(*), and the reference's per-line average becomes
sum(revenue) / sum(n_items).  A hot order (many lines) collapses in the
partial aggregate before any shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.sources.fixture import Shop

DELIVERED = "Delivered"
CANCELLED = "Cancelled"

# Parameters of the reference analyses, restated for the fixture
# (FIXTURES.md §3): the as-of date is the day after the last order, as
# 2025-01-01 is in the reference; showcase customers have delivered orders.
FIXTURE_AS_OF = dt.date(2001, 8, 2)
SHOWCASE_CUSTOMERS = [1, 2, 3, 10, 20]
SHOWCASE_CUSTOMERS_SCRIPT = [1, 2, 3]


def order_totals(shop: Shop) -> DataFrame:
    """order_id -> revenue, profit, n_items, units (orders with items only):
    those kept at order grain while they are fresh, else summed anew."""
    kept = shop.kept_order_totals()
    if kept is not None:
        return kept
    return (shop.order_items.groupBy("order_id")
            .agg(F.sum("revenue").alias("revenue"),
                 F.sum("profit").alias("profit"),
                 F.count(F.lit(1)).alias("n_items"),
                 F.sum("quantity").alias("units")))


def valued_orders(shop: Shop, status: str | None = None, not_status: str | None = None,
                  with_city: bool = False) -> DataFrame:
    """Orders passing the status filter, inner-joined to their item totals
    (orders without items drop out, as in the reference's inner joins)."""
    orders = shop.orders_where(status, not_status)
    if with_city:
        lookup = shop.city_lookup()
        orders = orders if lookup is None else orders.join(lookup, shop.city_key, "left")
    return orders.join(order_totals(shop), "order_id", "inner")


def delivered_lines(shop: Shop) -> DataFrame:
    """Line items of delivered orders (line grain, for product-level work)."""
    delivered = shop.orders_where(DELIVERED).select("order_id")
    return shop.order_items.join(delivered, "order_id", "inner")
