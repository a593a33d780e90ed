"""Deterministic, distributed generator of the shop star schema.

Re-aims the reference's seeded NumPy loop as Spark jobs: every table starts
from ``spark.range`` and every random value is a hash draw of (seed, salt,
row key) (``basketry.functions.draws``), so the output does not depend on the
number of partitions or executors, and a retried task rewrites the same rows.
The distributions follow the reference; the exact random streams do not
(bit-for-bit NumPy streams are not reproducible on a cluster).

Order lines fan out with ``explode(sequence(1, n_items))``; the k distinct
products of an order are the k smallest hash draws over the fixed 25-product
catalogue (an array literal, so no join and no shuffle).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.draws import hash32, uniform_int, uniform_unit, weighted_choice
from basketry.sources.schemas import PAYMENTS, SEGMENTS, STATUSES

# Fixed values of the reference generator.
CITIES = ["Bengaluru", "Mumbai", "Delhi", "Hyderabad", "Chennai", "Pune"]
CITY_WEIGHTS = [0.30, 0.20, 0.18, 0.15, 0.10, 0.07]
SEGMENT_WEIGHTS = [0.2, 0.5, 0.3]
AGE_GROUPS = ["18-25", "26-35", "36-45", "46+"]
AGE_WEIGHTS = [0.25, 0.40, 0.25, 0.10]
STATUS_WEIGHTS = [0.72, 0.15, 0.08, 0.05]
PAYMENT_WEIGHTS = [0.45, 0.25, 0.12, 0.12, 0.06]
ITEMS_PER_ORDER = [1, 2, 3, 4]
ITEMS_PER_ORDER_WEIGHTS = [0.50, 0.30, 0.15, 0.05]
DISCOUNTS = ["0.00", "0.05", "0.10", "0.15", "0.20"]
DISCOUNT_WEIGHTS = [0.40, 0.20, 0.20, 0.12, 0.08]
CATALOGUE = {
    "Electronics": [("iPhone 15", 85000), ("Samsung TV", 55000), ("Laptop", 72000),
                    ("Earbuds", 3500), ("Smartwatch", 18000)],
    "Fashion": [("Kurta Set", 1800), ("Jeans", 2200), ("Saree", 4500),
                ("Sneakers", 5500), ("Handbag", 3200)],
    "Home": [("Mixer", 4500), ("Air Cooler", 8500), ("Bedsheet", 1200),
             ("Pressure Cooker", 2800), ("Wall Shelf", 1600)],
    "Beauty": [("Moisturiser", 850), ("Lipstick", 450), ("Perfume", 2200),
               ("Hair Serum", 650), ("Face Wash", 280)],
    "Grocery": [("Rice 5kg", 420), ("Oil 1L", 180), ("Dal 1kg", 160),
                ("Tea 500g", 220), ("Coffee", 480)],
}
COST_RATE_LOW, COST_RATE_HIGH = 0.45, 0.65
SIGNUP_START = dt.date(2022, 1, 1)   # one customer every 12 hours
ORDER_START, ORDER_END = dt.date(2023, 1, 1), dt.date(2024, 12, 31)


@dataclass
class ShopData:
    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    order_items: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"customers": self.customers, "products": self.products,
                "orders": self.orders, "order_items": self.order_items}


def _catalogue_rows() -> list[tuple]:
    rows, pid = [], 1
    for category, items in CATALOGUE.items():
        for name, price in items:
            rows.append((f"P{pid:03d}", name, category, price))
            pid += 1
    return rows


def generate(spark: SparkSession, n_customers: int = 500, n_orders: int = 8000, seed: int = 42,
             partitions: int | None = None) -> ShopData:
    parts = partitions or spark.sparkContext.defaultParallelism
    money = T.DecimalType(12, 2)

    # customers
    cid = F.col("id")
    customers = spark.range(1, n_customers + 1, numPartitions=parts).select(
        F.format_string("C%04d", cid).alias("customer_id"),
        F.format_string("Customer_%d", cid).alias("name"),
        weighted_choice(seed, "city", cid, CITIES, CITY_WEIGHTS).alias("city"),
        F.date_add(F.lit(SIGNUP_START), F.expr("cast((id - 1) div 2 as int)")).alias("signup_date"),
        weighted_choice(seed, "segment", cid, SEGMENTS, SEGMENT_WEIGHTS).alias("segment"),
        weighted_choice(seed, "age", cid, AGE_GROUPS, AGE_WEIGHTS).alias("age_group"))

    # products: the fixed catalogue, cost = price x U(0.45, 0.65), 2 dp
    cat = spark.createDataFrame(_catalogue_rows(), "product_id string, product_name string, category string, price int")
    rate = F.lit(COST_RATE_LOW) + uniform_unit(seed, "cost", F.col("product_id")) * F.lit(COST_RATE_HIGH - COST_RATE_LOW)
    products = cat.select("product_id", "product_name", "category", F.col("price").cast(money).alias("price"),
                          F.round(F.col("price") * rate, 2).cast(money).alias("cost"))

    # orders: dates spread evenly over the period, i-th of n on day floor((i-1) * span / (n-1))
    span = (ORDER_END - ORDER_START).days
    oid = F.col("id")
    orders = spark.range(1, n_orders + 1, numPartitions=parts).select(
        F.format_string("ORD%05d", oid).alias("order_id"),
        F.format_string("C%04d", uniform_int(seed, "customer", oid, 1, n_customers)).alias("customer_id"),
        F.date_add(F.lit(ORDER_START),
                   F.expr(f"cast((id - 1) * {span} div greatest({n_orders} - 1, 1) as int)")).alias("order_date"),
        weighted_choice(seed, "status", oid, STATUSES, STATUS_WEIGHTS).alias("status"),
        weighted_choice(seed, "payment", oid, PAYMENTS, PAYMENT_WEIGHTS).alias("payment"),
        weighted_choice(seed, "order_city", oid, CITIES, CITY_WEIGHTS).alias("city"),
        oid.alias("order_no"))

    # order items: 1-4 distinct products per order
    cat_rows = _catalogue_rows()
    catalogue = F.array(*[F.struct(F.lit(pid).alias("product_id"), F.lit(price).alias("price"))
                          for pid, _, _, price in cat_rows])
    n_items = weighted_choice(seed, "n_items", F.col("order_no"), ITEMS_PER_ORDER, ITEMS_PER_ORDER_WEIGHTS)
    ranked = F.transform(catalogue, lambda p: F.struct(
        hash32(seed, "pick", F.concat(F.col("order_no").cast("string"), F.lit("-"), p["product_id"])).alias("h"),
        p["product_id"].alias("product_id"), p["price"].alias("price")))
    picks = F.slice(F.array_sort(ranked), 1, n_items)
    lines = orders.select("order_id", "order_no", F.posexplode(picks).alias("pos", "p"))
    key = F.concat(F.col("order_no").cast("string"), F.lit("-"), F.col("pos").cast("string"))
    costs = products.select("product_id", "cost")
    disc = weighted_choice(seed, "discount", key, [F.lit(d).cast("decimal(4,2)") for d in DISCOUNTS],
                           DISCOUNT_WEIGHTS)
    items = (lines.select(
        F.format_string("ITEM%05d-%d", F.col("order_no"), F.col("pos") + 1).alias("item_id"),
        "order_id", F.col("p.product_id").alias("product_id"),
        uniform_int(seed, "qty", key, 1, 3).alias("quantity"),
        F.col("p.price").cast(money).alias("unit_price"),
        disc.cast("decimal(4,2)").alias("discount"))
        .join(F.broadcast(costs), "product_id"))  # 25 fixed rows
    one = F.lit(1).cast("decimal(4,2)")
    net = F.col("unit_price") * F.col("quantity") * (one - F.col("discount"))
    order_items = items.select(
        "item_id", "order_id", "product_id", "quantity", "unit_price", "discount",
        F.round(net, 2).cast("decimal(14,2)").alias("revenue"),
        F.round((F.col("unit_price") - F.col("cost")) * F.col("quantity") * (one - F.col("discount")), 2)
        .cast("decimal(14,2)").alias("profit"))
    return ShopData(customers, products, orders.drop("order_no"), order_items)
