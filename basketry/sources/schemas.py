"""Typed definitions of the four shop tables (the declared DDL of the
reference, with the build types chosen in SURVEY §1.2).

Keys are BIGINT on the driver fixture and STRING in the generated shop data,
so the key type is a parameter.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed domains of the declared CHECK constraints.
SEGMENTS = ["Premium", "Regular", "Occasional"]
STATUSES = ["Delivered", "Shipped", "Cancelled", "Returned"]
PAYMENTS = ["UPI", "Card", "NetBanking", "COD", "Wallet"]


def customers_schema(key: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        T.StructField("customer_id", key, False),
        T.StructField("name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("signup_date", T.DateType()),
        T.StructField("segment", T.StringType()),
        T.StructField("age_group", T.StringType()),
    ])


def products_schema(key: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        T.StructField("product_id", key, False),
        T.StructField("product_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("price", T.DecimalType(12, 2)),
        T.StructField("cost", T.DecimalType(12, 2)),
    ])


def orders_schema(key: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        T.StructField("order_id", key, False),
        T.StructField("customer_id", key),
        T.StructField("order_date", T.DateType()),
        T.StructField("status", T.StringType()),
        T.StructField("payment", T.StringType()),
        T.StructField("city", T.StringType()),
    ])


def order_items_schema(key: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([
        T.StructField("item_id", key, False),
        T.StructField("order_id", key),
        T.StructField("product_id", key),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price", T.DecimalType(12, 2)),
        T.StructField("discount", T.DecimalType(4, 2)),
        T.StructField("revenue", T.DecimalType(14, 2)),
        T.StructField("profit", T.DecimalType(14, 2)),
    ])


SHOP_SCHEMAS = {
    "customers": customers_schema,
    "products": products_schema,
    "orders": orders_schema,
    "order_items": order_items_schema,
}

# Primary and foreign keys of the declared DDL (used by the audits).
PRIMARY_KEYS = {
    "customers": ["customer_id"],
    "products": ["product_id"],
    "orders": ["order_id"],
    "order_items": ["item_id"],
}
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
]
DOMAINS = [
    ("customers", "segment", SEGMENTS),
    ("orders", "status", STATUSES),
]
