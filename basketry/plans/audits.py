"""Audits of the declared DDL constraints over the shop tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import key_summary
from basketry.operators.audit import domain_violations, duplicate_keys, orphans
from basketry.session import checkpoint_dir
from basketry.sources.fixture import Shop
from basketry.sources.schemas import DOMAINS, FOREIGN_KEYS, PRIMARY_KEYS


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def audit_domain(shop: Shop) -> DataFrame:
    return _union([domain_violations(getattr(shop, table), table, column, values) for table, column, values in DOMAINS])


def audit_unique(shop: Shop) -> DataFrame:
    """Primary keys; order_items has no item_id on the fixture, so its
    natural key (order_id, line_no) is audited."""
    keys = PRIMARY_KEYS | {"order_items": ["order_id", "line_no"]}
    return _union([duplicate_keys(getattr(shop, table), table, columns) for table, columns in keys.items()])


def audit_fk(shop: Shop) -> DataFrame:
    return _union([orphans(getattr(shop, child), column, getattr(shop, parent), key, child, parent)
                   for child, column, parent, key in FOREIGN_KEYS])


#: Key columns of the driver tables behind the shop tables.
KEY_COLUMNS = {
    "customers": ("customer", {"customer_id": "c_custkey"}),
    "products": ("part", {"product_id": "p_partkey"}),
    "orders": ("orders", {"order_id": "o_orderkey", "customer_id": "o_custkey"}),
    "order_items": ("lineitem", {"order_id": "l_orderkey", "product_id": "l_partkey"}),
}
UNIQUE = [("customers", "customer_id"), ("products", "product_id"), ("orders", "order_id")]


def refresh_summaries(shop: Shop, folder: str) -> dict[str, int]:
    """Bring the key summaries under ``folder`` up to the tables' files;
    files read, by table."""
    return {name: key_summary.refresh(shop.spark, f"{shop.sf_dir}/{source}.parquet", list(columns.values()), f"{folder}/{name}")
            for name, (source, columns) in KEY_COLUMNS.items()}


def from_summaries(shop: Shop, folder: str) -> DataFrame:
    """Single-column primary keys and all foreign keys, from the summaries
    kept under ``folder``: (check, table, column, rows, distinct_keys, faults).
    Rows are read only where a summary shows a fault."""
    kept = {name: key_summary.kept(shop.spark, f"{folder}/{name}") for name in KEY_COLUMNS}

    def side(table: str, column: str):
        source, columns = KEY_COLUMNS[table]
        return kept[table], columns[column], shop.raw(source)

    def named(check: str, table: str, column: str, found: DataFrame) -> DataFrame:
        return found.select(F.lit(check).alias("check"), F.lit(table).alias("table"), F.lit(column).alias("column"), "rows", "distinct_keys", "faults")

    return _union([named("unique", table, column, key_summary.unique_from(*side(table, column))) for table, column in UNIQUE]
                  + [named("reference", child, column, key_summary.orphans_from(*side(child, column), *side(parent, key)))
                     for child, column, parent, key in FOREIGN_KEYS])


def audit_summaries(shop: Shop) -> DataFrame:
    folder = f"{checkpoint_dir(shop.spark)}/key-summaries-{uuid.uuid4().hex}"
    refresh_summaries(shop, folder)
    return from_summaries(shop, folder)
