"""Writing and reading shop tables (the reference's ``to_sql(...,
if_exists='replace')``): Parquet, one folder per table, each replacement a
commit."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketry.sources.schemas import SHOP_SCHEMAS

TABLES = ["customers", "products", "orders", "order_items"]


#: A table's commits: each names the folder of every part that the table
#: then consists of (a table that is replaced whole has one part).
_COMMITS = "commits"


def _last_commit(spark: SparkSession, folder: str) -> Row | None:
    try:
        commits = spark.read.parquet(f"{folder}/{_COMMITS}")
    except AnalysisException:  # nothing was written yet
        return None
    return commits.orderBy(F.col("number").desc(), F.col("name").desc()).first()


def _commit(spark: SparkSession, folder: str, last: Row | None, parts: dict[str | None, str], schema: str) -> None:
    row = (last["number"] + 1 if last else 1, uuid.uuid4().hex, schema, [(v, path) for v, path in sorted(parts.items(), key=str)])
    commit = spark.createDataFrame([row], "number long, name string, schema string, parts array<struct<value: string, path: string>>")
    commit.coalesce(1).write.mode("append").parquet(f"{folder}/{_COMMITS}")


def replace_table(df: DataFrame, folder: str) -> None:
    """Replace the table in ``folder`` by the rows of ``df`` as one commit:
    the rows are written to a folder of their own first, then one small file
    makes them the table.  Readers see the old or the new table whole; a
    writer that fails leaves the old one; ``df`` may be made from the table.
    Folders that no commit names any longer are left for the owner to clear,
    as readers may still be in them."""
    spark = df.sparkSession
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _commit(spark, folder, _last_commit(spark, folder), {None: path}, df.schema.json())


def replace_parts(df: DataFrame, folder: str, part: Column) -> None:
    """Replace only the parts (months, say) that ``df`` has rows of: ``part``
    tells a row's part as text.  All other parts stay as they are, in the same
    commit.  A table whose last commit has no parts must be replaced whole."""
    spark = df.sparkSession
    last = _last_commit(spark, folder)
    old = {x["value"]: x["path"] for x in last["parts"]} if last else {}
    if None in old:
        raise ValueError(f"{folder} is not written in parts")
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    named = df.withColumn("__part", F.coalesce(part.cast("string"), F.lit("")))
    named.withColumn("__part_folder", F.md5("__part")).write.partitionBy("__part_folder").parquet(path)
    written = spark.read.parquet(path) if not df.isEmpty() else None
    values = [r[0] for r in written.select("__part").distinct().collect()] if written is not None else []  # one row a part
    new = {v: f"{path}/__part_folder={hashlib.md5(v.encode()).hexdigest()}" for v in values}
    _commit(spark, folder, last, old | new, df.schema.json())


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """The table as its last commit has it."""
    last = _last_commit(spark, folder)
    if last is None:
        raise FileNotFoundError(f"no table was written to {folder}")
    schema = StructType.fromJson(json.loads(last["schema"]))
    paths = [x["path"] for x in last["parts"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_tables(tables: dict[str, DataFrame], root: str, partition_orders_by_month: bool = False) -> None:
    """Replace each table under ``root``.  Optionally keep orders in parts by
    order month, so that later writes can replace single months."""
    for name, df in tables.items():
        folder = f"{root.rstrip('/')}/{name}"
        if name == "orders" and partition_orders_by_month:
            replace_parts(df, folder, F.date_format("order_date", "yyyy-MM"))
        else:
            replace_table(df, folder)


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Read with the declared schemas (no inference)."""
    out = {}
    for name in TABLES:
        df = read_table(spark, f"{root.rstrip('/')}/{name}")
        schema = SHOP_SCHEMAS[name]()
        out[name] = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    return out


def register(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


# Bucketing keys: the join/aggregate keys the analyses use most.
BUCKET_KEYS = {"orders": "order_id", "order_items": "order_id", "customers": "customer_id"}


def save_bucketed(tables: dict[str, DataFrame], root: str, n_buckets: int, prefix: str = "shop_") -> dict[str, str]:
    """Save tables as catalog tables bucketed (and sorted) on their join
    key, files under ``root``.  Reading both sides of orders x order_items
    back with ``spark.table`` then joins and aggregates per order without
    a shuffle (same bucket count on both sides).  Returns table names."""
    names = {}
    for name, df in tables.items():
        table = f"{prefix}{name}"
        writer = df.write.mode("overwrite").option("path", f"{root.rstrip('/')}/{name}")
        key = BUCKET_KEYS.get(name)
        if key:
            writer = writer.bucketBy(n_buckets, key).sortBy(key)
        writer.saveAsTable(table)
        names[name] = table
    return names
