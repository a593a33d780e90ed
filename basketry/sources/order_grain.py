"""The order-grain table, kept between analyses.

Nearly every analysis starts from one row per order (revenue, profit, lines,
units).  ``write`` computes these rows once and keeps them as Parquet,
bucketed and sorted by order_id; ``kept`` gives them back as long as the line
items are the files they were made from.  A shop loaded with
``load(spark, sf_dir, order_grain=folder)`` uses them wherever
``plans.common.order_totals`` is asked for, and computes them anew where they
are missing or out of date.

Freshness: number, bytes and a combined hash of name, length and time of all
files of line items, listed by Spark.  A note holds these figures and names
the folder of the rows; it is written after them, so a writer that dies, or
an append while it runs, leaves an older note, which then holds no more or
still holds in full.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


def listing(spark: SparkSession, path: str) -> Row:
    """(files, bytes, code) of the files under ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    code = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    return files.select("length", code.alias("code")).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.coalesce(F.bit_xor("code"), F.lit(0)).alias("code")).first()


def _named(folder: str) -> str:
    return "order_totals_" + folder.rsplit("-", 1)[-1]


def write(shop, totals: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Keep ``totals`` (one row per order_id) under ``folder``."""
    spark = shop.spark
    made_from = listing(spark, shop.lines_path)
    rows = f"{folder}/rows-{uuid.uuid4().hex}"
    totals.write.option("path", rows).bucketBy(buckets, "order_id").sortBy("order_id").saveAsTable(_named(rows))
    note = spark.createDataFrame([(rows, buckets, totals.schema.json(), *made_from)],
                                 "rows string, buckets int, schema string, files long, bytes long, code long")
    # notes are only added; the last one counts
    note.withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/notes")


def kept(shop, folder: str) -> DataFrame | None:
    """The rows kept under ``folder``; None if there are none, or if the line
    items are no longer what they were made from."""
    spark = shop.spark
    try:
        note = spark.read.parquet(f"{folder}/notes").orderBy(F.col("written").desc(), "rows").first()
    except AnalysisException:
        return None
    if note is None or tuple(listing(spark, shop.lines_path)) != (note["files"], note["bytes"], note["code"]):
        return None
    name = _named(note["rows"])
    if not spark.catalog.tableExists(name):  # another application wrote them: name the files again, with their buckets
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(note["schema"])))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet CLUSTERED BY (order_id) SORTED BY (order_id) "
                  f"INTO {note['buckets']} BUCKETS LOCATION '{note['rows']}'")
    return spark.table(name)
