"""Audits of keys that don't read their tables again.

The whole-number keys of a table are kept as one row for each 32,768
neighbouring ids (Spark's bitmap buckets): how many rows hold one of them, and
a bitmap of those met.  ``refresh`` lists the table's files and reads only
those added since the last time; the old and the new summary merge by sum and
OR.  Where a file that was read has changed or gone, the summary is made anew.

Duplicates and orphans follow from the summaries: a bucket with more rows than
bits holds duplicates, and one whose bits are not all among the parent's holds
orphans.  Only the rows of such buckets are read, one column of them, to count
the faults exactly; a clean table is not read at all.

A generation of the summary and the list of its files are written first and a
note that names them last, so a writer that dies leaves the older generation.
One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, time) of the files of a table; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.unix_micros("modificationTime").alias("time"))


def summarise(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, bucket, rows, bitmap) of the named columns.  Null ids are a
    bucket of their own, null, without bits.  Ids are counted before they move
    to their bucket, so a hot id is one row there."""
    ids = rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("long").alias("id")) for k in keys])))
    counted = ids.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.select("key", "n", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit"))
    # bitmaps are built after the shuffle: a task's few ids of a bucket are smaller than its bitmap
    return (placed.repartition("key", "bucket").groupBy("key", "bucket")
            .agg(F.sum("n").alias("rows"), F.bitmap_construct_agg("bit").alias("bitmap")))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return (a.unionByName(b).groupBy("key", "bucket")
            .agg(F.sum("rows").alias("rows"), F.bitmap_or_agg("bitmap").alias("bitmap")))


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """The summary kept under ``folder``."""
    return spark.read.parquet(f"{_last(spark, folder)}/summary")


def _last(spark: SparkSession, folder: str) -> str | None:
    try:
        note = spark.read.parquet(f"{folder}/notes").orderBy(F.col("number").desc()).first()
    except AnalysisException:  # no note yet
        return None
    return note["generation"]


def refresh(spark: SparkSession, table: str, keys: Sequence[str], folder: str) -> int:
    """Bring the summary of the Parquet table ``table`` under ``folder`` up to
    its files; returns how many files were read.  The paths of files added go
    into the read, as Spark's own listing of a table does."""
    now = files_of(spark, table).checkpoint()
    generation = _last(spark, folder)
    if generation is not None:
        seen = spark.read.parquet(f"{generation}/files")
        same = set(keys) == {r["key"] for r in spark.read.parquet(f"{generation}/keys").collect()}
        if not same or not seen.join(now, ["path", "length", "time"], "left_anti").isEmpty():
            generation = None
    added = now if generation is None else now.join(seen, ["path", "length", "time"], "left_anti")
    paths = [r["path"] for r in added.select("path").collect()]
    if not paths and generation is not None:
        return 0
    summary = summarise(spark.read.parquet(*paths), keys)
    if generation is not None:
        summary = merge(spark.read.parquet(f"{generation}/summary"), summary)
    made = f"{folder}/generation-{uuid.uuid4().hex}"
    summary.write.parquet(f"{made}/summary")
    now.write.parquet(f"{made}/files")
    spark.createDataFrame([(k,) for k in keys], "key string").write.parquet(f"{made}/keys")
    number = 0 if _last(spark, folder) is None else spark.read.parquet(f"{folder}/notes").count()
    spark.createDataFrame([(number, made)], "number long, generation string").coalesce(1).write.mode("append").parquet(f"{folder}/notes")
    return len(paths)


def _of(summary: DataFrame, key: str) -> DataFrame:
    return summary.where(F.col("key") == key).drop("key")


def _rows_in(table: DataFrame, key: str, buckets: DataFrame) -> DataFrame:
    """The ids of ``table`` in the given buckets."""
    ids = table.select(F.col(key).cast("long").alias("id"))
    return ids.join(buckets.select("bucket"), F.bitmap_bucket_number("id").eqNullSafe(F.col("bucket")), "left_semi")


def unique_from(summary: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """One row: (rows, distinct_keys, faults); faults are the ids met more
    than once, null counting as an id."""
    s = _of(summary, key)
    distinct = F.when(F.col("bucket").isNull(), 1).otherwise(F.bitmap_count("bitmap"))
    totals = s.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"),
                   F.coalesce(F.sum(distinct), F.lit(0)).cast("bigint").alias("distinct_keys"))
    suspect = s.where(F.col("rows") > distinct)
    if suspect.isEmpty():
        return totals.withColumn("faults", F.lit(0).cast("bigint"))
    repeated = _rows_in(table, key, suspect).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return totals.withColumn("faults", repeated.agg(F.count(F.lit(1)).cast("bigint")).scalar())


def orphans_from(child: DataFrame, child_key: str, child_table: DataFrame,
                 parent: DataFrame, parent_key: str, parent_table: DataFrame) -> DataFrame:
    """One row: (rows, distinct_keys, faults) of the child's non-null ids;
    faults are its rows whose id no parent has."""
    c = _of(child, child_key).where(F.col("bucket").isNotNull())
    p = _of(parent, parent_key).where(F.col("bucket").isNotNull())
    totals = c.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"),
                   F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("bigint").alias("distinct_keys"))
    # a child's bits are all among the parent's where OR adds none to them
    both = p.select("bucket", "bitmap", F.lit(1).alias("of_parent")).union(c.select("bucket", "bitmap", F.lit(0)))
    suspect = (both.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("either"),
                                          F.coalesce(F.sum(F.when(F.col("of_parent") == 1, F.bitmap_count("bitmap"))), F.lit(0)).alias("parents"))
               .where(F.bitmap_count("either") > F.col("parents")))
    if suspect.isEmpty():
        return totals.withColumn("faults", F.lit(0).cast("bigint"))
    counted = _rows_in(child_table, child_key, suspect).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    missing = counted.join(_rows_in(parent_table, parent_key, suspect), "id", "left_anti")
    return totals.withColumn("faults", missing.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")).scalar())
