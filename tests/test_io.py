"""Replacing a table as a commit."""
import pytest
from pyspark.sql import functions as F

from basketry.sources.io import read_table, replace_parts, replace_table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replace_from_itself_and_empty(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_table(spark, folder)
    replace_table(spark.range(5).withColumn("v", F.col("id") * 2), folder)
    before = read_table(spark, folder)
    replace_table(before.where("id > 1").withColumn("v", F.col("v") + 1), folder)
    assert rows(read_table(spark, folder)) == [(2, 5), (3, 7), (4, 9)]
    assert rows(before) == [(i, 2 * i) for i in range(5)]  # a reader of the old table still has it whole
    replace_table(before.limit(0), folder)
    assert rows(read_table(spark, folder)) == [] and read_table(spark, folder).columns == ["id", "v"]


def test_a_failing_write_leaves_the_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    replace_table(spark.range(3), folder)
    with pytest.raises(Exception):
        replace_table(spark.range(100).select(F.assert_true(F.col("id") < 90).isNull().cast("long").alias("id")), folder)
    assert rows(read_table(spark, folder)) == [(0,), (1,), (2,)]


def test_one_month_is_replaced(spark, tmp_path):
    folder = str(tmp_path / "t")
    day = F.to_date(F.lit("2024-01-01")) + (F.col("id") * 10).cast("int")
    df = spark.range(12).select("id", day.alias("day")).union(spark.createDataFrame([(99, None)], "id long, day date"))
    month = F.date_format("day", "yyyy-MM")
    replace_parts(df, folder, month)
    assert rows(read_table(spark, folder)) == rows(df)
    new = spark.createDataFrame([(100, "2024-02-05"), (101, "2024-07-01")], "id long, day string").withColumn("day", F.to_date("day"))
    replace_parts(new, folder, month)
    kept = df.where(~F.coalesce(month == "2024-02", F.lit(False)))
    assert rows(read_table(spark, folder)) == rows(kept.union(new))
    files = {f.rsplit("/", 2)[0] for f in read_table(spark, folder).inputFiles()}
    assert len(files) == 2  # the other months are still the files first written
    replace_parts(new.limit(0), folder, month)
    assert rows(read_table(spark, folder)) == rows(kept.union(new))
    whole = str(tmp_path / "whole")
    replace_table(df, whole)
    with pytest.raises(ValueError):
        replace_parts(new, whole, month)
