"""Kept key summaries: the same findings as the scans, appended files only."""
import pytest
from pyspark.sql import functions as F

from basketry.operators import key_summary
from basketry.operators.audit import duplicate_keys, orphans
from basketry.plans import audits
from basketry.sources.fixture import load

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """A parent and a child with repeated, null, negative, far and orphaned ids."""
    parents = [*range(1, 500), 40_000, 40_001, 40_001, -5, None, None, 1 << 40]
    children = [*range(1, 300), 7, 7, 7, 40_000, -5, -6, None, 1 << 40, 1 << 41, 1 << 41]
    for name, ids in (("parent", parents), ("child", children)):
        spark.createDataFrame([(i, "x") for i in ids], "id long, other string").repartition(3).write.parquet(f"{tmp_path}/{name}")
    return str(tmp_path)


def findings(spark, folder):
    kept = {n: key_summary.kept(spark, f"{folder}/kept-{n}") for n in ("parent", "child")}
    read = {n: spark.read.parquet(f"{folder}/{n}") for n in kept}
    unique = {n: tuple(key_summary.unique_from(kept[n], "id", read[n]).first()) for n in kept}
    lost = key_summary.orphans_from(kept["child"], "id", read["child"], kept["parent"], "id", read["parent"]).first()
    return unique, tuple(lost)


def scanned(spark, folder):
    read = {n: spark.read.parquet(f"{folder}/{n}") for n in ("parent", "child")}
    unique = {n: tuple(duplicate_keys(df, n, ["id"]).first())[2:] for n, df in read.items()}
    some = read["child"].select("id").where("id IS NOT NULL")
    lost = orphans(read["child"], "id", read["parent"], "id", "child", "parent").first().orphan_rows
    return unique, (some.count(), some.distinct().count(), lost)


def refreshed(spark, folder):
    return [key_summary.refresh(spark, f"{folder}/{n}", ["id"], f"{folder}/kept-{n}") for n in ("parent", "child")]


def test_findings_equal_the_scans_before_and_after_appends(spark, tables):
    read = refreshed(spark, tables)
    assert min(read) > 0 and findings(spark, tables) == scanned(spark, tables)
    assert scanned(spark, tables)[0]["parent"][2] == 2 and scanned(spark, tables)[1][2] == 3
    assert refreshed(spark, tables) == [0, 0]  # nothing new, nothing read
    more = spark.createDataFrame([(2, "y"), (600, "y"), (70_000, "y"), (None, "y")], "id long, other string").coalesce(1)
    more.write.mode("append").parquet(f"{tables}/child")
    assert refreshed(spark, tables) == [0, 1]  # only the file added
    assert findings(spark, tables) == scanned(spark, tables)
    more.where("id > 100").write.mode("append").parquet(f"{tables}/parent")
    assert refreshed(spark, tables) == [1, 0] and findings(spark, tables) == scanned(spark, tables)
    more.write.mode("overwrite").parquet(f"{tables}/child")  # files are gone: made anew
    assert refreshed(spark, tables) == [0, 1] and findings(spark, tables) == scanned(spark, tables)


def test_a_writer_that_fails_leaves_the_older_summary(spark, tables):
    refreshed(spark, tables)
    before = findings(spark, tables)
    spark.createDataFrame([("no number",)], "id string").write.mode("append").parquet(f"{tables}/child")
    with pytest.raises(Exception):
        refreshed(spark, tables)
    assert tuple(key_summary.unique_from(key_summary.kept(spark, f"{tables}/kept-child"), "id", spark.range(0)).first())[:2] == before[0]["child"][:2]


def test_a_clean_table_is_not_read(spark, tmp_path):
    spark.range(1, 100_000).select("id", F.lit("x").alias("other")).write.parquet(f"{tmp_path}/parent")
    spark.range(1, 90_000).union(spark.range(5, 10).limit(0)).write.parquet(f"{tmp_path}/child")
    folder = str(tmp_path)
    refreshed(spark, folder)
    kept = {n: key_summary.kept(spark, f"{folder}/kept-{n}") for n in ("parent", "child")}
    read = {n: spark.read.parquet(f"{folder}/{n}") for n in kept}
    for found in (key_summary.unique_from(kept["parent"], "id", read["parent"]),
                  key_summary.orphans_from(kept["child"], "id", read["child"], kept["parent"], "id", read["parent"])):
        assert found.first().faults == 0
        assert not any(f.startswith(("file:" + folder + "/parent", "file:" + folder + "/child")) for f in found.inputFiles())


def test_the_shop_from_summaries(spark, tmp_path):
    shop = load(spark, SF)
    assert all(n > 0 for n in audits.refresh_summaries(shop, str(tmp_path)).values())
    assert all(n == 0 for n in audits.refresh_summaries(shop, str(tmp_path)).values())
    found = {(r["check"], r["table"], r["column"]): r for r in audits.from_summaries(shop, str(tmp_path)).collect()}
    for r in audits.audit_unique(shop).collect():
        if r["table"] != "order_items":
            got = found["unique", r["table"], r["key"]]
            assert (got["rows"], got["distinct_keys"], got["faults"]) == (r["rows"], r["distinct_keys"], r["duplicated_keys"])
    for r in audits.audit_fk(shop).collect():
        assert found["reference", r["child"], r["column"]]["faults"] == r["orphan_rows"]
