"""Distinct counts by bitmaps against Spark's own."""
import random

from pyspark.sql import functions as F

from basketry.operators.bitmaps import countable, distinct_counts, id_bitmaps, merged


def test_counts_of_groups_and_their_unions(spark):
    rng = random.Random(3)
    ids = [0, 1, -1, 32767, 32768, 32769, -32768, -32769, (1 << 63) - 1, -(1 << 63), None] + [rng.randrange(-10**6, 10**6) for _ in range(500)]
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), rng.choice(ids)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, h int, id long").repartition(7)
    made = id_bitmaps(df, ["g", "h"], "id").checkpoint()
    assert made.groupBy("g", "h", "bucket").count().where("count > 1").count() == 0
    for groups in (["g", "h"], ["g"], ["h"], []):
        got = distinct_counts(merged(made, groups), groups)
        want = df.groupBy(*groups).agg(F.countDistinct("id").alias("n"))
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert countable(df, "id") and not countable(df, "g")
