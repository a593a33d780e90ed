"""NTILE by exact selection of the tile borders, against Spark's own ntile."""
import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators.global_window import asc, desc
from basketry.operators.selection import Tiles, exact_ntiles


def native(df, spec):
    order = [F.col(o.column).asc_nulls_first() if o.ascending else F.col(o.column).desc_nulls_last() for o in spec.full]
    return df.withColumn("want", F.ntile(spec.k).over(Window.orderBy(*order)))


def differing(df, specs, **options):
    out = exact_ntiles(df, specs, **options)
    assert out.columns == [*df.columns, *[s.name for s in specs]]
    wrong = 0
    for spec in specs:
        j = out.select("id", spec.name).join(native(df, spec).select("id", "want"), "id")
        assert j.count() == df.count()
        wrong += j.where(~F.col(spec.name).eqNullSafe(F.col("want"))).count()
    return wrong


def test_rounds_on_hot_values_and_nulls(spark):
    """A sample far below the table: several rounds; a value holds a third."""
    rng = random.Random(5)
    rows = [(i, 7 if rng.random() < 0.34 else rng.choice([None, 1, 2, rng.randint(0, 1000)]), Decimal(rng.randint(-50, 50)) / 4,
             rng.choice(["", "a", "é", None, "zz"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, v int, d decimal(10,2), s string").repartition(5)
    specs = [Tiles("a", 5, (desc("v"),), ("id",)), Tiles("b", 3, (asc("v"), desc("s")), ("id",))]
    assert differing(df, specs, sample=500) == 0


@pytest.mark.parametrize("n, k", [(0, 5), (1, 5), (4, 5), (5, 5), (6, 5), (23, 7), (50, 1)])
def test_any_number_of_rows_and_tiles(spark, n, k):
    df = spark.createDataFrame([(i, i % 3) for i in range(n)], "id long, v int")
    assert differing(df, [Tiles("t", k, (desc("v"),), ("id",))]) == 0


@pytest.mark.parametrize("kind, values", [
    ("double", [float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1.5, None]),
    ("bigint", [-(1 << 63), (1 << 63) - 1, 0, 7, None]),
    ("string", ["", "a", "B", "é", "zz", None]),
    ("date", [dt.date(2020, 1, 1), dt.date(1950, 1, 2), None]),
    ("timestamp_ntz", ["2020-01-01 00:00:00", "2020-01-01 00:00:01", "1970-01-01 00:00:00", None]),
    ("timestamp", ["2020-03-29 02:30:00", "2020-10-25 02:30:00", "1970-01-01 00:00:00", None]),
])
def test_odd_values(spark, kind, values):
    rng = random.Random(kind)
    source = kind if kind in ("double", "bigint", "date") else "string"
    rows = [(i, rng.choice(values)) for i in range(400)]
    df = spark.createDataFrame(rows, f"id long, v {source}").withColumn("v", F.col("v").cast(kind))
    assert differing(df, [Tiles("up", 3, (asc("v"),), ("id",)), Tiles("down", 2, (desc("v"),), ("id",))], sample=200) == 0


def test_keys_may_be_text(spark):
    df = spark.createDataFrame([(i, i % 2, f"k{i * 7 % 500}") for i in range(500)], "id long, v int, key string")
    assert differing(df, [Tiles("t", 5, (asc("v"),), ("key",))], sample=250) == 0


def test_tiles_shuffle_nothing(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 11)
    out = exact_ntiles(df, [Tiles("t", 5, (desc("v"),), ("id",))])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
