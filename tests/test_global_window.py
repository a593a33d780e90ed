import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators.global_window import asc, desc, global_window
from basketry.operators.topk import topk


def native(df, order, keys, k):
    so = [F.col(o.column).asc_nulls_first() if o.ascending else F.col(o.column).desc_nulls_last() for o in order]
    w = Window.orderBy(*so, *keys)
    return (df.withColumn("rn2", F.row_number().over(w))
            .withColumn("rk2", F.rank().over(Window.orderBy(*so)))
            .withColumn("nt2", F.ntile(k).over(w))
            .withColumn("rs2", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))))


def make(spark, n, seed, hot=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if hot and rnd.random() < 0.34:
            v = 7  # one value holding about a third of all rows
        else:
            v = rnd.choice([None, 1, 2, 3, rnd.randint(0, 1000)])
        rows.append((i, v, Decimal(rnd.randint(-50, 50)) / 4))
    return spark.createDataFrame(rows, "id long, v int, d decimal(10,2)")


@pytest.mark.parametrize("order", [[desc("v")], [asc("v")], [desc("d"), asc("v")]])
@pytest.mark.parametrize("hot", [False, True])
def test_matches_native_windows(spark, order, hot):
    df = make(spark, 3000, 7, hot)
    out = global_window(df, order, ["id"], row_number="rn", rank="rk", ntile=("nt", 7),
                        running_sum=("rs", "d"), buckets=16)
    j = out.join(native(df, order, ["id"], 7), "id")
    bad = j.where((F.col("rn") != F.col("rn2")) | (F.col("rk") != F.col("rk2")) |
                  (F.col("nt") != F.col("nt2")) | (F.col("rs") != F.col("rs2"))).count()
    assert j.count() == 3000 and bad == 0


def test_hot_value_is_split_over_buckets(spark):
    from basketry.operators.global_window import _B, bucketed
    sizes = bucketed(make(spark, 3000, 3, hot=True), [desc("v"), asc("id")], 8).groupBy(_B).count()
    assert sizes.agg(F.max("count")).first()[0] < 3000 * 0.25  # no bucket holds the whole hot value (~34%)


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("kind, values", [
    ("double", [NAN, -NAN, INF, -INF, 0.0, -0.0, 1.5, None]),
    ("bigint", [-(1 << 63), (1 << 63) - 1, 0, 7, None]),
    ("string", ["", "a", "B", "é", "zz", None]),
    ("timestamp_ntz", ["2020-01-01 00:00:00", "2020-01-01 00:00:01", "1970-01-01 00:00:00", None]),
    ("int", [3]),
])
@pytest.mark.parametrize("buckets", [1, 4, 20])
def test_equals_native_for_odd_values(spark, kind, values, buckets):
    rnd = random.Random(kind)
    rows = [(i, rnd.choice(values), rnd.choice([None, Decimal("1.25"), Decimal(-3)]) if i > 40 or kind == "int" else None) for i in range(200)]
    source = kind if kind in ("double", "bigint", "int") else "string"
    df = spark.createDataFrame(rows, f"id long, v {source}, d decimal(10,2)").withColumn("v", F.col("v").cast(kind))
    for order in ([desc("v")], [asc("v")], [desc("v"), asc("d")]):
        out = global_window(df, order, ["id"], row_number="rn", rank="rk", ntile=("nt", 7), running_sum=("rs", "d"), buckets=buckets)
        j = out.join(native(df, order, ["id"], 7).select("id", "rn2", "rk2", "nt2", "rs2"), "id")
        same = [F.col(f"{c}").eqNullSafe(F.col(f"{c}2")) for c in ("rn", "rk", "nt", "rs")]
        assert j.count() == 200 and j.where(~(same[0] & same[1] & same[2] & same[3])).count() == 0


def test_small_and_empty_inputs(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "id long, v int")
    out = {r.id: (r.nt, r.rk) for r in global_window(df, [desc("v")], ["id"], rank="rk", ntile=("nt", 4)).collect()}
    assert out == {1: (1, 1), 2: (2, 1)}
    empty = spark.createDataFrame([], "id long, v int")
    assert global_window(empty, [desc("v")], ["id"], rank="rk", ntile=("nt", 4)).count() == 0


def test_ntile_sizes_differ_by_at_most_one(spark):
    df = make(spark, 1003, 11)
    counts = [r[1] for r in global_window(df, [asc("v")], ["id"], ntile=("nt", 5), buckets=8)
              .groupBy("nt").count().collect()]
    assert len(counts) == 5 and max(counts) - min(counts) <= 1 and sum(counts) == 1003


def test_topk_rank_and_ntile_are_global(spark):
    df = make(spark, 500, 5)
    top = {r.id: (r.rk, r.nt) for r in topk(df, 25, [desc("d")], ["id"], rank="rk", ntile=("nt", 4)).collect()}
    ref = native(df, [desc("d")], ["id"], 4).where(F.col("rn2") <= 25)
    assert top == {r.id: (r.rk2, r.nt2) for r in ref.collect()}


def test_several_specs_share_passes(spark):
    from basketry.operators.global_window import GlobalSpec, global_windows
    df = make(spark, 2000, 13, hot=True)
    out = global_windows(df, [GlobalSpec((desc("v"),), ("id",), rank="rk", ntile=("nt", 5)),
                              GlobalSpec((asc("d"),), ("id",), row_number="rn", running_sum=("rs", "d"))],
                         buckets=8)
    a = native(df, [desc("v")], ["id"], 5).select("id", "rk2", "nt2")
    b = native(df, [asc("d")], ["id"], 5).select("id", "rn2", "rs2")
    j = out.join(a, "id").join(b, "id")
    bad = j.where((F.col("rk") != F.col("rk2")) | (F.col("nt") != F.col("nt2")) |
                  (F.col("rn") != F.col("rn2")) | (F.col("rs") != F.col("rs2"))).count()
    assert j.count() == 2000 and bad == 0


def test_rank_without_keys_splits_hot_value(spark):
    """No tie-break keys: an internal row hash still spreads a value that
    holds a third of all rows over several buckets, and RANK stays exact."""
    from basketry.operators.global_window import GlobalSpec, global_windows
    df = make(spark, 3000, 21, hot=True)
    out = global_windows(df, [GlobalSpec((desc("v"),), rank="rk")], buckets=12)
    ref = df.withColumn("rk2", F.rank().over(Window.orderBy(F.col("v").desc_nulls_last())))
    j = out.join(ref.select("id", "rk2"), "id")
    assert j.count() == 3000 and j.where(F.col("rk") != F.col("rk2")).count() == 0
    assert set(out.columns) == set(df.columns) | {"rk"}
