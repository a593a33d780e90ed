import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from basketry.functions import expr as E
from basketry.plans.product import DISCOUNT_BUCKETS, DISCOUNT_OTHER


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_rnd_half_away_from_zero(spark):
    # ties that plain round() of a double gets wrong in some engines (D4/D5)
    assert one(spark, E.rnd(F.lit(75301.885), 2)) == 75301.89
    assert one(spark, E.rnd(F.lit(1.005), 2)) == 1.01
    assert one(spark, E.rnd(F.lit(-2.5), 0)) == -3.0
    assert one(spark, E.rnd_dec(F.lit(Decimal("2.675")), 2)) == 2.68


def test_ratio_zero_and_null_denominator(spark):
    assert one(spark, E.ratio(F.lit(5), F.lit(0))) is None
    assert one(spark, E.ratio(F.lit(5), F.lit(None).cast("int"))) is None
    assert one(spark, E.pct(F.lit(1), F.lit(4))) == 25.0


def test_month_helpers(spark):
    d = F.lit(dt.date(2024, 2, 29))
    assert one(spark, E.month_key(d)) == "2024-02"
    assert one(spark, E.month_name(d)) == "February"
    assert one(spark, E.month_diff(d, F.lit(dt.date(2023, 12, 31)))) == 2
    assert one(spark, E.days_between(d, F.lit(dt.date(2024, 2, 1)))) == 28


def test_discount_bucket_edges(spark):
    rows = [(Decimal(x),) for x in ["0.00", "0.05", "0.051", "0.10", "0.15", "0.20"]]
    df = spark.createDataFrame(rows, "d decimal(5,3)")
    got = [r[0] for r in df.select(E.bucketize("d", DISCOUNT_BUCKETS, DISCOUNT_OTHER)).collect()]
    assert got == ["0% — No Discount", "1-5% — Minimal", "6-10% — Moderate", "6-10% — Moderate",
                   "11-15% — Significant", "16-20% — Heavy"]


def test_rounding_rule_matches_duckdb(spark):
    """rnd / ratio (Spark) and R / RATIO (oracle text) agree on random
    doubles, decimal ties (x.xx5) and negatives."""
    import random

    import duckdb

    from basketry.plans.oracle import R, RATIO
    rng = random.Random(5)
    vals = [rng.uniform(-1e6, 1e6) for _ in range(1500)]
    vals += [int(rng.uniform(-1e7, 1e7)) / 1000 + 0.0005 for _ in range(500)]  # ties at 3 dp
    vals += [75301.885, 1.005, -2.5, 0.125, 2.675]
    pairs = [(v, rng.choice([3.0, 7.0, 0.0, -11.0])) for v in vals]
    df = spark.createDataFrame(pairs, "a double, b double")
    got = sorted((r.a, r.b, r.x2, r.x0, r.q) for r in df.select(
        "a", "b", E.rnd("a", 2).alias("x2"), E.rnd("a", 0).alias("x0"),
        E.rnd(E.ratio("a", "b"), 3).alias("q")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE t (a DOUBLE, b DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    exp = sorted(con.sql(f"SELECT a, b, {R('a', 2)}, {R('a', 0)}, {R(RATIO('a', 'b'), 3)} FROM t").fetchall())
    assert got == exp
