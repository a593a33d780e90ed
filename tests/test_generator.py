from pyspark.sql import functions as F

from basketry.operators.audit import duplicate_keys, orphans
from basketry.plans.revenue import revenue_by_category
from basketry.sources.fixture import TableShop
from basketry.sources.generator import generate
from basketry.sources.io import read_tables, write_tables


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_same_output_for_any_partitioning(spark):
    a = generate(spark, 60, 400, seed=42, partitions=1)
    b = generate(spark, 60, 400, seed=42, partitions=7)
    for name in ("customers", "orders", "order_items"):
        assert _rows(a.tables()[name]) == _rows(b.tables()[name])


def test_shape_and_integrity(spark):
    g = generate(spark, 50, 500, seed=7)
    items = g.order_items
    per_order = items.groupBy("order_id").agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("d"))
    assert per_order.where((F.col("n") != F.col("d")) | (F.col("n") > 4)).count() == 0
    assert items.where(~F.col("quantity").between(1, 3)).count() == 0
    bad = items.where(F.col("revenue") != F.round(F.col("unit_price") * F.col("quantity") * (1 - F.col("discount")), 2))
    assert bad.count() == 0
    assert duplicate_keys(items, "order_items", ["item_id"]).first().duplicated_keys == 0
    assert orphans(g.orders, "customer_id", g.customers, "customer_id", "o", "c").first().orphan_rows == 0
    d = g.orders.agg(F.min("order_date"), F.max("order_date")).first()
    assert str(d[0]) == "2023-01-01" and str(d[1]) == "2024-12-31"
    assert g.products.count() == 25


def test_write_read_round_trip_and_analysis(spark, tmp_path):
    g = generate(spark, 40, 300, seed=1)
    write_tables(g.tables(), str(tmp_path), partition_orders_by_month=True)
    t = read_tables(spark, str(tmp_path))
    assert _rows(t["orders"]) == _rows(g.orders)
    shop = TableShop(spark, t["customers"], t["products"], t["orders"], t["order_items"])
    out = revenue_by_category(shop).collect()
    assert {r.category for r in out} <= {"Electronics", "Fashion", "Home", "Beauty", "Grocery"}


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    from basketry.plans.common import order_totals
    from basketry.sources.io import save_bucketed
    g = generate(spark, 40, 300, seed=3)
    names = save_bucketed(g.tables(), str(tmp_path), 4, prefix="t_bucketed_")
    t = {k: spark.table(v) for k, v in names.items()}
    shop = TableShop(spark, t["customers"], t["products"], t["orders"], t["order_items"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = shop.orders.join(order_totals(shop), "order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
        assert joined.count() == g.orders.join(g.order_items.select("order_id").distinct(), "order_id").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_weighted_draws_follow_the_weights(spark):
    from pyspark.sql import functions as F

    from basketry.functions.draws import weighted_choice
    keys = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey")
    n = keys.count()
    for salt, values, weights in [("n_items", [1, 2, 3, 4], [0.50, 0.30, 0.15, 0.05]),
                                  ("status", ["Delivered", "Shipped", "Cancelled", "Returned"], [0.72, 0.15, 0.08, 0.05])]:
        drawn = keys.select(weighted_choice(42, salt, F.col("o_orderkey"), values, weights).alias("v"))
        share = {r.v: r["count"] / n for r in drawn.groupBy("v").count().collect()}
        for v, w in zip(values, weights):
            assert abs(share[v] - w) < 0.02, (v, share)
