"""Hot keys are found, and only they are salted."""
import random

import pytest
from pyspark.sql import functions as F

from basketry.operators.salted import hot_keys, salted_join
from basketry.plans import product, revenue
from basketry.sources.fixture import TableShop, load

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["long", "string"])
def test_hot_keys_and_their_shares(spark, kind):
    rng = random.Random(1)
    rows = [(7,)] * 3000 + [(8,)] * 600 + [(None,)] * 2000 + [(rng.randrange(1000, 5000),) for _ in range(4400)]
    df = spark.createDataFrame(rows, "k long").select(F.col("k").cast(kind).alias("k")).repartition(6)
    found = hot_keys(df, "k")
    assert {int(k) for k in found} == {7, 8}
    assert sorted(found.values()) == pytest.approx([0.06, 0.3], abs=0.01)
    assert hot_keys(df.where("k > 900"), "k") == {} and hot_keys(df.limit(0), "k") == {}


def test_hot_rows_are_spread_and_none_is_lost(spark):
    fact = spark.createDataFrame([(i, 7 if i % 3 == 0 else None if i % 50 == 1 else i % 40) for i in range(6000)], "id long, k long")
    dimension = spark.createDataFrame([(k, f"n{k}") for k in range(45)] + [(7, "again"), (None, "none")], "k long, name string")
    hot = hot_keys(fact, "k", share=0.1)
    assert list(hot) == [7]
    got = salted_join(fact, dimension, "k", "id", hot)
    assert got.exceptAll(fact.join(dimension, "k")).count() == 0 and got.count() == fact.join(dimension, "k").count()
    assert "__salt" in got._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot_shop(spark):
    """A product on a third of all lines."""
    shop = load(spark, SF)
    items = shop.order_items.withColumn("product_id", F.when(F.xxhash64("order_id", "line_no") % 3 == 0, F.lit(5)).otherwise(F.col("product_id")).cast("long"))
    return TableShop(spark, shop.customers.cache(), shop.products.cache(), shop.orders_with_city().cache(), items.cache())


@pytest.mark.parametrize("build, joined", [(revenue.revenue_by_category, revenue.revenue_by_category), (product.cross_sell, product.customer_items)])
def test_analyses_on_a_hot_product(spark, hot_shop, build, joined, monkeypatch):
    made = build(hot_shop)
    assert "__salt" in joined(hot_shop)._jdf.queryExecution().optimizedPlan().toString()
    for module in (revenue, product):
        monkeypatch.setattr(module, "hot_keys", lambda rows, key: {})
    assert list(map(tuple, made.collect())) == list(map(tuple, build(hot_shop).collect()))
