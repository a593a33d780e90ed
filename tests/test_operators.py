from pyspark.sql import functions as F

from basketry.operators.audit import domain_violations, duplicate_keys, orphans
from basketry.operators.events import argmin_rows
from basketry.operators.pairs import item_counts, pair_counts
from basketry.operators.pivot import pivot_sum


def test_pair_counts_equal_self_join(spark):
    rows = [(c, i) for c in range(60) for i in "abcde" if (c * 7 + ord(i)) % 3 != 0] + [(1, "a"), (2, None)]
    df = spark.createDataFrame(rows, "c int, i string")
    d = df.distinct()
    got = {(r.item_a, r.item_b): r.both for r in pair_counts(d, "c", "i").collect()}
    assert {r.item: r.holders for r in item_counts(d, "i").collect()} == \
        {r.i: r["count"] for r in d.where("i is not null").groupBy("i").count().collect()}
    a, b = d.alias("a"), d.alias("b")
    ref = (a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.i") < F.col("b.i")))
           .groupBy(F.col("a.i"), F.col("b.i")).agg(F.countDistinct("a.c")).collect())
    assert got == {(r[0], r[1]): r[2] for r in ref}


def test_pivot_gives_zero_not_null(spark):
    df = spark.createDataFrame([("x", "UPI", 5), ("x", "Card", 2), ("y", "UPI", 1)], "g string, p string, v int")
    out = {r.g: r for r in pivot_sum(df, ["g"], "p", ["UPI", "Card", "COD"], "v", total="t").collect()}
    assert out["y"]["Card"] == 0 and out["x"]["COD"] == 0 and out["x"]["t"] == 7


def test_argmin_rows_keeps_ties(spark):
    df = spark.createDataFrame([(1, 10, 3), (1, 11, 3), (1, 12, 4), (2, 13, 9)], "e int, id int, t int")
    assert sorted(r.id for r in argmin_rows(df, "e", "t").collect()) == [10, 11, 13]


def test_audits_find_planted_faults(spark):
    orders = spark.createDataFrame([(1, 10, "Delivered"), (1, 11, "Lost"), (2, 99, None)],
                                   "order_id int, customer_id int, status string")
    customers = spark.createDataFrame([(10,), (11,)], "customer_id int")
    dom = {r.value: r.rows for r in domain_violations(orders, "orders", "status",
                                                      ["Delivered", "Shipped"]).collect()}
    assert dom == {"Lost": 1, None: 1}
    dup = duplicate_keys(orders, "orders", ["order_id"]).first()
    assert (dup.rows, dup.distinct_keys, dup.duplicated_keys) == (3, 2, 1)
    assert orphans(orders, "customer_id", customers, "customer_id", "orders", "customers").first().orphan_rows == 1


def test_pairs_of_many_items_and_a_hot_entity(spark):
    """100 items; one entity holds all of them and a third of the rows."""
    rows = [(0, i) for i in range(100)] + [(c, (c * 7 + k) % 100) for c in range(1, 68) for k in (0, 3, 50)]
    held = spark.createDataFrame(rows, "c int, i int").distinct()
    got = {(r.item_a, r.item_b): r.both for r in pair_counts(held, "c", "i").collect()}
    want = {}
    for c in range(68):
        mine = sorted({i for e, i in rows if e == c})
        for n, a in enumerate(mine):
            for b in mine[n + 1:]:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == want


def test_salted_join_equals_a_join(spark):
    from basketry.operators.salted import salted_join
    fact = spark.range(300).selectExpr("id", "CAST(IF(id % 3 = 0, 7, id % 11) AS INT) AS k")
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(0, 9)], "k int, name string")
    view = lambda df: sorted(map(tuple, df.select("id", "k", "name").collect()))
    assert view(salted_join(fact, dim, "k", "id")) == view(fact.join(dim, "k"))


def test_load_sees_new_files(spark, tmp_path):
    from basketry.sources.fixture import load
    path = str(tmp_path / "orders.parquet")
    columns = "CAST(id AS BIGINT) AS o_orderkey", "CAST(1 AS BIGINT) AS o_custkey", "DATE '2000-01-01' AS o_orderdate", "'F' AS o_orderstatus", "'5-LOW' AS o_orderpriority"
    spark.range(10).selectExpr(*columns).write.parquet(path)
    assert load(spark, str(tmp_path)).orders.count() == 10
    spark.range(20).selectExpr(*columns).write.mode("append").parquet(path)
    assert load(spark, str(tmp_path)).orders.count() == 30


def test_sums_do_not_depend_on_partitions(spark, shop):
    from basketry.plans.product import discount_impact
    from basketry.plans.revenue import revenue_by_category
    from basketry.sources.fixture import Shop

    class Dealt(Shop):
        n = 1

        def raw(self, name):
            return super().raw(name).repartition(self.n)
    one, many = Dealt(spark, shop.sf_dir), Dealt(spark, shop.sf_dir)
    many.n = 50
    for q in (revenue_by_category, discount_impact):
        assert list(map(tuple, q(one).collect())) == list(map(tuple, q(many).collect()))


def test_journey_paths_of_a_busy_customer(spark, shop):
    """Chains far beyond DECIMAL(38): 5 orders on each of 2,000 days."""
    import math
    from basketry.plans.advanced import journey_paths
    from basketry.sources.fixture import TableShop
    orders = spark.range(10_000).selectExpr("id AS order_id", "1 AS customer_id", "date_add(DATE '2000-01-01', CAST(id DIV 5 AS INT)) AS order_date",
                                            "'Delivered' AS status", "'UPI' AS payment", "'x' AS city")
    items = spark.range(10_000).selectExpr("id AS order_id", "1 AS product_id", "1 AS quantity", "CAST(1e12 AS DECIMAL(18,2)) AS revenue", "CAST(0 AS DECIMAL(18,2)) AS profit")
    got = {r.order_number: r for r in journey_paths(TableShop(spark, None, None, orders, items)).collect()}
    for k in range(1, 6):
        want = 5.0 ** k * math.comb(1999, k - 1) * 1e12
        assert abs(got[k].total_revenue / want - 1) < 1e-9 and got[k].customers == 1
