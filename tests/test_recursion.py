"""Recursion that returns rows, against Spark's WITH RECURSIVE and brute force."""
import random

from pyspark.sql import functions as F

from basketry.operators.recursion import best_chains, reach


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_reach_equals_with_recursive(spark):
    rng = random.Random(5)
    # cycles, repeated links, a hot node, nulls
    links = [(rng.choice([0, 0, 0, *range(12)]), rng.randrange(12)) for _ in range(60)] + [(None, 3), (4, None), (7, 7)]
    seed = [("a", 0), ("b", 5), ("b", 5), ("c", None), (None, 7), ("d", 99)]
    spark.createDataFrame(links, "node int, next_node int").createOrReplaceTempView("r_links")
    spark.createDataFrame(seed, "name string, node int").createOrReplaceTempView("r_seed")
    want = spark.sql("""WITH RECURSIVE t(name, node, depth) AS (
        SELECT DISTINCT name, node, 1 FROM r_seed
        UNION ALL SELECT t.name, l.next_node, t.depth + 1 FROM t JOIN (SELECT DISTINCT * FROM r_links) l ON l.node = t.node WHERE t.depth < 4)
        SELECT DISTINCT name, node, depth FROM t""").collect()
    extra = spark.table("r_links").withColumn("name", F.lit("clash"))  # a further column, named like a carried one
    got = reach(spark.table("r_seed"), extra, ["node"], 4).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 30
    assert reach(spark.table("r_seed").where("false"), extra, ["node"], 4).count() == 0
    assert reach(spark.table("r_seed"), extra.where("false"), ["node"], 4).count() == 5


def brute(steps, depth):
    best = {}

    def walk(key, at, total, path):
        k = (key, len(path))
        best[k] = min(best.get(k, (-total, path)), (-total, path))
        if len(path) < depth:
            for key2, at2, id2, v, _ in steps:
                if key2 == key and at2 is not None and v is not None and at2 > at:
                    walk(key, at2, total + v, [*path, id2])
    for key, at, id_, v, first in steps:
        if first and None not in (key, at, v):
            walk(key, at, v, [id_])
    return sorted((k, n, -total, path) for (k, n), (total, path) in best.items())


def test_best_chains_equal_brute_force(spark):
    rng = random.Random(8)
    # equal values and times make ties; negative values make short chains best
    steps = [(rng.choice("aaab"), rng.choice([*range(6), None]), i, rng.choice([-2, 0, 1, 1, 3, None]), rng.random() < 0.4) for i in range(36)]
    steps += [(None, 1, 90, 5, True), ("c", 1, 91, 5, False), ("d", 2, 92, 0, True)]
    df = spark.createDataFrame(steps, "key string, at int, id int, value int, starts boolean").repartition(5)
    got = rows(best_chains(df, "key", "at", "id", "value", "starts", 4), "key", "length", "total", "path")
    assert got == [tuple(x) for x in brute(steps, 4)] and len({k for k, *_ in got}) == 3
    assert best_chains(df.where("false"), "key", "at", "id", "value", "starts", 4).count() == 0


def test_a_hot_key_has_a_row_for_each_time(spark):
    """Half a million steps of one key on 2,000 days: far too many pairs."""
    df = spark.range(500_000).selectExpr("'hot' AS key", "cast(id % 2000 AS int) AS at", "id", "cast(pmod(hash(id), 1000) AS bigint) AS value", "id % 2000 < 5 AS starts")
    got = best_chains(df, "key", "at", "id", "value", "starts", 5).orderBy("length").collect()
    day = df.groupBy("at").agg(F.max("value").alias("v")).collect()
    assert [r.length for r in got] == [1, 2, 3, 4, 5]
    assert got[0].total == max(r.v for r in day if r.at < 5) and got[4].total <= 5 * 999 and got[4].total > 5 * 990
