"""Windows without PARTITION BY typed as SQL: the same rows as Spark's own
windows, without its single task."""
from collections import Counter

import pytest

from basketry.operators.sql_windows import spread_windows
from basketry.plans.adhoc import counted, run_sql


@pytest.fixture(scope="module")
def view(spark):
    spark.range(300).selectExpr("id", "if(id % 7 = 0, null, id % 5) AS v", "id * 2 AS w", "CAST(id AS DECIMAL(10,2)) / 4 AS d",
                                "if(id % 3 = 0, 'a', cast(id % 11 as string)) AS `odd name`").createOrReplaceTempView("numbers")
    yield
    spark.catalog.dropTempView("numbers")


def same(spark, text, left=0):
    plain = spark.sql(text)
    made, rest = spread_windows(plain)
    assert made.dtypes == plain.dtypes and len(rest) == left
    assert Counter(map(tuple, made.collect())) == Counter(map(tuple, plain.collect()))
    return made


def test_every_spread_function(spark, view):
    made = same(spark, """SELECT id, v, RANK() OVER (ORDER BY v DESC) AS r, NTILE(4) OVER (ORDER BY v DESC, id) AS q,
        SUM(w) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS s, SUM(d) OVER (ORDER BY v + 1) AS g, COUNT(v) OVER (ORDER BY v) AS c,
        COUNT(*) OVER (ORDER BY v) AS cs, SUM(w) OVER () AS total, MAX(d) OVER () AS most, AVG(d) OVER (ORDER BY v) AS mean,
        AVG(w) OVER (PARTITION BY v ORDER BY id) AS own, DENSE_RANK() OVER (ORDER BY v) AS dr, PERCENT_RANK() OVER (ORDER BY v) AS pr,
        CUME_DIST() OVER (ORDER BY v) AS cd, ROW_NUMBER() OVER (ORDER BY id DESC) AS rn, RANK() OVER (ORDER BY `odd name`, v DESC) AS rr
        FROM numbers WHERE id > 2""")
    lines = made._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:  # partial totals, or one row a bucket
            below = next(x for x in lines[i + 1:] if "Aggregate" in x or "Scan" in x or "Exchange" in x)
            assert "partial_" in below or "=[__gw_bucket" in below, lines[i:i + 4]


@pytest.mark.parametrize("text", [
    """WITH a AS (SELECT v, SUM(w) AS s FROM numbers GROUP BY v), b AS (SELECT *, RANK() OVER (ORDER BY s DESC) AS k FROM a)
       SELECT x.v, x.k, y.k AS k2 FROM b x JOIN b y ON x.v = y.v WHERE x.k < 4 ORDER BY x.k LIMIT 3""",
    "SELECT v, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC, v) AS r FROM numbers GROUP BY v HAVING COUNT(*) > 1",
    "SELECT RANK() OVER (ORDER BY s) AS r FROM (SELECT SUM(w) OVER (ORDER BY v) AS s FROM numbers)",
    "SELECT id, RANK() OVER (ORDER BY id) AS r FROM numbers WHERE id < 0",
    "SELECT id, CUME_DIST() OVER (ORDER BY id) AS c, PERCENT_RANK() OVER (ORDER BY id) AS p FROM numbers WHERE id = 5",
    "SELECT id FROM numbers UNION ALL SELECT ROW_NUMBER() OVER (ORDER BY id) FROM numbers",
])
def test_windows_anywhere_in_a_statement(spark, view, text):
    same(spark, text)


def test_other_windows_stay_and_can_be_refused(spark, view):
    text = "SELECT id, LAG(w) OVER (ORDER BY id) AS l, RANK() OVER (ORDER BY v) AS r FROM numbers"
    same(spark, text, left=1)
    assert run_sql(spark, text, single_task_rows=300)[1] is None
    assert "more than 299 rows" in run_sql(spark, text, single_task_rows=299)[1]
    assert run_sql(spark, "SELECT id, RANK() OVER (ORDER BY v) AS r FROM numbers", single_task_rows=0)[1] is None


def test_rows_and_count_come_from_one_run(spark, view):
    """An accumulator counts how often rows are made."""
    made = spark.sparkContext.accumulator(0)

    def touch(rows):
        for r in rows:
            made.add(1)
            yield r
    df = spark.createDataFrame(spark.table("numbers").select("id").rdd.mapPartitions(touch), "id long").orderBy("id")
    at_start = made.value
    kept, n = counted(df)
    once = made.value - at_start
    assert n == 300 and [r.id for r in kept.limit(3).collect()] == [0, 1, 2] and kept.count() == 300
    assert made.value - at_start == once and once in (300, 600)  # a range sort reads its input twice, to sample it
