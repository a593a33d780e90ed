import pytest

from basketry.plans import registry  # noqa: F401
from basketry.plans.adhoc import prepare, run_sql
from basketry.plans.catalog import ENTRIES, as_dataframe, by_category, lookup


def test_run_sql_accepts_reads_and_reports_errors(spark, shop):
    prepare(shop)
    df, err = run_sql(spark, "SELECT strftime('%Y-%m', order_date) AS m, COUNT(*) AS n FROM orders GROUP BY 1")
    assert err is None and df.count() > 0
    assert run_sql(spark, "DELETE FROM orders")[0] is None
    assert run_sql(spark, "  ")[1] == "empty statement"
    df, err = run_sql(spark, "SELECT no_such_column FROM orders")
    assert df is None and "no_such_column" in err


@pytest.mark.parametrize("text", [
    "WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{d}' USING parquet SELECT * FROM a",
    "FROM (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{d}' USING parquet SELECT x",
    "INSERT INTO orders SELECT * FROM orders", "CREATE TABLE t AS SELECT 1 AS x", "DROP TABLE orders", "SET x = 1",
    "CACHE TABLE orders", "FROM orders INSERT INTO t SELECT *",
])
def test_run_sql_refuses_writes(spark, shop, tmp_path, text):
    prepare(shop)
    df, err = run_sql(spark, text.format(d=tmp_path / "out"))
    assert df is None and err and not (tmp_path / "out").exists()


def test_run_sql_accepts_looks(spark, shop):
    prepare(shop)
    for text in ("SHOW TABLES", "DESCRIBE orders", "EXPLAIN SELECT * FROM orders", "VALUES (1)", "FROM orders SELECT status",
                 "-- c\nWITH a AS (SELECT 1 AS x) SELECT * FROM a"):
        assert run_sql(spark, text)[1] is None, text


def test_eager_runs_the_whole_statement(spark):
    df, err = run_sql(spark, "SELECT CAST(IF(id = 900, 'x', '1') AS INT) AS v FROM range(1000)", eager=True)
    assert df is None and "CAST_INVALID_INPUT" in err


def test_strftime_codes(spark, shop):
    prepare(shop)
    df, err = run_sql(spark, "SELECT strftime('day %d/%m of %Y, %H:%M:%S %j %w 100%%', TIMESTAMP '2024-03-03 04:05:06') AS s, "
                             "julianday(TIMESTAMP '2000-01-01 12:00:00') AS j")
    assert err is None and tuple(df.first()) == ("day 03/03 of 2024, 04:05:06 063 0 100%", 2451545.0)
    df, err = run_sql(spark, "SELECT strftime('%%Y-%Y %%%d%%', DATE '2024-03-03') AS s, strftime('', DATE '2024-03-03') AS e")
    assert err is None and tuple(df.first()) == ("%Y-2024 %03%", "")
    df, err = run_sql(spark, "SELECT strftime('%Q', order_date) FROM orders", eager=True)
    assert df is None and "unknown code" in err


def test_the_callers_views_stay(spark, shop):
    spark.sql("SELECT 7 AS mine").createOrReplaceTempView("orders")
    lookup("op_adhoc_sql").build(shop).count()
    assert spark.table("orders").columns == ["mine"]
    spark.catalog.dropTempView("orders")


def test_julianday_matches_datediff(spark, shop):
    prepare(shop)
    df, err = run_sql(spark, "SELECT CAST(julianday(DATE '2025-01-01') - julianday(DATE '2024-12-01') AS INT) AS d")
    assert err is None and df.first().d == 31


def test_catalogue(spark):
    cats = by_category()
    assert len(cats["Revenue & Sales"]) == 4 and len(cats["Customer Analytics"]) == 5
    assert lookup("rfm").difficulty == "hard"
    assert as_dataframe(spark).count() == len(ENTRIES)


def test_eager_surfaces_runtime_errors(spark, shop):
    prepare(shop)
    df, err = run_sql(spark, "SELECT 1 / 0 AS x", eager=True)
    assert df is None and "DIVIDE_BY_ZERO" in err
    df, err = run_sql(spark, "SELECT 1 / 0 AS x")   # lazy: analysis passes, the action would fail
    assert err is None


def test_cli_list(capsys):
    from basketry.__main__ import main
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert "revenue_by_category" in out and f"{len(ENTRIES)} queries" in out
