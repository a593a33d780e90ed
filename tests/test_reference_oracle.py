"""The analyses on generated data in the reference layout (string ids,
decimal money, discounts up to 20 % so every discount bucket occurs),
against the same oracle SQL bodies run by DuckDB on Arrow copies of the
generated tables."""
import datetime as dt
import decimal
import math
from collections import Counter

import duckdb
import pytest

from basketry.plans import registry  # noqa: F401
from basketry.plans.catalog import lookup
from basketry.plans.oracle import ORACLES, PRELUDE
from basketry.sources.fixture import TableShop
from basketry.sources.generator import generate

KEYS = ["revenue_by_category", "monthly_trend", "top_products", "city_payment_pivot", "clv_ranking",
        "rfm", "rfm_customers", "new_vs_returning", "churn", "product_pareto", "cross_sell",
        "discount_impact", "order_funnel", "monthly_seasonality", "cohort_retention",
        "journey_sequence", "journey_paths", "revenue_by_category_script", "monthly_trend_script",
        "city_payment_pivot3", "clv_rank_full", "rfm_script", "churn_basic",
        "op_agg_basic", "op_count_distinct", "op_pivot", "op_topk", "op_union_all", "op_lag_lead",
        "op_rolling_avg", "op_window_first_last", "op_join_left", "op_join_full", "op_semi", "op_anti",
        "op_union_distinct", "op_having", "op_global_rank", "op_global_ntile", "op_running_total",
        "op_share_of_total", "op_window_dist", "op_first_event", "op_argmin_rows", "op_bucketize"]


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return repr(float(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return str(v)


def multiset(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def gen(spark):
    g = generate(spark, 300, 3000, seed=11)
    shop = TableShop(spark, g.customers.cache(), g.products.cache(), g.orders.cache(), g.order_items.cache())
    con = duckdb.connect()
    for name, df in [("shop_customers", shop.customers), ("shop_products", shop.products),
                     ("shop_orders", shop.orders), ("shop_items", shop.order_items)]:
        arrow = df.toArrow()
        con.register(f"{name}_arrow", arrow)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    return shop, con


@pytest.mark.parametrize("key", KEYS)
def test_generated_data_matches_oracle(gen, key):
    shop, con = gen
    text = ORACLES[key]
    recursive = PRELUDE.replace("WITH ", "WITH RECURSIVE ", 1)
    assert PRELUDE in text or recursive in text
    # the shop tables already exist in DuckDB: swap the mapping for a no-op CTE
    text = text.replace(recursive, "WITH RECURSIVE _generated AS (SELECT 1)")
    text = text.replace(PRELUDE, "WITH _generated AS (SELECT 1)")
    sdf = lookup(key).build(shop)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(text)
    d_rows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(s_rows) == len(d_rows)
    assert multiset(sdf.columns, s_rows) == multiset(rel.columns, d_rows)
