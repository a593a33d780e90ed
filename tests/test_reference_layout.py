"""Every named analysis on generated data in the reference layout
(C0001-style ids, 500 customers, 8,000 orders over 2023-2024), with the
reference's own parameters: as-of 2025-01-01 and showcase customers."""
import datetime as dt

import pytest

from basketry.plans import advanced, customer, operations, product, revenue
from basketry.sources.fixture import TableShop
from basketry.sources.generator import generate

AS_OF = dt.date(2025, 1, 1)
SHOWCASE = ["C0001", "C0002", "C0003", "C0010", "C0020"]


@pytest.fixture(scope="module")
def gen_shop(spark):
    g = generate(spark, 500, 8000, seed=42)
    return TableShop(spark, g.customers.cache(), g.products.cache(), g.orders.cache(), g.order_items.cache())


def test_revenue_family(gen_shop):
    cats = revenue.revenue_by_category(gen_shop).collect()
    assert {r.category for r in cats} == {"Electronics", "Fashion", "Home", "Beauty", "Grocery"}
    assert cats[0].category == "Electronics"  # high-ticket items lead, as the reference notes
    assert len(revenue.monthly_trend(gen_shop).collect()) == 24
    assert len(revenue.top_products(gen_shop, 10).collect()) == 10
    pivot = revenue.city_payment_pivot(gen_shop).collect()
    assert len(pivot) == 6 and pivot[0].city == "Bengaluru"


def test_customer_family(gen_shop):
    clv = customer.clv_ranking(gen_shop, 20).collect()
    assert [r.revenue_rank for r in clv] == sorted(r.revenue_rank for r in clv) and clv[0].revenue_rank == 1
    segs = customer.rfm(gen_shop, AS_OF).collect()
    assert sum(r.customers for r in segs) == len(customer.rfm_customers(gen_shop, AS_OF).collect())
    assert len(customer.churn(gen_shop, AS_OF, 25).collect()) == 25
    assert {r.customer_type for r in customer.new_vs_returning(gen_shop).collect()} == \
        {"New Customer", "Returning Customer"}


def test_product_and_operations(gen_shop):
    par = product.product_pareto(gen_shop, 20).collect()
    assert len(par) == 20 and par[-1].cumulative_revenue_pct <= 100.0
    cs = product.cross_sell(gen_shop).collect()
    assert len(cs) == 10  # 5 categories -> 10 unordered pairs
    assert len(product.discount_impact(gen_shop).collect()) == 5
    fun = operations.order_funnel(gen_shop, 20).collect()
    assert len(fun) == 20 and all(r.delivered + r.in_transit + r.cancelled + r.returned == r.total_orders
                                  for r in fun)
    assert len(operations.monthly_seasonality(gen_shop).collect()) == 24
    assert len(operations.cohort_retention(gen_shop).collect()) == 42


def test_advanced(gen_shop):
    show = advanced.window_showcase(gen_shop, SHOWCASE).collect()
    assert {r.customer_id for r in show} <= set(SHOWCASE) and len(show) > 0
    seq = advanced.journey_sequence(gen_shop, 5).collect()
    paths = advanced.journey_paths(gen_shop, 5).collect()
    assert [r.order_number for r in seq] == [1, 2, 3, 4, 5]
    assert seq[0].customers == paths[0].customers
