"""Hand-made shop rows for the reference's edge cases (FIXTURES.md §5)."""
import datetime as dt
from decimal import Decimal as D

import pytest

from basketry.plans import advanced, customer, product, revenue
from basketry.sources.fixture import TableShop
from basketry.sources.schemas import customers_schema, order_items_schema, orders_schema, products_schema

AS_OF = dt.date(2025, 1, 1)


@pytest.fixture(scope="module")
def tiny(spark):
    d = dt.date
    customers = spark.createDataFrame([
        ("C0001", "A", "Bengaluru", d(2022, 1, 1), "Premium", "18-25"),
        ("C0002", "B", "Mumbai", d(2022, 1, 1), "Regular", "26-35"),
        ("C0003", "C", "Delhi", d(2022, 1, 2), "Occasional", "36-45"),
        ("C0004", "D", "Pune", d(2022, 1, 2), "Regular", "46+"),
    ], customers_schema())
    products = spark.createDataFrame([
        ("P001", "Laptop", "Electronics", D("100.00"), D("50.00")),
        ("P002", "Jeans", "Fashion", D("10.00"), D("6.00")),
    ], products_schema())
    orders = spark.createDataFrame([
        ("O1", "C0001", d(2023, 1, 5), "Cancelled", "UPI", "Bengaluru"),   # first order cancelled
        ("O2", "C0001", d(2023, 2, 10), "Delivered", "UPI", "Bengaluru"),
        ("O3", "C0001", d(2023, 4, 10), "Delivered", "Card", "Mumbai"),    # March has no order
        ("O4", "C0002", d(2023, 1, 7), "Delivered", "COD", "Mumbai"),      # two orders on the first day
        ("O5", "C0002", d(2023, 1, 7), "Delivered", "COD", "Mumbai"),
        ("O6", "C0003", d(2023, 2, 1), "Shipped", "Wallet", "Delhi"),      # never delivered
        ("O7", "C0004", d(2023, 3, 3), "Delivered", "UPI", "Pune"),        # delivered, no items
    ], orders_schema())
    items = spark.createDataFrame([
        ("I1", "O1", "P001", 1, D("100.00"), D("0.00"), D("100.00"), D("50.00")),
        ("I2", "O2", "P001", 2, D("100.00"), D("0.10"), D("180.00"), D("90.00")),
        ("I3", "O2", "P002", 1, D("10.00"), D("0.00"), D("10.00"), D("4.00")),
        ("I4", "O3", "P002", 3, D("10.00"), D("0.05"), D("28.50"), D("11.40")),
        ("I5", "O4", "P001", 1, D("100.00"), D("0.00"), D("100.00"), D("50.00")),
        ("I6", "O5", "P002", 1, D("10.00"), D("0.20"), D("0.00"), D("0.00")),  # revenue 0
        ("I7", "O6", "P001", 1, D("100.00"), D("0.00"), D("100.00"), D("50.00")),
    ], order_items_schema())
    return TableShop(spark, customers, products, orders, items)


def test_first_order_cancelled_is_never_new(tiny):
    rows = {(r.customer_type, r.month): r for r in customer.new_vs_returning(tiny).collect()}
    assert ("Returning Customer", "2023-02") in rows and ("New Customer", "2023-02") not in rows
    new_jan = rows[("New Customer", "2023-01")]
    assert (new_jan.orders, new_jan.customers) == (2, 1)   # both first-day orders are New


def test_single_day_lifespan_gives_null_monthly_clv(tiny):
    rows = {r.customer_id: r for r in customer.clv_ranking(tiny, 20).collect()}
    assert rows["C0002"].customer_lifespan_days == 0 and rows["C0002"].monthly_clv is None
    assert rows["C0001"].customer_lifespan_days == 59
    assert "C0003" not in rows and "C0004" not in rows   # inner joins drop them
    assert rows["C0001"].revenue_rank == 1 and rows["C0001"].avg_order_value == pytest.approx(72.83)


def test_order_without_items_kept_only_by_script_churn(tiny):
    basic = {r.customer_id for r in customer.churn_basic(tiny, AS_OF).collect()}
    full = {r.customer_id for r in customer.churn(tiny, AS_OF, 25).collect()}
    assert "C0004" in basic and "C0004" not in full
    assert {r.churn_status for r in customer.churn(tiny, AS_OF, 25).collect()} == {"Churned"}


def test_lag_skips_absent_month(tiny):
    rows = {r.month: r for r in revenue.monthly_trend(tiny).collect()}
    assert sorted(rows) == ["2023-01", "2023-02", "2023-04"]
    assert rows["2023-04"].prev_month_revenue == 290.0
    assert rows["2023-02"].mom_growth_pct == 190.0
    assert rows["2023-04"].rolling_3m_avg == pytest.approx(round((100 + 290 + 28.5) / 3, 2))


def test_discount_impact_skips_zero_revenue(tiny):
    rows = {r.discount_bucket: r for r in product.discount_impact(tiny).collect()}
    assert "16-20% — Heavy" not in rows
    assert rows["6-10% — Moderate"].line_items == 1


def test_two_roots_on_first_day(tiny):
    paths = {r.order_number: r for r in advanced.journey_paths(tiny, 5).collect()}
    seq = {r.order_number: r for r in advanced.journey_sequence(tiny, 5).collect()}
    # C0001: O2 -> O3 ; C0002: two roots on one day, nothing after
    assert paths[1].customers == 2 and paths[1].total_revenue == 290.0
    assert paths[2].customers == 1 and paths[2].total_revenue == 28.5
    assert seq[2].customers == 2   # C0002's second order counts in the sequence reading


def test_city_payment_pivot_on_order_city(tiny):
    rows = {r.city: r for r in revenue.city_payment_pivot(tiny).collect()}
    assert rows["Mumbai"].card_revenue == 29.0  # 28.50 rounds half up and rows["Mumbai"].cod_revenue == 100.0
    assert rows["Bengaluru"].upi_revenue == 190.0 and rows["Bengaluru"].total_revenue == 190.0


def test_true_aov_option(tiny):
    rows = {r.customer_id: r for r in customer.clv_ranking(tiny, 20, true_aov=True).collect()}
    assert rows["C0001"].avg_order_value == pytest.approx(72.83)   # per line (3 lines)
    assert rows["C0001"].true_aov == pytest.approx(109.25)         # per order (2 orders)
    assert "true_aov" not in customer.clv_ranking(tiny, 20).columns


def test_seasonality_share_within_year(tiny):
    from basketry.plans import operations
    rows = operations.monthly_seasonality(tiny, share_within_year=True).collect()
    assert abs(sum(r.pct_of_annual_orders for r in rows) - 100.0) < 0.05


def test_rfm_high_is_good_flips_scores(tiny):
    lit = {r.customer_id: r for r in customer.rfm_customers(tiny, AS_OF).collect()}
    conv = {r.customer_id: r for r in customer.rfm_customers(tiny, AS_OF, high_is_good=True).collect()}
    assert set(lit) == set(conv) == {"C0001", "C0002"}
    for c in lit:
        assert (conv[c].r_score, conv[c].f_score, conv[c].m_score) == \
            (6 - lit[c].r_score, 6 - lit[c].f_score, 6 - lit[c].m_score)
    # literal rule: NTILE 1 goes to the most recent customer (C0001, last order 2023-04-10)
    assert lit["C0001"].r_score == 1 and lit["C0002"].r_score == 2


def test_journey_paths_equal_brute_force(spark):
    """Random tiny shop: every date-increasing chain from the first
    delivered day (orders with items only), enumerated in Python."""
    import random
    from collections import defaultdict
    rng = random.Random(9)
    d0 = dt.date(2023, 1, 1)
    orders, items = [], []
    for c in range(6):
        for o in range(rng.randint(1, 7)):
            oid = f"O{c}-{o}"
            day = d0 + dt.timedelta(days=rng.randint(0, 5))
            status = rng.choice(["Delivered", "Delivered", "Delivered", "Shipped"])
            orders.append((oid, f"C{c}", day, status, "UPI", "Pune"))
            for i in range(rng.choice([0, 1, 1, 2])):
                v = D(rng.randint(1, 500)) / 4
                items.append((f"I{oid}-{i}", oid, "P001", 1, v, D("0.00"), v, v))
    spark_orders = spark.createDataFrame(orders, orders_schema())
    spark_items = spark.createDataFrame(items, order_items_schema())
    empty_c = spark.createDataFrame([], customers_schema())
    empty_p = spark.createDataFrame([], products_schema())
    shop = TableShop(spark, empty_c, empty_p, spark_orders, spark_items)
    got = {r.order_number: (r.customers, r.total_revenue, r.avg_order_value)
           for r in advanced.journey_paths(shop, 5).collect()}

    value = defaultdict(lambda: D(0))
    for _, oid, *_rest, rev, _p in items:
        value[oid] += rev
    by_cust = defaultdict(list)
    for oid, c, day, status, *_ in orders:
        if status == "Delivered":
            by_cust[c].append((day, oid))
    level = defaultdict(list)  # depth -> [(customer, value)]
    for c, rows in by_cust.items():
        first = min(day for day, _ in rows)
        valued = [(day, oid) for day, oid in rows if oid in value]

        def walk(day, depth):
            for d2, o2 in valued:
                if d2 > day and depth < 5:
                    level[depth + 1].append((c, value[o2]))
                    walk(d2, depth + 1)
        for day, oid in valued:
            if day == first:
                level[1].append((c, value[oid]))
                walk(day, 1)
    exp = {k: (len({c for c, _ in v}), float(round(sum(x for _, x in v), 2)),
               float(round(sum(x for _, x in v) / len(v), 2))) for k, v in level.items()}
    assert len(exp) >= 3 and got == exp
