"""Registers every named analysis and operator key with its fixture
parameters.  Import this module to fill ``catalog.ENTRIES``."""

from __future__ import annotations

from basketry.plans import advanced, audits, customer, operations, operator_keys, product, revenue
from basketry.plans.common import SHOWCASE_CUSTOMERS_SCRIPT
from basketry.plans.catalog import register

# Category names, titles, difficulties and tags of the library
# (S9) are what its lookup is keyed by and lists.
REV = "Revenue & Sales"
CUST = "Customer Analytics"
PROD = "Product Intelligence"
OPS = "Operational Metrics"
ADV = "Advanced SQL"
SCRIPT = "Script variants"
OPERATOR = "Operators"
AUDIT = "Audits"

register("revenue_by_category", REV, "Total Revenue by Category", "easy",
         ("GROUP BY", "SUM", "ORDER BY"))(lambda shop: revenue.revenue_by_category(shop))
register("monthly_trend", REV, "Monthly Revenue Trend with MoM Growth", "hard",
         ("CTE", "Window Function", "LAG", "MoM Growth"))(lambda shop: revenue.monthly_trend(shop))
register("top_products", REV, "Top 10 Products by Revenue", "easy",
         ("JOIN", "GROUP BY", "LIMIT"))(lambda shop: revenue.top_products(shop, 10))
register("city_payment_pivot", REV, "Revenue by City and Payment Method", "med",
         ("GROUP BY", "CASE", "PIVOT-style"))(lambda shop: revenue.city_payment_pivot(shop))

register("revenue_by_category_script", SCRIPT, "Total Revenue by Category with Profit Margins", "easy",
         ("GROUP BY", "SUM"))(lambda shop: revenue.revenue_by_category(shop, with_avg_price=False))
register("monthly_trend_script", SCRIPT, "Monthly Revenue with MoM Growth", "hard",
         ("CTE", "LAG"))(lambda shop: revenue.monthly_trend(shop, with_unique_customers=False))
register("city_payment_pivot3", SCRIPT, "Revenue Pivot by City x Payment Method", "med",
         ("CASE", "PIVOT-style"))(lambda shop: revenue.city_payment_pivot(shop, ["UPI", "Card", "COD"]))

register("clv_ranking", CUST, "Customer Lifetime Value (CLV) Ranking", "hard",
         ("Window Function", "RANK", "CTE", "CLV"))(lambda shop: customer.clv_ranking(shop, 20))
register("rfm", CUST, "RFM Segmentation with SQL", "hard",
         ("CTE", "CASE", "NTILE", "Window Function", "RFM"))(lambda shop: customer.rfm(shop))
register("rfm_customers", CUST, "RFM scores per customer", "hard",
         ("NTILE", "Window Function", "RFM"))(lambda shop: customer.rfm_customers(shop))
register("new_vs_returning", CUST, "New vs Returning Customer Revenue Split", "med",
         ("CTE", "CASE", "SUBQUERY", "Cohort"))(lambda shop: customer.new_vs_returning(shop))
register("churn", CUST, "Customer Churn Detection", "hard",
         ("CTE", "DATEDIFF", "Window Function", "Churn"))(lambda shop: customer.churn(shop))
register("clv_rank_full", SCRIPT, "Customer Lifetime Value with Window Ranking", "hard",
         ("RANK", "NTILE", "CTE"))(lambda shop: customer.clv_rank_full(shop, 20))
register("rfm_script", SCRIPT, "Full RFM Segmentation in Pure SQL", "hard",
         ("NTILE", "CASE", "CTE"))(lambda shop: customer.rfm(shop, full=False))
register("churn_basic", SCRIPT, "Customer Churn Detection (orders only)", "med",
         ("CTE", "CASE"))(lambda shop: customer.churn_basic(shop))

register("product_pareto", PROD, "Product Performance with Running Total", "hard",
         ("Window Function", "SUM OVER", "Running Total", "Market Share"))(lambda shop: product.product_pareto(shop, 20))
register("cross_sell", PROD, "Category Cross-Sell Analysis", "hard",
         ("Self JOIN", "Subquery", "Cross-sell"))(lambda shop: product.cross_sell(shop))
register("discount_impact", PROD, "Discount Impact on Profitability", "med",
         ("CASE", "GROUP BY", "Profitability"))(lambda shop: product.discount_impact(shop))
register("order_funnel", OPS, "Order Funnel & Cancellation Analysis", "med",
         ("CASE", "COUNT", "Funnel", "Conversion"))(lambda shop: operations.order_funnel(shop, 20))
register("monthly_seasonality", OPS, "Peak Sales Hours Analysis", "easy",
         ("STRFTIME", "GROUP BY", "Time Analysis"))(lambda shop: operations.monthly_seasonality(shop))
register("cohort_retention", OPS, "Cohort Retention Query", "hard",
         ("CTE", "Cohort", "Retention", "Window Function"))(lambda shop: operations.cohort_retention(shop))
register("window_showcase", ADV, "Window Functions Showcase", "hard",
         ("ROW_NUMBER", "RANK", "DENSE_RANK", "LEAD", "LAG", "NTILE"))(lambda shop: advanced.window_showcase(shop))
register("journey_sequence", ADV, "Customer Journey: n-th order", "hard",
         ("Window Function", "ROW_NUMBER"))(lambda shop: advanced.journey_sequence(shop, 5))
register("journey_paths", ADV, "Recursive CTE — Customer Journey", "hard",
         ("Recursive CTE", "Hierarchy", "WITH RECURSIVE"))(lambda shop: advanced.journey_paths(shop, 5))
register("journey_chains", ADV, "Customer Journey: best chain of each length", "hard",
         ("Recursive CTE", "Hierarchy"))(lambda shop: advanced.journey_chains(shop, 5))
register("journey_months", ADV, "Customer Journey: linked months", "hard",
         ("Recursive CTE", "LEAD"))(lambda shop: advanced.journey_months(shop, 6))
register("window_showcase3", SCRIPT, "All major window functions in one query", "hard",
         ("ROW_NUMBER", "RANK", "LAG", "LEAD"))(
    lambda shop: advanced.window_showcase(shop, SHOWCASE_CUSTOMERS_SCRIPT, advanced.SCRIPT_NAMES))

# Generic operator keys and audits (C1-C3).
OPERATOR_KEYS = [
    ("op_scan", ("SELECT",)), ("op_line_measures", ("arithmetic", "ROUND")), ("op_preview", ("LIMIT",)),
    ("op_bucketize", ("CASE",)), ("op_join_inner", ("JOIN",)),
    ("op_first_event", ("MIN", "JOIN")), ("op_argmin_rows", ("Subquery", "MIN")), ("op_pairs", ("Self JOIN",)),
    ("op_agg_basic", ("SUM", "COUNT", "AVG", "MIN", "MAX")), ("op_count_distinct", ("COUNT DISTINCT",)),
    ("op_distinct_rollup", ("COUNT DISTINCT", "ROLLUP-style")), ("op_order_grain", ("SUM", "reuse")),
    ("op_pivot", ("CASE", "PIVOT-style")), ("op_global_rank", ("RANK", "ROW_NUMBER")),
    ("op_global_ntile", ("NTILE", "RANK")), ("op_running_total", ("SUM OVER", "Running Total")),
    ("op_share_of_total", ("SUM OVER",)), ("op_lag_lead", ("LAG", "LEAD")), ("op_rolling_avg", ("AVG OVER",)),
    ("op_window_dist", ("PERCENT_RANK", "CUME_DIST")), ("op_window_first_last", ("FIRST_VALUE", "LAST_VALUE")),
    ("op_topk", ("ORDER BY", "LIMIT")), ("op_union_all", ("UNION ALL",)), ("op_scalar_dates", ("STRFTIME",)),
    ("op_scalar_numeric", ("ROUND", "CAST", "NULLIF")), ("op_join_left", ("LEFT JOIN",)),
    ("op_join_right", ("RIGHT JOIN",)), ("op_join_full", ("OUTER JOIN",)), ("op_semi", ("EXISTS",)), ("op_anti", ("NOT EXISTS",)),
    ("op_union_distinct", ("UNION",)), ("op_having", ("HAVING",)), ("op_predicates", ("LIKE", "COALESCE")),
    ("op_adhoc_sql", ("ad-hoc SQL",)), ("op_adhoc_window", ("ad-hoc SQL", "RANK", "NTILE", "SUM OVER")),
]
for _key, _tags in OPERATOR_KEYS:
    register(_key, OPERATOR, _key, "med", _tags)(getattr(operator_keys, _key))

register("audit_domain", AUDIT, "CHECK domains", "easy", ("CHECK",))(audits.audit_domain)
register("audit_unique", AUDIT, "Primary key uniqueness", "easy", ("PRIMARY KEY",))(audits.audit_unique)
register("audit_summaries", AUDIT, "Keys and references from kept summaries", "med",
         ("PRIMARY KEY", "REFERENCES", "reuse"))(audits.audit_summaries)
register("audit_fk", AUDIT, "Foreign key orphans", "easy", ("REFERENCES",))(audits.audit_fk)
