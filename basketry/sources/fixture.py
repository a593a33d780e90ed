"""Shop tables derived from the driver's TPC-H-style parquet tables.

The driver tables carry no payment, cost or four-valued status, so this
module defines them deterministically (FIXTURES.md §3).  The same mapping is
written as SQL in ``basketry.plans.oracle.PRELUDE``; keep the two in step.

Everything is lazy: a ``Shop`` only builds plans.  Parquet scans get column
pruning and filter pushdown from Catalyst, so an analysis that reads three
lineitem columns scans three columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources import order_grain

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

# Fixed values of the mapping (FIXTURES.md §3).
PAYMENT_BY_PRIORITY = [
    ("1-URGENT", "UPI"),
    ("2-HIGH", "Card"),
    ("3-MEDIUM", "NetBanking"),
    ("4-NOT SPECIFIED", "COD"),
    ("5-LOW", "Wallet"),
]
DELIVERED_ORDERSTATUS = ["F", "O"]
# Pending orders spread over the other statuses by o_orderkey % 28.
PENDING_STATUS_CUTS = [(15, "Shipped"), (23, "Cancelled")]
PENDING_STATUS_REST = "Returned"
# cost rate = 0.45 + (p_partkey % 21) * 0.01, i.e. 0.45 .. 0.65
COST_RATE_BASE = 45
COST_RATE_SPAN = 21


def _dec(value, spec: str) -> Column:
    return F.lit(value).cast(spec)


def cost_rate(partkey: Column) -> Column:
    return (F.lit(COST_RATE_BASE) + partkey % COST_RATE_SPAN).cast("decimal(6,2)") * _dec("0.01", "decimal(3,2)")


def margin_rate(partkey: Column) -> Column:
    """1 - cost rate, exact: (55 - p % 21) * 0.01."""
    return (F.lit(100 - COST_RATE_BASE) - partkey % COST_RATE_SPAN).cast("decimal(6,2)") * _dec("0.01", "decimal(3,2)")


def _choose(cases: list[tuple[Column, str]], rest: Column) -> Column:
    """The label of the first condition that holds, as nested IFs: of these
    Catalyst makes a test on the raw column when a label is compared with a
    literal, and where conditions are null-safe equalities that test reaches
    the Parquet scan (of CASE with several branches it does not)."""
    for condition, label in reversed(cases):
        rest = F.call_function("if", condition, F.lit(label), rest)
    return rest


def _one_of(column: Column, values: list[str]) -> Column:
    """column IN values, and never NULL."""
    return reduce(lambda a, b: a | b, [column.eqNullSafe(v) for v in values])


def status_of(orderstatus: Column, orderkey: Column) -> Column:
    pending = [(orderkey % 28 < bound, label) for bound, label in PENDING_STATUS_CUTS]
    return _choose([(_one_of(orderstatus, DELIVERED_ORDERSTATUS), "Delivered"), *pending], F.lit(PENDING_STATUS_REST))


def status_is(status: str, orderstatus: Column, orderkey: Column) -> Column:
    """``status_of(...) == status`` written on the raw columns, so the
    delivered test reaches the Parquet scan as In(o_orderstatus, [F, O])."""
    delivered = orderstatus.isNotNull() & orderstatus.isin(*DELIVERED_ORDERSTATUS)  # never NULL
    if status == "Delivered":
        return delivered
    bucket = orderkey % 28
    lo = 0
    for bound, label in PENDING_STATUS_CUTS:
        if label == status:
            return ~delivered & (bucket >= lo) & (bucket < bound)
        lo = bound
    if status == PENDING_STATUS_REST:
        return ~delivered & (bucket >= lo)
    return F.lit(False)


def payment_of(priority: Column) -> Column:
    return _choose([(priority.eqNullSafe(given), payment) for given, payment in PAYMENT_BY_PRIORITY], F.lit(None).cast("string"))


@dataclass
class Shop:
    """The four shop tables over one driver scale-factor directory."""

    spark: SparkSession
    sf_dir: str
    #: Folder of kept order totals (``sources.order_grain``), if any.
    order_grain: str | None = None
    _cache: dict = field(default_factory=dict, repr=False)

    # An order's city is its customer's region here, so analyses by city
    # can aggregate per customer first and look the city up afterwards.
    city_key = "customer_id"

    def city_lookup(self) -> DataFrame | None:
        return self.customer_region()

    def raw(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    @property
    def lines_path(self) -> str:
        return f"{self.sf_dir}/lineitem.parquet"

    def kept_order_totals(self) -> DataFrame | None:
        """Order totals that were kept and are still those of the line items."""
        return self._memo(("order_totals",), lambda: order_grain.kept(self, self.order_grain) if self.order_grain else None)

    # -- dimensions -------------------------------------------------------
    def _memo(self, key, build):
        """Mapped tables are lazy plans; build (and analyse) each once."""
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    @property
    def customers(self) -> DataFrame:
        return self._memo(("customers",), self._customers)

    def _customers(self) -> DataFrame:
        c, n = self.raw("customer"), self.raw("nation")
        return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
                .select(F.col("c_custkey").alias("customer_id"),
                        F.col("c_name").alias("name"),
                        F.col("n_name").alias("city"),
                        F.col("c_mktsegment").alias("segment")))

    @property
    def products(self) -> DataFrame:
        return self._memo(("products",), self._products)

    def _products(self) -> DataFrame:
        p = self.raw("part")
        price = F.col("p_retailprice").cast("decimal(12,2)")
        return p.select(F.col("p_partkey").alias("product_id"),
                        F.col("p_name").alias("product_name"),
                        F.col("p_type").alias("category"),
                        price.alias("price"),
                        F.round(price * cost_rate(F.col("p_partkey")), 2).alias("cost"))

    def customer_region(self) -> DataFrame:
        return self._memo(("customer_region",), self._customer_region)

    def _customer_region(self) -> DataFrame:
        """customer_id -> region name, the ``city`` of an order.

        Grouped by the key, so Spark knows it is unique: a LEFT JOIN to it
        whose ``city`` is not used is removed from the plan (ad-hoc SQL over
        ``orders`` then scans orders only).  With the declared primary key
        (checked by ``audit_unique``) this equals the plain join."""
        c, n, r = self.raw("customer"), self.raw("nation"), self.raw("region")
        return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
                .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
                .groupBy(F.col("c_custkey").alias("customer_id")).agg(F.min("r_name").alias("city")))

    # -- facts ------------------------------------------------------------
    @property
    def orders(self) -> DataFrame:
        """orders without ``city``; see ``orders_with_city``."""
        return self._memo(("orders",), self._orders)

    def _orders(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(F.col("o_orderkey").alias("order_id"),
                        F.col("o_custkey").alias("customer_id"),
                        F.col("o_orderdate").cast("date").alias("order_date"),
                        status_of(F.col("o_orderstatus"), F.col("o_orderkey")).alias("status"),
                        payment_of(F.col("o_orderpriority")).alias("payment"))

    def orders_with_city(self) -> DataFrame:
        return self.orders.join(self.customer_region(), "customer_id", "left")

    def orders_where(self, status: str | None = None, not_status: str | None = None) -> DataFrame:
        """Orders with the given status (and/or without another), the test
        written on the raw columns so Parquet gets it as a pushed filter."""
        return self._memo(("orders_where", status, not_status), lambda: self._orders_where(status, not_status))

    def _orders_where(self, status: str | None, not_status: str | None) -> DataFrame:
        o = self.raw("orders")
        k, st = F.col("o_orderkey"), F.col("o_orderstatus")
        if status is not None:
            o = o.where(status_is(status, st, k))
        if not_status is not None:
            o = o.where(~status_is(not_status, st, k))
        return o.select(F.col("o_orderkey").alias("order_id"),
                        F.col("o_custkey").alias("customer_id"),
                        F.col("o_orderdate").cast("date").alias("order_date"),
                        status_of(st, k).alias("status"),
                        payment_of(F.col("o_orderpriority")).alias("payment"))

    @property
    def order_items(self) -> DataFrame:
        return self._memo(("order_items",), self._order_items)

    def _order_items(self) -> DataFrame:
        li = self.raw("lineitem")
        ext = F.col("l_extendedprice").cast("decimal(12,2)")
        disc = F.col("l_discount").cast("decimal(4,2)")
        keep = _dec(1, "decimal(4,2)") - disc
        net = ext * keep
        return li.select(F.col("l_orderkey").alias("order_id"),
                         F.col("l_partkey").alias("product_id"),
                         F.col("l_linenumber").alias("line_no"),
                         F.col("l_quantity").cast("int").alias("quantity"),
                         F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).cast("decimal(18,8)").alias("unit_price"),
                         disc.alias("discount"),
                         F.round(net, 2).alias("revenue"),
                         # (1 - discount) x margin is exact at 4 dp; keeping it
                         # DECIMAL(5,4) keeps the product within 18 digits
                         F.round(ext * (keep * margin_rate(F.col("l_partkey"))).cast("decimal(5,4)"), 2)
                         .alias("profit"))

    def register_views(self) -> None:
        """Temp views under the reference's table names, for ad-hoc SQL."""
        self.customers.createOrReplaceTempView("customers")
        self.products.createOrReplaceTempView("products")
        self.orders_with_city().createOrReplaceTempView("orders")
        self.order_items.createOrReplaceTempView("order_items")


class TableShop(Shop):
    """A shop over four given DataFrames in the reference layout (generated
    data, hand-made test rows, or tables read back with ``sources.io``).
    Orders carry their own ``city``."""

    city_key = "city"

    def __init__(self, spark: SparkSession, customers: DataFrame, products: DataFrame,
                 orders: DataFrame, order_items: DataFrame):
        super().__init__(spark, "")
        self._tables = {"customers": customers, "products": products, "orders": orders,
                        "order_items": order_items}

    def raw(self, name: str) -> DataFrame:
        raise KeyError(f"no driver table {name!r} behind a TableShop")

    def city_lookup(self) -> DataFrame | None:
        return None

    @property
    def customers(self) -> DataFrame:
        return self._tables["customers"]

    @property
    def products(self) -> DataFrame:
        return self._tables["products"]

    @property
    def orders(self) -> DataFrame:
        return self._tables["orders"]

    def orders_with_city(self) -> DataFrame:
        return self._tables["orders"]

    def orders_where(self, status: str | None = None, not_status: str | None = None) -> DataFrame:
        o = self._tables["orders"]
        if status is not None:
            o = o.where(F.col("status") == F.lit(status))
        if not_status is not None:
            o = o.where(F.col("status") != F.lit(not_status))
        return o

    @property
    def order_items(self) -> DataFrame:
        return self._tables["order_items"]

    def register_views(self) -> None:
        for name, df in self._tables.items():
            df.createOrReplaceTempView(name)


def load(spark: SparkSession, sf_dir: str, order_grain: str | None = None) -> Shop:
    """The shop over ``sf_dir`` as its files are now.  A shop remembers its
    plans, so take a new one for each query that shall see new files.  With
    ``order_grain``, order totals kept there are used while they are fresh."""
    return Shop(spark, sf_dir.rstrip("/"), order_grain)
