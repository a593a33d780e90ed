"""Column expressions shared by the analyses.

Every helper here has a DuckDB text twin in ``basketry.plans.oracle`` so the
oracle computes the very same arithmetic:

* money is summed as DECIMAL (exact, independent of partition order);
* ratios are taken between DOUBLEs (``ratio``) and give NULL on a zero
  denominator, as SQLite does;
* a double is rounded through DECIMAL(28,8) (``rnd``), which Spark, DuckDB and
  SQLite agree on, unlike plain ``round`` of a double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x: ColumnOrName) -> Column:
    return _c(x).cast("double")


def big(x: ColumnOrName) -> Column:
    return _c(x).cast("bigint")


def rnd(x: ColumnOrName, k: int) -> Column:
    """ROUND(x, k) of a double, half away from zero on its decimal value;
    the result is a DOUBLE."""
    return F.round(_c(x).cast("decimal(28,8)"), k).cast("double")


def rnd_dec(x: ColumnOrName, k: int) -> Column:
    """ROUND of an exact DECIMAL (a money sum), returned as DOUBLE."""
    return F.round(_c(x), k).cast("double")


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den in double arithmetic; NULL when den is 0 or NULL."""
    return F.try_divide(dbl(num), dbl(den))


def pct(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den * 100 (the reference's ``x * 100.0 / y`` and ``x / y * 100``)."""
    return ratio(num, den) * F.lit(100.0)


def month_key(d: ColumnOrName) -> Column:
    """STRFTIME('%Y-%m', d)."""
    return F.date_format(_c(d), "yyyy-MM")


def year_text(d: ColumnOrName) -> Column:
    """STRFTIME('%Y', d)."""
    return F.date_format(_c(d), "yyyy")


def month_text(d: ColumnOrName) -> Column:
    """STRFTIME('%m', d)."""
    return F.date_format(_c(d), "MM")


def month_diff(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Whole calendar months: 12 * (year diff) + (month diff), ignoring days."""
    a, b = _c(later), _c(earlier)
    return (F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))


def days_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """CAST(JULIANDAY(later) - JULIANDAY(earlier) AS INT) for dates."""
    return F.datediff(_c(later), _c(earlier))


# Month names, fixed values of the reference's CASE on the month number.
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]


def month_name(d: ColumnOrName) -> Column:
    """Locale-free English month name from a literal array."""
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.element_at(names, F.month(_c(d)))


def bucketize(x: ColumnOrName, rules: Sequence[tuple[str, object, str]],
              otherwise: str) -> Column:
    """Searched CASE over thresholds: rules are (op, bound, label), first
    match wins, e.g. [('==', 0, 'none'), ('<=', 0.05, 'low')].  Bounds are
    compared as given (pass Decimal for DECIMAL columns)."""
    col = _c(x)
    ops = {
        "==": lambda c, b: c == b, "<": lambda c, b: c < b, "<=": lambda c, b: c <= b,
        ">": lambda c, b: c > b, ">=": lambda c, b: c >= b,
    }
    expr = None
    for op, bound, label in rules:
        cond = ops[op](col, F.lit(bound))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(otherwise) if expr is None else expr.otherwise(F.lit(otherwise))


def count_if(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) as BIGINT (0 on no match)."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
