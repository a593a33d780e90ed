"""Ad-hoc SQL over the shop tables (the reference's "try your own SQL").

``run_sql`` hands the text to ``spark.sql`` over temp views named as in the
reference (customers, products, orders, order_items) and returns
``(DataFrame, None)`` or ``(None, message)``: failure is data, as in the
reference.  Only read statements are accepted: the text is parsed first and
refused if a command or write stands anywhere in its plan; writing tables is
``basketry.sources.io``'s job.  Spark is lazy, so analysis errors surface at
once but runtime errors (e.g. ANSI overflow) only on an action; pass
``eager=True`` to run the whole statement (into Spark's ``noop`` sink) inside
the guard.

``prepare`` creates the views in the shop's session; give it a shop over
``spark.newSession()`` to leave the caller's views alone.  Two SQLite date
functions the reference's queries use are registered as SQL functions
(JVM-side expressions, no Python): ``strftime(fmt, t)`` for the codes %Y %m
%d %H %M %S %j %w %% (any other code is an error) and ``julianday(t)``.  Note LIKE is case-sensitive in Spark
(SQLite's is not for ASCII): use ILIKE for the SQLite behaviour.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketry.operators.sql_windows import spread_windows
from basketry.sources.fixture import Shop

_CODES = {"%Y": "date_format(t, 'yyyy')", "%m": "date_format(t, 'MM')", "%d": "date_format(t, 'dd')",
          "%H": "date_format(t, 'HH')", "%M": "date_format(t, 'mm')", "%S": "date_format(t, 'ss')",
          "%j": "date_format(t, 'DDD')", "%w": "CAST(dayofweek(t) - 1 AS STRING)"}


def _strftime() -> str:
    """Codes are replaced between the ``%%``, which become ``%`` at last."""
    out = "part"
    for code, value in _CODES.items():
        out = f"replace({out}, '{code}', {value})"
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION strftime(fmt STRING, t TIMESTAMP) RETURNS STRING
       RETURN CASE WHEN instr(regexp_replace(fmt, '%[YmdHMSjw%]', ''), '%') > 0
                   THEN raise_error(concat('strftime: unknown code in ', fmt)) ELSE array_join(transform(split(fmt, '%%'), part -> {out}), '%') END"""


SQL_FUNCTIONS = [
    _strftime(),
    """CREATE OR REPLACE TEMPORARY FUNCTION julianday(t TIMESTAMP) RETURNS DOUBLE
       RETURN unix_micros(t) / 86400000000.0D + 2440587.5D""",
]

#: Commands that only look.
_LOOKS = ("Show", "Describe", "Explain")


def _nodes(plan):
    yield plan
    for inner in (plan.children(), plan.innerChildren()):
        for i in range(inner.size()):
            yield from _nodes(inner.apply(i))


def _writes(spark: SparkSession, text: str) -> bool:
    """Whether the parsed statement holds a command or a write."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if plan.getClass().getSimpleName().startswith(_LOOKS):
        return False
    kinds = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}")
             for name in ("Command", "ParsedStatement", "InsertIntoDir")]
    return any(kind.isInstance(node) for node in _nodes(plan) for kind in kinds)


def register_sql_functions(spark: SparkSession) -> None:
    for stmt in SQL_FUNCTIONS:
        spark.sql(stmt)


def prepare(shop: Shop) -> None:
    shop.register_views()
    register_sql_functions(shop.spark)


def run_sql(spark: SparkSession, text: str, eager: bool = False, single_task_rows: int | None = None) -> tuple[DataFrame | None, str | None]:
    """The statement's rows, or why it is refused.  Windows without PARTITION
    BY are spread over many tasks where their function allows
    (``operators.sql_windows``); with ``single_task_rows``, a statement is
    refused if one of the others has more input rows than that."""
    if not text or not text.strip():
        return None, "empty statement"
    try:
        if _writes(spark, text):
            return None, "only read statements (SELECT / WITH ...) are accepted"
        df, left = spread_windows(spark.sql(text))
        if single_task_rows is not None and any(rows.limit(single_task_rows + 1).count() > single_task_rows for rows in left):
            return None, f"a window without PARTITION BY would take more than {single_task_rows} rows into one task"
        if eager:
            df.write.format("noop").mode("overwrite").save()
        return df, None
    except PySparkException as e:
        return None, str(e)
    except Exception as e:  # noqa: BLE001  (Py4J errors not mapped to PySparkException)
        return None, str(e)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows of ``df``, kept by a checkpoint, and their number: both from
    one run, which counts the rows as it writes them."""
    seen = Observation()
    kept = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    return kept, seen.get["n"]
