"""``... OVER (ORDER BY ...)`` typed as SQL, without one task for all rows.

Spark moves every row of a window without PARTITION BY into one task.
``spread_windows`` looks for such windows in an analysed statement and
computes their columns by the library's own operators instead:

* RANK, ROW_NUMBER, NTILE(k) and SUM over ROWS UNBOUNDED PRECEDING by
  ``global_windows``;
* DENSE_RANK, PERCENT_RANK, CUME_DIST, and SUM, COUNT and AVG over the
  default frame (which takes in all peers) from one row for each distinct
  value of the order columns: these are numbered and summed globally, then
  joined back;
* an aggregate over the whole table (``OVER ()``) as a scalar subquery.

Everything else in the statement stays as Spark analysed it.  A window with
another function or frame (LAG, FIRST_VALUE, bounded frames ...) stays, too;
``single_task_windows`` tells which.  Where ROW_NUMBER or NTILE leave ties
open, a hash of the row decides.  The input of a window is checkpointed, so
the statement runs up to its last such window at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.global_window import GlobalSpec, OrderKey, global_windows

_RUNNING = "unboundedpreceding$(), currentrow$()"
_ROWS, _PEERS = f"specifiedwindowframe(RowFrame, {_RUNNING})", f"specifiedwindowframe(RangeFrame, {_RUNNING})"
_ALL = ("specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())",
        "specifiedwindowframe(RangeFrame, unboundedpreceding$(), unboundedfollowing$())")
_DIRECTIONS = {("Ascending", "NullsFirst"): True, ("Descending", "NullsLast"): False}


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan) -> Iterator:
    yield plan
    for child in _listed(plan.children()):
        yield from _nodes(child)


def _is_single(node) -> bool:
    return node.nodeName() == "Window" and node.partitionSpec().isEmpty()


def _kind(expression) -> str:
    return expression.getClass().getSimpleName()


class _Call:
    """One column of a window: what is asked for, over which columns."""

    def __init__(self, alias, places: dict[int, int]):
        self.alias = alias
        function = alias.child().windowFunction()
        self.frame = alias.child().windowSpec().frameSpecification().toString()
        self.name, self.argument, self.k = _kind(function), None, None
        self.known = True
        if self.name == "AggregateExpression":
            whole = function.aggregateFunction()
            self.name = whole.prettyName()
            self.known = not function.isDistinct() and function.filter().isEmpty() and whole.children().size() == 1
            if self.known:
                self._over(whole.children().apply(0), places)
        elif self.name == "NTile":
            self.known = _kind(function.buckets()) == "Literal"
            self.k = function.buckets().value() if self.known else None

    def _over(self, child, places: dict[int, int]) -> None:
        if _kind(child) == "AttributeReference" and child.exprId().id() in places:
            self.argument = f"c{places[child.exprId().id()]}"
        else:  # COUNT(*) counts a literal
            self.known = _kind(child) == "Literal" and self.name == "count" and child.value() is not None

    def values(self) -> Column:
        return F.col(self.argument) if self.argument else F.lit(1)

    def way(self, ordered: bool) -> str | None:
        """How the column is computed; None if it is left to Spark."""
        if not self.known:
            return None
        if not ordered:
            return "total" if self.frame in _ALL and self.name in ("sum", "count", "avg", "min", "max") else None
        if self.frame == _ROWS:
            return {"Rank": "global", "RowNumber": "global", "NTile": "global", "sum": "global",
                    "DenseRank": "peers", "PercentRank": "peers"}.get(self.name)
        if self.name == "CumeDist" or self.frame == _PEERS and self.name in ("sum", "count", "avg"):
            return "peers"
        return None


def _global(rows: DataFrame, order: tuple[OrderKey, ...], calls: dict[str, _Call]) -> DataFrame:
    specs = []
    for name, call in calls.items():
        asked = {"Rank": {"rank": name}, "RowNumber": {"row_number": name}, "NTile": {"ntile": (name, call.k)},
                 "sum": {"running_sum": (name, call.argument)}}[call.name]
        free = next((i for i, s in enumerate(specs) if not set(s) & set(asked)), None)
        if free is None:  # one pass gives a column of each sort
            specs.append(dict(asked))
        else:
            specs[free] |= asked
    return global_windows(rows, [GlobalSpec(order, **s) for s in specs], materialize=False)


def _peers(rows: DataFrame, order: tuple[OrderKey, ...], calls: dict[str, _Call]) -> DataFrame:
    columns = [o.column for o in order]
    sums = {"n": F.count(F.lit(1))}
    for name, call in calls.items():
        if call.name in ("sum", "avg"):
            sums[f"{name}_s"] = F.sum(call.values())
        if call.name in ("count", "avg"):
            sums[f"{name}_n"] = F.count(call.values())
    distinct = rows.groupBy(*columns).agg(*[v.alias(k) for k, v in sums.items()]).checkpoint()
    specs = [GlobalSpec(order, row_number="dense" if k == "n" else None, running_sum=(f"{k}_run", k)) for k in sums]
    run = global_windows(distinct, specs, materialize=False).withColumn("all", distinct.select(F.sum("n")).scalar())
    first = F.col("n_run") - F.col("n")
    made = []
    for name, call in calls.items():
        made.append({
            "DenseRank": F.col("dense"), "CumeDist": F.col("n_run") / F.col("all"),
            "PercentRank": F.coalesce(F.try_divide(first, F.col("all") - 1), F.lit(0.0)),
            "sum": F.col(f"{name}_s_run") if call.name == "sum" else None, "count": F.col(f"{name}_n_run") if call.name == "count" else None,
            # in the type of a plain sum, so that a decimal quotient keeps its places
            "avg": F.try_divide(F.col(f"{name}_s_run").cast(distinct.schema[f"{name}_s"].dataType), F.nullif(F.col(f"{name}_n_run"), F.lit(0))) if call.name == "avg" else None,
        }[call.name].alias(name))
    run = run.select(*[F.col(c).alias(f"{c}_of") for c in columns], *made)
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(run[f"{c}_of"]) for c in columns])
    return rows.join(run, same).drop(*[f"{c}_of" for c in columns])


def _totals(rows: DataFrame, calls: dict[str, _Call]) -> DataFrame:
    aggregate = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}
    return rows.withColumns({name: rows.select(aggregate[c.name](c.values())).scalar() for name, c in calls.items()})


def _spread(spark: SparkSession, window):
    """The plan that stands for a window node; None to leave it."""
    output = _listed(window.child().output())
    places = {a.exprId().id(): i for i, a in enumerate(output)}
    order = []
    for o in _listed(window.orderSpec()):
        ascending = _DIRECTIONS.get((o.direction().toString(), o.nullOrdering().toString()))
        if ascending is None or _kind(o.child()) != "AttributeReference":
            return None
        order.append(OrderKey(f"c{places[o.child().exprId().id()]}", ascending))
    calls = {f"w{i}": _Call(alias, places) for i, alias in enumerate(_listed(window.windowExpressions()))}
    ways = {name: call.way(bool(order)) for name, call in calls.items()}
    if None in ways.values():
        return None
    rows = _frame(spark, window.child()).toDF(*[f"c{i}" for i in range(len(output))]).checkpoint()
    made = rows
    for way in dict.fromkeys(ways.values()):
        mine = {name: call for name, call in calls.items() if ways[name] == way}
        made = _totals(made, mine) if way == "total" else (_global if way == "global" else _peers)(made, tuple(order), mine)
    made = made.select(*rows.columns, *[F.col(name).cast(call.alias.dataType().sql()) for name, call in calls.items()])
    # the columns keep the identity by which the rest of the statement names them
    plan = made._jdf.queryExecution().analyzed()
    expressions, none = spark._jvm.org.apache.spark.sql.catalyst.expressions, spark._jvm.scala.Option.empty()
    meant = [*output, *_listed(window.windowExpressions())]
    same = [expressions.Alias(a, m.name(), m.exprId(), m.qualifier(), none, _seq(spark, [])) for a, m in zip(_listed(plan.output()), meant)]
    return spark._jvm.org.apache.spark.sql.catalyst.plans.logical.Project(_seq(spark, same), plan)


def _seq(spark: SparkSession, items: list):
    out = spark._jvm.java.util.ArrayList()
    for x in items:
        out.add(x)
    return spark._jvm.scala.jdk.javaapi.CollectionConverters.asScala(out).toSeq()


def _rewritten(spark: SparkSession, plan, left: list[DataFrame]):
    children = _listed(plan.children())
    new = [_rewritten(spark, c, left) for c in children]
    if any(a is not b for a, b in zip(children, new)):
        plan = plan.withNewChildren(_seq(spark, new))
    if _is_single(plan):
        made = _spread(spark, plan)
        if made is None:
            left.append(_frame(spark, plan.child()))
        return made or plan
    return plan


def _frame(spark: SparkSession, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _inlined(spark: SparkSession, df: DataFrame):
    """The analysed plan, with common table expressions where they are used."""
    plan = df._jdf.queryExecution().analyzed()
    if any(node.nodeName() == "WithCTE" for node in _nodes(plan)):
        plan = spark._jvm.org.apache.spark.sql.catalyst.optimizer.InlineCTE(True, False).apply(plan)
    return plan


def spread_windows(df: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``df`` with its windows without PARTITION BY computed in many tasks,
    and the inputs of those that are left in one task."""
    spark, left = df.sparkSession, []
    plan = _inlined(spark, df)
    if not any(_is_single(node) for node in _nodes(plan)):
        return df, left
    new = _rewritten(spark, plan, left)
    return (df if new is plan else _frame(spark, new)), left
