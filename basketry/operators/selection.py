"""NTILE over a whole table by exact selection of its tile borders.

NTILE(k) needs only k - 1 rows: the last one of each tile but the last.  With
those known, a row's tile is 1 plus the number of borders before it, a
comparison with k - 1 literals, so no row is shuffled or sorted for it.

A border is the row of a known rank in the order.  It is found by random
sampling and exact counting: a sample of the rows among which it must lie is
sorted, the two sample rows a little before and a little behind its expected
place are the pivots, and one aggregate counts the rows up to each pivot.
These counts, not the sample, decide in which part the border lies, so the
result is exact; the next round looks at that part alone, a few hundredths
of the rows before.  Once a part has at most ``sample`` rows, they all are
its sample and the border is read off.

Costs for n rows: about log(n / sample) / log(sqrt(sample) / 8) rounds of two
scans of the frozen input for each ordering (none of them for n <= sample:
one scan finds all borders).  What is sorted in one task is at most about
``sample`` rows a border; what comes to the driver is two rows a border.

The order columns and the keys together must tell any two rows apart (as
NTILE is not defined otherwise); nulls come first in ascending and last in
descending order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators.global_window import OrderKey, asc

#: Rows of a part that are sorted to find a border.
SAMPLE = 20_000
_HASHES = 1 << 30


@dataclass(frozen=True)
class Tiles:
    """NTILE(k) over ``order``, ties in order of ``keys``, as column ``name``."""

    name: str
    k: int
    order: tuple[OrderKey, ...]
    keys: tuple[str, ...]

    @property
    def full(self) -> list[OrderKey]:
        return [*self.order, *map(asc, self.keys)]


@dataclass
class _Part:
    """Rows after ``low`` up to ``high`` (None: no end): ``inside`` of them,
    ``below`` before; the border is number ``rank`` of all rows."""

    rank: int
    inside: int
    below: int = 0
    low: tuple | None = None
    high: tuple | None = None

    def holds(self, spec: Tiles, kinds: list[T.DataType]) -> Column:
        inside = F.lit(True)
        if self.low is not None:
            inside = ~up_to(spec.full, self.low, kinds)
        if self.high is not None:
            inside = inside & up_to(spec.full, self.high, kinds)
        return inside


def up_to(order: Sequence[OrderKey], values: Sequence, kinds: Sequence[T.DataType]) -> Column:
    """Whether a row comes no later than ``values`` in the order."""
    out = F.lit(True)
    for key, value, kind in reversed(list(zip(order, values, kinds))):
        c, v = F.col(key.column), F.lit(value).cast(kind)
        if value is None:
            before = F.lit(False) if key.ascending else c.isNotNull()
        else:
            before = c.isNull() | (c < v) if key.ascending else F.coalesce(c > v, F.lit(False))
        out = before | (c.eqNullSafe(v) & out)
    return out


def _comparable(df: DataFrame, spec: Tiles) -> tuple[DataFrame, Tiles]:
    """Times become whole microseconds, whose literals depend on no zone."""
    times = {o.column for o in spec.full if isinstance(df.schema[o.column].dataType, (T.TimestampType, T.TimestampNTZType))}
    df = df.withColumns({f"__micros_{c}": F.unix_micros(F.col(c).cast("timestamp")) for c in times})
    named = {c: f"__micros_{c}" for c in times}
    order = tuple(OrderKey(named.get(o.column, o.column), o.ascending) for o in spec.order)
    return df, Tiles(spec.name, spec.k, order, tuple(named.get(c, c) for c in spec.keys))


def _round(df: DataFrame, spec: Tiles, parts: list[_Part], kinds: list[T.DataType], turn: int, sample: int) -> dict[int, tuple]:
    """By part: its border, or its two pivots (either may be missing)."""
    columns = [o.column for o in spec.full]
    hashed = F.pmod(F.xxhash64(F.lit(turn), *columns), F.lit(_HASHES))
    ways: dict[tuple, list[int]] = {}  # parts that are still the same share one sample
    for i, p in enumerate(parts):
        ways.setdefault((p.below, p.inside), []).append(i)
    taken = []
    for way, (_, inside) in enumerate(ways):
        p = parts[ways[_, inside][0]]
        chosen = p.holds(spec, kinds)
        if inside > sample:
            chosen = chosen & (hashed < int(_HASHES * sample / inside))
        taken.append(F.when(chosen, F.lit(way)))
    order = [F.col(o.column).asc_nulls_first() if o.ascending else F.col(o.column).desc_nulls_last() for o in spec.full]
    rows = df.select(*columns, F.explode(F.array_compact(F.array(*taken))).alias("way"))
    place = F.row_number().over(Window.partitionBy("way").orderBy(*order))
    rows = rows.withColumns({"place": place, "m": F.count(F.lit(1)).over(Window.partitionBy("way"))})
    wanted = []
    for way, members in enumerate(ways.values()):
        for i in members:
            p = parts[i]
            if p.inside <= sample:
                at = (F.lit(p.rank - p.below), None)
            else:
                centre = F.lit((p.rank - p.below) / p.inside) * F.col("m")
                slack = F.sqrt("m") * 2
                at = (F.floor(centre - slack), F.ceil(centre + slack))
            for side, place in enumerate(at):
                if place is not None:
                    wanted.append(F.when((F.col("way") == way) & (F.col("place") == place), F.struct(F.lit(i).alias("part"), F.lit(side).alias("side"))))
    rows = rows.withColumn("hit", F.explode(F.array_compact(F.array(*wanted))))
    found: dict[int, list] = {}
    for r in rows.select("hit.part", "hit.side", *[F.col(c).alias(f"c{j}") for j, c in enumerate(columns)]).collect():  # two rows a part
        found.setdefault(r[0], [None, None])[r[1]] = tuple(r)[2:]
    return {i: tuple(x) for i, x in found.items()}


def _count(df: DataFrame, spec: Tiles, pivots: list[tuple], kinds: list[T.DataType]) -> list[int]:
    """Rows up to each pivot, in one aggregate."""
    counts = [F.count(F.when(up_to(spec.full, p, kinds), 1)) for p in pivots]
    return list(df.agg(*counts).first()) if counts else []


def borders(df: DataFrame, spec: Tiles, n: int, sample: int = SAMPLE) -> list[tuple]:
    """The last row of each tile that another one follows, as a tuple of the
    order columns and keys.  ``df`` is read several times and has n rows."""
    kinds = [df.schema[o.column].dataType for o in spec.full]
    size, more = divmod(n, spec.k)
    ranks = [t * size + min(t, more) for t in range(1, spec.k)]
    parts = [_Part(rank, n) for rank in ranks if 0 < rank < n]
    done: dict[int, tuple] = {}
    turn = 0
    while len(done) < len(parts):
        open_ = [i for i in range(len(parts)) if i not in done]
        found = _round(df, spec, [parts[i] for i in open_], kinds, turn, sample)
        turn += 1
        pivots, whose = [], []
        for j, i in enumerate(open_):
            low, high = found.get(j, (None, None))
            if parts[i].inside <= sample:
                done[i] = low
                continue
            for side, pivot in enumerate((low, high)):
                if pivot is not None:
                    pivots.append(pivot)
                    whose.append((i, side))
        for (i, _), pivot, rows in zip(whose, pivots, _count(df, spec, pivots, kinds)):
            p = parts[i]
            end = p.below + p.inside
            if p.rank <= rows < end:
                p.high, p.inside = pivot, rows - p.below
            elif p.below < rows < p.rank:
                p.low, p.below, p.inside = pivot, rows, end - rows
    return [done[i] for i in sorted(done)]


def exact_ntiles(df: DataFrame, specs: Sequence[Tiles], sample: int = SAMPLE, materialize: bool = True) -> DataFrame:
    """``df`` with the tile of each spec (bigint).  The input is frozen by one
    checkpoint (unless it is one already: ``materialize=False``)."""
    if materialize:
        df = df.checkpoint(eager=True)
    n = df.count()
    for spec in specs:
        wide, plain = _comparable(df, spec)
        kinds = [wide.schema[o.column].dataType for o in plain.full]
        behind = [F.when(up_to(plain.full, b, kinds), 0).otherwise(1) for b in borders(wide, plain, n, sample)]
        tile = reduce(lambda x, y: x + y, behind, F.lit(1)).cast("bigint")
        df = wide.withColumn(spec.name, tile).select(*[c for c in df.columns if c != spec.name], spec.name)
    return df
