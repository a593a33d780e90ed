"""Deterministic pseudo-random draws as column expressions.

A draw is a pure function of (seed, salt, row key): the first 32 bits of
``md5('seed:salt:key')``.  It does not depend on partitioning or task order,
so a generated table is the same on 1 or 1000 executors and after a retry,
and DuckDB computes the very same numbers (``md5`` exists there too).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000  # weights are resolved to 1/10000


def hash32(seed: int, salt: str, key: Column) -> Column:
    """Unsigned 32-bit draw in [0, 2^32) as BIGINT."""
    text = F.concat(F.lit(f"{seed}:{salt}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform_int(seed: int, salt: str, key: Column, lo: int, hi: int) -> Column:
    """Integer in [lo, hi] (both ends included)."""
    return (hash32(seed, salt, key) % F.lit(hi - lo + 1) + F.lit(lo)).cast("int")


def uniform_unit(seed: int, salt: str, key: Column) -> Column:
    """Double in [0, 1): the 32-bit draw / 2^32 (exact in double)."""
    return hash32(seed, salt, key).cast("double") / F.lit(4294967296.0)


def thresholds(weights: Sequence[float]) -> list[int]:
    """Cumulative integer thresholds out of SCALE for the given weights."""
    total = float(sum(weights))
    out, acc = [], 0.0
    for w in weights:
        acc += w
        out.append(int(round(acc / total * SCALE)))
    out[-1] = SCALE
    return out


def weighted_choice(seed: int, salt: str, key: Column, values: Sequence, weights: Sequence[float]) -> Column:
    """One of ``values`` with the given probabilities (numpy's
    ``choice(values, p=weights)`` in distribution, not bit for bit)."""
    u = hash32(seed, salt, key) % F.lit(SCALE)
    expr = None
    for v, t in zip(values, thresholds(weights)):
        cond = u < F.lit(t)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def weighted_choice_sql(seed: int, salt: str, key_sql: str, values: Sequence, weights: Sequence[float]) -> str:
    """DuckDB text of ``weighted_choice`` (for the oracle)."""
    u = f"((('0x' || substr(md5('{seed}:{salt}:' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT) % {SCALE})"
    parts = " ".join(f"WHEN {u} < {t} THEN {_sql_lit(v)}" for v, t in zip(values, thresholds(weights)))
    return f"CASE {parts} END"


def hash32_sql(seed: int, salt: str, key_sql: str) -> str:
    return f"(('0x' || substr(md5('{seed}:{salt}:' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT)"


def _sql_lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)
