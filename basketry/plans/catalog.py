"""The query catalogue: named analyses with their category, difficulty and
tags (the reference's query library), plus the generic operator keys.

``QUERIES`` maps a key to a builder ``(shop) -> DataFrame``; ``by_category``
and ``lookup`` serve the list/lookup use of the reference's library.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from basketry.sources.fixture import Shop


@dataclass(frozen=True)
class Entry:
    key: str
    category: str
    title: str
    difficulty: str
    build: Callable[[Shop], DataFrame]
    tags: tuple[str, ...] = field(default_factory=tuple)


ENTRIES: list[Entry] = []


def register(key: str, category: str, title: str, difficulty: str, tags: tuple[str, ...] = ()):
    def deco(fn: Callable[[Shop], DataFrame]):
        ENTRIES.append(Entry(key, category, title, difficulty, fn, tuple(tags)))
        return fn
    return deco


def lookup(key: str) -> Entry:
    for e in ENTRIES:
        if e.key == key:
            return e
    raise KeyError(key)


def by_category() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for e in ENTRIES:
        out.setdefault(e.category, []).append(e.key)
    return out


def as_dataframe(spark: SparkSession) -> DataFrame:
    """The catalogue itself as a DataFrame (category, key, title, difficulty, tags)."""
    schema = T.StructType([
        T.StructField("category", T.StringType()), T.StructField("key", T.StringType()),
        T.StructField("title", T.StringType()), T.StructField("difficulty", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ])
    return spark.createDataFrame([(e.category, e.key, e.title, e.difficulty, list(e.tags)) for e in ENTRIES],
                                 schema)
