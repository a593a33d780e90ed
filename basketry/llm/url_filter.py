"""URL allow and block lists in a trie over reversed host labels and path
segments, broadcast to the executors; the longest matching entry decides.

A rule is (host, path, verdict).  It fits its host and every subdomain when
the URL's path starts with the rule's path (a plain prefix: `/en/1` fits
`/en/12213`).  Of several fitting rules the longest wins: the one with most
host labels, then the longest path; block beats allow between equals.

Rules are broadcast in blocks of at most ``BLOCK_RULES``, so the size of a
broadcast is bounded; a larger list makes more passes over the URL column,
each keeping the best rule so far.

Defined results: a null URL or one without `://` has an empty host and path
and fits no rule; a URL that fits none gets the default verdict; repeated
rules count once.  Ports and user names are part of the host, as written.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in one broadcast (about 200 bytes each in the trie).
BLOCK_RULES = 200_000

#: Rules of the query's contract: fixed values.
CONTRACT_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dicts.  A host node has children by label (from the right)
    and, under the key "", the root of its path trie; a path node has
    children by whole segment and, under None, its rules: the beginnings of
    a next segment, longest first."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in sorted(set(rules)):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("", {})
            *whole, beginning = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            entry = (beginning, f"{host}{path}", verdict, host.count(".") + 1, len(path))
            kept = [e for e in node.get(None, []) if e[0] != beginning]
            if len(kept) == len(node.get(None, [])) or verdict == "block":
                node[None] = sorted([*kept, entry], key=lambda e: (-len(e[0]), e[0]))

    def find(self, host: str, path: str):
        """(rule, verdict, host labels, path length) of the longest rule that
        fits, or None.  Deeper host nodes come first, so the first hit of
        the deepest node with any wins."""
        nodes = []
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(label) if label else None
            if node is None:
                break
            if "" in node:
                nodes.append(node[""])
        segments = path.split("/")
        for node in reversed(nodes):
            best = None
            for segment in segments:
                for beginning, rule, verdict, labels, length in node.get(None, ()):
                    if segment.startswith(beginning):
                        best = (rule, verdict, labels, length)
                        break
                node = node.get(segment)
                if node is None:
                    break
            if best:
                return best
        return None


_FOUND = "struct<rule:string,verdict:string,labels:int,length:int>"


def _matcher(trie):
    @F.arrow_udf(_FOUND)
    def match(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        find = trie.value.find
        found = [find(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
        return pa.array(
            [f and dict(zip(("rule", "verdict", "labels", "length"), f)) for f in found],
            pa.struct([("rule", pa.string()), ("verdict", pa.string()), ("labels", pa.int32()), ("length", pa.int32())]),
        )
    return match


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url",
               default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of these names in
    the input are replaced)."""
    spark = pages.sparkSession
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumn("__found", F.lit(None).cast(_FOUND))
    rules = sorted(set(rules))
    for i in range(0, len(rules), block_rules):
        trie = spark.sparkContext.broadcast(Trie(rules[i:i + block_rules]))
        out = out.withColumn("__next", _matcher(trie)(F.col("host"), F.col("path")))
        longer = F.struct("__next.labels", "__next.length", F.col("__next.verdict") == "block") > F.struct(
            "__found.labels", "__found.length", F.col("__found.verdict") == "block")
        pick = F.when(F.col("__found").isNull() | (F.col("__next").isNotNull() & longer), F.col("__next")).otherwise(F.col("__found"))
        out = out.withColumn("__found", pick).drop("__next")
    return out.withColumns({
        "rule": F.col("__found.rule"),
        "verdict": F.coalesce(F.col("__found.verdict"), F.lit(default)),
    }).drop("__found")
