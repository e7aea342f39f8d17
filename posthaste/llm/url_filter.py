"""Allow and block rules for URLs, found in a trie over reversed host labels and path segments.

A rule is a host and the beginning of a path, written ``host/path``. It fits
the host and all its subdomains where the URL's path starts with the rule's,
character by character. Of several fitting rules the longest text wins; of
equally long ones that with more host labels, then a block.

The trie is sent to every task. Rules are configuration: more than
``MAX_RULES`` are refused rather than broadcast.

Nulls and ties: a null URL, or one without ``://``, has an empty host and an
empty path, which no rule fits. Repeated rules count once; a rule that is both
allowed and blocked blocks. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# About 1.2 KB each, so a worker holds at most some 300 MB.
MAX_RULES = 250_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Keys of a trie node that cannot be host labels or path segments.
_PATHS, _STARTS, _SIZES = ("paths",), ("starts",), ("sizes",)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return (F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit("")))


def build_trie(rules: Iterable[tuple[str, str]]) -> dict:
    """``(verdict, "host/path")`` rules as nested dictionaries.

    Host labels lead from the last to the first. At the end of a host, the
    whole segments of the path lead on; the last segment, which may be cut
    anywhere, is among the node's beginnings, found by their lengths.
    """
    root: dict = {}
    lower = str.maketrans(_UPPER, _LOWER)
    for verdict, rule in rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a rule: {verdict} {rule}")
        host, _, path = rule.partition("/")
        node = root
        for label in reversed(host.translate(lower).split(".")):
            node = node.setdefault(label, {})
        rank = (len(rule), host.count("."), verdict == "block")
        node = node.setdefault(_PATHS, {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        starts = node.setdefault(_STARTS, {})
        node.setdefault(_SIZES, set()).add(len(last))
        starts[last] = max(starts.get(last, ((),)), (rank, rule, verdict))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The winning rule and its verdict."""
    best: tuple = ((), None, None)
    if not path.startswith("/"):
        return None, None
    segments = path[1:].split("/")
    node: dict | None = trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        place = node.get(_PATHS)
        for segment in segments:
            if place is None:
                break
            # One look-up for each length that a beginning here has.
            starts = place.get(_STARTS, {})
            for size in place.get(_SIZES, ()):
                if size <= len(segment) and segment[:size] in starts:
                    best = max(best, starts[segment[:size]])
            place = place.get(segment)
    return best[1], best[2]


def _match(batches: Iterator[pa.RecordBatch], trie, default: str) -> Iterator[pa.RecordBatch]:
    rules = trie.value
    for batch in batches:
        table = pa.Table.from_batches([batch])
        found = [longest_match(rules, h, p)
                 for h, p in zip(table.column("host").to_pylist(), table.column("path").to_pylist())]
        columns = [table.column("page_id"), table.column("host"), table.column("path"),
                   pa.array([rule for rule, _ in found], pa.string()),
                   pa.array([verdict or default for _, verdict in found], pa.string())]
        yield from pa.table(columns, ["page_id", "host", "path", "rule", "verdict"]).to_batches()


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """``pages(page_id, url)`` -> ``(page_id, host, path, rule, verdict)``; no rule gives ``default``."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(build_trie(rules))
    host, path = split_url(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return parts.mapInArrow(partial(_match, trie=trie, default=default),
                            "page_id long, host string, path string, rule string, verdict string")
