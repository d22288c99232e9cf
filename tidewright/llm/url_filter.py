"""URL filter: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BROADCAST_ROWS

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; host with A-Z lower-cased. Null or no '://': both empty."""
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    rest = rest[2]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    end = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return host.translate(_LOWER), path[:end]


class Trie:
    """Rules like `example.com/en/`: the host and its subdomains, the path as a prefix.

    The rule of the most host labels wins, among those the longest path. A path's complete segments are edges; what
    stands behind its last slash may be the start of a url's segment and is kept at the node, longest first.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        self.n = 0
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule is to allow or block, not {verdict}")
            if self.n >= BROADCAST_ROWS:
                raise ValueError(f"more than {BROADCAST_ROWS} rules don't fit a broadcast; join them by host instead")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            *whole, last = (slash + path).split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            ends = node.setdefault("ends", [])
            # of the same rule given twice, a block wins
            if known := [e for e in ends if e[0] == last]:
                ends.remove(known[0])
                verdict = "block" if "block" in (verdict, known[0][1]) else verdict
            ends.append((last, verdict, rule))
            ends.sort(key=lambda e: -len(e[0]))
            self.n += 1

    @staticmethod
    def _in_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for i, segment in enumerate(segments):
            for start, verdict, rule in node.get("ends", ()):
                if segment.startswith(start):
                    found = verdict, rule
                    break
            if i + 1 == len(segments) or (node := node.get("segments", {}).get(segment)) is None:
                break
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits, or None."""
        found, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                found = self._in_path(node["paths"], segments) or found
        return found


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to each row; a url that no rule fits gets the default and a null rule.

    The trie's size is checked (BROADCAST_ROWS rules at most); it goes out once per executor. No shuffle; no row is
    dropped, repeated ones are judged each, urls of any length whole. Null urls and those without `://` have an empty
    host and path and so the default verdict. Of two rules of the same length one only fits; given twice, a block wins.
    Columns of pages named host, path, rule or verdict are replaced, others stay. An empty table gives no rows.
    """
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(Trie(rules))
    out = StructType().add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string")

    @F.pandas_udf(out)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for urls in batches:
            rows = []
            for url in urls:
                host, path = split_url(url)
                verdict, rule = match(host, path) or (default, None)
                rows.append((host, path, rule, verdict))
            yield pd.DataFrame(rows, columns=out.names, dtype=object)

    kept = [c for c in pages.columns if c.lower() not in out.names]
    judged = "judged_" + "_" * max((len(c) for c in pages.columns), default=0)  # longer than any other name
    return pages.select(*[F.col(f"`{c}`") for c in kept], judge(F.col(url_col)).alias(judged)).select(*[F.col(f"`{c}`") for c in kept], f"{judged}.*")
