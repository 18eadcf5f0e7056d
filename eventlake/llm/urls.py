"""URL filters: a trie over reversed host labels and path segments, broadcast to the tasks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import need_columns, unused

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_HOST, _PATH = re.compile("[/?#]"), re.compile("[?#]")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = _HOST.search(rest)
    end = cut.start() if cut else len(rest)
    return rest[:end].translate(_LOWER), _PATH.split(rest[end:], maxsplit=1)[0]


class Node:
    __slots__ = ("labels", "paths", "rules")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}  # further host labels, from the right
        self.paths: dict[str, Node] = {}  # whole path segments
        self.rules: list[tuple[str, str, str]] = []  # (start of the next segment, rule, verdict)


class Trie:
    """Rules (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.

    The longest rule wins: the one with most host labels, among those the one
    with the longest path. Of two rules for one host and path, block wins. An
    empty rule host fits every host, an empty path every path.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = Node()
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"no such verdict: {verdict}")
            node, host = self.root, host.translate(_LOWER).strip(".")
            for label in reversed(host.split(".") if host else []):
                node = node.labels.setdefault(label, Node())
            *whole, start = path.split("/")
            for segment in whole:
                node = node.paths.setdefault(segment, Node())
            node.rules.append((start, host + path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        on_host = [self.root]
        for label in reversed(host.split(".") if host else []):
            node = on_host[-1].labels.get(label)
            if node is None:
                break
            on_host.append(node)
        segments = path.split("/")
        for node in reversed(on_host):
            best, at = None, node
            for segment in segments:
                fitting = [r for r in at.rules if segment.startswith(r[0])]
                if fitting:
                    best = max(fitting, key=lambda r: (len(r[0]), r[2] == "block"))
                at = at.paths.get(segment)
                if at is None:
                    break
            if best:
                return best[1], best[2]
        return None


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", default: str = "allow", most_rules: int = 1_000_000) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict (the rule's, else default).

    The rules are parameters, at most most_rules of them, and go to each task
    once as a trie. A null url, or one without ``://``, has an empty host and
    path and meets only rules without a host. Columns with the new names are
    replaced, all others stay. Rows stand alone; an empty table stays empty.
    """
    need_columns(pages, url_col)
    rules = list(rules)
    if len(rules) > most_rules:
        raise ValueError(f"{len(rules)} rules; at most {most_rules} are broadcast")
    trie = pages.sparkSession.sparkContext.broadcast(rules)
    made: dict[str, Trie] = {}

    @F.pandas_udf("struct<host: string, path: string, rule: string, verdict: string>")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = made.setdefault("trie", Trie(trie.value))
        for urls in parts:
            rows = []
            for u in urls:
                host, path = host_and_path(u)
                hit = t.find(host, path)
                rows.append((host, path, *(hit or (None, default))))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    new = ("host", "path", "rule", "verdict")
    (name,) = unused(pages, "_judged")
    kept = [c for c in pages.columns if c not in new]
    found = pages.select(*(pages[c] for c in kept), judged(F.col(url_col).cast("string")).alias(name))
    return found.select(*kept, *(F.col(name)[c].alias(c) for c in new))
