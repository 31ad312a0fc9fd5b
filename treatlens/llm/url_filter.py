"""URL filter: a trie over reversed host labels and path segments.

A rule is a host and a path. It fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's path. Of all rules that
fit, the longest ``host + path`` decides; then the longer host; then block.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from treatlens.llm.tables import rows_of

ALLOW, BLOCK = "allow", "block"
#: Most rules one filter takes: the trie travels to every executor.
MAX_RULES = 200_000
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without ``://``. Only A-Z are lower-cased."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


@dataclass
class _Segments:
    """Paths of one host: edges are whole segments, ``tails`` what a last segment may start with."""

    edges: dict[str, _Segments] = field(default_factory=dict)
    tails: dict[str, Rule] = field(default_factory=dict)


@dataclass
class _Labels:
    edges: dict[str, _Labels] = field(default_factory=dict)
    paths: _Segments = field(default_factory=_Segments)


class UrlTrie:
    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root = _Labels()
        for rule in rules:
            self._add(Rule(rule.verdict, rule.host.translate(_LOWER), rule.path))

    def _add(self, rule: Rule) -> None:
        node = self.root
        for label in rule.host.split(".")[::-1] if rule.host else []:
            node = node.edges.setdefault(label, _Labels())
        place = node.paths
        *whole, tail = rule.path.split("/")
        for segment in whole:
            place = place.edges.setdefault(segment, _Segments())
        held = place.tails.get(tail)
        if held is None or rule.verdict == BLOCK:
            place.tails[tail] = rule

    @staticmethod
    def _fits(place: _Segments, segments: list[str]) -> Iterator[Rule]:
        for segment in segments:
            for tail, rule in place.tails.items():
                if segment.startswith(tail):
                    yield rule
            deeper = place.edges.get(segment)
            if deeper is None:
                return
            place = deeper

    def match(self, host: str, path: str) -> Rule | None:
        segments = path.split("/")
        node: _Labels | None = self.root
        found = list(self._fits(node.paths, segments))
        for label in host.split(".")[::-1]:
            node = node.edges.get(label)
            if node is None:
                break
            found += self._fits(node.paths, segments)
        return max(found, key=lambda r: (len(r.text), len(r.host)), default=None)


def filter_urls(pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", default: str = ALLOW) -> DataFrame:
    """Host, path, deciding rule and verdict of every row.

    Null or unparsable URLs have an empty host and path; only a rule without
    host fits them. A URL without a rule gets ``default`` and a null rule.
    Repeated rows are judged one by one; other columns are not read.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie takes {MAX_RULES}")
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            parts = [split_url(u) for u in rows_of(batch, "url")]
            hits = [match(h, p) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([r and r.text for r in hits], pa.string()),
                    pa.array([r.verdict if r else default for r in hits], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, "url").mapInArrow(
        judge, f"{id_col} {kind}, host string, path string, rule string, verdict string"
    )
