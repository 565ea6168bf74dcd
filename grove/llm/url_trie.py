"""URL filter: a trie over reversed host labels and path segments.

A rule ``host/path`` fits its host and all subdomains whose path starts with the
rule's path.  Host labels are walked from the right (org, example, ...); every host
node that ends a rule holds a path trie walked segment by segment, whose leaves hold
the characters that the next segment must begin with.  Among all rules that fit, the
longest (in characters; then the one with more host labels) wins, whether it allows
or blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import free_names, slices

#: Most rules that a broadcast trie may hold; more raise an error instead of growing the broadcast.
MAX_RULES = 1_000_000
#: A url without a host fits no rule; its verdict, and that of a url no rule fits.
NO_HOST, NO_RULE = "block", "allow"

_HOST = re.compile("[^/?#]*", re.S)
_PATH = re.compile("[^?#]*", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to / ? # or the end, A-Z
    lower-cased; path from there up to ? or #.  Both empty for null or without ``://``."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    end = _HOST.match(rest).end()
    return rest[:end].translate(_LOWER), _PATH.match(rest, end).group()


class UrlTrie:
    """Rules are (verdict, rule) with rule = host followed by a path that starts with /."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict must be allow or block: {verdict}")
            host, slash, path = rule.partition("/")
            host, path = host.translate(_LOWER), slash + path
            if not host:
                raise ValueError(f"rule without a host: {rule}")
            node = self.root
            labels = host.split(".")[::-1]
            for label in labels:
                node = node.setdefault(label, {})
            *whole, begin = path.split("/")
            node = node.setdefault(None, {})              # the host's path trie
            for segment in whole:
                node = node.setdefault(segment, {})
            entry = (len(host + path), len(labels), host + path, verdict)
            old = node.setdefault(None, {}).get(begin)
            # equal rules with two verdicts: block wins
            if old is None or verdict == "block":
                node[None][begin] = entry

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, or None."""
        best = None
        segments = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            under = node.get(None)
            for segment in segments if under is not None else ():
                for begin, entry in under.get(None, {}).items():
                    if segment.startswith(begin) and (best is None or entry > best):
                        best = entry
                under = under.get(segment)
                if under is None:
                    break
        return None if best is None else (best[2], best[3])


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url",
                keep: Sequence[str] | None = None, max_rules: int = MAX_RULES,
                no_rule: str = NO_RULE, no_host: str = NO_HOST) -> DataFrame:
    """``keep`` columns of ``pages`` (default: all) plus host, path, rule, verdict.

    One narrow pass without a shuffle.  Null urls and urls without ``://`` have an
    empty host and path, no rule, and the verdict ``no_host``; other urls that no
    rule fits have a null rule and the verdict ``no_rule``.  Repeated rows are judged
    one by one, an empty table gives an empty result, and a column that clashes with
    a result column is replaced by it.
    """
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} may be broadcast")
    result = ["host", "path", "rule", "verdict"]
    names = [c for c in (keep if keep is not None else pages.columns) if c not in result]
    (inner,) = free_names(names, "_url")
    frame = pages.select(*[F.col(c) for c in names], F.col(url).cast("string").alias(inner))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in frame.select(*names).schema.fields)
    shared = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch, urls in slices(batches, inner):
            rows = []
            for u in urls:
                host, path = split_url(None if u is None else u.decode())
                rule, verdict = trie.find(host, path) or (None, None) if host else (None, no_host)
                rows.append((host, path, rule, verdict or no_rule))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(list(c), pa.string()) for c in zip(*rows)], names=names + result)

    schema = f"{fields}{', ' if fields else ''}host string, path string, rule string, verdict string"
    return frame.mapInArrow(run, schema)
