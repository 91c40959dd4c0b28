"""Allow and block lists for URLs: one trie over reversed host labels and path segments.

Rules name a host and the beginning of a path. They become a trie: from the root down the
host's labels from the last to the first, then the path's segments, each with its closing
slash; what a rule has after its last slash is kept at the node as a text the next segment
must begin with. A URL walks down its own host and path once and meets all rules that fit;
the one with most host labels wins, then the one with the longest path, then block before
allow. The trie is broadcast after a check of its size; rules beyond that are a mistake in
configuration and raise an error, as a list of rules does not grow with the pages.

Defined results: a null URL, or one without ``://``, has an empty host and path, which no
rule fits. The verdict is then the default. Rules with an empty host fit every host.
Duplicate rules count once. Extra columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.llm.stage import small_batches, staged

#: Most rules of one trie, some hundred bytes each; more rules make more tries.
MAX_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


class Trie:
    """Rules by reversed host label and path segment.

    A node is ``[children, path root, rule, beginnings]``: ``rule`` is the one that ends here
    and ``beginnings`` are rules whose path goes on with part of a segment.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: list = self._node()
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            host = host.translate(str.maketrans(_UPPER, _LOWER))
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node[0].setdefault(label, self._node())
            if node[1] is None:
                node[1] = self._node()
            node = node[1]
            *segments, rest = path.split("/")
            for segment in segments:
                node = node[0].setdefault(segment, self._node())
            mark = (host + path, verdict)
            if rest:
                if (rest, *mark) not in node[3]:
                    node[3].append((rest, *mark))
                    node[3].sort(key=lambda m: (-len(m[0]), m[2] != "block"))
            elif node[2] is None or verdict == "block":
                node[2] = mark

    @staticmethod
    def _node() -> list:
        return [{}, None, None, []]

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning rule's text and verdict."""
        found = None
        node = self.root
        found = self._path(node[1], path) or found
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            found = self._path(node[1], path) or found
        return found

    @staticmethod
    def _path(node: list | None, path: str) -> tuple[str, str] | None:
        if node is None:
            return None
        found, at = node[2], 0
        while True:
            for rest, rule, verdict in node[3]:
                if path.startswith(rest, at):
                    found = (rule, verdict)
                    break
            end = path.find("/", at)
            node = node[0].get(path[at:end]) if end >= 0 else None
            if node is None:
                return found
            found, at = node[2] or found, end + 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", 2), F.lit(""))
    return F.translate(rest, _UPPER, _LOWER), path


def _matched(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            found = [trie.find(h, p) or (None, None) for h, p in zip(hosts, paths)]
            yield pa.record_batch(
                {
                    "row": batch["row"],
                    "host": batch["host"],
                    "path": batch["path"],
                    "rule": pa.array([f[0] for f in found], pa.string()),
                    "verdict": pa.array([f[1] for f in found], pa.string()),
                }
            )

    return run


def judge_urls(
    pages: DataFrame, rules: list[Rule], keep: list[str], url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``row`` (a struct of the kept columns), ``host``, ``path``, ``rule`` and ``verdict``."""
    small_batches(pages.sparkSession)
    # A rule of a longer host wins, then that of a longer path, then a block.
    rules = sorted(set(rules))
    host, path = host_and_path(pages[url_col])
    row = F.struct(*[pages[c] for c in keep]).alias("row")
    out = pages.select(row, host.alias("host"), path.alias("path"))
    kind = out.schema["row"].dataType.simpleString()
    schema = f"row {kind}, host string, path string, rule string, verdict string"
    best = None
    for k in range(0, len(rules) or 1, MAX_RULES):
        shared = pages.sparkSession.sparkContext.broadcast(Trie(rules[k : k + MAX_RULES]))
        if k:  # one trie at a time in a task
            out = staged(out.select("row", "host", "path", best.alias("best")), "judged")
            inner = out.select(F.struct("row", "best").alias("row"), "host", "path")
            kind = inner.schema["row"].dataType.simpleString()
            found = inner.mapInArrow(_matched(shared), f"row {kind}, host string, path string, rule string, verdict string")
            out = found.select("row.row", "host", "path", "rule", "verdict", F.col("row.best").alias("before"))
            best = F.greatest("before", _rank())
        else:
            out = out.mapInArrow(_matched(shared), schema)
            best = _rank()
    if len(rules) > MAX_RULES:
        out = out.select("row", "host", "path", best["rule"].alias("rule"), best["verdict"].alias("verdict"))
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _rank() -> Column:
    """A found rule in the order of precedence, null without one."""
    cut = F.locate("/", F.concat("rule", F.lit("/")))
    order = [cut.alias("host_size"), F.char_length("rule").alias("size"), F.col("verdict").alias("verdict"), F.col("rule").alias("rule")]
    return F.when(F.col("rule").isNotNull(), F.struct(*order))


def allowed_pages(pages: DataFrame, rules: list[Rule], **how) -> DataFrame:
    """The pages that are not blocked, with their columns as they were."""
    return judge_urls(pages, rules, pages.columns, **how).where("verdict = 'allow'").select("row.*")


def verdict_report(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    out = judge_urls(pages, rules, ["page_id"])
    return out.select("row.page_id", "host", "path", "rule", "verdict")
