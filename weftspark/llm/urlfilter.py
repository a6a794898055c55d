"""URL allow and block lists as one trie over reversed host labels and path segments.

Labels are walked from the top-level domain down, then path segments from the left; the last segment of a rule matches
as a prefix, so a rule fits every url whose path starts with the rule's.  The longest rule wins, host and path together;
of equally long ones that with the deeper host, and of two equal rules the block.  The trie is built from a rule list whose size is checked before it is
broadcast; a larger list is an error, not a truncation.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; an unmatched url gets
the default verdict; empty labels (``a..b``) are labels; repeated rows give repeated results; a null page_id is kept;
very long urls are walked as others, a step a segment and a look-up for each length that a rule ends with there; an
empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship

#: Characters of hosts and paths, with ``RULE_COST`` more for each rule, that may be broadcast: a trie of about 50 MB in each worker.
MAX_COST, RULE_COST = 5_000_000, 200

Rule = tuple[str, str, str]  # verdict, host, path


class UrlTrie:
    """Nodes are dicts: a label leads to a node; under ``/`` is the tree of path segments with ends and open ends."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        cost = 0
        for verdict, host, path in rules:
            cost += len(host) + len(path) + RULE_COST
            if cost > MAX_COST:
                raise ValueError("so many rules can't be broadcast")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(("label", label), {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            ends = node.setdefault("ends", {})
            node["lengths"] = sorted({len(last), *node.get("lengths", ())})
            if ends.get(last, ("",))[0] != "block":
                ends[last] = (verdict, host.lower() + path)

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        """The rule with the longest path under a host node that fits."""
        best = None
        segments = path.split("/")
        for i, segment in enumerate(segments):
            if ends := node.get("ends"):
                for n in node["lengths"]:
                    if n <= len(segment) and segment[:n] in ends:
                        best = ends[segment[:n]]
            node = node.get(("segment", segment)) if i + 1 < len(segments) else None
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and rule of the longest match, or None."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(("label", label))
            if node is None:
                break
            found = self._path(node, path)
            if found and (best is None or len(found[1]) >= len(best[1])):
                best = found
        return best


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host and path, by built-in string functions."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col("page_id").cast("long"), F.coalesce(lower, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, the rule that decides and the verdict, for every row of ``pages`` (page_id, url, ...)."""
    ship(pages.sparkSession)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def verdicts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for frame in frames:
            found = [find(h, p) or (default, None) for h, p in zip(frame["host"], frame["path"], strict=True)]
            frame["rule"] = pd.Series([r for _, r in found], index=frame.index, dtype=object)
            frame["verdict"] = pd.Series([v for v, _ in found], index=frame.index, dtype=object)
            yield frame

    return split_url(pages).mapInPandas(verdicts, "page_id long, host string, path string, rule string, verdict string")
