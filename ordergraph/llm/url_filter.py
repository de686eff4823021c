"""URL filters: a trie over reversed host labels and path segments.

The rule list is a parameter of the job (its size does not follow the data);
it is built into a trie on the driver, broadcast, and looked up in Arrow
batches.  The longest matching rule decides between allow and block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
HOST = r"^.*?://([^/?#]*)"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    if url is None or (start := url.find("://")) < 0:
        return "", ""
    rest = url[start + 3 :]
    for mark in "?#":
        if (cut := rest.find(mark)) >= 0:
            rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


class RuleTrie:
    """Host labels from the right, then the path's segments.

    A node is [children by label, path root]; a path node is
    [children by segment, ends by the rule's last, open segment].
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: list = [{}, None]
        for verdict, host, path in rules:
            if verdict not in (ALLOW, BLOCK) or not path.startswith("/"):
                raise ValueError(f"not a rule: {verdict} {host} {path}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            node[1] = node[1] or [{}, {}, []]
            at, (*whole, last) = node[1], path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}, []])
            held = at[1].setdefault(last, (f"{host}{path}", verdict))
            at[2] = sorted({len(end) for end in at[1]})
            if held[1] != verdict:
                raise ValueError(f"both allowed and blocked: {host}{path}")

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """Rule and verdict of the longest match, or two None."""
        best: tuple[str | None, str | None] = (None, None)
        node, segments = self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            at = node[1]
            for segment in segments if path.startswith("/") else ():
                if at is None:
                    break
                for k in at[2]:  # only lengths that rules have, so a long segment is not tried at each of its places
                    if k <= len(segment) and (end := at[1].get(segment[:k])) and len(end[0]) > len(best[0] or ""):
                        best = end
                at = at[0].get(segment)
        return best


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = ALLOW, url: str = "url") -> DataFrame:
    """The columns of ``pages`` in struct row, with host, path, rule, verdict.

    ``rules`` are (verdict, host, path).  A url that no rule fits gets
    ``default`` and a null rule; so do a null url and one without ``://``.
    Repeated rows get one verdict each; an empty table gives none.
    """
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            parts = [split_url(u if isinstance(u, str) else None) for u in urls]
            found = [trie.value.match(*p) for p in parts]
            yield pd.DataFrame({"host": [p[0] for p in parts], "path": [p[1] for p in parts], "rule": [f[0] for f in found], "verdict": [f[1] or default for f in found]}, dtype=object)

    return pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), look_up(F.col(f"`{url}`")).alias("v")).select("row", "v.*")
