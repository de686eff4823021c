"""HTML extraction: page differencing between nearest URLs of a host.

Pages of a host are put in the order of their paths, and each is compared with
the nearest of them that are not copies of it.  Text lines are aligned by
longest common subsequence.  Outside the article element, a line that the
nearest page shares is the host's and is deleted; inside, where pages also share
passages that belong to them, one is deleted that all compared pages share.
Lines in elements that are never article text go in any case.
"""

from __future__ import annotations

import html as html_text
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, packed
from .url_filter import split_url

# Names of HTML elements, and words of class, id and role names.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NEVER = {"aside", "button", "datalist", "dialog", "footer", "form", "head", "input", "menu", "nav", "object", "search", "select", "svg", "math", "canvas", "audio", "video", "map"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_ARTICLE = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "complementary", "contentinfo", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "overlay", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
}
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?][^>]*(?:>|\Z)", re.S)
NAME = re.compile(r"[\s/]*([^\s/>=]+)(?:\s*(=)\s*)?")
BARE = re.compile(r"[^\s>]*")
#: Pages before and after one that are looked at, pages that it is compared with, and rows of a block.
AROUND, COMPARED, BLOCK = 6, 6, 4096


def attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes of a tag from ``at`` on, whether it closes itself, and where it ends (-1: not at all).

    A quote counts at the start of a value only.  One that is not closed ends
    at the next ``>``; so does one whose value would go on over a later tag.
    """
    out: dict[str, str] = {}
    while m := NAME.match(page, at):
        name, at, value = m[1].lower(), m.end(), ""
        if m[2] and page[at : at + 1] in ('"', "'"):
            close, end = page.find(page[at], at + 1), page.find(">", at)
            opens = page.find("<", at)
            if close < 0 or 0 <= end < opens < close:
                return out, False, end + 1 if end >= 0 else -1
            value, at = page[at + 1 : close], close + 1
        elif m[2]:
            value = BARE.match(page, at)[0]
            at += len(value)
        out.setdefault(name, value)
    end = page.find(">", at)
    return out, page[max(end - 1, 0) : end] == "/", end + 1 if end >= 0 else -1


def _marked(name: str, own: dict[str, str]) -> bool:
    """Whether the element's own names say that it is not article text."""
    if not own or name in {"html", "body", "article", "main"}:
        return False
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        return True
    return any(NOT_ARTICLE & set(re.split(r"[^a-z]+", own[key].lower())) for key in ("class", "id", "role") if key in own)


def lines_of(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in the article element, in an element that is never article text)
    of each text block, in page order; characters decoded, white space single."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, never, in the article, in its header
    here: list[str] = []
    page = page or ""

    def flush() -> None:
        text = " ".join(html_text.unescape("".join(here)).split())
        here.clear()
        if text:
            _, never, inside, head = stack[-1] if stack else ("", False, False, False)
            out.append((text, inside, never or head and not any(s[0] in HEADINGS for s in stack)))

    def close(upto: int) -> None:
        if any(s[0] in BLOCKS for s in stack[upto:]) or any(s[1] for s in stack[upto:]) != bool(stack[upto - 1 : upto] and stack[upto - 1][1]):
            flush()
        del stack[upto:]

    at = 0
    while m := MARKUP.search(page, at):
        here.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        own_names, closed, at = attributes(page, at)
        if at < 0:  # a tag that is cut off
            at = len(page)
            break
        if m[1]:
            found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if found is not None:
                close(found)
            elif name in BLOCKS:
                flush()
            continue
        if name == "br":
            here.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        shut = CLOSES.get(name) or ({"p"} if name in BLOCKS else ())
        for k in range(len(stack) - 1, -1, -1) if shut else ():
            if stack[k][0] in shut:
                close(k)
                break
            if stack[k][0] in BLOCKS and not (shut & {"td", "th", "tr"} and stack[k][0] not in {"table"}):
                break
        never, inside, head = stack[-1][1:] if stack else (False, False, False)
        own = never or name in NEVER or name == "header" and not inside or _marked(name, own_names)
        if name in BLOCKS or own != never:
            flush()
        if name not in VOID and not closed:
            article = inside or name in ("article", "main") and not own
            stack.append((name, own, article, head or name == "header" and inside))
    here.append(page[at:])
    flush()
    return out


def page_lines(page: object) -> list[tuple[str, bool]]:
    """(text, in the article element) of each line that may be article text; none of a page that is null."""
    return [(t, i) for t, i, never in lines_of(page if isinstance(page, str) else None) if not never]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``.

    A row of the table is a whole number, one bit for each place of ``b``, so
    neither time nor memory follows the product of the lengths bit by bit.
    """
    places: dict[int, list[int]] = {}
    for k, x in enumerate(b):
        places.setdefault(x, []).append(k)
    full = (1 << len(b)) - 1
    often: dict[int, int] = {}
    row = full
    for x in a:
        if (mask := often.get(x)) is None:
            mask = 0
            for k in places.get(x, ()):
                mask |= 1 << k
            if len(places.get(x, ())) > 16:
                often[x] = mask
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def shared_lines(mine: list[int], other: list[int]) -> set[int]:
    """Positions in ``mine`` of a longest common subsequence with ``other``, in space that is linear in both."""
    both = set(mine) & set(other)
    at = [k for k, x in enumerate(mine) if x in both]
    todo = [(0, [mine[k] for k in at], [x for x in other if x in both])]
    out: set[int] = set()
    while todo:
        first, a, b = todo.pop()
        start = len(os.path.commonprefix([a, b]))
        end = len(os.path.commonprefix([a[start:][::-1], b[start:][::-1]]))
        out.update(at[first + k] for k in (*range(start), *range(len(a) - end, len(a))))
        first, a, b = first + start, a[start : len(a) - end], b[start : len(b) - end]
        if len(a) == 1 and a[0] in b:
            out.add(at[first])
        elif len(a) > 1 and b:
            half = len(a) // 2
            cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
            todo += [(first, a[:half], b[:cut]), (first + half, a[half:], b[cut:])]
    return out


def is_copy(mine: tuple[list[int], list[bool]], other: tuple[list[int], list[bool]]) -> bool:
    """Whether two pages hold one article: half of the smaller article element's
    lines, or nine tenths of all lines of pages without one."""
    a, b = ({k for k, i in zip(*page) if i} for page in (mine, other))
    if a and b:
        return 2 * len(a & b) >= min(len(a), len(b))
    a, b = set(mine[0]), set(other[0])
    return 10 * len(a & b) >= 9 * min(len(a), len(b))


def deleted_lines(mine: tuple[list[int], list[bool]], others: list[tuple[list[int], list[bool]]]) -> list[int]:
    """Positions of the lines that comparing with ``others``, nearest first, deletes.

    Inside the article element: lines that COMPARED pages share, all of them.
    Outside: lines that the nearest page shares; without any page to compare
    with, all if there is an article element.
    """
    keys, inside = mine
    shared = [shared_lines(keys, other[0]) for other in others]
    every = set.intersection(*shared) if len(shared) >= COMPARED else set()
    alone = set(range(len(keys))) if any(inside) else set()
    near = shared[0] if shared else alone
    return [k for k, i in enumerate(inside) if k in (every if i else near)]


def _compared(block: pd.DataFrame) -> pd.DataFrame:
    """Deleted lines of the block's own rows, which come in order with AROUND rows of the next blocks at either end."""
    block = block.sort_values("rank", kind="stable")
    host, path, own = (block[c].tolist() for c in ("host", "path", "own"))
    pages = [(list(k), [bool(i) for i in f]) for k, f in zip(block["keys"], block["inside"])]
    out = []
    for k in range(len(block)):
        if not own[k]:
            continue
        around = [o for o in range(max(0, k - AROUND), min(len(block), k + AROUND + 1)) if o != k and host[k] and host[o] == host[k]]
        around.sort(key=lambda o: (-len(os.path.commonprefix([path[o], path[k]])), abs(o - k), o))
        others = [pages[o] for o in around if not is_copy(pages[k], pages[o])][:COMPARED]
        out.append((block["k1"].iat[k], block["k2"].iat[k], deleted_lines(pages[k], others), len(others)))
    return pd.DataFrame(out, columns=["k1", "k2", "deleted", "n_compared"])


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", block: int = BLOCK) -> DataFrame:
    """Columns row, text, n_chars, n_deleted (lines deleted by differencing), n_compared.

    A page is compared with up to COMPARED pages of its host, among the AROUND
    before and after it in the order of path, page_id and a hash: those of the
    longest common path first, copies of its own article left out.  Null or
    empty html: empty text.  Null url: host and path are empty, and the page
    is not compared.  Repeated rows count once and get the same result each;
    pages of one id are told apart by url and html.  An empty table gives none.
    """
    scratch = Scratch(pages.sparkSession, "html")
    named = {"d": F.col(f"`{page_id}`").cast("long"), "url": F.col(f"`{url}`"), "html": F.col(f"`{html}`")}
    identity = {"k1": F.xxhash64(*named.values()), "k2": F.xxhash64(F.lit(1), *named.values())}

    @F.pandas_udf("host string, path string, keys array<long>, inside array<boolean>")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for urls, bodies in batches:
            out = []
            for u, b in zip(urls, bodies):
                found = page_lines(b)
                keys = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for t, _ in found]
                out.append((*split_url(u if isinstance(u, str) else None), keys, [i for _, i in found]))
            yield pd.DataFrame(out, columns=["host", "path", "keys", "inside"])

    fields = pages.select(*[c.alias(k) for k, c in {**identity, **named}.items()])
    parsed = scratch.save(fields.select("k1", "k2", "d", parse("url", "html").alias("p")).select("k1", "k2", "d", "p.*"))
    # repeated rows once; then keys only are put in order: a range has no hot host
    once = parsed.groupBy("k1", "k2").agg(F.first(F.struct("d", "host", "path", "keys", "inside")).alias("p")).select("k1", "k2", "p.*")
    order = ["host", "path", "d", "k1", "k2"]
    dealt = scratch.save(scratch.save(once).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    # rank: rows of the parts before (one number a part), then the place within the part
    before, counts = 0, []
    for part, n in sorted((r[0], r[1]) for r in dealt.groupBy(F.shiftright("at", 33)).count().collect()):
        counts.append((part, before))
        before += n
    starts = pages.sparkSession.createDataFrame(counts, "part long, before long")
    ranked = dealt.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("part")).withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")
    mine, place = F.floor(F.col("rank") / block), F.col("rank") % block
    to = F.array_compact(F.array(mine, F.when(place < AROUND, mine - 1), F.when(place >= block - AROUND, mine + 1)))
    blocks = ranked.withColumn("block", F.explode(to)).withColumn("own", F.floor(F.col("rank") / block) == F.col("block"))
    kinds = "k1 long, k2 long, deleted array<int>, n_compared int"
    decided = scratch.save(blocks.groupBy("block").applyInPandas(_compared, kinds), "decided")
    scratch.clear(keep=("decided",))

    # pages are read again rather than kept: only the lines are dealt, compressed
    @F.pandas_udf("size int, lines binary")
    def pressed(bodies: pd.Series) -> pd.DataFrame:
        texts = ["\n".join(t for t, _ in page_lines(b)).encode("utf-8", "surrogatepass") for b in bodies]
        return pd.DataFrame({"size": [len(x) for x in texts], "lines": [pa.compress(x, codec="zstd", asbytes=True) for x in texts]})

    @F.pandas_udf("string")
    def kept(size: pd.Series, lines: pd.Series, deleted: pd.Series) -> pd.Series:
        out = []
        for n, x, d in zip(size, lines, deleted):
            gone = {int(k) for k in d}
            text = pa.decompress(x, decompressed_size=n, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass") if n else ""
            out.append("\n\n".join(t for k, t in enumerate(text.split("\n")) if k not in gone))
        return pd.Series(out, dtype=object)

    rows = packed(pages, **identity, p=pressed(named["html"]))
    both = rows.join(decided.hint("merge"), ["k1", "k2"]).select("row", "deleted", "n_compared", kept("p.size", "p.lines", "deleted").alias("text"))
    return both.select("row", "text", F.length("text").cast("long").alias("n_chars"), F.size("deleted").cast("long").alias("n_deleted"), F.col("n_compared").cast("long").alias("n_compared"))
