"""Removal of long byte strings that repeat anywhere in the corpus.

Equal strings of ``width`` bytes meet by content: the least hash among a
string's grams (its anchor) is the same wherever the string stands.  Runs of
strings that share an anchor are one segment; only segments whose anchor
occurs twice go on, equal segments as one with its number of copies.  Segments
of an anchor meet in a bin, where a suffix array over aligned blocks of bytes,
built by linear grouping, says which strings are equal.  Texts are dealt once,
compressed; everything else is hashes and positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted
from .lexical import texts_of
from .shingles import mixed

WIDTH, BLOCK = 200, 16
#: Bytes scanned at once, and bytes of the segments in a bin.
CHUNK, BIN = 1 << 19, 1 << 20
#: Anchors with more different segments than this are cut finer, by these numbers of places.
MANY, SPANS = 20_000, (16, 1)
_B = 0x9E3779B97F4A7C15
_SECOND = np.uint64(0xD6E8FEB86659FD93)


# ---- suffix array ---------------------------------------------------------


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of ``s`` in ascending order, in linear time.

    First, suffixes are grouped by their longest Lyndon prefix.  Groups are
    taken in descending order; the members of a group leave a list of open
    positions, in which the neighbour to the left is the previous smaller
    suffix and the one to the right ends the Lyndon prefix.  Previous suffixes
    move to a new group right above their own, those that were pointed at more
    often higher.  Then groups are emitted in ascending order: a suffix follows
    in its group when the suffix after its Lyndon prefix has its place.
    """
    n = len(s)
    left, right = list(range(-1, n + 1)), list(range(1, n + 3))  # position p is entry p + 1; 0 and n + 1 are ends
    symbols: dict[int, list[int]] = {}
    for p, c in enumerate(s, 1):
        symbols.setdefault(c, []).append(p)
    members: list[dict[int, None]] = [dict.fromkeys(symbols[c]) for c in sorted(symbols)]
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    upper[-1:] = [-1]
    group = [0] * (n + 2)
    for g, held in enumerate(members):
        for p in held:
            group[p] = g
    end_of, done = [0] * (n + 2), []  # where the Lyndon prefix ends; groups, highest first

    def move(own: int, some: list[int]) -> None:
        """``some`` members of ``own`` to a new group right above it."""
        held = members[own]
        if len(held) == len(some):
            return
        new, above = len(members), upper[own]
        for p in some:
            del held[p]
            group[p] = new
        members.append(dict.fromkeys(some))
        lower.append(own)
        upper.append(above)
        upper[own] = new
        if above >= 0:
            lower[above] = new

    at = len(members) - 1
    while at >= 0:
        held = members[at]
        done.append(at)
        if len(held) == 1:
            (p,) = held
            a, b = left[p], right[p]
            right[a], left[b], end_of[p] = b, a, b
            if a:
                move(group[a], [a])
        else:
            pointed: dict[int, int] = {}
            for p in held:
                a, b = left[p], right[p]
                right[a], left[b], end_of[p] = b, a, b
                if a:
                    pointed[a] = pointed.get(a, 0) + 1
            parts: dict[tuple[int, int], list[int]] = {}
            for a, times in pointed.items():
                parts.setdefault((-times, group[a]), []).append(a)
            for times, own in sorted(parts):
                move(own, parts[times, own])
        at = lower[at]
    head, place = [0] * len(members), 0
    for g in reversed(done):
        head[g] = place
        place += len(members[g])
    first, after = [0] * (n + 2), [0] * (n + 2)  # suffixes whose Lyndon prefix ends here
    for p in range(1, n + 1):
        e = end_of[p]
        after[p], first[e] = first[e], p
    out = [0] * n
    for k in range(-1, n):
        p = first[out[k] if k >= 0 else n + 1]
        while p:
            g = group[p]
            out[head[g]] = p
            head[g] += 1
            p = after[p]
    return [p - 1 for p in out]


# ---- anchors --------------------------------------------------------------

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if n not in _powers:
        _powers.clear()
        up = np.full(n, _B, dtype=np.uint64)
        down = np.full(n, pow(_B, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` bytes, never 0."""
    up, down = powers(2 * CHUNK)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    return mixed(h) | np.uint64(1)


def sliding(h: np.ndarray, size: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of each run of ``size`` values."""
    n, m, s = len(h) - size + 1, h, 1
    while 2 * s <= size:
        m = least(m[:-s], m[s:])
        s *= 2
    return least(m[:n], m[size - s : size - s + n])


def segments(data: np.ndarray, valid: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """start, number of strings, anchor minus start, and anchor hash of each segment.

    A string belongs to the leftmost of its grams of least hash.  ``valid``
    says for each place whether a string may start there.
    """
    h, w = gram_hashes(data, gram), width - gram + 1
    least = np.where(valid, sliding(h, w, np.minimum), np.uint64(0))
    edge = np.zeros(w - 1, dtype=np.uint64)
    anchors = np.flatnonzero(h == sliding(np.concatenate([edge, least, edge]), w, np.maximum))
    begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[begin[1:], len(least)] - 1
    live = least[begin] > 0
    begin, last = begin[live], last[live]
    values, which = np.unique(h[anchors], return_inverse=True)
    far = np.int64(len(data) + 1)
    order = np.sort(which * far + anchors)  # anchors of each value, by place
    own = np.searchsorted(values, least[begin]) * far
    low, high = np.searchsorted(order, own + begin), np.searchsorted(order, own + last + w - 1, side="right")
    n = high - low
    run = np.repeat(np.arange(len(begin)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = order[low[run] + nth] - own[run]
    start = np.where(nth == 0, begin[run], order[np.maximum(low[run] + nth - 1, 0)] - own[run] + 1)
    stop = np.minimum(at, last[run]) + 1
    some = start < stop
    start, stop, at, run = start[some], stop[some], at[some], run[some]
    return start, stop - start, at - start, least[begin[run]]


def chunks(texts: list[bytes | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about CHUNK at a time: bytes, places where strings may start, and
    for each part its begin, its text and its place in the text."""
    held: list[tuple[bytes, int, int]] = []
    size = 0

    def give():
        data = np.frombuffer(b"".join(h[0] for h in held), dtype=np.uint8)
        begin = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
        valid = np.zeros(len(data) - width + 1, dtype=bool)
        for (part, _, _), b in zip(held, begin):
            valid[b : b + len(part) - width + 1] = True
        return data, valid, begin, np.array([h[1] for h in held]), np.array([h[2] for h in held])

    for k, text in enumerate(texts):
        for at in range(0, len(text or b"") - width + 1, CHUNK - width):
            held.append((text[at : at + CHUNK - 1], k, at))
            size += len(held[-1][0])
            if size >= CHUNK // 2:
                yield give()
                held, size = [], 0
    if held:
        yield give()


def scanned(texts: list[bytes | None], width: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """text, start, strings, offset, key of all segments, in order of texts."""
    out = []
    for data, valid, begin, text, at in chunks(texts, width):
        start, n, off, key = segments(data, valid, width, gram)
        part = np.searchsorted(begin, start, side="right") - 1
        out.append((text[part], start - begin[part] + at[part], n, off, key.view(np.int64)))
    return out


# ---- bins -----------------------------------------------------------------


def repeated(texts: list[bytes], strings: np.ndarray, offs: np.ndarray, copies: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each segment, which of its strings stand twice or more among all.

    Segments are laid out in blocks, aligned to their anchors, so that equal
    strings have equal blocks.  A string is its bytes before the first block
    boundary, and the first bytes of the suffix there; suffixes that agree in
    so many bytes are neighbours in the suffix array.
    """
    size = np.array([len(t) for t in texts])
    pad = -offs % BLOCK
    blocks = -(-(pad + size) // BLOCK) + 1  # the last one separates
    first = np.cumsum(blocks) - blocks
    n = int(blocks.sum())
    raw = bytearray(n * BLOCK)
    for t, f, p in zip(texts, (first * BLOCK + pad).tolist(), size.tolist()):
        raw[f : f + p] = t
    data = np.frombuffer(bytes(raw), dtype=np.uint8).reshape(n, BLOCK)
    of = np.repeat(np.arange(len(texts)), blocks)
    begin, stop = first * BLOCK + pad, first * BLOCK + pad + size
    place = np.arange(n) * BLOCK
    filled = np.clip(stop[of] - place, 0, BLOCK)
    high, low = data.view(">u8").astype(np.uint64).T
    order = np.lexsort((filled, low, high))
    fresh = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]) | (filled[order][1:] != filled[order][:-1])
    symbol = np.empty(n, dtype=np.int64)
    symbol[order] = np.r_[1, 1 + np.cumsum(fresh)]
    symbol[filled == 0] = 0
    array = np.array(suffix_array(symbol.tolist()), dtype=np.int64)
    rank = np.empty(n, dtype=np.int64)
    rank[array] = np.arange(n)

    # bytes that neighbours in the suffix array have in common, up to the width
    ends = -(-width // BLOCK) + 1
    symbol, filled_, data_ = np.r_[symbol, np.zeros(ends, np.int64)], np.r_[filled, np.zeros(ends, np.int64)], np.vstack([data, np.zeros((ends, BLOCK), np.uint8)])
    common, open_ = np.zeros(n, dtype=np.int64), np.arange(1, n)
    for t in range(ends):
        x, y = array[open_] + t, array[open_ - 1] + t
        same = (symbol[x] == symbol[y]) & (symbol[x] > 0)
        common[open_[same]] += filled_[x[same]]
        x, y = x[~same], y[~same]
        part = (data_[x] == data_[y]).cumprod(axis=1).sum(axis=1)
        common[open_[~same]] += np.minimum(part, np.minimum(filled_[x], filled_[y]))
        open_ = open_[same]
        if not len(open_):
            break

    total = np.cumsum(strings) - strings
    twice = np.zeros(int(strings.sum()), dtype=bool)
    boundary = (place >= begin[of]) & (filled > 0)
    last_high, last_low = np.r_[np.uint64(0), high[:-1]], np.r_[np.uint64(0), low[:-1]]
    for h in range(min(BLOCK, width)):
        at = place - h - begin[of]
        mine = np.flatnonzero(boundary & (at >= 0) & (at < strings[of]))
        if not len(mine):
            continue
        kind = np.cumsum(common < width - h)[rank[mine]]
        a = last_high[mine] & np.uint64((1 << 8 * max(h - 8, 0)) - 1)
        b = last_low[mine] & np.uint64((1 << 8 * min(h, 8)) - 1)
        key = mixed(mixed(mixed(kind.astype(np.uint64)) + a) * _SECOND + b)
        by = np.argsort(key, kind="stable")
        new = key[by][1:] != key[by][:-1]
        differ = (kind[by][1:] != kind[by][:-1]) | (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
        if (differ & ~new).any():  # different strings of one hash
            by = np.lexsort((b, a, kind))
            new = (kind[by][1:] != kind[by][:-1]) | (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
        heads = np.flatnonzero(np.r_[True, new])
        weight = np.add.reduceat(copies[of[mine]][by], heads)
        found = mine[by][np.repeat(weight >= 2, np.diff(np.r_[heads, len(by)]))]
        twice[total[of[found]] + (place[found] - h - begin[of[found]])] = True
    return np.split(twice, total[1:])


def spans_of(twice: np.ndarray, width: int) -> tuple[list[int], list[int]]:
    """Begins and ends of the bytes that the marked strings cover, a pair for each run."""
    edge = np.diff(np.r_[False, twice, False].astype(np.int8))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + width - 1).tolist()


def merged(begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Runs that overlap or touch, as one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(begins, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# ---- jobs -----------------------------------------------------------------

ROW = ["r", "r2"]
SEGMENT = ["key", "s1", "s2"]


def _unpacked(blobs: pa.Array) -> list[bytes]:
    unzip = zstandard.ZstdDecompressor()
    return [unzip.decompress(b) if b else b"" for b in blobs.to_pylist()]


def _dealt(docs: DataFrame, text: str, doc_id: str, width: int, gram: int, scratch: Scratch) -> DataFrame:
    """r, r2 (hashes of the row), rest (its other columns), blob (its text), and
    its segments as arrays; dealt by r."""
    x = F.col(f"`{text}`").cast("string")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    read = docs.select(F.xxhash64(f"`{doc_id}`", x).alias("r"), F.xxhash64(F.lit(1), x, f"`{doc_id}`").alias("r2"), F.struct(*rest).alias("rest"), x.alias("x"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in _slices(batches):
            texts = texts_of(batch.column("x"))
            found = scanned(texts, width, gram)
            text, start, n, off, key = (np.concatenate(c) for c in zip(*found)) if found else [np.empty(0, np.int64)] * 5
            at = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v, kind)) for v, kind in ((start, pa.int64()), (n, pa.int32()), (off, pa.int32()), (key, pa.int64()))]
            blob = pa.array([None if t is None else squeeze.compress(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("r", "r2", "rest")), blob, *lists], ["r", "r2", "rest", "blob", "start", "n", "off", "keys"])

    schema = f"r long, r2 long, rest {read.schema['rest'].dataType.simpleString()}, blob binary, start array<long>, n array<int>, off array<int>, keys array<long>"
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.save_dealt(read.mapInArrow(scan, schema), "r", buckets)


def _met(dealt: DataFrame, wanted: DataFrame, how: str = "inner") -> DataFrame:
    """The dealt texts with their rows of ``wanted``; the dealt table stays where it lies."""
    wanted = wanted.withColumnsRenamed({"r": "w_r", "r2": "w_r2"}).hint("shuffle_hash")
    # not an equality, so that r alone is the key
    return dealt.join(wanted, (F.col("r") == F.col("w_r")) & (F.col("r2").bitwiseXOR(F.col("w_r2")) == 0), how).drop("w_r", "w_r2")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, rows):
            yield whole.slice(k, rows)


def _cut(wanted: DataFrame, dealt: DataFrame, span: int, width: int) -> DataFrame:
    """key, s1, s2 (hash of the bytes), r, r2, start, n, off of the wanted segments (r, r2, cuts).

    With a ``span``, a segment is cut by places of that many strings relative
    to its anchor, and the key is a hash of the bytes that all strings of a
    place have in common.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out: list[list] = [[] for _ in range(8)]
            rows = zip(batch.column("r").to_pylist(), batch.column("r2").to_pylist(), _unpacked(batch.column("blob")), batch.column("cuts").to_pylist())
            for r, r2, text, cuts in rows:
                for c in cuts:
                    parts = [(c["key"], c["start"], c["n"], c["off"])]
                    if span:
                        parts = []
                        a = c["off"]
                        while a > c["off"] - c["n"]:
                            low = max(a // span * span, c["off"] - c["n"] + 1)
                            anchor = c["start"] + c["off"]
                            core = text[anchor - a // span * span : anchor - a // span * span - span + 1 + width]
                            key = xxhash.xxh3_64_intdigest(core, seed=a // span) - (1 << 63)
                            parts.append((key, anchor - a, a - low + 1, a))
                            a = low - 1
                    for key, start, n, off in parts:
                        digest = xxhash.xxh3_128_digest(text[start : start + n + width - 1])
                        row = (key, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), r, r2, start, n, off)
                        for column, v in zip(out, row):
                            column.append(v)
            kinds = [pa.int64()] * 6 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [*SEGMENT, *ROW, "start", "n", "off"])

    return _met(dealt.select(*ROW, "blob"), wanted).mapInArrow(cut, "key long, s1 long, s2 long, r long, r2 long, start long, n int, off int")


def _of_rows(cuts: DataFrame) -> DataFrame:
    """A row for each text with all of its cuts; repeated rows have each once."""
    return cuts.groupBy(*ROW).agg(F.collect_set(F.struct("key", "start", "n", "off")).alias("cuts"))


def _different(cuts: DataFrame) -> DataFrame:
    return cuts.groupBy(*SEGMENT).agg(F.count("*").alias("m"), F.min(F.struct("r", "r2", "start", "n", "off")).alias("rep"))


def _fetched(different: DataFrame, dealt: DataFrame, width: int) -> DataFrame:
    """key, s1, s2, m, n, off and the bytes of different segments."""
    asked = different.groupBy(F.col("rep.r").alias("r"), F.col("rep.r2").alias("r2"))
    asked = asked.agg(F.collect_list(F.struct("key", "s1", "s2", "m", "rep.start", "rep.n", "rep.off")).alias("cuts"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for text, cuts in zip(_unpacked(batch.column("blob")), batch.column("cuts").to_pylist()):
                for c in cuts:
                    row = (c["key"], c["s1"], c["s2"], c["m"], c["n"], c["off"], text[c["start"] : c["start"] + c["n"] + width - 1])
                    for column, v in zip(out, row):
                        column.append(v)
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [*SEGMENT, "m", "n", "off", "bytes"])

    return _met(dealt.select(*ROW, "blob"), asked).mapInArrow(fetch, "key long, s1 long, s2 long, m long, n int, off int, bytes binary")


def _judged(segs: DataFrame, width: int) -> DataFrame:
    """key, s1, s2, m, begins, ends: the runs of a segment's bytes that repeat; rows come by key."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple] = {}
        size, last = 0, None

        def give() -> pa.RecordBatch:
            m, n, off, texts = zip(*held.values())
            marks = repeated(list(texts), np.array(n), np.array(off), np.array(m), width)
            runs = [(*k, v[0], *spans_of(t, width)) for (k, v), t in zip(held.items(), marks) if t.any()]
            columns = list(zip(*runs)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*SEGMENT, "m", "begins", "ends"])

        for batch in batches:
            for key, s1, s2, m, n, off, text in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BIN and key != last:
                    yield give()
                    held, size = {}, 0
                if (key, s1, s2) not in held:  # repeated rows give theirs each
                    held[key, s1, s2] = m, n, off, text
                    size += len(text)
                last = key
        if held:
            yield give()

    return segs.mapInArrow(judge, "key long, s1 long, s2 long, m long, begins array<int>, ends array<int>")


def remove_repeats(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns row (the input row without its text), n_bytes, n_removed, n_spans, spans (begin, end), kept (bytes).

    Texts are UTF-8 bytes.  Every byte is removed that a string of ``width``
    bytes covers which also starts anywhere else, in the same text or another;
    strings are judged on the input.  ``spans`` are the maximal removed runs.

    Null and empty texts have no bytes; texts shorter than ``width`` stay whole.
    Ids only tell rows apart: null ids are judged as any other, and repeated
    rows are two documents of equal text, which both lose their strings.  An
    empty table gives none.  ``width`` is more than 16.
    """
    if width <= BLOCK:
        raise ValueError(f"width is more than {BLOCK}")
    scratch = Scratch(docs.sparkSession, "suffixes")
    dealt = _dealt(docs, text, doc_id, width, max(1, width * 8 // 25), scratch)
    every = dealt.select("r", "r2", F.explode(F.arrays_zip("keys", "start", "n", "off")).alias("s")).select("r", "r2", F.col("s.keys").alias("key"), "s.start", "s.n", "s.off")
    often = scratch.save(every.select("key").groupBy("key").agg(F.count("*").alias("times")).filter("times > 1"))
    hits = join_counted(every, often, ["key"], "times", F.xxhash64("r", "start")).drop("times")
    cuts = scratch.save(_cut(_of_rows(hits), dealt, 0, width))
    different, cuts = _bounded(cuts, dealt, width, scratch)

    size = different.agg(F.sum(F.col("rep.n") + width)).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (32 * BIN))
    segs = _fetched(different, dealt, width).repartition(parts, "key").sortWithinPartitions("key")
    judged = scratch.save(_judged(segs, width))
    found = join_counted(cuts.select(*SEGMENT, *ROW, "start"), judged, SEGMENT, "m", F.xxhash64("r", "start"))
    found = found.groupBy(*ROW).agg(F.collect_set(F.struct("start", "begins", "ends")).alias("runs"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n_bytes, n_removed, spans, kept = [], [], [], []
            for text, runs in zip(_unpacked(batch.column("blob")), batch.column("runs").to_pylist()):
                gone = merged([x["start"] + b for x in runs or () for b in x["begins"]], [x["start"] + e for x in runs or () for e in x["ends"]])
                edges = [0, *(e for run in gone for e in run), len(text)]
                n_bytes.append(len(text))
                n_removed.append(sum(b - a for a, b in gone))
                spans.append([{"begin": a, "end": b} for a, b in gone])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *columns], ["row", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    schema = f"row {dealt.schema['rest'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, spans array<struct<begin: long, end: long>>, kept binary"
    return _met(dealt.select(*ROW, "rest", "blob"), found, "left").select("rest", "blob", "runs").mapInArrow(remove, schema)


def _bounded(cuts: DataFrame, dealt: DataFrame, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The different segments, with their copies, and all segments.

    The segments of an anchor that has more than MANY different ones are cut
    finer, in the end to single strings, of which an anchor has one.
    """
    of_all, all_cuts = [], []
    for span in (*SPANS, None):
        different = scratch.save(_different(cuts))
        many = different.groupBy("key").agg(F.count("*").alias("held")).filter(F.col("held") > MANY).select("key")
        if span is None or many.isEmpty():
            of_all.append(different)
            all_cuts.append(cuts)
            break
        many = scratch.save(many)
        of_all.append(different.join(many, "key", "left_anti"))
        all_cuts.append(cuts.join(many, "key", "left_anti"))
        cuts = scratch.save(_cut(_of_rows(cuts.join(many, "key", "left_semi")), dealt, span, width))
    together = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(together(tables[1:]))
    return together(of_all), together(all_cuts)
