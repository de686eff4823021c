"""Packing documents into token sequences by cutting-stock column generation.

Documents are tokenised once, in Arrow batches, into pieces of at most one
sequence; the table of pieces holds no text and is checkpointed.  Their length
histogram (a bounded number of classes) goes to the driver, where a linear
program over patterns is solved: a knapsack dynamic program prices new columns
until none improves.  Rounded patterns give each class its slots, and a piece
finds its sequence from its rank in its class.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import before, checkpoint

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
EOD = 1
#: In an ordered packing, each pattern is dealt over so many rounds.
ROUNDS = 64


def added_tokens() -> dict[str, int]:
    """Tokens that the tokenizers file recognises whole wherever they stand in a text."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def load_encoder(path: str, added: dict[str, int]):
    """tiktoken's encoder for a ranks file and added tokens; the ids are those of
    the tokenizers file of the same vocabulary (tested), in a third of the time."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def cut(ids: list[int], size: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece: whole sequences, then the rest."""
    raw = np.asarray(ids, dtype="<u4")
    return [(k, len(p), zlib.crc32(p.tobytes())) for k in range(0, len(raw), size) for p in [raw[k : k + size]]]


def pieces_of(docs: DataFrame, size: int = 2048, tokenizer: str = BPE, doc_id: str = "doc_id", text: str = "text", place: Column | None = None) -> DataFrame:
    added = added_tokens()
    schema = "place long, doc_id long, row_hash long, start long, length long, ids_crc32 long, doc_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder(tokenizer, added)
        for batch in batches:
            out = []
            for p, d, null, h, x in zip(batch["p"], batch["d"], batch["no_id"], batch["h"], batch["x"]):
                ids = encoder.encode(x, allowed_special="all") if isinstance(x, str) else []
                ids.append(EOD)
                out += [(p, None if null else int(d), h, s, n, c, len(ids)) for s, n, c in cut(ids, size)]
            frame = pd.DataFrame(out, columns=["place", "doc_id", "row_hash", "start", "length", "ids_crc32", "doc_tokens"])
            frame["doc_id"] = pd.array([row[1] for row in out], dtype="Int64")
            yield frame

    d = F.col(f"`{doc_id}`").cast("long")
    # pandas has no 64-bit integers beside nulls, so an id goes with a mark of its own for null
    return docs.select((F.lit(0) if place is None else place).cast("long").alias("p"), F.coalesce(d, F.lit(0)).alias("d"), d.isNull().alias("no_id"), F.xxhash64(d, F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("x")).mapInPandas(run, schema)


def _knapsack(values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Best pattern: items of width w = 1.. have values[w - 1], any number of each."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=int)
    for c in range(1, capacity + 1):
        w = np.arange(1, min(c, len(values)) + 1)
        gain = best[c - w] + values[w - 1]
        k = int(gain.argmax())
        best[c], last[c] = gain[k], k + 1
    pattern: Counter[int] = Counter()
    c = capacity
    while c > 0:
        if values[last[c] - 1] > 1e-12:  # else room that stays empty
            pattern[int(last[c])] += 1
        c -= last[c]
    return float(best[capacity]), dict(pattern)


def column_generation(demand: dict[int, int], capacity: int, rounds: int = 3000) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Patterns with their fractions in the linear program's optimum, and its
    lower bound on the number of sequences.

    Revised simplex: min sum(x), A x = demand, started from one width a
    pattern.  ``rounds`` bounds the columns; the bound on sequences holds
    whenever it stops.  Rounding errors of the inverse only cost sequences: what
    the patterns hold is counted in whole numbers afterwards.
    """
    widths = sorted(demand)
    row = {w: k for k, w in enumerate(widths)}
    basis = [{w: capacity // w} for w in widths]
    inverse = np.diag([1.0 / (capacity // w) for w in widths])
    x = inverse @ np.array([float(demand[w]) for w in widths])
    bound = 0.0
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        values = np.zeros(widths[-1])
        values[[w - 1 for w in widths]] = np.maximum(duals, 0)
        price, pattern = _knapsack(values, capacity)
        bound = max(bound, float(x.sum() / max(price, 1.0)))
        if price <= 1 + 1e-6 or x.sum() - bound < 0.5:
            break
        column = np.zeros(len(widths))
        for w, n in pattern.items():
            column[row[w]] = n
        direction = inverse @ column
        can = direction > 1e-9
        if not can.any():
            break
        ratio = np.where(can, x / np.where(can, direction, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x = np.maximum(x - theta * direction, 0)
        x[out] = theta
        basis[out] = pattern
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
    return list(zip(basis, x)), bound


def round_patterns(fractions: list[tuple[dict[int, int], float]], demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of patterns that hold exactly the demand.

    Fractions are rounded down; what is left (less than one pattern for each
    class) is packed by best fit, largest first.
    """
    left, out = Counter(demand), []
    for pattern, x in sorted(fractions, key=lambda p: -p[1]):
        n = min([int(x + 1e-9), *(left[w] // k for w, k in pattern.items())])
        if n > 0:
            out.append((pattern, n))
            left.subtract({w: k * n for w, k in pattern.items()})
    left = +left
    rest: Counter = Counter()
    while left:
        room, pattern = capacity, Counter()
        for w in sorted(left, reverse=True):
            if k := min(left[w], room // w):
                pattern[w] += k
                room -= k * w
        n = min(left[w] // k for w, k in pattern.items())
        rest[tuple(sorted(pattern.items()))] += n
        left.subtract({w: k * n for w, k in pattern.items()})
        left = +left
    return out + [(dict(p), n) for p, n in rest.items()]


def in_rounds(patterns: list[tuple[dict[int, int], int]], rounds: int) -> list[tuple[dict[int, int], int]]:
    """The same patterns as often, each dealt evenly over the rounds."""
    due = lambda k, n, g: (n * g + k * 37 % rounds) // rounds  # noqa: E731  rare patterns fall in different rounds
    return [(p, each) for g in range(rounds) for k, (p, n) in enumerate(patterns) if (each := due(k, n, g + 1) - due(k, n, g))]


def pack(
    docs: DataFrame,
    size: int = 2048,
    grain: int = 8,
    tokenizer: str = BPE,
    doc_id: str = "doc_id",
    text: str = "text",
    place: Column | None = None,
) -> DataFrame:
    """Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``grain``: widths are in units of so many tokens, so the histogram has at
    most size/grain classes, which bounds the program on the driver.

    ``place``: a whole number for each row, 0 or more, in whose order documents
    go to sequences: a class's pieces by rank, and all patterns side by side,
    so that a sequence holds what stands at about its own share of the order
    (to 1/ROUNDS of all).  Without it the order is that of a hash.

    Null or empty text: one piece, the end mark.  Null doc_id: packed as any
    other document, with a null id.  Repeated rows are packed each.  Ties in
    rank are of equal rows.  An empty table gives none.
    """
    units = size // grain
    pieces = checkpoint(pieces_of(docs, size, tokenizer, doc_id, text, place).withColumn("width", F.ceil(F.col("length") / grain).cast("int")))
    demand = {r["width"]: r["n"] for r in pieces.groupBy("width").agg(F.count("*").alias("n")).collect()}  # at most ``units`` rows
    if not demand:
        return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    patterns = round_patterns(column_generation(demand, units)[0], demand, units)
    if place is not None:
        patterns = in_rounds(patterns, ROUNDS)

    # a class's ranks, run by run: the first rank, pieces a sequence, the first sequence
    runs: dict[int, list[tuple[int, int, int]]] = {w: [] for w in demand}
    used: Counter[int] = Counter()
    base = 0
    for pattern, n in patterns:
        for w, k in pattern.items():
            runs[w].append((used[w], k, base))
            used[w] += k * n
        base += n
    tables = {w: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for w, r in runs.items()}

    @F.pandas_udf("long")
    def sequence_of(width: pd.Series, rank: pd.Series) -> pd.Series:
        w, r, out = width.to_numpy(), rank.to_numpy(), np.zeros(len(rank), dtype=np.int64)
        for value in np.unique(w):
            first, each, seq = tables[int(value)]
            mine = w == value
            k = np.searchsorted(first, r[mine], side="right") - 1
            out[mine] = seq[k] + (r[mine] - first[k]) // each[k]
        return pd.Series(out)

    # rank in the class: offsets of hashed parts of about 4096 pieces, then rows
    # within the part, so no class however large is sorted in one task
    parts = max(1, sum(demand.values()) // 4096)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "row_hash", "start"), F.lit(parts)) if place is None else F.shiftright("place", 12))
    counts = dealt.groupBy("width", "part").agg(F.count("*").alias("n"))
    starts = before(counts, "width", "part", "n").select(F.col("width").alias("at_width"), F.col("part").alias("at_part"), "before")
    own = Window.partitionBy("width", "part").orderBy("place", "doc_id", "start", "row_hash")
    ranked = dealt.withColumn("nth", F.row_number().over(own) - 1).join(starts, (F.col("width") == F.col("at_width")) & (F.col("part") == F.col("at_part")))
    placed = ranked.withColumn("sequence_id", sequence_of("width", F.col("before") + F.col("nth")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
