"""Drawn pairs of samples.

A draw that fetches its two vectors by itself moves draws x width numbers.
Here draws go as numbers to the tasks where groups of blocks meet, and a block
is sent a few times whatever the draws.  Distinct pairs are drawn by cells
(pairs of blocks) first and by pairs inside them, so draws of one cell are not
independent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distances import blocks, in_lines, keyed

#: Groups of draws of a kind; distinct pairs have each in one cell.
GROUPS = 256
#: Draws of a task, about, and rows of the small matrices that give their distances.
DRAWN, SQUARE = 1 << 22, 64
KINDS = ("ab", "aa", "bb")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def permuted(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a permutation of 0 .. n - 1, chosen by ``key``, sends the places.

    A Feistel network of six rounds over the next even number of bits, walked
    on until the result is below n.
    """
    return permuted_by(places, n, np.array([key]))[..., 0]


def permuted_by(places: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """The same for several permutations; the last axis is that of the keys."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    salts = [mixed(np.asarray(keys, dtype=np.uint64) * np.uint64(8) + np.uint64(r + 1)) for r in range(6)]

    def sent(y: np.ndarray, key: np.ndarray) -> np.ndarray:
        for salt in salts:
            low = y & mask
            y = (low << shift) | (((y >> shift) ^ mixed(low + salt[key])) & mask)
        return y

    every = np.arange(len(salts[0]))
    x = sent(np.asarray(places, dtype=np.uint64)[..., None], every)
    flat = x.reshape(-1)
    todo = np.flatnonzero(flat >= np.uint64(n))
    while len(todo):
        flat[todo] = y = sent(flat[todo], todo % len(every))
        todo = todo[y >= np.uint64(n)]
    return x.astype(np.int64)


def hashed(numbers: np.ndarray, *salts: int) -> np.ndarray:
    x = np.asarray(numbers).astype(np.uint64)
    for s in salts:
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + mixed(np.array([s + 1], dtype=np.uint64)))
    return x


def below(numbers: np.ndarray, n: int, *salts: int) -> np.ndarray:
    """A number from 0 .. n - 1 for each of the numbers."""
    return (hashed(numbers, *salts) % np.uint64(n)).astype(np.int64)


def triangle(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The t-th pair i < j in the order of j."""
    t = np.asarray(t, dtype=np.int64)
    j = ((1 + np.sqrt(1 + 8 * t.astype(np.float64))) / 2).astype(np.int64)
    j = np.where(j * (j - 1) // 2 > t, j - 1, np.where((j + 1) * j // 2 <= t, j + 1, j))
    return t - j * (j - 1) // 2, j


def _of(metric: Callable, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of x and j of y, from the matrix of the rows that occur."""
    a, i = np.unique(i, return_inverse=True)
    b, j = np.unique(j, return_inverse=True)
    return metric(x[a], y[b])[i, j]


def _row_by_row(metric: Callable, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of each row of x and the same row of y, from small matrices of always one size."""
    out = np.empty(len(x))
    for start in range(0, len(x), SQUARE):
        at = np.minimum(np.arange(start, start + SQUARE), len(x) - 1)
        out[start : start + SQUARE] = metric(x[at], y[at]).diagonal()[: len(x) - start]
    return out


class _Side:
    """The rows of one class that a task has, by their places."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r.start)
        n = np.array([r.n for r in rows], dtype=np.int64)
        self.start, self.first = np.array([r.start for r in rows], dtype=np.int64), np.cumsum(n) - n
        self.x = np.concatenate([np.frombuffer(r.data, dtype=np.float64).reshape(int(r.n), -1) for r in rows])

    def at(self, places: np.ndarray) -> np.ndarray:
        of = np.searchsorted(self.start, places, side="right") - 1
        return self.x[self.first[of] + places - self.start[of]]


def drawn_pairs(vectors: DataFrame, metric: Callable, draws: int, seed: int = 1, kinds: tuple[str, ...] = KINDS, packed: tuple | None = None) -> DataFrame:
    """draw, kind, grp, d: ``draws`` distances of each kind, of pairs drawn one by one with replacement (a sample may meet itself).

    Both places of a draw follow from its number, kind and ``seed`` alone, so
    every pair of samples is as likely in every draw.  A draw goes as two
    numbers to the task where the groups of its samples meet.  A group (grp)
    holds the draws that are equal modulo the number of groups.
    """
    if draws < 1:
        raise ValueError("draws must be positive")
    table, n = packed or blocks(keyed(vectors, "cls"))
    if any(n.get(c, 0) < 1 for k in kinds for c in k):
        raise ValueError("a sample of each class is needed")
    groups = min(GROUPS, draws)
    spark, asked = table.sparkSession, [no for no, k in enumerate(KINDS) if k in kinds]
    held, met = in_lines(table.filter(F.col("k").isin(sorted({c for k in kinds for c in k}))))
    first: dict[str, list] = {}  # of a class: groups and the places from which they are
    for r in held.groupBy("k", "grp").agg(F.min("start").alias("start")).orderBy("start").collect():  # a row a class and group
        first.setdefault(r["k"], []).append((r["start"], r["grp"]))
    where = {(g, h): no for no, m in enumerate(met) for g in m for h in m if g < h or g == h and m[g]}
    pairs = np.array(sorted(where), dtype=np.int64).reshape(-1, 2) @ np.array([1 << 32, 1])
    meeting = np.array([where[p] for p in sorted(where)], dtype=np.int64)
    parts = -(-draws * len(asked) // (len(met) * DRAWN))  # tasks of a meeting

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            draw = batch["id"].to_numpy()
            for no in asked:
                i, j = (below(draw, n[c], seed, no, side) for side, c in enumerate(KINDS[no]))
                g, h = (np.array([x[1] for x in first[c]])[np.searchsorted([x[0] for x in first[c]], z, side="right") - 1] for c, z in zip(KINDS[no], (i, j)))
                of = meeting[np.searchsorted(pairs, (np.minimum(g, h) << 32) + np.maximum(g, h))]
                yield pd.DataFrame({"task": (of * parts + draw % parts).astype(np.int32), "kind": np.int32(no), "draw": draw, "i": i, "j": j})

    drawn = spark.range(draws).mapInPandas(placed, "task int, kind int, draw long, i long, j long")
    sent = spark.createDataFrame([(g, no * parts + part) for no, m in enumerate(met) for g in m for part in range(parts)], "grp int, task int")
    dealt = held.join(F.broadcast(sent), "grp").select("task", F.lit(-1).alias("kind"), "k", "start", "n", "data")
    both = dealt.unionByName(drawn, allowMissingColumns=True).repartitionById(len(met) * parts, F.col("task")).sortWithinPartitions("task", "kind", "draw")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of a task: its blocks first, then draws as they come."""
        now, rows, sides = None, [], {}
        for batch in batches:
            for (task, no), f in batch.groupby(["task", "kind"]):
                if task != now:
                    now, rows, sides = task, [], {}
                if no < 0:
                    rows += list(f.itertuples())
                    continue
                sides = sides or {k: _Side([r for r in rows if r.k == k]) for k in {r.k for r in rows}}
                draw = f["draw"].to_numpy(np.int64)
                x, y = (sides[c].at(f[name].to_numpy(np.int64)) for c, name in zip(KINDS[no], "ij"))
                yield pd.DataFrame({"draw": draw, "kind": KINDS[no], "grp": (draw % groups).astype(np.int32), "d": _row_by_row(metric, x, y)})

    return both.mapInPandas(run, "draw long, kind string, grp int, d double")


def distinct_pairs(vectors: DataFrame, metric: Callable, draws: int, reduce: Callable, schema: str, groups: int = GROUPS, seed: int = 1) -> DataFrame:
    """What ``reduce`` (distances, rows i and j of the pairs, places of both blocks' rows) gives for each cell drawn, of about ``draws`` different pairs.

    ``vectors`` (sample_id, vec, place).  Blocks hold samples of all classes
    alike, so that which pairs are drawn says nothing about labels.  At most
    ``groups`` cells are drawn, more where they would be drawn to more than a
    quarter; each gives the same share of its pairs.  All cells are there if
    they are few, and all pairs if ``draws`` is their number.
    """
    table, sizes = blocks(vectors.select("sample_id", F.concat("vec", F.array(F.col("place").cast("double"))).alias("vec"), F.lit("all").alias("k")), seed=seed)
    n = sum(sizes.values())
    pairs, number = n * (n - 1) // 2, table.count()
    if not 0 < draws <= pairs:
        raise ValueError("more draws than pairs, or none")
    every = number * (number + 1) // 2
    taken = min(every, max(groups, -(-4 * draws * every // pairs)))
    share = min(1.0, draws / pairs * every / taken)

    @F.pandas_udf("i int, j int")
    def cell(ids: pd.Series) -> pd.DataFrame:
        t = permuted(ids.to_numpy(), every, seed * 7919)
        i, j = triangle(t)  # i < j, so j - 1 may be i: the cells with their own block
        return pd.DataFrame({"i": i.astype(np.int32), "j": (j - 1).astype(np.int32)})

    cells = vectors.sparkSession.range(taken).select(cell("id").alias("c")).select("c.*")
    block = lambda name, c: table.select(F.col("no").alias(name), F.col("n").alias(f"n{c}"), F.col("data").alias(f"data{c}"))
    met = cells.join(block("i", 1), "i").join(block("j", 2), "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x, y = (np.frombuffer(d, dtype=np.float64).reshape(m, -1) for d, m in ((r.data1, r.n1), (r.data2, r.n2)))
                held = r.n1 * (r.n1 - 1) // 2 if r.i == r.j else r.n1 * r.n2
                exact = share * held
                chance = float(hashed(np.array([r.i * 4_000_003 + r.j]), seed, 5)[0]) / 2.0**64
                m = min(held, int(np.floor(exact + 1e-9)) + int(chance < (exact + 1e-9) % 1.0 - 2e-9))
                if m < 1:
                    continue
                t = permuted(np.arange(m), held, seed * 104_729 + r.i * 1_009 + r.j)
                i, j = triangle(t) if r.i == r.j else (t // r.n2, t % r.n2)
                yield reduce(_of(metric, x[:, :-1], y[:, :-1], i, j), i, j, x[:, -1].astype(np.int64), y[:, -1].astype(np.int64))

    return met.mapInPandas(run, schema)
