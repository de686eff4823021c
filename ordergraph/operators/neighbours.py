"""Exact nearest neighbours and counts within a radius, by balls around pivots.

Vectors are dealt to the nearest of a bounded number of pivots; a ball's rows
are packed by shells of their distance to the pivot.  Shells meet by groups, as
blocks do, so what is sent does not follow how many rows ask.  A row's distance
to a shell is at least what the triangle inequality says, so a row is compared
only with those shells that can hold a neighbour.  Nothing is approximate: a shell is skipped when its bound is above the distance in question
by more than rounding can explain.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distances import blocks, gathered, kind_of, meetings, squared
from .graphs import cut_lineage, written
from .ordered import ranked

#: Rows of a ball that are aimed at, and of a shell at most (but for hashing).
BALL, SHELL = 256, 1024
#: Pivots at most, whatever the data; larger balls have more shells.
PIVOTS = 1024

KEY = ["k", "pivot", "shell", "part"]


class Balls(NamedTuple):
    """Packed shells (k, pivot, shell, part, lo, hi, n, ids, at, data, no), the pivots and the classes' sizes."""

    shells: DataFrame
    pivots: np.ndarray
    sizes: dict


def pivots_of(vectors: DataFrame, rows: int, seed: int = 0) -> np.ndarray:
    """The vectors of least hash, about one for BALL rows and at most PIVOTS."""
    most = max(1, min(PIVOTS, rows // BALL))
    drawn = vectors.select("vec", F.xxhash64("sample_id", F.lit(seed + 1)).alias("h"), "sample_id").orderBy("h", "sample_id").limit(most).collect()
    return np.array([r["vec"] for r in drawn], dtype=np.float64).reshape(len(drawn), -1)


def balls(vectors: DataFrame, packed: tuple | None = None) -> Balls:
    """The balls of vectors (sample_id, vec, k); ``packed``: their blocks, which give each row its place in its class."""
    table, sizes = packed or blocks(vectors)
    kind = kind_of(vectors)
    pivots = pivots_of(vectors, sum(sizes.values()))

    def nearest_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x = np.frombuffer(r.data, dtype=np.float64).reshape(r.n, -1)
                d = squared(x, pivots)
                own = d.argmin(axis=1)
                yield pd.DataFrame({"sample_id": np.frombuffer(r.ids, dtype=np.int64), "k": [r.k] * r.n, "at": r.start + np.arange(r.n), "vec": list(x), "pivot": own.astype(np.int32), "r": np.sqrt(d[np.arange(r.n), own])})

    rows = written(table.mapInPandas(nearest_pivot, f"sample_id long, k {kind}, at long, vec array<double>, pivot int, r double"))
    ball = rows.groupBy("k", "pivot").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n"))
    # shells of equal width; one that copies fill is cut by a hash
    wide = (F.col("hi") - F.col("lo")) / F.ceil(F.col("n") / F.lit(SHELL))
    nth = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("r") - F.col("lo")) / wide)).otherwise(0).cast("int")
    shelled = rows.join(ball, ["k", "pivot"]).select("sample_id", "k", "at", "vec", "pivot", "r", nth.alias("shell"))
    parts = shelled.groupBy("k", "pivot", "shell").agg(F.ceil(F.count("*") / F.lit(SHELL)).alias("parts"))
    dealt = shelled.join(parts, ["k", "pivot", "shell"]).withColumn("part", F.pmod(F.xxhash64("sample_id", F.lit(7)), F.col("parts")).cast("int")).drop("parts")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        data = np.stack([np.asarray(v, dtype=np.float64) for v in rows["vec"]])
        ids, at = (rows[c].to_numpy(np.int64).tobytes() for c in ("sample_id", "at"))
        key = [rows[c].iat[0] for c in KEY]
        return pd.DataFrame([(*key, rows["r"].min(), rows["r"].max(), len(rows), ids, at, data.tobytes())], columns=[*KEY, "lo", "hi", "n", "ids", "at", "data"])

    shells = dealt.groupBy(*KEY).applyInPandas(pack, f"k {kind}, pivot int, shell int, part int, lo double, hi double, n int, ids binary, at binary, data binary")
    kept = written(shells)
    order = cut_lineage(ranked(kept.select(*KEY), KEY, "nth")).select(*KEY, (F.col("nth") - 1).cast("int").alias("no"))
    return Balls(written(kept.join(order, KEY)), pivots, sizes)


def _rows(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(n, -1)


def _long(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


class Near:
    """A packed block or shell of a task: vectors, what stands for a distance of 0 to each row, and each row's limit."""

    def __init__(self, r, first: int, few: int = 0, beside: int = 0, at: np.ndarray | None = None) -> None:
        both = _rows(r.data, r.n)
        width = both.shape[1] - beside
        self.x, self.beside, self.ids, self.n = np.ascontiguousarray(both[:, :width]), both[:, width:], _long(r.ids), r.n
        self.zero = 1e-12 * ((r.start + np.arange(r.n) if at is None else at) + first + 1)
        self.limit = np.full(r.n, np.inf)
        self.best, self.who = np.full((r.n, few), np.inf), np.full((r.n, few), np.iinfo(np.int64).max)

    def found(self, i: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """Keeps the smallest of what each row has and the distances ``d`` of rows ``i`` to ``ids``."""
        few = self.best.shape[1]
        rows, of = np.unique(i, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(rows)), few), of])
        d, ids = np.concatenate([self.best[rows].ravel(), d]), np.concatenate([self.who[rows].ravel(), ids])
        order = np.lexsort((ids, d, of))
        nth = np.arange(len(of)) - np.searchsorted(of[order], np.arange(len(rows)))[of[order]]
        order = order[nth < few]
        self.best[rows], self.who[rows] = d[order].reshape(-1, few), ids[order].reshape(-1, few)
        self.limit[rows] = np.minimum(self.limit[rows], self.best[rows, -1])


class Screen:
    """Which pairs of rows of a task can lie within their limits, by products in single precision.

    These give a lower bound of a squared distance, by more than rounding can
    explain; only the pairs that it lets through are measured, one by one and
    in double precision, so that a pair's distance is the same wherever it is met.
    """

    def __init__(self, near: dict[int, Near]) -> None:
        self.near = near
        centre = next(iter(near.values())).x.mean(axis=0)
        top = max(float(np.abs(p.x - centre).max(initial=0.0)) for p in near.values())
        self.scale = 2.0 ** -float(np.clip(np.ceil(np.log2(top)), -500, 500)) if 0 < top < np.inf else 1.0
        self.right = {}
        for no, p in near.items():
            z = ((p.x - centre) * self.scale).astype(np.float32)
            size = np.einsum("ij,ij->i", z, z, dtype=np.float64) * (1 - (z.shape[1] + 16) * 2.0**-22)
            self.right[no] = np.ascontiguousarray(np.column_stack([z, np.ones(len(z)), size]).T, dtype=np.float32)
        self.of, self.left, self.place = None, None, np.empty(0, dtype=np.float32)

    def _low(self, r: int, s: int) -> np.ndarray:
        if self.of != r:
            z = self.right[r]
            self.of, self.left = r, np.ascontiguousarray(np.vstack([-2 * z[:-2], z[-1], z[-2]]).T)
        shape = len(self.left), self.right[s].shape[1]
        if self.place.size < shape[0] * shape[1]:
            self.place = np.empty(shape[0] * shape[1], dtype=np.float32)
        return np.matmul(self.left, self.right[s], out=self.place[: shape[0] * shape[1]].reshape(shape))

    def _limit(self, limit: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.nextafter((limit * self.scale**2 + 1e-30).astype(np.float32), np.float32(np.inf))

    def _let_through(self, r: int, s: int, limits: tuple) -> list[tuple] | None:
        """For both sides, rows and columns of the pairs whose lower bound is within the limit of that side's row; None where they are many."""
        if any(x is not None and np.isposinf(x).any() for x in limits):
            return None
        low, out = self._low(r, s), []
        for side, limit in enumerate(limits):
            at = np.zeros(0, dtype=np.int64) if limit is None else np.flatnonzero(low <= (self._limit(limit)[:, None] if side == 0 else self._limit(limit)))
            if len(at) > low.size // 64 + 4096:
                return None
            out.append(np.divmod(at, low.shape[1]))
        return out

    def pairs(self, r: int, s: int, limits: tuple, few: int = 0, counted: bool = False) -> Iterator[tuple]:
        """For both sides (r's rows, s's rows): asking rows, rows that they ask, and squared distances, of all pairs within the limits, or a bit beyond.

        ``limits``: of r's and of s's rows, or None.  With ``few`` only the smallest of each row are wanted.
        With ``counted`` pairs that are surely inside may be added to ``m`` and left out.
        """
        p, q = self.near[r], self.near[s]
        through = self._let_through(r, s, limits)
        d, wrong = _measured(p.x, q.x) if through is None else (None, None)
        for side, limit in enumerate(limits):
            if limit is None:
                continue
            a, b = (p, q) if side == 0 else (q, p)
            if through is None:
                one, error = (d, 2 * wrong) if side == 0 else (d.T, 2 * wrong.T)
                one = np.where(one == 0, b.zero[None, :], one)
                if r == s:
                    np.fill_diagonal(one, np.inf)
                if few and np.isposinf(limit).any():
                    limit = np.minimum(limit, _least(one, min(few, one.shape[1]))[:, -1] + error.max(axis=1))
                inside = one <= limit[:, None] + error
                if counted:
                    sure = one < limit[:, None] - error
                    a.m += sure.sum(axis=1)
                    inside &= ~sure
                i, j = np.nonzero(inside)
            else:
                i, j = through[side][:: 1 if side == 0 else -1]
            if r == s:
                i, j = i[i != j], j[i != j]
            if len(i):
                yield a, b, i, j, one_by_one(a.x, b.x, i, j, b.zero)


def one_by_one(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Squared distances of rows i of x and j of y; ``zero`` stands for 0."""
    d = np.empty(len(i))
    for s in range(0, len(i), 16_384):
        d[s : s + 16_384] = ((x[i[s : s + 16_384]] - y[j[s : s + 16_384]]) ** 2).sum(axis=1)
    return np.where(d == 0, zero[j], d)


def _measured(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances, and how far rounding may take them."""
    return squared(x, y), 1e-13 * ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :])


def _blur(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """How much farther than the root of their limit rows look, for rounding."""
    return 1e-6 * (np.sqrt((x * x).sum(axis=1)) + (np.sqrt((pivots * pivots).sum(axis=1)).max() if len(pivots) else 0.0))


def _least(d: np.ndarray, few: int) -> np.ndarray:
    """The few smallest of each row, in order."""
    m = min(few, d.shape[1])
    return np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1)


def _met(b: Balls, limited: DataFrame, begin, answer, give, schema: str, own_class: bool, counted: bool = False) -> DataFrame:
    """What ``give`` makes of the shells of a task after ``answer`` had the pairs of rows that cannot be ruled out.

    ``limited``: shells with ``limit``, a squared distance for each row.  A
    shell does not meet itself: it was looked at before.
    """
    pivots = b.pivots

    def run(one: list, two: list) -> Iterator[pd.DataFrame]:
        read = {r.no: r for r in [*one, *two]}
        near = {no: begin(r) for no, r in read.items()}
        screen = Screen(near) if near else None
        compared = {no: np.zeros(r.n, dtype=np.int64) for no, r in read.items()}
        blur = {no: _blur(p.x, pivots) for no, p in near.items()}

        def asking(asks, other) -> np.ndarray:
            """Limits of the rows; below all distances where the shell is ruled out."""
            p = near[asks.no]
            far, reach = np.sqrt(((p.x - pivots[other.pivot]) ** 2).sum(axis=1)), np.sqrt(p.limit) + blur[asks.no]
            ask = (far - other.hi <= reach) & (other.lo - far <= reach)
            compared[asks.no][ask] += other.n
            return np.where(ask, p.limit, -np.inf) if ask.any() else None

        for r in one:
            for s in two:
                if s.no <= r.no or r.grp == s.grp and not r.own or own_class and r.k != s.k:
                    continue
                limits = asking(r, s), asking(s, r)
                if any(x is not None for x in limits):
                    answer(screen.pairs(r.no, s.no, limits, counted=counted))
        for no, r in read.items():
            yield give(r, near[no], compared[no])

    return meetings(limited, run, schema, "within" if own_class else "all")


def nearest(b: Balls, few: int, first: dict) -> DataFrame:
    """sample_id, k, best (the ``few`` smallest squared distances to others of the class, in order), compared.

    ``first``: what is added to places of a class; a distance of 0 counts as
    1e-12 times the other's place.  ``compared`` tells how many distances were computed.
    """
    kind = b.shells.schema["k"].dataType.simpleString()

    def begin(r) -> Near:
        return Near(r, first[r.k], few, at=_long(r.at))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                p = begin(r)
                note(Screen({0: p}).pairs(0, 0, (p.limit, None), few))
                out.append((p.best[:, -1].tobytes(), p.best.tobytes()))
            yield batch.assign(limit=[o[0] for o in out], best=[o[1] for o in out])

    def note(found: Iterator[tuple]) -> None:
        for p, q, i, j, d in found:
            p.found(i, d, q.ids[j])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in b.shells.schema)
    begun = written(b.shells.mapInPandas(own, f"{fields}, limit binary, best binary"))

    def limited(r) -> Near:
        p = begin(r)
        p.limit = np.frombuffer(r.limit, dtype=np.float64).copy()
        return p

    def give(r, p: Near, compared: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"sample_id": p.ids, "k": [r.k] * r.n, "best": list(p.best), "compared": compared})

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield pd.DataFrame({"sample_id": _long(r.ids), "k": [r.k] * r.n, "best": list(np.frombuffer(r.best, dtype=np.float64).reshape(r.n, few)), "compared": r.n})

    schema = f"sample_id long, k {kind}, best array<double>, compared long"
    every = begun.mapInPandas(known, schema).unionByName(_met(b, begun, limited, note, give, schema, True))
    # at most ``few`` numbers a row and meeting of groups
    return every.groupBy("sample_id", "k").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, few).alias("best"), F.sum("compared").alias("compared"))


def within_radius(b: Balls, radius: DataFrame, first: dict) -> DataFrame:
    """sample_id, m (samples of any class within the squared radius, itself left out), compared.

    ``radius``: sample_id, k, radius.
    """
    packed = b.shells.select(*KEY, "ids")

    def ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids = _long(r.ids)
                yield pd.DataFrame({"k": [r.k] * len(ids), "pivot": np.int32(r.pivot), "shell": np.int32(r.shell), "part": np.int32(r.part), "nth": np.arange(len(ids)), "sample_id": ids})

    kind = b.shells.schema["k"].dataType.simpleString()
    named = packed.mapInPandas(ids_of, f"k {kind}, pivot int, shell int, part int, nth int, sample_id long")
    of = named.join(radius.select("sample_id", "radius"), "sample_id").groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "radius"))), lambda x: x["radius"]).alias("limit"))  # a shell's rows
    limited = b.shells.join(of, KEY)

    def bytes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(limit=[np.asarray(v, dtype=np.float64).tobytes() for v in batch["limit"]])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in b.shells.schema)
    limited = written(limited.mapInPandas(bytes_of, f"{fields}, limit binary"))

    def begin(r) -> Near:
        p = Near(r, first[r.k], at=_long(r.at))
        p.limit, p.m = np.frombuffer(r.limit, dtype=np.float64), np.zeros(r.n, dtype=np.int64)
        return p

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                p = begin(r)
                add_inside(Screen({0: p}).pairs(0, 0, (p.limit, None), counted=True))
                yield give(r, p, np.full(r.n, r.n))

    def give(r, p: Near, compared: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"sample_id": p.ids, "m": p.m, "compared": compared})

    schema = "sample_id long, m long, compared long"
    every = limited.mapInPandas(own, schema).unionByName(_met(b, limited, begin, add_inside, give, schema, False, True))
    return every.groupBy("sample_id").agg(F.sum("m").alias("m"), F.sum("compared").alias("compared"))


def add_inside(found: Iterator[tuple]) -> None:
    """Adds to each row's ``m`` the pairs within its limit."""
    for p, _, i, _, d in found:
        p.m += np.bincount(i[d <= p.limit[i]], minlength=p.n)
