"""Two-sample statistics of classes a and b: projections, resampling and information.

Vectors are (sample_id, vec, cls).  Sums over samples are made in tasks by matrix
products and added up by Spark; the driver solves eigenproblems whose size is
the vectors' width.  Resampling needs no tables of labels: a keyed permutation
of the places 0 .. n - 1 tells each task the labels of its own samples.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distances import Cell, beside, blocks, cells, energy, hellinger, keyed, kind_of, squared, unit
from .draws import KINDS, distinct_pairs, drawn_pairs, permuted, permuted_by
from .graphs import cut_lineage, written
from .histograms import concatenate
from .neighbours import Balls, Near, Screen, add_inside, balls, nearest, within_radius

SUMS = "r int, c int, v double"


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in batch["vec"]])


def _long(kind: int, m: np.ndarray) -> pd.DataFrame:
    r, c = np.indices(m.shape)
    return pd.DataFrame({"kind": kind, "r": r.ravel().astype(np.int32), "c": c.ravel().astype(np.int32), "v": m.ravel()})


def _total(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums by kind and place, as matrices (their sizes do not follow the data)."""
    out: dict[int, np.ndarray] = {}
    got = rows.groupBy("kind", "r", "c").agg(F.sum("v").alias("v")).toPandas()
    for kind, g in got.groupby("kind"):
        m = np.zeros((g["r"].max() + 1, g["c"].max() + 1))
        m[g["r"], g["c"]] = g["v"]
        out[int(kind)] = m
    return out


def covariance(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and sample covariance of all vectors, in two passes."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b)
                yield pd.concat([_long(0, np.array([[len(x)]])), _long(1, x.sum(axis=0)[None, :])])

    first = _total(vectors.select("vec").mapInPandas(sums, "kind int, " + SUMS))
    n, mean = int(first[0][0, 0]), first[1][0] / first[0][0, 0]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = _matrix(b) - mean
                yield _long(0, z.T @ z)

    return n, mean, _total(vectors.select("vec").mapInPandas(products, "kind int, " + SUMS))[0] / max(n - 1, 1)


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and vectors whose largest component is positive."""
    values, vectors = np.linalg.eigh(cov)
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1, 1)


def kept_axes(values: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.flatnonzero(values > tolerance * np.median(values))
    return keep if len(keep) else np.array([values.argmax()])


def transformed(vectors: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(vec=list(f(_matrix(b))))

    return vectors.mapInPandas(run, vectors.schema)


def project(vectors: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Vectors on the axes of the pooled covariance with a variance above
    ``tolerance`` of the median, each axis moved so that its least value is 1e-12."""
    _, mean, cov = covariance(vectors)
    values, axes = eigen(cov)
    axes = axes[:, kept_axes(values, tolerance)]
    turned = transformed(vectors, lambda x: (x - mean) @ axes)

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b).min(axis=0)
                yield pd.DataFrame({"c": np.arange(len(x), dtype=np.int32), "v": x})

    low = {r["c"]: r["v"] for r in turned.select("vec").mapInPandas(least, "c int, v double").groupBy("c").agg(F.min("v").alias("v")).collect()}
    shift = np.maximum(-np.array([low[c] for c in range(axes.shape[1])]), 0.0) + 1e-12

    def moved(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ axes + shift
        z[z.sum(axis=1) <= 0] = np.eye(1, z.shape[1])
        return z

    return transformed(vectors, moved)


def principal(vectors: DataFrame, mode: str = "cutoff", dim: int = 32, share: float = 0.99, tolerance: float = 1e-6) -> DataFrame:
    """Vectors on their first principal axes: all above the cutoff, at most ``dim``, or enough for the ``share`` of variance."""
    if mode not in ("cutoff", "dim", "variance"):
        raise ValueError(f"not a mode: {mode}")
    n, mean, cov = covariance(vectors)
    values, axes = (x[..., ::-1] for x in eigen(cov))
    if n <= 2:
        return transformed(vectors, lambda x: x - mean)
    r = max(1, int((values > np.median(values) * tolerance).sum()))
    if mode == "dim":
        r = min(dim, r)
    elif mode == "variance":
        r = int(np.clip(np.searchsorted(np.cumsum(values[:r]) / values[:r].sum(), share) + 1, 1, r))
    return transformed(vectors, lambda x: (x - mean) @ axes[:, :r])


def total(first: DataFrame, second: DataFrame) -> DataFrame:
    """Samples of several observables at once: their vectors one after another."""
    return cut_lineage(concatenate(first, second))  # read by several passes, joined once


def projected_energy(vectors: DataFrame, metric: Callable = hellinger, key: str = "cls", tolerance: float = 1e-6) -> DataFrame:
    return energy(project(vectors, tolerance), metric, key)


def numbered(vectors: DataFrame, seed: int = 0) -> tuple[DataFrame, dict]:
    """sample_id, cls, vec and at, the place in the class, in a random order; and the classes' sizes."""
    packed, sizes = blocks(keyed(vectors, "cls"), seed=seed)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x = np.frombuffer(r.data, dtype=np.float64).reshape(r.n, -1)
                yield pd.DataFrame({"sample_id": np.frombuffer(r.ids, dtype=np.int64), "cls": [r.k] * r.n, "vec": list(x), "at": r.start + np.arange(r.n)})

    return packed.mapInPandas(rows, "sample_id long, cls string, vec array<double>, at long"), sizes


def subsample(vectors: DataFrame, most: int, seed: int = 1) -> DataFrame:
    """At most ``most`` random samples of each class."""
    return numbered(vectors, seed)[0].filter(F.col("at") < most).drop("at")


def mc_apply(vectors: DataFrame, metric: Callable, draws: int, seed: int = 1, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """draw, kind, d: distances of pairs drawn with replacement, of the ``kinds`` (ab, aa and bb)."""
    return drawn_pairs(vectors, metric, draws, seed, kinds).drop("grp")


def mc_energy(vectors: DataFrame, metric: Callable, draws: int, seed: int = 1) -> DataFrame:
    """energy, distinguishability and its deviation (delta method) from drawn pairs.

    The variance of a mean is that of the means of groups of draws.
    """
    each = drawn_pairs(vectors, metric, draws, seed).groupBy("kind", "grp").agg(F.sum("d").alias("s"), F.count("*").alias("n"))
    of = lambda k, c: F.sum(F.when(F.col("kind") == k, c))
    x, n = F.col("s"), F.col("n").cast("double")
    sums = {f"{name}_{k}": of(k, c) for k in ("ab", "aa", "bb") for name, c in (("s", x), ("n", n), ("g", F.lit(1.0)), ("ss", x * x), ("sn", x * n), ("nn", n * n))}
    t = each.agg(*[c.alias(name) for name, c in sums.items()])
    c = lambda name, k: F.col(f"{name}_{k}")
    mean = {k: c("s", k) / c("n", k) for k in ("ab", "aa", "bb")}
    spread = lambda k: c("ss", k) - 2 * mean[k] * c("sn", k) + mean[k] ** 2 * c("nn", k)
    v = {k: F.when(c("g", k) > 1, F.greatest(spread(k), F.lit(0.0)) * c("g", k) / (c("g", k) - 1) / c("n", k) ** 2) for k in mean}
    e, den = 2 * mean["ab"] - mean["aa"] - mean["bb"], 2 * mean["ab"]
    var = (4 * v["ab"] + v["aa"] + v["bb"]) / den**2 + e * e * 4 * v["ab"] / den**4 - 2 * e * 4 * v["ab"] / den**3
    return t.select(e.alias("energy"), F.when(den == 0, 0.0).otherwise(e / den).alias("distinguishability"), F.when(den == 0, 0.0).otherwise(F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"))


def digamma(x: Column) -> Column:
    """For whole numbers from 1: the series at x + 10, brought down."""
    y = x + 10.0
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    return series - sum((1 / (x + float(i)) for i in range(10)), F.lit(0.0))


def neighbour_information(vectors: DataFrame, k: int = 5, projected: bool = True, tolerance: float = 1e-6, search: str = "cells", packed: tuple | None = None) -> DataFrame:
    """information: mutual information of vector and label from the k-th neighbours
    of the own class, over the label's entropy, in [0, 1].

    A distance of 0 counts as 1e-12 times the other sample's place, so that
    equal samples are not all at one distance.  ``search``: "cells" (all pairs
    of blocks) or "balls" (shells that can hold no neighbour are skipped), with equal results.
    """
    if search not in ("balls", "cells"):
        raise ValueError(f"not a search: {search}")
    v = keyed(project(vectors, tolerance) if projected else vectors, "cls")
    packed = packed or blocks(v)
    n = packed[1]
    if min(n.get("a", 0), n.get("b", 0)) < 2:
        raise ValueError("two samples of each class are needed")
    few = min(k, n["a"] - 1, n["b"] - 1)
    if search == "balls":
        m = neighbour_counts(balls(v, packed), few)
    else:
        m = _counts_by_cells(v, packed, few)
    size = n["a"] + n["b"]
    entropy = -sum(x / size * np.log(x / size) for x in (n["a"], n["b"]))
    of_n = sum((F.lit(x / size) * digamma(F.lit(float(x))) for x in (n["a"], n["b"])), F.lit(0.0))
    mi = digamma(F.lit(float(size))) - of_n + digamma(F.lit(float(few))) - F.avg(digamma(F.col("m").cast("double")))
    return m.agg(F.greatest(F.least(mi / F.lit(float(entropy)), F.lit(1.0)), F.lit(0.0)).alias("information"))


def _found(b: Balls, few: int) -> tuple[DataFrame, dict]:
    first = {c: b.sizes["a"] if c == "b" else 0 for c in b.sizes}
    radius = (F.col("best")[few - 1] + 1e-14).alias("radius")
    return written(nearest(b, few, first).select("sample_id", "k", radius, F.col("compared").alias("searched"))), first


def neighbour_counts(b: Balls, few: int) -> DataFrame:
    """sample_id, m: samples of both classes within the distance of the ``few``-th neighbour of the own class."""
    found, first = _found(b, few)
    return within_radius(b, found, first).select("sample_id", "m")


def neighbour_work(vectors: DataFrame, k: int = 5) -> DataFrame:
    """searched, counted: the shares of all distances that finding neighbours and counting within their radius compute."""
    b = balls(keyed(vectors, "cls"))
    found, first = _found(b, min(k, min(b.sizes.values()) - 1))
    own, every = float(sum(x * x for x in b.sizes.values())), float(sum(b.sizes.values()) ** 2)
    counted = within_radius(b, found, first).agg((F.sum("compared") / every).alias("counted"))
    return found.agg((F.sum("searched") / own).alias("searched")).join(F.broadcast(counted))  # one row each


def _counts_by_cells(v: DataFrame, packed: tuple, few: int) -> DataFrame:
    """sample_id, m: the same counts from all pairs of blocks."""
    n = packed[1]
    first = lambda c: n["a"] if c == "b" else 0

    def nearest(rows: list, pairs: Iterator) -> Iterator[pd.DataFrame]:
        near = {r.no: Near(r, first(r.k), few) for r in rows}
        for p, q, i, j, d in _screened(near, pairs, few):
            p.found(i, d, q.ids[j])
        for p in near.values():
            yield pd.DataFrame({"sample_id": p.ids, "best": list(p.best)})

    near = cells(v, None, nearest, "sample_id long, best array<double>", "within", packed=packed)
    # at most ``few`` numbers a sample and meeting of groups
    radius = near.groupBy("sample_id").agg((F.array_sort(F.flatten(F.collect_list("best")))[few - 1] + 1e-14).alias("radius"))
    with_radius = (beside(packed[0], radius, "radius"), n)

    def count(rows: list, pairs: Iterator) -> Iterator[pd.DataFrame]:
        near = {r.no: Near(r, first(r.k), beside=1) for r in rows}
        for p in near.values():
            p.limit, p.m = p.beside[:, 0], np.zeros(p.n, dtype=np.int64)
        add_inside(_screened(near, pairs, counted=True))
        for p in near.values():
            yield pd.DataFrame({"sample_id": p.ids, "m": p.m})

    return cells(v, None, count, "sample_id long, m long", "all", beside=1, packed=with_radius).groupBy("sample_id").agg(F.sum("m").alias("m"))


def _screened(near: dict[int, Near], pairs: Iterator, few: int = 0, counted: bool = False) -> Iterator[tuple]:
    """Asking block, other block, rows of both and distances, of all pairs of rows within the asking rows' limits."""
    screen = Screen(near) if near else None
    for r, s in pairs:
        yield from screen.pairs(r.no, s.no, (near[r.no].limit, None if r.no == s.no else near[s.no].limit), few, counted)


def poisson_weights(ids: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each sample is in each resample: Poisson numbers of mean 1, by a hash of id, draw and seed."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, draws + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    below = np.cumsum(np.exp(-1.0) / np.array([float(math.factorial(k)) for k in range(18)]))
    return np.searchsorted(below, u, side="right")


def _digammas(x: np.ndarray) -> np.ndarray:
    y = np.asarray(x, dtype=np.float64) + 10.0
    series = np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    return series - sum(1 / (y - 10.0 + i) for i in range(10))


def _enough_neighbours(k: int, samples: int, draws: int) -> int:
    """So many neighbours that their weights hardly ever add up to less than k in any resample."""
    m = k
    while samples * draws * sum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in range(k)) > 1e-3:
        m += 1
    return m


def weighted_information(vectors: DataFrame, draws: int, k: int = 5, seed: int = 1) -> DataFrame:
    """draw, information: of resamples that hold a sample as often as its Poisson weight says.

    Nothing is drawn or copied: weights follow from ids wherever a cell needs
    them.  Each sample keeps its nearest neighbours of the class, as many as
    every resample needs for its k-th; a radius for each resample comes from
    these, and one more pass over the cells adds up the weights inside.
    """
    v = keyed(vectors, "cls")
    packed = blocks(v)
    n = packed[1]
    if min(n.get("a", 0), n.get("b", 0)) < 2:
        raise ValueError("two samples of each class are needed")
    few = min(k, n["a"] - 1, n["b"] - 1)
    first = lambda c: n["a"] if c == "b" else 0

    @F.pandas_udf("array<int>")
    def picks(sample: pd.Series, near: pd.Series) -> pd.Series:
        """For each resample: the neighbour at which the weights, without one of the sample itself, reach k; -1 where they don't."""
        out = []
        for s, rows in zip(sample, near):
            ids = np.array([r["id"] for r in rows], dtype=np.int64)
            w = poisson_weights(ids, draws, seed)
            w[ids == s] = np.maximum(w[ids == s] - 1, 0)
            held = np.cumsum(w, axis=0)
            at = (held < few).sum(axis=0)
            at = np.where(at < len(ids), at, -1)
            out.append(np.where(held[-1] > 0, at, len(ids) - 1) if len(ids) >= most else at)
        return pd.Series(out)

    size, most = _enough_neighbours(few, n["a"] + n["b"], draws), max(n.values())
    while True:
        size = min(size, most)

        def nearest(rows: list, pairs: Iterator, size: int = size) -> Iterator[pd.DataFrame]:
            near, pairs = {r.no: Near(r, first(r.k), size) for r in rows}, list(pairs)
            for p in (near[r.no] for r, s in pairs if r.no == s.no):
                p.found(np.arange(p.n), p.zero, p.ids)  # a sample may be in a resample more than once
            for p, q, i, j, d in _screened(near, pairs, size):
                p.found(i, d, q.ids[j])
            for p in near.values():
                row, nth = np.nonzero(np.isfinite(p.best))
                start = np.searchsorted(row, np.arange(p.n + 1))
                d, ids = p.best[row, nth], p.who[row, nth]
                for n in range(0, p.n, 1024):
                    each = range(n, min(n + 1024, p.n))
                    yield pd.DataFrame({"sample_id": p.ids[n : n + 1024], "d": [d[start[m] : start[m + 1]] for m in each], "id": [ids[start[m] : start[m + 1]] for m in each]})

        near = cells(v, None, nearest, "sample_id long, d array<double>, id array<long>", "within", packed=packed)
        near = near.select("sample_id", F.arrays_zip("d", "id").alias("near"))
        # at most ``size`` numbers a sample and meeting of groups
        near = near.groupBy("sample_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, size).alias("near"))
        found = cut_lineage(near.select("sample_id", F.transform("near", lambda r: r["d"]).alias("d"), picks("sample_id", "near").alias("picks")))
        short = found.filter(F.array_contains("picks", -1))
        if size == most or short.isEmpty():
            break
        size *= 2
    # radii lie beside vectors as the neighbours' distances and the place of each resample's radius among them,
    # several places in one whole number
    bits = size.bit_length()
    fit = 52 // bits
    beside = size - (-draws // fit)
    direct = beside >= draws  # few resamples, or many neighbours
    beside = draws if direct else beside

    @F.pandas_udf("array<double>")
    def packed_radii(d: pd.Series, picks: pd.Series) -> pd.Series:
        near = np.stack([np.r_[x, np.full(size - len(x), np.inf)] for x in d]) + 1e-14
        at = np.stack(picks.to_numpy()).astype(np.int64)
        at[at < 0] = size  # where a class's weights do not reach k, all of it is inside
        if direct:
            return pd.Series(list(np.take_along_axis(np.c_[near, np.full(len(d), np.inf)], at, axis=1)))
        at = np.pad(at, ((0, 0), (0, (beside - size) * fit - draws)))
        places = (at.reshape(len(d), -1, fit) << (bits * np.arange(fit))).sum(axis=2)
        return pd.Series(list(np.concatenate([near, places.astype(np.float64)], axis=1)))

    def radii(x: np.ndarray) -> np.ndarray:
        if direct:
            return x
        places = x[:, size:].astype(np.int64)[:, :, None] >> (bits * np.arange(fit)) & ((1 << bits) - 1)
        return np.take_along_axis(np.c_[x[:, :size], np.full(len(x), np.inf)], places.reshape(len(x), -1)[:, :draws], axis=1)

    known = found.select("sample_id", packed_radii("d", "picks").alias("radius"))
    with_radius = cut_lineage(v.join(known, "sample_id").select("sample_id", "k", F.concat("vec", "radius").alias("vec")))

    def count(rows: list, pairs: Iterator) -> Iterator[pd.DataFrame]:
        near, pairs = {r.no: Near(r, first(r.k), beside=beside) for r in rows}, list(pairs)
        for p in near.values():
            p.limit, p.m = np.empty(p.n), np.zeros((p.n, draws), dtype=np.int32)
            for n in range(0, p.n, 1024):
                p.limit[n : n + 1024] = radii(p.beside[n : n + 1024]).max(axis=1)
            p.weight = poisson_weights(p.ids, draws, seed).astype(np.uint8)  # at most 18
        for p, q, i, j, d in _screened(near, pairs):
            order = np.argsort(i, kind="stable")
            i, j, d = i[order], j[order], d[order]
            for start in range(0, len(i), 16_384):
                a, b, c = (x[start : start + 16_384] for x in (i, j, d))
                first_of = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                r = np.repeat(radii(p.beside[a[first_of]]), np.diff(np.r_[first_of, len(a)]), axis=0)
                p.m[a[first_of]] += np.add.reduceat(np.where(c[:, None] <= r, q.weight[b], 0), first_of, axis=0, dtype=np.int32)
        for p in (near[r.no] for r, s in pairs if r.no == s.no):
            for n in range(0, p.n, 1024):
                w, inside = p.weight[n : n + 1024], p.zero[n : n + 1024, None] <= radii(p.beside[n : n + 1024])
                p.m[n : n + 1024] += np.where(inside, w, 0).astype(np.int32) - (w > 0)  # the sample itself, once
        for r in rows:
            p = near[r.no]
            for n in range(0, p.n, 1024):
                yield pd.DataFrame({"sample_id": p.ids[n : n + 1024], "cls": r.k, "m": list(p.m[n : n + 1024])})

    m = cells(with_radius, None, count, "sample_id long, cls string, m array<int>", "all", beside=beside).groupBy("sample_id", "cls").agg(F.array(*[F.sum(F.col("m")[r]) for r in range(draws)]).alias("m"))

    def sums(batches):
        for batch in batches:
            if len(batch):
                w = poisson_weights(batch["sample_id"].to_numpy(np.int64), draws, seed)
                of = np.stack(batch["m"].to_numpy())
                psi = (w * _digammas(np.maximum(of, 1))).sum(axis=0)
                a = (batch["cls"] == "a").to_numpy()
                yield pd.DataFrame({"draw": np.arange(draws), "psi": psi, "a": w[a].sum(axis=0), "b": w[~a].sum(axis=0)})

    each = m.mapInPandas(sums, "draw long, psi double, a long, b long").groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("psi", "a", "b")]).filter("a > 0 and b > 0")
    size_, of = F.col("a") + F.col("b"), lambda c: F.col(c) / (F.col("a") + F.col("b"))
    entropy = -(of("a") * F.log(of("a")) + of("b") * F.log(of("b")))
    mi = digamma(size_.cast("double")) - of("a") * digamma(F.col("a").cast("double")) - of("b") * digamma(F.col("b").cast("double")) + digamma(F.lit(float(few))) - F.col("psi") / size_
    return each.select("draw", F.greatest(F.least(mi / entropy, F.lit(1.0)), F.lit(0.0)).alias("information"))


def bootstrap_information(vectors: DataFrame, draws: int, k: int = 5, most: int | None = None, mode: str = "cutoff", dim: int = 32, share: float = 0.99, seed: int = 1, form: str = "weights") -> DataFrame:
    """information, std over resamples of vectors projected once.

    ``form``: "weights" (Poisson weights, all draws in one pass) or "copies"
    (each resample drawn with replacement within each class, a pass for each).
    """
    if draws < 1 or most is not None and most < 2 or form not in ("weights", "copies"):
        raise ValueError("draws must be positive, classes hold two samples, and the form be weights or copies")
    v = project(vectors)
    v = v if most is None else subsample(v, most, seed)
    v = v if mode == "cutoff" else principal(v, mode, dim, share)
    if form == "weights":
        return weighted_information(cut_lineage(v), draws, k, seed).agg(F.avg("information").alias("information"), F.stddev_samp("information").alias("std"))
    rows, n = numbered(v, seed)
    rows = cut_lineage(rows)
    every = None
    for draw in range(draws):
        size = F.when(F.col("cls") == "a", F.lit(n["a"])).otherwise(F.lit(n["b"]))
        picks = rows.select("cls", F.col("at").alias("nth"), F.pmod(F.xxhash64("cls", "at", F.lit(draw), F.lit(seed)), size).cast("long").alias("at"))
        again = picks.join(rows.select("cls", "at", "vec"), ["cls", "at"]).select(F.xxhash64("cls", "nth").alias("sample_id"), "cls", "vec")
        one = neighbour_information(cut_lineage(again), k, projected=False)
        every = one if every is None else every.unionByName(one)
    return every.agg(F.avg("information").alias("information"), F.stddev_samp("information").alias("std"))


def states(vectors: DataFrame, digits: int, key: str = "cls") -> DataFrame:
    """Counts of the classes' rounded unit vectors."""
    scale = float(10**digits)
    q = vectors.withColumn("unit", unit(F.col("vec"))).withColumn("state", F.transform("unit", lambda x: F.rint(x * scale).cast("long")))
    return q.groupBy(F.col(key).alias("k"), "state").agg(F.count("*").alias("n"))


def state_variation(vectors: DataFrame, digits: int, key: str = "cls") -> DataFrame:
    """Total variation between the classes' distributions of whole states, and
    the accuracy of the best guess."""
    n = states(vectors, digits, key)
    total = n.groupBy("k").agg(F.sum("n").alias("total"))
    p = n.join(total, "k").select("k", "state", (F.col("n") / F.col("total")).alias("p"))
    a, b = (p.filter(F.col("k") == c).select("state", F.col("p").alias(f"p_{c}")) for c in ("a", "b"))
    d = a.join(b, "state", "full").agg((0.5 * F.sum(F.abs(F.coalesce("p_a", F.lit(0.0)) - F.coalesce("p_b", F.lit(0.0))))).alias("distinguishability"))
    return d.withColumn("accuracy", (1 + F.col("distinguishability")) / 2)


def state_bias(vectors: DataFrame, digits: int, splits: int = 20, seed: int = 1) -> DataFrame:
    """distinguishability by whole rounded states, the mean and deviation of what
    random halves of one class show, and the difference in [0, 1], with accuracies."""
    scale = float(10**digits)
    state = F.xxhash64(F.transform(unit(F.col("vec")), lambda x: F.rint(x * scale).cast("long")))
    rows, n = numbered(vectors, seed)
    if min(n.values(), default=0) < 2:
        raise ValueError("two samples of each class are needed")
    rows = cut_lineage(rows.select("cls", "at", state.alias("state")))

    @F.pandas_udf("array<int>")
    def halves(cls: pd.Series, at: pd.Series) -> pd.Series:
        out = np.zeros((len(at), splits), dtype=np.int32)
        for c in cls.unique():
            mine, half = (cls == c).to_numpy(), n[c] // 2
            for s in range(splits):
                place = permuted(at[mine].to_numpy(), n[c], seed * 100_003 + s)
                out[mine, s] = np.where(place < half, 1, np.where(place < 2 * half, 2, 0))
        return pd.Series(list(out))

    split = rows.select("cls", "state", F.posexplode(halves("cls", "at")).alias("split", "half")).filter("half > 0").groupBy("cls", "split", "state").agg(*[F.sum(F.when(F.col("half") == h, 1).otherwise(0)).alias(f"n{h}") for h in (1, 2)])
    half_of = F.when(F.col("cls") == "a", F.lit(n["a"] // 2)).otherwise(F.lit(n["b"] // 2))
    bias = split.groupBy("cls", "split").agg((F.sum(F.abs(F.col("n1") - F.col("n2")) / half_of) / 2).alias("tv")).agg(F.avg("tv").alias("bias_mean"), F.stddev_samp("tv").alias("bias_std"))
    p = rows.groupBy("state").agg(*[F.sum(F.when(F.col("cls") == c, 1.0 / n[c]).otherwise(0.0)).alias(c) for c in ("a", "b")])
    tv = p.agg((F.sum(F.abs(F.col("a") - F.col("b"))) / 2).alias("distinguishability"))
    out = tv.join(F.broadcast(bias)).withColumn("debiased", F.greatest(F.least(F.col("distinguishability") - F.col("bias_mean"), F.lit(1.0)), F.lit(0.0)))
    return out.select("distinguishability", ((1 + F.col("distinguishability")) / 2).alias("accuracy"), "bias_mean", "bias_std", "debiased", ((1 + F.col("debiased")) / 2).alias("debiased_accuracy"))


def _first_halves(place: np.ndarray, half: int, permutations: int, seed: int) -> np.ndarray:
    """Whether each permutation sends the places, of twice ``half``, to the first half; column 0: without any."""
    out = np.empty((len(place), permutations + 1), dtype=bool)
    out[:, 0] = place < half
    for p in range(0, permutations, 64):
        keys = seed * 1_000_003 + np.arange(p, min(permutations, p + 64))
        out[:, 1 + p : 1 + p + len(keys)] = permuted_by(place, 2 * half, keys) < half
    return out


def _labels(at: np.ndarray, cls: object, half: int, permutations: int, seed: int) -> np.ndarray:
    """True for the first side, by sample and permutation; column 0 has the classes themselves."""
    return _first_halves(at + (half if cls == "b" else 0), half, permutations, seed)


#: Bytes of labels that a task keeps.
LABELS = 64 << 20


def _tested(sums: DataFrame, permutations: int, by: tuple[str, ...] = ()) -> DataFrame:
    """observed, p, z_emp, z_coll, null_mean, null_std from sums by permutation (perm, aa, ab, bb, n_aa, n_ab, n_bb)."""
    s = sums.groupBy(*by, "perm").agg(*[F.sum(c).alias(c) for c in ("aa", "ab", "bb", "n_aa", "n_ab", "n_bb")])
    mean = {k: F.when(F.col(f"n_{k}") > 0, F.col(k) / F.col(f"n_{k}")).otherwise(0.0) for k in ("aa", "ab", "bb")}
    stat = cut_lineage(s.select(*by, "perm", F.when(mean["ab"] == 0, 0.0).otherwise((2 * mean["ab"] - mean["aa"] - mean["bb"]) / (2 * mean["ab"])).alias("D")))
    seen = stat.filter("perm = 0").select(*by, F.col("D").alias("observed"))
    both = stat.filter("perm > 0").join(seen, list(by)) if by else stat.filter("perm > 0").join(F.broadcast(seen))  # one row
    out = both.groupBy(*by, "observed").agg(
        # rounding alone must not tell equal statistics apart
        ((F.sum(F.when(F.col("D") >= F.col("observed") - 1e-12, 1).otherwise(0)) + 1) / F.lit(permutations + 1.0)).alias("p"),
        F.avg("D").alias("null_mean"),
        F.stddev_samp("D").alias("null_std"),
    )

    @F.pandas_udf("double")
    def upper(p: pd.Series) -> pd.Series:
        eps = float(np.finfo(float).eps)
        return p.map(lambda x: NormalDist().inv_cdf(1 - min(max(x, eps), 1 - eps)))

    z = (F.col("observed") - F.col("null_mean")) / (F.col("null_std") + float(np.finfo(float).eps))
    return out.select(*by, "observed", "p", z.alias("z_emp"), upper("p").alias("z_coll"), "null_mean", "null_std")


#: Groups of blocks at least: a cell of a reference serves every class, and its labels cost more than its distances.
PERMUTED_GROUPS = 24
PERMUTED = "perm int, aa double, ab double, bb double, n_aa double, n_ab double, n_bb double"


def permutation_tests(vectors: DataFrame, metric: Callable, permutations: int = 1000, key: str = "cls", reference=None, seed: int = 1) -> DataFrame:
    """k1, k2, and the permutation test of k1 (first side) against k2, for every pair of classes k1 < k2, or each class against the reference.

    Energy with U-statistic means against relabelled samples; the classes of a
    pair are cut to one size at random.  All pairs are one job: a cell of one
    class serves every pair that has the class.  A cell turns its distances
    into sums for all permutations by two matrix products; no row is made for
    a pair of samples or a label.
    """
    v = keyed(vectors, key)
    packed = blocks(v, seed=seed)
    sizes = packed[1]
    names = sorted(sizes)
    if reference is not None and reference not in sizes:
        raise ValueError(f"no class {reference}")
    pairs = [(x, y) for n, x in enumerate(names) for y in names[n + 1 :]] if reference is None else [(x, reference) for x in names if x != reference]
    of: dict[tuple, list[tuple]] = {}
    for one, two in pairs:
        for cell in {(one, one), (two, two), (min(one, two), max(one, two))}:
            of.setdefault(cell, []).append((one, two))

    # samples beyond the size of a class's partners are in no test, so their blocks don't meet
    upto = {k: max((min(sizes[x], sizes[y]) for x, y in pairs if k in (x, y)), default=0) for k in names}
    limits = v.sparkSession.createDataFrame(list(upto.items()), f"of {kind_of(v)}, upto long")
    packed = (packed[0].join(F.broadcast(limits), F.col("k") == F.col("of")).filter("start < upto").drop("of", "upto"), sizes) if upto else packed

    kept: dict[tuple, np.ndarray] = {}  # of one task: the labels of its blocks, as bits

    def labels(k: object, at: np.ndarray, pair: tuple, half: int) -> np.ndarray:
        name = (k, at[0], len(at), pair)
        if name not in kept:
            found = np.packbits(_labels(at, "a" if k == pair[0] else "b", half, permutations, seed), axis=1)
            while kept and (len(kept) + 1) * found.nbytes > LABELS:
                kept.pop(next(iter(kept)))
            kept[name] = found
        return np.unpackbits(kept[name], axis=1, count=permutations + 1).astype(np.float64)

    def sums(c: Cell, pair: tuple) -> pd.DataFrame | None:
        half = min(sizes[k] for k in pair)
        in1, in2 = c.at1 < half, c.at2 < half
        d = c.d[np.ix_(in1, in2)]
        if not d.size:
            return None
        if c.same:
            d = np.triu(d, 1)
        one = labels(c.k1, c.at1[in1], pair, half)
        two = one if c.same else labels(c.k2, c.at2[in2], pair, half)
        aa, row, column, every = ((d @ two) * one).sum(axis=0), (d.sum(axis=1) @ one), (d.sum(axis=0) @ two), d.sum()
        if c.same:
            n1, m = one.sum(axis=0), float(len(d))
            n_aa, n_bb, n = n1 * (n1 - 1) / 2, (m - n1) * (m - n1 - 1) / 2, m * (m - 1) / 2
        else:
            n1, n2 = one.sum(axis=0), two.sum(axis=0)
            n_aa, n_bb, n = n1 * n2, (len(one) - n1) * (len(two) - n2), float(len(one) * len(two))
        bb = every - row - column + aa
        return pd.DataFrame({"k1": [pair[0]] * len(aa), "k2": [pair[1]] * len(aa), "perm": np.arange(permutations + 1, dtype=np.int32), "aa": aa, "ab": every - aa - bb, "bb": bb, "n_aa": n_aa, "n_ab": n - n_aa - n_bb, "n_bb": n_bb})

    def reduce(c: Cell) -> pd.DataFrame | None:
        found = [x for x in (sums(c, pair) for pair in of.get((c.k1, c.k2), ())) if x is not None]
        return pd.concat(found) if found else None

    def added(f: pd.DataFrame) -> pd.DataFrame:
        return f.groupby(["k1", "k2", "perm"], as_index=False).sum()

    kinds = f"k1 {kind_of(v)}, k2 {kind_of(v)}, "
    tested = v.sparkSession.createDataFrame([(*c, 0) for c in of], f"k1 {kind_of(v)}, k2 {kind_of(v)}, todo int") if of else None
    return _tested(cells(v, metric, reduce, kinds + PERMUTED, "all", packed=packed, todo=tested, merge=added, groups=PERMUTED_GROUPS), permutations, ("k1", "k2"))


def permutation_test(vectors: DataFrame, metric: Callable, permutations: int = 1000, seed: int = 1) -> DataFrame:
    """The permutation test of class a against class b."""
    return permutation_tests(vectors, metric, permutations, seed=seed).drop("k1", "k2")


def mc_permutation_test(vectors: DataFrame, metric: Callable, draws: int, permutations: int = 1000, seed: int = 1) -> DataFrame:
    """The permutation test on about ``draws`` distinct pairs of samples, drawn once, by cells of blocks that mix both classes."""
    rows, sizes = numbered(vectors, seed)
    half = min(sizes["a"], sizes["b"])
    rows = rows.filter(F.col("at") < half).select("sample_id", "vec", (F.col("at") + F.when(F.col("cls") == "b", half).otherwise(0)).alias("place"))

    def labels(place: np.ndarray) -> np.ndarray:
        return _first_halves(place, half, permutations, seed).astype(np.float64)

    def sums(d: np.ndarray, i: np.ndarray, j: np.ndarray, place1: np.ndarray, place2: np.ndarray) -> pd.DataFrame:
        one, two, found = labels(place1), labels(place2), {}
        for name, value in (("", d), ("n_", np.ones(len(d)))):
            m = np.zeros((len(place1), len(place2)))
            m[i, j] = value
            aa, every = ((m @ two) * one).sum(axis=0), m.sum()
            bb = every - m.sum(axis=1) @ one - m.sum(axis=0) @ two + aa
            found |= {f"{name}aa": aa, f"{name}ab": every - aa - bb, f"{name}bb": bb}
        return pd.DataFrame({"perm": np.arange(permutations + 1, dtype=np.int32), **{c: found[c] for c in ("aa", "ab", "bb")}, **{c: np.rint(found[c]) for c in ("n_aa", "n_ab", "n_bb")}})

    return _tested(distinct_pairs(rows, metric, draws, sums, PERMUTED, seed=seed), permutations)


def _gap(own: DataFrame, other: DataFrame, splits: int, q: float, alpha: float, tolerance: float, regularize: float, seed: int) -> dict[str, float]:
    """Distances of ``own`` samples from the reference ``other`` in its deviations, against random halves of it."""
    rows, sizes = numbered(other.withColumn("cls", F.lit("r")), seed)
    n, half = sizes["r"], sizes["r"] // 2
    rows = cut_lineage(rows.select("vec", "at"))
    _, mean, cov = covariance(rows)
    values, axes = eigen(cov)
    values = np.maximum(values, 0.0)
    middle = float(np.median(values))

    def sides(at: np.ndarray) -> np.ndarray:
        out = np.empty((len(at), splits), dtype=np.int8)
        for s in range(splits):
            place = permuted(at, n, seed * 100_003 + s)
            out[:, s] = np.where(place < half, 1, np.where(place < 2 * half, 2, 0))
        return out

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z, side = (_matrix(b) - mean) @ axes, sides(b["at"].to_numpy())
                yield pd.concat([_long(2 * h + k, (side == h).T.astype(float) @ x) for h in (1, 2) for k, x in enumerate((z, z * z))])

    # splits x width numbers, whatever the data
    s = _total(rows.mapInPandas(sums, "kind int, " + SUMS))
    variances = np.concatenate([(s[2 * h + 1] - s[2 * h] ** 2 / half) / (half - 1) for h in (1, 2)])
    floor = np.where(values < regularize * middle, np.median(variances, axis=0), 0.0)
    weight = np.maximum(np.maximum(values, floor), tolerance * middle)
    second = s[4] / half / np.sqrt(weight)

    def stat(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
        x = F.col(column)
        return rows.groupBy(*by).agg((F.min(x) if q == 0 else F.max(x) if q == 1 else F.percentile(x, F.lit(q))).alias("m"))

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z, side = (_matrix(b) - mean) @ axes / np.sqrt(weight), sides(b["at"].to_numpy())
                d = np.sqrt(squared(z, second))
                if q in (0, 1):  # one number a batch and split
                    d = (np.where(side == 1, d, np.inf).min(axis=0) if q == 0 else np.where(side == 1, d, -np.inf).max(axis=0))[None, :]
                    side = np.where(np.isfinite(d), 1, 0)
                i, r = np.nonzero(side == 1)
                yield pd.DataFrame({"split": r.astype(np.int32), "d": d[i, r]})

    base = np.array([r["m"] for r in stat(rows.mapInPandas(halves, "split int, d double"), "d", ["split"]).collect()])  # one row a split

    @F.pandas_udf("double")
    def sigma(v: pd.Series) -> pd.Series:
        return pd.Series(np.sqrt((((np.stack([np.asarray(x) for x in v]) - mean) @ axes) ** 2 / weight).sum(axis=1))) if len(v) else pd.Series([], dtype=float)

    seen = float(stat(own.select(sigma("vec").alias("d")), "d", []).first()["m"])
    z = (seen - base.mean()) / (base.std(ddof=1) + np.finfo(float).eps)
    return {"observed": seen, "threshold": float(np.quantile(base, 1 - alpha)), "z_emp": float(z), "D": NormalDist().cdf(float(z))}


def mahalanobis_gap(vectors: DataFrame, splits: int = 1000, q: float = 0.0, alpha: float = 0.05, symmetric: bool = False, tolerance: float = 1e-6, regularize: float = 0.01, seed: int = 1) -> DataFrame:
    """observed (least, largest or q-quantile distance of a's samples from b), D, distinguishable, threshold, z_emp;
    with ``symmetric`` also b's from a.

    Distances are in the eigenbasis of b's covariance, after directions without
    pooled variance are left out; small variances are raised to what halves of b
    show.  The threshold is the 1 - ``alpha`` quantile over random halves of b.
    """
    _, _, cov = covariance(vectors)
    values, axes = eigen(cov)
    axes = axes[:, kept_axes(values, tolerance)]
    v = cut_lineage(transformed(vectors.select("sample_id", "cls", "vec"), lambda x: x @ axes))
    a, b = (v.filter(F.col("cls") == c) for c in ("a", "b"))
    one = _gap(a, b, splits, q, alpha, tolerance, regularize, seed)
    two = _gap(b, a, splits, q, alpha, tolerance, regularize, seed + 1) if symmetric else None
    found = one["observed"] > one["threshold"] and (two is None or two["observed"] > two["threshold"])
    row = (one["observed"], one["D"], bool(found), one["threshold"], one["z_emp"], *((two["observed"], two["D"], min(one["observed"], two["observed"]), two["threshold"], max(one["threshold"], two["threshold"])) if two else (None,) * 5))
    return vectors.sparkSession.createDataFrame([row], "observed double, D double, distinguishable boolean, threshold double, z_emp double, observed_sym double, D_sym double, observed_min double, threshold_sym double, threshold_max double")


def by_reference(vectors: DataFrame, statistic: Callable[[DataFrame], DataFrame], key: str, reference: float) -> DataFrame:
    """A statistic of each class of ``key`` (as a) with the reference class (as b); the classes are few."""
    others = [r[0] for r in vectors.filter(F.col(key) != reference).select(key).distinct().orderBy(key).collect()]
    out = None
    for s in others:
        both = vectors.filter(F.col(key).isin([s, reference])).withColumn("cls", F.when(F.col(key) == reference, "b").otherwise("a"))
        one = statistic(both).select(F.lit(float(s)).alias(key), "*")
        out = one if out is None else out.unionByName(one)
    return out


def report(observables: dict[str, DataFrame], metric: Callable = hellinger, k: int = 5, splits: int | None = None) -> DataFrame:
    """observable, measure, value: energy and information, and with ``splits`` the Mahalanobis gap, of each observable."""
    out = None
    for name, vectors in observables.items():
        moved = project(vectors)
        packed = blocks(keyed(moved, "cls"))  # projected and packed once for both measures
        rows = [energy(moved, metric, packed=packed).select(F.lit("energy").alias("measure"), F.col("distinguishability").alias("value")), neighbour_information(moved, k, projected=False, packed=packed).select(F.lit("information").alias("measure"), F.col("information").alias("value"))]
        if splits:
            rows.append(mahalanobis_gap(vectors, splits).select(F.lit("mahalanobis").alias("measure"), F.col("D").alias("value")))
        for r in rows:
            r = r.select(F.lit(name).alias("observable"), "*")
            out = r if out is None else out.unionByName(r)
    return out
