"""Embedding whitening, fitted on distinct vectors.

Rows of one integer vector are grouped before anything is fitted; a group
weighs one, or its number of rows.  Sums are exact; the covariance is a sum of
centred matrix products of blocks; each distinct vector is whitened once, and
rows get the values of their vector by a join that deals frequent vectors out.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted, packed

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
#: A component counts as finite while 64 times it is below this.
LARGEST = 2.0**62
SAFE = 1 << 62
WIDE = Context(prec=80)


def usable(v: Column) -> Column:
    """Not null, no null and no non-finite component, at least one component."""
    sound = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) * SCALE < LARGEST))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(sound, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums in whole numbers, of any size."""
    largest = max(int(np.abs(x).max(initial=0)), 1)
    if n * largest + max(map(abs, sums), default=0) < SAFE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def squares(v: np.ndarray) -> list[int]:
    """Row sums of squares in whole numbers."""
    if v.dtype != object and v.shape[1] * max(int(np.abs(v).max(initial=0)), 1) ** 2 < SAFE:
        return (v * v).sum(axis=1).tolist()
    return [sum(e * e for e in row) for row in v.astype(object)]


def _column_sums(table: DataFrame, width: int, weights: str) -> tuple[int, list[int]]:
    """Weight of all rows and weighted sums of each dimension, exact."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, [0] * width
        for batch in batches:
            if batch.num_rows:
                x, m = matrix(batch.column(0), width), batch.column(1).to_numpy()
                m = m if weights == "counts" else np.ones_like(m)
                total += int(m.sum())
                if int(np.abs(x).max()) * int(m.sum()) >= SAFE:
                    x, m = x.astype(object), m.astype(object)
                sums = [a + int(b) for a, b in zip(sums, (x * m[:, None]).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([Decimal(s) for s in [total, *sums]], pa.decimal128(38, 0))], ["dim", "value"])

    rows = table.select("x", "m").mapInArrow(part, "dim int, value decimal(38,0)").groupBy("dim").agg(F.sum("value").alias("value")).collect()  # one row a dimension
    found = {r["dim"]: int(r["value"]) for r in rows}
    return found.get(-1, 0), [found.get(j, 0) for j in range(width)]


def _products(table: DataFrame, column: str, width: int, centre, weights: str) -> np.ndarray:
    """Sum over rows of weight times the outer square of ``centre(row)``: a ``width`` x ``width`` matrix."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                y = centre(matrix(batch.column(0), width))
                total += y.T @ (y * batch.column(1).to_numpy()[:, None] if weights == "counts" else y)
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "value"])

    out = np.zeros((width, width))
    for r in table.select(column, "m").mapInArrow(part, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # width squared rows
        out[r["i"], r["j"]] = r["value"]
    return out


def whiten(vectors: DataFrame, components: int = 16, weights: str = "one", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns row (the input row), n, deviation, whitened, explained, identity_error.

    Each component c of a vector becomes x = floor(64 c) + 1000000.  The fit
    list holds each distinct x vector once (``weights="one"``) or as often as
    rows have it (``"counts"``): n of them, with sums S.  ``deviation`` is the
    sum over dimensions of (n x - S)^2, exact, as decimal (null beyond 38
    digits); ``whitened`` is x - S/n projected on the unit eigenvectors of the
    fit list's covariance (divisor n), by falling eigenvalue, over the root of
    the eigenvalue; the largest entry of an eigenvector is positive.
    ``explained`` are the eigenvalues over their sum, ``identity_error`` is the
    largest absolute entry of the whitened covariance minus the identity.

    No part take vectors that are null or empty, hold null or non-finite
    components (or ones of 2^56 and more), or have another length than most
    (of two equally frequent lengths: than the smaller).  Vectors narrower than
    ``components`` give as many values as they have dimensions.  A component
    without variance (fewer distinct vectors than dimensions) is null in
    ``whitened`` and left out of ``identity_error``.  Rows count as they are:
    repeated rows and null ids get their vector's values each.  No usable
    rows: an empty table.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights are 'one' or 'counts'")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "whitening")
    every = packed(vectors, id=F.col(f"`{vec_id}`"), v=F.col(f"`{vector}`").cast("array<double>")).filter(usable(F.col("v")))
    common = every.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = common[0]["width"] if common else 1
    every = every.filter(F.size("v") == width).select("row", "id", F.transform("v", lambda e: F.floor(e * SCALE) + SHIFT).alias("x")).withColumn("h", F.xxhash64("x"))
    distinct = scratch.save(every.groupBy("h", "x").agg(F.count("*").alias("m")), "distinct")
    n, sums = _column_sums(distinct, width, weights)
    products = _products(distinct, "x", width, lambda x: (numerators(x, n, sums) / n).astype(float), weights)
    values, axes = np.linalg.eigh(products / max(n, 1))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(products) / max(n, 1))
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    live = values > max(values.max(initial=0), 0) * width * np.finfo(float).eps
    k, roots = len(values), np.sqrt(np.where(live, values, 1.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = numerators(matrix(batch.column(1), width), n, sums)
            y = ((v / n).astype(float) @ axes) / roots
            exact = [WIDE.create_decimal(s) if s < 10**38 else None for s in squares(v)]
            flat = pa.array(y.ravel(), mask=np.tile(~live, len(y)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(exact, pa.decimal128(38, 0)), lists], ["h", "x", "m", "deviation", "whitened"])

    white = scratch.save(distinct.mapInArrow(project, "h long, x array<long>, m long, deviation decimal(38,0), whitened array<double>"), "white")
    error = 0.0
    if n and live.any():
        filled = white.select(F.transform("whitened", lambda e: F.coalesce(e, F.lit(0.0))).alias("y"), "m")
        weight = F.col("m") if weights == "counts" else F.lit(1)
        means = filled.select(weight.alias("m"), F.posexplode("y")).groupBy("pos").agg((F.sum(F.col("col") * F.col("m")) / n).alias("mean")).collect()  # one row a component
        mean = np.zeros(k)
        for r in means:
            mean[r["pos"]] = r["mean"]
        covariance = _products(filled, "y", k, lambda y: y - mean, weights) / n
        error = float(np.abs(covariance - np.eye(k))[np.ix_(live, live)].max())
    share = F.array(*[F.lit(float(max(e, 0.0) / trace)) if trace > 0 else F.lit(None).cast("double") for e in values])
    both = join_counted(every, white, ["h", "x"], "m", F.xxhash64("id"))
    return both.select("row", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
