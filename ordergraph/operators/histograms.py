"""Histogram algebra on long tables (sample_id, .., bin, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .binning import equal_width
from .ordered import ranked_within


def normalize(hist: DataFrame, mode: str | float = "probability", key: str = "sample_id", size: str | None = None) -> DataFrame:
    """Weights over their sum ("probability"), their largest ("max") or a
    constant; times the column ``size`` if given.  A zero divisor is an error."""
    if isinstance(mode, str) and mode not in ("probability", "max"):
        raise ValueError(f"not a mode: {mode}")
    if not isinstance(mode, str) and (mode == 0 or mode != mode or abs(mode) == float("inf")):
        raise ValueError("the constant must be finite and not zero")
    w = F.col("weight") * F.col(size) if size else F.col("weight")
    own = Window.partitionBy(key)
    by = F.lit(float(mode)) if not isinstance(mode, str) else (F.sum("weight") if mode == "probability" else F.max("weight")).over(own)
    return hist.withColumn("weight", F.when(by == 0, F.raise_error(F.lit("nothing to divide by"))).otherwise(w / by))


def bin_range(hist: DataFrame) -> DataFrame:
    """lo, hi of the common support: from 0 if a bin 0 is held, else from 1."""
    return hist.agg(F.when(F.min("bin") == 0, 0).otherwise(1).alias("lo"), F.max("bin").alias("hi"))


def densify(hist: DataFrame, keys: list[str] = ["sample_id"]) -> DataFrame:  # noqa: B006
    """Zero-filled rows for every sample and bin of the common support."""
    support = hist.select(*keys).distinct().join(F.broadcast(bin_range(hist))).select(*keys, F.explode(F.sequence("lo", "hi")).alias("bin"), F.lit(0.0).alias("weight"))
    return support.unionByName(hist.select(*keys, "bin", F.col("weight").cast("double").alias("weight"))).groupBy(*keys, "bin").agg(F.sum("weight").alias("weight"))


def dense_arrays(hist: DataFrame, keys: list[str]) -> DataFrame:
    rows = densify(hist, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "weight"))).alias("a"))
    return rows.select(*keys, F.transform("a", lambda x: x["weight"]).alias("vec"))


def pad(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Vectors of one length, zeros at the right."""
    longest = vectors.agg(F.max(F.size(vec)).alias("longest"))
    return vectors.join(F.broadcast(longest)).withColumn(vec, F.concat(vec, F.array_repeat(F.lit(0.0), F.col("longest") - F.size(vec)))).drop("longest")


def trim(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Padded, then cut after the last place where any vector is positive."""
    padded = pad(vectors, vec)
    last = padded.agg(F.max(F.array_max(F.transform(F.col(vec), lambda x, i: F.when(x > 0, i + 1).otherwise(0)))).alias("last"))
    return padded.join(F.broadcast(last)).withColumn(vec, F.when(F.col("last") > 0, F.slice(vec, F.lit(1), F.greatest("last", F.lit(1)))).otherwise(F.col(vec))).drop("last")


def concatenate(first: DataFrame, second: DataFrame, key: str = "sample_id") -> DataFrame:
    """Each sample's two vectors as one; an error if a sample is in one table only, or more often in one than in the other."""
    n = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    uneven = n(first, "n1").join(n(second, "n2"), key, "full").filter("not n1 <=> n2 or n1 > 1").limit(3).collect()
    if uneven:
        raise ValueError(f"not one vector in each table for samples {sorted(str(r[key]) for r in uneven)}")
    return first.join(second.select(key, F.col("vec").alias("other")), key).withColumn("vec", F.concat("vec", "other")).drop("other")


def join_histograms(hist: DataFrame, keys: list[str], scalar: str | None = None) -> DataFrame:
    """Bin-wise sums; with ``scalar``, its values in a group must agree."""
    if scalar is None:
        return hist.groupBy(*keys, "bin").agg(F.sum("weight").alias("weight"))
    out = hist.groupBy(*keys, "bin").agg(F.sum("weight").alias("weight"), F.min(scalar).alias(scalar), F.max(scalar).alias("_other"))
    return out.filter(F.when(F.col(scalar) != F.col("_other"), F.raise_error(F.lit("scalars differ"))).otherwise(F.lit(True))).drop("_other")


def average(hist: DataFrame, by: list[str] | None = None, key: str = "sample_id") -> DataFrame:
    """Mean and population deviation by bin over samples; absent bins are 0."""
    by = by or []
    if by:
        n = hist.groupBy(*by).agg(F.countDistinct(key).alias("n"))
        sums = hist.groupBy(*by, "bin").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("ss")).join(n, by)
    else:
        n = hist.agg(F.countDistinct(key).alias("n"))
        sums = hist.groupBy("bin").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("ss")).join(F.broadcast(n))
    mean = F.col("s") / F.col("n")
    return sums.select(*by, "bin", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def average_vectors(vectors: DataFrame, by: list[str] | None = None, sample_std: bool = False) -> DataFrame:
    """Mean and deviation by position (from 1) over vectors of one length."""
    flat = vectors.select(*(by or []), F.posexplode("vec").alias("p", "x"))
    std = F.stddev_samp("x") if sample_std else F.stddev_pop("x")
    return flat.groupBy(*(by or []), (F.col("p") + 1).alias("pos")).agg(F.avg("x").alias("mean"), std.alias("std"))


def replace_zeros(df: DataFrame, std: str, key: str, share: float = 1e-3) -> DataFrame:
    least = F.min(F.when(F.col(std) > 0, F.col(std))).over(Window.partitionBy(key))
    return df.withColumn(std, F.when(F.col(std) == 0, share * least).otherwise(F.col(std)))


def empirical(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Shares of values in equal bins of [low, high], the last closed."""
    x, width = F.col(value), (high - low) / bins
    inside = df.filter((x >= low) & (x <= high)).groupBy(F.least(F.floor((x - low) / width) + 1, F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
    return inside.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))


def scale_columns(df: DataFrame, columns: list[str], near: float = 1e-3) -> DataFrame:
    """Each column to [0, 1]; a nearly constant one over its largest value."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(ends))

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        return F.when(hi - lo > near, (F.col(c) - lo) / (hi - lo)).when(F.abs(hi) > near, F.col(c) / hi).otherwise(F.col(c))

    return out.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def spectrum_series(df: DataFrame, values: str, key: str) -> DataFrame:
    """Entries after the first, with their index and its share of the length."""
    rest = df.select(key, F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))).alias("r")).filter(F.size("r") > 0)
    return rest.select(key, F.size("r").alias("n"), F.posexplode("r").alias("p", "y")).select(key, (F.col("p") + 1).alias("x"), ((F.col("p") + 1) / F.col("n")).alias("share"), "y")


def rekeyed(hist: DataFrame, scalar: str, bins: int, key: str = "sample_id") -> DataFrame:
    """Normalised histograms whose scalar is that of its bin's middle.

    As many labels as bins are taken as binned before and pass; fewer are an error.
    """
    labels = hist.agg(F.countDistinct(scalar).alias("_labels"))
    known = normalize(hist, key=key).join(F.broadcast(labels)).filter(F.when(F.col("_labels") < bins, F.raise_error(F.lit("finer than the bins that there are"))).otherwise(F.lit(True)))
    return equal_width(known.drop("_labels"), scalar, bins).drop(scalar).withColumnRenamed("bin_key", scalar)


def long_frame(frames: dict[str, DataFrame], order: str, share: float) -> DataFrame:
    """kind, id and the frames' columns: of each kind every round(1 / share)-th row from the first, numbered."""
    step, out = max(1, round(1 / share)), None
    for kind, df in frames.items():
        one = df.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    nth = ranked_within(out, ["kind"], [order], "_nth").filter((F.col("_nth") - 1) % step == 0)
    return nth.withColumn("id", F.floor((F.col("_nth") - 1) / step) + 1).drop("_nth")
