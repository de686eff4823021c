"""Scalar bins and averages by bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equal_width(df: DataFrame, scalar: str, bins: int | None, log: bool = False) -> DataFrame:
    """bin_key: the midpoint (with ``log``, geometric mean) of the value's bin.

    Without ``bins``, or if there are as many labels, a label is its own key.
    One value only: one bin.  The right end belongs to the last bin.
    """
    if bins is None:
        return df.withColumn("bin_key", F.col(scalar).cast("double"))
    x = F.log10(F.when(F.col(scalar) <= 0, F.raise_error(F.lit("not positive"))).otherwise(F.col(scalar))) if log else F.col(scalar).cast("double")
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.countDistinct(scalar).alias("_labels"))
    lo, hi = F.col("_lo"), F.when(F.col("_hi") == F.col("_lo"), F.col("_lo") + 1e-12).otherwise(F.col("_hi"))
    width = (hi - lo) / bins
    k = F.least(F.floor((x - lo) / width), F.lit(bins - 1))
    mid = lo + (k + 0.5) * width
    key = F.pow(F.lit(10.0), mid) if log else mid
    exact = F.lit(False) if log else F.col("_labels") == bins
    return df.join(F.broadcast(ends)).withColumn("bin_key", F.when(exact, F.col(scalar).cast("double")).otherwise(key)).drop("_lo", "_hi", "_labels")


def mean_std(df: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """Mean and sample deviation of each field; one value has deviation 0."""
    return df.groupBy(*by).agg(*[c for f in fields for c in (F.avg(f).alias(f"{f}_mean"), F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f"{f}_std"))])


def key_pairs(df: DataFrame, key: str = "bin_key", reference: float | None = None) -> DataFrame:
    """Distinct keys in pairs k1 < k2, or each with the reference."""
    keys = df.select(F.col(key).alias("k1")).distinct()
    if reference is not None:
        return keys.filter(F.col("k1") != reference).withColumn("k2", F.lit(float(reference)))
    return keys.join(keys.withColumnRenamed("k1", "k2"), F.col("k1") < F.col("k2"))
