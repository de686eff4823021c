"""Ranks and running sums in one order, without one task that holds it.

Rows are dealt by ranges and numbered within their range; the driver adds up one
number for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graphs import cut_lineage

LOW = (1 << 33) - 1


def _dealt(df: DataFrame, order: list[str], cut: bool = True) -> DataFrame:
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    return (cut_lineage(dealt) if cut else dealt).withColumn("_part", F.shiftright("_at", 33))


def _offsets(df: DataFrame, sums: dict[int, float], kind: str) -> DataFrame:
    """The sum over the ranges before each, a row for each range."""
    before, rows = 0, []
    for part in sorted(sums):
        rows.append((part, before))
        before += sums[part]
    return F.broadcast(df.sparkSession.createDataFrame(rows, f"_part long, _before {kind}"))


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Rows with their place, from 1, in ``order``; equal rows have places in any order."""
    dealt = _dealt(df, order)
    sums = {r[0]: r[1] for r in dealt.groupBy("_part").count().collect()}
    return dealt.join(_offsets(df, sums, "long"), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(LOW)) + 1).drop("_at", "_part", "_before")


def ranked_within(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Places from 1 within each group: those in the order of groups and rows, less those before the group."""
    every = ranked(df, by + order, "_rank")
    first = every.groupBy(*by).agg(F.min("_rank").alias("_first"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    joined = every.alias("l").join(first.alias("f"), same).select(*[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col("_rank") - F.col("_first") + 1).alias(name))
    return joined


def sums_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Rows with the sum of ``value`` over rows of smaller ``order``, which has each value once."""
    dealt = _dealt(df, [order])
    sums = {r[0]: r[1] for r in dealt.groupBy("_part").agg(F.sum(value)).collect()}
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inside", inside).join(_offsets(df, sums, "long"), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_at", "_part", "_before", "_inside")


def ranked_values(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """Rows with the place, from 1, of their value among the distinct values of ``order``."""
    inside = F.dense_rank().over(Window.partitionBy("_part").orderBy(order))
    dealt = cut_lineage(_dealt(df, [order], cut=False).withColumn("_inside", inside))
    sums = {r[0]: r[1] for r in dealt.groupBy("_part").agg(F.max("_inside")).collect()}
    return dealt.join(_offsets(df, sums, "long"), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_at", "_part", "_before", "_inside")


def running_sums(df: DataFrame, by: str, order: str, values: list[str], length: int = 4096) -> DataFrame:
    """Rows with the sums of ``values`` over the rows of their group up to them, in ``order`` (each value once a group).

    In two levels: groups are cut to parts of at most ``length`` rows, so that
    a task orders a part, or one row for each part.
    """
    parted = ranked(df, [by, order], "_nth").withColumn("_part", F.floor((F.col("_nth") - 1) / length))
    parted = cut_lineage(parted.drop("_nth"))
    upto = lambda c: F.sum(c).over(Window.partitionBy(by, "_part").orderBy(order))
    parts = parted.groupBy(by, "_part").agg(*[F.sum(c).alias(c) for c in values])
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(by, "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"_{c}") for c in values])
    inside = parted.select(*[c for c in df.columns if c not in values], "_part", *[upto(c).alias(c) for c in values])
    both = inside.join(parts, [by, "_part"])
    return both.select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in values else F.col(c) for c in df.columns])
