"""Means and sample deviations by bin over arriving files of records.

The state is a table in a shared folder, one version for each micro-batch: a
batch merges its own (n, mean, m2) with the version of the batch before it, so
a batch that runs again after a failure writes the same version again, and
nothing is lost or counted twice.  What is kept grows with the bins, not with
the records, and never lies on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_records(spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path)


def batch_moments(records: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean and m2 (squared deviations from the mean) of each bin."""
    x = F.col(value).cast("double")
    return records.filter(x.isNotNull()).groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def merged_moments(one: DataFrame, two: DataFrame, by: list[str]) -> DataFrame:
    """The moments of both tables' records together, about their common mean."""
    a, b = one.alias("a"), two.alias("b")
    both = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by], "full")
    n1, n2 = (F.coalesce(F.col(f"{t}.n"), F.lit(0)) for t in "ab")
    m1, m2 = (F.coalesce(F.col(f"{t}.mean"), F.lit(0.0)) for t in "ab")
    n, d = n1 + n2, m2 - m1
    mean = F.when(n1 == 0, m2).otherwise(m1 + d * n2 / n)
    squares = F.coalesce("a.m2", F.lit(0.0)) + F.coalesce("b.m2", F.lit(0.0)) + F.when((n1 > 0) & (n2 > 0), d * d * n1 * n2 / n).otherwise(0.0)
    return both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in by], n.alias("n"), mean.alias("mean"), squares.alias("m2"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written to their end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = {each.getPath().getName(): each.getPath() for each in fs.listStatus(root)}
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(n.removeprefix("version-")) for n, p in names.items() if n.startswith("version-") and done(p))


def keep_moments(records: DataFrame, value: str, by: list[str], folder: str, keep: int = 2):
    """A streaming query, not started yet, that merges each micro-batch into the state under ``folder``."""
    state = f"{folder}/state"

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own, before = batch_moments(batch, value, by), [v for v in _versions(spark, state) if v < batch_id]
        if before:
            own = merged_moments(spark.read.parquet(f"{state}/version-{before[-1]}"), own, by)
        own.write.mode("overwrite").parquet(f"{state}/version-{batch_id}")
        fs = spark._jvm.org.apache.hadoop.fs.Path(state).getFileSystem(spark._jsc.hadoopConfiguration())
        for old in before[: max(0, len(before) + 1 - keep)]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{state}/version-{old}"), True)

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint")


def kept_moments(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """by, n, mean, std (sample; 0 for one record) of the last finished batch."""
    versions = _versions(spark, f"{folder}/state")
    if not versions:
        raise ValueError(f"no finished batch under {folder}")
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0)
    return spark.read.parquet(f"{folder}/state/version-{versions[-1]}").select(*by, "n", "mean", std.alias("std"))
