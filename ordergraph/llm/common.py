"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that the text contracts name: \x20 and \x09-\x0D.
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most so many of the most frequent keys are broadcast; any other key has
#: less than 1/HOT_KEYS of all rows.
HOT_KEYS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run on this machine."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(shared)
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Scratch:
    """Tables that one run writes to the shared folder, compressed, and removes
    as soon as it has read them for the last time."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables, self.names = 0, []

    def save(self, df: DataFrame, name: str | None = None) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{name or f'step-{self.tables}'}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_dealt(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Dealt by ``key`` once and for all: joins on it do not shuffle the table again."""
        self.tables += 1
        name = f"dealt_{uuid.uuid4().hex}"
        dealt = df.repartition(buckets, key).write.option("compression", "zstd").option("path", f"{self.folder}/step-{self.tables}")
        dealt.bucketBy(buckets, key).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def clear(self, keep: tuple[str, ...] = ()) -> None:
        """Remove the run's tables but those named in ``keep``."""
        while self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop()}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(conf)
        for each in fs.listStatus(root) if fs.exists(root) else ():
            if each.getPath().getName() not in keep:
                fs.delete(each.getPath(), True)


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """The whole input row as struct ``row``, beside the named columns.

    Extra input columns can then have any names, also those of results.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in named.items()])


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case and nothing else (ASCII text takes the faster way)."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row.

    A plain expression used within a lambda would be evaluated again for each
    element; bound as a lambda variable it is not.
    """
    return F.transform(F.array(value), body)[0]


def join_counted(left: DataFrame, agg: DataFrame, keys: list[str], count: str, spread: Column) -> DataFrame:
    """``left`` inner-joined with ``agg``, which has one row per key.

    The HOT_KEYS largest keys (by ``count``) of ``agg`` are broadcast; rows of
    ``left`` that they match are dealt out by ``spread`` instead of by key, so
    no key however frequent gathers in one task.  ``agg`` is read twice: pass
    a checkpointed table.
    """
    values = [c for c in agg.columns if c not in keys]
    hot = agg.orderBy(F.desc(count), *keys).limit(HOT_KEYS)
    hot = hot.select(*[F.col(k).alias(f"hot_{k}") for k in keys], F.struct(*values).alias("hot_v"))
    on = [F.col(k) == F.col(f"hot_{k}") for k in keys]
    near = left.join(F.broadcast(hot), on, "left").drop(*[f"hot_{k}" for k in keys])
    near = near.withColumn("cold_k", F.when(F.col("hot_v").isNull(), F.col(keys[0])).otherwise(spread))
    cold = agg.select(F.col(keys[0]).alias("agg_k"), *[F.col(k).alias(f"agg_{k}") for k in keys[1:]], F.struct(*values).alias("agg_v"))
    on = [F.col("cold_k") == F.col("agg_k"), *[F.col(k) == F.col(f"agg_{k}") for k in keys[1:]]]
    out = near.join(cold, on, "left").withColumn("v", F.coalesce("hot_v", "agg_v"))
    return out.filter(F.col("v").isNotNull()).select(*[F.col(c) for c in left.columns], *[F.col("v")[c].alias(c) for c in values])


def before(sums: DataFrame, key: str, place: str, value: str, width: int = 1024) -> DataFrame:
    """The rows with column ``before``: the sum of ``value`` over the key's rows of smaller ``place``.

    In two levels of ``width`` places, so that a task orders a part of a key's
    rows, or one row for each part.
    """
    dealt = sums.withColumn("level", F.floor(F.col(place) / width))
    tops = dealt.groupBy(key, "level").agg(F.sum(value).alias("all"))
    tops = tops.select(F.col(key).alias("at_key"), F.col("level").alias("at_level"), (F.sum("all").over(Window.partitionBy(key).orderBy("level")) - F.col("all")).alias("above"))
    inside = F.sum(value).over(Window.partitionBy(key, "level").orderBy(place)) - F.col(value)
    both = dealt.withColumn("inside", inside).join(tops, F.col(key).eqNullSafe(F.col("at_key")) & (F.col("level") == F.col("at_level")))
    return both.select(*sums.columns, (F.col("above") + F.col("inside")).alias("before"))


def hash_share(h: Column | str, wanted: int, total: int) -> Column:
    """About ``wanted`` of ``total`` rows, by a uniform 64-bit hash; all if there are no more.

    Unlike a sorted limit, tasks send no more than is wanted of all together.
    """
    if wanted >= total:
        return F.lit(True)
    return (F.col(h) if isinstance(h, str) else h) < F.lit(-(2**63) + int(2**64 * (wanted / total)))
