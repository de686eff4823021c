"""Tables of order graphs, histograms and vectors, read from Parquet."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ordergraph.operators.ordered import ranked_within


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, id, u, v: a customer's orders by date and price."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("id"), F.unix_timestamp("o_orderdate").cast("double").alias("u"), F.col("o_totalprice").alias("v"))


def graph_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, n, cls, scalar: a row for each customer with orders."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("graph_id")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"), F.col("c_mktsegment").alias("cls"), F.col("c_nationkey").cast("double").alias("scalar"))
    return n.join(c, "graph_id")


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, cls, scalar, bin, weight: line numbers of each supplier's lines."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_linenumber").cast("int").alias("bin")).agg(F.count("*").cast("double").alias("weight"))
    return li.select("sample_id", F.when(F.col("sample_id") % 2 == 0, "a").otherwise("b").alias("cls"), (F.col("sample_id") % 10).cast("double").alias("scalar"), "bin", "weight")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, cls, scalar, vec: absolute components of the embeddings."""
    e = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull())
    return e.select(F.col("vec_id").alias("sample_id"), F.when(F.col("label") < 5, "a").otherwise("b").alias("cls"), F.col("label").cast("double").alias("scalar"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("vec"))


def scan_stats(spark: SparkSession, paths: list[str], columns: list[str], filters: list | None = None, thinning: float | int = 1.0, order: str = "graph_id") -> DataFrame:
    """Records of several datasets with their number; filtered, then thinned.

    An integer k keeps each k-th record; a fraction t the first of each
    max(1, round(1/t)).
    """
    if filters is not None and len(filters) != len(paths):
        raise ValueError("as many filters as paths are needed")
    out = None
    for k, path in enumerate(paths):
        part = spark.read.parquet(path)
        if filters and filters[k] is not None:
            part = part.filter(filters[k](part))
        part = part.withColumn("dataset", F.lit(k + 1))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return thin(out, ["dataset"], order, thinning).select("dataset", *columns)


def thin(df: DataFrame, by: list[str], order: str, thinning: float | int) -> DataFrame:
    step, first = (thinning, 0) if isinstance(thinning, int) and not isinstance(thinning, bool) else (max(1, round(1 / thinning)), 1)
    if step == 1:
        return df
    return ranked_within(df, by, [order], "_seen").filter((F.col("_seen") - first) % step == 0).drop("_seen")


def with_size(graphs: DataFrame, name: str = "size") -> DataFrame:
    """Records with the number of atoms as DOUBLE."""
    return graphs.withColumn(name, numeric(graphs, "n"))


def of_kind(graphs: DataFrame, kind: str, kinds: dict[str, list[str]]) -> DataFrame:
    """graph_id, n and the columns that this kind of graphs has; an unknown kind is an error."""
    if kind not in kinds:
        raise ValueError(f"not a kind: {kind}; known are {sorted(kinds)}")
    return graphs.filter(F.col("cls") == kind).select("graph_id", "n", *kinds[kind])


def write_statistics(records: DataFrame, path: str, kind: str, meta: dict[str, float]) -> int:
    """Records in a folder for each kind, published as the next version of the dataset; returns its number.

    Records go to a folder of their own first.  Then one manifest is added: the
    version, that folder, the run's numbers and how many records of each kind it
    holds.  Its file appears by one rename, so a reader sees the old version or
    the whole new one, and a write that is killed before leaves the old one.
    """
    spark = records.sparkSession
    folder = f"records-{uuid.uuid4().hex}"
    records.write.partitionBy(kind).parquet(f"{path}/{folder}")
    of = spark.read.parquet(f"{path}/{folder}") if not records.limit(1).isEmpty() else None
    counts = {str(r[kind]): r["n"] for r in of.groupBy(kind).agg(F.count("*").alias("n")).collect()} if of is not None else {}  # a row a kind
    version = max((m["version"] for m in manifests(spark, path)), default=0) + 1
    row = (version, folder, kind, counts, {k: float(v) for k, v in meta.items()}, records.schema.json())
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifests")
    return version


MANIFEST = "version long, folder string, kind string, counts map<string,long>, meta map<string,double>, schema string"


def manifests(spark: SparkSession, path: str) -> list:
    """The published versions, oldest first (a row each)."""
    try:
        found = spark.read.schema(MANIFEST).json(f"{path}/manifests")
    except AnalysisException:  # nothing was published yet
        return []
    return sorted(found.filter("version is not null").collect(), key=lambda m: (m["version"], m["folder"]))


def _published(spark: SparkSession, path: str, version: int | None) -> Row:
    every = [m for m in manifests(spark, path) if version is None or m["version"] == version]
    if not every:
        raise ValueError(f"no published version under {path}" if version is None else f"no version {version} under {path}")
    return every[-1]


def read_statistics(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Records of the last published version, or the one named, with the run's numbers beside them."""
    m = _published(spark, path, version)
    records = spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(f"{path}/{m['folder']}")
    return records.select("*", *[F.lit(v).alias(k) for k, v in sorted(m["meta"].items())])


def miscounted(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """kind, written, found: the kinds of a version that don't hold as many records as its manifest says."""
    m = _published(spark, path, version)
    found = read_statistics(spark, path, m["version"]).groupBy(F.coalesce(F.col(m["kind"]).cast("string"), F.lit("None")).alias("kind")).agg(F.count("*").alias("found"))
    written = spark.createDataFrame(list(m["counts"].items()), "kind string, written long")
    both = written.join(found, written["kind"].eqNullSafe(found["kind"]), "full")
    return both.select(F.coalesce(written["kind"], found["kind"]).alias("kind"), F.coalesce("written", F.lit(0)).alias("written"), F.coalesce("found", F.lit(0)).alias("found")).filter("written <> found")


def write_rows(rows: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def size_scan(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Records of the ensembles in folders named kind_size_count, with size and count."""
    found = F.regexp_extract("_metadata.file_path", r"([^/]+)_(\d+)_(\d+)/[^/]+$", 0)
    part = lambda k: F.regexp_extract("_folder", r"([^/]+)_(\d+)_(\d+)/", k)
    rows = spark.read.parquet(f"{root}/{kind}_*").select("*", found.alias("_folder"))
    return rows.withColumn("size", part(2).cast("int")).withColumn("count", part(3).cast("int")).drop("_folder")


#: What an observable's name stands for: its field, whether it is a histogram, and how it is normalised.
OBSERVABLES = {
    "connectivity": ("connectivity", False, None),
    "link_degree": ("degree", True, "probability"),
    "relation_degree": ("degree", True, "probability"),
    "height": ("height", True, "max"),
    "cardinality": ("weight", True, "probability"),
}


def observable(name: str) -> tuple[str, bool, str | None]:
    if name not in OBSERVABLES:
        raise ValueError(f"not an observable: {name}; known are {sorted(OBSERVABLES)}")
    return OBSERVABLES[name]


def numeric(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE; an error unless it is numeric."""
    if df.schema[name].dataType.typeName() not in {"byte", "short", "integer", "long", "float", "double"} and not df.schema[name].dataType.typeName().startswith("decimal"):
        raise TypeError(f"not numeric: {name}")
    return F.col(name).cast("double")
