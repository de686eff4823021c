"""The corpus pipeline: five of the operators, one after another, over documents.

Each stage reads its predecessor's rows, written as Parquet, and all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordergraph.llm import common, line_dedup, mixing, near_dedup, packing, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null texts go, null ids are judged as any."""
    return quality_rules.quality_rules(docs).filter("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no line with a word is left, as others hold them all, go;
    those that had none before stay."""
    worded = lambda c: F.length(F.btrim(F.coalesce(c, F.lit("")), F.lit(common.WS + "\n"))) > 0
    own = [F.col("kept_text").alias("text") if c == "text" else F.length("kept_text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"row.{c}") for c in docs.columns]
    out = line_dedup.dedup_lines(docs)
    return out.filter(worded(F.col("kept_text")) | ~worded(F.col("row.text"))).select(*own)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies; repeated rows of it stay each."""
    return near_dedup.near_duplicates(docs).filter("kept").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows, written in the mixed order."""
    mixed = mixing.mix_sources(docs)
    return mixed.repartitionByRange("slot", "block_offset").sortWithinPartitions("slot", "block_offset", "row.doc_id").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, in the order in which the mixing stage wrote its files."""
    file = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    return packing.pack(docs, place=F.shiftleft(F.coalesce(file, F.lit(0)), 40) + F.col("_metadata.row_index"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]

#: SQL can express neither the schedule's earliest deadlines nor the packing's linear program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each returns is written to the shared folder,
    read by the next, and removed once that has written its own, or if the run fails."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    done = ()
    try:
        for k, (name, stage) in enumerate(STAGES):
            docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
            scratch.clear(keep=(f"{k}-{name}",))
        done = (f"{len(STAGES) - 1}-{STAGES[-1][0]}",)
    finally:  # a failed run leaves no stage behind
        scratch.clear(keep=done)
    return docs
