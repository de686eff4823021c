"""Line dedup: lines that occur in several documents stay in the first only.

Lines are normalised, exploded and hashed (128 bits); a key's documents are
counted by a partial aggregation; lines over the threshold are dropped by
their positions and the rest is put together again in order.  DataFrame
functions only.  Texts are shuffled once, in the last join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_counted, line_key, once, packed

NEWLINE = "\n"


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), NEWLINE, -1)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns row (the input row), kept_text, n_lines, n_dropped.

    A line's key is the line stripped of ASCII white space, with A-Z in lower
    case.  Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose their lines, except those in the smallest doc_id.

    Null or empty text: one empty line.  Null doc_id: the row holds no keys
    and keeps its lines.  Rows with one doc_id count as one document; repeated
    rows get the same result each.  Ties cannot occur: the smallest id is one
    document.  An empty table gives an empty table.
    """
    rows = packed(docs, d=F.col(f"`{doc_id}`"), x=F.col(f"`{text}`")).withColumn("th", F.xxhash64("x"))
    lines = (
        rows.filter(F.col("d").isNotNull())
        .select("d", "th", F.posexplode(F.transform(_lines(F.col("x")), line_key)).alias("pos", "key"))
        .filter(F.length("key") >= min_chars)
        .select("d", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    held = lines.groupBy("h1", "h2")
    if min_docs == 2:
        shared = held.agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count("*").alias("n")).filter("first_d < last_d").drop("last_d")
    else:
        each = lines.groupBy("h1", "h2", "d").agg(F.count("*").alias("n"))
        shared = each.groupBy("h1", "h2").agg(F.min("d").alias("first_d"), F.count("*").alias("n_docs"), F.sum("n").alias("n")).filter(F.col("n_docs") >= min_docs).drop("n_docs")
    hits = join_counted(lines, checkpoint(shared), ["h1", "h2"], "n", F.xxhash64("d", "pos"))
    drops = hits.filter("d > first_d").groupBy(F.col("d").alias("drop_d"), F.col("th").alias("drop_th")).agg(F.collect_set("pos").alias("drops"))
    both = rows.join(drops, (F.col("d") == F.col("drop_d")) & (F.col("th") == F.col("drop_th")), "left")
    kept = once(
        _lines(F.col("x")),
        lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drops")), lambda i: F.get(ls, i)), NEWLINE),
    )
    return both.select(
        "row",
        F.when(F.col("drops").isNull(), F.coalesce("x", F.lit(""))).otherwise(kept).alias("kept_text"),
        (F.length(F.coalesce("x", F.lit(""))) - F.length(F.translate(F.coalesce("x", F.lit("")), NEWLINE, "")) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
