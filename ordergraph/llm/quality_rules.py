"""Quality rules: cross-document line frequency, beside a few text measures.

Normalised lines are hashed with their host; distinct documents are counted
for each host and line; lines above the limit are removed; documents of which
little is left are rejected.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, checkpoint, join_counted, line_key, once, packed

SYMBOLS = "#*$%&|<>"


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more.

    Windows are hashed (64 bits within one text) and sorted with their
    positions, so equal ones are neighbours: n log n for a text of n words.
    """

    def body(ws: Column) -> Column:
        at = lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p"))
        ordered = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), at))
        twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        found = once(ordered, twice)
        return F.when(F.size(ws) < 3, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))))

    return once(words, body)


def quality_rules(
    docs: DataFrame,
    max_docs: int = 5,
    max_percent: int = 5,
    max_removed: float = 0.7,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """Columns row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, removed_chars, line_chars, kept.

    A line is removed when more than ``max_docs`` distinct documents of its
    host hold it, and more than ``max_percent`` of a hundred of those of the
    host that have a line.  Documents are told apart by a hash of the whole
    normalised text, so copies of a whole document count once and cannot make
    its lines frequent, and a line counts once for a document however often it
    has it.  The smallest doc_id of the host keeps the line.  A document is
    rejected when base_failed, or when the removed lines hold more than
    ``max_removed`` of its line characters.

    Null text: no words, base_failed.  Null host: a host of its own.  Null
    doc_id: measured as any other; its lines are not counted or removed.
    Repeated rows get the same result each.  An empty table gives none.
    """
    rows = packed(docs, d=F.col(f"`{doc_id}`"), x=F.coalesce(F.col(f"`{text}`"), F.lit("")), host=F.col(f"`{host}`")).withColumn("th", F.xxhash64("x"))
    keys = once(
        F.filter(F.transform(F.split("x", "\n", -1), line_key), lambda k: k != ""),
        lambda ks: F.struct(
            F.xxhash64(ks).alias("whole"),
            F.concat(
                F.transform(ks, lambda k, i: F.struct(F.xxhash64("host", k).alias("h1"), F.xxhash64(F.lit(1), "host", k).alias("h2"), F.length(k).alias("chars"), i.alias("pos"))),
                # the host itself, as a line that each of its documents with a line has once
                F.when(F.size(ks) > 0, F.array(F.struct(F.xxhash64("host").alias("h1"), F.xxhash64(F.lit(1), "host").alias("h2"), F.lit(0).alias("chars"), F.lit(-1).alias("pos")))).otherwise(F.array()),
            ).alias("ks"),
        ),
    )
    lines = rows.filter(F.col("d").isNotNull()).select("d", "th", F.xxhash64("host").alias("in1"), F.xxhash64(F.lit(1), "host").alias("in2"), keys.alias("l"))
    lines = lines.select("d", "th", "in1", "in2", "l.whole", F.explode("l.ks").alias("k")).select("d", "th", "in1", "in2", "whole", "k.*")
    # most lines are too rare to need their documents told apart
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs)
    hits = checkpoint(join_counted(lines, checkpoint(often), ["h1", "h2"], "n", F.xxhash64("d", "pos")))
    held = hits.groupBy("h1", "h2", "whole").agg(F.min("d").alias("first_d"), F.count("*").alias("n"), F.min("in1").alias("in1"), F.min("in2").alias("in2"), F.min("pos").alias("pos"))
    counts = checkpoint(held.groupBy("h1", "h2").agg(F.min("first_d").alias("first_d"), F.sum("n").alias("n"), F.count("*").alias("n_docs"), F.min("in1").alias("in1"), F.min("in2").alias("in2"), F.min("pos").alias("pos")))
    hosts = counts.filter("pos < 0").select(F.col("h1").alias("in1"), F.col("h2").alias("in2"), F.col("n_docs").alias("host_docs"))
    frequent = counts.filter((F.col("pos") >= 0) & (F.col("n_docs") > max_docs)).join(hosts, ["in1", "in2"])
    frequent = frequent.filter(100 * F.col("n_docs") > max_percent * F.col("host_docs")).select("h1", "h2", "first_d", "n")
    hits = join_counted(hits.filter("pos >= 0").select("d", "th", "h1", "h2", "chars", "pos"), checkpoint(frequent), ["h1", "h2"], "n", F.xxhash64("d", "pos"))
    # repeated rows have each position once
    removed = hits.filter("d > first_d").dropDuplicates(["d", "th", "pos"]).groupBy(F.col("d").alias("cut_d"), F.col("th").alias("cut_th")).agg(F.sum("chars").alias("removed"))

    words = F.array_remove(F.split(F.translate("x", WS, " " * len(WS)), " ", -1), "")
    lines_with_words = F.filter(F.split("x", "\n", -1), lambda l: F.btrim(l, F.lit(WS)) != "")
    measured = rows.select(
        "*",
        once(words, lambda ws: F.struct(F.size(ws).alias("n"), _repeat_words(ws).alias("repeated"))).alias("w"),
        F.length(F.translate("x", WS, "")).cast("long").alias("word_chars"),
        (F.length("x") - F.length(F.translate("x", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        once(lines_with_words, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.aggregate(F.split("x", "\n", -1), F.lit(0), lambda a, l: a + F.length(F.btrim(l, F.lit(WS)))).alias("line_chars"),
    )
    both = measured.join(removed, (F.col("d") == F.col("cut_d")) & (F.col("th") == F.col("cut_th")), "left")
    n_words, repeated, cut = F.col("w.n").cast("long"), F.col("w.repeated").cast("long"), F.coalesce("removed", F.lit(0))
    failed = (n_words < min_words) | (100 * repeated > max_repeat_percent * n_words)
    return both.select(
        "row",
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        cut.cast("long").alias("removed_chars"),
        F.col("line_chars").cast("long").alias("line_chars"),
        (~failed & (cut <= max_removed * F.col("line_chars"))).alias("kept"),
    )
