"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal text.  Block j of a source that is due
q of every P slots is released at slot floor(jP/q) with deadline
ceil((j+1)P/q); earliest deadline first then serves each source with a
deviation of less than one block from its weight.  The schedule of one round of
P slots repeats, so its size follows the number of classes, not the data;
documents find their slots by broadcasting it.  The largest sources are a
class each; all smaller ones together are one, whose own slots they share in
order of their deadlines.  DataFrame functions only.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordergraph.operators.ordered import sums_before

from .common import before, checkpoint, packed

#: So many of the largest sources are scheduled each by itself; this bounds the
#: schedule.  Those beyond share a class of the sum of their weights, and are
#: interleaved in it by deadlines: a document with which its source has n
#: characters is due at n over the source's weight.
CLASSES = 256


def edf_round(quotas: dict, slots: int) -> dict[object, list[int]]:
    """Slots of each source's blocks in one round; quotas add up to ``slots``."""
    waiting = [[] for _ in range(slots)]
    for name, q in quotas.items():
        for j in range(q):
            waiting[j * slots // q].append((-(-(j + 1) * slots // q), name, j))
    ready: list = []
    out: dict[object, list[int]] = {name: [] for name in quotas}
    for now in range(slots):
        for job in waiting[now]:
            heapq.heappush(ready, job)
        deadline, name, _ = heapq.heappop(ready)
        assert deadline > now
        out[name].append(now)
    return out


def _quotas(weights: dict, slots: int) -> dict:
    """Largest remainders over ``slots``, at least one for each source."""
    total = sum(weights.values())
    exact = {k: max(1.0, slots * w / total) for k, w in weights.items()}
    out = {k: int(v) for k, v in exact.items()}
    order = sorted(weights, key=lambda k: (int(exact[k]) - exact[k], k))
    while (left := slots - sum(out.values())) != 0:
        for k in order if left > 0 else sorted(out, key=lambda k: (-out[k], k)):
            if left == 0:
                break
            if left > 0 or out[k] > 1:
                out[k] += 1 if left > 0 else -1
                left += -1 if left > 0 else 1
    return out


def schedule(blocks: dict, weights: dict, slots: int) -> list[dict]:
    """Phases of repeated rounds; one ends when a source runs out of blocks.

    The rest then shares its weight.  Each entry: source, first (its first
    block in the phase), last (after its last), base (the phase's first slot),
    slots (its slots in a round), round (slots in a round).
    """
    left, done, base, out = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        quotas = _quotas({k: weights[k] for k in left}, slots)
        table = edf_round(quotas, slots)
        whole = min(n // quotas[k] for k, n in left.items())
        for rounds, each in ((whole, quotas), (1, {k: min(quotas[k], n - whole * quotas[k]) for k, n in left.items()})):
            for k, n in each.items() if rounds else ():
                out.append({"source": k, "first": done[k], "last": done[k] + rounds * n, "base": base, "slots": table[k], "round": slots})
                done[k] += rounds * n
            base += rounds * slots
        left = {k: blocks[k] - done[k] for k in left if blocks[k] > done[k]}
    return out


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    block_chars: int = 65536,
    slots: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Columns row, source_key, block, slot, block_offset: every row, each once.

    The mixed order is (slot, block_offset, doc_id).  Within a source,
    documents are in the order of a hash, and within the class of the smaller
    sources (see CLASSES) in the order of deadlines; block = characters
    before the document in its class, divided by ``block_chars``.  ``weights`` are by source and
    default to characters to the power ``temperature``; a source without a
    weight is an error.  When a class runs out, the others share its slots,
    so no row is dropped or repeated.

    Null text or an empty one counts one character.  Null source: a source of
    its own, named ``""`` with the empty one.  Null doc_id and repeated rows
    are placed by their text.  An empty table gives none.
    """
    if slots < 2 * (CLASSES + 1):
        raise ValueError(f"at least {2 * (CLASSES + 1)} slots are needed")
    spark = docs.sparkSession
    size = F.greatest(F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(1)).cast("long")
    rows = packed(docs, s=F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")), d=F.col(f"`{doc_id}`"), chars=size, h=F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    buckets = max(1, docs.count() // 1024)
    rows = rows.withColumn("b", F.pmod("h", F.lit(buckets)))
    sums = checkpoint(rows.groupBy("s", "b").agg(F.sum("chars").alias("sum_chars")))
    totals = sums.groupBy("s").agg(F.sum("sum_chars").alias("n"))
    if weights is None:
        totals = totals.withColumn("w", F.pow("n", F.lit(temperature)))
    else:
        given = _literal(spark, [{"at": k, "w": float(w)} for k, w in weights.items()], "at:string,w:double")
        totals = totals.join(given, F.col("s") == F.col("at"), "left").select("s", "n", "w")
    totals = checkpoint(totals)
    if missing := totals.filter("w is null or not w > 0").limit(5).collect():
        raise ValueError(f"no weight for {sorted(r['s'] for r in missing)}")
    large = totals.orderBy(F.desc("n"), "s").limit(CLASSES).collect()
    classes = _literal(spark, [{"in_s": r["s"], "nth": k} for k, r in enumerate(large)], "in_s:string,nth:int")  # at most CLASSES rows
    rest = totals.join(F.broadcast(classes), F.col("s") == F.col("in_s"), "left_anti").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    every = {k: (r["n"], r["w"]) for k, r in enumerate(large)} | ({CLASSES: (rest["n"], rest["w"])} if rest["n"] else {})
    plan = schedule({k: -(-n // block_chars) for k, (n, _) in every.items()}, {k: w for k, (_, w) in every.items()}, slots)

    classed = lambda df: df.join(F.broadcast(classes), F.col("s") == F.col("in_s"), "left").withColumn("nth", F.coalesce("nth", F.lit(CLASSES))).drop("in_s")
    starts = before(sums, "s", "b", "sum_chars").select(F.col("s").alias("at_s"), F.col("b").alias("at_b"), F.col("before").alias("start"))
    own = Window.partitionBy("s", "b").orderBy("h", "d").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("chars").over(own), F.lit(0)))
    rows = classed(rows.join(starts, (F.col("s") == F.col("at_s")) & (F.col("b") == F.col("at_b"))).withColumn("at", F.col("start") + F.col("within")))
    placed = rows.select("row", "s", "nth", "at") if not rest["n"] else rows.filter(F.col("nth") < CLASSES).select("row", "s", "nth", "at").unionByName(_by_deadline(rows.filter(F.col("nth") == CLASSES), totals))
    rows = placed.select("row", "s", "nth", F.floor(F.col("at") / block_chars).alias("block"), (F.col("at") % block_chars).alias("block_offset"))
    phases = _literal(spark, plan, "source:int,first:long,last:long,base:long,slots:array<int>,round:int")
    placed = rows.join(F.broadcast(phases), (F.col("nth") == F.col("source")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("last")))
    return placed.select("row", F.col("s").alias("source_key"), "block", _slot().alias("slot"), "block_offset")


def _by_deadline(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows of the smaller sources, ``at`` counted over all of them in order of deadlines.

    Rows are dealt by ranges of that order; the driver adds up one number a range.
    """
    due = rows.join(totals.select(F.col("s").alias("of_s"), "w"), F.col("s") == F.col("of_s"))
    due = due.withColumn("due", F.struct(((F.col("at") + F.col("chars")) / F.col("w")).alias("t"), "s", "h", "d"))
    summed = sums_before(due.select("row", "s", "nth", "due", "chars"), "due", "chars", "at")
    return summed.select("row", "s", "nth", F.col("at").cast("long").alias("at"))


def _literal(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A small table written into the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def _slot() -> Column:
    nth = F.col("block") - F.col("first")
    each = F.least(F.col("last") - F.col("first"), F.size("slots").cast("long"))
    return F.col("base") + F.floor(nth / each) * F.col("round") + F.get("slots", F.pmod(nth, each))
