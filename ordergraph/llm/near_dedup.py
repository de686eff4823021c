"""Near-duplicates by SetSketch: mergeable registers, bands, likelihood, exact check.

One pass sketches each document's shingle set; documents with one set are one
class.  Classes that share a band of register values are candidates.  In each
round a bucket has a leader, with which the others are compared: registers
first, by their joint likelihood, then the full sets of the pairs that it
allows.  Confirmed links contract to components, and buckets of one component
close; rounds go on while they close enough.  What stays apart within a bucket
is compared block by block, without a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted, packed
from .shingles import WordHashes, jaccard_at_least, mixed, shingles

REGISTERS, BAND = 128, 4
#: Parameters of the sketch: the base of the exponential spacing, the rate, and the largest register value.
BASE, RATE, TOP = 1.1, 20.0, 255
#: Standard errors of the estimate by which a pair of registers may fall short of the threshold.
ERRORS = 5
_rng = np.random.default_rng(20240229)
SEEDS = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
FACTORS = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLY = np.uint64(0xD6E8FEB86659FD93)
#: Shingles that are sketched at once; the registers of a larger set are merged from pieces.
PIECE = 1 << 16


def merge(registers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers of unions: the larger value of each register, over rows from one start to the next."""
    return np.maximum.reduceat(registers, starts, axis=0)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of several non-empty sets, one row each (uint8).

    Register j of a set holds 1 - log_b(x / a), rounded down and truncated to
    0 .. TOP, for the smallest x of its members' exponential variables.
    """
    pieces = [s[k : k + PIECE] for s in sets for k in range(0, len(s), PIECE)]
    ends = np.cumsum([0] + [len(s) for s in pieces[:-1]])
    every = np.concatenate(pieces)
    out = np.empty((len(pieces), REGISTERS), dtype=np.uint8)
    for j in range(REGISTERS):
        x = (every ^ SEEDS[j]) * FACTORS[j]
        x ^= x >> np.uint64(32)
        x *= MULTIPLY
        least = np.minimum.reduceat(x, ends).astype(np.float64)
        value = np.floor(1 - np.log(-np.log1p(-(least + 1) / 2.0**64) / RATE) / np.log(BASE))
        out[:, j] = np.clip(value, 0, TOP)
    each = np.array([-(-len(s) // PIECE) for s in sets])
    return merge(out, np.cumsum(each) - each)


def band_keys(registers: str) -> Column:
    """band, key of each band of a row's registers (one byte each); bands have different keys."""
    return F.posexplode(F.array(*[F.xxhash64(F.lit(k), F.substring(registers, 1 + k * BAND, BAND)) for k in range(REGISTERS // BAND)])).alias("band", "key")


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """Jaccard similarity of the greatest joint likelihood of two sketches,
    given the sizes of the sets."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.linspace(0, min(u / v, v / u), 200)
    share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = share(u - v * j), share(v - u * j)
    more, less = int((a > b).sum()), int((a < b).sum())
    tiny = 1e-12
    fit = more * np.log(up + tiny) + less * np.log(down + tiny) + (len(a) - more - less) * np.log(np.maximum(1 - up - down, tiny))
    return float(j[fit.argmax()])


def slope(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, j: float) -> np.ndarray:
    """Slope at similarity ``j`` of the log-likelihood of pairs of sketches, of
    which ``more`` registers are larger in the first and ``less`` smaller.

    The log-likelihood is concave, so its peak (see likely_jaccard) lies at
    ``j`` or above exactly where the slope is not negative.
    """
    u = n_a / (n_a + n_b)
    v, c, tiny = 1 - u, (BASE - 1) / BASE, 1e-12
    x, y = 1 - np.clip(u - v * j, 0, 1) * c, 1 - np.clip(v - u * j, 0, 1) * c
    up, down = -np.log(x) / np.log(BASE), -np.log(y) / np.log(BASE)
    d_up, d_down = -c * v / x / np.log(BASE), -c * u / y / np.log(BASE)
    return more * d_up / (up + tiny) + less * d_down / (down + tiny) - (REGISTERS - more - less) * (d_up + d_down) / np.maximum(1 - up - down, tiny)


def least_likely(percent: int) -> float:
    """The similarity that an estimate must reach: ERRORS standard errors below
    the threshold, so that a link is lost less often by it than by the bands."""
    j = percent / 100
    return j - ERRORS * (j * (1 - j) / REGISTERS) ** 0.5


def sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d, th (hash of the text), n_shingles, s1, s2 (hash of the set), registers."""
    schema = "d long, th long, n_shingles long, s1 long, s2 long, registers binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for whole in batches:
            for k in range(0, len(whole), 500):
                batch = whole.iloc[k : k + 500]
                sets = [shingles(x if isinstance(x, str) else None, hashes) for x in batch["x"]]
                full = [s for s in sets if len(s)]
                rows = iter(sketch(full)) if full else iter(())
                out = []
                for s in sets:
                    if not len(s):
                        out.append((0, 0, 0, None))
                        continue
                    r = next(rows)
                    sums = [int(mixed(s + np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for c in (1, 2)]
                    out.append((len(s), *sums, r.tobytes()))
                frame = pd.DataFrame(out, columns=["n_shingles", "s1", "s2", "registers"])
                frame.insert(0, "d", np.where(batch["no_id"], None, batch["d"].astype(object)))
                frame.insert(1, "th", batch["th"].to_numpy())
                yield frame

    x = F.col(f"`{text}`")
    d = F.col(f"`{doc_id}`").cast("long")
    # pandas has no 64-bit integers beside nulls, so an id goes with a mark of its own for null
    return docs.select(F.coalesce(d, F.lit(0)).alias("d"), d.isNull().alias("no_id"), F.xxhash64(x).alias("th"), x.alias("x")).mapInPandas(run, schema)


def _cell_pairs(cell: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a cell that could be links.

    A pair counts if its components differ, its sizes and registers allow the
    similarity and this bucket is of the first band that the two share, so
    that it is judged in one bucket only.
    """
    registers = np.stack([np.frombuffer(r, np.uint8) for r in cell["registers"]])
    size, comp, block = (cell[c].to_numpy() for c in ("size", "comp", "block"))
    low, high = np.flatnonzero(block == cell["i"].iat[0]), np.flatnonzero(block == cell["j"].iat[0])
    if not len(low) or not len(high):
        return low[:0], low[:0]
    na, nb = size[low].astype(np.float64), size[high].astype(np.float64)
    ok = (comp[low][:, None] != comp[high][None, :]) & (100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :]))
    if cell["i"].iat[0] == cell["j"].iat[0]:
        ok = np.triu(ok, 1)
    p, q = (x[k] for x, k in zip((low, high), np.nonzero(ok)))
    found = []
    for k in range(0, len(p), 50_000):
        a, b = p[k : k + 50_000], q[k : k + 50_000]
        ra, rb = registers[a], registers[b]
        more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
        likely = slope(more, less, size[a].astype(np.float64), size[b].astype(np.float64), least_likely(percent)) >= 0
        first = (ra[likely] == rb[likely]).reshape(-1, REGISTERS // BAND, BAND).all(axis=2).argmax(axis=1)
        found.append(k + np.flatnonzero(likely)[first == cell["band"].iat[0]])
    here = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    return p[here], q[here]


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each cell (key, i, j), which come one after another."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        at = batch[["key", "i", "j"]].to_numpy()
        ends = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
        cuts = np.r_[0, ends]
        for k in range(len(ends)):
            yield batch.iloc[cuts[k] : cuts[k + 1]]
        rest = batch.iloc[cuts[-1] :]
    if rest is not None and len(rest):
        yield rest


def _possible(percent: int):
    """Of each cell, the members of any pair that could be a link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _cells(batches):
            p, q = _cell_pairs(cell, percent)
            if len(p):
                yield cell.iloc[np.unique(np.concatenate([p, q]))].drop(columns="registers")

    return run


def _forest(percent: int):
    """Of each cell, links (a, b) that join all that its links join: at most one less than its members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for cell in _cells(batches):
            p, q = _cell_pairs(cell, percent)
            if not len(p):
                continue
            sets = [shingles(x, hashes) for x in cell["x"]]
            sizes = np.array([len(s) for s in sets])
            names, codes = np.unique(np.concatenate(sets), return_inverse=True)
            starts, mine = np.r_[0, np.cumsum(sizes)], np.zeros(len(names), dtype=bool)
            node, label, links = cell["node"].to_numpy(), cell["comp"].to_numpy().copy(), []
            order = np.argsort(p, kind="stable")
            heads, begins = np.unique(p[order], return_index=True)
            for one, others in zip(heads, np.split(q[order], begins[1:])):
                others = others[label[others] != label[one]]
                if not len(others):
                    continue
                own = codes[starts[one] : starts[one + 1]]
                mine[own] = True
                for k in range(0, len(others), 256):
                    some = others[k : k + 256]
                    ends = np.r_[0, np.cumsum(sizes[some])[:-1]]
                    both = np.add.reduceat(mine[np.concatenate([codes[starts[o] : starts[o + 1]] for o in some])].astype(np.int64), ends)
                    for o in some[100 * both >= percent * (sizes[one] + sizes[some] - both)]:
                        if label[o] != label[one]:
                            label[label == label[o]] = label[one]
                            links.append((max(node[one], node[o]), min(node[one], node[o])))
                mine[own] = False
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return run


#: Members of a bucket that are compared with as many others in one cell.  A
#: cell holds a few MB of registers; a bucket of n sends each row n / BLOCK times.
BLOCK = 1024


def _across(open_m: DataFrame, whole: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) across components of ``open_m`` (key, band, node, size, comp).

    A bucket's members are dealt to blocks, and each two blocks meet in a
    cell of bounded size.  Pairs exist only inside of cells; a text goes only
    to cells where its registers allow a link.
    """
    sizes = open_m.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumn("again", F.xxhash64("key"))
    counted = open_m.withColumn("again", F.xxhash64("key")).join(sizes.hint("merge"), ["key", "again"]).select("key", "band", "node", "size", "comp", "blocks")
    blocks = F.col("blocks")
    own = counted.withColumn("block", F.pmod(F.xxhash64("node", F.lit(17)), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = own.select("key", "band", "node", "size", "comp", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    near = dealt.join(whole.select("node", "registers").hint("merge"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    schema = "key long, band int, node long, size long, comp long, block int, i int, j int"
    kept = scratch.save(near.select("key", "band", "node", "size", "comp", "block", "i", "j", "registers").mapInPandas(_possible(percent), schema))
    full = kept.join(whole.hint("merge"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return full.mapInPandas(_forest(percent), "a long, b long")


#: Pairs of one leader that are tested in one place.
PART = 4096


def _met(pairs: DataFrame, whole: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b, part, ..) with a column of both nodes, as of_a and of_b.

    The first node's goes with its pair to its leader's part, the leader's
    once to each of its parts, so a leader of any number of pairs is spread.
    """
    mine = pairs.join(whole.select(F.col("node").alias("a"), F.col(column).alias("of_a")).hint("merge"), "a")
    heads = pairs.select("b", "part").distinct().join(whole.select(F.col("node").alias("b"), F.col(column).alias("of_b")).hint("merge"), "b")
    return mine.join(heads.hint("merge"), ["b", "part"])


def _allowed(percent: int):
    """Whether two registers' likelihood, given the sets' sizes, allows a link."""

    @F.pandas_udf("boolean")
    def allowed(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(ra):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(r), np.uint8).reshape(len(r), -1) for r in (ra, rb))
        return pd.Series(slope((a > b).sum(axis=1), (a < b).sum(axis=1), na.to_numpy(float), nb.to_numpy(float), least_likely(percent)) >= 0)

    return allowed


def _tester(percent: int):
    @F.pandas_udf("boolean")
    def linked(ta: pd.Series, tb: pd.Series) -> pd.Series:
        hashes, last = WordHashes(), {}

        def of(text: str) -> np.ndarray:
            if text not in last:
                if len(last) > 8:
                    last.clear()
                last[text] = shingles(text, hashes)
            return last[text]

        return pd.Series([jaccard_at_least(shingles(xa, hashes), of(xb), percent) for xa, xb in zip(ta, tb)], dtype=object)

    return linked


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp: the smallest node that each node of ``links`` (a, b) reaches.

    Each round takes the least label among a node and its neighbours, then the
    label of that label.  Rounds follow the logarithm of the longest path.
    """
    a, b = links.select("a", "b"), links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    own = a.unionByName(b).select("a", F.col("a").alias("b"))
    both = scratch.save(a.unionByName(b).unionByName(own).distinct().withColumn("again", F.xxhash64("b")))
    at = both.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("comp"))
    while True:
        near = both.join(at.select(F.col("node").alias("b"), "comp", _again("node")).hint("merge"), ["b", "again"])
        step = scratch.save(near.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("comp"), F.max(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("old")))
        if step.filter("comp < old").isEmpty():
            return step.select("node", "comp")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"), _again("node"))
        at = step.withColumn("again", F.xxhash64("comp")).join(jump.hint("merge"), ["comp", "again"]).select("node", F.col("next").alias("comp"))


def _again(key: str):
    """The key's hash as a second join key: both sides are then dealt anew and
    Spark can split a hub's rows, as it cannot where a side's layout is kept."""
    return F.xxhash64(key).alias("again")


def _leader(turn: int):
    """The bucket's member that the others are compared with: first the one
    with most company in all its buckets, then another in each round."""
    order = F.struct("company", -F.col("node")) if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
    return F.max_by(F.struct("comp", "node", "size"), order).alias("leader")


def _pairs_of_round(open_m: DataFrame, percent: int) -> DataFrame:
    """a, b, part, size_a, size_b: each node with one of its leaders, that with which it shares most bands."""
    lead = F.col("leader")
    pairs = open_m.filter(F.col("comp") != lead["comp"]).select("node", "size", lead["node"].alias("other"), lead["size"].alias("other_size"))
    pairs = pairs.filter(100 * F.least("size", "other_size") >= percent * F.greatest("size", "other_size"))
    pairs = pairs.groupBy("node", "other", "size", "other_size").agg(F.count("*").alias("shared"))
    best = pairs.groupBy("node").agg(F.max_by(F.struct("other", "size", "other_size"), F.struct("shared", -F.col("other"))).alias("p"))
    return best.select(F.col("node").alias("a"), F.col("p.other").alias("b"), F.col("p.size").alias("size_a"), F.col("p.other_size").alias("size_b"))


def candidate_classes(own: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (s1, s2, d, th, size, registers, n), and the rows
    (key, band, node, size, n) of those that share a band with another."""
    grouped = own.groupBy("s1", "s2").agg(F.min(F.struct("d", "th")).alias("rep"), F.first("n_shingles").alias("size"), F.first("registers").alias("registers"), F.count("*").alias("n"))
    classes = scratch.save(grouped.select("s1", "s2", "rep.*", "size", "registers", "n"))
    keys = classes.select(band_keys("registers"), F.col("d").alias("node"), "size")
    buckets = scratch.save(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "n"))
    return classes, scratch.save(join_counted(keys, buckets, ["key"], "n", F.xxhash64("key", "node")))


def candidate_texts(docs: DataFrame, classes: DataFrame, members: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """node, registers, x of the candidates, dealt by node: rounds read this
    table where it lies, and not the documents."""
    nodes = scratch.save(members.select("node").distinct())
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() // 20_000)
    x = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("x_th"), F.col(f"`{text}`").alias("x"))
    wanted = classes.join(nodes.hint("merge"), F.col("d") == F.col("node")).select("node", "th", "registers")
    found = x.join(wanted.hint("merge"), (F.col("node") == F.col("d")) & (F.col("th") == F.col("x_th")))
    found = found.groupBy("node", "th").agg(F.first("registers").alias("registers"), F.first("x").alias("x")).drop("th")  # repeated rows
    return scratch.save_dealt(found, "node", buckets)


#: Another round of leaders is made while the last one closed at least this share of the open rows.
SHRINK = 0.25


def confirmed_links(members: DataFrame, whole: DataFrame, percent: int, scratch: Scratch, shrink: float = SHRINK) -> DataFrame | None:
    """node, comp of all nodes with a confirmed link, or None without links."""
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    open_m = members.join(company.hint("merge"), "node").select("key", "band", "node", "size", "company", F.col("node").alias("comp"))
    turn, before, links, at = 0, None, None, None
    allowed, linked = _allowed(percent), _tester(percent)
    while True:
        apart = open_m.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), _leader(turn)).filter("c0 < c1").select("key", "leader", _again("key"))
        open_m = scratch.save(open_m.withColumn("again", F.xxhash64("key")).join(apart.hint("merge"), ["key", "again"]).drop("again"))
        rows = open_m.count()
        if not rows:
            return at
        last = before is not None and rows > (1 - shrink) * before
        if last:
            new = scratch.save(_across(open_m, whole, percent, scratch))
        else:
            pairs = scratch.save(_pairs_of_round(open_m, percent))
            heads = scratch.save(pairs.groupBy("b").agg(F.count("*").alias("n")))
            parted = join_counted(pairs, heads, ["b"], "n", F.xxhash64("a")).withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / PART)))
            likely = scratch.save(_met(parted, whole, "registers").filter(allowed("of_a", "of_b", "size_a", "size_b")).select("a", "b", "part"))
            new = scratch.save(_met(likely, whole, "x").filter(linked("of_a", "of_b")).select("a", "b"))
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            at = components(links, scratch)
        if last:
            return at
        open_m = open_m.drop("leader")
        if not new.isEmpty():
            open_m = open_m.drop("comp").join(at.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        turn, before = turn + 1, rows


def near_duplicates(docs: DataFrame, percent: int = 75, shrink: float = SHRINK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns row, n_shingles, component_id, kept.

    Documents are linked when 100 * |A n B| >= ``percent`` * |A u B| for their
    sets of five-word shingles; a component is named by its smallest doc_id,
    which is kept.  ``shrink``: see SHRINK; it decides how the work is done,
    not the result.

    A text without words has an empty set and no links.  Null doc_id: no
    links, no component, kept.  Rows with one doc_id and different texts are
    placed each by its text.  Repeated rows get the same result each.  An
    empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "near")
    seen = scratch.save(sketched(docs, doc_id, text), "seen")
    own = seen.filter("d is not null and n_shingles > 0")
    classes, members = candidate_classes(own, scratch)
    at = None
    if not members.isEmpty():
        at = confirmed_links(members, candidate_texts(docs, classes, members, doc_id, text, scratch), percent, scratch, shrink)

    grouped = classes.select("s1", "s2", "n", F.col("d").alias("component_id"))
    if at is not None:
        grouped = classes.join(at.hint("merge"), F.col("d") == F.col("node"), "left").select("s1", "s2", "n", F.coalesce("comp", "d").alias("component_id"))
    grouped = scratch.save(grouped, "grouped")
    scratch.clear(keep=("seen", "grouped"))
    found = join_counted(own.select("d", "th", "n_shingles", "s1", "s2"), grouped, ["s1", "s2"], "n", F.xxhash64("d", "th"))
    result = found.select("d", "th", "n_shingles", "component_id").unionByName(seen.filter("d is null or n_shingles = 0").select("d", "th", "n_shingles", F.col("d").alias("component_id")))
    result = result.groupBy("d", "th").agg(F.first("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    rows = packed(docs, row_d=F.col(f"`{doc_id}`").cast("long"), row_th=F.xxhash64(F.col(f"`{text}`")))
    out = rows.join(result.hint("merge"), F.col("row_d").eqNullSafe(F.col("d")) & (F.col("row_th") == F.col("th")))
    return out.select("row", "n_shingles", "component_id", (F.col("component_id").isNull() | (F.col("component_id") == F.col("row_d"))).alias("kept"))
