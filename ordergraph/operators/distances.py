"""Distances of vectors of classes, by matrix blocks.

Vectors (sample_id, vec, k) are dealt by a hash to blocks of one class, each
packed as one matrix.  Blocks lie in groups, and a task has a few groups, so a
block is sent a few times, not once for each block.  There every two blocks
meet in a cell, which is one matrix product and gives off sums, counts or
smallest values, never its pairs, unless pairs are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graphs import cut_lineage, written
from .ordered import ranked, sums_before

BLOCK = 1024


def hellinger(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    h = p.sum(axis=1)[:, None] + q.sum(axis=1)[None, :]
    h -= 2 * np.sqrt(p) @ np.sqrt(q).T
    h /= 2
    if len(h) and h.shape[1] and h.min() < -1e-9 * max(1.0, float(np.abs(p).sum(axis=1).max())):
        raise ValueError("negative under the root")
    return np.sqrt(np.maximum(h, 0.0, out=h), out=h)


def total_variation(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    out, across = np.empty((len(p), len(q))), np.ascontiguousarray(q.T)
    apart = np.empty(across.shape)  # one place for all rows, whose sums run along the samples
    for n, row in enumerate(p):
        np.abs(np.subtract(row[:, None], across, out=apart), out=apart).sum(axis=0, out=out[n])
    return 0.5 * out


def squared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances; equal rows have exactly 0."""
    d = np.maximum((p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * p @ q.T, 0.0)
    close = np.nonzero(d < 1e-9 * (1e-30 + (p * p).sum(axis=1)[:, None]))
    for s in range(0, len(close[0]), 65_536):
        i, j = (c[s : s + 65_536] for c in close)
        d[i, j] = ((p[i] - q[j]) ** 2).sum(axis=1)
    return d


def unit(v: Column) -> Column:
    """The vector over its sum, which is added up once."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, e: a + e)
    return F.transform(F.array(F.struct(v.alias("v"), total(v).alias("s"))), lambda x: F.transform(x["v"], lambda e: e / x["s"]))[0]


def keyed(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select("sample_id", "vec", F.col(key).alias("k"))


class Cell(NamedTuple):
    """Two blocks: classes, ids, places in their classes, values beside the vectors, and distances."""

    k1: object
    k2: object
    ids1: np.ndarray
    ids2: np.ndarray
    at1: np.ndarray
    at2: np.ndarray
    x1: np.ndarray
    x2: np.ndarray
    d: np.ndarray
    same: bool
    todo: np.ndarray | None = None


def blocks(vectors: DataFrame, size: int = BLOCK, seed: int = 0) -> tuple[DataFrame, dict]:
    """no, k, start (place in the class of its first row), n, ids, data; and the classes' sizes.

    Places in a class are those of a hash of sample_id, so the first m are a random draw.
    """
    kind = vectors.schema["k"].dataType.simpleString()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample_id")
        data = np.stack([np.asarray(v, dtype=np.float64) for v in rows["vec"]])
        return pd.DataFrame([(rows["k"].iat[0], rows["part"].iat[0], len(rows), rows["sample_id"].to_numpy(np.int64).tobytes(), data.tobytes())], columns=["k", "part", "n", "ids", "data"])

    parts = vectors.groupBy(F.col("k").alias("of")).agg(F.greatest(F.floor(F.count("*") / F.lit(size)), F.lit(1)).alias("parts"))  # one row a class
    dealt = vectors.join(F.broadcast(parts), F.col("k").eqNullSafe(F.col("of"))).select(F.col("sample_id").cast("long").alias("sample_id"), "vec", "k", F.pmod(F.xxhash64("sample_id", F.lit(seed)), F.col("parts")).alias("part"))
    packed = cut_lineage(dealt.groupBy("k", "part").applyInPandas(pack, f"k {kind}, part long, n int, ids binary, data binary"))
    each = packed.select("k", "part", F.col("n").cast("long").alias("n"))
    many = each.count() > LISTED
    named, sizes = _numbered(each) if many else _listed(each, kind)
    named = named if many else F.broadcast(named)
    if not sizes:
        return packed.select(F.lit(0).alias("no"), "k", F.lit(0).cast("long").alias("start"), "n", "ids", "data"), sizes
    return packed.join(named, (F.col("k") == F.col("name")) & (F.col("part") == F.col("at"))).select("no", "k", "start", "n", "ids", "data"), sizes


#: Blocks of a class that the driver may list; more are numbered by a job.
LISTED = 20_000


def _listed(each: DataFrame, kind: str) -> tuple[DataFrame, dict]:
    """no, name, at, start of each block in the order of classes, and the classes' sizes."""
    names, sizes = [], {}
    for no, r in enumerate(each.orderBy("k", "part").collect()):
        names.append((no, r["k"], r["part"], sizes.get(r["k"], 0)))
        sizes[r["k"]] = sizes.get(r["k"], 0) + r["n"]
    return each.sparkSession.createDataFrame(names, f"no int, name {kind}, at long, start long"), sizes


def _numbered(each: DataFrame) -> tuple[DataFrame, dict]:
    """The same, without a list on the driver."""
    numbered = cut_lineage(ranked(each, ["k", "part"], "no"))
    before = sums_before(numbered, "no", "n", "all_before")
    before = cut_lineage(before.select((F.col("no") - 1).cast("int").alias("no"), F.col("k").alias("name"), F.col("part").alias("at"), "all_before", F.col("n").alias("size")))
    of_class = before.groupBy("name").agg(F.sum("size").alias("size"), F.min("all_before").alias("first")).select(F.col("name").alias("of"), "size", "first")
    sizes = {r["of"]: r["size"] for r in of_class.collect()}  # one row a class
    named = before.drop("size").join(of_class.drop("size"), F.col("name") == F.col("of")).select("no", "name", "at", (F.col("all_before") - F.col("first")).alias("start"))
    return named, sizes


#: Groups of blocks at least where they meet in pairs, if there are as many blocks.
GROUPS = 8
#: Bytes of a group's blocks that are aimed at, at most; more data have more groups.
GROUP_BYTES = 64 << 20
#: Tasks at least where groups meet by lines of a plane, and bytes of a task's groups that are aimed at, at most.
LINES, LINE_BYTES = 24, 192 << 20
#: Rows that a task gathers before it gives them off.
GATHERED = 1 << 17


def plane(q: int) -> list[list[int]]:
    """The lines of the projective plane over a prime q: q * q + q + 1 sets of q + 1 of as many points, and every two points are in one."""
    lines = [[x * q + (m * x + b) % q for x in range(q)] + [q * q + m] for m in range(q) for b in range(q)]
    lines += [[x * q + y for y in range(q)] + [q * q + q] for x in range(q)]
    return [*lines, list(range(q * q, q * q + q + 1))]


def order_of_plane(lines: float, size: int) -> int:
    """The least prime whose plane has so many lines, each with at most LINE_BYTES of ``size``."""
    q = 2
    while q * q + q + 1 < lines or size * (q + 1) > LINE_BYTES * (q * q + q + 1) or any(q % x == 0 for x in range(2, q)):
        q += 1
    return q


def _by_lines(first: int, q: int, held: set) -> list[dict[int, bool]]:
    """For each line its groups of those that are ``held``, which are numbered from ``first``, and whether a group meets itself there."""
    met = [{first + p: False for p in line if first + p in held} for line in plane(q)]
    for g in sorted(held):  # where the fewest do
        min((m for m in met if g in m), key=lambda m: sum(m.values()))[g] = True
    return [m for m in met if len(m) > 1 or any(m.values())]


def _in_one_plane(low: int, high: int, size: int) -> tuple[int, int, int]:
    return low, high, order_of_plane(LINES if high - low > 7 else 1, size)


def _dealt_to(held: DataFrame, spans: list[tuple[int, int, int]]) -> tuple[DataFrame, list[dict[int, bool]]]:
    """The rows with their group, ``grp``, and for each meeting its groups and whether a group meets itself there.

    ``spans``: numbers from and up to which blocks share a plane, and its order.
    """
    met, first, starts = [], 0, []
    for low, high, q in spans:
        points = q * q + q + 1
        met += _by_lines(first, q, {first + (no - low) * points // (high - low) for no in range(low, high)})
        starts.append((low, high, points, first))
        first += points
    dealt_to = held.sparkSession.createDataFrame(starts, "low int, high int, points long, first long")
    at = (F.col("first") + F.floor((F.col("no") - F.col("low")) * F.col("points") / (F.col("high") - F.col("low")))).cast("int")
    return held.join(F.broadcast(dealt_to), (F.col("no") >= F.col("low")) & (F.col("no") < F.col("high"))).withColumn("grp", at).drop("low", "high", "points", "first"), met


def in_lines(table: DataFrame) -> tuple[DataFrame, list[dict[int, bool]]]:
    """The same for blocks that all meet, in one plane."""
    r = table.agg(F.min("no").alias("low"), F.max("no").alias("high"), F.sum(F.length("data")).alias("size")).first()
    return _dealt_to(table, [_in_one_plane(r["low"], r["high"] + 1, r["size"])])


def meetings(table: DataFrame, run: Callable[[list, list], Iterator[pd.DataFrame]], schema: str, pairs: str = "all", wanted: set | None = None, groups: int | None = None) -> DataFrame:
    """What ``run`` gives for the packed rows (no, k, data and more) of two groups, or all rows of a task twice; every two groups meet in one task.

    A row also has its group, ``grp``, and ``own``, whether the group meets itself in the task.
    Rows are numbered from 0 in the order of k.  All groups, or those of one
    class where only classes meet themselves, are the points of a projective
    plane and each of its lines is a task, which so has q + 1 groups, and a row
    is sent q + 1 times: 6 for 31 tasks, 4 for 13 tasks of each of two classes.
    The order q grows only where a line would hold more than LINE_BYTES.
    With ``wanted`` (pairs of classes), or many classes that only meet
    themselves, groups meet in pairs instead, and those without a pair of
    classes to meet don't; so too with ``groups``, at least so many, where a few
    cells are most of the work.
    """
    held = table.filter(F.col("k").isNotNull())
    of_class = held.groupBy("k").agg(F.min("no").alias("low"), F.max("no").alias("high"), F.sum(F.length("data")).alias("size")).collect()  # a row a class
    number, size = max((r["high"] + 1 for r in of_class), default=0), sum(r["size"] for r in of_class)
    if pairs == "within" and len(of_class) <= GROUPS:
        work = float(sum((r["high"] - r["low"] + 1) ** 2 for r in of_class))
        spans = [(r["low"], r["high"] + 1, order_of_plane(LINES * (r["high"] - r["low"] + 1) ** 2 / work, r["size"])) for r in of_class if wanted is None or (r["k"], r["k"]) in wanted]
    elif wanted is None and groups is None and pairs == "all":
        spans = [_in_one_plane(0, number, size)] if number else []
    else:
        spans = None
    if spans is not None:
        grouped, met = _dealt_to(held, spans)
    else:
        least = GROUPS * GROUPS if pairs == "within" else groups or GROUPS
        groups = max(1, min(number, max(least, -(-size // GROUP_BYTES))))
        grouped = held.withColumn("grp", F.floor(F.col("no") * F.lit(groups) / F.lit(max(number, 1))).cast("int"))
        met = [{one: one == two, two: one == two} for one, two in _in_pairs(grouped, pairs, wanted)]
    deal = [(g, n, own) for n, m in enumerate(met) for g, own in m.items()]
    dealt = grouped.join(F.broadcast(table.sparkSession.createDataFrame(deal, "grp int, meeting int, own boolean")), "grp").repartitionById(max(1, len(met)), F.col("meeting"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for batch in batches:
            for r in batch.itertuples():
                found.setdefault(r.meeting, []).append(r)
        for meeting, rows in found.items():
            rows.sort(key=lambda r: r.no)
            sides = (min(met[meeting]), max(met[meeting])) if spans is None else ()
            yield from run(*[[r for r in rows if r.grp == g] for g in sides]) if sides else run(rows, rows)

    return dealt.mapInPandas(task, schema)


def _in_pairs(grouped: DataFrame, pairs: str, wanted: set | None) -> list[tuple[int, int]]:
    """The pairs of groups that have classes to meet."""
    spans = grouped.groupBy("grp").agg(F.min("k").alias("low"), F.max("k").alias("high")).orderBy("grp").collect()  # a row a group
    met = []
    for i, one in enumerate(spans):
        for two in spans[i:]:
            if pairs == "within" and two["low"] > one["high"]:
                break
            alike = pairs == "cross" and one["low"] == one["high"] == two["low"] == two["high"]
            if not alike and (wanted is None or any(one["low"] <= a <= one["high"] and two["low"] <= b <= two["high"] for a, b in wanted)):
                met.append((one["grp"], two["grp"]))
    return sorted(met, key=lambda m: m[0] == m[1])  # the smaller ones last


def gathered(frames: Iterator[pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None, most: int | None = None) -> Iterator[pd.DataFrame]:
    """The rows in larger frames; with ``merge`` all of a task in one, merged whenever more than ``most`` rows are new."""
    most, held, rows, old = most or GATHERED, [], 0, 0
    for f in frames:
        held.append(f)
        rows += len(f)
        if rows >= most + old:
            whole = pd.concat(held)
            held, rows = [], 0
            if merge:
                held, rows = [merge(whole)], 0
                rows = old = len(held[0])
            else:
                yield whole
    if held:
        yield merge(pd.concat(held)) if merge else pd.concat(held)


def cells(vectors: DataFrame, metric: Callable | None, reduce: Callable, schema: str, pairs: str = "all", beside: int = 0, packed: tuple | None = None, todo: DataFrame | None = None, merge: Callable | None = None, most: int | None = None, groups: int | None = None) -> DataFrame:
    """What ``reduce`` gives for each cell.  ``pairs``: "all", "within" a class or "cross".

    The last ``beside`` components of vectors are values beside them, which the metric does not see.
    ``todo`` (k1, k2, todo): an array for the cells of each pair of classes; cells of other pairs are left out.
    ``merge``: what makes fewer rows of those that the cells of a task give, whenever there are ``most``.
    Without a metric ``reduce`` gets a task's packed rows, and two by two those that meet, and measures itself.
    """
    table, _ = packed or blocks(vectors)
    wanted = None if todo is None else {(r["k1"], r["k2"]): r["todo"] for r in todo.select("k1", "k2", "todo").collect()}  # one row a pair of classes

    def apart(r, s) -> bool:
        """Whether two packed rows don't meet here."""
        return s.no < r.no or r.grp == s.grp and not r.own or pairs == "within" and r.k != s.k or pairs == "cross" and r.k == s.k or wanted is not None and (r.k, s.k) not in wanted

    def matrices(r) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.data, dtype=np.float64).reshape(r.n, -1)

    def reduced(one: list, two: list) -> Iterator[pd.DataFrame]:
        for r in one:
            ids1, x1 = matrices(r)
            width = x1.shape[1] - beside
            for s in two:
                if apart(r, s):
                    continue
                ids2, x2 = matrices(s)
                out = reduce(Cell(r.k, s.k, ids1, ids2, r.start + np.arange(r.n), s.start + np.arange(s.n), x1[:, width:], x2[:, width:], metric(x1[:, :width], x2[:, :width]), r.no == s.no, wanted and wanted[r.k, s.k]))
                if out is not None and len(out):
                    yield out

    def run(one: list, two: list) -> Iterator[pd.DataFrame]:
        if metric is None:
            return reduce(list({r.no: r for r in [*one, *two]}.values()), ((r, s) for r in one for s in two if not apart(r, s)))
        return gathered(reduced(one, two), merge, most)

    return meetings(table, run, schema, pairs, None if wanted is None else set(wanted), groups)


def beside(table: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Blocks with the value ``name`` of each row (sample_id, ``name``) behind its vector; every row must have one."""

    def ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield pd.DataFrame({"no": np.int32(r.no), "nth": np.arange(r.n), "sample_id": np.frombuffer(r.ids, dtype=np.int64)})

    named = table.select("no", "n", "ids").mapInPandas(ids_of, "no int, nth int, sample_id long").join(values, "sample_id")
    # a block's rows, read back so that few are broadcast
    of = written(named.groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", name))), lambda x: x[name]).alias("beside")))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [np.column_stack([np.frombuffer(r.data, dtype=np.float64).reshape(r.n, -1), r.beside]).tobytes() for r in batch.itertuples()]
            yield batch.assign(data=data).drop(columns="beside")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return cut_lineage(table.join(of, "no").select(*table.columns, "beside").mapInPandas(put, fields))


def _of_pairs(c: Cell) -> np.ndarray:
    """Distances of the cell's unordered pairs of two samples."""
    return c.d[np.triu_indices(len(c.d), 1)] if c.same else c.d.ravel()


def kind_of(vectors: DataFrame) -> str:
    return vectors.schema["k"].dataType.simpleString()


def within(vectors: DataFrame, metric: Callable, key: str = "cls") -> DataFrame:
    """k, id1 < id2, d: the unordered pairs of each class."""
    v = keyed(vectors, key)

    def reduce(c: Cell) -> pd.DataFrame:
        i, j = np.triu_indices(len(c.d), 1) if c.same else (a.ravel() for a in np.indices(c.d.shape))
        a, b = c.ids1[i], c.ids2[j]
        return pd.DataFrame({"k": [c.k1] * len(i), "id1": np.minimum(a, b), "id2": np.maximum(a, b), "d": c.d[i, j]})

    return cells(v, metric, reduce, f"k {kind_of(v)}, id1 long, id2 long, d double", "within")


#: Rows of one side of a matrix of distances that lie in a core's cache.
TILE = 128


def _hellinger_sums(rows: list, pairs: Iterator) -> Iterator[pd.DataFrame]:
    """k1, k2, n, s, ss, top of a task's blocks two by two: halves of squared distances are one product, tile by tile."""
    right, size, added, of, left = {}, {}, {}, None, None
    for r in rows:
        x = np.frombuffer(r.data, dtype=np.float64).reshape(r.n, -1)
        root, half, one = np.sqrt(x), x.sum(axis=1) / 2, np.ones(r.n)
        right[r.no] = np.ascontiguousarray(np.column_stack([-root, one, half]).T)
        size[r.no] = max(1.0, float(np.abs(x).sum(axis=1).max()))
    for r, s in pairs:
        if of != r.no:
            *root, one, half = right[r.no]
            of, left = r.no, np.ascontiguousarray(np.vstack([-np.array(root), half, one]).T)
        n, total, squares, top = 0, 0.0, 0.0, 0.0
        for start in range(0, r.n, TILE):
            h = left[start : start + TILE] @ (right[s.no][:, start:] if r.no == s.no else right[s.no])
            if r.no == s.no:  # what lies after each row
                h = h[np.triu_indices(h.shape[0], 1, h.shape[1])]
            if not h.size:
                continue
            if h.min() < -1e-9 * size[r.no]:
                raise ValueError("negative under the root")
            np.maximum(h, 0.0, out=h)
            n, squares, top = n + h.size, squares + h.sum(), max(top, h.max())
            total += np.sqrt(h, out=h).sum()
        if n:
            old = added.get((r.k, s.k), (0, 0.0, 0.0, 0.0))
            added[r.k, s.k] = (old[0] + n, old[1] + total, old[2] + squares, max(old[3], np.sqrt(top)))
    if added:
        yield pd.DataFrame([(*k, *v) for k, v in added.items()], columns=["k1", "k2", "n", "s", "ss", "top"])


def pair_sums(vectors: DataFrame, metric: Callable, key: str = "cls", pairs: str = "all", packed: tuple | None = None, only: DataFrame | None = None) -> DataFrame:
    """k1, k2, n, s, ss, top: number, sums, sums of squares and largest of the distances of unordered pairs of two samples.

    ``only`` (k1, k2): the pairs of classes that are wanted.
    """
    v = keyed(vectors, key)

    def reduce(c: Cell) -> pd.DataFrame | None:
        d = _of_pairs(c)
        return pd.DataFrame({"k1": [c.k1], "k2": [c.k2], "n": [d.size], "s": [d.sum()], "ss": [(d * d).sum()], "top": [d.max()]}) if d.size else None

    by_tiles = metric is hellinger
    each = cells(v, None if by_tiles else metric, _hellinger_sums if by_tiles else reduce, f"k1 {kind_of(v)}, k2 {kind_of(v)}, n long, s double, ss double, top double", pairs, packed=packed, todo=only and only.withColumn("todo", F.lit(0)))
    return each.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.max("top").alias("top"))


#: Entries of one component in a range of values, about; more entries have more ranges.
RANGE = 1 << 16


def _apart(n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """By classes j, k: what entries of k lie above those of j in earlier rows; n: how many a row has of each class, w: their sum."""
    before = lambda x: np.cumsum(x, axis=0) - x
    return before(n).T @ w - before(w).T @ n


def _no_number(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def variation_sums(vectors: DataFrame, key: str = "cls", only: DataFrame | None = None) -> DataFrame:
    """k1, k2, n, s: number and sum of the total variations of unordered pairs of two samples, without any pair.

    A class that holds what is no finite number has no sums (NaN).
    The sum over pairs is one over components, and in order of values the
    differences of a component add up from running numbers and sums of each
    class.  Ranges of values go to tasks of their own; what is between ranges
    follows from a number and a sum for each class and range.
    """
    v = keyed(vectors, key).filter(F.col("k").isNotNull())
    rows = v.groupBy("k").agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"), F.max(F.exists("vec", _no_number)).alias("bad")).collect()  # a row a class
    sizes = {r["k"]: r["n"] for r in sorted(rows, key=lambda r: r["k"])}
    names, kind, total = list(sizes), kind_of(v), sum(sizes.values())
    if len({r[c] for r in rows for c in ("least", "most")}) > 1:
        raise ValueError("vectors of unequal length")
    ranges = max(1, total // RANGE)
    # where ranges are cut only shares out the work: from the vectors of least hash, 16 for each range
    drawn = [r["vec"] for r in v.orderBy(F.xxhash64("sample_id"), "sample_id").limit(16 * ranges).collect()] if ranges > 1 else []
    cuts = np.quantile(np.array(drawn, dtype=np.float64), np.arange(1, ranges) / ranges, axis=0).T if drawn else None

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack([np.asarray(r, dtype=np.float64) for r in batch["vec"]])
            of = pd.Index(names).get_indexer(batch["k"]).astype(np.int32)
            out = []
            for c in range(x.shape[1]):
                order = np.lexsort((of, x[:, c]))
                value, k = x[order, c], of[order]
                start = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (k[1:] != k[:-1])])
                value, k, n = value[start], k[start], np.diff(np.r_[start, len(order)])
                nth = np.searchsorted(cuts[c], value, side="right") if cuts is not None else np.zeros(len(value), dtype=np.int64)
                for r in np.unique(nth):
                    here = nth == r
                    out.append((c, int(r), value[here].tobytes(), k[here].tobytes(), n[here].astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["c", "r", "x", "of", "n"])

    def inside(f: pd.DataFrame) -> pd.DataFrame:
        """For each class: how many entries the range has, their sum, and how far they lie above those of each class."""
        x, of, n = (np.frombuffer(b"".join(f[name]), dtype=t) for name, t in (("x", np.float64), ("of", np.int32), ("n", np.int32)))
        value, row = np.unique(x, return_inverse=True)
        numbers, sums, above = np.zeros(len(names)), np.zeros(len(names)), np.zeros((len(names),) * 2)
        order = np.argsort(row, kind="stable")
        step = max(1, (1 << 22) // len(names))
        for start in range(0, len(value), step):  # values at a time, so that tables of all classes stay small
            here = order[np.searchsorted(row[order], start) : np.searchsorted(row[order], start + step)]
            m = np.zeros((min(step, len(value) - start), len(names)))
            np.add.at(m, (row[here] - start, of[here]), n[here])
            w = np.where(m > 0, m * value[start : start + step, None], 0.0)  # what is no number stays with its class
            above += _apart(m, w) + np.outer(numbers, w.sum(axis=0)) - np.outer(sums, m.sum(axis=0))
            numbers, sums = numbers + m.sum(axis=0), sums + w.sum(axis=0)
        return pd.DataFrame({"c": f["c"].iat[0], "r": f["r"].iat[0], "k": np.arange(len(names), dtype=np.int32), "n": numbers, "w": sums, "above": list(above.T)})

    ranged = written(v.mapInPandas(pieces, "c int, r int, x binary, of binary, n binary").groupBy("c", "r").applyInPandas(inside, "c int, r int, k int, n double, w double, above array<double>"))

    def across(f: pd.DataFrame) -> pd.DataFrame:
        shape = (f["r"].nunique(), len(names))
        f = f.sort_values(["r", "k"])
        above = _apart(f["n"].to_numpy().reshape(shape), f["w"].to_numpy().reshape(shape))
        return pd.DataFrame({"c": f["c"].iat[0], "k": np.arange(len(names), dtype=np.int32), "above": list(above.T)})

    between = ranged.select("c", "r", "k", "n", "w").groupBy("c").applyInPandas(across, "c int, k int, above array<double>")
    each = ranged.select("k", "above").unionByName(between.select("k", "above")).select("k", F.posexplode("above").alias("j", "above"))
    low, high = F.least("j", "k").alias("i1"), F.greatest("j", "k").alias("i2")
    added = each.groupBy(low, high).agg((F.sum("above") / 2).alias("s"))
    listed = v.sparkSession.createDataFrame(list(enumerate(names)), f"i int, k {kind}")
    size = v.groupBy("k").agg(F.count("*").alias("size"))
    of = lambda i: listed.join(size, "k").select(F.col("i").alias(f"i{i}"), F.col("k").alias(f"k{i}"), F.col("size").alias(f"n{i}"))
    n = F.when(F.col("i1") == F.col("i2"), F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2")).cast("long")
    out = added.join(of(1), "i1").join(of(2), "i2").select("k1", "k2", n.alias("n"), "s").filter("n > 0")
    bad = [r["k"] for r in rows if r["bad"]]
    out = out.withColumn("s", F.when(F.col("k1").isin(bad) | F.col("k2").isin(bad), float("nan")).otherwise(F.col("s"))) if bad else out
    return out if only is None else out.join(only.select("k1", "k2"), ["k1", "k2"])


def class_pairs(classes: DataFrame, reference=None) -> DataFrame:
    """k1 <= k2 of the classes (k); with a reference, each with itself and the reference."""
    both = classes.select(F.col("k").alias("k1")).join(classes.select(F.col("k").alias("k2")), F.col("k1") <= F.col("k2"))
    if reference is None:
        return both
    return both.filter((F.col("k1") == F.col("k2")) | (F.col("k1") == reference) | (F.col("k2") == reference))


def energy(vectors: DataFrame, metric: Callable, key: str = "cls", reference=None, packed: tuple | None = None) -> DataFrame:
    """k1, k2, energy, distinguishability of each pair of classes, or of each class with the reference.

    Means include each sample with itself (V-statistic); no distance: 0.
    """
    v = keyed(vectors, key)
    if metric is total_variation:
        n = v.groupBy("k").agg(F.count("*").alias("size"))
    else:  # sizes come with the blocks, so the vectors are not made again
        packed = packed or blocks(v)
        n = v.sparkSession.createDataFrame(list(packed[1].items()), f"k {kind_of(v)}, size long")
    only = None if reference is None else class_pairs(n, reference)
    s = cut_lineage(variation_sums(vectors, key, only) if metric is total_variation else pair_sums(vectors, metric, key, packed=packed, only=only))
    own = n.join(s.filter("k1 = k2").select(F.col("k1").alias("k"), "s"), "k", "left").select("k", "size", (2 * F.coalesce("s", F.lit(0.0)) / (F.col("size") * F.col("size"))).alias("m"))
    x = s.filter("k1 < k2").select("k1", "k2", (F.col("s") / F.col("n")).alias("m"))
    if reference is not None:
        x = x.filter((F.col("k1") == reference) | (F.col("k2") == reference))
    out = x.join(own.select(F.col("k").alias("k1"), F.col("m").alias("m1")), "k1").join(own.select(F.col("k").alias("k2"), F.col("m").alias("m2")), "k2")
    e = 2 * F.col("m") - F.col("m1") - F.col("m2")
    return out.select("k1", "k2", e.alias("energy"), F.when(F.col("m") == 0, 0.0).otherwise(e / (2 * F.col("m"))).alias("distinguishability"))


#: Bits of a distance that each round of the search for ranks settles, highest first.
DIGITS = (26, 19, 19)


def _bits(d: np.ndarray) -> np.ndarray:
    """Distances as whole numbers of the same order."""
    return (np.ascontiguousarray(d) + 0.0).view(np.int64)


def _counted(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers, and how often each is there."""
    low = int(digits.min()) if len(digits) else 0
    if len(digits) < 4096 or int(digits.max()) - low > 4 * len(digits):
        return np.unique(digits, return_counts=True)
    n = np.bincount(digits - low)
    at = np.flatnonzero(n)
    return at + low, n[at]


def _first_digits(v: DataFrame, metric: Callable, pairs: str, packed: tuple, only: DataFrame | None) -> DataFrame:
    """k1, k2, digit, n, s, ss: how often each number of the first bits is there, and in one row of a cell its sums."""

    def reduce(c: Cell) -> pd.DataFrame | None:
        d = _of_pairs(c)
        if not d.size:
            return None
        digit, n = _counted(_bits(d) >> (64 - DIGITS[0]))
        s, ss = np.zeros((2, len(n)))
        s[0], ss[0] = d.sum(), (d * d).sum()
        return pd.DataFrame({"k1": [c.k1] * len(n), "k2": [c.k2] * len(n), "digit": digit, "n": n, "s": s, "ss": ss})

    added = lambda f: f.groupby(["k1", "k2", "digit"], as_index=False)[["n", "s", "ss"]].sum()
    each = cells(v, metric, reduce, f"k1 {kind_of(v)}, k2 {kind_of(v)}, digit long, n long, s double, ss double", pairs, packed=packed, todo=only and only.withColumn("todo", F.lit(0)), merge=added)
    return each.groupBy("k1", "k2", "digit").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])


def order_statistics(vectors: DataFrame, metric: Callable, ranks: DataFrame, key: str = "cls", pairs: str = "within", packed: tuple | None = None, first: DataFrame | None = None) -> DataFrame:
    """k1, k2, rank, d: for each of the ``ranks`` (k1, k2, rank from 0), the distance of that rank among the pair's.

    A selection by digits: each round counts, in tasks, the next bits of the
    distances that begin with a wanted prefix; running sums of these counts
    give each rank its longer prefix.  Nothing goes through the driver, and
    what a round holds are counts, at most 2^19 for each prefix, and fewer in
    the first, whose bits are mostly those of the size.  ``first``: its counts.
    """
    v = keyed(vectors, key)
    packed = packed or blocks(v)
    kinds = f"k1 {kind_of(v)}, k2 {kind_of(v)}"
    counts = lambda f: f.groupby(["k1", "k2", "prefix", "digit"], as_index=False)["n"].sum()
    state, rest = written(ranks.select("k1", "k2", "rank", F.lit(0).cast("long").alias("prefix"), F.col("rank").alias("left"))), 64
    for width in DIGITS:
        rest -= width

        def count(c: Cell, rest: int = rest, width: int = width) -> pd.DataFrame | None:
            bits, out = _bits(_of_pairs(c)) >> rest, []
            high = bits >> width
            for prefix in c.todo:
                digit, n = _counted(bits[high == prefix] & ((1 << width) - 1))
                out.append(pd.DataFrame({"k1": [c.k1] * len(n), "k2": [c.k2] * len(n), "prefix": prefix, "digit": digit, "n": n}))
            return pd.concat(out) if out else None

        wanted = state.groupBy("k1", "k2").agg(F.collect_set("prefix").alias("todo"))
        if first is not None:
            n, first = first.select("k1", "k2", F.lit(0).cast("long").alias("prefix"), "digit", "n"), None
        else:
            n = cells(v, metric, count, f"{kinds}, prefix long, digit long, n long", pairs, packed=packed, todo=wanted, merge=counts).groupBy("k1", "k2", "prefix", "digit").agg(F.sum("n").alias("n"))
        state = written(_longer(state, n, width))
    return state.select("k1", "k2", "rank", _from_bits("prefix").alias("d"))


def _longer(state: DataFrame, n: DataFrame, width: int) -> DataFrame:
    """k1, k2, rank, prefix, left: each rank's prefix with the next bits, by running sums of their counts."""
    upto = F.sum("n").over(Window.partitionBy("k1", "k2", "rank").orderBy("digit"))
    step = state.join(n, ["k1", "k2", "prefix"]).withColumn("upto", upto).filter((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
    longer = F.shiftleft("prefix", width).bitwiseOR(F.col("digit"))
    return step.select("k1", "k2", "rank", longer.alias("prefix"), (F.col("left") - F.col("upto") + F.col("n")).alias("left"))


def _from_bits(name: str) -> Column:
    @F.pandas_udf("double")
    def value(bits: pd.Series) -> pd.Series:
        return pd.Series(bits.to_numpy(dtype=np.int64).view(np.float64))

    return value(name)


def _places(sums: DataFrame, shares: Column) -> DataFrame:
    """k1, k2, nth, place, rank, next: where each share lies among the n distances, and the ranks on both sides."""
    place = (F.col("share") * (F.col("n") - 1)).alias("place")
    placed = sums.select("k1", "k2", "n", F.posexplode(shares).alias("nth", "share")).select("k1", "k2", "n", "nth", place).withColumn("rank", F.floor("place"))
    return placed.withColumn("next", F.least(F.col("rank") + 1, F.col("n") - 1)).drop("n")


def _ranks(places: DataFrame) -> DataFrame:
    return places.select("k1", "k2", "rank").unionByName(places.select("k1", "k2", F.col("next").alias("rank"))).distinct()


def _between(places: DataFrame, found: DataFrame) -> DataFrame:
    """k1, k2, nth, v: linear between the distances of both ranks."""
    at = lambda c, name: found.select("k1", "k2", F.col("rank").alias(c), F.col("d").alias(name))
    both = places.join(at("rank", "low"), ["k1", "k2", "rank"]).join(at("next", "high"), ["k1", "k2", "next"])
    return both.select("k1", "k2", "nth", (F.col("low") + (F.col("place") - F.col("rank")) * (F.col("high") - F.col("low"))).alias("v"))


def _sums(first: DataFrame) -> DataFrame:
    return written(first.groupBy("k1", "k2").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]))


def _mean_and_std() -> list[Column]:
    mean = F.col("s") / F.col("n")
    std = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("ss") - F.col("s") * mean, F.lit(0.0)) / (F.col("n") - 1))).otherwise(float("nan"))
    return [mean.alias("mean"), std.alias("std")]


def quantiles(vectors: DataFrame, metric: Callable, shares: list[float], key: str = "cls", pairs: str = "within", packed: tuple | None = None, only: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """k1, k2, n, mean, std, values (a quantile for each share) of the distances of each pair of classes.

    Quantiles are exact, linear between order statistics; pairs are not sorted.
    ``only`` (k1, k2): the pairs of classes that are wanted.
    """
    packed = packed or blocks(keyed(vectors, key))
    first = first or written(_first_digits(keyed(vectors, key), metric, pairs, packed, only))
    sums = _sums(first)
    places = _places(sums, F.array(*[F.lit(float(q)) for q in shares]))
    found = written(order_statistics(vectors, metric, _ranks(places), key, pairs, packed, first))
    values = _between(places, found).groupBy("k1", "k2").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "v"))), lambda x: x["v"]).alias("values"))
    return sums.select("k1", "k2", "n", *_mean_and_std()).join(values, ["k1", "k2"])


def within_percentile(vectors: DataFrame, metric: Callable, q: float, key: str = "cls") -> DataFrame:
    """k, threshold: the percentile of the distances of each class's pairs."""
    return quantiles(vectors, metric, [q], key).select(F.col("k1").alias("k"), F.col("values")[0].alias("threshold"))


def _spans(digits: list[int], rest: int) -> list[tuple[float, float]]:
    """From and up to which distances have the first bits, of which neighbours are joined."""
    digits = np.unique(np.asarray(digits, dtype=np.int64))
    first = np.r_[True, np.diff(digits) > 1]
    value = lambda x: (x << rest).view(np.float64)
    return list(zip(value(digits[first]), value(digits[np.r_[first[1:], True]] + 1)))


def _in_spans(d: np.ndarray, spans: list[tuple], error: float = 0.0) -> np.ndarray:
    held = np.zeros(d.shape, dtype=bool)
    for low, high in spans:
        held |= (d >= low - error) & ~(d >= high + error)  # nothing is beyond infinity
    return held


def _nearly(p: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Total variations in single precision; ``across``: the other vectors' components."""
    out, apart, half = np.empty((len(p), across.shape[1]), dtype=np.float32), np.empty_like(across), np.full(len(across), 0.5, dtype=np.float32)
    for n, row in enumerate(p):
        np.dot(half, np.abs(np.subtract(row[:, None], across, out=apart), out=apart), out=out[n])
    return out


def _variations_in(rows: list, pairs: Iterator, spans_of: dict) -> Iterator[pd.DataFrame]:
    """k1, k2, bits, n: the total variations within the spans of two classes.

    Single precision tells which pairs these can be; only they are measured, to the same bits as all.
    """
    x = {r.no: np.frombuffer(r.data, dtype=np.float64).reshape(r.n, -1) for r in rows}
    with np.errstate(over="ignore"):  # too large ones are measured all
        single = {no: v.astype(np.float32) for no, v in x.items()}
    across = {no: np.ascontiguousarray(v.T) for no, v in single.items()}
    size = {no: float(np.abs(v).sum(axis=1).max()) for no, v in x.items()}
    for r, s in pairs:
        both, spans = size[r.no] + size[s.no], spans_of[r.k, s.k]
        if s.n > 1 and 1e-20 < both < 1e30:
            near = _nearly(single[r.no], across[s.no])
            i, j = np.nonzero(_in_spans(near, spans, (x[r.no].shape[1] + 8) * 2.0**-23 * both))
            i, j = (i[i < j], j[i < j]) if r.no == s.no else (i, j)
            d = np.concatenate([_variations_of(x[r.no][i[n : n + 16_384]], x[s.no][j[n : n + 16_384]]) for n in range(0, len(i), 16_384)] or [np.zeros(0)])
        else:
            d = total_variation(x[r.no], x[s.no])
            d = d[np.triu_indices(len(d), 1)] if r.no == s.no else d.ravel()
        value, n = np.unique(_bits(d[_in_spans(d, spans)]), return_counts=True)
        if len(n):
            yield pd.DataFrame({"k1": [r.k] * len(n), "k2": [s.k] * len(n), "bits": value, "n": n})


def _variations_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Total variations of rows of p and the same rows of q, added up in the order of components as for matrices."""
    m = len(p)
    p, q = (np.concatenate([x, x]) if m == 1 else x for x in (p, q))  # one column would be added up in another order
    return 0.5 * np.abs(np.ascontiguousarray(p.T) - q.T).sum(axis=0)[:m]


#: Distances, at most, that exceedance lists in its second pass; more are counted by digits in two rounds and a pass for the far ones.
VALUES = 1 << 27


def exceedance(vectors: DataFrame, metric: Callable, q: float = 0.95, key: str = "cls", reference=None) -> DataFrame:
    """k1, k2, distinguishability (share of cross pairs farther than k1's own percentile), mean, std, low, high.

    All pairs of classes k1 < k2, or those with the reference, whose percentile counts then.
    Two passes over the pairs: the first counts the first bits of the distances,
    the second lists those whose bits are a wanted rank's or the percentile's.
    """
    v = keyed(vectors, key)
    packed = blocks(v)
    only = None
    if reference is not None:
        only = class_pairs(packed[0].select("k").distinct(), reference).filter((F.col("k1") == reference) | (F.col("k2") == reference))
    own = F.col("k1") if reference is None else F.lit(reference)
    first = written(_first_digits(v, metric, "all", packed, only))  # cross pairs and those within classes
    sums = _sums(first)
    shares = F.when(F.col("k1") == F.col("k2"), F.array(F.lit(float(q)))).otherwise(F.array(F.lit(0.16), F.lit(0.84)))
    places = _places(sums, shares)
    begun = _ranks(places).select("k1", "k2", "rank", F.lit(0).cast("long").alias("prefix"), F.col("rank").alias("left"))
    state = written(_longer(begun, first.select("k1", "k2", F.lit(0).cast("long").alias("prefix"), "digit", "n"), DIGITS[0]))
    # between which first bits a class's own percentile lies
    spans = written(state.filter("k1 = k2").groupBy(F.col("k1").alias("k")).agg(F.min("prefix").alias("least"), F.max("prefix").alias("most")))
    spanned = first.filter("k1 < k2").join(F.broadcast(spans), own == F.col("k"))
    listed = written(state.select("k1", "k2", F.col("prefix").alias("digit")).unionByName(spanned.filter("digit between least and most").select("k1", "k2", "digit")).distinct())
    if (first.join(listed, ["k1", "k2", "digit"]).agg(F.sum("n")).first()[0] or 0) > VALUES:
        return _exceedance_by_digits(vectors, metric, q, key, reference, packed, only, first)
    rest = 64 - DIGITS[0]
    todo = listed.groupBy("k1", "k2").agg(F.collect_list("digit").alias("todo"))
    spans_of = {(r["k1"], r["k2"]): _spans(r["todo"], rest) for r in todo.collect()}  # one row a pair of classes

    def chosen(c: Cell) -> pd.DataFrame | None:
        d = _of_pairs(c)
        value, n = np.unique(_bits(d[_in_spans(d, spans_of[c.k1, c.k2])]), return_counts=True)
        return pd.DataFrame({"k1": [c.k1] * len(n), "k2": [c.k2] * len(n), "bits": value, "n": n})

    fast = metric is total_variation
    each = cells(v, None if fast else metric, (lambda rows, pairs: gathered(_variations_in(rows, pairs, spans_of))) if fast else chosen, f"k1 {kind_of(v)}, k2 {kind_of(v)}, bits long, n long", "all", packed=packed, todo=todo)
    values = written(each.groupBy("k1", "k2", "bits").agg(F.sum("n").alias("n")))
    prefix = F.shiftright("bits", rest)
    found = _longer(state, values.select("k1", "k2", prefix.alias("prefix"), F.col("bits").bitwiseAND(F.lit((1 << rest) - 1)).alias("digit"), "n"), rest)
    at = written(_between(places, written(found.select("k1", "k2", "rank", _from_bits("prefix").alias("d")))))
    limits = at.filter("k1 = k2").select(F.col("k1").alias("k"), F.col("v").alias("threshold")).join(spans, "k")
    beyond = spanned.filter("digit > most").select("k1", "k2", "n")
    near = values.filter("k1 < k2").join(F.broadcast(limits), own == F.col("k")).filter(prefix.between(F.col("least"), F.col("most")) & (_from_bits("bits") > F.col("threshold")))
    far = beyond.unionByName(near.select("k1", "k2", "n")).groupBy("k1", "k2").agg(F.sum("n").alias("far"))
    sides = at.filter("k1 < k2").groupBy("k1", "k2").agg(*[F.max(F.when(F.col("nth") == nth, F.col("v"))).alias(name) for nth, name in enumerate(("p16", "p84"))])
    out = sums.select("k1", "k2", "n", *_mean_and_std()).join(sides, ["k1", "k2"]).join(far, ["k1", "k2"], "left")
    share = F.coalesce("far", F.lit(0)) / F.col("n")
    return out.select("k1", "k2", share.alias("distinguishability"), "mean", "std", (F.col("mean") - F.col("p16")).alias("low"), (F.col("p84") - F.col("mean")).alias("high"))


def _exceedance_by_digits(vectors: DataFrame, metric: Callable, q: float, key: str, reference, packed: tuple, only: DataFrame | None, first: DataFrame) -> DataFrame:
    """The same where the distances of the wanted first bits are too many to list."""
    v = keyed(vectors, key)
    every = written(quantiles(vectors, metric, [0.16, 0.84, q], key, "all", packed, only, first))
    rest, limits = every.filter("k1 < k2"), every.filter("k1 = k2").select(F.col("k1").alias("k"), F.col("values")[2].alias("threshold"))
    own = F.col("k1") if reference is None else F.lit(reference)
    limited = rest.select("k1", "k2").join(limits, own == F.col("k"), "left").select("k1", "k2", F.array(F.coalesce("threshold", F.lit(float("inf")))).alias("todo"))

    def farther(c: Cell) -> pd.DataFrame:
        return pd.DataFrame({"k1": [c.k1], "k2": [c.k2], "far": [int((c.d > c.todo[0]).sum())]})

    far = cells(v, metric, farther, f"k1 {kind_of(v)}, k2 {kind_of(v)}, far long", "cross", packed=packed, todo=limited).groupBy("k1", "k2").agg(F.sum("far").alias("far"))
    low, high = F.col("mean") - F.col("values")[0], F.col("values")[1] - F.col("mean")
    return far.join(rest, ["k1", "k2"]).select("k1", "k2", (F.col("far") / F.col("n")).alias("distinguishability"), "mean", "std", low.alias("low"), high.alias("high"))


def relative_change(a: Column, b: Column) -> Column:
    return F.when((a <= 0) | (b <= 0), F.raise_error(F.lit("not positive"))).otherwise(F.abs(a - b) / (a + b))
