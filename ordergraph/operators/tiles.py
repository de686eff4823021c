"""Graphs as packed tiles, and what is computed on them.

A tile holds the edges between two blocks of 1024 atoms of a graph, a bit for
each pair, cut to the rows and columns in use.  Atoms between two others are
counted by products of tiles.  A graph of one block is one row of the table
and needs no other; tiles of larger graphs meet by (graph, block, block).
Tasks read rows that are sorted by these keys as a stream, so they hold a few
tiles, whatever the number of graphs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of an atom's place in its block.
BITS = 10
SCHEMA = "graph_id long, bi int, bj int, rows int, cols int, ordered boolean, bits binary"
#: Graphs of more blocks go other ways where a task would walk through a whole graph.
WALK = 64


class Rows:
    """Output columns that are given off in batches of bounded size."""

    def __init__(self, schema: dict[str, pa.DataType], size: int = 100_000):
        self.schema, self.size, self.n, self.parts = schema, size, 0, []

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.n += len(columns[0])
        if self.n >= self.size:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            columns = [pa.array(np.concatenate(c), kind) for c, kind in zip(zip(*self.parts), self.schema.values())]
            self.n, self.parts = 0, []
            yield pa.RecordBatch.from_arrays(columns, list(self.schema))


EDGE = {"graph_id": pa.int64(), "src": pa.int64(), "dst": pa.int64()}


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], list[np.ndarray]]]:
    """Key and other columns of each group of neighbouring rows that agree in the first ``keys`` columns."""
    last, held = None, []
    joined = lambda: [np.concatenate(c) for c in zip(*held)]
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        edge = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns[:keys]:
            edge |= c[1:] != c[:-1]
        begin = [0, *(np.flatnonzero(edge) + 1).tolist(), batch.num_rows]
        for a, b in zip(begin, begin[1:]):
            key = tuple(int(c[a]) for c in columns[:keys])
            if last is not None and key != last:
                yield last, joined()
                held = []
            last = key
            held.append([c[a:b] for c in columns[keys:]])
    if last is not None:
        yield last, joined()


def unpacked(bits: bytes, rows: int, cols: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8).reshape(rows, -1), axis=1, count=cols)


def square(tile: np.ndarray, side: int = 0) -> np.ndarray:
    side = max(side, *tile.shape)
    out = np.zeros((side, side), dtype=tile.dtype)
    out[: tile.shape[0], : tile.shape[1]] = tile
    return out


def packed(edges: DataFrame) -> DataFrame:
    """The tiles of the edges (graph_id, src, dst); repeated edges are one.

    ``ordered`` says that all edges of a tile go from a smaller atom to a larger.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows({"graph_id": pa.int64(), "bi": pa.int32(), "bj": pa.int32(), "rows": pa.int32(), "cols": pa.int32(), "ordered": pa.bool_(), "bits": pa.binary()}, 64)
        out.size = 2000
        for (g, i, j), (s, d) in grouped(batches, 3):
            tile = np.zeros((s.max() + 1, d.max() + 1), dtype=bool)
            tile[s, d] = True
            ordered = i < j or (i == j and bool((s < d).all()))
            yield from out.add(*(np.array([v], dtype=object) for v in (g, i, j, *tile.shape, ordered, np.packbits(tile, axis=1).tobytes())))
        yield from out.rest()

    block, place = (lambda c: F.shiftright(c, BITS).cast("int")), (lambda c: F.col(c).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    keys = ["graph_id", "bi", "bj"]
    dealt = edges.select(F.col("graph_id").cast("long").alias("graph_id"), block("src").alias("bi"), block("dst").alias("bj"), place("src").alias("s"), place("dst").alias("d"))
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(pack, SCHEMA)


def packed_points(points: DataFrame, written) -> DataFrame:
    """The tiles of the order of points (graph_id, atom, u, v): src before dst if both coordinates are smaller.

    Points that come sorted by graph and atom become a row for each block of
    atoms; blocks meet those at or after them, so no row is made for an edge.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"graph_id": pa.int64(), "b": pa.int32(), "first": pa.int32(), "u": pa.list_(pa.float64()), "v": pa.list_(pa.float64())}
        out: list[tuple] = []
        for (g, b), (atom, u, v) in grouped(batches, 2):
            out.append((g, b, int(atom[0]) & ((1 << BITS) - 1), u, v))
            if len(out) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds.values())], list(kinds))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds.values())], list(kinds))

    rows = points.select(F.col("graph_id").cast("long").alias("graph_id"), F.shiftright("atom", BITS).cast("int").alias("b"), F.col("atom").cast("long").alias("atom"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    blocks = written(rows.mapInArrow(block, "graph_id long, b int, first int, u array<double>, v array<double>"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"graph_id": pa.int64(), "bi": pa.int32(), "bj": pa.int32(), "rows": pa.int32(), "cols": pa.int32(), "ordered": pa.bool_(), "bits": pa.binary()}
        out = Rows(kinds, 2000)
        for batch in batches:
            lists = [batch.column(c) for c in ("u", "v", "u_2", "v_2")]
            flat, at = [c.flatten().to_numpy() for c in lists], [c.offsets.to_numpy() - c.offsets[0].as_py() for c in lists]
            for k, (g, i, j, p, q) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("graph_id", "b", "b_2", "first", "first_2")))):
                u, v, x, y = (f[a[k] : a[k + 1]] for f, a in zip(flat, at))
                met = (u[:, None] < x) & (v[:, None] < y)
                s, d = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
                if len(s):
                    tile = np.zeros((p + s[-1] + 1, q + d[-1] + 1), dtype=bool)
                    tile[p:, q:] = met[: s[-1] + 1, : d[-1] + 1]
                    # atoms are in the order of u + v, so an edge goes to a larger one
                    yield from out.add(*(np.array([e], dtype=object) for e in (g, i, j, *tile.shape, True, np.packbits(tile, axis=1).tobytes())))
        yield from out.rest()

    named = [F.col(c).alias(f"{c}_2") for c in ("b", "first", "u", "v")]
    small, wide = parted(blocks, written, "b > 0")
    met = small.select("*", *named)
    if wide is not None:
        met = met.unionByName(wide.join(wide.select("graph_id", *named), "graph_id").filter("b <= b_2"))
    return met.mapInArrow(meet, SCHEMA)


def edges(tiles: DataFrame) -> DataFrame:
    """The edges of the tiles."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(EDGE)
        for batch in batches:
            for g, i, j, rows, cols, bits in zip(*(c.to_pylist() for c in batch.columns)):
                s, d = np.nonzero(unpacked(bits, rows, cols))
                yield from out.add(np.full(len(s), g), s + (i << BITS), d + (j << BITS))
        yield from out.rest()

    return tiles.select("graph_id", "bi", "bj", "rows", "cols", "bits").mapInArrow(unpack, "graph_id long, src long, dst long")


def parted(tiles: DataFrame, written, further: str = "bi > 0 or bj > 0") -> tuple[DataFrame, DataFrame | None]:
    """Tiles of graphs of one block, and of the others (None if there are none)."""
    wide = tiles.filter(further).select("graph_id").distinct()
    if wide.isEmpty():
        return tiles, None
    wide = written(wide)
    return tiles.join(wide, "graph_id", "left_anti"), tiles.join(wide, "graph_id", "left_semi")


def _given(kind: str, g: int, i: int, j: int, mask: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns of one finished tile: its edges, those without an atom between, or sizes and how many."""
    s, d = np.nonzero(mask)
    n = inside[s, d].astype(np.int64)
    if kind == "sizes":
        n, weight = np.unique(n, return_counts=True)
        return np.full(len(n), g), n, weight
    if kind == "links":
        s, d, n = s[n == 0], d[n == 0], n[n == 0]
    return np.full(len(s), g), s + (i << BITS), d + (j << BITS), *([n] if kind == "intervals" else [])


KINDS = {
    "intervals": EDGE | {"inside": pa.int64()},
    "links": EDGE,
    "sizes": {"graph_id": pa.int64(), "inside": pa.int64(), "weight": pa.int64()},
}


def between(tiles: DataFrame, kind: str, written) -> DataFrame:
    """How many atoms lie between the ends of each edge of the (written) tiles.

    ``kind``: "intervals" (edges with ``inside``), "links" (edges with none
    inside), or "sizes" (inside, weight; a row for each tile and size).
    """
    schema = KINDS[kind]
    sql = ", ".join(f"{c} long" for c in schema)
    small, wide = parted(tiles, written)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for g, rows, cols, bits in zip(*(c.to_pylist() for c in batch.columns)):
                a = square(unpacked(bits, rows, cols))
                dense = a.astype(np.float32)
                yield from out.add(*_given(kind, g, 0, 0, a, dense @ dense))
        yield from out.rest()

    found = small.select("graph_id", "rows", "cols", "bits").mapInArrow(alone, sql)
    if wide is None:
        return found

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, mask, inside = Rows(schema), None, None, None
        for batch in batches:
            for g, i, j, k, *tile, rows, cols, bits in zip(*(c.to_pylist() for c in batch.columns)):
                a = unpacked(tile[2], tile[0], tile[1])
                if k < 0:  # the edges of the tile, before its products
                    if mask is not None:
                        yield from out.add(*_given(kind, *at, mask, inside))
                    at, mask, inside = (g, i, j), a, np.zeros(a.shape, dtype=np.float32)
                elif at == (g, i, j):
                    b = unpacked(bits, rows, cols)
                    n, p, q = min(a.shape[1], rows), min(len(mask), len(a)), min(mask.shape[1], cols)
                    inside[:p, :q] += a[:p, :n].astype(np.float32) @ b[:n, :q].astype(np.float32)
        if mask is not None:
            yield from out.add(*_given(kind, *at, mask, inside))
        yield from out.rest()

    wide = written(wide)
    left = wide.select("graph_id", F.col("bi").alias("i"), F.col("bj").alias("k"), "rows", "cols", "bits")
    right = wide.select("graph_id", F.col("bj").alias("j"), F.col("bi").alias("k"), F.col("rows").alias("rows_2"), F.col("cols").alias("cols_2"), F.col("bits").alias("bits_2"))
    where = ["graph_id", "i", "j", "k"]
    order = [*where, "rows", "cols", "bits", "rows_2", "cols_2", "bits_2"]
    own = wide.select("graph_id", F.col("bi").alias("i"), F.col("bj").alias("j"))  # products that meet no edge are not made
    pairs = left.join(right, ["graph_id", "k"]).join(own, ["graph_id", "i", "j"], "left_semi").select(*order)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("rows_2", "int"), ("cols_2", "int"), ("bits_2", "binary"))]
    masks = wide.select("graph_id", F.col("bi").alias("i"), F.col("bj").alias("j"), F.lit(-1).alias("k"), "rows", "cols", "bits", *none)
    every = pairs.unionByName(masks).repartition("graph_id", "i", "j").sortWithinPartitions(*where)
    return found.unionByName(every.mapInArrow(met, sql))


def blocks_of(tiles: DataFrame) -> int:
    """Blocks of the largest graph."""
    return (tiles.agg(F.max(F.greatest("bi", "bj"))).first()[0] or 0) + 1


def walked(tiles: DataFrame, visit, columns: dict[str, pa.DataType], ascending: bool = True) -> DataFrame:
    """``visit(graph_id, tiles)`` for each graph, whose tiles come as a stream of (bi, bj, matrix).

    A target block's tiles come together, those that end (``ascending``) or
    start in it, the block's own last.  ``visit`` gives columns of values.
    """
    sql = ", ".join(f"{c} {'double' if t == pa.float64() else 'long'}" for c, t in columns.items())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        out, row = Rows(columns), next(rows, None)
        while row is not None:
            g = row[0]

            def of_graph() -> Iterator[tuple[int, int, np.ndarray]]:
                nonlocal row
                while row is not None and row[0] == g:
                    _, i, j, height, width, bits = row
                    yield i, j, unpacked(bits, height, width)
                    row = next(rows, None)

            mine = of_graph()
            yield from out.add(*visit(g, mine))
            for _ in mine:  # what it left
                pass
        yield from out.rest()

    order = ["graph_id", F.col("bj").asc(), F.col("bi").asc()] if ascending else ["graph_id", F.col("bi").desc(), F.col("bj").desc()]
    return tiles.select("graph_id", "bi", "bj", "rows", "cols", "bits").repartition("graph_id").sortWithinPartitions(*order).mapInArrow(walk, sql)


def _values(g: int, held: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    atoms, values = np.concatenate([np.arange(len(h)) + (b << BITS) for b, h in held.items()]), np.concatenate(list(held.values()))
    return np.full(np.count_nonzero(atoms), g), atoms[atoms > 0], values[atoms > 0]  # atoms are numbered from 1


def longest_paths(tiles: DataFrame, ending: bool) -> DataFrame:
    """graph_id, atom, height: edges of the longest path that ends (or starts) at each atom with edges, of ordered tiles."""

    def visit(g: int, mine) -> tuple[np.ndarray, ...]:
        held: dict[int, np.ndarray] = {}

        def at(block: int, side: int) -> np.ndarray:
            h = held.get(block, np.zeros(0, dtype=np.int64))
            if len(h) < side:
                held[block] = h = np.r_[h, np.zeros(side - len(h), dtype=np.int64)]
            return h

        for i, j, tile in mine:
            tile = tile if ending else tile.T
            known, target = (i, j) if ending else (j, i)
            if known != target:
                h, own = at(known, tile.shape[0]), at(target, tile.shape[1])
                reach = np.where(tile.astype(bool), h[: tile.shape[0], None] + 1, 0).max(axis=0)
                np.maximum(own[: tile.shape[1]], reach, out=own[: tile.shape[1]])
            else:
                h = at(target, max(tile.shape))
                for t in range(tile.shape[1]) if ending else range(tile.shape[1] - 1, -1, -1):
                    before = np.flatnonzero(tile[:, t])
                    if len(before):
                        h[t] = max(h[t], h[before].max() + 1)
        return _values(g, held)

    return walked(tiles, visit, {"graph_id": pa.int64(), "atom": pa.int64(), "height": pa.int64()}, ending)


def path_sums(tiles: DataFrame) -> DataFrame:
    """graph_id, atom, c: paths of one edge or more that start at each atom, over the factorials of their lengths; of ordered tiles."""

    def visit(g: int, mine) -> tuple[np.ndarray, ...]:
        terms: dict[int, np.ndarray] = {}  # of a block: a column for each length, from 0

        def grown(block: int, side: int) -> np.ndarray:
            v = terms.get(block, np.ones((0, 1)))
            if len(v) < side:
                more = np.zeros((side - len(v), v.shape[1]))
                more[:, 0] = 1
                terms[block] = v = np.vstack([v, more])
            return v

        across: dict[int, np.ndarray] = {}

        def finish(block: int, tile: np.ndarray | None) -> None:
            """All terms of a block, after those that it leads to."""
            far = across.pop(block, np.zeros((0, 0)))
            side = max(len(far), *(tile.shape if tile is not None else (0,)))
            a = square(tile, side).astype(float) if tile is not None else np.zeros((side, side))
            columns, last, k = [np.ones(side)], np.ones(side), 0
            while True:
                k += 1
                nxt = a @ last
                if k <= far.shape[1]:
                    nxt[: len(far)] += far[:, k - 1]
                nxt /= k
                if not nxt.any() and k > far.shape[1]:
                    break
                columns.append(nxt)
                last = nxt
            terms[block] = np.stack(columns, axis=1)

        at = None
        for i, j, tile in mine:
            if at is not None and at != i and at in across:
                finish(at, None)
            at = i
            if i == j:
                finish(i, tile)
            else:
                v = grown(j, tile.shape[1])[: tile.shape[1]]
                sums, part = across.get(i, np.zeros((0, 0))), tile.astype(float) @ v
                both = np.zeros((max(len(sums), len(part)), max(sums.shape[1], part.shape[1])))
                both[: len(sums), : sums.shape[1]] += sums
                both[: len(part), : part.shape[1]] += part
                across[i] = both
        for block in list(across):
            finish(block, None)
        return _values(g, {b: v[:, 1:].sum(axis=1) for b, v in terms.items()})

    return walked(tiles, visit, {"graph_id": pa.int64(), "atom": pa.int64(), "c": pa.float64()}, False)


def joined(label: np.ndarray, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Labels (of each atom, the least of its component) after the edges from s to d came to them."""
    while True:
        one, two = label[s], label[d]
        if (one == two).all():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        further = label[label]
        while (further != label).any():
            label, further = further, further[further]


def components(tiles: DataFrame, written) -> DataFrame:
    """graph_id, atom, label (the least atom of its component), for atoms with an edge, whatever its direction.

    Graphs of one block stay where they are; of the others a task walks
    through the tiles and holds a number for each atom.
    """
    columns = {"graph_id": pa.int64(), "atom": pa.int64(), "label": pa.int64()}
    small, wide = parted(tiles, written)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(columns)
        for batch in batches:
            first, edges, graphs = 0, [], []
            for g, rows, cols, bits in zip(*(c.to_pylist() for c in batch.columns)):
                s, d = np.nonzero(unpacked(bits, rows, cols))
                edges.append((s + first, d + first))
                graphs.append((g, first))
                first += max(rows, cols)
                if first >= out.size:
                    yield from out.add(*of_batch(graphs, edges, first))
                    first, edges, graphs = 0, [], []
            if graphs:
                yield from out.add(*of_batch(graphs, edges, first))
        yield from out.rest()

    def of_batch(graphs: list, edges: list, side: int) -> tuple[np.ndarray, ...]:
        """All graphs side by side, as if they were one."""
        s, d = (np.concatenate(e) for e in zip(*edges))
        label, atoms = joined(np.arange(side), s, d), np.unique(np.concatenate([s, d]))
        g, start = (np.array(c) for c in zip(*graphs))
        of = np.searchsorted(start, atoms, side="right") - 1
        return g[of], atoms - start[of], label[atoms] - start[of]

    found = small.select("graph_id", "rows", "cols", "bits").mapInArrow(alone, "graph_id long, atom long, label long")
    if wide is None:
        return found

    def visit(g: int, mine) -> tuple[np.ndarray, ...]:
        label, seen = np.arange(0), np.zeros(0, dtype=bool)
        for i, j, tile in mine:
            s, d = np.nonzero(tile)
            s, d = s + (i << BITS), d + (j << BITS)
            side = max(len(label), s.max(initial=-1) + 1, d.max(initial=-1) + 1)
            label, seen = np.r_[label, np.arange(len(label), side)], np.r_[seen, np.zeros(side - len(seen), dtype=bool)]
            seen[s] = seen[d] = True
            label = joined(label, s, d)
        atoms = np.flatnonzero(seen)
        return np.full(len(atoms), g), atoms, label[atoms]

    return found.unionByName(walked(wide, visit, columns))


OBSERVED = ("degree", "link_degree", "height_profile", "cardinalities")


def _heights(a: np.ndarray) -> np.ndarray:
    """Edges of the longest path that ends at each atom of an ordered tile."""
    h = np.zeros(len(a), dtype=np.int64)
    if len(a) <= 64:
        while True:
            longer = (a * (h + 1)[:, None]).max(axis=0)
            if (longer == h).all():
                return h
            h = longer
    for t in range(len(a)):
        before = np.flatnonzero(a[:, t])
        if len(before):
            h[t] = h[before].max() + 1
    return h


def observed(tiles: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """graph_id, relations, and arrays of the asked observables, a row for each graph of one (ordered) block of relations.

    Degrees and heights are those of atoms 1 to the last with an edge; cardinalities, of intervals of two atoms and more.
    """
    names = [g for g in OBSERVED if g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def given() -> pa.RecordBatch:
            g, n, *lists = zip(*held)
            arrays = [pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in c])].astype(np.int32), np.concatenate(c).astype(np.int64)) for c in lists]
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(n, pa.int64()), *arrays], ["graph_id", "relations", *names])

        for batch in batches:
            for g, rows, cols, bits in zip(*(c.to_pylist() for c in batch.columns)):
                a = square(unpacked(bits, rows, cols))
                found = {"degree": (a.sum(axis=0, dtype=np.int64) + a.sum(axis=1, dtype=np.int64))[1:]}
                relations = int(found["degree"].sum()) // 2
                if len(names) > int("degree" in names):
                    dense = a.astype(np.float32)
                    inside = dense @ dense
                    if "cardinalities" in names:
                        n = np.bincount(inside[a.astype(bool)].astype(np.int64))
                        found["cardinalities"] = n[n > 0]
                    link = a * (inside == 0)
                    found["link_degree"] = (link.sum(axis=0, dtype=np.int64) + link.sum(axis=1, dtype=np.int64))[1:]
                    if "height_profile" in names:
                        found["height_profile"] = _heights(link)[1:]
                held.append((g, relations, *(found[c] for c in names)))
                size += len(a)
                if size >= 100_000:
                    yield given()
                    held, size = [], 0
        if held:
            yield given()

    sql = "".join(f", {c} array<long>" for c in names)
    return tiles.select("graph_id", "rows", "cols", "bits").mapInArrow(run, f"graph_id long, relations long{sql}")
