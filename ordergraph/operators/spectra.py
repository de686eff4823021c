"""Extreme eigenvalues of sparse symmetric matrices, for all graphs in one job.

Graphs of a few blocks of atoms are solved each by itself. For larger ones a
matrix is a table (graph_id, src, dst, w) with its spectrum in [-1, 1], a
vector a table (graph_id, atom, x). From a vector v a round makes the Chebyshev
polynomials T_0 .. T_m of the matrix times v; the sums mu_k = v T_k v of a
graph give the best vector among them (an eigenproblem of m rows), from which
the next round starts. Graphs whose residual is small leave.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordergraph.operators import graphs as G
from ordergraph.operators import tiles

#: Graphs of at most so many blocks of 1024 atoms are solved each by itself.
DENSE = 4
#: Eigenvalues up to this are those of null vectors.
NULL = 1e-9


def start_vector(graphs: DataFrame) -> DataFrame:
    return G.atoms_of(graphs).withColumn("x", F.sin(F.col("atom") * 1.7 + 0.3) + 1.1)


def _normalised(v: DataFrame) -> DataFrame:
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("graph_id")))
    return v.select("graph_id", "atom", F.when(size > 0, F.col("x") / size).otherwise(0.0).alias("x"))


def _next_polynomial(entries: DataFrame, t: DataFrame) -> DataFrame:
    """T_(k+1) = 2 A T_k - T_(k-1) behind the others; entries without weight carry an atom's own array."""
    met = entries.join(t.withColumnRenamed("atom", "dst"), ["graph_id", "dst"])
    last, before = F.element_at("t", -1), F.get("t", F.size("t") - 2)
    twice = F.when(F.size("t") == 1, 1.0).otherwise(2.0)
    part = F.when(F.col("w").isNull(), -F.coalesce(before, F.lit(0.0))).otherwise(twice * F.col("w") * last)
    grown = met.groupBy("graph_id", F.col("src").alias("atom")).agg(F.max(F.when(F.col("w").isNull(), F.col("t"))).alias("t"), F.sum(part).alias("x"))
    return grown.select("graph_id", "atom", F.concat("t", F.array("x")).alias("t"))


def _moments(steps: int) -> Column:
    """mu_0 .. mu_(2 steps - 1), from T_(2k) = 2 T_k T_k - T_0 and T_(2k+1) = 2 T_k T_(k+1) - T_1."""
    t = lambda k: F.get("t", F.lit(k))
    zero, one = F.sum(t(0) * t(0)), F.sum(t(0) * t(1))
    pairs = [(2 * F.sum(t(k // 2) * t(k - k // 2)) - (one if k % 2 else zero)) for k in range(2, 2 * steps)]
    return F.array(zero, one, *pairs)


def _best_vector(steps: int, largest: bool):
    i, j = np.indices((steps, steps))

    @F.pandas_udf("array<double>")
    def coefficients(mu: pd.Series) -> pd.Series:
        if mu.empty:
            return pd.Series([], dtype=object)
        m = np.stack(mu.to_numpy())
        product = lambda a, b: (m[:, a + b] + m[:, abs(a - b)]) / 2
        gram, image = product(i, j), (product(i, j + 1) + product(i, abs(j - 1))) / 2
        d, u = np.linalg.eigh(gram)
        kept = d > 1e-14 * d[:, -1:]
        white = u * np.where(kept, 1 / np.sqrt(np.where(kept, d, 1.0)), 0.0)[:, None, :]
        small = white.transpose(0, 2, 1) @ image @ white
        small[:, range(steps), range(steps)] += np.where(kept, 0.0, -3.0 if largest else 3.0)
        s = np.linalg.eigh((small + small.transpose(0, 2, 1)) / 2)[1]
        return pd.Series(list((white @ s[:, :, [-1 if largest else 0]])[:, :, 0]))

    return coefficients


def extreme_eigenvalue(matrix: DataFrame, vector: DataFrame, largest: bool = True, project=None, steps: int = 10, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """graph_id, value, residual: the largest or least eigenvalue of each graph of the vector.

    ``project`` takes known eigenvectors out of a vector. The value lies within
    the residual of an eigenvalue; after the last round it may exceed the tolerance.
    """
    project = project or (lambda v: v)
    own = vector.select("graph_id", F.col("atom").alias("src"), F.col("atom").alias("dst"), F.lit(None).cast("double").alias("w"))
    entries = G.written(matrix.select(*G.KEYS, "w").filter("w is not null").unionByName(own))
    best, done = _best_vector(steps, largest), []
    v = G.written(_normalised(project(vector)))
    for k in range(rounds):
        t = v.select("graph_id", "atom", F.array("x").alias("t"))
        for _ in range(steps):
            t = _next_polynomial(entries, t)
        t = G.written(t)
        found = t.groupBy("graph_id").agg(_moments(steps).alias("mu"))
        value = F.get("mu", F.lit(1))
        residual = F.sqrt(F.greatest((F.get("mu", F.lit(0)) + F.get("mu", F.lit(2))) / 2 - value * value, F.lit(0.0)))
        found = G.written(found.select("graph_id", value.alias("value"), residual.alias("residual"), best("mu").alias("y")))
        open_ = found.filter(F.col("residual") > tolerance)
        if k == rounds - 1 or open_.isEmpty():
            done.append(found)
            break
        done.append(found.filter(F.col("residual") <= tolerance))
        again = t.join(open_.select("graph_id", "y"), "graph_id")
        x = F.aggregate(F.zip_with("y", F.slice("t", 1, steps), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        v = G.written(_normalised(project(again.select("graph_id", "atom", x.alias("x")))))
        entries = G.written(entries.join(open_.select("graph_id"), "graph_id", "left_semi"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("graph_id", "value", "residual")


def _matrix(mine) -> np.ndarray:
    """A graph's tiles as one matrix of links."""
    held = [(i << tiles.BITS, j << tiles.BITS, t) for i, j, t in mine]
    side = max(max(i + t.shape[0], j + t.shape[1]) for i, j, t in held)
    out = np.zeros((side, side))
    for i, j, t in held:
        out[i : i + t.shape[0], j : j + t.shape[1]] = t
    return out


def _normalised_laplacian(links: np.ndarray) -> np.ndarray:
    """Of the undirected links, of the atoms that have one."""
    a = np.maximum(links, links.T)
    a = a[:, a.any(axis=0)][a.any(axis=0)]
    root = np.sqrt(a.sum(axis=1))
    return np.eye(len(a)) - a / np.outer(root, root)


def _antisymmetric(links: np.ndarray, kind: str) -> np.ndarray:
    """The hermitian matrix i K."""
    d = links.sum(axis=0) if kind == "in" else links.sum(axis=1)
    k = links * np.where(d > 0, (0.5 if kind == "in" else -0.5) / np.maximum(d, 1), 0.0)
    return 1j * (k - k.T)


def _one_value(a: np.ndarray, choose) -> tuple[float, float]:
    """The chosen eigenvalue, and the residual of a vector for it.

    All vectors of a large matrix take several times as long as its values, so
    there the vector comes from two steps of inverse iteration."""
    if len(a) <= 256:
        values, vectors = np.linalg.eigh(a)
        k = choose(values)
        return values[k], np.linalg.norm(a @ vectors[:, k] - values[k] * vectors[:, k])
    values = np.linalg.eigvalsh(a)
    value, x = values[choose(values)], np.sin(np.arange(len(a)) * 1.7 + 0.3)
    shifted = a - (value + 1e-12) * np.eye(len(a))
    for _ in range(2):
        x = np.linalg.solve(shifted, x)
        x /= np.linalg.norm(x)
    return value, np.linalg.norm(a @ x - value * x)


def _each_graph(links: DataFrame, graphs: DataFrame, matrix, choose, iterate, dense: int) -> DataFrame:
    """graph_id, used (atoms with a link), value, residual, of graphs with links.

    A graph of at most ``dense`` blocks of atoms is solved by itself, from its
    tiles, which meet in one exchange; larger ones go through ``iterate``.
    """

    def visit(g: int, mine) -> tuple[np.ndarray, ...]:
        a = matrix(_matrix(mine))
        value, residual = _one_value(a, choose)
        return np.array([g]), np.array([len(a)]), np.array([value]), np.array([residual])

    packed = G.written(tiles.packed(links))
    columns = {"graph_id": pa.int64(), "used": pa.int64(), "value": pa.float64(), "residual": pa.float64()}
    large = packed.filter(F.greatest("bi", "bj") >= dense).select("graph_id").distinct()
    if large.isEmpty():
        return tiles.walked(packed, visit, columns)
    large = G.written(large)
    rest = iterate(links.join(large, "graph_id", "left_semi"), graphs.join(large, "graph_id", "left_semi"))
    return tiles.walked(packed.join(large, "graph_id", "left_anti"), visit, columns).unionByName(rest.select("graph_id", F.lit(None).cast("long").alias("used"), "value", "residual"))


def _laplacian(found: DataFrame, graphs: DataFrame, isolated) -> DataFrame:
    nan, few = F.lit(float("nan")), F.col("n") < 3
    out = graphs.select("graph_id", "n").join(found, "graph_id", "left")
    value = F.when(F.col("used") < F.col("n"), isolated(F.col("value"), F.lit(1.0))).otherwise(F.col("value"))
    return out.select("graph_id", F.when(few, nan).otherwise(F.coalesce(value, F.lit(1.0))).alias("value"), F.when(few, nan).otherwise(F.coalesce("residual", F.lit(0.0))).alias("residual"))


def last_laplacian_eigenvalue(links: DataFrame, graphs: DataFrame, dense: int = DENSE, **how) -> DataFrame:
    """graph_id, value, residual: the largest eigenvalue of the normalised Laplacian of the undirected links; n < 3 gives NaN.

    Isolated atoms count with eigenvalue 1."""

    def iterate(some: DataFrame, of: DataFrame) -> DataFrame:
        return extreme_eigenvalue(G.laplacian_weights(some, of), start_vector(of.filter("n >= 3")), True, **how).withColumn("value", F.col("value") + 1)

    return _laplacian(_each_graph(links, graphs, _normalised_laplacian, lambda v: len(v) - 1, iterate, dense), graphs, F.greatest)


def first_nonzero_laplacian_eigenvalue(links: DataFrame, graphs: DataFrame, dense: int = DENSE, **how) -> DataFrame:
    """graph_id, value, residual: the least eigenvalue above 0; n < 3 gives NaN.

    Isolated atoms count with eigenvalue 1. In the iteration the null vectors
    (roots of degrees, one for each component with an edge) are taken out.
    """

    def iterate(some: DataFrame, of: DataFrame) -> DataFrame:
        d = G.degrees(some, of).select("graph_id", "atom", F.sqrt("degree").alias("root"))
        null = G.written(G.component_labels(some).join(d, ["graph_id", "atom"]))

        def project(v: DataFrame) -> DataFrame:
            part = Window.partitionBy("graph_id", "label")
            known = v.join(null, ["graph_id", "atom"], "left")
            away = F.sum(F.col("x") * F.col("root")).over(part) / F.sum(F.col("root") * F.col("root")).over(part)
            return known.select("graph_id", "atom", (F.col("x") - F.coalesce(away * F.col("root"), F.lit(0.0))).alias("x"))

        return extreme_eigenvalue(G.laplacian_weights(some, of), start_vector(of.filter("n >= 3")), False, project, **how).withColumn("value", F.col("value") + 1)

    return _laplacian(_each_graph(links, graphs, _normalised_laplacian, lambda v: int(np.argmax(v > NULL)), iterate, dense), graphs, F.least)


def lowest_antisymmetric_eigenvalue(links: DataFrame, graphs: DataFrame, kind: str = "in", dense: int = DENSE, **how) -> DataFrame:
    """graph_id, value, residual: minus the largest singular value of the entries K; no link gives 0.

    In the iteration the singular values are the eigenvalues of the symmetric
    (0, K; K', 0) of twice the size, which is scaled by its largest row sum.
    """

    def iterate(some: DataFrame, of: DataFrame) -> DataFrame:
        k = G.antisymmetric_entries(some, of, kind)
        left, right = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
        doubled = G.written(k.select("graph_id", left("src").alias("src"), right("dst").alias("dst"), "w").unionByName(k.select("graph_id", right("dst").alias("src"), left("src").alias("dst"), "w")))
        scale = G.written(doubled.groupBy("graph_id", "src").agg(F.sum(F.abs("w")).alias("s")).groupBy("graph_id").agg(F.max("s").alias("scale")).filter("scale > 0"))
        matrix = doubled.join(scale, "graph_id").select(*G.KEYS, (F.col("w") / F.col("scale")).alias("w"))
        start = start_vector(of.join(scale, "graph_id", "left_semi"))
        start = start.select("graph_id", left("atom").alias("atom"), "x").unionByName(start.select("graph_id", right("atom").alias("atom"), F.cos(F.col("atom") * 2.3).alias("x")))
        return extreme_eigenvalue(matrix, start, True, **how).join(scale, "graph_id").select("graph_id", (-F.col("value") * F.col("scale")).alias("value"), (F.col("residual") * F.col("scale")).alias("residual"))

    out = _each_graph(links, graphs, lambda a: _antisymmetric(a, kind), lambda v: 0, iterate, dense)
    return graphs.select("graph_id").join(out, "graph_id", "left").select("graph_id", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("residual", F.lit(0.0)).alias("residual"))
