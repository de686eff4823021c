import numpy as np
import pytest
from pyspark.sql import functions as F

from ordergraph.operators import graphs as G
from ordergraph.operators import spectra as P
from ordergraph.operators import tiles

EDGES = "graph_id long, src long, dst long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, graphs):
    """Edges of matrices (atoms from 1) as a table."""
    parts = [np.stack([np.full(np.count_nonzero(a), g), *(c + 1 for c in np.nonzero(a))], axis=1) for g, a in graphs.items()]
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(np.concatenate(parts), columns=["graph_id", "src", "dst"]), EDGES)


def order(seed, n):
    rng = np.random.default_rng(seed)
    u, v = rng.random(n), rng.random(n)
    at = np.argsort(u + v)
    return (u[at][:, None] < u[at]) & (v[at][:, None] < v[at])


@pytest.fixture(scope="module")
def large():
    sparse = np.triu(np.random.default_rng(3).random((2300, 2300)) < 0.002, 1)
    return {7: order(1, 1500), 8: sparse, 9: order(2, 30), 10: np.zeros((5, 5), bool)}


def test_intervals_links_and_sizes_across_blocks(spark, large):
    edges = frame(spark, large)
    want = {g: a.astype(np.float32) @ a.astype(np.float32) for g, a in large.items()}
    every = [(g, int(i) + 1, int(j) + 1, int(want[g][i, j])) for g, a in large.items() for i, j in zip(*np.nonzero(a))]
    assert rows(G.intervals(edges.unionByName(edges.filter("graph_id = 9")))) == every
    assert rows(G.transitive_reduction(edges)) == [e[:3] for e in every if e[3] == 0]
    graphs = spark.createDataFrame([(g, len(a)) for g, a in large.items()], "graph_id long, n long")
    sizes = {(g, 1): len(a) for g, a in large.items()}
    for g, _, _, n in every:
        sizes[g, n + 2] = sizes.get((g, n + 2), 0) + 1
    assert rows(G.cardinalities(edges, graphs)) == sorted((*k, v) for k, v in sizes.items())


def longest(a, ending):
    n = len(a)
    h = np.zeros(n, dtype=int)
    for t in range(n) if ending else range(n - 1, -1, -1):
        near = np.flatnonzero(a[:, t] if ending else a[t])
        h[t] = h[near].max() + 1 if len(near) else 0
    return h


def test_longest_paths_across_blocks_and_against_the_order(spark, large):
    edges, graphs = frame(spark, large), spark.createDataFrame([(g, len(a)) for g, a in large.items()], "graph_id long, n long")
    want = {ending: sorted((g, t + 1, int(h)) for g, a in large.items() for t, h in enumerate(longest(a, ending))) for ending in (True, False)}
    assert rows(G.height_profile(edges, graphs)) == want[True]
    assert rows(G.heights(edges, graphs)) == want[False]
    few = {k: order(k, 9) for k in range(3)}
    some, of = frame(spark, few), spark.createDataFrame([(g, 9) for g in few], "graph_id long, n long")
    assert rows(G.height_profile(G.reverse(some), of)) == sorted((g, t + 1, int(h)) for g, a in few.items() for t, h in enumerate(longest(a, False)))


def test_a_long_chain_needs_no_rounds(spark):
    chain = spark.range(1, 4096).select(F.lit(1).cast("long").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    graphs = spark.createDataFrame([(1, 4096)], "graph_id long, n long")
    assert rows(G.height_profile(chain, graphs)) == [(1, k, k - 1) for k in range(1, 4097)]
    got = {r[1]: r[2] for r in G.communicability(chain, graphs).collect()}
    assert got[4096] == 1 and got[4095] == 2 and got[1] == pytest.approx(np.e, rel=1e-14)


def test_path_sums_across_blocks(spark, large):
    some = {g: large[g] for g in (8, 9)}
    edges, graphs = frame(spark, some), spark.createDataFrame([(g, len(a)) for g, a in some.items()], "graph_id long, n long")
    got = {(r[0], r[1]): r[2] for r in G.communicability(edges, graphs).collect()}
    for g, a in some.items():
        total, term, k = np.ones(len(a)), np.ones(len(a)), 0
        while term.any():
            k += 1
            term = a @ term / k
            total += term
        assert np.allclose([got[g, t + 1] for t in range(len(a))], total, rtol=1e-12)


def test_tiles_of_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    graphs = spark.createDataFrame([(1, 2)], "graph_id long, n long")
    assert rows(G.intervals(none)) == [] and rows(G.heights(none, graphs)) == [(1, 1, 0), (1, 2, 0)]
    assert rows(G.communicability(none, graphs)) == [(1, 1, 1.0), (1, 2, 1.0)]
    assert rows(P.lowest_antisymmetric_eigenvalue(none, graphs)) == [(1, 0.0, 0.0)]


def test_eigenvalues_of_tiles_and_of_iteration_agree(spark):
    some = {g: order(g, n) for g, n in enumerate((3, 7, 12))}
    some = {g: np.pad(a, (0, 2)) for g, a in some.items()}  # two isolated atoms
    links = G.transitive_reduction(frame(spark, some))
    graphs = spark.createDataFrame([(g, len(a)) for g, a in some.items()], "graph_id long, n long")
    for solve in (P.last_laplacian_eigenvalue, P.first_nonzero_laplacian_eigenvalue, P.lowest_antisymmetric_eigenvalue):
        exact, near = ({r[0]: r for r in solve(links, graphs, dense=d).collect()} for d in (4, 0))
        for g in some:
            assert near[g]["value"] == pytest.approx(exact[g]["value"], abs=1e-6) and exact[g]["residual"] < 1e-9
    out = {r[0]: r["value"] for r in P.lowest_antisymmetric_eigenvalue(links, graphs, "out").collect()}
    for g, a in some.items():
        link = a & (a.astype(int) @ a.astype(int) == 0)
        d = link.sum(axis=1)
        k = np.where(link & (d > 0), -0.5 / np.maximum(d, 1), 0.0)
        assert out[g] == pytest.approx(-np.linalg.svd(k - k.T, compute_uv=False)[0], abs=1e-9)


def test_tiles_of_points_hold_their_relations(spark):
    rng = np.random.default_rng(6)
    data = [(g, int(k), float(u), float(v)) for g, n in enumerate((1, 2, 40, 2100)) for k, (u, v) in enumerate(np.round(rng.random((n, 2)), 3))]  # with ties
    points = spark.createDataFrame(data, "graph_id long, id long, u double, v double")
    packed = G.relation_tiles(points)
    assert rows(tiles.edges(packed)) == rows(G.relations_from_points(points))
    assert packed.filter("not ordered").isEmpty() and packed.filter("graph_id = 3").count() == 6
    assert rows(G.links_of_tiles(packed)) == rows(G.transitive_reduction(tiles.edges(packed)))
    assert tiles.edges(G.relation_tiles(points.limit(0))).isEmpty()
