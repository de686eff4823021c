import math

import numpy as np
import pytest

from ordergraph.operators import graphs as G
from ordergraph.operators import spectra as P

CHAIN = [(1, 1, 2), (1, 2, 3), (1, 1, 3)]
DIAMOND = [(2, 1, 2), (2, 1, 3), (2, 2, 4), (2, 3, 4), (2, 1, 4)]


@pytest.fixture(scope="module")
def ensemble(spark):
    relations = spark.createDataFrame(CHAIN + DIAMOND, "graph_id long, src int, dst int")
    graphs = spark.createDataFrame([(1, 3), (2, 4), (3, 4)], "graph_id long, n long")
    return relations, G.transitive_reduction(relations), graphs


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_transitive_reduction(ensemble):
    assert rows(ensemble[1]) == [(1, 1, 2), (1, 2, 3), (2, 1, 2), (2, 1, 3), (2, 2, 4), (2, 3, 4)]


def test_degrees_and_connectivity(ensemble):
    relations, links, graphs = ensemble
    assert [r[2:] for r in rows(G.degrees(relations, graphs)) if r[0] == 1] == [(0, 2, 2), (1, 1, 2), (2, 0, 2)]
    assert [r[2:] for r in rows(G.degrees(links, graphs)) if r[0] == 1] == [(0, 1, 1), (1, 1, 2), (1, 0, 1)]
    assert rows(G.connectivity(relations, graphs)) == [(1, 1.0), (2, 5 / 6), (3, 0.0)]


def test_heights(ensemble):
    _, links, graphs = ensemble
    assert [r[2] for r in rows(G.heights(links, graphs))] == [2, 1, 0, 2, 1, 1, 0, 0, 0, 0, 0]
    assert [r[2] for r in rows(G.height_profile(links, graphs)) if r[0] == 2] == [0, 1, 1, 2]


def test_cardinalities(ensemble):
    relations, _, graphs = ensemble
    assert [r for r in rows(G.cardinalities(relations, graphs)) if r[0] == 1] == [(1, 1, 3), (1, 2, 2), (1, 3, 1)]


def test_communicability(spark):
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4)], "graph_id long, src int, dst int")
    graphs = spark.createDataFrame([(1, 4)], "graph_id long, n long")
    assert [r[2] for r in rows(G.communicability(links, graphs))] == pytest.approx([8 / 3, 5 / 2, 2, 1])


def test_antisymmetric(ensemble):
    _, links, graphs = ensemble
    assert [r[1:] for r in rows(G.antisymmetric_entries(links, graphs)) if r[0] == 1] == [(1, 2, 0.5), (2, 1, -0.5), (2, 3, 0.5), (3, 2, -0.5)]
    assert rows(P.lowest_antisymmetric_eigenvalue(links, graphs))[0][1] == pytest.approx(-math.sqrt(2) / 2, abs=1e-9)


def test_dimension_and_components(spark, ensemble):
    half = spark.createDataFrame([(1, 0.5)], "graph_id long, connectivity double")
    assert rows(G.relation_dimension(half))[0][2] == pytest.approx(2.0)
    assert rows(G.weak_components(ensemble[1])) == [(1, 1), (2, 1)]


def test_summary_of_array(spark):
    df = spark.createDataFrame([(1, [-2.0, 0.0, 2.0, 4.0])], "k long, v array<double>")
    r = G.spectrum_summary(df, "v", "k").first()
    assert (r["num_zero"], r["min_abs_nonzero"], r["q25"], r["median"]) == (1, 2.0, -0.5, 1.0)


def test_record_rejects_unknown(ensemble):
    with pytest.raises(ValueError):
        G.record(ensemble[0], ensemble[2], ("nothing",))


def random_ensemble(spark, sizes):
    """Points in the plane, and the order, links and sizes of intervals by brute force."""
    rng, points, order = np.random.default_rng(5), [], {}
    for g, n in enumerate(sizes):
        u, v = rng.random(n), rng.random(n)
        at = np.argsort(u + v)
        u, v = u[at], v[at]
        order[g] = (u[:, None] < u) & (v[:, None] < v)
        points += [(g, int(i), float(u[i]), float(v[i])) for i in rng.permutation(n)]
    return spark.createDataFrame(points, "graph_id long, id long, u double, v double"), order


def test_order_links_and_intervals_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 6)
    points, order = random_ensemble(spark, [1, 2, 63, 64, 65, 200])
    relations = G.relations_from_points(points)
    inside = {g: r.astype(int) @ r.astype(int) for g, r in order.items()}
    every = [(g, i + 1, j + 1, inside[g][i, j]) for g, r in order.items() for i, j in zip(*np.nonzero(r))]
    assert rows(relations) == [e[:3] for e in every]
    assert rows(G.intervals(relations)) == every
    assert rows(G.transitive_reduction(relations)) == [e[:3] for e in every if e[3] == 0]


def test_intervals_of_reversed_repeated_and_no_edges(spark, ensemble):
    back = G.reverse(ensemble[0])
    assert rows(G.transitive_reduction(back.unionByName(back))) == rows(G.reverse(ensemble[1]))
    assert rows(G.transitive_reduction(back.limit(0))) == []


def test_eigenvalues_against_dense_matrices(spark):
    points, order = random_ensemble(spark, [2, 3, 4, 9, 20])
    graphs = spark.createDataFrame([(g, len(r)) for g, r in order.items()], "graph_id long, n long")
    links = G.transitive_reduction(G.relations_from_points(points))
    found = {f: {r[0]: r for r in f(links, graphs).collect()} for f in (P.first_nonzero_laplacian_eigenvalue, P.last_laplacian_eigenvalue, P.lowest_antisymmetric_eigenvalue)}
    for g, r in order.items():
        link = r & (r.astype(int) @ r.astype(int) == 0)
        a = (link | link.T).astype(float)
        root = np.sqrt(np.maximum(a.sum(1), 1))
        values = np.linalg.eigvalsh(np.eye(len(a)) - a / np.outer(root, root))
        first, last, lowest = (f[g]["value"] for f in found.values())
        if len(a) < 3:
            assert math.isnan(last) and math.isnan(first)
        else:
            assert (first, last) == pytest.approx((values[values > 1e-9][0], values[-1]), abs=1e-7)
        k = np.where(link, 0.5 / np.maximum(link.sum(0), 1), 0.0)
        assert lowest == pytest.approx(-np.linalg.svd(k - k.T, compute_uv=False)[0], abs=1e-7)


def test_arrays_that_are_no_links_fail(spark):
    graphs = spark.createDataFrame([(1, 3)], "graph_id long, n long")
    arrays = lambda *rows: spark.createDataFrame(rows, "graph_id long, src int, future array<int>")
    assert rows(G.arrays_to_links(arrays((1, 1, [2, 3]), (1, 3, [])), graphs)) == [(1, 1, 2), (1, 1, 3)]
    for bad in ((1, 1, [4]), (1, 1, [0]), (1, 0, [1]), (1, 4, [1]), (1, 1, [2, 2]), (1, 1, [None]), (1, None, [1]), (1, 1, None), (2, 1, [2])):
        with pytest.raises(Exception, match="not an array of links"):
            G.arrays_to_links(arrays((1, 1, [2]), bad), graphs).collect()


def test_record_of_all_groups(ensemble):
    got = {r["graph_id"]: r for r in G.record(ensemble[0], ensemble[2], G.GROUPS).collect()}
    assert got[2]["height_profile_max"] == 2 and got[2]["degree_mean"] == 2.5 and got[2]["cardinalities_max"] == 4 and got[3]["connectivity"] == 0


@pytest.mark.parametrize("walk", [64, 1])
def test_components_against_brute_force(spark, monkeypatch, walk):
    """graphs of one and of several blocks, by a walk through tiles (no round of joins) and by rounds."""
    monkeypatch.setattr(G.tiles, "WALK", walk)
    if walk > 1:
        monkeypatch.setattr(G, "_labels_by_rounds", None)
    rng, edges, want = np.random.default_rng(6), [], []
    for g, n in enumerate([2, 5, 30, 900, 3000]):
        mine = rng.integers(1, n + 1, size=(max(1, int(0.6 * n)), 2))
        mine = mine[mine[:, 0] != mine[:, 1]] if n > 2 else np.array([[2, 1]])
        label = list(range(n + 1))
        for s, d in np.r_[mine, mine[::-1]].tolist():
            low, high = sorted((label[s], label[d]))
            label = [low if x == high else x for x in label] if low != high else label
        edges += [(g, s, d) for s, d in mine.tolist()]
        want.append((g, len({label[a] for a in np.unique(mine)})))
    links = spark.createDataFrame(edges, "graph_id long, src int, dst int")
    assert rows(G.weak_components(links)) == want
    assert rows(G.weak_components_of_tiles(G.written(G.tiles.packed(spark.createDataFrame(CHAIN, "graph_id long, src int, dst int"))))) == [(1, 1)]


def test_record_of_tiles_equals_that_of_edges(spark):
    """graphs without relations, of one block, of more than 64 atoms, and of two blocks."""
    points, order = random_ensemble(spark, [1, 2, 3, 10, 100, 1100])
    packed = G.relation_tiles(points)
    graphs = spark.createDataFrame([(g, len(r)) for g, r in order.items()] + [(9, 3)], "graph_id long, n long")
    got, want = (sorted(map(tuple, f(r, graphs, G.GROUPS).collect())) for f, r in ((G.record_of_tiles, packed), (G.record, G.tiles.edges(packed))))
    assert len(got) == len(want) == 7
    for one, two in zip(got, want):
        assert [x is None for x in one] == [x is None for x in two]
        assert [x for x in one if x is not None] == pytest.approx([x for x in two if x is not None], abs=1e-9)
    with pytest.raises(ValueError):
        G.record_of_tiles(packed, graphs, ("nothing",))
