import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordergraph.operators import distances as D
from ordergraph.operators import draws as R
from ordergraph.operators import neighbours as N
from ordergraph.operators import twosample as W


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    a, b = rng.dirichlet(np.ones(6), 70), rng.dirichlet(np.array([1.5, 1, 1, 1, 1, 0.7]), 50)
    b[3] = b[4]
    return a, b


@pytest.fixture(scope="module")
def vectors(spark, sample):
    rows = [(k, [float(x) for x in v], c) for c, part, base in (("a", sample[0], 0), ("b", sample[1], 1000)) for k, v in enumerate(part, base)]
    return spark.createDataFrame(rows, "sample_id long, vec array<double>, cls string").cache()


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 25)
    monkeypatch.setattr(D.blocks, "__defaults__", (25, 0))


def test_distances_of_matrices(sample):
    a, b = sample
    h, t = D.hellinger(a, b), D.total_variation(a, b)
    for i, j in ((0, 0), (5, 7), (69, 49)):
        assert h[i, j] == pytest.approx(np.sqrt(((np.sqrt(a[i]) - np.sqrt(b[j])) ** 2).sum() / 2)) and t[i, j] == pytest.approx(np.abs(a[i] - b[j]).sum() / 2)
    assert D.squared(b, b)[3, 4] == 0 and D.squared(a, b)[1, 2] == pytest.approx(((a[1] - b[2]) ** 2).sum())


def test_energy_and_quantiles_over_blocks(vectors, sample, monkeypatch):
    a, b = sample
    m = lambda x, y: D.hellinger(x, y).mean()
    e = 2 * m(a, b) - m(a, a) - m(b, b)
    (got,) = D.energy(vectors, D.hellinger).collect()
    assert got.energy == pytest.approx(e, abs=1e-6) and got.distinguishability == pytest.approx(e / 2 / m(a, b), abs=1e-6)
    inside = {"a": D.hellinger(a, a)[np.triu_indices(70, 1)], "b": D.hellinger(b, b)[np.triu_indices(50, 1)]}
    assert D.within(vectors, D.hellinger).groupBy("k").count().collect().__len__() == 2
    for digits in ((16, 16, 16, 16), (32, 20, 12)):
        monkeypatch.setattr(D, "DIGITS", digits)
        got = {r.k: r.threshold for r in D.within_percentile(vectors, D.hellinger, 0.95).collect()}
        assert got == pytest.approx({k: np.quantile(x, 0.95) for k, x in inside.items()}, abs=1e-7)
    cross = D.hellinger(a, b).ravel()
    (x,) = D.exceedance(vectors, D.hellinger).collect()
    assert x.distinguishability == pytest.approx((cross > np.quantile(inside["a"], 0.95)).mean()) and x.std == pytest.approx(cross.std(ddof=1))
    assert x.high == pytest.approx(np.quantile(cross, 0.84) - cross.mean(), abs=1e-7)
    (mc,) = W.mc_energy(vectors, D.hellinger, 4000).collect()
    assert abs(mc.distinguishability - e / 2 / m(a, b)) < 5 * mc.std < 0.1


def projected(a, b):
    x = np.concatenate([a, b])
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(len(values))] < 0, -1, 1)
    keep = values > 1e-6 * np.median(values)
    z = (x - x.mean(axis=0)) @ axes[:, keep]
    return z + np.maximum(-z.min(axis=0), 0) + 1e-12


def test_projection(vectors, sample):
    z = projected(*sample)
    got = np.array([r.vec for r in W.project(vectors).orderBy("sample_id").collect()])
    assert got.shape == (120, 5) and np.allclose(got, z, atol=1e-9)
    p = np.array([r.vec for r in W.principal(vectors, "dim", 2).orderBy("sample_id").collect()])
    values = np.sort(np.linalg.eigvalsh(np.cov(np.concatenate(sample).T)))[::-1]
    assert p.shape == (120, 2) and p.var(axis=0, ddof=1) == pytest.approx(values[:2])


def digamma(n):
    return -0.5772156649015329 + sum(1 / k for k in range(1, n))


def test_neighbour_information(spark, vectors, sample):
    assert [r[0] for r in spark.range(1, 40).select(W.digamma(F.col("id").cast("double"))).collect()] == pytest.approx([digamma(n) for n in range(1, 40)])
    z, n = projected(*sample), 120
    label = np.arange(n) < 70
    d = D.squared(z, z)
    np.fill_diagonal(d, np.inf)
    radius = np.array([np.sort(d[i][label == label[i]])[4] for i in range(n)]) + 1e-14
    m = (d <= radius[:, None]).sum(axis=1)
    h = -sum(p * np.log(p) for p in (70 / 120, 50 / 120))
    mi = digamma(120) - (70 * digamma(70) + 50 * digamma(50)) / 120 + digamma(5) - np.mean([digamma(int(x)) for x in m])
    (got,) = W.neighbour_information(vectors).collect()
    assert got.information == pytest.approx(min(max(mi / h, 0), 1), abs=1e-9) and got.information > 0
    (boot,) = W.bootstrap_information(vectors, 2).collect()
    assert 0 <= boot.information <= 1 and boot.std >= 0
    far = vectors.withColumn("vec", F.when(F.col("cls") == "a", F.transform("vec", lambda x: x + 100.0)).otherwise(F.col("vec")))
    assert W.neighbour_information(far).first().information > 0.97


def test_permutations_are_permutations():
    for n in (1, 2, 7, 100, 1000):
        seen = [W.permuted(np.arange(n), n, key) for key in range(5)]
        assert all(sorted(s) == list(range(n)) for s in seen)
    share = np.mean([W.permuted(np.arange(40), 40, key) < 20 for key in range(2000)], axis=0)
    assert np.abs(share - 0.5).max() < 0.06


def test_permutation_tests(vectors, sample):
    (got,) = W.permutation_test(vectors, D.hellinger, 99).collect()
    assert got.p == pytest.approx(round(got.p * 100) / 100) and got.observed > 0
    (mc,) = W.mc_permutation_test(vectors, D.hellinger, 4950, 99).collect()
    assert mc.observed == pytest.approx(got.observed, abs=1e-9)  # all pairs of 2 x 50 samples are drawn
    same = vectors.withColumn("cls", F.when(F.col("sample_id") % 2 == 0, "a").otherwise("b"))
    assert W.permutation_test(same, D.hellinger, 99).first().p > 0.02
    (bias,) = W.state_bias(vectors, 1).collect()
    assert 0 <= bias.debiased <= bias.distinguishability <= 1 and bias.bias_std > 0


def test_mahalanobis_gap(vectors, sample):
    a, b = sample
    (got,) = W.mahalanobis_gap(vectors, 50).collect()
    _, axes = np.linalg.eigh(np.cov(np.concatenate([a, b]).T))
    a, b = a @ axes[:, 1:], b @ axes[:, 1:]
    z = np.sqrt(np.einsum("ij,jk,ik->i", a - b.mean(axis=0), np.linalg.inv(np.cov(b.T)), a - b.mean(axis=0)))
    assert got.observed == pytest.approx(z.min(), rel=1e-6) and got.threshold > 0 and not got.distinguishable
    far = vectors.withColumn("vec", F.when(F.col("cls") == "a", F.transform("vec", lambda x, i: x + F.when(i == 0, 9.0).otherwise(0.0))).otherwise(F.col("vec")))
    (apart,) = W.mahalanobis_gap(far, 50, symmetric=True).collect()
    assert apart.distinguishable and apart.D > 0.999 and apart.observed_min == min(apart.observed, apart.observed_sym)


def _brute_pairs(rows, metric):
    """Distances of the unordered pairs of samples, by pair of classes."""
    out = {}
    for n, (_, v, k) in enumerate(rows):
        for _, w, m in rows[n + 1 :]:
            out.setdefault((min(k, m), max(k, m)), []).append(float(metric(np.array([v]), np.array([w]))[0, 0]))
    return out


@pytest.mark.parametrize("block,listed,classes", [(1024, 20_000, 60), (20, 2, 4)])
def test_quantiles_of_many_classes_against_sorting(spark, monkeypatch, block, listed, classes):
    monkeypatch.setattr(D, "LISTED", listed)
    monkeypatch.setattr(D.blocks, "__defaults__", (block, 0))
    rng = np.random.default_rng(11)
    rows = [(n, [float(x) for x in np.round(rng.random(3), 1)], int(k)) for n, k in enumerate(rng.integers(0, classes, size=5 * classes))]  # with ties
    rows += [(1000, [0.5, 0.5, 0.5], 77)]  # a class without pairs
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>, cls int")
    want = _brute_pairs(rows, D.total_variation)
    shares = [0.0, 0.16, 0.5, 1.0]
    for pairs in ("within", "cross"):
        got = {(r["k1"], r["k2"]): r for r in D.quantiles(df, D.total_variation, shares, pairs=pairs).collect()}
        mine = {p: d for p, d in want.items() if (p[0] == p[1]) == (pairs == "within")}
        assert set(got) == set(mine)
        for p, d in mine.items():
            assert got[p]["n"] == len(d) and got[p]["values"] == pytest.approx(list(np.quantile(d, shares)), abs=1e-12)
            assert got[p]["mean"] == pytest.approx(np.mean(d)) and (len(d) == 1 or got[p]["std"] == pytest.approx(np.std(d, ddof=1), abs=1e-7))


def test_exceedance_against_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = [(n, [float(x) for x in rng.random(4) + k / 4], "abc"[k]) for n, k in enumerate(rng.integers(0, 3, size=90))]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>, cls string")
    d = _brute_pairs(rows, D.total_variation)
    for reference in (None, "b"):
        got = {(r["k1"], r["k2"]): r for r in D.exceedance(df, D.total_variation, 0.9, reference=reference).collect()}
        assert set(got) == {p for p in d if p[0] != p[1] and (reference is None or reference in p)}
        for p, r in got.items():
            own = reference or p[0]
            x = np.array(d[p])
            assert r["distinguishability"] == pytest.approx((x > np.quantile(d[own, own], 0.9)).mean())
            assert (r["mean"], r["low"], r["high"]) == pytest.approx((x.mean(), x.mean() - np.quantile(x, 0.16), np.quantile(x, 0.84) - x.mean()))


def test_poisson_weights_are_poisson():
    w = W.poisson_weights(np.arange(5000), 40, 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06
    assert (W.poisson_weights(np.array([7]), 40, 3) == w[7]).all() and (W.poisson_weights(np.arange(50), 40, 4) != w[:50]).any()


def _information(x, labels, weights, k):
    """Of samples that stand as often as their weights say, by all distances."""
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d = np.where(d == 0, 1e-12 * (np.arange(len(x)) + 1)[None, :], d)
    total, psi = weights.sum(), 0.0
    for i in np.flatnonzero(weights):
        w = weights.astype(float).copy()
        w[i] -= 1
        mine = np.flatnonzero(labels == labels[i])
        order = mine[np.argsort(d[i, mine])]
        at = int(np.argmax(np.cumsum(w[order]) >= k))
        psi += weights[i] * W._digammas(np.array([w[d[i] <= d[i, order[at]] + 1e-14].sum()]))[0]
    share = [weights[labels == c].sum() / total for c in (0, 1)]
    mi = W._digammas(np.array([float(total)]))[0] - sum(s * W._digammas(np.array([s * total]))[0] for s in share) + W._digammas(np.array([float(k)]))[0] - psi / total
    return min(max(mi / -sum(s * np.log(s) for s in share), 0.0), 1.0)


@pytest.mark.parametrize("block", [1024, 16])
def test_weighted_information_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D.blocks, "__defaults__", (block, 0))
    rng = np.random.default_rng(21)
    x, labels = rng.normal(size=(70, 3)), (np.arange(70) >= 40).astype(int)
    x[labels == 1] += 0.8
    rows = [(n, [float(e) for e in v], "ab"[c]) for n, (v, c) in enumerate(zip(x, labels))]
    got = {r["draw"]: r["information"] for r in W.weighted_information(spark.createDataFrame(rows, "sample_id long, vec array<double>, cls string"), 12, 3).collect()}
    weights = W.poisson_weights(np.arange(70), 12, 1)
    for draw in range(12):
        assert got[draw] == pytest.approx(_information(x, labels, weights[:, draw], 3), abs=1e-9)


def test_weights_deviate_as_copies_do(spark):
    rng = np.random.default_rng(22)
    rows = [(n, [float(e) for e in rng.normal(size=3) + (n % 2) * 0.9], "ab"[n % 2]) for n in range(120)]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>, cls string")
    one = W.weighted_information(df, 400).toPandas()["information"]
    x, labels = np.array([r[1] for r in rows]), np.array([n % 2 for n in range(120)])
    two = []
    for _ in range(400):
        w = np.zeros(120, dtype=int)
        for c in (0, 1):
            np.add.at(w, rng.choice(np.flatnonzero(labels == c), size=60), 1)
        two.append(_information(x, labels, w, 5))
    assert one.std() == pytest.approx(np.std(two), rel=0.1) and one.mean() == pytest.approx(np.mean(two), abs=0.03)


def test_permutation_tests_of_pairs_equal_those_of_two(spark):
    rng = np.random.default_rng(31)
    rows = [(n, [float(x) for x in rng.dirichlet(np.ones(4) + k)], int(k)) for n, k in enumerate(rng.permutation(np.arange(120) % 4))]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>, scalar int")
    every = {(r["k1"], r["k2"]): r for r in W.permutation_tests(df, D.hellinger, 99, "scalar").collect()}
    assert set(every) == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    against = {(r["k1"], r["k2"]): r for r in W.permutation_tests(df, D.hellinger, 99, "scalar", 2).collect()}
    assert set(against) == {(k, 2) for k in (0, 1, 3)}
    for (a, b), found in [((0, 3), every[0, 3]), ((1, 2), against[1, 2]), ((3, 2), against[3, 2])]:
        two = df.filter(F.col("scalar").isin([a, b])).withColumn("cls", F.when(F.col("scalar") == a, "a").otherwise("b"))
        (alone,) = W.permutation_test(two, D.hellinger, 99).collect()
        assert found["observed"] == pytest.approx(alone["observed"]) and found["p"] == pytest.approx(alone["p"], abs=0.12)
        x, y = (np.array([v for _, v, k in sorted(rows) if k == c]) for c in (a, b))
        mean = lambda p, q, same: D.hellinger(p, q)[np.triu_indices(30, 1)].mean() if same else D.hellinger(p, q).mean()
        e = 2 * mean(x, y, False) - mean(x, x, True) - mean(y, y, True)
        assert found["observed"] == pytest.approx(e / (2 * mean(x, y, False)))


def _cloud(spark, a, b):
    rows = [(k, [float(x) for x in v], c) for c, part, base in (("a", a, 0), ("b", b, 10_000)) for k, v in enumerate(part, base)]
    return spark.createDataFrame(rows, "sample_id long, vec array<double>, cls string")


def _brute_counts(a, b, few):
    """Samples within the few-th neighbour's squared distance, zeros by places that the caller has none of."""
    every = np.concatenate([a, b])
    d = ((every[:, None, :] - every[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    side = np.arange(len(every)) < len(a)
    return [int((row <= np.sort(row[side == own])[few - 1] + 1e-14).sum()) for row, own in zip(d, side)]


@pytest.fixture
def small_balls(monkeypatch):
    monkeypatch.setattr(N, "BALL", 16)
    monkeypatch.setattr(N, "SHELL", 20)


def test_balls_find_all_neighbours(spark, small_balls):
    rng = np.random.default_rng(11)
    centres = rng.uniform(-100, 100, (8, 5))
    a, b = (centres[rng.integers(0, 8, n)] + rng.normal(0, 1, (n, 5)) for n in (230, 170))
    v = _cloud(spark, a, b)
    balls = N.balls(D.keyed(v, "cls"))
    assert balls.shells.agg(F.sum("n")).first()[0] == 400 and balls.shells.agg(F.max("n")).first()[0] < 80
    got = [r.m for r in W.neighbour_counts(balls, 5).orderBy("sample_id").collect()]
    assert got == _brute_counts(a, b, 5)
    work = W.neighbour_work(v).first()
    assert 0 < work.searched < 0.4 and 0 < work.counted < 0.4


def test_balls_equal_cells_with_hot_copies(spark, small_balls, scale=1e6):
    """A third of a class is one vector, and lies in one ball, which a hash cuts."""
    rng = np.random.default_rng(12)
    a, b = rng.normal(0, scale, (150, 4)), rng.normal(0.5 * scale, scale, (90, 4))
    a[:50], b[:5] = a[0], a[0]
    v = _cloud(spark, a, b)
    one, two = (W.neighbour_information(v, projected=False, search=s).first().information for s in ("balls", "cells"))
    assert one == pytest.approx(two, abs=1e-12)
    assert N.balls(D.keyed(v, "cls")).shells.agg(F.max("n")).first()[0] < 60


def test_balls_of_few_samples(spark, small_balls):
    v = _cloud(spark, np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([[5.0, 5.0], [6.0, 5.0], [5.0, 5.0]]))
    one, two = (W.neighbour_information(v, projected=False, search=s).first().information for s in ("balls", "cells"))
    assert one == pytest.approx(two, abs=1e-12)
    with pytest.raises(ValueError):
        W.neighbour_information(v.filter("cls = 'a'"))
    with pytest.raises(ValueError):
        W.neighbour_information(v, search="trees")


def test_drawn_pairs_are_unbiased_and_know_their_deviation(spark):
    """Means of many seeds against all pairs, from few cells of many blocks."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, (160, 3)), rng.normal(0.5, 1, (120, 3))
    v = D.keyed(_cloud(spark, a, b), "cls")
    packed = D.blocks(v, 25)
    table = packed[0].cache()
    metric = lambda x, y: np.sqrt(D.squared(x, y))
    every = {k: metric({"a": a, "b": b}[k[0]], {"a": a, "b": b}[k[1]]).mean() for k in R.KINDS}
    seeds, means = 12, {k: [] for k in R.KINDS}
    frames = [R.drawn_pairs(v, metric, 1024, s, packed=(table, packed[1])).groupBy("kind").agg(F.avg("d").alias("m"), F.count("*").alias("n")) for s in range(seeds)]
    for f in frames:
        for r in f.collect():
            assert r.n == 1024
            means[r.kind].append(r.m)
    for k, m in means.items():
        assert abs(np.mean(m) - every[k]) < 5 * np.std(m, ddof=1) / np.sqrt(seeds)
    assert np.std(means["ab"]) < 0.1


def test_what_draws_move_does_not_follow_their_number(spark, vectors):
    """Whatever the draws, a kind has at most GROUPS groups, and each pair of blocks meets once."""
    few, many = (R.drawn_pairs(vectors, D.hellinger, n, 3) for n in (500, 5000))
    of = lambda df: df.groupBy("kind").agg(F.countDistinct("grp").alias("g"), F.count("*").alias("n"), F.countDistinct("draw").alias("m")).collect()
    assert {(r.g, r.n, r.m) for r in of(few)} == {(256, 500, 500)} and {(r.g, r.n, r.m) for r in of(many)} == {(256, 5000, 5000)}
    with pytest.raises(ValueError):
        R.drawn_pairs(vectors, D.hellinger, 0)
    with pytest.raises(ValueError):
        R.drawn_pairs(vectors.filter("cls = 'a'"), D.hellinger, 10)


def test_distinct_pairs(spark, vectors):
    """Each pair at most once, with the distance of its places; all of them if as many are asked for."""
    rows = W.numbered(vectors)[0].filter("at < 50").select("sample_id", "vec", (F.col("at") + F.when(F.col("cls") == "b", 50).otherwise(0)).alias("place"))
    of = {r.place: np.array(r.vec) for r in rows.collect()}

    def give(d, i, j, p, q):
        return pd.DataFrame({"p": np.minimum(p[i], q[j]), "q": np.maximum(p[i], q[j]), "d": d})

    for draws, groups in ((4950, 256), (900, 256), (200, 3)):
        got = R.distinct_pairs(rows, D.hellinger, draws, give, "p long, q long, d double", groups).collect()
        assert len({(r.p, r.q) for r in got}) == len(got) and all(r.p < r.q for r in got)
        assert len(got) == draws if draws == 4950 else 0.6 * draws < len(got) < 1.6 * draws
        for r in got[:50]:
            assert r.d == pytest.approx(D.hellinger(of[r.p][None], of[r.q][None])[0, 0], abs=1e-7)
    with pytest.raises(ValueError):
        R.distinct_pairs(rows, D.hellinger, 4951, give, "p long, q long, d double")


def _by_place(vectors, seed):
    return {(r.cls, r["at"]): np.array(r.vec) for r in W.numbered(vectors, seed)[0].collect()}


def test_null_of_permutations_against_explicit_labels(vectors):
    """Every relabelling by itself, with means over the pairs of each side."""
    at, n = _by_place(vectors, 1), 50
    x = np.stack([at[c, k] for c in ("a", "b") for k in range(n)])
    d, place, found = D.hellinger(x, x), np.arange(2 * n), []
    for p in range(-1, 40):
        first = place < n if p < 0 else W.permuted(place, 2 * n, 1_000_003 + p) < n
        inside = lambda s: d[np.ix_(s, s)][np.triu_indices(n, 1)].mean()
        ab = d[np.ix_(first, ~first)].mean()
        found.append((2 * ab - inside(first) - inside(~first)) / (2 * ab))
    seen, null = found[0], np.array(found[1:])
    got = W.permutation_test(vectors, D.hellinger, 40).first()
    assert got.observed == pytest.approx(seen, abs=1e-9) and got.p == pytest.approx(((null >= seen - 1e-12).sum() + 1) / 41)
    assert got.null_mean == pytest.approx(null.mean(), abs=1e-9) and got.null_std == pytest.approx(null.std(ddof=1), abs=1e-9)
    assert got.z_emp == pytest.approx((seen - null.mean()) / null.std(ddof=1), rel=1e-6)


def test_threshold_of_the_gap_against_explicit_halves(vectors, sample):
    """The threshold, the raised variances and the z value, from halves that are taken one by one."""
    a, b = sample
    splits, pooled = 30, np.concatenate([a, b])
    values, axes = W.eigen(np.cov(pooled.T))
    keep = axes[:, W.kept_axes(values, 1e-6)]
    at = _by_place(vectors.filter("cls = 'b'").withColumn("cls", F.lit("r")), 1)
    z = np.stack([at["r", k] for k in range(len(b))]) @ keep
    own, turn = W.eigen(np.cov(z.T))
    y, half = (z - z.mean(axis=0)) @ turn, len(b) // 2
    halves = []
    for s in range(splits):
        place = W.permuted(np.arange(len(b)), len(b), 100_003 + s)
        halves.append((y[place < half], y[(place >= half) & (place < 2 * half)]))
    small = np.median([h.var(axis=0, ddof=1) for pair in halves for h in pair], axis=0)
    weight = np.maximum(np.maximum(own, np.where(own < 0.01 * np.median(own), small, 0)), 1e-6 * np.median(own))
    base = [np.sqrt(((one - two.mean(axis=0)) ** 2 / weight).sum(axis=1)).min() for one, two in halves]
    seen = np.sqrt((((a @ keep - z.mean(axis=0)) @ turn) ** 2 / weight).sum(axis=1)).min()
    got = W.mahalanobis_gap(vectors, splits).first()
    assert got.observed == pytest.approx(seen, rel=1e-6) and got.threshold == pytest.approx(np.quantile(base, 0.95), rel=1e-6)
    assert got.z_emp == pytest.approx((seen - np.mean(base)) / np.std(base, ddof=1), rel=1e-5) and got.distinguishable == (got.observed > got.threshold)


def test_blocks_are_sent_once_for_each_group(spark):
    """What is moved follows the blocks, not their square, and small classes are not cut finer."""
    rng = np.random.default_rng(21)
    rows = [(n, [float(x) for x in rng.random(3)], n % 10) for n in range(1500)]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>, cls int")
    table, sizes = D.blocks(D.keyed(df, "cls"), 25)
    number = table.count()
    assert sum(sizes.values()) == 1500 and number <= 60
    give = lambda one, two: iter([pd.DataFrame({"sent": [len({r.no for r in one + two})]})])
    assert number < D.meetings(table, give, "sent long").agg({"sent": "sum"}).first()[0] <= D.GROUPS * number
    (sent,) = D.meetings(table, give, "sent long", "within").agg({"sent": "sum"}).first()
    assert sent <= D.GROUPS * number
    n = D.pair_sums(df, D.total_variation).agg({"n": "sum"}).first()[0]
    assert n == 1500 * 1499 // 2


def test_permutations_of_many_keys_at_once():
    """Labels of all permutations from one call equal those of each."""
    places = np.arange(300)
    every = R.permuted_by(places, 300, np.arange(7, 20))
    assert all((every[:, n] == R.permuted(places, 300, key)).all() for n, key in enumerate(range(7, 20)))


def test_shells_are_sent_once_for_each_group(spark, small_balls):
    """also where no row can rule a shell out."""
    rng = np.random.default_rng(22)
    shells = N.balls(D.keyed(_cloud(spark, rng.normal(0, 1, (400, 8)), rng.normal(0, 1, (300, 8))), "cls")).shells
    number = shells.count()
    give = lambda one, two: iter([pd.DataFrame({"sent": [len({r.no for r in one + two})]})])
    assert number > 20 and D.meetings(shells, give, "sent long").agg({"sent": "sum"}).first()[0] <= D.GROUPS * number


def test_pairs_with_a_reference_send_little_and_quantiles_take_three_rounds(spark, monkeypatch):
    """Groups without a wanted pair of classes do not meet, and sums come with the first bits."""
    rng = np.random.default_rng(22)
    rows = [(n, [float(x) for x in rng.random(3)], n % 10) for n in range(1500)]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>, cls int")
    table, _ = packed = D.blocks(D.keyed(df, "cls"), 25)
    give = lambda one, two: iter([pd.DataFrame({"sent": [len({r.no for r in one + two})]})])
    sent = lambda wanted: D.meetings(table, give, "sent long", wanted=wanted).agg({"sent": "sum"}).first()[0]
    assert sent({(0, k) for k in range(10)}) < 0.6 * sent(None) and sent({(9, 9)}) < 0.3 * sent(None)
    calls, cells = [], D.cells
    monkeypatch.setattr(D, "cells", lambda *a, **b: calls.append(a) or cells(*a, **b))
    got = {r["k1"]: r["values"][0] for r in D.quantiles(df, D.total_variation, [0.95], packed=packed).collect()}
    assert len(calls) == 3
    x = {k: np.array([r[1] for r in rows if r[2] == k]) for k in range(10)}
    want = {k: np.quantile(D.total_variation(v, v)[np.triu_indices(len(v), 1)], 0.95) for k, v in x.items()}
    assert got == pytest.approx(want, abs=1e-12)


def test_drawn_pairs_of_one_kind(vectors):
    """a kind alone has the draws it has beside the others, which are not made."""
    every, one = (sorted(map(tuple, W.mc_apply(vectors, D.hellinger, 300, **k).filter("kind = 'ab'").collect())) for k in ({}, {"kinds": ("ab",)}))
    assert len(one) == 300 and one == every
    assert {r.kind for r in W.mc_apply(vectors, D.hellinger, 300, kinds=("ab",)).select("kind").distinct().collect()} == {"ab"}


@pytest.mark.parametrize("values", [1 << 27, 0])
def test_exceedance_takes_two_passes_unless_its_values_are_too_many(spark, monkeypatch, values):
    """with ties, gaps and a class without pairs; the percentile and the far pairs come from what the second pass lists."""
    rng = np.random.default_rng(31)
    rows = [(n, [float(x) for x in np.round(rng.random(3), 1 + n % 2) + k / 3], int(k)) for n, k in enumerate(rng.integers(0, 3, size=80))] + [(500, [9.0, 0.0, 0.0], 7)]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>, cls int")
    d = _brute_pairs(rows, D.total_variation)
    calls, cells = [], D.cells
    monkeypatch.setattr(D, "VALUES", values)
    monkeypatch.setattr(D, "cells", lambda *a, **b: calls.append(a) or cells(*a, **b))
    for reference in (None, 1, 7):
        calls.clear()
        got = {(r["k1"], r["k2"]): r for r in D.exceedance(df, D.total_variation, 0.9, reference=reference).collect()}
        assert len(calls) == (2 if values else 4)
        assert set(got) == {p for p in d if p[0] != p[1] and (reference is None or reference in p)}
        for p, r in got.items():
            x, own = np.array(d[p]), p[0] if reference is None else reference
            limit = np.quantile(d[own, own], 0.9) if (own, own) in d else np.inf
            assert r["distinguishability"] == (x > limit).mean()
            assert (r["mean"], r["low"], r["high"]) == pytest.approx((x.mean(), x.mean() - np.quantile(x, 0.16), np.quantile(x, 0.84) - x.mean()))


@pytest.mark.parametrize("ranges", [1 << 16, 30])
def test_sums_of_total_variation_without_pairs(spark, monkeypatch, ranges):
    """one range or several, ties, a class of one sample and one of copies; no two blocks meet."""
    rng = np.random.default_rng(32)
    rows = [(n, [float(x) for x in np.round(rng.random(3), 1 + n % 3)], int(k)) for n, k in enumerate(rng.integers(0, 4, size=200))]
    rows += [(500, [9.0, 0.0, 0.1], 7)] + [(600 + n, [0.1, 0.2, 0.7], 8) for n in range(9)]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>, cls int")
    monkeypatch.setattr(D, "RANGE", ranges)
    want = {p: (len(d), sum(d)) for p, d in _brute_pairs(rows, D.total_variation).items()}
    calls, meetings = [], D.meetings
    monkeypatch.setattr(D, "meetings", lambda *a, **b: calls.append(a) or meetings(*a, **b))
    got = {(r["k1"], r["k2"]): (r["n"], r["s"]) for r in D.variation_sums(df).collect()}
    assert {p: r[0] for p, r in got.items()} == {p: r[0] for p, r in want.items()} and got[8, 8] == (36, 0.0)
    assert [got[p][1] for p in want] == pytest.approx([r[1] for r in want.values()], rel=1e-12)
    energy = {(r["k1"], r["k2"]): r["energy"] for r in D.energy(df, D.total_variation, reference=2).collect()}
    assert not calls and set(energy) == {p for p in want if 2 in p and p[0] != p[1]}
    size = {k: sum(r[2] == k for r in rows) for k in range(9)}
    mean = lambda a, b: want.get((a, b), (0, 0.0))[1] * (2 if a == b else 1) / size[a] / size[b]
    assert energy == pytest.approx({(a, b): 2 * mean(a, b) - mean(a, a) - mean(b, b) for a, b in energy}, abs=1e-12)
    named = df.unionByName(spark.createDataFrame([(998, [0.1, float("nan"), 0.2], 6)], df.schema)).withColumn("cls", F.concat(F.lit("c"), "cls"))
    again = {(r["k1"], r["k2"]): r["s"] for r in D.variation_sums(named).collect()}
    assert {p for p, x in again.items() if x != x} == {p for p in again if "c6" in p} != set()
    assert [again[f"c{a}", f"c{b}"] for a, b in want] == pytest.approx([r[1] for r in want.values()], rel=1e-12)
    with pytest.raises(ValueError):
        D.variation_sums(df.unionByName(spark.createDataFrame([(999, [1.0], 0)], df.schema)))


def test_radii_of_resamples_take_less_room_than_their_number(spark, monkeypatch):
    """beside a vector lie its neighbours' distances and places among them, not a radius for each resample."""
    rng = np.random.default_rng(33)
    df = _cloud(spark, rng.normal(0, 1, (60, 3)), rng.normal(0.5, 1, (50, 3)))
    wide, cells = [], W.cells
    monkeypatch.setattr(W, "cells", lambda *a, **b: wide.append(b.get("beside", 0)) or cells(*a, **b))
    assert W.weighted_information(df, 200).count() == 200 and 0 < wide[-1] < 100


def test_permutations_leave_out_blocks_beyond_the_smaller_class(spark, monkeypatch):
    """what is cut off does not meet, and the reference's cells are in several tasks."""
    rng = np.random.default_rng(34)
    df = _cloud(spark, rng.random((60, 4)), rng.random((500, 4)))
    met, meetings = [], D.meetings
    monkeypatch.setattr(D, "meetings", lambda t, *a: met.append((t.agg(F.sum("n")).first()[0], a)) or meetings(t, *a))
    W.permutation_test(df, D.hellinger, 9).collect()
    assert 120 <= met[0][0] < 200 and met[0][1][-1] == W.PERMUTED_GROUPS


def test_groups_meet_by_lines_of_a_plane(spark):
    """Every two blocks meet once, and a block is sent 6 times, or 4 times where two classes meet themselves."""
    for q in (2, 3, 5, 7):
        lines = D.plane(q)
        assert len(lines) == q * q + q + 1 and {len(x) for x in lines} == {q + 1}
        assert sorted(p for x in lines for n, a in enumerate(sorted(x)) for p in ((a, b) for b in sorted(x)[n + 1 :])) == [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines))]
    assert [D.order_of_plane(24, size) for size in (0, 700 << 20, 1200 << 20, 1800 << 20)] == [5, 5, 7, 11]
    rng = np.random.default_rng(41)
    rows = [(n, [float(x) for x in rng.random(3)], "ab"[n % 2]) for n in range(1500)]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>, cls string")
    table, sizes = packed = D.blocks(D.keyed(df, "cls"), 25)
    number = table.count()
    give = lambda one, two: iter([pd.DataFrame({"sent": [len({r.no for r in one + two})]})])
    of = {r["no"]: r["k"] for r in table.select("no", "k").collect()}
    met = lambda c: pd.DataFrame({"one": [c.ids1[0]], "two": [c.ids2[0]], "n": [c.d.size]})
    for pairs, most in (("all", 6), ("within", 4)):
        assert D.meetings(table, give, "sent long", pairs).agg({"sent": "sum"}).first()[0] <= most * number
        cells = D.cells(D.keyed(df, "cls"), D.squared, met, "one long, two long, n long", pairs, packed=packed).collect()
        want = sum(of[a] == of[b] or pairs == "all" for a in of for b in of if a <= b)
        assert len(cells) == len({(r["one"], r["two"]) for r in cells}) == want


@pytest.mark.parametrize("size", [1, 3, 40])
def test_sums_where_blocks_are_few(spark, monkeypatch, size):
    """from one block to more blocks than groups, the pairs are those of brute force."""
    rng = np.random.default_rng(42)
    rows = [(n, [float(x) for x in rng.random(3)], int(n % size == 0)) for n in range(2 * size)]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>, cls int")
    packed = D.blocks(D.keyed(df, "cls"), 2)
    got = {(r["k1"], r["k2"]): (r["n"], r["s"]) for r in D.pair_sums(df, D.hellinger, packed=packed).collect()}
    want = {p: d for p, d in _brute_pairs(rows, D.hellinger).items() if len(d)}
    assert {p: r[0] for p, r in got.items()} == {p: len(d) for p, d in want.items()}
    assert [got[p][1] for p in want] == pytest.approx([sum(d) for d in want.values()])


def test_vectors_are_packed_once_for_neighbours(spark, monkeypatch):
    """the radius goes to the blocks that are there; vectors are not joined and packed again."""
    rng = np.random.default_rng(43)
    df = _cloud(spark, rng.normal(0, 1, (60, 3)), rng.normal(0.5, 1, (50, 3)))
    calls, blocks = [], D.blocks
    for module in (D, W):
        monkeypatch.setattr(module, "blocks", lambda *a, **b: calls.append(a) or blocks(*a, **b))
    got = W.neighbour_information(df, 3, projected=False).first()[0]
    assert len(calls) == 1
    assert got == pytest.approx(W.neighbour_information(df, 3, projected=False, search="balls").first()[0])


def test_report_projects_and_packs_once(spark, monkeypatch):
    """both measures of an observable read the same blocks, and are those of each alone."""
    rng = np.random.default_rng(44)
    df = _cloud(spark, rng.random((60, 3)), rng.random((50, 3)) + 0.2)
    calls, blocks, project = [], D.blocks, W.project
    for module in (D, W):
        monkeypatch.setattr(module, "blocks", lambda *a, **b: calls.append("blocks") or blocks(*a, **b))
    monkeypatch.setattr(W, "project", lambda *a, **b: calls.append("project") or project(*a, **b))
    got = {r["measure"]: r["value"] for r in W.report({"x": df}, k=3).collect()}
    assert calls == ["project", "blocks"]
    assert got["energy"] == pytest.approx(W.projected_energy(df).first()["distinguishability"])
    assert got["information"] == pytest.approx(W.neighbour_information(df, 3).first()["information"])


def test_samples_of_two_observables_are_joined_once(spark):
    """what several passes read is no join any more."""
    df = spark.createDataFrame([(n, "ab"[n % 2], 0.0, [float(n), 1.0]) for n in range(9)], "sample_id long, cls string, scalar double, vec array<double>")
    both = W.total(df, df)
    assert "Join" not in both._jdf.queryExecution().optimizedPlan().toString()
    assert {r["sample_id"]: r["vec"] for r in both.collect()} == {n: [float(n), 1.0] * 2 for n in range(9)}


def test_draws_are_made_one_by_one_from_all_pairs(spark, monkeypatch):
    """the distance of each draw is that of its own two places, and all pairs of blocks are drawn from, not a bounded number."""
    monkeypatch.setattr(R, "DRAWN", 300)  # several tasks for a meeting
    a, b = np.arange(160.0)[:, None], 1000 + np.arange(120.0)[:, None]
    v = D.keyed(_cloud(spark, a, b), "cls")
    packed = D.blocks(v, 5)
    table = packed[0].cache()
    ids = {k: np.concatenate([np.frombuffer(r.ids, dtype=np.int64) for r in table.filter(F.col("k") == k).orderBy("start").collect()]) for k in "ab"}
    value = {"a": ids["a"].astype(float), "b": ids["b"] - 9000.0}  # of each place
    block = {k: np.concatenate([[r.no] * r.n for r in table.filter(F.col("k") == k).orderBy("start").collect()]) for k in "ab"}
    metric = lambda x, y: x * 10_000 + y.T
    got = {(r.kind, r.draw): r.d for r in R.drawn_pairs(v, metric, 9000, 3, packed=(table, packed[1])).collect()}
    assert len(got) == 3 * 9000
    for no, kind in enumerate(R.KINDS):
        i, j = (R.below(np.arange(9000), len(ids[c]), 3, no, side) for side, c in enumerate(kind))
        assert np.array_equal([got[kind, n] for n in range(9000)], value[kind[0]][i] * 10_000 + value[kind[1]][j])
        cells = set(zip(block[kind[0]][i], block[kind[1]][j]))
        assert len(cells) > 0.95 * len(set(block[kind[0]])) * len(set(block[kind[1]]))


@pytest.mark.parametrize("search", ["cells", "balls"])
def test_neighbours_do_not_depend_on_products(spark, small_balls, search):
    """only pairs that a lower bound lets through are measured, each by itself, so far clusters far from 0 and ranges of sizes lose no neighbour."""
    rng = np.random.default_rng(45)
    centres = 1e5 + 1e4 * rng.normal(0, 1, (6, 4))
    a, b = (np.concatenate([centres[rng.integers(0, 6, n)] + 1e-3 * rng.normal(0, 1, (n, 4)), 1e9 * rng.normal(0, 1, (10, 4))]) for n in (150, 110))
    a[:5] = b[:4] = a[0]
    v = D.keyed(_cloud(spark, a, b), "cls")
    table, n = packed = D.blocks(v, 25)
    at = {}
    for r in table.collect():
        at |= {int(s): r.start + k + (n["a"] if r.k == "b" else 0) for k, s in enumerate(np.frombuffer(r.ids, dtype=np.int64))}
    x, ids = np.concatenate([a, b]), [*range(len(a)), *range(10_000, 10_000 + len(b))]
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    d = np.where(d == 0, 1e-12 * (np.array([at[s] for s in ids]) + 1)[None, :], d)
    np.fill_diagonal(d, np.inf)
    side = np.arange(len(x)) < len(a)
    want = {s: int((row <= np.sort(row[side == own])[4] + 1e-14).sum()) for s, row, own in zip(ids, d, side)}
    m = W.neighbour_counts(N.balls(v, packed), 5) if search == "balls" else W._counts_by_cells(v, packed, 5)
    assert {r.sample_id: r.m for r in m.collect()} == want


def test_few_pairs_are_measured(monkeypatch):
    """neighbours of blocks that nothing rules out, from one measured pair in twenty; those of brute force."""
    rng = np.random.default_rng(46)
    x = rng.normal(0, 1, (2000, 16))
    rows = [types.SimpleNamespace(no=k, n=250, start=250 * k, ids=np.arange(250 * k, 250 * (k + 1)).tobytes(), data=x[250 * k : 250 * (k + 1)].tobytes()) for k in range(8)]
    near = {r.no: N.Near(r, 0, 5) for r in rows}
    measured, one_by_one = [], N.one_by_one
    monkeypatch.setattr(N, "one_by_one", lambda *a: measured.append(len(a[2])) or one_by_one(*a))
    for p, q, i, j, d in W._screened(near, ((r, s) for r in rows for s in rows if r.no <= s.no), 5):
        p.found(i, d, q.ids[j])
    every = np.stack([((x - row) ** 2).sum(axis=1) for row in x])
    np.fill_diagonal(every, np.inf)
    assert np.array_equal(np.concatenate([p.best for p in near.values()]), np.sort(every, axis=1)[:, :5])
    assert np.array_equal(np.concatenate([p.who for p in near.values()]), np.argsort(every, axis=1)[:, :5])
    assert sum(measured) < 0.05 * every.size


def test_resamples_read_no_whole_cells(spark, monkeypatch):
    """neither neighbours nor weights of resamples come from a matrix of all distances."""
    rng = np.random.default_rng(47)
    df = _cloud(spark, rng.normal(0, 1, (60, 3)), rng.normal(0.5, 1, (50, 3)))
    metrics, cells = [], W.cells
    monkeypatch.setattr(W, "cells", lambda *a, **b: metrics.append(a[1]) or cells(*a, **b))
    assert W.weighted_information(df, 8).count() == 8 and len(metrics) >= 2 and set(metrics) == {None}


def test_sums_of_hellinger_distances_by_tiles(spark, monkeypatch):
    """sums without a matrix of distances of two blocks, over tiles of any size, are those of brute force."""
    rng = np.random.default_rng(48)
    rows = [(n, [float(x) for x in rng.random(5)], int(n % 3)) for n in range(130)]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>, cls int")
    want = {p: d for p, d in _brute_pairs(rows, D.hellinger).items() if len(d)}
    for tile in (1, 7, 128):
        monkeypatch.setattr(D, "TILE", tile)
        metrics, cells = [], D.cells
        monkeypatch.setattr(D, "cells", lambda *a, **b: metrics.append(a[1]) or cells(*a, **b))
        got = {(r["k1"], r["k2"]): r for r in D.pair_sums(df, D.hellinger).collect()}
        monkeypatch.setattr(D, "cells", cells)
        assert metrics == [None] and set(got) == set(want)
        for p, d in want.items():
            d, r = np.array(d), got[p]
            assert r["n"] == len(d) and (r["s"], r["ss"], r["top"]) == pytest.approx((d.sum(), (d * d).sum(), d.max()))
    # a task takes blocks in tiles itself
    blocks = [types.SimpleNamespace(no=k, n=20, k="a", data=rng.random((20, 5)).tobytes()) for k in range(3)]
    x = np.concatenate([np.frombuffer(r.data).reshape(20, 5) for r in blocks])
    monkeypatch.setattr(D, "TILE", 7)
    (f,) = D._hellinger_sums(blocks, ((r, s) for r in blocks for s in blocks if r.no <= s.no))
    d = D.hellinger(x, x)[np.triu_indices(60, 1)]
    assert f["n"][0] == len(d) and (f["s"][0], f["ss"][0], f["top"][0]) == pytest.approx((d.sum(), (d * d).sum(), d.max()))


def test_total_variations_in_spans(monkeypatch):
    """what single precision lets through is measured to the bits of the whole matrix; few pairs are, and none within the spans is missed."""
    rng = np.random.default_rng(49)
    for scale in (1.0, 1e12, 1e-30, 1e40):
        x = scale * np.concatenate([rng.dirichlet(np.ones(40), size=300), np.round(rng.random((41, 40)), 1)])
        rows = [types.SimpleNamespace(no=k, n=len(p), k=k % 2, data=np.ascontiguousarray(p).tobytes()) for k, p in enumerate(np.split(x, [100, 200, 300, 340]))]
        d = {(r.no, s.no): D.total_variation(*(np.frombuffer(t.data).reshape(t.n, -1) for t in (r, s))) for r in rows for s in rows if r.no <= s.no}
        flat = {p: m[np.triu_indices(len(m), 1)] if p[0] == p[1] else m.ravel() for p, m in d.items()}
        digits = np.unique(D._bits(np.quantile(np.concatenate(list(flat.values())), [0.0, 0.16, 0.84, 0.95, 1.0])) >> 38)
        spans = D._spans([*digits, digits[1] + 1], 38)
        assert len(spans) <= 5 and all(((D._bits(f) >> 38 == digits[:, None]) | (D._bits(f) >> 38 == digits[1] + 1)).any(axis=0).tolist() == D._in_spans(f, spans).tolist() for f in flat.values())
        measured, of = [], D._variations_of
        monkeypatch.setattr(D, "_variations_of", lambda p, q: measured.append(len(p)) or of(p, q))
        got = pd.concat(D._variations_in(rows, ((r, s) for r in rows for s in rows if r.no <= s.no), {(a, b): spans for a in (0, 1) for b in (0, 1)}))
        monkeypatch.setattr(D, "_variations_of", of)
        every = np.concatenate(list(flat.values()))
        want = np.unique(D._bits(every[D._in_spans(every, spans)]), return_counts=True)
        found = got.groupby("bits")["n"].sum()
        assert np.array_equal(found.index.to_numpy(), want[0]) and np.array_equal(found.to_numpy(), want[1])
        assert sum(measured) < 0.05 * len(every)
