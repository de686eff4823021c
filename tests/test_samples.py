import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordergraph.operators import binning as B
from ordergraph.operators import distances as D
from ordergraph.operators import fitting as T
from ordergraph.operators import histograms as H
from ordergraph.operators import moments as M
from ordergraph.operators import ordered as O
from ordergraph.operators import twosample as W
from ordergraph.sources import ensembles as S
from ordergraph.streaming import moments as R


def hist(spark, rows):
    return spark.createDataFrame([(s, b, float(w)) for s, b, w in rows], "sample_id long, bin int, weight double")


def test_moments(spark):
    r = M.moments(hist(spark, [(1, 1, 1), (1, 3, 3)])).first()
    assert r["mean"] == 2.5 and r["std"] == pytest.approx(math.sqrt(0.75))
    assert r["skewness"] == pytest.approx(-1.1547005383792515) and r["kurtosis"] == pytest.approx(-2 / 3)
    r = M.moments(hist(spark, [(1, 2, 5)])).first()
    assert r["std"] == 0 and math.isnan(r["skewness"])
    assert math.isnan(M.moments(hist(spark, [(1, 2, 0)])).first()["mean"])


def test_running(spark):
    run = M.running(hist(spark, [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4)]), 1).orderBy("n").collect()
    assert [r["std"] for r in run] == pytest.approx([0, 0.5, math.sqrt(2 / 3), math.sqrt(1.25)])
    assert [r["mean"] for r in run] == [1, 1.5, 2, 2.5]


def test_decay_fit(spark):
    series = spark.createDataFrame([(1, n, 1 + 2 * n**-0.5) for n in range(1, 11)] + [(1, 10**9, 1.0)], "bin long, n long, std double")
    r = M.fit_decay(series, "std").first()
    assert r["alpha"] == pytest.approx(0.5, abs=1e-3) and r["amplitude"] == pytest.approx(2, abs=1e-3)


def test_normalize_and_densify(spark):
    h = hist(spark, [(1, 1, 1), (1, 3, 3), (2, 2, 5)])
    assert {(r.sample_id, r.bin): r.weight for r in H.normalize(h).collect()} == {(1, 1): 0.25, (1, 3): 0.75, (2, 2): 1}
    assert [r.vec for r in H.dense_arrays(h, ["sample_id"]).orderBy("sample_id").collect()] == [[1, 0, 3], [0, 5, 0]]
    with pytest.raises(ValueError):
        H.normalize(h, 0.0)


def test_trim(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 2.0])], "sample_id long, vec array<double>")
    assert [r.vec for r in H.trim(v).orderBy("sample_id").collect()] == [[1, 0], [0, 2]]


def test_bins(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "s double")
    assert [r.bin_key for r in B.equal_width(df, "s", 2).orderBy("s").collect()] == [1.5, 2.5, 2.5]
    assert [r.bin_key for r in B.equal_width(df, "s", 3).orderBy("s").collect()] == [1, 2, 3]


def test_distances_of_states_apart(spark):
    one, two = np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]])
    assert (D.hellinger(one, one)[0, 0], D.hellinger(one, two)[0, 0], D.total_variation(one, two)[0, 0]) == (0, 1, 1)
    v = spark.createDataFrame([(k, "a", [1.0, 0.0]) for k in range(4)] + [(k + 4, "b", [0.0, 1.0]) for k in range(4)], "sample_id long, cls string, vec array<double>")
    assert tuple(W.state_variation(v, 0).first()) == (1.0, 1.0)
    assert D.energy(v, D.hellinger).first()["distinguishability"] == 1.0
    assert W.permutation_test(v, D.hellinger, 200).first()["p"] < 0.2


def test_ranks_and_sums_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randrange(10_000), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x long, k long").repartition(7)
    got = {r.k: (r.place, r.within) for r in O.ranked_within(O.ranked(df, ["x", "k"], "place"), ["g"], ["x", "k"], "within").collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    want = {k: (i, sum(h == g and (y, m) <= (x, k) for h, y, m in rows)) for i, (g, x, k) in enumerate(order, 1)}
    assert got == want
    sums = O.sums_before(df.groupBy("x").agg(F.count("*").alias("n")), "x", "n", "below").collect()
    assert all(r.below == sum(y < r.x for _, y, _ in rows) for r in sums)


def test_curves_that_are_not_lines(spark):
    """Gauss-Newton reaches the optimum; errors, bootstrap, windows and trends agree with closed forms."""
    x = np.arange(1, 25, dtype=float)
    noise = np.random.default_rng(5).normal(size=24)
    rows = [("p", float(a), float(b)) for a, b in zip(x, 3 * x**0.5 + 0.1 * noise)] + [("q", float(a), float(b)) for a, b in zip(x, 0.5 * x**-1.5)]
    s = spark.createDataFrame(rows, "series string, x double, y double").withColumn("std", F.lit(0.1))
    model = lambda x, p: p["a"] * F.pow(x, p["b"])
    bounds = {"a": (0.0, 10.0), "b": (-3.0, 3.0)}
    fitted = T.fit_curve(s, model, bounds).cache()
    got = {r.series: r for r in fitted.collect()}
    assert (got["q"].a, got["q"].b) == pytest.approx((0.5, -1.5), abs=1e-6) and (got["p"].a, got["p"].b) == pytest.approx((3, 0.5), abs=0.1)
    j = np.stack([x ** got["p"].b, got["p"].a * x ** got["p"].b * np.log(x)], axis=1)
    r = 3 * x**0.5 + 0.1 * noise - got["p"].a * x ** got["p"].b
    assert np.abs(j.T @ r).max() < 1e-4  # the gradient is 0
    cov = np.linalg.inv(j.T @ j) * (r @ r) / 22
    e = {z.series: z for z in T.errors(s, fitted, model, ["a", "b"]).collect()}
    assert (e["p"].a_err, e["p"].b_err) == pytest.approx(np.sqrt(np.diag(cov)), rel=1e-3)
    boot = {z.series: z for z in T.bootstrap_errors(s, fitted, model, bounds, 60).collect()}
    assert boot["p"].a_err == pytest.approx(np.sqrt(np.linalg.inv(j.T @ j)[0, 0]) * 0.1, rel=0.5)
    band = T.power_trend(s).filter("series = 'p' and x = 9").first()
    assert band.trend == pytest.approx(got["p"].a * 9 ** got["p"].b, rel=1e-4) and band.band == pytest.approx(np.sqrt(j[8] @ cov @ j[8]), rel=1e-3)
    bent = s.filter("series = 'q'").withColumn("y", F.when(F.col("x") > 12, 9.0).otherwise(F.col("y")))
    assert T.growing_window(bent, model, bounds, 2.0).first()["last"] == 13.0


def test_sources_refuse_what_they_do_not_know(spark):
    graphs = spark.createDataFrame([(1, 3, "x", 0.5)], "graph_id long, n long, cls string, scalar double")
    with pytest.raises(ValueError):
        S.of_kind(graphs, "y", {"x": []})
    with pytest.raises(ValueError):
        S.observable("nothing")
    with pytest.raises(Exception, match="finer than the bins"):
        H.rekeyed(spark.createDataFrame([(1, 2.0, 1, 1.0)], "sample_id long, scalar double, bin int, weight double"), "scalar", 3).collect()


def test_dominance_equals_pairs(spark):
    rng = random.Random(3)
    rows = [(float(rng.randrange(9)), rng.choice("ab")) for _ in range(60)]
    a, b = [x for x, c in rows if c == "a"], [x for x, c in rows if c == "b"]
    want = sum(x > y for x in a for y in b) / len(a) / len(b)
    assert M.dominance(spark.createDataFrame(rows, "x double, cls string"), "x").first()[0] == pytest.approx(want)


def test_fit_recovers_line(spark):
    s = spark.createDataFrame([("s", float(x), 3.0 - 2.0 * x) for x in range(10)], "series string, x double, y double")
    model = lambda x, p: p["a"] + p["b"] * x
    r = T.fit_curve(s, model, {"a": (-10, 10), "b": (-10, 10)}, rounds=12).first()
    assert (r["a"], r["b"]) == (pytest.approx(3, abs=0.1), pytest.approx(-2, abs=0.05))


def test_abundances(spark):
    grid = spark.createDataFrame([(20, 2), (20, 3), (30, 2), (30, 5)], "n int, m int")
    got = {(r.n, r.m): r.abundance for r in M.exact_abundance(grid).collect()}
    assert got == pytest.approx({(20, 2): 36.03190670757, (20, 3): 19.604854646124, (30, 2): 64.330803443474, (30, 5): 19.93271024983}, rel=1e-6)


def test_same_spectrum_has_no_peak(spark):
    pairs = spark.createDataFrame([("s", b, 5.0, 5.0) for b in range(1, 20)], "series string, bin int, reference double, candidate double")
    s = M.spectrum(pairs)
    assert s.agg(F.max("amplitude")).first()[0] == 0 and M.peaks(s, 0.0).count() == 0


def test_whole_results_beside_those_of_the_sql(spark, tmp_path):
    """Averages by bin, errors of a line, moments of samples without variance."""
    import datetime

    from ordergraph import catalogue

    spark.createDataFrame([(k, k % 10, [float(k), 1.0]) for k in range(20)], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    ys = [1.0, 3.5, 4.0, 8.0]
    spark.createDataFrame([("e", datetime.datetime(2020, 1, 1, h), y) for h, y in enumerate(ys)], "event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    means = sorted((r["bin_key"], r["mean"]) for r in run("b8_averages_by_bin") if r["pos"] == 1)
    assert [m for _, m in means] == [k + 5.0 for k in range(10)]
    got = {r["sample_id"]: r for r in run("m1_moments_of_all")}
    assert (got[1]["mean"], got[1]["std"], got[1]["skewness"], got[1]["kurtosis"]) == (2, 0, None, None) and got[2]["std"] == 1
    (line,) = run("f4_line_fit_errors")
    rss = sum((y - line["intercept"] - line["slope"] * x) ** 2 for x, y in enumerate(ys, 1))
    assert line["slope_err"] == pytest.approx(math.sqrt(rss / 2 / 5)) and line["intercept_err"] == pytest.approx(math.sqrt(rss / 2 * 30 / 20))


def test_running_moments_of_a_large_mean(spark):
    rng = np.random.default_rng(8)
    x = 1e9 + rng.normal(size=4000)
    df = spark.createDataFrame([(k, 1, float(v)) for k, v in enumerate(x)], "sample_id long, bin int, weight double")
    got = M.running(df, 500).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(500, 4001, 500))
    for r in got:
        assert r["std"] == pytest.approx(x[: r["n"]].std(), rel=1e-6) and r["mean"] == pytest.approx(x[: r["n"]].mean(), abs=1e-5)


def test_windows_of_a_long_series_against_least_squares(spark):
    import time

    rng = np.random.default_rng(9)
    x = np.arange(1, 100_001) / 1000
    y = 5e6 + 3 * x - 0.2 * x**2 + rng.normal(size=len(x))
    frame = __import__("pandas").DataFrame({"series": "s", "x": x, "y": y, "std": 1.0})
    start = time.perf_counter()
    got = T.linear_windows(spark.createDataFrame(frame), [lambda x: x, lambda x: x * x], 1.0).toPandas().set_index("end")
    assert time.perf_counter() - start < 60 and len(got) == (x >= 1.0).sum()
    for end in (1.2, 1.5, 20.0, 100.0):
        mine = (x >= 1.0) & (x <= end)
        a = np.stack([np.ones(mine.sum()), x[mine], x[mine] ** 2], axis=1)
        rest = np.linalg.lstsq(a, y[mine], rcond=None)[0]
        assert got.loc[end, "points"] == mine.sum()
        assert got.loc[end, "chi_squared"] == pytest.approx(((y[mine] - a @ rest) ** 2).sum(), rel=1e-4)


def test_streamed_moments_survive_a_stop_between_files(spark, tmp_path):
    rng = np.random.default_rng(10)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, size=90), 1e8 + rng.normal(size=90))] + [(None, 5.0), (1, None)]
    schema, source, folder = spark.createDataFrame([], "bin int, value double").schema, str(tmp_path / "in"), str(tmp_path / "kept")

    def arrive(k):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        R.keep_moments(R.read_records(spark, source, schema), "value", ["bin"], folder).trigger(availableNow=True).start().awaitTermination()

    arrive(0)
    arrive(1)
    run()
    arrive(2)
    run()
    # the last batch is lost after its state was written, and runs again
    import os

    commits = sorted(os.listdir(f"{folder}/checkpoint/commits"), key=lambda n: (n.startswith("."), n))
    last = max(int(n) for n in commits if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{folder}/checkpoint/commits/{name}"):
            os.remove(f"{folder}/checkpoint/commits/{name}")
    arrive(3)
    run()
    got = {r["bin"]: r for r in R.kept_moments(spark, folder, ["bin"]).collect()}
    want = {}
    for b, v in rows:
        if v is not None:
            want.setdefault(b, []).append(v)
    assert set(got) == set(want)
    for b, v in want.items():
        assert got[b]["n"] == len(v) and got[b]["mean"] == pytest.approx(np.mean(v), abs=1e-6)
        assert got[b]["std"] == pytest.approx(np.std(v, ddof=1) if len(v) > 1 else 0.0, rel=1e-6)
    assert len(R._versions(spark, f"{folder}/state")) == 2


def test_datasets_are_published_whole(spark, tmp_path):
    path = str(tmp_path / "set")
    with pytest.raises(ValueError, match="no published version"):
        S.read_statistics(spark, path)
    one = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0), (3, None, 4.0)], "id long, kind string, x double")
    assert S.write_statistics(one, path, "kind", {"batchsize": 10}) == 1
    want = [(1, "a", 2.0, 10.0), (2, "b", 3.0, 10.0), (3, None, 4.0, 10.0)]
    read = lambda **k: sorted(map(tuple, S.read_statistics(spark, path, **k).select("id", "kind", "x", "batchsize").collect()))
    assert read() == want and S.miscounted(spark, path).collect() == []

    def broken(x):
        raise RuntimeError("killed")

    bad = F.udf(broken, "double")
    with pytest.raises(Exception, match="killed"):  # a write that stops half way
        S.write_statistics(one.withColumn("x", F.when(F.col("id") == 3, bad("x")).otherwise(F.col("x"))), path, "kind", {"batchsize": 20})
    one.limit(1).write.parquet(f"{path}/records-not-published")  # or before its manifest
    assert read() == want
    two = one.filter("id = 2").withColumn("x", F.lit(9.0))
    assert S.write_statistics(two, path, "kind", {"batchsize": 30, "seed": 4}) == 2
    assert read() == [(2, "b", 9.0, 30.0)] and read(version=1) == want
    assert S.write_statistics(one.limit(0), path, "kind", {}) == 3 and S.read_statistics(spark, path).count() == 0
    import glob
    import os

    (lost,) = glob.glob(f"{path}/{S.manifests(spark, path)[0]['folder']}/kind=a/*.parquet")
    os.remove(lost)
    assert [tuple(r) for r in S.miscounted(spark, path, 1).collect()] == [("a", 1, 0)]


def test_concatenation_of_unequal_samples_fails(spark):
    v = lambda *ids: spark.createDataFrame([(i, [float(i)]) for i in ids], "sample_id long, vec array<double>")
    assert sorted(map(tuple, H.concatenate(v(1, 2), v(2, 1)).collect())) == [(1, [1.0, 1.0]), (2, [2.0, 2.0])]
    for one, two in (((1, 2), (1,)), ((1,), (1, 2)), ((1, 1), (1, 1))):
        with pytest.raises(ValueError, match="not one vector"):
            H.concatenate(v(*one), v(*two))
