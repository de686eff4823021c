"""Queries over histograms, vectors and records of samples."""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordergraph.operators import binning as B
from ordergraph.operators import distances as D
from ordergraph.operators import fitting as T
from ordergraph.operators import graphs as G
from ordergraph.operators import histograms as H
from ordergraph.operators import moments as M
from ordergraph.operators import twosample as W
from ordergraph.sources import ensembles as S
from ordergraph.streaming import moments as R

from .graph_queries import longs, rounded

QUERIES, SQL = {}, {}
HIST = """WITH hist AS (SELECT l_suppkey AS sample_id, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS cls, (l_suppkey % 10)::DOUBLE AS scalar, l_linenumber::INT AS bin, count(*)::DOUBLE AS weight
  FROM lineitem GROUP BY 1, 2, 3, 4),
support AS (SELECT CASE WHEN min(bin) = 0 THEN 0 ELSE 1 END AS lo, max(bin) AS hi FROM hist),
dense AS (SELECT s.sample_id, b::INT AS bin, coalesce(weight, 0) AS weight FROM (SELECT sample_id, unnest(range(lo, hi + 1)) AS b FROM (SELECT DISTINCT sample_id FROM hist), support) s
  LEFT JOIN hist h ON h.sample_id = s.sample_id AND h.bin = s.b)
"""
VEC = """WITH vec AS (SELECT vec_id AS sample_id, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS cls, label::DOUBLE AS scalar, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS vec FROM embeddings WHERE embedding IS NOT NULL),
unit AS (SELECT sample_id, cls, scalar, list_transform(vec, lambda x: x / list_sum(vec)) AS vec FROM vec)
"""


def query(sql: str | None = None, prefix: str = HIST):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = prefix + sql
        return f

    return add


def units(spark, sf):
    return S.vectors(spark, sf).withColumn("vec", D.unit(F.col("vec")))


def path(sf, name):
    return f"{sf}/{name}.parquet"


@query("SELECT 1 AS dataset, o_orderkey, o_totalprice FROM orders UNION ALL SELECT 2, o_orderkey, o_totalprice FROM orders", "")
def s1_scan(spark, sf):
    return S.scan_stats(spark, [path(sf, "orders")] * 2, ["o_orderkey", "o_totalprice"], order="o_orderkey")


@query("SELECT l_suppkey AS sample_id, count(*) FILTER (l_linenumber = 1)::DOUBLE AS bin_1, count(*) FILTER (l_linenumber = 99)::DOUBLE AS bin_99 FROM lineitem GROUP BY 1", "")
def s2_fields_with_bins(spark, sf):
    m = S.histograms(spark, sf).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "weight"))).alias("hist"))
    bin_of = lambda b: F.coalesce(F.try_element_at("hist", F.lit(b)), F.lit(0.0))
    return m.select("sample_id", bin_of(1).alias("bin_1"), bin_of(99).alias("bin_99"))


@query("SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS scalar FROM orders", "")
def s3_fields_with_scalar(spark, sf):
    o = S.table(spark, sf, "orders")
    return o.select("o_orderkey", "o_totalprice", S.numeric(o, "o_custkey").alias("scalar"))


@query("SELECT o_custkey::DOUBLE AS field FROM orders", "")
def s4_one_field(spark, sf):
    """One field of the records, as numbers."""
    o = S.table(spark, sf, "orders")
    return o.select(S.numeric(o, "o_custkey").alias("field"))


@query("SELECT sample_id, bin, weight, scalar FROM hist")
def s5_histograms_with_scalar(spark, sf):
    m = S.histograms(spark, sf).groupBy("sample_id", "scalar").agg(F.map_from_entries(F.collect_list(F.struct("bin", "weight"))).alias("hist"))
    return m.select("sample_id", "scalar", F.explode("hist").alias("bin", "weight"))


@query("SELECT dataset, o_orderkey FROM (SELECT 1 AS dataset, o_orderkey FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderstatus = 'F')", "")
def s7_filter_by_dataset(spark, sf):
    return S.scan_stats(spark, [path(sf, "orders")] * 2, ["o_orderkey"], [lambda d: F.col("o_totalprice") > 200000, lambda d: F.col("o_orderstatus") == "F"], order="o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i % 2 = 0", "")
def s8_thinning_by_count(spark, sf):
    return S.thin(S.table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", 2).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE (i - 1) % 4 = 0", "")
def s8_thinning_by_share(spark, sf):
    return S.thin(S.table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", 0.25).select("o_custkey", "o_orderkey")


@query("SELECT sample_id, cls, scalar, bin, round(weight / sum(weight) OVER (PARTITION BY sample_id), 6) AS weight FROM hist")
def h1_normalize(spark, sf):
    return rounded(H.normalize(S.histograms(spark, sf)), "weight")


@query("SELECT sample_id, cls, scalar, bin, round(weight / max(weight) OVER (PARTITION BY sample_id), 6) AS weight FROM hist")
def h1_normalize_max(spark, sf):
    return rounded(H.normalize(S.histograms(spark, sf), "max"), "weight")


@query("SELECT sample_id, cls, scalar, bin, round(weight * scalar / sum(weight) OVER (PARTITION BY sample_id), 6) AS weight FROM hist")
def h2_size_normalize(spark, sf):
    return rounded(H.normalize(S.histograms(spark, sf), size="scalar"), "weight")


@query("SELECT sample_id, bin, weight FROM dense")
def h4_densify(spark, sf):
    return H.densify(S.histograms(spark, sf))


@query("SELECT sample_id, cls, pos, x FROM (SELECT sample_id, cls, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM (SELECT sample_id, cls, list_concat(vec, [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]) AS v FROM vec))", VEC)
def h5_pad(spark, sf):
    v = S.vectors(spark, sf)
    one = v.select(F.lit(-1).cast("long").alias("sample_id"), F.lit("a").alias("cls"), F.lit(0.0).alias("scalar"), F.array_repeat(F.lit(0.0), 67).alias("vec")).limit(1)
    out = H.pad(v.unionByName(one)).filter("sample_id >= 0")
    return out.select("sample_id", "cls", F.posexplode("vec").alias("p", "x")).select("sample_id", "cls", (F.col("p") + 1).cast("long").alias("pos"), "x")


@query("SELECT sample_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM vec", VEC)
def h6_trim(spark, sf):
    v = S.vectors(spark, sf).withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), 5)))
    return H.trim(v).select("sample_id", F.posexplode("vec").alias("p", "x")).select("sample_id", "x", (F.col("p") + 1).cast("long").alias("pos"))


@query("SELECT sample_id, cls, bin, lo + (least(floor((scalar - lo) / ((hi - lo) / 4)), 3) + 0.5) * (hi - lo) / 4 AS scalar, round(weight / sum(weight) OVER (PARTITION BY sample_id), 6) AS weight FROM hist, (SELECT min(scalar) AS lo, max(scalar) AS hi FROM hist)")
def h3_rekeyed(spark, sf):
    return rounded(H.rekeyed(S.histograms(spark, sf), "scalar", 4), "weight")


@query("SELECT kind, o_orderkey, (i - 1) // 4 + 1 AS id FROM (SELECT o_orderstatus AS kind, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus IN ('F', 'O')) WHERE (i - 1) % 4 = 0", "")
def h17_long_frame(spark, sf):
    o = S.table(spark, sf, "orders")
    return H.long_frame({k: o.filter(F.col("o_orderstatus") == k).select("o_orderkey") for k in ("F", "O")}, "o_orderkey", 0.25)


@query("SELECT sample_id, pos, round(x, 6) AS x FROM (SELECT sample_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM (SELECT sample_id, list_concat(vec, vec) AS v FROM unit))", VEC)
def h7_concatenate(spark, sf):
    u = units(spark, sf)
    return H.concatenate(u, u).select("sample_id", F.posexplode("vec").alias("p", "x")).select("sample_id", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("SELECT scalar, bin, sum(weight) AS weight FROM hist GROUP BY 1, 2")
def h8_join_histograms(spark, sf):
    return H.join_histograms(S.histograms(spark, sf), ["scalar"])


@query("SELECT sample_id, bin, sum(weight) AS weight, min(scalar) AS scalar FROM hist GROUP BY 1, 2")
def h9_join_histograms_scalar(spark, sf):
    return H.join_histograms(S.histograms(spark, sf), ["sample_id"], "scalar")


@query("SELECT bin, round(avg(weight), 6) AS mean, round(stddev_pop(weight), 6) AS std FROM dense GROUP BY 1")
def h10_average_histogram(spark, sf):
    return rounded(H.average(S.histograms(spark, sf)), "mean", "std")


@query(", n AS (SELECT scalar, count(DISTINCT sample_id) AS n FROM hist GROUP BY 1) SELECT h.scalar, bin, round(sum(weight) / n, 6) AS mean, round(sqrt(greatest(sum(weight * weight) / n - (sum(weight) / n) ** 2, 0)), 6) AS std FROM hist h JOIN n USING (scalar) GROUP BY 1, 2, n")
def h11_average_histogram_by_scalar(spark, sf):
    return rounded(H.average(S.histograms(spark, sf), ["scalar"]), "mean", "std")


@query("SELECT pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM vec) GROUP BY 1", VEC)
def h12_average_vectors(spark, sf):
    return rounded(longs(H.average_vectors(S.vectors(spark, sf)), "pos"), "mean", "std")


@query("SELECT scalar, pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT scalar, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM vec) GROUP BY 1, 2", VEC)
def h13_average_vectors_by_scalar(spark, sf):
    return rounded(longs(H.average_vectors(S.vectors(spark, sf), ["scalar"]), "pos"), "mean", "std")


@query(", s AS (SELECT sample_id, bin, CASE WHEN bin = 7 THEN 0 ELSE weight END AS std FROM hist) SELECT sample_id, bin, round(CASE WHEN std = 0 THEN 1e-3 * min(CASE WHEN std > 0 THEN std END) OVER (PARTITION BY sample_id) ELSE std END, 9) AS std FROM s")
def h14_replace_zeros(spark, sf):
    s = S.histograms(spark, sf).select("sample_id", "bin", F.when(F.col("bin") == 7, 0.0).otherwise(F.col("weight")).alias("std"))
    return rounded(H.replace_zeros(s, "std", "sample_id"), "std", digits=9)


@query("SELECT bin, round(n / sum(n) OVER (), 6) AS share FROM (SELECT least(floor((value - 0) / 10.0) + 1, 10)::BIGINT AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 100 GROUP BY 1)", "")
def h15_empirical_histogram(spark, sf):
    return rounded(H.empirical(S.table(spark, sf, "events"), "value", 0.0, 100.0, 10), "share").select(F.col("bin").cast("long").alias("bin"), "share")


@query("SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS p_retailprice FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)", "")
def h16_scale_columns(spark, sf):
    return rounded(H.scale_columns(S.table(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]), "p_retailprice")


@query("SELECT sample_id, i AS x, round(i / 63.0::DOUBLE, 6) AS share, vec[i + 1] AS y FROM vec, range(1, 64) t(i)", VEC)
def h18_spectrum_series(spark, sf):
    out = H.spectrum_series(S.vectors(spark, sf), "vec", "sample_id")
    return rounded(longs(out, "x"), "share")


@query("SELECT scalar, pos, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM (SELECT scalar, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM (SELECT scalar, list_sort(vec) AS v FROM vec)) GROUP BY 1, 2", VEC)
def h19_sorted_positions(spark, sf):
    v = S.vectors(spark, sf).withColumn("vec", F.array_sort("vec"))
    return rounded(longs(H.average_vectors(v, ["scalar"], sample_std=True), "pos"), "mean", "std")


RUN = """, run AS (SELECT bin, count(*) OVER w AS n, sum(weight) OVER w AS s, sum(weight * weight) OVER w AS ss FROM dense WINDOW w AS (PARTITION BY bin ORDER BY sample_id ROWS UNBOUNDED PRECEDING)),
evo AS (SELECT bin, n, s / n AS mean, sqrt(greatest(ss / n - (s / n) ** 2, 0)) AS std FROM run WHERE n % 5 = 0)
"""


@query(RUN + "SELECT bin, n, round(abs(std - coalesce(lag(std) OVER (PARTITION BY bin ORDER BY n), 0)), 6) AS change FROM evo")
def h20_std_change(spark, sf):
    return rounded(M.std_change(M.running(H.densify(S.histograms(spark, sf)), 5)), "change")


@query(RUN + "SELECT bin, n, round(mean, 6) AS mean, round(std, 6) AS std FROM evo")
def c1_running_moments(spark, sf):
    return rounded(M.running(H.densify(S.histograms(spark, sf)), 5), "mean", "std")


@query("SELECT sample_id, ceil(bin / 2.0)::BIGINT AS bin, round(avg(weight), 6) AS weight FROM dense GROUP BY 1, 2")
def c3_bin_average(spark, sf):
    return rounded(longs(M.bin_average(H.densify(S.histograms(spark, sf)), 2), "bin"), "weight")


@query(RUN + "SELECT -1 AS bin, n, round(avg(std), 6) AS std FROM evo GROUP BY n UNION ALL SELECT bin, n, round(std, 6) FROM evo")
def c6_bins_and_mean(spark, sf):
    return rounded(M.with_bin_mean(_runs(spark, sf), "std"), "std")


def _runs(spark, sf):
    return M.running(H.densify(S.histograms(spark, sf)), 5)


def decay_sql(series: str, value: str, free: str | None = None, rounds: int = 4, steps: int = 40) -> str:
    """CTEs up to ``fitted`` (bin, alpha, amplitude, lim, loss): the best of a grid of alphas and limits that is narrowed each round."""
    about = {None: "0", "half": "abs(last) / 2", "whole": "CASE WHEN last = 0 THEN 1 ELSE abs(last) END"}[free]
    cuts = 0 if free is None else steps // 2
    out = f"""data AS (SELECT bin, n, {value}::DOUBLE AS y FROM {series} WHERE {value} IS NOT NULL),
box0 AS (SELECT bin, points, 1e-3::DOUBLE AS lo, 5.0::DOUBLE AS hi, last - {about} AS l_lo, last + {about} AS l_hi FROM (SELECT bin, count(*) AS points, arg_max(y, n) AS last FROM data GROUP BY 1))"""
    for r in range(rounds):
        out += f""",
grid{r} AS (SELECT *, lo + (hi - lo) * k / {steps} AS alpha, l_lo + (l_hi - l_lo) * c / {max(cuts, 1)} AS lim FROM box{r}, range({steps + 1}) t(k), range({cuts + 1}) u(c)),
sums{r} AS (SELECT bin, points, lo, hi, l_lo, l_hi, alpha, lim, sum(pow(n, -alpha) * abs(y - lim)) / sum(pow(n, -alpha) * pow(n, -alpha)) AS amplitude, sum(abs(y - lim) ** 2) - sum(pow(n, -alpha) * abs(y - lim)) * amplitude AS loss
  FROM grid{r} JOIN data USING (bin) GROUP BY ALL),
best{r} AS (SELECT * FROM sums{r} QUALIFY row_number() OVER (PARTITION BY bin ORDER BY loss, alpha, lim) = 1),
box{r + 1} AS (SELECT bin, points, greatest(alpha - (hi - lo) / {steps}, 1e-3) AS lo, least(alpha + (hi - lo) / {steps}, 5.0) AS hi, lim - (l_hi - l_lo) / {max(cuts, 1)} AS l_lo, lim + (l_hi - l_lo) / {max(cuts, 1)} AS l_hi FROM best{r})"""
    named = ", ".join(f"CASE WHEN points >= 3 THEN {c} END AS {c}" for c in ("alpha", "amplitude", "lim", "loss"))
    return out + f""",
fitted AS (SELECT bin, {named} FROM best{rounds - 1})
"""


FITTED = 'SELECT bin, round(alpha, 5) AS alpha, round(amplitude, 5) AS amplitude, round(lim, 5) AS "limit", round(loss, 5) AS loss FROM fitted'
FIT = ("alpha", "amplitude", "limit", "loss")
HISTORY = HIST + RUN + ", "


@query(decay_sql("evo", "std") + FITTED, HISTORY)
def c4_fit_std_decay(spark, sf):
    return rounded(M.fit_decay(_runs(spark, sf), "std"), *FIT, digits=5)


@query(decay_sql("evo", "std", "half") + FITTED, HISTORY)
def c4_fit_std_decay_free(spark, sf):
    return rounded(M.fit_decay(_runs(spark, sf), "std", free="half"), *FIT, digits=5)


@query(decay_sql("evo", "mean") + FITTED, HISTORY)
def c5_fit_mean_decay(spark, sf):
    return rounded(M.fit_decay(_runs(spark, sf), "mean"), *FIT, digits=5)


@query(decay_sql("evo", "mean", "whole") + FITTED, HISTORY)
def c5_fit_mean_decay_free(spark, sf):
    return rounded(M.fit_decay(_runs(spark, sf), "mean", free="whole"), *FIT, digits=5)


@query(decay_sql("(SELECT bin, n, std FROM evo UNION ALL SELECT -1, n, avg(std) FROM evo GROUP BY n)", "std") + FITTED, HISTORY)
def c6_fit_with_mean(spark, sf):
    return rounded(M.fit_decay(M.with_bin_mean(_runs(spark, sf), "std"), "std"), *FIT, digits=5)


@query(decay_sql("evo", "std") + """SELECT bin, zero_share, points, round(end_amplitude, 5) AS end_amplitude, round(rmse, 5) AS rmse FROM
(SELECT bin, round(avg(CASE WHEN std = 0 THEN 1.0 ELSE 0.0 END), 5) AS zero_share FROM evo WHERE n >= 20 GROUP BY 1) LEFT JOIN
(SELECT bin, count(*) AS points, arg_max(abs(term) / abs(std), n) AS end_amplitude, sqrt(avg((abs(std - lim) - term) ** 2)) / avg(abs(std)) AS rmse
  FROM (SELECT bin, n, std, lim, amplitude * pow(n, -alpha) AS term FROM evo JOIN fitted USING (bin) WHERE n >= 20 AND std <> 0) GROUP BY 1) USING (bin)""", HISTORY)
def c7_fit_diagnostics(spark, sf):
    run = _runs(spark, sf)
    return rounded(M.decay_diagnostics(run, M.fit_decay(run, "std"), "std", 20), "zero_share", "end_amplitude", "rmse", digits=5)


BINS = "(SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi FROM {t})"


@query("SELECT o_orderkey, round(lo + (least(floor((o_totalprice - lo) / ((hi - lo) / 8)), 7) + 0.5) * (hi - lo) / 8, 6) AS bin_key FROM orders, " + BINS.format(x="o_totalprice", t="orders"), "")
def b1_equal_width(spark, sf):
    return rounded(B.equal_width(S.table(spark, sf, "orders"), "o_totalprice", 8).select("o_orderkey", "bin_key"), "bin_key")


@query("SELECT c_custkey, c_nationkey::DOUBLE AS bin_key FROM customer", "")
def b2_exact_labels(spark, sf):
    return B.equal_width(S.table(spark, sf, "customer"), "c_nationkey", None).select("c_custkey", "bin_key")


@query("SELECT o_orderkey, round(10 ** (lo + (least(floor((log10(o_totalprice) - lo) / ((hi - lo) / 6)), 5) + 0.5) * (hi - lo) / 6), 4) AS bin_key FROM orders, " + BINS.format(x="log10(o_totalprice)", t="orders"), "")
def b3_logarithmic(spark, sf):
    return rounded(B.equal_width(S.table(spark, sf, "orders"), "o_totalprice", 6, log=True).select("o_orderkey", "bin_key"), "bin_key", digits=4)


@query("SELECT round_even(value, 0) AS key, count(*) AS n FROM events GROUP BY 1", "")
def b4_rounded_key(spark, sf):
    return S.table(spark, sf, "events").groupBy(F.rint("value").alias("key")).agg(F.count("*").alias("n"))


@query("SELECT event_type, round(avg(value), 6) AS value_mean, round(coalesce(stddev_samp(value), 0), 6) AS value_std FROM events GROUP BY 1", "")
def b5_mean_std_by_key(spark, sf):
    return rounded(B.mean_std(S.table(spark, sf, "events"), ["value"], ["event_type"]), "value_mean", "value_std")


@query("SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events", "")
def b6_mean_std(spark, sf):
    return rounded(S.table(spark, sf, "events").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")), "mean", "std")


@query("SELECT a.k AS k1, b.k AS k2 FROM (SELECT DISTINCT scalar AS k FROM hist) a JOIN (SELECT DISTINCT scalar AS k FROM hist) b ON a.k < b.k")
def b7_key_pairs(spark, sf):
    return B.key_pairs(S.histograms(spark, sf), "scalar")


@query("SELECT scalar AS bin_key, pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT scalar, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM vec) GROUP BY 1, 2", VEC)
def b8_average_by_bin(spark, sf):
    return rounded(longs(H.average_vectors(B.equal_width(S.vectors(spark, sf), "scalar", 10), ["bin_key"]), "pos"), "mean", "std")


@query()
def b8_averages_by_bin(spark, sf):
    """The averages, not rounded."""
    return H.average_vectors(B.equal_width(S.vectors(spark, sf), "scalar", 10), ["bin_key"])


@query("SELECT cls, bin, round(sum(p) / n, 6) AS mean FROM (SELECT cls, bin, weight / sum(weight) OVER (PARTITION BY sample_id) AS p FROM hist) JOIN (SELECT cls, count(DISTINCT sample_id) AS n FROM hist GROUP BY 1) USING (cls) GROUP BY 1, 2, n")
def b9_average_by_series(spark, sf):
    return rounded(H.average(H.normalize(S.histograms(spark, sf)), ["cls"]).drop("std"), "mean")


MOM = """, a AS (SELECT sample_id, sum(weight) AS w, sum(weight * bin) / sum(weight) AS mean FROM hist GROUP BY 1),
m AS (SELECT sample_id, mean, sum(weight * (bin - mean) ** 2) / w AS m2, sum(weight * (bin - mean) ** 3) / w AS m3, sum(weight * (bin - mean) ** 4) / w AS m4 FROM hist JOIN a USING (sample_id) GROUP BY 1, 2, w)
"""


@query(MOM + "SELECT sample_id, round(mean, 6) AS mean, round(sqrt(m2), 6) AS std, CASE WHEN m2 > 0 THEN round(m3 / m2 ** 1.5, 6) END AS skewness, CASE WHEN m2 > 0 THEN round(m4 / (m2 * m2) - 3, 6) END AS kurtosis FROM m")
def m1_moments(spark, sf):
    """What is undefined is null."""
    m = M.moments(S.histograms(spark, sf))
    return rounded(m.select("sample_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("mean", "std", "skewness", "kurtosis")]), "mean", "std", "skewness", "kurtosis")


@query()
def m1_moments_of_all(spark, sf):
    """The moments, not rounded."""
    m = M.moments(S.histograms(spark, sf))
    return m.select("sample_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("mean", "std", "skewness", "kurtosis")])


@query(MOM + "SELECT cls, round(avg(mean), 6) AS mean, round(stddev_pop(mean), 6) AS std FROM (SELECT *, CASE WHEN sample_id % 2 = 0 THEN 'a' ELSE 'b' END AS cls FROM m) GROUP BY 1")
def u3_user_moment(spark, sf):
    """A user's function from histograms to one value a sample."""
    own = lambda h: h.groupBy("sample_id").agg((F.sum(F.col("weight") * F.col("bin")) / F.sum("weight")).alias("value"))
    return rounded(M.user_moment(S.histograms(spark, sf), own, ["cls"]).select("cls", "mean", "std"), "mean", "std")


@query(MOM + "SELECT cls, round(avg(mean), 6) AS mean, round(stddev_pop(mean), 6) AS std, round(quantile_cont(mean, 0.16), 6) AS q16, round(quantile_cont(mean, 0.5), 6) AS q50, round(quantile_cont(mean, 0.84), 6) AS q84, round(quantile_cont(mean, 0.5) - quantile_cont(mean, 0.16), 6) AS std_lo, round(quantile_cont(mean, 0.84) - quantile_cont(mean, 0.5), 6) AS std_hi FROM (SELECT *, CASE WHEN sample_id % 2 = 0 THEN 'a' ELSE 'b' END AS cls FROM m) GROUP BY 1")
def m5_aggregate_moment(spark, sf):
    out = M.aggregate_moment(M.moments(S.histograms(spark, sf), ["sample_id", "cls"]), "mean", ["cls"])
    return rounded(out, *out.columns[1:])


@query("SELECT cls, round(ln(arg_max(m, n) / arg_min(m, n)) / ln(max(n) / min(n)), 6) AS exponent FROM (SELECT cls, scalar + 1 AS n, sum(weight * bin) / sum(weight) AS m FROM hist GROUP BY 1, 2) GROUP BY 1")
def m6_decay_exponent(spark, sf):
    m = M.moments(S.histograms(spark, sf), ["cls", "scalar"]).withColumn("n", F.col("scalar") + 1)
    return rounded(M.decay_exponent(m, "n", "mean", ["cls"]), "exponent")


@query("SELECT round(avg(CASE WHEN a.value > b.value THEN 1.0 ELSE 0.0 END), 6) AS p_greater FROM (SELECT value FROM events WHERE user_id % 2 = 0) a, (SELECT value FROM events WHERE user_id % 2 = 1) b", "")
def m7_dominance(spark, sf):
    e = S.table(spark, sf, "events").select("value", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("cls"))
    return rounded(M.dominance(e, "value"), "p_greater")


def _series(spark, sf):
    """Mean event value by type over the hour."""
    e = S.table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), (F.hour("ts") + 1).cast("double").alias("x"))
    return e.agg(F.avg("value").alias("y"), F.stddev_samp("value").alias("std"))


def _line(x, p):
    return p["a"] + p["b"] * x


LINE = {"a": (-1000.0, 1000.0), "b": (-50.0, 50.0)}
SERIES = "(SELECT event_type AS series, (hour(ts) + 1)::DOUBLE AS x, avg(value) AS y, stddev_samp(value) AS std, count(value) AS c FROM events GROUP BY 1, 2)"


@query(f"SELECT series, round(regr_intercept(y, x), 5) AS a, round(regr_slope(y, x), 5) AS b FROM {SERIES} GROUP BY 1", "")
def f1_fit_curve(spark, sf):
    return rounded(T.fit_curve(_series(spark, sf), _line, LINE).select("series", "a", "b"), "a", "b", digits=5)


@query(f"SELECT series, round(sqrt(avg(((y - a - b * x) / y) ** 2)), 5) AS score FROM {SERIES} JOIN (SELECT series, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM {SERIES} GROUP BY 1) USING (series) GROUP BY 1", "")
def f2_relative_score(spark, sf):
    s = _series(spark, sf)
    return rounded(T.score(T.residuals(s, T.fit_curve(s, _line, LINE), _line, ["a", "b"]), 2), "score", digits=5)


@query(f"SELECT series, round(regr_syy(y, x) / s / s / (count(*) - 2) * (1 - corr(y, x) ** 2), 5) AS score FROM {SERIES}, (SELECT 2.0::DOUBLE AS s) GROUP BY 1, s", "")
def f2_chi_score(spark, sf):
    """Reduced chi squared with a deviation of 2 at every point."""
    s = _series(spark, sf).withColumn("std", F.lit(2.0))
    rest = T.residuals(s, T.fit_curve(s, _line, LINE, stds=True), _line, ["a", "b"]).withColumn("std", F.lit(2.0))
    return rounded(T.score(rest, 2, std="std"), "score", digits=5)


@query(f"SELECT series, x, y, round(y - a - b * x, 5) AS residual, round((y - a - b * x) / y, 5) AS relative FROM {SERIES} JOIN (SELECT series, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM {SERIES} GROUP BY 1) USING (series)".replace("x, y, round", "x, round(y, 6) AS y, round"), "")
def f3_fit_residuals(spark, sf):
    s = _series(spark, sf)
    r = T.residuals(s, T.fit_curve(s, _line, LINE), _line, ["a", "b"])
    return rounded(rounded(r, "residual", "relative", digits=5), "y")


ERRORS = f"""SELECT series, round(b, 5) AS slope, round(a, 5) AS intercept, round(sqrt(v / sxx), 5) AS slope_err, round(sqrt(v * (1.0 / n + mx * mx / sxx)), 5) AS intercept_err FROM
(SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) AS v FROM {SERIES} GROUP BY 1)"""


@query(ERRORS, "")
def f4_line_fit(spark, sf):
    return rounded(T.line_fit(_series(spark, sf)), "slope", "intercept", "slope_err", "intercept_err", digits=5)


@query()
def f4_line_fit_errors(spark, sf):
    """The line and its errors, not rounded."""
    return T.line_fit(_series(spark, sf))


@query(ERRORS, "")
def f4_curve_errors(spark, sf):
    """The errors of any curve, here a line."""
    s = _series(spark, sf)
    e = T.errors(s, T.fit_curve(s, _line, LINE), _line, ["a", "b"])
    return rounded(e.select("series", F.col("b").alias("slope"), F.col("a").alias("intercept"), F.col("b_err").alias("slope_err"), F.col("a_err").alias("intercept_err")), "slope", "intercept", "slope_err", "intercept_err", digits=5)


@query()
def f5_bootstrap_errors(spark, sf):
    s = _series(spark, sf).withColumn("std", F.lit(2.0))
    return T.bootstrap_errors(s, T.fit_curve(s, _line, LINE, stds=True), _line, LINE, 50)


@query(f"SELECT series, x, round(CASE WHEN x < 3 THEN 1e-3 * min(CASE WHEN x >= 3 THEN std END) OVER (PARTITION BY series) ELSE std END, 9) AS std FROM {SERIES} WHERE c > 1", "")
def f6_std_floor(spark, sf):
    """Deviations of 0 in the first two hours are raised."""
    s = _series(spark, sf).filter("std is not null").withColumn("std", F.when(F.col("x") < 3, 0.0).otherwise(F.col("std")))
    return rounded(T.std_floor(s).select("series", "x", "std"), "std", digits=9)


@query(f"SELECT series, round(regr_intercept(y, x), 5) AS a, round(regr_slope(y, x), 5) AS b FROM {SERIES} WHERE x BETWEEN 3 AND 12 GROUP BY 1", "")
def f7_fit_window(spark, sf):
    return rounded(T.fit_curve(_series(spark, sf).filter("x between 3 and 12"), _line, LINE).select("series", "a", "b"), "a", "b", digits=5)


@query(f"""SELECT series, min(x) FILTER (n > 2 AND (syy - sxy * sxy / sxx) / 4 / (n - 2) > 1) AS last FROM (SELECT series, x, count(*) OVER w AS n, regr_syy(y, x) OVER w AS syy, regr_sxy(y, x) OVER w AS sxy, regr_sxx(y, x) OVER w AS sxx
  FROM {SERIES} WHERE x >= 2 WINDOW w AS (PARTITION BY series ORDER BY x ROWS UNBOUNDED PRECEDING)) GROUP BY 1""", "")
def f8_growing_window(spark, sf):
    windows = T.linear_windows(_series(spark, sf).withColumn("std", F.lit(2.0)), [lambda x: x], 2.0)
    return T.first_bad_window(windows, 2)


@query()
def f9_power_trend(spark, sf):
    return T.power_trend(_series(spark, sf))


HELL = "sqrt(greatest((list_sum(a.vec) + list_sum(b.vec) - 2 * list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: sqrt(z[1]) * sqrt(z[2])))) / 2, 0))"
TV = "0.5 * list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: abs(z[1] - z[2])))"


@query(f"SELECT a.sample_id AS id1, b.sample_id AS id2, round({HELL}, 6) AS d FROM unit a JOIN unit b ON a.sample_id < b.sample_id AND a.scalar = b.scalar", VEC)
def d3_pairwise_hellinger(spark, sf):
    return rounded(D.within(units(spark, sf), D.hellinger, "scalar").select("id1", "id2", "d"), "d")


@query(f"SELECT least(a.scalar, b.scalar) AS k1, greatest(a.scalar, b.scalar) AS k2, count(*) AS n, round(sum({TV}), 5) AS total FROM unit a JOIN unit b ON a.sample_id < b.sample_id GROUP BY 1, 2", VEC)
def d4_total_variation_sums(spark, sf):
    """Within and across classes."""
    return rounded(D.variation_sums(units(spark, sf), "scalar").select("k1", "k2", "n", F.col("s").alias("total")), "total", digits=5)


@query()
def d5_pooled_projection(spark, sf):
    return W.project(S.vectors(spark, sf)).select("sample_id", F.posexplode("vec").alias("axis", "x"))


ENERGY = """, m AS (SELECT a.{k} AS k1, b.{k} AS k2, avg({d}) AS m FROM {t} a, {t} b GROUP BY 1, 2)
SELECT x.k1, x.k2, round(2 * x.m - p.m - q.m, 6) AS energy, round((2 * x.m - p.m - q.m) / (2 * x.m), 6) AS distinguishability{more} FROM m x
JOIN m p ON p.k1 = x.k1 AND p.k2 = x.k1 JOIN m q ON q.k1 = x.k2 AND q.k2 = x.k2 WHERE x.k1 < x.k2"""


@query(ENERGY.format(k="cls", d=HELL, t="unit", more=""), VEC)
def d6_energy(spark, sf):
    return rounded(D.energy(units(spark, sf), D.hellinger), "energy", "distinguishability")


@query()
def d6_energy_projected(spark, sf):
    return W.projected_energy(S.vectors(spark, sf))


@query()
def d7_mc_energy(spark, sf):
    return W.mc_energy(units(spark, sf), D.hellinger, 20 * S.table(spark, sf, "embeddings").count())


BOTH = VEC + ", two AS (SELECT sample_id, cls, list_concat(vec, list_reverse(list_sort(vec))) AS vec FROM unit)\n"


def _total(spark, sf):
    """Two observables of each sample: its unit vector, and the same in descending order."""
    u = units(spark, sf)
    return W.total(u, u.withColumn("vec", F.sort_array("vec", asc=False)))


@query(ENERGY.format(k="cls", d=HELL, t="two", more=""), BOTH)
def d8_total_energy(spark, sf):
    return rounded(D.energy(_total(spark, sf), D.hellinger), "energy", "distinguishability")


@query()
def d9_neighbour_information(spark, sf):
    return W.neighbour_information(units(spark, sf))


@query()
def d9_neighbour_information_by_balls(spark, sf):
    """The same, without the shells that can hold no neighbour."""
    return W.neighbour_information(units(spark, sf), search="balls")


@query()
def d10_bootstrap_information(spark, sf):
    return W.bootstrap_information(units(spark, sf), 200)


@query()
def d11_information_of_principal_axes(spark, sf):
    return W.neighbour_information(W.principal(W.project(units(spark, sf)), "variance", share=0.9), projected=False)


@query("SELECT cls, least(count(*), 100) AS n FROM vec GROUP BY 1", VEC)
def d12_subsample(spark, sf):
    return W.subsample(S.vectors(spark, sf), 100).groupBy("cls").agg(F.count("*").alias("n"))


@query()
def d13_total_information(spark, sf):
    return W.neighbour_information(_total(spark, sf))


@query("""SELECT round(0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS distinguishability, round((1 + 0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0)))) / 2, 6) AS accuracy FROM
(SELECT s, count(*) / (SELECT count(*) FROM unit WHERE cls = 'a') AS p FROM (SELECT list_transform(vec, lambda x: round_even(x * 10, 0)::BIGINT) AS s FROM unit WHERE cls = 'a') GROUP BY 1) FULL JOIN
(SELECT s, count(*) / (SELECT count(*) FROM unit WHERE cls = 'b') AS q FROM (SELECT list_transform(vec, lambda x: round_even(x * 10, 0)::BIGINT) AS s FROM unit WHERE cls = 'b') GROUP BY 1) USING (s)""", VEC)
def d14_state_variation(spark, sf):
    return rounded(W.state_variation(S.vectors(spark, sf), 1), "distinguishability", "accuracy")


@query()
def d15_debiased_variation(spark, sf):
    return W.state_bias(S.vectors(spark, sf), 1)


@query("""SELECT round(0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS distinguishability, round((1 + 0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0)))) / 2, 6) AS accuracy FROM
(SELECT s, count(*) / (SELECT count(*) FROM two WHERE cls = 'a') AS p FROM (SELECT list_transform(vec, lambda x: round_even(x / list_sum(vec) * 10, 0)::BIGINT) AS s FROM two WHERE cls = 'a') GROUP BY 1) FULL JOIN
(SELECT s, count(*) / (SELECT count(*) FROM two WHERE cls = 'b') AS q FROM (SELECT list_transform(vec, lambda x: round_even(x / list_sum(vec) * 10, 0)::BIGINT) AS s FROM two WHERE cls = 'b') GROUP BY 1) USING (s)""", BOTH)
def d16_total_variation_of_both(spark, sf):
    return rounded(W.state_variation(_total(spark, sf), 1), "distinguishability", "accuracy")


@query()
def d17_permutation_test(spark, sf):
    return W.permutation_test(units(spark, sf), D.hellinger)


@query()
def d18_mc_permutation_test(spark, sf):
    return W.mc_permutation_test(units(spark, sf), D.hellinger, 10 * S.table(spark, sf, "embeddings").count())


@query()
def d19_mahalanobis_gap(spark, sf):
    return W.mahalanobis_gap(units(spark, sf), symmetric=True)


@query(f"SELECT a.cls AS k, round(quantile_cont({HELL}, 0.95), 6) AS threshold FROM unit a JOIN unit b ON a.sample_id < b.sample_id AND a.cls = b.cls GROUP BY 1", VEC)
def d20_within_percentile(spark, sf):
    return rounded(D.within_percentile(units(spark, sf), D.hellinger, 0.95), "threshold")


EXCEED = """, x AS (SELECT a.{k} AS k1, b.{k} AS k2, {d} AS d FROM unit a JOIN unit b ON a.{k} < b.{k}),
t AS (SELECT a.{k} AS k, quantile_cont({d}, 0.95) AS threshold FROM unit a JOIN unit b ON a.sample_id < b.sample_id AND a.{k} = b.{k} GROUP BY 1)
SELECT k1, k2, round(avg(CASE WHEN d > threshold THEN 1.0 ELSE 0.0 END), 6) AS distinguishability, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std,
round(avg(d) - quantile_cont(d, 0.16), 6) AS low, round(quantile_cont(d, 0.84) - avg(d), 6) AS high FROM x JOIN t ON {on} {where} GROUP BY 1, 2"""
MEASURES = ("distinguishability", "mean", "std", "low", "high")


@query(EXCEED.format(k="cls", d=HELL, on="k1 = t.k", where=""), VEC)
def d21_exceedance(spark, sf):
    return rounded(D.exceedance(units(spark, sf), D.hellinger), *MEASURES)


@query(EXCEED.format(k="scalar", d=TV, on="k1 = t.k", where=""), VEC)
def d22_exceedance_by_scalar(spark, sf):
    return rounded(D.exceedance(units(spark, sf), D.total_variation, key="scalar"), *MEASURES)


@query(EXCEED.format(k="scalar", d=HELL, on="t.k = 0", where="WHERE k1 = 0 OR k2 = 0"), VEC)
def d22_exceedance_of_reference(spark, sf):
    return rounded(D.exceedance(units(spark, sf), D.hellinger, key="scalar", reference=0.0), *MEASURES)


@query(ENERGY.format(k="scalar", d=TV, t="unit", more=", round(abs(x.k1 - x.k2) / (x.k1 + x.k2 + 2), 6) AS rel_change"), VEC)
def d23_energy_by_scalar(spark, sf):
    e = D.energy(units(spark, sf), D.total_variation, "scalar").withColumn("rel_change", D.relative_change(F.col("k1") + 1, F.col("k2") + 1))
    return rounded(e, "energy", "distinguishability", "rel_change")


@query(ENERGY.format(k="scalar", d=HELL, t="unit", more="") + " AND x.k1 = 0", VEC)
def d23_energy_of_reference(spark, sf):
    return rounded(D.energy(units(spark, sf), D.hellinger, "scalar", reference=0.0), "energy", "distinguishability")


@query()
def d24_permutation_by_scalar(spark, sf):
    """Every class against class 0."""
    return W.permutation_tests(units(spark, sf), D.hellinger, 1000, "scalar", 0.0)


@query()
def d24_permutation_of_pairs(spark, sf):
    return W.permutation_tests(units(spark, sf), D.hellinger, 200, "scalar")


@query()
def d25_mahalanobis_by_scalar(spark, sf):
    return W.by_reference(units(spark, sf), lambda v: W.mahalanobis_gap(v, 200).drop("D"), "scalar", 0.0)


@query()
def d26_series_against_reference(spark, sf):
    """Five measures of logarithmic bins of the label against the first: information, total variation, energy, permutations, Mahalanobis."""
    v = B.equal_width(units(spark, sf).withColumn("size", F.col("scalar") + 1), "size", 3, log=True)
    first = v.agg(F.min("bin_key")).first()[0]

    def measures(x):
        parts = [
            W.neighbour_information(x).select("information"),
            W.state_variation(x, 1).select(F.col("distinguishability").alias("total_variation"), "accuracy"),
            D.energy(x, D.hellinger).select(F.col("distinguishability").alias("energy")),
            W.permutation_test(x, D.hellinger).select(F.col("p").alias("permutation_p"), F.col("z_emp").alias("permutation_z")),
            W.mahalanobis_gap(x, 200).select(F.col("D").alias("mahalanobis"), "distinguishable"),
        ]
        return functools.reduce(lambda one, two: one.join(F.broadcast(two)), parts)  # one row each

    return W.by_reference(v, measures, "bin_key", first)


@query("SELECT o_orderkey, round(abs(o_totalprice - o_custkey - 1) / (o_totalprice + o_custkey + 1), 6) AS change FROM orders", "")
def d27_relative_change(spark, sf):
    return S.table(spark, sf, "orders").select("o_orderkey", F.round(D.relative_change(F.col("o_totalprice"), F.col("o_custkey") + 1), 6).alias("change"))


@query()
def d28_mc_pairwise(spark, sf):
    return W.mc_apply(units(spark, sf), D.hellinger, 10 * S.table(spark, sf, "embeddings").count(), kinds=("ab",)).select("draw", "d")


@query()
def d29_report(spark, sf):
    v = units(spark, sf)
    return W.report({"vector": v, "sorted": v.withColumn("vec", F.sort_array("vec", asc=False)), "total": _total(spark, sf)}, splits=100)


@query("SELECT sample_id, vec[2] AS second, vec[-1] AS last FROM vec", VEC)
def d30_selected_entries(spark, sf):
    return S.vectors(spark, sf).select("sample_id", F.element_at("vec", 2).alias("second"), F.element_at("vec", -1).alias("last"))


def _pairs(spark, sf):
    """Daily counts of each event type against those of all types."""
    e = S.table(spark, sf, "events").groupBy("event_type", F.dayofyear("ts").alias("bin")).agg(F.count("*").cast("double").alias("candidate"))
    reference = e.groupBy("bin").agg(F.avg("candidate").alias("reference"))
    nth = F.row_number().over(Window.partitionBy("event_type").orderBy("bin"))
    return e.join(reference, "bin").select(F.col("event_type").alias("series"), "candidate", "reference", nth.alias("bin"))


SPEC = """WITH e AS (SELECT event_type, dayofyear(ts) AS day, count(*)::DOUBLE AS c FROM events GROUP BY 1, 2),
p AS (SELECT event_type AS series, c, avg(c) OVER (PARTITION BY day) AS r, row_number() OVER (PARTITION BY event_type ORDER BY day) AS bin FROM e),
x AS (SELECT series, bin - 2 AS j, c / r - 1 AS d, max(bin) OVER (PARTITION BY series) - 1 AS n FROM p),
s AS (SELECT series, k, n, sum(d * cos(-2 * pi() * j * k / n)) AS re, sum(d * sin(-2 * pi() * j * k / n)) AS im FROM (SELECT *, unnest(range(0, n)) AS k FROM x WHERE j >= 0) GROUP BY 1, 2, 3)
"""


@query("SELECT series, k, round(k / n, 6) AS frequency, round(sqrt(re * re + im * im), 6) AS amplitude FROM s", SPEC)
def x2_deviation_spectrum(spark, sf):
    return rounded(longs(M.spectrum(_pairs(spark, sf)), "k"), "frequency", "amplitude")


@query("""WITH e AS (SELECT event_type, dayofyear(ts) AS day, count(*)::DOUBLE AS c FROM events GROUP BY 1, 2),
p AS (SELECT event_type AS series, c, avg(c) OVER (PARTITION BY day) AS r, row_number() OVER (PARTITION BY event_type ORDER BY day) AS bin FROM e)
SELECT series, bin - 2 AS j, 19 AS "end", round(c / r - 1, 6) AS d FROM p WHERE bin BETWEEN 2 AND 19""", "")
def x1_truncated_deviations(spark, sf):
    """The reference has its first zero in bin 20."""
    p = _pairs(spark, sf).withColumn("reference", F.when(F.col("bin") == 20, 0.0).otherwise(F.col("reference")))
    return rounded(longs(M.deviations(p), "j", "end"), "d")


PEAKS = """, q AS (SELECT series, k, n, n / k AS period, sqrt(re * re + im * im) AS a FROM s WHERE k <= n // 2 AND k / n >= 1.0::DOUBLE / 13 AND sqrt(re * re + im * im) > 1e-12),
kept AS (SELECT series, 1 AS nth, period, a, n, [period] AS periods FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY a DESC, k) AS r FROM q) WHERE r = 1 UNION ALL
  SELECT series, nth + 1, period, a, n, list_append(periods, period) FROM (SELECT q.*, nth, periods, row_number() OVER (PARTITION BY series ORDER BY q.a DESC, q.k) AS r FROM (SELECT series, nth, periods FROM kept WHERE nth < 5) JOIN q USING (series)
    WHERE len(list_filter(periods, lambda y: abs(y - q.period) <= 0.02)) = 0) WHERE r = 1)
"""
RECURSIVE = SPEC.replace("WITH", "WITH RECURSIVE", 1) + PEAKS
PEAK_LIST = "SELECT series, nth, round(period, 6) AS period, round(2 * a / n, 6) AS peak_amplitude FROM kept"


@query(PEAK_LIST, RECURSIVE)
def x3_peak_list(spark, sf):
    return rounded(M.peak_list(M.spectrum(_pairs(spark, sf))), "period", "peak_amplitude")


@query(PEAK_LIST, RECURSIVE)
def x4_deviation_report(spark, sf):
    return rounded(M.deviation_report(_pairs(spark, sf)), "period", "peak_amplitude")


@query("SELECT series, round(1 / period, 6) AS frequency, round(period, 6) AS period, round(2 * a / n, 6) AS peak_amplitude FROM kept WHERE nth = 1", RECURSIVE)
def x3_spectrum_peaks(spark, sf):
    return rounded(M.peaks(M.spectrum(_pairs(spark, sf)), 1 / 13), "frequency", "period", "peak_amplitude")


def _grid(spark, sf):
    """Sizes of the ensemble's graphs, with m up to 5."""
    n = S.graph_table(spark, sf).select(F.col("n").cast("int").alias("n")).distinct().filter("n >= 5")
    return n.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(5))))


@query(""", z AS (SELECT n, m, m - 2 AS k, -0.5772156649015329 + sum(CASE WHEN m > 2 THEN 1.0::DOUBLE / (m - 2) ELSE 0 END) OVER (PARTITION BY n ORDER BY m) AS psi FROM w)
SELECT n, m, round(CASE WHEN m = 1 THEN n::DOUBLE ELSE 1 + 2 * k - 2 * n + (1 + k + n) * (ln(n) - psi) END, 6) AS abundance FROM z""", "WITH w AS (SELECT DISTINCT n, m FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey), range(1, 6) t(m) WHERE n >= 5)")
def a1_large_n_abundance(spark, sf):
    return rounded(longs(M.large_n_abundance(_grid(spark, sf)), "n", "m"), "abundance")


@query("""SELECT n, m, round(n * n * sum(exp(-n * v + (m - 2) * ln(n * v) - lgamma(m - 1)) * (-(1 + v) * ln(v) - 2 * (1 - v)) * dv), 6) AS abundance
FROM w, (SELECT pow((i + 0.5::DOUBLE) / 4000, 3) AS v, 3 * pow((i + 0.5::DOUBLE) / 4000, 2) / 4000 AS dv FROM range(4000) t(i)) WHERE m >= 2 GROUP BY 1, 2""", "WITH w AS (SELECT DISTINCT n, m FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey), range(1, 6) t(m) WHERE n >= 5)")
def a2_exact_abundance(spark, sf):
    return rounded(longs(M.exact_abundance(_grid(spark, sf)), "n", "m"), "abundance")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM events GROUP BY 1", "")
def t1_streamed_moments(spark, sf):
    """All arriving files merged batch by batch into a table in the shared folder."""
    folder = f"{G.shared_folder(spark)}/moments-{uuid.uuid4().hex}"
    records = R.read_records(spark, sf, S.table(spark, sf, "events").schema, "events.parquet")
    R.keep_moments(records, "value", ["event_type"], folder).trigger(availableNow=True).start().awaitTermination()
    return rounded(R.kept_moments(spark, folder, ["event_type"]), "mean", "std")
