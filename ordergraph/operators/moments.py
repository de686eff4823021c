"""Moments of histograms, and their convergence over sample size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import ranked_values, sums_before

NAN = float("nan")


def moments(hist: DataFrame, by: list[str] = ["sample_id"]) -> DataFrame:  # noqa: B006
    """mean, std, skewness, kurtosis (excess) of the weights over bins.

    No weight: NaN.  No variance: std 0, the others NaN.
    """
    w, x = F.col("weight"), F.col("bin")
    first = hist.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx")).withColumn("mean", F.when(F.col("w") != 0, F.col("wx") / F.col("w")).otherwise(NAN))
    d = x - F.col("mean")
    rest = hist.join(first.select(*by, "w", "mean"), by).groupBy(*by, "mean", "w").agg(*[F.sum(w * F.pow(d, F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)])
    m = {k: F.col(f"m{k}") / F.col("w") for k in (2, 3, 4)}
    some, spread = F.col("w") != 0, (F.col("w") != 0) & (F.col("m2") != 0)
    return rest.select(
        *by,
        "mean",
        F.when(some, F.sqrt(m[2])).otherwise(NAN).alias("std"),
        F.when(spread, m[3] / F.pow(m[2], F.lit(1.5))).otherwise(NAN).alias("skewness"),
        F.when(spread, m[4] / (m[2] * m[2]) - 3).otherwise(NAN).alias("kurtosis"),
    )


def aggregate_moment(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    x = F.col(value)
    q = lambda p: F.percentile(x, F.lit(p))
    out = values.filter(~F.isnan(x) & x.isNotNull()).groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), q(0.16).alias("q16"), q(0.5).alias("q50"), q(0.84).alias("q84"))
    return out.withColumn("std_lo", F.col("q50") - F.col("q16")).withColumn("std_hi", F.col("q84") - F.col("q50"))


def decay_exponent(table: DataFrame, size: str, moment: str, by: list[str]) -> DataFrame:
    ends = table.groupBy(*by).agg(F.min_by(moment, size).alias("m0"), F.max_by(moment, size).alias("m1"), F.min(size).alias("n0"), F.max(size).alias("n1"))
    return ends.select(*by, (F.log(F.col("m1") / F.col("m0")) / F.log(F.col("n1") / F.col("n0"))).alias("exponent"))


def dominance(values: DataFrame, value: str, cls: str = "cls") -> DataFrame:
    """P(a > b) over all pairs of the two classes, from ranks: no pair is made.

    Values are counted first, so that ties and frequent values are one row.
    """
    n = values.groupBy(F.col(value).alias("x")).agg(F.sum(F.when(F.col(cls) == "a", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(cls) == "b", 1).otherwise(0)).alias("b"))
    return sums_before(n, "x", "b", "below").agg((F.sum(F.col("a") * F.col("below")) / (F.sum("a") * F.sum("b"))).alias("p_greater"))


def running(dense: DataFrame, batch: int, order: str = "sample_id") -> DataFrame:
    """bin, n, mean, std (population) over the first n = batch, 2 batch, .. samples.

    Samples are ranked once; count, mean and centred squares of batches leave
    the tasks, and only they are merged in order.
    """
    placed = ranked_values(dense, order, "place")
    each = placed.groupBy("bin", F.ceil(F.col("place") / batch).alias("nth")).agg(F.count("*").alias("c"), F.avg("weight").alias("m"), F.var_pop("weight").alias("v"))
    w = Window.partitionBy("bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    # batches' moments add up about the first batch's mean, so no square of a large mean is taken away
    d = F.col("m") - F.first("m").over(w)
    each = each.select("bin", "c", "nth", (F.col("m") - d).alias("about"), (F.col("c") * d).alias("s"), (F.col("c") * (F.col("v") + d * d)).alias("ss"))
    run = each.select("bin", "c", "about", (F.col("nth") * batch).alias("n"), F.sum("s").over(w).alias("s"), F.sum("ss").over(w).alias("ss")).filter(F.col("c") == batch)
    mean = F.col("s") / F.col("n")
    return run.select("bin", "n", (F.col("about") + mean).alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def bin_average(dense: DataFrame, k: int) -> DataFrame:
    """Means of k consecutive bins; the last may be of fewer."""
    return dense.groupBy("sample_id", F.ceil(F.col("bin") / k).alias("bin")).agg(F.avg("weight").alias("weight"))


def std_change(run: DataFrame) -> DataFrame:
    before = F.lag("std").over(Window.partitionBy("bin").orderBy("n"))
    return run.select("bin", "n", F.abs(F.col("std") - F.coalesce(before, F.lit(0.0))).alias("change"))


def with_bin_mean(run: DataFrame, value: str) -> DataFrame:
    """The series of bins and, as bin -1, that of their mean."""
    return run.select("bin", "n", value).unionByName(run.groupBy("n").agg(F.avg(value).alias(value)).select(F.lit(-1).alias("bin"), "n", value))


def fit_decay(series: DataFrame, value: str, key: str = "bin", rounds: int = 4, steps: int = 40, free: str | None = None) -> DataFrame:
    """value(n) = limit + amplitude n^-alpha for each series.

    limit: the series' last value, or with ``free`` a value within half of it
    ("half") or within its size, or 1 if it is 0 ("whole").  The amplitude is in
    closed form for each alpha and limit, so a grid that is narrowed each round
    fits all series in one job.  Fewer than three finite points: null.
    """
    if free not in (None, "half", "whole"):
        raise ValueError(f"not a range of limits: {free}")
    ok = series.filter(F.col(value).isNotNull() & ~F.isnan(value))
    last = ok.groupBy(key).agg(F.max_by(value, "n").alias("last"), F.count("*").alias("points"))
    data = ok.join(last, key)
    about = {None: F.lit(0.0), "half": F.abs("last") / 2, "whole": F.when(F.col("last") == 0, 1.0).otherwise(F.abs("last"))}[free]
    box = last.select(key, F.lit(1e-3).alias("lo"), F.lit(5.0).alias("hi"), (F.col("last") - about).alias("l_lo"), (F.col("last") + about).alias("l_hi"))
    cuts = 0 if free is None else steps // 2
    ends = ["lo", "hi", "l_lo", "l_hi"]
    best = None
    for _ in range(rounds):
        grid = box.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cuts))).alias("c"))
        grid = grid.withColumn("alpha", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / steps).withColumn("limit", F.col("l_lo") + (F.col("l_hi") - F.col("l_lo")) * F.col("c") / max(cuts, 1))
        p, d = F.pow(F.col("n").cast("double"), -F.col("alpha")), F.abs(F.col(value) - F.col("limit"))
        sums = data.join(grid, key).groupBy(key, *ends, "alpha", "limit", "points").agg(F.sum(p * d).alias("pd"), F.sum(p * p).alias("pp"), F.sum(d * d).alias("dd"))
        sums = sums.withColumn("amplitude", F.col("pd") / F.col("pp")).withColumn("loss", F.col("dd") - F.col("pd") * F.col("amplitude"))
        best = sums.groupBy(key).agg(F.min_by(F.struct("alpha", "amplitude", "limit", "points", "loss", *ends), F.struct("loss", "alpha", "limit")).alias("b")).select(key, "b.*")
        step, l_step = (F.col("hi") - F.col("lo")) / steps, (F.col("l_hi") - F.col("l_lo")) / max(cuts, 1)
        box = best.select(key, F.greatest(F.col("alpha") - step, F.lit(1e-3)).alias("lo"), F.least(F.col("alpha") + step, F.lit(5.0)).alias("hi"), (F.col("limit") - l_step).alias("l_lo"), (F.col("limit") + l_step).alias("l_hi"))
    few = F.col("points") < 3
    return best.select(key, *[F.when(~few, F.col(c)).alias(c) for c in ("alpha", "amplitude", "limit", "loss")])


def decay_diagnostics(series: DataFrame, fitted: DataFrame, value: str, first: int, key: str = "bin") -> DataFrame:
    """key, points, zero_share, end_amplitude (of the fit at the last n, over the last value), rmse (over the values' mean size), from n = ``first`` on, zeros left out."""
    late = series.filter(F.col("n") >= first)
    zero = late.groupBy(key).agg(F.avg(F.when(F.col(value) == 0, 1.0).otherwise(0.0)).alias("zero_share"))
    x = late.filter(F.col(value) != 0).join(fitted, key)
    term = F.col("amplitude") * F.pow(F.col("n").cast("double"), -F.col("alpha"))
    miss = F.abs(F.col(value) - F.col("limit")) - term
    out = x.groupBy(key).agg(F.count("*").alias("points"), F.max_by(F.abs(term) / F.abs(value), "n").alias("end_amplitude"), (F.sqrt(F.avg(miss * miss)) / F.avg(F.abs(value))).alias("rmse"))
    return zero.join(out, key, "left")


def user_moment(hist: DataFrame, moment, by: list[str], value: str = "value") -> DataFrame:
    """Average of a moment by group: a name that ``moments`` gives, or a function from histograms to (sample_id, value)."""
    m = moment(hist) if callable(moment) else moments(hist).select("sample_id", F.col(moment).alias(value))
    return aggregate_moment(m.join(hist.select("sample_id", *by).distinct(), "sample_id"), value, by)


def large_n_abundance(grid: DataFrame) -> DataFrame:
    """Interval abundances of n sprinkled points in the plane for large n; m = 1 gives n.

    psi at whole numbers is a running sum of reciprocals by n.
    """
    w = Window.partitionBy("n").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("m") - 2
    psi = -0.5772156649015329 + F.sum(F.when(F.col("m") > 2, 1.0 / (F.col("m") - 2)).otherwise(0.0)).over(w)
    n = F.col("n")
    return grid.withColumn("abundance", F.when(F.col("m") == 1, n.cast("double")).otherwise(1 + 2 * k - 2 * n + (1 + k + n) * (F.log(n.cast("double")) - psi)))


def exact_abundance(grid: DataFrame, nodes: int = 4000) -> DataFrame:
    """n^2 times the integral of w(v) e^(-nv) (nv)^k / k!, k = m - 2, by midpoints in v = t^3."""
    t = (F.col("id") + 0.5) / nodes
    v = grid.sparkSession.range(nodes).select((t * t * t).alias("v"), (3 * t * t / nodes).alias("dv"))
    v = v.withColumn("w", -(1 + F.col("v")) * F.log("v") - 2 * (1 - F.col("v")))
    n, k = F.col("n").cast("double"), (F.col("m") - 2).cast("double")
    fact = grid.filter("m >= 2").select("n", "m", F.aggregate(F.sequence(F.lit(0), F.col("m") - 2), F.lit(0.0), lambda a, i: a + F.when(i > 0, F.log(i.cast("double"))).otherwise(0.0)).alias("log_fact"))
    term = F.exp(-n * F.col("v") + k * F.log(n * F.col("v")) - F.col("log_fact")) * F.col("w") * F.col("dv")
    return fact.join(F.broadcast(v)).groupBy("n", "m").agg((F.first(n) * F.first(n) * F.sum(term)).alias("abundance"))


def deviations(pairs: DataFrame, key: str = "series") -> DataFrame:
    """series, end, j, d: candidate / reference - 1 from bin 2 (j = 0) to the last
    before the reference's first zero, which must be 2 or more.

    ``pairs``: series, bin, reference, candidate.
    """
    end = pairs.groupBy(key).agg((F.coalesce(F.min(F.when(F.col("reference") == 0, F.col("bin"))), F.max("bin") + 1) - 1).alias("end"))
    end = end.withColumn("end", F.when(F.col("end") < 2, F.raise_error(F.lit("nothing before the first zero"))).otherwise(F.col("end")))
    return pairs.join(end, key).filter("bin >= 2 and bin <= end").select(key, "end", (F.col("bin") - 2).alias("j"), (F.col("candidate") / F.col("reference") - 1).alias("d"))


def spectrum(pairs: DataFrame, key: str = "series") -> DataFrame:
    """series, k, frequency, amplitude of the deviations."""
    x = deviations(pairs, key)
    size = F.col("end") - 1
    waves = x.withColumn("k", F.explode(F.sequence(F.lit(0), (size - 1).cast("int"))))
    angle = -2 * math.pi * F.col("j") * F.col("k") / size
    s = waves.groupBy(key, "k", "end").agg(F.sum(F.col("d") * F.cos(angle)).alias("re"), F.sum(F.col("d") * F.sin(angle)).alias("im"))
    return s.select(key, "k", (F.col("k") / size).alias("frequency"), F.hypot("re", "im").alias("amplitude"))


def peaks(spec: DataFrame, min_frequency: float, key: str = "series") -> DataFrame:
    """Strongest frequency up to the half, its period and amplitude 2|S|/N."""
    inside = _inside(spec, min_frequency, key)
    best = inside.groupBy(key, "last").agg(F.max_by("frequency", F.struct("amplitude", -F.col("k"))).alias("frequency"), F.max("amplitude").alias("amplitude"))
    return best.select(key, "frequency", (1 / F.col("frequency")).alias("period"), (2 * F.col("amplitude") / (F.col("last") + 1)).alias("peak_amplitude"))


def _inside(spec: DataFrame, min_frequency: float, key: str) -> DataFrame:
    n = spec.groupBy(key).agg(F.max("k").alias("last"))
    return spec.join(n, key).filter((F.col("k") <= F.floor((F.col("last") + 1) / 2)) & (F.col("frequency") >= min_frequency) & (F.col("amplitude") > 1e-12))


def peak_list(spec: DataFrame, min_frequency: float = 1 / 13, most: int = 5, apart: float = 0.02, key: str = "series") -> DataFrame:
    """series, nth, period, peak_amplitude: the strongest frequencies whose periods differ by more than ``apart``.

    A series has as many frequencies as bins; they are folded in descending amplitude.
    """
    size = F.col("last") + 1
    rows = _inside(spec, min_frequency, key).groupBy(key, "last").agg(F.sort_array(F.collect_list(F.struct("amplitude", (-F.col("k")).alias("k"), (1 / F.col("frequency")).alias("period"))), asc=False).alias("a"))
    new = lambda kept, x: (F.size(kept) < most) & ~F.exists(kept, lambda y: F.abs(y["period"] - x["period"]) <= apart)
    kept = F.aggregate("a", F.slice("a", F.lit(1), F.lit(0)), lambda kept, x: F.when(new(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return rows.select(key, size.alias("size"), F.posexplode(kept).alias("p", "x")).select(key, (F.col("p") + 1).alias("nth"), "x.period", (2 * F.col("x.amplitude") / F.col("size")).alias("peak_amplitude"))


def deviation_report(pairs: DataFrame, longest_period: float = 13.0, key: str = "series") -> DataFrame:
    """From abundances to peaks: truncation, deviation, spectrum, list of periods."""
    return peak_list(spectrum(pairs, key), 1 / longest_period, key=key)
