"""Curves fitted to many series at once.

Candidates in a box are scored for every series in one job; damped Gauss-Newton
steps from the best then go on to the optimum, with normal equations as sums.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graphs import cut_lineage
from .ordered import running_sums

Model = Callable[[Column, dict[str, Column]], Column]


def search(series: DataFrame, model: Model, bounds: dict[str, tuple[float, float]], key: str = "series", candidates: int = 200, stds: bool = False) -> DataFrame:
    """key, parameters: the best of candidates drawn in the box by a hash, so runs agree."""
    names = list(bounds)
    grid = series.select(key).distinct().withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(candidates))))
    for k, p in enumerate(names):
        u = F.pmod(F.xxhash64("cand", F.lit(k)), F.lit(2**32)) / float(2**32)
        u = F.when(F.col("cand") == 0, F.lit(0.5)).otherwise(u)
        grid = grid.withColumn(p, F.lit(float(bounds[p][0])) + u * float(bounds[p][1] - bounds[p][0]))
    d = F.col("y") - model(F.col("x"), {p: F.col(p) for p in names})
    d = d / F.col("std") if stds else d
    scored = series.join(grid, key).groupBy(key, "cand", *names).agg(F.sum(d * d).alias("loss")).filter("loss is not null and not isnan(loss)")
    return scored.groupBy(key).agg(F.min_by(F.struct(*names), F.struct("loss", "cand")).alias("b")).select(key, "b.*")


def normal_sums(series: DataFrame, at: DataFrame, model: Model, names: list[str], key: str, more: list[str], stds: bool) -> DataFrame:
    """key, parameters, points, loss, g (J'Wr) and h (J'WJ by rows), with J by forward differences of 1e-6 of a parameter."""
    p = {c: F.col(c) for c in names}
    weight = 1 / (F.col("std") * F.col("std")) if stds else F.lit(1.0)
    f = model(F.col("x"), p)
    step = {c: F.greatest(F.abs(c) * 1e-6, F.lit(1e-9)) for c in names}
    rows = series.join(at, key).withColumn("_r", F.col("y") - f).withColumn("_w", weight)
    rows = rows.withColumns({f"_j{k}": (model(F.col("x"), p | {c: F.col(c) + step[c]}) - f) / step[c] for k, c in enumerate(names)})
    r, w, j = F.col("_r"), F.col("_w"), [F.col(f"_j{k}") for k in range(len(names))]
    sums = rows.groupBy(key, *more, *names).agg(F.count("*").alias("points"), F.sum(w * r * r).alias("loss"), *[F.sum(w * a * r).alias(f"_g{k}") for k, a in enumerate(j)], *[F.sum(w * a * b).alias(f"_h{k}_{m}") for k, a in enumerate(j) for m, b in enumerate(j)])
    g, h = F.array(*[f"_g{k}" for k in range(len(names))]), F.array(*[f"_h{k}_{m}" for k in range(len(names)) for m in range(len(names))])
    return sums.select(key, *more, *names, "points", "loss", g.alias("g"), h.alias("h"))


def refine(series: DataFrame, start: DataFrame, model: Model, bounds: dict[str, tuple[float, float]], key: str = "series", rounds: int = 6, stds: bool = False) -> DataFrame:
    """key, parameters, points, loss, g, h at the optimum near ``start``.

    Each round sums the normal equations of every series at several damped
    steps from its best point, and keeps the best; so the loss never rises.
    """
    names = list(bounds)
    low, high = (np.array([float(bounds[c][e]) for c in names]) for e in (0, 1))

    @F.pandas_udf("array<array<double>>")
    def steps(p: pd.Series, g: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for p0, g0, h0 in zip(p, g, h):
            p0, g0, h0 = np.asarray(p0, float), np.asarray(g0, float), np.asarray(h0, float).reshape(len(names), -1)
            own = [p0]
            if np.isfinite(h0).all() and np.isfinite(g0).all():
                for damp in (0.0, 1e-2, 1.0, 1e2):
                    own.append(np.clip(p0 + np.linalg.lstsq(h0 + damp * np.diag(np.diag(h0)), g0, rcond=1e-15)[0], low, high))
            out.append([list(map(float, x)) for x in own])
        return pd.Series(out)

    best = normal_sums(series, start, model, names, key, [], stds)
    for _ in range(rounds):
        tried = best.select(key, F.posexplode(steps(F.array(*names), "g", "h")).alias("cand", "p")).select(key, "cand", *[F.col("p")[k].alias(c) for k, c in enumerate(names)])
        sums = normal_sums(series, tried, model, names, key, ["cand"], stds).filter("loss is not null and not isnan(loss)")
        best = cut_lineage(sums.groupBy(key).agg(F.min_by(F.struct(*names, "points", "loss", "g", "h"), F.struct("loss", "cand")).alias("b")).select(key, "b.*"))
    return best


def fit_curve(series: DataFrame, model: Model, bounds: dict[str, tuple[float, float]], key: str = "series", rounds: int = 6, candidates: int = 200, stds: bool = False) -> DataFrame:
    """key, parameters, loss: least squares (chi squared with column std) within bounds."""
    found = refine(series, search(series, model, bounds, key, candidates, stds), model, bounds, key, rounds, stds)
    return found.select(key, *bounds, "loss")


def errors(series: DataFrame, fitted: DataFrame, model: Model, names: list[str], key: str = "series", stds: bool = False) -> DataFrame:
    """key, parameters, their standard errors p_err and the covariance (by rows) of the linearised least squares."""
    sums = normal_sums(series, fitted.select(key, *names), model, names, key, [], stds)

    @F.pandas_udf("array<double>")
    def covariance(h: pd.Series, loss: pd.Series, points: pd.Series) -> pd.Series:
        scale = [s / (n - len(names)) if n > len(names) else 1.0 for s, n in zip(loss, points)]
        return pd.Series([list(map(float, (np.linalg.pinv(np.asarray(x, float).reshape(len(names), -1)) * s).ravel())) for x, s in zip(h, scale)])

    out = sums.select(key, *names, covariance("h", "loss", "points").alias("cov"))
    return out.select(key, *names, *[F.sqrt(F.abs(F.col("cov")[k * (len(names) + 1)])).alias(f"{c}_err") for k, c in enumerate(names)], "cov")


def bootstrap_errors(series: DataFrame, fitted: DataFrame, model: Model, bounds: dict[str, tuple[float, float]], draws: int = 200, key: str = "series", seed: int = 1) -> DataFrame:
    """key and the deviation of each parameter over refits of y with normal noise of its std."""
    if draws < 2:
        raise ValueError("at least two draws are needed")
    u = lambda k: (F.pmod(F.xxhash64(key, "x", "boot", F.lit(seed), F.lit(k)), F.lit(2**32)) + 0.5) / float(2**32)
    noise = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    again = series.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("y", F.col("y") + F.col("std") * noise)
    again = cut_lineage(again.withColumn("own", F.struct(key, "boot")).select("own", "x", "y", "std"))
    start = again.select("own").distinct().withColumn(key, F.col(f"own.{key}")).join(fitted.select(key, *bounds), key).select("own", *bounds)
    fits = refine(again, start, model, bounds, "own", 3, True)
    return fits.groupBy(F.col(f"own.{key}").alias(key)).agg(*[F.stddev_samp(c).alias(f"{c}_err") for c in bounds])


def growing_window(series: DataFrame, model: Model, bounds: dict[str, tuple[float, float]], first: float, key: str = "series") -> DataFrame:
    """key, last: the first end of a window from ``first`` on whose fit has a reduced chi squared above 1 (null if none)."""
    inside = series.filter(F.col("x") >= first)
    ends = inside.select(key, F.col("x").alias("end"))
    windows = cut_lineage(inside.join(ends, key).filter("x <= end").withColumn("own", F.struct(key, "end")).select("own", "x", "y", "std"))
    found = refine(windows, search(windows, model, bounds, "own", 50, True), model, bounds, "own", 3, True)
    free = F.col("points") - len(bounds)
    return found.groupBy(F.col(f"own.{key}").alias(key)).agg(F.min(F.when((free > 0) & (F.col("loss") / free > 1), F.col("own.end"))).alias("last"))


def linear_windows(series: DataFrame, terms: list[Callable[[Column], Column]], first: float, key: str = "series") -> DataFrame:
    """key, end, points, chi_squared: the weighted least squares of y by a constant and ``terms`` of x over the window from ``first`` to each end.

    Normal equations are running sums in the order of x: no window copies its
    rows.  y counts from its value at the window's first x, so that little is
    lost where it is far from 0; terms that hardly differ over a short window
    cost digits, as normal equations square their condition.
    """
    inside = series.filter(F.col("x") >= first)
    about = inside.groupBy(key).agg(F.min_by("y", "x").alias("_y0"))
    w, t, y = 1 / (F.col("std") * F.col("std")), [F.lit(1.0), *[f(F.col("x")) for f in terms]], F.col("y") - F.col("_y0")
    p = len(t)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    products = {f"_a{i}_{j}": w * t[i] * t[j] for i, j in pairs} | {f"_b{i}": w * t[i] * y for i in range(p)} | {"_yy": w * y * y, "_n": F.lit(1.0)}
    rows = inside.join(about, key).select(key, "x", *[v.cast("double").alias(k) for k, v in products.items()])
    sums = running_sums(rows, key, "x", list(products))

    @F.pandas_udf("double")
    def loss(a: pd.Series, b: pd.Series, yy: pd.Series) -> pd.Series:
        if a.empty:
            return pd.Series([], dtype=float)
        m, g = np.zeros((len(a), p, p)), np.stack(b.to_numpy())
        for (i, j), v in zip(pairs, np.stack(a.to_numpy()).T):
            m[:, i, j] = m[:, j, i] = v
        scale = np.sqrt(np.maximum(m[:, range(p), range(p)], 1e-300))
        beta = (np.linalg.pinv(m / scale[:, :, None] / scale[:, None, :], rcond=1e-13, hermitian=True) @ (g / scale)[:, :, None])[:, :, 0]
        return pd.Series(np.maximum(yy.to_numpy() - (beta * (g / scale)).sum(axis=1), 0.0))

    chi = loss(F.array(*[f"_a{i}_{j}" for i, j in pairs]), F.array(*[f"_b{i}" for i in range(p)]), "_yy")
    return sums.select(key, F.col("x").alias("end"), F.col("_n").cast("long").alias("points"), chi.alias("chi_squared"))


def first_bad_window(windows: DataFrame, parameters: int, key: str = "series") -> DataFrame:
    """key, last: the first end whose window has a reduced chi squared above 1 (null if none)."""
    free = F.col("points") - parameters
    return windows.groupBy(key).agg(F.min(F.when((free > 0) & (F.col("chi_squared") / free > 1), F.col("end"))).alias("last"))


def power_trend(table: DataFrame, key: str = "series") -> DataFrame:
    """key, x, trend, band: y = a x^b with the propagated error of its parameters at each x."""
    model = lambda x, p: p["a"] * F.pow(x, p["b"])
    logs = table.groupBy(key).agg(F.regr_slope(F.log("y"), F.log("x")).alias("b"), F.regr_intercept(F.log("y"), F.log("x")).alias("_l")).select(key, F.exp("_l").alias("a"), "b")
    fitted = refine(table, logs, model, {"a": (-1e300, 1e300), "b": (-50.0, 50.0)}, key)
    e = errors(table, fitted, model, ["a", "b"], key)
    of_a, of_b = F.pow("x", "b"), F.col("a") * F.pow("x", "b") * F.log("x")
    var = of_a * of_a * F.col("cov")[0] + 2 * of_a * of_b * F.col("cov")[1] + of_b * of_b * F.col("cov")[3]
    return table.join(e, key).select(key, "x", (F.col("a") * of_a).alias("trend"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("band"))


def residuals(series: DataFrame, fitted: DataFrame, model: Model, names: list[str], key: str = "series") -> DataFrame:
    f = model(F.col("x"), {p: F.col(p) for p in names})
    return series.join(fitted, key).select(key, "x", "y", (F.col("y") - f).alias("residual"), ((F.col("y") - f) / F.when(F.col("y") == 0, 2.220446049250313e-16).otherwise(F.col("y"))).alias("relative"))


def score(rest: DataFrame, parameters: int, key: str = "series", std: str | None = None) -> DataFrame:
    """Reduced chi squared with stds (NaN without freedom), else relative RMS."""
    if std is None:
        return rest.groupBy(key).agg(F.sqrt(F.avg(F.col("relative") * F.col("relative"))).alias("score"))
    free = F.count("*") - parameters
    r = F.col("residual") / F.col(std)
    return rest.groupBy(key).agg(F.when(free > 0, F.sum(r * r) / free).otherwise(float("nan")).alias("score"))


def std_floor(series: DataFrame, key: str = "series", share: float = 1e-3) -> DataFrame:
    good = F.when((F.col("std") > 0) & (F.col("std") < float("inf")), F.col("std"))
    return series.withColumn("std", F.coalesce(good, share * F.min(good).over(Window.partitionBy(key))))


def line_fit(series: DataFrame, key: str = "series") -> DataFrame:
    """Straight line with the standard errors of its linearised least squares."""
    x, y = F.col("x"), F.col("y")
    s = series.groupBy(key).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    s = s.withColumn("slope", (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    rss = F.greatest(F.col("syy") - F.col("intercept") * F.col("sy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    var = rss / (F.col("n") - 2)
    return s.filter(F.col("n") > 2).select(key, "slope", "intercept", F.sqrt(var * F.col("n") / det).alias("slope_err"), F.sqrt(var * F.col("sxx") / det).alias("intercept_err"))
