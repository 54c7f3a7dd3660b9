"""Fits as aggregates: line, weighted orthogonal line and Gaussian."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def finite(c: Column) -> Column:
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def ols(df: DataFrame, x: str, y: str, by: Sequence[str] = (), *, degenerate: bool = False) -> DataFrame:
    """Least-squares line y = slope x + intercept with errors; groups with n < 2 or constant x are left out.

    With ``degenerate`` they stay, as rows with null results and a ``reason`` (``points`` or ``constant``, null for a line).
    The regr_ aggregates combine on the map side and keep centred sums.
    """
    ok = df.filter(finite(F.col(x)) & finite(F.col(y))).withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    s = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_x").alias("x_mean"),
        F.avg("_y").alias("y_mean"),
        F.regr_sxx("_y", "_x").alias("sxx"),
        F.regr_syy("_y", "_x").alias("syy"),
        F.regr_sxy("_y", "_x").alias("sxy"),
    )
    if degenerate:
        reason = F.when(F.col("n") < 2, F.lit("points")).when(~(F.col("sxx") > 0), F.lit("constant"))
        line = F.col("reason").isNull()
        s = s.withColumn("reason", reason).withColumns({c: F.when(line, F.col(c)) for c in ("sxx", "syy", "sxy")})
    else:
        s = s.filter((F.col("n") >= 2) & (F.col("sxx") > 0))
    s = s.withColumn("slope", F.col("sxy") / F.col("sxx"))
    s = s.withColumns(
        {
            "intercept": F.col("y_mean") - F.col("slope") * F.col("x_mean"),
            "rss": F.when(F.col("sxx").isNotNull(), F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))),
            "dof": F.col("n") - 2,
        }
    )
    s2 = F.try_divide(F.col("rss"), F.nullif(F.col("dof").cast("double"), F.lit(0.0)))
    s = s.withColumn("_s2", s2).withColumns(
        {
            "r2": F.when(F.col("sxx").isNull(), None).when(F.col("syy") > 0, F.lit(1.0) - F.col("rss") / F.col("syy")).otherwise(
                F.when(F.col("rss") < 1e-30, F.lit(1.0)).otherwise(F.lit(0.0))
            ),
            "stderr_slope": F.sqrt(F.col("_s2") / F.col("sxx")),
            "stderr_intercept": F.sqrt(F.col("_s2") * (F.lit(1.0) / F.col("n") + F.col("x_mean") * F.col("x_mean") / F.col("sxx"))),
            "cov_ab": -F.col("x_mean") * F.col("_s2") / F.col("sxx"),
        }
    )
    return s.drop("_s2", "sxx", "syy", "sxy")


def track_fit(
    hits: DataFrame,
    x: str = "x",
    y: str = "z",
    weight: str = "w",
    key: str = "event_id",
    *,
    origin: tuple[float, float] = (0.0, 0.0),
) -> DataFrame:
    """Weighted orthogonal line per event, y = a_slope x + a_intercept.

    Closed form from six weighted moments in one combining aggregate: direction angle
    ``atan2(2 Sxy, Sxx - Syy) / 2``, chi2 = weight sum times the smaller eigenvalue of the covariance. ``origin`` is a
    point near the data (e.g. the detector centre) and keeps the moments well conditioned without a second
    pass over the rows. Only weights > 0 take part; an event with a non-finite value or fewer than two points
    has null results but for its number of points; a vertical line has null slope and intercept.
    """
    w = F.col(weight).cast("double")
    m = hits.filter((w > 0) | F.isnan(w)).groupBy(key).agg(*track_moments(x, y, weight, origin=origin))
    return with_track(m, origin)


def track_moments(x: str = "x", y: str = "z", weight: str = "w", *, origin: tuple[float, float] = (0.0, 0.0)) -> list[Column]:
    """Aggregates that ``with_track`` reads; rows whose weight is not above 0 add nothing."""
    w, u, v = F.col(weight).cast("double"), F.col(x).cast("double") - origin[0], F.col(y).cast("double") - origin[1]
    used = (w > 0) | F.isnan(w)
    sums = {"_w": w, "_wu": w * u, "_wv": w * v, "_wuu": w * u * u, "_wvv": w * v * v, "_wuv": w * u * v}
    return [
        F.count_if(used).alias("_rows"),
        F.count_if(used & finite(w) & finite(u) & finite(v)).alias("_n"),
        *[F.sum(F.when(used, value)).alias(name) for name, value in sums.items()],
    ]


def with_track(m: DataFrame, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """The line of every group in place of its ``track_moments``; all null where no row had a weight."""
    # variables instead of column chains: a filter on a result must not multiply the arithmetic when it is pushed down
    moments = "named_struct('cu', _wu / _w, 'cv', _wv / _w, 'muu', _wuu / _w, 'mvv', _wvv / _w, 'muv', _wuv / _w)"
    spread = f"""named_struct('cu', k.cu, 'cv', k.cv,
        'suu', {_settle("k.muu - k.cu * k.cu", "k.muu")},
        'svv', {_settle("k.mvv - k.cv * k.cv", "k.mvv")},
        'suv', {_settle("k.muv - k.cu * k.cv", "sqrt(k.muu * k.mvv)")})"""
    # variance across the line as a projection: no difference of two large eigenvalues
    line = f"""named_struct(
        'slope', d.slope,
        'intercept', s.cv + {float(origin[1])!r}D - d.slope * (s.cu + {float(origin[0])!r}D),
        'chi2', _w * greatest(0.0D, s.suu * d.s * d.s - 2.0D * s.suv * d.s * d.c + s.svv * d.c * d.c),
        'angle', degrees(t))"""
    direction = "named_struct('c', cos(t), 's', sin(t), 'slope', if(abs(cos(t)) >= 1e-12D, sin(t) / cos(t), null))"
    angle = "atan2(2.0D * s.suv, s.suu - s.svv) / 2.0D"
    fit = sql_let(moments, "k", sql_let(spread, "s", sql_let(angle, "t", sql_let(direction, "d", line))))
    kept = [c for c in m.columns if c not in ("_rows", "_n", "_w", "_wu", "_wv", "_wuu", "_wvv", "_wuv")]
    m = m.withColumn("_ok", F.expr("_n = _rows and _n >= 2")).withColumn("_fit", F.expr(f"if(_ok, {fit}, null)"))
    return m.selectExpr(
        *kept,
        "_fit.slope as a_slope",
        "_fit.intercept as a_intercept",
        "_fit.chi2 as a_chi2",
        "if(_ok and _n > 2, _fit.chi2 / (_n - 2), null) as a_chi2_reduced",
        "_fit.angle as a_angle_deg",
        "if(_rows > 0, cast(_rows as int), null) as a_n_points",
        "if(_rows > 0, cast(greatest(_rows - 2, 0) as int), null) as a_dof",
    )


def sql_let(value: str, name: str, body: str) -> str:
    """SQL text that evaluates ``value`` once and uses it as ``name`` inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _settle(difference: str, scale: str) -> str:
    """Rounding noise of coinciding coordinates counts as 0, so vertical and point-like events are exact."""
    return f"if(abs({difference}) <= 1e-12D * {scale}, 0.0D, {difference})"


def gauss(x: Column, amplitude: Column, mu: Column, sigma: Column) -> Column:
    t = (x - mu) / sigma
    return amplitude * F.exp(-t * t / 2)


def gauss_fit(
    hist: DataFrame,
    center: str = "center",
    count: str = "n",
    by: Sequence[str] = (),
    *,
    fit_range: tuple[float, float] | None = None,
    mode: str = "compat",
    method: str = "parabola",
) -> DataFrame:
    """Gaussian amplitude, mu and sigma of a histogram per group by a weighted parabola in log space.

    ``mode='compat'`` lets empty bins enter as log(1e-12) with weight 1; ``mode='positive'`` leaves them out.
    Where the parabola does not open downwards, the moments of the histogram are returned. Fewer than three
    usable bins give no row. ``method='least_squares'`` instead minimises chi2 with the Poisson weights of the bins,
    starting from the moments, and adds ``amplitude_error``, ``mu_error`` and ``sigma_error`` from the covariance at the
    minimum. ``method`` says what gave a row: ``least_squares``, or, without errors, ``parabola`` or ``moments`` where no
    minimum was found.
    """
    by = list(by)
    h = hist.select(*by, F.col(center).cast("double").alias("x"), F.col(count).cast("double").alias("y"))
    h = h.filter(finite(F.col("x")) & finite(F.col("y")) & (F.col("y") >= 0))
    if fit_range is not None:
        lo, hi = min(fit_range), max(fit_range)
        h = h.filter(F.col("x").between(lo, hi))
    if mode == "positive":
        h = h.filter(F.col("y") > 0)
    # a histogram has a set number of bins, so one array per group is bounded; the source is read once
    g = h.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("_h")).filter(F.size("_h") >= 3)

    fit = g.select(*by, "_h", F.size("_h").cast("bigint").alias("n_bins"), F.expr(_parabola()).alias("_f"))
    flat = fit.selectExpr(*by, "_h", "n_bins", "_f.p.amplitude", "_f.p.mu", "_f.p.sigma", "_f.p.converged", "_f.chi2")
    if method == "least_squares":
        named = flat.withColumn("method", F.when(F.col("converged"), F.lit("parabola")).otherwise(F.lit("moments")))
        flat = named.withColumns({c: F.lit(None).cast("double") for c in ERRORS})
        flat = flat.mapInPandas(_refine, flat.schema)
    elif method != "parabola":
        raise ValueError(f"method: {method}")
    return flat.drop("_h").withColumn("chi2_red", F.expr("chi2 / greatest(n_bins - 3, 1)"))


ERRORS = ["amplitude_error", "mu_error", "sigma_error"]


def _refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the parameters of every histogram by the weighted least-squares ones where these are found."""
    for pdf in batches:
        pdf = pdf.copy()
        for i, bins in zip(pdf.index, pdf["_h"]):
            x = np.array([b["x"] for b in bins])
            y = np.array([b["y"] for b in bins])
            best = least_squares_gauss(x, y)
            if best is not None:
                pdf.loc[i, ["amplitude", "mu", "sigma", "chi2", *ERRORS]] = best
                pdf.loc[i, "converged"], pdf.loc[i, "method"] = True, "least_squares"
        yield pdf


def least_squares_gauss(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, ...] | None:
    """Damped Gauss-Newton on (A, mu, sigma) of one histogram; errors sqrt(max(y, 1)); None without convergence.

    Returns the parameters, chi2 and the parameters' standard errors (NaN where the minimum does not determine them).

    A stays >= 0, sigma > 0 and mu within ten spans of the bins.
    """
    total, span = y.sum(), np.ptp(x)
    if total <= 0 or span <= 0:
        return None
    mu = (x * y).sum() / total
    spread = math.sqrt(((x - mu) ** 2 * y).sum() / total)
    p = np.array([y.max(), mu, spread if spread > 0 else span / 6])
    low = np.array([0.0, x.min() - 10 * span, 1e-9])
    high = np.array([np.inf, x.max() + 10 * span, np.inf])
    err = np.sqrt(np.maximum(y, 1.0))

    def cost(q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        t = (x - q[1]) / q[2]
        g = np.exp(-t * t / 2)
        slope = np.stack([g, q[0] * g * t / q[2], q[0] * g * t * t / q[2]], axis=1) / err[:, None]
        miss = (y - q[0] * g) / err
        return float(miss @ miss), miss, slope

    def result(p: np.ndarray, chi2: float, slope: np.ndarray) -> tuple[float, ...]:
        try:
            errors = np.sqrt(np.clip(np.diag(np.linalg.inv(slope.T @ slope)), 0, None))
        except np.linalg.LinAlgError:
            errors = np.full(3, np.nan)
        return float(p[0]), float(p[1]), float(p[2]), chi2, *errors.tolist()

    chi2, miss, slope = cost(p)
    damp = 1e-3
    for _ in range(steps):
        normal, pull = slope.T @ slope, slope.T @ miss
        try:
            move = np.linalg.solve(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-300)), pull)
        except np.linalg.LinAlgError:
            return None
        q = np.clip(p + move, low, high)
        new, miss_q, slope_q = cost(q)
        if new <= chi2:
            done = chi2 - new <= 1e-12 * max(chi2, 1e-12) and np.all(np.abs(q - p) <= 1e-9 * (np.abs(p) + 1e-9))
            p, chi2, miss, slope, damp = q, new, miss_q, slope_q, max(damp / 10, 1e-12)
            if done or chi2 == 0:
                return result(p, chi2, slope)
        else:
            damp *= 10
            if damp > 1e12:
                return result(p, chi2, slope)
    return None


def _total(rows: str, term: str) -> str:
    return f"aggregate({rows}, 0.0D, (acc, e) -> acc + {term})"


def _det3(*m: str) -> str:
    a, b, c, d, e, f, g, h, i = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _parabola() -> str:
    """SQL text: parameters and chi2 of the histogram array ``_h`` of (x, y)."""
    sums = f"""named_struct('c', {_total("_h", "e.x")} / size(_h), 'sy', {_total("_h", "e.y")}, 'sxy', {_total("_h", "e.x * e.y")},
        'top', array_max(_h.y), 'span', array_max(_h.x) - array_min(_h.x))"""
    shape = f"""named_struct('c', a.c, 'sy', a.sy, 'top', a.top, 'span', a.span,
        'sd', sqrt({_total("_h", "pow(e.x - a.c, 2D)")} / size(_h)), 'mu0', if(a.sy > 0, a.sxy / a.sy, a.c))"""
    # centred and scaled abscissa, squared weight and log height of every bin
    bins = """transform(_h, e -> named_struct('t', try_divide(e.x - m.c, m.span), 'w', greatest(e.y, 1.0D), 'l', ln(greatest(e.y, 1e-12D))))"""
    power = {p: _total("q", f"e.w * pow(e.t, {p}D)") for p in range(5)}
    mixed = {p: _total("q", f"e.w * pow(e.t, {p}D) * e.l") for p in range(3)}
    normal = "named_struct(" + ", ".join(
        [f"'s{p}', {t}" for p, t in power.items()] + [f"'l{p}', {t}" for p, t in mixed.items()]
    ) + f""", 'ss', {_total("_h", "pow(e.x - m.mu0, 2D) * e.y")})"""
    det = _det3("n.s0", "n.s1", "n.s2", "n.s1", "n.s2", "n.s3", "n.s2", "n.s3", "n.s4")
    coef = [
        _det3("n.l0", "n.s1", "n.s2", "n.l1", "n.s2", "n.s3", "n.l2", "n.s3", "n.s4"),
        _det3("n.s0", "n.l0", "n.s2", "n.s1", "n.l1", "n.s3", "n.s2", "n.l2", "n.s4"),
        _det3("n.s0", "n.s1", "n.l0", "n.s1", "n.s2", "n.l1", "n.s2", "n.s3", "n.l2"),
    ]
    solved = sql_let(det, "d", "named_struct(" + ", ".join(f"'b{i}', try_divide({c}, d)" for i, c in enumerate(coef)) + ")")
    fitted = sql_let(
        "-0.5D / b.b2",
        "v",
        "named_struct('amplitude', exp(b.b0 + b.b1 * b.b1 * v / 2D), 'mu', m.c + b.b1 * v * m.span, 'sigma', sqrt(v) * m.span, 'converged', true)",
    )
    moments = """named_struct('amplitude', if(m.sy > 0, greatest(m.top, 1e-9D), 1.0D), 'mu', m.mu0,
        'sigma', greatest(case when m.sy > 0 and n.ss > 0 then sqrt(n.ss / greatest(m.sy, 1.0D)) when m.sy <= 0 and m.sd > 0 then m.sd else m.span / 6D end, 1e-9D),
        'converged', false)"""
    parameters = sql_let(solved, "b", f"if(b.b2 < 0, {fitted}, {moments})")
    inner = sql_let(sums, "a", sql_let(shape, "m", sql_let(bins, "q", sql_let(normal, "n", parameters))))
    miss = "(e.y - p.amplitude * exp(-pow((e.x - p.mu) / p.sigma, 2D) / 2D))"
    return sql_let(inner, "p", f"""named_struct('p', p, 'chi2', {_total("_h", f"{miss} * {miss} / greatest(e.y, 1.0D)")})""")
