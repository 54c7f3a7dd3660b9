"""Detector checks: resolution, timing, gain and noise, each a short chain of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.calib import SOURCE_ENERGY_DOWN, SOURCE_ENERGY_UP, Z_DOWN, Z_UP, Readout, inverse_line
from pulseloom.functions.waveform import equivalent_noise_charge
from pulseloom.operators.fits import gauss_fit
from pulseloom.operators.hist import hist1d


def with_inverse(events: DataFrame) -> DataFrame:
    """Track as x over z: columns slope and intercept (null for a horizontal fit)."""
    s, i = inverse_line(F.col("a_slope"), F.col("a_intercept"))
    return events.withColumns({"slope": s, "intercept": i})


def straight(events: DataFrame, max_slope: float = 0.05, max_x: float = 10.0) -> DataFrame:
    return events.filter((F.abs("slope") < max_slope) & (F.abs("x_ug") < max_x))


def energy_balance(events: DataFrame) -> DataFrame:
    """Mean of the outer upstream rows minus the middle row, and the sum of all three."""
    e1, e2, e3 = F.col("E_up1"), F.col("E_up2"), F.col("E_up3")
    return events.withColumns({"q_diff": (e1 + e3) / 2 - e2, "q_total": e1 + e2 + e3})


def energy_resolution(
    events: DataFrame, *, span: float = 30, bins: int = 100, fit: float = 20, max_slope: float = 0.05, mode: str = "compat"
) -> DataFrame:
    sel = straight(energy_balance(with_inverse(events)), max_slope)
    return gauss_fit(hist1d(sel, "q_diff", -span, span, bins), fit_range=(-fit, fit), mode=mode)


def position_residuals(events: DataFrame, *, max_slope: float = 0.05, max_x: float = 10.0) -> DataFrame:
    """Distance of the two centroids from the track at the two reference planes, and their difference."""
    at = lambda z: F.col("slope") * F.lit(z) + F.col("intercept")
    up, dn = at(Z_UP) - F.col("x_ug"), at(Z_DOWN) - F.col("x_dg")
    sel = straight(with_inverse(events), max_slope, max_x)
    return sel.withColumns({"residual": F.sqrt(up * up + dn * dn), "x_diff": F.abs(F.col("x_ug") - F.col("x_dg"))})


def timing(events: DataFrame, *, max_slope: float = 1.0, max_x: float = 12.0, min_hits: int = 3) -> DataFrame:
    sel = straight(with_inverse(events), max_slope, max_x).filter((F.col("N_up") > min_hits) & (F.col("N_dn") > min_hits))
    return sel.withColumns({"y_sum": F.col("y_up_ns") + F.col("y_dn_ns"), "y_dif": F.col("y_up_ns") - F.col("y_dn_ns")})


def gain_calibration(
    events: DataFrame,
    *,
    up_range: tuple = (10e3, 30e3),
    down_range: tuple = (20e3, 40e3),
    up_fit: tuple = (15e3, 25e3),
    down_fit: tuple = (20e3, 30e3),
    bins: int = 50,
    cuts: dict | None = None,
    readout: Readout = Readout(a=0.22372, b=8.56488),
    mode: str = "compat",
) -> DataFrame:
    """Gas gain and energy line of each half from the mean charge of alpha-source tracks.

    One row per half. The energy lines use all three sources upstream and the first two downstream.
    """
    c = {"q_dn_min": 10e3, "q_dn_max": 30e3, "q_up_min": 10e3, "max_slope": 0.05, "max_x": 10.0} | (cuts or {})
    sel = straight(with_inverse(events), c["max_slope"], c["max_x"]).filter(
        (F.col("Q_dn") > c["q_dn_min"]) & (F.col("Q_dn") < c["q_dn_max"]) & (F.col("Q_up") > c["q_up_min"])
    )
    up_kev = sum(SOURCE_ENERGY_UP.values()) / 3.0
    dn_kev = (SOURCE_ENERGY_DOWN["Am241"] + SOURCE_ENERGY_DOWN["Cm244"]) / 2.0

    def half(name: str, col: str, span: tuple, fit: tuple, kev: float) -> DataFrame:
        f = gauss_fit(hist1d(sel, col, *span, bins), fit_range=fit, mode=mode)
        gain = readout.gain(F.col("mu"), kev)
        a, b = readout.line(gain)
        return f.select(F.lit(name).alias("half"), "mu", "sigma", gain.alias("gain"), a.alias("line_a"), b.alias("line_b"))

    return half("up", "Q_up", up_range, up_fit, up_kev).unionByName(half("down", "Q_dn", down_range, down_fit, dn_kev))


def noise_sigma(samples: DataFrame, value: str, by: list, *, top: float = 1024, bins: int = 1024, mode: str = "compat") -> DataFrame:
    """Gaussian width of the baseline samples per channel and the noise charge that follows from it."""
    f = gauss_fit(hist1d(samples, value, 0, top, bins, by=by), by=by, fit_range=(0, top), mode=mode)
    return f.withColumn("enc", equivalent_noise_charge(F.col("sigma")))
