"""Charge, energy and geometry arithmetic on columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the detector calibration.
ENERGY_UP = (0.007594825219782722, 0.2907597292526938)  # keV per count, keV; pads 0..59
ENERGY_DOWN = (0.006512604389126628, 0.24932806669203858)  # pads 60..119
Z_OFFSET = -3.031088913245535
Z_UP = 45.0 + Z_OFFSET
Z_DOWN = 136.5 + Z_OFFSET
# Energy loss in keV of the three alpha sources in the two halves.
SOURCE_ENERGY_UP = {"Am241": 133.3, "Cm244": 129.8, "Np237": 145.6}
SOURCE_ENERGY_DOWN = {"Am241": 175.7, "Cm244": 162.9, "Np237": 209.9}


@dataclass(frozen=True)
class Readout:
    """Electronics and gas constants: charge line a, b; capacitance; mV; W value; elementary charge."""

    a: float = 0.2327
    b: float = 2.375
    capacitance: float = 4.0
    millivolt: float = 1.953
    w_value: float = 26e-3
    electron: float = 1.602e-4

    def measured(self, value: Column) -> Column:
        return (value * F.lit(self.a) + F.lit(self.b)) * F.lit(self.millivolt) / F.lit(self.capacitance)

    def energy(self, value: Column, gain: Column | float = 2781.0) -> Column:
        """Energy deposit from a pulse value."""
        return self.measured(value) / (F.lit(self.electron / self.w_value) * _lit(gain))

    def gain(self, value: Column, energy: Column | float = 133.0) -> Column:
        """Gas gain from a pulse value of known energy."""
        return self.measured(value) / (F.lit(self.electron / self.w_value) * _lit(energy))

    def line(self, gain: Column | float = 2781.0) -> tuple[Column, Column]:
        """Coefficients of the linear form of ``energy``."""
        unit = F.lit(self.millivolt * self.w_value) / (F.lit(self.capacitance * self.electron) * _lit(gain))
        return F.lit(self.a) * unit, F.lit(self.b) * unit


def _lit(v):
    return v if isinstance(v, Column) else F.lit(float(v))


def energy_deposit(charge: Column, tpc_id: Column) -> Column:
    """Calibrated energy per half; null outside the pads."""
    up, down = ENERGY_UP, ENERGY_DOWN
    return F.when(tpc_id.between(0, 59), charge * F.lit(up[0]) + F.lit(up[1])).when(
        tpc_id.between(60, 119), charge * F.lit(down[0]) + F.lit(down[1])
    )


def mirrored_pad(pad: Column) -> Column:
    """Pad number of the same row counted from the other side (20 pads per row)."""
    row = F.floor(pad / F.lit(20)).cast("int")
    return F.lit(19) - pad % 20 + row * 20


def tick_to_ns(ticks: Column, ns_per_tick: float = 3.125) -> Column:
    return ticks.cast("double") * F.lit(ns_per_tick)


def inverse_line(slope: Column, intercept: Column) -> tuple[Column, Column]:
    """Line z = s x + i read as x over z; null for slope 0."""
    return F.try_divide(F.lit(1.0), slope), F.try_divide(-intercept, slope)
