"""Pulses of built events: the single pulse of every wave of an event, events without pulses left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.functions import waveform as wf
from pulseloom.operators.position import with_position


def event_pulses(
    waves: DataFrame, event: str, wave: str, *, up: float = 20, down: float = 20, pre: int = 12, post: int = 12, baseline_samples: int = 10
) -> DataFrame:
    """One row per wave with a pulse: all columns of ``waves`` but the wave, and the pulse with its features.

    Added are ``pulse`` (the samples of the cut, see ``segment_pulse``), ``peak_at`` (0-based place of the largest sample of
    the whole wave, the first of equal ones), ``n_samples``, ``max_sample`` and ``charge`` of the pulse, and
    ``pulse_event``: events that have a pulse, numbered from 0 in the order of ``event``. A null event has no number, a null
    or short wave no pulse; repeated rows are waves of their own.

    Waves are cut where they are; only the event numbers are shuffled before the rows meet their number.
    """
    cut = waves.withColumn("pulse", wf.segment_pulse(wave, up=up, down=down, pre=pre, post=post, baseline_samples=baseline_samples))
    cut = cut.filter(F.col("pulse").isNotNull()).withColumns(
        {
            "peak_at": wf.peak_position(wave) - 1,
            "n_samples": F.size("pulse").cast("bigint"),
            "max_sample": wf.peak("pulse"),
            "charge": wf.total("pulse"),
        }
    ).drop(wave)
    numbers = with_position(cut.select(event).filter(F.col(event).isNotNull()).distinct(), [event], "pulse_event")
    return cut.join(numbers, event, "left")


def event_totals(pulses: DataFrame) -> DataFrame:
    """Per event: pulse_event, n_pulses, n_samples, largest sample and total charge of its pulses."""
    return pulses.groupBy("pulse_event").agg(
        F.count(F.lit(1)).alias("n_pulses"), F.sum("n_samples").alias("n_samples"), F.max("max_sample").alias("largest"), F.sum("charge").alias("total_charge")
    )
