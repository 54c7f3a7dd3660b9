"""From pulses to positioned, calibrated hits and per-event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.calib import energy_deposit
from pulseloom.operators.dims import join_map, join_pads, pad_geometry, with_zones
from pulseloom.operators.fits import track_fit, track_moments, with_track
from pulseloom.operators.sessions import gap_events
from pulseloom.operators.summary import summary_aggregates, time_aggregates, with_centroids

# A point between the two detector halves; keeps the track moments small.
TRACK_ORIGIN = (0.0, 90.0)


def mapped(pulses: DataFrame, mapping: DataFrame, key: str = "gch") -> DataFrame:
    """Pulses with pad and calibrated energy."""
    hits = join_map(pulses, mapping, key)
    return hits.withColumn("energy", energy_deposit(F.col("charge").cast("double"), F.col("tpc_id")))


def build_hits(pulses: DataFrame, mapping: DataFrame, time: str, gap: float, key: str = "gch") -> DataFrame:
    """Hits on pads with event id, position, energy, weight and zone flags; ground and unmapped channels are left out.

    The event id comes from all pulses, also those outside the pads.
    """
    spark: SparkSession = pulses.sparkSession
    events = gap_events(pulses, time, gap, with_start=True)
    hits = join_pads(mapped(events, mapping, key), pad_geometry(spark))
    return with_zones(hits.withColumn("w", F.col("charge").cast("double"))).filter("is_al")


def build_tracks(hits: DataFrame) -> DataFrame:
    """Lines z = a_slope x + a_intercept; a track straight down the detector is steep."""
    return track_fit(hits, "x", "z", "w", origin=TRACK_ORIGIN)


def build_summary_tracks(hits: DataFrame, *more: Column) -> DataFrame:
    """Summary, centroids and track of every event, and ``more`` aggregates, from one aggregation without a join."""
    moments = track_moments("x", "z", "w", origin=TRACK_ORIGIN)
    sums = hits.groupBy("event_id").agg(*summary_aggregates(), *more, *moments)
    return with_track(with_centroids(sums), TRACK_ORIGIN)


def build_events(hits: DataFrame, time: str, ns_per_unit: float) -> DataFrame:
    """Summary, centroids, mean times and track of every event."""
    return build_summary_tracks(hits, *time_aggregates(time, ns_per_unit))


def select_events(
    events: DataFrame, *, q_up_max: float = 30e3, q_dn_min: float = 20e3, n_max: int = 13
) -> DataFrame:
    return events.filter(
        (F.col("Q_up") < q_up_max) & (F.col("Q_dn") > q_dn_min) & (F.col("N_dn") < n_max) & (F.col("N_up") < n_max)
    )
