"""Per-event aggregates. All are hash aggregates with map-side combine, so a huge event is no hot spot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.operators.position import number_within, with_position

ZONE_SUFFIXES = ["al", "up", "dn", "up1", "up2", "up3", "dn1", "dn2", "dn3"]
PART_ROWS = 10_000


def csum(cond: Column, value: Column) -> Column:
    """Conditional sum, 0.0 without rows."""
    return F.sum(F.when(cond, F.coalesce(value.cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)))


def ccount(cond: Column) -> Column:
    return F.count_if(cond)


def cmean(cond: Column, value: Column) -> Column:
    """Conditional mean over all flagged rows (rows with a null value count); null without rows."""
    return F.try_divide(F.sum(F.when(cond, value.cast("double"))), F.count_if(cond).cast("double"))


def event_summary(hits: DataFrame, key: str = "event_id") -> DataFrame:
    """Counts, charges, charge-weighted x sums, energies and mean z of every event.

    Expects charge, x, z, energy and the zone flags. A missing energy or position adds nothing.
    """
    return hits.groupBy(key).agg(*summary_aggregates())


def summary_aggregates() -> list[Column]:
    zone = lambda z: F.col(f"is_{z}")
    aggs = [cmean(zone(h), F.col("z")).alias(f"z_{h}") for h in ("up", "dn")]
    for name, value in (("Wx", F.col("charge") * F.col("x")), ("Q", F.col("charge")), ("E", F.col("energy"))):
        aggs += [csum(zone(z), value).alias(f"{name}_{z}") for z in ZONE_SUFFIXES]
    return aggs + [ccount(zone(z)).alias(f"N_{z}") for z in ("al", "up", "dn")]


def with_centroids(events: DataFrame) -> DataFrame:
    """Charge-weighted x of the two halves and the six rows; null where the charge is 0."""
    names = {"up": "x_ug", "dn": "x_dg"} | {f"{h}{i}": f"x_{h[0]}g{i}" for h in ("up", "dn") for i in (1, 2, 3)}
    return events.withColumns(
        {out: F.try_divide(F.col(f"Wx_{z}"), F.nullif(F.col(f"Q_{z}"), F.lit(0.0))) for z, out in names.items()}
    )


def event_times(hits: DataFrame, time: str, per_unit_ns: float, key: str = "event_id", near: str | None = "event_start") -> DataFrame:
    """Mean hit time of each half relative to the first hit of the event, in ns.

    ``near`` is a column with one value per event close to its times (the event start): sums run over small offsets from
    it, so one combining aggregate is exact enough and no second pass over the rows is needed. None means offsets from 0.
    """
    return hits.groupBy(key).agg(*time_aggregates(time, per_unit_ns, near))


def time_aggregates(time: str, per_unit_ns: float, near: str | None = "event_start") -> list[Column]:
    base = F.coalesce(F.col(near), F.lit(0)) if near else F.lit(0)
    rel = (F.col(time) - base).cast("double")
    half = lambda z: (F.avg(F.when(F.col(z), rel)) - F.min(rel)) * F.lit(per_unit_ns)
    return [F.coalesce(F.min(time), F.lit(0)).alias("y_offset"), half("is_up").alias("y_up_ns"), half("is_dn").alias("y_dn_ns")]


def ordered_parts(
    df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], *, part_rows: int = PART_ROWS
) -> DataFrame:
    """Arrays of the ``values`` columns per key, in the given total order.

    A key with more than ``part_rows`` rows gives several rows, numbered by ``part``; no array grows without
    bound, and a key that holds a third of the table is spread over many tasks. ``order`` must be total.
    """
    key = list(key)
    placed = number_within(with_position(df, [*key, *order], "_pos"), key, "_pos", "_rank")
    part = F.floor(F.col("_rank") / F.lit(part_rows)).cast("bigint").alias("part")
    grouped = placed.groupBy(*key, part).agg(
        F.sort_array(F.collect_list(F.struct("_rank", *values))).alias("_rows")
    )
    return grouped.select(*key, "part", *[F.col(f"_rows.{v}").alias(v) for v in values])
