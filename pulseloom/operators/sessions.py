"""Grouping of pulses into events by time gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.operators.chain import follow
from pulseloom.operators.position import with_position
from pulseloom.session import materialize

ZONE_SLOTS = 1 << 16


def slot_of(time: str, gap: float) -> Column:
    """Slot of width ``gap``; without a gap every distinct time is a slot of its own."""
    if gap < 0:
        raise ValueError("a gap or threshold must not be negative")
    return F.floor(F.col(time) / F.lit(gap)).cast("bigint") if gap else F.col(time)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join in which null keys meet; the key columns come from the left side once."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"_right_{k}" for k in keys])


def gap_slots(
    df: DataFrame,
    time: str,
    gap: float,
    *,
    stream: Sequence[str] = (),
    aggregates: Sequence[Column] = (),
    zone_slots: int = ZONE_SLOTS,
) -> DataFrame:
    """One row per occupied time slot with its event id and event start.

    A new event starts where the step to the previous time is larger than ``gap``. Times that share a
    slot of width ``gap`` differ by less than ``gap``, so they always share the event: rows can be reduced to
    (min, max) per slot before anything is ordered. The reduction is a hash aggregate with map-side
    combine, so one crowded slot is no hot spot. Slots are ordered inside zones of at most
    ``zone_slots`` slots, and one row per zone goes through the last, global step.
    """
    stream = list(stream)
    slot = slot_of(time, gap)
    slots = (
        df.filter(F.col(time).isNotNull())
        .groupBy(*stream, slot.alias("_slot"))
        .agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"), *aggregates)
        .withColumn("_zone", F.floor(F.col("_slot") / F.lit(zone_slots)).cast("bigint"))
    )
    keys = [*stream, "_zone"]
    in_zone = W.partitionBy(*keys).orderBy("_slot")
    upto = in_zone.rowsBetween(W.unboundedPreceding, W.currentRow)
    slots = slots.withColumn(
        "_open", F.coalesce(F.col("_lo") - F.lag("_hi").over(in_zone) > F.lit(gap), F.lit(False))
    )
    over = W.partitionBy(*stream).orderBy("_zone") if stream else W.orderBy("_zone")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    zones = (
        slots.groupBy(*keys)
        .agg(
            F.min("_lo").alias("_first"),
            F.max("_hi").alias("_end"),
            F.count_if("_open").alias("_opens"),
            F.max(F.when(F.col("_open"), F.col("_lo"))).alias("_last_start"),
        )
        .withColumn("_head", F.coalesce(F.col("_first") - F.lag("_end").over(over) > F.lit(gap), F.lit(True)))
    )
    head = F.col("_head").cast("bigint")
    own = F.coalesce("_last_start", F.when(F.col("_head"), F.col("_first")))
    zones = zones.select(
        *keys,
        (F.coalesce(F.sum(F.col("_opens") + head).over(before), F.lit(0)) + head).alias("_base"),
        F.when(F.col("_head"), F.col("_first")).otherwise(F.last(own, ignorenulls=True).over(before)).alias("_zone_start"),
    )
    return (
        slots.withColumn("_inner", F.sum(F.col("_open").cast("bigint")).over(upto))
        .withColumn("_start", F.last(F.when(F.col("_open"), F.col("_lo")), ignorenulls=True).over(upto))
        .transform(lambda s: join_null_safe(s, zones, keys, "inner"))
        .withColumn("event_id", F.col("_base") + F.col("_inner"))
        .withColumn("event_start", F.coalesce("_start", "_zone_start"))
        .drop("_zone", "_open", "_inner", "_start", "_base", "_zone_start")
    )


def gap_events(
    df: DataFrame,
    time: str,
    gap: float,
    *,
    stream: Sequence[str] = (),
    zone_slots: int = ZONE_SLOTS,
    with_start: bool = False,
) -> DataFrame:
    """All rows with ``event_id`` (1-based, null where the time is null).

    Rows meet the slot table in one equi join on the slot; a crowded slot is split by the adaptive skew join.
    """
    stream = list(stream)
    slots = gap_slots(df, time, gap, stream=stream, zone_slots=zone_slots).drop("_lo", "_hi")
    if not with_start:
        slots = slots.drop("event_start")
    rows = df.withColumn("_slot", slot_of(time, gap))
    return join_null_safe(rows, slots, [*stream, "_slot"], "left").drop("_slot")


ZONE_TIMES = 1 << 16


def anchor_times(
    df: DataFrame, time: str, threshold: float, *, stream: Sequence[str] = (), zone_times: int = ZONE_TIMES
) -> DataFrame:
    """Event id of every distinct time: a new event starts where a time is more than ``threshold`` after the
    event's first time. Returns (stream.., time, event_id, event_start); null times have no row.

    Rows are reduced to distinct times first (combining, so a frequent time costs nothing). These get dense positions,
    written once, and the sequential rule runs as a greedy chain over zones of ``zone_times`` positions. So a task holds
    the same number of times in a dense stretch and in a sparse one, whether times are whole numbers or not.
    """
    stream = list(stream)
    if threshold <= 0:  # nothing but the very same time belongs to an anchor, so anchors and gaps are the same
        slots = gap_slots(df, time, threshold, stream=stream)
        return slots.select(*stream, F.col("_lo").alias(time), "event_id", "event_start")
    num = df.schema[time].dataType
    far = F.col(time) + F.lit(threshold)
    limit = F.floor(far) if isinstance(num, T.IntegralType) else far
    times = df.filter(F.col(time).isNotNull()).groupBy(*stream, time).agg(F.lit(1).alias("_one")).drop("_one")
    nodes = with_position(times, [*stream, time], "_pos").select(
        *stream, time, limit.cast(num).alias("_limit"), F.floor(F.col("_pos") / F.lit(zone_times)).alias("_z")
    )
    labels = materialize(follow(nodes, time, "_limit", stream=stream, zone="_z", max_step=threshold, members=True))
    over = W.partitionBy(*stream).orderBy("zone") if stream else W.orderBy("zone")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    own = F.when(F.col("step") > 0, F.col("start"))
    zones = labels.groupBy(*stream, "zone").agg(F.max("step").alias("_n"), F.max(own).alias("_last"))
    zones = zones.select(
        *stream,
        "zone",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.last("_last", ignorenulls=True).over(before).alias("_carry"),
    )
    return join_null_safe(labels, zones, [*stream, "zone"], "inner").select(
        *stream, time, (F.col("_base") + F.col("step")).alias("event_id"), F.coalesce(own, F.col("_carry")).alias("event_start")
    )


def anchor_events(
    df: DataFrame, time: str, threshold: float, *, stream: Sequence[str] = (), zone_times: int = ZONE_TIMES
) -> DataFrame:
    """All rows with the anchored ``event_id`` (1-based, null where the time is null) and ``event_start``."""
    ids = anchor_times(df, time, threshold, stream=stream, zone_times=zone_times)
    return join_null_safe(df, ids, [*stream, time], "left")
