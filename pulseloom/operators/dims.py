"""Small dimensions: channel map (at most 128 rows) and pad geometry (120 rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.calib import Z_DOWN, Z_UP, mirrored_pad

PADS_PER_ROW = 20


def channel_map(raw: DataFrame) -> DataFrame:
    """(map_id, tpc_id) from the text form of the map; ground ('G') and other bad ids become -1."""
    return raw.select(
        F.col("readoutID").cast("bigint").alias("map_id"),
        F.coalesce(F.expr("try_cast(gid as int)"), F.lit(-1)).alias("tpc_id"),
    )


def channel_map_legacy(raw: DataFrame) -> DataFrame:
    """Older map form: rows whose tpcID or padID is no number are dropped; both are 1-based."""
    num = raw.select(
        F.col("readoutID").cast("bigint").alias("map_id"),
        F.expr("try_cast(tpcID as int)").alias("tpc"),
        F.expr("try_cast(padID as int)").alias("pad"),
    ).filter("tpc is not null and pad is not null")
    return num.select("map_id", ((F.col("tpc") - 1) * 60 + F.col("pad") - 1).alias("tpc_id"))


def half_pads(spark: SparkSession, z0: float, mirrored: bool) -> DataFrame:
    """Centres of 3 rows of 20 triangular pads, pitch 3."""
    k, r = F.col("k").cast("double"), F.col("r")
    lead = [0.5, 1.0, 1.5]
    if mirrored:
        lead.reverse()
    shift = F.when(r == 0, F.lit(lead[0])).when(r == 1, F.lit(lead[1])).otherwise(F.lit(lead[2]))
    parity = (F.col("k") + (1 if mirrored else 0)) % 2
    root3 = F.sqrt(F.lit(3.0))
    pad = spark.range(3 * PADS_PER_ROW).select(
        F.col("id").cast("int").alias("g"),
        F.expr(f"cast(id div {PADS_PER_ROW} as int)").alias("r"),
        F.expr(f"cast(id % {PADS_PER_ROW} as int)").alias("k"),
    )
    return pad.select(
        (mirrored_pad(F.col("g")) if mirrored else F.col("g")).cast("int").alias("tpc_id"),
        ((k + shift) * 1.5 - 15.75).alias("x"),
        (parity * root3 / 2 + r * root3 * 1.5 + F.lit(z0)).alias("z"),
    )


def pad_geometry(spark: SparkSession) -> DataFrame:
    """Upstream pads 0..59 and mirrored downstream pads 60..119."""
    down = half_pads(spark, Z_DOWN, True).withColumn("tpc_id", F.col("tpc_id") + 60)
    return half_pads(spark, Z_UP, False).unionByName(down)


def join_map(hits: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Left lookup of the pad; unmapped channels keep a null pad.

    The caller's map carries no hint: it is sent to all tasks only while its measured size is below the session's limit.
    """
    return hits.join(mapping, hits[key] == mapping["map_id"], "left").drop("map_id")


def join_pads(hits: DataFrame, pads: DataFrame) -> DataFrame:
    return hits.join(pads, "tpc_id", "left")


ZONES = ["is_al", "is_up", "is_dn", "is_up1", "is_up2", "is_up3", "is_dn1", "is_dn2", "is_dn3"]


def zone_columns(tpc: str = "tpc_id") -> dict:
    """Membership of a pad in the detector, its halves and its six rows."""
    zones = {"is_al": f"{tpc} between 0 and 119", "is_up": f"{tpc} between 0 and 59", "is_dn": f"{tpc} >= 60"}
    for n in range(6):
        name = f"is_{'up' if n < 3 else 'dn'}{n % 3 + 1}"
        zones[name] = f"{tpc} between {n * PADS_PER_ROW} and {(n + 1) * PADS_PER_ROW - 1}"
    return {name: F.expr(test) for name, test in zones.items()}


def lookup(mapping: DataFrame, **where) -> DataFrame:
    """All map rows with the given values, e.g. ``lookup(m, chipNo=2, chipChannel=4)`` or ``lookup(m, tpc_id=7)``."""
    for name, value in where.items():
        mapping = mapping.filter(F.col(name).eqNullSafe(F.lit(value)))
    return mapping


def lookup_each(df: DataFrame, mapping: DataFrame, keys: dict[str, str], label: str) -> DataFrame:
    """``label`` of the first map row (by label) that fits each row of ``df``; ``keys`` maps columns of df to map columns."""
    first = mapping.groupBy(*[F.col(m).alias(f"_{m}") for m in keys.values()]).agg(F.min(label).alias(label))
    return df.join(first, [F.col(c) == F.col(f"_{m}") for c, m in keys.items()], "left").drop(*[f"_{m}" for m in keys.values()])


def with_zones(hits: DataFrame, tpc: str = "tpc_id") -> DataFrame:
    return hits.withColumns(zone_columns(tpc))
