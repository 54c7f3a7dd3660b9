"""Detector-style views over the given tables (all columns are derived by Spark)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Total order of the block stream inside one run.
BLOCK_ORDER = [
    "run", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
]


# 32 ten-bit samples, one per channel; written out, since Spark compiles no lambda functions.
SAMPLES = f"array({', '.join(f'(l_partkey * 7 + {ch * 31} + l_linenumber * 101) % 1024' for ch in range(32))})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str):
    """Epoch microseconds of a zone-less timestamp, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pulse per row: pulse_no, chip, channel, gch, t_us, charge."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pulse_no"),
        (F.col("user_id") % 4).alias("chip"),
        (F.col("event_id") % 32).alias("channel"),
        ((F.col("user_id") % 4) * 32 + F.col("event_id") % 32).alias("gch"),
        micros("ts").alias("t_us"),
        F.round(F.col("value") * 100).cast("bigint").alias("charge"),
    )


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 64-sample, 10-bit wave per row: vec_id, block, chip, channel, w."""
    sample = lambda e: F.least(
        F.lit(1023.0), F.greatest(F.lit(0.0), F.floor(F.lit(200.0) + F.lit(1500.0) * e.cast("double")).cast("double"))
    ).cast("bigint")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.expr("vec_id div 32").alias("block"),
        F.expr("(vec_id div 32) % 4").alias("chip"),
        F.expr("vec_id % 32").alias("channel"),
        F.transform("embedding", sample).alias("w"),
    )


def frames2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples_value[channel][sample] per block; a block never has more than 32 waves."""
    return (
        waves(spark, sf_dir)
        .groupBy("block")
        .agg(F.min("chip").alias("chip"), F.sort_array(F.collect_list(F.struct("channel", "w"))).alias("cw"))
        .select("block", "chip", F.col("cw.w").alias("samples_value"))
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded readout blocks; BLOCK_ORDER gives the stream order."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey % 16").alias("run"),
        *BLOCK_ORDER[1:],
        F.expr("(l_orderkey div 16) % 4").alias("chip"),
        F.col("l_linenumber").cast("bigint").alias("sample_index"),
        F.expr("l_suppkey % 32").alias("error_level"),
        F.expr(SAMPLES).alias("samples_value"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40-byte payloads as 80 hex digits."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.md5("p_name"), F.md5("p_brand"), F.substring(F.md5("p_type"), 1, 16)).alias("hex"),
    )


def channel_map_rows(spark: SparkSession) -> DataFrame:
    """128 map rows as text, the form a CSV file gives; ids 120..127 are ground."""
    return spark.range(128).select(
        F.expr("cast(id div 32 as int)").alias("chipNo"),
        F.expr("cast(id % 32 as int)").alias("chipChannel"),
        F.col("id").cast("int").alias("readoutID"),
        F.expr("case when id >= 120 then 'G' else cast((id * 7) % 120 as string) end").alias("gid"),
    )
