"""Table readers and writers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom import schemas


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RAW).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUNS).parquet(path)


def read_pulses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PULSES).parquet(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HITS).parquet(path)


def read_channel_map(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """CSV channel map with header; ground rows carry text, so everything that may be no number is read as text."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schemas.CHANNEL_MAP)
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def write_table(df: DataFrame, path: str, *, rows_per_file: int | None = None, rows_per_group: int | None = None, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Zstd Parquet; ``rows_per_file`` and ``rows_per_group`` limit single files and the row groups in them."""
    w = df.write.mode(mode).option("compression", "zstd")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    if rows_per_group:
        w = w.option("parquet.block.row.count.limit", rows_per_group)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def read_netlist(spark: SparkSession, path: str) -> DataFrame:
    """Nets of an XML board file, one row per net element."""
    return spark.read.format("xml").option("rowTag", "net").schema(schemas.NET).load(path)


def netlist_pins(nets: DataFrame) -> DataFrame:
    """(number, kind, part, pin) of the connector pins (parts J<n>) on nets named IN$<n> or OUT$<n>.

    ``nets`` has a name and, per segment, the pin references.
    """
    pattern = r"^(IN|OUT)\$(\d+)$"
    named = nets.select(
        F.regexp_extract("_name", pattern, 1).alias("kind"),
        F.regexp_extract("_name", pattern, 2).alias("digits"),
        F.flatten(F.transform("segment", lambda s: F.coalesce(s["pinref"], F.array().cast(schemas.PINREFS)))).alias("refs"),
    ).filter("kind <> ''")
    pins = named.select(F.col("digits").cast("bigint").alias("number"), "kind", F.inline("refs"))
    return pins.filter(F.col("_part").rlike(r"^J\d+$")).select("number", "kind", F.col("_part").alias("part"), F.col("_pin").alias("pin"))
