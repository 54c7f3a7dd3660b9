"""Queries over byte streams, board files and streams; every input is derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom import fixtures as fx
from pulseloom import schemas
from pulseloom.catalog.common import FX_EVENT, FX_MAP, FX_PULSE, csv, with_views
from pulseloom.operators import dims
from pulseloom.session import scratch_path
from pulseloom.sources import tables
from pulseloom.sources.block_stream import Format, read_blocks, write_blocks
from pulseloom.streaming.sessions import end_of_stream, global_sessions, live_gap_events, start_global_sessions

QUERIES = {}
ORACLE = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn

    return add


TICKS = "l_orderkey * 1000 + l_linenumber * 32"


def encoded(spark, d, gap: bytes = b"", ticks: str = TICKS, **more) -> str:
    """Byte streams of all blocks of the block view, below a new scratch folder."""
    b = fx.blocks(spark, d).drop("samples_value").withColumn("timestamp", F.expr(ticks))
    path = scratch_path(spark, "blocks")
    write_blocks(b, path, "run", fx.BLOCK_ORDER[1:], **{"samples": fx.SAMPLES, "gap": gap, **more})
    return path


def damaged(body):
    """By order and line: blocks without footer, blocks cut off at 47 bytes, whole blocks."""
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    lost = F.unhex(F.concat(F.substring(F.hex(body), 1, 112), F.lit("0000"), F.substring(F.hex(body), 117, 4)))
    return F.when(kind == 3, lost).when(kind == 5, F.substring(body, 1, 47)).otherwise(body)


# What is left of a file whose last block has lost its end: one more header, and bytes that complete what is before it.
OPEN_END = b"\xaf\xaf" + b"\0" * 64


BLOCK_ROWS = """with b as (select (l_orderkey // 16) % 4 chip, cast(l_linenumber as bigint) sample_index, l_orderkey * 1000 + l_linenumber * 32 ts,
  list_transform(range(32), lambda ch: (l_partkey * 7 + ch * 31 + l_linenumber * 101) % 1024) v from lineitem)
"""
ROW = """chip, sample_index, ts "timestamp", array_to_string(v, ',') samples, count(*) n from b group by all"""


def rows(blocks):
    # which file a block lands in follows the shuffle, so the check is on the blocks themselves
    return blocks.groupBy("data_block", "error_level", "chip", "sample_index", "timestamp", csv("samples_value").alias("samples")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("raw_blocks", BLOCK_ROWS + "select cast(60 as bigint) data_block, cast(0 as bigint) error_level, " + ROW)
def raw_blocks(spark, d):
    return rows(read_blocks(spark, encoded(spark, d, gap=b"\0"), range_bytes=1 << 20))


@query(
    "raw_blocks_damaged",
    BLOCK_ROWS.replace("% 1024", "% 256").replace(" from lineitem", ", (l_orderkey + l_linenumber) % 7 kind from lineitem") + """
    select cast(case kind when 5 then 47 else 60 end as bigint) data_block, cast(case kind when 3 then 16 when 5 then 17 else 0 end as bigint) error_level,
      chip, sample_index, ts "timestamp", case when kind not in (3, 5) then array_to_string(v, ',') end samples, count(*) n from b group by all""",
)
def raw_blocks_damaged(spark, d):
    """Streams in which blocks have lost their footer or their end: these end at the next header."""
    # samples of eight bits, so that no marker arises in them by chance
    path = encoded(spark, d, samples=fx.SAMPLES.replace("% 1024", "% 256"), alter=damaged, tail=OPEN_END)
    # the clock takes any value, so a header inside an intact head is one of its words
    return rows(read_blocks(spark, path, Format(whole_heads=True), range_bytes=1 << 20))


@query(
    "header_blocks",
    """with b as (select (l_orderkey // 16) % 4 chip, cast(l_linenumber as bigint) sample_index, l_orderkey * 4096 + l_linenumber * 8 ts,
      (l_orderkey + l_linenumber) % 7 kind from lineitem)
    select cast(case kind when 5 then 47 else 60 end as bigint) data_block, cast(case when kind in (3, 5) then 16 else 0 end as bigint) error_level,
      cast(case when kind in (3, 5) then 1 else 0 end as bigint) n_missing, chip, sample_index, ts "timestamp", count(*) n from b group by all""",
)
def header_blocks(spark, d):
    """The same streams cut from header to header, with the marks that each block lacks."""
    # Samples in which no header arises by chance, at any bit shift; the clock takes any value.
    path = encoded(spark, d, ticks="l_orderkey * 4096 + l_linenumber * 8", samples="array_repeat(0, 32)", alter=damaged, tail=OPEN_END)
    found = read_blocks(spark, path, Format(layout="headers", whole_heads=True), range_bytes=1 << 20)
    missing = F.bit_count("error_level").cast("bigint").alias("n_missing")
    return found.groupBy("data_block", "error_level", missing, "chip", "sample_index", "timestamp").agg(F.count(F.lit(1)).alias("n"))


@query("raw_blocks_fixed", BLOCK_ROWS + "select cast(58 as bigint) data_block, cast(0 as bigint) error_level, " + ROW)
def raw_blocks_fixed(spark, d):
    # the 58 bytes up to and with the footer are the fixed layout; the echo behind it is skipped byte by byte
    return rows(read_blocks(spark, encoded(spark, d), Format(layout="fixed58"), range_bytes=1 << 20))


@query("netlist_pins", """select p_partkey % 64 number, case when p_partkey % 2 = 0 then 'IN' else 'OUT' end kind, concat('J', p_size) part,
  cast(p_partkey % 10 as varchar) pin, count(*) n from part where p_partkey % 3 <> 2 group by all""")
def netlist_pins(spark, d):
    """Net elements as XML text, one per part; nets of other names and pins of other parts are left out."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "IN").otherwise("OUT"), F.lit("$"), F.col("p_partkey") % 64)
    other = F.col("p_partkey") % 3 == 2
    xml = F.concat(
        F.lit('<net name="'), F.when(other, F.lit("GND")).otherwise(name), F.lit('"><segment><pinref part="J'), F.col("p_size"),
        F.lit('" gate="A" pin="'), F.col("p_partkey") % 10, F.lit('"/><pinref part="R1" gate="B" pin="1"/></segment></net>'),
    )
    nets = fx.table(spark, d, "part").select(F.from_xml(xml, schemas.NET).alias("net")).select("net.*")
    pins = tables.netlist_pins(nets)
    return pins.groupBy("number", "kind", "part", "pin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "map_from_csv",
    with_views(FX_PULSE, FX_MAP) + """select tpc_id, count(*) n_pulses, cast(sum(charge) as bigint) charge
      from fx_pulse left join fx_map_gid on map_id = gch group by tpc_id""",
)
def map_from_csv(spark, d):
    """Pulses joined to a channel map that is read from CSV text, ground rows included."""
    path = scratch_path(spark, "map")
    p = fx.pulses(spark, d)
    used = fx.channel_map_rows(spark).join(p.select(F.col("gch").alias("readoutID")).distinct(), "readoutID", "left_semi")
    text = used.select("chipNo", "chipChannel", "readoutID", F.lit("").alias("tpcID"), F.lit("").alias("padID"), "gid")
    text.write.option("header", True).csv(path)
    mapped = dims.join_map(p, dims.channel_map(tables.read_channel_map(spark, path)), "gch")
    return mapped.groupBy("tpc_id").agg(F.count(F.lit(1)).alias("n_pulses"), F.sum("charge").alias("charge"))


@query(
    "stream_event_gap",
    with_views(FX_PULSE).rstrip() + """, f as (select *, case when lag(t_us) over o is null or t_us - lag(t_us) over o > 300000000 then 1 else 0 end f
      from fx_pulse window o as (partition by chip order by t_us, pulse_no)),
    e as (select *, sum(f) over (partition by chip order by t_us, pulse_no rows unbounded preceding) session from f)
    select chip, count(*) n_pulses, cast(sum(charge) as bigint) charge, min(t_us) t_first, max(t_us) t_last from e group by chip, session""",
)
def stream_event_gap(spark, d):
    """All pulses as a file stream, run to its end, sessions per chip."""
    source = scratch_path(spark, "arrivals")
    p = fx.pulses(spark, d).select(F.timestamp_micros(F.col("t_us")).alias("ts"), "charge", "chip")
    p.unionByName(end_of_stream(p, "ts", "300 seconds", ["chip"])).write.parquet(source)
    stream = spark.readStream.schema(p.schema).parquet(source)
    target = scratch_path(spark, "sessions")
    run = (
        live_gap_events(stream, "ts", "300 seconds", ["chip"])
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", scratch_path(spark, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    done = spark.read.parquet(target)
    return done.select("chip", "n_pulses", "charge", F.unix_micros("t_first").alias("t_first"), F.unix_micros("t_last").alias("t_last"))


@query(
    "stream_global_sessions",
    with_views(FX_EVENT) + """select count(*) n_pulses, cast(sum(charge) as bigint) charge, min(t_us) t_first, max(t_us) t_last
      from fx_event group by event_id""",
)
def stream_global_sessions(spark, d):
    """All pulses as a file stream, run to its end, sessions over all chips; the end is a row that opens one more slot."""
    source, target = scratch_path(spark, "arrivals"), scratch_path(spark, "sessions")
    p = fx.pulses(spark, d).select(F.timestamp_micros(F.col("t_us")).alias("ts"), "charge")
    p.unionByName(end_of_stream(p, "ts", "300 seconds", [])).write.parquet(source)
    start_global_sessions(spark.readStream.schema(p.schema).parquet(source), "ts", 300, target).awaitTermination()
    return global_sessions(spark, target, with_open=True).select("n_pulses", "charge", "t_first", "t_last")
