"""Readers, writers and the live form of event grouping."""

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulseloom.operators import dims
from pulseloom.session import materialize, scratch_path, shared_folder
from pulseloom.sources import tables
from pulseloom.streaming.sessions import live_gap_events


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="run-"))


def test_netlist(spark, folder):
    (folder / "board.sch").write_text(
        """<board><nets>
        <net name="IN$1"><segment><pinref part="J1" gate="A" pin="3"/><pinref part="R4" gate="A" pin="1"/></segment>
          <segment><pinref part="J22" gate="B" pin="9"/></segment></net>
        <net name="OUT$1"><segment><wire x="1"/></segment></net>
        <net name="OUT$12"><segment><pinref part="J2" gate="A" pin="P$7"/></segment></net>
        <net name="GND"><segment><pinref part="J3" gate="A" pin="1"/></segment></net>
        </nets></board>"""
    )
    pins = tables.netlist_pins(tables.read_netlist(spark, str(folder / "board.sch")))
    assert sorted(map(tuple, pins.collect())) == [(1, "IN", "J1", "3"), (1, "IN", "J22", "9"), (12, "OUT", "J2", "P$7")]


def test_channel_map_csv(spark, folder):
    f = folder / "map.csv"
    f.write_text("# wiring of May\na,b,c,d,e,f\n0,0,0,1,3,17\n0,1,1,GND,GND,G\n0,2,2,2,60,x\n")
    raw = tables.read_channel_map(spark, str(f), comment="#")
    assert sorted(map(tuple, dims.channel_map(raw).collect())) == [(0, 17), (1, -1), (2, -1)]
    assert sorted(map(tuple, dims.channel_map_legacy(raw).collect())) == [(0, 2), (2, 119)]


def test_write_and_read_pulses(spark, folder):
    df = spark.range(25).select(
        F.col("id").alias("chip"), F.lit(1).cast("bigint").alias("channel"), F.lit(0.5).alias("t0_ms"),
        *[F.array(F.col("id")).alias(c) for c in ("pulse", "pulse_index", "pulse_timestamp")],
    )
    path = str(folder / "pulses")
    tables.write_table(df.coalesce(1), path, rows_per_file=10)
    assert len(list(Path(path).glob("*.zstd.parquet"))) == 3
    back = tables.read_pulses(spark, path)
    assert back.count() == 25 and tables.preview(back, 4).count() == 4


def test_cluster_without_shared_folder_is_an_error(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    kept = materialize(spark.range(5).select("id", F.array("id").alias("a")))
    assert [tuple(r) for r in kept.orderBy("id").collect()] == [(i, [i]) for i in range(5)]


def test_live_sessions(spark, folder):
    rows = [(0, 1, 5), (0, 11, 6), (0, 22, 7), (1, 3, 1), (0, 500, 9)]
    src = str(folder / "in")
    spark.createDataFrame(rows, "run int, s int, charge bigint").select("run", F.timestamp_seconds("s").alias("ts"), "charge").write.parquet(src)
    stream = spark.readStream.schema("run int, ts timestamp, charge bigint").parquet(src)
    run = (
        live_gap_events(stream, "ts", "10 seconds", ["run"], late="20 seconds")
        .writeStream.outputMode("append").format("memory").queryName("sessions_seen")
        .option("checkpointLocation", str(folder / "progress")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    got = spark.table("sessions_seen").select("run", "n_pulses", "charge").collect()
    # a step of exactly the gap stays; the last session is still open
    assert sorted(map(tuple, got)) == [(0, 1, 7), (0, 2, 11), (1, 1, 1)]
