"""Live event grouping over arriving pulses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulseloom.operators.sessions import gap_events
from pulseloom.session import materialize


def live_gap_events(stream: DataFrame, time: str, gap: str, keys: Sequence[str], *, late: str = "10 minutes") -> DataFrame:
    """Pulses and charge per gap session of a stream with a timestamp column, for every key (e.g. the run).

    A step equal to the gap stays in the session, as in the batch form. State is one row per open session and a session
    is emitted once the watermark has passed it; ``end_of_stream`` rows, sent last, close what is still open. With few keys set
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` so that pulses of a session are merged
    before the shuffle and a busy key ships one row per session and task.
    """
    return (
        stream.withWatermark(time, late)
        .groupBy(*keys, F.session_window(F.col(time), gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n_pulses"), F.sum("charge").alias("charge"), F.min(time).alias("t_first"), F.max(time).alias("t_last"))
    )


def end_of_stream(pulses: DataFrame, time: str, gap: str, keys: Sequence[str], *, late: str = "10 minutes") -> DataFrame:
    """One row per key that lies so far behind the last pulse that every session before it is closed.

    Its own session stays open and is never written. Columns other than the time and the keys are null.
    """
    last = pulses.groupBy(*keys).agg(F.max(F.max(time)).over(W.partitionBy(F.lit(1))).alias(time)).filter(F.col(time).isNotNull())
    far = F.col(time) + F.expr(f"interval {gap}") + F.expr(f"interval {late}") + F.expr("interval 1 second")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in pulses.schema if f.name not in (time, *keys)]
    return last.select(*keys, far.alias(time), *rest).select(*pulses.columns)


def start_global_sessions(
    stream: DataFrame, time: str, gap_seconds: int, target: str, *, late: str = "10 minutes", progress: str | None = None, charge: str = "charge"
) -> StreamingQuery:
    """Pulses and charge per gap session over all channels of a stream, written below ``target``; see ``global_sessions``.

    Two states follow each other. The first is a windowed aggregate: two times in one slot as wide as the gap always share
    a session, so pulses are combined to one row per slot and task before anything is shuffled, and no key is constant or
    holds a session. Slots that the watermark has passed are stitched batch by batch with the batch operator. Behind the
    last slot of a batch at most one session can still grow; it is the second state, one row per batch.

    Closed sessions and the open one are written under the number of the batch, so a repeated batch overwrites its own
    output. A step equal to the gap stays in the session, as in the batch form. Null times are left out.
    """
    spark = stream.sparkSession
    slots = (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, f"{gap_seconds} seconds").alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(charge).alias("charge"), F.min(time).alias("lo"), F.max(time).alias("hi"))
        .select("n", "charge", F.unix_micros("lo").alias("lo"), F.unix_micros("hi").alias("hi"))
    )

    def stitch(batch: DataFrame, number: int) -> None:
        # The first and the last time of a slot link it; what it holds counts at the first.
        ends = F.array(F.struct(F.col("lo").alias("t"), "lo", "n", "charge"), F.struct(F.col("hi").alias("t"), "lo", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(batch.schema["charge"].dataType).alias("charge")))
        rows = batch.select(F.inline(ends))
        if number > 0:
            before = spark.read.parquet(f"{target}/open/batch={number - 1}")
            rows = rows.unionByName(before.select(F.col("t_last").alias("t"), F.col("t_first").alias("lo"), F.col("n_pulses").alias("n"), "charge"))
        found = gap_events(rows, "t", gap_seconds * 1_000_000).groupBy("event_id").agg(
            F.sum("n").alias("n_pulses"), F.sum("charge").cast(batch.schema["charge"].dataType).alias("charge"), F.min("lo").alias("t_first"), F.max("t").alias("t_last")
        )
        found = materialize(found)
        last = found.agg(F.max("t_last")).first()[0]
        is_open = F.col("t_last") == F.lit(last).cast("bigint")
        for part, which in (("closed", ~is_open), ("open", is_open)):
            found.filter(which).select("n_pulses", "charge", "t_first", "t_last").coalesce(1 if part == "open" else 8).write.mode("overwrite").parquet(f"{target}/{part}/batch={number}")

    writer = slots.writeStream.outputMode("append").foreachBatch(stitch)
    return writer.option("checkpointLocation", progress or f"{target}/progress").trigger(availableNow=True).start()


def global_sessions(spark: SparkSession, target: str, *, with_open: bool = False) -> DataFrame:
    """Sessions (n_pulses, charge, t_first, t_last in microseconds) that ``start_global_sessions`` has closed so far.

    ``with_open`` adds the session that could still grow, once, as its latest batch left it; use it behind the end of a stream.
    """
    closed = spark.read.parquet(f"{target}/closed")
    if with_open:
        held = spark.read.parquet(f"{target}/open")
        latest = held.agg(F.max("batch").alias("batch"))
        closed = closed.unionByName(held.join(F.broadcast(latest), "batch").select(*closed.columns))
    return closed.drop("batch")
