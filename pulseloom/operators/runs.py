"""Assembly of blocks into runs, waveforms and frames. ``pos`` is the position in the stream of a block."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.functions.bits import unpack_flags
from pulseloom.functions.waveform import transpose
from pulseloom.operators.position import BUCKET_ROWS, mark_segments, segment_homes
from pulseloom.session import materialize

NEVER = (1 << 62) - 1
BEFORE = -NEVER


def good_blocks(blocks: DataFrame, size: int = 60) -> DataFrame:
    """Blocks of full size without an error flag."""
    return blocks.filter((F.col("data_block") == size) & (F.col("error_level") == 0))


def opens_run(p: Column, c: Column) -> Column:
    """A block stays in the run of its predecessor with the same chip and a smaller index."""
    return (p["chip"] != c["chip"]) | (c["sample_index"] <= p["sample_index"])


def run_starts(blocks: DataFrame, pos: str = "pos", *, stream: Sequence[str] = (), width: int = BUCKET_ROWS) -> DataFrame:
    """Blocks with ``run_start``, the position of the first block of their run."""
    return mark_segments(blocks, pos, opens_run, ["chip", "sample_index"], stream=stream, width=width, start_name="run_start")


def contiguous_runs(
    blocks: DataFrame,
    pos: str = "pos",
    *,
    stream: Sequence[str] = (),
    timestamp: str = "timestamp",
    width: int = BUCKET_ROWS,
    drop_open_run: bool = False,
) -> DataFrame:
    """One row per run: chip, timestamps, indices and samples as ``[channel][sample]``.

    The index grows strictly inside a run and has one byte, so a run has at most 256 blocks and its arrays are bounded.
    ``drop_open_run`` leaves out the last run of each stream, which no later block has closed. Samples are moved once.
    """
    used = blocks.select(*stream, pos, "chip", "sample_index", timestamp, "samples_value")
    homes = segment_homes(used, pos, opens_run, ["chip", "sample_index"], stream=stream, width=width)
    runs = homes.groupBy(*stream, "_home", F.col("_start.p").alias("run_start")).agg(
        F.min("chip").alias("chip"),
        F.sort_array(F.collect_list(F.struct(pos, F.col(timestamp).alias("t"), "sample_index", "samples_value"))).alias("_b"),
    )
    if drop_open_run:
        last = runs.groupBy(*stream).agg(F.max("run_start").alias("run_start"))
        runs = runs.join(last, [*stream, "run_start"], "left_anti")
    return runs.select(
        *stream,
        "run_start",
        "chip",
        F.col("_b.t").alias("timestamp"),
        F.col("_b.sample_index").alias("sample_index"),
        transpose("_b.samples_value").alias("samples_value"),
    )


def run_events(
    blocks: DataFrame, gap: int = 50, pos: str = "pos", *, stream: Sequence[str] = (), timestamp: str = "timestamp", width: int = BUCKET_ROWS
) -> DataFrame:
    """One row per run: run_start, chip, its first time and the 1-based event_id in its stream.

    A run whose first time is at least ``gap`` ticks away from its predecessor's, before or after it, opens an event.
    Only the first block of each run goes into the second step, and no samples.
    """
    slim = blocks.select(*stream, pos, "chip", "sample_index", F.col(timestamp).alias("t_first"))
    starts = run_starts(slim, pos, stream=stream, width=width).filter(F.col(pos) == F.col("run_start"))
    marked = mark_segments(
        starts.select(*stream, "run_start", "chip", "t_first"), "run_start", lambda p, c: F.abs(c["t_first"] - p["t_first"]) >= gap,
        ["t_first"], stream=stream, width=width, start_name="_event", number_name="event_id",
    )
    return marked.drop("_event")


def chip_runs(
    blocks: DataFrame,
    pos: str = "pos",
    *,
    stream: Sequence[str] = (),
    timestamp: str = "timestamp",
    width: int = BUCKET_ROWS,
    part_blocks: int = 4096,
) -> DataFrame:
    """Older run rule: a run ends where the chip changes; one row per run, part and channel.

    Nothing bounds such a run, so its blocks are cut into parts by dense position (``part_blocks`` each). A run is
    labelled with its own chip and first time. Samples are moved once.
    """
    used = blocks.select(*stream, pos, "chip", timestamp, "samples_value")
    homes = segment_homes(
        used, pos, lambda p, c: p["chip"] != c["chip"], ["chip"], stream=stream, width=width, part=part_blocks, start_using=[timestamp]
    )
    marked = homes.withColumn("run_start", F.col("_start.p"))
    marked = marked.withColumn("part", F.floor((F.col(pos) - F.col("run_start")) / F.lit(part_blocks)).cast("bigint"))
    parts = marked.groupBy(*stream, "_home", "run_start", "part").agg(
        F.min("chip").alias("chip"), F.max(F.col("_start")[timestamp]).alias("_t"),
        F.sort_array(F.collect_list(F.struct(pos, "samples_value"))).alias("_b"),
    )
    wide = parts.select(
        *stream, "run_start", "part", "chip", F.posexplode(transpose("_b.samples_value")).alias("channel", "samples"), F.col("_t").alias("timestamp")
    )
    return wide.withColumn("channel", F.col("channel").cast("bigint"))


def skip_first_runs(runs: DataFrame, n: int = 2, *, stream: Sequence[str] = (), order: str = "run_start") -> DataFrame:
    """Without the first ``n`` runs of every stream (row_number <= n is limited before the shuffle)."""
    w = W.partitionBy(*stream).orderBy(order) if stream else W.partitionBy(F.lit(1)).orderBy(order)
    first = runs.select(*stream, order).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return runs.join(F.broadcast(first) if not stream else first, [*stream, order], "left_anti")


def covering_ends(at: np.ndarray, index: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """For every row the position by which all indices have come, from the row on.

    ``at`` grows, ``index`` is below ``len(behind)``, and ``behind`` has the first position of every index after these rows.
    The window that holds all indices only moves forward at both of its ends, so a row costs the same for 7 indices and
    for 64. Where it does not close inside the rows, the indices that are missing decide by ``behind``.
    """
    last = np.full(len(behind), -1, dtype=np.int64)
    np.maximum.at(last, index, np.arange(len(at)))
    order = np.argsort(last, kind="stable")
    missing = np.searchsorted(last[order], np.arange(len(at)), side="left")
    end = np.maximum.accumulate(behind[order])[np.maximum(missing - 1, 0)]
    held, absent, to, which = [0] * len(behind), len(behind), 0, index.tolist()
    for row in range(int(last.min()) + 1):
        while absent:
            held[which[to]] += 1
            absent -= held[which[to]] == 1
            to += 1
        end[row] = at[to - 1]
        held[which[row]] -= 1
        absent += held[which[row]] == 0
    return end


def zone_steps(at: np.ndarray, index: np.ndarray, n_samples: int) -> dict[str, np.ndarray]:
    """What a zone does to a chain of frames, whichever frame comes in.

    ``next`` is the row behind the frame that starts at a row, -1 where that frame is still open at the end of the zone;
    ``first`` and ``last`` are the positions of every index. A frame that comes in can only close where an index occurs for the first
    time, so few entries are possible: ``after`` has for each index the start of the frame that is open at the end of the zone
    if the one before closes at the first block of that index, and in front of these the one if a frame starts with the zone.
    """
    rows = np.arange(len(at))
    first, last = np.full(n_samples, NEVER), np.full(n_samples, BEFORE)
    np.minimum.at(first, index, at)
    np.maximum.at(last, index, at)
    end = covering_ends(at, index, np.full(n_samples, NEVER))
    behind = np.where(end == NEVER, -1, np.searchsorted(at, end, side="right"))
    # pointer doubling up to the frame that stays open, or to the end of the zone
    to = np.append(np.where(behind < 0, rows, behind), len(at))
    while not np.array_equal(to, further := to[to]):
        to = further
    starts = np.append(at, NEVER)
    entries = np.append(0, np.searchsorted(at, first, side="right"))
    return {"next": behind, "first": first, "last": last, "after": starts[to[entries]]}


def zone_leads(first: np.ndarray, last: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the zones of a stream in order: start and end of the frame that comes in (``BEFORE``: none), end of the one that starts in the zone
    and leaves it open, and the first position of every index behind the zone. An end that never comes is ``NEVER``."""
    n = len(first)
    start, end, leaves = np.full(n, BEFORE), np.full(n, BEFORE), np.full(n, NEVER)
    behind = np.full_like(first, NEVER)
    behind[:-1] = np.minimum.accumulate(first[::-1], axis=0)[::-1][1:]
    opened, missing, since = BEFORE, None, 0  # the open frame, its missing indices and the zone in which it started
    for z in range(n):
        nxt = after[z, 0]
        if opened != BEFORE:
            start[z], end[z] = opened, NEVER
            closing = int(np.argmax(np.where(missing, first[z], BEFORE)))
            if first[z, closing] == NEVER:
                missing = missing & (first[z] == NEVER)
                continue
            end[since + 1 : z + 1] = first[z, closing]
            leaves[since] = first[z, closing]
            nxt = after[z, closing + 1]
        opened, since = (BEFORE if nxt == NEVER else nxt), z
        missing = last[z] < opened
    return start, end, leaves, behind


def zone_members(
    at: np.ndarray, index: np.ndarray, nxt: np.ndarray, start: int, end: int, leaves: int, behind: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the blocks of a zone that are the last of their index in a complete frame, with start and end of that frame."""
    row = int(np.searchsorted(at, end, side="right"))
    opening, closed = [], []
    while 0 <= row < len(at):
        opening.append(row)
        row = int(nxt[row])
        closed.append(leaves if row < 0 else at[row - 1])
    frame = np.searchsorted(np.asarray(opening, dtype=np.int64), np.arange(len(at)), side="right")
    starts, ends = np.append(start, at[opening]), np.append(end, np.asarray(closed, dtype=np.int64))
    order = np.argsort(index, kind="stable")
    again = (index[order][1:] == index[order][:-1]) & (frame[order][1:] == frame[order][:-1])
    kept = np.empty(len(at), dtype=bool)
    kept[order] = np.append(~again, True)
    # the last block of an index in this zone may be replaced by one of a later zone
    kept &= (ends[frame] < NEVER) & (behind[index] > ends[frame])
    return at[kept], starts[frame[kept]], ends[frame[kept]]


def frame_members(
    blocks: DataFrame, pos: str = "pos", *, stream: Sequence[str] = ("chip",), n_samples: int = 64, zone: int = 1 << 18
) -> DataFrame:
    """The blocks that fill complete frames: stream, ``pos``, frame_start and frame_end; no samples are read.

    Every zone is read once and leaves one row: its positions, indices and steps as bytes, and three numbers per index. The numbers
    alone pass through the step over the zones of a stream; then each zone marks its blocks.
    """
    keys = [*stream, "_zone"]
    slim = blocks.filter(F.col("sample_index").between(0, n_samples - 1)).select(
        *stream, F.floor(F.col(pos) / F.lit(zone)).cast("bigint").alias("_zone"), F.col(pos).cast("bigint").alias("_pos"),
        F.col("sample_index").cast("bigint").alias("_i"),
    )
    of = [next(f for f in slim.schema if f.name == k) for k in keys]
    numbers, packed, long = T.ArrayType(T.LongType()), T.BinaryType(), T.LongType()

    def schema(**more: T.DataType) -> T.StructType:
        return T.StructType([*of, *[T.StructField(name, kind) for name, kind in more.items()]])

    def table(key: tuple, columns: dict) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, **{k: [v] for k, v in columns.items()}})

    def steps(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos")
        at, index = rows["_pos"].to_numpy(), rows["_i"].to_numpy()
        got = zone_steps(at, index, n_samples)
        got["next"] = got["next"].astype(np.int32).tobytes()
        return table(key, {"at": at.tobytes(), "index": index.astype(np.int32).tobytes(), **got})

    def leads(zones: pd.DataFrame) -> pd.DataFrame:
        zones = zones.sort_values("_zone")
        start, end, leaves, behind = zone_leads(*[np.stack(zones[c].to_list()) for c in ("first", "last", "after")])
        return zones[keys].assign(start=start, end=end, leaves=leaves, behind=list(behind))

    def members(key: tuple, zone_row: pd.DataFrame, lead: pd.DataFrame) -> pd.DataFrame:
        z, lead = zone_row.iloc[0], lead.iloc[0]
        at, index, nxt = [np.frombuffer(z[c], dtype=kind) for c, kind in (("at", np.int64), ("index", np.int32), ("next", np.int32))]
        kept, start, end = zone_members(at, index, nxt, lead["start"], lead["end"], lead["leaves"], np.asarray(lead["behind"]))
        got = pd.DataFrame({"_pos": kept, "frame_start": start, "frame_end": end})
        return got.assign(**dict(zip(keys, key)))[[*keys, "_pos", "frame_start", "frame_end"]]

    summed = slim.groupBy(*keys).applyInPandas(steps, schema(at=packed, index=packed, next=packed, first=numbers, last=numbers, after=numbers))
    # a row has up to some MB; by default the writer looks at its memory only after a hundred rows
    zones = materialize(summed, **{f"parquet.{unit}.size.row.check.min": "1" for unit in ("page", "block")})
    small = zones.select(*keys, "first", "last", "after")
    lead = small.groupBy(*(stream or [F.lit(0).alias("_all")])).applyInPandas(leads, schema(start=long, end=long, leaves=long, behind=numbers))
    marked = zones.groupBy(*keys).cogroup(lead.groupBy(*keys)).applyInPandas(members, schema(_pos=long, frame_start=long, frame_end=long))
    return marked.select(*stream, F.col("_pos").alias(pos), "frame_start", "frame_end")


def complete_frames(
    blocks: DataFrame,
    pos: str = "pos",
    *,
    stream: Sequence[str] = ("chip",),
    n_samples: int = 64,
    zone: int = 1 << 18,
) -> DataFrame:
    """Frames ``[channel][sample]``: blocks are gathered until every index below ``n_samples`` has been seen.

    A later block with the same index replaces the earlier one; then the next frame starts. The end of the frame that
    would start at a block is the largest "next occurrence" over all indices, so the true frames are a greedy chain.
    Which blocks fill frames is worked out without samples; samples are moved once to meet these, and only those that stay go
    on to their frame.
    """
    stream = list(stream)
    members = frame_members(blocks, pos, stream=stream, n_samples=n_samples, zone=zone)
    held = blocks.select(*stream, pos, "sample_index", "samples_value").join(members, [*stream, pos])
    frames = held.groupBy(*stream, "frame_start", "frame_end").agg(
        F.sort_array(F.collect_list(F.struct("sample_index", F.col("samples_value").alias("v")))).alias("_b")
    )
    return frames.select(*stream, "frame_start", "frame_end", transpose("_b.v").alias("samples_value"))


def block_quality(blocks: DataFrame, good_size: int = 60) -> DataFrame:
    """Share of every error level in percent, with the share of blocks of good size (same on every row)."""
    per = blocks.groupBy("error_level").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("data_block") == good_size).alias("n_good")
    )
    # at most 32 levels, so the unpartitioned totals are over a bounded table
    everything = W.partitionBy()
    return per.select(
        "error_level",
        "n",
        (F.lit(100.0) * F.col("n") / F.sum("n").over(everything)).alias("rate"),
        (F.lit(100.0) * F.sum("n_good").over(everything) / F.sum("n").over(everything)).alias("good_rate"),
        unpack_flags(F.col("error_level")).alias("flags"),
    )
