"""Anchored events along the order of a file, where a step back in time opens an event too."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.operators.chain import follow
from pulseloom.operators.position import mark_segments
from pulseloom.session import materialize

NEVER = (1 << 62) - 1
ZONE_ROWS = 1 << 17  # positions that one group of Python holds; the tree of a zone takes about 300 bytes for each
FAN = 32  # buckets, or groups of them, whose smallest and largest times one row of the search tree holds


def first_far(t: np.ndarray, at: np.ndarray, value: np.ndarray, threshold: float) -> np.ndarray:
    """For every (at, value): the first index >= at whose time is further than ``threshold`` from value; len(t) if none.

    Minima and maxima over blocks of 2^k times; a search passes the largest block that holds no far time.
    """
    n = len(t)
    lows, highs = [t], [t]
    while (1 << len(lows)) <= n:
        k = 1 << (len(lows) - 1)
        lows.append(np.minimum(lows[-1][:-k], lows[-1][k:]))
        highs.append(np.maximum(highs[-1][:-k], highs[-1][k:]))
    pos = at.copy()
    for k in reversed(range(len(lows))):
        i = np.minimum(pos, max(len(lows[k]) - 1, 0))
        near = (pos < len(lows[k])) & (value - lows[k][i] <= threshold) & (highs[k][i] - value <= threshold)
        pos = np.where(near, pos + (1 << k), pos)
    return pos


def next_far(rows: DataFrame, pos: str, time: str, threshold: float, *, stream: Sequence[str] = (), width: int = ZONE_ROWS) -> DataFrame:
    """(stream.., pos, far): position of the first later row whose time is further away than ``threshold``; NEVER if there is none.

    Positions are dense. Every bucket of ``width`` positions answers its own rows. What it leaves open looks for its bucket
    in a tree of smallest and largest times, up and down again, in about two rounds for every factor of FAN in the number
    of buckets, and is answered there. A stretch without a far time costs no more rounds than that, however long.
    """
    keys = [*stream, "_b"]
    slim = rows.select(*stream, F.col(pos).cast("bigint").alias("_p"), F.col(time).alias("_t"), F.floor(F.col(pos) / width).cast("bigint").alias("_b"))
    slim = materialize(slim)
    fields = [slim.schema[k] for k in keys]
    schema = T.StructType([*fields, slim.schema["_p"], slim.schema["_t"], T.StructField("_far", T.LongType())])
    columns = schema.names

    def answer(key: tuple, own: pd.DataFrame, asked: pd.DataFrame, offset: int) -> pd.DataFrame:
        own = own.sort_values("_p")
        t = own["_t"].to_numpy()
        start = np.zeros(len(asked), np.int64) if offset is None else asked["_p"].to_numpy() - own["_p"].iloc[0] + offset
        at = first_far(t, start, asked["_t"].to_numpy(), threshold)
        out = asked[["_p", "_t"]].copy()
        out["_far"] = pd.array(np.where(at < len(t), own["_p"].to_numpy()[np.minimum(at, len(t) - 1)], -1), dtype="Int64")
        for k, v in zip(keys, key):
            out[k] = v
        return out[columns]

    def inside(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_p")
        return answer(key, own, own, 1)

    def later(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return answer(key, own, asked, None) if len(asked) else pd.DataFrame(columns=columns)

    found = materialize(slim.groupBy(*keys).applyInPandas(inside, schema))
    done = found.filter("_far >= 0").select(*stream, F.col("_p").alias(pos), F.col("_far").alias("far"))
    left = found.filter("_far < 0")
    if left.isEmpty():
        return done
    asked = far_buckets(slim, left, threshold, stream)
    never = asked.filter("_b is null").select(*stream, F.col("_p").alias(pos), F.lit(NEVER).alias("far"))
    asked = asked.filter("_b is not null").withColumn("_far", F.lit(None).cast("bigint")).select(*columns)
    ahead = slim.join(asked.select(*keys).distinct(), keys, "left_semi")
    last = materialize(ahead.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(later, schema))
    return done.unionByName(never).unionByName(last.select(*stream, F.col("_p").alias(pos), F.col("_far").alias("far")))


def far_buckets(slim: DataFrame, left: DataFrame, threshold: float, stream: list[str]) -> DataFrame:
    """(stream.., _p, _t, _b): the first bucket behind ``_b`` with a time further than ``threshold`` from ``_t``, null if none.

    A row of the tree holds FAN children, (smallest, largest) time each; level 0 has the buckets as children.
    """
    low_high = [F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")]
    part = slim.groupBy(*stream, F.col("_b").alias("_i")).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    tree, level = None, 0
    while True:
        kid = F.struct((F.col("_i") % FAN).alias("c"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
        up = materialize(part.groupBy(*stream, F.floor(F.col("_i") / FAN).alias("_i")).agg(F.array_sort(F.collect_list(kid)).alias("_kids"), *low_high))
        rows = up.select(*stream, F.lit(level).alias("_level"), F.col("_i").alias("_node"), "_kids")
        tree = rows if tree is None else tree.unionByName(rows)
        if up.filter("_i > 0").isEmpty():
            break
        part, level = up.drop("_kids"), level + 1
    to = F.col("_b") + 1
    state = [F.lit(0).alias("_level"), F.floor(to / FAN).alias("_node"), (to % FAN).alias("_from")]
    open_, ended = left.select(*stream, "_p", "_t", *state), None
    while True:
        far = lambda k: (k["c"] >= F.col("_from")) & ((F.col("_t") - k["lo"] > threshold) | (k["hi"] - F.col("_t") > threshold))
        seen = open_.join(tree, [*stream, "_level", "_node"], "left").withColumn("_c", F.get(F.filter("_kids", far), F.lit(0))["c"])
        hit, child = F.col("_c").isNotNull(), F.col("_node") * FAN + F.col("_c")
        seen = materialize(seen.select(
            *stream, "_p", "_t", (hit & (F.col("_level") == 0)).alias("_found"), (~hit & (F.col("_level") == level)).alias("_none"), child.alias("_b"),
            F.when(hit, F.col("_level") - 1).otherwise(F.col("_level") + 1).alias("_level"),
            F.when(hit, child).otherwise(F.floor(F.col("_node") / FAN)).alias("_node"),
            F.when(hit, F.lit(0)).otherwise(F.col("_node") % FAN + 1).cast("bigint").alias("_from"),
        ))
        over = seen.filter("_found or _none").select(*stream, "_p", "_t", F.when(F.col("_found"), F.col("_b")).alias("_b"))
        ended = over if ended is None else ended.unionByName(over)
        open_ = seen.filter("not (_found or _none)").select(*stream, "_p", "_t", "_level", "_node", "_from")
        if open_.isEmpty():
            return ended


def anchor_events_in_order(
    df: DataFrame, pos: str, time: str, threshold: float, *, stream: Sequence[str] = (), width: int = ZONE_ROWS
) -> DataFrame:
    """All rows with ``event_id`` (1-based per stream): along ``pos``, a row further than ``threshold`` from the time of its
    event's first row, before or after, opens the next event.

    ``pos`` is dense within a stream and times are not null. The sequential rule is a greedy chain over positions.
    """
    stream = list(stream)
    far = next_far(df, pos, time, threshold, stream=stream, width=width)
    nodes = far.select(*stream, pos, (F.col("far") - 1).alias("_limit"))
    chain = follow(nodes, pos, "_limit", width, stream=stream).select(*stream, pos, F.lit(True).alias("_anchor"))
    marked = df.join(materialize(chain), [*stream, pos], "left").withColumn("_anchor", F.coalesce("_anchor", F.lit(False)))
    out = mark_segments(marked, pos, lambda p, c: c["_anchor"], ["_anchor"], stream=stream, width=width, number_name="event_id")
    return out.drop("_anchor", "segment")
