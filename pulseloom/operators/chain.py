"""Greedy chains: follow "the first element beyond a limit that the current element sets".

Anchored events (next anchor = first time more than a threshold after the current one), frame assembly and
block framing in a byte stream all have this form, which is sequential by definition. Here it runs in parallel:

1. The coordinate axis is cut into zones. Inside a zone the way through it is worked out for every element at which
   a chain may enter, in one task per zone. Chains merge quickly, so the result is a short step function
   "incoming limit -> outgoing limit".
2. The step functions are composed, first inside groups of zones (in parallel), then over the groups.
3. Every zone learns its incoming limit and marks the elements on the one true chain.

Only step functions, never elements, pass through the tasks of step 2.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.session import materialize

GROUP_ZONES = 1024


def step_function(c: np.ndarray, limit: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(upto, out): an incoming limit x enters at the first element > x, so at the first run with upto > x.

    ``c`` is sorted, ``limit[i] >= c[i]`` is what element i sets, and no incoming limit is larger than ``reach``.
    """
    n = len(c)
    last = min(n - 1, int(np.searchsorted(c, reach, side="right")))
    nxt = np.searchsorted(c, limit, side="right")
    # pointer doubling: end[i] is the last element of the chain that starts at i
    end = np.arange(n)
    jump = np.append(nxt, n)
    while True:
        active = jump[:n] < n
        if not active.any():
            break
        end = np.where(active, end[np.minimum(jump[:n], n - 1)], end)
        jump = np.append(jump[jump[:n]], n)
    out = limit[end[: last + 1]]
    close = np.append(out[1:] != out[:-1], True)
    return c[: last + 1][close], out[close]


def enter(upto: np.ndarray, out: np.ndarray, x):
    """Outgoing limit for incoming ``x``; None where the chain passes by (then the next zone is entered at its first element)."""
    i = int(np.searchsorted(upto, x, side="right"))
    return out[i] if i < len(upto) else None


def run_through(zones: list, x):
    """Limits in front of every zone, and behind the last one; ``x`` None means "before everything"."""
    at = []
    for upto, out in zones:
        at.append(x)
        if x is None:
            x = out[0]
        else:
            y = enter(upto, out, x)
            if y is not None:
                x = y
    return at, x


def compose(zones: list) -> tuple[np.ndarray, np.ndarray]:
    """Step function of several zones in a row, worked out from the last zone backwards."""
    upto = np.concatenate([u for u, _ in zones])
    out = np.concatenate([o for _, o in zones])
    end = len(upto)
    for u, _ in reversed(zones):
        start = end - len(u)
        i = np.searchsorted(upto[end:], out[start:end], side="right")
        onward = i < len(upto) - end
        out[start:end] = np.where(onward, out[np.minimum(end + i, len(out) - 1)], out[start:end])
        end = start
    close = np.append(out[1:] != out[:-1], True)
    return upto[close], out[close]


def visited(c: np.ndarray, limit: np.ndarray, x) -> np.ndarray:
    """Indices on the chain that enters with limit ``x`` (None: at the first element)."""
    nxt = np.searchsorted(c, limit, side="right")
    i = 0 if x is None else int(np.searchsorted(c, x, side="right"))
    hits = []
    while i < len(c):
        hits.append(i)
        i = int(nxt[i])
    return np.asarray(hits, dtype=np.int64)


def follow(
    nodes: DataFrame,
    c: str,
    limit: str,
    width: float | None = None,
    *,
    stream: Sequence[str] = (),
    zone: str | None = None,
    max_step: float | None = None,
    members: bool = False,
    group_zones: int = GROUP_ZONES,
) -> DataFrame:
    """The elements on the greedy chain of every stream.

    ``nodes`` has one row per distinct coordinate ``c`` and its ``limit`` (>= c, same type). Returns
    (stream.., c, limit, zone, step) with ``step`` counting the chain elements inside a zone from 0. A zone covers
    ``width`` units of the coordinate, so with integer coordinates it never has more than ``width`` elements; or the column
    ``zone`` names it, as a number that grows with the coordinate. Null streams are streams of their own.
    With ``members`` every element is returned: ``step`` counts the chain elements of its zone up to it (0 in front of
    the first one) and ``start`` is the coordinate of the last of them, meaningful where ``step`` is not 0.
    ``max_step`` is a bound of limit - c where one is known; otherwise the largest limit of earlier zones is looked up.
    """
    stream = list(stream)
    keys = [*stream, "_zone"]
    in_zone = F.col(zone) if zone else F.floor(F.col(c) / F.lit(width))
    nodes = nodes.select(*stream, F.col(c).alias("_c"), F.col(limit).alias("_l"), in_zone.cast("bigint").alias("_zone"))
    over = W.partitionBy(*stream).orderBy("_zone") if stream else W.orderBy("_zone")
    pre = [T.StructField(f.name, f.dataType) for f in nodes.schema if f.name in keys]
    # explicit order: keys first
    pre = [next(f for f in pre if f.name == k) for k in keys]
    num_type = nodes.schema["_c"].dataType
    nk = len(keys)

    def step_of(key: tuple, zone: pd.DataFrame, top) -> pd.DataFrame:
        zone = zone.sort_values("_c")
        a, b = zone["_c"].to_numpy(), zone["_l"].to_numpy()
        upto, out = step_function(a, b, a[0] if top is None or pd.isna(top) else top)
        return pd.DataFrame([[*key, upto, out]], columns=[*keys, "upto", "out"])

    def bounded(key: tuple, zone: pd.DataFrame) -> pd.DataFrame:
        # earlier elements are smaller than the first one here, so their limits are smaller than this
        return step_of(key, zone, zone["_c"].min() + max_step)

    def looked_up(key: tuple, zone: pd.DataFrame, bound: pd.DataFrame) -> pd.DataFrame:
        return step_of(key, zone, bound["_reach"].iloc[0] if len(bound) else None)

    step_schema = T.StructType([*pre, T.StructField("upto", T.ArrayType(num_type)), T.StructField("out", T.ArrayType(num_type))])
    if max_step is not None:
        steps = nodes.groupBy(*keys).applyInPandas(bounded, step_schema)
    else:
        reach = nodes.groupBy(*keys).agg(F.max("_l").alias("_m")).select(
            *keys, F.max("_m").over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_reach")
        )
        steps = nodes.groupBy(*keys).cogroup(reach.toDF(*reach.columns).groupBy(*keys)).applyInPandas(looked_up, step_schema)
    steps = materialize(steps.withColumn("_group", F.floor(F.col("_zone") / F.lit(group_zones)).cast("bigint")))

    def as_zones(pdf: pd.DataFrame) -> list:
        return [(np.asarray(u), np.asarray(o)) for u, o in zip(pdf["upto"], pdf["out"])]

    def of_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        upto, out = compose(as_zones(pdf.sort_values("_zone")))
        return pd.DataFrame([[*key, upto, out]], columns=[*stream, "_group", "upto", "out"])

    group_pre = [*pre[: nk - 1], T.StructField("_group", T.LongType())]
    groups = steps.groupBy(*stream, "_group").applyInPandas(of_group, T.StructType([*group_pre, *step_schema.fields[nk:]]))

    entry_fields = [T.StructField("_x", num_type), T.StructField("_first", T.BooleanType())]

    def starts(order: str, cols: list):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            lead = pdf["_x"].iloc[0] if "_x" in pdf.columns and not pdf["_first"].iloc[0] else None
            at, _ = run_through(as_zones(pdf), lead)
            got = pdf[cols].copy()
            got["_first"] = [x is None for x in at]
            zero = pdf["out"].iloc[0][0]
            got["_x"] = np.asarray([zero if x is None else x for x in at])
            return got[[*cols, "_x", "_first"]]

        return run

    whole = groups.groupBy(*(stream or [F.lit(0).alias("_all")]))
    entries_g = whole.applyInPandas(starts("_group", [*stream, "_group"]), T.StructType([*group_pre, *entry_fields]))
    entries_g = entries_g.withColumnsRenamed({k: f"_of_{k}" for k in [*stream, "_group"]})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*stream, "_group"]]
    with_lead = steps.join(entries_g, same, "inner").drop(*[f"_of_{k}" for k in [*stream, "_group"]])
    entries = with_lead.groupBy(*stream, "_group").applyInPandas(starts("_zone", keys), T.StructType([*pre, *entry_fields]))

    def mark(key: tuple, zone: pd.DataFrame, lead: pd.DataFrame) -> pd.DataFrame:
        zone = zone.sort_values("_c")
        x = None if lead["_first"].iloc[0] else lead["_x"].iloc[0]
        at = zone["_c"].to_numpy()
        idx = visited(at, zone["_l"].to_numpy(), x)
        if members:
            got = zone[[*keys, "_c"]].copy()
            got["step"] = np.searchsorted(idx, np.arange(len(at)), side="right")
            got["start"] = at[idx[np.maximum(got["step"].to_numpy() - 1, 0)]] if len(idx) else at
            return got
        got = zone.iloc[idx][[*keys, "_c", "_l"]].copy()
        got["step"] = np.arange(len(idx), dtype=np.int64)
        return got

    step = T.StructField("step", T.LongType())
    values = [step, T.StructField("start", num_type)] if members else [T.StructField("_l", num_type), step]
    out_schema = T.StructType([*pre, T.StructField("_c", num_type), *values])
    on_chain = nodes.groupBy(*keys).cogroup(entries.toDF(*entries.columns).groupBy(*keys)).applyInPandas(mark, out_schema)
    return on_chain.withColumnsRenamed({"_c": c, "_l": limit, "_zone": "zone"})
