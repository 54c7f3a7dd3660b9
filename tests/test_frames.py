"""Frames of blocks: every zone width against plain Python, and how often samples are moved."""

import random

import pytest

from pulseloom.operators import runs

SCHEMA = "s string, chip int, pos long, sample_index int, samples_value array<long>"


def some_blocks(seed, n, n_samples, first=0):
    """Stretches in which an index is rare or missing, so that frames reach over many zones and some never close."""
    rng = random.Random(seed)
    rows, rare = [], 0
    for p in range(first, first + n):
        rare = rng.randrange(n_samples) if rng.random() < 0.05 else rare
        index = rng.randrange(-1, n_samples + 1)
        if index == rare and rng.random() < 0.8:
            continue
        rows.append((rng.choice(["a", "b"]), rng.choice([0, 1, None]), p, index, [rng.randrange(99), p]))
    return rows


def plain_frames(rows, stream, n_samples):
    held, start, out = {}, {}, []
    for r in sorted(rows, key=lambda r: r[2]):
        k = stream(r)
        if None in k or not 0 <= r[3] < n_samples:
            continue
        mine = held.setdefault(k, {})
        if not mine:
            start[k] = r[2]
        mine[r[3]] = r[4]
        if len(mine) == n_samples:
            out.append((*k, start[k], r[2], [[mine[i][c] for i in range(n_samples)] for c in (0, 1)]))
            mine.clear()
    return out


@pytest.mark.parametrize("zone", [1, 4, 37, 1 << 18])
@pytest.mark.parametrize("stream,n_samples,first", [(("s", "chip"), 3, 0), (("s",), 5, -90), ((), 8, 1 << 40), (("chip",), 1, 0)])
def test_frames_of_every_zone_width(spark, zone, stream, n_samples, first):
    rows = some_blocks(n_samples, 300, n_samples, first)
    at = [("s", "chip").index(c) for c in stream]
    want = plain_frames(rows, lambda r: tuple(r[i] for i in at), n_samples)
    assert want
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = runs.complete_frames(df, stream=stream, n_samples=n_samples, zone=zone).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def shuffles_with(plan, column):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return shuffles_with(plan.initialPlan(), column)
    children = plan.children()
    mine = "ShuffleExchange" in plan.getClass().getSimpleName() and column in plan.output().mkString(",")
    return mine + sum(shuffles_with(children.apply(i), column) for i in range(children.size()))


def test_samples_of_all_blocks_are_moved_once(spark):
    """A second shuffle moves the blocks that fill frames, as parts of these; nothing else carries samples."""
    df = spark.createDataFrame(some_blocks(2, 100, 3), SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = runs.complete_frames(df, stream=["s", "chip"], n_samples=3)._jdf.queryExecution().executedPlan()
        whole, parts = shuffles_with(plan, "samples_value"), shuffles_with(plan, "_b") + shuffles_with(plan, "buf")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert (whole, parts) == (1, 1), plan.toString()
