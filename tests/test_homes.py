"""Runs whose samples are moved once: every bucket width against plain Python, and the plan."""

import random

import pytest

from pulseloom.operators import runs

SCHEMA = "s long, pos long, chip long, sample_index long, timestamp long, samples_value array<long>"


def some_blocks(seed):
    rng = random.Random(seed)
    rows, pos = [], 0
    for s in range(3):
        chip, index = 0, 0
        for _ in range(60):
            step = rng.random()
            chip = chip if step < 0.95 else (chip + 1) % 3
            index = index + 1 if step < 0.85 else 1
            rows.append((s, pos, chip, index, rng.randrange(1_000), [pos, -pos]))
            pos += 1
    return rows


def plain_runs(rows, opens):
    out = []
    for r in rows:
        last = out[-1][-1] if out else None
        if last is None or last[0] != r[0] or opens(last, r):
            out.append([])
        out[-1].append(r)
    return out


@pytest.mark.parametrize("width", [1, 3, 7, 1 << 20])
def test_runs_of_every_bucket_width(spark, width):
    rows = some_blocks(width)
    df = spark.createDataFrame(rows, SCHEMA)
    want = [
        (r[0][0], r[0][1], r[0][2], [b[4] for b in r], [b[3] for b in r], [[b[5][c] for b in r] for c in (0, 1)])
        for r in plain_runs(rows, lambda p, c: p[2] != c[2] or c[3] <= p[3])
    ]
    got = runs.contiguous_runs(df, stream=["s"], width=width).collect()
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("width", [1, 3, 7, 1 << 20])
@pytest.mark.parametrize("part", [1, 4, 64])
def test_chip_runs_of_every_bucket_width(spark, width, part):
    rows = some_blocks(width + part)
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for r in plain_runs(rows, lambda p, c: p[2] != c[2]):
        for i in range(0, len(r), part):
            for c in (0, 1):
                want.append((r[0][0], r[0][1], i // part, r[0][2], c, [b[5][c] for b in r[i : i + part]], r[0][4]))
    got = runs.chip_runs(df, stream=["s"], width=width, part_blocks=part).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_samples_are_moved_once(spark):
    df = spark.createDataFrame(some_blocks(1), SCHEMA)
    for made in (runs.contiguous_runs(df, stream=["s"]), runs.chip_runs(df, stream=["s"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_filled_bytes_are_put_in_place_without_a_search_per_position(spark):
    from pyspark.sql import functions as F

    from pulseloom.functions.bits import interval_bytes

    def plain(pairs, start, end, fill):
        got = {}
        for e in pairs or []:
            if e and e[0] is not None:
                got[e[0]] = e[1]
        out = [got.get(p) if got.get(p) is not None else fill for p in range(start, end)]
        return None if None in out else bytes(x & 255 for x in out)

    rng = random.Random(5)
    rows = [[(rng.choice([None, *range(12)]), rng.choice([None, 0, 7, 255, 300])) for _ in range(rng.randrange(40))] for _ in range(60)] + [None, [], [None, (3, 4)]]
    df = spark.createDataFrame([(r,) for r in rows], "p array<struct<pos: int, byte: int>>")
    for fill in (None, 0, 165):
        got = interval_bytes(F.col("p"), 2, 9, fill_missing=fill)
        assert [r[0] if r[0] is None else bytes(r[0]) for r in df.select(got).collect()] == [plain(r, 2, 9, fill) for r in rows]
        assert "try_element_at" not in df.select(got)._jdf.queryExecution().optimizedPlan().toString()
