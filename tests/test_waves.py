"""Wave functions against plain Python on edge cases and random waves."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import bits
from pulseloom.functions import waveform as wf
from pulseloom.functions.spans import wave_spans

EDGES = [
    None, [], [5], [7] * 12, [1, 1, 2, 2], [0, 100, 0], [60] * 20, [0] * 19 + [90], [90] + [0] * 19,
    [0, 60, 60, 0, 0, 60, 0], [10] * 5 + [50] + [10] * 5, list(range(30)),
]


@pytest.fixture(scope="module")
def waves(spark):
    rng = random.Random(3)
    rand = [[rng.choice([0, 0, 5, 10, 30, 49, 50, 51, 80, 120]) for _ in range(rng.randint(1, 70))] for _ in range(150)]
    rows = [(i, w) for i, w in enumerate(EDGES + rand)]
    df = spark.createDataFrame(rows, "id int, w array<bigint>").repartition(4).cache()
    return df, dict(rows)


def run(waves, col):
    df, src = waves
    return {r["id"]: r["o"] for r in df.select("id", col.alias("o")).collect()}, src


def test_baseline_first(waves):
    got, src = run(waves, wf.subtract_first("w"))
    for i, w in src.items():
        want = [] if not w else np.rint(np.array(w) - np.mean(w[:10])).astype(int).tolist()
        assert got[i] == want


@pytest.mark.parametrize("ties", ["smallest", "first"])
def test_baseline_mode(waves, ties):
    got, src = run(waves, wf.subtract_mode("w", ties=ties))
    for i, w in src.items():
        if not w:
            assert got[i] == []
            continue
        n = Counter(w)
        top = max(n.values())
        base = min(v for v in n if n[v] == top) if ties == "smallest" else next(v for v in w if n[v] == top)
        assert got[i] == [x - base for x in w]


def spans_by_walk(x, rise, fall, pre, post, minlen):
    out, pos, n = [], 0, len(x)
    while (start := next((i for i in range(pos, n) if x[i] >= rise), None)) is not None:
        stop = next((i for i in range(start + 1, n) if x[i] <= fall), None)
        lo, hi = max(0, start - pre), n if stop is None else min(n, stop + 1 + post)
        if hi - lo >= minlen:
            out.append((lo, hi))
        pos = hi
    return out


@pytest.mark.parametrize("pre,post,minlen", [(10, 8, 4), (0, 0, 1), (2, 3, 6)])
def test_pulse_spans(waves, pre, post, minlen):
    got, src = run(waves, wf.pulse_spans("w", rise=50, fall=10, pre=pre, post=post, minlen=minlen))
    for i, w in src.items():
        if w is not None:
            assert [tuple(s) for s in got[i]] == spans_by_walk(w, 50, 10, pre, post, minlen)


def test_find_pulses_edges(spark):
    wave = [0] * 5 + [90] * 3 + [0] * 5
    rows = [(1, [wave, None, []], list(range(100, 113)), 2), (2, None, [1], 0), (3, [wave], None, 0), (4, [wave], [1, 2, 3], 0), (5, [], [1], 0)]
    df = spark.createDataFrame(rows, "id int, sv array<array<bigint>>, ts array<bigint>, chip bigint")
    got = {r["id"]: r["p"] for r in df.select("id", wf.find_pulses("sv", "ts", "chip", pre=2, post=1).alias("p")).collect()}
    (one,) = got[1]
    assert one["pulse"] == [0, 0, 90, 90, 90, 0, 0] and one["index"] == list(range(3, 10))
    assert one["time"] == list(range(103, 110)) and (one["chip"], one["channel"]) == (2, 0) and one["original"] == wave
    assert not got[2] and not got[3] and got[4] == [] and got[5] == []


def test_segment(waves):
    got, src = run(waves, wf.segment_pulse("w", up=40, down=40))
    for i, w in src.items():
        want = None
        if w and len(w) >= 20:
            y = np.array(w, float) - (sum(w[:11]) + sum(w[-11:])) / 22
            above = np.flatnonzero(y >= 40)
            if len(above):
                r = above[0]
                f = next((j for j in range(r, len(y)) if y[j] < 40), len(y) - 1)
                seg = y[max(0, r - 12) : min(len(y), f + 12)]
                if len(seg) >= 10:
                    want = seg - seg[:10].sum() / 10
        assert (got[i] is None) == (want is None)
        if want is not None:
            assert np.allclose(got[i], want)


def test_features(waves):
    df, src = waves
    rows = df.select(
        "id", wf.total("w").alias("q"), wf.peak_position("w").alias("p"), wf.crossings_up("w", 49).alias("u"), wf.crossings_down("w", 49).alias("d"),
        wf.normalized("w").alias("n"), wf.max_step("w").alias("s"),
    ).collect()
    for r in rows:
        w = src[r["id"]]
        if w is None:
            continue
        assert r["q"] == sum(w)
        assert r["p"] == (w.index(max(w)) + 1 if w else None)
        assert r["u"] == [i for i in range(1, len(w)) if w[i] > 49 >= w[i - 1]]
        assert r["d"] == [i for i in range(1, len(w)) if w[i] <= 49 < w[i - 1]]
        assert r["s"] == (max(abs(a - b) for a, b in zip(w, w[1:])) if len(w) > 1 else None)


def test_null_sample_counts_zero(spark):
    df = spark.createDataFrame([([1, None, 3],)], "w array<bigint>")
    assert df.select(wf.total("w")).first()[0] == 4.0


def test_ranges(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, float("nan"), None, -2.0],)], "a array<double>")
    one = lambda c: df.select(c).first()[0]
    assert one(wf.within_range("a", 3, 1)) == [1.0, 2.0, 3.0]
    assert one(wf.within_range("a", 1, 3, inclusive="neither")) == [2.0]
    assert one(wf.within_range("a", 1, 2, absolute=True)) == [1.0, 2.0, -2.0]
    assert one(wf.within_range_indices("a", 2, 3)) == [1, 2]
    assert one(wf.trim_ms_to_ns("a", 1, 3, inclusive=False)) == [2e6]
    with pytest.raises(ValueError):
        wf.in_range(F.lit(1), 0, 1, "all")


def test_transpose(spark):
    df = spark.createDataFrame([([[1, 2, 3], [4, 5]],), ([],), ([[]],)], "r array<array<bigint>>")
    assert [r[0] for r in df.select(wf.transpose("r")).collect()] == [[[1, 4], [2, 5]], [], []]


def test_flag_table(spark):
    checks = [(1, 1, 1, 1, 1), (0, 1, 1, 1, 1), (1, 0, 1, 1, 1), (1, 1, 0, 1, 1), (1, 1, 1, 0, 1), (1, 1, 1, 1, 0), (0,) * 5]
    df = spark.createDataFrame([tuple(map(bool, c)) for c in checks], "a boolean, b boolean, c boolean, d boolean, e boolean")
    level = bits.pack_flags(*[F.col(c) for c in "abcde"])
    rows = df.select("*", level.alias("v")).select("*", bits.unpack_flags(F.col("v")).alias("f")).collect()
    assert [r["v"] for r in rows] == [0, 1, 2, 4, 8, 16, 31]
    assert [tuple(map(int, r["f"])) for r in rows] == checks


def test_unpack10(spark):
    rng = random.Random(5)
    raws = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 3, 5, 39, 40)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raws)], "i int, b binary")
    cols = {(m, p): bits.unpack10(F.col("b"), msb_first=m, pad_last=p).alias(f"c{int(m)}{int(p)}") for m in (True, False) for p in (True, False)}
    for r in df.select("i", *cols.values()).collect():
        raw = raws[r["i"]]
        msb = "".join(f"{x:08b}" for x in raw)
        lsb = "".join(f"{x:08b}"[::-1] for x in raw)
        for (m, p), _ in cols.items():
            text = msb if m else lsb
            groups = [text[k : k + 10] for k in range(0, len(text), 10)]
            if groups and len(groups[-1]) < 10:
                groups = groups[:-1] + ([groups[-1].ljust(10, "0")] if p else [])
            want = [int(g, 2) if m else int(g[::-1], 2) for g in groups]
            assert r[f"c{int(m)}{int(p)}"] == want


def test_markers(spark):
    df = spark.createDataFrame([(bytearray(bytes.fromhex("affaaffa12fffa0a0b")),), (bytearray(b""),)], "b binary")
    b = F.col("b")
    first = df.select(bits.marker_positions(b, "AFFA"), bits.marker_positions(b, "FAAF"), bits.word_after(b, "FFFA"), bits.word_after(b, "0A0B"), bits.timestamp_of(b)).first()
    assert first[0] == [0, 2] and first[1] == [1] and first[2] == 0x0A0B and first[3] is None
    assert first[4] == (0xAFFA << 32) | (0xFA12 << 16) | 0x0A0B


def test_spans_of_null_and_empty_waves_in_one_batch(spark):
    wave = [0.0, 60.0, None, 60.0, 5.0, None, 80.0]
    rows = [(0, [wave, None, []]), (1, None), (2, []), (3, [[], wave[:3]]), (4, [None])]
    df = spark.createDataFrame(rows, "id int, ws array<array<double>>").coalesce(1)
    got = {r["id"]: r["s"] for r in df.select("id", wave_spans(F.col("ws"), rise=50, fall=10, pre=0, post=0, minlen=1).alias("s")).collect()}
    assert [[tuple(s) for s in ss] if ss is not None else None for ss in got[0]] == [[(1, 5), (6, 7)], None, []]
    assert got[1] is None and got[2] == [] and got[4] == [None]
    assert [[tuple(s) for s in ss] for ss in got[3]] == [[], [(1, 3)]]


def test_many_pulses_in_one_long_wave(spark):
    wave = [0, 90] * 50_000
    df = spark.createDataFrame([(wave,)], "w array<bigint>")
    spans = df.select(wave_spans(F.array("w"), rise=50, fall=10, pre=0, post=0, minlen=1).alias("s")).filter(F.size("s") > 0).select(F.inline(F.get("s", F.lit(0)))).collect()
    assert [tuple(s) for s in spans] == [(i, min(i + 2, len(wave))) for i in range(1, len(wave), 2)]


@pytest.mark.parametrize("pre,post,minlen", [(10, 8, 4), (0, 0, 1), (2, 3, 6)])
def test_wave_spans(waves, pre, post, minlen):
    got, src = run(waves, wave_spans(F.array("w", "w"), rise=50, fall=10, pre=pre, post=post, minlen=minlen))
    for i, w in src.items():
        want = None if w is None else spans_by_walk(w, 50, 10, pre, post, minlen)
        assert [None if s is None else [tuple(x) for x in s] for s in got[i]] == [want, want]


def test_inline_of_found_pulses(spark):
    df = spark.createDataFrame([([[0, 0, 90, 0, 0]], [1, 2, 3, 4, 5], 7)], "sv array<array<bigint>>, ts array<bigint>, chip bigint")
    rows = df.select(F.inline(wf.find_pulses("sv", "ts", "chip", pre=1, post=0, minlen=1))).collect()
    assert [(r["pulse"], r["index"], r["time"], r["chip"], r["channel"]) for r in rows] == [([0, 90, 0], [1, 2, 3], [2, 3, 4], 7, 0)]
