"""Block scan: round trip, damaged streams, and equality over every way to cut a file."""

import random
import tempfile
import time
from pathlib import Path

import numpy as np
import pytest

from pulseloom.sources import block_stream
from pulseloom.sources.block_stream import KINDS, Bytes, Format, compose_zones, read_blocks, run_zones, write_blocks, zone_map


def block(chip, index, ticks, samples):
    bits = "".join(f"{s:010b}" for s in samples)
    body = int(bits, 2).to_bytes(40, "big")
    t = ticks.to_bytes(6, "big")
    return b"\xaf\xaf" + bytes([chip, index]) + b"\xaf\xfa" + t[:2] + b"\xfa\xaf" + t[2:4] + b"\xff\xfa" + t[4:] + body + b"\xfa\xfa" + bytes([chip, index])


def some_blocks(rng, n):
    return [(rng.randrange(4), i % 64, rng.randrange(1 << 31), [rng.randrange(1024) for _ in range(32)]) for i in range(n)]


def scan(path, fmt, range_bytes, group=3):
    """The passes of the scan over byte ranges, without Spark."""
    length = Path(path).stat().st_size
    if fmt.max_bytes is not None:
        length = min(length, fmt.max_bytes)
    starts = range(0, length, range_bytes)

    def load(later):
        return [KINDS[fmt.layout](Bytes(str(path), a, min(a + range_bytes, length), length), a, min(a + range_bytes, length), fmt, x) for a, x in zip(starts, later)]

    zones = load([None] * len(starts))
    if any(z.waiting or zone_map(z) and z.waiting for z in zones):
        later = []
        for i in range(len(zones)):
            behind = [[f for f in (z.first[s] for z in zones[i + 1 :]) if f >= 0] for s in range(8)]
            later.append([min(x, default=None) for x in behind])
        zones = load(later)
        assert not any(z.waiting for z in zones)
    zones = [(z, zone_map(z)) for z in zones if len(z.c)]
    packs = [zones[i : i + group] for i in range(0, len(zones), group)]
    rows = []
    for pack, lead in zip(packs, run_zones([compose_zones([m for _, m in p]) for p in packs], None)):
        for (z, _), x in zip(pack, run_zones([m for _, m in pack], lead)):
            for batch in z.decode(x, "f"):
                rows += batch.to_pylist()
    return sorted(rows, key=lambda r: r["offset"])


def plain_scan(data, fmt):
    """(start, end, by footer) of the blocks of a framed stream, found one after the other by plain searching."""
    n = len(data)
    usable = n if fmt.emit_tail else n - 1
    byte = lambda i, s: data[i] if s == 0 else (data[i] >> s) | ((data[i + 1] & ((1 << s) - 1)) << (8 - s)) & 0xFF
    heads = [[i for i in range(n - 2) if byte(i, s) == 0xAF == byte(i + 1, s)] for s in range(8)]
    next_of = lambda s, at: next((h for h in heads[s] if h >= at), None)

    def footer(h):
        for p in range(h + 2, h + 57, 2):
            if p + 4 <= min(h + 60, usable) and data[p : p + 2] == b"\xfa\xfa" and data[p + 2 : p + 4] == data[h + 2 : h + 4]:
                return p + 4
        return None

    out, at = [], -1
    while True:
        later = [(h * 8 + s, h, s) for s in range(8) for h in heads[s] if h * 8 + s > at]
        if not later:
            return out
        _, h, s = min(later)
        counts = h + 1  # from where on a further header counts
        while True:
            e = footer(h)
            if e and counts + 2 <= h + 59 and max(e, counts + 3) <= usable:
                out.append((h, e, True))
                at = (max(e, counts + 3) - 2) * 8 - 1
                break
            inside, q = next_of(s, counts), None
            if inside is not None and inside < h + 59:
                if h + 62 <= n:
                    out.append((h, inside, False))
                    counts, h = h + 59, inside
                    continue
            else:
                q = next_of(s, max(counts, h + 59))
            if q is None:
                return out + ([(h, n, False)] if fmt.emit_tail else [])
            out.append((h, q, False))
            at = q * 8 + s - 1
            break


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="run-"))


def test_round_trip(folder):
    want = some_blocks(random.Random(1), 50)
    f = folder / "a.bin"
    f.write_bytes(b"".join(block(*b) for b in want) + b"\0")
    got = scan(f, Format(), 1 << 20)
    assert [(r["chip"], r["sample_index"], r["timestamp"], r["samples_value"]) for r in got] == want
    assert {(r["data_block"], r["error_level"]) for r in got} == {(60, 0)}
    assert [r["offset"] for r in got] == [60 * i for i in range(50)]


def test_last_byte_only_completes(folder):
    want = some_blocks(random.Random(2), 3)
    f = folder / "a.bin"
    f.write_bytes(b"".join(block(*b) for b in want))
    assert len(scan(f, Format(), 1 << 20)) == 2
    assert len(scan(f, Format(emit_tail=True), 1 << 20)) == 3


def test_lost_footer_splits_at_next_header(folder):
    a, b, c = (bytearray(block(*x)) for x in some_blocks(random.Random(3), 3))
    b[56:58] = b"\0\0"
    f = folder / "a.bin"
    f.write_bytes(bytes(a + b + c) + b"\0" * 4)
    got = scan(f, Format(), 1 << 20)
    assert [(r["offset"], r["data_block"], r["error_level"]) for r in got] == [(0, 60, 0), (60, 60, 16), (120, 60, 0)]
    assert got[1]["samples_value"] is None and got[1]["timestamp"] is not None


def test_header_in_window_is_used_on_expiry(folder):
    a, b, c = (bytearray(block(*x)) for x in some_blocks(random.Random(4), 3))
    f = folder / "a.bin"
    f.write_bytes(bytes(a[:20] + b + c) + b"\0" * 4)
    got = scan(f, Format(), 1 << 20)
    assert [(r["offset"], r["data_block"]) for r in got] == [(0, 20), (20, 60), (80, 60)]
    assert got[0]["error_level"] == 1 + 16 and got[1]["error_level"] == 0


def test_false_header_in_payload_is_ignored(folder):
    blocks = [bytearray(block(*x)) for x in some_blocks(random.Random(5), 3)]
    for b in blocks:
        b[30:32] = b"\xaf\xaf"
    f = folder / "a.bin"
    f.write_bytes(bytes(b"".join(blocks)) + b"\0" * 4)
    assert [r["offset"] for r in scan(f, Format(), 1 << 20)] == [0, 60, 120]


def test_missing_marker_bits(folder):
    got = []
    for n, (at, bit) in enumerate([(4, 2), (8, 4), (12, 8)]):
        b = bytearray(block(1, 2, 3, [0] * 32))
        b[at : at + 2] = b"\0\0"
        f = folder / f"{n}.bin"
        f.write_bytes(bytes(b) + b"\0" * 4)
        (r,) = scan(f, Format(), 1 << 20)
        assert r["error_level"] == bit and r["timestamp"] is None
        got.append(r["samples_value"])
    assert got[0] == [0] * 32 and got[2] is None


def shift_stream(data, s):
    """The stream as seen when the reader is ``s`` bits off: byte i takes its low bits from the following byte."""
    n = int.from_bytes(data, "little") << s
    return n.to_bytes(len(data) + 1, "little")


def test_shifted_headers_are_found(folder):
    data = b"".join(block(*x) for x in some_blocks(random.Random(6), 4)) + b"\0" * 4
    for s in range(1, 8):
        f = folder / f"{s}.bin"
        f.write_bytes(shift_stream(data, s))
        got = scan(f, Format(), 1 << 20)
        assert got and got[0]["offset"] == 0
        assert all(r["error_level"] & 16 for r in got if r["data_block"] != 60 or r["samples_value"] is None)


@pytest.mark.parametrize("ahead", [64, 100, 1 << 16])
@pytest.mark.parametrize("seed", range(4))
def test_same_result_for_every_cut(folder, monkeypatch, seed, ahead):
    monkeypatch.setattr(block_stream, "AHEAD", ahead)
    rng = random.Random(seed)
    data = bytearray()
    for b in some_blocks(rng, 25):
        x = bytearray(block(*b))
        what = rng.randrange(8)
        if what == 0:
            x[56:58] = b"\0\0"
        elif what == 1:
            del x[rng.randrange(2, 60) :]
        elif what == 2:
            x[rng.randrange(4, 50)] = 0xAF
        elif what == 3:
            x = bytearray(shift_stream(bytes(x), rng.randrange(1, 8)))
        elif what == 4:
            x += bytes(rng.choice([0xAF, 0xFA, 0x00]) for _ in range(rng.randrange(150)))
        data += x
    f = folder / "a.bin"
    f.write_bytes(bytes(data))
    for tail in (False, True):
        fmt = Format(emit_tail=tail)
        whole = scan(f, fmt, 1 << 20)
        assert whole
        want = plain_scan(bytes(data), fmt)
        assert [(r["offset"], r["offset"] + r["data_block"]) for r in whole] == [(a, b) for a, b, _ in want]
        assert [r["error_level"] & 16 == 0 for r in whole] == [ok for _, _, ok in want]
        for cut in (1, 59, 60, 61, 128, 500) if seed == 0 else (7, 61, 500):
            assert scan(f, fmt, cut, group=rng.choice([1, 2, 5])) == whole


def test_byte_limit(folder):
    f = folder / "a.bin"
    f.write_bytes(b"".join(block(*x) for x in some_blocks(random.Random(8), 10)))
    assert len(scan(f, Format(max_bytes=301), 1 << 20)) == 5
    assert len(scan(f, Format(max_bytes=300), 1 << 20)) == 4


@pytest.mark.parametrize("layout,size", [("fixed58", 58), ("fixed46", 46)])
def test_fixed_layouts(folder, layout, size):
    rng = random.Random(9)
    want = some_blocks(rng, 20)
    parts = [block(*b) for b in want]
    parts = [p[:58] if size == 58 else p[:4] + p[16:58] for p in parts]
    noise = [bytes(rng.randrange(200) for _ in range(rng.randrange(9))) for _ in parts]
    f = folder / "a.bin"
    f.write_bytes(b"".join(n + p for n, p in zip(noise, parts)))
    for cut in (1 << 20, 10, 64):
        got = scan(f, Format(layout=layout), cut)
        assert [(r["chip"], r["sample_index"], r["samples_value"]) for r in got] == [(b[0], b[1], b[3]) for b in want]
        if size == 58:
            assert [r["timestamp"] for r in got] == [b[2] for b in want]
    swapped = scan(f, Format(layout=layout, chip_first=False), 1 << 20)
    assert [r["chip"] for r in swapped] == [b[1] for b in want]


def test_spark_scan_of_many_files(spark, folder):
    rng = random.Random(10)
    want = {}
    for n in range(3):
        rows = some_blocks(rng, 40)
        (folder / f"{n}.bin").write_bytes(b"".join(block(*b) for b in rows) + b"\0")
        want[f"{n}.bin"] = rows
    got = read_blocks(spark, str(folder), range_bytes=500).orderBy("file", "offset").collect()
    by_file = {}
    for r in got:
        by_file.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["chip"], r["sample_index"], r["timestamp"], r["samples_value"]))
    for name, rows in want.items():
        assert len(by_file[name]) == len(rows)
        for i, (a, b) in enumerate(zip(by_file[name], rows)):
            assert a == b, (name, i)


def test_many_headers_without_footers(folder):
    """200,000 headers 46 bytes apart and a gap of many ranges: time in proportion to the bytes."""
    f = folder / "a.bin"
    one = b"\xaf\xaf\x01\x02" + b"\0" * 42
    f.write_bytes(one * 200_000 + b"\0" * 5_000_000 + one + b"\0" * 100)
    began = time.time()
    got = scan(f, Format(), 1 << 20)
    assert time.time() - began < 60
    assert [r["data_block"] for r in got] == [46] * 199_999 + [5_000_046]
    assert {r["error_level"] for r in got} == {1 + 2 + 4 + 8 + 16}


@pytest.mark.parametrize("ahead", [64, 1 << 16])
def test_header_to_header(folder, monkeypatch, ahead):
    monkeypatch.setattr(block_stream, "AHEAD", ahead)
    rng = random.Random(12)
    parts = []
    for b in some_blocks(rng, 20):
        x = bytearray(block(*b[:2], 4_096 * len(parts), [0] * 32))  # no header by chance
        if rng.random() < 0.4:
            x[rng.choice([4, 8, 12, 56])] = 0
        parts.append(bytes(x) + b"\0" * rng.choice([0, 0, 3, 300]))
    data = b"".join(parts)
    f = folder / "a.bin"
    f.write_bytes(data)
    marks = {2: b"\xaf\xfa", 4: b"\xfa\xaf", 8: b"\xff\xfa", 16: b"\xfa\xfa"}
    want, at = [], 0
    for x in parts:
        want.append((at, len(x), sum(bit for bit, m in marks.items() if m not in x[2:]), x[2], x[3]))
        at += len(x)
    for cut in (1 << 20, 50, 61, 400):
        got = [tuple(r[c] for c in ("offset", "data_block", "error_level", "chip", "sample_index")) for r in scan(f, Format(layout="headers"), cut)]
        assert got == want[:-1]
        got = [tuple(r[c] for c in ("offset", "data_block", "error_level", "chip", "sample_index")) for r in scan(f, Format(layout="headers", emit_tail=True), cut)]
        assert got == want


def test_spark_scan_of_damaged_files(spark, folder):
    rng = random.Random(13)
    want = []
    for n in range(3):
        data = bytearray()
        for b in some_blocks(rng, 60):
            x = bytearray(block(*b))
            if rng.random() < 0.3:
                del x[rng.choice([20, 46, 56]) :]
            data += x + (b"\0" * 80_000 if rng.random() < 0.03 else b"")
        (folder / f"{n}.bin").write_bytes(bytes(data))
        want += [(f"{n}.bin", a, b - a) for a, b, _ in plain_scan(bytes(data), Format())]
    got = read_blocks(spark, str(folder), range_bytes=700).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["offset"], r["data_block"]) for r in got) == sorted(want)


def test_a_file_gets_its_name_when_it_is_whole(spark, folder):
    rows = spark.createDataFrame([(1, i, 5, i, [i] * 32) for i in range(10)], "run long, chip long, timestamp long, sample_index long, samples_value array<long>")
    written = write_blocks(rows, str(folder / "out"), "run", ["sample_index"]).collect()
    assert sum(r["blocks"] for r in written) == 10
    assert {p.name for p in (folder / "out").rglob("*") if p.is_file()} == {Path(r["file"]).name for r in written}


WORDS = [0xAFAF, 0xAF12, 0x12AF, 0xFAFA, 0xFFFA, 0xFAAF, 0xAFFA, 0x5F5F, 0x7D7D, 0xBEBE, 7]


@pytest.mark.parametrize("layout", ["framed", "headers"])
def test_clock_words_like_marks_are_data_in_a_whole_head(folder, monkeypatch, layout):
    monkeypatch.setattr(block_stream, "AHEAD", 64)
    rng = random.Random(14)
    data, want = b"", []
    for a in WORDS:
        for b in WORDS:
            x = block(rng.randrange(4), rng.randrange(1, 8), 3 << 32 | a << 16 | b, [0] * 32)
            lost = rng.choice([0, 56, 47])
            x = x[:56] + b"\0\0" + x[58:] if lost == 56 else x[:47] if lost else x
            want.append((len(data), len(x), 3 << 32 | a << 16 | b, 0 if lost == 0 else 16))
            data += x
    f = folder / "a.bin"
    f.write_bytes(data + block(1, 1, 0, [0] * 32) + block(1, 1, 0, [0] * 32)[:16] + b"\0" * 60)
    for cut in (1 << 20, 1, 17, 60, 500):
        got = scan(f, Format(layout=layout, whole_heads=True), cut)
        assert [(r["offset"], r["data_block"], r["timestamp"], r["error_level"] & 16) for r in got][: len(want)] == want


def test_a_mark_in_its_place_goes_before_a_clock_word(folder):
    f = folder / "a.bin"
    f.write_bytes(block(1, 2, 0xFFFA1234, list(range(32))) + b"\0" * 4)
    (r,) = scan(f, Format(), 1 << 20)
    assert r["timestamp"] == 0xFFFA1234 and r["samples_value"] == list(range(32))


@pytest.mark.parametrize("name", ["raw_blocks", "raw_blocks_damaged", "header_blocks"])
def test_clocks_of_larger_tables(spark, folder, name):
    """Keys of larger tables, at which words of the clock are the header, the footer or a mark."""
    from harness import compare, connect

    from pulseloom.catalog import files

    source = "/root/testdata/sf0.001/lineitem.parquet"
    lines = spark.read.parquet(source)
    starts = spark.createDataFrame([(x,) for x in (719_000, 1_027_500, 1_048_000, 2_936_500, 4_294_000)], "base long")
    lines.crossJoin(starts).withColumn("l_orderkey", lines.l_orderkey + starts.base).drop("base").coalesce(1).write.parquet(str(folder / "x"))
    next((folder / "x").glob("part-*")).rename(folder / "lineitem.parquet")
    assert compare(files.QUERIES[name](spark, str(folder)), connect(str(folder)), files.ORACLE[name]) is None


def test_a_task_reads_more_than_one_small_range(spark, folder):
    rng = random.Random(15)
    want = some_blocks(rng, 400)
    (folder / "a.bin").write_bytes(b"".join(block(*b) for b in want) + b"\0")
    found = read_blocks(spark, str(folder), range_bytes=100)
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert [(r["chip"], r["sample_index"], r["timestamp"], r["samples_value"]) for r in found.orderBy("offset").collect()] == want
