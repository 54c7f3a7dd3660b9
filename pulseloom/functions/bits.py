"""Bit and byte fields of readout blocks, on binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseloom.functions.waveform import let

# Fixed values of the block format (two bytes each, big-endian).
HEADER, FOOTER = "AFAF", "FAFA"
MARK_T3, MARK_T2, MARK_T1 = "AFFA", "FAAF", "FFFA"
BLOCK_BYTES, GAP_BYTES, FLAGS = 60, 58, 5
CHANNELS, SAMPLE_BITS = 32, 10


def byte_values(b: Column) -> Column:
    """Binary as array of 0..255."""
    chars = F.slice(F.split(F.decode(b, "ISO-8859-1"), ""), F.lit(1), F.length(b))
    return F.when(F.length(b) > 0, F.transform(chars, lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def number(b: Column) -> Column:
    """Big-endian unsigned number of a short binary."""
    return F.conv(F.hex(b), 16, 10).cast("bigint")


def word_be(b: Column, i: int | Column) -> Column:
    """16-bit word at byte ``i``, null when it is cut off."""
    part = F.substring(b, _col(i) + 1, F.lit(2))
    return F.when(F.length(part) == 2, number(part))


def word_le(b: Column, i: int | Column) -> Column:
    return let(word_be(b, i), lambda w: F.shiftright(w, 8).bitwiseOR(F.shiftleft(w.bitwiseAND(F.lit(255)), 8)))


def byte_at(b: Column, i: int | Column) -> Column:
    part = F.substring(b, _col(i) + 1, F.lit(1))
    return F.when(F.length(part) == 1, number(part))


def _col(i):
    return i if isinstance(i, Column) else F.lit(i)


def marker_positions(b: Column, marker: str) -> Column:
    """0-based byte positions of a marker (hex text), at any alignment, overlaps included."""
    k = len(marker) // 2
    want = F.unhex(F.lit(marker))
    last = F.length(b) - k
    at = F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(b, i + 1, F.lit(k)) == want)
    return F.when(last >= 0, at).otherwise(F.array().cast("array<int>"))


def bytes_after(b: Column, pos: Column, n: int = 2) -> Column:
    """``n`` bytes behind a 2-byte marker at ``pos``; null when any of them is missing."""
    part = F.substring(b, pos + 3, F.lit(n))
    return F.when(F.length(part) == n, part)


def word_after(b: Column, marker: str, hit: int = 0) -> Column:
    """16-bit value behind the given occurrence of a marker."""
    return let(F.get(marker_positions(b, marker), F.lit(hit)), lambda p: F.when(p.isNotNull(), number(bytes_after(b, p))))


def timestamp48(t1: Column, t2: Column, t3: Column) -> Column:
    """48-bit clock value from its three 16-bit parts; null unless all are there."""
    return F.shiftleft(t3, 32).bitwiseOR(F.shiftleft(t2, 16)).bitwiseOR(t1)


def timestamp_of(b: Column) -> Column:
    return timestamp48(word_after(b, MARK_T1), word_after(b, MARK_T2), word_after(b, MARK_T3))


def unpack10(b: Column, *, msb_first: bool = True, pad_last: bool = False) -> Column:
    """10-bit numbers packed without gaps; a cut-off last number is dropped, or filled with zero bits."""
    bits = F.length(b) * 8
    n = F.floor(bits / SAMPLE_BITS).cast("int")
    if pad_last:
        n = F.ceil(bits / SAMPLE_BITS).cast("int")

    def values(v: Column) -> Column:
        def one(i: Column) -> Column:
            bit = i * SAMPLE_BITS
            k, off = F.floor(bit / 8).cast("int"), bit % 8
            first, second = F.get(v, k), F.coalesce(F.get(v, k + 1), F.lit(0))
            if msb_first:
                return F.call_function("shiftright", first * 256 + second, 6 - off).bitwiseAND(F.lit(1023)).cast("bigint")
            return F.call_function("shiftright", first + second * 256, off).bitwiseAND(F.lit(1023)).cast("bigint")

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<bigint>"))

    return let(byte_values(b), values)


def interval_bytes(pairs: Column, start: int | Column, end: int | Column, *, fill_missing: int | None = None) -> Column:
    """Bytes at the positions [start, end) out of an array of (pos, byte) in any order, as binary.

    Of repeated positions the last entry counts. A position without entry is ``fill_missing``; without that the result
    is null, so that one incomplete block does not end a job. A negative start or an end before it gives no bytes.
    """
    start, end = _col(start), _col(end)
    blank = F.repeat(F.lit("--"), end - start)  # two hex digits for each position

    def put(text: Column, e: Column) -> Column:
        at, byte = e["pos"].cast("int"), e["byte"].cast("int").bitwiseAND(F.lit(255))
        digits = F.coalesce(F.substring(F.hex(byte + 256), 2, 2), F.lit("--"))
        return F.when((at >= start) & (at < end), F.overlay(text, digits, (at - start) * 2 + 1, F.lit(2))).otherwise(text)

    text = F.coalesce(F.aggregate(pairs, blank, put), blank)
    if fill_missing is not None:
        made = F.unhex(F.replace(text, F.lit("--"), F.lit(f"{fill_missing & 255:02X}")))
    else:
        made = let(text, lambda t: F.when(~F.contains(t, F.lit("-")), F.unhex(t)))
    return F.when((start < 0) | (end <= start), F.unhex(F.lit(""))).otherwise(made)


def unpack10_pairs(
    pairs: Column, start: int | Column, end: int | Column, *, fill_missing: int | None = None, msb_first: bool = True, pad_last: bool = False
) -> Column:
    """``unpack10`` of ``interval_bytes``."""
    return let(
        interval_bytes(pairs, start, end, fill_missing=fill_missing), lambda b: unpack10(b, msb_first=msb_first, pad_last=pad_last)
    )


def pack_flags(*ok: Column) -> Column:
    """Bit i is 0 where check i holds."""
    level = F.lit(0)
    for i, flag in enumerate(ok):
        level = level + F.when(flag, F.lit(0)).otherwise(F.lit(1 << i))
    return level.cast("bigint")


def unpack_flags(level: Column, width: int = FLAGS) -> Column:
    """Array of booleans, true where the check holds."""
    return F.array(*[F.shiftright(level, i).bitwiseAND(F.lit(1)) == 0 for i in range(width)])


def block_level(gap: Column, footer_ok: Column) -> Column:
    """Error level of the bytes between header and block end: size, t3, t2 and t1 marker, footer."""
    has = lambda m: F.size(marker_positions(gap, m)) > 0
    return pack_flags(F.length(gap) == GAP_BYTES, has(MARK_T3), has(MARK_T2), has(MARK_T1), footer_ok)


def missing_markers(level: Column) -> Column:
    """Number of absent markers (t3, t2, t1, footer) in an error level."""
    return F.bit_count(level.bitwiseAND(F.lit(30))).cast("bigint")


def hex_words(b: Column) -> Column:
    """Bytes as text of 4-digit words."""
    return F.trim(F.regexp_replace(F.lower(F.hex(b)), "(.{4})", "$1 "))


def pack10(samples: str, n: int = CHANNELS) -> Column:
    """Hex text of ``n`` (a multiple of four) 10-bit samples; written out per group, so it stays inside generated code."""
    at = lambda i: f"cast({samples}[{i}] as bigint)"
    words = [
        f"lpad(hex((shiftleft({at(i)}, 30) | shiftleft({at(i + 1)}, 20)) | (shiftleft({at(i + 2)}, 10) | {at(i + 3)})), 10, '0')"
        for i in range(0, n, 4)
    ]
    return F.expr(f"concat({', '.join(words)})")


def encode_block(chip: Column, index: Column, ticks: Column, samples: str) -> Column:
    """The 60 bytes of one block."""
    h = lambda v, n: F.lpad(F.hex(v), n, "0")
    part = lambda k: h(F.shiftright(ticks, k).bitwiseAND(F.lit(65535)), 4)
    ident = F.concat(h(chip, 2), h(index, 2))
    return F.unhex(
        F.concat(
            F.lit(HEADER), ident, F.lit(MARK_T3), part(32), F.lit(MARK_T2), part(16), F.lit(MARK_T1), part(0),
            pack10(samples), F.lit(FOOTER), ident,
        )
    )
