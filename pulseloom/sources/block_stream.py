"""Readout byte streams as DataFrames: a splittable scan of framed blocks, and the matching writer.

A stream is a chain: where a block ends decides where the search for the next header goes on, so no byte range of a
file can be decoded on its own. The scan therefore runs in two passes over byte ranges. The first finds all candidate
headers of a range and reduces the range to a short function "state in which the chain enters -> state in which it
leaves". The functions are composed per file. In the second pass every range knows its entry and decodes its blocks.
Both passes are tasks over (file, range) rows; no file and no range table passes through the driver.

The chain is in one of two states at a border. It searches: the state is a limit (8 * position + bit shift), and the next
header behind it is entered. Or a block without footer was ended by a header inside its window, and the block that starts
there is not decided yet: the state is a negative ``code`` of that header and of the position from which further headers
count. Blocks that have to wait for a header beyond the bytes a range has loaded get it from a table of the first headers
of all ranges, so a range never reads on through the file to decide a chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.bits import encode_block
from pulseloom.session import materialize

BLOCKS = (
    "file string, offset bigint, data_block bigint, error_level bigint, timestamp bigint, chip bigint, "
    "sample_index bigint, samples_value array<bigint>"
)
ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("data_block", pa.int64()),
        ("error_level", pa.int64()),
        ("timestamp", pa.int64()),
        ("chip", pa.int64()),
        ("sample_index", pa.int64()),
        ("samples_value", pa.list_(pa.int64())),
    ]
)
WINDOW = 58  # bytes behind the header in which the footer must be complete
AHEAD = 1 << 16  # bytes loaded behind a range
HEAD = 16  # bytes of a block's head: header, chip and index, three marks with a word each
PLACES = {"t3": 4, "t2": 8, "t1": 12}  # of the marks in a head
BEHIND = 64 + HEAD  # and before it: more than a block's window and a head
PIECE = 1 << 22  # bytes of a long gap that are looked at together
UNKNOWN = 1 << 62  # limit behind a header that waits for one beyond the loaded bytes, while that one is not known
RANGES_PER_GROUP = 1024
TASK_BYTES = 16 << 20  # ranges that one task reads, one after the other, where there are enough for all cores


@dataclass(frozen=True)
class Format:
    """Markers and layout of a stream.

    ``layout`` is ``framed`` (header at any bit shift, footer with an echo of the first two bytes), ``headers`` (every
    header at any bit shift starts a block, which ends at the next one; markers are looked for anywhere inside),
    ``fixed58`` or ``fixed46`` (blocks of fixed parts at byte alignment, with and without a timestamp field respectively).

    With ``whole_heads`` the 16 bytes from a header to the end of t1 are one piece where all three marks are in their
    places: a word of the clock that looks like a header or a footer is data. Without it every header counts.
    """

    header: int = 0xAFAF
    footer: int = 0xFAFA
    t1: int = 0xFFFA
    t2: int = 0xFAAF
    t3: int = 0xAFFA
    layout: str = "framed"
    chip_first: bool = True
    max_bytes: int | None = None
    emit_tail: bool = False
    whole_heads: bool = False

    @property
    def fixed_size(self) -> int:
        return {"fixed58": 58, "fixed46": 46}[self.layout]


# ---------------------------------------------------------------- bytes of one file

class Bytes:
    """Bytes of a file from a little before a range to AHEAD and a head behind it."""

    def __init__(self, path: str, start: int, stop: int, length: int):
        from pyarrow import fs

        uri = path
        if uri.startswith("file:"):
            uri = "/" + uri[5:].lstrip("/")
        for scheme in ("s3a:", "s3n:"):  # names that only Hadoop knows
            if uri.startswith(scheme):
                uri = "s3:" + uri[len(scheme) :]
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.start, self.length = max(start - BEHIND, 0), length
        self.handle = self.fs.open_input_file(self.path)
        self.data = self._read(self.start, min(stop + AHEAD + HEAD, length))

    def _read(self, a: int, b: int) -> np.ndarray:
        self.handle.seek(a)
        return np.frombuffer(self.handle.read(max(b - a, 0)), dtype=np.uint8)

    @property
    def stop(self) -> int:
        return self.start + len(self.data)

    def at(self, a: int, b: int) -> bytes:
        if b <= self.stop:
            return self.data[a - self.start : b - self.start].tobytes()
        return self._read(a, min(b, self.length)).tobytes()

    def find(self, word: bytes, a: int, b: int) -> int:
        """First place of a two-byte word that lies inside [a, b), or -1; a long stretch is read in pieces."""
        while b - a >= len(word):
            found = self.at(a, min(a + PIECE, b)).find(word)
            if found >= 0:
                return a + found
            a = min(a + PIECE, b) - len(word) + 1
        return -1

    def close(self) -> None:
        self.handle.close()


def whole_heads(src: Bytes, fmt: Format, h: np.ndarray) -> np.ndarray:
    """Whether all three marks stand in their places behind each header."""
    raw, at = src.data, h - src.start
    ok = at + max(PLACES.values()) + 2 <= len(raw)
    for name, place in PLACES.items():
        mark, p = getattr(fmt, name), np.where(ok, at + place, 0)
        ok &= (raw[p] == mark >> 8) & (raw[np.minimum(p + 1, len(raw) - 1)] == mark & 0xFF)
    return ok


def headers(raw: np.ndarray, base: int, marker: int, last: int) -> list[np.ndarray]:
    """Positions of the header for each of the 8 bit shifts; a position needs the byte behind the header too."""
    hi, lo = marker >> 8, marker & 0xFF
    found = []
    for s in range(8):
        if s == 0:
            v = raw[:-1]
        else:
            v = (raw[:-1] >> s) | ((raw[1:] & ((1 << s) - 1)) << (8 - s)).astype(np.uint8)
        at = np.flatnonzero((v[:-1] == hi) & (v[1:] == lo)) + base
        found.append(at[at <= last])
    return found


NOTHING = np.zeros(0, np.int64)


def code(h, s, visible):
    """A block at header ``h`` of shift ``s`` that is not decided yet; headers count from ``visible`` (h + 1 to h + 59) on."""
    return -((h * 8 + s) * 64 + (visible - h) + 1)


def decoded(x) -> tuple:
    at, d = np.divmod(-x - 1, 64)
    return at // 8, at % 8, at // 8 + d


class Zone:
    """Chain elements in one byte range: ``c`` = 8 * position + bit shift, ``limit`` = state that each leads to.

    ``key`` are the codes with which the chain may enter the range, ``to`` what they lead to. ``first`` has, for each
    shift, the first header of a stretch as long as the range, AHEAD behind it; ``later`` the first header of all
    following stretches (None while that is not known; ``waiting`` says that it is needed).
    """

    def __init__(self, src: Bytes, start: int, stop: int, fmt: Format, later: list | None = None):
        self.src, self.fmt, self.start, self.stop, self.later = src, fmt, start, stop, later
        self.key = self.to = NOTHING
        self.first, self.waiting = [-1] * 8, False

    def path(self, x: int | None) -> tuple[list[int], list[tuple]]:
        """Elements on the chain that enters with ``x``, and the blocks before the first of them: (start, end, ok, seen)."""
        nxt = np.where(self.limit >= 0, np.searchsorted(self.c, self.limit, side="right"), len(self.c)).tolist()
        before: list[tuple] = []
        if x is not None and x < -1:
            before, x = self.walk(x)
        i = 0 if x is None else int(np.searchsorted(self.c, x, side="right")) if x >= -1 else len(nxt)
        out = []
        while i < len(nxt):
            out.append(i)
            i = nxt[i]
        return out, before

    def walk(self, x: int) -> tuple[list[tuple], int]:
        return [], x


class Headers(Zone):
    """A zone with the headers of all bit shifts."""

    def __init__(self, src: Bytes, start: int, stop: int, fmt: Format, later: list | None = None):
        super().__init__(src, start, stop, fmt, later)
        self.length = src.length
        # the last byte of a stream only completes what is before it
        self.usable = self.length if fmt.emit_tail else self.length - 1
        self.end_of_file = self.length * 8 + 8
        self.heads = headers(src.data, src.start, fmt.header, self.length - 3)
        if fmt.whole_heads:
            self.heads = [h[~self._in_head(h, s)] for s, h in enumerate(self.heads)]
        if src.stop < self.length:  # what follows may lie in a head that is not loaded to its end
            self.heads = [h[h < stop + AHEAD - 2] for h in self.heads]
        c = np.concatenate([h * 8 + s for s, h in enumerate(self.heads)])
        c.sort()
        self.all, self.c = c, c[(c >= start * 8) & (c < stop * 8)]
        for s, h in enumerate(self.heads):
            i = int(np.searchsorted(h, start + AHEAD - 2))
            self.first[s] = int(h[i]) if i < len(h) else -1

    def _in_head(self, at: np.ndarray, s: int) -> np.ndarray:
        """Whether headers of shift ``s`` lie behind the start of a head with all marks, and before its end."""
        if s == 0:
            h = self.heads[0]
            self.whole = h[whole_heads(self.src, self.fmt, h)]
        i = np.searchsorted(self.whole, at, side="left" if s == 0 else "right") - 1
        return (i >= 0) & (at < np.append(self.whole, UNKNOWN)[i] + HEAD)

    def next_head(self, s: int, at: np.ndarray) -> np.ndarray:
        """First header of shift ``s`` at or behind each position; -1 where there is none, UNKNOWN // 8 where that is not known."""
        h = self.heads[s]
        i = np.searchsorted(h, at)
        out = h[np.minimum(i, len(h) - 1)] if len(h) else np.zeros(len(at), np.int64)
        beyond = i >= len(h)
        if beyond.any():
            known = -1 if self.src.stop >= self.length else UNKNOWN // 8 if self.later is None else self.later[s]
            self.waiting |= known == UNKNOWN // 8
            out = np.where(beyond, -1 if known is None else known, out)
        return out


class Framed(Headers):
    """Blocks that end with a footer inside the window, else at a header."""

    def __init__(self, src: Bytes, start: int, stop: int, fmt: Format, later: list | None = None):
        super().__init__(src, start, stop, fmt, later)
        self.end = self._footers(self.c // 8)
        self.limit = (self.end - 2) * 8 - 1
        lost = np.flatnonzero(self.end < 0)
        h, s = self.c[lost] // 8, self.c[lost] % 8
        own = code(h, s, h + 1)
        self.key = self._entering()
        self._states(np.unique(np.concatenate([own, self.key])))
        self.limit[lost] = self.leads[np.searchsorted(self.codes, own)]
        self.to = self.leads[np.searchsorted(self.codes, self.key)]

    def _footers(self, h: np.ndarray) -> np.ndarray:
        """Exclusive end of the block of each header when its footer is inside the window, else -1."""
        raw, base = self.src.data, self.src.start
        foot = np.zeros(len(raw), dtype=bool)
        foot[:-1] = (raw[:-1] == self.fmt.footer >> 8) & (raw[1:] == self.fmt.footer & 0xFF)
        end = np.full(len(h), -1, dtype=np.int64)
        todo = np.arange(len(h))
        limit = min(self.usable, self.src.stop)
        behind = np.where(whole_heads(self.src, self.fmt, h), HEAD, 0) if self.fmt.whole_heads else np.zeros(len(h), np.int64)
        for k in range(0, WINDOW - 3, 2):
            p = h[todo] + 2 + k
            ok = (p + 4 <= limit) & (2 + k >= behind[todo])
            q = np.where(ok, p - base, 0)
            f = np.where(ok, h[todo] + 2 - base, 0)
            ok &= foot[q]
            ok[ok] = (raw[q[ok] + 2] == raw[f[ok]]) & (raw[q[ok] + 3] == raw[f[ok] + 1])
            end[todo[ok]] = p[ok] + 4
            todo = todo[~ok]
            if not len(todo):
                break
        return end

    def _entering(self) -> np.ndarray:
        """Codes of headers of this range whose block may have been opened by one before the range."""
        out = []
        for s, h in enumerate(self.heads):
            a, b, c = np.searchsorted(h, [self.start - WINDOW, self.start, min(self.start + WINDOW, self.stop)])
            early, own = h[a:b], h[b:c]
            for p in early.tolist():
                out += [code(x, s, p + WINDOW + 1) for x in own.tolist() if x <= p + WINDOW]
        return np.unique(np.array(out, np.int64))

    def _step(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each code the state behind its block, and the block's end (-1: none), footer and bytes seen."""
        h, s, visible = decoded(x)
        end = self._footers(h)
        ready = np.maximum(end, visible + 3)  # the byte after the queued header has been reached
        ok = (end > 0) & (visible <= h + WINDOW - 1) & (ready <= self.usable)
        to, seen = np.where(ok, (ready - 2) * 8 - 1, self.end_of_file), np.where(ok, ready, 0)
        end = np.where(ok, end, -1)
        for shift in range(8):
            at = np.flatnonzero(~ok & (s == shift))
            if not len(at):
                continue
            heads, o, v = self.heads[shift], h[at], visible[at]
            i = np.searchsorted(heads, v)
            q = np.append(heads, UNKNOWN)[i]
            queued = q < o + WINDOW + 1
            done = queued & (o + WINDOW + 4 <= self.length)
            to[at[done]], end[at[done]], seen[at[done]] = code(q[done], shift, o[done] + WINDOW + 1), q[done], o[done] + WINDOW + 3
            at, o, v = at[~queued], o[~queued], v[~queued]
            n = self.next_head(shift, np.maximum(v, o + WINDOW + 1))
            found = n >= 0
            to[at[found]], end[at[found]], seen[at[found]] = n[found] * 8 + shift - 1, n[found], n[found] + 2
        if self.fmt.emit_tail:
            tail = end < 0
            end[tail], seen[tail] = self.length, self.length
        return to, end, ok, seen

    def _states(self, codes: np.ndarray) -> None:
        """All codes that the given ones lead through inside the range, each worked out once, and where each leads in the end."""
        parts: list[tuple] = []
        todo, known = codes, codes
        while len(todo):
            parts.append((todo, *self._step(todo)))
            to = parts[-1][1]
            todo = np.setdiff1d(to[(to < -1) & (decoded(to)[0] < self.stop)], known)
            known = np.union1d(known, todo)
        joined = [np.concatenate(x) for x in zip(*parts)] if parts else [NOTHING] * 5
        order = np.argsort(joined[0])
        self.codes, self.after, self.block_end, self.block_ok, self.seen = (x[order] for x in joined)
        n = len(order)
        at = np.searchsorted(self.codes, self.after)
        inner = np.zeros(n, bool)
        fits = at < n
        inner[fits] = self.codes[at[fits]] == self.after[fits]
        self.next_code = jump = np.append(np.where(inner, at, n), n)  # n: the chain leaves these codes
        last = np.arange(n)
        while (jump[:n] < n).any():
            last = np.where(jump[:n] < n, last[np.minimum(jump[:n], n - 1)], last)
            jump = np.append(jump[jump[:n]], n)
        self.leads = self.after[last]

    def walk(self, x: int) -> tuple[list[tuple], int]:
        i = int(np.searchsorted(self.codes, x))
        if i >= len(self.codes) or self.codes[i] != x:
            return [], x  # a header behind this range
        at = []
        while i < len(self.codes):
            at.append(i)
            i = int(self.next_code[i])
        at = np.array(at)
        full = at[self.block_end[at] >= 0]
        blocks = zip(decoded(self.codes[full])[0].tolist(), self.block_end[full].tolist(), self.block_ok[full].tolist(), self.seen[full].tolist())
        return list(blocks), int(self.after[at[-1]])

    def decode(self, x: int | None, file: str) -> Iterator[pa.RecordBatch]:
        on, rest = self.path(x)
        idx = np.array(on, np.int64)
        h, end = self.c[idx] // 8, self.end[idx]
        plain = (end - h) == 60
        yield self._plain(h[plain], file)
        for i in idx[~plain]:
            h, e = int(self.c[i]) // 8, int(self.end[i])
            rest += self.walk(int(code(h, int(self.c[i]) % 8, h + 1)))[0] if e < 0 else [(h, e, True, e)]
        for at in range(0, len(rest), 10_000):
            yield pa.RecordBatch.from_pylist([one_block(self.src, self.fmt, *b, file) for b in rest[at : at + 10_000]], schema=ARROW)

    def _plain(self, h: np.ndarray, file: str) -> pa.RecordBatch:
        """Blocks of the regular size, all at once."""
        raw, fmt = self.src.data, self.fmt
        m = raw[(h - self.src.start + 2)[:, None] + np.arange(58)]
        values, where, has = {}, {}, {}
        for name in ("t3", "t2", "t1"):
            mark = getattr(fmt, name)
            hit = (m[:, :-1] == mark >> 8) & (m[:, 1:] == mark & 0xFF)
            has[name] = hit.any(axis=1)
            own = PLACES[name] - 2  # a mark in its place goes before one that arises in an earlier word
            p = np.where(hit[:, own], own, hit.argmax(axis=1))
            where[name] = p
            cut = has[name] & (p + 4 <= 58)
            q = np.minimum(p, 54)
            r = np.arange(len(h))
            values[name] = (np.where(cut, m[r, q + 2].astype(np.int64) * 256 + m[r, q + 3], 0), cut)
        level = sum((~has[n]).astype(np.int64) << (i + 1) for i, n in enumerate(("t3", "t2", "t1")))
        stamp = (values["t3"][0] << 32) | (values["t2"][0] << 16) | values["t1"][0]
        stamped = values["t3"][1] & values["t2"][1] & values["t1"][1]
        first = where["t1"] + 4
        usual = has["t1"] & (first == 14)
        lists: list = [None] * len(h)
        samples = unpack(m[usual][:, 14:54])
        if usual.all():
            flat, offsets = samples.ravel(), np.arange(len(h) + 1, dtype=np.int32) * 32
            col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        else:
            for i, v in zip(np.flatnonzero(usual), samples):
                lists[i] = v
            for i in np.flatnonzero(has["t1"] & ~usual):
                lists[i] = unpack(m[i : i + 1, first[i] : 54])[0]
            col = pa.array(lists, type=pa.list_(pa.int64()))
        n = len(h)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([file] * n, pa.string()),
                pa.array(h, pa.int64()),
                pa.array(np.full(n, 60), pa.int64()),
                pa.array(level, pa.int64()),
                pa.array(stamp, pa.int64(), mask=~stamped),
                pa.array(m[:, 0].astype(np.int64)),
                pa.array(m[:, 1].astype(np.int64)),
                col,
            ],
            schema=ARROW,
        )


def find_mark(src: Bytes, fmt: Format, name: str, h: int, end: int) -> int:
    """Place of a mark of the block [h, end): its own if it stands there, else the first; -1 if there is none."""
    word, own = getattr(fmt, name).to_bytes(2, "big"), h + PLACES[name]
    return own if own + 2 <= end and src.at(own, own + 2) == word else src.find(word, h + 2, end)


def one_block(src: Bytes, fmt: Format, h: int, end: int, ok: bool, seen: int, file: str) -> dict:
    """Any block. ``seen`` is the end of the bytes read when the block was closed."""
    at = {n: find_mark(src, fmt, n, h, end) for n in ("t3", "t2", "t1")}
    part = {n: src.at(p + 2, min(p + 4, seen)) if p >= 0 else b"" for n, p in at.items()}
    size = end - h
    level = (size != 60) | sum((at[n] < 0) << (i + 1) for i, n in enumerate(("t3", "t2", "t1"))) | (not ok) << 4
    stamp = None
    if all(len(v) == 2 for v in part.values()):
        stamp = int.from_bytes(part["t3"] + part["t2"] + part["t1"], "big")
    samples = None
    if ok and at["t1"] >= 0:
        first = at["t1"] + 4
        samples = unpack(np.frombuffer(src.at(first, max(end - 4, first)), dtype=np.uint8)[None, :])[0].tolist()
    ident = src.at(h + 2, min(h + 4, seen))
    return {
        "file": file,
        "offset": h,
        "data_block": size,
        "error_level": int(level),
        "timestamp": stamp,
        "chip": ident[0] if len(ident) > 0 else None,
        "sample_index": ident[1] if len(ident) > 1 else None,
        "samples_value": samples,
    }


class HeaderToHeader(Headers):
    """Every header starts a block that ends at the next header, of whatever shift."""

    def __init__(self, src: Bytes, start: int, stop: int, fmt: Format, later: list | None = None):
        super().__init__(src, start, stop, fmt, later)
        self.limit = self.c.copy()
        self.end = np.append(self.all, UNKNOWN)[np.searchsorted(self.all, self.c, side="right")] // 8
        if len(self.c) and self.end[-1] == UNKNOWN // 8:
            found = [n for n in (self.next_head(s, self.c[-1:] // 8 + 1)[0] for s in range(8)) if n >= 0]
            self.end[-1] = min(found, default=-1)

    def decode(self, x: int | None, file: str) -> Iterator[pa.RecordBatch]:
        rows = []
        whole = set(self.whole.tolist()) if self.fmt.whole_heads else set()
        for c, end in zip(self.c.tolist(), self.end.tolist()):
            if end < 0 and not self.fmt.emit_tail:
                continue
            h, end = c // 8, max(end if end >= 0 else self.length, c // 8 + 2)
            row = one_block(self.src, self.fmt, h, end, False, end, file)
            footer = self.src.find(self.fmt.footer.to_bytes(2, "big"), h + (HEAD if h in whole else 2), end)
            rows.append({**row, "error_level": (row["error_level"] & 14) | (footer < 0) << 4})
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class Fixed(Zone):
    """Chain elements of a stream of fixed blocks: positions with header and footer in place."""

    def __init__(self, src: Bytes, start: int, stop: int, fmt: Format, later: list | None = None):
        super().__init__(src, start, stop, fmt, later)
        size, raw, base = fmt.fixed_size, src.data, src.start
        n = max(min(stop, src.length - size + 1) - start, 0)
        h, f = raw[start - base :], raw[start - base + size - 2 :]
        hit = (h[:n] == fmt.header >> 8) & (h[1 : n + 1] == fmt.header & 0xFF)
        hit &= (f[:n] == fmt.footer >> 8) & (f[1 : n + 1] == fmt.footer & 0xFF)
        self.c = (np.flatnonzero(hit) + start) * 8
        self.limit = self.c + size * 8 - 1

    def decode(self, x: int | None, file: str) -> Iterator[pa.RecordBatch]:
        size = self.fmt.fixed_size
        h = self.c[np.array(self.path(x)[0], np.int64)] // 8
        m = self.src.data[(h - self.src.start)[:, None] + np.arange(size)].astype(np.int64)
        a, b = m[:, 2], m[:, 3]
        chip, index = (a, b) if self.fmt.chip_first else (b, a)
        samples = unpack(m[:, size - 42 : size - 2].astype(np.uint8))
        stamp = None
        if size == 58:
            p = [m[:, i] * 256 + m[:, i + 1] for i in (6, 10, 14)]
            stamp = (p[0] << 32) | (p[1] << 16) | p[2]
        n = len(h)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 32), pa.array(samples.ravel()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([file] * n, pa.string()),
                pa.array(h, pa.int64()),
                pa.array(np.full(n, size), pa.int64()),
                pa.array(np.zeros(n, dtype=np.int64)),
                pa.nulls(n, pa.int64()) if stamp is None else pa.array(stamp),
                pa.array(chip),
                pa.array(index),
                flat,
            ],
            schema=ARROW,
        )


def unpack(body: np.ndarray) -> np.ndarray:
    """10-bit numbers, first bit first, of every row of bytes; cut-off numbers are dropped."""
    n = body.shape[1] * 8 // 10
    bit = np.arange(n) * 10
    k = bit // 8
    wide = np.concatenate([body, np.zeros((len(body), 1), np.uint8)], axis=1).astype(np.int64)
    return ((wide[:, k] * 256 + wide[:, k + 1]) >> (6 - bit % 8)) & 1023


# ---------------------------------------------------------------- the scan

def byte_ranges(spark: SparkSession, path: str, range_bytes: int, max_bytes: int | None) -> DataFrame:
    """(file, length, start) for every byte range; only the file listing is read here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    length = F.col("length") if max_bytes is None else F.least(F.col("length"), F.lit(max_bytes))
    listed = files.select(F.col("path").alias("file"), length.alias("length")).filter("length > 0")
    return listed.select("file", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))


KINDS = {"framed": Framed, "headers": HeaderToHeader, "fixed58": Fixed, "fixed46": Fixed}
STEP_LISTS = ["later", "upto", "out", "key", "to", "first"]
STEP = "file string, length bigint, start bigint, " + ", ".join(f"{n} array<bigint>" for n in STEP_LISTS) + ", waiting boolean"
STEP_ARROW = pa.schema(
    [("file", pa.string()), ("length", pa.int64()), ("start", pa.int64()), *[(n, pa.list_(pa.int64())) for n in STEP_LISTS], ("waiting", pa.bool_())]
)


def read_blocks(
    spark: SparkSession, path: str, fmt: Format = Format(), *, range_bytes: int = 32 << 20, tasks: int | None = None
) -> DataFrame:
    """One row per block of all files below ``path``, ordered by (file, offset) where order matters.

    The file and offset columns take the place of the implicit stream order. Ranges are spread evenly over ``tasks``
    tasks (default: TASK_BYTES each, at least four per core, at most 100,000); a range is the unit of memory. Damaged streams cost time in proportion
    to their length, too: a range is read with a fixed margin, twice, and a third time if some block of the file waits for
    a header beyond the margin. The bytes of a long gap are looked through once, when its block is decoded.

    In the layout ``headers`` error_level has the bits 2, 4, 8 for a missing marker and 16 for a missing footer mark, and
    the last header of a file starts a block only with ``emit_tail``. Empty files and files without headers give no rows.
    """
    kind = KINDS[fmt.layout]
    ranges = byte_ranges(spark, path, range_bytes, fmt.max_bytes)
    if not tasks:
        n = ranges.count()
        tasks = max(1, min(n, 100_000, max(n * range_bytes // TASK_BYTES, 4 * spark.sparkContext.defaultParallelism)))

    def load(row: dict) -> tuple[Bytes, Zone]:
        stop = min(row["start"] + range_bytes, row["length"])
        src = Bytes(row["file"], row["start"], stop, row["length"])
        return src, kind(src, row["start"], stop, fmt, row["later"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                src, zone = load(row)
                src.close()
                made = dict(zip(("upto", "out", "key", "to"), (x.tolist() for x in zone_map(zone))))
                yield pa.RecordBatch.from_pylist([{**row, **made, "first": zone.first, "waiting": zone.waiting}], schema=STEP_ARROW)

    # an explicit number of tasks: the rows are tiny, and adaptive execution would put them all into one
    spread = lambda df: df.select("file", "length", "start", "later").repartition(tasks, "file", "start")
    steps = materialize(spread(ranges.withColumn("later", F.lit(None).cast("array<bigint>"))).mapInArrow(maps, STEP))
    if not steps.filter("waiting").isEmpty():
        behind = "over (partition by file order by start rows between 1 following and unbounded following)"
        later = F.array(*[F.expr(f"min(case when first[{s}] >= 0 then first[{s}] end) {behind}") for s in range(8)])
        steps = materialize(spread(steps.select("file", "length", "start", later.alias("later"))).mapInArrow(maps, STEP))
    known = materialize(_entries(steps, range_bytes))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                src, zone = load(row)
                yield from zone.decode(row["entry"], row["file"])
                src.close()

    return known.repartition(tasks, "file", "start").mapInArrow(decode, BLOCKS)


def zone_map(zone: Zone) -> tuple[np.ndarray, ...]:
    """(upto, out, key, to): a limit x enters at the first element > x, so it leaves as at the first run with upto > x; a
    code that is a key leaves as its ``to``; everything else passes by."""
    c, limit, n = zone.c, zone.limit, len(zone.c)
    jump = np.append(np.where(limit >= 0, np.searchsorted(c, limit, side="right"), n), n)
    last = np.arange(n)
    while (jump[:n] < n).any():  # pointer doubling: the last element of the chain that starts at each
        last = np.where(jump[:n] < n, last[np.minimum(jump[:n], n - 1)], last)
        jump = np.append(jump[jump[:n]], n)
    out = limit[last]
    to = onward(zone.to, c, out, NOTHING, NOTHING)
    close = np.append(out[1:] != out[:-1], True) if n else np.zeros(0, bool)
    return c[close], out[close], zone.key, to


def onward(x: np.ndarray, upto: np.ndarray, out: np.ndarray, key: np.ndarray, to: np.ndarray) -> np.ndarray:
    """States behind a stretch of zones for states in front of it."""
    res = x.copy()
    if len(upto):
        i = np.searchsorted(upto, x, side="right")
        on = (x >= 0) & (i < len(upto))
        res[on] = out[i[on]]
    if len(key):
        i = np.minimum(np.searchsorted(key, x), len(key) - 1)
        on = key[i] == x
        res[on] = to[i[on]]
    return res


def compose_zones(zones: list[tuple]) -> tuple[np.ndarray, ...]:
    """The map of several zones in a row, worked out from the last zone backwards. Keys fall with the position."""
    upto, out = (np.concatenate([z[i] for z in zones]) for i in (0, 1))
    key = to = NOTHING
    end = len(upto)
    for u, _, k, t in reversed(zones):
        start = end - len(u)
        behind = upto[end:], out[end:], key, to
        out[start:end] = onward(out[start:end], *behind)
        key, to = np.concatenate([key, k]), np.concatenate([to, onward(t, *behind)])
        end = start
    close = np.append(out[1:] != out[:-1], True) if len(out) else np.zeros(0, bool)
    return upto[close], out[close], key, to


def run_zones(zones: list[tuple], x: int | None) -> list:
    """States in front of every zone; None means "before everything"."""
    at = []
    for z in zones:
        at.append(x)
        if x is None:
            x = int(z[1][0]) if len(z[1]) else None
        else:
            x = int(onward(np.array([x], np.int64), *z)[0])
    return at


def _entries(steps: DataFrame, range_bytes: int) -> DataFrame:
    """(file, length, start, later, entry) of every range with headers: the state in which the chain enters it."""
    group = F.floor(F.col("start") / F.lit(range_bytes * RANGES_PER_GROUP)).cast("bigint")
    steps = steps.filter("size(upto) > 0").withColumn("_group", group)
    names = ["upto", "out", "key", "to"]

    def zones(pdf: pd.DataFrame) -> list:
        return [tuple(np.asarray(x, np.int64) for x in z) for z in zip(*(pdf[n] for n in names))]

    def grouped(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, *compose_zones(zones(pdf.sort_values("start")))]], columns=["file", "_group", *names])

    def entries(order: str, cols: list[str]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            lead = int(pdf["entry"].iloc[0]) if "entry" in pdf.columns else -1
            at = run_zones(zones(pdf), None if lead == -1 else lead)
            got = pdf[cols].copy()
            got["entry"] = np.asarray([-1 if x is None else x for x in at], dtype=np.int64)
            return got

        return run

    shape = ", ".join(f"{n} array<bigint>" for n in names)
    groups = steps.groupBy("file", "_group").applyInPandas(grouped, f"file string, _group bigint, {shape}")
    leads = groups.groupBy("file").applyInPandas(entries("_group", ["file", "_group"]), "file string, _group bigint, entry bigint")
    return steps.join(leads, ["file", "_group"]).groupBy("file", "_group").applyInPandas(
        entries("start", ["file", "length", "start", "later"]), "file string, length bigint, start bigint, later array<bigint>, entry bigint"
    )


def write_blocks(
    blocks: DataFrame, folder: str, stream: str, order: list[str | Column], *, samples: str = "samples_value", gap: bytes = b"", tail: bytes = b"\0" * 4,
    alter: Callable[[Column], Column] = lambda body: body,
) -> DataFrame:
    """Write blocks (chip, sample_index, timestamp and ``samples``) as byte streams, one or more files per stream.

    ``samples`` is a column or an SQL expression; an expression is evaluated behind the ordering shuffle. ``alter`` may
    change the bytes of a block.

    Returns the written files. Rows are range-partitioned by (stream, order), so a long stream is spread over several
    tasks, each with its own file. A file is written under a name that no reader lists and of this attempt alone, and gets
    its own name when it is whole, so a repeated or second copy of a task never mixes with the first.
    """
    body = encode_block(F.col("chip"), F.col("sample_index"), F.col("timestamp"), "_v")
    placed = blocks.repartitionByRange(stream, *order).sortWithinPartitions(stream, *order).withColumn("_v", F.expr(samples))
    rows = placed.select(F.col(stream).cast("string").alias("s"), F.concat(alter(body), F.lit(gap)).alias("b"))

    def sink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyarrow import fs
        from pyspark import TaskContext

        target, base = fs.FileSystem.from_uri("/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder)
        task = TaskContext.get()
        part = f"part-{task.partitionId():05d}"
        name, out, n = None, None, 0
        done = []

        def finish() -> None:
            if out is not None:
                out.write(tail)
                out.close()
                target.move(f"{base}/{name}/{hidden}", f"{base}/{name}/{part}.bin")
                done.append({"file": f"{base}/{name}/{part}.bin", "blocks": n})

        hidden = f"_{part}-{task.taskAttemptId()}.bin"
        for batch in batches:
            at = 0
            for run in pc.run_end_encode(batch.column(0)).run_ends.to_pylist():
                s = batch.column(0)[at].as_py()
                if s != name:
                    finish()
                    target.create_dir(f"{base}/{s}", recursive=True)
                    name, out, n = s, target.open_output_stream(f"{base}/{s}/{hidden}"), 0
                out.write(b"".join(batch.column(1)[at:run].to_pylist()))
                n, at = n + run - at, run
        finish()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return materialize(rows.mapInArrow(sink, "file string, blocks bigint"))
