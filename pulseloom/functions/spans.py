"""Pulse spans of whole batches of waves at once, in Arrow batches; ``waveform.pulse_spans`` is the form that stays in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int>>"


def _next_true(flag: np.ndarray) -> np.ndarray:
    """For every place the first place at or behind it where ``flag`` holds, the length if there is none; one more entry at the end."""
    at = np.where(np.append(flag, False), np.arange(len(flag) + 1), len(flag))
    return np.minimum.accumulate(at[::-1])[::-1]


def _walk(x: np.ndarray, begin: np.ndarray, end: np.ndarray, rise: float, fall: float, pre: int, post: int, minlen: int):
    """(wave, start, end) of all pulses in waves x[begin:end]; every step takes one pulse of each wave that still has one."""
    up, down = _next_true(x >= rise), _next_true(x <= fall)
    wave = np.flatnonzero(begin < end)
    at = begin[wave]
    found = []
    while len(wave):
        first = up[at]
        live = first < end[wave]
        wave, first = wave[live], first[live]
        last = down[first + 1]
        stop = np.where(last < end[wave], np.minimum(end[wave], last + 1 + post), end[wave])
        start = np.maximum(begin[wave], first - pre)
        long = stop - start >= minlen
        found.append((wave[long], (start - begin[wave])[long], (stop - begin[wave])[long]))
        open_ = stop < end[wave]
        wave, at = wave[open_], stop[open_]
    if not found:
        found.append((wave, wave, wave))
    of, start, stop = (np.concatenate(part) for part in zip(*found))
    order = np.argsort(of, kind="stable")
    return of[order], start[order], stop[order]


def _lists(lengths: np.ndarray, values: pa.Array, null: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(null))


def _shape(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, lists.is_null().to_numpy(zero_copy_only=False)


def wave_spans(waves: Column, *, rise: float, fall: float, pre: int, post: int, minlen: int) -> Column:
    """Spans of every wave of an array of waves: array of arrays of (start, end).

    Successors of rises and falls are read off the flattened samples of a batch, so the work is linear in the samples,
    however many pulses a wave holds: the form for long waves. A null sample passes no test; a null wave has null spans,
    an empty one no spans. Select it into a column of its own; it is marked as not deterministic, so that the optimizer
    does not move it into filters or expressions that cannot call Python.
    """

    @F.arrow_udf(f"array<{SPANS}>")
    def spans(batch: pa.Array) -> pa.Array:
        outer, no_waves = _shape(batch)
        inner = batch.flatten()
        sizes, no_wave = _shape(inner)
        x = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        end = np.cumsum(sizes)
        of, start, stop = _walk(x, end - sizes, end, rise, fall, pre, post, minlen)
        pairs = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["start", "end"])
        return _lists(outer, _lists(np.bincount(of, minlength=len(sizes)), pairs, no_wave), no_waves)

    return spans.asNondeterministic()(waves.cast("array<array<double>>"))
