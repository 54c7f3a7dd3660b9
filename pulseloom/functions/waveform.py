"""Waveform functions: ``Column -> Column`` on arrays of samples, all evaluated in the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_PER_MS = 320_000.0  # 320 MHz clock
SAMPLE = "array<bigint>"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column | str, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable.

    Without this an array expression that is used inside a lambda would be computed again for every element.
    """
    return F.get(F.transform(F.array(_c(value)), body), F.lit(0))


def bound(fn):
    """Let-bind the first argument of a wave function."""

    @functools.wraps(fn)
    def wrapper(w, *args, **kwargs):
        return let(w, lambda v: fn(v, *args, **kwargs))

    return wrapper


def total(w: Column) -> Column:
    """Sum of the samples as double; a null sample counts 0."""
    return F.aggregate(_c(w), F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))


def total_long(w: Column) -> Column:
    return F.aggregate(_c(w), F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x.cast("bigint"), F.lit(0)))


@bound
def mean_of(w: Column) -> Column:
    """Mean, null for an empty array."""
    return total(w) / F.nullif(F.size(w).cast("double"), F.lit(0.0))


def head(w: Column, n: int) -> Column:
    return F.slice(_c(w), 1, n)


def prefix(w: Column, n: Column) -> Column:
    return F.slice(w, F.lit(1), n)


def window_of(w: Column, start: Column, end: Column) -> Column:
    """Elements with 0-based index in [start, end)."""
    return F.slice(w, start + 1, F.greatest(end - start, F.lit(0)))


def indices_where(w: Column, test) -> Column:
    """0-based positions of the samples that pass ``test``; one lambda call per sample."""
    w = _c(w)
    at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: test(F.get(w, i)))
    return F.when(F.size(w) > 0, at).otherwise(F.array().cast("array<int>"))


# ---------------------------------------------------------------- baselines

@bound
def subtract_first(w: Column, n: int = 10) -> Column:
    """Subtract the mean of the first min(n, size) samples; result rounded half to even; empty for null or empty."""
    w = _c(w)
    moved = let(mean_of(head(w, n)), lambda b: F.transform(w, lambda x: F.rint(x - b).cast("bigint")))
    return F.when(w.isNull() | (F.size(w) == 0), F.array().cast(SAMPLE)).otherwise(moved)


def per_channel(sv: Column, fn) -> Column:
    """Apply a wave function to every channel of ``[channel][sample]``; a null row gives an empty array."""
    sv = _c(sv)
    return F.coalesce(F.transform(sv, fn), F.array().cast("array<array<bigint>>"))


def baseline_first(sv: Column, n: int = 10) -> Column:
    return per_channel(sv, lambda w: subtract_first(w, n))


@bound
def mode_value(w: Column, *, ties: str = "smallest") -> Column:
    """Most frequent sample; ties go to the smallest value or to the value seen first."""
    w = _c(w)
    rank = (lambda v: -v) if ties == "smallest" else (lambda v: -F.array_position(w, v))
    best = F.array_max(
        F.transform(
            F.array_distinct(w),
            lambda v: F.struct(F.size(F.filter(w, lambda x: x == v)).alias("n"), rank(v).alias("r"), v.alias("v")),
        )
    )
    return best["v"]


@bound
def subtract_mode(w: Column, *, ties: str = "smallest", first: int | None = None) -> Column:
    """Subtract the mode; with ``first`` only that many leading samples are used and returned."""
    w = _c(w)
    part = head(w, first) if first else w
    moved = let(mode_value(part, ties=ties), lambda b: F.transform(part, lambda x: x - b))
    return F.when(w.isNull() | (F.size(w) == 0), F.array().cast(SAMPLE)).otherwise(moved.cast(SAMPLE))


def baseline_mode(sv: Column) -> Column:
    return per_channel(sv, lambda w: subtract_mode(w))


# ---------------------------------------------------------------- pulse extraction

@bound
def segment_pulse(
    w: Column, *, up: float = 100, down: float = 100, pre: int = 12, post: int = 12, baseline_samples: int = 10
) -> Column:
    """Cut the single pulse of a wave, with a baseline taken in two steps; null where there is none.

    Step 1 uses the mean of the first and last 11 samples. The cut runs from ``pre`` samples before the
    first sample >= up to ``post`` samples after the next one < down (or after the last sample).
    Step 2 subtracts the mean of the first ``baseline_samples`` of the cut.
    """
    n = F.size(w)
    base = total(F.concat(head(w, 11), F.slice(w, -11, 11))) / F.lit(22.0)

    def cut(y: Column) -> Column:
        rise = F.array_position(F.transform(y, lambda v: v >= up), F.lit(True)).cast("int") - 1
        return let(rise, lambda r: F.when(r >= 0, let(fall_after(y, r), lambda f: window_of(y, F.greatest(F.lit(0), r - pre), F.least(n, f + post)))))

    def fall_after(y: Column, rise: Column) -> Column:
        below = F.array_position(F.transform(y, lambda v, i: (v < down) & (i >= rise)), F.lit(True)).cast("int")
        return F.coalesce(F.nullif(below, F.lit(0)), n) - 1

    def rebase(seg: Column) -> Column:
        second = total(F.slice(seg, 1, baseline_samples)) / F.lit(float(baseline_samples))
        return F.when(F.size(seg) >= baseline_samples, let(second, lambda b: F.transform(seg, lambda v: v - b)))

    moved = let(base, lambda b: F.transform(w, lambda x: x.cast("double") - b))
    return F.when(F.coalesce(n, F.lit(0)) >= 20, let(let(moved, cut), rebase))


SPANS = "array<struct<start:int,end:int>>"


@bound
def pulse_spans(w: Column, *, rise: float, fall: float, pre: int, post: int, minlen: int) -> Column:
    """Spans [start, end) of the pulses of one wave.

    A pulse opens at a sample >= rise and closes at the next later sample <= fall; ``pre``/``post`` samples are
    added, the search goes on behind the end, and a pulse still open at the last sample is closed there.
    Only samples above ``rise`` are walked, not every sample.
    """
    n = F.size(w)
    state = F.struct(F.lit(0).alias("next"), F.array().cast(SPANS).alias("spans"))
    edges = F.struct(indices_where(w, lambda x: x >= rise).alias("ups"), indices_where(w, lambda x: x <= fall).alias("downs"))

    def walk(e: Column) -> Column:
        def close(acc: Column, i: Column, down: Column) -> Column:
            start = F.greatest(F.lit(0), i - pre)
            end = F.coalesce(F.least(n, down + 1 + post), n)
            span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
            spans = F.when(end - start >= minlen, F.concat(acc["spans"], span)).otherwise(acc["spans"])
            return F.struct(end.cast("int").alias("next"), spans.cast(SPANS).alias("spans"))

        def visit(acc: Column, i: Column) -> Column:
            after = F.get(F.filter(e["downs"], lambda d: d > i), F.lit(0))
            return F.when(i >= acc["next"], let(F.coalesce(after, F.lit(-1)), lambda d: close(acc, i, F.nullif(d, F.lit(-1))))).otherwise(acc)

        return F.aggregate(e["ups"], state, visit)["spans"]

    return let(edges, walk)


def find_pulses(
    sv: Column | str,
    ts: Column | str,
    chip: Column | str,
    *,
    rise: float = 50,
    fall: float = 10,
    pre: int = 10,
    post: int = 8,
    minlen: int = 4,
    keep_original: bool = True,
) -> Column:
    """Pulses of all channels: array of (original, pulse, index, time, chip, channel)."""
    sv, ts, chip = _c(sv), _c(ts), _c(chip)

    def channel(wave: Column, ch: Column) -> Column:
        def cuts(x: Column) -> Column:
            def cut(s: Column) -> Column:
                fields = [
                    window_of(x, s["start"], s["end"]).cast(SAMPLE).alias("pulse"),
                    F.sequence(s["start"], s["end"] - 1).cast(SAMPLE).alias("index"),
                    window_of(ts, s["start"], s["end"]).cast(SAMPLE).alias("time"),
                    chip.cast("bigint").alias("chip"),
                    ch.cast("bigint").alias("channel"),
                ]
                return F.struct(x.cast(SAMPLE).alias("original"), *fields) if keep_original else F.struct(*fields)

            return F.transform(pulse_spans(x, rise=rise, fall=fall, pre=pre, post=post, minlen=minlen), cut)

        return let(prefix(wave, F.least(F.size(wave), F.size(ts))), cuts)

    def channels(waves: Column) -> Column:
        # a null wave has no pulses
        return F.flatten(F.filter(F.transform(waves, channel), lambda found: found.isNotNull()))

    # nothing to search is nothing found
    return F.coalesce(F.when(sv.isNotNull() & ts.isNotNull(), let(sv, channels)), F.array())


def as_parallel_arrays(items: Column | str) -> Column:
    """Struct of arrays (pulses, original_index, timestamps, chip, channel) from the array of pulses."""
    items = _c(items)
    return F.struct(
        items["pulse"].alias("pulses"),
        items["index"].alias("original_index"),
        items["time"].alias("timestamps"),
        items["chip"].alias("chip"),
        items["channel"].alias("channel"),
    )


# ---------------------------------------------------------------- features

def peak(w: Column) -> Column:
    return F.array_max(_c(w))


@bound
def peak_position(w: Column) -> Column:
    """1-based position of the first maximum; null for null or empty."""
    w = _c(w)
    return F.nullif(F.array_position(w, F.array_max(w)), F.lit(0).cast("bigint")).cast("int")


def peak_time_ms(w: Column, times: Column, ticks_per_ms: float = TICKS_PER_MS) -> Column:
    return F.try_element_at(_c(times), peak_position(w)).cast("double") / F.lit(ticks_per_ms)


def start_time_ms(times: Column, ticks_per_ms: float = TICKS_PER_MS) -> Column:
    return F.try_element_at(_c(times), F.lit(1)).cast("double") / F.lit(ticks_per_ms)


def global_channel(chip: Column, channel: Column) -> Column:
    return _c(chip) * 32 + _c(channel)


@bound
def normalized(w: Column) -> Column:
    w = _c(w)
    top = F.array_max(w).cast("double")
    return F.transform(w, lambda x: F.try_divide(x.cast("double"), top))


@bound
def crossings_up(w: Column, thr: float, *, from_start: bool = False) -> Column:
    """0-based positions where the wave goes from <= thr to > thr; ``from_start`` also counts a wave that begins above."""
    w = _c(w)
    lead = (lambda i: (i == 0) | (F.get(w, i - 1) <= thr)) if from_start else (lambda i: (i > 0) & (F.get(w, i - 1) <= thr))
    marks = F.transform(w, lambda x, i: F.when((x > thr) & lead(i), i))
    return F.filter(marks, lambda i: i.isNotNull())


@bound
def crossings_down(w: Column, thr: float) -> Column:
    """0-based positions where the wave goes from > thr to <= thr."""
    w = _c(w)
    marks = F.transform(w, lambda x, i: F.when((x <= thr) & (i > 0) & (F.get(w, i - 1) > thr), i))
    return F.filter(marks, lambda i: i.isNotNull())


@bound
def max_step(w: Column) -> Column:
    """Largest absolute difference between neighbouring samples."""
    w = _c(w)
    return F.array_max(F.transform(w, lambda x, i: F.when(i > 0, F.abs(x - F.get(w, i - 1)))))


@bound
def acceptance(y: Column, *, threshold: float = 200) -> Column:
    """True where a baseline-free wave of 60 samples passes all seven pulse cuts."""
    y = _c(y)
    ups, downs = crossings_up(y, threshold), crossings_down(y, threshold)
    lead, tail = F.slice(y, 1, 10), F.slice(y, 11, 50)
    one_pulse = F.size(ups) * F.size(downs) == 1
    width = F.get(downs, F.lit(0)) - F.get(ups, F.lit(0)) >= 4
    return (
        one_pulse
        & F.forall(tail, lambda v: v.between(-50, 50))
        & F.forall(lead, lambda v: v.between(-10, 1000))
        & (F.array_max(lead) > 100)
        & (total_long(lead) > 400)
        & F.coalesce(width, F.lit(False))
        & (F.coalesce(max_step(lead), F.lit(0)) <= 200)
    )


@bound
def acceptance_simple(w: Column) -> Column:
    """50 < samples < 65 and a maximum of more than 50 above the mean of the first 10 samples."""
    w = _c(w)
    return (F.size(w) > 50) & (F.size(w) < 65) & (F.array_max(w).cast("double") - mean_of(head(w, 10)) > 50)


# ---------------------------------------------------------------- pedestal and noise

def pedestal(sv: Column, samples: int = 64) -> Column:
    """Per channel (mean, rms) of the first samples; rms is the population form."""
    def channel(w: Column) -> Column:
        h = head(w, samples)
        n = F.greatest(F.size(h), F.lit(1)).cast("double")
        moments = F.transform(
            F.array(total(h) / n),
            lambda m: F.struct(
                m.alias("mean"),
                F.sqrt(F.aggregate(h, F.lit(0.0), lambda acc, x: acc + F.pow(x.cast("double") - m, F.lit(2.0))) / n).alias("rms"),
            ),
        )
        return F.get(moments, F.lit(0))

    return F.transform(_c(sv), channel)


def equivalent_noise_charge(rms: Column, *, ch2mv: float = 2000.0 / 1024.0, gain: float = 20.0) -> Column:
    """Noise in electrons: 6241 electrons per femtocoulomb, ``gain`` in mV/fC."""
    return F.lit(6241.0) * F.lit(ch2mv) * _c(rms) / F.lit(gain)


# ---------------------------------------------------------------- ranges

def in_range(x: Column, lo: float, hi: float, inclusive: str = "both") -> Column:
    """Range test; ``inclusive`` is both, left, right or neither; reversed bounds are swapped."""
    if inclusive not in ("both", "left", "right", "neither"):
        raise ValueError(f"inclusive: {inclusive}")
    lo, hi = min(lo, hi), max(lo, hi)
    low = x >= lo if inclusive in ("both", "left") else x > lo
    high = x <= hi if inclusive in ("both", "right") else x < hi
    return low & high


def within_range(a: Column, lo: float, hi: float, *, inclusive: str = "both", absolute: bool = False, finite_only: bool = True) -> Column:
    """Elements in the range; bounds may come in either order. Without ``finite_only`` an infinite element can be in an open range."""
    lo, hi = min(lo, hi), max(lo, hi)
    size = F.abs if absolute else (lambda x: x)
    inside = lambda x: in_range(size(x), lo, hi, inclusive) & ~F.isnan(x.cast("double"))
    return F.filter(_c(a), lambda x: inside(x) & (F.abs(x.cast("double")) < float("inf")) if finite_only else inside(x))


@bound
def within_range_indices(a: Column, lo: float, hi: float, *, inclusive: str = "both", absolute: bool = False) -> Column:
    size = F.abs if absolute else (lambda x: x)
    return indices_where(a, lambda x: in_range(size(x), lo, hi, inclusive))


def trim_ms_to_ns(a: Column, lo: float | None = None, hi: float | None = None, *, inclusive: bool = True) -> Column:
    """Values inside the range, converted from ms to ns; NaN and null are left out, a missing bound is open."""
    lo, hi = float("-inf") if lo is None else lo, float("inf") if hi is None else hi
    kept = F.filter(
        _c(a),
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & in_range(x, lo, hi, "both" if inclusive else "neither"),
    )
    return F.transform(kept, lambda x: x.cast("double") * 1e6)


@bound
def transpose(rows: Column) -> Column:
    """``[block][channel]`` -> ``[channel][block]``, cut to the shortest row."""
    rows = _c(rows)
    shortest = F.array_min(F.transform(rows, lambda r: F.size(r)))
    empty = F.array().cast("array<array<bigint>>")
    turned = F.transform(
        F.sequence(F.lit(0), shortest - 1), lambda c: F.transform(rows, lambda r: F.get(r, c))
    )
    return F.when(F.coalesce(shortest, F.lit(0)) > 0, turned).otherwise(empty)
