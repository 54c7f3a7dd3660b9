"""Histograms as grouped counts with edges that agree exactly with uniform-edge binning on doubles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseloom.operators.fits import finite
from pulseloom.operators.position import BUCKET_ROWS, with_position


def uniform_bin(x: Column, lo: float | Column, width: float | Column, n: int | Column, hi: float | Column) -> Column:
    """Bin number in 0..n-1 of half-open bins, the last bin closed at ``hi``; null outside."""
    lo, width, n, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, width, n, hi))
    x = x.cast("double")
    guess = F.floor((x - lo) / width)
    edge = lambda b: lo + b.cast("double") * width
    # the quotient may round across an edge; the edge itself decides
    low = F.when(x < edge(guess), guess - 1).otherwise(guess)
    both = F.when((x >= edge(guess + 1)) & (guess < n - 1), guess + 1).otherwise(low)
    return F.when((x >= lo) & (x <= hi), F.least(both, n - 1)).cast("bigint")


def fixed_width(start: float, end: float, size: float) -> tuple[float, float, int]:
    """Number of bins of a fixed width that cover ``end``; returns (lo, hi, n)."""
    n = math.ceil((end - start) / size)
    if start + size * n < end - 1e-12:
        n += 1
    return start, start + size * n, n


def hist1d(
    df: DataFrame,
    value: str | Column,
    lo: float,
    hi: float,
    n: int,
    *,
    by: Sequence[str] = (),
    weight: str | Column | None = None,
) -> DataFrame:
    """(by.., bin, left, right, center, n) with empty bins; values outside and non-finite ones are dropped."""
    by = list(by)
    lo, hi = float(lo), float(hi)
    width = (hi - lo) / n
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    amount = F.count(F.lit(1)) if weight is None else F.sum(F.col("_w"))
    rows = df.select(*by, x.alias("_x"), *([] if weight is None else [(F.col(weight) if isinstance(weight, str) else weight).alias("_w")]))
    counted = rows.withColumn("bin", F.when(finite(F.col("_x")), uniform_bin(F.col("_x"), lo, width, n, hi))).groupBy(*by, "bin").agg(amount.alias("n"))
    # at most n + 1 rows per group from here: one row per group with its bins, then the full set of bins
    entries = F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))
    per_group = counted.groupBy(*by).agg(F.map_from_entries(entries).alias("_bins"))
    zero = F.lit(0).cast(counted.schema["n"].dataType)
    full = per_group.select(*by, "_bins", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("bin"))
    return _with_edges(full.select(*by, "bin", F.coalesce(F.try_element_at("_bins", F.col("bin")), zero).alias("n")), lo, width)


def _with_edges(h: DataFrame, lo, width) -> DataFrame:
    lo, width = (v if isinstance(v, Column) else F.lit(v) for v in (lo, width))
    left = lo + F.col("bin").cast("double") * width
    right = lo + (F.col("bin") + 1).cast("double") * width
    return h.withColumns({"left": left, "right": right, "center": F.lit(0.5) * (left + right)})


def min_max(df: DataFrame, value: str) -> tuple[float, float] | None:
    """Range of the finite values: one row to the driver, as parameters of a following plan."""
    r = df.filter(finite(F.col(value))).agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b")).first()
    return None if r["a"] is None else (r["a"], r["b"])


def value_counts_cumulative(df: DataFrame, value: str, width: int = BUCKET_ROWS) -> DataFrame:
    """Distinct values with the number of rows before and up to each of them.

    Rows are first reduced to distinct values, so a frequent value is one row; the prefix sum runs per bucket
    of bounded size and over one row per bucket.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    placed = with_position(counts, [value], "_pos").withColumn("_bucket", F.floor(F.col("_pos") / F.lit(width)).cast("bigint"))
    sums = placed.groupBy("_bucket").agg(F.sum("n").alias("_n")).select(
        "_bucket",
        F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
    )
    upto = W.partitionBy("_bucket").orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        placed.withColumn("_run", F.sum("n").over(upto))
        .join(sums, "_bucket")
        .select(value, "n", (F.col("_base") + F.col("_run")).alias("upto"), (F.col("_base") + F.col("_run") - F.col("n")).alias("before"))
    )


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation (two order statistics per quantile reach the driver)."""
    cum = value_counts_cumulative(df.filter(finite(F.col(value))), value)
    total = cum.agg(F.max("upto")).first()[0]
    return _quantiles(cum, value, total, probs) if total else []


def _quantiles(cum: DataFrame, value: str, total: int, probs: Sequence[float]) -> list[float]:
    ranks = sorted({f((total - 1) * p) for p in probs for f in (math.floor, math.ceil)})
    want = F.array(*[F.lit(int(r)).cast("bigint") for r in ranks])
    hits = cum.select(value, F.explode(F.filter(want, lambda r: (r >= F.col("before")) & (r < F.col("upto")))).alias("rank"))
    at = {r["rank"]: float(r[value]) for r in hits.collect()}
    out = []
    for p in probs:
        h = (total - 1) * p
        a, b = at[math.floor(h)], at[math.ceil(h)]
        out.append(a + (b - a) * (h - math.floor(h)))
    return out


def auto_bins(df: DataFrame, value: str, *, integers: bool = False) -> tuple[float, float, int]:
    """(lo, hi, n) by the larger of the Sturges and the Freedman-Diaconis number of bins, the latter limited
    by the square-root rule; integer data never get bins narrower than 1."""
    return _auto_bins(value_counts_cumulative(df.filter(finite(F.col(value))), value), value, integers)


def hist1d_auto(df: DataFrame, value: str, *, integers: bool = False) -> DataFrame:
    """``hist1d`` with automatic bins. Rows are read once, into a table of distinct values and their counts, from which
    range, quartiles and the histogram itself are read. Without a finite value there is one empty bin from 0 to 1."""
    counts = value_counts_cumulative(df.filter(finite(F.col(value))), value)
    lo, hi, n = _auto_bins(counts, value, integers)
    return hist1d(counts, value, lo, hi, n, weight="n")


def _auto_bins(cum: DataFrame, value: str, integers: bool) -> tuple[float, float, int]:
    r = cum.agg(
        F.max("upto").alias("n"), F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b")
    ).first()
    if not r["n"]:
        return 0.0, 1.0, 1
    lo, hi, count = r["a"], r["b"], r["n"]
    if lo == hi:
        return lo - 0.5, hi + 0.5, 1
    q1, q3 = _quantiles(cum, value, count, [0.25, 0.75])
    sturges = (hi - lo) / (math.log2(count) + 1.0)
    root = (hi - lo) / math.sqrt(count)
    fd = 2.0 * (q3 - q1) * count ** (-1.0 / 3.0)
    width = min(max(fd, root / 2), sturges)
    if integers and width < 1:
        width = 1.0
    return lo, hi, max(1, math.ceil((hi - lo) / width))


def overflow_bin(x: Column, lo: float, hi: float, n_edges: int) -> Column:
    """0 below ``lo``, 1..n_edges-1 inside (half-open), n_edges from ``hi`` on; null and NaN have no bin."""
    n = n_edges - 1
    lo, hi = float(lo), float(hi)
    width = (hi - lo) / n
    x = x.cast("double")
    inside = uniform_bin(x, lo, width, n, hi) + 1
    return F.when(x.isNull() | F.isnan(x), None).when(x < lo, F.lit(0)).when(x >= hi, F.lit(n_edges)).otherwise(inside).cast("bigint")


def hist1d_overflow(df: DataFrame, value: str, lo: float, hi: float, n_edges: int) -> DataFrame:
    """(bin, n, place) where place is under, in or over; only bins with entries."""
    b = df.select(overflow_bin(F.col(value), lo, hi, n_edges).alias("bin")).filter(F.col("bin").isNotNull())
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).withColumn("place", _place("bin", n_edges))


def _place(col: str, n_edges: int) -> Column:
    return F.when(F.col(col) == 0, "under").when(F.col(col) == n_edges, "over").otherwise("in")


def hist2d_overflow(
    df: DataFrame, x: str, y: str, xr: tuple[float, float], yr: tuple[float, float], nx_edges: int, ny_edges: int
) -> DataFrame:
    b = df.select(
        overflow_bin(F.col(x), *xr, nx_edges).alias("bx"), overflow_bin(F.col(y), *yr, ny_edges).alias("by")
    ).filter(F.col("bx").isNotNull() & F.col("by").isNotNull())
    return b.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"place_x": _place("bx", nx_edges), "place_y": _place("by", ny_edges)}
    )


def explode_aligned(df: DataFrame, x: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """Element pairs of two array columns, cut to the shorter one (the join on row and index, without a join)."""
    n = F.least(F.size(x), F.size(y))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.get(x, i - 1).alias("x"), F.get(y, i - 1).alias("y")))
    return df.filter(n > 0).select(*keep, F.inline(pairs))


def hist2d(
    df: DataFrame,
    x: str | Column,
    y: str | Column,
    xr: tuple[float, float],
    yr: tuple[float, float],
    nx: int,
    ny: int,
    *,
    by: Sequence[str] = (),
) -> DataFrame:
    """Non-empty cells (by.., bx, by, n); pairs with a non-finite or outside value are dropped."""
    cx = (F.col(x) if isinstance(x, str) else x).cast("double")
    cy = (F.col(y) if isinstance(y, str) else y).cast("double")
    rows = df.select(*by, cx.alias("_x"), cy.alias("_y")).filter(finite(F.col("_x")) & finite(F.col("_y")))
    (x0, x1), (y0, y1) = map(lambda r: (float(r[0]), float(r[1])), (xr, yr))
    cells = rows.select(
        *by,
        uniform_bin(F.col("_x"), x0, (x1 - x0) / nx, nx, x1).alias("bx"),
        uniform_bin(F.col("_y"), y0, (y1 - y0) / ny, ny, y1).alias("by"),
    ).filter(F.col("bx").isNotNull() & F.col("by").isNotNull())
    return cells.groupBy(*by, "bx", "by").agg(F.count(F.lit(1)).alias("n"))


def slice_by_bin(cells: DataFrame, bx: int, *, normalize_width: float | None = None) -> DataFrame:
    """y counts of one x bin; with a bin width the counts become a density of area 1."""
    return _density(cells.filter(F.col("bx") == bx).select(F.col("by").alias("bin"), "n"), normalize_width)


def slice_by_range(
    df: DataFrame, x: str, y: str, xmin: float, xmax: float, lo: float, hi: float, n: int, *, normalize: bool = False
) -> DataFrame:
    """y histogram of the rows with x in [xmin, xmax)."""
    h = hist1d(df.filter((F.col(x) >= xmin) & (F.col(x) < xmax)), y, lo, hi, n).select("bin", "n")
    return _density(h, (float(hi) - float(lo)) / n if normalize else None)


def _density(h: DataFrame, width: float | None) -> DataFrame:
    if width is None:
        return h
    # a histogram has a fixed number of bins, so the unpartitioned total is over a bounded table
    total = F.sum("n").over(W.partitionBy())
    return h.withColumn("density", F.try_divide(F.col("n").cast("double"), total * F.lit(width)))


def hist2d_stats(cells: DataFrame) -> DataFrame:
    """Entries, the fullest and the emptiest non-empty cell (ties to the lowest cell), and log10(n + 1) of the fullest."""
    cell = F.struct(F.col("bx"), F.col("by"))
    low = F.min(F.struct(-F.col("n"), F.col("bx"), F.col("by")))
    return cells.agg(
        F.sum("n").alias("entries"),
        low.alias("_most"),
        F.min(F.struct(F.col("n"), F.col("bx"), F.col("by"))).alias("_least"),
        F.count(cell).alias("cells"),
    ).select(
        "entries",
        "cells",
        (-F.col("_most.col1")).alias("most_n"),
        F.col("_most.bx").alias("most_bx"),
        F.col("_most.by").alias("most_by"),
        F.col("_least.n").alias("least_n"),
        F.log10(-F.col("_most.col1") + 1).alias("most_log"),
    )


def all_cells(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """(bx, by, n, log_n) of every cell of a grid, empty ones with 0; ``log_n`` is log10(n + 1).

    The grid is nx * ny rows, whatever the data; ``cells`` has at most as many.
    """
    grid = cells.sparkSession.range(nx * ny).select(F.floor(F.col("id") / ny).alias("bx"), (F.col("id") % ny).alias("by"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return grid.join(cells.select("bx", "by", "n"), ["bx", "by"], "left").select("bx", "by", n.alias("n"), F.log10(n + 1).alias("log_n"))


def hist2d_range(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """Entries, and the fullest and the emptiest cell of the whole grid, the first of equal ones row by row."""
    first = F.struct(F.col("bx"), F.col("by"))
    full = all_cells(cells, nx, ny)
    most, least = F.max_by(F.struct("n", "bx", "by"), F.struct(F.col("n"), -F.col("bx"), -F.col("by"))), F.min_by(F.struct("n", "bx", "by"), F.struct(F.col("n"), first))
    out = full.agg(F.sum("n").alias("entries"), F.count_if(F.col("n") == 0).alias("empty"), most.alias("most"), least.alias("least"))
    return out.select("entries", "empty", *[F.col(f"{a}.{b}").alias(f"{a}_{b}") for a in ("most", "least") for b in ("n", "bx", "by")])
