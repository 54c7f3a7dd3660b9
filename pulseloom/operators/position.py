"""Order-dependent operators that stay distributed.

A window without a partition key pulls all rows into one task. Here order is made explicit as a
numeric position, positions are cut into buckets of bounded size, the window runs per bucket, and
only one summary row per bucket takes part in the step that crosses buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseloom.session import materialize

BUCKET_ROWS = 1 << 20
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in 33 bits


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "pos", *, keep: Sequence[str] | None = None) -> DataFrame:
    """Dense 0-based position in the given total order; ``keep`` names the columns that are needed behind it (None: all).

    One range shuffle on the whole ordering key (so a frequent leading value spreads over many
    partitions as long as the key is total), then row numbers per partition plus a prefix sum over
    one row per partition. The range-sorted rows are written to a table, because the bounds of a range
    shuffle come from a sample and a second evaluation could place rows differently.
    """
    spread = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    fixed = materialize(spread if keep is None else spread.select(*keep, "_mid"))
    part = F.shiftright("_mid", _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
    )
    # One row per partition of the shuffle: bounded by the number of tasks, never by the data.
    return (
        fixed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_base") + local)
        .drop("_mid", "_part", "_base")
    )


def mark_segments(
    df: DataFrame,
    pos: str,
    starts: Callable[[Column, Column], Column],
    using: Sequence[str],
    *,
    stream: Sequence[str] = (),
    width: int = BUCKET_ROWS,
    start_name: str = "segment",
    lag_name: str | None = None,
    number_name: str | None = None,
) -> DataFrame:
    """Cut an ordered stream into segments.

    ``starts(prev, cur)`` gets the structs of the ``using`` columns of a row and of its predecessor and
    says whether the row opens a segment; the first row of a stream always does. ``start_name`` gets the
    position of the segment's first row, which identifies the segment without any global numbering.
    Optional outputs: the predecessor struct and a dense 1-based segment number per stream.
    A bucket holds at most ``width`` positions, so no window partition grows with the data.
    """
    stream = list(stream)
    keys = [*stream, "_bucket"]
    rows = df.withColumn("_bucket", F.floor(F.col(pos) / F.lit(width)).cast("bigint")).withColumn(
        "_cur", F.struct(*using)
    )
    in_bucket = W.partitionBy(*keys).orderBy(pos)
    upto = in_bucket.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_prev", F.lag("_cur").over(in_bucket))
    rows = rows.withColumn(
        "_open", F.when(F.col("_prev").isNull(), F.lit(False)).otherwise(F.coalesce(starts(F.col("_prev"), F.col("_cur")), F.lit(False)))
    )
    heads = rows.groupBy(*keys).agg(
        F.min_by("_cur", pos).alias("_first"),
        F.max_by("_cur", pos).alias("_last"),
        F.min(pos).alias("_first_pos"),
        F.max(F.when(F.col("_open"), F.col(pos))).alias("_last_open"),
        F.count_if("_open").alias("_opens"),
    )
    over = W.partitionBy(*stream).orderBy("_bucket") if stream else W.orderBy("_bucket")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    heads = heads.withColumn("_tail", F.lag("_last").over(over)).withColumn(
        "_head_open",
        F.when(F.col("_tail").isNull(), F.lit(True)).otherwise(
            F.coalesce(starts(F.col("_tail"), F.col("_first")), F.lit(False))
        ),
    )
    own = F.coalesce("_last_open", F.when(F.col("_head_open"), F.col("_first_pos")))
    heads = heads.select(
        *keys,
        "_tail",
        F.when(F.col("_head_open"), F.col("_first_pos"))
        .otherwise(F.last(own, ignorenulls=True).over(before))
        .alias("_carry"),
        (
            F.coalesce(F.sum(F.col("_opens") + F.col("_head_open").cast("bigint")).over(before), F.lit(0))
            + F.col("_head_open").cast("bigint")
        ).alias("_count"),
    )
    out = rows.withColumn(
        "_inner", F.last(F.when(F.col("_open"), F.col(pos)), ignorenulls=True).over(upto)
    )
    if number_name:
        out = out.withColumn("_inner_n", F.sum(F.col("_open").cast("bigint")).over(upto))
    out = _join_keys(out, heads, keys).withColumn(start_name, F.coalesce("_inner", "_carry"))
    if number_name:
        out = out.withColumn(number_name, F.col("_count") + F.col("_inner_n"))
    if lag_name:
        out = out.withColumn(lag_name, F.coalesce("_prev", "_tail"))
    return out.drop("_bucket", "_cur", "_prev", "_open", "_inner", "_inner_n", "_tail", "_carry", "_count")


def segment_homes(
    df: DataFrame,
    pos: str,
    starts: Callable[[Column, Column], Column],
    using: Sequence[str],
    *,
    stream: Sequence[str] = (),
    width: int = BUCKET_ROWS,
    part: int | None = None,
    start_using: Sequence[str] = (),
) -> DataFrame:
    """Rows with ``_home`` and ``_start``, moved once so that a group of (stream, _home, segment) needs no further shuffle.

    Segments are those of ``mark_segments``; ``_start`` is a struct of ``p``, the position of the segment's first row, and of
    its ``start_using`` columns. A first pass over ``pos`` and ``using`` alone leaves one row per bucket: where its first
    segment opens and what it continues. With these, rows that continue a segment of an earlier bucket go to its home
    before anything wide is moved. With ``part`` that holds for the parts of so many positions into which a segment is cut,
    so a segment of any length fills no home with more than ``width + part`` positions.
    """
    stream = list(stream)
    keys = [*stream, "_bucket"]
    placed = df.withColumn("_bucket", F.floor(F.col(pos) / F.lit(width)).cast("bigint"))
    me = F.struct(F.col(pos).cast("bigint").alias("p"), *start_using)
    needed = dict.fromkeys([*keys, pos, *using, *start_using])
    slim = placed.select(*needed).withColumn("_cur", F.struct(*using)).withColumn("_me", me)
    slim = slim.withColumn("_prev", F.lag("_cur").over(W.partitionBy(*keys).orderBy(pos)))
    opens = F.when(F.col("_prev").isNotNull() & starts(F.col("_prev"), F.col("_cur")), F.col("_me"))
    heads = slim.groupBy(*keys).agg(
        F.min_by("_cur", pos).alias("_first"), F.max_by("_cur", pos).alias("_last"), F.min_by("_me", pos).alias("_first_me"),
        F.min_by(opens, F.when(opens.isNotNull(), F.col(pos))).alias("_first_open"),
        F.max_by(opens, F.when(opens.isNotNull(), F.col(pos))).alias("_last_open"),
    )
    over = W.partitionBy(*stream).orderBy("_bucket") if stream else W.orderBy("_bucket")
    heads = heads.withColumn("_tail", F.lag("_last").over(over))
    heads = heads.withColumn("_head", F.when(F.col("_tail").isNull() | starts(F.col("_tail"), F.col("_first")), F.col("_first_me")))
    own = F.coalesce("_last_open", "_head")
    heads = heads.select(
        *keys, F.coalesce("_head", "_first_open")["p"].alias("_from"),
        F.last(own, ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_carry"),
    )
    # written, so that its size is known when the join is planned and the wide rows stay where they are
    rows = _join_keys(placed, materialize(heads), keys)
    early = F.col("_from").isNull() | (F.col(pos) < F.col("_from"))
    to = F.col("_carry.p")
    if part:
        to = to + F.floor((F.col(pos) - to) / F.lit(part)) * part
    rows = rows.withColumn("_home", F.when(early, F.floor(to / F.lit(width)).cast("bigint")).otherwise(F.col("_bucket")))
    rows = rows.withColumn("_known", F.when(early, F.col("_carry"))).withColumn("_opens", ~early & (F.col(pos) == F.col("_from")))
    rows = rows.drop("_bucket", "_from", "_carry")
    at_home = W.partitionBy(*stream, "_home").orderBy(pos)
    prev, cur = F.lag(F.struct(*using)).over(at_home), F.struct(*using)
    rows = rows.withColumn("_prev", prev).withColumn("_cur", cur)
    rows = rows.withColumn("_opens", F.col("_opens") | (F.col("_prev").isNotNull() & F.coalesce(starts(F.col("_prev"), F.col("_cur")), F.lit(False))))
    opened = F.last(F.when(F.col("_opens"), me), ignorenulls=True).over(at_home.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_start", F.coalesce("_known", opened)).drop("_known", "_opens", "_prev", "_cur")


def _join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Plain equi join: the summary is small, so adaptive execution turns it into a broadcast by measured size.
    return left.join(right, list(keys), "inner")


def lag_by_position(
    df: DataFrame, pos: str, using: Sequence[str], name: str, *, stream: Sequence[str] = (), width: int = BUCKET_ROWS
) -> DataFrame:
    """Struct of the ``using`` columns of the predecessor in ``pos`` order (null for the first row)."""
    return mark_segments(
        df, pos, lambda p, c: F.lit(False), using, stream=stream, width=width, start_name="_seg", lag_name=name
    ).drop("_seg")


def carry_last(
    df: DataFrame, pos: str, value: str, name: str, *, stream: Sequence[str] = (), width: int = BUCKET_ROWS
) -> DataFrame:
    """Last non-null ``value`` at or before the row in ``pos`` order (fill forward along every stream)."""
    keys = [*stream, "_bucket"]
    rows = df.withColumn("_bucket", F.floor(F.col(pos) / F.lit(width)).cast("bigint"))
    over = W.partitionBy(*stream).orderBy("_bucket") if stream else W.orderBy("_bucket")
    tails = rows.groupBy(*keys).agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(pos))).alias("_tail")).select(
        *keys, F.last("_tail", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_carry")
    )
    upto = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("_in", F.last(value, ignorenulls=True).over(upto))
        .join(tails, keys, "inner")
        .withColumn(name, F.coalesce("_in", "_carry"))
        .drop("_bucket", "_in", "_carry")
    )


def nearest_within(left: DataFrame, right: DataFrame, key: str, payload: str, tol: float) -> DataFrame:
    """Left rows with the nearest right row whose ``key`` differs by at most ``tol`` (ties: the lower key, then payload).

    Both sides are put in one order and the neighbours on either side are carried along it, so no pairs inside the
    tolerance are formed. ``payload`` is unique per side. Adds match and match_key; unmatched rows keep nulls.
    """
    a = left.select(F.col(key).alias("_k"), F.lit(1).alias("_side"), F.col(payload).alias("_id"), F.struct(*left.columns).alias("_row"))
    b = right.select(F.col(key).alias("_k"), F.lit(0).alias("_side"), F.col(payload).alias("_id"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    both = with_position(a.unionByName(b).filter(F.col("_k").isNotNull()), ["_k", "_side", "_id"], "_pos")
    both = both.withColumn("_cand", F.when(F.col("_side") == 0, F.struct("_k", "_id")))
    both = carry_last(both, "_pos", "_cand", "_below")
    both = carry_last(both.withColumn("_back", -F.col("_pos")), "_back", "_cand", "_above")
    down, up = F.col("_k") - F.col("_below._k"), F.col("_above._k") - F.col("_k")
    best = F.when(F.col("_above").isNull() | (down <= up), F.col("_below")).otherwise(F.col("_above"))
    rows = both.filter(F.col("_side") == 1).withColumn("_best", F.when(F.abs(best["_k"] - F.col("_k")) <= F.lit(tol), best))
    return rows.select("_row.*", F.col("_best._id").alias("match"), F.col("_best._k").alias("match_key"))


def number_within(df: DataFrame, key: Sequence[str], pos: str, name: str, *, width: int = BUCKET_ROWS) -> DataFrame:
    """0-based rank inside a key when ``pos`` is dense and each key is one contiguous stretch.

    The stretch of a key is found like any other segment, so a key that holds a large share of the rows is spread over
    as many tasks as it fills buckets; a join or window on the key would put it into one.
    """
    def changes(p: Column, c: Column) -> Column:
        test = F.lit(False)
        for k in key:
            test = test | ~p[k].eqNullSafe(c[k])
        return test

    marked = mark_segments(df, pos, changes, list(key), width=width, start_name="_from")
    return marked.withColumn(name, F.col(pos) - F.col("_from")).drop("_from")
