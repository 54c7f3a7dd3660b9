"""Event building and per-channel series."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseloom import fixtures as fx
from pulseloom.catalog.common import FX_EVENT, FX_PULSE, FX_WAVE, GAP_US, csv, csv_scaled, r6, sql_r6, with_views
from pulseloom.functions import waveform as wf
from pulseloom.operators.position import lag_by_position, mark_segments, with_position
from pulseloom.operators.sessions import anchor_events, gap_events, gap_slots
from pulseloom.operators.stream_order import anchor_events_in_order
from pulseloom.operators.summary import PART_ROWS, ordered_parts
from pulseloom.plans.event_pulses import event_pulses as plan_event_pulses
from pulseloom.plans.event_pulses import event_totals

QUERIES = {}
ORACLE = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn

    return add


P = with_views(FX_PULSE)
EV = with_views(FX_EVENT)
# the next anchor of every time is the first time over the limit; the recursion walks anchors, not rows
ANCHOR = P + """, times as (select distinct t_us from fx_pulse),
  nxt as (select t_us, min(t_us) over (order by t_us range between 300000001 following and unbounded following) nt from times),
  scan(anchor, event_id) as (
    select min(t_us), cast(1 as bigint) from times
    union all
    select nxt.nt, event_id + 1 from scan join nxt on nxt.t_us = scan.anchor where nxt.nt is not null),
  bounds as (select anchor, event_id, coalesce(lead(anchor) over (order by anchor), 9000000000000000000) until from scan),
  fx_anchor as (select p.*, event_id, anchor event_start from fx_pulse p join bounds on p.t_us >= anchor and p.t_us < until)
"""

# in file order: from each row on to the first one that is further away in time, before or after
FILE_ANCHOR = P + """, rows as materialized (select *, row_number() over (order by pulse_no) pos from fx_pulse),
  far as materialized (select a.pos, min(b.pos) nxt from rows a left join rows b on b.pos > a.pos and abs(b.t_us - a.t_us) > 300000000 group by a.pos),
  walk(pos, event_id) as (
    select cast(1 as bigint), cast(1 as bigint) union all
    select far.nxt, event_id + 1 from walk join far on far.pos = walk.pos where far.nxt is not null),
  walked as materialized (select pos, event_id, coalesce(lead(pos) over (order by pos), 9000000000000000000) until from walk),
  fx_file_anchor as (select r.*, event_id from rows r join walked w on r.pos >= w.pos and r.pos < w.until)
"""


@query("event_gap", EV + "select pulse_no, chip, channel, gch, t_us, charge, event_id from fx_event")
def event_gap(spark, d):
    return gap_events(fx.pulses(spark, d), "t_us", GAP_US)


@query("event_anchor", ANCHOR + "select pulse_no, t_us, event_id, event_start from fx_anchor")
def event_anchor(spark, d):
    return anchor_events(fx.pulses(spark, d), "t_us", GAP_US).select("pulse_no", "t_us", "event_id", "event_start")


ARRAYS = "array_to_string(list({c} order by {order}), ',') {a}"


def parts_sql(source: str, key: str, arrays: dict[str, str], extra: str = "", order: str = "t_us, pulse_no") -> str:
    """Arrays per key, cut every PART_ROWS rows; ``extra`` columns are the same in all parts of a key."""
    lists = ", ".join(ARRAYS.format(c=c, a=a, order=order) for a, c in arrays.items())
    more = ", any_value(n) n, any_value(t_first) t_first" if extra else ""
    return f""", numbered as (select *, (row_number() over (partition by {key} order by {order}) - 1) // {PART_ROWS} part {extra} from {source})
      select {key}, cast(part as bigint) part{more}, {lists} from numbered group by {key}, part"""


@query(
    "event_anchor_arrays",
    FILE_ANCHOR.rstrip() + parts_sql("fx_file_anchor", "event_id", {"times": "t_us", "channels": "gch", "charges": "charge"}, order="pulse_no"),
)
def event_anchor_arrays(spark, d):
    p = with_position(fx.pulses(spark, d).select("t_us", "pulse_no", "gch", "charge"), ["pulse_no"])
    e = anchor_events_in_order(p, "pos", "t_us", GAP_US)
    parts = ordered_parts(e.drop("pos"), ["event_id"], ["pulse_no"], ["t_us", "gch", "charge"])
    return parts.select("event_id", "part", csv("t_us").alias("times"), csv("gch").alias("channels"), csv("charge").alias("charges"))


@query(
    "event_arrays",
    EV.rstrip() + parts_sql("fx_event", "event_id", {"times": "t_us", "chips": "chip", "channels": "channel"}),
)
def event_arrays(spark, d):
    e = gap_events(fx.pulses(spark, d), "t_us", GAP_US).select("event_id", "t_us", "pulse_no", "chip", "channel")
    parts = ordered_parts(e, ["event_id"], ["t_us", "pulse_no"], ["t_us", "chip", "channel"])
    return parts.select("event_id", "part", csv("t_us").alias("times"), csv("chip").alias("chips"), csv("channel").alias("channels"))


@query(
    "event_extent",
    EV + "select event_id, count(*) n_pulses, min(t_us) t_first, max(t_us) - min(t_us) t_range from fx_event group by event_id",
)
def event_extent(spark, d):
    # event totals come from the slot table; the rows are read once and never joined
    slots = gap_slots(fx.pulses(spark, d), "t_us", GAP_US, aggregates=[F.count(F.lit(1)).alias("n")])
    return slots.groupBy("event_id").agg(
        F.sum("n").alias("n_pulses"), F.min("_lo").alias("t_first"), (F.max("_hi") - F.min("_lo")).alias("t_range")
    )


@query(
    "event_multiplicity",
    EV + """select event_id, count(*) n_all, count(*) filter (charge > 500) n_kept, cast(sum(charge) as bigint) charge,
      cast(coalesce(sum(charge) filter (charge > 500), 0) as bigint) charge_kept, max(charge) largest from fx_event group by event_id""",
)
def event_multiplicity(spark, d):
    kept = F.col("charge") > 500
    slots = gap_slots(
        fx.pulses(spark, d),
        "t_us",
        GAP_US,
        aggregates=[
            F.count(F.lit(1)).alias("n_all"),
            F.count_if(kept).alias("n_kept"),
            F.sum("charge").alias("charge"),
            F.coalesce(F.sum(F.when(kept, F.col("charge"))), F.lit(0)).alias("charge_kept"),
            F.max("charge").alias("largest"),
        ],
    )
    return slots.groupBy("event_id").agg(
        *[F.sum(c).alias(c) for c in ("n_all", "n_kept", "charge", "charge_kept")], F.max("largest").alias("largest")
    )


@query(
    "run_events",
    P + """, f as (select *, case when abs(t_us - lag(t_us) over (order by pulse_no)) < 200000000 then 0 else 1 end f from fx_pulse)
      select pulse_no, t_us, cast(sum(f) over (order by pulse_no rows unbounded preceding) as bigint) event_id from f""",
)
def run_events(spark, d):
    # stream order, not time order: compare with the predecessor in the file
    p = fx.pulses(spark, d).select("pulse_no", "t_us")
    marked = mark_segments(
        p, "pulse_no", lambda a, b: F.abs(b["t_us"] - a["t_us"]) >= 200_000_000, ["t_us"], number_name="event_id"
    )
    return marked.select("pulse_no", "t_us", "event_id")


@query(
    "channel_dt",
    P + "select pulse_no, gch, t_us, t_us - lag(t_us) over (partition by gch order by t_us, pulse_no) dt from fx_pulse",
)
def channel_dt(spark, d):
    # ordered by channel and time in one range order, so a busy channel spreads over many tasks
    p = with_position(fx.pulses(spark, d).select("gch", "t_us", "pulse_no"), ["gch", "t_us", "pulse_no"])
    p = lag_by_position(p, "pos", ["gch", "t_us"], "prev")
    return p.select("pulse_no", "gch", "t_us", F.when(F.col("prev.gch") == F.col("gch"), F.col("t_us") - F.col("prev.t_us")).alias("dt"))


@query(
    "first_n_per_channel",
    P + "select chip, channel, pulse_no, t_us, charge from fx_pulse qualify row_number() over (partition by chip, channel order by t_us, pulse_no) <= 10",
)
def first_n_per_channel(spark, d):
    # row_number() <= N keeps N rows per channel already before the shuffle (window group limit)
    w = W.partitionBy("chip", "channel").orderBy("t_us", "pulse_no")
    p = fx.pulses(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 10")
    return p.select("chip", "channel", "pulse_no", "t_us", "charge")


@query(
    "freq_counts",
    P + """select 'chip' what, chip "value", count(*) n from fx_pulse group by chip union all
      select 'channel', channel, count(*) from fx_pulse group by channel union all
      select 'id', gch, count(*) from fx_pulse group by gch union all
      select 'charge', charge, count(*) from fx_pulse group by charge""",
)
def freq_counts(spark, d):
    named = [("chip", "chip"), ("channel", "channel"), ("id", "gch"), ("charge", "charge")]
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(c).alias("value")) for n, c in named])).alias("k")
    return fx.pulses(spark, d).select(long).groupBy("k.what", "k.value").agg(F.count(F.lit(1)).alias("n"))


@query("sorted_pulses", P + "select pulse_no, t_us, charge, row_number() over (order by t_us, pulse_no) - 1 pos from fx_pulse")
def sorted_pulses(spark, d):
    return with_position(fx.pulses(spark, d).select("pulse_no", "t_us", "charge"), ["t_us", "pulse_no"])


@query("topk_pulses", P + "select pulse_no, gch, t_us, charge from fx_pulse order by charge desc, pulse_no limit 50")
def topk_pulses(spark, d):
    return fx.pulses(spark, d).select("pulse_no", "gch", "t_us", "charge").orderBy(F.desc("charge"), "pulse_no").limit(50)


@query(
    "channel_series",
    P.rstrip() + parts_sql(
        "fx_pulse", "chip, channel", {"times": "t_us", "charges": "charge"},
        ", count(*) over (partition by chip, channel) n, min(t_us) over (partition by chip, channel) t_first",
    ),
)
def channel_series(spark, d):
    p = fx.pulses(spark, d).select("chip", "channel", "t_us", "pulse_no", "charge")
    parts = ordered_parts(p, ["chip", "channel"], ["t_us", "pulse_no"], ["t_us", "charge"])
    whole = p.groupBy("chip", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("t_first"))
    return parts.join(whole, ["chip", "channel"]).select(
        "chip", "channel", "part", "n", "t_first",
        csv("t_us").alias("times"), csv("charge").alias("charges"),
    )


@query("channel_allowlist", P + "select * from fx_pulse where chip < 2 and channel < 16")
def channel_allowlist(spark, d):
    allowed = spark.range(32).select(F.expr("id div 16").alias("chip"), F.expr("id % 16").alias("channel"))
    return fx.pulses(spark, d).join(F.broadcast(allowed), ["chip", "channel"], "left_semi")


@query(
    "event_pulses",
    with_views(FX_WAVE) + f""", a as (select vec_id, block, w, list_transform(w, lambda x: x - list_sum(list_concat(w[1:11], w[-11:])) / 22.0::double) y from fx_wave),
  b as (select *, list_position(list_transform(y, lambda v: v >= 320), true) - 1 rise from a),
  c as (select *, coalesce(list_min(list_filter(range(64), lambda i: i >= rise and y[i + 1] < 320)), 63) fall from b where rise >= 0),
  e as (select vec_id, block, y[greatest(0, rise - 12) + 1 : least(64, fall + 12)] seg from c),
  g as (select vec_id, block, list_transform(seg, lambda v: v - list_sum(seg[1:10]) / 10.0::double) p from e where len(seg) >= 10),
  q as (select vec_id, block // 2 raw_event, len(p) n, list_max(p) top, list_sum(p) q from g),
  ev as (select raw_event, dense_rank() over (order by raw_event) - 1 event_id, row_number() over (partition by raw_event order by vec_id) rn, vec_id, n, top, q from q)
  select event_id, count(*) n_pulses, cast(sum(n) as bigint) n_samples, {sql_r6('max(top)', 4)} largest, {sql_r6('sum(q)', 3)} total_charge from ev group by event_id""",
)
def event_pulses(spark, d):
    """Single-pulse cut per wave, events without pulses dropped, the rest renumbered from 0 in stream order."""
    cut = fx.waves(spark, d).select(
        F.expr("block div 2").alias("raw_event"), wf.segment_pulse("w", up=320, down=320).alias("p")
    ).filter(F.col("p").isNotNull())
    events = cut.groupBy("raw_event").agg(
        F.count(F.lit(1)).alias("n_pulses"),
        F.sum(F.size("p").cast("bigint")).alias("n_samples"),
        r6(F.max(wf.peak("p")), 4).alias("largest"),
        r6(F.sum(wf.total("p")), 3).alias("total_charge"),
    )
    return with_position(events, ["raw_event"], "event_id").drop("raw_event")


# Waves with times that run through 64 per block pair and jump 700 on, back to the start after some blocks; every fifth block is flat.
BUILT = with_views(FX_WAVE).rstrip() + """, rows as materialized (select vec_id, chip, channel, ((vec_id // 64) * 700) % 6400 + vec_id % 64 t,
    case when block % 5 < 2 then list_transform(w, lambda x: x // 64) else w end w, row_number() over (order by vec_id) pos from fx_wave),
  far as materialized (select a.pos, min(b.pos) nxt from rows a left join rows b on b.pos > a.pos and abs(b.t - a.t) > 120 group by a.pos),
  walk(pos, event_id) as (
    select cast(1 as bigint), cast(1 as bigint) union all
    select far.nxt, event_id + 1 from walk join far on far.pos = walk.pos where far.nxt is not null),
  walked as materialized (select pos, event_id, coalesce(lead(pos) over (order by pos), 9000000000000000000) until from walk),
  a as (select r.*, event_id, list_transform(w, lambda x: x - list_sum(list_concat(w[1:11], w[-11:])) / 22.0::double) y
    from rows r join walked x on r.pos >= x.pos and r.pos < x.until),
  b as (select *, list_position(list_transform(y, lambda v: v >= 20), true) - 1 rise from a),
  c as (select *, coalesce(list_min(list_filter(range(64), lambda i: i >= rise and y[i + 1] < 20)), 63) fall from b where rise >= 0),
  e as (select *, y[greatest(0, rise - 12) + 1 : least(64, fall + 12)] seg from c),
  g as (select *, list_transform(seg, lambda v: v - list_sum(seg[1:10]) / 10.0::double) p from e where len(seg) >= 10),
  q as (select dense_rank() over (order by event_id) - 1 pulse_event, vec_id, chip, channel, t, list_position(w, list_max(w)) - 1 peak_at,
    len(p) n_samples, list_max(p) max_sample, list_sum(p) charge from g)
"""


def built_pulses(spark, d):
    """The pulses of events that are built from the waves in stored order."""
    flat = F.expr("transform(w, x -> x div 64)")
    waves = fx.waves(spark, d).select(
        "vec_id", "chip", "channel", F.expr("((vec_id div 64) * 700) % 6400 + vec_id % 64").alias("t"), F.when(F.col("block") % 5 < 2, flat).otherwise(F.col("w")).alias("w")
    )
    events = anchor_events_in_order(with_position(waves, ["vec_id"]), "pos", "t", 120)
    return plan_event_pulses(events.drop("pos"), "event_id", "w")


@query("built_event_pulses", BUILT + f"""select pulse_event, vec_id, chip, channel, t, cast(peak_at as int) peak_at, n_samples,
  {sql_r6('max_sample', 4)} max_sample, {sql_r6('charge', 3)} charge from q""")
def built_event_pulses(spark, d):
    found = built_pulses(spark, d)
    return found.select("pulse_event", "vec_id", "chip", "channel", "t", "peak_at", "n_samples", r6("max_sample", 4).alias("max_sample"), r6("charge", 3).alias("charge"))


@query("built_event_totals", BUILT + f"""select pulse_event, count(*) n_pulses, cast(sum(n_samples) as bigint) n_samples,
  {sql_r6('max(max_sample)', 4)} largest, {sql_r6('sum(charge)', 3)} total_charge from q group by pulse_event""")
def built_event_totals(spark, d):
    return event_totals(built_pulses(spark, d)).select("pulse_event", "n_pulses", "n_samples", r6("largest", 4).alias("largest"), r6("total_charge", 3).alias("total_charge"))
