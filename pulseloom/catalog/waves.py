"""Waveform queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom import fixtures as fx
from pulseloom.catalog.common import FX_EVENT2D, FX_WAVE, csv, csv_scaled, r6, sql_r6, with_views
from pulseloom.functions import waveform as wf

QUERIES = {}
ORACLE = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn

    return add


W = with_views(FX_WAVE)
E2D = with_views(FX_EVENT2D)
TICKS = "list_transform(range(64), lambda i: vec_id * 1000 + i * 32)"


def ticks(base="vec_id", n=64):
    """Sample times in clock ticks, 32 per sample."""
    return F.expr(f"transform(sequence(0, {n - 1}), i -> {base} * 1000L + i * 32)")


@query(
    "baseline_first10",
    W + """select block, channel, array_to_string(list_transform(w,
             lambda x: cast(round_even(x - list_avg(w[1:10]), 0) as bigint)), ',') y from fx_wave""",
)
def baseline_first10(spark, d):
    sv = fx.frames2d(spark, d).select("block", F.posexplode(wf.baseline_first("samples_value")).alias("channel", "y"))
    return sv.select("block", F.col("channel").cast("bigint").alias("channel"), csv("y").alias("y"))


MODE_SQL = """, counted as (select vec_id, v, count(*) n, min(i) first_at from
   (select vec_id, unnest({part}) v, generate_subscripts({part}, 1) i from fx_wave) group by vec_id, v),
 base as (select vec_id, v from counted qualify row_number() over (partition by vec_id order by n desc, {tie}) = 1)
 select {cols}, array_to_string(list_transform({part}, lambda x: x - base.v), ',') y from fx_wave join base using (vec_id)"""


@query("baseline_mode", W + MODE_SQL.format(part="w", tie="v", cols="block, channel"))
def baseline_mode(spark, d):
    sv = fx.frames2d(spark, d).select("block", F.posexplode(wf.baseline_mode("samples_value")).alias("channel", "y"))
    return sv.select("block", F.col("channel").cast("bigint").alias("channel"), csv("y").alias("y"))


@query("baseline_mode_first", W + MODE_SQL.format(part="w[1:60]", tie="first_at", cols="vec_id"))
def baseline_mode_first(spark, d):
    return fx.waves(spark, d).select("vec_id", csv(wf.subtract_mode("w", ties="first", first=60)).alias("y"))


@query(
    "segment_single_pulse",
    W + """, a as (select vec_id, len(w) n, list_transform(w, lambda x: x - list_sum(list_concat(w[1:11], w[-11:])) / 22.0::double) y from fx_wave),
  b as (select *, list_position(list_transform(y, lambda v: v >= 100), true) - 1 rise from a),
  c as (select *, coalesce(list_min(list_filter(range(n), lambda i: i >= rise and y[i + 1] < 100)), n - 1) fall from b where rise >= 0),
  e as (select vec_id, y[greatest(0, rise - 12) + 1 : least(n, fall + 12)] seg from c)
  select vec_id, len(seg) n_samples, array_to_string(list_transform(seg,
    lambda v: cast(round((v - list_sum(seg[1:10]) / 10.0::double) * 1000) as bigint)), ',') pulse
  from e where len(seg) >= 10""",
)
def segment_single_pulse(spark, d):
    cut = fx.waves(spark, d).select("vec_id", wf.segment_pulse("w").alias("p")).filter(F.col("p").isNotNull())
    return cut.select("vec_id", F.size("p").cast("bigint").alias("n_samples"), csv_scaled(F.col("p"), 1000).alias("pulse"))


SPANS_SQL = W + """, base as (
    select vec_id, block, chip, channel, list_transform(w, lambda x: cast(round_even(x - list_avg(w[1:10]), 0) as bigint)) y from fx_wave),
  walk(vec_id, y, i, pulse_from, span_from, span_to) as (
    select vec_id, y, 0, -1, -1, -1 from base
    union all
    select vec_id, y,
      case when pulse_from < 0 then i + 1 when y[i + 1] <= 10 then least(64, i + 9) else i + 1 end,
      case when pulse_from < 0 and y[i + 1] >= 50 then greatest(0, i - 10) when pulse_from >= 0 and y[i + 1] <= 10 then -1 else pulse_from end,
      case when pulse_from >= 0 and y[i + 1] <= 10 then pulse_from else -1 end,
      case when pulse_from >= 0 and y[i + 1] <= 10 then least(64, i + 9) else -1 end
    from walk where i < 64),
  spans as (
    select vec_id, span_from a, span_to b from walk where span_from >= 0
    union all
    select vec_id, pulse_from, 64 from walk where i >= 64 and pulse_from >= 0),
  found as (select base.*, a, b from base join spans using (vec_id) where b - a >= 4)
"""


def found_pulses(spark, d):
    runs = fx.frames2d(spark, d).select(
        "block", "chip", wf.baseline_first("samples_value").alias("sv"), ticks("block").alias("ts")
    )
    return runs.select("block", wf.find_pulses("sv", "ts", "chip").alias("items"))


@query(
    "find_pulses",
    SPANS_SQL + """select block, chip, channel, a first_index, array_to_string(y[a + 1 : b], ',') pulse,
      array_to_string(range(a, b), ',') pulse_index,
      array_to_string(list_transform(range(a, b), lambda i: block * 1000 + i * 32), ',') pulse_timestamp from found
    union all
    select block, null, null, null, null, null, null from base where block not in (select block from found) group by block""",
)
def find_pulses(spark, d):
    rows = found_pulses(spark, d).select("block", F.explode_outer("items").alias("p"))
    return rows.select(
        "block",
        F.col("p.chip").alias("chip"),
        F.col("p.channel").alias("channel"),
        F.get(F.col("p.index"), F.lit(0)).alias("first_index"),
        csv("p.pulse").alias("pulse"),
        csv("p.index").alias("pulse_index"),
        csv("p.time").alias("pulse_timestamp"),
    )


@query(
    "find_pulses_soa",
    SPANS_SQL + """select block, count(*) n_pulses, array_to_string(list(channel order by channel, a, b), ',') channels,
      array_to_string(list(a order by channel, a, b), ',') first_indices,
      array_to_string(list(block * 1000 + a * 32 order by channel, a, b), ',') first_times,
      array_to_string(list(list_sum(y[a + 1 : b])::bigint order by channel, a, b), ',') charges from found group by block""",
)
def find_pulses_soa(spark, d):
    soa = found_pulses(spark, d).select("block", wf.as_parallel_arrays("items").alias("s"))
    return soa.filter(F.size("s.channel") > 0).select(
        "block",
        F.size("s.channel").cast("bigint").alias("n_pulses"),
        csv("s.channel").alias("channels"),
        csv(F.transform("s.original_index", lambda a: F.get(a, F.lit(0)))).alias("first_indices"),
        csv(F.transform("s.timestamps", lambda a: F.get(a, F.lit(0)))).alias("first_times"),
        csv(F.transform("s.pulses", wf.total_long)).alias("charges"),
    )


@query(
    "pulse_t0",
    W + f"select vec_id, {sql_r6('(vec_id * 1000) / 320000.0::double', 9)} t0_ms from fx_wave",
)
def pulse_t0(spark, d):
    t0 = fx.waves(spark, d).select("vec_id", wf.start_time_ms(ticks()).alias("t0"))
    return t0.filter(F.col("t0").isNotNull()).select("vec_id", r6("t0", 9).alias("t0_ms"))


@query(
    "pulse_features",
    W + """select vec_id, chip * 32 + channel gch, list_max(w) maxsample, list_sum(w)::double charge,
      len(w) n_samples from fx_wave""",
)
def pulse_features(spark, d):
    return fx.waves(spark, d).select(
        "vec_id",
        wf.global_channel("chip", "channel").alias("gch"),
        wf.peak("w").alias("maxsample"),
        wf.total("w").alias("charge"),
        F.size("w").cast("bigint").alias("n_samples"),
    )


@query(
    "pulse_peak_time",
    W + f"""select vec_id, cast(list_position(w, list_max(w)) as bigint) peak_position, cast(list_position(w, list_max(w)) - 1 as bigint) peak_index,
      {sql_r6(f"({TICKS})[list_position(w, list_max(w))] / 320000.0::double", 9)} peak_time_ms from fx_wave""",
)
def pulse_peak_time(spark, d):
    w = fx.waves(spark, d)
    return w.select(
        "vec_id",
        wf.peak_position("w").cast("bigint").alias("peak_position"),
        (wf.peak_position("w").cast("bigint") - 1).alias("peak_index"),
        r6(wf.peak_time_ms("w", ticks()), 9).alias("peak_time_ms"),
    )


@query(
    "normalized_pulse",
    W + """select vec_id, array_to_string(list_transform(w, lambda x: cast(round(x / list_max(w)::double * 1000000.0::double) as bigint)), ',') shape
      from fx_wave""",
)
def normalized_pulse(spark, d):
    return fx.waves(spark, d).select("vec_id", csv_scaled(wf.normalized("w")).alias("shape"))


@query(
    "threshold_crossings",
    W + """select vec_id,
      array_to_string(list_filter(range(64), lambda i: i > 0 and w[i + 1] > 400 and w[i] <= 400), ',') ups,
      array_to_string(list_filter(range(64), lambda i: w[i + 1] > 400 and (i = 0 or w[i] <= 400)), ',') ups_from_start,
      array_to_string(list_filter(range(64), lambda i: i > 0 and w[i + 1] <= 400 and w[i] > 400), ',') downs from fx_wave""",
)
def threshold_crossings(spark, d):
    return fx.waves(spark, d).select(
        "vec_id",
        csv(wf.crossings_up("w", 400)).alias("ups"),
        csv(wf.crossings_up("w", 400, from_start=True)).alias("ups_from_start"),
        csv(wf.crossings_down("w", 400)).alias("downs"),
    )


@query(
    "accept_waveforms",
    W + """, counted as (select vec_id, v, count(*) n, min(i) first_at from
       (select vec_id, unnest(w[1:60]) v, generate_subscripts(w[1:60], 1) i from fx_wave) group by vec_id, v),
      base as (select vec_id, v from counted qualify row_number() over (partition by vec_id order by n desc, first_at) = 1),
      y as (select vec_id, list_transform(w[1:60], lambda x: x - base.v) y from fx_wave join base using (vec_id)),
      f as (select vec_id, y, list_filter(range(60), lambda i: i > 0 and y[i + 1] > 200 and y[i] <= 200) u,
        list_filter(range(60), lambda i: i > 0 and y[i + 1] <= 200 and y[i] > 200) n from y)
      select vec_id, len(u) n_up, len(n) n_down,
        len(u) * len(n) = 1 and len(list_filter(y[11:60], lambda v: v not between -50 and 50)) = 0
        and len(list_filter(y[1:10], lambda v: v not between -10 and 1000)) = 0 and list_max(y[1:10]) > 100
        and list_sum(y[1:10]) > 400 and n[1] - u[1] >= 4
        and len(list_filter(range(1, 10), lambda i: abs(y[i + 1] - y[i]) > 200)) = 0 accepted,
        list_max(list_transform(range(1, 10), lambda i: abs(y[i + 1] - y[i]))) head_step from f""",
)
def accept_waveforms(spark, d):
    y = fx.waves(spark, d).select("vec_id", wf.subtract_mode("w", ties="first", first=60).alias("y"))
    return y.select(
        "vec_id",
        F.size(wf.crossings_up("y", 200)).cast("bigint").alias("n_up"),
        F.size(wf.crossings_down("y", 200)).cast("bigint").alias("n_down"),
        wf.acceptance("y").alias("accepted"),
        wf.max_step(wf.head("y", 10)).alias("head_step"),
    )


@query(
    "accept_simple",
    W + """select vec_id, cast(list_position(w, list_max(w)) - 1 as bigint) peak_index from fx_wave
      where len(w) > 50 and len(w) < 65 and list_max(w) - list_avg(w[1:10]) > 50""",
)
def accept_simple(spark, d):
    w = fx.waves(spark, d).filter(wf.acceptance_simple("w"))
    return w.select("vec_id", (wf.peak_position("w") - 1).cast("bigint").alias("peak_index"))


@query(
    "flatten_samples",
    E2D + """, waves as (select block, unnest(samples_value) w, generate_subscripts(samples_value, 1) - 1 channel from fx_event2d)
      select block, channel, generate_subscripts(w, 1) - 1 sample_no, channel * 64 + generate_subscripts(w, 1) - 1 flat_no, unnest(w) sample from waves""",
)
def flatten_samples(spark, d):
    waves = fx.frames2d(spark, d).select("block", F.posexplode("samples_value").alias("channel", "w"))
    long = waves.select("block", "channel", F.posexplode("w").alias("sample_no", "sample"))
    return long.select(
        "block",
        F.col("channel").cast("bigint").alias("channel"),
        F.col("sample_no").cast("bigint").alias("sample_no"),
        (F.col("channel") * 64 + F.col("sample_no")).cast("bigint").alias("flat_no"),
        "sample",
    )


@query(
    "trim_range",
    W + """select vec_id,
      array_to_string(list_transform(list_filter(list_transform(w, lambda x: x / 1000.0::double), lambda v: v >= 0.2 and v <= 0.4), lambda v: cast(round(v * 1e6::double) as bigint)), ',') closed_ns,
      array_to_string(list_transform(list_filter(list_transform(w, lambda x: x / 1000.0::double), lambda v: v > 0.2 and v < 0.4), lambda v: cast(round(v * 1e6::double) as bigint)), ',') open_ns from fx_wave""",
)
def trim_range(spark, d):
    ms = F.transform("w", lambda x: x / F.lit(1000.0))
    v = fx.waves(spark, d).select("vec_id", ms.alias("v"))
    return v.select(
        "vec_id",
        csv_scaled(wf.trim_ms_to_ns("v", 0.2, 0.4), 1).alias("closed_ns"),
        csv_scaled(wf.trim_ms_to_ns("v", 0.2, 0.4, inclusive=False), 1).alias("open_ns"),
    )


@query(
    "within_range",
    W + """, y as (select vec_id, list_transform(w, lambda x: x - 200) y from fx_wave)
      select vec_id,
      array_to_string(list_filter(y, lambda v: v >= -100 and v <= 100), ',') both_ends,
      array_to_string(list_filter(y, lambda v: v >= -100 and v < 100), ',') left_end,
      array_to_string(list_filter(y, lambda v: v > -100 and v <= 100), ',') right_end,
      array_to_string(list_filter(y, lambda v: v > -100 and v < 100), ',') no_end,
      array_to_string(list_filter(y, lambda v: abs(v) >= 50 and abs(v) <= 100), ',') magnitude,
      array_to_string(list_filter(range(64), lambda i: y[i + 1] >= -100 and y[i + 1] <= 100), ',') indices from y""",
)
def within_range(spark, d):
    y = fx.waves(spark, d).select("vec_id", F.transform("w", lambda x: x - 200).alias("y"))
    ends = [("both", "both_ends"), ("left", "left_end"), ("right", "right_end"), ("neither", "no_end")]
    return y.select(
        "vec_id",
        *[csv(wf.within_range("y", 100, -100, inclusive=i)).alias(n) for i, n in ends],
        csv(wf.within_range("y", 50, 100, absolute=True)).alias("magnitude"),
        csv(wf.within_range_indices("y", -100, 100)).alias("indices"),
    )


# ---------------------------------------------------------------- pedestal and noise

PED = E2D + """, waves as (select block, chip, unnest(samples_value) w, generate_subscripts(samples_value, 1) - 1 channel from fx_event2d),
  ped as (select block, chip, channel, list_avg(w[1:64]) mean,
    sqrt(list_avg(list_transform(w[1:64], lambda x: pow(x - list_avg(w[1:64]), 2)))) rms from waves)
"""


def pedestals(spark, d):
    ped = fx.frames2d(spark, d).select("block", "chip", F.posexplode(wf.pedestal("samples_value", 64)).alias("channel", "p"))
    return ped.select("block", "chip", F.col("channel").cast("bigint").alias("channel"), F.col("p.mean").alias("mean"), F.col("p.rms").alias("rms")).filter(F.col("rms").isNotNull())


@query("pedestal_rms", PED + f"select block, chip, channel, {sql_r6('mean')} mean, {sql_r6('rms')} rms from ped")
def pedestal_rms(spark, d):
    return pedestals(spark, d).select("block", "chip", "channel", r6("mean").alias("mean"), r6("rms").alias("rms"))


@query(
    "enc",
    PED + f"select block, chip * 32 + channel gch, {sql_r6('6241.0::double * (2000.0::double / 1024.0::double) * rms / 20.0::double', 4)} enc from ped",
)
def enc(spark, d):
    return pedestals(spark, d).select(
        "block", wf.global_channel("chip", "channel").alias("gch"), r6(wf.equivalent_noise_charge("rms"), 4).alias("enc")
    )


@query(
    "noise_samples",
    W + f"""select chip, channel, count(*) * 8 n_samples, cast(sum(list_sum(w[1:8])) as bigint) total, count(*) n_waves,
      {sql_r6('max(list_max(w) - list_avg(w[1:8]))')} largest_excess, {sql_r6('avg(list_max(w) - list_avg(w[1:8]))')} mean_excess
      from fx_wave group by chip, channel""",
)
def noise_samples(spark, d):
    lead = wf.head("w", 8)
    excess = wf.peak("w").cast("double") - wf.mean_of(lead)
    per_wave = fx.waves(spark, d).select("chip", "channel", lead.alias("lead"), excess.alias("excess"))
    return per_wave.groupBy("chip", "channel").agg(
        F.sum(F.size("lead")).cast("bigint").alias("n_samples"),
        F.sum(wf.total_long("lead")).alias("total"),
        F.count(F.lit(1)).alias("n_waves"),
        r6(F.max("excess")).alias("largest_excess"),
        r6(F.avg("excess")).alias("mean_excess"),
    )


@query(
    "channel_rms",
    W + f""", s as (select chip, channel, unnest(w) v from fx_wave),
      r as (select chip, channel, sqrt(avg(v * v)) rms from s group by chip, channel)
      select chip, count(*) n_channels, {sql_r6('min(rms)')} lowest, {sql_r6('max(rms)')} highest, {sql_r6('avg(rms)')} mean from r group by chip""",
)
def channel_rms(spark, d):
    # sums per wave first: the shuffle carries two numbers per channel instead of every sample
    squares = F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rms = (
        fx.waves(spark, d)
        .select("chip", "channel", squares.alias("sq"), F.size("w").alias("n"))
        .groupBy("chip", "channel")
        .agg(F.sqrt(F.sum("sq") / F.sum("n")).alias("rms"))
    )
    return rms.groupBy("chip").agg(
        F.count(F.lit(1)).alias("n_channels"),
        r6(F.min("rms")).alias("lowest"),
        r6(F.max("rms")).alias("highest"),
        r6(F.avg("rms")).alias("mean"),
    )
