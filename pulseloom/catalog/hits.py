"""Queries on mapped hits and per-event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom import fixtures as fx
from pulseloom.catalog.common import e6, sql_e6, FX_EVENT, FX_HIT, FX_MAP, FX_PAD, FX_PULSE, GAP_US, csv, csv_scaled, r6, sql_r6, with_views
from pulseloom.functions.calib import Readout, inverse_line, mirrored_pad
from pulseloom.operators import dims
from pulseloom.operators.fits import ols
from pulseloom.operators.position import nearest_within
from pulseloom.operators.sessions import gap_events
from pulseloom.operators.summary import PART_ROWS, ZONE_SUFFIXES, event_summary, event_times, ordered_parts, with_centroids
from pulseloom.plans import hits as plan

QUERIES = {}
ORACLE = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn

    return add


H = with_views(FX_HIT)
MAP = with_views(FX_PULSE, FX_MAP)


def mapping(spark):
    return dims.channel_map(fx.channel_map_rows(spark))


def hits(spark, d):
    return plan.build_hits(fx.pulses(spark, d), mapping(spark), "t_us", GAP_US).withColumn("maxsample", F.col("charge") % 1000 + 1)


# ---------------------------------------------------------------- dimensions and lookups

@query(
    "channel_map",
    MAP + """select map_id, tpc_id, count(pulse_no) n_pulses, cast(coalesce(sum(charge), 0) as bigint) charge
      from fx_map_gid left join fx_pulse on gch = map_id group by map_id, tpc_id""",
)
def channel_map(spark, d):
    used = fx.pulses(spark, d).groupBy("gch").agg(F.count(F.lit(1)).alias("n_pulses"), F.sum("charge").alias("charge"))
    m = mapping(spark)
    return m.join(used, m.map_id == used.gch, "left").drop("gch").fillna(0, ["n_pulses", "charge"])


@query(
    "channel_map_legacy",
    MAP + """, old as (select map_id, tpc_id // 60 + 1 tpc, tpc_id % 60 + 1 pad from fx_map_gid where tpc_id >= 0)
      select map_id, cast((tpc - 1) * 60 + pad - 1 as int) tpc_id, count(pulse_no) n_pulses
      from old left join fx_pulse on gch = map_id group by all""",
)
def channel_map_legacy(spark, d):
    g = F.expr("try_cast(gid as int)")
    raw = fx.channel_map_rows(spark).select(
        "readoutID",
        F.coalesce((F.floor(g / 60) + 1).cast("string"), F.lit("GND")).alias("tpcID"),
        F.coalesce((g % 60 + 1).cast("string"), F.lit("GND")).alias("padID"),
    )
    used = fx.pulses(spark, d).groupBy("gch").agg(F.count(F.lit(1)).alias("n_pulses"))
    m = dims.channel_map_legacy(raw)
    return m.join(used, m.map_id == used.gch, "left").drop("gch").fillna(0, ["n_pulses"])


@query(
    "map_lookup",
    MAP + """select pads.range pad, min(map_id) first_id, count(distinct map_id) n_ids, count(pulse_no) n_pulses
      from range(120) pads left join fx_map_gid on tpc_id = pads.range left join fx_pulse on gch = map_id group by pads.range""",
)
def map_lookup(spark, d):
    used = fx.pulses(spark, d).groupBy("gch").agg(F.count(F.lit(1)).alias("n_pulses"))
    m = mapping(spark)
    report = m.join(used, m.map_id == used.gch, "left").groupBy("tpc_id").agg(
        F.min("map_id").alias("first_id"), F.count("map_id").alias("n_ids"), F.sum("n_pulses").alias("n_pulses")
    )
    pads = spark.range(120).select(F.col("id").alias("pad"))
    return pads.join(report, pads.pad == report.tpc_id, "left").drop("tpc_id").fillna(0, ["n_ids", "n_pulses"])


@query(
    "map_lookup_channel",
    MAP + """select pulse_no, chip, channel, min("readoutID") "readoutID" from fx_pulse left join fx_map on "chipNo" = chip and "chipChannel" = channel
      group by pulse_no, chip, channel""",
)
def map_lookup_channel(spark, d):
    """Map id of every pulse by its chip and channel."""
    p = fx.pulses(spark, d).select("pulse_no", "chip", "channel")
    return dims.lookup_each(p, fx.channel_map_rows(spark), {"chip": "chipNo", "channel": "chipChannel"}, "readoutID")


@query(
    "map_lookup_rows",
    MAP + """select "chipNo", "chipChannel", "readoutID", gid, count(pulse_no) n_pulses from fx_map left join fx_pulse on gch = "readoutID"
      where "chipNo" = 2 group by all""",
)
def map_lookup_rows(spark, d):
    """All map rows of one chip, with the pulses that each has."""
    rows = dims.lookup(fx.channel_map_rows(spark), chipNo=2)
    used = fx.pulses(spark, d).groupBy("gch").agg(F.count(F.lit(1)).alias("n_pulses"))
    return rows.join(used, rows.readoutID == used.gch, "left").drop("gch").fillna(0, ["n_pulses"])


@query("map_channels", MAP + "select fx_pulse.*, tpc_id from fx_pulse left join fx_map_gid on gch = map_id")
def map_channels(spark, d):
    return dims.join_map(fx.pulses(spark, d), mapping(spark), "gch")


@query(
    "zone_flags",
    MAP + """select pulse_no, tpc_id, cast(tpc_id between 0 and 119 as int) is_al, cast(tpc_id between 0 and 59 as int) is_up,
      cast(tpc_id >= 60 as int) is_dn, """
    + ", ".join(f"cast(tpc_id between {n * 20} and {n * 20 + 19} as int) is_{'up' if n < 3 else 'dn'}{n % 3 + 1}" for n in range(6))
    + " from fx_pulse left join fx_map_gid on gch = map_id",
)
def zone_flags(spark, d):
    z = dims.with_zones(dims.join_map(fx.pulses(spark, d), mapping(spark), "gch"))
    return z.select("pulse_no", "tpc_id", *[F.col(c).cast("int").alias(c) for c in dims.ZONES])


@query(
    "pad_geometry",
    with_views(FX_PULSE, FX_MAP, FX_PAD) + f"""select p.tpc_id, {sql_r6('x')} x, {sql_r6('z')} z, cast(19 - p.tpc_id % 20 + 20 * (p.tpc_id // 20) as int) mirror,
      count(pulse_no) n_pulses from fx_pad p left join fx_map_gid m on m.tpc_id = p.tpc_id left join fx_pulse on gch = map_id group by p.tpc_id, x, z""",
)
def pad_geometry(spark, d):
    used = dims.join_map(fx.pulses(spark, d), mapping(spark), "gch").groupBy("tpc_id").agg(F.count(F.lit(1)).alias("n_pulses"))
    pads = dims.pad_geometry(spark).join(used, "tpc_id", "left").fillna(0, ["n_pulses"])
    return pads.select("tpc_id", r6("x").alias("x"), r6("z").alias("z"), mirrored_pad(F.col("tpc_id")).cast("int").alias("mirror"), "n_pulses")


@query(
    "pad_row_z",
    H + f"""select cast(pad_row as bigint) pad_row, {sql_r6('avg(z)')} hit_z, count(*) n_hits, min(mean_z) pad_z from fx_hit
      join (select tpc_id // 20 pad_row, {sql_r6('avg(z)')} mean_z from fx_pad group by 1) using (pad_row) group by pad_row""",
)
def pad_row_z(spark, d):
    row = F.floor(F.col("tpc_id") / F.lit(20)).cast("bigint").alias("pad_row")
    pads = dims.pad_geometry(spark)
    pad_z = pads.groupBy(row).agg(r6(F.avg("z")).alias("pad_z"))
    mapped = dims.join_pads(dims.join_map(fx.pulses(spark, d), mapping(spark), "gch"), pads).filter(F.col("tpc_id").between(0, 119))
    return mapped.groupBy(row).agg(r6(F.avg("z")).alias("hit_z"), F.count(F.lit(1)).alias("n_hits")).join(F.broadcast(pad_z), "pad_row")


@query(
    "hit_positions",
    H + f"select pulse_no, event_id, tpc_id, {sql_r6('x')} x, t_us y, {sql_r6('z')} z, charge from fx_hit",
)
def hit_positions(spark, d):
    return hits(spark, d).select("pulse_no", "event_id", "tpc_id", r6("x").alias("x"), F.col("t_us").alias("y"), r6("z").alias("z"), "charge")


@query(
    "nearest_within_tol",
    with_views(FX_PULSE) + """, r as (select pulse_no rid, t_us rt from fx_pulse where chip <> 0), l as (select pulse_no, t_us from fx_pulse where chip = 0),
      lo as (select pulse_no, t_us, rid, rt from l asof left join r on l.t_us >= r.rt),
      hi as (select pulse_no, rid, rt from l asof left join r on l.t_us <= r.rt),
      b as (select lo.pulse_no, lo.t_us, case when hi.rt is null or lo.t_us - lo.rt <= hi.rt - lo.t_us then lo.rid else hi.rid end m,
        case when hi.rt is null or lo.t_us - lo.rt <= hi.rt - lo.t_us then lo.rt else hi.rt end mt from lo join hi using (pulse_no))
      select pulse_no, t_us, case when abs(mt - t_us) <= 120000000 then m end "match", case when abs(mt - t_us) <= 120000000 then mt end match_key from b""",
)
def nearest_within_tol(spark, d):
    p = fx.pulses(spark, d).select("pulse_no", "t_us", "chip")
    return nearest_within(p.filter("chip = 0").drop("chip"), p.filter("chip <> 0").drop("chip"), "t_us", "pulse_no", 120_000_000)


@query("energy_deposit", H + f"select pulse_no, tpc_id, {sql_r6('energy')} energy from fx_all_hit")
def energy_deposit(spark, d):
    return plan.mapped(fx.pulses(spark, d), mapping(spark)).select("pulse_no", "tpc_id", r6("energy").alias("energy"))


@query(
    "energy_model",
    with_views(FX_PULSE) + f"""select pulse_no,
      {sql_r6('((charge * 0.2327::double + 2.375::double) * 1.953::double / 4.0::double) / ((1.602e-4::double / 26e-3::double) * 2781.0::double)')} energy,
      {sql_r6('((charge * 0.2327::double + 2.375::double) * 1.953::double / 4.0::double) / ((1.602e-4::double / 26e-3::double) * 133.0::double)')} gain,
      {sql_r6('charge * (0.2327::double * 1.953::double * 26e-3::double / (4.0::double * 1.602e-4::double * 2781.0::double)) + 2.375::double * 1.953::double * 26e-3::double / (4.0::double * 1.602e-4::double * 2781.0::double)')} energy_line
      from fx_pulse""",
)
def energy_model(spark, d):
    ro, q = Readout(), F.col("charge").cast("double")
    a, b = ro.line()
    return fx.pulses(spark, d).select(
        "pulse_no", r6(ro.energy(q)).alias("energy"), r6(ro.gain(q)).alias("gain"), r6(q * a + b).alias("energy_line")
    )


# ---------------------------------------------------------------- per-event tables

ZONE_SQL = {"al": "true", "up": "is_up", "dn": "is_dn"} | {f"{h}{i + 1}": f"pad_row = {3 * (h == 'dn') + i}" for h in ("up", "dn") for i in range(3)}


def zone_sums(expr: str, name: str) -> str:
    return ", ".join(f"{sql_r6(f'sum(case when {c} then {expr} else 0 end)')} {name}_{z}" for z, c in ZONE_SQL.items())


@query(
    "event_summary",
    H + f"""select event_id, {sql_r6('avg(case when is_up then z end)')} z_up, {sql_r6('avg(case when is_dn then z end)')} z_dn,
      {zone_sums('w * x', 'Wx')}, {zone_sums('w', 'Q')}, {zone_sums('energy', 'E')},
      count(*) N_al, count(*) filter (is_up) N_up, count(*) filter (is_dn) N_dn from fx_hit group by event_id""",
)
def q_event_summary(spark, d):
    s = event_summary(hits(spark, d))
    sums = [r6(c).alias(c) for z in ZONE_SUFFIXES for c in (f"Wx_{z}", f"Q_{z}", f"E_{z}")]
    return s.select("event_id", r6("z_up").alias("z_up"), r6("z_dn").alias("z_dn"), *sums, "N_al", "N_up", "N_dn")


@query(
    "event_hits",
    H + f""", t as (select event_id, tpc_id, x, t_us y, z, energy, pulse_no,
      cast((row_number() over (partition by event_id order by tpc_id, x, t_us, z, energy, pulse_no) - 1) // {PART_ROWS} as bigint) part from fx_hit)
      select event_id, part, array_to_string(list(tpc_id order by tpc_id, x, y, z, energy, pulse_no), ',') tpc_ids,
       array_to_string(list(cast(round(x * 1000) as bigint) order by tpc_id, x, y, z, energy, pulse_no), ',') xs,
       array_to_string(list(y order by tpc_id, x, y, z, energy, pulse_no), ',') ys,
       array_to_string(list(cast(round(z * 1000) as bigint) order by tpc_id, x, y, z, energy, pulse_no), ',') zs,
       array_to_string(list(cast(round(energy * 1000) as bigint) order by tpc_id, x, y, z, energy, pulse_no), ',') energies from t group by event_id, part""",
)
def event_hits(spark, d):
    h = hits(spark, d).select("event_id", "tpc_id", "x", F.col("t_us").alias("y"), "z", "energy", "pulse_no")
    parts = ordered_parts(h, ["event_id"], ["tpc_id", "x", "y", "z", "energy", "pulse_no"], ["tpc_id", "x", "y", "z", "energy"])
    return parts.select(
        "event_id",
        "part",
        csv("tpc_id").alias("tpc_ids"),
        csv_scaled(F.col("x"), 1000).alias("xs"),
        csv("y").alias("ys"),
        csv_scaled(F.col("z"), 1000).alias("zs"),
        csv_scaled(F.col("energy"), 1000).alias("energies"),
    )


CENTROID_SQL = ", ".join(
    f"{sql_r6(f'sum(case when {ZONE_SQL[z]} then w * x end) / nullif(sum(case when {ZONE_SQL[z]} then w end), 0)')} x_{z[0]}g{z[2:]}"
    for z in ["up", "dn", "up1", "up2", "up3", "dn1", "dn2", "dn3"]
)
CENTROIDS = ["x_ug", "x_dg", "x_ug1", "x_ug2", "x_ug3", "x_dg1", "x_dg2", "x_dg3"]


@query("event_centroids", H + f"select event_id, {CENTROID_SQL} from fx_hit group by event_id")
def event_centroids(spark, d):
    e = with_centroids(event_summary(hits(spark, d)))
    return e.select("event_id", *[r6(c).alias(c) for c in CENTROIDS])


@query(
    "event_centroids_peak",
    H + ("select event_id, " + ", ".join(
        f"{sql_r6(f'sum(case when {c} then maxsample * x end) / nullif(sum(case when {c} then maxsample end), 0)')} x_{z}, cast(coalesce(sum(case when {c} then maxsample end), 0) as bigint) peak_{z}"
        for z, c in (("up", "is_up"), ("dn", "is_dn"))) + " from fx_hit group by event_id"),
)
def event_centroids_peak(spark, d):
    cols = []
    for z in ("up", "dn"):
        m = F.when(F.col(f"is_{z}"), F.col("maxsample"))
        cols.append(r6(F.try_divide(F.sum(m * F.col("x")), F.nullif(F.sum(m), F.lit(0)))).alias(f"x_{z}"))
        cols.append(F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(f"peak_{z}"))
    return hits(spark, d).groupBy("event_id").agg(*cols)


TIMES_SQL = """, rel as (select *, t_us - min(t_us) over (partition by event_id) rel from fx_hit),
  times as (select event_id, min(t_us) y_offset, avg(case when is_up then rel end) * 1000.0::double y_up_ns,
    avg(case when is_dn then rel end) * 1000.0::double y_dn_ns from rel group by event_id)
"""


@query("event_times", H + TIMES_SQL + f"select event_id, y_offset, {sql_r6('y_up_ns', 1)} y_up_ns, {sql_r6('y_dn_ns', 1)} y_dn_ns from times")
def q_event_times(spark, d):
    t = event_times(hits(spark, d), "t_us", 1000.0)
    return t.select("event_id", "y_offset", r6("y_up_ns", 1).alias("y_up_ns"), r6("y_dn_ns", 1).alias("y_dn_ns"))


TRACK_SQL = """, pts as (select event_id, w, x u, z v from fx_hit where w > 0),
  cen as (select event_id, count(*) n, sum(w) sw, sum(w * u) / sum(w) cu, sum(w * v) / sum(w) cv from pts group by event_id),
  mom as (select event_id, n, sw, cu, cv, sum(w * (u - cu) * (u - cu)) / sw suu0, sum(w * (v - cv) * (v - cv)) / sw svv0,
    sum(w * (u - cu) * (v - cv)) / sw suv0 from pts join cen using (event_id) group by event_id, n, sw, cu, cv),
  sn as (select *, case when abs(suu0) < 1e-8 then 0.0 else suu0 end suu, case when abs(svv0) < 1e-8 then 0.0 else svv0 end svv,
    case when abs(suv0) < 1e-8 then 0.0 else suv0 end suv from mom),
  ang as (select *, atan2(2 * suv, suu - svv) / 2 th from sn),
  track as (select event_id, case when n >= 2 and abs(cos(th)) >= 1e-12 then sin(th) / cos(th) end a_slope,
    case when n >= 2 and abs(cos(th)) >= 1e-12 then cv - sin(th) / cos(th) * cu end a_intercept,
    case when n >= 2 then sw * greatest(0.0, (suu + svv) / 2 - sqrt(((suu - svv) / 2) * ((suu - svv) / 2) + suv * suv)) end a_chi2,
    case when n >= 2 then degrees(th) end a_angle_deg, cast(n as int) a_n_points,
    cast(greatest(n - 2, 0) as int) a_dof from ang)
"""
TRACK_OUT = f"""{sql_e6('a_slope')} a_slope, {sql_e6('a_intercept')} a_intercept, {sql_r6('a_chi2', 3)} a_chi2,
  {sql_r6('case when a_dof > 0 then a_chi2 / a_dof end', 3)} a_chi2_reduced, {sql_r6('a_angle_deg', 4)} a_angle_deg, a_n_points, a_dof"""


def track_columns():
    return [
        e6("a_slope").alias("a_slope"),
        e6("a_intercept").alias("a_intercept"),
        r6("a_chi2", 3).alias("a_chi2"),
        r6("a_chi2_reduced", 3).alias("a_chi2_reduced"),
        r6("a_angle_deg", 4).alias("a_angle_deg"),
        "a_n_points",
        "a_dof",
    ]


@query("track_fit", H + TRACK_SQL + f"select event_id, {TRACK_OUT} from track")
def q_track_fit(spark, d):
    return plan.build_tracks(hits(spark, d)).select("event_id", *track_columns())


@query(
    "event_tracks",
    H + TRACK_SQL + f", s as (select event_id, count(*) N_al, sum(w) Q_al from fx_hit group by event_id) select event_id, N_al, Q_al, {TRACK_OUT} from s left join track using (event_id)",
)
def event_tracks(spark, d):
    h = hits(spark, d)
    return plan.build_summary_tracks(h).select("event_id", "N_al", "Q_al", *track_columns())


SUMS_SQL = """, sums as (select event_id, count(*) filter (is_up) N_up, count(*) filter (is_dn) N_dn,
  sum(case when is_up then w else 0 end) Q_up, sum(case when is_dn then w else 0 end) Q_dn,
  sum(case when is_up then energy else 0 end) E_up, sum(case when is_dn then energy else 0 end) E_dn,
  sum(case when is_up then w * x end) / nullif(sum(case when is_up then w end), 0) x_ug,
  sum(case when is_dn then w * x end) / nullif(sum(case when is_dn then w end), 0) x_dg,
  sum(case when pad_row = 0 then energy else 0 end) E_up1, sum(case when pad_row = 1 then energy else 0 end) E_up2,
  sum(case when pad_row = 2 then energy else 0 end) E_up3 from fx_hit group by event_id)
"""


@query(
    "event_selection",
    H + SUMS_SQL + f"select event_id, N_up, N_dn, Q_up, Q_dn, {sql_r6('x_ug')} x_ug from sums where Q_up < 30e3 and Q_dn > 2e3 and N_dn < 13 and N_up < 13 and abs(x_ug) < 10",
)
def event_selection(spark, d):
    e = plan.select_events(with_centroids(event_summary(hits(spark, d))), q_dn_min=2e3).filter(F.abs("x_ug") < 10)
    return e.select("event_id", "N_up", "N_dn", "Q_up", "Q_dn", r6("x_ug").alias("x_ug"))


@query(
    "track_inverse",
    H + TRACK_SQL + f"""select event_id, {sql_e6('(case when a_slope <> 0 then 1.0 / a_slope end)')} slope,
      {sql_e6('(case when a_slope <> 0 then -a_intercept / a_slope end)')} intercept from track""",
)
def track_inverse(spark, d):
    t = plan.build_tracks(hits(spark, d))
    s, i = inverse_line(F.col("a_slope"), F.col("a_intercept"))
    return t.select("event_id", e6(s).alias("slope"), e6(i).alias("intercept"))


@query(
    "track_ols",
    H + f"""select event_id, is_dn downstream, count(*) n, {sql_r6('regr_slope(x, z)', 5)} slope, {sql_r6('regr_intercept(x, z)', 3)} intercept
      from fx_hit group by event_id, is_dn having count(*) >= 2 and max(z) - min(z) > 1e-9""",
)
def track_ols(spark, d):
    # positions relative to a fixed point, so coinciding z give exactly no spread
    h = hits(spark, d).withColumn("z", F.round("z", 9))
    f = ols(h.withColumnRenamed("is_dn", "downstream"), "z", "x", by=["event_id", "downstream"]).filter(F.col("n") >= 2)
    return f.select("event_id", "downstream", "n", r6("slope", 5).alias("slope"), r6("intercept", 3).alias("intercept"))


@query(
    "hit_map",
    H + f"""select event_id, tpc_id, {sql_r6('sum(energy)')} energy, count(*) n_hits from fx_hit
      where event_id in (select event_id from fx_hit group by event_id having count(*) filter (is_up) > 3 and count(*) filter (is_dn) > 3)
      group by event_id, tpc_id""",
)
def hit_map(spark, d):
    # per pad first: at most 120 rows per event reach the event-level test
    pads = hits(spark, d).groupBy("event_id", "tpc_id").agg(F.sum("energy").alias("energy"), F.count(F.lit(1)).alias("n_hits"))
    up, dn = F.col("tpc_id") < 60, F.col("tpc_id") >= 60
    full = pads.groupBy("event_id").agg(
        F.sum(F.when(up, F.col("n_hits"))).alias("nu"), F.sum(F.when(dn, F.col("n_hits"))).alias("nd")
    ).filter("nu > 3 and nd > 3")
    return pads.join(full, "event_id", "left_semi").select("event_id", "tpc_id", r6("energy").alias("energy"), "n_hits")


@query(
    "downstream_filter",
    H + "select event_id, count(*) n_hits, count(*) filter (tpc_id >= 60) n_down from fx_hit group by event_id having count(*) filter (tpc_id >= 60) > 5",
)
def downstream_filter(spark, d):
    n = hits(spark, d).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(F.col("tpc_id") >= 60).alias("n_down"))
    return n.filter("n_down > 5")


@query(
    "chip_charge_pairs",
    with_views(FX_EVENT) + """, s as (select event_id, """
    + ", ".join(f"cast(coalesce(sum(charge) filter (chip = {c}), 0) as bigint) q{c}" for c in range(4))
    + " from fx_event where channel <= 15 group by event_id) select * from s where q0 > 0 and q1 > 0 and q2 > 0 and q3 > 0",
)
def chip_charge_pairs(spark, d):
    e = gap_events(fx.pulses(spark, d), "t_us", GAP_US).filter("channel <= 15")
    wide = e.groupBy("event_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("chip") == c, F.col("charge"))), F.lit(0)).alias(f"q{c}") for c in range(4)]
    )
    return wide.filter("q0 > 0 and q1 > 0 and q2 > 0 and q3 > 0")


@query(
    "charge_matrix",
    with_views(FX_EVENT) + """, lastq as (select event_id, gch, arg_max(charge, t_us) q from fx_event group by event_id, gch),
      m as (select event_id, map_from_entries(list((gch, q))) m, count(*) n from lastq group by event_id)
      select event_id, n n_channels, array_to_string(list_transform(range(128), lambda i: coalesce(m[i], 0)), ',') charges from m""",
)
def charge_matrix(spark, d):
    e = gap_events(fx.pulses(spark, d), "t_us", GAP_US)
    last = e.groupBy("event_id", "gch").agg(F.max_by("charge", F.struct("t_us", "pulse_no")).alias("q"))
    # at most 128 channels per event from here on
    per = last.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("gch", "q"))).alias("m"), F.count(F.lit(1)).alias("n_channels"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0)))
    return per.select("event_id", "n_channels", csv(dense).alias("charges"))
