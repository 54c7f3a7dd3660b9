"""Histograms, fits and detector checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom import fixtures as fx
from pulseloom.catalog.common import FX_HIT, FX_PULSE, FX_WAVE, r6, sql_r6, with_views
from pulseloom.catalog.hits import SUMS_SQL, TIMES_SQL, TRACK_SQL, hits
from pulseloom.functions import waveform as wf
from pulseloom.operators import hist
from pulseloom.operators.fits import gauss_fit, ols
from pulseloom.operators.summary import event_summary
from pulseloom.plans import checks
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


W = with_views(FX_WAVE)
P = with_views(FX_PULSE)
H = with_views(FX_HIT)
SAMPLES = W + ", s as (select vec_id, unnest(w) v from fx_wave)"
FEATURES = W + ", f as (select vec_id, chip, channel, list_max(w) top, cast(list_sum(w) as bigint) q from fx_wave)"


def features(spark, d):
    return fx.waves(spark, d).select("vec_id", "chip", "channel", wf.peak("w").alias("top"), wf.total_long("w").alias("q"))


def sql_bins(table: str, x: str, lo: float, width: float, n: int, hi: float, weight: str = "count(*)", where: str = "true") -> str:
    return f"""(select b.range bin, coalesce(n, 0) n from range({n}) b left join
      (select least(cast(floor(({x} - {lo}::double) / {width}::double) as bigint), {n - 1}) bin, {weight} n from {table}
       where {x} >= {lo} and {x} <= {hi} and {where} group by 1) c on c.bin = b.range)"""


# ---------------------------------------------------------------- histograms

@query("hist1d", FEATURES + f"select bin, {sql_r6('350 + bin * 12.5')} \"left\", {sql_r6('350 + bin * 12.5 + 6.25')} center, n from {sql_bins('f', 'top', 350, 12.5, 40, 850)}")
def hist1d(spark, d):
    h = hist.hist1d(features(spark, d), "top", 350, 850, 40)
    return h.select("bin", r6("left").alias("left"), r6("center").alias("center"), "n")


@query(
    "hist1d_auto",
    SAMPLES + """, st as (select min(v)::double lo, max(v)::double hi, count(*) n, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) iqr from s),
      wd as (select lo, hi, n, greatest(1.0, least(greatest(2.0 * iqr * pow(n, -1.0 / 3.0), (hi - lo) / sqrt(n) / 2.0), (hi - lo) / (log2(n) + 1.0))) wdt from st),
      k as (select lo, hi, cast(ceil((hi - lo) / wdt) as bigint) nb from wd),
      c as (select least(cast(floor((v - lo) / ((hi - lo) / nb)) as bigint), nb - 1) bin, count(*) n from s, k group by 1)
      select b bin, coalesce(n, 0) n from (select unnest(range(nb)) b from k) left join c on c.bin = b""",
)
def hist1d_auto(spark, d):
    s = fx.waves(spark, d).select(F.explode("w").alias("v"))
    return hist.hist1d_auto(s, "v", integers=True).select("bin", "n")


OVER = "case when {x} < {lo} then 0 when {x} >= {hi} then {e} else 1 + cast(floor(({x} - {lo}) / {w}::double) as bigint) end"


@query(
    "hist1d_overflow",
    FEATURES + f"""select cast(b as bigint) bin, count(*) n, case when b = 0 then 'under' when b = 21 then 'over' else 'in' end place
      from (select {OVER.format(x='top', lo=500, hi=800, e=21, w=15)} b from f) group by b""",
)
def hist1d_overflow(spark, d):
    return hist.hist1d_overflow(features(spark, d), "top", 500, 800, 21)


@query(
    "hist1d_arrays",
    SAMPLES + f"""select cast(b as bigint) bin, count(*) n, case when b = 0 then 'under' when b = 31 then 'over' else 'in' end place
      from (select {OVER.format(x='v', lo=50, hi=350, e=31, w=10)} b from s) group by b""",
)
def hist1d_arrays(spark, d):
    return hist.hist1d_overflow(fx.waves(spark, d).select(F.explode("w").alias("v")), "v", 50, 350, 31)


CELLS = """(select least(cast(floor((top - 350) / 25::double) as bigint), 19) bx, least(cast(floor((q - 8000) / 500::double) as bigint), 19) "by", count(*) n
  from f where top between 350 and 850 and q between 8000 and 18000 group by 1, 2)"""


def cells(spark, d):
    return hist.hist2d(features(spark, d), "top", "q", (350, 850), (8000, 18000), 20, 20)


@query("hist2d", FEATURES + f'select bx, "by", n from {CELLS}')
def hist2d(spark, d):
    return cells(spark, d)


@query(
    "hist2d_overflow",
    FEATURES + f"""select cast(bx as bigint) bx, cast(b as bigint) "by", count(*) n, case when bx = 0 then 'under' when bx = 11 then 'over' else 'in' end place_x,
      case when b = 0 then 'under' when b = 11 then 'over' else 'in' end place_y from (select
      {OVER.format(x='top', lo=500, hi=800, e=11, w=30)} bx, {OVER.format(x='q', lo=11000, hi=14000, e=11, w=300)} b from f) group by bx, b""",
)
def hist2d_overflow(spark, d):
    return hist.hist2d_overflow(features(spark, d), "top", "q", (500, 800), (11000, 14000), 11, 11)


@query(
    "hist2d_arrays",
    W + f""", xy as (select unnest(w[1:60]) x, unnest(list_transform(w[1:60], lambda v, i: i)) y from fx_wave)
      select cast(bx as bigint) bx, cast(b as bigint) "by", count(*) n, case when bx = 0 then 'under' when bx = 16 then 'over' else 'in' end place_x,
      case when b = 0 then 'under' when b = 7 then 'over' else 'in' end place_y from (select
      {OVER.format(x='x', lo=50, hi=350, e=16, w=20)} bx, {OVER.format(x='y', lo=0, hi=60, e=7, w=10)} b from xy) group by bx, b""",
)
def hist2d_arrays(spark, d):
    a = fx.waves(spark, d).select("w", F.expr("transform(sequence(1, 60), i -> cast(i as bigint))").alias("i"))
    return hist.hist2d_overflow(hist.explode_aligned(a, "w", "i"), "x", "y", (50, 350), (0, 60), 16, 7)


@query(
    "hist2d_slice_bin",
    FEATURES + f'select "by" bin, n, {sql_r6("n / (sum(n) over () * 500.0::double)", 9)} density from {CELLS} where bx = 11',
)
def hist2d_slice_bin(spark, d):
    s = hist.slice_by_bin(cells(spark, d), 11, normalize_width=500.0)
    return s.withColumn("density", r6("density", 9))


@query(
    "hist2d_slice_range",
    FEATURES + f"select bin, n, {sql_r6('n / (sum(n) over () * 500.0::double)', 9)} density from {sql_bins('f', 'q', 8000, 500, 20, 18000, where='top >= 600 and top < 700')}",
)
def hist2d_slice_range(spark, d):
    s = hist.slice_by_range(features(spark, d), "top", "q", 600, 700, 8000, 18000, 20, normalize=True)
    return s.withColumn("density", r6("density", 9))


@query(
    "hist2d_stats",
    FEATURES + f""", c as (select * from {CELLS})
      select cast(sum(n) as bigint) entries, count(*) cells, max(n) most_n,
       (select bx from c order by n desc, bx, "by" limit 1) most_bx, (select "by" from c order by n desc, bx, "by" limit 1) most_by,
       min(n) least_n, {sql_r6('log10(max(n) + 1)')} most_log from c""",
)
def hist2d_stats(spark, d):
    return hist.hist2d_stats(cells(spark, d)).withColumn("most_log", r6("most_log"))


GRID = f"""g as (select gx.range bx, gy.range "by", coalesce(c.n, 0) n from range(20) gx cross join range(20) gy
  left join (select * from {CELLS}) c on c.bx = gx.range and c."by" = gy.range)"""


@query("hist2d_log", FEATURES + f", {GRID} select bx, \"by\", n, {sql_r6('log10(n + 1)')} log_n from g")
def hist2d_log(spark, d):
    return hist.all_cells(cells(spark, d), 20, 20).withColumn("log_n", r6("log_n"))


@query(
    "hist2d_range",
    FEATURES + f""", {GRID}, hi as (select * from g order by n desc, bx, "by" limit 1), lo as (select * from g order by n, bx, "by" limit 1)
      select (select cast(sum(n) as bigint) from g) entries, (select count(*) from g where n = 0) "empty", hi.n most_n, hi.bx most_bx, hi."by" most_by,
        lo.n least_n, lo.bx least_bx, lo."by" least_by from hi cross join lo""",
)
def hist2d_range(spark, d):
    return hist.hist2d_range(cells(spark, d), 20, 20)


@query("occupancy", P + f"select bin id, n from {sql_bins('fx_pulse', 'gch', 0, 1, 128, 128)}")
def occupancy(spark, d):
    return hist.hist1d(fx.pulses(spark, d), "gch", 0, 128, 128).select(F.col("bin").alias("id"), "n")


# ---------------------------------------------------------------- fits

@query(
    "ols_fit",
    FEATURES + f""", m as (select chip, count(*) n, regr_slope(top, q) a, regr_intercept(top, q) b, regr_r2(top, q) r2, regr_sxx(top, q) sxx,
        regr_syy(top, q) - regr_slope(top, q) * regr_sxy(top, q) rss, avg(q) mx, avg(top) my from f group by chip)
      select chip, n, {sql_r6('a', 9)} slope, {sql_r6('b', 4)} intercept, {sql_r6('r2')} r2, {sql_r6('rss', 2)} rss, n - 2 dof,
        {sql_r6('sqrt(rss / (n - 2) / sxx)', 9)} stderr_slope, {sql_r6('sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx))', 4)} stderr_intercept,
        {sql_r6('-mx * rss / (n - 2) / sxx', 6)} cov_ab, {sql_r6('mx', 4)} x_mean, {sql_r6('my', 4)} y_mean, {sql_r6('a * 4000 + b', 4)} at_4000 from m""",
)
def ols_fit(spark, d):
    f = ols(features(spark, d), "q", "top", by=["chip"])
    digits = {"slope": 9, "intercept": 4, "r2": 6, "rss": 2, "stderr_slope": 9, "stderr_intercept": 4, "cov_ab": 6, "x_mean": 4, "y_mean": 4}
    at = (F.col("slope") * 4000 + F.col("intercept")).alias("at_4000")
    return f.select("chip", "n", "dof", *[r6(c, k).alias(c) for c, k in digits.items()], r6(at, 4).alias("at_4000"))


@query(
    "charge_height_fit",
    FEATURES + f"select count(*) n, {sql_r6('regr_slope(top, q)', 9)} slope, {sql_r6('regr_intercept(top, q)', 4)} intercept, {sql_r6('regr_r2(top, q)')} r2 from f where q < 13000",
)
def charge_height_fit(spark, d):
    f = ols(features(spark, d).filter("q < 13000"), "q", "top")
    return f.select("n", r6("slope", 9).alias("slope"), r6("intercept", 4).alias("intercept"), r6("r2").alias("r2"))


def gauss_sql(source: str, x: str, lo: float, hi: float, n: int, fit: tuple, by: str = "", positive: bool = False) -> str:
    """CTEs that end in ``gf`` with the parabola fit of a histogram, written with normal equations in SQL."""
    w = (hi - lo) / n
    key, keyed = (f"{by}, ", f"{by}, ") if by else ("", "")
    grid = f"(select distinct {by} from {source}) g, range({n}) r" if by else f"range({n}) r"
    on = f"c.bin = r.range and ({' and '.join(f'c.{k.strip()} = g.{k.strip()}' for k in by.split(','))})" if by else "c.bin = r.range"
    gk = ", ".join(f"g.{k.strip()}" for k in by.split(",")) + ", " if by else ""
    group = f"group by {by}" if by else ""
    using = f"join m using ({by})" if by else "cross join m"
    using_p = f"join par using ({by})" if by else "cross join par"
    return f"""
  hc as (select {key}least(cast(floor(({x} - {lo}::double) / {w!r}::double) as bigint), {n - 1}) bin, count(*) n from {source}
     where {x} >= {lo} and {x} <= {hi} group by all),
  hb as (select {gk}0.5::double * (({lo} + r.range * {w!r}::double) + ({lo} + (r.range + 1) * {w!r}::double)) x, coalesce(c.n, 0)::double y
     from {grid} left join hc c on {on}),
  hf as (select * from hb where x between {fit[0]} and {fit[1]} {'and y > 0' if positive else ''}),
  m as (select {key}count(*) k, avg(x) c, max(x) - min(x) span, sum(y) sy, sum(x * y) sxy, max(y) top, stddev_pop(x) sd from hf {group} having count(*) >= 3),
  t as (select *, (x - c) / span t, greatest(y, 1.0) w2, ln(greatest(y, 1e-12)) l, case when sy > 0 then sxy / sy else c end mu0 from hf {using}),
  sm as (select {key}k, c, span, sy, top, mu0, sd, sum(w2) s0, sum(w2*t) s1, sum(w2*t*t) s2, sum(w2*t*t*t) s3, sum(w2*t*t*t*t) s4,
     sum(w2*l) l0, sum(w2*t*l) l1, sum(w2*t*t*l) l2, sum((x - mu0) * (x - mu0) * y) ss from t group by {key}k, c, span, sy, top, mu0, sd),
  dt as (select *, s0*(s2*s4-s3*s3)-s1*(s1*s4-s3*s2)+s2*(s1*s3-s2*s2) det from sm),
  co as (select *, (l0*(s2*s4-s3*s3)-s1*(l1*s4-s3*l2)+s2*(l1*s3-s2*l2))/det b0,
     (s0*(l1*s4-s3*l2)-l0*(s1*s4-s3*s2)+s2*(s1*l2-l1*s2))/det b1,
     (s0*(s2*l2-l1*s3)-s1*(s1*l2-l1*s2)+l0*(s1*s3-s2*s2))/det b2 from dt),
  par as (select {keyed}k n_bins, coalesce(b2 < 0, false) converged,
     case when b2 < 0 then exp(b0 + b1*b1*(-0.5/b2)/2) when sy > 0 then greatest(top, 1e-9) else 1.0 end amplitude,
     case when b2 < 0 then c + b1*(-0.5/b2)*span else mu0 end mu,
     case when b2 < 0 then sqrt(greatest(-0.5/b2, 0)) * span when sy > 0 and ss > 0 then sqrt(ss / greatest(sy, 1.0)) when sy <= 0 and sd > 0 then sd else span / 6 end sigma from co),
  gf as (select {keyed}n_bins, amplitude, mu, sigma, converged,
     sum(pow((y - amplitude * exp(-((x - mu) / sigma) * ((x - mu) / sigma) / 2)) / sqrt(greatest(y, 1.0)), 2)) chi2
     from hf {using_p} group by {keyed}n_bins, amplitude, mu, sigma, converged)
"""


FIT_OUT = f"""n_bins, converged, {sql_r6('amplitude', 4)} amplitude, {sql_r6('mu', 5)} mu, {sql_r6('sigma', 5)} sigma, {sql_r6('chi2', 3)} chi2,
  {sql_r6('chi2 / greatest(n_bins - 3, 1)', 4)} chi2_red"""


def fit_columns():
    digits = {"amplitude": 4, "mu": 5, "sigma": 5, "chi2": 3, "chi2_red": 4}
    return ["n_bins", "converged", *[r6(c, k).alias(c) for c, k in digits.items()]]


# Gauss-Newton steps on the whole histogram, from its moments, until nothing moves; J has the derivatives by A, mu and sigma.
NEWTON = W + """, q as (select list_sum(w)::double q from fx_wave),
  hb as (select 9200.0 + 400 * r.range x, (select count(*) from q where q >= 9000 + 400 * r.range and (q < 9400 + 400 * r.range or (r.range = 24 and q <= 19000)))::double y
    from range(25) r),
  h as (select list(struct_pack(x := x, y := y, v := 1 / greatest(y, 1)) order by x) h, max(y) a, sum(x * y) / sum(y) m from hb),
  walk(k, h, a, m, s) as (
    select 0, h, a, m, sqrt(list_sum(list_transform(h, lambda e: e.y * (e.x - m) * (e.x - m))) / list_sum(list_transform(h, lambda e: e.y))) from h
    union all
    select k + 1, h, a + (p0*(n11*n22-n12*n12) - n01*(p1*n22-n12*p2) + n02*(p1*n12-n11*p2)) / det, m + (n00*(p1*n22-n12*p2) - p0*(n01*n22-n12*n02) + n02*(n01*p2-p1*n02)) / det,
      s + (n00*(n11*p2-p1*n12) - n01*(n01*p2-p1*n02) + p0*(n01*n12-n11*n02)) / det
    from (select *, n00*(n11*n22-n12*n12) - n01*(n01*n22-n12*n02) + n02*(n01*n12-n11*n02) det from (select *,
      list_sum(list_transform(j, lambda e: e.v*e.g*e.g)) n00, list_sum(list_transform(j, lambda e: e.v*e.g*e.d)) n01, list_sum(list_transform(j, lambda e: e.v*e.g*e.f)) n02,
      list_sum(list_transform(j, lambda e: e.v*e.d*e.d)) n11, list_sum(list_transform(j, lambda e: e.v*e.d*e.f)) n12, list_sum(list_transform(j, lambda e: e.v*e.f*e.f)) n22,
      list_sum(list_transform(j, lambda e: e.v*e.g*e.r)) p0, list_sum(list_transform(j, lambda e: e.v*e.d*e.r)) p1, list_sum(list_transform(j, lambda e: e.v*e.f*e.r)) p2
      from (select *, list_transform(h, lambda e: struct_pack(v := e.v, g := exp(-((e.x-m)/s)*((e.x-m)/s)/2), d := a*exp(-((e.x-m)/s)*((e.x-m)/s)/2)*(e.x-m)/s/s,
        f := a*exp(-((e.x-m)/s)*((e.x-m)/s)/2)*((e.x-m)/s)*((e.x-m)/s)/s, r := e.y - a*exp(-((e.x-m)/s)*((e.x-m)/s)/2))) j from walk where k < 60)))),
  best as (select *, list_transform(h, lambda e: struct_pack(v := e.v, g := exp(-((e.x-m)/s)*((e.x-m)/s)/2), d := a*exp(-((e.x-m)/s)*((e.x-m)/s)/2)*(e.x-m)/s/s,
        f := a*exp(-((e.x-m)/s)*((e.x-m)/s)/2)*((e.x-m)/s)*((e.x-m)/s)/s, r := e.y - a*exp(-((e.x-m)/s)*((e.x-m)/s)/2))) j from walk where k = 60),
  nm as (select *, list_sum(list_transform(j, lambda e: e.v*e.g*e.g)) n00, list_sum(list_transform(j, lambda e: e.v*e.g*e.d)) n01, list_sum(list_transform(j, lambda e: e.v*e.g*e.f)) n02,
      list_sum(list_transform(j, lambda e: e.v*e.d*e.d)) n11, list_sum(list_transform(j, lambda e: e.v*e.d*e.f)) n12, list_sum(list_transform(j, lambda e: e.v*e.f*e.f)) n22,
      list_sum(list_transform(j, lambda e: e.v*e.r*e.r)) chi2 from best),
  dt as (select *, n00*(n11*n22-n12*n12) - n01*(n01*n22-n12*n02) + n02*(n01*n12-n11*n02) det from nm)
"""


@query("gauss_least_squares", NEWTON + f"""select cast(25 as bigint) n_bins, 'least_squares' "method", {sql_r6('a', 3)} amplitude, {sql_r6('m', 2)} mu, {sql_r6('s', 2)} sigma,
  {sql_r6('chi2', 3)} chi2, {sql_r6('sqrt((n11*n22-n12*n12) / det)', 3)} amplitude_error, {sql_r6('sqrt((n00*n22-n02*n02) / det)', 2)} mu_error,
  {sql_r6('sqrt((n00*n11-n01*n01) / det)', 2)} sigma_error from dt""")
def gauss_least_squares(spark, d):
    """The distribution of the waves' sums, fitted with Poisson weights, with standard errors."""
    sums = fx.waves(spark, d).select(wf.total("w").alias("q"))
    f = gauss_fit(hist.hist1d(sums, "q", 9000, 19000, 25), method="least_squares")
    digits = {"amplitude": 3, "mu": 2, "sigma": 2, "chi2": 3, "amplitude_error": 3, "mu_error": 2, "sigma_error": 2}
    return f.select("n_bins", "method", *[r6(c, k).alias(c) for c, k in digits.items()])


@query("gauss_fit", SAMPLES + ", " + gauss_sql("s", "v", 0, 1000, 50, (0, 400)) + f"select {FIT_OUT} from gf")
def q_gauss_fit(spark, d):
    s = fx.waves(spark, d).select(F.explode("w").alias("v"))
    return gauss_fit(hist.hist1d(s, "v", 0, 1000, 50), fit_range=(0, 400)).select(*fit_columns())


@query(
    "pulse_height_fit",
    FEATURES + ", one as (select * from f where channel = 15), " + gauss_sql("one", "top", 350, 950, 12, (350, 950), positive=True)
    + f"select {FIT_OUT}, {sql_r6('sigma / mu * 100', 4)} percent from gf",
)
def pulse_height_fit(spark, d):
    one = features(spark, d).filter("channel = 15")
    f = gauss_fit(hist.hist1d(one, "top", 350, 950, 12), fit_range=(350, 950), mode="positive")
    return f.select(*fit_columns(), r6(F.col("sigma") / F.col("mu") * 100, 4).alias("percent"))


@query(
    "noise_sigma",
    W + ", b as (select chip, channel, unnest(w[1:8]) v from fx_wave), " + gauss_sql("b", "v", 0, 1024, 64, (0, 1024), by="chip, channel", positive=True)
    + f"select chip, channel, n_bins, converged, {sql_r6('mu', 4)} mu, {sql_r6('sigma', 4)} sigma, {sql_r6('6241.0::double * (2000.0::double / 1024.0::double) * sigma / 20.0::double', 2)} enc from gf",
)
def noise_sigma(spark, d):
    b = fx.waves(spark, d).select("chip", "channel", F.explode(wf.head("w", 8)).alias("v"))
    f = checks.noise_sigma(b, "v", ["chip", "channel"], bins=64, mode="positive")
    return f.select("chip", "channel", "n_bins", "converged", r6("mu", 4).alias("mu"), r6("sigma", 4).alias("sigma"), r6("enc", 2).alias("enc"))


# ---------------------------------------------------------------- checks on events

def events(spark, d, times: bool = False):
    h = hits(spark, d)
    if times:
        return plan.build_events(h, "t_us", 1000.0)
    return plan.build_summary_tracks(h)


EVENTS = H + TRACK_SQL + SUMS_SQL + """, ev as (select s.*, a_slope, a_intercept, a_chi2, a_dof,
   case when a_slope <> 0 then 1.0 / a_slope end slope, case when a_slope <> 0 then -a_intercept / a_slope end intercept
   from sums s left join track using (event_id))"""
TEVENTS = H + TIMES_SQL + TRACK_SQL + SUMS_SQL + """, ev as (select s.*, y_up_ns, y_dn_ns, case when a_slope <> 0 then 1.0 / a_slope end slope
   from sums s left join track using (event_id) left join times using (event_id))"""


@query(
    "track_distributions",
    EVENTS + f"""select 'slope' what, bin, n from {sql_bins('ev', 'slope', -1, 0.05, 40, 1)}
      union all select 'intercept', bin, n from {sql_bins('ev', 'intercept', -20, 1, 40, 20)}
      union all select 'chi2_red', bin, n from {sql_bins('(select a_chi2 / a_dof c from ev where a_dof > 0)', 'c', 0, 500, 40, 20000)}""",
)
def track_distributions(spark, d):
    e = checks.with_inverse(plan.build_tracks(hits(spark, d)))
    one = lambda name, col, lo, hi: hist.hist1d(e, col, lo, hi, 40).select(F.lit(name).alias("what"), "bin", "n")
    return one("slope", "slope", -1, 1).unionByName(one("intercept", "intercept", -20, 20)).unionByName(one("chi2_red", "a_chi2_reduced", 0, 20000))


@query(
    "energy_resolution",
    EVENTS + ", sel as (select (E_up1 + E_up3) / 2 - E_up2 qd from ev where abs(slope) < 0.5 and abs(x_ug) < 10), "
    + gauss_sql("sel", "qd", -30, 30, 20, (-20, 20), positive=True) + f"select {FIT_OUT} from gf",
)
def energy_resolution(spark, d):
    return checks.energy_resolution(events(spark, d), bins=20, max_slope=0.5, mode="positive").select(*fit_columns())


@query(
    "position_residual",
    EVENTS + f"""select event_id, {sql_r6('sqrt(pow(slope * (45.0::double - 3.031088913245535::double) + intercept - x_ug, 2) + pow(slope * (136.5::double - 3.031088913245535::double) + intercept - x_dg, 2))', 3)} residual,
      {sql_r6('abs(x_ug - x_dg)', 5)} x_diff from ev where abs(slope) < 0.5 and abs(x_ug) < 10""",
)
def position_residual(spark, d):
    e = checks.position_residuals(events(spark, d), max_slope=0.5)
    return e.select("event_id", r6("residual", 3).alias("residual"), r6("x_diff", 5).alias("x_diff"))


@query(
    "position_residual_fit",
    EVENTS + ", sel as (select abs(x_ug - x_dg) dx from ev where abs(slope) < 0.5 and abs(x_ug) < 10), "
    + gauss_sql("sel", "dx", -50, 50, 50, (-20, 20), positive=True) + f"select {FIT_OUT} from gf",
)
def position_residual_fit(spark, d):
    e = checks.position_residuals(events(spark, d), max_slope=0.5)
    return gauss_fit(hist.hist1d(e, "x_diff", -50, 50, 50), fit_range=(-20, 20), mode="positive").select(*fit_columns())


@query(
    "timing_sum_diff",
    TEVENTS + f"""select event_id, {sql_r6('y_up_ns + y_dn_ns', 0)} y_sum, {sql_r6('y_up_ns - y_dn_ns', 0)} y_dif from ev
      where abs(slope) < 1 and abs(x_ug) < 12 and N_up > 1 and N_dn > 1""",
)
def timing_sum_diff(spark, d):
    t = checks.timing(events(spark, d, times=True), min_hits=1)
    return t.select("event_id", r6("y_sum", 0).alias("y_sum"), r6("y_dif", 0).alias("y_dif"))


TIMING = "select y_up_ns + y_dn_ns y_sum, y_up_ns - y_dn_ns y_dif from ev where abs(slope) < 1 and abs(x_ug) < 12 and N_up > 1 and N_dn > 1"


@query(
    "timing_distributions",
    TEVENTS + f""", sel as ({TIMING}) select 'sum' what, bin, n from {sql_bins('sel', 'y_sum', 0, 1e10, 40, 4e11)}
      union all select 'difference', bin, n from {sql_bins('sel', 'y_dif', -2e11, 1e10, 40, 2e11)}""",
)
def timing_distributions(spark, d):
    t = checks.timing(events(spark, d, times=True), min_hits=1)
    one = lambda name, col, lo, hi: hist.hist1d(t, col, lo, hi, 40).select(F.lit(name).alias("what"), "bin", "n")
    return one("sum", "y_sum", 0, 4e11).unionByName(one("difference", "y_dif", -2e11, 2e11))


@query(
    "residual_distribution",
    EVENTS + """, sel as (select sqrt(pow(slope * (45.0::double - 3.031088913245535::double) + intercept - x_ug, 2)
      + pow(slope * (136.5::double - 3.031088913245535::double) + intercept - x_dg, 2)) res from ev where abs(slope) < 0.5 and abs(x_ug) < 10)
      """ + f"select bin, n from {sql_bins('sel', 'res', -1, 0.5, 50, 24)}",
)
def residual_distribution(spark, d):
    return hist.hist1d(checks.position_residuals(events(spark, d), max_slope=0.5), "residual", -1, 24, 50).select("bin", "n")


@query(
    "multiplicity_energy",
    H + SUMS_SQL + """, u as (select 'up' half, N_up n, E_up e from sums union all select 'down', N_dn, E_dn from sums)
      select half, cast(least(n, 19) as bigint) bx, cast(least(floor(e / 5.0::double), 19) as bigint) "by", count(*) n from u where n <= 20 and e <= 100 group by half, bx, "by" """,
)
def multiplicity_energy(spark, d):
    s = event_summary(hits(spark, d))
    pair = lambda h, z: F.struct(F.lit(h).alias("half"), F.col(f"N_{z}").alias("m"), F.col(f"E_{z}").alias("e"))
    long = s.select(F.inline(F.array(pair("up", "up"), pair("down", "dn"))))
    return hist.hist2d(long, "m", "e", (0, 20), (0, 100), 20, 20, by=["half"])


GAIN_EXPR = "((mu * 0.22372::double + 8.56488::double) * 1.953::double / 4.0::double) / ((1.602e-4::double / 26e-3::double) * {kev}::double)"


def _gain_sql(h: str, kev: str, sub: str) -> str:
    g = GAIN_EXPR.format(kev=kev)
    unit = f"(1.953::double * 26e-3::double / (4.0::double * 1.602e-4::double * ({g})))"
    return (
        f"select '{h}' half, {sql_r6('mu', 3)} mu, {sql_r6('sigma', 3)} sigma, {sql_r6(g, 3)} gain, {sql_r6('0.22372::double * ' + unit, 6)} line_a, "
        f"{sql_r6('8.56488::double * ' + unit, 5)} line_b from {sub}"
    )


@query(
    "gain_calibration",
    EVENTS + ", sel as (select Q_up, Q_dn from ev where abs(slope) < 0.5 and abs(x_ug) < 10 and Q_dn > 500 and Q_dn < 30e3 and Q_up > 500), "
    + "fu as (with " + gauss_sql("sel", "Q_up", 500, 12500, 24, (500, 12500), positive=True).strip() + " select * from gf), "
    + "fd as (with " + gauss_sql("sel", "Q_dn", 500, 12500, 24, (500, 12500), positive=True).strip() + " select * from gf) "
    + _gain_sql("up", "((133.3 + 129.8 + 145.6) / 3.0)", "fu") + " union all " + _gain_sql("down", "((175.7 + 162.9) / 2.0)", "fd"),
)
def gain_calibration(spark, d):
    span = (500, 12500)
    g = checks.gain_calibration(
        events(spark, d), up_range=span, down_range=span, up_fit=span, down_fit=span, bins=24, mode="positive",
        cuts={"q_dn_min": 500, "q_up_min": 500, "max_slope": 0.5},
    )
    digits = {"mu": 3, "sigma": 3, "gain": 3, "line_a": 6, "line_b": 5}
    return g.select("half", *[r6(c, k).alias(c) for c, k in digits.items()])
