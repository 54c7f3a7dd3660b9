"""Ordering, sessions, chains, runs, histograms and fits against plain Python; invariance to partitioning."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import bits
from pulseloom.operators import chain, dims, hist, runs
from pulseloom.operators.fits import gauss_fit, ols, track_fit
from pulseloom.operators.position import carry_last, lag_by_position, mark_segments, nearest_within, with_position
from pulseloom.operators.sessions import anchor_events, gap_events
from pulseloom.operators.stream_order import anchor_events_in_order
from pulseloom.operators.summary import event_summary, event_times, ordered_parts, with_centroids
from pulseloom.plans import checks
from pulseloom.plans.hits import build_events, build_summary_tracks, build_tracks

SHUFFLES = [1, 4, 16]


@pytest.fixture(params=SHUFFLES)
def shuffles(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def times(seed, n, top, null_share=0.05):
    rng = random.Random(seed)
    rows = [(i, None if rng.random() < null_share else rng.randrange(top)) for i in range(n)]
    rng.shuffle(rows)
    return rows


def gap_ids(ts, gap):
    out, event, last = {}, 0, None
    for t in sorted(set(t for t in ts if t is not None)):
        event += last is None or t - last > gap
        out[t], last = event, t
    return out


def anchor_ids(ts, thr):
    out, event, anchor = {}, 0, None
    for t in sorted(set(t for t in ts if t is not None)):
        if anchor is None or t - anchor > thr:
            event, anchor = event + 1, t
        out[t] = (event, anchor)
    return out


@pytest.mark.parametrize("n,top,gap,zone", [(400, 3000, 10, 3), (400, 300, 5, 2), (200, 100000, 50, 1 << 16), (1, 5, 3, 4), (300, 40, 100, 2)])
def test_gap_events(spark, shuffles, n, top, gap, zone):
    rows = times(n + top, n, top)
    df = spark.createDataFrame(rows, "id int, t bigint").repartition(5)
    got = gap_events(df, "t", gap, zone_slots=zone, with_start=True).collect()
    want = gap_ids([t for _, t in rows], gap)
    first = {}
    for t, e in want.items():
        first[e] = min(first.get(e, t), t)
    assert len(got) == len(rows)
    for r in got:
        assert r["event_id"] == (None if r["t"] is None else want[r["t"]])
        assert r["event_start"] == (None if r["t"] is None else first[want[r["t"]]])


def test_gap_of_exactly_the_threshold_stays(spark):
    df = spark.createDataFrame([(0,), (10,), (21,), (31,), (31,)], "t bigint")
    assert sorted(r["event_id"] for r in gap_events(df, "t", 10).collect()) == [1, 1, 2, 2, 2]


def test_gap_events_double_time_and_streams(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), round(rng.uniform(-50, 50), 3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "run string, t double")
    got = gap_events(df, "t", 0.7, stream=["run"], zone_slots=4).collect()
    want = {r: gap_ids([t for q, t in rows if q == r], 0.7) for r in "ab"}
    assert all(x["event_id"] == want[x["run"]][x["t"]] for x in got) and len(got) == 300


@pytest.mark.parametrize("n,top,thr", [(300, 3000, 20), (300, 300, 7), (200, 60, 100), (1, 5, 3)])
def test_anchor_events(spark, n, top, thr):
    rows = times(n * 7 + top, n, top)
    df = spark.createDataFrame(rows, "id int, t bigint").repartition(3)
    want = anchor_ids([t for _, t in rows], thr)
    for zones in (7, 64):
        got = anchor_events(df, "t", thr, zone_times=zones).collect()
        assert len(got) == n
        for r in got:
            assert (r["event_id"], r["event_start"]) == ((None, None) if r["t"] is None else want[r["t"]])


def test_anchor_events_with_streams(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), rng.randrange(500)) for _ in range(300)]
    df = spark.createDataFrame(rows, "run string, t bigint")
    want = {r: anchor_ids([t for q, t in rows if q == r], 9) for r in "abc"}
    got = anchor_events(df, "t", 9, stream=["run"], zone_times=20).collect()
    assert all((x["event_id"], x["event_start"]) == want[x["run"]][x["t"]] for x in got)


def test_anchor_events_dense_and_sparse_doubles(spark):
    """A dense stretch is cut by rows, and a fractional threshold on negative whole times rounds down."""
    rng = random.Random(9)
    dense = [(r, rng.uniform(-1, 1)) for r in ("a", None) for _ in range(400)]
    sparse = [(r, rng.uniform(-1e9, 1e9)) for r in ("a", None) for _ in range(100)]
    rows = dense + sparse + dense[:50] + [("a", None)]
    got = anchor_events(spark.createDataFrame(rows, "run string, t double"), "t", 0.03, stream=["run"], zone_times=16).collect()
    want = {r: anchor_ids([t for q, t in rows if q == r], 0.03) for r in ("a", None)}
    assert len(got) == len(rows)
    assert all((x["event_id"], x["event_start"]) == (want[x["run"]][x["t"]] if x["t"] is not None else (None, None)) for x in got)
    whole = spark.createDataFrame([(t,) for t in (-5, -4, -3, -2, 0, 1)], "t bigint")
    for r in anchor_events(whole, "t", 1.5, zone_times=2).collect():
        assert (r["event_id"], r["event_start"]) == anchor_ids([-5, -4, -3, -2, 0, 1], 1.5)[r["t"]]
    assert anchor_events(whole.limit(0), "t", 2).count() == 0


def walk(c, limit):
    seen, i = [], 0
    while i < len(c):
        seen.append(i)
        i = next((j for j in range(i + 1, len(c)) if c[j] > limit[seen[-1]]), len(c))
    return seen


def test_chain_step_functions():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 50)
        c = np.array(sorted(rng.sample(range(200), n)))
        limit = c + np.array([rng.randint(0, rng.choice([3, 20, 80])) for _ in range(n)])
        width, group = rng.choice([7, 20, 50]), rng.choice([1, 2, 3])
        zones, reach = [], None
        for z in sorted(set(c // width)):
            i = np.flatnonzero(c // width == z)
            a, b = c[i], limit[i]
            zones.append((i, chain.step_function(a, b, a[0] if reach is None else reach)))
            reach = max(b) if reach is None else max(reach, max(b))
        packs = [zones[k : k + group] for k in range(0, len(zones), group)]
        leads, _ = chain.run_through([chain.compose([m for _, m in p]) for p in packs], None)
        got = []
        for pack, lead in zip(packs, leads):
            at, _ = chain.run_through([m for _, m in pack], lead)
            for (i, _), x in zip(pack, at):
                got += i[chain.visited(c[i], limit[i], x)].tolist()
        assert got == walk(c, limit)


def test_with_position_and_hot_key(spark, shuffles):
    # one leading key holds most rows
    rows = [(0 if i % 3 else i, i) for i in range(500)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int")
    got = {(r["k"], r["i"]): r["pos"] for r in with_position(df, ["k", "i"]).collect()}
    assert got == {row: n for n, row in enumerate(sorted(rows))}


def test_segments_lag_and_fill(spark, shuffles):
    rng = random.Random(9)
    rows = [(i, rng.randrange(3), rng.choice([None, None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "pos bigint, v int, s int").repartition(7)
    for width in (1, 3, 1000):
        m = mark_segments(df, "pos", lambda p, c: p["v"] != c["v"], ["v"], width=width, number_name="n", lag_name="prev").orderBy("pos").collect()
        start, number = 0, 0
        for i, r in enumerate(m):
            if i == 0 or rows[i][1] != rows[i - 1][1]:
                start, number = i, number + 1
            assert (r["segment"], r["n"]) == (start, number)
            assert (r["prev"]["v"] if r["prev"] else None) == (rows[i - 1][1] if i else None)
        lag = lag_by_position(df, "pos", ["v"], "p", width=width).count()
        assert lag == 200
        filled = carry_last(df, "pos", "s", "last", width=width).orderBy("pos").collect()
        last = None
        for r, (_, _, s) in zip(filled, rows):
            last = s if s is not None else last
            assert r["last"] == last


def test_nearest(spark):
    rng = random.Random(3)
    left = [(i, rng.randrange(1000)) for i in range(80)]
    right = [(i, rng.randrange(1000)) for i in range(60)]
    l, r = (spark.createDataFrame(x, "id bigint, t bigint") for x in (left, right))
    for row in nearest_within(l, r, "t", "id", 6).collect():
        best = min(abs(t - row["t"]) for _, t in right)
        assert (row["match"] is None) == (best > 6)
        if row["match"] is not None:
            assert abs(row["match_key"] - row["t"]) == best and (row["match"], row["match_key"]) in right


def test_ordered_parts_cut_a_hot_key(spark):
    rows = [("hot", i) for i in range(95)] + [("b", 1)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(4)
    got = sorted((r["k"], r["part"], r["i"]) for r in ordered_parts(df, ["k"], ["i"], ["i"], part_rows=20).collect())
    assert got == [("b", 0, [1])] + [("hot", p, list(range(20 * p, min(95, 20 * p + 20)))) for p in range(5)]


def blocks(seed, n):
    rng = random.Random(seed)
    return [(p, rng.randrange(2), rng.randrange(6), [rng.randrange(9) for _ in range(3)], p * 10) for p in range(n)]


BLOCK = "pos bigint, chip bigint, sample_index bigint, samples_value array<bigint>, timestamp bigint"


@pytest.mark.parametrize("width", [2, 5, 1000])
def test_contiguous_runs(spark, width):
    rows = blocks(5, 120)
    want, cur = [], []
    for b in rows:
        if cur and not (cur[-1][1] == b[1] and cur[-1][2] < b[2]):
            want.append(cur)
            cur = []
        cur.append(b)
    want.append(cur)
    df = spark.createDataFrame(rows, BLOCK).repartition(6)
    got = runs.contiguous_runs(df, width=width).orderBy("run_start").collect()
    assert [r["sample_index"] for r in got] == [[b[2] for b in w] for w in want]
    assert [r["samples_value"] for r in got] == [[list(c) for c in zip(*[b[3] for b in w])] for w in want]
    closed = runs.contiguous_runs(df.withColumn("f", F.lit(1)), stream=["f"], width=width, drop_open_run=True).count()
    assert closed == len(want) - 1


def test_covering_ends():
    rng = random.Random(12)
    for _ in range(300):
        n, k = rng.randint(1, 40), rng.randint(1, 7)
        at = np.array(sorted(rng.sample(range(100), n)))
        index = np.array([rng.randrange(k) for _ in range(n)])
        behind = np.array([rng.choice([rng.randint(100, 150), runs.NEVER]) for _ in range(k)])
        want = [max(next((at[j] for j in range(r, n) if index[j] == i), behind[i]) for i in range(k)) for r in range(n)]
        assert runs.covering_ends(at, index, behind).tolist() == want


@pytest.mark.parametrize("zone", [3, 10, 1000])
def test_complete_frames(spark, zone):
    rows = blocks(6, 150)
    want = []
    for chip in (0, 1):
        held = {}
        start = None
        for p, c, i, v, _ in rows:
            if c != chip or i >= 4:
                continue
            start = p if not held else start
            held[i] = v
            if len(held) == 4:
                want.append((chip, start, p, [list(x) for x in zip(*[held[k] for k in range(4)])]))
                held = {}
    df = spark.createDataFrame(rows, BLOCK).repartition(5)
    got = runs.complete_frames(df, n_samples=4, zone=zone).collect()
    assert sorted((r["chip"], r["frame_start"], r["frame_end"], r["samples_value"]) for r in got) == sorted(want)


@pytest.mark.parametrize("lo,hi,n", [(0, 1, 10), (-1, 4, 200), (0.1, 0.7, 6), (-30, 30, 100)])
def test_hist1d_edges(spark, lo, hi, n):
    rng = random.Random(n)
    edges = np.linspace(lo, hi, n + 1)
    values = [float(e) for e in edges] + [rng.uniform(lo - 1, hi + 1) for _ in range(500)] + [float("inf"), float("-inf"), float("nan"), None]
    values += [float(np.nextafter(e, -1e9)) for e in edges] + [float(np.nextafter(e, 1e9)) for e in edges]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["n"] for r in hist.hist1d(df, "x", lo, hi, n).orderBy("bin").collect()]
    finite = np.array([v for v in values if v is not None and math.isfinite(v)])
    want, _ = np.histogram(finite, bins=lo + np.arange(n + 1) * ((hi - lo) / n))
    assert sum(got) == ((finite >= lo) & (finite <= hi)).sum()
    assert abs(np.array(got) - np.histogram(finite, bins=n, range=(lo, hi))[0]).sum() <= 2
    assert abs(np.array(got) - want).sum() <= 2


def test_hist1d_groups_weights_and_fixed_width(spark):
    df = spark.createDataFrame([("a", 0.5, 2.0), ("a", 1.5, 3.0), ("b", 9.0, 1.0)], "g string, x double, w double")
    got = {(r["g"], r["bin"]): r["n"] for r in hist.hist1d(df, "x", 0, 2, 2, by=["g"], weight="w").collect()}
    assert got == {("a", 0): 2.0, ("a", 1): 3.0, ("b", 0): 0.0, ("b", 1): 0.0}
    assert hist.fixed_width(0, 10, 3) == (0, 12, 4) and hist.fixed_width(0, 9, 3) == (0, 9, 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_auto_bins_and_quantiles(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=700)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    got = hist.exact_quantiles(df, "x", [0, 0.25, 0.5, 0.77, 1])
    assert np.allclose(got, np.quantile(x, [0, 0.25, 0.5, 0.77, 1]))
    lo, hi, n = hist.auto_bins(df, "x")
    assert n == len(np.histogram_bin_edges(x, bins="auto")) - 1 and (lo, hi) == (x.min(), x.max())


def test_overflow_bins(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 1.99, 2.0, 7.0, None)], "x double")
    got = {(r["bin"], r["place"]): r["n"] for r in hist.hist1d_overflow(df, "x", 0, 2, 3).collect()}
    assert got == {(0, "under"): 1, (1, "in"): 2, (2, "in"): 2, (3, "over"): 2}


def line_by_eigenvector(x, y, w):
    c = np.average([x, y], axis=1, weights=w)
    d = np.array([x, y]) - c[:, None]
    vals, vecs = np.linalg.eigh((w * d) @ d.T / w.sum())
    ux, uy = vecs[:, 1]
    return w.sum() * max(vals[0], 0), (uy / ux if abs(ux) > 1e-9 else None)


def test_track_fit(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for e in range(40):
        n = int(rng.integers(2, 15))
        z, w = rng.uniform(40, 150, n), rng.uniform(1, 50, n)
        x = rng.normal(0, 1) * z / 50 + rng.normal(0, 1, n)
        rows += [(e, float(a), float(b), float(c)) for a, b, c in zip(z, x, w)] + [(e, 50.0, 0.0, 0.0)]
        want[e] = (line_by_eigenvector(z, x, w), n)
    rows += [(100, 60.0, float(i), 1.0) for i in range(3)]  # vertical
    rows += [(101, 60.0, 1.0, 1.0)]  # one point
    rows += [(102, float("nan"), 1.0, 1.0), (102, 3.0, 1.0, 1.0), (102, 4.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "event_id int, z double, x double, w double")
    got = {r["event_id"]: r for r in track_fit(df, "z", "x", origin=(90.0, 0.0)).collect()}
    for e, ((chi2, slope), n) in want.items():
        r = got[e]
        assert math.isclose(r["a_slope"], slope, rel_tol=1e-7) and r["a_n_points"] == n and r["a_dof"] == n - 2
        assert math.isclose(r["a_chi2"], chi2, rel_tol=1e-6, abs_tol=1e-6)
        assert r["a_chi2_reduced"] is None if n == 2 else math.isclose(r["a_chi2_reduced"], r["a_chi2"] / (n - 2))
    assert got[100]["a_slope"] is None and abs(got[100]["a_angle_deg"]) == 90 and got[100]["a_chi2"] < 1e-20
    assert got[101]["a_slope"] is None and got[101]["a_n_points"] == 1 and got[101]["a_dof"] == 0
    assert got[102]["a_slope"] is None and got[102]["a_n_points"] == 3 and got[102]["a_dof"] == 1


def test_known_line_passes_the_cut_and_has_no_residual(spark):
    """x = 0.02 z + 1 runs down the detector, x = 60 z - 5000 across it; numbers by hand."""
    down = [(1, 0.02 * z + 1.0, z, 1.0 + i) for i, z in enumerate((42.0, 43.5, 45.0, 134.0, 135.0, 136.0))]
    across = [(2, 60.0 * z - 5000.0, z, 1.0) for z in (83.2, 83.3, 83.4, 83.5)]
    hits = spark.createDataFrame(down + across, "event_id int, x double, z double, w double")
    e = checks.with_inverse(build_tracks(hits))
    r = {x["event_id"]: x for x in e.collect()}
    assert math.isclose(r[1]["a_slope"], 50.0, rel_tol=1e-9) and math.isclose(r[1]["a_intercept"], -50.0, rel_tol=1e-8)
    assert math.isclose(r[1]["slope"], 0.02, rel_tol=1e-9) and math.isclose(r[1]["intercept"], 1.0, rel_tol=1e-8)
    assert math.isclose(r[2]["slope"], 60.0, rel_tol=1e-6)
    z_up, z_dn = 45.0 - 3.031088913245535, 136.5 - 3.031088913245535
    e = e.withColumns({"x_ug": F.lit(0.02 * z_up + 1.0), "x_dg": F.lit(0.02 * z_dn + 1.5)})
    kept = checks.position_residuals(e).collect()
    assert [x["event_id"] for x in kept] == [1]
    assert math.isclose(kept[0]["residual"], 0.5, rel_tol=1e-6)


def test_array_parts_do_not_change_totals(spark):
    df = spark.createDataFrame([(1, i, i * 2) for i in range(10)] + [(2, 5, 7)], "k int, t int, v int")
    rows = ordered_parts(df, ["k"], ["t"], ["v"], part_rows=3).orderBy("k", "part").collect()
    assert [(r["k"], r["part"], r["v"]) for r in rows] == [
        (1, 0, [0, 2, 4]), (1, 1, [6, 8, 10]), (1, 2, [12, 14, 16]), (1, 3, [18]), (2, 0, [7]),
    ]


def test_ols(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 100, 50)
    y = 3 * x - 5 + rng.normal(size=50)
    rows = [("a", float(p), float(q)) for p, q in zip(x, y)] + [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("one", 1.0, 1.0), ("a", float("nan"), 1.0)]
    got = {r["g"]: r for r in ols(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", by=["g"]).collect()}
    assert set(got) == {"a"}
    (a, b), cov = np.polyfit(x, y, 1, cov="unscaled")
    r = got["a"]
    rss = ((y - a * x - b) ** 2).sum()
    assert np.allclose([r["slope"], r["intercept"], r["rss"], r["r2"]], [a, b, rss, 1 - rss / ((y - y.mean()) ** 2).sum()])
    s2 = rss / 48
    assert np.allclose([r["stderr_slope"] ** 2, r["stderr_intercept"] ** 2, r["cov_ab"]], [cov[0, 0] * s2, cov[1, 1] * s2, cov[0, 1] * s2])


@pytest.mark.parametrize("mode", ["compat", "positive"])
def test_gauss_fit(spark, mode):
    x = np.linspace(-4, 6, 41)
    y = np.rint(500 * np.exp(-((x - 1.2) ** 2) / (2 * 0.8**2)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "center double, n double")
    r = gauss_fit(df, mode=mode).first()
    keep = y > 0 if mode == "positive" else np.full(len(y), True)
    X, Y = x[keep], y[keep]
    w = np.sqrt(np.clip(Y, 1, None))
    c2, c1, c0 = np.polyfit(X, np.log(np.clip(Y, 1e-12, None)), 2, w=w)
    sigma = math.sqrt(-1 / (2 * c2))
    mu = c1 * sigma**2
    assert np.allclose([r["sigma"], r["mu"], r["amplitude"]], [sigma, mu, math.exp(c0 + mu**2 / (2 * sigma**2))], rtol=1e-6)
    if mode == "positive":
        assert abs(r["mu"] - 1.2) < 0.05 and abs(r["sigma"] - 0.8) < 0.05


def test_gauss_fit_least_squares(spark):
    rng = np.random.default_rng(11)
    x = np.linspace(0, 100, 51)
    rows, truth = [], {"a": (400, 47.0, 9.0), "b": (60, 70.0, 5.0)}
    for g, (amp, mu, sigma) in truth.items():
        rows += [(g, float(p), float(rng.poisson(amp * math.exp(-((p - mu) ** 2) / (2 * sigma**2))))) for p in x]
    df = spark.createDataFrame(rows, "g string, center double, n double")
    fits = {r["g"]: r for r in gauss_fit(df, by=["g"], method="least_squares").collect()}
    rough = {r["g"]: r for r in gauss_fit(df, by=["g"]).collect()}
    for g, (amp, mu, sigma) in truth.items():
        r = fits[g]
        assert abs(r["mu"] - mu) < 1 and abs(r["sigma"] - sigma) < 1 and abs(r["amplitude"] - amp) < 0.1 * amp
        assert r["chi2"] <= rough[g]["chi2"] and r["n_bins"] == 51
        # no small step in any direction lowers chi2
        y = np.array([n for k, _, n in rows if k == g])
        best = np.array([r["amplitude"], r["mu"], r["sigma"]])
        chi2 = lambda q: (((y - q[0] * np.exp(-((x - q[1]) ** 2) / (2 * q[2] ** 2))) ** 2) / np.maximum(y, 1)).sum()
        assert math.isclose(chi2(best), r["chi2"])
        for k in range(3):
            for step in (-1e-3, 1e-3):
                q = best.copy()
                q[k] *= 1 + step
                assert chi2(q) >= r["chi2"]


def test_gauss_fit_without_peak_gives_moments(spark):
    df = spark.createDataFrame([(0.0, 9.0), (1.0, 1.0), (2.0, 9.0)], "center double, n double")
    r = gauss_fit(df).first()
    assert not r["converged"] and r["mu"] == 1.0 and r["amplitude"] == 9.0
    assert gauss_fit(df.filter("center < 2")).count() == 0


def test_pads(spark):
    pads = {r["tpc_id"]: (r["x"], r["z"]) for r in dims.pad_geometry(spark).collect()}
    assert sorted(pads) == list(range(120))
    z0 = 45 - 3.031088913245535
    assert np.allclose(pads[0], (0.75 - 15.75, z0)) and np.allclose(pads[1], (2.25 - 15.75, z0 + math.sqrt(3) / 2))
    assert np.allclose(pads[20], (1.5 - 15.75, z0 + 1.5 * math.sqrt(3)))
    # the second half counts each row from the other side
    assert np.allclose(pads[79], (2.25 - 15.75, 136.5 - 3.031088913245535 + math.sqrt(3) / 2))


def test_one_aggregate_equals_its_parts(spark):
    """Also for events without a weight, with a null weight, with a value that is not a number, and for the null event."""
    rng = random.Random(21)
    zones = ["al", "up", "dn", "up1", "up2", "up3", "dn1", "dn2", "dn3"]
    rows = []
    for e in [None, 1, 2, 3, 4, 5]:
        for i in range(1 if e == 5 else 8):
            w = {2: 0.0, 3: None}.get(e, rng.uniform(1, 9))
            z = float("nan") if e == 4 and i == 3 else rng.uniform(80, 100)
            rows.append((e, 1000 * (e or 0) + i, 1000 * (e or 0), rng.uniform(1, 9), rng.uniform(-5, 5), z, w, rng.uniform(1, 5), *[i % 2 == k % 2 for k in range(9)]))
    names = "event_id int, t bigint, event_start bigint, charge double, x double, z double, w double, energy double, " + ", ".join(f"is_{z} boolean" for z in zones)
    hits = spark.createDataFrame(rows, names).repartition(3)
    key = lambda r: -1 if r["event_id"] is None else r["event_id"]
    parts = [with_centroids(event_summary(hits)), event_times(hits, "t", 10.0), build_tracks(hits)]
    want = {}
    for part in parts:
        for r in part.collect():
            want.setdefault(key(r), {}).update(r.asDict())
    got = {key(r): r.asDict() for r in build_events(hits, "t", 10.0).collect()}
    assert got.keys() == want.keys()
    columns = {c for part in parts for c in part.columns}
    for e, row in got.items():
        assert row.keys() == columns
        for c, v in row.items():
            assert v == pytest.approx(want[e].get(c), rel=1e-9, abs=1e-9, nan_ok=True) if isinstance(v, float) else v == want[e].get(c), (e, c)
    assert set(build_summary_tracks(hits).columns) == columns - {"y_offset", "y_up_ns", "y_dn_ns"}
    assert "Join" not in build_events(hits, "t", 10.0)._jdf.queryExecution().optimizedPlan().toString()


def test_event_times_with_null_time(spark):
    df = spark.createDataFrame([(1, 5, True, False), (1, None, True, False), (1, 9, False, True), (2, None, True, False)], "event_id int, t bigint, is_up boolean, is_dn boolean")
    got = {r["event_id"]: (r["y_offset"], r["y_up_ns"], r["y_dn_ns"]) for r in event_times(df, "t", 10.0, near=None).collect()}
    assert got == {1: (5, 0.0, 40.0), 2: (0, None, None)}


@pytest.mark.parametrize("width", [3, 16, 1000])
def test_anchors_in_file_order(spark, width):
    rng = random.Random(width)
    t, rows, want, ref, event = 0, [], [], None, 0
    for i in range(120):
        t += rng.choice([0, 1, 2, 5, 9, -3, -12]) if i % 40 < 30 else 0
        rows.append((i, t))
        if ref is None or abs(t - ref) > 10:
            event, ref = event + 1, t
        want.append(event)
    df = spark.createDataFrame(rows, "pos long, t long").repartition(4)
    got = anchor_events_in_order(df, "pos", "t", 10, width=width).orderBy("pos").collect()
    assert [r["event_id"] for r in got] == want


def test_a_quiet_stretch_takes_few_rounds(spark, monkeypatch):
    """1,000 buckets without a far time: the search goes up and down a tree, not from bucket to bucket."""
    from pulseloom.operators import stream_order

    rows = [(i, 5 if i < 3000 else 100) for i in range(3010)] + [(i, 100 + (i % 7) * (i >= 3990) * 3) for i in range(3010, 4000)]
    df = spark.createDataFrame(rows, "pos long, t long")
    written = []
    real = stream_order.materialize
    monkeypatch.setattr(stream_order, "materialize", lambda x: written.append(1) or real(x))
    far = {r["pos"]: r["far"] for r in stream_order.next_far(df, "pos", "t", 10, width=3).collect()}
    want, after = {}, {}
    for i, t in reversed(rows):
        want[i] = min((p for v, p in after.items() if abs(v - t) > 10), default=stream_order.NEVER)
        after[t] = i
    assert far == want
    assert len(written) <= 10 + 3


def test_pulses_of_events(spark):
    from pulseloom.plans.event_pulses import event_pulses, event_totals

    def wave(at, height, n=40):
        return [height if at <= i < at + 4 else 0 for i in range(n)]

    rows = [
        (7, 1, wave(15, 300)), (7, 2, wave(20, 10)), (7, 2, wave(15, 300)), (9, 1, wave(5, 12)), (12, 3, wave(0, 90)), (12, 3, [1] * 10), (12, 4, None), (None, 5, wave(15, 300)),
    ]
    found = event_pulses(spark.createDataFrame(rows, "event_id long, channel long, w array<long>"), "event_id", "w")
    got = sorted(((r["pulse_event"], r["channel"], r["peak_at"], r["n_samples"]) for r in found.collect()), key=str)
    # the cut runs from 12 before the rise to 12 behind the first sample below, both inside the wave; event 9 has no pulse
    assert got == sorted([(0, 1, 15, 28), (0, 2, 15, 28), (1, 3, 0, 16), (None, 5, 15, 28)], key=str)
    totals = {r["pulse_event"]: (r["n_pulses"], r["n_samples"]) for r in event_totals(found).collect()}
    assert totals == {0: (2, 56), 1: (1, 16), None: (1, 28)}
    assert event_pulses(spark.createDataFrame([], "event_id long, channel long, w array<long>"), "event_id", "w").count() == 0


def test_line_of_groups_without_one(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 5.0), ("b", 1.0, 2.0), ("c", 0.0, 1.0), ("c", 2.0, 5.0), ("d", None, 1.0)], "g string, x double, y double")
    assert [r["g"] for r in ols(df, "x", "y", ["g"]).collect()] == ["c"]
    got = {r["g"]: (r["reason"], r["n"], r["slope"], r["intercept"], r["r2"], r["rss"]) for r in ols(df, "x", "y", ["g"], degenerate=True).collect()}
    assert got == {"a": ("constant", 2, None, None, None, None), "b": ("points", 1, None, None, None, None), "c": (None, 2, 2.0, 1.0, 1.0, 0.0)}


def test_errors_and_method_of_least_squares(spark):
    x = np.arange(-10, 11) * 0.5
    bins = [("good", float(v), float(round(1000 * math.exp(-((v - 1) ** 2) / 2 / 1.5**2)))) for v in x]
    bins += [("none", float(v), 0.0) for v in x]
    f = {r["g"]: r for r in gauss_fit(spark.createDataFrame(bins, "g string, center double, n double"), by=["g"], method="least_squares").collect()}
    r = f["good"]
    t = (x - r["mu"]) / r["sigma"]
    e = np.exp(-t * t / 2)
    j = np.stack([e, r["amplitude"] * e * t / r["sigma"], r["amplitude"] * e * t * t / r["sigma"]], axis=1)
    y = np.array([b[2] for b in bins[: len(x)]])
    want = np.sqrt(np.diag(np.linalg.inv((j.T / np.maximum(y, 1)) @ j)))
    assert r["method"] == "least_squares" and np.allclose([r["amplitude_error"], r["mu_error"], r["sigma_error"]], want, rtol=1e-9)
    assert f["none"]["method"] != "least_squares" and f["none"]["mu_error"] is None or math.isnan(f["none"]["mu_error"])


def test_bytes_by_position(spark):
    def run(pairs, start, end, fill=None):
        df = spark.createDataFrame([(pairs,)], "p array<struct<pos:int,byte:int>>")
        got = df.select(bits.interval_bytes(F.col("p"), start, end, fill_missing=fill).alias("b")).first()["b"]
        return None if got is None else list(got)

    pairs = [(3, 30), (1, 10), (2, 511), (1, 11), (9, 90)]
    assert run(pairs, 1, 4) == [11, 255, 30]
    assert run(pairs, 0, 4) is None and run(pairs, 0, 4, 300) == [44, 11, 255, 30]
    assert run(pairs, -1, 4) == [] and run(pairs, 4, 3) == [] and run(pairs, 4, 4) == []
    assert run([], 0, 2, 7) == [7, 7] and run([], 0, 2) is None


def test_events_of_run_starts(spark):
    rng = np.random.default_rng(5)
    rows, t = [], 1000
    for pos in range(400):
        t += int(rng.integers(-60, 90))
        rows.append((pos, int(rng.integers(0, 2)), int(rng.integers(0, 5)), t))
    want, event, before, last = [], 0, None, None
    for pos, chip, index, time in rows:
        if before is None or before[0] != chip or index <= before[1]:
            event += last is None or abs(time - last) >= 50
            last = time
            want.append((pos, chip, time, event))
        before = (chip, index)
    df = spark.createDataFrame(rows, "pos long, chip long, sample_index long, timestamp long").repartition(3)
    for width in (1 << 20, 7):
        got = runs.run_events(df, 50, width=width).orderBy("run_start").select("run_start", "chip", "t_first", "event_id").collect()
        assert [tuple(r) for r in got] == want


def test_automatic_histogram_without_values(spark):
    none = hist.hist1d_auto(spark.createDataFrame([], "x double"), "x").collect()
    assert [(r["left"], r["right"], r["n"]) for r in none] == [(0.0, 1.0, 0)]
    one = hist.hist1d_auto(spark.createDataFrame([(2.0,), (2.0,), (None,), (float("nan"),)], "x double"), "x").collect()
    assert [(r["left"], r["right"], r["n"]) for r in one] == [(1.5, 2.5, 2)]
