"""Block-level queries: bit fields, runs, frames, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom import fixtures as fx
from pulseloom.catalog.common import FX_BLOCK, FX_BYTES, csv, r6, sql_r6, with_views
from pulseloom.functions import bits
from pulseloom.functions.calib import tick_to_ns
from pulseloom.operators import runs
from pulseloom.operators.position import with_position

QUERIES = {}
ORACLE = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn

    return add


B = with_views(FX_BLOCK)
Y = with_views(FX_BYTES)


def placed(spark, d):
    """Blocks with a dense position in stream order; every run (file) is one stretch of positions."""
    needed = ["run", "l_orderkey", "l_linenumber", "l_partkey", "chip", "sample_index", "error_level"]
    b = with_position(fx.blocks(spark, d).drop("samples_value"), fx.BLOCK_ORDER, keep=needed)
    return b.select(
        "run", "pos", "chip", "sample_index", "error_level",
        # samples are derived after the ordering shuffle, which then carries only the order columns
        F.expr(fx.SAMPLES).alias("samples_value"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 32).alias("timestamp"),
    )


def raw(spark, d):
    """The parts of the block view that need no order."""
    return fx.blocks(spark, d).withColumn("data_block", F.when(F.col("l_quantity") < 45, F.lit(60)).otherwise(F.lit(58)).cast("bigint"))


def payload(spark, d):
    return fx.payloads(spark, d).select("p_partkey", F.unhex("hex").alias("b"))


def spread_payload(spark, d):
    """Payloads in an explicit number of tasks: rows are few bytes and much work, and a small file is one split."""
    return payload(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


@query(
    "run_start_events",
    B + """, f as (select *, l_orderkey * 1000 + l_linenumber * 32 ts,
        case when lag(chip) over o = chip and sample_index > lag(sample_index) over o then 0 else 1 end f from fx_pos window o as (partition by run order by pos)),
      r as (select run, chip, pos run_start, ts t_first from f where f = 1),
      g as (select *, case when abs(t_first - lag(t_first) over (partition by run order by run_start)) < 20000 then 0 else 1 end g from r)
      select run, chip, run_start, t_first, cast(sum(g) over (partition by run order by run_start rows unbounded preceding) as bigint) event_id from g""",
)
def run_start_events(spark, d):
    return runs.run_events(placed(spark, d), 20_000, stream=["run"]).select("run", "chip", "run_start", "t_first", "event_id")


# ---------------------------------------------------------------- bit fields

WORD = "cast(('0x' || substring(hex, {at}, 4)) as bigint)"


@query(
    "unpack10",
    Y + """, v as (select p_partkey, list_transform(range(40), lambda k: cast(('0x' || substring(hex, 2 * k + 1, 2)) as bigint)) b from fx_bytes)
      select p_partkey,
       array_to_string(list_transform(range(32), lambda i: ((b[(i * 10) // 8 + 1] * 256 + coalesce(b[(i * 10) // 8 + 2], 0)) >> (6 - (i * 10) % 8)) & 1023), ',') msb,
       array_to_string(list_transform(range(32), lambda i: ((b[(i * 10) // 8 + 1] + coalesce(b[(i * 10) // 8 + 2], 0) * 256) >> ((i * 10) % 8)) & 1023), ',') lsb,
       ((b[1] * 256 + b[2]) >> 6) & 1023 first_value from v""",
)
def unpack10(spark, d):
    return spread_payload(spark, d).select(
        "p_partkey",
        csv(bits.unpack10(F.col("b"))).alias("msb"),
        csv(bits.unpack10(F.col("b"), msb_first=False)).alias("lsb"),
        F.get(bits.unpack10(F.substring("b", 1, 2)), F.lit(0)).alias("first_value"),
    )


@query(
    "unpack10_filled",
    Y + """, v as (select p_partkey, list_transform(range(4, 35), lambda k: case when k % 7 = 3 then 165 else
        cast(('0x' || substring(hex, 2 * k + 1, 2)) as bigint) end) b from fx_bytes)
      select p_partkey,
       array_to_string(list_transform(range(25), lambda i: ((b[(i * 10) // 8 + 1] * 256 + coalesce(b[(i * 10) // 8 + 2], 0)) >> (6 - (i * 10) % 8)) & 1023), ',') msb,
       array_to_string(list_transform(range(24), lambda i: ((b[(i * 10) // 8 + 1] + coalesce(b[(i * 10) // 8 + 2], 0) * 256) >> ((i * 10) % 8)) & 1023), ',') lsb
      from v""",
)
def unpack10_filled(spark, d):
    """Bytes 4 to 34 of the payloads, of which every seventh is lost and filled."""
    numbered = F.transform(bits.byte_values(F.col("b")), lambda v, i: F.struct(i.alias("pos"), v.alias("byte")))
    left = F.filter(numbered, lambda e: e["pos"] % 7 != 3)
    return spread_payload(spark, d).select("p_partkey", left.alias("pairs")).select(
        "p_partkey",
        csv(bits.unpack10_pairs(F.col("pairs"), 4, 35, fill_missing=165, pad_last=True)).alias("msb"),
        csv(bits.unpack10_pairs(F.col("pairs"), 4, 35, fill_missing=165, msb_first=False)).alias("lsb"),
    )


@query(
    "timestamp48",
    Y + f"""select p_partkey, {WORD.format(at=5)} * 4294967296 + {WORD.format(at=9)} * 65536 + {WORD.format(at=13)} ticks,
      cast(('0x' || substring(hex, 7, 2) || substring(hex, 5, 2)) as bigint) le_word from fx_bytes""",
)
def timestamp48(spark, d):
    b = F.col("b")
    return payload(spark, d).select(
        "p_partkey",
        bits.timestamp48(bits.word_be(b, 6), bits.word_be(b, 4), bits.word_be(b, 2)).alias("ticks"),
        bits.word_le(b, 2).alias("le_word"),
    )


@query(
    "marker_positions",
    Y + """, m as (select p_partkey, hex, list_filter(range(40), lambda i: substring(hex, 2 * i + 1, 2) = 'af') one,
        list_filter(range(39), lambda i: substring(hex, 2 * i + 1, 4) = 'fafa') two from fx_bytes)
      select p_partkey, array_to_string(one, ',') one_byte, array_to_string(two, ',') footers, len(one) n_hits,
       case when one[1] is not null and one[1] + 4 <= 40 then cast(('0x' || substring(hex, 2 * (one[1] + 2) + 1, 4)) as bigint) end value_after from m""",
)
def marker_positions(spark, d):
    b = F.col("b")
    hits = payload(spark, d).withColumn("one", bits.marker_positions(b, "AF"))
    return hits.select(
        "p_partkey",
        csv("one").alias("one_byte"),
        csv(bits.marker_positions(b, bits.FOOTER)).alias("footers"),
        F.size("one").cast("bigint").alias("n_hits"),
        bits.word_after(b, "AF").alias("value_after"),
    )


@query("block_hex", Y + "select p_partkey, trim(regexp_replace(lower(hex), '(.{4})', '\\1 ', 'g')) words from fx_bytes")
def block_hex(spark, d):
    return payload(spark, d).select("p_partkey", bits.hex_words(F.col("b")).alias("words"))


FLAG_SQL = ", ".join(f"cast((error_level >> {i}) & 1 = 0 as boolean) {n}" for i, n in enumerate(["size_ok", "t3_ok", "t2_ok", "t1_ok", "footer_ok"]))


@query(
    "error_flags",
    B + f"select error_level, {FLAG_SQL}, count(*) n, error_level packed from fx_block group by error_level",
)
def error_flags(spark, d):
    flags = raw(spark, d).groupBy("error_level").agg(F.count(F.lit(1)).alias("n")).withColumn("f", bits.unpack_flags(F.col("error_level")))
    names = ["size_ok", "t3_ok", "t2_ok", "t1_ok", "footer_ok"]
    back = bits.pack_flags(*[F.get("f", F.lit(i)) for i in range(5)])
    return flags.select("error_level", *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)], "n", back.alias("packed"))


@query(
    "good_blocks",
    B + "select run, l_orderkey, l_linenumber, l_partkey, l_suppkey, chip from fx_block where error_level = 0 and l_quantity < 45",
)
def good_blocks(spark, d):
    return runs.good_blocks(raw(spark, d)).select("run", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "chip")


@query(
    "block_quality",
    B + f"""select error_level, count(*) n, {sql_r6('100.0 * count(*) / sum(count(*)) over ()')} rate,
      {sql_r6('100.0 * sum(count(*) filter (l_quantity < 45)) over () / sum(count(*)) over ()')} good_rate,
      concat(error_level & 1, (error_level >> 1) & 1, (error_level >> 2) & 1, (error_level >> 3) & 1, (error_level >> 4) & 1) failed
      from fx_block group by error_level""",
)
def block_quality(spark, d):
    q = runs.block_quality(raw(spark, d))
    failed = F.array_join(F.transform("flags", lambda f: F.when(f, "0").otherwise("1")), "")
    return q.select("error_level", "n", r6("rate").alias("rate"), r6("good_rate").alias("good_rate"), failed.alias("failed"))


@query(
    "block_marker_errors",
    B + """select run, bit_count(error_level & 30)::bigint missing, count(*) n from fx_block where (error_level & 30) <> 0 group by run, missing""",
)
def block_marker_errors(spark, d):
    b = raw(spark, d).withColumn("missing", bits.missing_markers(F.col("error_level"))).filter("missing > 0")
    return b.groupBy("run", "missing").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tick_time",
    B + f"""select run, min(l_orderkey * 1000 + l_linenumber * 32) first_tick, {sql_r6('min(l_orderkey * 1000 + l_linenumber * 32) * 3.125::double', 3)} first_ns,
      {sql_r6('max(l_orderkey * 1000 + l_linenumber * 32) / 320000.0::double')} last_ms, {sql_r6('max(l_orderkey * 1000 + l_linenumber * 32) / 32.0::double * 3.125::double', 3)} last_other_ns
      from fx_block group by run""",
)
def tick_time(spark, d):
    t = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 32
    e = fx.blocks(spark, d).groupBy("run").agg(F.min(t).alias("a"), F.max(t).alias("b"))
    return e.select(
        "run",
        F.col("a").alias("first_tick"),
        r6(tick_to_ns(F.col("a")), 3).alias("first_ns"),
        r6(F.col("b").cast("double") / 320000.0).alias("last_ms"),
        r6(tick_to_ns(F.col("b"), 3.125 / 32), 3).alias("last_other_ns"),
    )


# ---------------------------------------------------------------- runs and frames

RUNS = B + """, p as (select run, pos, chip, sample_index, samples_value, l_orderkey * 1000 + l_linenumber * 32 ts from fx_pos),
  f as (select *, case when lag(chip) over (partition by run order by pos) = chip and lag(sample_index) over (partition by run order by pos) < sample_index
    then 0 else 1 end brk from p),
  r as (select *, max(case when brk = 1 then pos end) over (partition by run order by pos rows unbounded preceding) run_start from f)
"""
RUN_COLS = """array_to_string(list(ts order by pos), ',') times, array_to_string(list(sample_index order by pos), ',') indices,
   count(*) n_samples, cast(len(first(samples_value)) as bigint) n_channels"""
CH = "array_to_string(list(samples_value[{i}] order by pos), ',')"


def run_table(spark, d):
    return runs.contiguous_runs(placed(spark, d), stream=["run"])


@query("contiguous_runs", RUNS + f"select run, run_start, min(chip) chip, {RUN_COLS} from r group by run, run_start")
def contiguous_runs(spark, d):
    t = run_table(spark, d)
    return t.select(
        "run", "run_start", "chip", csv("timestamp").alias("times"), csv("sample_index").alias("indices"),
        F.size("sample_index").cast("bigint").alias("n_samples"), F.size("samples_value").cast("bigint").alias("n_channels"),
    )


@query(
    "transpose_runs",
    RUNS + f"""select run, run_start, {CH.format(i=1)} first_channel, {CH.format(i=32)} last_channel,
      array_to_string(list_transform(range(32), lambda c: cast(list_sum(list_transform(list(samples_value), lambda v: v[c + 1])) as bigint)), ',') sums from r group by run, run_start""",
)
def transpose_runs(spark, d):
    from pulseloom.functions.waveform import total_long

    t = run_table(spark, d)
    return t.select(
        "run", "run_start", csv(F.get("samples_value", F.lit(0))).alias("first_channel"),
        csv(F.get("samples_value", F.lit(31))).alias("last_channel"), csv(F.transform("samples_value", total_long)).alias("sums"),
    )


@query(
    "skip_first_runs",
    RUNS + "select run, run_start, count(*) n_samples from r group by run, run_start qualify row_number() over (partition by run order by run_start) > 2",
)
def skip_first_runs(spark, d):
    marked = runs.run_starts(placed(spark, d).drop("samples_value"), stream=["run"])
    t = marked.groupBy("run", "run_start").agg(F.count(F.lit(1)).alias("n_samples"))
    return runs.skip_first_runs(t, 2, stream=["run"])


@query(
    "runs_by_chip_change",
    B + """, p as (select run, pos, chip, samples_value, l_orderkey * 1000 + l_linenumber * 32 ts from fx_pos),
      f as (select *, case when lag(chip) over (partition by run order by pos) = chip then 0 else 1 end brk from p),
      r as (select *, max(case when brk = 1 then pos end) over (partition by run order by pos rows unbounded preceding) run_start from f),
      g as (select run, run_start, (pos - run_start) // 64 part, min(chip) chip, list(samples_value order by pos) v from r group by run, run_start, part),
      h as (select run, run_start, arg_min(ts, pos) "timestamp" from r group by run, run_start)
      select run, run_start, part, chip, c.range channel, array_to_string(list_transform(v, lambda s: s[c.range + 1]), ',') samples, "timestamp"
      from g join h using (run, run_start) cross join range(32) c""",
)
def runs_by_chip_change(spark, d):
    t = runs.chip_runs(placed(spark, d), stream=["run"], part_blocks=64)
    return t.select("run", "run_start", "part", "chip", "channel", csv("samples").alias("samples"), "timestamp")


FRAME = 7  # lines of an order are numbered 1..7


@query(
    "complete_frames",
    B + """, p as (select run, chip, pos, sample_index - 1 i, samples_value v from fx_pos),
      n as (select *, row_number() over (partition by run, chip order by pos) rn, """
    + ", ".join(
        f"min(case when i = {k} then pos end) over (partition by run, chip order by pos rows between current row and unbounded following) n{k}"
        for k in range(FRAME)
    )
    + """ from p),
      e as (select *, case when """ + " and ".join(f"n{k} is not null" for k in range(FRAME)) + " then greatest(" + ", ".join(f"n{k}" for k in range(FRAME)) + """) end e from n),
      step as (select a.run, a.chip, a.pos, a.e, c.pos nxt from e a join e b on b.run = a.run and b.chip = a.chip and b.pos = a.e
        left join e c on c.run = b.run and c.chip = b.chip and c.rn = b.rn + 1),
      walk(run, chip, s, e, nxt) as (
        select step.run, step.chip, step.pos, step.e, step.nxt from step join e using (run, chip, pos) where rn = 1
        union all
        select step.run, step.chip, step.pos, step.e, step.nxt from walk join step on step.run = walk.run and step.chip = walk.chip and step.pos = walk.nxt),
      f as (select w.run, w.chip, w.s, w.e, p.i, arg_max(p.v, p.pos) v from walk w join p on p.run = w.run and p.chip = w.chip and p.pos between w.s and w.e group by all),
      g as (select run, chip, s, e, list(v order by i) v from f group by all)
      select run, chip, s frame_start, e frame_end, array_to_string(flatten(list_transform(range(32), lambda c: list_transform(v, lambda r: r[c + 1]))), ',') samples from g""",
)
def complete_frames(spark, d):
    """Frames of all seven indices of the view per run and chip."""
    b = placed(spark, d).withColumn("sample_index", F.col("sample_index") - 1)
    f = runs.complete_frames(b, stream=["run", "chip"], n_samples=FRAME)
    return f.select("run", "chip", "frame_start", "frame_end", csv(F.flatten("samples_value")).alias("samples"))
