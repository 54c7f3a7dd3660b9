"""Shared parts of the registered queries: result shaping and the SQL form of the views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP_US = 300_000_000  # event gap on the pulses view, 300 s


def csv(a: Column | str) -> Column:
    """Array of integers as text, so that both engines print the same value."""
    a = F.col(a) if isinstance(a, str) else a
    return F.array_join(a.cast("array<string>"), ",")


def csv_scaled(a: Column, scale: float = 1e6) -> Column:
    """Array of doubles as text of rounded integers."""
    return csv(F.transform(a, lambda x: F.round(x * scale).cast("bigint")))


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def e6(c: Column | str) -> Column:
    """Six significant digits as text, for values of any size."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.format_string("%.5e", c.cast("double") + F.lit(0.0)))


def sql_e6(expr: str) -> str:
    return f"(case when {expr} is not null then printf('%.5e', cast({expr} as double) + 0.0) end)"


def sql_r6(expr: str, digits: int = 6) -> str:
    return f"(round(cast({expr} as double), {digits}) + 0.0)"


FX_PULSE = """fx_pulse as (
  select event_id pulse_no, user_id % 4 chip, event_id % 32 channel, (user_id % 4) * 32 + event_id % 32 gch,
         epoch_us(ts) t_us, cast(round(value * 100) as bigint) charge from events)"""

FX_WAVE = """fx_wave as (
  select vec_id, vec_id // 32 block, (vec_id // 32) % 4 chip, vec_id % 32 channel,
         list_transform(embedding, lambda e: cast(least(1023.0::double, greatest(0.0::double,
           floor(200.0::double + 1500.0::double * cast(e as double)))) as bigint)) w from embeddings)"""

FX_EVENT2D = FX_WAVE + """, fx_event2d as (
  select block, min(chip) chip, list(w order by channel) samples_value from fx_wave group by block)"""

FX_BLOCK = """fx_block as (
  select l_orderkey % 16 run, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
         l_tax, l_shipdate, (l_orderkey // 16) % 4 chip, cast(l_linenumber as bigint) sample_index,
         l_suppkey % 32 error_level,
         list_transform(range(32), lambda ch: (l_partkey * 7 + ch * 31 + l_linenumber * 101) % 1024) samples_value
  from lineitem), fx_pos as (
  select *, row_number() over (order by run, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_shipdate) - 1 pos from fx_block)"""

FX_BYTES = """fx_bytes as (
  select p_partkey, concat(md5(p_name), md5(p_brand), substring(md5(p_type), 1, 16)) hex from part)"""

FX_MAP = """fx_map as (
  select cast(range // 32 as int) "chipNo", cast(range % 32 as int) "chipChannel", cast(range as int) "readoutID",
         case when range >= 120 then 'G' else cast((range * 7) % 120 as varchar) end gid from range(128)),
  fx_map_gid as (select cast("readoutID" as bigint) map_id, coalesce(try_cast(gid as int), -1) tpc_id from fx_map)"""

# Pads: three rows of 20 triangles per half, the second half mirrored row by row.
FX_PAD = """fx_row as (select cast(range as int) g, cast(range // 20 as int) r, cast(range % 20 as int) k from range(60)),
  fx_pad as (
  select g tpc_id,
         (case r when 0 then k + 0.5e0 when 1 then k + 1.0e0 else k + 1.5e0 end) * 1.5e0 - 15.75e0 x,
         (k % 2) * sqrt(3e0) / 2e0 + r * sqrt(3e0) * 1.5e0 + (45e0 - 3.031088913245535e0) z from fx_row
  union all
  select 60 + 19 - k + 20 * r tpc_id,
         (case r when 0 then k + 1.5e0 when 1 then k + 1.0e0 else k + 0.5e0 end) * 1.5e0 - 15.75e0 x,
         ((k + 1) % 2) * sqrt(3e0) / 2e0 + r * sqrt(3e0) * 1.5e0 + (136.5e0 - 3.031088913245535e0) z from fx_row)"""


def with_views(*views: str) -> str:
    return "with recursive " + ",\n".join(views) + "\n"


FX_EVENT = FX_PULSE + """, fx_gap as (
  select *, case when lag(t_us) over o is null or t_us - lag(t_us) over o > 300000000 then 1 else 0 end f
  from fx_pulse window o as (order by t_us, pulse_no)), fx_event as (
  select * exclude (f), cast(sum(f) over (order by t_us, pulse_no rows unbounded preceding) as bigint) event_id from fx_gap)"""

FX_HIT = (
    FX_EVENT + ", " + FX_MAP + ", " + FX_PAD + """, fx_all_hit as (
  select e.*, m.tpc_id, p.x, p.z, cast(charge as double) w, charge % 1000 + 1 maxsample,
    case when m.tpc_id between 0 and 59 then charge * 0.007594825219782722::double + 0.2907597292526938::double
         when m.tpc_id between 60 and 119 then charge * 0.006512604389126628::double + 0.24932806669203858::double end energy
  from fx_event e left join fx_map_gid m on m.map_id = e.gch left join fx_pad p on p.tpc_id = m.tpc_id),
  fx_hit as (select *, tpc_id < 60 is_up, tpc_id >= 60 is_dn, tpc_id // 20 pad_row from fx_all_hit where tpc_id between 0 and 119)"""
)
