"""Reproducible shuffle into shards: a Feistel permutation over global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import let, table
from pulseloom.operators.position import with_position

# A prime below 2^31 and odd multipliers; products of two residues stay below 2^62.
PRIME = 2147483647
MULTIPLIERS = (1103515245, 1664525)
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One key per round from the seed."""
    keys, x = [], seed % PRIME
    for _ in range(rounds):
        x = (x * 48271 + 11) % PRIME
        keys.append(x)
    return keys


def domain(n: int) -> tuple[int, int]:
    """The two radices of the Feistel halves: their product is at least n and exceeds it by less than the first."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def mixed(x: Column, key: Column) -> Column:
    """Round function: two squarings modulo a prime, so that it is not linear in x."""
    y = (x * F.lit(MULTIPLIERS[0]) + key) % F.lit(PRIME)
    z = ((y * y) % F.lit(PRIME) * F.lit(MULTIPLIERS[1]) + key) % F.lit(PRIME)
    return (z * z) % F.lit(PRIME)


def feistel(x: Column, a: int, b: int, keys: list[int]) -> Column:
    """One pass of the network over 0..a*b-1; the halves are changed in turn."""
    start = F.struct((x % F.lit(a)).cast("bigint").alias("l"), F.expr("0L").alias("r"))
    start = start.withField("r", ((x - x % F.lit(a)) / F.lit(a)).cast("bigint"))
    rounds = F.array(*[F.struct(F.lit(k).cast("bigint").alias("key"), F.lit(i % 2 == 0).alias("left")) for i, k in enumerate(keys)])

    def step(h: Column, k: Column) -> Column:
        return F.struct(
            F.when(k["left"], (h["l"] + mixed(h["r"], k["key"])) % F.lit(a)).otherwise(h["l"]).alias("l"),
            F.when(k["left"], h["r"]).otherwise((h["r"] + mixed(h["l"], k["key"])) % F.lit(b)).alias("r"),
        )

    return F.aggregate(rounds, start, step, lambda h: h["l"] + h["r"] * F.lit(a))


def permuted(row: Column, n: int, seed: int) -> Column:
    """Place of a row number in a permutation of 0..n-1.

    Cycle walking: a result of n or more goes through the network again. The domain has fewer than sqrt(n) surplus
    values, so a walk is that long at most and only one row in sqrt(n) walks at all.
    """
    a, b = domain(n)
    if a * b >= 1 << 53:
        raise ValueError("more rows than a double holds exactly")
    keys, surplus = round_keys(seed), a * b - n
    first = feistel(row, a, b, keys)
    if surplus == 0:
        return first
    again = lambda x: F.aggregate(
        F.sequence(F.lit(1), F.lit(surplus)), x, lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, a, b, keys))
    )
    return let(first, lambda x: F.when(x < n, x).otherwise(again(x)))


def shard_rows(df: DataFrame, order: list[str], n_shards: int, *, seed: int = 20) -> DataFrame:
    """Add ``row`` (global number in ``order``), ``shard`` and ``slot``; shard sizes differ by at most one row.

    ``shard = p(row) mod n_shards``, ``slot = p(row) div n_shards`` with the permutation p, so both can be computed from
    the row number, and back. Numbering costs one range shuffle of the given columns; select few of them. Rows that are
    equal in all of ``order`` get neighbouring numbers in any order, nulls come first, an empty frame stays empty.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    kept = df.columns
    numbered = with_position(df, order, "_row")
    place = permuted(F.col("_row"), numbered.count(), seed)
    return numbered.select(*kept, F.col("_row").alias("row"), place.alias("_p")).select(
        *kept,
        "row",
        (F.col("_p") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / n_shards).cast("bigint").alias("slot"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 40, *, seed: int = 20) -> DataFrame:
    """Shards of documents: doc_id, size, text_crc32, law, shard, slot, grown_shard, row.

    Rows are numbered by doc_id; rows that share one are told apart by size, checksum and a hash of the text. A null text
    has size 16 and the checksum of no bytes. Only these numbers are shuffled, never texts. Equal texts need not meet.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("_h"),
    )
    out = shard_rows(slim, ["doc_id", "size", "text_crc32", "_h"], n_shards, seed=seed)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row"
    )


def op5_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


def crc_table() -> list[int]:
    """CRC-32 table by its polynomial."""
    rows = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        rows.append(c)
    return rows


def _sql(n_shards: int = 40, seed: int = 20) -> str:
    p, (m1, m2) = PRIME, MULTIPLIERS
    f = "((z * z) % {p})"
    steps = ["h0 as (select *, x % a l, x // a r from {src})"]
    for i, k in enumerate(round_keys(seed)):
        inp, out, mod = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        steps.append(f"y{i} as (select *, ({inp} * {m1} + {k}) % {p} y from h{i})")
        steps.append(f"z{i} as (select * exclude (y), ((y * y) % {p} * {m2} + {k}) % {p} z from y{i})")
        steps.append(f"h{i + 1} as (select * replace (({out} + {f.format(p=p)}) % {mod} as {out}) from z{i})".replace("select * replace", "select * exclude (z) replace"))
    one = ", ".join(steps) + f' select n, a, b, "row", l + r * a x, step from h{ROUNDS}'
    return f"""with recursive size as (select count(*) n from documents),
  sides as (select n, greatest(1, cast(ceil(sqrt(n::double)) as bigint)) a from size),
  dom as (select n, a, greatest(1, (n + a - 1) // a) b from sides),
  num as (select d.doc_id, octet_length(encode(coalesce(text, ''))) + 16 size, coalesce(text, '') t,
            row_number() over (order by d.doc_id nulls first) - 1 "row" from documents d),
  walk as (
    select n, a, b, "row", "row" x, 0 step from num, dom
    union all
    (with {one.format(src='(select n, a, b, "row", x, step + 1 step from walk where step = 0 or x >= n)')})),
  placed as (select "row", arg_max(x, step) x from walk group by "row"),
  crc as (select "row", xor(list_reduce(list_prepend(4294967295::bigint,
      list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: cast('0x' || h as bigint))),
      lambda c, byte: xor(c >> 8, ({crc_table()}::bigint[])[(xor(c, byte) & 255) + 1])), 4294967295::bigint) c from num)
  select doc_id, cast(size as bigint) size, c text_crc32, 'rows' law, cast(x % {n_shards} as int) shard,
         cast(x // {n_shards} as bigint) slot, cast(null as int) grown_shard, "row"
  from num join placed using ("row") join crc using ("row")"""


SQL = _sql()
