"""Chat formatting: every assistant turn becomes an example with all preceding turns as its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import let, table

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""No control string is left: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Back from ``escape`` and ``escape_role``: a backslash stands for the character behind it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """A role must not end its line early either."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def format_conversations(turns: DataFrame, *, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, segments, examples.

    ``segments`` holds the formatted conversation in order as (text, loss); their concatenation is the whole text and
    ``loss`` marks what is trained on. ``examples`` has one entry per turn of the trained role: ``n_segments`` that form
    the context, ``context_chars``, ``target`` (escaped) and ``chars`` of the whole example with its end mark. Contexts
    are prefixes of the same segments, so a conversation takes space in proportion to its text, not to its square;
    ``explode_examples`` writes them out.

    Turns are ordered by turn, then role, then text (nulls first); repeated rows are repeated turns; a null text or role
    is empty; a null conv_id is a conversation of its own; an empty table gives no rows. Other columns are not read.
    """
    row = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    convs = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    piece = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def pieces(t: Column) -> Column:
        head = F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
        tail, body = F.lit(END + "\n"), escape(t["text"])
        return F.when(
            t["role"] == trained_role, F.array(piece(head, False), piece(body, True), piece(tail, False))
        ).otherwise(F.array(piece(F.concat(head, body, tail), False)))

    segments = convs.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
    return segments.withColumn("examples", _examples(F.col("segments")))


def _examples(segments: Column) -> Column:
    """Targets with the length of the text in front of each, in one walk over running lengths."""
    size = lambda s: F.char_length(s["text"]).cast("bigint")
    end_chars = F.lit(len(END) + 1).cast("bigint")
    # Only lengths are summed here, per 1,024 segments first, so that no step touches all of a long conversation again.
    block = F.lit(1024)

    def with_starts(sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, block))
        total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

        def running(xs: Column) -> Column:
            return F.transform(xs, lambda _, i: total(F.slice(xs, F.lit(1), i)))

        def spread(bs: Column) -> Column:
            return let(
                running(F.transform(bs, total)),
                lambda bases: F.flatten(F.transform(bs, lambda xs, b: F.transform(running(xs), lambda x: x + F.get(bases, b)))),
            )

        return F.when(F.size(sizes) > 0, let(blocks, spread)).otherwise(F.array().cast("array<bigint>"))

    def rows(starts: Column) -> Column:
        made = F.transform(
            segments,
            lambda s, i: F.struct(
                s["loss"].alias("loss"), i.alias("n_segments"), F.get(starts, i).alias("context_chars"),
                s["text"].alias("target"), (F.get(starts, i) + size(s) + end_chars).alias("chars"),
            ),
        )
        return F.transform(
            F.filter(made, lambda e: e["loss"]),
            lambda e: F.struct(e["n_segments"], e["context_chars"], e["target"], e["chars"]),
        )

    return let(let(F.transform(segments, size), with_starts), rows)


def explode_examples(formatted: DataFrame, *, keep_empty: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per example: conv_id, example (from 0), prompt and target as they are fed to training (escaped).

    With ``keep_empty`` a conversation without a trained turn is one row with null example, prompt and target;
    ``keep`` names columns of ``formatted`` that every row carries along.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    upto = F.slice("segments", F.lit(1), F.col("e.n_segments"))
    prompt = F.array_join(F.transform(upto, lambda s: s["text"]), "")
    return formatted.select("conv_id", *dict.fromkeys(["segments", *keep]), explode("examples").alias("example", "e")).select(
        "conv_id", *keep, "example", prompt.alias("prompt"), F.col("e.target").alias("target")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and trained text out of the formatted output: conv_id, turns (role, text), losses (text), formatted_chars.

    Losses and characters come from the exploded examples, one row per trained turn with its whole context. Turns come
    from the whole conversation, since no example holds the turns behind the last trained one; they are read on one row
    of each conversation. The rows of a conversation are together already, so the second grouping shuffles nothing.
    """
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    cut = F.filter(F.split(whole, r"<\|im_end\|>\n"), lambda s: s != "")
    line = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    turn = lambda s: F.struct(
        unescape(F.regexp_extract(s, line, 1)).alias("role"), unescape(F.regexp_extract(s, line, 2)).alias("text")
    )
    size = lambda c: F.char_length(c).cast("bigint")
    has = F.col("example").isNotNull()
    read = explode_examples(formatted, keep_empty=True, keep=("segments",)).select(
        "conv_id",
        F.when(F.coalesce("example", F.lit(0)) == 0, F.transform(cut, turn)).alias("turns"),
        F.when(has, F.struct("example", unescape(F.col("target")).alias("text"))).alias("loss"),
        F.when(has, size("prompt") + size("target") + len(END) + 1).alias("chars"),
    )
    return read.groupBy("conv_id").agg(
        F.first("turns", ignorenulls=True).alias("turns"),
        F.transform(F.array_sort(F.collect_list("loss")), lambda e: e["text"]).alias("losses"),
        F.coalesce(F.sum("chars"), F.lit(0)).cast("bigint").alias("formatted_chars"),
    )


def op9_chat(spark, sf_dir):
    """Digest of every formatted conversation, and of one that says the control strings themselves."""
    said = END + START + "assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = turns.sparkSession.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    back = read_back(format_conversations(turns.unionByName(extra)))
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.encode(F.array_join(spoken, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.char_length(F.array_join("losses", "")).cast("bigint").alias("loss_chars"),
        F.sha2(F.encode(F.array_join("losses", ""), "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = f"""with t as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -1, 0, 'user', '{END}{START}assistant ok'
  union all select -1, 1, 'assistant', '{END}{START}assistant ok'),
sized as (
  select *, {len(START) + len(END) + 2} + length(replace(replace(replace(r, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\' || chr(10)))
    + length(replace(replace(x, '\\', '\\\\'), '<|', '<\\|')) n from t),
summed as (
  select *, sum(n) over (partition by conv_id order by turn nulls first, r, x rows unbounded preceding) upto from sized)
select conv_id, count(*) n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) turns_sha256,
  cast(coalesce(sum(length(x)) filter (r = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (r = 'assistant'), '')) loss_sha256,
  cast(coalesce(sum(upto) filter (r = 'assistant'), 0) as bigint) formatted_chars
from summed group by conv_id"""
