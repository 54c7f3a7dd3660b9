"""Repeated passages by recompression: rounds that name runs and pairs alike wherever equal words stand."""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import table
from pulseloom.llm.tokens import Family, U, Words, mix
from pulseloom.session import materialize, scratch_path

WINDOW = 35
ROUNDS = 6
BLOCK_BYTES = 4 << 20  # texts are packed to rows of about this size
PART_BYTES = 32 << 20  # bytes of text per hash part and per bucket: what one task holds at a time
MOST_BUCKETS = 50_000  # a table may not have more than twice as many; the hash parts are not bound to it


def recompress(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the last round over the words of several texts: name, and the words [low, high) that decide on it.

    A round first names runs of equal symbols, then pairs of a symbol of the left and one of the right half of the
    alphabet; the halves are drawn anew in each round by the first word of a symbol. A name is a fingerprint of the run
    or pair, so every task gives equal strings equal names without asking another. Texts are never merged.

    Whether a symbol stands at a place depends on few words around it. [low, high) covers them, so wherever the same
    words stand, the same symbol stands among them: what differs at the edges of a repeat is outside that range.
    """
    n = len(words)
    name, start = words.copy(), np.arange(n)
    end, low, high = start + 1, start.copy(), start + 1
    text = np.searchsorted(first, start, side="right") - 1
    text_low, text_high = first[text], first[text + 1]
    for r in range(rounds):
        if len(name) < 2:
            break
        # Runs. That a neighbour differs is seen by one word, unless that word is the same.
        t = text[start]
        together = (t[1:] == t[:-1]) & (name[1:] == name[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~together]))
        tail = np.append(head[1:], len(name)) - 1
        count = tail - head + 1
        run = count > 1
        left, right = np.maximum(head - 1, 0), np.minimum(tail + 1, len(name) - 1)
        s, e = start[head], end[tail]
        new_low, new_high = np.minimum.reduceat(low, head), np.maximum.reduceat(high, head)
        before, after = np.maximum(s - 1, text_low[s]), np.minimum(e + 1, text_high[s])
        # A text's edge is seen like a word: it lies one place outside, where no window of another text can reach.
        before, after = np.where(s == text_low[s], s - 1, before), np.where(e == text_high[s], e + 1, after)
        same_left = (s > text_low[s]) & (words[s - 1] == words[end[head] - 1])
        same_right = (e < text_high[s]) & (words[np.minimum(e, n - 1)] == words[start[tail]])
        new_low = np.minimum(new_low, np.where(same_left, low[left] - 1, before))
        new_high = np.maximum(new_high, np.where(same_right, high[right] + 1, after))
        name = np.where(run, mix(name[head] + count.astype(U) * U(0x9E3779B97F4A7C15) + U(2 * r + 1)), name[head])
        start, end, low, high = s, e, new_low, new_high
        # Pairs. A left symbol looks at the first word of the next one, a right symbol at the whole one before it.
        t = text[start]
        half = ((mix(words[start] + U((r * 0xD6E8FEB86659FD93) % (1 << 64))) >> U(17)) & U(1)).astype(bool)
        pair = (t[1:] == t[:-1]) & ~half[:-1] & half[1:]
        second = np.concatenate([[False], pair])
        joins = np.append(pair, False)
        alone = ~second & ~joins
        inner_left = start > text_low[start]
        low_of_left, start_of_left = np.concatenate([[0], low[:-1]]), start - 1
        looks_left = alone & half
        low = np.where(looks_left, np.minimum(low, np.where(inner_left, low_of_left, start_of_left)), low)
        looks_right = alone & ~half
        high = np.where(looks_right, np.maximum(high, end + 1), high)
        keep = np.flatnonzero(~second)
        mate = np.minimum(keep + 1, len(name) - 1)
        paired = joins[keep]
        name = np.where(paired, mix(name[keep] * U(0xA24BAED4963EE407) + mix(name[mate]) + U(2 * r + 2)), name[keep])
        end = np.where(paired, end[mate], end[keep])
        low = np.where(paired, np.minimum(low[keep], low[mate]), low[keep])
        high = np.where(paired, np.maximum(high[keep], high[mate]), high[keep])
        start = start[keep]
    return name, low, high


class Block:
    """Words, symbols and windows of the texts of one row."""

    def __init__(self, texts: pa.Array):
        self.families = Family(8), Family(88)
        self.cut = Words(texts)
        self.first = self.cut.first
        self.n = len(self.cut.start)

    def symbols(self):
        return recompress(self.cut.numbers(self.families[0]), self.first)

    def has_window(self) -> np.ndarray:
        """Whether a whole window starts at each word."""
        text_end = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(self.n) + WINDOW <= text_end

    def window_numbers(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent numbers of the whole windows at ``at``; no other words are hashed."""
        needed = covered(self.n, at)
        place = (np.cumsum(needed) - 1)[at]  # the words of a window stay neighbours among the needed ones
        h1, h2 = (f.windows(self.cut.numbers(f, only=needed), WINDOW)[place] for f in self.families)
        return h1, h2

    def candidates(self, repeated: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Words at which a window starts that holds no symbol found only once in the corpus; [low, high) as from ``symbols``."""
        once = ~repeated
        a, b = np.maximum(high[once] - WINDOW, 0), low[once]
        inside = (b >= a) & (low[once] >= 0)
        change = np.bincount(a[inside], minlength=self.n + 1) - np.bincount(np.minimum(b[inside] + 1, self.n), minlength=self.n + 1)
        return np.flatnonzero((np.cumsum(change[: self.n]) == 0) & self.has_window())


def covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of ``n`` words the windows at ``starts`` cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


class Question:
    """Numbers of one block in the order in which they are asked: by part, then by value, each once."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray | None, parts: int):
        h1 = h1 | U(1)  # the lowest bit is free for the mark below
        part = (mix(h1) % U(parts)).astype(np.int64)
        order = np.argsort(h1, kind="stable")
        order = order[np.argsort(part[order], kind="stable")]
        a, p = h1[order], part[order]
        b = h2[order] if h2 is not None else None
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | ((b[1:] != b[:-1]) if b is not None else False)
        at = np.flatnonzero(new)
        many = np.diff(np.append(at, len(a))) > 1
        self.place = np.empty(len(a), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.h1 = np.where(many, a[at], a[at] ^ U(1))  # odd: twice or more in this block alone
        self.h2 = b[at] if b is not None else None
        self.bounds = np.searchsorted(p[at], np.arange(parts + 1))

    def packed_places(self) -> bytes:
        """What it takes to read the answers without the numbers: parts asked, questions to each, the place of every caller's number."""
        size = np.diff(self.bounds)
        asked = np.flatnonzero(size)
        return np.concatenate([[len(asked)], asked, size[asked], self.place]).astype(np.int32).tobytes()

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        for p in np.flatnonzero(np.diff(self.bounds)):
            a, b = self.bounds[p : p + 2]
            yield int(p), self.h1[a:b].tobytes(), self.h2[a:b].tobytes() if self.h2 is not None else b""


def read_answers(places: bytes, answers: dict[int, bytes]) -> np.ndarray:
    """Whether each number asked about, in the caller's order, is repeated in the corpus; from ``packed_places``."""
    x = np.frombuffer(places, np.int32)
    k = int(x[0])
    bits = [np.unpackbits(np.frombuffer(answers[p], np.uint8), count=n) for p, n in zip(x[1 : k + 1].tolist(), x[k + 1 : 2 * k + 1].tolist())]
    return np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)[x[2 * k + 1 :]]


def repeated_in(blobs: list[tuple[bytes, bytes]]) -> list[bytes]:
    """For the numbers that all blocks asked about in one part: bits that say which of them occur more than once."""
    sizes = [len(x) // 8 for x, _ in blobs]
    h1 = np.frombuffer(b"".join(x for x, _ in blobs), U)
    marked, key = (h1 & U(1)).astype(bool), h1 | U(1)
    second = np.frombuffer(b"".join(y for _, y in blobs), U)
    order = np.argsort(key, kind="stable")
    a = key[order]
    equal = a[1:] == a[:-1]
    if len(second):
        b = second[order]
        if (equal & (b[1:] != b[:-1])).any():
            order = np.lexsort((second, key))
            a, b = key[order], second[order]
        equal = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    seen = np.zeros(len(a), bool)
    seen[1:] |= equal
    seen[:-1] |= equal
    out = marked.copy()
    out[order] |= seen
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


def in_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """Texts packed to rows (block, doc_ids, texts) in a table bucketed by block, and the number of its buckets.

    The rows stay on the task that reads them. Later joins by block move the small side only.
    """

    def pack(batches) -> Iterator[pa.RecordBatch]:
        def row(ids: list, texts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([secrets.randbits(62)]), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))],
                names=["block", "doc_ids", "texts"],
            )

        ids: list = []
        texts: list = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield row(ids, texts)

    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    name = f"blocks_{secrets.token_hex(8)}"
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(pack, "block long, doc_ids array<long>, texts array<string>")
    rows.write.option("compression", "zstd").option("path", scratch_path(spark, name)).bucketBy(min(parts, MOST_BUCKETS), "block").saveAsTable(name)
    return spark.table(name), parts


def answers(questions: DataFrame) -> DataFrame:
    """(block, answers) from (part, block, h1, h2).

    A part holds an even share of all numbers, and each block asks about a number once however often it has it, so a
    number that fills a third of the corpus takes no more room in its part than one entry per block.
    """

    def work(group: pa.Table) -> pa.Table:
        bits = repeated_in(list(zip(group["h1"].to_pylist(), group["h2"].to_pylist())))
        return pa.table({"block": group["block"], "part": group["part"], "bits": pa.array(bits, pa.binary())})

    bits = questions.groupBy("part").applyInArrow(work, "block long, part int, bits binary")
    return bits.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("answers"))


# A row with what a block keeps for itself in place of a part's questions: ranges of its symbols or starts of its windows, and the
# places of their answers.
HELD = -1
ASK = "part int, block long, h1 binary, h2 binary"


def asked(block: int, q: Question) -> pa.RecordBatch:
    rows = list(q.rows())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()),
            pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
        ],
        names=["part", "block", "h1", "h2"],
    )


def held(block: int, kept: np.ndarray, q: Question) -> pa.RecordBatch:
    kept = pa.array([kept.astype(np.int32).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([HELD], pa.int32()), pa.array([block], pa.int64()), kept, pa.array([q.packed_places()], pa.binary())], names=["part", "block", "h1", "h2"])


def given(value) -> dict[int, bytes]:
    return {x["part"]: x["bits"] for x in value.as_py() or []}


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Removed is every word covered by a window of 35 words that starts at another place too. Two rounds of questions go
    over the corpus. The first asks which symbols of the last recompression round occur more than once; a window around
    a symbol that occurs once is unique. The second verifies the windows that are left, by 128-bit numbers of their
    words. Numbers are asked about by hash part, and the answers come back as bits. Symbols are worked out once: which
    words decide on each is kept with the questions, so the second round hashes only the words of windows that are left.

    A null or wordless text keeps the empty string; texts of fewer than 35 words keep all words; repeated rows repeat
    each other and lose all covered words; a null doc_id is carried along; an empty table gives no rows.
    """
    blocks, parts = in_blocks(docs)

    def ask_symbols(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, low, high = Block(batch.column(1)[i].values).symbols()
                if len(name):
                    number, q = batch.column(0)[i].as_py(), Question(name, None, parts)
                    yield asked(number, q)
                    yield held(number, np.concatenate([np.diff(low, prepend=0), high - low]), q)

    def ask_windows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ranges = batch.column(2)[i].as_py()
                if ranges is None:  # no words
                    continue
                steps, widths = np.split(np.frombuffer(ranges, np.int32).astype(np.int64), 2)
                b, low = Block(batch.column(1)[i].values), np.cumsum(steps)
                at = b.candidates(read_answers(batch.column(3)[i].as_py(), given(batch.column(4)[i])), low, low + widths)
                if len(at):
                    number, q = batch.column(0)[i].as_py(), Question(*b.window_numbers(at), parts)
                    yield asked(number, q)
                    yield held(number, at, q)

    def answered(asked_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the blocks keep, and their answers."""
        rows = materialize(asked_rows)
        kept = rows.filter(f"part = {HELD}").select("block", F.col("h1").alias("kept"), F.col("h2").alias("places"))
        return kept, materialize(answers(rows.filter(f"part <> {HELD}")))

    symbols, first = answered(blocks.select("block", "texts").mapInArrow(ask_symbols, ASK))
    known = blocks.join(symbols, "block", "left").join(first, "block", "left").select("block", "texts", "kept", "places", "answers")
    windows, second = answered(known.mapInArrow(ask_windows, ASK))

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                texts, cut = batch.column(1)[i].values, Words(batch.column(1)[i].values)
                n_all, first, starts = len(cut.start), cut.first, batch.column(3)[i].as_py()
                stays = np.ones(n_all, bool)
                if starts is not None:
                    hit = np.frombuffer(starts, np.int32)[read_answers(batch.column(4)[i].as_py(), given(batch.column(5)[i]))]
                    stays = ~covered(n_all, hit)
                kept = []
                for t, x, y in zip(texts, first[:-1], first[1:]):
                    kept.append(b" ".join(compress(t.as_py().encode().split(), stays[x:y].tolist())).decode())
                n = np.diff(first)
                left = np.concatenate([[0], np.cumsum(stays)])[first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2)[i].values, pa.array(n, pa.int64()), pa.array(n - np.diff(left), pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    both = blocks.join(windows, "block", "left").join(second, "block", "left")
    return both.select("block", "texts", "doc_ids", "kept", "places", "answers").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")


def op8_repeats(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = f"""with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
starts as (select doc_id, unnest(range(1, len(w) - {WINDOW - 2})) i, w from words where len(w) >= {WINDOW}),
win as (select doc_id, i, md5_number(array_to_string(w[i:i + {WINDOW - 1}], ' ')) h from starts),
hit as (select doc_id, i from win where h in (select h from win group by h having count(*) > 1)),
gone as (select distinct doc_id, unnest(range(i, i + {WINDOW})) i from hit),
cut as (select doc_id, list(i) g from gone group by doc_id),
one as (select doc_id, unnest(w) x, generate_subscripts(w, 1) i from words),
kept as (select one.doc_id, string_agg(x, ' ' order by one.i) k from one left join gone on gone.doc_id = one.doc_id and gone.i = one.i
  where gone.i is null group by one.doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(g), 0) as bigint) n_removed, sha256(coalesce(k, '')) kept_sha256
from words left join cut using (doc_id) left join kept using (doc_id)"""
