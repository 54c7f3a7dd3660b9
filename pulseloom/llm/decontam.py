"""Benchmark decontamination: passages query a BM25 index of the test items, pruned by block maxima."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.common import table
from pulseloom.llm.tokens import IS_MARK, Family, U, Words

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
K1, B = 1.2, 0.75
SCORE = 0.6  # share of an item's own score from which a passage is looked at
QUESTION_GRAM, ANSWER_GRAM = 5, 3
OVERLAP = 0.5  # share of an item's word sequences that must be in the document, of question and answer each
BLOCK_ITEMS, SUB_ITEMS = 256, 16
SLICE_WORDS = 2_000_000  # words of items that one pass over the documents carries; more items take more passes
LEAK = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType()),
]))


MARKS = "[\\x00-/:-@\\[-`{-\\x7F]+"  # as IS_MARK


def split_item(text: str) -> str:
    """The question of an item. The answer is the last sentence, or the last third of a single sentence."""
    ends = [m.end() for m in re.finditer(r"[.?!:][ \t\r\n]+", text.strip())]
    if ends:
        return text.strip()[: ends[-1]]
    words = text.split()
    return " ".join(words[: len(words) - max(len(words) // 3, 1)])


def grams(numbers: np.ndarray, size: int, family: Family) -> np.ndarray:
    """Distinct word sequences; a shorter text is one sequence."""
    return np.unique(family.windows(numbers, min(size, len(numbers)))) if len(numbers) else np.zeros(0, U)


class ItemBlock:
    """Inverted index of a block of items of similar length: term weights, and their maxima by block and sub-block."""

    def __init__(self, items: list, n_items: int, mean_words: float):
        family = Family(4)
        self.family, self.ids = family, np.array([i["item_id"] for i in items], np.int64)
        self.words = [Words(pa.array([i["text"]]), IS_MARK).numbers(family, lower=True) for i in items]
        self.stride = stride_for(max(map(len, self.words)))
        self.vocab = np.unique(np.concatenate(self.words))
        weight = np.zeros((len(self.vocab), len(items)), np.float32)
        for j, (item, w) in enumerate(zip(items, self.words)):
            df = dict(zip(Words(pa.array([" ".join(item["df"])]), IS_MARK).numbers(family, lower=True).tolist(), item["df"].values()))
            terms, tf = np.unique(w, return_counts=True)
            idf = np.array([np.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()])
            x = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean_words))
            weight[np.searchsorted(self.vocab, terms), j] = x / x.sum()
        self.weight = weight
        pad = -len(items) % SUB_ITEMS
        cut = np.pad(weight, ((0, 0), (0, pad))).reshape(len(self.vocab), -1, SUB_ITEMS)
        self.sub_max = cut.max(axis=2)
        parts = [len(Words(pa.array([split_item(i["text"])]), IS_MARK).start) for i in items]
        sized = lambda w, n: (grams(w, n, family), min(n, len(w)))
        self.question = [sized(w[:q], QUESTION_GRAM) for w, q in zip(self.words, parts)]
        self.answer = [sized(w[q:], ANSWER_GRAM) for w, q in zip(self.words, parts)]

    def hits(self, numbers: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, low, high) for every passage that reaches SCORE; low and high are its words.

        Chunks have ``stride`` words and two neighbours make a passage, so a copy of an item is whole in one of them. The
        maxima of a sub-block's terms, summed over both chunks, bound every score in it; only sub-blocks whose bound
        reaches the threshold are scored.
        """
        at = np.minimum(np.searchsorted(self.vocab, numbers), len(self.vocab) - 1)
        known = np.flatnonzero(self.vocab[at] == numbers)
        if not len(known):
            return
        text = np.searchsorted(first, known, side="right") - 1
        per_text = -(-np.diff(first) // self.stride)
        base = np.concatenate([[0], np.cumsum(per_text)])
        chunk = base[text] + (known - first[text]) // self.stride
        pair = np.unique(chunk * len(self.vocab) + at[known])
        chunks, terms = pair // len(self.vocab), pair % len(self.vocab)
        bounds = np.searchsorted(chunks, np.arange(base[-1] + 1))
        filled = np.flatnonzero(np.diff(bounds))
        upper = np.zeros((base[-1] + 1, self.sub_max.shape[1]), np.float32)
        for a in range(0, len(filled), 20_000):
            part = filled[a : a + 20_000]
            lo, hi = bounds[part[0]], bounds[part[-1] + 1]
            upper[part] = np.add.reduceat(self.sub_max[terms[lo:hi]], bounds[part] - lo, axis=0)
        owner = np.searchsorted(base, np.arange(base[-1]), side="right") - 1
        joined = np.zeros(base[-1] + 1, bool)
        joined[:-1][:-1] = owner[1:] == owner[:-1] if base[-1] > 1 else False
        both = upper[:-1] + np.where(joined[:-1, None], upper[1:], 0)
        for c in np.flatnonzero((both >= SCORE - 1e-5).any(axis=1)).tolist():
            ts = np.unique(terms[bounds[c] : bounds[c + 2 if joined[c] else c + 1]])
            for s in np.flatnonzero(both[c] >= SCORE - 1e-5).tolist():
                score = self.weight[ts, s * SUB_ITEMS : (s + 1) * SUB_ITEMS].astype(np.float64).sum(axis=0)
                t = int(owner[c])
                low = first[t] + (c - base[t]) * self.stride
                for j in np.flatnonzero(score >= SCORE).tolist():
                    yield t, s * SUB_ITEMS + j, float(score[j]), int(low), int(min(low + 2 * self.stride, first[t + 1]))

    def overlaps(self, item: int, numbers: np.ndarray) -> tuple[float, float]:
        """Shares of the item's question and answer sequences that stand in a stretch of words; an empty part is there."""
        share = lambda own, size: float(np.isin(own, self.family.windows(numbers, size)).mean()) if len(own) else 1.0
        return share(*self.question[item]), share(*self.answer[item])


def load_items(benchmark: DataFrame) -> Iterator[tuple[list, int, float]]:
    """Items (item_id, text, df by word), slice by slice, and the size of the whole collection.

    Frequencies count over all items, in Spark. A slice is bounded in words, so the driver holds a fixed amount.
    """
    words = F.array_remove(F.split(F.translate("text", UPPER, UPPER.lower()), MARKS), "")
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text", words.alias("w")).filter("size(w) > 0").distinct()
    n, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("w")), F.lit(0))).first()
    if not n:
        return
    each = items.select("item_id", "text", F.explode(F.array_distinct("w")).alias("word"))
    df = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rows = each.join(df, "word").groupBy("item_id", "text").agg(F.map_from_entries(F.collect_list(F.struct("word", "df"))).alias("df"))
    slices = -(-total // SLICE_WORDS)
    for s in range(slices):
        yield rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s).orderBy("item_id", "text").collect(), n, total / n


def stride_for(n_words: int) -> int:
    """Words of a chunk that holds an item of so many words."""
    stride = 64
    while stride < n_words:
        stride *= 8
    return stride


def blocks_of(items: list, n: int, mean: float) -> list[ItemBlock]:
    """Blocks of items of similar length."""
    classes: dict[int, list] = {}
    for i in sorted(items, key=lambda i: (len(i["text"]), i["item_id"])):
        classes.setdefault(stride_for(len(i["text"].split())), []).append(i)
    return [ItemBlock(x[a : a + BLOCK_ITEMS], n, mean) for x in classes.values() for a in range(0, len(x), BLOCK_ITEMS)]


def flag_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``leaks``: test items whose text is in the document, with the best score of each.

    Words are letters and digits in lower case (A-Z), apart from all else. Every passage of every text queries the index with its distinct words. All items that reach ``SCORE`` of their own
    score are retrieved, whatever their number, and kept if ``OVERLAP`` of the word sequences of both question and answer
    stand in the passage or right beside it. Documents are neither moved nor shuffled.

    A null or wordless text has no leaks; items without words or id are left out; equal rows get equal results; without
    items nothing leaks; a column named ``leaks`` is replaced.
    """
    keep = docs.select(*[c for c in docs.columns if c.lower() != "leaks"])
    out = None
    for items, n, mean in load_items(benchmark):
        one = _flag(keep if out is None else out, blocks_of(items, n, mean))
        out = one
    return out if out is not None else keep.withColumn("leaks", F.lit(None).cast(LEAK)).withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAK)))


def _flag(docs: DataFrame, blocks: list[ItemBlock]) -> DataFrame:
    rest = [c for c in docs.columns if c != "leaks"]
    old = docs.columns.index("leaks") if "leaks" in docs.columns else None
    at, columns = docs.columns.index("text"), [*rest, "leaks"]
    spots = [docs.columns.index(c) for c in rest]
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField("leaks", LEAK)])
    shape = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def leaks_of(texts) -> list[dict]:
        words = Words(texts, IS_MARK)
        found: list[dict] = [{} for _ in range(len(words))]
        numbers = words.numbers(blocks[0].family, lower=True)
        for block in blocks:
            for t, j, score, low, high in block.hits(numbers, words.first):
                a, b = max(low - block.stride, words.first[t]), min(high + block.stride, words.first[t + 1])
                q, s = block.overlaps(j, numbers[a:b])
                if q >= OVERLAP and s >= OVERLAP:
                    item = int(block.ids[j])
                    found[t][item] = max(found[t].get(item, (0.0, 0.0, 0.0)), (round(min(score, 1.0), 6), round(q, 6), round(s, 6)))
        return [[{"item_id": i, "score": x[0], "question_overlap": x[1], "answer_overlap": x[2]} for i, x in sorted(f.items())] for f in found]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                lists = leaks_of(batch.column(at))
                if old is not None:
                    lists = [(a.as_py() or []) + b for a, b in zip(batch.column(old), lists)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in spots], pa.array(lists, shape)], names=columns)

    return docs.mapInArrow(run, schema)


def op4_decontamination(spark, sf_dir):
    """One row per document and leaked test item."""
    flagged = flag_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return flagged.select("doc_id", F.inline("leaks"))
