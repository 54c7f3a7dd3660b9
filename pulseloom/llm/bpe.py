"""BPE encoding and decoding: greedy proposals, vectorised checks of neighbours, exact merging only where they fail."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.common import table

END = ""  # stands for the word-end mark of the vocabulary while a word is cut
LONG_WORD = 64  # longer words are cut and merged one by one, shorter ones all at a time
CACHED_WORDS = 150_000  # words whose ids a worker remembers, from task to task, and as many that it used before those
SLICE_CHARS = 1 << 22  # texts are taken in slices of about so many characters
# The split pattern and the normaliser of the vocabulary file.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and how every token was merged; built on the driver and sent along with the task (a few MB, set by the file)."""

    def __init__(self, spec: dict):
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not suffix:
            raise ValueError("a BPE vocabulary with a word-end mark is needed")
        named = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) and t != suffix else t
        self.ids = {named(t): i for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = named(a), named(b)
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.longest = max(map(len, self.ids))
        size = max(self.ids.values()) + 1
        # Last merge of each token: its rank (-1: none) and its two parts. ``whole`` says that merging yields the token itself.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.whole = np.zeros(size, bool)
        for t, i in self.ids.items():
            done = self.merge(t, trace := [])
            self.whole[i] = done == [i]
            if trace and self.whole[i]:
                self.rank[i], self.left[i], self.right[i] = trace[-1]
        keys = sorted((a << 32 | b, rank) for (a, b), (rank, _) in self.merges.items())
        self.pair_keys = np.array([k for k, _ in keys], np.int64)
        self.pair_ranks = np.array([r for _, r in keys], np.int64)
        self.pair_made = np.array([self.merges[k >> 32, k & 0xFFFFFFFF][1] for k, _ in keys], np.int64)
        self.spell()

    def spell(self) -> None:
        """Tables by character: its number (0: in no token), the tokens of units, and the steps from prefix to prefix of a token."""
        chars = sorted({c for t in self.ids for c in t})
        number = {c: i for i, c in enumerate(chars, 1)}
        self.wide = len(chars) + 1
        self.code = np.zeros(ord(chars[-1]) + 2, np.int64)
        self.code[[ord(c) for c in chars]] = range(1, self.wide)
        self.unit, self.last_unit = np.full((2, self.wide), -1, np.int64)
        for c, i in number.items():
            self.unit[i] = self.ids.get(c, -1)
            self.last_unit[i] = self.ids.get(c + END, -1)
        steps: dict = {}
        ends = {}
        for t, i in self.ids.items():
            node = 0
            for c in t:
                node = steps.setdefault(node * self.wide + number[c], len(steps) + 1)
            ends[node] = i
        self.step_keys = np.array(sorted(steps), np.int64)
        self.step_to = np.array([steps[k] for k in self.step_keys.tolist()], np.int64)
        self.token_at = np.full(len(steps) + 1, -1, np.int64)
        self.token_at[list(ends)] = list(ends.values())

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the characters of all words, and where each word starts (and the last ends)."""
        raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.code[np.minimum(raw, len(self.code) - 1)], np.cumsum([0, *map(len, words)])

    def merge(self, word: str, trace: list | None = None) -> list[int]:
        """Exact ids: the pair of lowest rank is merged first, the leftmost of equals."""
        units = [*word[:-2], word[-2:]] if word.endswith(END) and len(word) > 1 else list(word)
        ids = [self.ids[u] for u in units if u in self.ids]
        n = len(ids)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.merges[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merges]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            if trace is not None:
                trace.append((rank, a, b))
            ids[i], live[j], after[i] = self.merges[a, b][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (p := (ids[x], ids[after[x]])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], x, *p))
        return [t for t, on in zip(ids, live) if on]

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; the word-end mark is never left alone. None if that gets stuck."""
        out, i, n, get = [], 0, len(word), self.ids.get
        while i < n:
            j = min(n, i + self.longest)
            while (t := get(word[i:j])) is None or j == n - 1:
                j -= 1
                if j == i:
                    return None
            out.append(t)
            i = j
        return out

    def propose_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``propose`` of all words at a time: tokens, the word of each, and which words got stuck (they have none).

        Every word reads on while what it has read since its last token begins another one, and goes back to the longest token.
        """
        codes, bounds = self.codes(words)
        taken = np.full(len(codes), -1, np.int64)
        stuck = np.zeros(len(words), bool)
        word = np.flatnonzero(np.diff(bounds) > 0)
        start, stop = bounds[word], bounds[word + 1]
        at, node = start.copy(), np.zeros(len(word), np.int64)
        best, best_end = np.full(len(word), -1, np.int64), start.copy()
        codes = np.append(codes, 0)
        while len(word):
            key = node * self.wide + codes[at]
            to = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            on = (at < stop) & (self.step_keys[to] == key)
            node, at = np.where(on, self.step_to[to], 0), at + on
            token = np.where(on & (at != stop - 1), self.token_at[node], -1)
            found = token >= 0
            best, best_end = np.where(found, token, best), np.where(found, at, best_end)
            cut = ~on
            if not cut.any():
                continue
            lost = cut & (best < 0)
            stuck[word[lost]] = True
            good = cut & ~lost
            taken[start[good]] = best[good]
            start, at = np.where(good, best_end, start), np.where(good, best_end, at)
            best = np.where(good, -1, best)
            live = ~(lost | (good & (start == stop)))
            if not live.all():
                word, start, stop, at, node, best, best_end = (x[live] for x in (word, start, stop, at, node, best, best_end))
        owner = np.repeat(np.arange(len(words)), np.diff(bounds))
        at = np.flatnonzero((taken >= 0) & ~stuck[owner])
        return taken[at], owner[at], stuck

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of all words at a time, as tokens and the word of each: in every round each word takes its leftmost pair of lowest rank."""
        codes, bounds = self.codes(words)
        owner = np.repeat(np.arange(len(words)), np.diff(bounds))
        ids = self.unit[codes]
        last = bounds[1:] - 1  # the mark; the character in front of it, if any, makes one unit with it
        pair = last[np.diff(bounds) > 1]
        ids[pair - 1], ids[pair] = self.last_unit[codes[pair - 1]], -1
        ids, owner = ids[ids >= 0], owner[ids >= 0]
        none = np.iinfo(np.int64).max

        def rated(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank of the pair that starts at each place, and the token it makes."""
            inner = at + 1 < len(ids)
            inner[inner] = owner[at[inner]] == owner[at[inner] + 1]
            rank, made = np.full(len(at), none), np.zeros(len(at), np.int64)
            rank[inner], made[inner] = self.pair_merge(ids[at[inner]], ids[at[inner] + 1])
            return rank, made

        done_ids, done_owner = [ids[:0]], [owner[:0]]
        rank, made = rated(np.arange(len(ids)))
        while len(ids):
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(head, len(ids)))
            lowest = np.minimum.reduceat(rank, head)
            if (over := lowest == none).any():
                over = np.repeat(over, size)
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, rank, made = (x[~over] for x in (ids, owner, rank, made))
                continue
            at = np.flatnonzero(rank == np.repeat(lowest, size))
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, rank, made = (x[keep] for x in (ids, owner, rank, made))
            at = at - np.arange(len(at))
            near = np.concatenate([at, at[at > 0] - 1])
            rank[near], made[near] = rated(near)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def pair_merge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair as a merge (a large number where there is none) and the token it makes."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max), self.pair_made[at]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pair_merge(a, b)[0]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined strings of each pair gives just that pair.

        Time runs backwards: of the tokens that touch at the border, the one merged later is taken apart, and until its
        merge nothing may have joined the two at the border. Of equal ranks the left one was merged first.
        """
        ok = self.whole[a] & self.whole[b] & (self.pair_rank(a, b) == np.iinfo(np.int64).max)
        at = np.flatnonzero(ok)
        u, v = a[at].copy(), b[at].copy()
        while len(at):
            ru, rv = self.rank[u], self.rank[v]
            done = (ru < 0) & (rv < 0)
            at, u, v, ru, rv = (x[~done] for x in (at, u, v, ru, rv))
            from_right = rv >= ru
            until = np.where(from_right, rv, ru)
            u, v = np.where(from_right, u, self.right[u]), np.where(from_right, self.left[v], v)
            cross = self.pair_rank(u, v)
            bad = np.where(from_right, cross <= until, cross < until)
            ok[at[bad]] = False
            at, u, v = at[~bad], u[~bad], v[~bad]
        return ok

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that end with the word-end mark, each word's as the bytes of 32-bit numbers."""
        short = np.array([len(w) <= LONG_WORD for w in words], bool)
        if not short.all():
            out = [b"" if few else np.array(self.encode_word(w), np.int32).tobytes() for few, w in zip(short.tolist(), words)]
            at = np.flatnonzero(short).tolist()
            for i, ids in zip(at, self.encode_words([words[i] for i in at])):
                out[i] = ids
            return out
        flat, owner, failed = self.propose_all(words)
        if len(flat) > 1:
            inner = owner[1:] == owner[:-1]
            good = self.compatible(flat[:-1][inner], flat[1:][inner])
            failed[owner[1:][inner][~good]] = True
        failed[owner[~self.whole[flat]]] = True
        again = np.flatnonzero(failed)
        exact, whose = self.merge_all([words[i] for i in again.tolist()])
        keep = ~failed[owner]
        flat, owner = np.concatenate([flat[keep], exact]), np.concatenate([owner[keep], again[whose]])
        order = np.argsort(owner, kind="stable")
        packed = flat[order].astype(np.int32).tobytes()
        at = (4 * np.searchsorted(owner[order], np.arange(len(words) + 1))).tolist()
        return [packed[a:b] for a, b in zip(at[:-1], at[1:])]

    def encode_word(self, word: str) -> list[int]:
        """As ``encode_words``, for one word of any length."""
        got = self.propose(word)
        flat = np.array(got or [], np.int64)
        good = got is not None and self.whole[flat].all() and self.compatible(flat[:-1], flat[1:]).all()
        return got if good else self.merge(word)


class Encoder:
    """Texts to ids, with a bounded memory of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, self.marks(vocabulary)
        self.before: dict = {}
        self.bytes = dict(enumerate(byte_chars()))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None

    @staticmethod
    def marks(vocabulary: Vocabulary) -> dict:
        return {i: np.array([i], np.int32).tobytes() for i in vocabulary.special.values()}

    def words(self, text: str) -> list:
        """Words of a text in order; an id stands for a special token."""
        out: list = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.v.special:
                out.append(self.v.special[part])
            elif part:
                # Lower case goes by single characters, without the rule for a sigma at the end of a word.
                out += SPLIT.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as the bytes of 32-bit numbers."""
        cut = [self.words(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.before, self.known = self.known, self.marks(self.v)
        known, before = self.known, self.before
        unseen = set(chain.from_iterable(cut)).difference(known)
        again = unseen.intersection(before)
        known.update((w, before[w]) for w in again)
        new = list(unseen - again)
        spelled = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes) + END for w in new]
        known.update(zip(new, self.v.encode_words(spelled)))
        return [b"".join(map(known.__getitem__, ws)) for ws in cut]


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """From a file on the driver; by default the public word vocabulary of the box."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= SLICE_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _free(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in names]


def shared(spark: SparkSession, vocabulary: Vocabulary) -> Broadcast:
    """The vocabulary (of the file's size) for all tasks, as bytes that need no installed package; see ``worker``."""
    return spark.sparkContext.broadcast({"packed": cloudpickle.dumps(vocabulary)})


def worker(held: Broadcast) -> tuple[Encoder, np.ndarray]:
    """The encoder and the tokens by id. A Python worker unpacks them once and keeps them for its later tasks."""
    got = held.value
    if "encoder" not in got:
        v = cloudpickle.loads(got.pop("packed"))
        got["tokens"] = np.array([v.text.get(i) for i in range(max(v.text) + 1)], object)
        got["encoder"] = Encoder(v)
    return got["encoder"], got["tokens"]


def joined(tokens: np.ndarray, ids: np.ndarray) -> str:
    return " ".join(filter(None, tokens[ids].tolist()))


def encode(df: DataFrame, vocabulary: Vocabulary, *, text: str = "text", decoded: bool = False) -> DataFrame:
    """All columns of ``df`` and ``ids`` (array of int), the ids of the whole text; a null text is empty.

    With ``decoded`` the text that ``decode`` makes of the ids is added in the same pass. Rows stay where they are: nothing
    is shuffled. Columns of these names are replaced. Special tokens that stand in a text get their ids, as in the usual
    encoder.
    """
    added = ["ids", "decoded"] if decoded else ["ids"]
    keep = df.select(*_free(df, *added), F.col(text).alias("_text"))
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]
    schema = T.StructType([*keep.schema.fields[:-1], *fields[: len(added)]])
    held, names = shared(df.sparkSession, vocabulary), schema.names

    def run(batches):
        enc, tokens = worker(held)
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                batch = whole.slice(at, 5000)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                for a, b in slices(texts):
                    packed = enc.packed(texts[a:b])
                    ends = np.cumsum([0, *map(len, packed)]).astype(np.int32) // 4
                    flat = np.frombuffer(b"".join(packed), np.int32)
                    made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                    if decoded:
                        made.append(pa.array([joined(tokens, flat[x:y]) for x, y in zip(ends[:-1], ends[1:])], pa.string()))
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *made], names=names)

    return keep.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All columns of ``df`` and ``decoded``: the tokens of ``ids`` joined by spaces, special tokens too, unknown ids left out.

    The vocabulary file names no decoder, so word ends stay visible. Null ids give an empty text.
    """
    keep = df.select(*_free(df, "decoded"))
    columns, at = keep.columns, keep.columns.index("ids")
    schema = T.StructType([*keep.schema.fields, T.StructField("decoded", T.StringType())])
    held = shared(df.sparkSession, vocabulary)

    def run(batches):
        _, tokens = worker(held)
        for batch in batches:
            lists = (x.values.to_numpy() if x.is_valid else np.zeros(0, int) for x in batch.column(at))
            known = (x[(x >= 0) & (x < len(tokens))] for x in lists)
            out = pa.array([joined(tokens, x) for x in known], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*columns, "decoded"])

    return keep.mapInArrow(run, schema)


def digests(coded: DataFrame) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.encode(joined, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op3_bpe(spark, sf_dir):
    """Digests of ids and decoded text of every document; null and empty texts have no ids, repeated rows equal ones."""
    v = load_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, v, decoded=True))
