"""Encoding against the public library, on made-up and given texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from pulseloom.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(vocabulary)


def test_given_texts(spark, vocabulary, library):
    rows = bpe.decode(bpe.encode(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), vocabulary), vocabulary)
    for r in rows.select("text", "ids", "decoded").collect():
        want = library.encode(r["text"], add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    both = bpe.encode(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), vocabulary, decoded=True)
    assert sorted(both.select("doc_id", "ids", "decoded").collect()) == sorted(rows.select("doc_id", "ids", "decoded").collect())


def test_random_letters(encoder, library):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdehinorst'1é", k=rng.randint(1, 16))) for _ in range(5000)]
    assert encoder.encode(words) == [x.ids for x in library.encode_batch(words, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8", categories=["L", "N", "P", "S", "Z", "M"], max_codepoint=0x2FFF), st.sampled_from(" \n\t<|>'sΣİ")), max_size=60))
def test_any_text(encoder, library, text):
    assert encoder.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_long_words(encoder, library):
    for text in ("a<|endoftext|>b <|startoftext|>", "<|endoftext|", "ab" * 5000, "x" * 30_000):
        assert encoder.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_compatible_pairs_are_those_that_merging_keeps(vocabulary):
    import numpy as np

    rng = random.Random(2)
    tokens = [t for t in vocabulary.ids if not t.endswith(bpe.END)]
    ends = [t for t in vocabulary.ids if t.endswith(bpe.END)]
    pairs = [(rng.choice(tokens), rng.choice(ends)) for _ in range(3000)]
    ids = [(vocabulary.ids[a], vocabulary.ids[b]) for a, b in pairs]
    got = vocabulary.compatible(*map(np.array, zip(*ids)))
    assert got.tolist() == [vocabulary.merge(a + b) == [i, j] for (a, b), (i, j) in zip(pairs, ids)]


def test_odd_rows(spark, odd_docs, no_docs, vocabulary):
    out = bpe.decode(bpe.encode(odd_docs, vocabulary), vocabulary)
    rows = out.select("doc_id", "ids", "decoded").collect()
    assert len(rows) == odd_docs.count()
    assert all(r["ids"] == [] and r["decoded"] == "" for r in rows if r["doc_id"] in (1, 2, 3))
    assert bpe.encode(no_docs, vocabulary).count() == 0


def test_words_that_are_forgotten_are_encoded_alike(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 20)
    enc, rng = bpe.Encoder(vocabulary), random.Random(7)
    words = ["".join(rng.choices("aehinorst", k=5)) for _ in range(60)]
    for _ in range(30):
        text = " ".join(rng.choices(words, k=25))
        assert enc.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_words_are_cut_and_merged_all_at_a_time(vocabulary, monkeypatch):
    import numpy as np

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdehinorst", k=rng.randint(1, bpe.LONG_WORD + 9))) + bpe.END for _ in range(400)]
    words += ["ab" + bpe.END, "a" + bpe.END, bpe.END, "aaaa" + bpe.END, "一" + bpe.END]
    want = [vocabulary.merge(w) for w in words]
    tokens, owner, stuck = vocabulary.propose_all(words)
    assert [None if s else tokens[owner == i].tolist() for i, s in enumerate(stuck)] == [vocabulary.propose(w) for w in words]
    tokens, owner = vocabulary.merge_all(words)
    assert [tokens[owner == i].tolist() for i in range(len(words))] == want
    assert vocabulary.encode_words([]) == []

    merge, single = vocabulary.merge, []
    monkeypatch.setattr(vocabulary, "merge", lambda w: single.append(w) or merge(w))
    assert [np.frombuffer(x, np.int32).tolist() for x in vocabulary.encode_words(words)] == want
    assert single and all(len(w) > bpe.LONG_WORD for w in single)
