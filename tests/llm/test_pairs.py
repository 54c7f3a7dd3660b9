"""Near copies, repeated passages and leaked test items against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pulseloom.llm import decontam, minhash, repeats
from pulseloom.llm.components import components
from pulseloom.llm.tokens import Family, Words

SF = "/root/testdata/sf0.001"


def words(text, lower=False):
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t, lower=True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_groups_chains_and_edges_of_the_threshold(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for _ in range(6):  # copies that differ by so much that some link only through others
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 200]))]
        for n in [0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 8]:
            rows.append((i, edited(rng, base, n * len(base) // 200 or (n > 0))))
            i += 1
    chain = [f"c{k}" for k in range(400)]
    for start in range(0, 120, 12):  # each overlaps the next one
        rows.append((i, " ".join(chain[start : start + 150])))
        i += 1
    shared = " ".join(f"p{k}" for k in range(60))
    for _ in range(40):  # a common passage, but no near copies
        rows.append((i, shared + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))))
        i += 1
    exact = " ".join(f"e{k}" for k in range(11))  # 7 shingles; with one word more 8: 7/8
    rows += [(i, exact), (i + 1, exact + " more"), (i + 2, "x y"), (i + 3, "X  Y"), (i + 4, "y x"), (i + 5, None), (i + 6, ""), (i + 7, " \t")]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def test_near_copies_of_odd_rows(odd_docs, no_docs):
    rows = minhash.near_copies(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in rows)
    assert minhash.near_copies(no_docs).count() == 0


def test_cells_of_one_member_find_the_same_links(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    rows = [(i, edited(rng, base, rng.randrange(8))) for i in range(60)]
    monkeypatch.setattr(minhash, "CELL", 3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: v[1] for k, v in plain_components(rows).items()}


def test_min_and_max_estimate_without_bias():
    rng = np.random.default_rng(5)
    minmax = minhash.MinMax()
    for share in (0.2, 0.5, 0.8):
        both = rng.integers(0, 1 << 63, int(4000 * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, int(2000 * (1 - share)), dtype=np.uint64)])) for _ in range(2))
        sig = minmax.signatures([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.1


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(7, i) for i in range(8, 60)] + [(100, 101), (101, 102), (102, 100), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 200 for i in range(200, 261)} | {i: 7 for i in range(7, 60)} | {i: 100 for i in (100, 101, 102)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_cover(texts):
    ws = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in ws for i in range(len(w) - 34))
    out = []
    for w in ws:
        hit = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append((len(w), len(hit), " ".join(x for i, x in enumerate(w) if i not in hit)))
    return out


def test_repeats_in_texts_of_small_alphabets(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        al = [str(i) for i in range(rng.choice([1, 2, 3, 40]))]
        pool = [[rng.choice(al) for _ in range(rng.choice([20, 36, 50, 120]))] for _ in range(3)]
        t = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p))
            t += rng.choice([p, p[a:], [rng.choice(al) for _ in range(rng.randint(0, 30))], [al[0]] * rng.randint(0, 90)])
        texts.append(rng.choice([" ", "\n", "  \t"]).join(t))
    texts += [None, "", texts[3], texts[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in repeats.remove_repeats(df).collect()}
    assert got == dict(enumerate(plain_cover(texts)))


def test_blocks_and_parts_do_not_matter(spark, monkeypatch):
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([f"a{rng.randrange(10**6)}" for _ in range(40)] + passage + [f"b{rng.randrange(10**6)}" for _ in range(40)]) for _ in range(20)]
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(repeats, "PART_BYTES", 500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in repeats.remove_repeats(df).collect()}
    assert got == dict(enumerate(plain_cover(texts))) and all(v[1] == 50 for v in got.values())


def test_equal_words_get_equal_symbols_inside():
    """A symbol whose deciding words are inside a repeat stands at the same place in both copies."""
    rng = random.Random(13)
    for _ in range(200):
        al = [str(i) for i in range(rng.choice([2, 3, 30]))]
        mid = [rng.choice(al) for _ in range(60)]
        edge = lambda: [rng.choice(al) for _ in range(rng.randint(0, 20))]
        a, b = edge(), edge()
        block = repeats.Block(pa.array([" ".join(a + mid + edge()), " ".join(b + mid + edge())]))
        name, low, high = block.symbols()
        inside = [
            {(int(n), lo - at, hi - at) for n, lo, hi in zip(name, low, high) if lo >= at and hi <= at + 60}
            for at in (block.first[0] + len(a), block.first[1] + len(b))
        ]
        assert inside[0] == inside[1]



def test_windows_that_are_left_hash_their_own_words_only(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["ab", "c", "déf", "x" * 300, "9"], k=k)) for k in (0, 34, 35, 200, 90)]
    block = repeats.Block(pa.array(texts))
    starts = np.flatnonzero(block.has_window())
    at = np.array(sorted(rng.sample(starts.tolist(), 12) + [starts[0], starts[-1]]))
    at = np.unique(at)
    want = [f.windows(Words(pa.array(texts)).numbers(f), repeats.WINDOW)[at].tolist() for f in (Family(8), Family(88))]
    hashed, numbers = [], Words.numbers
    monkeypatch.setattr(Words, "numbers", lambda self, f, only=None: hashed.append(only.sum()) or numbers(self, f, only=only))
    assert [x.tolist() for x in block.window_numbers(at)] == want
    assert hashed == [repeats.covered(block.n, at).sum()] * 2


def test_repeats_of_odd_rows(odd_docs, no_docs):
    rows = repeats.remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["n_removed"] == 0 for r in rows if r["doc_id"] != 4)
    assert repeats.remove_repeats(no_docs).count() == 0


def test_every_planted_item_is_found_and_nothing_else(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()}
    flat = lambda t: " " + " ".join(re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", t.lower())) + " "
    flat_docs, flat_items = {i: flat(t) for i, t in docs.items()}, {j: flat(t) for j, t in items.items()}
    want = {(i, j) for i, t in flat_docs.items() for j, s in flat_items.items() if s in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op4_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and len(want) > 10


def test_block_maxima_lose_nothing(spark):
    """All passages above the threshold, against scoring every item on every passage."""
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    items, n, mean = next(decontam.load_items(spark.read.parquet(f"{SF}/benchmark.parquet")))
    block = decontam.blocks_of(items, n, mean)[0]
    w = decontam.Words(pa.array(docs), decontam.IS_MARK)
    numbers = w.numbers(block.family, lower=True)
    got = {(t, j, low): s for t, j, s, low, _ in block.hits(numbers, w.first)}
    want = {}
    for t in range(len(docs)):
        a, b = w.first[t], w.first[t + 1]
        for low in range(a, b, block.stride):
            terms = np.isin(block.vocab, numbers[low : min(low + 2 * block.stride, b)])
            for j, s in enumerate(block.weight[terms].astype(np.float64).sum(axis=0)):
                if s >= decontam.SCORE:
                    want[t, j, int(low)] = float(s)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_slices_of_items_add_up(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda: sorted((r["doc_id"], x["item_id"]) for r in decontam.flag_leaks(docs, items).collect() for x in r["leaks"])
    want = rows()
    monkeypatch.setattr(decontam, "SLICE_WORDS", 400)
    assert rows() == want


def test_leaks_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (None, "a b c"), (2, ""), (3, "one two three."), (4, "word5x5 word6x6 word7x7 word8x8. word9x9 word10x10")], "item_id long, text string")
    rows = decontam.flag_leaks(odd_docs, items).select("doc_id", "leaks").collect()
    assert len(rows) == odd_docs.count()
    assert {(r["doc_id"], x["item_id"]) for r in rows for x in r["leaks"]} == {(5, 3), (4, 4)}
    assert decontam.flag_leaks(no_docs, items).count() == 0
    assert all(r["leaks"] == [] for r in decontam.flag_leaks(odd_docs, items.limit(0)).select("leaks").collect())


def regular_words():
    """Two different words whose letters follow one rule with a and b exchanged; sums of powers cannot tell them apart."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_regular_words_are_different_words(spark):
    t, u = regular_words()
    for seed in (4, 6, 8, 88):
        a, b = Words(pa.array([f"{t} {u}"])).numbers(Family(seed))
        assert a != b
    rows = [(1, t), (2, u)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}
    lead = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{lead} {t}"), (2, f"{lead} {u}")]
    out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in out] == [0, 0]
    both = repeats.remove_repeats(spark.createDataFrame([*rows, (3, rows[0][1])], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in both} == {1: 35, 2: 0, 3: 35}


def test_word_numbers_beyond_the_table():
    rng = random.Random(9)
    long = ["".join(rng.choice("abc") for _ in range(n)) for n in (255, 256, 257, 300, 5000)]
    near = [w[:-1] + ("x" if w[-1] != "x" else "y") for w in long] + ["x" + w[1:] for w in long]
    words = [*long, *near, *long]
    n = Words(pa.array([" ".join(words)])).numbers(Family(3))
    assert n[: len(long)].tolist() == n[-len(long) :].tolist() and len(set(n.tolist())) == len(set(words))


def test_texts_that_share_an_id_are_judged_each_on_its_own(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(rng.choice("klmnop") * rng.randint(1, 9) + str(rng.randrange(99)) for _ in range(60)) for _ in range(3))
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, c), (9, c), (3, b + " most")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_copies(df).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5), (8, 3), (9, 9), (9, 9)]
    stays = sorted((r["doc_id"], r["text"]) for r in minhash.without_copies(df).collect())
    assert stays == sorted([(5, a), (3, b + " most"), (9, c)])


def test_heavy_nodes(spark, monkeypatch):
    from pulseloom.llm import components as c

    monkeypatch.setattr(c, "LEAST_HEAVY", 5)
    monkeypatch.setattr(c, "MOST_HEAVY", 2)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 320)] + [(150, 300), (400, 401)]
    got = {r["node"]: r["label"] for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(200), *range(300, 321)]} | {400: 400, 401: 400}


def test_a_stray_makes_every_member_travel_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 10)
    sketch = [0] * (minhash.SKETCH_BITS * minhash.SKETCH_WORDS)
    far = [-1] * len(sketch)
    rows = [(1, i, 0, 50, sketch, 0.1, True) for i in range(100)] + [(1, 100, 100, 50, far, 0.9, False), (2, 7, 7, 50, sketch, 0.0, True)]
    members = spark.createDataFrame(rows, "key long, rep long, l long, n long, s array<long>, d double, main boolean")
    seen = []
    monkeypatch.setattr(minhash, "materialize", lambda df: seen.append(df) or df)
    sets = spark.createDataFrame([(i, b"") for i in range(101)], "rep long, bag binary")
    assert minhash.links_across(members, sets).count() == 0
    assert seen[0].count() == 0  # no member needs its full set
