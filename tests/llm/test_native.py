"""Sharding, chat formatting, url filters and licence scans on small fixtures, and the pipeline's stages."""

import re
from collections import Counter

import pytest
from pulseloom.llm import chat, licenses, sharding, urls
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 10, 97, 1000])
def test_every_place_once(spark, n):
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 7).alias("p")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    if n >= 97:
        assert sum(r["id"] == r["p"] for r in rows) < n / 10


def test_shards_are_even_gapless_and_reproducible(spark):
    df = spark.range(1003).select(F.col("id").alias("doc_id"), F.format_string("text %d", "id").alias("text"))
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(df).collect()}
    two = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(df.repartition(5)).collect()}
    assert one == two
    sizes = Counter(s for s, _ in one.values())
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(k for x, k in one.values() if x == s) == list(range(sizes[s]))


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, 4).collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [2, 2, 2, 3]
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 1} == {(16, 0)}
    assert sharding.shard_documents(no_docs).count() == 0
    with pytest.raises(ValueError, match="n_shards"):
        sharding.shard_documents(odd_docs, 0)


TURNS = "conv_id long, turn long, role string, text string, segments string"


def test_texts_come_back_and_each_reply_is_trained_once(spark):
    nasty = ["", "<|", "\\", "\\<|im_end|>\n", "a<", "|>x", "<|im_start|>assistant\nhi<|im_end|>\n", "<\\|", "\n\n", "é\U0001f600", "\\\\<\\|"]
    rows = [(1, i, ("user", "assistant", "sy\\s<|\nx")[i % 3], t, "clash") for i, t in enumerate(nasty * 2)]
    df = spark.createDataFrame(rows + [(2, 0, "user", "no reply", "")], TURNS)
    out = chat.format_conversations(df)
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r[2], r[3]) for r in rows]
    assert back[1]["losses"] == [r[3] for r in rows if r[2] == "assistant"] and back[2]["losses"] == []
    examples = chat.explode_examples(out).orderBy("example").collect()
    whole = {r["conv_id"]: "".join(s["text"] for s in r["segments"]) for r in out.collect()}
    end = chat.END + "\n"
    assert len(examples) == len(back[1]["losses"])
    assert all(whole[1].startswith(e["prompt"] + e["target"] + end) and e["prompt"].endswith("<|im_start|>assistant\n") for e in examples)
    assert back[1]["formatted_chars"] == sum(len(e["prompt"] + e["target"] + end) for e in examples)


def test_odd_turns(spark):
    rows = [(None, 0, "user", "a", ""), (None, 1, "assistant", None, ""), (1, None, None, None, ""), (1, 0, "assistant", "b", ""), (1, 0, "assistant", "b", "")]
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, TURNS))).collect()}
    assert [tuple(t) for t in back[None]["turns"]] == [("user", "a"), ("assistant", "")] and back[None]["losses"] == [""]
    assert [tuple(t) for t in back[1]["turns"]] == [("", ""), ("assistant", "b"), ("assistant", "b")]
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversation_takes_linear_space(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}", "") for i in range(5000)]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    r = out.select(F.size("examples").alias("n"), F.expr("examples[2499].context_chars").alias("c"), F.expr("aggregate(segments, 0, (a, s) -> a + length(s.text))").alias("all")).first()
    assert r["n"] == 2500 and r["c"] == r["all"] - len("turn 4999") - len(chat.END) - 1


def judged(spark, rows):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(rows)], "page_id long, url string, host string")
    return [tuple(r) for r in urls.filter_urls(df).orderBy("page_id").select("host", "path", "rule", "verdict", "pattern").collect()]


def test_url_rules(spark):
    got = judged(spark, [
        "https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "http://b.com/de/",
        "http://b.com/DE/", "http://org", "http://x.net?org/", None, "no scheme", "ftp://spam-farm.example.net/a", "http://spam-farm.example.org/a", "http://my-spam-farm.net/", "://", "a://b://c",
    ])
    assert got == [
        ("a.example.org", "/es/1", "example.org/es/", "block", None), ("example.org", "/en/12", "example.org/en/1", "block", None),
        ("example.org", "/en/2", "org/", "allow", None), ("notexample.org", "/es/", "org/", "allow", None), ("b.com", "/de/", "com/de/", "block", None),
        ("b.com", "/DE/", None, "allow", None), ("org", "", None, "allow", None), ("x.net", "", None, "allow", None), ("", "", None, "allow", None),
        ("", "", None, "allow", None), ("spam-farm.example.net", "/a", None, "block", "spam-farm"), ("spam-farm.example.org", "/a", "org/", "allow", None),
        ("my-spam-farm.net", "/", None, "allow", None), ("", "", None, "allow", None), ("b:", "//c", None, "allow", None),
    ]
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_index_finds_what_all_patterns_find(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rules = [*urls.SITE_RULES, *urls.PATTERN_RULES]
    for r in urls.filter_urls(df).collect():
        fits = [x for x in rules if re.search(x.pattern(), r["host"] + r["path"])]
        sites = [x for x in fits if isinstance(x, urls.HostPath)]
        assert r["rule"] == (max(sites, key=lambda x: len(x.rule)).rule if sites else None)
        if not sites:
            assert (r["verdict"] == "block") == any(x.action == "block" for x in fits)


def test_licences_are_found_and_inherited(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = spark.createDataFrame([
        ("a/LICENSE", mit, 1), ("a/x.txt", "plain words here", 1), ("a/b/y.txt", "more plain words", 1), ("a/b/c/COPYING", gpl, 1), ("a/b/c/z.txt", "text", 1),
        ("a/b/own.txt", "long text about many other things that have nothing to do with it at all\n" + gpl + "\nand more words that follow", 1), ("top.txt", "this work is under the public", 1),
        ("ab/LICENSE2", None, 1), ("ab/c.txt", "", 1), (None, mit, 1),
    ], "path string, text string, score int")
    got = {r["path"]: (r["license"], r["license_from"], r["is_license_file"]) for r in licenses.scan_licenses(files).collect()}
    assert got == {
        "a/LICENSE": ("MIT", None, True), "a/x.txt": ("MIT", "a", False), "a/b/y.txt": ("MIT", "a", False), "a/b/c/COPYING": ("GPL-3.0", None, True),
        "a/b/c/z.txt": ("GPL-3.0", "a/b/c", False), "a/b/own.txt": ("GPL-3.0", None, False), "top.txt": (None, None, False), "ab/LICENSE2": (None, None, False),
        "ab/c.txt": (None, None, False), None: (None, None, False),
    }
    assert licenses.scan_licenses(files.limit(0)).count() == 0


def test_licence_lines_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = {"MIT License": "MIT", "GNU General": "GPL-3.0", "Apache License": "Apache-2.0", "CC BY-NC": "CC-BY-NC-4.0", "All rights reserved": "proprietary"}
    want = {r["doc_id"]: next((v for k, v in said.items() if k in r["text"]), None) for r in docs.collect()}
    got = {r["doc_id"]: r["own_license"] for r in licenses.op1_licenses(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


@pytest.mark.parametrize("times", [10, 1000])
def test_headers_with_extra_words_keep_their_licence_at_any_size(spark, times):
    header = "// This file is licensed under the Apache License, Version 2.0."
    texts = [header + "\nint x;", "# Copyright Foo. Licensed under the Apache License, Version 2.0.\nx = 1", "this file is about foo"]
    texts += [f"this file is one of {i} that hold the other words" for i in range(7)]
    files = spark.createDataFrame([(f"d{i}/x", t) for i, t in enumerate(texts)], "path string, text string")
    many = files.crossJoin(spark.range(times)).select(F.concat_ws("/", F.col("id").cast("string"), "path").alias("path"), "text")
    got = licenses.scan_licenses(many).select(F.substring_index("path", "/", -2).alias("p"), "own_license", "own_score").distinct().collect()
    assert len(got) == len(texts)
    score = {r["p"]: (r["own_license"], r["own_score"]) for r in got}
    assert score["d0/x"][0] == score["d1/x"][0] == "Apache-2.0" and all(score[f"d{i}/x"] == (None, None) for i in range(2, 10))


def test_full_texts_and_wrapped_headers(spark):
    texts = {p.name: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    mit = "MIT License\n\nCopyright (c) 2019 Jane Doe\nAll rights reserved.\n\n" + texts["MIT.txt"].split("\n\n", 2)[2]
    header = "".join(f"# {x.strip()}\n" for x in texts["Apache-2.0.header.txt"].splitlines())
    code = "".join(f"value{i} = other{i}(thing{i})\n" for i in range(300))
    wrapped = "/*\n   Released under\n   the MIT\n   License.\n*/\n"
    rows = [
        ("m/LICENSE", mit), ("m/x.py", code), ("a/y.py", header + "\n" + code), ("a/z.py", code), ("w/v.c", wrapped + code),
        ("b/COPYING", texts["BSD-3-Clause.txt"]), ("b/c/t.py", code), ("g/COPYING", texts["GPL-3.0.txt"]), ("l/COPYING", texts["LGPL-2.1.txt"]),
        ("p/LICENSE", texts["Apache-2.0.txt"]), ("g2/COPYING", texts["GPL-2.0.txt"]),
    ]
    got = {r["path"]: (r["license"], r["license_from"], r["is_license_file"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "m/LICENSE": ("MIT", None, True), "m/x.py": ("MIT", "m", False), "a/y.py": ("Apache-2.0", None, False), "a/z.py": (None, None, False),
        "w/v.c": ("MIT", None, False), "b/COPYING": ("BSD-3-Clause", None, True), "b/c/t.py": ("BSD-3-Clause", "b", False),
        "g/COPYING": ("GPL-3.0", None, True), "l/COPYING": ("LGPL-2.1", None, True), "p/LICENSE": ("Apache-2.0", None, True), "g2/COPYING": ("GPL-2.0", None, True),
    }


def test_pipeline_stages_on_their_own_input(spark):
    import corpus_pipeline as cp
    from pulseloom.llm import bpe, decontam, minhash, pii, quality
    from pulseloom.session import materialize

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(materialize(stage(spark, seen[-1], d)))
    assert all(x.columns == columns for x in seen[1:-1])
    labels = spark.read.parquet(f"{d}/labels.parquet")
    assert ids(seen[1]) == ids(quality.judge(docs, labels).filter("kept")) != ids(docs)
    assert ids(seen[2]) == ids(minhash.near_copies(seen[1]).filter("kept"))
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    assert ids(seen[3]) == ids(decontam.flag_leaks(seen[2], items).filter("size(leaks) = 0"))
    assert ids(decontam.flag_leaks(seen[3], items).filter("size(leaks) > 0")) == set()
    before = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    model = pii.fit(seen[3])
    for r in seen[4].collect():
        assert r["text"] == pii.redacted(before[r["doc_id"]], pii.spans_of(before[r["doc_id"]], model)) and r["n_chars"] == len(r["text"])
    enc = bpe.Encoder(bpe.load_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    assert {r["doc_id"]: r["ids"] for r in seen[5].collect()} == {i: enc.encode([t])[0] for i, t in texts.items()}
    assert sorted(r["doc_id"] for r in cp.run(spark, d).collect()) == sorted(ids(seen[5]))
