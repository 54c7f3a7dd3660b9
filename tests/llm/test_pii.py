"""Base spans against plain patterns, and the trees on respelled data."""

import random
import re

import numpy as np
from pulseloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def fine(kind, s):
        d = [int(c) for c in s if c.isascii() and c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            twice = [x * 2 - 9 * (x > 4) for x in d[-2::-2]]
            return 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(twice)) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if fine(k, m.group())] for k, p in PLAIN.items()}


def test_base_spans():
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choices("0123456789" * 2 + "..@@+- ()abA%_é\n", k=rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000, "1 " * 150_000):
        pii.spans_of(text, None)


def test_query_is_the_plain_form_on_all_rows(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    import hashlib

    for r in pii.op7_pii(spark, "/root/testdata/sf0.001").collect():
        want = plain_spans(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS]
        assert not text or set(text.split(",")) <= set(r["spans"].split(","))


def test_trees_find_respelled_data_and_leave_numbers_alone(spark):
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    found = lambda t: [(k, t[a:b]) for k, a, b, base, _ in pii.spans_of(t, model) if not base]
    assert ("phone", "(426) 555-1234") in found("please call (426) 555-1234 today")
    assert ("email", "jane.doe [at] mail [dot] example [dot] com") in found("write to jane.doe [at] mail [dot] example [dot] com soon")
    for clean in ("version 2.0.14 of 2021", "ids 4716 3948 and 12, 17", "we met at noon and sat at home", "4716394817263541 rows"):
        assert found(clean) == []


def test_frequent_forms_are_still_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(5)
    n = lambda k: "".join(rng.choices("123456789", k=k))
    rows, forms = [], {}
    for i, r in enumerate(docs):
        text = r["text"] or ""
        if i % 3 == 0:
            phone = (f"({n(3)}) {n(3)}-{n(4)}", f"0{n(2)} {n(4)} {n(4)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{n(3)} {n(7)}")[i // 3 % 4]
            mail = f"jane{i} [at] mail [dot] com"
            text += f"\nplease call {phone} today\nwrite to {mail} soon"
            forms[i] = (phone, mail)
        rows.append((i, text))
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    hit = {k: 0 for k in range(5)}
    for i, (phone, mail) in forms.items():
        got = {rows[i][1][a:b] for _, a, b, _, _ in pii.spans_of(rows[i][1], model)}
        hit[i // 3 % 4] += phone in got
        hit[4] += mail in got
    assert hit[4] > 0.95 * len(forms) and all(hit[k] > 0.9 * len(forms) / 4 for k in range(4)), hit


def test_calibration_rises_and_is_right_on_held_out_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 4))
    y = (rng.random(6000) < 1 / (1 + np.exp(-3 * x[:, 0] * (x[:, 1] > 0)))).astype(int)
    model = pii.Boosted(x[:4000], y[:4000])
    p = model.probability(x[4000:])
    assert (np.diff(model.steps[1]) >= 0).all()
    assert abs(y[4000:][p > 0.9].mean() - p[p > 0.9].mean()) < 0.05


def test_redaction_joins_overlaps():
    assert pii.redacted("ab 1.2.3.4 cd", [("ip", 3, 10, True, 1.0), ("card", 5, 10, False, 1.0)]) == "ab [IP] cd"


def test_odd_rows(odd_docs, no_docs):
    rows = pii.find_spans(odd_docs, None).select("doc_id", "text", "spans", "redacted").collect()
    assert len(rows) == odd_docs.count()
    assert all(r["spans"] == [] and r["redacted"] == r["text"] for r in rows)
    assert pii.fit(no_docs) is None and pii.find_spans(no_docs, None).count() == 0
