"""Personal data: fixed patterns, and overlapping candidates that boosted trees score by form and context."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.boosting import Boosted
from pulseloom.llm.common import table

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 8_000  # about so many documents give the labelled candidates
MAX_ROWS = 30_000  # and at most so many candidate rows are fitted on
PRECISION = 0.95  # calibrated probability from which a candidate is redacted
SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType()),
])

# The patterns of the base rules. Possessive forms and the look-behind leave out attempts that cannot match.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Candidates: forms that may be personal data. They may overlap each other.
LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}|@) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]{1,63}+){1,4}", re.I)),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ at [A-Za-z0-9-]{1,63}+(?: dot [A-Za-z0-9-]{1,63}+){1,4}", re.I)),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}+(?: ?(?:\[\.\]|\(\.\)|\.) ?[0-9]{1,3}+){3}(?![0-9.])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{3,6}+(?:[ ._/-]{0,2}+[0-9]{2,7}+){1,5}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:(?:00|\+)[1-9][0-9]{0,2}+[ .-]?)?(?:\(0?[0-9]{1,4}\)|[0-9]{1,5}+)(?:[ .-]{1,2}+|/|(?<=\)))[0-9]{2,8}+(?:[ .-]{1,2}+[0-9]{2,4}+){0,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:(?:00|\+)[0-9]{1,3}+[ .-]?|[0-9]{1,3}[ .-])?\(?[0-9]{3}+\)?[ .-]{0,2}+[0-9]{3}+[ .-]{1,2}+[0-9]{4}+(?![0-9])")),
)
HINTS = re.compile(r"\b(?:phone|tel|call|mobile|fax|card|visa|credit|pay|mail|contact|ip|server|host|from)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` so that long runs of letters cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Matches of the fixed rules; those that fail their check are dropped, and what they covered is not looked at again."""
    span = lambda r: [m.span() for m in r.finditer(text)]
    return {
        "email": emails(text),
        "ip": [(a, b) for a, b in span(IP) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text[a:b].split("."))],
        "card": [(a, b) for a, b in span(CARD) if 13 <= len(d := only_digits(text[a:b])) <= 19 and luhn(d)],
        "phone": [(a, b) for a, b in span(PHONE) if 9 <= len(only_digits(text[a:b])) <= 15] if "+" in text else [],
    }


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Loose matches that touch no base span."""
    if not re.search("[0-9@]|[Aa][Tt]", text):
        return []
    found = {(k, *m.span()) for k, r in LOOSE for m in r.finditer(text)}
    starts = np.array([a for a, _ in taken] or [0])
    ends = np.array([b for _, b in taken] or [0])
    free = lambda a, b: not ((starts < b) & (ends > a)).any()
    digits = lambda c: len(only_digits(text[c[1] : c[2]]))
    return sorted(c for c in found if free(c[1], c[2]) and (c[0] != "phone" or 7 <= digits(c) <= 15))


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Form and context of a span as numbers."""
    s, before, after = text[a:b], text[max(0, a - 30) : a], text[b : b + 10]
    d = only_digits(s)
    groups = re.findall("[0-9]+", s)
    char = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4
    return [
        KINDS.index(kind), len(s), len(d), float(luhn(d)) if 0 < len(d) < 30 else 0.0, len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0), max((int(g) for g in groups if len(g) < 6), default=0),
        len(set(d)), s.count("."), s.count("-"), s.count(" "), float("(" in s), float("@" in s),
        char(before[-1:]), char(after[:1]), float(bool(HINTS.search(before))), float("+" in before[-2:] + s[:1]),
        float(bool(re.search(r"(?:\bat\b|\[at\]|\(at\)).*(?:\bdot\b|\[dot\]|\(dot\))", s, re.I))), float(before[-1:] in "\"'#=_/"),
    ]


def variants(kind: str, s: str, rng: random.Random) -> list[tuple[str, int]]:
    """Other spellings of a true span (1), and look-alikes that are none (0)."""
    d = only_digits(s)
    if kind == "email":
        user, _, host = s.partition("@")
        at, dot = rng.choice([("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot ")])
        return [(user + at + host.replace(".", dot), 1), (f"{user} at {host.partition('.')[0]}", 0)]
    if kind == "ip":
        return [(s.replace(".", "[.]"), 1), (s.replace(".", " . "), 1), (".".join(str(rng.randint(0, 999) + 256) for _ in range(4)), 0), (f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", 0)]
    if kind == "card":
        off = d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10)
        cut = lambda x: ".".join(x[i : i + 4] for i in range(0, len(x), 4))
        return [(cut(d), 1), (off, 0), (cut(off), 0), (d[:10], 0)]
    nine = d[-10:]
    two, rest = nine[2:], nine[3:]
    national = [  # groupings of other countries, with the leading zero of the trunk
        f"0{nine[0]} {' '.join(nine[i : i + 2] for i in range(1, 9, 2))}", f"0{nine[:2]}/{two}", f"0{nine[:3]} {rest}", f"(0{nine[:2]}) {two[:4]} {two[4:]}",
        f"0{nine[:2]}-{two[:4]}-{two[4:]}", f"0{nine[:4]} {nine[4:]}", f"0{nine[:2]} {two[:4]} {two[4:]}",
    ]
    broken = [f"{nine[:1]}-{nine[1:2]}-{nine[2:]}", f"{nine[:5]}.{nine[5:]}", f"{nine[:3]} {nine[3:5]}", f"{rng.randint(1, 9)} {nine[:2]} {nine[2:4]} {nine[4:6]}"]
    return [
        *((x, 1) for x in national if len(nine) == 10), *((x, 0) for x in broken),
        (f"({nine[:3]}) {nine[3:6]}-{nine[6:]}", 1), (f"{nine[:3]}-{nine[3:6]}-{nine[6:]}", 1), (f"00{d[:-10]} {nine[:3]} {nine[3:6]} {nine[6:]}", 1),
        (nine, 0), (f"{nine[:4]} {nine[4:]}", 0), (f"{nine[:4]}-{nine[4:6]}-{nine[6:8]}", 0),
    ]


def breaks_rules(kind: str, s: str) -> bool:
    """Whether a loose match cannot be data of its kind, however it is spelled."""
    d = only_digits(s)
    if kind == "email":
        return not re.search(r"(?:dot|\.)[^A-Za-z0-9]*[A-Za-z-]{2,}$", s, re.I)
    if kind == "ip":
        return any(int(x) > 255 for x in re.findall("[0-9]+", s))
    if kind == "card":
        return not (13 <= len(d) <= 19 and luhn(d))
    return not 7 <= len(d) <= 15 or len(set(d)) < 3


def labelled(text: str) -> list[tuple[list[float], int]]:
    """Labelled rows out of one text, without human labels.

    Each base span is respelled in place: the spellings of the same data are positive, its look-alikes negative. What the
    loose patterns find elsewhere is negative only where it breaks a rule of its form; the rest may be personal data and
    is left out, so that a form does not become unlikely by being frequent.
    """
    base = base_spans(text)
    flat = sorted((a, b, k) for k, ss in base.items() for a, b in ss)
    rows = []
    for a, b, kind in flat:
        rng = random.Random(f"{kind}:{text[a:b]}")
        for s, y in variants(kind, text[a:b], rng):
            changed = text[max(0, a - 60) : a] + s + text[b : b + 60]
            at = min(a, 60)
            for k, x, z in candidates(changed, []):
                if x < at + len(s) and z > at:
                    whole = x <= at + 2 and z >= at + len(s) - 2 and x >= at - 2
                    rows.append((describe(changed, k, x, z), int(y and whole and k == kind)))
    rows += [(describe(text, k, a, b), 0) for k, a, b in candidates(text, [(a, b) for a, b, _ in flat]) if breaks_rules(k, text[a:b])]
    return rows


def fit(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, max_rows: int = MAX_ROWS) -> Boosted | None:
    """Trees from a bounded sample: documents by the hash of doc_id, about ``sample_docs``; ``max_rows`` rows at most.

    None if the sample does not hold both labels; then only the fixed rules count.
    """
    n = max(docs.count(), 1)
    picked = docs.filter("text is not null").filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample_docs).select("doc_id", "text")

    def rows(batches):
        for pdf in batches:
            out = [(str(i), j, *r) for i, t in zip(pdf["doc_id"], pdf["text"]) for j, r in enumerate(labelled(t))]
            yield pd.DataFrame(out, columns=["id", "j", "x", "y"])

    got = picked.mapInPandas(rows, "id string, j int, x array<double>, y int")
    got = got.orderBy(F.xxhash64("id", "j"), "id", "j", "y", "x").limit(max_rows).toPandas()
    if got["y"].nunique() < 2 or len(got) < 100:
        return None
    return Boosted(np.array(got["x"].tolist(), float), got["y"].to_numpy())


def spans_of(text: str, model: Boosted | None, precision: float = PRECISION) -> list[tuple]:
    """Base spans and the candidates that the model accepts, by kind and start. Of overlapping candidates the surest stays."""
    base = base_spans(text)
    out = [(k, a, b, True, 1.0) for k, ss in base.items() for a, b in ss]
    if model is not None and (found := candidates(text, [(a, b) for _, a, b, _, _ in out])):
        p = model.probability(np.array([describe(text, *c) for c in found], float))
        end_of: list[tuple[int, int]] = []
        for q, (k, a, b) in sorted(zip(p.tolist(), found), key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
            if q >= precision and all(b <= c or a >= d for c, d in end_of):
                end_of.append((a, b))
                out.append((k, a, b, False, q))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redacted(text: str, spans: list[tuple]) -> str:
    """Text with every span replaced by its kind in brackets; spans that overlap become one."""
    out, at = [], 0
    for k, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_spans(df: DataFrame, model: Boosted | None, *, precision: float = PRECISION) -> DataFrame:
    """All columns of ``df``, ``spans`` (kind, start, end in code points, base, score) and ``redacted``.

    Every row is worked on by itself and nothing is shuffled. A null text has no spans and stays null; equal rows get
    equal spans; columns with the names of results are replaced.
    """
    keep = df.select(*[c for c in df.columns if c.lower() not in ("spans", "redacted")])
    schema = T.StructType([*keep.schema.fields, T.StructField("spans", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())])
    columns, at = keep.columns, keep.columns.index("text")

    def run(batches):
        import pyarrow as pa

        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
        names = ("kind", "start", "end", "base", "score")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = [spans_of(t, model, precision) if t else [] for t in texts]
            new = [None if t is None else redacted(t, s) for t, s in zip(texts, spans)]
            lists = pa.array([[dict(zip(names, s)) for s in ss] for ss in spans], shape)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(new, pa.string())], names=[*columns, "spans", "redacted"])

    return keep.mapInArrow(run, schema)


def listed(spans) :
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
