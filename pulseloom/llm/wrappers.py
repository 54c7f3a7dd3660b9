"""Main text of pages by wrappers: union-free regular expressions that the pages of a host have in common."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.common import table
from pulseloom.session import materialize

DEPTH = 60  # elements below this depth do not nest any further; their text stays
KEYS = 64  # kinds of one tag below one element; more are told apart by their tag alone
TEMPLATE_PAGES = 10  # different pages that a host must have before a text they all share counts as template
FAN = 64  # wrappers of a host that are aligned in one group
HELD = 2_000  # hosts that a task holds before it sends their wrappers on
PLAN_BYTES = 64 << 20  # plans of all hosts that are sent to every task; more are joined by shuffle
SLOT = "#"

# Elements of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("noscript template svg math select button canvas object audio video map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
CLOSES = {  # an element that starts ends these, up to the given ancestors
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
BLOCKS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre blockquote td th tr table ul ol dl tbody figcaption".split())
NOT_TEXT = frozenset("head nav header footer aside form fieldset menu dialog".split())
# Words in class, id and role that mark what is not the article.
NOT_TEXT_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies disqus"
    " footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related"
    " replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)

MARKUP = re.compile(
    r"<!---?>|<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</[^A-Za-z>][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"]{0,20000}\"|'[^']{0,20000}')*+)>|<(/?)([A-Za-z][^\s/<>]*)([^<>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(4096)
def key_of(tag: str, attributes: str) -> str:
    """What an element is aligned by: its tag, classes, id and role without digits, and whether it is hidden."""
    got = {}
    for name, value in ATTRIBUTE.findall(attributes):
        got.setdefault(name.lower(), value.strip("\"'"))
    clean = lambda v: re.sub(r"[^a-z_-]+", "", CAMEL.sub("-", v).lower())[:40]
    classes = sorted({clean(c) for c in got.get("class", "").split()} - {""})
    key = tag + "".join(f".{c}" for c in classes)
    for mark, name in (("#", "id"), ("@", "role")):
        if clean(got.get(name, "")):
            key += mark + clean(got[name])
    if "hidden" in got or re.search(r"display\s*:\s*none", got.get("style", "")) or got.get("aria-hidden", "").lower() == "true":
        key += "!hidden"
    return key


def tag_of(key: str) -> str:
    return re.split(r"[.#@!]", key, maxsplit=1)[0]


@lru_cache(4096)
def set_apart(key: str) -> int:
    """2: never article text, 1: named like something beside the article, 0: neither."""
    if tag_of(key) in NOT_TEXT or key.endswith("!hidden"):
        return 2
    return int(bool(NOT_TEXT_WORDS & set(re.findall("[a-z]+", key[len(tag_of(key)) :]))))


class Page:
    """Elements (parent, key) in page order, element 0 is the page; runs of text (element, text, characters in links)."""

    def __init__(self, source: str | None):
        self.elements: list[tuple[int, str]] = [(-1, "")]
        self.runs: list[tuple[int, str, int]] = []
        self._open: list[tuple[str, int]] = [("", 0)]
        self._pieces: list[str] = []
        self._linked, self._in_link = 0, False
        self._read(source or "")
        self._end_run()

    def _end_run(self) -> None:
        text = " ".join("".join(self._pieces).split())
        if text:
            self.runs.append((self._open[-1][1], text, min(self._linked, len(text))))
        self._pieces, self._linked = [], 0

    def _text(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self._pieces.append(text)
            if self._in_link:
                self._linked += len(" ".join(text.split()))

    def _pop_to(self, depth: int) -> None:
        self._end_run()
        del self._open[depth:]

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            self._pop_to(1)
            return
        if tag in ("hr", "input", "embed"):
            self._end_run()
        if tag in VOID:
            if tag == "br":
                self._pieces.append(" ")
            return
        if tag in INLINE:
            self._in_link = self._in_link or tag == "a"
            return
        names = [t for t, _ in self._open]
        if tag in CLOSES_P and "p" in names:
            self._pop_to(len(names) - 1 - names[::-1].index("p"))
        if tag in CLOSES:
            closed, until = CLOSES[tag]
            at = len(self._open)
            for i in range(len(self._open) - 1, 0, -1):
                if self._open[i][0] in until:
                    break
                if self._open[i][0] in closed:
                    at = i
            if at < len(self._open):
                self._pop_to(at)
        self._end_run()
        parent = self._open[-1][1]
        if len(self._open) <= DEPTH:
            self.elements.append((parent, key_of(tag, attributes)))
            parent = len(self.elements) - 1
        self._open.append((tag, parent))

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._in_link = False
            return
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] == tag:
                self._pop_to(i)
                break

    def _read(self, source: str) -> None:
        at = 0
        lowered: str | None = None
        for m in iter(lambda: MARKUP.search(source, at), None):
            self._text(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._end(tag)
            elif tag in RAW or tag in DROPPED:
                lowered = lowered if lowered is not None else source.lower() if len(source.lower()) == len(source) else source
                close = re.compile(rf"</{re.escape(tag)}[\s/>]").search(lowered, at)
                if close:
                    end = source.find(">", close.start())
                    at = end + 1 if end >= 0 else len(source)
                elif tag in RAW:
                    at = len(source)
            else:
                self._start(tag, m[3] or m[6] or "")
        self._text(source[at:])


# Wrappers. A level of a wrapper knows its kinds of children, in how many instances each occurs and which follows which.


def level() -> dict:
    return {"n": 0, "c": {}, "o": {}, "e": set(), "g": set()}


def fingerprint(text: str) -> str:
    return blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def wrapper_of(page: Page) -> dict:
    """The wrapper of one page; equal neighbours already share one level."""
    nodes, last, seen = [level()], [""], [set()]
    nodes[0]["n"] = 1

    def follow(parent: int, key: str) -> None:
        node = nodes[parent]
        if last[parent]:
            node["e"].add((last[parent], key))
        last[parent] = key
        if key not in seen[parent]:
            seen[parent].add(key)
            node["o"][key] = node["o"].get(key, 0) + 1

    at = iter([*page.runs, None])
    run = next(at)
    for i, (parent, key) in enumerate(page.elements):
        if i:
            follow(parent, key)
            nodes.append(nodes[parent]["c"].setdefault(key, level()))
            nodes[i]["n"] += 1
            last.append("")
            seen.append(set())
    while run:
        element, text, linked = run
        follow(element, SLOT)
        slot = {"n": 1, "chars": len(text), "link": linked, "lit": fingerprint(text)}
        old = nodes[element]["c"].get(SLOT)
        nodes[element]["c"][SLOT] = align_slots(old, slot) if old else slot
        run = next(at)
    kind = fingerprint("\n".join(t for _, t, _ in page.runs))
    return {"root": nodes[0], "kinds": {kind}}


def align_slots(a: dict, b: dict) -> dict:
    """Texts that differ make a slot; what they have in common is only their place."""
    return {"n": a["n"] + b["n"], "chars": a["chars"] + b["chars"], "link": a["link"] + b["link"], "lit": a["lit"] if a["lit"] == b["lit"] else None}


def _general(node: dict, tags: set[str]) -> None:
    """Children with these tags are told apart by their tag alone."""
    node["g"] |= tags
    name = lambda k: tag_of(k) if k != SLOT and tag_of(k) in tags else k
    kids: dict = {}
    for k, child in sorted(node["c"].items()):
        if name(k) in kids:
            align_levels(kids[name(k)], child)
        else:
            kids[name(k)] = child
    often: dict = {}
    for k, n in node["o"].items():
        often[name(k)] = min(often.get(name(k), 0) + n, node["n"])
    node["c"], node["o"], node["e"] = kids, often, {(name(a), name(b)) for a, b in node["e"]}


def align_levels(a: dict, b: dict) -> None:
    """Align level ``b`` with ``a``, in place.

    A child that only one side has, or that some instances lack, becomes optional; a child that follows itself, or
    children whose order differs, become a repeated group; texts that differ become a slot. The result does not depend
    on the order in which pages are aligned.
    """
    tags = a["g"] | b["g"]
    if tags:
        _general(a, tags)
        _general(b, tags)
    a["n"] += b["n"]
    for k, n in b["o"].items():
        a["o"][k] = a["o"].get(k, 0) + n
    a["e"] |= b["e"]
    for k, child in b["c"].items():
        mine = a["c"].get(k)
        if mine is None:
            a["c"][k] = child
        elif k == SLOT:
            a["c"][k] = align_slots(mine, child)
        else:
            align_levels(mine, child)
    if len(a["c"]) > KEYS:
        count: dict[str, int] = defaultdict(int)
        for k in a["c"]:
            count[tag_of(k)] += 1
        many = {t for t, n in count.items() if n > KEYS and t != SLOT}
        if many:
            _general(a, many)


def align(a: dict, b: dict) -> dict:
    align_levels(a["root"], b["root"])
    a["kinds"] = set(sorted(a["kinds"] | b["kinds"])[:TEMPLATE_PAGES])
    return a


def dump(wrapper: dict) -> str:
    def plain(x):
        return sorted(x) if isinstance(x, set) else x

    return json.dumps(wrapper, default=plain, sort_keys=True)


def load(text: str) -> dict:
    def sets(node: dict) -> None:
        node["e"], node["g"] = {tuple(x) for x in node["e"]}, set(node["g"])
        for k, child in node["c"].items():
            if k != SLOT:
                sets(child)

    wrapper = json.loads(text)
    wrapper["kinds"] = set(wrapper["kinds"])
    sets(wrapper["root"])
    return wrapper


def groups(node: dict) -> list[tuple[list[str], bool]]:
    """Children of a level in page order: a single one, or those that repeat together, and whether they repeat."""
    after = {k: {b for a, b in node["e"] if a == k} for k in node["c"]}
    reach = {}
    for k in after:
        found, todo = set(), list(after[k])
        while todo:
            x = todo.pop()
            if x not in found:
                found.add(x)
                todo += after[x]
        reach[k] = found
    done, out = set(), []
    for k in sorted(after, key=lambda k: (-len(reach[k] - {x for x in reach[k] if k in reach[x]}), k)):
        if k not in done:
            own = sorted(x for x in after if x == k or (x in reach[k] and k in reach[x]))
            done.update(own)
            out.append((own, k in reach[k]))
    return out


def expression(node: dict) -> str:
    """A level as a union-free regular expression: ``#`` is a text slot, ``=`` a text that never changes."""
    out = ""
    for keys, repeated in groups(node):
        one = lambda k: ("=" if node["c"][k]["lit"] else "#") if k == SLOT else f"<{k}>{expression(node['c'][k])}</{tag_of(k)}>"
        always = any(node["o"].get(k, 0) >= node["n"] for k in keys)
        if len(keys) > 1:
            out += "(" + "".join(f"({one(k)})?" for k in keys) + (")+" if always else ")*")
        elif repeated:
            out += f"({one(keys[0])})" + ("+" if always else "*")
        else:
            out += one(keys[0]) if always else f"({one(keys[0])})?"
    return out


# What of a wrapper is the article


def plan_of(wrapper: dict) -> dict:
    """Paths that hold the article, paths to leave out, and texts that belong to the template.

    The article is what stands in ``article`` elements, else in ``main``; on a page or host without them, in the deepest
    element that still holds most of the text outside links. Elements named like something beside the article are left
    out unless they hold an article or most of the text themselves.
    """
    weight: dict[str, int] = {}
    tagged: dict[str, list[str]] = {"article": [], "main": []}
    holds: set[str] = set()
    nodes: dict[str, dict] = {}

    def weigh(path: str, key: str, node: dict) -> int:
        nodes[path] = node
        own = 0
        for k, child in node["c"].items():
            if k == SLOT:
                own += max(child["chars"] - 2 * child["link"], 0)
            elif set_apart(k) < 2:
                own += weigh(f"{path}/{k}", k, child)
        weight[path] = own
        return own

    all_text = weigh("", "", wrapper["root"])
    for path in nodes:
        kind = tag_of(path.rpartition("/")[2])
        kind = "main" if "@main" in path.rpartition("/")[2] else kind
        if kind in tagged and not any(set_apart(k) for k in path.split("/")[-1:]):
            tagged[kind].append(path)
            parts = path.split("/")
            holds.update("/".join(parts[:i]) for i in range(1, len(parts)))
    out = {p for p in nodes if set_apart(p.rpartition("/")[2]) == 1 and p not in holds and (2 * weight[p] <= all_text or any(p.startswith(f"{a}/") for a in tagged["article"]))}
    inside = lambda p, roots: any(p == r or p.startswith(f"{r}/") for r in roots)
    first = lambda paths: [p for p in paths if not inside(p, out) and not inside(p.rpartition("/")[0], [q for q in paths if q != p])]
    articles, mains = first(tagged["article"]), first(tagged["main"])

    def least(path: str) -> int:
        return sum(weight[p] for p in out if p == path or p.startswith(f"{path}/"))

    deepest = ""
    while True:
        kids = [f"{deepest}/{k}" for k in nodes[deepest]["c"] if f"{deepest}/{k}" in nodes and f"{deepest}/{k}" not in out]
        best = max(kids, key=lambda p: (weight[p] - least(p), p), default=None)
        if best is None or tag_of(best.rpartition("/")[2]) in BLOCKS or 5 * (weight[best] - least(best)) < 3 * max(weight[deepest] - least(deepest), 1):
            break
        deepest = best
    literals = {}
    if len(wrapper["kinds"]) >= TEMPLATE_PAGES:
        literals = {p: n["c"][SLOT]["lit"] for p, n in nodes.items() if SLOT in n["c"] and n["c"][SLOT]["lit"] and n["c"][SLOT]["n"] >= wrapper["root"]["n"]}
    general = {p: sorted(n["g"]) for p, n in nodes.items() if n["g"]}
    return {"main": [articles, mains, [deepest]], "out": sorted(out), "literals": literals, "general": general}


@lru_cache(512)
def read_plan(text: str) -> dict:
    plan = json.loads(text)
    plan["main"], plan["out"] = [set(x) for x in plan["main"]], set(plan["out"])
    return plan


def main_text(page: Page, plan: dict) -> str:
    """Match a page with its host's wrapper; the blocks of text in the article's slots, in page order."""
    paths, gone = [""], [False]
    for parent, key in page.elements[1:]:
        if tag_of(key) in plan["general"].get(paths[parent], ()):
            key = tag_of(key)
        paths.append(f"{paths[parent]}/{key}")
        gone.append(gone[parent] or set_apart(key) == 2 or paths[-1] in plan["out"])
    roots = next((r for r in plan["main"] if any(p in r and not g for p, g in zip(paths, gone))), {""})
    inside = [False] * len(paths)
    for i, p in enumerate(paths):
        inside[i] = p in roots or i > 0 and inside[page.elements[i][0]]
    blocks = [t for e, t, _ in page.runs if inside[e] and not gone[e] and not (paths[e] in plan["literals"] and plan["literals"][paths[e]] == fingerprint(t))]
    return "\n\n".join(blocks)


# Spark


def host_of(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without one."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def infer_wrappers(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """One row per host: host, wrapper (JSON), expression, plan (JSON), n_pages.

    Every page counts. A task aligns its pages of a host one after the other, then wrappers of a host are aligned in
    groups of about FAN, round by round, so a host of any size never meets in one task. A wrapper grows with the kinds of
    elements of its host, which KEYS and DEPTH bound, not with its pages. Pages without a host share one wrapper.
    """

    def first(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}

        def send() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(map(dump, held.values()), pa.string())], names=["host", "wrapper"])
            held.clear()
            return rows

        for batch in batches:
            for host, source in zip(batch.column(0), batch.column(1)):
                host, own = host.as_py(), wrapper_of(Page(source.as_py()))
                held[host] = align(held[host], own) if host in held else own
                if len(held) >= HELD:
                    yield send()
        yield send()

    def together(group: pa.Table) -> pa.Table:
        texts = group["wrapper"].to_pylist()
        whole = load(texts[0])
        for t in texts[1:]:
            align(whole, load(t))
        return pa.table({"host": group["host"].slice(0, 1), "wrapper": pa.array([dump(whole)], pa.string())})

    parts = materialize(pages.select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(first, "host string, wrapper string"))
    while True:
        most = parts.groupBy("host").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 1
        if most == 1:
            break
        lots = -(-most // FAN)
        numbered = parts.withColumn("lot", F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id()), F.lit(lots)) if lots > 1 else F.lit(0).cast("long"))
        parts = materialize(numbered.groupBy("host", "lot").applyInArrow(together, "host string, wrapper string"))

    def finish(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole = load(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([expression(whole["root"])], pa.string()),
                    pa.array([json.dumps(plan_of(whole))], pa.string()), pa.array([whole["root"]["n"]], pa.int64()),
                ], names=["host", "wrapper", "expression", "plan", "n_pages"])

    return materialize(parts.mapInArrow(finish, "host string, wrapper string, expression string, plan string, n_pages long"))


def extract(pages: DataFrame, wrappers: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """All columns of ``pages`` and ``text``, the main text by the wrapper of the page's host.

    Pages stay where they are while the plans of all hosts are small; more are joined by shuffle, with equal results. A
    null or empty page has an empty text, a page of a host without wrapper is read by its own. Repeated rows get equal
    texts, a text of any length is read whole, and a column named ``text`` is replaced.
    """
    plans = wrappers.select(F.col("host").alias("_host"), F.col("plan").alias("_plan"))
    small = (plans.agg(F.sum(F.octet_length("_host") + F.octet_length("_plan"))).first()[0] or 0) <= PLAN_BYTES
    rest = [c for c in pages.columns if c.lower() != "text"]
    keep = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(html).alias("_html"), host_of(url).alias("_host"))
    keep = keep.join(F.broadcast(plans) if small else plans, "_host", "left").drop("_host")
    schema = T.StructType([*keep.schema.fields[: len(rest)], T.StructField("text", T.StringType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, plan in zip(batch.column(len(rest)), batch.column(len(rest) + 1)):
                page, plan = Page(source.as_py()), plan.as_py()
                texts.append(main_text(page, read_plan(plan if plan is not None else json.dumps(plan_of(wrapper_of(page))))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], names=schema.names)

    return keep.mapInArrow(run, schema)


def op11_html(spark, sf_dir):
    """Main text of every page; see ``extract`` for odd rows."""
    pages = table(spark, sf_dir, "pages")
    found = extract(pages.select("page_id", "url", "html"), infer_wrappers(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
