"""Ranked lexical search over a length-stratified index: documents of one normaliser together, postings by frequency."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import table
from pulseloom.session import materialize

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # in UTF-8 with A-Z lowered: letters, digits and all beyond ASCII
BLOCK_WORDS, BLOCK_DOCS = 1 << 18, 1 << 12  # a block of a stratum holds about so many words, and documents
QUERY_TERMS, QUERY_ITEMS = 1 << 17, 256  # of the items that are searched at a time
PILOT_DOCS = 2_000  # documents visited per item, best strata first, to find a first threshold
EXPAND = 1 << 20  # postings of all items that are spread out at a time
SMALL_ROWS = 100_000  # strata that are sent to all tasks; more are joined by shuffle
NOWHERE = -1  # term number of a block's list of documents


@dataclass
class Index:
    """``postings``: m, block, term, tf, docs (positions in the block), one row per term and frequency in a block of a
    stratum; the row without a term has the doc_ids of the block instead, in ``ids``."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def counted(text: str | None) -> Counter:
    return Counter(TERM.findall((text or "").encode("utf-8", "replace").lower()))


def term_lists(docs: DataFrame) -> DataFrame:
    """row, doc_id, n and the distinct terms with their frequencies, packed; documents without terms are left out."""
    names = ["row", "doc_id", "n", "terms", "tfs"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                bags = [counted(t.as_py()) for t in batch.column(2)]
                full = pa.array([i for i, b in enumerate(bags) if b], pa.int64())
                bags = [b for b in bags if b]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(full), batch.column(1).take(full), pa.array([sum(b.values()) for b in bags], pa.int64()),
                    pa.array([b" ".join(b) for b in bags], pa.binary()), pa.array([np.fromiter(b.values(), np.uint32, len(b)).tobytes() for b in bags], pa.binary()),
                ], names=names)

    # The row numbers are stored with the rows, so it does not matter that another run could give others.
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "row long, doc_id long, n long, terms binary, tfs binary"
    )


def block_postings(block: pa.Table) -> pa.Table:
    """Postings of one block: terms, within a term frequencies, within these positions."""
    terms, pos, tfs = [], [], []
    for i, (t, f) in enumerate(zip(block["terms"].to_pylist(), block["tfs"].to_pylist())):
        own = t.split(b" ")
        terms += own
        pos.append(np.full(len(own), i, np.int32))
        tfs.append(np.frombuffer(f, np.uint32))
    coded = pa.array(terms, pa.binary()).dictionary_encode()
    term, pos, tf = coded.indices.to_numpy(), np.concatenate(pos), np.concatenate(tfs).astype(np.int64)
    order = np.lexsort((pos, tf, term))
    term, pos, tf = term[order], pos[order], tf[order]
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
    ends = np.concatenate([new, [len(term)]]).astype(np.int32)
    ids, rows = block["doc_id"].combine_chunks(), len(new)
    same = lambda v: pa.array(np.full(rows + 1, v.as_py(), np.int64))
    return pa.table({
        "m": same(block["m"][0]), "block": same(block["block"][0]),
        "term": pa.concat_arrays([coded.dictionary.take(pa.array(term[new])), pa.nulls(1, pa.binary())]),
        "tf": pa.array(np.concatenate([tf[new], [0]])),
        "docs": pa.ListArray.from_arrays(pa.array(np.concatenate([ends, ends[-1:]])), pa.array(pos)),
        "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(rows + 1, np.int32), [len(ids)]]).astype(np.int32)), ids),
    })


def build_index(docs: DataFrame) -> Index:
    """The index of all rows of ``docs`` (doc_id, text).

    Terms are the maximal runs of letters, digits and characters beyond ASCII, only A-Z lowered. Documents with an equal
    normaliser m form a stratum; as their lengths are about equal, a stratum is cut to blocks of about equal work. The
    texts are read once, their distinct terms are shuffled once.

    Null, empty and termless texts are not indexed, equal rows are indexed as often as they stand there, a text of any
    length fits a block of its own. Other columns are not read.
    """
    lists = materialize(term_lists(docs))
    n_docs, n_terms = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {max(n_terms, 1)}L")
    strata = materialize(
        lists.groupBy(m.alias("m")).agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("d"))
        .select("m", F.greatest(F.ceil(F.col("words") / BLOCK_WORDS), F.ceil(F.col("d") / BLOCK_DOCS)).cast("long").alias("parts"))
    )
    strata = F.broadcast(strata) if strata.count() <= SMALL_ROWS else strata
    placed = lists.withColumn("m", m).join(strata, "m").select("m", F.pmod("row", "parts").alias("block"), "doc_id", "terms", "tfs")
    postings = placed.groupBy("m", "block").applyInArrow(block_postings, "m long, block long, term binary, tf long, docs array<int>, ids array<long>")
    return Index(materialize(postings), n_docs, n_terms)


# Search


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Queries:
    """Items of one pass, flat and by item: item number, term number, weight times repeats."""

    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    n: int

    def only(self, items: np.ndarray) -> Queries:
        keep = np.isin(self.item, items)
        return Queries(self.item[keep], self.term[keep], self.weight[keep], self.n)


def bounds(strata: pa.Table, q: Queries) -> pa.Table:
    """Upper bounds of the scores in one stratum (rows: m, t, tf the largest frequency) for every item with a term there."""
    m = strata["m"][0].as_py()
    t, tf = strata["t"].to_numpy(), strata["tf"].to_numpy()
    order = np.argsort(t)
    t, most = t[order], impact(tf[order], m)
    at = np.minimum(np.searchsorted(t, q.term), len(t) - 1)
    total = np.zeros(q.n, np.int64)
    np.add.at(total, q.item, np.where(t[at] == q.term, q.weight * most[at], 0))
    items = np.flatnonzero(total)
    return pa.table({"m": pa.array(np.full(len(items), m)), "item": pa.array(items), "bound": pa.array(total[items])})


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def slices(size: np.ndarray) -> Iterator[slice]:
    """Stretches with a total size of about EXPAND."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPAND)))
        yield slice(at, end)
        at = end


def rank_block(block: pa.Table, q: Queries, least: np.ndarray, k: int) -> pa.Table:
    """The ``k`` best documents of a block for every item, as far as they reach the item's ``least`` score.

    Impacts are computed once per frequency. Terms whose bounds, the smallest added up, stay below the least score cannot
    make a document count alone: only the lists of the other terms are walked, and what they find is completed by lookups.
    """
    empty = pa.table({"item": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    t = block["t"].to_numpy()
    ids = block["ids"].combine_chunks().take(pa.array(np.flatnonzero(t == NOWHERE))).flatten()
    rows = np.flatnonzero(t != NOWHERE)
    if not len(rows):
        return empty
    d, m = len(ids), block["m"][0].as_py()
    lists = block["docs"].combine_chunks().take(pa.array(rows))
    size = np.diff(lists.offsets.to_numpy())
    steps, which = np.unique(block["tf"].to_numpy()[rows], return_inverse=True)
    key = np.repeat(t[rows], size) * d + lists.flatten().to_numpy()
    order = np.argsort(key)
    key, value = key[order], np.repeat(impact(steps, m)[which], size)[order]
    terms, first = np.unique(key // d, return_index=True)
    length = np.diff(np.concatenate([first, [len(key)]]))
    most = np.maximum.reduceat(value, first)

    at = np.minimum(np.searchsorted(terms, q.term), len(terms) - 1)
    here = (terms[at] == q.term) & (q.weight > 0)
    item, at, weight = q.item[here], at[here], q.weight[here]
    bound = weight * most[at]
    total = np.zeros(q.n, np.int64)
    np.add.at(total, item, bound)
    live = np.flatnonzero(total >= least)
    keep = np.isin(item, live)
    order = np.lexsort((bound[keep], item[keep]))
    item, at, weight, bound = (np.searchsorted(live, item[keep])[order], at[keep][order], weight[keep][order], bound[keep][order])
    if not len(item):
        return empty
    least = least[live]
    begin = np.searchsorted(item, np.arange(len(live) + 1))
    upto = np.cumsum(bound)
    upto -= np.concatenate([[0], upto])[begin[item]]
    lead = upto >= least[item]
    rest = np.zeros(len(live), np.int64)
    np.add.at(rest, item[~lead], bound[~lead])

    score = np.zeros(len(live) * d, np.int64)
    own, spot, heavy = item[lead], at[lead], weight[lead]
    for s in slices(length[spot]):
        n = length[spot[s]]
        p = ranges(first[spot[s]], n)
        np.add.at(score, np.repeat(own[s], n) * d + key[p] % d, np.repeat(heavy[s], n) * value[p])
    found = np.flatnonzero(score)
    found = found[score[found] + rest[found // d] >= least[found // d]]
    tail = np.searchsorted(item, np.arange(len(live) + 1))
    light = np.add.reduceat((~lead).astype(np.int64), tail[:-1])  # the first entries of an item, as bounds rise
    for s in slices(np.maximum(light[found // d], 1)):
        own = found[s] // d
        n = light[own]
        e = ranges(tail[own], n)
        spot = np.repeat(found[s], n)
        want = terms[at[e]] * d + spot % d
        p = np.minimum(np.searchsorted(key, want), len(key) - 1)
        np.add.at(score, spot, np.where(key[p] == want, weight[e] * value[p], 0))
    found = found[score[found] >= least[found // d]]
    no_id = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy()
    pos = found % d
    order = np.lexsort((number[pos], no_id[pos], -score[found], found // d))
    found = found[order]
    start = np.searchsorted(found // d, np.arange(len(live)))
    found = found[np.arange(len(found)) - start[found // d] < k]
    return pa.table({"item": pa.array(live[found // d]), "doc_id": ids.take(pa.array(found % d)), "score": pa.array(score[found])})


def search(index: Index, items: DataFrame, *, k: int = 20) -> DataFrame:
    """The ``k`` best documents of every row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Only scores above 0 count; equal scores go by ascending doc_id, null last. Items are searched in passes of bounded
    size. In a pass the strata are ordered by their upper bounds for each item; the best of them give a first threshold,
    with which blocks, items and lists that cannot reach it are left out of the visit to all strata. Exact at every size.

    Items without a known term have no rows. Rows that repeat an item_id are ranked each on its own. An empty index or
    table gives no rows; columns other than item_id and text are not read.
    """
    spark = items.sparkSession

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bag = counted(batch.column(2)[i].as_py())
                same = pa.array([0] * len(bag), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1).take(same), batch.column(1).slice(i, 1).take(same), pa.array(list(bag), pa.binary()), pa.array(list(bag.values()), pa.int64()),
                ], names=["item", "item_id", "term", "times"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    entries = materialize(numbered.mapInArrow(run, "item long, item_id long, term binary, times long"))
    n_entries, n_items = entries.agg(F.count(F.lit(1)), F.count_distinct("item")).first()
    passes = max(-(-n_entries // QUERY_TERMS), -(-n_items // QUERY_ITEMS))
    out = None
    for p in range(passes if index.n_docs else 0):
        rows = entries.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).orderBy("item", "term").collect()
        if rows:
            part = _search_pass(spark, index, rows, k)
            out = part if out is None else out.unionByName(part)
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return empty if out is None else out


def _search_pass(spark, index: Index, rows: list, k: int) -> DataFrame:
    """``search`` for as many items as the driver and every task can hold (QUERY_TERMS, QUERY_ITEMS; larger items alone)."""
    numbers = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
    items = {item: i for i, item in enumerate(dict.fromkeys(r["item"] for r in rows))}
    names = {items[r["item"]]: r["item_id"] for r in rows}
    vocabulary = spark.createDataFrame([(bytearray(t), i) for t, i in numbers.items()], "term binary, t long")
    found = index.postings.join(F.broadcast(vocabulary), "term").select("m", "block", "t", "tf", "docs", F.lit(None).cast("array<long>").alias("ids"))
    lists = index.postings.filter("term is null").select("m", "block", F.lit(NOWHERE).cast("long").alias("t"), "tf", "docs", "ids")
    postings = materialize(found.unionByName(lists))

    df = dict(postings.filter(f"t <> {NOWHERE}").groupBy("t").agg(F.sum(F.size("docs"))).collect())
    weight = {t: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    entries = [(items[r["item"]], numbers[bytes(r["term"])], r["times"]) for r in rows]
    kept = sorted((i, t, n * weight[t]) for i, t, n in entries if weight.get(t, 0) > 0)
    flat = np.array(kept, np.int64).reshape(-1, 3)
    q = Queries(flat[:, 0].copy(), flat[:, 1].copy(), flat[:, 2].copy(), len(items))
    shape = "item long, doc_id long, score long"

    most = postings.filter(f"t <> {NOWHERE}").groupBy("m", "t").agg(F.max("tf").alias("tf"))
    bound = most.groupBy("m").applyInArrow(lambda x: bounds(x, q), "m long, item long, bound long")
    docs = postings.filter(f"t = {NOWHERE} and block = 0").select("m", F.size("ids").alias("d"))
    order = "partition by item order by bound desc, m"
    visits = bound.join(docs, "m").selectExpr("m", "item", f"sum(d) over ({order} rows between unbounded preceding and current row) - d as before").filter(F.col("before") < PILOT_DOCS)
    first: dict[int, list[int]] = {}
    for r in visits.collect():
        first.setdefault(r["m"], []).append(r["item"])
    ones = np.ones(len(items), np.int64)
    begun = postings.filter((F.col("block") == 0) & F.col("m").isin(list(first))).groupBy("m")
    pilot = begun.applyInArrow(lambda x: rank_block(x, q.only(np.array(first[x["m"][0].as_py()])), ones, k), shape)
    least = ones.copy()
    place = F.expr("row_number() over (partition by item order by score desc)")
    for r in pilot.withColumn("place", place).filter(F.col("place") == k).collect():
        least[r["item"]] = r["score"]

    ranked = postings.groupBy("m", "block").applyInArrow(lambda x: rank_block(x, q, least, k), shape)
    place = F.expr("row_number() over (partition by item order by score desc, doc_id asc nulls last)")
    best = materialize(ranked.withColumn("rank", place).filter(F.col("rank") <= k))
    ids = spark.createDataFrame([(i, name) for i, name in names.items()], "item long, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_search(spark, sf_dir):
    """The 20 best documents of every benchmark item; see ``build_index`` and ``search`` for odd rows."""
    index = build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""with d as (select row_number() over () r, doc_id, {_TERMS} w from documents),
b as (select row_number() over () i, item_id, {_TERMS} w from benchmark),
sized as (select r, doc_id, w, len(w) n from d where len(w) > 0),
size as (select count(*) docs, sum(n)::bigint words from sized),
post as (select r, t, count(*) tf from (select r, unnest(w) t from sized) group by r, t),
weight as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint w from post, size group by t, docs),
norm as (select r, doc_id, 75 + (25 * n * docs) // words m from sized, size),
query as (select i, t, count(*) c from (select i, unnest(w) t from b) group by i, t),
score as (select i, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score
  from query join weight using (t) join post using (t) join norm using (r) group by i, r),
ranked as (select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id) place
  from score join norm using (r) where score > 0)
select item_id, place::int rank, doc_id, score from ranked join b using (i) where place <= 20"""
