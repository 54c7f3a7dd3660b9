"""Near copies by min-max hashing: candidates from bands of minima and maxima, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import table
from pulseloom.llm.components import components
from pulseloom.llm.tokens import Family, U, Words, mix
from pulseloom.session import materialize

SHINGLE = 5
NEED, OF = 75, 100  # linked: OF * intersection >= NEED * union
BANDS, ROWS = 40, 5  # a link at 0.75 misses all bands with a probability of 2e-5, at 0.8 of 1e-7
PERMUTATIONS = 200  # each gives its minimum and its maximum; bands use half of them, sketches all
SKETCH_BITS, SKETCH_WORDS = 3, 8  # bits kept of every signature entry, and numbers that hold one bit of all entries
SKETCH_AGREE = 277  # of 400 entries; a link at 0.75 agrees in 312.5 on average and in fewer than 277 once in 1e5
ORDERS = (0x2B5D8C713A96E4F1, 0x54A2738EC5691B0E)  # any two numbers below 2^63; see where they are used
SET_BYTES = 6  # bytes kept of a shingle's number when sets are compared


def shingles(numbers: np.ndarray, family: Family) -> np.ndarray:
    """Sorted distinct shingles of one text: five words each, a shorter text as one."""
    if len(numbers) >= SHINGLE:
        return np.unique(family.windows(numbers, SHINGLE))
    if len(numbers):
        return family.windows(numbers, len(numbers)) ^ U(len(numbers))
    return np.zeros(0, U)


def shingle_sets(column: pa.Array, family: Family) -> list[np.ndarray]:
    words = Words(column)
    n = words.numbers(family, lower=True)
    return [shingles(n[a:b], family) for a, b in zip(words.first[:-1], words.first[1:])]


class MinMax:
    """Signatures of sets: under each permutation both the smallest and the largest image."""

    def __init__(self, permutations: int = PERMUTATIONS, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
        self.scale = rng.integers(1, 1 << 62, permutations, dtype=np.uint64) * U(2) + U(1)
        self.band = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of 2 * permutations numbers per set; sets must not be empty."""
        sizes = np.array([len(s) for s in sets])
        out = np.empty((len(sets), 2 * len(self.flip)), U)
        at = 0
        while at < len(sets):  # pieces that stay in the processor's cache
            end = at + 1 + int(np.searchsorted(np.cumsum(sizes[at + 1 :]), 60_000))
            x, starts = np.concatenate(sets[at:end]), np.cumsum(sizes[at:end]) - sizes[at:end]
            for k in range(len(self.flip)):
                v = (x ^ self.flip[k]) * self.scale[k]
                out[at:end, 2 * k] = np.minimum.reduceat(v, starts)
                out[at:end, 2 * k + 1] = np.maximum.reduceat(v, starts)
            at = end
        return out

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """Band keys. A band takes its rows from different permutations."""
        out = np.empty((len(sig), BANDS), U)
        for b in range(BANDS):
            h = np.full(len(sig), self.band[b])
            for r in range(ROWS):
                h = mix(h * U(3) + sig[:, b + r * BANDS])
            out[:, b] = h
        return out

    def sketch(self, sig: np.ndarray) -> np.ndarray:
        """Three bits of every entry, each bit of all entries in four numbers."""
        mixed = mix(sig)
        planes = [((mixed >> U(j)) & U(1)).reshape(len(sig), SKETCH_WORDS, sig.shape[1] // SKETCH_WORDS) for j in range(SKETCH_BITS)]
        return np.concatenate([(p << np.arange(p.shape[2], dtype=U)).sum(axis=2, dtype=U) for p in planes], axis=1)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def signatures(docs: DataFrame, carry: list[str]) -> DataFrame:
    """One row per document: doc_id, the columns to carry, n, h1, h2 (fingerprint of the set), keys, s (sketch); no text."""
    family, minmax = Family(6), MinMax()
    docs = docs.select("doc_id", "text", *carry)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[2:])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = shingle_sets(batch.column(1), family)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                sig = minmax.signatures([sets[i] for i in full]) if len(full) else np.zeros((0, 2 * PERMUTATIONS), U)
                keys, s = np.zeros((len(n), BANDS), U), np.zeros((len(n), SKETCH_BITS * SKETCH_WORDS), U)
                keys[full], s[full] = minmax.keys(sig), minmax.sketch(sig)
                h1 = np.array([x.sum(dtype=U) for x in sets], U)
                h2 = np.array([mix(x ^ U(0x5851F42D4C957F2D)).sum(dtype=U) for x in sets], U)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), signed(m.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *batch.columns[2:], pa.array(n), signed(h1), signed(h2), lists(keys), lists(s)],
                    names=["doc_id", *carry, "n", "h1", "h2", "keys", "s"],
                )

    return docs.mapInArrow(run, "doc_id long, " + kept + ", " * bool(kept) + "n long, h1 long, h2 long, keys array<long>, s array<long>")


def packed_sets(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 and the sorted set with SET_BYTES bytes per shingle."""
    family = Family(6)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = shingle_sets(batch.column(1), family)
                h1 = np.array([x.sum(dtype=U) for x in sets], U)
                h2 = np.array([mix(x ^ U(0x5851F42D4C957F2D)).sum(dtype=U) for x in sets], U)
                cut = [x.view(np.uint8).reshape(-1, 8)[:, 8 - SET_BYTES :].tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), signed(h1), signed(h2), pa.array(cut, pa.binary())], names=["doc_id", "h1", "h2", "bag"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h1 long, h2 long, bag binary")


def unpacked(bag: bytes) -> np.ndarray:
    x = np.zeros((len(bag) // SET_BYTES, 8), np.uint8)
    x[:, :SET_BYTES] = np.frombuffer(bag, np.uint8).reshape(-1, SET_BYTES)
    return x.view(U).ravel()


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their Jaccard distance on full sets (d), and whether they are linked.

    The set of a, of which many pairs share one, is attached first, so that the second shuffle goes by b.
    """
    one = pairs.join(sets.select(F.col("rep").alias("a"), F.col("bag").alias("bag_a")), "a")
    two = one.join(sets.select(F.col("rep").alias("b"), F.col("bag").alias("bag_b")), "b").select("a", "b", "bag_a", "bag_b")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                d.append(1 - both / union)
                linked.append(OF * both >= NEED * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "d", "linked"])

    return two.mapInArrow(run, "a long, b long, d double, linked boolean")


def likely(x: str, y: str):
    """Conditions that every link meets: near sizes, and (but for one in 100,000 at the very threshold) enough equal sketch entries."""
    w = SKETCH_WORDS
    differ = " + ".join(
        "bit_count(" + " | ".join(f"({x}_s[{i + j * w}] ^ {y}_s[{i + j * w}])" for j in range(SKETCH_BITS)) + ")" for i in range(w)
    )
    near = f"{OF} * least({x}_n, {y}_n) >= {NEED} * greatest({x}_n, {y}_n)"
    return F.expr(f"{near} and {2 * PERMUTATIONS} - ({differ}) >= {SKETCH_AGREE}")


CELL = 500  # members of a bucket on either side of a comparison: what one task holds at a time
CELL_BYTES = 16 << 20  # and their sets, on average


def _close(rep, label, main, n, d, sketch, u: int, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of ``right`` that a left member may be linked with by all but the full sets, and their equal sketch entries."""
    near = OF * np.minimum(n[u], n[right]) >= NEED * np.maximum(n[u], n[right])
    near &= (label[right] != label[u]) & (main[right] | (rep[u] < rep[right])) & ~(np.abs(d[right] - d[u]) > 1 - NEED / OF + 1e-9)
    at = right[near]
    agree = 2 * PERMUTATIONS - np.bitwise_count(np.bitwise_or.reduce(sketch[at] ^ sketch[u], axis=1)).sum(axis=1, dtype=np.int64)
    return at[agree >= SKETCH_AGREE], agree[agree >= SKETCH_AGREE]


def _members(cell: pa.Table) -> tuple:
    column = lambda c: cell[c].to_numpy(zero_copy_only=False)
    sketch = cell["s"].combine_chunks().flatten().to_numpy().reshape(cell.num_rows, SKETCH_BITS, SKETCH_WORDS).view(U)
    return column("rep"), column("l"), column("main").astype(bool), column("n"), column("d").astype(float), sketch


def cell_close(cell: pa.Table) -> pa.Table:
    """The members of a cell whose full sets are needed."""
    m = _members(cell)
    left = cell["left"].to_numpy(zero_copy_only=False).astype(bool)
    right = np.flatnonzero(~left)
    need = np.zeros(cell.num_rows, bool)
    for u in np.flatnonzero(left):
        at, _ = _close(*m, u, right)
        need[at] = True
        need[u] = len(at) > 0
    return cell.filter(pa.array(need))


def cell_links(cell: pa.Table) -> pa.Table:
    """Links between members of two stretches of a bucket, as many as it takes to join their components.

    Full sets are compared, the likeliest first, as long as the two components are still apart.
    """
    rep, label, *rest = _members(cell)
    left = cell["left"].to_numpy(zero_copy_only=False).astype(bool)
    right = np.flatnonzero(~left)
    sets = cell["bag"].combine_chunks()
    bags: dict[int, np.ndarray] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    def bag(i: int) -> np.ndarray:
        if i not in bags:
            bags[i] = unpacked(sets[i].as_buffer())
        return bags[i]

    out = []
    for u in np.flatnonzero(left):
        at, agree = _close(rep, label, *rest, u, right)
        for v in at[np.argsort(-agree, kind="stable")]:
            if root(label[u]) == root(label[v]):
                continue
            x, y = bag(u), bag(v)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if OF * both >= NEED * (len(x) + len(y) - both):
                parent[root(label[u])] = root(label[v])
                out.append((rep[u], rep[v]))
    return pa.table({"a": pa.array([int(x) for x, _ in out], pa.int64()), "b": pa.array([int(x) for _, x in out], pa.int64())})


def links_across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join components within buckets.

    ``members``: key, rep, l (component), main (whether it is that of the bucket's smallest), d, n, s; ``sets``: rep, bag.
    The members of a bucket are cut to stretches of about CELL members, those outside the main component to stretches of
    their own, and every pair of stretches is a group, so a bucket of any size spreads over many tasks and no pair is
    ever a row. A member travels once for every stretch outside the main component: with one stray, once. Sizes, labels,
    distances and sketches are compared first; full sets go only to the cells, and only of the members, that need them.
    """
    lots = lambda which: F.greatest(F.ceil(F.count_if(which) / CELL), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) * SET_BYTES / CELL_BYTES)).cast("int")
    parts = members.groupBy("key").agg(lots(F.lit(True)).alias("k"), lots(~F.col("main")).alias("strays"))
    own = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    cell = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cells = F.concat(
        F.transform(each("strays"), lambda i: cell(i, own("k"), False)),
        F.when(F.col("main"), F.array().cast("array<struct<i:int,j:int,left:boolean>>")).otherwise(F.transform(each("k"), lambda j: cell(own("strays"), j, True))),
    )
    slim = ["key", "i", "j", "left", "rep", "l", "main", "d", "n", "s"]
    spread = members.join(parts.filter("strays > 0"), "key").withColumn("cell", F.explode(cells)).select("key", "cell.*", *slim[4:])
    need = materialize(spread.select(*slim).groupBy("key", "i", "j").applyInArrow(cell_close, spread.select(*slim).schema))
    return need.join(sets, "rep").select(*slim, "bag").groupBy("key", "i", "j").applyInArrow(cell_links, "a long, b long")


def labelled(docs: DataFrame, carry: list[str]) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns to carry, n (shingles), label (number of the component, null where
    nothing can be linked) and component_id."""
    sig = materialize(signatures(docs, carry))
    usable = sig.filter("n > 0 and doc_id is not null")
    # A class is known by its number. Its smallest doc_id may be that of other texts, too.
    reps = materialize(
        usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("n", "s", "keys"), "doc_id").alias("x"))
        .select("h1", "h2", "id", "x.n", "x.s", "x.keys", F.monotonically_increasing_id().alias("rep"))
    )
    rows = reps.select("rep", F.explode("keys").alias("key"))
    # Two more orders of the numbers, each the same in all buckets, in as few bytes as a number.
    other = lambda x: F.min(F.col("rep").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x))
    buckets = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.min("rep").alias("p0"), *[other(x).alias(f"p{i}") for i, x in enumerate(ORDERS, 1)]
    ).filter("c > 1").drop("c")
    members = materialize(rows.join(buckets, "key"))
    known = reps.select("rep", "id", "n", "s", "h1", "h2").join(members.select("rep").distinct(), "rep", "left_semi")
    known = materialize(known)
    sets = materialize(
        # The ids grow with the corpus, so the texts are shuffled at every size.
        packed_sets(docs.select("doc_id", "text").join(known.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi"))
        .withColumnRenamed("doc_id", "id").join(known.select("id", "rep", "h1", "h2"), ["id", "h1", "h2"])
        .dropDuplicates(["id", "h1", "h2"]).select("rep", "bag")
    )
    side = lambda c: known.select(F.col("rep").alias(c), F.col("n").alias(f"{c}_n"), F.col("s").alias(f"{c}_s"))
    stars = members.select(F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
    stars = stars.join(side("a"), "a").join(side("b"), "b").filter(likely("a", "b")).select("a", "b")
    seen = materialize(measured(stars, sets))
    labels = materialize(components(seen.filter("linked").select("a", "b")))

    # What is left: members outside the component of their bucket's smallest, against the others of the bucket.
    label_of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_l"))
    m = members.select("key", "rep", "p0").join(label_of("rep"), "rep", "left").join(label_of("p0"), "p0", "left")
    m = m.select("key", "rep", "p0", F.coalesce("rep_l", "rep").alias("l"), F.coalesce("p0_l", "p0").alias("main"))
    mixed = m.filter("l <> main").select("key").distinct()
    to_first = seen.select(F.col("a").alias("p0"), F.col("b").alias("rep"), "d")
    m = m.join(mixed, "key", "left_semi").join(to_first, ["p0", "rep"], "left").join(known.select("rep", "n", "s"), "rep")
    m = materialize(m.select("key", "rep", "l", "n", "s", F.when(F.col("p0") == F.col("rep"), 0.0).otherwise(F.col("d")).alias("d"), (F.col("l") == F.col("main")).alias("main")))
    more = materialize(links_across(m, sets).distinct())
    if more.isEmpty():
        final = labels
    else:
        final = materialize(components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))))
    final = final.withColumnRenamed("node", "rep")
    least = final.join(reps.select("rep", "id"), "rep").groupBy("label").agg(F.min("id").alias("component"))
    of_class = reps.select("h1", "h2", "rep", "id").join(final.join(least, "label"), "rep", "left")
    of_class = of_class.select("h1", "h2", F.coalesce("label", "rep").alias("label"), F.coalesce("component", "id").alias("component"))
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = sig.select("doc_id", *carry, "n", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    return out.select("doc_id", *carry, "n", F.when(linked, F.col("label")).alias("label"), F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts with equal sets form a class. Classes that share a band go to one bucket.
    A bucket is never expanded to all its pairs: its members are measured against three of them first and the confirmed
    links are joined to components. Only members outside the component of the bucket's smallest are then compared with
    the other components, in bounded cells and behind conditions that no link fails: sizes, sketches, and the triangle
    inequality of Jaccard distances to the bucket's smallest member. Links are confirmed on full sets.

    A null or wordless text has an empty set and is linked with nothing. A null doc_id is linked with nothing and kept.
    Rows that repeat a doc_id get the component of their own text; only rows whose doc_id is the component_id are kept,
    so repeated rows stay together. Other columns are not read; an empty table gives no rows.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return labelled(docs, []).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of every component one row stays, of the smallest doc_id (of equal ones any).

    Rows are told apart by their place in the Parquet files that ``docs`` reads, so rows that share a doc_id are judged
    each by its own text. Other tables are written first. Rows without words or doc_id all stay.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        docs = materialize(docs)
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    found = materialize(labelled(placed, ["_file", "_at"]).filter("label is not null").select("doc_id", "_file", "_at", "label"))
    first = found.groupBy("label").agg(F.min(F.struct("doc_id", "_file", "_at")).alias("x"), F.count(F.lit(1)).alias("c"))
    stays = first.filter("c > 1").select("x._file", "x._at")
    copies = found.join(first.filter("c > 1").select("label"), "label", "left_semi").select("_file", "_at")
    gone = copies.join(stays, ["_file", "_at"], "left_anti").hint("merge")  # grows with the corpus, so no size sends it to all tasks
    return placed.join(gone, ["_file", "_at"], "left_anti").select(*docs.columns)


def op6_minhash(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents"))


SQL = f"""with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
sh as (select distinct doc_id, unnest(case when len(w) >= {SHINGLE} then list_transform(range(1, len(w) - {SHINGLE - 2}),
    lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from words),
num as (select doc_id, count(*) n from sh group by doc_id),
common as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join num x on x.doc_id = a join num y on y.doc_id = b
  where {OF} * c >= {NEED} * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach as (select doc_id a, doc_id b from documents union select r.a, e.b from reach r join edge e on e.a = r.b),
comp as (select a doc_id, min(b) component_id from reach group by a)
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, component_id, d.doc_id = component_id kept
from documents d left join num using (doc_id) left join comp using (doc_id)"""
