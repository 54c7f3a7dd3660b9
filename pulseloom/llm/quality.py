"""Quality rules: document statistics and a log-likelihood ratio of hashed n-grams, target against raw corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import SPACE, let, table, words_of
from pulseloom.operators.position import with_position
from pulseloom.session import materialize

BUCKETS = 1 << 14
SMOOTHING = 0.5
UNIT = 1 << 20  # log ratios are whole multiples of 1 / UNIT, so that sums do not depend on their order
BROADCAST_ROWS = 1_000_000  # trusted ids, 8 bytes each, that are sent to every executor
GOOD_LOSS = 0.001  # share of trusted rows that is not looked at when the lowest trusted score is taken
BAD_SHARE = 0.95  # and of the rows of quality 0 below it, the score that so many of them do not exceed


def features(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the single words and word pairs, in lower case."""
    ids = lambda w: F.concat(
        F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")),
        F.transform(
            F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
            lambda x, i: F.pmod(F.xxhash64(F.get(w, i), x), F.lit(buckets)).cast("int"),
        ),
    )
    return let(words, ids)


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Counts per document that the fixed rules use; ``text`` must not be null."""

    def repeated(w: Column) -> Column:
        def covered(s: Column) -> Column:
            equal = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
            hits = F.filter(s, lambda x, i: equal(x, i - 1) | equal(x, i + 1))
            spread = F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(spread)).cast("bigint")

        def counted(h: Column) -> Column:
            # most texts have no equal windows, which one look at the distinct numbers tells; only the others are sorted
            at = F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i"))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(F.sort_array(at), covered))

        windows = F.transform(F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))
        return let(windows, counted)

    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.char_length(F.regexp_replace(text, SPACE, "")).cast("bigint"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("bigint"),
        "n_dup_lines": let(with_word, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint"),
        "n_repeat_words": let(words, repeated),
    }


def ratios(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[int]:
    """Log ratio per bucket, target against raw, as whole multiples of 1 / UNIT.

    Counts cover every document. The target is every document with a label of quality 1; its text joins the labels on
    doc_id. The result has ``buckets`` numbers, whatever the size of the corpus, so that it may pass the driver.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct().withColumn("_good", F.lit(1))
    if good.count() <= BROADCAST_ROWS:
        good = F.broadcast(good)  # ids only; more of them are shuffled, and the texts with them
    ids = docs.filter("text is not null").select("doc_id", "text").join(good, "doc_id", "left")
    counted = ids.select("_good", F.explode(features(words_of(F.col("text")), buckets)).alias("b")).groupBy("b")
    rows = {r["b"]: (r["target"], r["raw"]) for r in counted.agg(F.count("_good").alias("target"), F.count(F.lit(1)).alias("raw")).collect()}
    n_t, n_r = (sum(v[i] for v in rows.values()) + smoothing * buckets for i in (0, 1))
    out = []
    for b in range(buckets):
        t, r = rows.get(b, (0, 0))
        out.append(round(UNIT * (math.log((t + smoothing) / n_t) - math.log((r + smoothing) / n_r))))
    return out


def score(words: Column, log_ratios: list[int]) -> Column:
    """Mean log ratio of the features of a document in 1 / UNIT (null without words)."""
    weights = F.split(F.lit(",".join(map(str, log_ratios))), ",").cast("array<bigint>")  # folded to one constant
    total = lambda f: F.aggregate(f, F.lit(0).cast("bigint"), lambda acc, b: acc + F.get(weights, b)) / F.size(f)
    return let(features(words, len(log_ratios)), lambda f: F.when(F.size(f) > 0, total(f)))


def quantile(values: DataFrame, name: str, share: float) -> float | None:
    """Exact quantile between neighbouring values, null for no rows; the values are ordered by a range shuffle, not in one task."""
    n = values.count()
    if n == 0:
        return None
    at = share * (n - 1)
    near = with_position(values.select(name), [name]).filter(F.col("pos").isin(math.floor(at), math.ceil(at)))
    low, *high = [r[name] for r in near.orderBy("pos").collect()]
    return low + (at - math.floor(at)) * (high[0] - low) if high else low


def fit_threshold(scored: DataFrame, labels: DataFrame) -> float:
    """Score below which a document is rejected, of ``scored`` (doc_id, score) and all labelled ids among them.

    The threshold lies in the middle between the lowest trusted score (but for ``GOOD_LOSS`` of them) and the highest
    score (but for 1 - ``BAD_SHARE``) of the rows of quality 0 that are below it; without such rows nothing is rejected.
    """
    known = labels.filter("quality in (0, 1)").select("doc_id", "quality").distinct()
    known = materialize(scored.filter("score is not null").select("doc_id", "score").join(known, "doc_id").select("quality", "score"))
    low = quantile(known.filter("quality = 1"), "score", GOOD_LOSS)
    if low is None:
        return -math.inf
    bad = quantile(known.filter("quality = 0").filter(F.col("score") < low), "score", BAD_SHARE)
    return -math.inf if bad is None else (low + bad) / 2


def judge(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, columns: list[str] | None = None) -> DataFrame:
    """All columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    A document fails the fixed rules with fewer than 50 words or when over half of its words stand in repeated 3-word
    windows. Else it is kept when its mean log ratio reaches the threshold fitted on all labelled documents. A null text has
    no words and fails. Repeated rows are judged alike; labels with null are left out; an empty table gives no rows. Columns
    of ``docs`` with the names of results are replaced. ``columns`` names those of ``docs`` to keep; they are written once with
    the scores, so that texts are scored once for the threshold and the verdict.
    """
    weights = ratios(docs, labels, buckets=buckets)
    text = F.coalesce(F.col("text"), F.lit(""))
    named = statistics(F.col("_text"), F.col("_words"))
    taken = [*named, "base_failed", "score", "kept"]
    rest = [c for c in columns or docs.columns if c.lower() not in taken]
    base = docs.select(*rest, F.col("doc_id").alias("_id"), text.alias("_text")).withColumn("_words", words_of(F.col("_text")))
    full = materialize(base.select(*rest, "_id", *[v.alias(k) for k, v in named.items()], score(F.col("_words"), weights).alias("score")))
    limit = fit_threshold(full.select(F.col("_id").alias("doc_id"), "score"), labels)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    full = full.drop("_id").withColumn("base_failed", failed)
    return full.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= F.lit(limit), F.lit(False)))


def op10_quality(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), columns=["doc_id"])
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
