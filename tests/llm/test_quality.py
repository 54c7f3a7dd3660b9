"""Document statistics and scores against plain Python."""

import math
import re
from collections import Counter

from pulseloom.llm import quality
from pulseloom.llm.common import words_of
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plain(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_statistics_of_every_document(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in quality.op10_quality(spark, SF).collect():
        want = plain(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_statistics_of_made_up_texts(spark):
    texts = ["", "a", "a b", "a b c", "a a a a", "a b c a b c d", "x\nx\n\n \nx y\nx y", "# $\t%&|<> *", "é é  ", "a b a b a b a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.withColumn("w", words_of(F.col("text"))).select("i", *[v.alias(k) for k, v in quality.statistics(F.col("text"), F.col("w")).items()]).collect()
    for r in rows:
        want = plain(texts[r["i"]])
        assert {k: r[k] for k in want} == want, texts[r["i"]]


def test_score_is_the_mean_log_ratio_of_all_features(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    n = 64
    with_ids = docs.select("doc_id", quality.features(words_of(F.col("text")), n).alias("f")).collect()
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    raw = Counter(b for r in with_ids for b in r["f"])
    target = Counter(b for r in with_ids if r["doc_id"] in good for b in r["f"])
    s = quality.SMOOTHING
    total = [sum(c.values()) + s * n for c in (target, raw)]
    weight = [round(quality.UNIT * (math.log((target[b] + s) / total[0]) - math.log((raw[b] + s) / total[1]))) for b in range(n)]
    assert quality.ratios(docs, labels, buckets=n) == weight
    got = docs.select("doc_id", quality.score(words_of(F.col("text")), weight).alias("s")).collect()
    want = {r["doc_id"]: sum(weight[b] for b in r["f"]) / len(r["f"]) if r["f"] else None for r in with_ids}
    assert {r["doc_id"]: r["s"] for r in got} == want


def test_ids_too_many_to_broadcast_count_the_same(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = quality.ratios(docs, labels, buckets=128)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert quality.ratios(docs, labels, buckets=128) == want


def test_labelled_documents_are_told_apart(spark):
    d = "/root/testdata/sf0.01"
    out = quality.op10_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    rate = {r["quality"]: r["k"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] == 1.0 and rate[0] < 0.1


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (5, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(odd_docs, labels).select("doc_id", "n_words", "base_failed", "kept").collect()
    assert len(rows) == odd_docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] != 4)
    assert [r["n_words"] for r in rows if r["doc_id"] == 4] == [60_000]
    assert quality.judge(no_docs, labels).count() == 0
    assert quality.judge(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_threshold_is_fitted_on_every_label(spark):
    """One trusted and one bad score among 60,000 labelled rows decide, wherever their ids hash to."""
    n = 60_000
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    scored = ids.withColumn("score", F.when(F.col("doc_id") % 2 == 1, F.col("doc_id") + 1_000.0).otherwise(-F.col("doc_id") - 1.0))
    labels = ids.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    good, bad = sorted(i + 1_000.0 for i in range(1, n, 2)), sorted(-i - 1.0 for i in range(0, n, 2))

    def exact(v, share):
        at = share * (len(v) - 1)
        i = math.floor(at)
        return v[i] + (at - i) * (v[min(i + 1, len(v) - 1)] - v[i])

    want = (exact(good, quality.GOOD_LOSS) + exact(bad, quality.BAD_SHARE)) / 2
    assert math.isclose(quality.fit_threshold(scored, labels), want, rel_tol=1e-12)


def test_quantile_is_that_of_all_rows(spark):
    values = spark.range(1_001).select(F.pmod(F.xxhash64("id"), F.lit(300)).cast("double").alias("v"))
    for share in (0.0, 0.001, 0.5, 0.95, 1.0):
        assert math.isclose(quality.quantile(values, "v", share), values.agg(F.percentile("v", F.lit(share))).first()[0], rel_tol=1e-12)
    assert quality.quantile(values.limit(0), "v", 0.5) is None


def test_only_texts_with_equal_windows_are_sorted(spark):
    rows = [(0, "", 0), (1, "a b", 0), (2, "a b c", 0), (3, "a b c a b", 0), (4, "a b c d a b c", 6), (5, "x x x x", 4), (6, "x x x x x", 5), (7, "a b c a b c a b c", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, want long")
    n = quality.statistics(F.col("text"), words_of(F.col("text")))["n_repeat_words"]
    out = df.select("doc_id", "want", n.alias("n"))
    assert all(r["n"] == r["want"] for r in out.collect())
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan  # the latter compares by an interpreted lambda
