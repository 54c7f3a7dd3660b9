"""License scans: TF-IDF cosine of files, blocks and lines to templates, then inheritance from the nearest directory with a licence file."""

from __future__ import annotations

import math
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.common import let, table
from pulseloom.session import materialize

# Short public notices by licence id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1 of the License."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
)
MATCH = 0.75
FILE_SHARE = 0.5
TOKEN_SPLIT = "[^a-z0-9]+"
TEXTS = Path(__file__).resolve().parent / "licence_texts"  # full texts and standard headers, read by the driver
COMMENT = r"^\s*(?:///?|/?\*|#|--|;|%|<!--|!|dnl\b|rem\b)"
FILE, BLOCK, LINE = 0, 1, 2  # kinds of units


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(text), ".", ""), TOKEN_SPLIT), "")


def full_texts() -> tuple[tuple[str, str], ...]:
    """Licence id and text of every full licence text and standard header."""
    return tuple((p.name.removesuffix(".txt").removesuffix(".header"), p.read_text()) for p in sorted(TEXTS.glob("*.txt")))


def template_terms(templates=TEMPLATES) -> dict[str, dict[str, int]]:
    """Term counts of every template, tokenised as ``tokens`` does."""
    import re

    out: dict[str, dict[str, int]] = {}
    for name, text in templates:
        counts: dict[str, int] = {}
        for t in re.split(TOKEN_SPLIT, text.lower().replace(".", "")):
            if t:
                counts[t] = counts.get(t, 0) + 1
        out[name] = counts
    return out


def frequencies(files: DataFrame) -> DataFrame:
    """token, n: in how many texts it is, for every token of all texts; the token "" holds the number of texts."""
    have = F.array_append(F.array_distinct(tokens(F.coalesce(F.col("text"), F.lit("")))), F.lit(""))
    return files.select(F.explode(have).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def inverse_frequency(total: Column, n: Column) -> Column:
    return F.log((1 + total) / (1 + n)) + 1


def term_frequencies(counts: DataFrame, terms: list[str]) -> tuple[dict[str, int], int]:
    """In how many texts each template term is, and the number of texts."""
    seen = {r["token"]: r["n"] for r in counts.filter(F.col("token").isin(["", *terms])).collect()}  # at most one row per template term
    return {t: seen.get(t, 0) for t in terms}, seen.get("", 0)


def key_terms(weights: dict[str, float], match: float, seen: dict[str, int]) -> list[str]:
    """Terms of which a text must have one to come within ``match`` of a template.

    What is left of the template without them has less than ``match`` of its norm, so by Cauchy-Schwarz a text that
    shares only the rest stays below. Terms that are in the fewest texts for their weight come first.
    """
    norm2 = sum(w * w for w in weights.values())
    rest, keys = norm2, []
    for t, w in sorted(weights.items(), key=lambda x: (seen[x[0]] / x[1] ** 2, -x[1], x[0])):
        if rest < match * match * norm2 * (1 - 1e-9):
            break
        keys.append(t)
        rest -= w * w
    return keys


def fewest_terms(weights: dict[str, float], match: float) -> int:
    """How many different terms of a template a text has at least that comes within ``match`` of it (Cauchy-Schwarz)."""
    squares = sorted((w * w for w in weights.values()), reverse=True)
    need, n = match * match * sum(squares) * (1 - 1e-9), 0
    while need > 0 and n < len(squares):
        need -= squares[n]
        n += 1
    return n


def any_term(terms: list[str]) -> str:
    """Pattern of a text that has one of the terms; terms with the same start share it, so a word is tried once."""

    def branch(rest: list[str]) -> str:
        heads = sorted({t[0] for t in rest if t})
        arms = [c + "\\.*+" + branch([t[1:] for t in rest if t[:1] == c]) for c in heads]
        arms += ["(?:$|[^a-z0-9.])"] if "" in rest else []
        return arms[0] if len(arms) == 1 else "(?:" + "|".join(arms) + ")"

    return "(?:^|[^a-z0-9.])\\.*+" + branch(terms) if terms else "$^"


def blocks(text: Column) -> Column:
    """Neighbouring lines that belong together: runs of comment lines, bodies of /* */, and paragraphs; single lines are left out."""
    cut = "\u0001"
    lines = F.split(text, "\n")
    joined = lambda apart: F.split(F.array_join(F.transform(lines, lambda x: F.when(apart(x), F.lit(cut)).otherwise(F.translate(x, cut, " "))), "\n"), cut)
    comments = joined(lambda x: ~F.lower(x).rlike(COMMENT))
    paragraphs = joined(lambda x: F.trim(F.translate(x, "\t\r", "  ")) == "")
    bodies = F.transform(F.filter(F.split(text, r"\*/"), lambda x: x.contains("/*")), lambda x: F.substring_index(x, "/*", -1))
    return F.array_distinct(F.filter(F.concat(comments, paragraphs, bodies), lambda x: F.trim(F.translate(x, "\n", " ")) != F.lit("")))


def scan_units(files: DataFrame, *, templates=TEMPLATES, texts=None, match: float = MATCH) -> DataFrame:
    """Best template of every unit that reaches ``match``: path, kind, unit, license, score, full, n_tokens.

    Units are the whole file, its blocks and its lines; all are measured against the short ``templates`` and the full
    ``texts``. Vectors are tf * idf, and the idf of every token, in a template or not, is that of all texts. Units that
    cannot match by the Cauchy-Schwarz inequality are left out before anything is exploded; units of equal tokens are
    scored once. A full text goes before a short notice, ties go to the smaller licence id.
    """
    spark = files.sparkSession
    texts = full_texts() if texts is None else texts
    # Templates are numbered: a licence may have several.
    named = [(name, False, *template_terms([(name, t)]).values()) for name, t in templates]
    named += [(name, True, *template_terms([(name, t)]).values()) for name, t in texts]
    vocabulary = sorted({t for _, _, c in named for t in c})
    frequency = materialize(frequencies(files))
    seen, total = term_frequencies(frequency, vocabulary)
    idf = {t: math.log((1 + total) / (1 + n)) + 1 for t, n in seen.items()}
    weighted = [(name, full, {t: n * idf[t] for t, n in c.items()}) for name, full, c in named]
    keys = lambda which: sorted({k for _, full, w in weighted if full in which for k in key_terms(w, match, seen)})
    short, every, whole = any_term(keys([False])), any_term(keys([False, True])), any_term(keys([True]))
    long = [(fewest_terms(w, match), F.split(F.lit(" ".join(w)), " ")) for _, full, w in weighted if full]
    least = min((n for n, _ in long), default=0)
    enough = lambda have: (F.size(have) >= least) & reduce(
        lambda x, y: x | y, (F.size(F.array_intersect(have, terms)) >= n for n, terms in long)
    )
    possible = lambda x: F.lower(x).rlike(short) | (F.lower(x).rlike(whole) & let(F.array_distinct(tokens(x)), enough) if long else F.lit(False))
    units = lambda kind, xs: F.transform(
        F.filter(xs, possible), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit"), F.array_join(tokens(x), " ").alias("words"))
    )
    text = F.col("text")
    found = files.filter(F.lower(text).rlike(every)).select(
        "path", F.explode(F.concat(units(FILE, F.array(text)), units(BLOCK, blocks(text)), units(LINE, F.split(text, "\n")))).alias("u")
    )
    found = materialize(found.select("path", "u.*", F.md5(F.encode("u.words", "UTF-8")).alias("id")))
    index = F.broadcast(spark.createDataFrame(  # one row per template term: bounded by the templates
        [(t, idf[t], k, w / math.sqrt(sum(x * x for x in ws.values()))) for k, (_, _, ws) in enumerate(weighted) for t, w in ws.items()],
        "token string, idf double, template int, weight double",
    ))
    names = F.broadcast(spark.createDataFrame([(k, name, full) for k, (name, full, _) in enumerate(weighted)], "template int, license string, full boolean"))
    once = found.groupBy("id").agg(F.first("words").alias("words"))
    tf = once.select("id", F.explode(F.split("words", " ")).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    norms = tf.join(frequency, "token").groupBy("id").agg(
        F.sqrt(F.sum(F.pow(F.col("tf") * inverse_frequency(F.lit(total), F.col("n")), 2))).alias("_norm")
    )
    dots = tf.join(index, "token").groupBy("id", "template").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("_dot"))
    scores = dots.join(norms, "id").withColumn("score", F.round(F.col("_dot") / F.col("_norm"), 6)).filter(F.col("score") >= match)
    best = F.min(F.struct((~F.col("full")).alias("f"), (-F.col("score")).alias("s"), F.col("license").alias("l")))
    of_id = scores.join(names, "template").groupBy("id").agg(best.alias("b"))
    return found.select("path", "kind", "unit", "id", F.size(F.split("words", " ")).alias("n_tokens")).join(of_id, "id").select(
        "path", "kind", "unit", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score"), (~F.col("b.f")).alias("full"), "n_tokens"
    )


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licenses(
    files: DataFrame, *, templates=TEMPLATES, texts=None, match: float = MATCH, file_share: float = FILE_SHARE
) -> DataFrame:
    """One row per path: path, own_license, own_score, is_license_file, license, license_from.

    ``own_license`` is that of the best matching unit: the file as a whole, a block of neighbouring lines, or a line. A
    file that matches as a whole, or of whose tokens at least ``file_share`` stand in matching lines, is a licence file
    and covers its directory and all below that have no nearer one; of several in one
    directory the higher score wins, then the smaller path. ``license`` is the own licence, else the inherited one, else
    null; ``license_from`` is the directory it came from ("" is the root; null for own or none).

    Paths must be unique per file; rows with equal path are read as one file whose lines follow each other in no fixed
    order. A null path is a file without a directory, a null or empty text has no licence, and an empty table gives no rows.
    """
    files = files.select("path", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    hits = scan_units(files.filter("path is not null"), templates=templates, texts=texts, match=match)
    first = F.min(F.struct((~F.col("full")).alias("f"), (-F.col("score")).alias("s"), F.col("license").alias("l")))
    own = hits.groupBy("path").agg(
        first.alias("b"), F.sum(F.when(F.col("kind") == LINE, F.col("n_tokens"))).alias("_matched"), F.max(F.col("kind") == FILE).alias("_whole")
    ).select("path", F.col("b.l").alias("own_license"), (-F.col("b.s")).alias("own_score"), "_matched", "_whole")
    # Only paths and counts are joined from here on, no texts.
    sizes = files.groupBy("path").agg(F.sum(F.size(tokens(F.col("text")))).alias("_n"))
    known = sizes.join(own, "path", "left").withColumn(
        "is_license_file", F.coalesce("_whole", F.lit(False)) | F.coalesce(F.col("_matched") >= F.col("_n") * file_share, F.lit(False))
    ).withColumn("_dir", folder_of(F.col("path")))
    pick = F.min(F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own_license").alias("l")))
    covers = known.filter("is_license_file").groupBy("_dir").agg(pick.alias("b")).select(F.col("_dir").alias("_up"), F.col("b.l").alias("_license"))
    # Each directory once, whatever the number of its files: a directory that holds a third of them is one row here.
    dirs = known.select("_dir").distinct()
    parts = F.split("_dir", "/")
    ups = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up"))
    )
    chain = dirs.filter("_dir is not null").select("_dir", F.explode(ups).alias("u")).select("_dir", "u.depth", F.col("u.up").alias("_up"))
    near = chain.join(covers, "_up").groupBy("_dir").agg(F.max_by(F.struct("_license", "_up"), "depth").alias("n"))
    out = known.join(near, "_dir", "left")
    inherits = F.col("own_license").isNull()
    return out.select(
        "path", "own_license", "own_score", "is_license_file",
        F.coalesce("own_license", F.col("n._license")).alias("license"),
        F.when(inherits, F.col("n._up")).alias("license_from"),
    )


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Documents under source/language/block of 50 ids/doc_id; nulls are spelled out as such."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    block = F.coalesce(F.expr("doc_id div 50").cast("string"), F.lit("null"))
    return docs.select(F.concat_ws("/", part("source"), part("lang"), block, part("doc_id")).alias("path"), "text")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(documents_as_files(table(spark, sf_dir, "documents")))
    return out.withColumn("doc_id", F.regexp_extract("path", "[^/]*$", 0).cast(T.LongType()))


def _sql() -> str:
    terms = [(name, t, n) for name, c in template_terms().items() for t, n in c.items()]
    values = ", ".join(f"('{a}', '{t}', {n})" for a, t, n in terms)
    words = "list_filter(regexp_split_to_array(replace(lower({}), '.', ''), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""with tmpl(license, token, n) as (values {values}),
  vocab as (select distinct token from tmpl),
  files as (select concat_ws('/', coalesce(source, 'null'), coalesce(lang, 'null'), coalesce(cast(doc_id // 50 as varchar), 'null'),
      coalesce(cast(doc_id as varchar), 'null')) path, doc_id, coalesce(text, '') text from documents),
  total as (select count(*) n from files),
  have as (select distinct path, unnest({words.format('text')}) token from files),
  df as (select token, count(h.path) df from vocab left join have h using (token) group by token),
  idf as (select token, ln((1 + n) / (1 + df)::double) + 1 idf from df, total),
  tw as (select license, token, t.n * idf w from tmpl t join idf using (token)),
  tn as (select license, sqrt(sum(w * w)) norm from tw group by license),
  raw_lines as (select path, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) line from files),
  lines as (select path, line, {words.format('t')} ws from raw_lines),
  toks as (select path, line, len(ws) line_tokens, unnest(ws) token from lines),
  tf as (select path, line, line_tokens, token, count(*) tf from toks group by all),
  norms as (select path, line, sqrt(sum(case when idf is null then tf * power(ln(1 + n::double) + 1, 2) else power(tf * idf, 2) end)) norm
    from tf left join idf using (token), total group by path, line),
  dots as (select path, line, line_tokens, license, sum(tf * idf * w / tn.norm) dot
    from tf join idf using (token) join tw using (token) join tn using (license) group by all),
  scored as (select path, line, line_tokens, license, round(dot / norm, 6) score from dots join norms using (path, line)),
  best as (select * from scored where score >= {MATCH}
    qualify row_number() over (partition by path, line order by score desc, license) = 1),
  own as (select path, arg_min(license, (-score, license)) own_license, max(score) own_score, sum(line_tokens) matched from best group by path),
  known as (select f.path, doc_id, own_license, own_score, coalesce(matched >= len({words.format('text')}) * {FILE_SHARE}, false) is_license_file,
      regexp_replace(f.path, '/?[^/]*$', '') dir from files f left join own using (path)),
  covers as (select dir up, arg_min(own_license, (-own_score, path)) lic from known where is_license_file group by dir),
  near as (select path, arg_max(lic, length(up)) lic, arg_max(up, length(up)) up
    from known join covers on up = '' or dir = up or starts_with(dir, up || '/') group by path)
  select k.path, own_license, own_score, is_license_file, coalesce(own_license, lic) license,
    case when own_license is null then up end license_from, doc_id from known k left join near using (path)"""


SQL = _sql()
