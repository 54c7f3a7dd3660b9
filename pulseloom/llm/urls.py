"""URL filters: pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import table

MAX_RULES = 100_000  # a rule table above this is joined without a broadcast hint


@dataclass(frozen=True)
class HostPath:
    """A rule on a host with its subdomains and a path prefix, like ``example.org/en/``."""

    action: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]

    def pattern(self) -> str:
        return f"^(?:[^/]*\\.)?{re.escape(self.host)}{re.escape(self.path)}"

    def literals(self) -> list[str]:
        """Tokens that every fitting url has in full; the last one of the path may go on and is none."""
        whole = self.path.rpartition(self._tail())[0] if self._tail() else self.path
        return _tokens(self.host) + _tokens(whole)

    def _tail(self) -> str:
        return re.search(r"[A-Za-z0-9]*$", self.path).group()


@dataclass(frozen=True)
class Pattern:
    """A rule by regular expression over host + path; ``literals`` are whole tokens that every fitting url has."""

    action: str
    rule: str
    regex: str
    words: tuple[str, ...]

    def pattern(self) -> str:
        return self.regex

    def literals(self) -> list[str]:
        return [w.lower() for w in self.words]


# The rules on hosts and paths, and the method's own patterns of unwanted sites.
SITE_RULES = (
    HostPath("allow", "org/"),
    HostPath("block", "example.org/es/"),
    HostPath("block", "example.org/en/1"),
    HostPath("allow", "com/fr/"),
    HostPath("block", "com/de/"),
)
PATTERN_RULES = (
    Pattern("block", "spam-farm", r"^(?:[^/]*\.)?spam-farm\.", ("spam", "farm")),
    Pattern("block", "cheap-pills", r"^(?:[^/]*\.)?cheap-pills\.", ("cheap", "pills")),
    Pattern("block", "casino-win", r"^(?:[^/]*\.)?casino-win\.", ("casino", "win")),
    Pattern("block", "free-bets", r"^(?:[^/]*\.)?free-bets\.", ("free", "bets")),
    Pattern("block", "adult-x", r"^(?:[^/]*\.)?adult-x\.", ("adult", "x")),
    Pattern("block", "ads-track", r"^(?:[^/]*\.)?ads-track\.", ("ads", "track")),
)


def _tokens(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def host_and_path(url: Column) -> dict[str, Column]:
    """Host in lower case (A-Z only) and path of a url; both empty for null or without ``://``."""
    text = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda i: F.regexp_extract(text, r"(?s)^(?:(?!://).)*+://([^/?#]*+)([^?#]*+)", i)
    return {"host": F.translate(part(1), upper, lower), "path": part(2)}


def filter_urls(pages: DataFrame, *, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES, default: str = "allow", key: str = "page_id") -> DataFrame:
    """Every row of ``pages`` judged by its url: key, host, path, rule, verdict, pattern.

    Each rule is listed under that of its literal tokens which the fewest urls hold (counted over all rows). A url's
    distinct tokens fetch candidate rules, and only these run their regular expression; rules without a literal token
    are candidates of every url. The longest fitting site rule decides (``rule``); without one, a fitting pattern rule
    does (``pattern``, block before allow, then by name); without either, the default. A null url, or one without
    ``://``, has an empty host and path and fits nothing that names a host. Repeated rows are judged alike.
    """
    spark = pages.sparkSession
    parts = host_and_path(F.col("url"))
    rows = pages.select(F.col(key), parts["host"].alias("host"), parts["path"].alias("path"))
    urls = rows.select("host", "path")
    tokens = F.array_distinct(
        F.array_append(F.array_remove(F.split(F.lower(F.concat("host", F.lit(" "), "path")), "[^a-z0-9]+"), ""), F.lit(""))
    )
    rules = [*((0, r) for r in site_rules), *((1, r) for r in pattern_rules)]
    wanted = sorted({t for _, r in rules for t in r.literals()})
    counts = (
        urls.select(F.explode(F.array_intersect(tokens, F.array(F.lit(""), *[F.lit(t) for t in wanted]))).alias("t"))
        .groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    )
    seen = {r["t"]: r["n"] for r in counts.collect()}  # one row per literal token of the rules at most
    listed = spark.createDataFrame(
        [(min(r.literals(), key=lambda t: (seen.get(t, 0), t), default=""), kind, r.rule, r.action, r.pattern()) for kind, r in rules],
        "token string, kind int, rule string, action string, regex string",
    )
    if len(rules) <= MAX_RULES:
        listed = F.broadcast(listed)
    # Each url is judged once, however many rows have it; only urls with a fitting rule come back.
    found = (
        urls.distinct().withColumn("token", F.explode(tokens)).join(listed, "token")
        .filter("concat(host, path) rlike regex")
        .groupBy("host", "path").agg(
            F.max(F.when(F.col("kind") == 0, F.struct(F.length("rule").alias("n"), "rule", "action"))).alias("_s"),
            F.min(F.when(F.col("kind") == 1, F.struct((F.col("action") != "block").alias("n"), "rule", "action"))).alias("_p"),
        )
    )
    return rows.join(found, ["host", "path"], "left").select(
        key, "host", "path", F.col("_s.rule").alias("rule"),
        F.coalesce("_s.action", "_p.action", F.lit(default)).alias("verdict"),
        F.when(F.col("_s.rule").isNull(), F.col("_p.rule")).alias("pattern"),
    )


def op2_urls(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(
        f"({kind}, {quote(r.rule)}, {quote(r.action)}, {quote(r.pattern())})"
        for kind, r in [*((0, r) for r in SITE_RULES), *((1, r) for r in PATTERN_RULES)]
    )
    return f"""with rules(kind, rule, action, regex) as (values {values}),
  cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
  p as (select page_id, lower(regexp_extract(rest, '^[^/?#]*')) host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from cut),
  f as (select page_id, kind, rule, action from p join rules on regexp_matches(host || path, regex)),
  s as (select page_id, arg_max(rule, length(rule)) rule, arg_max(action, length(rule)) action from f where kind = 0 group by page_id),
  m as (select page_id, arg_min(rule, (action <> 'block', rule)) pattern, arg_min(action, (action <> 'block', rule)) action
    from f where kind = 1 group by page_id)
  select p.page_id, host, path, s.rule, coalesce(s.action, m.action, 'allow') verdict,
    case when s.rule is null then m.pattern end pattern
  from p left join s using (page_id) left join m using (page_id)"""


SQL = _sql()
