"""URL filters: pattern rules behind an inverted index on their rarest literal token.

Every rule is a regular expression together with the ways in which a URL can fit it: for each, literal tokens that the URL must
then contain as whole tokens. How often each of those tokens occurs is counted over all URLs; a rule is filed under the
rarest one of each way. A URL then looks up its own tokens, and only the rules that it fetches run their regular expression on
it. DataFrame functions only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules the index is broadcast (a rule is some 200 bytes); a longer list is joined by shuffling.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is matched against host + path, by letter case for host rules, else with A-Z lower-cased. ``literals``: sets of tokens
    ``[a-z0-9]+``; a fitting URL contains, in any letter case, all tokens of one of the sets as whole tokens. A rule with an
    empty set, or without any, is tried on every URL. Host rules (``is_host``) go before patterns; among each the longest wins."""

    rule: str
    verdict: str
    pattern: str
    literals: tuple[tuple[str, ...], ...]
    is_host: bool = False


def host_rule(verdict: str, rule: str) -> UrlRule:
    """A rule ``host/path-prefix``: it fits the host and its subdomains where the path starts with the rule's."""
    host, slash, path = rule.partition("/")
    prefix = slash + path
    words = re.findall("[a-z0-9]+", host.lower())
    in_path = list(re.finditer("[a-z0-9]+", prefix.lower()))
    words += [m[0] for m in in_path if m.end() < len(prefix)]  # a token at the very end may go on in the URL
    return UrlRule(rule, verdict, rf"^(?:[^/]*\.)?{_quoted(host.lower())}{_quoted(prefix)}", (tuple(dict.fromkeys(words)),), True)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/\-])", r"\\\1", text)


def block_pattern(name: str, literals: Sequence[Sequence[str]], pattern: str) -> UrlRule:
    return UrlRule(name, "block", pattern, tuple(tuple(x) for x in literals))


#: The rules of the query's contract, as (verdict, host and path).
CONTRACT_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Patterns of unwanted sites, tried where no host rule fits: name, literal tokens of each way to fit, expression.
DEFAULT_PATTERNS = (
    block_pattern("spam-farm", [("spam", "farm"), ("spamfarm",)], r"^[^/]*(?:^|[.-])spam-?farm[.-]"),
    block_pattern("casino", [("casino",)], r"(?:^|[./_-])casino(?:[./_-]|$)"),
    block_pattern("pills", [("pills",)], r"(?:^|[./_-])(?:cheap|buy|online)-pills(?:[./_-]|$)"),
    block_pattern("bets", [("free", "bets")], r"(?:^|[./_-])free-bets(?:[./_-]|$)"),
    block_pattern("ad-tracker", [("ads", "track")], r"^[^/]*(?:^|\.)ads-track\."),
    block_pattern("adult", [("xxx",)], r"(?:^|[./_-])xxx(?:[./_-]|$)"),
)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def _tokens(key: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(key, UPPER, LOWER), F.lit("([a-z0-9]+)"), F.lit(1)))


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], *, url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` with the columns url_host, url_path, url_rule, url_pattern and url_verdict added.

    url_rule is the host rule that decided, url_pattern the pattern; both null where ``default`` applies. Null URLs and URLs
    without ``://`` have empty host and path, so only rules without literals can fit them. Repeated rows each get their row;
    other columns, whatever their names, pass through, and columns called like the added ones are replaced; an empty table gives
    an empty result. Ties in length go to the smaller rule text. A URL that many rows share is judged once.
    """
    spark = pages.sparkSession
    given = names.without(pages, *[c for c in ("url_host", "url_path", "url_rule", "url_pattern", "url_verdict") if c.lower() != url_col.lower()])
    host, path = url_host(names.col(url_col)), url_path(names.col(url_col))
    keyed = given.select(F.struct(*names.cols(given.columns)).alias("row"), host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", "path"))
    keys = keyed.select("key").distinct().withColumn("token", F.explode(F.concat(_tokens(F.col("key")), F.array(F.lit("")))))
    # How often the rules' tokens occur over all rows; at most one row per token of the rules comes back.
    literals = sorted({t for r in rules for ways in r.literals for t in ways})
    wanted = spark.createDataFrame([(t,) for t in literals], "token string")
    counted = keyed.select(F.explode(_tokens(F.col("key"))).alias("token")).groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counted.join(wanted, "token", "left_semi").collect()} if literals else {}
    index = spark.createDataFrame(
        [(token, r.rule, r.verdict, r.pattern, r.is_host) for r in rules for token in sorted({min(way, key=lambda t: (seen.get(t, 0), t), default="") for way in r.literals or ((),)})],
        "token string, rule string, verdict string, pattern string, is_host boolean",
    )
    fetched = keys.join(F.broadcast(index) if index.count() <= broadcast_rules else index, "token")
    read = F.when(F.col("is_host"), F.col("key")).otherwise(F.translate("key", UPPER, LOWER))
    fits = fetched.where(F.regexp_like(read, F.col("pattern")))
    best = fits.groupBy("key").agg(F.min(F.struct((~F.col("is_host")).alias("late"), (-F.length("rule")).alias("short"), "rule", "verdict", "is_host")).alias("best"))
    out = keyed.join(best, "key", "left")
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in given.columns if c.lower() not in ("url_host", "url_path", "url_rule", "url_pattern", "url_verdict")],
        F.col("host").alias("url_host"),
        F.col("path").alias("url_path"),
        F.when(F.col("best.is_host"), F.col("best.rule")).alias("url_rule"),
        F.when(~F.col("best.is_host"), F.col("best.rule")).alias("url_pattern"),
        F.coalesce("best.verdict", F.lit(default)).alias("url_verdict"),
    )
