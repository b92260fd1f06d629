"""URL filters: host and path rules, and pattern rules found by their rarest literal token.

A pattern rule is a regular expression with literal tokens that any URL it
matches must contain as whole tokens.  Each rule is indexed once, under the
token that fewest URLs of the corpus contain; a URL's tokens fetch candidate
rules, and only those run their expression.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class HostRule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class PatternRule(NamedTuple):
    """``tokens``: lower-case runs of letters and digits that every match contains as whole tokens."""

    pattern: str
    tokens: tuple[str, ...]


HOST_RULES = (HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("example.com", "/de/", "block"), HostRule("org", "/fr/", "allow"))
PATTERN_RULES = (
    PatternRule(r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule(r"[./-]casino[./-]", ("casino",)),
    PatternRule(r"[./-](free|cheap)-pills[./?-]", ("pills",)),
    PatternRule(r"[./-]viagra[./?-]", ("viagra",)),
    PatternRule(r"[./-]online-pharmacy[./-]", ("online", "pharmacy")),
    PatternRule(r"[./-]porn[./-]", ("porn",)),
    PatternRule(r"[./-]xxx[./-]", ("xxx",)),
    PatternRule(r"[./-]warez[./-]", ("warez",)),
    PatternRule(r"/wp-login\.php([?#]|$)", ("wp", "login", "php")),
    PatternRule(r"://([^/?#]*\.)?doubleclick\.net/", ("doubleclick", "net")),
    PatternRule(r"/ads/banner[./?-]", ("ads", "banner")),
)
TOKEN = r"[a-z0-9]+"


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(url, UPPER, LOWER), F.lit(TOKEN), F.lit(0)))


def rarest_tokens(urls: DataFrame, url_col: str, rules: tuple[PatternRule, ...]) -> dict[str, list[int]]:
    """Rules by the token of theirs that fewest rows contain; ties go to the longer, then earlier token.

    Counts cover all rows but only the rules' own tokens, so their number is
    that of the rules.
    """
    known = sorted({t for r in rules for t in r.tokens})
    if not known:
        return {}
    mine = F.explode(F.array_intersect(tokens_of(F.col(url_col)), F.array(*map(F.lit, known)))).alias("token")
    counts = {r["token"]: r["n"] for r in urls.select(mine).groupBy("token").agg(F.count("*").alias("n")).collect()}
    index = defaultdict(list)
    for i, rule in enumerate(rules):
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(i)
    return dict(index)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, url_col: str = "url", host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, pattern``, clashing columns replaced.

    The longest host and path rule that fits decides.  Where none does, the
    URL is blocked if a pattern rule matches, with the first such rule as
    ``pattern``, and allowed otherwise.  A null or empty URL, or one without
    ``://``, has empty host and path and is judged by the patterns, none of
    which fits a null.
    """
    host, path = F.col("host"), F.col("path")
    longest = sorted(host_rules, key=lambda r: (-len(r.name), r.name))
    fits = [(host == r.host) | host.endswith("." + r.host) for r in longest]
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, fit in reversed(list(zip(longest, fits, strict=True))):
        both = fit & path.startswith(r.path)
        rule, verdict = F.when(both, F.lit(r.name)).otherwise(rule), F.when(both, F.lit(r.verdict)).otherwise(verdict)
    index = rarest_tokens(pages, url_col, pattern_rules)
    patterns = [r.pattern for r in pattern_rules]

    @F.pandas_udf("int")
    def first_match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled, token = [re.compile(p) for p in patterns], re.compile(TOKEN)
        lower = str.maketrans(UPPER, LOWER)

        def of(url: str | None) -> int | None:
            if not url:
                return None
            url = url.translate(lower)
            candidates = sorted({i for t in set(token.findall(url)) & index.keys() for i in index[t]})
            return next((i for i in candidates if compiled[i].search(url)), None)

        for urls in batches:
            yield pd.Series([of(u) for u in urls], dtype="Int32")

    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "pattern")]
    rows = pages.select(*(F.col(f"`{c}`") for c in rest), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), first_match(F.col(url_col).cast("string")).alias("_match"))
    by_pattern = F.when(F.col("_match").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    named = F.element_at(F.array(*map(F.lit, patterns or [""])), F.col("_match") + 1)
    return rows.select(*(F.col(f"`{c}`") for c in rest), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_pattern).alias("verdict"), named.alias("pattern"))


_FITS = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
#: Each pattern is run on every row, without the index.
ORACLE_SQL = f"""
with split as (
  select page_id, url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
         coalesce({" or ".join(f"regexp_matches(translate(url, '{UPPER}', '{LOWER}'), '{r.pattern}')" for r in PATTERN_RULES)}, false) as hit
  from pages
), ruled as (
  select *, case {" ".join("when " + _FITS.format(h=r.host, p=r.path) + f" then '{r.name}'" for r in sorted(HOST_RULES, key=lambda r: (-len(r.name), r.name)))} end as rule
  from split
)
select page_id, host, path, rule,
       case {" ".join(f"when rule = '{r.name}' then '{r.verdict}'" for r in HOST_RULES)}
            when hit then 'block' else 'allow' end as verdict
from ruled
"""
