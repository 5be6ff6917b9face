"""Allow and block rules for URLs, indexed by the rarest literal token of each rule.

A rule is text in which ``||`` at the start anchors it at a label of the host, ``*`` stands
for anything and ``^`` for a character that is no letter or digit, or an end. It is matched
against host and path together. A rule can only fit a URL that holds all its whole literal
tokens, so it is filed under the one that is rarest among the URLs; the tokens of a URL fetch
the rules filed under them, and only those run their regular expression. Rules without a
whole token are filed under the empty token, which every URL has.

Among the rules that fit, the lowest ``tier`` wins, then the longest name, then the smaller
name. Decisions are made once for each distinct URL.

Defined results: a null URL and one without ``://`` have an empty host and path, fit no rule
and get the default verdict. Repeated rows each get the decision of their URL. Columns of the
input that are named like results are replaced, others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.storage import free_names, kept, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    verdict: str
    tier: int = 0
    fold_case: bool = False


# The rules that the query applies to every table of pages.
BASE_RULES = (
    Rule("net/", "||net/", "block"),
    Rule("example.net/en/", "||example.net/en/", "allow"),
    Rule("example.com/de/", "||example.com/de/", "block"),
    Rule("org/fr/", "||org/fr/", "allow"),
)

UNWANTED = (
    "adult", "casino", "porn", "xxx", "pills", "viagra", "gambling", "betting", "escort",
    "malware", "phishing", "warez", "torrent", "doubleclick", "adserver",
)
PATTERN_RULES = tuple(Rule(f"^{word}^", f"^{word}^", "block", 1, True) for word in UNWANTED)


def regex_of(rule: Rule) -> str:
    """The regular expression of a rule over host and path."""
    body, anchored = rule.pattern.removeprefix("||"), rule.pattern.startswith("||")
    special = {"*": ".*", "^": "(?:[^A-Za-z0-9]|^|$)"}
    text = "".join(special.get(c, re.sub(r"([\\.\[\](){}+?|$])", r"\\\1", c)) for c in body)
    return ("(?is)" if rule.fold_case else "(?s)") + (r"^(?:[^/?#]*\.)?" if anchored else "") + text


def literal_tokens(rule: Rule) -> list[str]:
    """Tokens that every URL which fits must hold as whole tokens; the empty one if none."""
    body, anchored = rule.pattern.removeprefix("||").translate(str.maketrans(UPPER, LOWER)), rule.pattern.startswith("||")
    whole = []
    for m in re.finditer("[a-z0-9]+", body):
        before = body[m.start() - 1] if m.start() else ("|" if anchored else "*")
        after = body[m.end()] if m.end() < len(body) else "*"
        if before != "*" and after != "*":
            whole.append(m[0])
    return sorted(set(whole)) or [""]


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """``(name, verdict, tier, regex, tokens)`` of a list of rules."""
    rows = [
        F.struct(
            F.lit(r.name).alias("name"),
            F.lit(r.verdict).alias("verdict"),
            F.lit(r.tier).alias("tier"),
            F.lit(regex_of(r)).alias("regex"),
            F.array(*map(F.lit, literal_tokens(r))).alias("tokens"),
        )
        for r in rules
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``tier`` and ``verdict``.

    ``rules`` has the columns of :func:`rule_table`. The index of the rules is a written table
    of one row per rule; it is broadcast only if its counted size is small.
    """
    pages = pages.drop("host", "path", "rule", "tier", "verdict")
    host, path = host_and_path(F.col("url"))
    urls = pages.select("url").distinct().select("url", F.concat(host, path).alias("place")).filter("place <> ''")
    words = F.array_remove(F.split(F.translate("place", UPPER, LOWER), "[^a-z0-9]+"), "")
    tokens = urls.select("url", "place", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), words))).alias("token"))
    filed = kept(rules.select("name", "verdict", "tier", "regex", F.explode("tokens").alias("token")), "url-rules")
    counts = tokens.join(small_side(filed.select("token").distinct(), 100), "token").groupBy("token").agg(F.count("*").alias("c"))
    index = kept(
        filed.join(counts, "token", "left")
        .groupBy("name", "verdict", "tier", "regex")
        .agg(F.min_by("token", F.struct(F.coalesce("c", F.lit(0)), "token")).alias("token")),
        "url-index",
    )
    # Descending: the lower tier, then the longer name, then the smaller one.
    rank = F.struct("tier", (-F.length("name")).alias("longer"), "name", "verdict")
    of, best = free_names(pages, "url", "best")
    decided = (
        tokens.join(small_side(index, 1000), "token")
        .filter(F.regexp_like("place", F.col("regex")))
        .groupBy("url")
        .agg(F.min(rank).alias("best"))
        .select(F.col("url").alias(of), F.col("best").alias(best))
    )
    return (
        pages.join(decided, F.col("url") == F.col(of), "left")
        .withColumns(
            {
                "host": host,
                "path": path,
                "rule": F.col(f"{best}.name"),
                "tier": F.col(f"{best}.tier"),
                "verdict": F.coalesce(f"{best}.verdict", F.lit(default)),
            }
        )
        .drop(of, best)
    )
