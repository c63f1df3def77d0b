"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A vocabulary has strict and soft terms. A term counts where no ASCII letter or digit stands directly before
or behind it in the lower-cased url. One strict term blocks a url, and so do ``soft_limit`` different soft
ones; the same soft term twice counts once.

Rules are (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with the
rule's path; of several the longest wins, and its verdict stands whatever the vocabulary says.

Defined cases: a null url, or one without ``://``, has an empty host and path, and the vocabulary judges
the whole string (null: nothing to judge, allowed). Very long urls are judged whole. Repeated rows are
judged alike; an empty table gives no rows; result columns replace input columns of the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscan.llm.common import with_fields

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["host", "path", "rule", "n_strict", "n_soft", "verdict"]


@dataclass(frozen=True)
class UrlFilter:
    rules: tuple[tuple[str, str, str], ...] = ()
    strict: tuple[str, ...] = ("porn", "xxx", "sex", "casino-win", "warez", "escort")
    soft: tuple[str, ...] = (
        "adult", "bet", "bonus", "casino", "cheap", "dating", "free", "gamble", "hot", "pills", "poker",
        "replica", "slots", "viagra", "win",
    )
    soft_limit: int = 2


@lru_cache(maxsize=8)
def automaton(terms: tuple[tuple[str, bool], ...]) -> ahocorasick.Automaton | None:
    """Built once per worker."""
    if not terms:
        return None
    found = ahocorasick.Automaton()
    for term, strict in terms:
        found.add_word(term, (term, strict))
    found.make_automaton()
    return found


def _bounded(text: str, start: int, end: int) -> bool:
    return not (
        start > 0 and text[start - 1].isascii() and text[start - 1].isalnum()
        or end < len(text) and text[end].isascii() and text[end].isalnum()
    )


def count_terms(url: str, terms: tuple[tuple[str, bool], ...]) -> tuple[int, int]:
    """Different strict and soft terms in a lower-cased url."""
    found = automaton(terms)
    if found is None:
        return 0, 0
    hits = {item for end, item in found.iter(url) if _bounded(url, end + 1 - len(item[0]), end + 1)}
    strict = sum(is_strict for _, is_strict in hits)
    return strict, len(hits) - strict


def rule_table(rules: Iterable[tuple[str, str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Host -> (path, verdict) from the longest path on."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    return {h: sorted(v, key=lambda x: (-len(x[0]), x)) for h, v in by_host.items()}


def find_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """The longest fitting rule as (rule, verdict): one lookup for each label of the host."""
    best: tuple[str, str] | None = None
    rest = host
    while rest:
        for prefix, verdict in by_host.get(rest, ()):
            if path.startswith(prefix):
                if best is None or len(rest) + len(prefix) > len(best[0]):
                    best = (rest + prefix, verdict)
                break
        _, dot, rest = rest.partition(".")
        if not dot:
            break
    return best


def split_url(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def judge_urls(df: DataFrame, config: UrlFilter, url: str = "url") -> DataFrame:
    """df with host, path, rule, n_strict, n_soft, verdict ('allow' or 'block')."""
    rules, soft_limit = config.rules, config.soft_limit
    terms = tuple([(t, True) for t in config.strict] + [(t, False) for t in config.soft if t not in config.strict])

    @F.pandas_udf("rule string, n_strict int, n_soft int, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        by_host = rule_table(rules)
        for urls, hosts, paths in batches:
            rows = []
            for text, host, path in zip(urls, hosts, paths):
                strict, soft = count_terms(text, terms)
                blocked = strict >= 1 or soft >= soft_limit
                rule, verdict = find_rule(host, path, by_host) or (None, "block" if blocked else "allow")
                rows.append((rule, strict, soft, verdict))
            yield pd.DataFrame(rows, columns=["rule", "n_strict", "n_soft", "verdict"])

    host, path = split_url(F.col(f"`{url}`"))
    lowered = F.translate(F.coalesce(F.col(f"`{url}`"), F.lit("")), UPPER, LOWER)
    found = judge(lowered, host, path)
    holder = f"_found_{uuid.uuid4().hex}"
    split = with_fields(df, F.struct(host.alias("host"), path.alias("path"), found.alias(holder)), ["host", "path", holder])
    result = F.struct("host", "path", *(F.col(holder)[n].alias(n) for n in FIELDS[2:]))
    return with_fields(split, result, FIELDS).drop(holder)
