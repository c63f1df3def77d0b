"""Quality rules: what a public vocabulary makes of a text, with rejection bands per language or script.

A text is cut into tokens of a byte-level vocabulary (a rank file). Three measures follow: characters per
token, the share of tokens that are parts of characters because no token covers them whole (the vocabulary
falls back to bytes), and the entropy of the text's tokens in bits. The entropy is compared with the most that so
many tokens could have, so that short and long texts share a band. A band names the accepted range of each measure.

The band is that of the language; without one, that of the script with most letters in the text. ``fit_bands``
learns the bands of languages from texts that are known to be good: the range between two outer quantiles, and a margin.

Base counts, over words ``[^\\x20\\x09-\\x0D]+``: words, their code points, symbols, repeated lines and words
in repeated windows of three. A text fails the base if it has fewer than 50 words or if more than half its
words are in repeated windows.

Defined cases: a null text has no words and fails; an empty one too; very long texts are measured whole; a
null language is judged by script; repeated rows are judged alike; an empty table gives no rows; result
columns replace input columns of the same name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscan.llm.common import with_fields

SYMBOLS = b"#*$%&|<>"
# The white space of the splitting pattern.
LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")
MIN_WORDS, REPEAT_PERCENT = 50, 50
MEASURED = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token",
    "byte_share", "token_entropy", "script", "base_failed",
]
FIELDS = [*MEASURED, "kept"]
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, byte_share double, token_entropy double, script string, base_failed boolean"
)
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3),
)


@dataclass(frozen=True)
class Band:
    """Accepted ranges, ends included."""

    chars_per_token: tuple[float, float] = (1.5, 8.0)
    byte_share: tuple[float, float] = (0.0, 0.10)
    relative_entropy: tuple[float, float] = (0.35, 1.0)


def _default_bands() -> dict[str, Band]:
    wide = Band((0.5, 6.0), (0.0, 0.6))
    return {name: wide for name, _, _ in SCRIPTS if name != "latin"} | {"latin": Band(), "other": Band((0.3, 8.0), (0.0, 0.9))}


@dataclass(frozen=True)
class FertilityRules:
    bands: Mapping[str, Band] = field(default_factory=_default_bands)  # by language or script


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=n)
    if len(known) == n:
        return 0
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, windows, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] > 1
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """words, their code points, symbols, repeated lines, words in repeated windows."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    white = len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(text) - white, symbols, len(lines) - len(set(lines)), repeated_words(words)


def script_of(text: str) -> str:
    """The script with most letters; 'other' if no known script has any."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    best, most = "other", 0
    for name, low, high in SCRIPTS:
        inside = (codes >= low) & (codes <= high)
        if name == "latin":
            inside &= ~((codes >= 0x5B) & (codes <= 0x60) | (codes >= 0x7B) & (codes <= 0xBF))
        n = int(inside.sum())
        if n > most:
            best, most = name, n
    return best


@lru_cache(maxsize=2)
def load_vocabulary(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and for each id whether it is a part of a character. Read once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    partial = np.zeros(max(ranks.values()) + 1, dtype=bool)
    for token, rank in ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            partial[rank] = True
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), partial


def _last_of_run(text: str, end: int) -> int:
    """Where the piece that a run of white space makes ends: its last character goes with what follows."""
    return end if end == len(text) else end - 1


def encode(text: str, encoding: tiktoken.Encoding) -> list[int]:
    """The token ids of a text. Long runs of white space, which the splitting pattern cannot take, are encoded apart.

    The pattern makes one piece of a run but for its last character, or of all of it at the end of the text.
    """
    ids: list[int] = []
    start = 0
    for run in LONG_RUN.finditer(text):
        end = _last_of_run(text, run.end())
        ids += encoding.encode_ordinary(text[start : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        start = end
    return ids + encoding.encode_ordinary(text[start:])


def measures(text: str, encoding: tiktoken.Encoding, partial: np.ndarray) -> tuple[int, float, float, float]:
    """tokens, characters per token, byte share, entropy in bits."""
    ids = np.array(encode(text, encoding), dtype=np.int64)
    n = len(ids)
    if n == 0:
        return 0, 0.0, 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1]
    p = counts / n
    return n, len(text) / n, float(partial[ids].mean()), float(-(p * np.log2(p)).sum()) + 0.0


def measure_fertility(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """df with MEASURED. vocabulary: the path of a rank file that every executor has; pattern: how it splits text."""

    @F.pandas_udf(SCHEMA)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoding, partial = load_vocabulary(vocabulary, pattern)
        for texts in batches:
            rows = []
            for body in texts:
                base = base_counts(body)
                failed = base[0] < MIN_WORDS or 100 * base[4] > REPEAT_PERCENT * base[0]
                body = body or ""
                rows.append((*base, *measures(body, encoding, partial), script_of(body), failed))
            yield pd.DataFrame(rows, columns=MEASURED)

    return with_fields(df, measure(F.col(f"`{text}`")), MEASURED)


def relative_entropy() -> Column:
    """Entropy as a share of the most that so many tokens can have; 1 for a single token."""
    return F.when(F.col("n_tokens") > 1, F.col("token_entropy") / F.log2("n_tokens")).otherwise(1.0)


def _compared() -> dict[str, Column]:
    return {
        "chars_per_token": F.col("chars_per_token"),
        "byte_share": F.col("byte_share"),
        "relative_entropy": relative_entropy(),
    }


def fit_bands(measured: DataFrame, lang: str = "lang", margin: float = 0.5, least: int = 50) -> dict[str, Band]:
    """Bands per language from the measures of good texts; languages with fewer than ``least`` such texts get none.

    The range from the 1st to the 99th percentile of those that pass the base, wider by ``margin`` of itself on
    either side.
    """
    rows = measured.where("not base_failed").select(F.col(f"`{lang}`").alias("lang"), *(c.alias(n) for n, c in _compared().items()))
    ends = [F.percentile_approx(name, [0.01, 0.99], 10_000).alias(name) for name in _compared()]
    known = rows.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *ends)

    def widened(low: float, high: float) -> tuple[float, float]:
        return low - margin * (high - low), high + margin * (high - low)

    # A row per language.
    return {
        row["lang"]: Band(**{name: widened(*row[name]) for name in _compared()})
        for row in known.where(F.col("n") >= least).collect()
    }


def judge_measured(df: DataFrame, rules: FertilityRules = FertilityRules(), lang: str = "lang") -> DataFrame:
    """df, with MEASURED in it, and ``kept``."""

    def accepted(band: Band) -> Column:
        sides = [c.between(*getattr(band, name)) for name, c in _compared().items()]
        return sides[0] & sides[1] & sides[2]

    def judged(key: Column, otherwise: Column) -> Column:
        for name, band in rules.bands.items():
            otherwise = F.when(key == name, accepted(band)).otherwise(otherwise)
        return otherwise

    by_script = judged(F.col("script"), F.lit(True))
    kept = ~F.col("base_failed") & judged(F.col(f"`{lang}`"), by_script)
    return with_fields(df, F.struct(kept.alias("kept")), ["kept"])


def judge_fertility(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    rules: FertilityRules = FertilityRules(),
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """df with FIELDS."""
    return judge_measured(measure_fertility(df, vocabulary, pattern, text), rules, lang)
