"""Secret scan: patterns that stand alone, and weak parts that count only beside complementary ones.

Strong kinds, leftmost and non-overlapping within a kind: ``assign`` (a key word with a value of 12 or more
characters), ``access`` (an access identifier of 18 or more), ``hex`` (16 or more hex digits).

Weak kinds are too common to report alone: ``secret`` (a bare token of exactly 40 base64 characters),
``identifier`` (client, user or account name in an assignment) and ``endpoint`` (a service address). They
are linked by an interval join inside scopes. A scope is a paragraph (text between empty lines); two parts
are near if the gap between their spans is at most ``reach`` code points. Reported are

* a ``secret`` near an identifier (``access`` or ``identifier``),
* an ``identifier`` near a secret part (``assign``, ``hex`` or ``secret``),
* an ``endpoint`` near both an identifier and a secret part.

A weak span that overlaps a strong one, or a bare token inside a named part, is no part of its own. The join sorts the parts of one text once
and looks up neighbours by bisection, so its cost is n log n in the parts, with no pair listed.

Defined cases: a null or empty text has no finding; very long texts are scanned whole; repeated rows are
scanned alike; an empty table gives no rows; the result column replaces an input column of the same name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscan.llm.common import with_fields

# The patterns of the strong kinds. Runs too short to count never match, which changes no other match.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_MIN = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
WEAK_IDENTIFIER = re.compile(
    r"""\b(?:client_?id|user(?:_?name)?|login|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    re.I | re.A,
)
ENDPOINT = re.compile(r"""(?:https?|s3|ftp|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]+""")
PARAGRAPH = re.compile(r"\n[\x20\t]*\n")

KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")
STRONG = KINDS[:3]
IDENTIFIERS, SECRETS = {"access", "identifier"}, {"assign", "hex", "secret"}
REACH = 200

Span = tuple[str, int, int]


def strong_spans(text: str) -> list[Span]:
    found = [
        ("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN
    ]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _clear_of(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Spans that overlap none of those taken."""
    ends, starts, most = [], [], 0
    for _, start, end in sorted(taken, key=lambda s: s[1]):
        most = max(most, end)
        starts.append(start)
        ends.append(most)
    clear = []
    for span in spans:
        i = bisect_left(starts, span[2])  # spans that start before this one ends
        if i == 0 or ends[i - 1] <= span[1]:
            clear.append(span)
    return clear


class _Parts:
    """Spans of one role in one text; tells whether one lies near within a scope."""

    def __init__(self, spans: list[Span]):
        ordered = sorted(spans, key=lambda s: s[1])
        self.starts = [s[1] for s in ordered]
        self.ends, most = [], -1
        for s in ordered:
            most = max(most, s[2])
            self.ends.append(most)

    def near(self, span: Span, low: int, high: int, reach: int) -> bool:
        """One whose gap to the span is at most reach, inside [low, high)."""
        i = bisect_right(self.starts, min(high - 1, span[2] + reach))  # those that start in time
        return i > 0 and self.ends[i - 1] >= max(low + 1, span[1] - reach)


def linked_spans(text: str, strong: list[Span], reach: int = REACH) -> list[Span]:
    """The weak spans whose complementary parts co-occur."""
    named = [("identifier", m.start(), m.end()) for m in WEAK_IDENTIFIER.finditer(text)]
    named += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    named = _clear_of(named, strong)
    bare = [("secret", m.start(), m.end()) for m in WEAK_SECRET.finditer(text)]
    weak = named + _clear_of(bare, strong + named)
    if not weak:
        return []
    breaks = [m.end() for m in PARAGRAPH.finditer(text)]
    every = strong + weak
    identifiers = _Parts([s for s in every if s[0] in IDENTIFIERS])
    secrets = _Parts([s for s in every if s[0] in SECRETS])
    found = []
    for span in weak:
        i = bisect_right(breaks, span[1])
        low, high = breaks[i - 1] if i else 0, breaks[i] - 1 if i < len(breaks) else len(text)
        has_id = span[0] == "identifier" or identifiers.near(span, low, high, reach)
        has_secret = span[0] == "secret" or secrets.near(span, low, high, reach)
        if has_id and has_secret:
            found.append(span)
    return found


def scan_text(text: str | None, reach: int = REACH) -> list[Span]:
    """All findings of a text, by start, then kind as listed."""
    if not text:
        return []
    strong = strong_spans(text)
    found = strong + linked_spans(text, strong, reach)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(df: DataFrame, text: str = "text", reach: int = REACH, out: str = "findings") -> DataFrame:
    """df with ``out``: array<struct<kind, start, end>>, code points, end exclusive."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t, reach)] for t in texts], dtype=object
            )

    return with_fields(df, F.struct(scan(F.col(f"`{text}`")).alias(out)), [out])


def mask_text(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """Every stretch that findings cover, replaced by a mark."""
    out, at, until = [], 0, 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= until:
            out += [text[at:start], mark]
        at = until = max(until, end)
    return "".join([*out, text[at:]])


def mask_secrets(df: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """df with all findings in the text masked; a null text stays null."""

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([t if not (s := scan_text(t, reach)) else mask_text(t, s) for t in texts], dtype=object)

    return df.withColumn(text, mask(F.col(f"`{text}`")))


def joined(findings: Column) -> Column:
    """kind:start:end of findings, comma-joined."""
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))),
        ",",
    )
