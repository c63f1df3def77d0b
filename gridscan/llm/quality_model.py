"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of bounded or log-transformed statistics. For either label the labelled rows
give a mean and a covariance, which is shrunk towards the diagonal of the pooled covariance; a small ridge
keeps it invertible. The score of a text is the logistic function of the difference of the two Gaussian
log-densities (Mahalanobis distance and log-determinant from Cholesky factors that are computed once) and
the log prior odds.

Fitting is one aggregation: sums and products of the statistics per label, of a fixed size whatever the
input. All labelled training rows count; no sample is taken.

Defined cases: null and empty texts are scored alike, from the statistics of an empty text; very long texts
are measured whole; a null label trains nothing; repeated rows count as often as they occur. Without rows
of label 1 the score is 0, without rows of label 0 it is 1, and without either it is 0.5. An empty table
gives no rows. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscan.llm.common import release, with_fields

STATISTICS = (
    "log_words", "log_word_length", "upper_share", "digit_share", "mark_share", "bang_share", "stop_share",
    "bar_share", "other_share", "distinct_words", "repeated_lines", "log_line_words", "log_longest_run",
    "title_share", "common_word_share",
)
SHRINKAGE, RIDGE = 0.1, 1e-4

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_MARK = b"#*$%&<>^~_=+@\\{}[]"
_BANG = b"!?"
_STOP = b".,;:"
_BAR = b"|"
_SPACE = b" \t\n\r\x0b\x0c"


def _count(data: bytes, which: bytes) -> int:
    return len(data) - len(data.translate(None, which))


def longest_run(words: list[bytes]) -> int:
    """The most times that a word stands in a row."""
    n = len(words)
    if n < 2:
        return n
    ends = np.flatnonzero(~np.fromiter(map(eq, words, islice(words, 1, None)), dtype=bool, count=n - 1))
    return int(np.diff(np.concatenate(([-1], ends, [n - 1]))).max())


def measure(text: str | None) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    ink = len(data) - _count(data, _SPACE)
    inked = ink + 30  # shares of short texts are drawn towards 0
    distinct = len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = len(lines) - len(set(lines))
    upper = _count(data, _UPPER)
    controls = _count(data, bytes(range(9)) + bytes(range(14, 32)) + b"\x7f")
    best = longest_run(words)
    title = sum(1 for w in words if 65 <= w[0] <= 90)
    top = 0
    if n:
        half = n // 2
        first = set(words[:half])
        top = sum(1 for w in words[half:] if w in first)
    share = math.sqrt  # shares are skewed: their square roots are closer to normal
    return [
        math.log1p(n),
        math.log1p(ink / max(1, n)),
        share(upper / inked),
        share(_count(data, _DIGIT) / inked),
        share(_count(data, _MARK) / inked),
        share(_count(data, _BANG) / inked),
        share(_count(data, _STOP) / inked),
        share(_count(data, _BAR) / inked),
        share(controls / inked),
        (distinct + 1) / (n + 1) * math.log1p(n),
        share(repeated / (len(lines) + 4)),
        math.log1p(n / max(1, len(lines))),
        math.log1p(best),
        share(title / (n + 5)),
        share(top / (n - n // 2 + 5)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([measure(t) for t in texts], dtype=object)
        release()


@dataclass(frozen=True)
class Gaussian:
    """A class: log prior, mean, and the inverse Cholesky factor of its covariance."""

    log_prior: float
    mean: np.ndarray
    whiten: np.ndarray
    log_root_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whiten.T
        return self.log_prior - self.log_root_det - 0.5 * np.einsum("ij,ij->i", z, z)


@dataclass(frozen=True)
class Discriminant:
    low: Gaussian | None
    high: Gaussian | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(x), 0.5 if self.low is self.high else float(self.low is None))
        odds = self.high.log_density(x) - self.low.log_density(x)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))

    @property
    def fitted(self) -> bool:
        return self.low is not None and self.high is not None


def from_moments(
    moments: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE, ridge: float = RIDGE
) -> Discriminant:
    """Label -> (rows, sum, sum of products) to a model."""
    total = sum(n for n, _, _ in moments.values())
    centred = {}
    for label, (n, s, p) in moments.items():
        mean = s / n
        centred[label] = (n, mean, p / n - np.outer(mean, mean))
    if not centred:
        return Discriminant(None, None)
    pooled = sum(n * np.diag(c) for n, _, c in centred.values()) / total
    classes: dict[int, Gaussian] = {}
    for label, (n, mean, cov) in centred.items():
        shrunk = (1 - shrinkage) * cov + shrinkage * np.diag(pooled) + ridge * np.eye(len(mean))
        root = np.linalg.cholesky(shrunk)
        classes[label] = Gaussian(
            math.log(n / total), mean, np.linalg.inv(root), float(np.log(np.diag(root)).sum())
        )
    return Discriminant(classes.get(0), classes.get(1))


def fit(rows: DataFrame, text: str = "text", label: str = "quality", shrinkage: float = SHRINKAGE) -> Discriminant:
    """Learn from rows of text and label (0 or 1); other labels are left out."""
    label_col = F.col(f"`{label}`").cast("int")
    rows = rows.where(label_col.isin(0, 1))
    return fit_measured(rows.select(label_col.alias("label"), statistics(F.col(f"`{text}`")).alias("x")), shrinkage)


def fit_measured(measured: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Learn from rows of label (0 or 1) and x, the statistics of a text."""
    d = len(STATISTICS)
    x = F.col("x")
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    moments = {}
    for row in measured.groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect():
        p = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                p[i, j] = p[j, i] = row[f"p{i}_{j}"]
        moments[row["label"]] = (row["n"], np.array([row[f"s{i}"] for i in range(d)]), p)
    return from_moments(moments, shrinkage)


def score(df: DataFrame, model: Discriminant, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """df with score (0 to 1) and predicted (1 from the threshold on)."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([measure(t) for t in texts]).reshape(-1, len(STATISTICS))
            yield pd.Series(model.score(x))
            release()

    with_score = with_fields(df, F.struct(scored(F.col(f"`{text}`")).alias("score")), ["score"])
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int")
    return with_fields(with_score, F.struct(predicted.alias("predicted")), ["predicted"])


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are kept from training; a null id is not held out."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % 4
    return F.coalesce(fold == 2, F.lit(False))


def fit_on_labels(documents: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from the labelled documents that are not held out. Statistics, not texts, move to the labels."""
    label = F.col("quality").cast("int")
    wanted = labels.where(~held_out(F.col("doc_id")) & label.isin(0, 1)).select("doc_id", label.alias("label"))
    rows = documents.where(~held_out(F.col("doc_id"))).select("doc_id", statistics("text").alias("x"))
    return fit_measured(rows.join(wanted, "doc_id").select("label", "x"))
