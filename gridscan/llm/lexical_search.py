"""Ranked lexical search: the best documents for each of many items, scored from term counts.

1. Items are cut into blocks of bounded text size. A block's terms, each guarded by a separator on both
   sides, make one Aho-Corasick automaton, which is broadcast with the list of items that each term occurs in.
2. A first scan of all texts counts the documents, their terms, and in how many documents each term of the
   block occurs. That gives the weights of the terms.
3. A second scan runs the automaton over each text again: its outputs are the term frequencies, which are
   mapped to items and scored. Neither scan builds an index of the documents. A task keeps the best documents
   per item so far and reports them at its end.
4. The reports, at most ``top`` rows for each task and item, are ranked.

Texts become bytes in which every separator is a space and A-Z are lower-case; other bytes stay. As terms
hold no space, each occurrence between guards is one whole term and no output hides another.

Defined cases: a null text has no term, as an empty one; such documents count nowhere. Very long texts are
scanned whole. Equal scores go by ascending document id, null ids last; repeated documents are ranked one by
one, repeated items each have their own ranking; a null item id is an item like any other. Empty tables give no
rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscan.llm.common import written

BLOCK_BYTES = 8 << 20  # text of the items of one automaton
CELLS = 1 << 21  # scores, and additions to them, at a time
PENDING = 1 << 18  # reports held before the best are kept

# Bytes that separate terms.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]


def _byte_table() -> bytes:
    table = bytearray(range(256))
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    for b in SEPARATORS:
        table[b] = 0x20
    return bytes(table)


TABLE = _byte_table()


def guarded(text: str | None) -> bytes:
    """The text as lower-case terms between spaces."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").translate(TABLE) + b" "


def count_terms(text: bytes) -> int:
    """Terms of a guarded text, repeats included."""
    inside = np.frombuffer(text, dtype=np.uint8) != 0x20
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


@dataclass
class Items:
    """A block of items: its terms, and for each term the items that hold it and how often."""

    rows: np.ndarray
    terms: list[bytes]
    starts: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[int], texts: list[str | None]) -> Items:
        known: dict[bytes, int] = {}
        found = []
        for i, text in enumerate(texts):
            for term, times in Counter(guarded(text).split()).items():
                found.append((known.setdefault(term, len(known)), i, times))
        table = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
        starts = np.searchsorted(table[:, 0], np.arange(len(known) + 1))
        return cls(np.array(rows, dtype=np.int64), list(known), starts, table[:, 1], table[:, 2])

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, term in enumerate(self.terms):
            found.add_word(f" {term.decode('latin-1')} ", number)
        found.make_automaton()
        return found


def frequencies(automaton: ahocorasick.Automaton, text: bytes) -> Counter:
    """How often each term of the automaton occurs in a guarded text."""
    return Counter(map(itemgetter(1), automaton.iter(text.decode("latin-1"))))


@dataclass
class Statistics:
    """Of all documents: how many have a term, how many terms they have, and each term's weight."""

    documents: int
    terms: int
    weights: np.ndarray

    @classmethod
    def of(cls, documents: int, terms: int, holders: np.ndarray) -> Statistics:
        # The weight's form.
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holders.tolist()]
        return cls(documents, terms, np.array(weights, dtype=np.int64))

    def measure(self, n: int) -> int:
        return 25 + (75 * n * self.documents) // self.terms  # fixed values: the share of the length


class Best:
    """The best documents per item, among those added."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.floor = np.ones(items, dtype=np.int64)
        self.kept = [np.empty(0, dtype=np.int64)] * 4
        self.pending: list[list[np.ndarray]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        """scores: documents x items."""
        doc, item = np.nonzero(scores >= self.floor)
        self.pending.append([item, scores[doc, item], unnamed[doc], ids[doc]])
        self.held += len(doc)
        if self.held >= PENDING:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        """item, score, whether the id is null, id: sorted, at most ``top`` rows per item."""
        columns = [np.concatenate(x) for x in zip(self.kept, *self.pending)]
        item, score, unnamed, ids = columns
        order = np.lexsort((ids, unnamed, -score, item))
        item, score = item[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = rank == self.top - 1
        self.floor[item[full]] = score[full]
        self.kept = [c[order[rank < self.top]] for c in columns]
        self.pending, self.held = [], 0
        return self.kept


def scored(items: Items, statistics: Statistics, found: list[tuple[int, Counter]]) -> np.ndarray:
    """documents x items: the scores of documents, each given by its number of terms and frequencies."""
    out = np.zeros((len(found), len(items.rows)), dtype=np.int64)
    sizes = [len(c) for _, c in found]
    total = sum(sizes)
    term = np.fromiter((t for _, c in found for t in c), dtype=np.int64, count=total)
    times = np.fromiter((x for _, c in found for x in c.values()), dtype=np.int64, count=total)
    doc = np.repeat(np.arange(len(found)), sizes)
    m = np.array([statistics.measure(n) for n, _ in found], dtype=np.int64)[doc]
    # The saturation of the frequency.
    gain = statistics.weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m))
    width = items.starts[term + 1] - items.starts[term]
    ends = np.cumsum(width)
    for low in _pieces(ends):
        part = slice(*low)
        w = width[part]
        at = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(items.starts[term[part]], w)
        np.add.at(out, (np.repeat(doc[part], w), items.item[at]), np.repeat(gain[part], w) * items.times[at])
    return out


def _pieces(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose widths add up to about ``CELLS``."""
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + CELLS)))
        yield low, high
        low = high


def _statistics(texts: DataFrame, shared: Broadcast) -> Statistics:
    """One scan: a task sums up what it saw in a row per term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        automaton = items.automaton()
        holders = np.zeros(len(items.terms) + 2, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text"):
                text = guarded(text.as_py())
                n = count_terms(text)
                if n:
                    holders[-2:] += (1, n)
                    holders[list(frequencies(automaton, text))] += 1
        seen = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(holders[seen])], names=["term", "n"])

    sums = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    holders = np.zeros(len(shared.value.terms) + 2, dtype=np.int64)
    for row in sums.toLocalIterator():  # at most a row per term of the block
        holders[row.term] = row.n
    documents, terms = holders[-2:].tolist()
    return Statistics.of(documents, terms, holders[:-2])


def _block_ranking(documents: DataFrame, items: Items, top: int) -> DataFrame:
    """row, doc_id, score: the best of every task for each item of a block."""
    context = documents.sparkSession.sparkContext
    shared = context.broadcast(items)
    statistics = context.broadcast(_statistics(documents.select("text"), shared))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = shared.value, statistics.value
        automaton = items.automaton()
        best = Best(len(items.rows), top)
        step = max(1, CELLS // len(items.rows))
        for batch in batches:
            column = batch.column("doc_id")
            unnamed = np.asarray(column.is_null()).astype(np.int64)
            ids = column.fill_null(0).to_numpy()
            texts = batch.column("text")
            for low in range(0, len(texts), step):
                found, at = [], []
                for i in range(low, min(low + step, len(texts))):
                    text = guarded(texts[i].as_py())
                    if counts := frequencies(automaton, text):
                        found.append((count_terms(text), counts))
                        at.append(i)
                if found:
                    best.add(scored(items, known, found), ids[at], unnamed[at])
        item, score, unnamed, ids = best.cut() if best.pending else best.kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(items.rows[item]), pa.array(ids, mask=unnamed.astype(bool)), pa.array(score)],
            names=["row", "doc_id", "score"],
        )

    return documents.select("doc_id", "text").mapInArrow(rank, "row long, doc_id long, score long")


def _item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items, a bounded block at a time."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    total = items.agg(F.sum(size.cast("long"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "text").collect()
        yield Items.of([r.row for r in rows], [r.text for r in rows])


def search(documents: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``top`` documents (doc_id, text) of each item (item_id, text)."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = written(items.select("item_id", "text", F.monotonically_increasing_id().alias("row")))
    found = [written(_block_ranking(texts, block, top)) for block in _item_blocks(items) if block.terms]
    schema = "row long, doc_id long, score long"
    reports = documents.sparkSession.createDataFrame([], schema)
    for block in found:
        reports = reports.union(block)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = reports.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(items.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
