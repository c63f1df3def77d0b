import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscan.llm import lexical_search as L
from plain import lower

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(TERM.findall(lower(text or "")))


def expected(docs, items, top=10):
    counts = [(d, c) for d, c in ((d, terms(t)) for d, t in docs) if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            score = 0
            for t, times in terms(text).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def searched(spark, docs, items, top=10):
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    out = L.search(df, spark.createDataFrame(items, ITEMS), top)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(rng, n):
    words = ["a", "ab", "B", "bc", "é", "É", "x1", " ", "\x85", "the", "rare%d" % rng.randrange(9)]
    gaps = [" ", "\n", "-", "_", ", ", "\x00", "\x7f", "[", "{", "@", "/"]
    return [
        (rng.randrange(n * 2), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(40)))) for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_ranking_equals_plain(spark, seed):
    rng = random.Random(seed)
    docs = corpus(rng, 150)
    items = [(i, t) for i, (_, t) in enumerate(corpus(rng, 12))]
    assert searched(spark, docs, items, top=7) == expected(docs, items, 7)


def test_small_blocks_and_pieces_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    docs, items = corpus(rng, 120), [(i % 5, t) for i, (_, t) in enumerate(corpus(rng, 15))]
    monkeypatch.setattr(L, "BLOCK_BYTES", 300)
    assert searched(spark, docs, items) == expected(docs, items)


def test_best_of_many(monkeypatch):
    monkeypatch.setattr(L, "PENDING", 50)
    monkeypatch.setattr(L, "CELLS", 10)
    rng = np.random.default_rng(4)
    best, rows = L.Best(3, 4), []
    for step in range(30):
        scores, ids, unnamed = rng.integers(0, 6, (5, 3)), rng.integers(0, 40, 5), rng.integers(0, 2, 5)
        best.add(scores, ids, unnamed)
        rows += [(i, -scores[d, i], unnamed[d], ids[d]) for d in range(5) for i in range(3) if scores[d, i] > 0]
    item, score, unnamed, ids = best.cut()
    wanted = [r for i in range(3) for r in sorted(x for x in rows if x[0] == i)[:4]]
    assert [(a, -b, c, d) for a, b, c, d in zip(item, score, unnamed, ids)] == wanted


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, "--"), (None, "cat dog"), (4, "cat dog"), (4, "cat dog"), (5, "CAT"), (6, "dog " * 5000), (7, "catdog")]
    docs += [(8, " " * 300_000 + "cat" + "z" * 300_000)]
    items = [(1, "cat"), (1, "cat"), (None, "dog, cat"), (2, None), (3, ""), (4, "unseen")]
    assert searched(spark, docs, items, 3) == expected(docs, items, 3)
    assert searched(spark, [], items) == []
    assert searched(spark, docs, []) == []
    assert searched(spark, docs, [(1, None)]) == []


def test_further_columns_are_ignored(spark):
    docs, items = [(i, "cat dog " * i) for i in range(1, 6)], [(1, "cat")]
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for name in ("row", "score", "rank", "term", "item_id"):
        a = a.withColumn(name, F.lit("x"))
    for name in ("row", "score", "rank", "doc_id"):
        b = b.withColumn(name, F.lit("x"))
    assert sorted((tuple(r) for r in L.search(a, b).collect()), key=repr) == expected(docs, items)


def test_guards():
    items = L.Items.of([0], ["a ab abc"])
    found = L.frequencies(items.automaton(), L.guarded("a a,ab abc xab abx é-ab"))
    assert {items.terms[t]: n for t, n in found.items()} == {b"a": 2, b"ab": 2, b"abc": 1}
