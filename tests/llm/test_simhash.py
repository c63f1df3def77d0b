import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridscan.llm import simhash as S
from plain import WORD, lower

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text, words):
    parts = WORD.findall(lower(text or ""))
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), S.SEED) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def plain_groups(fps, distance):
    """Of a list of unsigned fingerprints: a representative for each."""
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    known = sorted(up)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= distance:
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return [root(f) for f in fps]


def expected(rows, words, distance):
    fps = [plain_fingerprint(t, words) for _, t in rows]
    labels = plain_groups(fps, distance)
    least = {}
    for (d, _), label in zip(rows, labels):
        if d is not None:
            least[label] = min(d, least.get(label, d))
    return sorted(((d, f"{f:016x}", least.get(x, d)) for (d, _), f, x in zip(rows, fps, labels)), key=repr)


def grouped(spark, rows, words=3, distance=4):
    out = S.near_groups(spark.createDataFrame(rows, SCHEMA), S.SimHash(words, distance))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def edited_texts(rng, groups=12, copies=9):
    rows = []
    for _ in range(groups):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice((2, 30, 200)))]
        for _ in range(copies):
            rows.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
    rng.shuffle(rows)
    return [(5 * i, t) for i, t in enumerate(rows)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_of_texts_of_all_kinds():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "one two", "É é x \x85 y", "a b c d " * 40, "x" * 100_000]
    texts += [" ".join(rng.choice(("ab", "Cd", "é", "\U0001f600")) for _ in range(rng.randrange(60))) for _ in range(40)]
    for text in texts:
        assert S.fingerprint(text, 4) == signed(plain_fingerprint(text, 4)), text


def test_fingerprint_of_a_long_text_in_pieces(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000))
    whole = S.fingerprint(text, 4)
    monkeypatch.setattr(S, "SHINGLES", 100)
    assert S.fingerprint(text, 4) == whole == signed(plain_fingerprint(text, 4))


def test_thresholds_keep_the_pigeonhole():
    rng = random.Random(2)
    for m in S.GROUPS:
        costs = [[rng.random() * 10**t for t in range(5)] for _ in range(m)]
        cost, chosen = S.best_thresholds(costs, 4)
        assert sum(t + 1 for t in chosen) == 5
        every = [
            (sum(c[t] for c, t in zip(costs, ts) if t >= 0))
            for ts in np.ndindex(*([6] * m))
            for ts in [[t - 1 for t in ts]]
            if sum(t + 1 for t in ts) == 5 and max(ts) <= 4
        ]
        assert cost == pytest.approx(min(every))


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(3)
    base = rng.random((4000, 32)) < 0.5
    noise = rng.random((4000, 32)) < 0.05
    order = rng.permutation(64)
    bits = np.concatenate([base, base ^ noise], axis=1)[:, order].astype(float)
    groups = S.correlated_groups(bits.T @ bits, 4000, 4)
    where = {b: g for g, group in enumerate(groups) for b in group}
    twins = [(int(np.flatnonzero(order == i)[0]), int(np.flatnonzero(order == i + 32)[0])) for i in range(32)]
    assert sorted(where) == list(range(64))
    assert sum(where[a] == where[b] for a, b in twins) >= 28


def test_groups_equal_all_pairs(spark):
    rows = edited_texts(random.Random(4))
    assert grouped(spark, rows) == expected(rows, 3, 4)


def test_large_buckets_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 2)
    monkeypatch.setattr(S, "BLOCK", 4)
    rows = edited_texts(random.Random(5), groups=4, copies=40)
    assert grouped(spark, rows) == expected(rows, 3, 4)


@pytest.mark.parametrize("m", S.GROUPS)
def test_links_do_not_depend_on_the_plan(spark, m):
    rng = random.Random(m)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(5)):
                x ^= 1 << b
    fps = sorted(fps)
    thresholds = {2: (1, 2), 3: (3, -1, 0), 4: (0, 1, 0, 0)}[m]
    groups = tuple(tuple(range(64))[i::m] for i in range(m))
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = S.links(df, len(fps), S.Plan(groups, thresholds), 4).collect()
    up = {f: f for f in fps}
    mask = (1 << 64) - 1

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        a, b = a & mask, b & mask
        assert (a ^ b).bit_count() <= 4
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(f) for f in fps] == plain_groups(fps, 4)


def test_defined_cases(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (None, ""), (None, "a b c d"), (7, "q r s t u"), (7, "q r s t u"), (9, "Q R S T U")]
    assert grouped(spark, rows) == expected(rows, 3, 4)
    assert grouped(spark, []) == []
    assert grouped(spark, [(4, "only one")]) == expected([(4, "only one")], 3, 4)


def test_further_columns_are_ignored(spark):
    rows = edited_texts(random.Random(6), groups=2, copies=4)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("fp", "fingerprint", "component_id", "n", "first", "key", "g"):
        df = df.withColumn(name, F.lit(1))
    out = S.near_groups(df, S.SimHash(3, 4))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(rows, 3, 4)


def test_query_equals_plain(spark, sf_dir):
    from gridscan.llm.queries import op11_simhash

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = op11_simhash(spark, sf_dir)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(rows, 4, 4)
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in out.collect())
