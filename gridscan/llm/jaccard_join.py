"""N-gram Jaccard self-join: texts whose sets of word shingles overlap by a percentage or more.

Steps, all exact:

1. A text's set is the distinct shingles of ``words`` words (A-Z lower-cased); with fewer words, the whole
   sequence; without words, nothing. Texts with equal sets are one class, known by a hash of the set.
2. Frequencies: shingles are dealt by hash in packed blocks, and each shingle's number of classes is counted.
   A shingle of one class can be in no intersection, so only shared ones go on, and only classes whose
   shared shingles could reach the percentage.
3. Signatures: a set's shingles are ordered from rare to frequent. A prefix of size - needed + 1 shingles
   holds one that any partner has in its own prefix. Prefixes are extended by m shingles, so that partners
   share m + 1: then they share a rare shingle, or two frequent ones of the same of m token classes.
   Rare shingles are indexed alone, frequent ones as pairs within their class. m depends on the size band
   of the smaller partner (powers of two); a set is indexed in the bands that its partners can have.
4. Candidates: few sets with the same signature are paired. Many are gathered under the smallest of them, cut
   into blocks of bounded size, each of sets of about one size, and compared block by block as matrix products. A block pair reports links
   as a spanning forest of what it found, so a large group of copies costs no row per pair.
5. Verification counts intersections on shared shingles, the union from set sizes.
6. Components of the links, then of the texts.

Defined cases: null and empty texts have an empty set, size 0, no link, and are components of their own;
very long texts are taken whole; equal rows are one class and stay as rows; a null id does not name a
component; an empty table gives no rows; further columns are ignored.

Shingles are 64-bit hashes, of which frequencies and intersections use 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscan.llm.common import join_hot, release, written
from gridscan.llm.components import components
from gridscan.llm.packed import U, mix, pack, shared_keys, slices, unpack

BLOCK_TOKENS = 1_000_000  # shingles packed at a time
BUCKET_TOKENS = 1_000_000  # shingles counted at a time, about
FREQUENT = 16  # classes from which a shingle is indexed in pairs
FEW = 8  # sets of a signature that are paired directly
CHUNK_TOKENS = 200_000  # shingles in a block of a large group, about
CHUNK_SETS = 1000  # sets in such a block, about
BAND_RATIO = 1.15  # sizes of the sets in a block differ by less
KNOWN_WORDS = 100_000
_ODD = U(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Similar:
    words: int = 5
    percent: int = 80


class WordHashes(dict):
    """Hashes of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    if not text:
        return np.empty(0, dtype=U)
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if n == 0:
        return np.empty(0, dtype=U)
    w = np.fromiter(map(hashes.__getitem__, parts), dtype=U, count=n)
    k = min(words, n)
    value = np.full(n - k + 1, k, dtype=U)
    for i in range(k):
        value = value * _ODD + w[i : n - k + 1 + i]
    return np.unique(mix(value))


def class_of(tokens: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = mix(tokens + _ODD).sum(dtype=U, keepdims=True) + np.array([len(tokens)], dtype=U) * _ODD
    return int(mix(total).view(np.int64)[0])


def needed(n: np.ndarray | int, percent: int):
    """Shingles that a set of n must share with any partner."""
    return -(-n * percent // 100)


def extension(band: int, percent: int) -> int:
    """m: the token classes of frequent shingles for sets of 2^band or more."""
    size = 1 << band
    return 0 if band < 5 else max(1, size * (100 - percent) // 400)


def measured(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, class: the size and class of each text's set (class null if empty)."""

    @F.pandas_udf("n long, class long")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for texts in batches:
            sets = [shingles(t, words, hashes) for t in texts]
            classes = pd.array([class_of(s) if len(s) else None for s in sets], dtype="Int64")
            yield pd.DataFrame({"n": [len(s) for s in sets], "class": classes})
        hashes.clear()
        release()

    rows = documents.select("doc_id", measure("text").alias("m"))
    return rows.select("doc_id", F.col("m.n").alias("n_shingles"), F.col("m.class").alias("class"))


def shared_tokens(documents: DataFrame, config: Similar, total: int) -> DataFrame:
    """class, n, tokens: the shared shingles of each class that can have a partner, rare first.

    tokens: array<struct<df, token>>, where df is the number of classes with the shingle. ``total`` is the
    number of shingles of all texts, by which buckets are kept to a bounded size.
    """
    words, percent = config.words, config.percent
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, partitions, total // BUCKET_TOKENS)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        sets: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> pd.DataFrame:
            classes = np.fromiter(sets, dtype=np.int64, count=len(sets))
            sizes = np.array([len(s) for s in sets.values()], dtype=np.int64)
            tokens = np.concatenate(list(sets.values())) >> U(16)
            rows = slices(tokens, np.repeat(np.arange(len(sets)), sizes), classes, sizes, buckets)
            return pd.DataFrame(rows, columns=["bucket", "block"])

        for pdf in batches:
            for text in pdf["text"]:
                s = shingles(text, words, hashes)
                if len(s) and (key := class_of(s)) not in sets:
                    sets[key] = s
                    held += len(s)
                    if held >= BLOCK_TOKENS:
                        yield flush()
                        sets.clear()
                        held = 0
                        release()
        if sets:
            yield flush()
        sets.clear()
        hashes.clear()
        release()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, owners, sizes = shared_keys([unpack(b) for b in pdf["block"]])
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, np.int64)
        times = np.diff(np.append(first, len(tokens)))
        df = np.repeat(times, times)
        keep = df > 1
        out = pd.DataFrame(
            {
                "class": owners[keep],
                "n": sizes[keep],
                "df": df[keep].astype(np.int64),
                "token": tokens[keep].view(np.int64),
            }
        )
        del tokens, owners, sizes, first, times, df, keep
        release()
        return out

    blocks = documents.select("text").mapInPandas(split, "bucket int, block binary")
    rows = blocks.groupBy("bucket").applyInPandas(count, "class long, n long, df long, token long")
    lists = rows.groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    return lists.where(F.size("tokens") * 100 >= F.col("n") * percent)


def signatures_of(n: int, df: np.ndarray, tokens: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of one set: n its size, tokens its shared shingles from rare to frequent."""
    alone = n - len(tokens)  # shingles that no other class has come first
    need = int(needed(n, percent))
    # A partner of size s has s >= need; the band of the smaller one is that of n or of any size from need on.
    bands = range(need.bit_length() - 1, n.bit_length())
    out = []
    for band in bands:
        m = extension(band, percent)
        length = n - need + 1 + m - alone
        if length <= 0:
            continue
        prefix, often = tokens[:length], df[:length] >= FREQUENT
        salt = mix(np.array([band + 1], dtype=U))[0]
        if m == 0:
            out.append(mix(prefix ^ salt))
            continue
        out.append(mix(prefix[~often] ^ salt))
        frequent = prefix[often]
        group = mix(frequent + _ODD) % U(m)
        order = np.argsort(group, kind="stable")
        frequent, group = frequent[order], group[order]
        for step in range(1, len(frequent)):
            same = group[step:] == group[:-step]
            if not same.any():
                break
            a, b = frequent[:-step][same], frequent[step:][same]
            low, high = np.minimum(a, b), np.maximum(a, b)
            out.append(mix(mix(low ^ salt) + high * _ODD))
    return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=U)


def signatures(shared: DataFrame, percent: int) -> DataFrame:
    """sig, class, n"""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns: list[tuple[np.ndarray, int, int]] = []
            for owner, n, df, tokens in zip(pdf["class"], pdf["n"], pdf["df"], pdf["token"]):
                s = signatures_of(int(n), np.asarray(df), np.asarray(tokens).astype(np.int64).view(U), percent)
                columns.append((s.view(np.int64), owner, n))
            sizes = [len(s) for s, _, _ in columns]
            if sum(sizes):
                yield pd.DataFrame(
                    {
                        "sig": np.concatenate([s for s, _, _ in columns]),
                        "class": np.repeat([c for _, c, _ in columns], sizes),
                        "n": np.repeat([n for _, _, n in columns], sizes),
                    }
                )
            release()

    rows = shared.select("class", "n", F.col("tokens.df").alias("df"), F.col("tokens.token").alias("token"))
    return rows.mapInPandas(sign, "sig long, class long, n long")


def _sorted_tokens(column: str):
    return F.array_sort(F.col(f"{column}.token"))


def linked_pairs(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b of classes, those that are similar enough."""
    lists = shared.select("class", "n", _sorted_tokens("tokens").alias("t"))

    @F.pandas_udf("boolean")
    def similar(ta: pd.Series, tb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        out = []
        for x, y, p, q in zip(ta, tb, na, nb):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (int(p) + int(q) - both))
        return pd.Series(out)

    left = lists.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("t").alias("ta"))
    right = lists.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("t").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.where(similar("ta", "tb", "na", "nb")).select("a", "b")


def links_between(
    a: list[tuple[int, int, np.ndarray]], b: list[tuple[int, int, np.ndarray]], percent: int
) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of (class, n, tokens); a may be b itself."""
    ta, tb = (np.concatenate([t for _, _, t in x]) for x in (a, b))
    ra, rb = (np.repeat(np.arange(len(x)), [len(t) for _, _, t in x]) for x in (a, b))
    known = np.intersect1d(ta, tb)
    counts = np.zeros((len(a), len(b)), dtype=np.float32)
    sides = []
    for t, r in ((ta, ra), (tb, rb)):
        at = np.searchsorted(known, t)
        at[at == len(known)] = 0
        hit = known[at] == t if len(known) else np.zeros(len(t), dtype=bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], r[hit][order]))
    for low in range(0, len(known), 2048):
        dense = []
        for (at, r), rows in zip(sides, (len(a), len(b))):
            i, j = np.searchsorted(at, (low, low + 2048))
            part = np.zeros((rows, min(2048, len(known) - low)), dtype=np.float32)
            part[r[i:j], at[i:j] - low] = 1
            dense.append(part)
        counts += dense[0] @ dense[1].T
    both = counts.astype(np.int64)
    del counts
    na, nb = (np.array([n for _, n, _ in x], dtype=np.int64) for x in (a, b))
    linked = 100 * both >= percent * (na[:, None] + nb[None, :] - both)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    out = []
    for i, row in enumerate(linked):
        own = a[i][0]
        for j in np.flatnonzero(row):
            x, y = root(own), root(b[j][0])
            if x != y:
                parent[x] = y
                out.append((own, b[j][0]))
    return out


def links_in_groups(members: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """a, b: links among the classes of each group (leader, class), enough to connect what is linked."""
    # Chunks hold sets of about the same size. How many a leader has follows from sums, and a hash deals them.
    weight = F.greatest(F.size("tokens"), F.lit(CHUNK_TOKENS // CHUNK_SETS)).cast("long")
    band = F.floor(F.log("n") / F.log(F.lit(BAND_RATIO)))
    rows = members.select("leader", "class").join(shared.select("class", band.alias("band"), weight.alias("weight")), "class")
    rows = written(rows)
    sums = written(rows.groupBy("leader", "band").agg(F.sum("weight").alias("held"), F.count(F.lit(1)).alias("n")))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = join_hot(rows, sums.drop("n"), ["leader", "band"], sums, total)
    chunk = F.pmod(F.xxhash64("class"), F.ceil(F.col("held") / CHUNK_TOKENS))
    lists = shared.select("class", "n", _sorted_tokens("tokens").alias("t"))
    rows = rows.select("leader", "band", "class", chunk.alias("chunk")).join(lists, "class")
    chunks = rows.groupBy("leader", "band", "chunk").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.collect_list(F.struct("class", "n", "t")).alias("sets")
    )
    chunks = written(chunks.select("leader", "low", "high", "sets", F.monotonically_increasing_id().alias("id")))
    # Pairs are made of numbers; the contents follow by joins that spread a leader's pairs.
    left = chunks.select("leader", "id", "low", "high")
    right = left.select("leader", *(F.col(c).alias(f"{c}_b") for c in ("id", "low", "high")))
    met = (F.col("high") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low") * percent)
    pairs = written(left.join(right, "leader").where((F.col("id") <= F.col("id_b")) & met).select("id", "id_b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: list[tuple[int, int]] = []
            for x, y in zip(pdf["sets"], pdf["sets_b"]):
                sides = [[(int(s["class"]), int(s["n"]), np.asarray(s["t"])) for s in z] for z in (x, y)]
                found += links_between(*sides, percent)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
            release()

    sets = chunks.select("id", "sets")
    other = chunks.select(F.col("id").alias("id_b"), F.col("sets").alias("sets_b"))
    pairs = pairs.repartition("id", "id_b").join(sets, "id").join(other, "id_b").select("sets", "sets_b")
    return pairs.mapInPandas(compare, "a long, b long")


def link_classes(documents: DataFrame, config: Similar, total: int) -> DataFrame:
    """a, b: links between classes; every class is connected to all it is linked with, maybe by way of others."""
    shared = written(shared_tokens(documents, config, total))
    signed = signatures(shared, config.percent)
    same = Window.partitionBy("sig")
    signed = signed.select("*", F.count("*").over(same).alias("size"), F.min("class").over(same).alias("leader"))
    signed = written(signed.where("size > 1"))
    few = signed.where(F.col("size") <= FEW)
    other = few.select("sig", F.col("class").alias("b"), F.col("n").alias("nb"))
    pairs = few.select("sig", F.col("class").alias("a"), F.col("n").alias("na")).join(other, "sig")
    smaller, larger = F.least("na", "nb"), F.greatest("na", "nb")
    pairs = pairs.where((F.col("a") < F.col("b")) & (smaller * 100 >= larger * config.percent))
    pairs = written(pairs.select("a", "b").distinct())
    many = signed.where(F.col("size") > FEW).select("leader", "class").distinct()
    return linked_pairs(pairs, shared, config.percent).union(links_in_groups(many, shared, config.percent))


def similar_groups(documents: DataFrame, config: Similar = Similar()) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of documents (doc_id, text).

    component_id is the smallest doc_id that links lead to, the row's own included.
    """
    rows = written(measured(documents, config.words))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    found = components(link_classes(documents, config, total))
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    classes = classes.join(found.withColumnRenamed("node", "class"), "class", "left")
    classes = classes.select("class", "first", F.coalesce("component", "class").alias("component"))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = classes.join(least, "component").select("class", "component_id")
    out = rows.join(classes, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
