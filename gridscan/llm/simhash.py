"""SimHash near-duplicates: fingerprints that differ in few bits, found by a generalised pigeonhole.

1. A text's fingerprint has a bit set where over half the hashes of its word shingles have it. Texts with
   equal fingerprints are one from here on.
2. Partitions: 64 bits are divided into m groups, correlated bits together, so that the groups themselves are as
   independent as can be. Correlations come from bit counts over all fingerprints.
3. Thresholds: if the thresholds t of the groups satisfy sum(t + 1) = distance + 1, any two fingerprints within the
   distance differ by at most t in some group. -1 skips a group. Dynamic programming picks the thresholds with
   the least work: probes made, plus pairs that they are expected to hit, estimated from the numbers of
   fingerprints that agree in each group. m is the one whose best thresholds cost least.
4. Probing: fingerprints that agree in a group form a bucket, cut into blocks of bounded size. A bucket probes the
   buckets whose group differs from its own by at most t bits, itself included.
5. Verification counts the bits in which the members of two blocks differ. Small blocks are compared pair by pair;
   larger ones as matrices, of which only links that connect what is not connected yet are reported, so a large
   group of near copies costs no row per pair.
6. Components of the links, then of the documents.

Every choice above gives the same links; thresholds and m only change the work.

Defined cases: a null, empty or wordless text has fingerprint zero, linked like any other; very long texts are
taken whole; equal rows stay as rows; a null id does not name a component, and is one where no other id is;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscan.llm.common import join_hot, written
from gridscan.llm.components import components

BITS = 64
SEED = 42  # fixed value: seed of the shingle hash
GROUPS = (2, 3, 4)  # numbers of bit groups that are weighed
PAIR_COST = 0.2  # a compared pair, in probes
SMALL = 64  # members of a bucket whose pairs are compared one by one
BLOCK = 2048  # members of a block of a larger bucket, about
SHINGLES = 1 << 16  # hashes held at a time


@dataclass(frozen=True)
class SimHash:
    words: int = 5
    distance: int = 4


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(text: str | None, words: int) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if n == 0:
        return 0
    buffer = memoryview(b" ".join(parts))
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=n)
    del parts
    ends = np.cumsum(sizes + 1) - 1
    k = min(words, n)
    first, last = (ends - sizes)[: n - k + 1], ends[k - 1 :]
    total = len(first)
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, total, SHINGLES):
        spans = zip(first[low : low + SHINGLES].tolist(), last[low : low + SHINGLES].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(buffer[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return _signed(sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist()))


def fingerprints(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, fp"""

    @F.pandas_udf("long")
    def fingerprint_of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return documents.select("doc_id", fingerprint_of("text").alias("fp"))


def bit_moments(fps: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits set. Tasks send sums of 64 rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for pdf in batches:
            values = pdf["fp"].to_numpy(dtype="<i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": total.ravel().astype(np.int64)})

    sums = fps.select("fp").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    out = np.zeros((BITS, BITS))
    for row in sums.collect():  # 4096 rows
        out[row.i, row.j] = row.n
    return out


def correlated_groups(moments: np.ndarray, total: int, m: int) -> list[list[int]]:
    """m groups of bits, of equal size or one bit apart, gathered greedily by correlation."""
    p = np.diag(moments) / total
    cov = moments / total - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    related = np.abs(cov / scale)
    np.fill_diagonal(related, 0)
    left, groups = list(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        group = [max(left, key=lambda b: (related[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (related[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _mask(group: list[int]) -> int:
    return _signed(sum(1 << b for b in group))


def flips(group: list[int], most: int) -> list[int]:
    """All changes of at most so many bits of a group."""
    return [_mask(list(bits)) for k in range(most + 1) for bits in combinations(group, k)]


def differing_shares(p: np.ndarray, most: int) -> np.ndarray:
    """Chances that two fingerprints differ in at most 0, 1, .. ``most`` bits with the set shares p."""
    chances = np.zeros(most + 1)
    chances[0] = 1.0
    for q in 2 * p * (1 - p):
        chances[1:] = chances[1:] * (1 - q) + chances[:-1] * q
        chances[0] *= 1 - q
    return np.cumsum(chances)


def best_thresholds(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds from -1 with the least total cost; costs[g][t] is that of threshold t in group g."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance - used + 1):
                new = (cost + (row[t] if t >= 0 else 0.0), [*chosen, t])
                key = used + t + 1
                if key not in after or new < after[key]:
                    after[key] = new
        best = after
    return best[distance + 1]


@dataclass(frozen=True)
class Plan:
    """Groups of bits and their thresholds."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def plan(fps: DataFrame, total: int, distance: int) -> Plan:
    """Choose groups and thresholds from counts over all fingerprints."""
    moments = bit_moments(fps)
    p = np.diag(moments) / total
    options = [correlated_groups(moments, total, m) for m in GROUPS]
    masks = [(o, g, _mask(group)) for o, groups in enumerate(options) for g, group in enumerate(groups)]
    keys = F.explode(
        F.array(
            *(
                F.struct(F.lit(o).alias("o"), F.lit(g).alias("g"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key"))
                for o, g, mask in masks
            )
        )
    )
    sizes = fps.select(keys.alias("k")).select("k.*").groupBy("o", "g", "key").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    agreeing = {(r.o, r.g): r.pairs for r in sizes.groupBy("o", "g").agg(F.sum(n * n).alias("pairs")).collect()}

    def work(o: int, g: int, group: list[int], t: int) -> float:
        shares = differing_shares(p[group], distance)
        hit = agreeing[o, g] * shares[t] / max(shares[0], 1e-300)
        probes = total * sum(comb(len(group), k) for k in range(t + 1))
        return probes + PAIR_COST * min(hit, float(total) ** 2)

    found = []
    for o, groups in enumerate(options):
        costs = [[work(o, g, group, t) for t in range(distance + 1)] for g, group in enumerate(groups)]
        cost, thresholds = best_thresholds(costs, distance)
        found.append((cost, [tuple(g) for g in groups], thresholds))
    _, groups, thresholds = min(found)
    return Plan(tuple(groups), tuple(thresholds))


def buckets(fps: DataFrame, plan: Plan, total: int) -> DataFrame:
    """g, key, blocks, members: the blocks of fingerprints that agree in group g."""
    used = [(g, _mask(list(group))) for g, group in enumerate(plan.groups) if plan.thresholds[g] >= 0]
    keys = F.explode(
        F.array(*(F.struct(F.lit(g).alias("g"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for g, mask in used))
    )
    rows = fps.select("fp", keys.alias("k")).select("fp", "k.*")
    counts = written(rows.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")))
    rows = join_hot(rows, counts, ["g", "key"], counts, total * len(used))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    return rows.groupBy("g", "key", "blocks", "block").agg(F.collect_list("fp").alias("members"))


def _probing(blocks: DataFrame, plan: Plan) -> DataFrame:
    """The blocks with each key that they probe; of two different keys the larger probes the smaller."""
    parts = []
    for g, t in enumerate(plan.thresholds):
        if t < 0:
            continue
        changes = F.array(*(F.lit(x) for x in flips(list(plan.groups[g]), t)))
        probes = F.transform(changes, lambda c: F.col("key").bitwiseXOR(c))
        found = F.explode(F.filter(probes, lambda k: k <= F.col("key"))).alias("probe")
        parts.append(blocks.where(F.col("g") == g).select("*", found))
    return reduce(DataFrame.unionByName, parts)


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def forest(a: np.ndarray, b: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between the members of two blocks, as many as it takes to connect all that are linked.

    The members are signed 64-bit numbers; bits are counted on unsigned ones.
    """
    bits = b.view(np.uint64)
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    out = []
    for x in a:
        own = int(x)
        for y in b[np.bitwise_count(bits ^ x.view(np.uint64)) <= distance].tolist():
            p, q = root(own), root(y)
            if p != q:
                up[p] = q
                out.append((own, y))
    return out


def links(fps: DataFrame, total: int, plan: Plan, distance: int) -> DataFrame:
    """a, b: pairs of fingerprints that connect all that are within the distance."""
    blocks = written(buckets(fps, plan, total).withColumn("id", F.monotonically_increasing_id()))
    small = (F.col("blocks") == 1) & (F.size("members") <= SMALL)
    keys = blocks.select("g", "key", "id", small.alias("small"), F.when(small, F.col("members")).alias("members"))
    right = keys.select("g", F.col("key").alias("probe"), *(F.col(c).alias(f"{c}_b") for c in ("id", "small", "members")))
    met = _probing(keys, plan).join(right, ["g", "probe"])
    # Blocks of one bucket meet both ways; once is enough.
    met = met.where((F.col("key") != F.col("probe")) | (F.col("id") <= F.col("id_b")))

    pairs = met.where("small and small_b").select(F.explode("members").alias("a"), "members_b")
    near = F.filter("members_b", lambda b: (F.col("a") != b) & _near(F.col("a"), b, distance))
    pairs = pairs.select("a", F.explode(near).alias("b"))

    larger = written(met.where("not (small and small_b)").select("id", "id_b"))
    members = blocks.select("id", "members")
    other = blocks.select(F.col("id").alias("id_b"), F.col("members").alias("members_b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for x, y in zip(pdf["members"], pdf["members_b"]):
                found += forest(np.asarray(x, dtype=np.int64), np.asarray(y, dtype=np.int64), distance)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    compared = larger.join(members, "id").join(other, "id_b").select("members", "members_b")
    return pairs.unionByName(compared.mapInPandas(compare, "a long, b long"))


def near_groups(documents: DataFrame, config: SimHash = SimHash()) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of documents (doc_id, text).

    component_id is the smallest doc_id that links lead to, the row's own included.
    """
    rows = written(fingerprints(documents, config.words))
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    total, documents_total = fps.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = fps.select("fp", "first", F.col("fp").alias("component"))
    if total > 1:
        linked = links(fps.select("fp"), total, plan(fps, total, config.distance), config.distance)
        label = components(linked).withColumnsRenamed({"node": "fp", "component": "label"})
        label = found.join(label, "fp", "left")
        found = label.select("fp", "first", F.coalesce("label", "component").alias("component"))
    found = written(found)
    sizes = found.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    sizes = written(sizes)
    found = join_hot(found, sizes.drop("n"), ["component"], sizes, total).select("fp", "component_id")
    out = join_hot(rows, written(found), ["fp"], fps, documents_total)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
