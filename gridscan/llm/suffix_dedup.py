"""Removal of byte strings that an earlier document has, by suffix sorting.

Every byte that a string of ``length`` bytes covers goes, if the string also starts in a document with a
smaller id. Overlaps count, and strings are judged on the input.

Suffixes need to be sorted only where texts can agree. A string of ``length`` bytes holds an anchor: the
32-byte gram of smallest hash in it (the first of equal ones), so equal strings have equal anchors at equal
places. Strings that follow one another in a text with the same anchor are a run; its context are the bytes
that they cover. Steps, all exact but for equal 64-bit hashes of different texts or grams:

1. Equal texts are one class, which the smallest id stands for. Longer copies than ``length`` go whole.
2. Anchors are dealt by hash in packed blocks. Those of one class only can share no string.
3. Texts with shared anchors give the contexts of their runs. Of equal contexts that one task sees, those
   of larger ids go at once and only the rest move on, so a passage that very many texts have moves about
   once per task.
4. Contexts meet by anchor, which becomes one symbol of them. Of equal ones the smallest id stays. A context
   is cut back on either side to what it shares with another context of its anchor, since no common string
   reaches farther; one that is then too short has none. The suffixes of all others are sorted anchor by
   anchor (linear grouping over Lyndon prefixes, ``lyndon_sort``). In that order equal strings stand
   together; all but those of the smallest id go.
5. Removed stretches are gathered per class and cut out of the texts.

An anchor that more than ``large`` texts have is not brought together as one: its strings meet by their own
bytes, again after larger ids have gone in every task.

Defined cases: null and empty texts, and those shorter than ``length``, lose nothing; very long texts are
treated whole; a null id counts as larger than all others; equal rows with one id lose only what smaller ids
have; an empty table gives no rows; further columns are kept, result columns replace those of the same name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscan.llm.common import with_fields, written
from gridscan.llm.lyndon_sort import suffix_order
from gridscan.llm.packed import U, mix, shared_keys, slices, unpack

GRAM = 32
BATCH_BYTES = 4_000_000
BLOCK_KEYS = 1_000_000
SORT_ROWS = 50_000  # contexts whose suffixes are sorted in one call, about
NO_BYTE = 0xFF  # no UTF-8 text holds it
ANCHOR = 0x101  # the symbol of an anchor, above those of all bytes
LARGE = 20_000
LAST_ID = (1 << 63) - 1
_POSITION = U(0xFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each position on."""
    h = mix(data.astype(U) + U(0x9E3779B97F4A7C15))
    step = 1
    while step < GRAM:
        h = h[:-step] * U(0xD6E8FEB86659FD93) + h[step:]
        h ^= h >> U(29)
        step *= 2
    return mix(h)


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of so many keys."""
    span, out = 1, keys
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run: anchor hash, index of its text, first and last start of its strings, place of the anchor."""
    out = []
    held: list[tuple[int, int, bytes]] = []  # index, offset in its text, bytes
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), BATCH_BYTES):
            part = text[at : at + BATCH_BYTES + length - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= BATCH_BYTES:
                out.append(_runs(held, length))
                held, size = [], 0
    if held:
        out.append(_runs(held, length))
    if not out:
        return np.empty(0, U), *(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(5))


def _runs(held: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8)
    sizes = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    key = gram_hashes(data)
    packed = (key & ~_POSITION) | np.arange(len(key), dtype=U)
    least = _smallest(packed, length - GRAM + 1) & _POSITION
    valid = np.ones(len(least), dtype=bool)  # strings inside one text
    for end in ends[:-1]:
        valid[end - length + 1 : end] = False
    at = np.flatnonzero(valid)
    anchor = least[at].astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    which = np.searchsorted(ends, at[first], side="right")
    offset = np.array([o for _, o, _ in held])[which] - starts[which]
    index = np.array([i for i, _, _ in held])[which]
    place = anchor[first]
    # Smallest hashes crowd at the low end: they are spread again, as blocks are dealt by ranges.
    return mix(key[place]), index, at[first] + offset, at[last] + offset, place + offset


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def shared_anchors(texts: DataFrame, length: int, large: int) -> DataFrame:
    """class, anchors, frequent: 48 bits of the anchors of each class that other classes have too.

    frequent: those that more than ``large`` classes have. texts: class, text.
    """
    buckets = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            classes = np.fromiter(seen, dtype=np.int64, count=len(seen))
            rows = slices(
                np.concatenate(keys), np.concatenate(owners), classes, np.zeros(len(seen), dtype=np.int64), buckets
            )
            return pd.DataFrame(rows, columns=["bucket", "block"])

        for pdf in batches:
            fresh, at = [], []
            for owner, text in zip(pdf["class"], pdf["text"]):
                if owner not in seen:
                    at.append(len(seen))
                    seen[owner] = len(seen)
                    fresh.append(_bytes_of(text))
            key, index, *_ = runs(fresh, length)
            if len(key):
                key = key >> U(16)
                both = np.unique(np.rec.fromarrays([np.array(at)[index], key], names="o,k"))
                owners.append(np.ascontiguousarray(both.o))
                keys.append(np.ascontiguousarray(both.k))
                held += len(both)
            if held >= BLOCK_KEYS:
                yield flush()
                seen.clear(), keys.clear(), owners.clear()
                held = 0
        if held:
            yield flush()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, owners, _ = shared_keys([unpack(b) for b in pdf["block"]])
        _, index, times = np.unique(keys, return_inverse=True, return_counts=True)
        times = times[index]
        more = times > 1
        anchors = keys[more].view(np.int64)
        return pd.DataFrame({"class": owners[more], "anchor": anchors, "often": times[more] > large})

    blocks = texts.mapInPandas(split, "bucket int, block binary")
    rows = blocks.groupBy("bucket").applyInPandas(count, "class long, anchor long, often boolean")
    return rows.groupBy("class").agg(
        F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("often"), F.col("anchor"))).alias("frequent")
    )


FOUND = ["class", "start", "end"]
SIDES = "key long, left binary, right binary, id long, class long, start long, end long"


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of SIDES that go, as one row without sides for each stretch, with keys of no anchor."""
    rows = rows.sort_values(["class", "start"], kind="stable")
    text, start, end = (rows[c].to_numpy() for c in FOUND)
    head = np.ones(len(rows), dtype=bool)
    head[1:] = (text[1:] != text[:-1]) | (start[1:] > end[:-1])  # ends ascend with starts, as runs follow one another
    out = rows[head].assign(left=None, right=None, end=end[np.append(head[1:], True)] if len(rows) else end)
    return out.assign(key=mix(out["class"].to_numpy(np.int64).view(U) + out["start"].to_numpy(np.int64).view(U)).view(np.int64))


def sides_of(texts: DataFrame, length: int) -> DataFrame:
    """SIDES: the contexts of each text's shared anchors, as the bytes before and behind the anchor.

    A row without sides is a stretch that goes: the task saw its contexts with smaller ids. For a frequent
    anchor each string is a context of its own, with a key of its own. texts: id, first, class, text,
    anchors, frequent; only rows whose id is ``first`` count.
    """

    def within(key: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.isin(key >> U(16), np.asarray(known).astype(np.int64).view(U))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[(pdf["id"] == pdf["first"]) & pdf["anchors"].notna()].drop_duplicates(["class", "id"])
            data = [_bytes_of(t) for t in pdf["text"]]
            key, index, first, last, place = runs(data, length)
            edges = np.searchsorted(index, np.arange(len(data) + 1))
            often = np.zeros(len(key), dtype=bool)
            keep = np.zeros(len(key), dtype=bool)
            for i, (anchors, frequent) in enumerate(zip(pdf["anchors"], pdf["frequent"])):
                part = slice(edges[i], edges[i + 1])
                keep[part] = within(key[part], anchors)
                if len(frequent):
                    often[part] = within(key[part], frequent)
            once = np.flatnonzero(keep & ~often)
            many = np.flatnonzero(keep & often)
            parts = last[many] - first[many] + 1  # strings of the runs of frequent anchors
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            which = np.concatenate([once, np.repeat(many, parts)])
            start = np.concatenate([first[once], first[np.repeat(many, parts)] + step])
            end = np.concatenate([last[once], first[np.repeat(many, parts)] + step]) + length
            if not len(which):
                continue
            place_of, anchor, text = place[which], key[which].copy(), index[which]
            left = [data[i][a:p] for i, a, p in zip(text, start, place_of)]
            right = [data[i][p + GRAM : b] for i, p, b in zip(text, place_of, end)]
            for j in range(len(once), len(which)):
                anchor[j] ^= U(xxhash.xxh3_64_intdigest(left[j] + b"|" + right[j], seed=len(left[j])))
            rows = pd.DataFrame({
                "key": anchor.view(np.int64), "left": left, "right": right, "id": pdf["id"].to_numpy()[text],
                "class": pdf["class"].to_numpy()[text], "start": start, "end": end,
            })
            least = rows.groupby(["key", "left", "right"], sort=False)["id"].transform("min")
            gone = (rows["id"] > least).to_numpy()
            yield rows[~gone]
            yield _joined(rows[gone])

    return texts.select("id", "first", "class", "text", "anchors", "frequent").mapInPandas(cut, SIDES)


def _places(sides: list[bytes], width: int, front: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each side away from the anchor, one row each, filled up with a byte that no text has; sizes."""
    fill = bytes([NO_BYTE])
    joined = b"".join([x.rjust(width, fill) for x in sides] if front else [x.ljust(width, fill) for x in sides])
    rows = np.frombuffer(joined, dtype=np.uint8).reshape(len(sides), width)
    return rows[:, ::-1] if front else rows, np.fromiter(map(len, sides), dtype=np.int64, count=len(sides))


def _order(key: np.ndarray, *sides: np.ndarray) -> np.ndarray:
    """Rows by key and then by the bytes of the sides."""
    words = []
    for side in sides:
        padded = np.zeros((len(side), -(-side.shape[1] // 8) * 8), dtype=np.uint8)
        padded[:, : side.shape[1]] = side
        words += list(padded.view(">u8").astype(U).T)
    return np.lexsort((*words[::-1], key))


def _agreed(key: np.ndarray, side: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many places from the anchor on a row shares with the other row of its key that agrees in most."""
    out = np.zeros(len(key), dtype=np.int64)
    if len(key) > 1 and side.shape[1]:
        order = _order(key, side)
        differ = side[order[1:]] != side[order[:-1]]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1])
        same = np.minimum(same, np.minimum(size[order[1:]], size[order[:-1]]))
        same[key[order[1:]] != key[order[:-1]]] = 0
        out[order[1:]] = same
        out[order[:-1]] = np.maximum(out[order[:-1]], same)
    return out


def earlier_strings(symbols: np.ndarray, block: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Sorted places of the strings of so many symbols that a text of a smaller owner has in the same block.

    symbols, block: as for ``suffix_order``; owner: of each place.
    """
    order = suffix_order(symbols, block)
    ends = np.flatnonzero(symbols == 0)
    order = order[order + length <= ends[np.searchsorted(ends, order)]] if len(order) else order
    if not len(order):
        return order
    new = np.ones(len(order), dtype=bool)
    new[1:] = block[order[1:]] != block[order[:-1]]
    for k in range(length):
        new[1:] |= symbols[order[1:] + k] != symbols[order[:-1] + k]
    first = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(owner[order], first), np.diff(np.append(first, len(order))))
    return np.sort(order[owner[order] > least])


def contexts_matches(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """class, start, end: what goes of contexts (SIDES) that hold all of their keys."""
    decided = rows["left"].isna().to_numpy()
    out = [rows.loc[decided, FOUND]]
    rows = rows[~decided]
    if not len(rows):
        return out[0]
    width = length - GRAM
    key, own = rows["key"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)
    left, left_size = _places(rows["left"].tolist(), width, True)
    right, right_size = _places(rows["right"].tolist(), width, False)
    # Equal contexts: those of larger ids go, the others are one.
    order = _order(key, left, right)
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    for side in (left, right):
        new[1:] |= (side[order[1:]] != side[order[:-1]]).any(axis=1)
    one = order[new]
    context = np.empty(len(order), dtype=np.int64)
    context[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(own[order], np.flatnonzero(new))
    gone = own > least[context]
    out.append(rows.loc[gone, FOUND])
    # A string cannot reach farther from the anchor than another context agrees with this one.
    key, left, right = key[one], left[one], right[one]
    before, behind = _agreed(key, left, left_size[one]), _agreed(key, right, right_size[one])
    kept = np.flatnonzero(before + behind >= width)
    if not len(kept):
        return pd.concat(out)
    before, behind = before[kept], behind[kept]
    marks = np.full((len(kept), 2 * width + 2), ANCHOR, dtype=np.int64)
    marks[:, :width] = left[kept][:, ::-1].astype(np.int64) + 1
    marks[:, width + 1 : -1] = right[kept].astype(np.int64) + 1
    marks[:, -1] = 0
    used = np.ones(marks.shape, dtype=bool)
    used[:, :width] = np.arange(width)[::-1] < before[:, None]
    used[:, width + 1 : -1] = np.arange(width) < behind[:, None]
    sizes = used.sum(axis=1)
    symbols = np.append(0, marks[used])
    text = np.append(0, np.repeat(np.arange(len(kept)), sizes))
    block = np.unique(key[kept], return_inverse=True)[1]
    at = earlier_strings(symbols, block[text], least[kept][text], width + 1)
    if not len(at):
        return pd.concat(out)
    # Strings that touch are one stretch; every row of the context loses it.
    head = np.ones(len(at), dtype=bool)
    head[1:] = (text[at[1:]] != text[at[:-1]]) | (np.diff(at) > width + 1)
    first, last = at[head], at[np.append(head[1:], True)]
    which = text[first]
    offset = 1 + np.cumsum(sizes) - sizes + before - left_size[one][kept]  # where the whole context would start
    found = pd.DataFrame({"context": kept[which], "from": first - offset[which], "to": last - offset[which] + length})
    places = pd.DataFrame({"context": context[~gone], "class": rows["class"].to_numpy()[~gone], "at": rows["start"].to_numpy()[~gone]})
    found = found.merge(places, on="context")
    out.append(pd.DataFrame({"class": found["class"], "start": found["at"] + found["from"], "end": found["at"] + found["to"]}))
    return pd.concat(out)


def sorted_matches(rows: DataFrame, length: int) -> DataFrame:
    """class, start, end: what goes, of rows of SIDES."""

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            size += len(pdf)
            last = pdf["key"].iloc[-1]
            if size >= SORT_ROWS and held[0]["key"].iloc[0] != last:  # the last key may go on
                together = pd.concat(held, ignore_index=True)
                whole = (together["key"] != last).to_numpy()
                yield contexts_matches(together[whole], length)
                held = [together[~whole]]
                size = len(held[0])
        if size:
            yield contexts_matches(pd.concat(held, ignore_index=True), length)

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(sort, "class long, start long, end long")


def joined_stretches(pairs) -> list[tuple[int, int]]:
    """Maximal stretches of a list of (start, end)."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((int(p["start"]), int(p["end"])) for p in pairs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


FIELDS = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
HELPERS = {"rd_class", "rd_first", "rd_stretches", "anchors", "frequent"}


def remove_repeats(documents: DataFrame, length: int = 50, large: int = LARGE) -> DataFrame:
    """documents (doc_id, text, ...) with FIELDS; ``kept`` are the remaining bytes."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    # Columns that share a name with one used below stay out of the way under another.
    clashing = {c: f"_{uuid.uuid4().hex}" for c in documents.columns if c.lower() in HELPERS}
    documents = documents.withColumnsRenamed(clashing)
    last = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    own = documents.withColumn("rd_class", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = own.select(F.col("rd_class").alias("class"), "text").where(F.octet_length("text") >= length)
    firsts = own.select("rd_class", last.alias("id")).groupBy("rd_class").agg(F.min("id").alias("rd_first"))
    wanted = firsts.join(shared_anchors(texts, length, large).withColumnRenamed("class", "rd_class"), "rd_class", "left")
    wanted = written(wanted)
    dealt = own.join(wanted, "rd_class", "left")
    shared = dealt.select(last.alias("id"), F.col("rd_first").alias("first"), F.col("rd_class").alias("class"), "text", "anchors", "frequent")
    lost = sorted_matches(sides_of(shared, length), length)
    lost = lost.groupBy(F.col("class").alias("rd_class")).agg(F.collect_list(F.struct("start", "end")).alias("rd_stretches"))
    rows = own.join(wanted.select("rd_class", "rd_first").join(lost, "rd_class", "left"), "rd_class", "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, copies, lists in batches:
            rows = []
            for text, copy, pairs in zip(texts, copies, lists):
                data = _bytes_of(text)
                gone = [(0, len(data))] if copy else joined_stretches(pairs) if pairs is not None else []
                at, parts = 0, []
                for start, end in gone:
                    parts.append(data[at:start])
                    at = end
                kept = b"".join([*parts, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=FIELDS)

    copy = (F.octet_length("text") >= length) & (last > F.col("rd_first"))
    cut_rows = with_fields(rows, cut("text", F.coalesce(copy, F.lit(False)), "rd_stretches"), FIELDS)
    cut_rows = cut_rows.drop("rd_class", "rd_first", "rd_stretches")
    return cut_rows.withColumnsRenamed({hidden: name for name, hidden in clashing.items()})
