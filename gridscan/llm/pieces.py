"""SentencePiece encoding and decoding over the pieces of a given model file.

A text is split into pieces so that the sum of the pieces' scores is largest. The automaton (Aho-Corasick)
over all pieces reads the text once; at every position its output links list the pieces that end there, and
each relaxes the best score of that position from the best score of the piece's start (Viterbi). Characters
that no piece covers become the byte pieces of their UTF-8 form, at a score below any piece's. Of equal
scores the longer last piece wins, as the output links lead from longer to shorter pieces.

For a model whose scores are merge ranks (BPE) this gives the segmentation of the best total rank, which
need not be the one that replaying merges gives; decoding is exact either way.

No piece has a space mark behind another character, so the best split of a text is the best splits of its
words (a run of space marks with the word behind it), put together. Splits of words are remembered up to a
number of words, which saves time and changes no result.

The space is written as U+2581 and one is put in front of the text. A U+2581 in the text itself becomes its
bytes, so that decoding gives back every text exactly, with all white space.

Defined cases: a null text gives null pieces and decodes to null; an empty text has no piece; very long
texts and words are encoded whole, in time linear in their length; repeated rows are encoded alike; an empty
table gives no rows; result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscan.llm.common import release, with_fields

MARK = "▁"
BYTE_PENALTY = 10.0
REMEMBERED, LONGEST_REMEMBERED = 400_000, 40
HELD = 50_000  # words that a worker may remember from one task to the next
UNKNOWN_SCORE = -1e9  # pieces scored at or below it have no score of their own: they rank below all others


class PieceModel:
    """Pieces, scores and the automaton over them."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int]):
        """pieces: by id, '' where an id is no text piece; byte_ids: the id of each byte."""
        self.byte_ids = byte_ids
        usable = [s for p, s in pieces if p and s > UNKNOWN_SCORE]
        lowest = min(usable, default=0.0) - 1
        pieces = [(p, s if s > UNKNOWN_SCORE else lowest) for p, s in pieces]
        self.byte_score = lowest - BYTE_PENALTY
        self.scores = [s for _, s in pieces]
        self.plain = [p.replace(MARK, " ").encode() for p, _ in pieces]
        for value, i in enumerate(byte_ids):
            self.plain[i] = bytes([value])
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece:
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece has a space mark behind another character")
                self.automaton.add_word(piece, (len(piece), score, i))
        self.single = {p for p, s in pieces if len(p) == 1 and s > self.byte_score}
        self.empty = len(self.automaton) == 0
        if not self.empty:
            self.automaton.make_automaton()
        self.own_mark = array("i", [byte_ids[b] for b in MARK.encode()]).tobytes()
        line = "" if any("\n" in p for p, _ in pieces) else "\n"  # lines are apart if no piece joins them
        self.words = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|{line}" if line else ""))
        self.memory: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = [], [0] * 256
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:-1], 16)] = i
            text = not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
            pieces.append((sp.id_to_piece(i) if text else "", sp.get_score(i)))
        return cls(pieces, byte_ids)

    def best_split(self, word: str) -> list[int]:
        """Ids of the best split of a text without U+2581 of its own."""
        n = len(word)
        best, back, size = [0.0] + [float("-inf")] * n, [-1] * (n + 1), [1] * (n + 1)
        if self.single.issuperset(word):  # no byte can be better than the piece of its character
            for end, (length, score, i) in self.automaton.iter(word):
                end += 1
                value = best[end - length] + score
                if value > best[end]:
                    best[end], back[end], size[end] = value, i, length
        else:
            self._relax_with_bytes(word, best, back, size)
        ids: list[int] = []
        at = n
        while at > 0:
            if back[at] >= 0:
                ids.append(back[at])
            else:
                ids.extend(self.byte_ids[b] for b in reversed(word[at - 1].replace(MARK, " ").encode()))
            at -= size[at]
        ids.reverse()
        return ids

    def _relax_with_bytes(self, word: str, best: list, back: list, size: list) -> None:
        fall, single, done = self.byte_score, self.single, 0
        ends = [] if self.empty else self.automaton.iter(word)
        for end, (length, score, i) in [*ends, (len(word), (0, 0.0, -1))]:
            while done < end:  # all pieces that end at or before done have been seen
                done += 1
                char = word[done - 1]
                if char not in single:
                    value = best[done - 1] + fall * (1 if char == MARK else len(char.encode()))
                    if value > best[done]:
                        best[done], back[done], size[done] = value, -1, 1
            if length:
                value = best[end + 1 - length] + score
                if value > best[end + 1]:
                    best[end + 1], back[end + 1], size[end + 1] = value, i, length

    def _word(self, word: str) -> bytes:
        found = array("i", self.best_split(word)).tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.empty(0, dtype=np.int32)
        parts = (" " + text).split(MARK)  # between space marks of the text's own
        return np.frombuffer(self.own_mark.join([self._encode(p.replace(" ", MARK)) for p in parts]), dtype=np.int32)

    def _encode(self, text: str) -> bytes:
        known, word = self.memory.get, self._word
        return b"".join([known(w) or word(w) for w in self.words.findall(text)])

    def rest(self) -> None:
        """After a task: give back a large memory, which would take room from other stages' tasks."""
        if len(self.memory) > HELD:
            self.memory.clear()
        release()

    def decode(self, ids) -> str:
        """The text of ids, without the space put in front."""
        plain = self.plain
        data = b"".join([plain[i] for i in np.asarray(ids).tolist()])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    """Read once per worker."""
    return PieceModel.load(path)


def encode_texts(df: DataFrame, model: str, text: str = "text", out: str = "pieces") -> DataFrame:
    """df with ``out``: the ids of each text. model: a path that every executor has."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = load_model(model)
        for texts in batches:
            yield pd.Series([None if t is None else pieces.encode(t) for t in texts], dtype=object)
        pieces.rest()

    return with_fields(df, F.struct(encode(F.col(f"`{text}`")).alias(out)), [out])


def decode_pieces(df: DataFrame, model: str, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """df with ``out``: the text of each row's ids."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = load_model(model)
        for rows in batches:
            yield pd.Series([None if r is None else known.decode(r) for r in rows], dtype=object)
        known.rest()

    return with_fields(df, F.struct(decode(F.col(f"`{pieces}`")).alias(out)), [out])
