"""Byte-pair encoding by backtracking, and decoding from an offset table.

The encoder never merges.  An Aho-Corasick automaton over all tokens gives the longest
token at each place of a pre-token.  From left to right the longest token is taken that
is *compatible* with the one before it; if none is, the one before is shortened.  A
sequence is what merging would give exactly if every neighbouring pair is compatible,
i.e. if merging the two tokens' symbols together never merges across their border:

a symbol sequence x at the right edge of the left token and y at the left edge of the
right token, joined by a merge of rank q, would do so if both exist at that time.  x
does from its own merge until the merge that takes it up; the same holds for y, save
that of equal ranks the leftmost goes first.  Only edges of the two tokens need be
looked at, and verdicts are kept in a table of pairs.

Places that were given up are marked, so each is visited once: the work is linear in
the length of the pre-token.  Decoding gathers bytes from one flat string through the
offsets of the ids.

A null text is empty: no ids, and an empty text decoded.  An empty table gives an empty
table; repeated rows repeat their results.  Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.vocabulary import LIMIT, Vocabulary, vocabulary
from codesift.llm.words import raw

KEPT_WORDS = 400_000  # encoded words and pair verdicts that a worker remembers at once
KEPT_LENGTH = 64
SLICE_ROWS = 256


class BacktrackingEncoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.length = {i: len(s) for s, i in vocab.ids.items()}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank of the merge that makes it
        self.right_edge: dict[int, list[tuple[int, int, int]]] = {}  # (part, made at, taken up at)
        self.left_edge: dict[int, list[tuple[int, int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        for i in (i for s, i in vocab.ids.items() if len(s) == 1):
            self.right_edge[i] = self.left_edge[i] = [(i, -1, LIMIT)]
        for (a, b), rank in sorted(vocab.rank.items(), key=lambda x: x[1]):
            token = vocab.result[a, b]
            if token not in self.right_edge and a in self.right_edge and b in self.right_edge and self._border(a, b) == rank:
                self.right_edge[token] = [(token, rank, LIMIT), (b, self.right_edge[b][0][1], rank), *self.right_edge[b][1:]]
                self.left_edge[token] = [(token, rank, LIMIT), (a, self.left_edge[a][0][1], rank), *self.left_edge[a][1:]]
        # Tokens that merging can't make are left out: they never stand in a result.
        self.found = ahocorasick.Automaton()
        reachable = {s: i for s, i in vocab.ids.items() if i in self.right_edge}
        for s, i in reachable.items():
            self.found.add_word(s, i)
        self.found.make_automaton()
        self.shorter: dict[int, int] = {}
        for s, i in reachable.items():
            self.shorter[i] = next((reachable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in reachable), -1)

    def _border(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of a and b, LIMIT if there is none."""
        best = LIMIT
        rank = self.vocab.rank
        for x, made_x, taken_x in self.right_edge[a]:
            for y, made_y, taken_y in self.left_edge[b]:
                q = rank.get((x, y), LIMIT)
                if q < best and made_x < q < taken_x and made_y < q <= taken_y:
                    best = q
        return best

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 2 * KEPT_WORDS:
                self.pairs.clear()
            known = self.pairs[key] = self._border(a, b) == LIMIT
        return known

    def encode_word(self, word: str) -> list[int]:
        whole = self.vocab.ids.get(word)
        if whole in self.shorter:
            return [whole]
        length, shorter = self.length, self.shorter
        longest = [-1] * len(word)
        reach = [0] * len(word)
        for end, token in self.found.iter(word):
            start = end + 1 - length[token]
            if length[token] > reach[start]:
                longest[start], reach[start] = token, length[token]
        out: list[int] = []
        given_up = bytearray(len(word) + 1)
        at = 0
        token = longest[0] if word else -1
        while at < len(word):
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if not given_up[end] and (last < 0 or self.fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(word) else -1
            else:
                given_up[at] = 1
                last = out.pop()  # a first token of one symbol always fits, so there is one
                at -= length[last]
                token = shorter[last]
        return out

    def encode(self, text: str) -> list[int]:
        vocab, words = self.vocab, self.words
        ids: list[int] = []
        for special, part in vocab.pieces(text):
            if special:
                ids.append(vocab.special[part])
                continue
            newer = vocab.newer_words(part)
            if newer is not None:
                for word in newer:
                    ids.extend(self.encode_word(word))
                continue
            for pre_token in vocab.split.findall(vocab.normal(part)):
                known = words.get(pre_token)
                if known is None:
                    known = tuple(self.encode_word(vocab.word(pre_token)))
                    if len(pre_token) <= KEPT_LENGTH:
                        if len(words) >= KEPT_WORDS:
                            words.clear()
                        words[pre_token] = known
                ids.extend(known)
        return ids


class OffsetDecoder:
    """Ids to text for a vocabulary without decoder: names of tokens with one space between."""

    def __init__(self, vocab: Vocabulary):
        names = [vocab.names.get(i, "").encode("utf-8") + b" " for i in range(max(vocab.names) + 1)]
        self.flat = np.frombuffer(b"".join(names), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(n) for n in names])])

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)][:-1].tobytes()


@lru_cache(maxsize=2)
def coder(path: str) -> tuple[BacktrackingEncoder, OffsetDecoder]:
    vocab = vocabulary(path)
    return BacktrackingEncoder(vocab), OffsetDecoder(vocab)


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Texts of a few rows at a time; null is empty."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        data, offsets = raw(batch.column(column).slice(at, SLICE_ROWS))
        held = data.tobytes()
        yield at, [held[a:b].decode("utf-8") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc (its id), ids, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(path)
        for batch in batches:
            for at, texts in texts_of(batch, 1):
                ids = [np.array(encoder.encode(t), np.int32) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), np.concatenate(ids)),
                        pa.array([decoder.decode(x) for x in ids], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc", "ids", "decoded"],
                )

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")
