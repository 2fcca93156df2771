"""Token counts with a whole-token shortcut.

A vocabulary string that, encoded alone, comes out as one token is *proven* by merging
it once when a worker starts.  A pre-token that is such a string counts one and is not
merged; all others are merged by rank, in n log n for long ones, and short ones are
remembered.  A special string inside a text is found first and counts one.

A null text is empty: 0 bytes and 0 tokens.  An empty table gives an empty table;
repeated rows repeat their results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.bpe import KEPT_LENGTH, KEPT_WORDS, texts_of
from codesift.llm.vocabulary import Vocabulary, byte_symbols, merged, vocabulary


class TokenCounter:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.words: dict[str, int] = {}
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.whole: set[str] = set()
        for s, i in vocab.ids.items():
            if merged(vocab, s) == [i]:
                try:  # pieces of characters never are whole pre-tokens
                    self.whole.add(bytes(byte_of[c] for c in s).decode("utf-8"))
                except UnicodeDecodeError:
                    continue

    def count(self, text: str) -> int:
        total = 0
        whole, words, vocab = self.whole, self.words, self.vocab
        for special, part in vocab.pieces(text):
            if special:
                total += 1
                continue
            newer = vocab.newer_words(part)
            if newer is not None:
                total += sum(len(merged(vocab, word)) for word in newer)
                continue
            for pre_token in vocab.split.findall(part):
                if pre_token in whole:
                    total += 1
                    continue
                n = words.get(pre_token)
                if n is None:
                    n = len(merged(vocab, vocab.word(pre_token)))
                    if len(pre_token) <= KEPT_LENGTH:
                        if len(words) >= KEPT_WORDS:
                            words.clear()
                        words[pre_token] = n
                total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(vocabulary(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc (its id), n_bytes, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            out = [count(t) for _, texts in texts_of(batch, 2) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(out, np.int64))], names=["doc", "n_bytes", "n_tokens"])

    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return own.mapInArrow(run, f"doc {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
