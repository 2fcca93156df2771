"""Substring dedup by difference-cover anchors.

A repeated window has ``WINDOW`` words.  The set COVER holds, for every residue, two
members with that difference modulo PERIOD.  So if a window occurs at two places, some
offset below PERIOD falls on a cover position in both, and the ANCHOR words from there
on lie inside both occurrences.  Only cover positions are hashed: 6 of 31.

1. *Anchors*: the hash of the anchor words, and the hash of the context, i.e. all words
   that any window through this anchor can reach.  Among equal contexts only the
   smallest document needs to be looked at again; all others are covered as a whole.
   Each slice of texts is combined before the exchange, so a passage that a third of
   the documents share sends one row a slice and not one a document.
2. *Extension*: anchors that occur in different contexts (near an edit, or at the end
   of a passage) are extended to whole windows in the text of the smallest document of
   each context; the windows are compared in the same way.
3. The covered words of each document are cut from its text.

No pairs are made anywhere: every comparison is with the smallest document of a key.
Two independent 64-bit hashes identify a sequence of words.

Defined cases: a null text has no words; texts under WINDOW words stay whole; a row
without id counts as later than every other; equal ids are never smaller than each
other, and rows with one id (or none) but different texts are handled separately, told
apart by a 64-bit hash of the text and its length; repeated rows give repeated results;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.store import NO_ID, order_key, written
from codesift.llm.words import BASES, mix, prefix_sums, run_hash, word_slices

WINDOW = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # every residue modulo 31 is a difference of two of these
ANCHOR = WINDOW - PERIOD + 1
REACH = WINDOW - ANCHOR
COMBINE_WORDS = 2_000_000

ROW = ["doc", "tag", "size"]  # tells the rows of a table apart, except repeated ones
ROWS = "h long, ctx long, doc long, tag long, size int, at long"
SPANS = "kind int, doc long, tag long, size int, lo int, hi int"
_U64 = np.uint64


def _pack(pos: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (pos << 12) | (left << 6) | right


def _numbers(batch: pa.RecordBatch, columns: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in columns)


def _spans(kind: int, doc: np.ndarray, tag: np.ndarray, size: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    pos, left, right = at >> 12, (at >> 6) & 63, at & 63
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(doc), kind, np.int32)),
            pa.array(doc),
            pa.array(tag),
            pa.array(size),
            pa.array((pos - left).astype(np.int32)),
            pa.array((pos + ANCHOR + right).astype(np.int32)),
        ],
        names=["kind", *ROW, "lo", "hi"],
    )


def _combined(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows to exchange.  Of equal (h, ctx) in these texts only those of the smallest
    document go on as candidates; the others are covered, and say so by a null ctx."""
    h, ctx, doc, tag, size, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((doc, ctx, h))
    h, ctx, doc, tag, size, at = (x[order] for x in (h, ctx, doc, tag, size, at))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])
    covered = doc > doc[new][np.cumsum(new) - 1]
    h = np.where(covered, mix(doc.astype(_U64) ^ mix(tag.view(_U64))), h)
    for i in range(0, len(h), 50_000):
        part = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(h[part].view(np.int64)), pa.array(ctx[part].view(np.int64), mask=covered[part]),
                *(pa.array(x[part]) for x in (doc, tag, size, at)),
            ],
            names=["h", "ctx", *ROW, "at"],
        )


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of whole texts: columns doc, tag, size, text in; ROWS out."""
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0
    for batch in batches:
        row = _numbers(batch, (0, 1, 2))
        for a, b, words in word_slices(batch.column(3)):
            if not len(words.start):
                continue
            hashes = words.hashes()
            one, two = prefix_sums(hashes, BASES[0]), prefix_sums(words.hashes(1), BASES[1])
            doc = words.doc
            first, last = words.first[doc], words.first[doc + 1]
            pos = np.arange(len(hashes)) - first
            lo, hi = np.maximum(np.arange(len(hashes)) - REACH, first), np.minimum(np.arange(len(hashes)) + WINDOW, last)
            at = np.flatnonzero(cover[pos % PERIOD] & (hi - lo >= WINDOW) & (pos + ANCHOR <= last - first))
            lo, hi, doc = lo[at], hi[at], doc[at]
            left, right = at - lo, hi - at - ANCHOR
            ctx = mix(run_hash(two, BASES[1], lo, hi) ^ (left * 64 + right).astype(_U64))
            parts.append((run_hash(one, BASES[0], at, at + ANCHOR), ctx, *(x[a:b][doc] for x in row), _pack(pos[at], left, right)))
            held += len(hashes)
            if held >= COMBINE_WORDS:
                yield from _combined(parts)
                parts, held = [], 0
    if parts:
        yield from _combined(parts)


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole windows that start inside the given ranges: doc, tag, size, text, lo, hi in."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0
    for batch in batches:
        row = _numbers(batch, (0, 1, 2))
        los, his = batch.column(4), batch.column(5)
        for a, b, words in word_slices(batch.column(3)):
            hashes = words.hashes()
            one, two = prefix_sums(hashes, BASES[0]), prefix_sums(words.hashes(1), BASES[1])
            for d in range(a, b):
                first = words.first[d - a]
                steps = np.zeros(words.first[d - a + 1] - first + 1, np.int64)
                np.add.at(steps, los[d].values.to_numpy(), 1)
                np.add.at(steps, his[d].values.to_numpy() - WINDOW + 1, -1)
                pos = np.flatnonzero(np.cumsum(steps) > 0)
                start = first + pos
                flat = np.zeros(len(pos), np.int64)
                parts.append((
                    run_hash(one, BASES[0], start, start + WINDOW), run_hash(two, BASES[1], start, start + WINDOW),
                    *(np.full(len(pos), x[d], x.dtype) for x in row), _pack(pos, flat, flat + REACH),
                ))
                held += len(pos)
            if held >= COMBINE_WORDS // 4:
                yield from _combined(parts)
                parts, held = [], 0
    if parts:
        yield from _combined(parts)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over ROWS sorted by (h, ctx, doc): kind 0 for a covered context, kind 1
    for the smallest document of a context whose anchor has other contexts too.

    Held between batches: the open anchor's class and the rows of its first smallest
    document, never the group."""
    open_h = open_ctx = open_doc = None
    classes = 0
    waiting: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        told = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        h, *row = _numbers(batch, (0, 2, 3, 4, 5))  # row: doc, tag, size, at
        if told.any():
            yield _spans(0, *(x[told] for x in row))
        ctx = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        h, ctx, row = h[~told], ctx[~told], [x[~told] for x in row]
        doc = row[0]
        if not len(h):
            continue
        goes_on = open_h is not None and h[0] == open_h
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_h[0] = not goes_on
        new_c = new_h.copy()
        new_c[1:] |= ctx[1:] != ctx[:-1]
        new_c[0] |= ctx[0] != open_ctx
        smallest = np.concatenate([[doc[0] if open_doc is None else open_doc], doc[new_c]])[np.cumsum(new_c)]
        covered = doc > smallest
        group = np.cumsum(new_h)
        total = np.bincount(group, new_c).astype(np.int64)
        total[0] += classes
        many = total[group] > 1
        if covered.any():
            yield _spans(0, *(x[covered] for x in row))
        if goes_on and total[0] > 1:
            for part in waiting:
                yield _spans(1, *part)
        if not goes_on or total[0] > 1 or group[-1] > 0:
            waiting = []
        out = ~covered & many
        if out.any():
            yield _spans(1, *(x[out] for x in row))
        if total[group[-1]] == 1:
            rest = ~covered & (group == group[-1])
            waiting.append(tuple(x[rest] for x in row))
        open_h, open_ctx, open_doc, classes = h[-1], ctx[-1], smallest[-1], int(total[group[-1]])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words left over: doc, text, lo, hi in; doc, n_words, n_removed, kept out."""
    for batch in batches:
        los, his = batch.column(2), batch.column(3)
        for a, b, words in word_slices(batch.column(1)):
            counts = words.counts
            removed = np.zeros(b - a, np.int64)
            kept: list[bytes] = []
            for d in range(a, b):
                first, n = words.first[d - a], counts[d - a]
                stay = np.arange(first, first + n)
                if los[d].is_valid:
                    steps = np.zeros(n + 1, np.int64)
                    np.add.at(steps, los[d].values.to_numpy(), 1)
                    np.add.at(steps, his[d].values.to_numpy(), -1)
                    stay = first + np.flatnonzero(np.cumsum(steps[:-1]) == 0)
                    removed[d - a] = n - len(stay)
                kept.append(_joined(words, stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc", "n_words", "n_removed", "kept"],
            )


def _joined(words, which: np.ndarray) -> bytes:
    """The chosen words with one space between them."""
    if not len(which):
        return b""
    start, end = words.start[which], words.end[which]
    size = end - start + 1
    ends = np.cumsum(size)
    take = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
    out = words.data[np.minimum(take, len(words.data) - 1)]
    out[ends - 1] = 32
    return out[:-1].tobytes()


def _compared(rows: DataFrame) -> DataFrame:
    return rows.repartition("h").sortWithinPartitions("h", "ctx", "doc").mapInArrow(compare, SPANS)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc (its id), n_words, n_removed, kept (the words left)."""
    texts = docs.select(
        order_key(id_col).alias("doc"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("tag"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).alias("size"),
    )
    anchors = texts.select(*ROW, "text").mapInArrow(anchor_rows, ROWS)
    found = written(_compared(anchors), "anchors")
    ranges = (
        found.where("kind = 1").groupBy(*ROW).agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    )
    # Repeated rows have one set of windows; one of them is enough.
    once = texts.join(ranges, ROW).dropDuplicates(ROW).select(*ROW, "text", "lo", "hi")
    extended = written(_compared(once.mapInArrow(window_rows, ROWS)).where("kind = 0"), "windows")
    covered = (
        found.where("kind = 0").unionByName(extended).select(*ROW, "lo", "hi").distinct()
        .groupBy(*ROW).agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    )
    out = texts.join(covered, ROW, "left").select("doc", "text", "lo", "hi")
    out = out.mapInArrow(cut, "doc long, n_words long, n_removed long, kept string")
    return out.withColumn("doc", F.nullif("doc", F.lit(NO_ID)))
