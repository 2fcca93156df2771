"""Exact dedup with a two-pass Bloom filter, in DataFrame functions only.

Pass one hashes every text to one slot in each of two halves of a bit table and keeps
the slots that were hit more than once; the table is a bitmap of fixed size.  Pass two
tests every row: a row with a slot that nobody else hit is unique and goes straight
through; only the others are exchanged, by the SHA-256 of their normalised text, and
compared.  The filter can only let too many rows into the exchange, never too few.

Texts are equal when identical after lower-casing A-Z alone; null counts as empty.  The
row with the largest id stays; a row without id loses to any with one.  Of repeated
rows with one id exactly one stays.  An empty table gives an empty table.  The filter
looks at ``lower(text)``, which maps equal texts to equal values as well and is cheaper.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.llm.store import written

# Slots in each half; both bitmaps together take 2 * FILTER_SLOTS / 8 bytes, at any input size.
FILTER_SLOTS = 1 << 26
PAGE_BITS = 1 << 15  # of one value of bitmap_construct_agg


def normalised(text_col: str) -> Column:
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _slots(text_col: str, slots: int) -> list[Column]:
    h = F.xxhash64(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    return [h.bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(slots - 1)) + F.lit(slots)]


def _page(slot: Column) -> Column:
    return F.shiftright(slot, 15).cast("int")


def repeated_slots(docs: DataFrame, text_col: str, slots: int = FILTER_SLOTS) -> DataFrame:
    """(page, bits): the slots that more than one row hits; at most 2 * slots / PAGE_BITS rows of 4 KiB."""
    hit = docs.select(F.explode(F.array(*_slots(text_col, slots))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    return (
        hit.where("n > 1")
        .groupBy(_page(F.col("slot")).alias("page"))
        .agg(F.bitmap_construct_agg((F.col("slot") % PAGE_BITS)).alias("bits"))
    )


def _is_set(bits: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(slot % PAGE_BITS, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (slot % 8).cast("int")) == 1, F.lit(False))


def maybe_repeated(docs: DataFrame, text_col: str, flag: str, pages: DataFrame, slots: int = FILTER_SLOTS) -> DataFrame:
    """``docs`` with a boolean column: false means that no other row has this text."""
    for half, slot in enumerate(_slots(text_col, slots)):
        side = F.broadcast(pages.select(F.col("page").alias(f"{flag}_page{half}"), F.col("bits").alias(f"{flag}_bits{half}")))
        docs = docs.withColumn(f"{flag}_slot{half}", slot)
        docs = docs.join(side, _page(F.col(f"{flag}_slot{half}")) == side[f"{flag}_page{half}"], "left")
    both = _is_set(F.col(f"{flag}_bits0"), F.col(f"{flag}_slot0")) & _is_set(F.col(f"{flag}_bits1"), F.col(f"{flag}_slot1"))
    return docs.withColumn(flag, both).drop(*(f"{flag}_{x}{half}" for half in (0, 1) for x in ("page", "bits", "slot")))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = FILTER_SLOTS) -> DataFrame:
    """One row per row of ``docs``: doc (its id), keep_id, group_size, kept, digest (SHA-256, binary)."""
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    pages = written(repeated_slots(texts, "text", slots), "bloom")
    flagged = maybe_repeated(texts, "text", "maybe", pages, slots)
    marks = written(flagged.select("doc", F.unhex(F.sha2(normalised("text"), 256)).alias("digest"), "maybe"), "digests")
    alone = marks.where("not maybe").select(
        "doc", F.col("doc").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    found = marks.where("maybe").groupBy("digest", "doc").agg(F.count("*").alias("n"))
    # Written, so that both sides of the join are plain exchanges and a text that many rows hold is split.
    groups = written(found.groupBy("digest").agg(F.max("doc").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    # Repeated rows were folded into n above; they come out again one by one, and the first may stay.
    shared = (
        found.join(groups, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select("doc", "keep_id", "group_size", (F.col("doc").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest")
    )
    return alone.unionByName(shared)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = FILTER_SLOTS) -> DataFrame:
    """``docs`` with one row of each text, columns unchanged."""
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)))
    doc, text = f"in_{names.index(id_col)}", f"in_{names.index(text_col)}"
    pages = written(repeated_slots(own, text, slots), "bloom")
    flagged = maybe_repeated(own, text, "maybe", pages, slots)
    alone = flagged.where("not maybe").drop("maybe")
    found = flagged.where("maybe").drop("maybe").withColumn("digest", F.sha2(normalised(text), 256))
    tops = found.groupBy("digest").agg(F.max(doc).alias("top"))
    stay = found.join(tops, (found["digest"] == tops["digest"]) & found[doc].eqNullSafe(tops["top"])).drop(tops["digest"])
    # Only rows with the largest id of their text are left: one of each group, more if rows are repeated.
    one = stay.withColumn("copy", F.row_number().over(Window.partitionBy("digest").orderBy(F.lit(1)))).where("copy = 1")
    kept = alone.unionByName(one.drop("digest", "top", "copy"))
    return kept.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(names)))
