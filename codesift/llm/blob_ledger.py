"""Secret scans over an incremental ledger of blobs.

A text is a blob, named by the SHA-256 of its bytes; rows of the input are paths, or
versions of a path, that hold it.  The ledger is an append-only table in the shared folder
with a row for each blob and rule version that was ever scanned, findings or not.  A run

1. hashes every text where it lies; only ids and hashes are exchanged,
2. takes from the blobs and rules those pairs that the ledger does not have, and for each
   blob the row with the smallest id to read it from,
3. scans these rows in place: a bitmap of fixed size, sent to all executors, tells a row
   that it was chosen, so no text is ever exchanged,
4. adds the pairs to the ledger, and joins findings back to every row with the blob.

A second run over the same texts scans nothing; a rule with a new version is scanned alone;
new rows cost a hash and, if the text is new, one scan.  The bitmap may choose a row too
many, never one too few: such a blob is scanned twice and entered once.  It fills up beyond
some 10^8 new blobs a run; then more copies are scanned, and results stay the same.

Positions are code points of the whole text; matches of a rule are leftmost and do not
overlap, and those whose value is too short are dropped afterwards.  A null text is empty.
Rows without id are rows like others, repeated rows repeat their findings, and an empty
table gives an empty table.  A worker holds one slice of texts, at least one whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.bpe import texts_of
from codesift.llm.store import written


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int  # whose length counts
    least: int


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
RULES = (
    Rule("assign", 1, rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32),
)
LEDGER = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"

SLOTS = 1 << 26  # in each half of the bitmap; both take 2 * SLOTS / 8 bytes
PAGE = 1 << 15  # bits of one value of bitmap_construct_agg


def _slots(key: Column) -> list[Column]:
    return [key.bitwiseAND(F.lit(SLOTS - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(SLOTS - 1)) + F.lit(SLOTS)]


def bitmap(chosen: DataFrame, *key: str) -> DataFrame:
    """(page, bits) of the chosen rows: at most 2 * SLOTS / PAGE rows of 4 KiB."""
    slot = F.col("slot")
    return chosen.select(F.explode(F.array(*_slots(F.xxhash64(*key)))).alias("slot")).groupBy((slot / PAGE).cast("int").alias("page")).agg(
        F.bitmap_construct_agg(slot % PAGE).alias("bits")
    )


def where_set(rows: DataFrame, pages: DataFrame, *key: str) -> DataFrame:
    """The rows whose key is in the bitmap, and a few others."""
    out = rows.withColumn("row_key", F.xxhash64(*key))
    for half, slot in enumerate(_slots(F.col("row_key"))):
        side = F.broadcast(pages.select(F.col("page").alias(f"page{half}"), F.col("bits").alias(f"bits{half}")))
        out = out.withColumn("slot", slot).join(side, (F.col("slot") / PAGE).cast("int") == F.col(f"page{half}"))
        byte = F.conv(F.hex(F.substring(f"bits{half}", F.shiftright(F.col("slot") % PAGE, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out = out.where(F.getbit(byte, (F.col("slot") % 8).cast("int")) == 1)
    return out.select(*rows.columns)


def spans_of(rule: Rule, text: str) -> list[tuple[int, int]]:
    found = re.finditer(rule.pattern, text)
    return [m.span() for m in found if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scanned(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, text) → a ledger row for each rule."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    faster = [r if r.name != "hex" else Rule(r.name, r.version, f"[0-9a-f]{{{r.least},}}", r.group, r.least) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in texts_of(batch, 1):
                names = batch.column(0).slice(at, len(texts))
                for rule in faster:
                    found = [[{"start": a, "end": b} for a, b in spans_of(rule, t)] for t in texts]
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.array([rule.name] * len(texts)), pa.array([rule.version] * len(texts), pa.int32()), pa.array(found, spans)],
                        names=["blob", "rule", "version", "spans"],
                    )

    return blobs.mapInArrow(run, LEDGER)


def open_ledger(docs: DataFrame, path: str) -> DataFrame:
    """The ledger at ``path``; a new one is empty."""
    spark = docs.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def unseen(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, doc, wanted): the blobs that some rules have not scanned, and a row to read each from."""
    blobs = history.groupBy("blob").agg(F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc")).alias("at")).select("blob", "at.doc")
    listed = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    pairs = blobs.select("blob", "doc", F.inline(listed))
    left = pairs.join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
    return left.groupBy("blob", "doc").agg(F.array_sort(F.collect_set("rule")).alias("wanted"))


def scan(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc (its id), blob, spans (array of start, end, kind; by
    start, then in the order of the rules).  The ledger gets what was scanned."""
    ledger = open_ledger(docs, ledger_path)
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = texts.select("doc", F.unhex(F.sha2("text", 256)).alias("blob"), "text")
    history = written(named.select("doc", "blob"), "history")
    todo = written(unseen(history, ledger, rules), "unseen")
    # A new blob lacks all rules, a known one those that changed: a few sets, a pass for each.
    for row in todo.select("wanted").distinct().collect():
        wanted = [r for r in rules if r.name in row["wanted"]]
        same = todo.where(F.col("wanted") == F.lit(row["wanted"]))
        pages = written(bitmap(same, "blob", "doc"), "chosen")
        new = scanned(where_set(named, pages, "blob", "doc").select("blob", "text"), wanted)
        once = new.groupBy("blob", "rule", "version").agg(F.first("spans").alias("spans"))
        once.write.mode("append").parquet(ledger_path)

    order = {r.name: i for i, r in enumerate(rules)}
    current = reduce(or_, ((F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules))
    number = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    known = open_ledger(docs, ledger_path).where(current & (F.size("spans") > 0))
    shown = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), number[F.col("rule")].alias("no"), s["end"].alias("end"), F.col("rule").alias("kind")))
    # One list per rule: a blob's findings are as bounded as its text.
    found = written(known.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set(shown))).alias("spans")), "found")
    none = F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>")
    return history.join(found, "blob", "left").select("doc", "blob", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, separated by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
