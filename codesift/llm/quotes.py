"""Chat formatting by quotation linking.

Each message is cut into lines; the quote level of a line is its number of leading ``>``.
Neighbouring lines of one level form a passage, a blank line ends it.  A passage is hashed
after white space is collapsed and case is folded: as a whole, by sentence (so parts of it match even when
re-wrapped) and by line (so single lines do).  Hashes of quoted passages are joined to
the first message of the conversation that says the passage itself, if that is an earlier
one.  A message replies to the latest original of its outermost linked quotes.

Links point backwards, so they form trees.  Roots and depths come from doubling: each
round a message takes over the link of the message it points to, so the number of rounds
is the logarithm of the longest chain.  Ordering by (root, turn) puts replies after what
they answer and keeps each tree together; messages without quotes are their own roots, so
a plain conversation stays in the order of its turns.

Nothing is gathered per conversation: originals are a minimum per passage, the order is a
range sort, which splits a conversation of any length over tasks.

Marks are told from text that looks like one: in ``chat`` every ``<|`` of a message, with any
backslashes between its two characters, gets one backslash more (``unescape`` takes it away
again), and characters of a role other than letters, digits, ``_``, ``-``, ``.`` and blanks
become ``_``.  ``content`` and ``role`` stay as they are.

Defined cases: a null text is empty, a null role is ``unknown``; ids of conversations may be
of any type, and keep it; messages without conversation or turn, or with a turn that is no
whole number, are formatted but not linked; rows repeated for one turn share its links; an
empty table gives an empty table.  Texts of any length are read whole, in slices of half a
megabyte or one text, so memory follows the longest text.  Quoted lines and the attribution
line above them are left out of the formatted text whether or not an original is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.store import written
from codesift.llm.words import slices

MARK = regex.compile(r"[ \t]{0,3}(?:>[ \t]?)+")
#: Fixed words of the lines that mail programs put above a quote.
ATTRIBUTION = regex.compile(r"\s*(?:On|Am|Le|El)\b.*\b(?:wrote|schrieb|écrit|escribió)\b.*:\s*")
PART = "struct<level:int, passage:binary>"


def lines_of(text: str) -> list[tuple[int, str]]:
    """(quote level, line without marks) of every line."""
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        mark = MARK.match(line)
        out.append((mark.group().count(">"), line[mark.end() :]) if mark else (0, line))
    return out


def own_text(lines: list[tuple[int, str]]) -> str:
    """The lines of level 0 without attributions; runs of blank lines become one."""
    kept: list[str] = []
    for i, (level, line) in enumerate(lines):
        ahead = next((n for n, rest in lines[i + 1 : i + 3] if n or rest.strip()), 0)
        if level or (ahead and ATTRIBUTION.fullmatch(line)):
            continue
        if line.strip() or (kept and kept[-1].strip()):
            kept.append(line.rstrip())
    return "\n".join(kept).strip()


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, bytes]]:
    """(level, hash) of every passage, and every sentence and line of one, without repeats."""
    found: dict[tuple[int, bytes], None] = {}

    def told(level: int, words: list[str]) -> None:
        if words:
            found[level, hashlib.md5(" ".join(words).encode()).digest()] = None

    block: list[str] = []
    at = 0
    for level, line in [*lines, (-1, "")]:
        words = line.casefold().split()
        if level != at or not words:
            told(at, block)
            ends = [i + 1 for i, word in enumerate(block) if word[-1] in ".!?"]
            for first, end in zip([0, *ends], [*ends, len(block)], strict=True):
                told(at, block[first:end])
            block, at = [], level
        if words:
            told(level, words)
            block += words
    return list(found)


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text in, beside the columns before it; own text and parts out."""
    for batch in (piece for whole in batches for piece in slices(whole)):
        own, parts = [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            lines = lines_of(text or "")
            own.append(own_text(lines))
            parts.append([{"level": level, "passage": h} for level, h in passages(lines)])
        kind = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.binary())]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(own, pa.string()), pa.array(parts, kind)], names=[*batch.schema.names[:-1], "own", "parts"]
        )


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    """What ``escaped`` was given."""
    return regex.sub(r"<\\(\\*)\|", r"<\1|", text)


def _doubled(links: DataFrame) -> DataFrame:
    """(conv, turn, up) links to (conv, turn, root, depth)."""
    now = written(links.select("conv", "turn", "up", F.lit(1).cast("long").alias("depth")), "up")
    while True:
        above = now.select("conv", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        step = now.join(above, ["conv", "up"], "left")
        step = written(
            step.select("conv", "turn", F.coalesce("higher", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "up"
        )
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now.withColumnRenamed("up", "root")


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message, in reply order: conv, root, turn, role, reply_to, depth, n_quotes
    (hashed pieces of quoted passages), n_linked, content (without quotes), chat (with its role)."""
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).try_cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.col(text_col).alias("text")
    )
    conv = rows.schema["conv"].dataType.simpleString()
    parsed = written(rows.mapInArrow(parse, f"conv {conv}, turn long, role string, own string, parts array<{PART}>"), "messages")
    parts = parsed.where("conv is not null and turn is not null").select("conv", "turn", F.explode("parts").alias("part")).select("conv", "turn", "part.level", "part.passage")
    originals = parts.where("level = 0").groupBy("conv", "passage").agg(F.min("turn").alias("said"))
    quotes = parts.where("level > 0").distinct()
    linked = quotes.join(originals, ["conv", "passage"]).where("said < turn")
    links = linked.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), F.col("said")))["said"].alias("up"), F.count("*").alias("n_linked"))
    links = written(links, "links")
    trees = _doubled(links)
    told = trees.join(links, ["conv", "turn"])
    zero = F.lit(0).cast("long")
    role = F.regexp_replace("role", r"[^\p{L}\p{N}_. -]", "_")
    out = parsed.join(told, ["conv", "turn"], "left").select(
        "conv", F.coalesce("root", "turn").alias("root"), "turn", "role", F.col("up").alias("reply_to"), F.coalesce("depth", zero).alias("depth"),
        F.size(F.filter("parts", lambda p: p["level"] > 0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
        F.col("own").alias("content"), F.concat(F.lit("<|"), role, F.lit("|>\n"), escaped(F.col("own")), F.lit("\n<|end|>\n")).alias("chat"),
    )
    return out.repartitionByRange("conv", "root", "turn").sortWithinPartitions("conv", "root", "turn")
