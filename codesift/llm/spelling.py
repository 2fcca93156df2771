"""Spelling variants: words that are one edit apart, grouped under the most frequent form.

Words are counted first, so from here on the work grows with the vocabulary.  Near words are
found by asymmetric q-chunks.  The shorter word of a pair (of equal lengths the smaller one)
is cut into two disjoint chunks; the other contributes its positional grams.  One edit hits
one chunk and leaves the other: the first where it was, the second moved by the difference
of the lengths, so within a shift of one.  The chunk that is hit consists of two halves, of
which the edit leaves one, too.  A join key is therefore a chunk and a half of the other
chunk; only grams that can stand for these are made: four keys for each length that the
partner may have.  The join itself verifies pairs by their edit distance and gives out
none but true ones; keys are as selective as three quarters of a word, and adaptive
execution splits those that many words share.  No side of a join goes through the driver.

A word's form is its most frequent near word, if that is at least twice as frequent.  Forms
grow by a factor of two with each step, so there are no rings and chains are short; roots
are found by doubling the steps.

Runs are cut from whole texts; A-Z is lower-cased, other letters are not.  A null text has
no runs.  The hash that decides on dropped letters takes a null id as an empty string.
Repeated rows count again.  Ties go to the smaller word in code-point order.  A table
without words gives an empty table.  Other columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.store import merged, written

LEAST_LENGTH = 5
LEAST_COUNT = 3
DROP_EVERY = 97
RUN = "[A-Za-z\\u00C0-\\u00FF]+"


def lower_ascii(word: Column) -> Column:
    return F.when(F.rlike(word, F.lit("[A-Z]")), F.translate(word, string.ascii_uppercase, string.ascii_lowercase)).otherwise(word)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(own.alias("doc"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("doc", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))
    kept = words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return kept.where(F.col("n") >= LEAST_COUNT)


def _parts(length: Column) -> list[tuple[Column, Column]]:
    """(start, length) of the four halves that a word of this length is cut into; the first
    two and the last two are its chunks."""
    chunk = ((length + 1) / 2).cast("int")
    first, third = ((chunk + 1) / 2).cast("int"), ((length - chunk + 1) / 2).cast("int")
    return [(F.lit(0), first), (first, chunk - first), (chunk, third), (chunk + third, length - chunk - third)]


def _keys(word: Column, length: Column, shift: Column) -> Column:
    """Four keys of a word that stands for a partner of ``length``; what follows the edit
    has moved by ``shift``."""

    def gram(start: Column, size: Column, moved: bool) -> Column:
        return F.substring(word, start + (shift if moved else 0) + 1, size)

    (a, an), (b, bn), (c, cn), (d, dn) = _parts(length)
    front, back = gram(a, an + bn, False), gram(c, cn + dn, True)
    pairs = [(front, gram(c, cn, False)), (front, gram(d, dn, True)), (back, gram(a, an, False)), (back, gram(b, bn, True))]
    return F.array(*(F.xxhash64(length, F.lit(i), x, y) for i, (x, y) in enumerate(pairs)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), once for each pair of words exactly one edit apart; a is the shorter or smaller one."""
    size = F.char_length("word")
    chunks = words.select(F.col("word").alias("a"), F.explode(_keys(F.col("word"), size, F.lit(0))).alias("key"))
    same, less = _keys(F.col("word"), size, F.lit(0)), _keys(F.col("word"), size - 1, F.lit(1))
    grams = words.select(F.col("word").alias("b"), F.explode(F.array_union(same, less)).alias("key"))
    longer = F.char_length("b") > F.char_length("a")
    one_edit = F.levenshtein("a", "b", 1) == 1
    met = chunks.join(merged(grams), (chunks["key"] == grams["key"]) & (longer | (F.col("a") < F.col("b"))) & one_edit)
    return met.select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): where following the forms ends."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(merged(ahead), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "forms")
        now = moved.select("word", "root")
        if not moved.where("on").limit(1).count():
            return now


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word."""
    words = written(word_counts(docs, id_col, text_col), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    # The most frequent one, then the smallest: the least of (-n, word).
    best = both.join(merged(counts), "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), "b")).alias("best"))
    held = words.join(merged(best.withColumnRenamed("a", "word")), "word", "left")
    twice = -F.col("best.minus") >= 2 * F.col("n")
    held = written(held.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(twice, F.col("best.b")).alias("form"),
        F.when(twice, -F.col("best.minus")).alias("form_n"),
    ), "held")
    ends = roots(held.where("form is not null"))
    return held.join(merged(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
