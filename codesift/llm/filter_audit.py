"""Filter interaction audit: what each filter of a chain removes, in every order.

Every document gets a mask with one bit per filter that it fails.  Documents are counted
per part and mask, so that whatever the size of the table, a part comes down to 32 counts.
From these the removals of all 32 coalitions (sets of filters applied together) are
tabulated.  A step of an order removes the difference of two coalitions: the filters so far
with and without its own.

Shapley values come from the kernel form of their definition: the additive function that is
nearest to the removals of all coalitions, in least squares weighted by the Shapley kernel,
among those that give the whole chain its exact removal.  The normal equations with that
one constraint depend on the number of filters alone; they are solved once in rationals,
for all right sides at once, and times n! the solution is in whole numbers.

The filter for copies looks at the whole table: a document fails if a smaller id has the
same text.  A text's documents share all other bits, so only the rows of its smallest id
are looked up, by text *and* id: the copies of a frequent text never meet in one task.

A null text is empty and has no words; a null part is the empty string.  A row without id
has no label, is no copy of anything and makes nothing a copy.  Rows that repeat an id and
its text count each, and do not make each other copies.  An empty table gives no rows.
Words of one text at a time are held in memory.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import cache, reduce
from itertools import permutations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.store import written

WORD_GAP = "[\\x20\\x09-\\x0D]+"


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The failure condition of each filter that looks at one document only."""
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


COPIES = "E"  # the letter of the filter that drops copies


@cache
def shapley_numerators(n: int) -> list[list[int]]:
    """Row i, column s: what the removals of coalition s (a bit set) count in n! times the
    Shapley value of filter i."""
    whole = (1 << n) - 1
    weight = {s: Fraction(n - 1, math.comb(n, k) * k * (n - k)) for s in range(1, whole) for k in [s.bit_count()]}
    # Unknowns: n values and the multiplier of the constraint.  Right side: one column per coalition.
    rows = []
    for i in range(n):
        left = [sum(w for s, w in weight.items() if s >> i & s >> j & 1) for j in range(n)]
        rows.append([*left, Fraction(1), *(weight.get(s, Fraction(0)) * (s >> i & 1) for s in range(whole + 1))])
    rows.append([*[Fraction(1)] * n, Fraction(0), *(Fraction(s == whole) for s in range(whole + 1))])
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
    solved = [[x * math.factorial(n) for x in row[n + 1 :]] for row in rows[:n]]
    assert all(x.denominator == 1 for row in solved for x in row)
    return [[int(x) for x in row] for row in solved]


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, bit i for letter i."""
    text = docs.select(
        F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("words", F.filter(F.split("text", WORD_GAP), lambda w: w != ""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(F.col("text"), F.col("words")).values())]
    rows = text.select("doc", "part", F.unhex(F.sha2("text", 256)).alias("digest"), reduce(add, bits).alias("mask"))
    told = written(
        labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("quality").alias("q"), F.col("toxic").alias("t")).where("doc is not null")
        .groupBy("doc").agg(F.max((F.col("q") == 1).cast("int")).alias("q"), F.max((F.col("t") == 1).cast("int")).alias("t")),
        "labels",
    )
    marks = written(rows.groupBy("doc", "digest", "part", "mask").agg(F.count("*").alias("n")), "marks")
    named = marks.where("doc is not null")
    shown = ["part", "mask", "n", (F.col("n") * F.coalesce("q", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("t", F.lit(0))).alias("toxic")]
    labelled = written(named.join(told, "doc", "left").select("doc", "digest", *shown), "labelled")
    nameless = marks.where("doc is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))

    firsts = labelled.groupBy("digest").agg(F.min("doc").alias("doc"))
    first = labelled.join(firsts, ["digest", "doc"], "left_semi").select("part", "mask", "n", "good", "toxic")
    copy_bit = 1 << len(bits)
    numbers = ("n", "good", "toxic")
    # Copies are all rows with an id less the first ones.
    taken = first.select("part", (F.col("mask") + copy_bit).alias("mask"), *((-F.col(c)).alias(c) for c in numbers))
    every = labelled.select("part", (F.col("mask") + copy_bit).alias("mask"), *numbers)
    both = first.unionByName(nameless).unionByName(every).unionByName(taken)
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in numbers)).where("n != 0")


def coalitions(counts: DataFrame, n: int) -> DataFrame:
    """(part, total, cut): cut[s] has the documents that coalition s removes: all, good, toxic ones."""
    hit = F.col("mask").bitwiseAND(F.col("s")) != 0
    spread = counts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    sums = spread.groupBy("part", "s").agg(
        F.sum("n").alias("total"), *(F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic"))
    )
    # One row per coalition: the lists have 2**n entries.
    return sums.groupBy("part").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("cut"))


def steps(letters: str) -> list[tuple[str, int, int, int, int]]:
    """(order, step, number of its filter, filters before, filters after) for all orders."""
    out = []
    for order in permutations(range(len(letters))):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(letters[i] for i in order), k + 1, f, before, before | 1 << f))
            before |= 1 << f
    return out


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley (summed over all orders)."""
    letters = "".join(failures(F.lit(""), F.array(F.lit("")))) + COPIES
    n, whole = len(letters), (1 << len(letters)) - 1
    table = coalitions(mask_counts(docs, labels, id_col, text_col, part_col), n)

    def cut(s: Column | int, what: str = "n") -> Column:
        return F.get("cut", F.lit(s) if isinstance(s, int) else s)[what]

    def value(numerators: list[int]) -> Column:
        return reduce(add, (c * cut(s) for s, c in enumerate(numerators) if c))

    per_filter = F.array(*(
        F.struct(cut(1 << i).alias("fails"), (cut(whole) - cut(whole ^ 1 << i)).alias("alone"), value(numerators).alias("shapley"))
        for i, numerators in enumerate(shapley_numerators(n))
    ))
    listed = steps(letters)
    at = {name: F.get(F.lit([s[i] for s in listed]), F.col("k")).alias(name) for i, name in enumerate(("filter_order", "step", "f", "before", "after"))}
    rows = table.select("part", "total", "cut", per_filter.alias("own")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(listed) - 1))))
    rows = rows.select("part", "total", "cut", "own", *at.values()).withColumn("its", F.get("own", F.col("f")))

    def lost(what: str) -> Column:
        return cut(F.col("after"), what) - cut(F.col("before"), what)

    return rows.select(
        "part", "filter_order", "step", (F.col("total") - cut(F.col("after"))).alias("kept"), lost("n").alias("removed"),
        (F.col("its.fails") - lost("n")).alias("redundant"), F.col("its.alone").alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("its.shapley").alias("shapley"),
    )
