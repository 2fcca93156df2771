"""Mixing sources to target weights.

Words are added up per source; sources by code point, null last, weigh WEIGHTS in turn.
Targets share all words by weight, but stop at MOST_REPEATS times what a source has; the
excess goes to the others by weight.  With sources ordered by size per weight this has a
closed form: everything before some place in that order is capped, the rest shares what
is left.  A document is emitted floor(rate) times, where rate = target / source size,
and once more if a number in [0, 1) that depends on the seed and its id alone is below
the fraction.  So reruns agree, and a lost task makes the same copies again.

Defined cases: a null text has size 0; a source without words has target 0 and gives no
document; a row without id is drawn by its text; repeated rows are drawn alike; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.llm.store import join_small, written

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: str, text_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate).  One row per source:
    the windows below order sources, not documents."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(in_order) - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(in_order)).withColumn("weight", weigh.cast("long"))
    cap = F.col("source_size") * MOST_REPEATS
    by_room = Window.orderBy(cap.cast("double") / F.col("weight").cast("double"), "place")
    every = Window.partitionBy()
    upto = by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = (F.sum("source_size").over(every) - (F.sum(cap).over(upto) - cap)).cast("double")
    share = left / (F.sum("weight").over(every) - (F.sum("weight").over(upto) - F.col("weight"))).cast("double")
    placed = ranked.withColumn("share", share).withColumn("room", F.row_number().over(by_room))
    free = cap.cast("double") > F.col("share") * F.col("weight").cast("double")
    level = F.min(F.when(free, F.struct("room", "share"))).over(every)["share"]
    target = F.coalesce(F.least(cap.cast("double"), level * F.col("weight").cast("double")), cap.cast("double"))
    return placed.withColumn("target", target).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0).alias("rate"),
    )


def mix_plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str = SEED) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(word_count(text_col)).alias("source_size"))
    plan = written(targets(sizes), "targets")
    plan = plan.select(
        F.coalesce("source", F.lit("")).alias("mix_name"), F.col("source").isNull().alias("mix_null"),
        F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate"),
    )
    docs = docs.withColumns({
        "mix_name": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "mix_null": F.col(source_col).isNull(),
        "mix_size": word_count(text_col), "mix_draw": draw(id_col, text_col, seed),
    })
    out = join_small(docs, plan, ["mix_name", "mix_null"], plan.count())
    whole = F.floor("mix_rate")
    more = (F.col("mix_draw") < F.col("mix_rate") - whole).cast("long")
    return out.withColumn("mix_copies", whole + more).drop("mix_name", "mix_null", "mix_draw", "mix_rate")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged."""
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)))
    at = {c: f"in_{names.index(c)}" for c in (id_col, text_col, source_col)}
    plan = mix_plan(own, at[id_col], at[text_col], at[source_col], seed).where("mix_copies > 0")
    out = plan.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return out.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(names)))
