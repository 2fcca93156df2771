"""Structure of code as tables: neighbours, nesting, delimiter pairs and argument spans.

Everything is a window over the tokens of one file.  A file is capped in size,
so a window partition is bounded, and all windows reuse the placement by
``file_id`` made when the text was exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.operators.tokens import by_file, up_to

OPENERS = ["(", "[", "{"]
CLOSERS = [")", "]", "}"]


def neighbours(tokens: DataFrame, back: int, ahead: int, kinds_ahead: int = 0, text: str = "text") -> DataFrame:
    """Adds p1..pn (texts before), n1..nm (texts after) and k0 kinds around; ``text`` is the
    column that neighbours show."""
    w = by_file()
    cols = {f"p{i}": F.coalesce(F.lag(text, i).over(w), F.lit("")) for i in range(1, back + 1)}
    cols |= {f"n{i}": F.coalesce(F.lead(text, i).over(w), F.lit("")) for i in range(1, ahead + 1)}
    cols |= {"pk1": F.coalesce(F.lag("kind", 1).over(w), F.lit("")), "pline": F.lag("line", 1).over(w)}
    cols |= {f"nk{i}": F.coalesce(F.lead("kind", i).over(w), F.lit("")) for i in range(1, kinds_ahead + 1)}
    return tokens.withColumns(cols)


def is_opener() -> Column:
    return F.col("text").isin(OPENERS) | (F.col("kind") == "tstart")


def is_closer() -> Column:
    return F.col("text").isin(CLOSERS) | (F.col("kind") == "tend")


def nested(tokens: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """Adds ``lv`` (level of the token in its parent), ``bl`` (brace level) and
    running counters ``c_<name>`` of the given flags, inclusive of the row."""
    step = F.when(is_opener(), 1).when(is_closer(), -1).otherwise(0)
    brace = F.when(F.col("text") == "{", 1).when(F.col("text") == "}", -1).otherwise(0)
    cols = {"lv": F.sum(step).over(up_to()), "bl": F.sum(brace).over(up_to())}
    cols |= {f"c_{name}": F.sum(F.when(flag, 1).otherwise(0)).over(up_to()) for name, flag in counters.items()}
    out = tokens.withColumns(cols)
    return out.withColumns({
        "lv": (F.col("lv") - F.when(is_opener(), 1).otherwise(0)).cast("int"),
        # A closing brace still belongs to the block it closes.
        "bl": (F.col("bl") + F.when(F.col("text") == "}", 1).when(F.col("text") == "{", -1).otherwise(0)).cast("int"),
    })


def keyed(tokens: DataFrame) -> DataFrame:
    """One row per token and level it takes part in, with the enclosing group.

    A delimiter appears twice: in its parent's level (role ``self``) and, as
    ``open`` or ``close``, in the level it delimits.  ``grp`` is the index of the
    innermost opener (-1 at the top).
    """
    inner = F.col("lv") + 1
    roles = F.when(is_opener(), F.array(
        F.struct(F.col("lv").alias("key"), F.lit("self").alias("role")), F.struct(inner.alias("key"), F.lit("open").alias("role"))
    )).when(is_closer(), F.array(
        F.struct(F.col("lv").alias("key"), F.lit("self").alias("role")), F.struct(inner.alias("key"), F.lit("close").alias("role"))
    )).otherwise(F.array(F.struct(F.col("lv").alias("key"), F.lit("self").alias("role"))))
    rows = tokens.select("*", F.inline(roles))
    w = Window.partitionBy("file_id", "key").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opener = F.last(F.when(F.col("role") == "open", F.struct("idx", "text")), ignorenulls=True).over(w)
    rows = rows.withColumn("opener", opener)
    # At level 0 there is no opener; a close without one is unbalanced text.
    return rows.withColumns({
        "grp": F.coalesce(F.when(F.col("key") > 0, F.col("opener.idx")), F.lit(-1)),
        "grp_text": F.when(F.col("key") > 0, F.col("opener.text")),
    }).drop("opener")


def selves(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("role") == "self").drop("role", "key")


def pairs(rows: DataFrame) -> DataFrame:
    """delims(file_id, open_idx, close_idx, kind, depth)."""
    return rows.where((F.col("role") == "close") & (F.col("grp") >= 0)).select(
        "file_id", F.col("grp").alias("open_idx"), F.col("idx").alias("close_idx"), F.col("grp_text").alias("kind"),
        (F.col("key") - 1).alias("depth"),
    )


def span(start_counts: str, end: str, counters: list[str], prefix: str) -> list[Column]:
    """Counts of each flag strictly between two separators, by difference.

    ``start_counts`` is a column prefix of the opening separator (inclusive
    counters), ``end`` the struct of the closing one; a separator carries none
    of the flags itself.
    """
    return [(F.col(f"{end}.c_{c}") - F.col(f"{start_counts}c_{c}")).alias(f"{prefix}{c}") for c in counters]


def args(seps: DataFrame, counters: list[str], extra: list[str] = []) -> DataFrame:
    """args(file_id, open_idx, arg_no, start_idx, end_idx, <counts>), empty ones dropped."""
    rows = seps.where((F.col("role") != "close") & F.col("nx.idx").isNotNull())
    return rows.select(
        "file_id", F.col("grp").alias("open_idx"), "arg_no", (F.col("idx") + 1).alias("start_idx"),
        (F.col("nx.idx") - 1).alias("end_idx"), *span("", "nx", counters, "x_"), *extra,
    ).where(F.col("start_idx") <= F.col("end_idx"))


def enclosing_at(points: DataFrame, openers: DataFrame, level: str, key: Column | None = None) -> DataFrame:
    """The group around each point at one level: its innermost one, or the one at level ``key``.

    points(file_id, idx, <level>, ...), openers(file_id, idx, <level>): an opener at level d
    opens level d+1.  Adds ``scope`` (opener index, -1 = file).  The last opener of the level
    before a point is the one that is open there, so this is one window over one row per
    point; points that are not that deep are left out.
    """
    names = [c for c in points.columns if c not in ("file_id", "idx")]
    asked = points.select("*", F.greatest(F.col(level), F.lit(0)).alias("own_level"), F.lit(1).alias("is_point"))
    asked = asked.withColumn("key", F.col("own_level") if key is None else key).where(F.col("key").between(0, F.col("own_level")))
    marks = openers.select("file_id", "idx", (F.col(level) + 1).alias("key"), F.lit(0).alias("is_point"))
    rows = asked.drop("own_level").unionByName(marks, allowMissingColumns=True)
    # A closing brace is a point of its own block, so openers sort first on ties only.
    w = Window.partitionBy("file_id", "key").orderBy("idx", "is_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.max(F.when(F.col("is_point") == 0, F.col("idx"))).over(w)
    out = rows.withColumn("scope", F.when(F.col("key") == 0, F.lit(-1)).otherwise(F.coalesce(at, F.lit(-1))))
    return out.where(F.col("is_point") == 1).select("file_id", "idx", *names, "scope")
