"""Shards along a Hilbert curve through the metadata, in DataFrame functions only.

Size, language and source are quantised to 2**BITS levels each: size by its bit length,
the two names by their share of all rows, in code-point order.  The cell of a row is its
place on the Hilbert curve through that cube.  Rows are ordered by cell, and runs of equal
row counts are the shards (law ``rows``), so each shard covers a compact block of all three
dimensions and a reader can skip it by the minima and maxima of any of them.

No row count is taken in one task.  Rows are cut into pieces by ranges of the whole order,
one per PIECE_ROWS rows, so a piece may begin inside a cell, even inside a group of equal
texts; pieces are counted and their counts added up; a row's position is its piece's offset
plus its rank within the piece.  The order is the same at any size.

Inside a cell rows are ordered by the CRC-32 of the text, then id, so equal texts with
equal metadata stand side by side.  Nulls: a null text has no bytes, size 1; null names
are a level of their own, before all others; rows without id come first.  Repeated rows
get neighbouring slots.  An empty table gives an empty table.

``write_shards`` writes the rows themselves, a folder per shard sorted along the curve,
and beside them one row per shard with the minima and maxima of the three dimensions;
``read_shards`` opens only the shards whose ranges can hold what is asked for.  Columns
keep their names: the shard's own column gets underscores until its name is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesift.llm.store import join_small, written

BITS = 5
DIMS = 3
SHARDS = 8
PIECE_ROWS = 100_000


def curve_steps() -> list[tuple[int, int]]:
    """For state * 2**DIMS + octant: (next state, digit of the index).

    A state is an entry corner and a direction.  An octant, seen from the entry and with
    the direction turned to the first axis, is the Gray code of its digit; entry and
    direction of the sub-cube follow from the digit (Hamilton, "Compact Hilbert Indices", 2006)."""
    full = (1 << DIMS) - 1

    def turn(x: int, by: int) -> int:
        by %= DIMS
        return (x << by | x >> (DIMS - by)) & full

    def gray(x: int) -> int:
        return x ^ x >> 1

    digit_of = {gray(i): i for i in range(1 << DIMS)}
    entry = [0 if i == 0 else gray(2 * ((i - 1) // 2)) for i in range(1 << DIMS)]
    low_ones = [(~i & (i + 1)).bit_length() - 1 for i in range(1 << DIMS)]
    way = [0 if i == 0 else (low_ones[i - 1] if i % 2 == 0 else low_ones[i]) % DIMS for i in range(1 << DIMS)]
    steps = []
    for state in range((1 << DIMS) * DIMS):
        start, along = divmod(state, DIMS)
        for octant in range(1 << DIMS):
            digit = digit_of[turn(octant ^ start, -(along + 1))]
            to = start ^ turn(entry[digit], along + 1)
            steps.append((to * DIMS + (along + way[digit] + 1) % DIMS, digit))
    return steps


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """The curve index of DIMS integer columns of ``bits`` bits, highest bit first."""
    steps = curve_steps()
    to, digit = F.array(*(F.lit(s) for s, _ in steps)), F.array(*(F.lit(d) for _, d in steps))

    def step(acc: Column, bit: Column) -> Column:
        octant = sum((F.getbit(F.element_at(levels_array, k + 1), bit).cast("int") * (1 << k) for k in range(1, DIMS)), F.getbit(F.element_at(levels_array, 1), bit).cast("int"))
        at = acc["state"] * (1 << DIMS) + octant + 1
        return F.struct(F.element_at(to, at).alias("state"), (acc["index"] * (1 << DIMS) + F.element_at(digit, at)).alias("index"))

    levels_array = F.array(*(c.cast("long") for c in levels))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("index"))
    return F.aggregate(F.array(*(F.lit(b) for b in range(bits - 1, -1, -1))), start, step, lambda acc: acc["index"])


def name_levels(rows: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """(name, level): a name's share of rows before it, in 2**bits steps.  One row per name."""
    counts = rows.groupBy(name).agg(F.count("*").alias("n"))
    before = Window.orderBy(F.col(name).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    return counts.select(
        name, F.floor((F.sum("n").over(before) - F.col("n")) * (1 << bits) / F.sum("n").over(every)).cast("int").alias("level")
    )


def _with_level(rows: DataFrame, name: str, to: str) -> DataFrame:
    levels = written(name_levels(rows, name), "levels")
    side = levels.select(F.coalesce(name, F.lit("")).alias("k"), F.col(name).isNull().alias("k_null"), F.col("level").alias(to))
    rows = rows.withColumns({"k": F.coalesce(name, F.lit("")), "k_null": F.col(name).isNull()})
    return join_small(rows, side, ["k", "k_null"], levels.count()).drop("k", "k_null")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("lang", "source"), parts: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc, size, crc, cell, shard, slot."""
    return _placed(docs, id_col, text_col, names, parts, F.monotonically_increasing_id()).drop("row")


def _placed(docs: DataFrame, id_col: str, text_col: str, names: tuple[str, str], parts: int, row: Column) -> DataFrame:
    """The same with ``row``, which tells rows apart that are equal in all else."""
    rows = written(
        docs.select(
            F.col(id_col).alias("doc"), _size(text_col).alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"),
            F.col(names[0]).cast("string").alias("one"), F.col(names[1]).cast("string").alias("two"), row.alias("row"),
        ), "meta",
    )
    levelled = _with_level(_with_level(rows, "one", "level_one"), "two", "level_two")
    by_size = F.least(F.length(F.bin("size")) - 1, F.lit((1 << BITS) - 1))
    celled = levelled.select(
        "doc", "size", "crc", hilbert_index([by_size, F.col("level_one"), F.col("level_two")]).alias("cell"), "row",
    )
    celled = written(celled, "cells")
    order = ["cell", "crc", F.col("doc").asc_nulls_first(), "size", "row"]
    pieces = max(1, -(-celled.count() // PIECE_ROWS))
    pieced = written(celled.repartitionByRange(pieces, *order).withColumn("piece", F.spark_partition_id()), "pieces")
    counts = pieced.groupBy("piece").agg(F.count("*").alias("n"))
    upto = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = written(counts.select("piece", (F.sum("n").over(upto) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy()).alias("total")), "offsets")
    placed = pieced.withColumn("rank", F.row_number().over(Window.partitionBy("piece").orderBy(*order)) - 1)
    placed = join_small(placed, offsets, ["piece"], offsets.count())
    at = F.col("offset") + F.col("rank")
    shard = F.expr(f"cast((offset + rank) * {parts} div total as int)")
    first = F.expr(f"(shard * total + {parts - 1}) div {parts}")
    return placed.withColumn("shard", shard).select("doc", "size", "crc", "cell", "shard", (at - first).alias("slot"), "row")


def _size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1


def write_shards(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("lang", "source"), parts: int = SHARDS
) -> DataFrame:
    """Write ``path/rows``, a folder per shard, ``path/columns``, which holds no rows, and
    ``path/ranges``; returns the ranges.

    Rows are numbered in a table of their own first, so places are joined to them by a key
    that no two rows share.  A shard is written by several tasks, each a run of the curve."""
    columns = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(columns)), F.monotonically_increasing_id().alias("row"))
    numbered = written(own, "numbered")
    doc, text, *dims = (f"in_{columns.index(c)}" for c in (id_col, text_col, *names))
    place = written(_placed(numbered, doc, text, tuple(dims), parts, F.col("row")).select("row", "size", "shard", "slot"), "places")
    pieces = max(parts, -(-place.count() // PIECE_ROWS))
    runs = numbered.join(place, "row").repartitionByRange(pieces, "shard", "slot").sortWithinPartitions("shard", "slot")
    shard = "shard"
    while shard.lower() in {c.lower() for c in columns}:
        shard += "_"
    kept = runs.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)), F.col("shard").alias(shard))
    kept.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    kept.write.mode("overwrite").partitionBy(shard).parquet(f"{path}/rows")
    held = [f(F.col(c).cast("string")).alias(f"{to}_{end}") for c, to in zip(dims, ("one", "two"), strict=True) for f, end in ((F.min, "low"), (F.max, "high"))]
    held += [F.count_if(F.col(c).isNull()).alias(f"{to}_nulls") for c, to in zip(dims, ("one", "two"), strict=True)]
    ranges = numbered.select("row", *dims).join(place, "row").groupBy("shard").agg(
        F.count("*").alias("rows"), F.min("size").alias("size_low"), F.max("size").alias("size_high"), *held
    )
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
    return docs.sparkSession.read.schema(ranges.schema).parquet(f"{path}/ranges")


def shards_for(ranges: DataFrame, sizes: tuple[int, int] | None = None, one: str | None = None, two: str | None = None) -> list[int]:
    """Numbers of the shards whose ranges allow such rows; there is one row per shard."""
    may = F.lit(True)
    if sizes:
        may &= (F.col("size_low") <= sizes[1]) & (F.col("size_high") >= sizes[0])
    for wanted, to in ((one, "one"), (two, "two")):
        if wanted is not None:
            may &= F.coalesce(F.lit(wanted).between(F.col(f"{to}_low"), F.col(f"{to}_high")), F.lit(False))
    return sorted(r.shard for r in ranges.where(may).select("shard").collect())


def read_shards(
    spark: SparkSession, path: str, text_col: str = "text", names: tuple[str, str] = ("lang", "source"),
    sizes: tuple[int, int] | None = None, one: str | None = None, two: str | None = None,
) -> DataFrame:
    """Rows of the given sizes (bytes plus 1, both ends included) and names; None asks for
    all.  Shards whose ranges allow no such row are not opened."""
    rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
    opened = shards_for(spark.read.parquet(f"{path}/ranges"), sizes, one, two)
    shard = rows.columns[-1]
    holds = F.col(f"`{shard}`").isin(opened)
    if sizes:
        holds &= _size(text_col).between(*sizes)
    for wanted, name in zip((one, two), names, strict=True):
        if wanted is not None:
            holds &= F.col(f"`{name}`").cast("string") == wanted
    return rows.where(holds).drop(shard)
