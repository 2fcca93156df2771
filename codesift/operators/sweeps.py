"""Ordered passes over the rows of each file.

Questions about nesting (which binding does this place see, where does this expression end,
which spans hold this token) are answered by one pass in token order with a stack, instead
of a row per place and nesting level.  Spark unions and sorts the few kinds of rows a pass
looks at and hands each file's rows to one task in order; the pass holds what is open at
the moment, never the file.  Its work and its output grow with its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.session import buckets

Feed = Callable[[tuple, list], None]  # one row in, found tuples appended


def fold(rows: DataFrame, order: list[Column], out: dict[str, str], make: Callable[[], Feed]) -> DataFrame:
    """Feeds each file's rows in order to a fresh ``make()``, which appends tuples.

    ``out`` names the columns that come out and the input columns whose types they have;
    ``file_id`` is the first column of ``rows`` and is added to every tuple.
    """
    placed = rows.repartition(buckets(rows.sparkSession), "file_id").sortWithinPartitions("file_id", *order)
    types = {"file_id": "file_id", **out}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, feed = None, None
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if feed is None or row[0] != now:
                    now, feed = row[0], make()
                said = len(found)
                feed(row, found)
                for i in range(said, len(found)):
                    found[i] = (now, *found[i])
            columns = zip(*found, strict=True) if found else ([] for _ in types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), batch.schema.field(t).type) for c, t in zip(columns, types.values(), strict=True)], names=list(types)
            )

    schema = ", ".join(f"{name} {rows.schema[t].dataType.simpleString()}" for name, t in types.items())
    return placed.mapInArrow(run, schema)


def _level(name: str) -> Column:
    return F.greatest(F.col(name), F.lit(0)).cast("int")


def visible(points: DataFrame, bindings: DataFrame, openers: DataFrame, level: str, in_function: bool = False) -> DataFrame:
    """Latest visible binding of each point.

    points(file_id, idx, <level>, point_id, name); openers(file_id, idx, <level>[, is_fn]): a
    scope one level deeper begins; bindings(file_id, at, scope_level, pos, name, is_barrier)
    take effect at ``at`` in the scope then open at that level, until it ends.  With
    ``in_function`` a point sees no binding from outside its innermost function.
    Returns (file_id, point_id, name, pos, is_barrier); points without a binding are absent.
    """
    is_fn = F.col("is_fn") if in_function else F.lit(False)
    opened = openers.select("file_id", F.col("idx").alias("at"), F.lit(0).alias("turn"), _level(level).alias("level"), is_fn.alias("is_fn"))
    asked = points.select("file_id", F.col("idx").alias("at"), F.lit(1).alias("turn"), _level(level).alias("level"), "name", "point_id")
    # A binding at the very position of a point is not before it.
    bound = bindings.select("file_id", "at", F.lit(2).alias("turn"), _level("scope_level").alias("level"), "name", "pos", "is_barrier")
    rows = opened.unionByName(asked, allowMissingColumns=True).unionByName(bound, allowMissingColumns=True)
    rows = rows.select("file_id", F.col("at").cast("int").alias("at"), "turn", "level", "is_fn", "name", "point_id", "pos", "is_barrier")

    def make() -> Feed:
        held: dict[str, list[tuple]] = {}  # name: (position, barrier, level), innermost last
        scopes: list[list[str]] = [[]]  # names bound in each open scope
        functions: list[int] = []

        def feed(row: tuple, out: list) -> None:
            _, _, turn, depth, opens_function, name, point, pos, barrier = row
            while len(scopes) > depth + 1:
                for gone in scopes.pop():
                    held[gone].pop()
            while functions and functions[-1] > depth:
                functions.pop()
            if turn == 1:
                seen = held.get(name)
                if seen and (not in_function or (functions and seen[-1][2] >= functions[-1])):
                    out.append((point, name, seen[-1][0], seen[-1][1]))
                return
            while len(scopes) <= depth:
                scopes.append([])
            if turn == 0:
                scopes.append([])
                if opens_function:
                    functions.append(depth + 1)
                return
            stack = held.setdefault(name, [])
            if stack and stack[-1][2] == depth:
                stack[-1] = (pos, barrier, depth)
            else:
                stack.append((pos, barrier, depth))
                scopes[depth].append(name)

        return feed

    return fold(rows, [F.col("at"), F.col("turn"), F.col("pos")], {"point_id": "point_id", "name": "name", "pos": "pos", "is_barrier": "is_barrier"}, make)


def next_marks(starts: DataFrame, marks: DataFrame, closers: DataFrame) -> DataFrame:
    """The first mark after each start in the start's own group; if that closes first, in
    the group around it, and so on: (file_id, idx, next_idx).

    starts(file_id, idx, lv), marks(file_id, idx, lv), closers(file_id, idx, lv, inner): a
    group one level deeper ends there; ``inner`` closers are the last mark of that group.
    """
    kinds = [
        starts.select("file_id", "idx", F.lit(0).alias("turn"), _level("lv").alias("lv"), F.lit(False).alias("inner")),
        marks.select("file_id", "idx", F.lit(1).alias("turn"), _level("lv").alias("lv"), F.lit(False).alias("inner")),
        closers.select("file_id", "idx", F.lit(2).alias("turn"), _level("lv").alias("lv"), "inner"),
    ]
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])

    def make() -> Feed:
        ahead: list[int | None] = [None]  # next mark of each open group, from the right

        def feed(row: tuple, out: list) -> None:
            _, idx, turn, depth, inner = row
            del ahead[depth + 1 :]
            while len(ahead) <= depth:
                ahead.append(ahead[-1])
            if turn == 0:
                if ahead[depth] is not None:
                    out.append((idx, ahead[depth]))
            elif turn == 1:
                ahead[depth] = idx
            else:
                ahead.append(idx if inner else ahead[depth])

        return feed

    return fold(rows, [F.col("idx").desc(), F.col("turn")], {"idx": "idx", "next_idx": "idx"}, make)


def marks_in_spans(spans: DataFrame, marks: DataFrame, key: str, span_columns: list[str], mark_columns: list[str]) -> DataFrame:
    """The first mark of each key in each span: (file_id, span columns, mark columns).

    spans(file_id, start_idx, end_idx, ...), marks(file_id, idx, <key>, ...[, as_first,
    as_inner]): whether the mark counts at the start of a span, and behind it.  A span that
    has met a key is not looked at again for it, so work grows with what comes out.
    """
    told = {"as_first", "as_inner"} <= set(marks.columns)
    flags = [F.col(c) if told else F.lit(True).alias(c) for c in ("as_first", "as_inner")]
    opened = spans.where(F.col("start_idx") <= F.col("end_idx")).select(
        "file_id", F.col("start_idx").cast("int").alias("at"), F.lit(0).alias("turn"), F.col("end_idx").cast("int").alias("end"), *[F.col(c).alias(f"s_{c}") for c in span_columns]
    )
    said = marks.select(
        "file_id", F.col("idx").cast("int").alias("at"), F.lit(1).alias("turn"), F.col(key).alias("key"), *flags, *[F.col(c).alias(f"m_{c}") for c in mark_columns]
    )
    names = [f"s_{c}" for c in span_columns] + [f"m_{c}" for c in mark_columns]
    rows = opened.unionByName(said, allowMissingColumns=True).select("file_id", "at", "turn", "end", "key", "as_first", "as_inner", *names)
    n = len(span_columns)

    def make() -> Feed:
        active: list[tuple] = []  # (start, end, columns), by start
        met: dict = {}  # key: spans that start here or before have it

        def feed(row: tuple, out: list) -> None:
            _, at, turn, end, key_, as_first, as_inner = row[:7]
            while active and active[-1][1] < at:
                active.pop()
            if turn == 0:
                active.append((at, end, row[7 : 7 + n]))
                return
            seen, over = met.get(key_, -1), False
            for i in range(len(active) - 1, -1, -1):
                start, last, columns = active[i]
                if start <= seen:
                    break
                if last < at:
                    over = True
                elif as_first if start == at else as_inner:
                    out.append((*columns, *row[7 + n :]))
                elif start < at:
                    break  # counts at the start of a span only
            if as_inner:
                met[key_] = at if as_first else max(at - 1, seen)
            if over:
                active[:] = [x for x in active if x[1] >= at]

        return feed

    out = {c: f"s_{c}" for c in span_columns} | {c: f"m_{c}" for c in mark_columns}
    return fold(rows, [F.col("at"), F.col("turn"), F.col("end").desc()], out, make)


def param_lists(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """The round bracket a name stands in, through any square ones: (file_id, idx, grp).

    tokens(file_id, idx, text) hold at least the brackets, braces and semicolons; a name
    behind a brace or semicolon of its own bracket has none.
    """
    rows = tokens.select("file_id", "idx", F.lit(0).alias("turn"), "text").unionByName(
        asked.select("file_id", "idx", F.lit(1).alias("turn"), F.lit("").alias("text"))
    )

    def make() -> Feed:
        opened: list[list] = []  # [position, nothing in the way]

        def feed(row: tuple, out: list) -> None:
            _, idx, turn, text = row
            if turn:
                if opened and opened[-1][1]:
                    out.append((idx, opened[-1][0]))
            elif text == "(":
                opened.append([idx, True])
            elif text == ")":
                if opened:
                    opened.pop()
            elif opened:
                opened[-1][1] = False

        return feed

    return fold(rows, [F.col("idx"), F.col("turn")], {"idx": "idx", "grp": "idx"}, make)
