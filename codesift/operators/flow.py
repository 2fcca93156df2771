"""Data flow inside a file: reachability from sources, aliases, and marks ahead.

A *point* is a place that mentions a name; a *binding* is a place that sets it (see
``sweeps.visible``).  A visible binding always lies before the point it is seen from, so
the edges binding → binding of a file form a DAG in position order, and one pass over a
file's edges decides it.  What makes it more than plain reachability is that no name may
be met twice on a path.  That can only happen between names on a common cycle of the graph
*of names*, so only these are remembered, and only until a path leaves the cycle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_END = 2147483647

Binding = tuple[int, str]  # position, name


def name_cycles(edges: list[tuple[str, str]]) -> dict[str, int]:
    """For each name on a cycle the number of its strongly connected component."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    path: list[str] = []
    on_path: set[str] = set()
    out: dict[str, int] = {}
    for root in after:
        if root in order:
            continue
        todo = [(root, iter(after[root]))]
        order[root] = low[root] = len(order)
        path.append(root)
        on_path.add(root)
        while todo:
            name, rest = todo[-1]
            for x in rest:
                if x not in order:
                    order[x] = low[x] = len(order)
                    path.append(x)
                    on_path.add(x)
                    todo.append((x, iter(after[x])))
                    break
                if x in on_path:
                    low[name] = min(low[name], order[x])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[name])
                if low[name] == order[name]:
                    part = []
                    while not part or part[-1] != name:
                        part.append(path.pop())
                        on_path.discard(part[-1])
                    if len(part) > 1 or name in after[name]:
                        out |= dict.fromkeys(part, order[name])
    return out


def _bits(cycles: dict[str, int]) -> dict[str, int]:
    """A bit for each name, distinct inside its cycle."""
    used: dict[int, int] = {}
    out = {}
    for name, cycle in cycles.items():
        out[name] = 1 << used.setdefault(cycle, 0)
        used[cycle] += 1
    return out


def reached(bindings: list[dict]) -> list[Binding]:
    """Bindings, in position order, from which a source is reachable without meeting a name twice."""
    live: dict[Binding, list[Binding]] = {}
    for b in bindings:
        refs = [r for x in b["refs"] if (r := (x["pos"], x["name"])) in live]
        if b["src"] or refs:
            live[b["pos"], b["name"]] = refs
    cycles = name_cycles([(name, to) for (_, name), refs in live.items() for _, to in refs])
    if not cycles:
        return list(live)
    bit = _bits(cycles)
    sources = {(b["pos"], b["name"]) for b in bindings if b["src"]}
    # Names of its cycle on the paths of a binding; a path with fewer names makes others superfluous.
    paths: dict[Binding, list[int]] = {}
    for b, refs in live.items():
        name = b[1]
        own, cycle = bit.get(name, 0), cycles.get(name)
        some = {own} if b in sources else set()
        for r in refs:
            if cycle is not None and cycles.get(r[1]) == cycle:
                some |= {p | own for p in paths.get(r, ()) if not p & own}
            elif r in paths:
                some.add(own)
        if own in some:
            some = {own}
        if some:
            kept: list[int] = []
            for p in sorted(some, key=int.bit_count):
                if not any(k & p == k for k in kept):
                    kept.append(p)
            paths[b] = kept
    return list(paths)


def chain_ends(links: list[dict]) -> list[tuple[int, str, int, str]]:
    """(position, name, end position, end name): a chain stops before a name it has met.

    Walked from the ends of the chains: on the way from an end the nearest binding of the
    same name is the last one of that name, and the tighter of two stops holds."""
    below: dict[Binding, list[Binding]] = {}
    up = {}
    for x in links:
        b, to = (x["pos"], x["name"]), (x["to_pos"], x["to_name"])
        up[b] = to
        below.setdefault(to, []).append(b)
    out = []
    for root in below:
        if root in up:
            continue
        way: list[Binding] = []  # from the end to here
        last: dict[str, list[int]] = {}  # name: places on the way
        stops: list[int] = []
        todo: list[tuple[Binding, bool]] = [(root, True)]
        while todo:
            b, enter = todo.pop()
            if not enter:
                way.pop()
                stops.pop()
                last[b[1]].pop()
                continue
            places = last.setdefault(b[1], [])
            stop = max(stops[-1] if stops else -1, places[-1] if places else -1)
            places.append(len(way))
            stops.append(stop)
            way.append(b)
            if b in up:
                out.append((*b, *way[stop + 1]))
            todo.append((b, False))
            todo.extend((x, True) for x in below.get(b, ()))
    return out


def all_safe(bindings: list[dict]) -> list[int]:
    """Positions, in order, of bindings whose every part ends in safe values without meeting a name twice."""
    name_of = {b["pos"]: b["name"] for b in bindings}
    cycles = name_cycles([(b["name"], name_of[r]) for b in bindings for r in b["refs"] if r in name_of])
    bit = _bits(cycles)
    below: dict[int, int] = {}  # names of its own cycle under a safe binding, itself included
    for b in bindings:
        name = b["name"]
        if any(r not in below for r in b["refs"]):
            continue
        same = [below[r] for r in b["refs"] if name in cycles and cycles.get(name_of[r]) == cycles[name]]
        own = bit.get(name, 0)
        if any(s & own for s in same):
            continue
        for s in same:
            own |= s
        below[b["pos"]] = own
    return list(below)


def _per_file(files: DataFrame, column: str, decide: Callable[[list[dict]], list], out: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """One call of ``decide`` per file, on the list that ``column`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file's list at a time
                rows = [r if isinstance(r, tuple) else (r,) for r in decide(batch.column(1)[i].as_py())]
                ids = pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type)
                columns = zip(*rows, strict=True) if rows else ([] for _ in out)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), t) for c, t in zip(columns, out.values(), strict=True))], names=["file_id", *out])

    return files.select("file_id", column).mapInArrow(run, f"file_id {files.schema['file_id'].dataType.simpleString()}, {ddl}")


def tainted_bindings(bindings: DataFrame, edges: DataFrame) -> DataFrame:
    """Bindings from which a source is reachable without meeting a name twice: (file_id, pos, name).

    bindings(file_id, pos, name, has_source), edges(file_id, pos, name, to_pos, to_name).
    """
    refs = edges.groupBy("file_id", "pos", "name").agg(F.collect_set(F.struct(F.col("to_pos").alias("pos"), F.col("to_name").alias("name"))).alias("refs"))
    useful = bindings.join(refs, ["file_id", "pos", "name"], "left").where(F.col("has_source") | F.col("refs").isNotNull())
    none = F.array().cast("array<struct<pos:int,name:string>>")
    rows = useful.select("file_id", F.struct("pos", "name", F.col("has_source").alias("src"), F.coalesce("refs", none).alias("refs")).alias("b"))
    per_file = rows.groupBy("file_id").agg(F.bool_or("b.src").alias("any_source"), F.array_sort(F.collect_list("b")).alias("bs")).where("any_source")
    return _per_file(per_file, "bs", reached, {"pos": pa.int32(), "name": pa.string()}, "pos int, name string")


def alias_ends(edges: DataFrame) -> DataFrame:
    """Where a chain of plain aliases ends: (file_id, pos, name, end_pos, end_name).

    edges(file_id, pos, name, to_pos, to_name): the binding at ``pos`` is exactly
    the name ``to_name``, seen as the binding ``to_pos``.
    """
    per_file = edges.groupBy("file_id").agg(F.collect_list(F.struct("pos", "name", "to_pos", "to_name")).alias("es"))
    out = {"pos": pa.int32(), "name": pa.string(), "end_pos": pa.int32(), "end_name": pa.string()}
    return _per_file(per_file, "es", chain_ends, out, "pos int, name string, end_pos int, end_name string")


def safe_bindings(bindings: DataFrame, refs: DataFrame) -> DataFrame:
    """Bindings whose every part is safe: (file_id, pos).

    bindings(file_id, pos, name, bad): ``bad`` = some part is neither safe nor a
    plain alias.  refs(file_id, pos, to_pos): alias parts; a NULL target is an
    alias without a visible value.  A name met twice on a path is not safe.
    """
    parts = refs.groupBy("file_id", "pos").agg(
        F.collect_set("to_pos").alias("refs"), F.bool_or(F.col("to_pos").isNull()).alias("open")
    )
    rows = bindings.join(parts, ["file_id", "pos"], "left").where(~F.col("bad") & ~F.coalesce("open", F.lit(False)))
    per_file = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "name", F.coalesce("refs", F.array().cast("array<int>")).alias("refs")
    ))).alias("bs"))
    return _per_file(per_file, "bs", all_safe, {"pos": pa.int32()}, "pos int")


def next_in_group(rows: DataFrame, marks: Column, out: str, carry: list[str] = []) -> DataFrame:
    """Adds the next marked row after each row inside the same group.

    One backward window per (file, group): linear, unlike a frame that looks
    ahead from every row.
    """
    w = Window.partitionBy("file_id", "grp").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(F.when(marks, F.struct("idx", *carry)), ignorenulls=True).over(w))


def first_in_span(spans: DataFrame, marks: DataFrame, carry: str) -> DataFrame:
    """Adds ``mark`` (idx, <carry>): the first mark inside each of spans(file_id, start_idx,
    end_idx, ...); spans without one are left out.  One backward window per file."""
    asked = spans.select("*", F.col("start_idx").alias("idx"), F.lit(1).alias("ask"))
    rows = asked.unionByName(marks.select("file_id", "idx", F.col(carry).alias("carried"), F.lit(0).alias("ask")), allowMissingColumns=True)
    # Descending, and marks before spans at one place: a span sees the mark it starts with.
    w = Window.partitionBy("file_id").orderBy(F.col("idx").desc(), "ask").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.last(F.when(F.col("ask") == 0, F.struct("idx", F.col("carried").alias(carry))), ignorenulls=True).over(w)
    found = rows.withColumn("mark", ahead).where((F.col("ask") == 1) & (F.col("mark.idx") <= F.col("end_idx")))
    return found.select(*spans.columns, "mark")


def not_covered(marks: DataFrame, covers: DataFrame) -> DataFrame:
    """marks(file_id, idx, ...) that lie in none of covers(file_id, start_idx, end_idx), by a
    running sum of what begins and ends."""
    steps = covers.select("file_id", F.inline(F.array(
        F.struct(F.col("start_idx").cast("int").alias("idx"), F.lit(1).alias("step")),
        F.struct((F.col("end_idx") + 1).cast("int").alias("idx"), F.lit(-1).alias("step")),
    )))
    rows = steps.unionByName(marks.withColumn("is_mark", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("file_id").orderBy("idx").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    depth = rows.withColumn("depth", F.coalesce(F.sum("step").over(w), F.lit(0)))
    return depth.where(F.col("is_mark") & (F.col("depth") == 0)).select(*marks.columns)


def span_tokens(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens inside spans(file_id, start_idx, end_idx, ...): an equi-join on the index
    instead of a range join.  For spans of bounded length only."""
    opened = spans.where(F.col("start_idx") <= F.col("end_idx")).withColumn(
        "idx", F.explode(F.sequence(F.col("start_idx"), F.col("end_idx")))
    )
    return opened.join(tokens, ["file_id", "idx"])
