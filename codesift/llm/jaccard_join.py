"""N-gram Jaccard self-join by chosen paths.

A text is the set of its runs of SHINGLE words.  Texts with one set form a class, and
only classes are compared.  Each class has tokens sampled alike from all sets, as minima
under hash functions: two sets of similarity J agree in each with probability J.

A run sends every class down a path of sampled tokens: first the run's own token, then,
while a bucket holds more than LIMIT classes, the tokens at BRANCHES places of the sketch
that the path itself chooses.  Similar sets keep meeting, others part soon, however
frequent one passage is.  A large bucket that a further token hardly shrinks holds sets
that are alike, and is split no more.  Buckets are compared by brute force, large ones
block against block, so a task holds two blocks at most and no class is left out.

RUNS runs are made.  A pair at J = 0.8 shares the run's token with probability 0.8 and at
least one token of a further level with 1 - 0.2**2 = 0.96, so a run over three further
levels finds it with 0.7, and all ten miss it once in 170,000 cases; above 0.8, and
without further levels, far less often.  Comparing asks for agreement in CLOSE of the
sketch; a pair at J = 0.8 fails that once in 20,000 cases.

A bucket doesn't emit its pairs but a spanning forest of them.  The components of all
forests hold every link, so inside each of them all sets are then compared exactly, again
block against block: |A and B| >= THRESHOLD * |A or B|.  That yields the number of links
of each class and a spanning forest of links, and the groups are its components.  So work
inside a group of thousands of different near copies is quadratic, what is emitted isn't.

Defined cases: a text of 1 to 4 words has one shingle of all its words; a text without
words (or null) is a class of its own and has no links; rows without id are labelled by
the largest long; repeated rows are copies of each other; an empty table gives an empty
one.  Sets are named by 64-bit hashes of two independent 64-bit sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.components import roots
from codesift.llm.store import NO_ID, order_key, written
from codesift.llm.words import BASES, Words, mix, prefix_sums, run_hash, word_slices

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 128
CLOSE = 0.64
RUNS = 10
LIMIT = 1024
BRANCHES = 2
ALIKE = 0.7  # a token that this share of a bucket has doesn't split it
MAX_DEPTH = 12
SET_BLOCK = 512
SEED = 0x5EED

_U64, _U32 = np.uint64, np.uint32
_numbers = np.random.default_rng(SEED)
_FACTOR = _numbers.integers(0, 1 << 32, RUNS + COORDINATES, dtype=_U32) | _U32(1)
_SHIFT = _numbers.integers(0, 1 << 32, RUNS + COORDINATES, dtype=_U32)
_FEATURES = "doc long, tag long, cid long, n int, tokens binary, sketch binary"


def distinct_shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, shingle hash), sorted and distinct."""
    hashes = words.hashes()
    sums = prefix_sums(hashes, BASES[0])
    doc = words.doc
    at = np.arange(len(hashes))
    last = words.first[doc + 1]
    starts = (at + SHINGLE <= last) | (at == words.first[doc])
    at, doc, last = at[starts], doc[starts], last[starts]
    value = run_hash(sums, BASES[0], at, np.minimum(at + SHINGLE, last))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def set_names(texts: int, doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of shingles, name, places where the texts that have any start)."""
    size = np.bincount(doc, minlength=texts)
    start = (np.cumsum(size) - size)[size > 0]
    name = np.zeros(texts, _U64)
    if len(start):
        one = np.add.reduceat(mix(value), start)
        two = np.add.reduceat(mix(value ^ _U64(BASES[1])), start)
        name[size > 0] = mix(one ^ mix(two + size[size > 0].astype(_U64)))
    return size, name.view(np.int64), start


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text, tag in; _FEATURES out: the token of each run in 64 bits, the sketch in 16."""
    for batch in batches:
        for a, b, words in word_slices(batch.column(1)):
            doc, value = distinct_shingles(words)
            size, name, start = set_names(b - a, doc, value)
            tokens, sketch = np.zeros((b - a, RUNS), _U64), np.zeros((b - a, COORDINATES), np.uint16)
            if len(start):
                low, held = (value >> _U64(32)).astype(_U32), size > 0
                for c in range(RUNS + COORDINATES):
                    least = np.minimum.reduceat(low * _FACTOR[c] + _SHIFT[c], start)
                    if c < RUNS:
                        tokens[held, c] = mix(least.astype(_U64) + (_U64(c + 1) << _U64(32)))
                    else:
                        sketch[held, c - RUNS] = mix(least.astype(_U64)) & _U64(0xFFFF)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(name),
                    pa.array(size.astype(np.int32)), _rows(tokens), _rows(sketch),
                ],
                names=["doc", "tag", "cid", "n", "tokens", "sketch"],
            )


def _rows(held: np.ndarray) -> pa.Array:
    width = held.shape[1] * held.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(held), [None, pa.py_buffer(held.tobytes())]).cast(pa.binary())


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def first_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, tokens in; node, cid, parent (size of the bucket above) out, one row for each run."""
    for batch in batches:
        node = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        cid = np.repeat(batch.column(0).to_numpy(), RUNS)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(cid), pa.array(np.full(len(cid), 1 << 62))], names=["node", "cid", "parent"])


def next_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, cid, m, sketch in; the child nodes out.  The node chooses the coordinates."""
    for batch in batches:
        sketch = _sketches(batch.column(3))
        node = batch.column(0).to_numpy().view(_U64)
        out = []
        for k in range(BRANCHES):
            chosen = mix(node + _U64(k + 1))
            token = sketch[np.arange(len(node)), (chosen % _U64(COORDINATES)).astype(np.int64)]
            out.append(mix(chosen ^ mix(token.astype(_U64))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.stack(out, 1).ravel().view(np.int64)), *(pa.array(np.repeat(batch.column(i).to_numpy(), BRANCHES)) for i in (1, 2))], names=["node", "cid", "parent"]
        )


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, the cell, as a table for each.  Held between
    batches: the rows of the open cell, two blocks at most."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        cells = table.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(lo, hi - lo)
        rest = table.slice(edges[-1])
    if rest is not None:
        yield rest


class Forest:
    """Grows a spanning forest over the rows of a cell."""

    def __init__(self, cid: np.ndarray):
        self.cid, self.tree = cid, np.arange(len(cid))
        self.edges: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        found, first = np.unique(self.tree[others], return_index=True)
        for tree, at in zip(found, first, strict=True):
            if tree != self.tree[i]:
                self.edges.append((self.cid[i], self.cid[others[at]]))
                self.tree[self.tree == tree] = self.tree[i]


def _fits(side: np.ndarray, cid: np.ndarray, n: np.ndarray, i: int) -> np.ndarray:
    """Later rows of the cell to compare with row i: of the other block, if there are two, and of fitting size."""
    later = slice(i + 1, None)
    fits = np.minimum(n[i], n[later]) >= THRESHOLD * np.maximum(n[i], n[later])
    return np.flatnonzero(fits & (cid[later] != cid[i]) & ((side[i] == 0) | (side[later] != side[i]))) + i + 1


def close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, side, cid, n, sketch in; a spanning forest of the pairs with close sketches out."""
    held: list[tuple[int, int]] = []

    def out() -> pa.RecordBatch:
        edges = np.array(held, np.int64).reshape(-1, 2)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(edges.min(1)), pa.array(edges.max(1))], names=["a", "b"])

    for cell in _cells(batches):
        side, cid, n = (cell.column(i).to_numpy() for i in (1, 2, 3))
        sketch = _sketches(cell.column(4))
        forest = Forest(cid)
        for i in range(len(cid) - 1):
            at = _fits(side, cid, n, i)
            at = at[forest.tree[at] != forest.tree[i]]  # what hangs together needs no more edges
            if len(at):
                forest.join(i, at[(sketch[at] == sketch[i]).sum(1) >= CLOSE * COORDINATES])
        held += forest.edges
        if len(held) > 10_000:
            yield out()
    yield out()


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common members of all pairs of sets, over a few thousand members at a time."""
    member, which = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(member, kind="stable")
    member, which = member[order], which[order]
    edge = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1], [True]]))
    shared = np.diff(edge) > 1
    column = np.repeat(np.cumsum(shared) - 1, np.diff(edge))
    keep = np.repeat(shared, np.diff(edge))
    column, which = column[keep], which[keep]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[which[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out


def exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, side, cid, set in; per class its number of links in this cell (b null), and a
    spanning forest of the links (n null)."""
    for cell in _cells(batches):
        side, cid = cell.column(1).to_numpy(), cell.column(2).to_numpy()
        if len(cid) < 2:
            continue
        sets = [np.frombuffer(x.as_buffer(), _U64) for x in cell.column(3).chunk(0)]
        n = np.array([len(x) for x in sets])
        both = common(sets)
        degree, forest = np.zeros(len(cid), np.int64), Forest(cid)
        for i in range(len(cid) - 1):
            at = _fits(side, cid, n, i)
            at = at[both[i, at] >= THRESHOLD * (n[i] + n[at] - both[i, at]) - 1e-9]
            degree[i] += len(at)
            degree[at] += 1
            forest.join(i, at)
        some = np.flatnonzero(degree)
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        gap = [np.ones(len(x), bool) for x in (some, edges)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([cid[some], edges[:, 0]])),
                pa.array(np.concatenate([cid[some], edges[:, 1]]), mask=np.concatenate([gap[0], ~gap[1]])),
                pa.array(np.concatenate([degree[some], edges[:, 0]]), mask=np.concatenate([~gap[0], gap[1]])),
            ],
            names=["a", "b", "n"],
        )


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text, cid in; cid and the sorted set out, where the text has that set."""
    for batch in batches:
        cids = batch.column(2).to_numpy()
        for a, b, words in word_slices(batch.column(1)):
            doc, value = distinct_shingles(words)
            size, name, _ = set_names(b - a, doc, value)
            ends = np.cumsum(size)
            own = np.flatnonzero(name == cids[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cids[a:b][own]), pa.array([value[ends[d] - size[d] : ends[d]].tobytes() for d in own], pa.binary())], names=["cid", "held"]
            )


def _in_blocks(rows: DataFrame, group: str, m: str, limit: int, *more: str) -> DataFrame:
    """Rows of groups with ``m`` members as cells of one block, or of two different ones."""
    rows = rows.withColumn("blocks", F.ceil(F.col(m) / limit).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid", group), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return rows.select(F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")).alias("cell"), side.alias("side"), "cid", *more)


def _buckets(classes: DataFrame) -> DataFrame:
    """(node, cid, m): the buckets to compare, with their numbers of classes."""
    rows = written(classes.select("cid", "tokens").mapInArrow(first_nodes, "node long, cid long, parent long"), "paths")
    ready = []
    for depth in range(MAX_DEPTH):
        count = rows.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        met = written(rows.join(count, "node"), "met")
        split = (F.col("m") > LIMIT) & (F.col("m") < ALIKE * F.col("parent")) & F.lit(depth < MAX_DEPTH - 1)
        ready.append(met.where(~split).select("node", "cid", "m"))
        large = met.where(split)
        if large.isEmpty():
            break
        large = large.join(classes.select("cid", "sketch"), "cid").select("node", "cid", "m", "sketch")
        rows = written(large.mapInArrow(next_nodes, "node long, cid long, parent long"), "paths")
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, root): classes that may have links, grouped so that no link leaves a group."""
    cells = _in_blocks(_buckets(classes), "node", "m", LIMIT).join(classes.select("cid", "n", "sketch"), "cid").select("cell", "side", "cid", "n", "sketch")
    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(close_pairs, "a long, b long")
    return written(roots(written(found.distinct(), "close")), "groups")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``jaccard_join`` with tag (hash of the text) and group (one value for all
    rows that are linked or copies, null for texts without words); doc is the order key."""
    texts = docs.select(order_key(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tag"))
    rows = written(texts.mapInArrow(features, _FEATURES), "features")
    full = rows.where("n > 0")
    classes = full.groupBy("cid").agg(F.min(F.struct("doc", "tag")).alias("rep"), F.count("*").alias("n_copies"), *(F.first(c).alias(c) for c in ("n", "tokens", "sketch")))
    classes = written(classes.select("cid", F.col("rep.doc").alias("rep"), F.col("rep.tag").alias("tag"), "n_copies", "n", "tokens", "sketch"), "classes")
    groups = candidate_groups(classes)
    # An id may have many texts (no id has), so a class fetches its own by id and tag; repeated
    # rows, and texts whose tags collide, are told apart only after the set has been checked.
    wanted = groups.join(classes.select(F.col("cid").alias("node"), F.col("rep").alias("doc"), "tag"), "node").select(F.col("node").alias("cid"), "doc", "tag")
    sets = texts.join(wanted, ["doc", "tag"]).select("doc", "text", "cid").mapInArrow(shingle_sets, "cid long, held binary").dropDuplicates(["cid"])
    sizes = groups.groupBy("root").agg(F.count("*").alias("m"))
    cells = _in_blocks(groups.join(sizes, "root").withColumnRenamed("node", "cid"), "root", "m", SET_BLOCK)
    cells = cells.join(sets, "cid").select("cell", "side", "cid", "held")
    told = written(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(exact_links, "a long, b long, n long"), "links")
    reach = written(roots(told.where("b is not null").select("a", "b")), "roots")
    degree = told.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    label = reach.join(classes.select(F.col("cid").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_id"))
    told = reach.join(label, "root").join(degree, "node").select(F.col("node").alias("cid"), "root", "class_id", "n_links")
    # Written, so that both sides of the next join are plain exchanges and a set that many rows hold is split.
    told = written(classes.select("cid", "rep", "n_copies").join(told, "cid", "left"), "told")
    out = full.select("doc", "tag", "cid").join(told, "cid").select(
        "doc", "tag", F.coalesce("root", "cid").alias("group"),
        F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("copy_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    one = F.lit(1).cast("long")
    empty = rows.where("n = 0").select(
        "doc", "tag", F.lit(None).cast("long").alias("group"),
        F.col("doc").alias("class_id"), F.col("doc").alias("copy_id"), one.alias("n_copies"), (one - 1).alias("n_links"),
    )
    return out.unionByName(empty)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc (its id), class_id (smallest id of all documents it
    is linked with, directly or through others), copy_id (smallest id with the same set),
    n_copies, n_links (classes it is directly linked with)."""
    return _grouped(docs, id_col, text_col).drop("tag", "group").withColumn("doc", F.nullif("doc", F.lit(NO_ID)))


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, columns unchanged: of the smallest
    id, rows without id last.  Texts without words are in no group and stay."""
    own = F.struct("doc", "tag")
    found = written(_grouped(docs, id_col, text_col).where("group is not null").select("doc", "tag", "group"), "grouped")
    firsts = written(found.groupBy("group").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    # Rows of one id and text are in one group; more than one such row may come first.
    told = found.join(firsts, "group").groupBy("doc", "tag").agg(F.max(F.col("first") == own).alias("first"), F.count("*").alias("n"))
    told = written(told.where("not first or n > 1").select("doc", "tag", "first"), "gone")
    names = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)), order_key(id_col).alias("doc"), F.xxhash64(text_col).alias("tag"))
    rows = rows.join(told, ["doc", "tag"], "left")
    kept = rows.where("first is null")
    if not told.where("first").isEmpty():
        kept = kept.unionByName(rows.where("first").dropDuplicates(["doc", "tag"]))
    return kept.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(names)))
