"""Approximate nearest neighbours over learned partitions.

Fit, on a bounded sample (SAMPLE vectors of smallest hash): the graph of each vector's
GRAPH_NEIGHBOURS nearest ones is cut into PARTS parts of equal size.  The cut starts from
medians along principal axes and is improved by swapping equally many vectors between two
parts while that keeps more edges inside.  A small network with one hidden layer learns,
for a vector, how its neighbours spread over the parts.

Index: every vector goes to its most probable part.  Search: a query goes to its PROBES
most probable parts, where cosines are computed in double precision and the best kept.  A
part is dealt over blocks of BLOCK_ROWS vectors by a hash of their ids, its queries over
chunks of CHUNK_QUERIES, and each task takes one block and one chunk, so parts may be of
any size and hold any number of equal vectors.  A query that finds too few in its parts
is searched in all parts.

Vectors that are null, zero, without id, of another length than most of the sample, or
hold null or non-finite components take no part.  Repeated rows count once; of rows that
share an id the nearest counts.  Ties go to the smaller id.  Fewer candidates than K give
shorter results; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codesift.llm.store import written

SAMPLE = 6144
GRAPH_NEIGHBOURS = 10
PARTS = 16
PROBES = 12
HIDDEN = 128
EPOCHS = 25
BLOCK_ROWS = 4096
CHUNK_QUERIES = 1024
SEED = 7


@dataclass
class Router:
    """Log-odds of the parts for unit vectors."""

    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray

    def scores(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.inner + self.inner_bias, 0) @ self.outer + self.outer_bias


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first so that nothing overflows."""
    if not len(vectors):
        return vectors
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest others, in blocks of rows."""
    k = min(k, len(unit) - 1)
    out = np.empty((len(unit), k), np.int64)
    for at in range(0, len(unit), 512):
        near = unit[at : at + 512] @ unit.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -2
        out[at : at + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 4) -> np.ndarray:
    """A part for each row, sizes at most one apart."""
    part = np.zeros(len(unit), np.int64)
    todo = [(np.arange(len(unit)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        centred = unit[rows] - unit[rows].mean(0)
        axis = np.linalg.svd(centred[:: max(1, len(rows) // 2048)], full_matrices=False)[2][0]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        half = len(rows) * (n // 2) // n
        todo += [(order[:half], first, n // 2), (order[half:], first + n // 2, n - n // 2)]
    both = np.concatenate([graph, graph[:, :0]], 1)
    source = np.repeat(np.arange(len(unit)), both.shape[1])
    one, two = np.concatenate([source, both.ravel()]), np.concatenate([both.ravel(), source])
    for _ in range(rounds):
        moved = 0
        for p in range(parts):
            for q in range(p + 1, parts):
                ties = np.zeros((len(unit), 2), np.int64)
                for side, name in enumerate((p, q)):
                    at = part[two] == name
                    ties[:, side] = np.bincount(one[at], minlength=len(unit))
                here, there = np.flatnonzero(part == p), np.flatnonzero(part == q)
                gain_here, gain_there = (ties[here, 1] - ties[here, 0]), (ties[there, 0] - ties[there, 1])
                here, there = here[np.argsort(-gain_here, kind="stable")], there[np.argsort(-gain_there, kind="stable")]
                n = min(len(here), len(there))
                total = np.sort(gain_here)[::-1][:n] + np.sort(gain_there)[::-1][:n]
                swap = int((total > 2).sum()) // 2  # half of what seems to gain, as neighbours move together
                part[here[:swap]], part[there[:swap]] = q, p
                moved += swap
        if not moved:
            break
    return part


def fit_router(unit: np.ndarray, spread: np.ndarray) -> Router:
    """Softmax regression with a hidden layer on soft targets, by Adam."""
    rng = np.random.default_rng(SEED)
    width, parts = unit.shape[1], spread.shape[1]
    weights = [
        rng.normal(0, np.sqrt(2 / width) * np.sqrt(width) / 2, (width, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.004 * (1 - epoch / EPOCHS) + 0.0002
        order = rng.permutation(len(unit))
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            x, want = unit[rows], spread[rows]
            inner = x @ weights[0] + weights[1]
            hidden = np.maximum(inner, 0)
            logits = hidden @ weights[2] + weights[3]
            likely = np.exp(logits - logits.max(1, keepdims=True))
            error = (likely / likely.sum(1, keepdims=True) - want) / len(rows)
            back = (error @ weights[2].T) * (inner > 0)
            step += 1
            for i, slope in enumerate((x.T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                slope = slope + 1e-4 * weights[i]
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope * slope
                weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def fit(sample: np.ndarray, parts: int = PARTS) -> Router:
    unit = units(sample)
    parts = max(1, min(parts, len(unit) // 16))
    graph = neighbour_graph(unit, GRAPH_NEIGHBOURS)
    part = balanced_parts(unit, graph, parts) if parts > 1 else np.zeros(len(unit), np.int64)
    spread = np.eye(parts)[part]  # a vector's own part counts as much as two neighbours
    spread = 2 * spread + np.eye(parts)[part[graph]].sum(1)
    return fit_router(unit, spread / spread.sum(1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _best(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Each query's k nearest of these rows: id, v and id, v in; query_id, vec_id, score out."""
    q_ids, ids = queries["id"].to_numpy(), rows["id"].to_numpy()
    q, v = matrix(queries["v"]), matrix(rows["v"])
    out: list[tuple[np.ndarray, ...]] = []
    if len(q) and len(v):
        q_unit, unit = units(q), units(v)
        for i, near in enumerate(q_unit @ unit.T):
            near[ids == q_ids[i]] = -2
            take, want = np.zeros(0, np.int64), min(k, len(near))
            while True:  # more while repeated ids take places
                floor = np.partition(near, -want)[-want]
                take = np.flatnonzero((near >= floor - 1e-9) & (near > -1.5))
                if want == len(near) or len(np.unique(ids[take])) >= k:
                    break
                want = min(len(near), 4 * want)
            # One row at a time, so that equal vectors have equal scores whatever stands beside them.
            score = (unit[take] * q_unit[i]).sum(1)
            order = np.lexsort((ids[take], -score))
            first = np.sort(np.unique(ids[take][order], return_index=True)[1])[:k]
            order = order[first]
            out.append((np.full(len(order), q_ids[i]), ids[take][order], score[order]))
    parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})


def _routed(rows: DataFrame, router: Router, probes: int) -> DataFrame:
    """``rows`` (id, v) once for each of their most probable parts, with the part."""

    def run(batches):
        for batch in batches:
            score = router.scores(units(matrix(batch.column(1))))
            top = np.argsort(-score, axis=1, kind="stable")[:, :probes].ravel()
            at = pa.array(np.repeat(np.arange(batch.num_rows), min(probes, score.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(top.astype(np.int32)), *(c.take(at) for c in batch.columns)], names=["part", "id", "v"])

    return rows.mapInArrow(run, "part int, id long, v array<double>")


def _search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Both with part, id, v.  Block by chunk, then the best of each query."""
    sizes = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))  # a row per part
    asked = queries.groupBy("part").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("chunks"))
    shape = F.broadcast(sizes.join(asked, "part"))
    blocks = index.join(shape, "part").select(
        "part", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "v"
    )
    chunks = queries.join(shape, "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), "id", "v"
    )
    key = ("part", "block", "chunk")
    found = chunks.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(lambda q, rows: _best(q, rows, k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(
    rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, parts: int = PARTS, probes: int = PROBES, sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where ``is_query`` (a test on the column ``id``)."""
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    held = [r["v"] for r in good.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()]
    lengths = np.bincount([len(v) for v in held], minlength=1)
    good = good.where(F.size("v") == int(lengths.argmax()))
    drawn = np.array([v for v in held if len(v) == lengths.argmax()]) if held else np.eye(1)
    router = fit(drawn, parts)
    index = written(_routed(good, router, 1), "index")
    queries = good.where(is_query)
    found = written(_search(index, _routed(queries, router, probes), k), "nearest")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = written(queries.join(full, queries["id"] == full["query_id"], "left_anti"), "short")
    if not short.isEmpty():
        again = _search(index, _routed(short, router, parts), k)
        found = found.join(full, "query_id", "left_semi").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")
