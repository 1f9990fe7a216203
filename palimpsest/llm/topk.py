"""Exact top-k inner products by block-at-a-time pruning.

Vectors lie in blocks of id ranges. A block is one row: its ids, its forward index (a matrix of whole numbers),
and per term (dimension) the largest and the smallest weight. The sum over terms of a query's weight times the
block's extreme bounds every score in the block. A task has a set of queries and a set of blocks; every query
orders the blocks by their bounds and is scored through their forward indexes until the next bound falls below
its k-th best score. The bests of all tasks meet per query.

Each query's own block gives it real scores when the blocks are made, so every task starts with a k-th score that
prunes. Query sets and block sets have fixed sizes; the pairs of them are what any exact search of these queries
against all rows has to visit or rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.plans.lineage import cut

#: Vectors of a block; blocks and queries of one task, on average.
BLOCK = 256
TASK_BLOCKS = 64
TASK_QUERIES = 2048
_NONE = np.iinfo(np.int64).min

_BLOCKS = "block bigint, ids binary, dim int, matrix binary, high binary, low binary"
_SCHEMA = _BLOCKS + ", n_queries int, q_slots binary, q_matrix binary, q_floor binary"
_FOUND = "q bigint, query_id bigint, vec_id bigint, score bigint"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by float64 where no sum can pass 2^53, else in int64."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * dim < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bests(q: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Positions of every query's k best entries: highest score first, then smallest id."""
    order = np.lexsort((vec_id, -score, q))
    held = q[order]
    first = np.searchsorted(held, held, side="left")
    return order[np.arange(len(order)) - first < k]


def _matrix(raw: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(rows, dim)


def blocks(vectors: DataFrame, k: int, every: int, size: int) -> DataFrame:
    """One row per block of ``vectors`` (vec_id, embedding), in order of id: see the module."""

    def make(number: int, ids: np.ndarray, lists: list) -> list:
        dim = max((len(v) for v in lists), default=0)
        matrix = np.zeros((len(lists), dim), np.int64)
        for i, v in enumerate(lists):
            matrix[i, : len(v)] = np.floor(64.0 * np.asarray(v, np.float64)).astype(np.int64)
        slots = np.flatnonzero(ids % every == 0)
        floor = np.full(len(slots), _NONE)
        if len(ids) > k and len(slots):
            scores = products(matrix[slots], matrix)
            scores[np.arange(len(slots)), slots] = _NONE
            floor = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        return [
            number, ids.astype("<i8").tobytes(), dim, matrix.astype("<i8").tobytes(),
            matrix.max(axis=0).astype("<i8").tobytes(), matrix.min(axis=0).astype("<i8").tobytes(),
            len(slots), slots.astype("<i8").tobytes(), matrix[slots].astype("<i8").tobytes(), floor.astype("<i8").tobytes(),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids: list[int] = []
        lists: list = []

        def row() -> pa.RecordBatch:
            nonlocal number
            out = make(number, np.array(ids, np.int64), lists)
            number += 1
            types = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 3]
            names = [c.split()[0] for c in _SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, types, strict=True)], names)

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(vec_id)
                lists.append(vector)
                if len(ids) == size:
                    yield row()
                    ids, lists = [], []
        if ids:
            yield row()

    spark = vectors.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    laid = vectors.withColumn("_draw", F.rand(11)).repartitionByRange(parts, "vec_id", "_draw")
    return laid.sortWithinPartitions("vec_id", "_draw").select("vec_id", "embedding").mapInArrow(run, _SCHEMA)


def search_blocks(queries: list[dict], held: list[dict], k: int, size: int) -> tuple[np.ndarray, ...]:
    """(q, query_id, vec_id, score): the k best of every query among the rows of ``held``."""
    dim = max([r["dim"] for r in queries + held], default=0)
    q_key, q_id, q_floor, q_rows = [], [], [], []
    for r in queries:
        slots, ids = np.frombuffer(r["q_slots"], "<i8"), np.frombuffer(r["ids"], "<i8")
        q_key.append(r["block"] * size + slots)
        q_id.append(ids[slots])
        q_floor.append(np.frombuffer(r["q_floor"], "<i8"))
        q_rows.append(np.pad(_matrix(r["q_matrix"], r["dim"], len(slots)), ((0, 0), (0, dim - r["dim"]))))
    key, query_id, floor, query = (np.concatenate(x) for x in (q_key, q_id, q_floor, q_rows))
    n, b = len(key), len(held)
    wide = [np.pad(_matrix(r["matrix"], r["dim"], -1) if r["dim"] else np.zeros((len(r["ids"]) // 8, 0), np.int64), ((0, 0), (0, dim - r["dim"]))) for r in held]
    ids = [np.frombuffer(r["ids"], "<i8") for r in held]
    keys = [r["block"] * size + np.arange(len(i)) for r, i in zip(held, ids, strict=True)]
    # what lies beyond a block's own dimensions is 0
    high = np.array([np.pad(np.frombuffer(r["high"], "<i8"), (0, dim - r["dim"])) for r in held]).reshape(b, dim)
    low = np.array([np.pad(np.frombuffer(r["low"], "<i8"), (0, dim - r["dim"])) for r in held]).reshape(b, dim)
    bound = products(np.maximum(query, 0), high) + products(np.minimum(query, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")

    # the bests so far, as entries; the k-th score of every query, and from when on it is one found here
    none = np.zeros(0, np.int64)
    e_q, e_score, e_id = none, none, none
    kth, kth_id = floor.copy(), np.full(n, np.iinfo(np.int64).max)
    for turn in range(b):
        block_of = order[:, turn]
        active = bound[np.arange(n), block_of] >= kth
        if not active.any():
            break
        new_q, new_score, new_id = [e_q], [e_score], [e_id]
        for j in np.unique(block_of[active]).tolist():
            rows = np.flatnonzero(active & (block_of == j))
            score = products(query[rows], wide[j])
            good = (score > kth[rows, None]) | ((score == kth[rows, None]) & (ids[j][None, :] <= kth_id[rows, None]))
            good &= keys[j][None, :] != key[rows, None]
            at, col = np.nonzero(good)
            new_q.append(rows[at])
            new_score.append(score[at, col])
            new_id.append(ids[j][col])
        e_q, e_score, e_id = (np.concatenate(x) for x in (new_q, new_score, new_id))
        keep = bests(e_q, e_score, e_id, k)
        e_q, e_score, e_id = e_q[keep], e_score[keep], e_id[keep]
        full = np.flatnonzero(np.bincount(e_q, minlength=n) == k)
        last = np.searchsorted(e_q, full, side="right") - 1
        kth[full], kth_id[full] = e_score[last], e_id[last]
    return key[e_q], query_id[e_q], e_id, e_score


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    block: int = BLOCK, task_blocks: int = TASK_BLOCKS, task_queries: int = TASK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its ``k`` best other rows.

    Components are floor(64 x); the score is their integer inner product, ties go to the smaller id. Vectors that
    are null or hold a null or non-finite component, and rows without an id, take no part. A shorter vector counts
    as filled up with zeros. A repeated row is a row of its own: a candidate for its twins and, if its id says so,
    a query. Scores are 64-bit numbers. Fewer than ``k`` other rows give as many results, an empty table none. Other columns are not read.
    """
    number, vector = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    clean = vectors.filter(number.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        number.alias("vec_id"), vector.alias("embedding")
    )
    index = cut(blocks(clean, k, every, block))
    sizes = index.agg(F.count("*").alias("b"), F.coalesce(F.sum("n_queries"), F.lit(0)).alias("q")).first()
    n_block_sets = -(-sizes["b"] // task_blocks) or 1
    n_query_sets = -(-sizes["q"] // task_queries) or 1

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("block", F.lit(own)), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        )

    asked = dealt(index.filter("n_queries > 0").select("block", "ids", "dim", "q_slots", "q_matrix", "q_floor"),
                  "qs", n_query_sets, "bs", n_block_sets)
    scored = dealt(index.select("block", "ids", "dim", "matrix", "high", "low"), "bs", n_block_sets, "qs", n_query_sets)
    scored = scored.select(*[F.col(c).alias(f"b_{c}") for c in scored.columns])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        queries = left.to_pylist()
        held = right.rename_columns([c.removeprefix("b_") for c in right.column_names]).to_pylist()
        found = search_blocks(queries, held, k, block) if queries and held else (np.zeros(0, np.int64),) * 4
        return pa.table(dict(zip(("q", "query_id", "vec_id", "score"), (pa.array(x, pa.int64()) for x in found), strict=True)))

    found = asked.groupBy("qs", "bs").cogroup(scored.groupBy("b_qs", "b_bs")).applyInArrow(search, _FOUND)
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
