"""Best-fit packing after a Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens (:func:`pieces`), and the pieces an instance of bin
packing over whole lengths. Lengths lie between 1 and the capacity, so the whole instance is one count per
length, at most ``capacity`` numbers whatever the corpus holds. On these counts

1. the reduction fixes, again and again, a small set of lengths that dominates every other set its longest
   member could share a sequence with (Martello and Toth 1990): alone if nothing fits beside it, with its
   exact complement, with the longest partner if only one more fits, with the two longest if only two fit and
   no other pair has a longer smaller member. Equal lengths are fixed in one step, as often as counts allow;
2. the remaining lengths are placed best-fit, longest first, equal open sequences being one class.

Every step makes at most one new class, so the plan holds at most two classes per length. It goes back to
Spark as a bounded table (length, range of ranks, first sequence, offset); every piece finds its place from its
rank among the pieces of its length. Ranks come from hashed buckets of each length and their counted offsets,
so a length that a third of all pieces have is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.bpe import load, vocabulary
from palimpsest.llm.common import bounded_batches, slices
from palimpsest.plans.lineage import cut

#: A pattern: how often each length stands in one sequence, as ((length, times), ...).
Pattern = tuple[tuple[int, int], ...]

#: Pieces of one length that one task ranks.
RANK_ROWS = 100_000

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(
    docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32). A document is its ids and ``end_id``; only
    one longer than ``capacity`` is cut, into full pieces and a last one. Null text is empty: one piece of one id.
    Repeated rows give repeated pieces; columns besides id and text are not read."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = load(path), np.array([end_id], dtype="<u4")
        for batch in slices(batches, "text"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(bpe.encode_column(batch.column("text"))):
                ids = np.concatenate([ids.astype("<u4"), last])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at: at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = bounded_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    return source.mapInArrow(run, PIECE)


# ---- the plan, on counts per length ----------------------------------------------------------


def _largest(count: np.ndarray, limit: int) -> int:
    """The largest length up to ``limit`` that is left, or 0."""
    if limit < 1:
        return 0
    at = np.flatnonzero(count[1: limit + 1])
    return int(at[-1]) + 1 if len(at) else 0


def _smallest(count: np.ndarray, many: int) -> list[int]:
    """The ``many`` smallest items left, equal ones repeated."""
    out: list[int] = []
    for length in np.flatnonzero(count)[:many].tolist():
        out += [length] * min(many - len(out), int(count[length]))
    return out[:many]


def _pairs(count: np.ndarray, room: int) -> tuple[int, int]:
    """Over all pairs (c >= d) that fit into ``room``: the largest d, and the largest sum; 0 if there is none."""
    lengths = np.flatnonzero(count[: room + 1])
    if not len(lengths):
        return 0, 0
    # the largest partner of every c among items not longer than c (c itself only if there are two)
    place = np.searchsorted(lengths, np.minimum(lengths, room - lengths), side="right") - 1
    own = (place >= 0) & (lengths[np.maximum(place, 0)] == lengths) & (count[lengths] < 2)
    place = place - own
    d = np.where(place >= 0, lengths[np.maximum(place, 0)], 0)
    fits = d > 0
    return int(d.max(initial=0)), int((lengths + d)[fits].max(initial=0))


def _dominating(count: np.ndarray, longest: int, capacity: int) -> list[int] | None:
    """Partners that, together with one item of ``longest`` (already taken out of ``count``), dominate every
    feasible set that holds it; None if none of the criteria says so."""
    room = capacity - longest
    low = _smallest(count, 3)
    if not low or low[0] > room:
        return []
    if room <= capacity and count[room]:
        return [room]
    first = _largest(count, room)
    if len(low) < 2 or low[0] + low[1] > room:
        return [first]
    if len(low) < 3 or sum(low) > room:
        count[first] -= 1
        second = _largest(count, room - first)
        count[first] += 1
        deepest, most = _pairs(count, room)
        if second and deepest <= second:
            return [first, second]
        if not second and most <= first:
            return [first]
    return None


def reduce(count: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Fixes dominating sets until no criterion applies; takes them out of ``count``."""
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for longest in np.flatnonzero(count)[::-1].tolist():
            while count[longest]:
                count[longest] -= 1
                partners = _dominating(count, longest, capacity)
                count[longest] += 1
                if partners is None:
                    break
                need: dict[int, int] = defaultdict(int)
                for length in [longest, *partners]:
                    need[length] += 1
                times = min(int(count[length]) // k for length, k in need.items())
                for length, k in need.items():
                    count[length] -= k * times
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                changed = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: sequences with equal contents are one class."""
    rooms: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    open_rooms = np.zeros(capacity + 1, dtype=bool)

    def put(pattern: Pattern, times: int, room: int) -> None:
        rooms[room].append((pattern, times))
        open_rooms[room] = True

    for length in np.flatnonzero(count)[::-1].tolist():
        left = int(count[length])
        while left:
            ahead = open_rooms[length:]
            at = int(ahead.argmax())
            if not ahead[at]:  # no open sequence has room: new ones, filled with this length alone
                each = min(left, capacity // length)
                times = left // each
                put(((length, each),), times, capacity - each * length)
                left -= each * times
                continue
            room = length + at
            pattern, times = rooms[room].pop()
            moved = min(times, left)
            if times > moved:
                rooms[room].append((pattern, times - moved))
            open_rooms[room] = bool(rooms[room])
            *head, (last, k) = pattern
            grown = (*head, (last, k + 1)) if last == length else (*pattern, (length, 1))
            put(grown, moved, room - length)
            left -= moved
    count[:] = 0
    return [x for same in rooms.values() for x in same]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences have each, for ``counts`` pieces of each length."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        count[length] = n
    return reduce(count, capacity) + best_fit(count, capacity)


def places(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, times per sequence, offset) of every pattern."""
    out, sequence, rank = [], 0, defaultdict(int)
    for pattern, times in patterns:
        offset = 0
        for length, k in pattern:
            out.append((length, rank[length], rank[length] + k * times, sequence, k, offset))
            rank[length] += k * times
            offset += k * length
        sequence += times
    return out


# ---- the operator ----------------------------------------------------------------------------


def ranked(found: DataFrame, buckets: int) -> DataFrame:
    """``found`` with ``rank``, from 0, within every length; equal rows may stand in either order."""
    hashed = found.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = hashed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("length").alias("_l"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    within = W.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    numbered = hashed.withColumn("_r", F.row_number().over(within) - 1)
    on = (F.col("length") == F.col("_l")) & (F.col("_b") == F.col("_c"))
    return numbered.join(offsets, on).withColumn("rank", F.col("_r") + F.col("_off")).drop("_b", "_r", "_l", "_c", "_off")


def pack(
    docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    Returns one row per piece: those of :func:`pieces` and ``sequence_id``, ``offset``. Pieces of a sequence
    follow each other without gaps. Nulls, repeats and extra columns as in :func:`pieces`; an empty table
    gives no rows. Ties between equal lengths are broken by hash, then id, so results repeat.
    """
    spark = docs.sparkSession
    found = cut(pieces(docs, capacity, path, end_id, id_col, text_col))
    # one row per length, so at most ``capacity`` of them however large the corpus is
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan(counts, capacity))
    put = spark.createDataFrame(
        table, "_length bigint, _from bigint, _to bigint, _seq bigint, _k bigint, _at bigint"
    )
    most = max(counts.values(), default=0)
    numbered = ranked(found, max(16, -(-most // RANK_ROWS)))
    here = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
    step = F.col("rank") - F.col("_from")
    return numbered.join(F.broadcast(put), here).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_seq") + F.floor(step / F.col("_k"))).cast("bigint").alias("sequence_id"),
        (F.col("_at") + F.pmod(step, F.col("_k")) * F.col("length")).cast("bigint").alias("offset"),
    )
