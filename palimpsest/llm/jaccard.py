"""Near duplicates by a grouped prefix join on word shingles, exact at its threshold.

1. A fixed-size count of shingles over the whole table gives one global order, rare shingles first. Any order
   gives the same links; this one keeps passages that many documents share out of the prefixes.
2. A document's prefix is so many of its first shingles that two documents that link share one. Documents with
   the same prefix and set size are one group, and only groups are posted, in packed arrays dealt to buckets.
   Only postings of shingles that two groups share come back; they are few.
3. Posting lists are expanded to the groups' members, and pairs are filtered by size, by the overlap that can
   follow their common shingle, and by a bitmap of each set (two bitmaps that differ in many bits prove that the
   sets differ in as many shingles). What is left is verified on whole sets.

Links are asked for component by component, so a set of copies never yields all its pairs. In every round each
list links its members to one hub, and components are formed; lists that hold one component drop out. At last
all pairs of a list that still lie in different components are filtered, in blocks of bounded size. What is left
out can not change a component: its two ends are already together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Words, bounded_batches, mix64, slices
from palimpsest.plans.lineage import BROADCAST_ROWS, cut, fits, is_empty

#: Counters of the global order: 4 MB, whatever the table holds.
COUNTERS = 1 << 20
_CHUNKS = 16
#: Bits of a set's bitmap, and of that of a set of more than ``LARGE`` shingles.
BITS, WIDE, LARGE = 2048, 16384, 1024
#: Postings a bucket is planned for; those of so many groups are packed together.
BUCKET_POSTINGS = 400_000
PACK_GROUPS = 4096
#: Members of a list that one block of the last round holds, and postings of one of its tasks.
BLOCK = 2048
CROSS_POSTINGS = 200_000
#: Rounds with hubs before the last one.
ROUNDS = 2
#: Text that a task takes apart at a time.
TEXT_BYTES = 2 << 20
#: Pairs up to which their bitmaps are sent to every task.
FEW = 50_000


def min_overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The fewest common shingles of a set of size ``n`` with any set it links to."""
    return -(-num * n // den)


def pair_overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The fewest common shingles at which sets of sizes a and b link: den * x >= num * (a + b - x)."""
    return -(-num * (a + b) // (num + den))


def sets_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of every text, ascending, and where each text's begin)."""
    hashes, first = Words(column).windows(width)
    text = np.repeat(np.arange(len(column)), np.diff(first))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[fresh], text[fresh]
    return hashes, np.searchsorted(text, np.arange(len(column) + 1))


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 per text."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")


# ---- the global order ------------------------------------------------------------------------


def shingle_counts(source: DataFrame, width: int) -> np.ndarray:
    """Counts of shingles by hashed counter over all texts. Tasks count on their own; equal chunks of their
    counts are added in two steps, so that no task adds up more than a few hundred of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches, "text", TEXT_BYTES):
            hashes, _ = sets_of(batch.column("text"), width)
            counts += np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        part = TaskContext.get().partitionId() % 256
        held = counts.astype("<u4").reshape(_CHUNKS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * _CHUNKS, pa.int32()), pa.array(range(_CHUNKS), pa.int32()),
             pa.array([c.tobytes() for c in held], pa.binary())],
            ["part", "chunk", "counts"],
        )

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // _CHUNKS, np.uint32)
        for raw in rows.column("counts"):
            total += np.frombuffer(raw.as_buffer(), "<u4")
        return pa.table({
            "part": rows.column("part")[:1], "chunk": rows.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())
        })

    schema = "part int, chunk int, counts binary"
    parts = source.select("text").mapInArrow(count, schema)
    sums = parts.groupBy("chunk", "part").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    chunks = {r["chunk"]: np.frombuffer(r["counts"], "<u4") for r in sums.collect()}  # 4 MB in all
    return np.concatenate([chunks[i] for i in range(_CHUNKS)]) if chunks else np.zeros(COUNTERS, np.uint32)


# ---- documents ---------------------------------------------------------------------------------


def document_sets(source: DataFrame, counts, width: int, num: int, den: int, prefixes: bool) -> DataFrame:
    """(doc_id, n, p1, p2) and either the prefix or (d1, d2, bitmap): set size, 128-bit digests of the prefix and
    of the whole set, the first shingles in the global order, and a parity bitmap of the set. Documents without
    shingles have n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in slices(batches, "text", TEXT_BYTES):
            hashes, first = sets_of(batch.column("text"), width)
            n = np.diff(first)
            text = np.repeat(np.arange(len(n)), n)
            size = np.where(n > 0, n - min_overlap(n, num, den) + 1, 0)
            order = np.lexsort((hashes, table[(hashes >> np.uint64(44)).astype(np.int64)], text))
            ordered = hashes[order]
            inside = np.arange(len(ordered)) - first[text] < size[text]
            ends = np.concatenate([[0], np.cumsum(size)])
            head = ordered[inside]
            out = {
                "doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()),
                "p1": pa.array(_summed(mix64(head + np.uint64(3)), ends).view(np.int64)),
                "p2": pa.array(_summed(mix64(head ^ np.uint64(0x5A5A5A5A5A5A5A5A)), ends).view(np.int64)),
            }
            if prefixes:
                held = [head[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                out["prefix"] = pa.array(held, pa.binary())
            else:
                out["d1"] = pa.array(_summed(mix64(hashes + np.uint64(1)), first).view(np.int64))
                out["d2"] = pa.array(_summed(mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first).view(np.int64))
                out["bitmap"] = pa.array(_bitmaps(hashes, first), pa.binary())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kept = "prefix binary" if prefixes else "d1 bigint, d2 bigint, bitmap binary"
    return source.mapInArrow(run, f"doc_id bigint, n bigint, p1 bigint, p2 bigint, {kept}")


def _bitmaps(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A parity bitmap of every text's set, some texts at a time. Folding a wide one gives the narrow one of the set."""
    out: list[bytes] = [b""] * (len(first) - 1)
    size = np.diff(first)
    for bits, chosen in ((BITS, np.flatnonzero(size <= LARGE)), (WIDE, np.flatnonzero(size > LARGE))):
        for at in range(0, len(chosen), (1 << 19) // bits):
            some = chosen[at: at + (1 << 19) // bits]
            n = size[some]
            ends = np.cumsum(n)
            members = hashes[np.repeat(first[some] - ends + n, n) + np.arange(ends[-1])]
            bit = np.repeat(np.arange(len(some)), n) * bits + (mix64(members + np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64)
            odd = (np.bincount(bit, minlength=len(some) * bits) & 1).astype(np.uint8)
            for i, m in zip(some.tolist(), np.packbits(odd.reshape(-1, bits), axis=1, bitorder="little"), strict=True):
                out[i] = m.tobytes()
    return out


class Bitmaps:
    """The bitmaps of a column: all of them narrow (wide ones folded), and the wide ones as they are."""

    def __init__(self, column):
        raw = column.to_pylist()
        self.wide = np.array([len(m) > BITS // 8 for m in raw], bool)
        self.slot = np.cumsum(self.wide) - 1
        self.large = np.frombuffer(b"".join(m for m in raw if len(m) > BITS // 8), "<u8").reshape(-1, WIDE // 64)
        self.small = np.zeros((len(raw), BITS // 64), np.uint64)
        self.small[~self.wide] = np.frombuffer(b"".join(m for m in raw if len(m) <= BITS // 8), "<u8").reshape(-1, BITS // 64)
        if len(self.large):
            self.small[self.wide] = np.bitwise_xor.reduce(self.large.reshape(-1, WIDE // BITS, BITS // 64), axis=1)


def bits_that_differ(x: Bitmaps, i: np.ndarray, y: Bitmaps, j: np.ndarray) -> np.ndarray:
    out = np.bitwise_count(x.small[i] ^ y.small[j]).sum(axis=1, dtype=np.int64)
    both = np.flatnonzero(x.wide[i] & y.wide[j])
    for at in range(0, len(both), 4096):
        k = both[at: at + 4096]
        out[k] = np.bitwise_count(x.large[x.slot[i[k]]] ^ y.large[y.slot[j[k]]]).sum(axis=1, dtype=np.int64)
    return out


# ---- posting lists -------------------------------------------------------------------------------


_PACK = "bucket int, token binary, of binary, place binary, v binary, n binary"
_POSTING = "token bigint, v bigint, n bigint, place bigint"


def packed_postings(groups: DataFrame, n_buckets: int) -> DataFrame:
    """Postings of ``groups`` (v, n, prefix) in packs of arrays, dealt to buckets by shingle. A shingle that several
    groups of a pack have is known to be shared: its postings go straight through (to a bucket number beyond
    ``n_buckets``), and only one of them, as a witness of place -1, to the shingle's own bucket. So a shingle
    that a third of all groups have does not fill one bucket."""

    def pack(rows: list[tuple], turn: int) -> pa.RecordBatch:
        prefixes = [np.frombuffer(r[2], "<u8") for r in rows]
        size = np.array([len(p) for p in prefixes])
        token = np.concatenate(prefixes)
        of = np.repeat(np.arange(len(rows)), size)
        place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
        order = np.argsort(token, kind="stable")
        token, of, place = token[order], of[order], place[order]
        start = np.flatnonzero(np.diff(token, prepend=token[0] ^ np.uint64(1)))
        many = np.repeat(np.diff([*start, len(token)]) > 1, np.diff([*start, len(token)]))
        bucket = (mix64(token) % np.uint64(n_buckets)).astype(np.int64)
        witness = start[many[start]]
        token, of, place = (np.concatenate([x, x[witness]]) for x in (token, of, place))
        place[len(many):] = -1
        bucket = np.concatenate([np.where(many, n_buckets + turn % n_buckets, bucket), bucket[witness]])
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        v, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        cols: list[list] = [[] for _ in range(6)]
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            at = order[a:b]
            here, local = np.unique(of[at], return_inverse=True)
            values = (int(bucket[at[0]]), token[at].tobytes(), local.astype("<u2").tobytes(), place[at].astype("<i4").tobytes(),
                      v[here].tobytes(), n[here].astype("<i4").tobytes())
            for col, value in zip(cols, values, strict=True):
                col.append(value)
        types = [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                          [c.split()[0] for c in _PACK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("v", "n", "prefix")], strict=True))
            for at in range(0, len(rows), PACK_GROUPS):
                yield pack(rows[at: at + PACK_GROUPS], turn)
                turn += 1

    return groups.select("v", "n", "prefix").mapInArrow(run, _PACK)


def shared_postings(packs: DataFrame, n_buckets: int) -> DataFrame:
    """(token, v, n, place): the postings of shingles that at least two groups have."""

    def find(rows: pa.Table) -> pa.Table:
        token, v, n, place = [], [], [], []
        for r in rows.to_pylist():
            of = np.frombuffer(r["of"], "<u2")
            token.append(np.frombuffer(r["token"], "<u8"))
            v.append(np.frombuffer(r["v"], "<i8")[of])
            n.append(np.frombuffer(r["n"], "<i4")[of])
            place.append(np.frombuffer(r["place"], "<i4"))
        token, v, n, place = (np.concatenate(x) for x in (token, v, n, place))
        if rows.column("bucket")[0].as_py() < n_buckets:
            order = np.argsort(token, kind="stable")
            token, v, n, place = token[order], v[order], n[order], place[order]
            start = np.flatnonzero(np.diff(token, prepend=token[0] ^ np.uint64(1)))
            size = np.diff([*start, len(token)])
            shared = (size > 1) | (np.minimum.reduceat(place, start) < 0)
            keep = np.repeat(shared, size) & (place >= 0)
            token, v, n, place = token[keep], v[keep], n[keep], place[keep]
        return pa.table({"token": token.view(np.int64), "v": v, "n": n.astype(np.int64), "place": place.astype(np.int64)})

    return packs.groupBy("bucket").applyInArrow(find, _POSTING)


def possible(na, place_a, nb, place_b, num: int, den: int):
    """SQL or numpy: whether sets of these sizes, whose prefixes meet at these places, can still link: by size, and
    by what can stand before and behind the common shingle on both sides."""
    less = np.minimum if isinstance(na, np.ndarray) else F.least
    more = np.maximum if isinstance(na, np.ndarray) else F.greatest
    most = less(place_a, place_b) + less(na - place_a, nb - place_b)
    return (den * less(na, nb) >= num * more(na, nb)) & ((num + den) * most >= num * (na + nb))


def bitmaps_allow(differ: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sets whose bitmaps differ in d bits differ in d shingles at least, so they share (na + nb - d) / 2 at most."""
    return (num + den) * ((na + nb - differ) // 2) >= num * (na + nb)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh]


def hub_pairs(lists: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """(a, b): every member that lies in another component than the hub of one of its lists, with one such hub: the one it
    meets in most lists, so a round asks for no more pairs than there are members. The first round's hub of a list is the
    smallest set, later ones are drawn."""
    key = F.col("n") if turn == 0 else F.xxhash64("v", F.lit(turn))
    hubs = lists.groupBy("token").agg(
        F.min(F.struct(key.alias("k"), "v", "n", "place", "comp")).alias("h"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")
    ).filter("_lo <> _hi").select("token", *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("v", "n", "place", "comp")])
    met = lists.join(hubs, "token").filter("comp <> h_comp").filter(
        possible(F.col("n"), F.col("place"), F.col("h_n"), F.col("h_place"), num, den)
    )
    often = met.filter("v <> h_v").groupBy("v", "h_v").agg(F.count("*").alias("k"))
    best = often.groupBy("v").agg(F.max(F.struct("k", "h_v")).alias("m")).select("v", F.col("m.h_v").alias("h_v"))
    return best.select(F.least("v", "h_v").alias("a"), F.greatest("v", "h_v").alias("b")).distinct()


def cross_pairs(lists: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): all pairs of a list that lie in different components and pass every filter. Long lists are cut into
    blocks, and two blocks at a time meet in a task."""
    mixed = cut(lists.groupBy("token").agg(F.count("*").alias("_k"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter(
        "_lo <> _hi"
    ).select("token", "_lo", "_k", F.ceil(F.col("_k") / BLOCK).cast("int").alias("_m")))
    # lists around one component share most of their members: they go to one bucket, or to as many as they fill
    fill = mixed.groupBy("_lo").agg(F.ceil(F.sum("_k") / CROSS_POSTINGS).alias("_salts"))
    mixed = mixed.join(small(cut(fill)), "_lo").select("token", "_m", F.xxhash64("_lo", F.pmod("token", "_salts")).alias("_key"))
    mixed = small(cut(mixed))
    i, j = F.col("_i"), F.col("_j")
    dealt = (
        lists.join(mixed, "token").withColumn("_i", F.pmod(F.xxhash64("v"), F.col("_m")).cast("int"))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        .select(
            F.when(F.col("_m") == 1, F.col("token")).otherwise(F.xxhash64("token", F.least(i, j), F.greatest(i, j))).alias("list"),
            F.when(F.col("_m") == 1, F.col("_key")).otherwise(F.xxhash64("token", F.least(i, j), F.greatest(i, j))).alias("key"),
            "v", "n", "place", "comp", F.when(i == j, -1).when(i < j, 0).otherwise(1).alias("side"),
        )
    )
    dealt = cut(dealt)
    n_buckets = dealt.count() // CROSS_POSTINGS + 1
    dealt = dealt.withColumn("bucket", F.pmod("key", F.lit(n_buckets)).cast("int")).drop("key")
    # an id with several texts has several sets: a member is told by id and size, and where even that is not one set,
    # its bitmaps rule nothing out
    held = dealt.select(F.col("bucket").alias("of"), F.col("v").alias("id"), F.col("n").alias("size")).distinct().join(
        nodes.select(F.col("v").alias("id"), F.col("n").alias("size"), "bitmap"), ["id", "size"]
    ).select("of", "id", "size", "bitmap")

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        found = [(none, none)]
        if left.num_rows:
            lst, v, n, place, comp, side = (
                np.asarray(left.column(c)) for c in ("list", "v", "n", "place", "comp", "side")
            )
            ids, sizes, maps = np.asarray(right.column("id")), np.asarray(right.column("size")), Bitmaps(right.column("bitmap"))
            known = np.unique(ids)
            span = int(sizes.max()) + 1
            code = np.searchsorted(known, ids) * span + sizes
            by = np.argsort(code)
            row = by[np.searchsorted(code[by], np.searchsorted(known, v) * span + n)]
            many = np.zeros(len(ids), bool)
            many[by[:-1]] |= code[by[1:]] == code[by[:-1]]
            many[by[1:]] |= code[by[1:]] == code[by[:-1]]
            order = np.lexsort((n, lst))
            lst, row, n, place, comp, side = (x[order] for x in (lst, row, n, place, comp, side))
            size = np.diff([*np.flatnonzero(np.diff(lst, prepend=lst[0] - 1)), len(lst)])
            waiting: list[tuple[np.ndarray, np.ndarray]] = []

            def settle() -> None:
                a, b = _distinct(*(np.concatenate([x[k] for x in waiting]) for k in (0, 1)))
                waiting.clear()
                for at in range(0, len(a), 1 << 15):
                    x, y = a[at: at + (1 << 15)], b[at: at + (1 << 15)]
                    ok = bitmaps_allow(bits_that_differ(maps, x, maps, y), sizes[x], sizes[y], num, den) | many[x] | many[y]
                    found.append((x[ok], y[ok]))

            for gap in range(1, int(size.max())):
                # each member looks ahead only as far as set sizes still fit
                a = np.flatnonzero((lst[gap:] == lst[:-gap]) & (den * n[:-gap] >= num * n[gap:]))
                if not len(a):
                    break
                b = a + gap
                ok = (comp[a] != comp[b]) & ((side[a] < 0) | (side[a] != side[b]))
                ok &= possible(n[a], place[a], n[b], place[b], num, den)
                a, b = row[a[ok]], row[b[ok]]
                waiting.append((np.minimum(a, b), np.maximum(a, b)))
                if sum(len(x) for x, _ in waiting) > 500_000:
                    settle()
            if waiting:
                settle()
            a, b = _distinct(*(np.concatenate([x[k] for x in found]) for k in (0, 1)))
            found = [(np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]))]
        return pa.table({"a": pa.array(found[0][0], pa.int64()), "b": pa.array(found[0][1], pa.int64())})

    met = dealt.groupBy("bucket").cogroup(held.groupBy("of")).applyInArrow(pairs, "a bigint, b bigint")
    return met.distinct()


# ---- verification --------------------------------------------------------------------------------


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()


def bitmap_filter(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (kept in the shared folder) whose bitmaps do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (np.asarray(batch.column(c)) for c in ("na", "nb"))
                every = np.arange(batch.num_rows)
                differ = bits_that_differ(Bitmaps(batch.column("ma")), every, Bitmaps(batch.column("mb")), every)
                ok = bitmaps_allow(differ, na, nb, num, den)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    ends = _ends(pairs)
    few = fits(pairs, FEW)
    near = cut(nodes.select("v", "n", "bitmap").join(F.broadcast(ends) if few else ends, "v", "left_semi"))
    left = near.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma"))
    right = near.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb"))
    if few:
        left, right = small(left, FEW), small(right, FEW)
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint")


def whole_sets(source: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(v, sets): the whole sets of the documents with the ``needed`` ids. An id that repeats with several texts has
    several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            hashes, first = sets_of(batch.column("text"), width)
            held = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), held], ["v", "members"])

    found = source.join(small(needed.withColumnRenamed("v", "doc_id")), "doc_id", "left_semi").mapInArrow(
        run, "v bigint, members array<bigint>"
    )
    return found.filter("size(members) > 0").groupBy("v").agg(F.collect_set("members").alias("sets"))


def verified(pairs: DataFrame, source: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs that link, by their whole sets. Rows of one id are one document, so two ids link if two of their
    sets do."""
    needed = cut(_ends(pairs))
    sets = whole_sets(source, needed, width)
    left = sets.select(F.col("v").alias("a"), F.col("sets").alias("_x"))
    right = sets.select(F.col("v").alias("b"), F.col("sets").alias("_y"))

    def link(x: Column, y: Column) -> Column:
        common = F.size(F.array_intersect(x, y))
        return den * common >= num * (F.size(x) + F.size(y) - common)

    both = pairs.join(left, "a").join(right, "b")
    return both.filter(F.exists("_x", lambda x: F.exists("_y", lambda y: link(x, y)))).select("a", "b")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a bounded count shows that it is small, else as it is."""
    return F.broadcast(df) if fits(df, rows) else df


# ---- components --------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) of every end of ``edges`` (a, b): the smallest id reachable. Labels go to neighbours and then
    jump to their label's label, until none changes."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("comp")))
    while True:
        of = small(labels)
        met = both.join(of.select(F.col("v").alias("b"), F.col("comp").alias("_c")), "b").select("a", "_c")
        own = labels.select(F.col("v").alias("a"), F.col("comp").alias("_c"))
        step = met.union(own).groupBy(F.col("a").alias("v")).agg(F.min("_c").alias("_c"))
        jump = of.select(F.col("v").alias("_c"), F.col("comp").alias("_up"))
        moved = step.join(jump, "_c", "left").select("v", F.least("_c", F.coalesce("_up", "_c")).alias("comp"))
        new = cut(moved)
        changed = new.join(small(labels.withColumnRenamed("comp", "_old")), "v").filter("comp <> _old")
        labels = new
        if is_empty(changed):
            return labels


def merged_labels(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``labels`` after ``edges`` have been added: only the edges between components are walked."""
    if labels is None:
        return components(edges)
    known = small(labels)
    ends = edges
    for end in ("a", "b"):
        ends = ends.join(known.select(F.col("v").alias(end), F.col("comp").alias(f"_{end}")), end, "left")
    ends = ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a <> b").distinct()
    moved = components(ends)
    up = small(moved).select(F.col("v").alias("comp"), F.col("comp").alias("_up"))
    old = labels.join(up, "comp", "left").select("v", F.coalesce("_up", "comp").alias("comp"))
    return cut(old.union(moved.join(small(labels.select("v")), "v", "left_anti")))


# ---- the operator ------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    A text's set holds its distinct ``width``-word shingles (A-Z lower-cased); a text of fewer words is one
    shingle, a text without words or a null one has none and links with nothing. Two documents link when
    den * |common| >= num * |union|. ``component_id`` is the smallest id reachable by links.

    Rows with equal sets are linked. Rows that repeat an id are one document, so their components are one as
    well. Rows without an id take no part: they get their set size and a null component. An empty table gives
    no rows; other columns are not read. Shingles are compared as 64-bit hashes, sets of one table as 128-bit ones.
    """
    spark = docs.sparkSession
    source = _slim(docs, id_col, text_col)
    counts = spark.sparkContext.broadcast(shingle_counts(source, width))
    rows = cut(document_sets(source, counts, width, num, den, prefixes=False))

    # nodes: equal sets; the smallest id stands for them. Groups: equal prefix and size
    sets = ["n", "d1", "d2"]
    known = rows.filter("n > 0 and doc_id is not null")
    nodes = cut(known.groupBy(*sets).agg(
        F.min("doc_id").alias("v"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("bitmap").alias("bitmap")
    ))
    like = nodes.groupBy("n", "p1", "p2").agg(F.min("v").alias("g"), F.count("*").alias("_many")).filter("_many > 1")
    members = cut(nodes.select("n", "p1", "p2", "v").join(like, ["n", "p1", "p2"]).select("g", "v", "n", "p1"))

    groups = (
        document_sets(source, counts, width, num, den, prefixes=True).filter("n > 0 and doc_id is not null")
        .groupBy("n", "p1", "p2").agg(F.min(F.struct("doc_id", "prefix")).alias("_m")).select("n", "_m.doc_id", "_m.prefix")
        .withColumnRenamed("doc_id", "v")
    )
    postings = nodes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    n_buckets = int(postings) // BUCKET_POSTINGS + 1
    shared = shared_postings(packed_postings(groups, n_buckets), n_buckets)
    # a list's groups are expanded to their members; a group of several nodes is a list of its own as well
    whole = shared.withColumnRenamed("v", "g").join(small(members.select("g", "v")), "g", "left").select(
        "token", F.coalesce("v", "g").alias("v"), "n", "place"
    )
    lists = cut(whole.union(members.select(F.col("p1").alias("token"), "v", "n", F.lit(0).cast("bigint").alias("place"))))

    # an id that repeats with several sets is one document
    owner = known.select("doc_id", *sets).distinct().join(nodes.select("v", *sets), sets)
    several = owner.groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("b")).filter("a <> b").select("doc_id", "a")
    same = cut(owner.join(small(cut(several)), "doc_id").select("a", F.col("v").alias("b")).filter("a <> b"))
    labels = None if is_empty(same) else components(same)
    asked = None
    lists = lists.withColumn("comp", F.col("v")) if labels is None else _mixed(lists, labels)
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pairs = bitmap_filter(cut(hub_pairs(lists, turn, num, den)), nodes, num, den)
        else:
            pairs = cross_pairs(lists, nodes, num, den)
        if asked is not None:
            pairs = pairs.join(small(asked), ["a", "b"], "left_anti")
        pairs = cut(pairs)
        asked = pairs if asked is None else asked.union(pairs)
        found = cut(verified(pairs, source, width, num, den))
        if not is_empty(found):
            labels = merged_labels(labels, found)
        if turn < ROUNDS and labels is not None:
            lists = _mixed(lists, labels)
            if is_empty(lists):
                break

    own = rows.select("doc_id", *sets).join(nodes.select("v", *sets), sets, "left")
    own = own.join(small(labels), "v", "left") if labels is not None else own.withColumn("comp", F.col("v"))
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("comp", "v")).otherwise(F.col("doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold more than one component, with their members' components."""
    placed = lists.drop("comp").join(small(labels), "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo <> _hi").select("token")
    return cut(placed.join(small(cut(mixed)), "token", "left_semi"))


def keep_first(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns. Documents without
    shingles or without an id stay. Of rows that repeat an id all stay or go together."""
    mark = "_gone" + "_" * max(len(n) for n in docs.columns)
    found = near_duplicates(docs, width, num, den).filter("doc_id <> component_id").select(F.col("doc_id").alias(mark)).distinct()
    found = cut(found)
    on = docs["doc_id"].cast("bigint") == F.col(mark)
    return docs.join(F.broadcast(found) if fits(found) else found, on, "left_anti")
