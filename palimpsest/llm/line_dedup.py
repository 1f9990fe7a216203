"""Lines that many documents share, found through sharded minimal perfect hashes.

Long enough lines become 128-bit hashes of their keys, one per document. Their documents are counted, and the
hashes found in enough documents are dealt to shards. Each shard is one row: a minimal perfect hash over its
distinct line hashes, and three arrays that it indexes: a 64-bit fingerprint, the number of documents, and the
document that keeps the line. Documents then probe the arrays; lines are not joined.

Up to ``PROBE_KEYS`` counted hashes the shards go to every task and texts are not moved at all. Beyond that,
line hashes (no texts) go to the shards, salted so that no line gathers in one task, and the few that are found
come back to their documents. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import Words, bounded_batches, mix64, slices
from palimpsest.plans.lineage import cut

#: Hashes that one shard holds on average.
SHARD_KEYS = 1 << 17
#: So many counted hashes at most are sent to every task: about 21 bytes each.
PROBE_KEYS = 4_000_000
#: Line hashes that one task probes on the way beyond that.
PROBE_ROWS = 500_000
_STEP = 0x9E3779B97F4A7C15


class PerfectHash:
    """Minimal perfect hash over distinct 128-bit keys, given as two uint64 arrays.

    Level by level, every key left sets a bit; bits set by exactly one key stay, the other keys go on to the
    next level. A key's index is the number of set bits before its own. A key that was not put in gives either
    -1 or some index, so callers compare a fingerprint."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        base = 0
        while len(a):
            words = len(a) // 32 + 1  # two bits a key
            at = self._place(a, b, len(self.levels), words)
            hits = np.bincount(at, minlength=words * 64)
            once = hits == 1
            bits = np.packbits(once, bitorder="little").view("<u8")
            before = np.cumsum(np.bitwise_count(bits).astype(np.int64)) - np.bitwise_count(bits)
            self.levels.append((bits, before + base, words))
            base += int(once.sum())
            again = ~once[at]
            a, b = a[again], b[again]
        self.size = base

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, words: int) -> np.ndarray:
        turn = np.uint64((level + 1) * _STEP & (2**64 - 1))
        return (mix64(a ^ mix64(b + turn)) % np.uint64(words * 64)).astype(np.int64)

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (bits, before, words) in enumerate(self.levels):
            at = self._place(a[left], b[left], level, words)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = before[at[hit] >> 6] + below[hit]
            left = left[~hit]
        return out


class Shard:
    """A perfect hash and the arrays it indexes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_docs: np.ndarray, keeper: np.ndarray):
        self.hash = PerfectHash(a, b)
        order = self.hash.index(a, b)
        self.print = np.empty(len(a), np.uint64)
        self.n_docs = np.empty(len(a), np.uint32)
        self.keeper = np.empty(len(a), np.int64)
        self.print[order], self.n_docs[order], self.keeper[order] = b, n_docs.clip(max=2**32 - 1), keeper

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        levels = {f"{k}{i}": x for i, level in enumerate(self.hash.levels) for k, x in zip("be", level[:2], strict=True)}
        np.savez(out, print=self.print, n_docs=self.n_docs, keeper=self.keeper, **levels)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Shard":
        held = np.load(io.BytesIO(raw))
        new = cls.__new__(cls)
        new.print, new.n_docs, new.keeper = held["print"], held["n_docs"], held["keeper"]
        new.hash = PerfectHash.__new__(PerfectHash)
        n = sum(k.startswith("b") for k in held.files)
        new.hash.levels = [(held[f"b{i}"], held[f"e{i}"], len(held[f"b{i}"])) for i in range(n)]
        new.hash.size = len(new.print)
        return new

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is held, the document that keeps it)"""
        at = self.hash.index(a, b)
        safe = np.maximum(at, 0)
        if not len(self.print):
            return np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        return (at >= 0) & (self.print[safe] == b), self.keeper[safe]


# ---- lines of a slice --------------------------------------------------------------------------


class Lines:
    """All lines of the texts of a column; the hashes of those whose key has ``min_chars`` code points."""

    def __init__(self, column: pa.Array, min_chars: int):
        words = Words(column)
        data, offsets = words.data, words.offsets
        breaks = np.flatnonzero(data == 10)
        per_text = np.searchsorted(breaks, offsets)
        self.count = np.diff(per_text) + 1  # lines of every text
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        # a text's line k ends at its k-th line feed, its last one at its end
        end = np.empty(self.first[-1], np.int64)
        last = self.first[1:] - 1
        inner = np.ones(len(end), bool)
        inner[last] = False
        end[inner], end[last] = breaks, offsets[1:]
        begin = np.empty(len(end), np.int64)
        begin[self.first[:-1]] = offsets[:-1]
        begin[1:][inner[:-1]] = end[:-1][inner[:-1]] + 1
        lo, hi = np.searchsorted(words.start, begin), np.searchsorted(words.start, end)
        some = np.flatnonzero(lo < hi)
        a, b = words.start[lo[some]], words.end[hi[some] - 1]
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long_ = points[b] - points[a] >= min_chars
        self.line, a, b = some[long_], a[long_], b[long_]
        raw = data.tobytes()
        digest = b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        halves = np.frombuffer(digest, ">u8").astype(np.uint64).reshape(-1, 2)
        self.a, self.b = halves[:, 0], halves[:, 1]
        self.text = np.searchsorted(self.first, self.line, side="right") - 1


def line_hashes(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, a, b): the hashes of a document's long enough lines, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines = Lines(batch.column("text"), min_chars)
            key = np.stack([lines.text.astype(np.uint64), lines.a, lines.b], axis=1)
            key = np.unique(key, axis=0) if len(key) else key
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(key[:, 0].astype(np.int64))),
                    pa.array(key[:, 1].astype(np.int64)), pa.array(key[:, 2].astype(np.int64)),
                ],
                ["doc_id", "a", "b"],
            )

    source = bounded_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    return source.mapInArrow(run, "doc_id bigint, a bigint, b bigint")


def _unsigned(col) -> np.ndarray:
    return np.asarray(col, dtype=np.int64).view(np.uint64)


def build_shards(shared: DataFrame, n_shards: int) -> DataFrame:
    """(shard, arrays): ``shared`` has distinct (a, b) with n_docs and keeper."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = Shard(_unsigned(rows.a), _unsigned(rows.b), rows.n_docs.to_numpy(), rows.keeper.to_numpy())
        return pd.DataFrame({"shard": [int(rows.shard.iloc[0])], "arrays": [made.to_bytes()]})

    dealt = shared.withColumn("shard", F.pmod("a", F.lit(n_shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, arrays binary")


def _probe(table: dict[int, Shard], n_shards: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held, keeper = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    shard = a.view(np.int64) % n_shards
    for k in np.unique(shard).tolist():
        if k in table:
            at = np.flatnonzero(shard == k)
            held[at], keeper[at] = table[k].probe(a[at], b[at])
    return held, keeper


_OPENED: list = [None, {}]


def _opened(sent) -> dict[int, Shard]:
    """The shards of a broadcast, opened once per worker."""
    if _OPENED[0] is not sent:
        _OPENED[:] = [sent, {k: Shard.from_bytes(raw) for k, raw in sent.value.items()}]
    return _OPENED[1]


# ---- the operator --------------------------------------------------------------------------------


def dedup_lines(
    docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text",
    digest: bool = False, probe_keys: int = PROBE_KEYS,
) -> DataFrame:
    """Takes repeated lines out of the texts.

    A line's key is the line without white space at both ends, A-Z lower-cased. A key of at least ``min_chars``
    code points found in at least ``min_docs`` documents (distinct ids) loses its lines everywhere but in the
    largest id that holds it; that document keeps all its copies. Other lines stay, joined by line feeds.

    Returns ``docs`` with the new text, or with ``digest`` (doc_id, n_lines, n_dropped, kept_sha256), with the
    counts in columns n_lines and n_dropped where ``docs`` has no columns of these names. A null text is one
    empty line and stays null in ``docs``; its digest is that of ''. Repeated rows with one id are one document,
    rows without an id belong to none and keep no repeated line. Empty tables and other columns pass through.
    """
    spark = docs.sparkSession
    hashes = line_hashes(docs, min_chars, id_col, text_col)
    shared = cut(
        hashes.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )
    n_keys = shared.count()
    n_shards = n_keys // SHARD_KEYS + 1
    shards = build_shards(shared, n_shards)
    names = docs.columns
    inputs: list[str] = []
    if n_keys <= probe_keys:
        # at most PROBE_KEYS hashes, about 21 bytes each
        sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["arrays"]) for r in shards.collect()})
        found, rows = None, docs
    else:
        sent = None
        found = "_found" + "_" * max(len(n) for n in names)  # a name that ``docs`` has not
        rows = _with_found(docs, hashes, shards, n_shards, id_col, found)

    if not digest:
        inputs = rows.columns  # columns go by number on the way in, whatever characters their names have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _opened(sent) if sent is not None else None
        for batch in batches if not inputs else (b.rename_columns(inputs) for b in batches):
            yield from one(batch, table)

    def one(whole: pa.RecordBatch, table) -> Iterator[pa.RecordBatch]:
        for batch in slices([whole], text_col):
            column, ids = batch.column(text_col), batch.column(id_col).cast(pa.int64())
            lines = Lines(column, min_chars)
            if table is not None:
                held, keeper = _probe(table, n_shards, lines.a, lines.b)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                own = ids.fill_null(0).to_numpy(zero_copy_only=False)
                drop = held & ~(known[lines.text] & (own[lines.text] == keeper))
            else:
                lists = [set(zip(x["a"], x["b"], strict=True)) if x else () for x in batch.column(found).to_pylist()]
                keys = zip(lines.a.view(np.int64).tolist(), lines.b.view(np.int64).tolist(), strict=True)
                drop = np.array([k in lists[t] for k, t in zip(keys, lines.text.tolist(), strict=True)], bool)
            dropped = np.bincount(lines.text[drop], minlength=len(column))
            gone: dict[int, set[int]] = {}
            for t, line in zip(lines.text[drop].tolist(), (lines.line[drop] - lines.first[lines.text[drop]]).tolist(), strict=True):
                gone.setdefault(t, set()).add(line)
            texts = column.to_pylist()
            for t, out in gone.items():
                texts[t] = "\n".join([x for k, x in enumerate(texts[t].split("\n")) if k not in out])
            counts = {"n_lines": pa.array(lines.count, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            if digest:
                shas = [hashlib.sha256((t or "").encode("utf-8")).hexdigest() for t in texts]
                columns = {"doc_id": ids, **counts, "kept_sha256": pa.array(shas, pa.string())}
            else:
                columns = {n: batch.column(n) for n in names}
                columns[text_col] = pa.array(texts, column.type)
                columns |= {n: c for n, c in counts.items() if n not in names}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    if digest:
        keep = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *([F.col(found)] if found else [])]
        return rows.select(*keep).mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")
    counts = [T.StructField(n, T.LongType()) for n in ("n_lines", "n_dropped") if n not in names]
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    return plain.mapInArrow(run, T.StructType([*docs.schema.fields, *counts]))


def _with_found(docs: DataFrame, hashes: DataFrame, shards: DataFrame, n_shards: int, id_col: str, found: str) -> DataFrame:
    """``docs`` with the hashes of the lines each document loses, by way of shards that are too many to send."""
    lines = cut(hashes)
    salts = max(1, -(-lines.count() // (n_shards * PROBE_ROWS)))
    asked = lines.withColumn("shard", F.pmod("a", F.lit(n_shards)).cast("int")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    )
    copies = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(["doc_id", "a", "b"])
        if not right.num_rows or not left.num_rows:
            return left.slice(0, 0)
        a, b = _unsigned(left.column("a")), _unsigned(left.column("b"))
        held, keeper = Shard.from_bytes(right.column("arrays")[0].as_py()).probe(a, b)
        ids = left.column("doc_id")
        known = np.asarray(ids.is_valid())
        own = np.asarray(ids.fill_null(0))
        return left.filter(pa.array(held & ~(known & (own == keeper))))

    hits = asked.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(
        probe, "doc_id bigint, a bigint, b bigint"
    )
    # a document's own lines: as many as its text has
    of = found + "of"
    lists = hits.groupBy(F.col("doc_id").alias(of)).agg(
        F.struct(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")).alias(found)
    )
    return docs.join(lists, docs[id_col].cast("bigint").eqNullSafe(F.col(of)), "left").drop(of)
