"""Token ids as packed matrices: best-fit-decreasing with a segment tree, written as binary columns.

A task tokenises its documents and packs them in blocks of about ``block_tokens`` tokens, so nothing is
shuffled and a task holds one block. Within a block the pieces are placed longest first, each into the open
sequence with the least room that suffices; a segment tree over room finds it in log(capacity) steps. Documents
longer than a sequence are split without loss; a split document's pieces carry the place they begin at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from palimpsest.llm.bpe import load, vocabulary
from palimpsest.llm.common import bounded_batches, slices

SCHEMA = (
    "sequence_id bigint, n_tokens int, n_pieces int, input_ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<bigint>, doc_starts array<bigint>"
)


class RoomTree:
    """Open sequences by the room they have left: ``take(n)`` gives one with the least room of at least n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, sequence: int, room: int) -> None:
        self.held[room].append(sequence)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        node = least + self.size
        if not self.count[node]:
            # up to the first right neighbour that holds something, then down its left side
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.held[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``lengths`` by sequence; every length lies between 1 and ``capacity``."""
    tree, out = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = len(out), capacity
            out.append([])
        sequence, room = found
        out[sequence].append(i)
        tree.put(sequence, room - lengths[i])
    return out


def packed_matrices(
    docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1, pad_id: int = 0,
    block_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per packed sequence.

    ``input_ids``: ``capacity`` little-endian ids (16 bits each if the vocabulary allows, else 32), ``pad_id`` behind
    the ``n_tokens`` that count. ``cu_seqlens``: where pieces begin, and the end, from 0. ``position_ids``:
    little-endian 16-bit places (32-bit beyond a capacity of 65,536) that begin at 0 with every piece; padding has 0. ``doc_ids``, ``doc_starts``: each
    piece's document and its place in it. A document is its ids and ``end_id``; null text is the empty one.
    Repeated rows are packed as often as they stand there, an empty table gives no rows, and columns besides
    id and text are not read. ``sequence_id`` is the task's number and a count, so a task that is run again
    after the loss of an executor gives the same rows.
    """
    path = path or vocabulary()
    width = "<u2" if capacity <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        dtype = np.dtype(bpe.wide).newbyteorder("<")
        number = TaskContext.get().partitionId() << 33
        place = np.arange(capacity, dtype=width)

        def packed(block: list[tuple[int | None, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            bins = best_fit_decreasing([len(ids) for _, _, ids in block], capacity)
            for at in range(0, len(bins), 256):
                cols: list[list] = [[] for _ in range(8)]
                for members in bins[at: at + 256]:
                    ids, position, ends = np.full(capacity, pad_id, dtype), np.zeros(capacity, width), [0]
                    for i in members:
                        part, start = block[i][2], ends[-1]
                        ends.append(start + len(part))
                        ids[start: ends[-1]] = part
                        position[start: ends[-1]] = place[: len(part)]
                    row = (number, ends[-1], len(members), ids.tobytes(), ends, position.tobytes(),
                           [block[i][0] for i in members], [block[i][1] for i in members])
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
                    number += 1
                types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(),
                         pa.list_(pa.int64()), pa.list_(pa.int64()))
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        block, held = [], 0
        for batch in slices(batches, "text"):
            texts = bpe.encode_column(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.append(ids.astype(dtype), np.array([end_id], dtype))
                for at in range(0, len(ids), capacity):
                    block.append((doc_id, at, ids[at: at + capacity]))
                held += len(ids)
                if held >= block_tokens:
                    yield from packed(block)
                    block, held = [], 0
        yield from packed(block)

    source = bounded_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    return source.mapInArrow(run, SCHEMA)


def write_matrices(packed: DataFrame, folder: str) -> None:
    """The binary output: the packed rows as Parquet files."""
    packed.write.mode("errorifexists").parquet(folder)


def read_documents(packed: DataFrame) -> DataFrame:
    """The way back: (doc_id, start, ids array<int>) of every piece, cut out of the matrices again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, ids = [], [], []
            for row in batch.to_pylist():
                ends = row["cu_seqlens"]
                wide = len(row["input_ids"]) // (len(row["position_ids"]) // 2)
                matrix = np.frombuffer(row["input_ids"], "<u2" if wide == 2 else "<u4").astype(np.int32)
                doc += row["doc_ids"]
                start += row["doc_starts"]
                ids += [matrix[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                ["doc_id", "start", "ids"],
            )

    return packed.mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")
