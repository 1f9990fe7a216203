"""Repair of conversation structure: the cheapest edits that make the roles read ``(s?(ua)+)?``.

The edit lattice of a conversation has a node for every (rows consumed, state of the role pattern). Two searches meet in
it: one from the start, keeping for every node its cost and least audit so far, one back from the ends, keeping costs and
least audits to come. When the two smallest keys together exceed the best meeting, every node on which an equally cheap
path crosses has been labelled from both sides, and the least concatenated audit is picked among them.

A long conversation is cut into blocks of rows; each block is searched from every state to every state, and the blocks'
best are joined from the last to the first, so the lattice in memory has ``BLOCK`` rows whatever the conversation's length.

Rows are put in order once, by ranges of (conversation, turn, role, beginning of the text), so that a conversation of any
size is sorted by many tasks. What the search needs of a row is one letter. The repaired text's digest chains through
the conversation by its definition: its rows stream, in order, past the audit and into the digest, and are not held.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import WS_RE, bounded_batches
from palimpsest.plans.lineage import cut, fits

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: Rows of one search.
BLOCK = 1 << 10
#: The state after each state's user or assistant row; which of the two it is; the states in which a conversation may end.
#: 0: nothing yet, 1: after the system row, 2: after a user row, 3: after an assistant row.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
ENDS = (0, 3)
STATES = range(4)
#: Role initials and faults of the one letter that stands for a row: ord("A") + 4 * initial + fault.
INITIALS = "sua?"
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)


def _steps(letter: str, state: int) -> list[tuple[int, int, str]]:
    """(state after, cost, initial) of every edit that consumes a row."""
    initial, fault = divmod(ord(letter) - 65, 4)
    out = [(state, DELETE, "D")]
    if fault < BLANK:
        more = CUT_OFF if fault == TRUNCATED else 0
        if INITIALS[initial] == ROLE[state][0]:
            out.append((NEXT[state], KEEP + more, "K"))
        elif state == 0 and INITIALS[initial] == "s":
            out.append((1, KEEP + more, "K"))
        out.append((NEXT[state], REROLE + more, "R"))
    return out


@lru_cache(maxsize=256)
def _edges(letter: str) -> tuple[tuple, tuple]:
    """Of a row: the edits by the state before it, and by the state after it (with the state before)."""
    forth = tuple(tuple(_steps(letter, s)) for s in STATES)
    back = tuple(tuple((s, cost, name) for s in STATES for to, cost, name in forth[s] if to == t) for t in STATES)
    return forth, back


_BEFORE_INSERT = tuple(tuple(s for s in STATES if NEXT[s] == t) for t in STATES)


def search(letters: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """:func:`_search`, whose answers for short row sequences are kept, as most conversations are like others."""
    return (_kept if len(letters) <= 32 else _search)(letters, start, ends)


def _search(letters: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest, then ASCII-least, edits of rows ``letters`` from state ``start`` to one of
    ``ends``, by bidirectional Dijkstra; None where there are none.

    Every letter of an audit fixes the state that follows it, so two equally cheap audits to one node never begin each
    other, and the least audit through a node is its least beginning with its least end. Keys are (cost, rows passed):
    free edits only lead on to the next row, so when a node is taken from a heap no equally cheap audit to it is to come."""
    n = len(letters)
    edges = [_edges(x) for x in letters]
    forth: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    back: dict[tuple[int, int], tuple[int, str]] = {(n, e): (0, "") for e in ends}
    heap_f, heap_b = [(0, 0, start)], [(0, 0, e) for e in ends]
    done_f: set[tuple[int, int]] = set()
    done_b: set[tuple[int, int]] = set()
    best: int | None = None

    def meet(node: tuple[int, int]) -> None:
        nonlocal best
        if node in forth and node in back:
            cost = forth[node][0] + back[node][0]
            if best is None or cost < best:
                best = cost

    def offer(labels, heap, node, cost, audit, passed) -> None:
        held = labels.get(node)
        if held is None or (cost, audit) < held:
            labels[node] = (cost, audit)
            if held is None or cost < held[0]:
                heapq.heappush(heap, (cost, passed, node[1]))
            meet(node)

    for e in ends:
        meet((n, e))
    while heap_f and heap_b and (best is None or heap_f[0][0] + heap_b[0][0] <= best):
        if heap_f[0] <= heap_b[0]:
            cost, i, s = heapq.heappop(heap_f)
            if (i, s) in done_f:
                continue
            done_f.add((i, s))
            audit = forth[i, s][1]
            offer(forth, heap_f, (i, NEXT[s]), cost + INSERT, audit + "I", i)
            if i < n:
                for to, more, name in edges[i][0][s]:
                    offer(forth, heap_f, (i + 1, to), cost + more, audit + name, i + 1)
        else:
            cost, passed, s = heapq.heappop(heap_b)
            i = n - passed
            if (i, s) in done_b:
                continue
            done_b.add((i, s))
            audit = back[i, s][1]
            for of in _BEFORE_INSERT[s]:
                offer(back, heap_b, (i, of), cost + INSERT, "I" + audit, passed)
            if i:
                for of, more, name in edges[i - 1][1][s]:
                    offer(back, heap_b, (i - 1, of), cost + more, name + audit, passed + 1)
    if best is None:
        return None
    return best, min(forth[v][1] + back[v][1] for v in forth.keys() & back.keys() if forth[v][0] + back[v][0] == best)


_kept = lru_cache(maxsize=50_000)(_search)


def repair(blocks: list[str]) -> tuple[int, list[str], list[int]]:
    """(cost, audit of every block, state before every block) of a conversation's rows, given as letters in blocks."""
    if len(blocks) == 1:
        cost, audit = search(blocks[0], 0, ENDS)
        return cost, [audit], [0]
    # from each state before block k: the cost and audit from there to the end, and the state after the block
    after: list[tuple[int, str] | None] = [(0, "") if s in ENDS else None for s in STATES]
    chosen: list[list[tuple[str, int] | None]] = []
    for letters in reversed(blocks):
        now, pick = [], []
        for s in STATES:
            ways = [
                (part[0] + rest[0], part[1] + rest[1], part[1], e)
                for e, rest in enumerate(after) if rest is not None and (part := search(letters, s, (e,))) is not None
            ]
            least = min(ways, default=None)
            now.append(least[:2] if least else None)
            pick.append(least[2:] if least else None)
        after = now
        chosen.append(pick)
    state, audits, states = 0, [], []
    for pick in reversed(chosen):
        states.append(state)
        audit, state = pick[state]
        audits.append(audit)
    return after[0][0], audits, states


# ---- rows --------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the contract's damage: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0),
    loses its text (1), its ``.!?`` (2), comes twice (3) or becomes the user's (4). A null counts as one blank."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return rows.withColumn("kind", kind).where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """The rows with ``seq``, their place by (conversation, turn with nulls first, role, text), and with what is needed of
    their role and text: initial, fault as far as the row tells, digest of both. Written once: all that follows reads it."""
    text, role = F.col("text"), F.col("role")
    bare = F.regexp_replace(text, WS_RE, "")
    initial = F.left(role, F.lit(1))
    laid = rows.repartitionByRange("conv_id", "turn", "role", F.left(text, F.lit(32)))
    laid = laid.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return cut(laid.select(
        "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("seq"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED).alias("fault"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
    ))


def _pieces(laid: DataFrame) -> DataFrame:
    """(conv_id, piece, letters, first and last turn, turns, of turns): blocks of at most ``BLOCK`` rows of a conversation.
    A row is a duplicate where an earlier row has its digest; digests that come once are not joined."""
    narrow = laid.select("conv_id", "turn", "seq", "initial", "fault", "digest")
    twice = narrow.where(f"fault <> {BLANK}").groupBy("conv_id", "digest").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    twice = twice.where("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first_seq")
    if fits(twice):
        twice = F.broadcast(twice)
    same = narrow["conv_id"].eqNullSafe(F.col("c")) & (narrow["digest"] == F.col("d"))
    again = F.col("first_seq").isNotNull() & (F.col("seq") > F.col("first_seq"))
    fault: Column = F.when(F.col("fault") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("fault"))
    row = F.struct("seq", F.char(F.lit(65) + 4 * F.col("initial") + fault).alias("letter"))
    rows = narrow.join(twice, same, "left").withColumn("row", row).withColumn("piece", F.floor(F.col("seq") / BLOCK))
    return rows.groupBy("conv_id", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["letter"]), "").alias("letters"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("turns"),
    )


_FOUND = (
    "conv_id bigint, piece bigint, seq bigint, state int, part string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, cost bigint"
)
_RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)
_LEGAL = ("su", "ua", "au")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f[1]]) for c, f in zip(columns, fields, strict=True)], [f[0] for f in fields])


def _long(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def summary(pieces: list[tuple[str, int | None, int | None, int]]) -> tuple[int, ...]:
    """(gaps, blank, duplicate, truncated, illegal) of a conversation from (letters, low, high, turns) of its blocks."""
    letters = "".join(p[0] for p in pieces)
    codes = [ord(x) - 65 for x in letters]
    faults = [c % 4 for c in codes]
    roles = [INITIALS[c // 4] for c in codes]
    illegal = sum(a + b not in _LEGAL for a, b in zip(roles, roles[1:]))
    with_turn = [p for p in pieces if p[1] is not None]
    gaps = 0
    if with_turn:
        shared = sum(a[2] == b[1] for a, b in zip(with_turn, with_turn[1:]))
        gaps = max(p[2] for p in with_turn) - min(p[1] for p in with_turn) + 1 - (sum(p[3] for p in with_turn) - shared)
    return _long(gaps), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal


def _solved(pieces: DataFrame) -> DataFrame:
    """One row per block: its audit and the state before it; the conversation's numbers are on its first block's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for conv_id, some in groupby(rows, key=lambda r: r[0]):
            held = list(some)
            numbers = summary([r[2:] for r in held])
            cost, audits, states = repair([r[2] for r in held])
            for i, (r, audit, state) in enumerate(zip(held, audits, states, strict=True)):
                found.append((conv_id, r[1], -1, state, audit, *((*numbers, cost) if i == 0 else [None] * 6)))
            if len(found) >= 4096:
                yield _batch(found, _FOUND)
                found = []
        if found:
            yield _batch(found, _FOUND)

    laid = pieces.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "piece")
    return laid.select("conv_id", "piece", "letters", "low", "high", "turns").mapInArrow(run, _FOUND)


class _Digest:
    """A repaired conversation, hashed as its rows come by."""

    def __init__(self):
        self.hash, self.first, self.parts = hashlib.sha256(), True, []
        self.audit: Iterator[str] = iter(())
        self.state = 0
        self.numbers: tuple = (0,) * 6

    def block(self, part: str, state: int) -> None:
        self.flush()
        self.audit, self.state = iter(part), state
        self.parts.append(part)

    def _write(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + role + ":" + text).encode("utf-8"))
        self.first = False

    def _insert(self) -> None:
        self._write(ROLE[self.state], "")
        self.state = NEXT[self.state]

    def row(self, role: str, text: str) -> None:
        for edit in self.audit:
            if edit == "I":
                self._insert()
                continue
            if edit == "R":
                self._write(ROLE[self.state], text)
            elif edit == "K":
                self._write(role, text)
            if edit != "D":
                self.state = 1 if edit == "K" and role[0] == "s" else NEXT[self.state]
            return

    def flush(self) -> None:
        for _ in self.audit:
            self._insert()


def _streamed(rows: DataFrame) -> DataFrame:
    """Rows of a conversation in order (per block: its audit, then its rows) -> one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        now: _Digest | None = None
        held = None

        def end() -> None:
            now.flush()
            found.append((held, *now.numbers, "".join(now.parts), now.hash.hexdigest()))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "seq", "role", "text", "state", "part")]
            numbers = [batch.column(c).to_pylist() for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
            for i, (conv_id, seq, role, text, state, part) in enumerate(zip(*columns, strict=True)):
                if now is None or conv_id != held:
                    if now is not None:
                        end()
                    now, held = _Digest(), conv_id
                if part is not None:
                    now.block(part, state)
                    if numbers[0][i] is not None:
                        now.numbers = tuple(c[i] for c in numbers)
                elif seq is not None:
                    now.row(role, text)
            if len(found) >= 4096:
                yield _batch(found, _RESULT)
                found = []
        if now is not None:
            end()
        if found:
            yield _batch(found, _RESULT)

    laid = rows.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("piece").asc_nulls_first(), F.col("seq").asc_nulls_first()
    )
    return laid.mapInArrow(run, _RESULT)


def repair_conversations(rows: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per conversation of
    ``rows`` (conv_id, turn, role, text), and per id of ``all_ids`` that has no rows any more (zeros, empty audit, digest of '').

    Null ids make one conversation; null turns come first; a null role or text counts as one blank. Rows of one turn are
    taken by role, then text; rows alike in all are each a row. A role other than one that begins with s, u or a can
    be rerolled or deleted, never kept; an empty role has no initial, so pairs with it are illegal. Empty and long
    texts are rows like others. Other columns are not read. No rows, no result rows. Gaps wrap around beyond a long.
    """
    plain = rows.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    laid = _in_order(bounded_batches(plain))
    texts = laid.select("conv_id", F.floor(F.col("seq") / BLOCK).alias("piece"), "seq", "role", "text")
    streams = texts.unionByName(_solved(_pieces(laid)), allowMissingColumns=True)
    if all_ids is not None:
        streams = streams.unionByName(all_ids.select(F.col("conv_id").cast("bigint")).distinct(), allowMissingColumns=True)
    return _streamed(streams)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """:func:`repair_conversations` of the damaged rows, for every id of ``conversations``."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    return repair_conversations(damage(rows), rows.select("conv_id"))
