"""Byte-level BPE by replaying merges over all new pieces of a slice at once.

The pieces a slice of texts brings for the first time are laid end to end in one arena of tokens. An inverted index
leads from the rank of a pair of neighbours to the positions where such a pair begins. Ranks are taken in order from
a heap; a rank's positions are merged, and only the two pairs beside each merge are ranked and indexed anew. Entries
of pairs that have changed since are passed over. Every piece of the corpus is thus encoded once per worker, not once
per occurrence; encoded pieces are kept in a table of bounded size.

A merge may make a pair of *lower* rank than its own (the rank files do not promise otherwise). The rest of that
piece then waits until the lower rank has been replayed, so each piece sees exactly the merges it would see alone:
always its least rank, leftmost first. A piece that is itself a token is that token without any merge.

The ids equal the tiktoken library's for the same rank file and pattern. The library's Unicode tables may be older
or newer than Python's; code points on which they could differ are tried out with the library when a worker starts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimpsest.llm.common import bounded_batches, slices

#: Encoded pieces a worker keeps, and the longest piece (in characters) it keeps.
KNOWN_PIECES = 400_000
KNOWN_CHARS = 64
#: Pieces of a text that are encoded at a time.
PIECES_AT_ONCE = 1 << 20


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


@lru_cache(maxsize=1)
def _doubtful() -> dict[str, frozenset[int]]:
    """Code points that are letters (L) or numbers (N) for one of Python's two Unicode tables and not for the other."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out = {}
    for kind in "LN":
        held = regex.compile(rf"\p{{{kind}}}").match
        out[kind] = frozenset(c for c in points if (held(chr(c)) is not None) != (unicodedata.category(chr(c))[0] == kind))
    return out


def _of_library(kind: str, lead: str, points: Iterable[int]) -> set[int]:
    """Those of ``points`` which the library takes for the same kind as ``lead``: only then is lead + point one
    piece, and so the one token that stands for the two."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for c in points:
        ranks.setdefault((lead + chr(c)).encode(), len(ranks))
    trial = tiktoken.Encoding("trial", pat_str=rf"\p{{{kind}}}+|\P{{{kind}}}", mergeable_ranks=ranks, special_tokens={})
    return {c for c in points if len(trial.encode_ordinary(lead + chr(c))) == 1}


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str | None = None):
        self.ranks = read_ranks(path)
        self.token = {rank: token for token, rank in self.ranks.items()}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path}: not every byte has a rank")
        self.shift = max(self.token).bit_length()
        # every way to cut a token into two tokens: the pair's rank is the rank of what it makes
        self.pairs = {
            self.ranks[t[:i]] << self.shift | self.ranks[t[i:]]: rank
            for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        }
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs = np.full((256, 256), -1, np.int64)
        for t, rank in self.ranks.items():
            if len(t) == 2:
                self.byte_pairs[t[0], t[1]] = rank
        self.known: dict[str, bytes] = {}
        self.pattern = pattern or split_pattern()
        self.plain = regex.compile(self.pattern)
        self.careful = None
        doubtful = _doubtful()
        every = doubtful["L"] | doubtful["N"]
        self.doubt = regex.compile("[" + "".join(regex.escape(chr(c)) for c in sorted(every)) + "]").search if every else None
        self.beyond = regex.compile(f"[{chr(min(every))}-\U0010ffff]").search if every else None

    # ---- pieces ---------------------------------------------------------------------------------

    def _careful(self):
        """The pattern with the library's own letters and numbers, built when a text first needs it."""
        if self.careful is None:
            text = self.pattern
            for kind, lead in (("L", "a"), ("N", "1")):
                doubtful = _doubtful()[kind]
                here = regex.compile(rf"\p{{{kind}}}").match
                theirs = _of_library(kind, lead, doubtful)
                more = "".join(regex.escape(chr(c)) for c in sorted(doubtful) if c in theirs and not here(chr(c)))
                less = "".join(regex.escape(chr(c)) for c in sorted(doubtful) if c not in theirs and here(chr(c)))
                own = rf"\p{{{kind}}}{more}"
                if less:
                    # a class minus the characters the library does not count; outside a class and inside a negated one
                    text = text.replace(rf"[^\s\p{{L}}\p{{N}}]", r"(?:(?![\s]|@L@|@N@)[\s\S])")
                    text = text.replace(rf"\p{{{kind}}}", rf"(?:(?![{less}])[{own}])").replace(f"@{kind}@", rf"(?:(?![{less}])[{own}])")
                elif more:
                    text = text.replace(rf"\p{{{kind}}}", f"[{own}]")
            self.careful = regex.compile(text.replace("@L@", r"\p{L}").replace("@N@", r"\p{N}"))
        return self.careful

    def splitter(self, text: str):
        if self.beyond is None or self.beyond(text) is None or self.doubt(text) is None:
            return self.plain
        return self._careful()

    # ---- merges ---------------------------------------------------------------------------------

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of every piece: those that are tokens at once, the others by replay over their common arena."""
        out: list[list[int] | None] = [None if p not in self.ranks else [self.ranks[p]] for p in pieces]
        rest = [i for i, ids in enumerate(out) if ids is None and pieces[i]]
        for i, ids in zip(rest, self._replay([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return [ids or [] for ids in out]

    def _replay(self, pieces: list[bytes]) -> list[list[int]]:
        if not pieces:
            return []
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces])
        ends = np.cumsum(size)
        n = len(flat)
        first = np.full(n + 1, -1, np.int64)  # rank of the pair that begins at a position, -1 for none
        first[: n - 1] = self.byte_pairs[flat[:-1], flat[1:]]
        first[ends - 1] = -1
        token, rank_at = self.of_byte[flat].tolist(), first.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        piece = np.repeat(np.arange(len(pieces)), size).tolist()
        last = (ends - 1).tolist()
        # the inverted index: rank -> positions, in order
        order = np.argsort(first[:n], kind="stable")
        order = order[np.searchsorted(first[order], 0):]
        held, begin = np.unique(first[order], return_index=True)
        index = {r: some.tolist() for r, some in zip(held.tolist(), np.split(order, begin[1:]), strict=True)} if len(held) else {}
        heap = list(index)  # sorted, so a heap
        pairs, shift = self.pairs, self.shift
        push, pop = heapq.heappush, heapq.heappop

        def offer(rank: int, at: int) -> None:
            some = index.get(rank)
            if some is None:
                index[rank] = [at]
                push(heap, rank)
            else:
                some.append(at)

        while heap:
            rank = pop(heap)
            places = index.pop(rank)
            if len(places) > 1:
                places.sort()
            waits = -1  # the piece that has a lower rank now
            for at in places:
                if rank_at[at] != rank:
                    continue
                here = piece[at]
                if here == waits:
                    offer(rank, at)
                    continue
                gone = after[at]
                token[at] = rank
                rank_at[gone] = token[gone] = -1
                following = after[gone]
                after[at] = following
                lower = False
                if following <= last[here]:
                    before[following] = at
                    made = pairs.get(rank << shift | token[following], -1)
                    rank_at[at] = made
                    if made >= 0:
                        offer(made, at)
                        lower = made < rank
                else:
                    rank_at[at] = -1
                prior = before[at]
                if prior >= 0 and piece[prior] == here:
                    made = pairs.get(token[prior] << shift | rank, -1)
                    rank_at[prior] = made
                    if made >= 0:
                        offer(made, prior)
                        lower = lower or made < rank
                if lower:
                    waits = here
        found = np.array(token)
        kept = np.flatnonzero(found >= 0)
        cuts = np.searchsorted(kept, ends)
        ids = found[kept].tolist()
        starts = [0, *cuts[:-1].tolist()]
        return [ids[a:b] for a, b in zip(starts, cuts.tolist(), strict=True)]

    # ---- texts ----------------------------------------------------------------------------------

    def encode_texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of every text as little-endian unsigned 32-bit numbers; null is the empty text."""
        cut = [self.splitter(t).findall(t) if t and len(t) <= PIECES_AT_ONCE else None for t in texts]
        self.learn(piece for some in cut if some for piece in some)
        for text, pieces in zip(texts, cut, strict=True):
            if not text:
                yield b""
            elif pieces is not None:
                yield b"".join(map(self.known.__getitem__, pieces))
            else:
                yield b"".join(self._long(text))
        if len(self.known) > KNOWN_PIECES:
            self.known = {}
        else:
            for piece in [p for p in self.known if len(p) > KNOWN_CHARS]:
                del self.known[piece]

    def _long(self, text: str) -> Iterator[bytes]:
        found = (m.group() for m in self.splitter(text).finditer(text))
        while pieces := list(islice(found, PIECES_AT_ONCE)):
            self.learn(pieces)
            yield b"".join(map(self.known.__getitem__, pieces))

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes those of ``pieces`` which the table does not hold."""
        new = list(set(pieces).difference(self.known))
        for piece, ids in zip(new, self.encode_pieces([p.encode("utf-8") for p in new]), strict=True):
            self.known[piece] = np.array(ids, "<u4").tobytes()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        types = None
        for batch in slices(batches, "text"):
            types = types or [pa.int64(), *row(bpe, b"")[1]]
            columns = zip(*[row(bpe, ids)[0] for ids in bpe.encode_texts(batch.column("text").to_pylist())], strict=True)
            arrays = [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    source = bounded_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    return source.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<bigint>, decoded binary): every row of ``docs`` encoded and decoded again.

    Null and empty texts have no ids. Repeated rows give repeated results; rows keep a null id. Other columns of
    ``docs`` are not read, whatever their names. No rows, no result rows. ``path`` is a file every worker has.
    """

    def row(bpe: ByteBpe, ids: bytes):
        numbers = np.frombuffer(ids, "<u4").tolist()
        return (numbers, bpe.decode(numbers)), (pa.list_(pa.int64()), pa.binary())

    return _encoded(docs, path or rank_file(), id_col, text_col, "doc_id bigint, ids array<bigint>, decoded binary", row)


def round_trip_digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what :func:`encode_decode` gives, as digests taken in the same
    task. Nulls, ties and empty tables as there."""

    def row(bpe: ByteBpe, ids: bytes):
        numbers = np.frombuffer(ids, "<u4").tolist()
        found = (len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(numbers)).hexdigest())
        return found, (pa.int64(), pa.string(), pa.string())

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, path or rank_file(), id_col, text_col, schema, row)
