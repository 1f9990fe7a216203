"""BPE encoding and decoding by a contiguous rank array.

A short word keeps its part boundaries and, next to them, the merge rank of every adjacent pair of parts.
The smallest rank is looked for by a scan; the boundary between its two parts is deleted and the two ranks
beside it are looked up anew; numpy does this for many words at once. Words of more than ``SHORT`` parts, where repeated scans would be quadratic,
take the same merges from a heap over linked parts. Encoded words are kept in a table of bounded size,
because natural text repeats its words.

The result equals the tokenizers library's on the vocabulary file (a byte-level BPE whose words end in
``</w>``, text put in NFC and lower-cased character by character, special tokens' strings matched first).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimpsest.llm.common import LOWER, bounded_batches, equal_spans, hash_spans, mix64, sizes_within, slices, spans, text_data

#: Words of more parts than this are merged with a heap.
SHORT = 48
#: Encoded pieces a worker keeps, see ``_Known``; more are only held while a slice needs them.
KNOWN_PIECES = 1_000_000
_NONE = 1 << 60
#: Letters outside the long-settled blocks of Unicode.
_RARE = re.compile(
    "[^\x00-\u02af\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20a0-\u20b5"
    "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
).search


_KIND = np.full(256, 4, np.uint8)
_KIND[:128] = 3
_KIND[[*range(ord("a"), ord("z") + 1)]] = 1
_KIND[[*range(ord("0"), ord("9") + 1)]] = 2
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
_KIND[ord("'")] = 4


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class _Known:
    """Hash of a piece -> its bytes and ids, in sorted arrays. A piece counts as known only if its bytes are the same. A
    full table forgets the pieces it has met only once since they came in; those that come again are simply encoded again."""

    def __init__(self):
        self.bytes, self.from_, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint16)

    def find(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of every key, whether its piece is there, whether another piece has its place)"""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        same = there & (self.size[at] == size)
        k = np.flatnonzero(same)
        same[k] = equal_spans(self.bytes, self.from_[at[k]], data, start[k], size[k])
        return at, same, there & ~same

    def room(self, more: int) -> None:
        if len(self.keys) + more > KNOWN_PIECES:
            keep = np.flatnonzero(self.met)
            if len(keep) > KNOWN_PIECES // 2:
                keep = keep[:0]
            self.ids = ragged(self.ids, self.at[keep], self.n[keep])
            self.bytes = ragged(self.bytes, self.from_[keep], self.size[keep])
            self.keys, self.n, self.size = self.keys[keep], self.n[keep], self.size[keep]
            self.at, self.from_ = np.cumsum(self.n) - self.n, np.cumsum(self.size) - self.size
            self.met = np.zeros(len(keep), bool)

    def add(self, keys: np.ndarray, ids: list[np.ndarray], data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        n = np.array([len(i) for i in ids], np.int64)
        order = np.argsort(all_keys := np.concatenate([self.keys, keys]), kind="stable")
        self.at = np.concatenate([self.at, np.cumsum(n) - n + len(self.ids)])[order]
        self.n = np.concatenate([self.n, n])[order]
        self.met = np.concatenate([self.met, np.zeros(len(keys), bool)])[order]
        self.ids = np.concatenate([self.ids, *ids])
        self.from_ = np.concatenate([self.from_, np.cumsum(size) - size + len(self.bytes)])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.bytes = np.concatenate([self.bytes, ragged(data, start, size)])
        self.keys = all_keys[order]


def ragged(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[at[0]: at[0] + n[0]], values[at[1]: at[1] + n[1]], ... in one array."""
    ends = np.cumsum(n)
    return values[np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Bpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in {**self.vocab, **self.special}.items()}
        # the merges by (left id, right id): their ranks, and the ids they make
        pairs = [(self.vocab[a] << 32 | self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]]
        self.rank = {pair: r for r, (pair, _) in enumerate(pairs)}
        self.makes = np.array([made for _, made in pairs] or [0], dtype=np.int64)
        self.pairs = np.array(sorted(self.rank), dtype=np.int64)
        self.ranks = np.array([self.rank[p] for p in self.pairs.tolist()], dtype=np.int64)
        self.letters = byte_letters()
        self.inner = np.array([self.vocab.get(x, -1) for x in self.letters], dtype=np.int64)
        self.final = np.array([self.vocab.get(x + self.suffix, -1) for x in self.letters], dtype=np.int64)
        if (self.inner < 0).any() or (self.final < 0).any():
            raise ValueError(f"{path}: not a byte-level vocabulary")
        self.byte_of = {x: b for b, x in enumerate(self.letters)}
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.known = _Known()
        self.wide = np.uint32 if max(self.token) > 65535 else np.uint16
        self.known.ids = self.known.ids.astype(self.wide)
        self.path, self.library = path, None

    # ---- words ------------------------------------------------------------------------------

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], _NONE)

    def _scan(self, words: list[bytes]) -> list[np.ndarray]:
        """Short words, many at once, one row each: where its parts begin, their ids, and the rank of every
        part with the next. Each turn scans the rows for their smallest rank, deletes the boundary behind
        that part and refreshes the rank before and the rank behind it; a row without a rank is done."""
        wide, n = max(map(len, words)), len(words)
        size = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(n, wide)
        ids = self.inner[flat]
        every = np.arange(n)
        ids[every, size - 1] = self.final[flat[every, size - 1]]
        bounds = np.tile(np.arange(wide + 1), (n, 1))  # bounds[:, size] ends the word
        ranks = np.full((n, wide + 1), _NONE)
        ranks[:, 1:wide] = self._rank_of(ids[:, :-1], ids[:, 1:])  # ranks[:, i + 1] is of parts i and i + 1
        ranks[np.arange(wide + 1) >= size[:, None]] = _NONE
        out: list[np.ndarray] = [ids[:0]] * n
        row, column = every, np.arange(wide)
        while len(row):
            at = ranks.argmin(axis=1)
            k = np.arange(len(row))
            least = ranks[k, at]
            done = least == _NONE
            if done.any():
                for r, parts, m in zip(row[done].tolist(), ids[done].astype(self.wide), size[done].tolist(), strict=True):
                    out[r] = parts[:m]
                keep = ~done
                row, ids, bounds, ranks, size = row[keep], ids[keep], bounds[keep], ranks[keep], size[keep]
                at, least = at[keep], least[keep]
                k = np.arange(len(row))
                if not len(row):
                    break
            at = at - 1  # the part that takes in the next one
            gone = (column >= at[:, None] + 1).astype(np.int64)
            move = np.minimum(column + gone, wide - 1)
            ids = np.take_along_axis(ids, move, axis=1)
            ids[k, at] = self.makes[least]
            bounds[:, :wide] = np.take_along_axis(bounds, column + gone, axis=1)
            ranks[:, :wide] = np.take_along_axis(ranks, column + gone, axis=1)
            ranks[:, wide] = _NONE
            size = size - 1
            has = at > 0
            ranks[k[has], at[has]] = self._rank_of(ids[k[has], at[has] - 1], ids[k[has], at[has]])
            has = at + 1 < size
            ranks[k[has], at[has] + 1] = self._rank_of(ids[k[has], at[has]], ids[k[has], at[has] + 1])
            ranks[k[~has], at[~has] + 1] = _NONE
        return out

    def _heap(self, word: bytes) -> np.ndarray:
        """One long word: the same merges from a heap over linked parts."""
        n = len(word)
        part = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.final[word[-1]])]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n:
                rank = self.rank.get(part[a] << 32 | part[b])
                if rank is not None:
                    heapq.heappush(heap, (rank, a, part[a], part[b]))

        for a in range(n):
            offer(a)
        while heap:
            rank, a, left, right = heapq.heappop(heap)
            if part[a] != left or after[a] >= n or part[after[a]] != right:
                continue  # one of the two parts has changed
            b = after[a]
            part[a], part[b], after[a] = int(self.makes[rank]), -1, after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return np.array([x for x in part if x >= 0], dtype=self.wide)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words given as UTF-8 bytes."""
        out: list[np.ndarray] = [np.zeros(0, self.wide)] * len(words)
        order = sorted((i for i, w in enumerate(words) if w), key=lambda i: len(words[i]))
        for at in range(0, len(order), 4096):
            some = order[at: at + 4096]
            short = [i for i in some if len(words[i]) <= SHORT]
            for i, ids in zip(short, self._scan([words[i] for i in short]) if short else [], strict=True):
                out[i] = ids
            for i in some[len(short):]:
                out[i] = self._heap(words[i])
        return out

    # ---- whole texts ------------------------------------------------------------------------

    def _words_of(self, run: str) -> list[bytes]:
        """The words of a text of any characters. A capital sigma becomes a plain small one wherever it stands."""
        if _RARE(run) is None:
            return [w.encode("utf-8") for w in self.pieces(unicodedata.normalize("NFC", run).replace("Σ", "σ").lower())]
        # letters of which Unicode versions may think differently: the library says where words end
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        known = self.library.normalizer.normalize_str(run)
        words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(known)]
        return [bytes(map(self.byte_of.__getitem__, w)) for w in words]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Lower-cased bytes, and starts and ends of the pieces of all texts: runs of letters, single digits,
        runs of other characters. Only ASCII and the letters of Latin-1 are told apart here; a run between
        blanks with anything else (or with an apostrophe) is one piece, marked as one to be cut in Python."""
        low = LOWER[data]
        kind = _KIND[low]  # 0 blank, 1 letter, 2 digit, 3 other, 4 not told apart here
        lead = np.flatnonzero(low == 0xC3)
        if len(lead):
            lead = lead[lead + 1 < len(low)]
            second = low[lead + 1]
            letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
            lead, second = lead[letter], second[letter]
            kind[lead] = kind[lead + 1] = 1
            low[lead + 1] = np.where(second <= 0x9E, second | 0x20, second)  # the capitals; sharp s stays
        start, end = spans(kind > 0, offsets)
        odd = np.add.reduceat(kind == 4, start) > 0 if len(start) else np.zeros(0, bool)
        if odd.any():
            odd[odd] = [kind[a:b].max() == 4 for a, b in zip(start[odd], end[odd], strict=True)]
            hole = np.zeros(len(kind) + 1, np.int32)
            hole[start[odd]] += 1
            hole[end[odd]] -= 1
            kind[np.cumsum(hole[:-1]) > 0] = 0
        same = kind[1:] == kind[:-1]
        same &= kind[1:] != 2
        cuts = np.concatenate([np.flatnonzero(~same) + 1, offsets])
        first, last = spans(kind > 0, cuts)
        complex_ = np.concatenate([np.zeros(len(first), bool), np.ones(int(odd.sum()), bool)])
        first, last = np.concatenate([first, start[odd]]), np.concatenate([last, end[odd]])
        order = np.argsort(first, kind="stable")
        return low, first[order], last[order], complex_[order]

    def _encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ends of each text's ids in them); no text holds a special token's string."""
        low, start, end, odd = self._pieces(data, offsets)
        if not len(start):
            return np.zeros(0, self.wide), np.zeros(len(offsets), np.int64)
        # a piece to be cut in Python is told by its bytes as they came, the others by their lower-cased ones
        both, at_ = np.concatenate([low, data]), np.where(odd, start + len(low), start)
        size = end - start
        keys = hash_spans(both, at_, at_ + size)
        keys[odd] = mix64(keys[odd])
        keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
        alike = (size == size[at][back]) & (odd == odd[at][back])
        k = np.flatnonzero(alike)
        alike[k] = equal_spans(both, at_[k], both, at_[at][back][k], size[k])
        self.known.room(len(keys))
        place, there, taken = self.known.find(keys, both, at_[at], size[at])
        new = np.flatnonzero(~there & ~taken)
        if len(new):
            ids = self._ids_of(data, low, start[at[new]], end[at[new]], odd[at[new]])
            self.known.met[place[there]] = True
            self.known.add(keys[new], ids, both, at_[at[new]], size[at[new]])
            place, there, taken = self.known.find(keys, both, at_[at], size[at])
        else:
            self.known.met[place[there]] = True
        n, source, values = self.known.n[place][back], self.known.at[place][back], self.known.ids
        # pieces whose hash belongs to other bytes are encoded apart from the table
        odd_ones = np.flatnonzero(~alike | taken[back])
        if len(odd_ones):
            ids = self._ids_of(data, low, start[odd_ones], end[odd_ones], odd[odd_ones])
            n[odd_ones] = [len(i) for i in ids]
            source[odd_ones] = np.cumsum(n[odd_ones]) - n[odd_ones] + len(values)
            values = np.concatenate([values, *ids])
        ends = np.concatenate([[0], np.cumsum(n)])
        return ragged(values, source, n), ends[np.searchsorted(start, offsets)]

    def _ids_of(self, data: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> list[np.ndarray]:
        text, raw = low.tobytes(), data.tobytes()
        words, count = [], []
        for a, b, hard in zip(start.tolist(), end.tolist(), odd.tolist(), strict=True):
            some = self._words_of(raw[a:b].decode("utf-8")) if hard else [text[a:b]]
            words += some
            count.append(len(some))
        ids = self.encode_words(words)
        if len(ids) != len(start):
            ends = np.cumsum(count).tolist()
            none = np.zeros(0, self.wide)
            ids = [np.concatenate([none, *ids[e - c: e]]) for c, e in zip(count, ends, strict=True)]
        return ids

    def encode_column(self, column: pa.Array, most: int = 8 << 20) -> Iterator[np.ndarray]:
        """The ids of every text of an Arrow column, in order; null is the empty text."""
        data, offsets = text_data(column)
        raw = data.tobytes() if self.special else b""
        marked = bool(self.special) and any(s.encode() in raw for s in self.special)
        for lo, hi in sizes_within(offsets, most):
            some, ends = data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
            if not marked:
                ids, at = self._encode_slice(some, ends)
                for i in range(hi - lo):
                    yield ids[at[i]: at[i + 1]]
                continue
            for i in range(lo, hi):
                parts = self.cut(raw[offsets[i]: offsets[i + 1]].decode("utf-8"))
                plain = [p.encode("utf-8") for p in parts[0::2]]
                cuts = np.concatenate([[0], np.cumsum([len(p) for p in plain])])
                ids, at = self._encode_slice(np.frombuffer(b"".join(plain), np.uint8), cuts)
                out = []
                for k in range(len(plain)):
                    out.append(ids[at[k]: at[k + 1]])
                    if 2 * k + 1 < len(parts):
                        out.append(np.array([self.special[parts[2 * k + 1]]], self.wide))
                yield np.concatenate(out)

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_column(pa.array([text], pa.large_string()))).astype(np.uint32)

    def decode(self, ids) -> str:
        """The library's text for ids of a file without a decoder: tokens joined by one blank; unknown ids go."""
        return " ".join([t for t in map(self.token.get, ids) if t is not None])


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded): every row of ``docs``, its text encoded and decoded again.

    Null and empty texts have no ids and decode to ''. Repeated rows give repeated results. Other columns
    of ``docs`` are not read, whatever their names. ``path`` is a folder path every worker has.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, "text", 2 << 20):
            ids = list(bpe.encode_column(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
                    pa.array([bpe.decode(i.tolist()) for i in ids], pa.string()),
                ],
                ["doc_id", "ids", "decoded"],
            )

    source = bounded_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    return source.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def round_trip_digest(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what :func:`encode_decode` gives, as digests taken in
    the same task, so that neither ids nor decoded text leave it. Nulls and ties as there."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        digits = {i: str(i) for i in bpe.token}
        for batch in slices(batches, "text"):
            n, a, b = [], [], []
            for found in bpe.encode_column(batch.column("text")):
                ids = found.tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([digits[i] for i in ids]).encode("ascii")).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = bounded_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    return source.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
