import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import best_fit, bpe, token_matrix


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary())


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.vocabulary())


def texts(seed, n):
    rng = random.Random(seed)
    pools = ["abcdefg ABC's'll12 \n\t", "éèüßñçÉÀΣσς İıŸ", "中文字日本語 한국어", "́̀a e\x1c\x85  ½²Ⅷ٣", "".join(map(chr, range(0x250, 0x2000, 7)))]
    for _ in range(n):
        yield "".join(
            rng.choice(rng.choice(pools)) if rng.random() < 0.97 else rng.choice(["<|endoftext|>", "<|startoftext|>"])
            for _ in range(rng.randint(0, 60))
        )


def test_equals_the_library_on_hard_texts(library, own):
    held = [*texts(1, 1500), "", " ", "a" * 5000 + "bcd" * 900, "!" * 3000 + " " + "thean" * 800, "the The THE the's they'll 1234"]
    found = list(own.encode_column(pa.array(held), most=1000))
    for text, ids in zip(held, found, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_table_forgets_and_encodes_again(own, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 50)
    small = bpe.Bpe(bpe.vocabulary())
    held = list(texts(2, 200))
    for a, b in zip(small.encode_column(pa.array(held), most=500), own.encode_column(pa.array(held)), strict=True):
        assert a.tolist() == b.tolist()
    assert len(small.known.keys) < 400


def test_digest_and_full_output_agree(docs, rows, library, empty):
    found = {(r.doc_id, r.ids_sha256) for r in bpe.round_trip_digest(docs).collect()}
    want = set()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.add((r[0], hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert found == want
    full = bpe.encode_decode(docs).collect()
    assert len(full) == len(rows)
    assert Counter((r.doc_id, r.decoded) for r in full) == Counter(
        (r[0], library.decode(library.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in rows
    )
    assert bpe.round_trip_digest(empty).count() == 0


# ---- packing ---------------------------------------------------------------------------------


def optimum(lengths, capacity):
    """Fewest sequences, by trying every set that holds the first item left."""
    lengths = tuple(sorted(lengths, reverse=True))
    memo = {}

    def solve(left):
        if not left:
            return 0
        if left not in memo:
            best = len(left)
            for k in range(len(left)):
                for rest in combinations(range(1, len(left)), k):
                    if left[0] + sum(left[i] for i in rest) <= capacity:
                        best = min(best, 1 + solve(tuple(x for i, x in enumerate(left) if i and i not in rest)))
            memo[left] = best
        return memo[left]

    return solve(lengths)


def test_reduction_never_costs_a_sequence():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
        fixed = best_fit.reduce(count, capacity)
        rest = [n for n in range(capacity + 1) for _ in range(count[n])]
        assert sum(t for _, t in fixed) + optimum(rest, capacity) == optimum(lengths, capacity)


def test_plan_is_valid_and_close_to_the_bound():
    rng = random.Random(4)
    for capacity, n in ((100, 3000), (4096, 5000), (4096, 40)):
        lengths = [min(capacity, int(rng.lognormvariate(5, 1.2)) + 1) for _ in range(n)]
        patterns = best_fit.plan(Counter(lengths), capacity)
        used = Counter()
        for pattern, times in patterns:
            assert sum(a * k for a, k in pattern) <= capacity
            for a, k in pattern:
                used[a] += k * times
        assert used == Counter(lengths)
        assert sum(t for _, t in patterns) <= 1.01 * sum(lengths) / capacity + 2


def test_pack_places_every_token_once(docs, rows, library, empty):
    found = best_fit.pack(docs, capacity=64).collect()
    by_seq = defaultdict(list)
    for r in found:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    want = Counter()
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at: at + 64]
            want[(r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    assert best_fit.pack(empty).count() == 0


def test_best_fit_decreasing_takes_the_least_room():
    rng = random.Random(6)
    lengths = [rng.randint(1, 50) for _ in range(400)]
    bins, rooms = [], []
    for i in sorted(range(400), key=lambda i: -lengths[i]):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= lengths[i]]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
            rooms.append(50)
        bins[b].append(i)
        rooms[b] -= lengths[i]
    found = token_matrix.best_fit_decreasing(lengths, 50)
    assert len(found) == len(bins)
    assert sorted(sum(lengths[i] for i in b) for b in found) == sorted(sum(lengths[i] for i in b) for b in bins)


def test_matrices_round_trip(docs, rows, library, empty, tmp_path):
    packed = token_matrix.packed_matrices(docs, capacity=128, block_tokens=5000)
    token_matrix.write_matrices(packed, str(tmp_path / "m"))
    packed = docs.sparkSession.read.parquet(str(tmp_path / "m"))
    assert packed.select("sequence_id").distinct().count() == packed.count()
    for r in packed.collect():
        assert len(r.input_ids) == len(r.position_ids) == 256 and r.cu_seqlens[-1] == r.n_tokens <= 128
        place = np.frombuffer(r.position_ids, "<u2")
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert place[a:b].tolist() == list(range(b - a))
    pieces = defaultdict(list)
    for r in token_matrix.read_documents(packed).collect():
        pieces[r.doc_id].append((r.start, tuple(r.ids)))
    want = defaultdict(list)
    for r in rows:
        ids = (*library.encode(r[1] or "", add_special_tokens=False).ids, 1)
        want[r[0]] += [(at, ids[at: at + 128]) for at in range(0, len(ids), 128)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_matrix.packed_matrices(empty).count() == 0
