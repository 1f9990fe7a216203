import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken

from palimpsest.llm import byte_bpe


@pytest.fixture(scope="module")
def own():
    return byte_bpe.ByteBpe(byte_bpe.rank_file())


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=own.ranks, special_tokens={})


def texts(seed, n):
    rng = random.Random(seed)
    pools = [
        "abcdefg ABC's'll12 \n\t", "éèüßñçÉÀΣσς İıŸ", "中文字日本語 한국어", "́̀a e\x1c\x85  ½²Ⅷ٣", "aaaab",
        "".join(map(chr, range(0x250, 0x2000, 7))), "".join(map(chr, [*range(0xA7C0, 0xA7F8), *range(0x10D40, 0x10D50), *range(0x323A0, 0x323C0)])),
    ]
    for _ in range(n):
        yield "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 80)))


def test_equals_the_library_on_hard_texts(own, library):
    held = [*texts(1, 1500), *["".join(t.split()) for t in texts(2, 200)], "", None, "a" * 5000 + "bcd" * 900, " " * 3000 + "x", "!" * 2000, "\n" * 99 + "a"]
    for text, ids in zip(held, own.encode_texts(held), strict=True):
        want = library.encode_ordinary(text or "")
        found = np.frombuffer(ids, "<u4").tolist()
        assert found == want, text
        assert own.decode(found) == library.decode_bytes(want)


def test_every_code_point_is_split_like_the_library(own, library):
    held = [f"a{c}b 1{c}2 {c}\n{c}" for c in map(chr, range(0x20, 0x110000, 23)) if not 0xD800 <= ord(c) < 0xE000]
    held += [f"a{chr(c)}b 1{chr(c)}2" for c in sorted(byte_bpe._doubtful()["L"] | byte_bpe._doubtful()["N"])[::5]]
    for text, ids in zip(held, own.encode_texts(held), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), ascii(text)


def one_by_one(word, ranks):
    """The definition: the least rank of the piece, leftmost first."""
    parts = [word[i: i + 1] for i in range(len(word))]
    while True:
        held = [(ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        if not held or min(held)[0] == 1 << 60:
            return [ranks[p] for p in parts]
        i = min(held)[1]
        parts[i: i + 2] = [parts[i] + parts[i + 1]]


def test_replay_of_many_pieces_equals_each_alone_even_where_ranks_fall():
    """Ranks in which a merge makes a pair of lower rank than its own: an order over the whole corpus must not
    run ahead of it inside a piece."""
    rng = random.Random(3)
    for _ in range(60):
        tokens = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 5))) for _ in range(12)}
        ranks = {bytes([b]): i for i, b in enumerate(rng.sample(range(256), 256))}
        for t in rng.sample(sorted(tokens), len(tokens)):
            ranks[t.encode()] = 256 + len(ranks)
        bpe = byte_bpe.ByteBpe.__new__(byte_bpe.ByteBpe)
        bpe.ranks, bpe.shift = ranks, max(ranks.values()).bit_length()
        bpe.pairs = {
            ranks[t[:i]] << bpe.shift | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }
        bpe.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        bpe.byte_pairs = np.full((256, 256), -1, np.int64)
        for t, r in ranks.items():
            if len(t) == 2:
                bpe.byte_pairs[t[0], t[1]] = r
        words = ["".join(rng.choice("aab") for _ in range(rng.randint(1, 30))).encode() for _ in range(40)]
        found = bpe.encode_pieces(words)
        assert found == [[ranks[w]] if w in ranks else one_by_one(w, ranks) for w in words]


def test_bounded_table_and_long_texts(own, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN_PIECES", 50)
    monkeypatch.setattr(byte_bpe, "PIECES_AT_ONCE", 30)
    small = byte_bpe.ByteBpe(byte_bpe.rank_file())
    held = list(texts(4, 200))
    for text, ids in zip(held, [x for i in range(0, 200, 9) for x in small.encode_texts(held[i: i + 9])], strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert len(small.known) < 2000


def test_digest_and_full_output_agree(docs, rows, library, empty):
    def want(text):
        ids = library.encode_ordinary(text or "")
        raw = np.array(ids, "<u4").tobytes()
        return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip_digest(docs).collect())
    assert found == Counter((r[0], *want(r[1])) for r in rows)
    full = byte_bpe.encode_decode(docs).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in full) == Counter((r[0], (r[1] or "").encode()) for r in rows)
    assert byte_bpe.round_trip_digest(empty).count() == 0
