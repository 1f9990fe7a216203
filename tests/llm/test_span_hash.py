"""Texts whose words collide under sums of powers modulo 2^64, and a table whose hashes all collide."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import bpe, common, jaccard, lm, quality

SCHEMA = "doc_id bigint, text string, lang string, source string"


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


X, Y = thue_morse(1024)


def test_hashes_tell_words_apart_wherever_they_stand():
    rng = np.random.default_rng(0)
    words = [X, Y, *thue_morse(2048), *thue_morse(4096), *["".join(rng.choice(list("abé"), rng.integers(1, 90))) for _ in range(3000)]]
    text = " ".join([*words, *reversed(words)])
    held = common.Words(pa.array(["", text, "a " + text]), lower=False)
    raw, known = held.data.tobytes(), {}
    for h, a, b in zip(held.hash.tolist(), held.start.tolist(), held.end.tolist(), strict=True):
        assert known.setdefault(raw[a:b], h) == h
    assert len(set(known.values())) == len(known) == len(set(words)) + (0 if "a" in words else 1)


def test_op1(spark):
    library = Tokenizer.from_file(bpe.vocabulary())
    docs = spark.createDataFrame([(1, X, "", ""), (2, Y, "", ""), (3, f"{X} {Y} {X}", "", "")], SCHEMA).coalesce(1)
    for r in bpe.round_trip_digest(docs).collect():
        ids = library.encode({1: X, 2: Y, 3: f"{X} {Y} {X}"}[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize("values", [1, 3])
def test_op1_where_hashes_collide(monkeypatch, values):
    monkeypatch.setattr(bpe, "hash_spans", lambda data, start, end: ((end - start) % values).astype(np.uint64))
    library, own = Tokenizer.from_file(bpe.vocabulary()), bpe.Bpe(bpe.vocabulary())
    texts = ["the cat sat on the mat", "don't DON'T élan Éla", "cat tac act 12 é", "", "the the hat"]
    for _ in range(2):
        for text, ids in zip(texts, own.encode_column(pa.array(texts)), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_op8_and_op9_and_op10(spark):
    docs = spark.createDataFrame([(1, X, "l", "s"), (2, Y, "l", "s"), (3, f"{X}\n{Y}", "l", "s"), (4, X, "l", "s")], SCHEMA)
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 1}
    rows = {r.doc_id: r.n_dup_lines for r in quality.quality(docs).collect()}
    assert rows == {1: 0, 2: 0, 3: 0, 4: 0}
    scored = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    train = [i for i in range(1, 5) if not scored[i].held_out]
    counts = {w: sum(w in t.split() for i, t in {1: X, 2: Y, 3: f"{X} {Y}", 4: X}.items() if i in train) for w in (X, Y)}
    total = sum(counts.values()) + len(train)
    types = sum(c > 0 for c in counts.values()) + 1
    for i, words in {1: [X], 2: [Y], 3: [X, Y], 4: [X]}.items():
        want = sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in words) + np.log10((len(train) + 1) / (total + types + 1))
        assert abs(scored[i].base_score - want) < 1e-9
