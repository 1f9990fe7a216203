import random
from collections import Counter

import pytest

from palimpsest.llm import jaccard
from test_text_operators import brute_components


@pytest.mark.parametrize("rounds", [0, 2])
@pytest.mark.parametrize("same_size", [False, True])
def test_near_copies_of_the_second_text_are_linked(spark, monkeypatch, rounds, same_size):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "CROSS_POSTINGS", 200)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(40):
        first = [rng.choice(words) for _ in range(60 if same_size else 30 + i)]
        second = [rng.choice(words) for _ in range(60)]
        copy = [*second[:-2], "other", "end"]
        rows += [(i, " ".join(first)), (i, " ".join(second)), (1000 + i, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect())
    assert found == brute_components(rows)
    assert {r[0]: r[2] for r in found}[1000] == 0
