import math
import random
from collections import defaultdict

import corpus_pipeline
import pytest

from palimpsest.llm import topk


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], "x") for i in range(300)]
    rows += [(400 + i, [0.5] * 6, "tie") for i in range(60)]  # ties
    rows += [
        (500, None, ""), (501, [0.1, None, 0.2], ""), (502, [float("nan")] * 6, ""), (520, [float("inf")] * 6, ""), (540, [], ""),
        (560, [3.0, -1.0], ""), (None, [1.0] * 6, ""), rows[20], rows[20], (-20, [0.25] * 6, ""),
    ]
    return rows


def brute(rows, k=20, every=20):
    use = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = defaultdict(int)
    for at, (q, x) in enumerate(use):
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for n, (i, y) in enumerate(use) if n != at)
            for rank, (score, i) in enumerate(found[:k], 1):
                out[(q, rank, i, -score)] += 1
    return dict(out)


@pytest.mark.parametrize("sizes", [(256, 64, 2048), (7, 3, 5)])
def test_top_k_equals_brute_force(spark, vectors, sizes):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank string").repartition(4)
    found = defaultdict(int)
    for r in topk.top_k(frame, block=sizes[0], task_blocks=sizes[1], task_queries=sizes[2]).collect():
        found[(r.query_id, r.rank, r.vec_id, r.score)] += 1
    assert dict(found) == brute(vectors)


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 0.5])], schema)
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 3, 64 * 64 + 128 * 32)]
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0


def test_large_weights_stay_whole(spark):
    rows = [(0, [1e7, 3.0], ""), (1, [1e7, 1.0], ""), (2, [1e7, 2.0], "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string")
    assert [tuple(r) for r in topk.top_k(frame).collect()] == [(r[0], r[1], r[2], r[3]) for r in sorted(brute(rows))]


def test_stages_return_their_documents(spark, docs):
    at, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, "")
        assert out.columns == docs.columns, name
        out = out.repartition(2).cache()
        assert out.count() <= at.count()
        if name == "line_dedup":
            assert out.count() == at.count() and out.exceptAll(at).count() > 0
        at = out
    assert at.count() < before
    ids = [r.doc_id for r in at.select("doc_id").collect()]
    assert sum(200 <= i < 230 for i in ids if i is not None) < 30  # near copies have gone, one of them stays
    assert 200 in ids
    packed = corpus_pipeline.best_fit_packing(spark, at, "").collect()
    assert {r.doc_id for r in packed} == set(ids)


def test_stages_take_an_empty_table(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
