"""Steps that several queries share: what they hand on, and that they move no more than they need."""

from types import SimpleNamespace

import numpy as np
import pytest

from palimpsest.operators import align as al
from palimpsest.operators import kernels
from palimpsest.operators import lexicon as lx
from palimpsest.operators import negatives as ng
from palimpsest.plans import base
from palimpsest.queries import script_q


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_pairs_stay_where_they_lie(spark, tmp_path):
    texts = [" ".join(f"word{d}x{i}" if i % 9 else f"shared{i}" for i in range(60)) for d in range(3)]
    spark.createDataFrame([(1, texts[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(d, texts[d], "en", "s") for d in (1, 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.palimpsest.pairMinShared", "2")
    try:
        b = base.Inputs(spark, str(tmp_path))
        wide = b.wide
        rows = {r["pair_id"]: r for r in wide.select("pair_id", "r_pid", "r_tok", "r_norm", "n_r").collect()}
    finally:
        spark.conf.unset("spark.palimpsest.pairMinShared")
    assert rows
    for r in rows.values():
        doc, seg = divmod(r["r_pid"], 1000000)
        want = texts[doc].split(" ")[max(seg - 1, 0) * 24 : (seg + 2) * 24]
        assert r["r_tok"] == want and r["n_r"] == len(want) == len(r["r_norm"])
    counted = _plan(wide.groupBy("pair_id").count())
    assert "Exchange" not in counted


def test_optimal_pairs_reads_its_cells_once(spark):
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 5.0), ("a", 1, 0, 2.0), ("a", 2, 7, 3.0), ("b", 0, 0, 4.0)], "pair_id string, t int, s int, cost double")
    out = al.optimal_pairs(cells)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, 1), ("a", 1, 0), ("a", 2, 7), ("b", 0, 0)]
    assert "Union" not in _plan(out)


@pytest.mark.parametrize("nulls", [False, True])
def test_sparse_assignment_against_every_choice(nulls):
    rng = np.random.default_rng(5)
    for _ in range(200):
        cells = {(t, s): float(rng.integers(1, 9)) for t in range(4) for s in range(4) if rng.random() < 0.5}
        null = {t: float(rng.integers(1, 9)) for t in range(4)} if nulls else {}

        def every(t, used):
            if t == 4:
                yield ()
                return
            yield from every(t + 1, used)
            for s in range(4):
                if (t, s) in cells and s not in used:
                    for rest in every(t + 1, used | {s}):
                        yield ((t, s), *rest)

        def worth(links):
            total = sum(cells[x] for x in links)
            return total + sum(v for t, v in null.items() if t not in {x[0] for x in links}) if nulls else (len(links), -total)

        rows = [(t, s, p) for (t, s), p in cells.items()] + [(t, -1, p) for t, p in null.items()]
        got = kernels._links(rows, nulls)
        assert len({s for _, s in got}) == len(got)
        assert worth(tuple(got)) == max(worth(x) for x in every(0, frozenset()))


def test_neighbours_of_the_rows_asked_for_are_the_same(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "x" if i % 3 else "y", [float(v) for v in rng.normal(size=6)]) for i in range(90)]
    vec = spark.createDataFrame(rows, "id long, pos string, vec array<double>")
    asked = spark.createDataFrame([(i,) for i in (1, 4, 7, 50, 400)], "id long")
    cols = ["pos", "a", "b", "rank"]
    whole = {tuple(r) for r in lx.vector_neighbours(vec, threshold=0.1, top=2, block_rows=20).select(cols).collect() if r["a"] in (1, 4, 7, 50)}
    some = lx.vector_neighbours(vec, threshold=0.1, top=2, block_rows=20, asked=asked).select(cols).collect()
    assert whole and {tuple(r) for r in some} == whole and len(some) == len(whole)


def test_grown_links_and_their_ranks(spark):
    fwd = [("a", 0, 0, 0.9), ("a", 0, -1, 0.1), ("a", 1, 1, 0.8), ("a", 1, -1, 0.1), ("a", 3, 5, 0.7), ("a", 3, -1, 0.1)]
    rev = [("a", 0, 0, 0.9), ("a", 0, -1, 0.1), ("a", 1, 0, 0.6), ("a", 1, -1, 0.1)]
    f = spark.createDataFrame(fwd, "pair_id string, t int, s int, p double")
    r = spark.createDataFrame([(p, t, s, v) for p, s, t, v in rev], "pair_id string, t int, s int, p double").select("pair_id", "s", "t", "p")
    got = sorted(tuple(x) for x in al.grow_diag_final(f, r).select("t", "s", "rank").collect())
    assert got == [(0, 0, 1), (0, 1, 2), (1, 1, 1), (3, 5, 1)]
    assert "aggregate(" not in _plan(al.grow_diag_final(f, r))


def test_easy_negatives_rank_the_passages_once(spark):
    passages = [(i, "a", f"w{i} " * 7, 7) for i in range(20)]
    corpus = spark.createDataFrame(passages, "pid long, author string, txt string, n int")
    rows = spark.createDataFrame([(f"r{i}", "a", f"q{i}", 7) for i in range(5)], "id string, author string, query_txt string, n_q int")
    attested = spark.createDataFrame([("none", "none")], "txt string, query_txt string")
    out = ng.easy(rows, corpus, attested)
    assert {r["id"] for r in out.collect()} == {f"r{i}" for i in range(5)}
    assert "Window" not in _plan(out)


def test_details_look_at_linked_cells_only(spark, monkeypatch):
    asked = []
    found = spark.createDataFrame([("a", 2, "COPY", "")], "pair_id string, t int, tag string, detail string")
    monkeypatch.setattr(script_q.ty, "rule_type", lambda links, evidence: evidence)
    b = SimpleNamespace(pred="links", link_evidence=lambda links: asked.append(links) or found)
    assert [tuple(r) for r in script_q._details(b).collect()] == [("a", 2, "COPY", "CASE")]
    assert asked == ["links"]
