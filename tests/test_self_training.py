"""Self-training writes what it reads several times where its pair lies."""

from test_layout import evidence_inputs, shuffles

from palimpsest.queries import em_q
from palimpsest.plans.lineage import cut


def test_edges_words_and_script_are_written_once_by_pair(spark, monkeypatch):
    b = evidence_inputs(spark)
    assert b.fwd.count() and b.rev.count() and b.lemma_tables
    kept = []
    monkeypatch.setattr(em_q, "cut", lambda df, **k: kept.append(cut(df, **k)) or kept[-1])
    rows = em_q.self_training(b).collect()
    assert len(kept) == 4 and all(shuffles(df.groupBy("pair_id").count()) == 0 for df in kept)
    agreed, edges, words, script = kept
    assert words.count() == b.rwords.count() and script.count() > 0 and edges.count() <= agreed.count()
    assert rows and {r.op for r in rows} <= {"COPY", "MORPH", "SUBST"} and {(r.pair_id, r.t, r.s) for r in rows} <= {(r.pair_id, r.t, r.s) for r in edges.collect()}
