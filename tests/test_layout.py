"""Tables made from the pair table lie by pair: what follows needs no shuffle."""

from pyspark.sql import functions as F

from palimpsest.operators import align, em, mining
from palimpsest.plans.base import Inputs
from palimpsest.plans.lineage import cut, lay


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def pair_table(spark, folder=""):
    b = Inputs(spark, folder)
    rows = [(f"{i}_1", "aa bb cc".split(), "aa bx cc dd".split()) for i in range(20)]
    pairs = spark.createDataFrame(rows, "pair_id string, s_tok array<string>, r_tok array<string>")
    pairs = pairs.withColumn("s_norm", F.col("s_tok")).withColumn("r_norm", F.col("r_tok"))
    b.__dict__["pairs"] = b.lay(pairs.withColumn("n_s", F.size("s_tok")).withColumn("n_r", F.size("r_tok")))
    return b


def test_a_laid_checkpoint_keeps_its_layout_and_the_setting(spark):
    df = spark.range(100).selectExpr("id % 10 as k", "id")
    assert shuffles(cut(df.repartition(4, "k")).groupBy("k").count()) == 1  # an adaptive plan does not tell
    laid = lay(df, 4, "k")
    assert shuffles(laid.groupBy("k", "id").count()) == 0 and laid.count() == 100
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_cells_rows_and_their_average_need_no_shuffle(spark):
    b = pair_table(spark)
    for df in (b.cells, b.fwd, b.rev, b.pred):
        assert shuffles(df.groupBy("pair_id").count()) == 0
    mean = align.average(b.fwd, b.rev)
    assert shuffles(mean.groupBy("pair_id", "t").count()) == 0
    f = {(r.pair_id, r.t, r.s): r.p for r in b.fwd.collect()}
    v = {(r.pair_id, r.t, r.s): r.p for r in b.rev.collect()}
    want = {k: (f.get(k, 0.0) + v.get(k, 0.0)) * 0.5 for k in set(f) | set(v) if k[1] >= 0 and k[2] >= 0}
    want |= {k: p for k, p in f.items() if k[2] < 0}
    assert {(r.pair_id, r.t, r.s): r.p for r in mean.collect()} == want


def test_hits_are_counted_where_the_passage_lies(spark):
    rows = [(1, "gentem romanam condere moenia urbis altae"), (2, "gentem romanam condere xerxes ypsilon zetas"), (3, "p q r s t u")]
    df = spark.createDataFrame(rows, "pid long, txt string").withColumn("toks", F.split("txt", " ")).withColumn("n", F.size("toks"))
    pairs = mining.overlap_pairs(df.filter("pid = 1"), df.filter("pid > 1"), min_shared=2)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    # the small corpus side is still dealt by text and by word
    assert not any(f"hashpartitioning({c}#" in plan for c in ("q", "c", "pid"))
    assert [(r.q, r.c, r.n_shared, r.r_tok[3]) for r in pairs.collect()] == [(2, 1, 3, "xerxes")]


def test_the_fit_lies_by_reuse_word(spark):
    b = pair_table(spark)
    cells = em.em_cells(b.grid, b.rwords)
    assert shuffles(cells.groupBy("pair_id", "t").count()) == 0
    rows = em.collapsed(cells)
    assert shuffles(rows.groupBy("wt", "ws").count()) == 0
    # 20 equal pairs: every occurrence meets a, b, c and the null
    assert {(r.wt, r.m, r.k) for r in rows.collect()} == {(w, 20, 1) for w in ("aa", "bx", "cc", "dd")} and rows.count() == 16


def evidence_inputs(spark):
    b = pair_table(spark)
    vec = [("aa", [1.0, 0.0]), ("bb", [0.6, 0.8]), ("aabab", [3.0, 4.0])]
    rows = [(f"{i}_1", "aabab aaque bbb Ccc".split(), "aabab aabac bbb ddd ccc".split()) for i in range(20)]
    pairs = spark.createDataFrame(rows, "pair_id string, s_tok array<string>, r_tok array<string>")
    for side in ("s", "r"):
        pairs = pairs.withColumn(f"{side}_norm", F.transform(f"{side}_tok", F.lower)).withColumn(f"n_{side}", F.size(f"{side}_tok"))
    b.__dict__["pairs"] = b.lay(pairs)
    b.__dict__["vectors"] = spark.createDataFrame([*vec, ("bbb", [1.0, 1.0])], "lemma string, vec array<double>")
    b.__dict__["lexicon"] = spark.createDataFrame([("bbb", "a", "synonyms", "ddd"), ("zzz", "a", "synonyms", "ddd")], "lemma string, pos string, relation string, other string")
    b.__dict__["names"] = spark.createDataFrame([("Ccc",)], "form string")
    b.__dict__["norms"] = spark.createDataFrame([("bbb", 3), ("aabab", 5)], "norm string, n long")
    return b


def test_evidence_moves_no_cell(spark):
    b = evidence_inputs(spark)
    for df in (b.evidence, b.evid, b.sims, b.cell_evidence, b.evidence_of(b.gold)):
        assert shuffles(df.groupBy("pair_id", "t").count()) == 0
    assert b.evidence.count() == 20 * 4 * 5
    one = {(r.sw, r.rw): r for r in b.evidence.filter("pair_id = '0_1'").collect()}
    assert one["bbb", "ddd"].wn_syn == 1 and one["bbb", "ddd"].tier == 1 and one["bbb", "ddd"].wn_missing == 0
    assert abs(one["bbb", "aabab"].cos - 7 / 50**0.5) < 1e-12 and one["bbb", "ddd"].cos_missing == 1
    assert one["Ccc", "ccc"].either_name == 1 and one["Ccc", "ccc"].both_names == 0


def test_lemma_tables_too_large_to_broadcast_give_the_same_evidence(spark):
    small, large = evidence_inputs(spark), evidence_inputs(spark)
    large.__dict__["lemma_tables"] = None
    for name in ("evidence", "evid", "sims", "cell_evidence"):
        a, b = getattr(small, name), getattr(large, name)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_vectors_are_looked_up_only_where_cheaper_tests_leave_a_cell(spark):
    b = evidence_inputs(spark)
    some = b.evidence.filter("tier > 0 or edit_ratio >= 0.4 or cos >= 0.35")
    assert sorted(map(tuple, b._telling().collect())) == sorted(map(tuple, some.collect())) and some.count() > 0
    close = {(r.la, r.lb) for r in b.close_flags.filter("close = 1").collect()}
    assert ("bbb", "aabab") in close and ("bbb", "ddd") not in close
    plan = b._telling()._jdf.queryExecution().optimizedPlan().toString()
    assert "close" in plan and "levenshtein" in plan[plan.index("close") - 2000 : plan.index("close") + 2000]


def test_balancing_is_one_pass_over_the_pairs(spark):
    b = pair_table(spark)
    out = align.sinkhorn(b.fwd, b.pairs)
    assert shuffles(out) == 0 and "Scan ExistingRDD" in out._jdf.queryExecution().executedPlan().toString()
    rows = {(r.t, r.s): r.p for r in out.filter("pair_id = '3_1'").collect()}
    assert set(rows) == {(r.t, r.s) for r in b.fwd.filter("pair_id = '3_1'").collect()} and out.count() == b.fwd.count()
    # the rounds by hand: 4 reuse words, 3 source words, a bin each
    from math import exp, log

    z = [[-30.0] * 4 for _ in range(4)] + [[0.0] * 4]
    for r in b.fwd.filter("pair_id = '3_1'").collect():
        z[r.t][r.s if r.s >= 0 else 3] = log(r.p)
    norm = -log(7)
    mu, nu = [norm] * 4 + [log(3) + norm], [norm] * 3 + [log(4) + norm]
    v = [0.0] * 4
    for _ in range(10):
        u = [mu[i] - log(sum(exp(z[i][j] + v[j]) for j in range(4))) for i in range(5)]
        v = [nu[j] - log(sum(exp(z[i][j] + u[i]) for i in range(5))) for j in range(4)]
    for (t, s), p in rows.items():
        assert abs(p - exp(z[t][s] + u[t] + v[s] - norm)) < 1e-12


def test_the_vocabulary_is_counted_once(spark):
    b = Inputs(spark, "")
    rows = [("s", 1, 1, 0, "Arma"), ("s", 1, 1, 1, "arma,"), ("r", 2, 2, 0, "arma"), ("r", 2, 2, 1, "!"), ("r", 2, 2, 2, "uir")]
    b.__dict__["tokens"] = spark.createDataFrame(rows, "side string, pid long, work long, i int, surface string")
    assert {(r.norm, r.n) for r in b.attested.collect()} == {("arma", 3)}
    assert {r.norm: r.n for r in b.norms.collect()}["uir"] == 1 and b.forms.count() == 5
    del b.__dict__["tokens"]  # nothing below reads the corpus again
    assert b.attested.count() == 1 and "Scan ExistingRDD" in b.attested._jdf.queryExecution().executedPlan().toString()


def test_links_look_at_their_own_cells_only(spark):
    b, wide = evidence_inputs(spark), evidence_inputs(spark)
    assert b.words.count() == 100 and "cell_evidence" not in b.__dict__ and "evid" not in b.__dict__
    assert wide.cell_evidence.count() > 0
    assert sorted(map(tuple, b.words.collect())) == sorted(map(tuple, wide.words.collect()))
    assert sorted(map(tuple, b.gold_words.collect())) == sorted(map(tuple, wide.gold_words.collect()))


def test_a_plan_keeps_narrow_rows(spark):
    from palimpsest.queries import script_q

    b, wide = evidence_inputs(spark), evidence_inputs(spark)
    assert wide.evid.count() > 0
    a, z = script_q._plan(b), script_q._plan(wide)
    assert "evid" not in b.__dict__ and sorted(map(tuple, a.collect())) == sorted(map(tuple, z.collect()))


def test_a_dump_is_dealt_once(spark, tmp_path):
    from palimpsest.queries import dumps_q

    b = evidence_inputs(spark)
    rows, links = dumps_q.redecoded(b)
    for df in (rows, links):
        assert shuffles(df.groupBy("pair_id", "t").count()) == 0
    assert links.count() > 0 and dumps_q.lost(b).first()["lost"] == 0


def test_fragments_lie_by_pair(spark, monkeypatch):
    b = pair_table(spark)
    kept = []
    monkeypatch.setattr(align, "cut", lambda df, **k: kept.append(cut(df, **k)) or kept[-1])
    assert align.fragment_decode(b.fwd, b.rev, b.rwords, theta=0.3).count() > 0
    assert len(kept) >= 3 and all(shuffles(df.groupBy("pair_id", "t").count()) == 0 for df in kept[:3])
