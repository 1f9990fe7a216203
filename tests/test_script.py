import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import labels as lb
from palimpsest.functions import text as tx
from palimpsest.operators import score as so
from palimpsest.operators import script as sc
from palimpsest.sources import records as io

CASES = [
    (6, 6, {1: 1, 4: 4}, [], {0: "NEW", 2: "INS", 3: "INS", 5: "NEW"}, {0: "OUT", 2: "DEL", 3: "DEL", 5: "OUT"}),
    (6, 3, {4: 0, 5: 1}, [0, 1], {0: "MARK", 1: "MARK", 2: "NEW", 3: "NEW"}, {2: "OUT"}),
    (3, 3, {1: 1}, [0, 1, 2], {0: "MARK", 2: "MARK"}, {0: "OUT", 2: "OUT"}),
    (3, 4, {0: 0, 1: 1, 2: 3}, [], {}, {2: "DEL"}),
    (3, 2, {}, [], {0: "NEW", 1: "NEW", 2: "NEW"}, {0: "OUT", 1: "OUT"}),
]


def table(spark, pid, n_s, links, tokens, tags=None, frame=()):
    rows = [(pid, n_s, len(tokens), t, w, links.get(t, -1), (tags or {}).get(t, "NOP" if t in links else "INS"), int(t in frame)) for t, w in enumerate(tokens)]
    return spark.createDataFrame(rows, "pair_id string, n_s int, n_r int, t int, word string, s int, tag string, frame int").withColumn("norm", tx.normalize(F.col("word")))


def sources(spark, pid, tokens):
    return spark.createDataFrame([(pid, s, w) for s, w in enumerate(tokens)], "pair_id string, s int, word string").withColumn("norm", tx.normalize(F.col("word")))


@pytest.mark.parametrize("case", range(len(CASES)))
def test_unlinked_words(spark, case):
    n_r, n_s, links, frame, want_r, want_s = CASES[case]
    w = table(spark, "p", n_s, links, [f"w{i}" for i in range(n_r)], frame=frame)
    s = sources(spark, "p", [f"x{i}" for i in range(n_s)])
    assert {r["i"]: r["op"] for r in sc.unlinked_reuse(w).collect()} == want_r
    assert {r["i"]: r["op"] for r in sc.unlinked_source(w, s).collect()} == want_s


def test_patterns(spark):
    four = table(spark, "p", 9, {i: i for i in range(4)}, list("abcd"))
    assert [(r["a"], r["b"]) for r in sc.quotes(four).collect()] == [(0, 3)]
    assert sc.quotes(table(spark, "p", 9, {i: i for i in range(3)}, list("abc"))).count() == 0
    assert sc.quotes(table(spark, "p", 9, {0: 0, 1: 1, 2: 5, 3: 6}, list("abcd"))).count() == 0
    assert sc.reordered(table(spark, "p", 12, {0: 8, 1: 11, 2: 10, 3: 9}, list("abcd"))).count() == 2
    assert [r["t"] for r in sc.reordered(table(spark, "p", 9, {0: 5, 1: 3, 2: 4}, list("abc"))).collect()] == [0]
    toks = "arma virumque. cano Troiae.".split()
    assert [r["t"] for r in sc.dispersed(table(spark, "p", 4, {0: 0, 2: 1}, toks)).collect()] == [1]
    assert sc.dispersed(table(spark, "p", 4, {2: 0, 3: 1}, toks)).count() == 0


def test_script_replays_and_inverts(spark):
    src, toks = "arma uirum cano te".split(), "ut ait arma uirumque cano".split()
    w = table(spark, "p", 4, {2: 0, 3: 1, 4: 2}, toks, tags={2: "NOP", 3: "MORPH", 4: "NOP"}, frame=(0, 1))
    s = sources(spark, "p", src)
    schema = "pair_id string, n_s int, n_r int, r_tok array<string>, s_norm array<string>, r_norm array<string>"
    pairs = spark.createDataFrame([("p", 4, 5, toks, src, toks)], schema)
    script = sc.decode_script(w, s).cache()
    assert sc.replays(script, pairs).first()["ok"]
    altered = spark.createDataFrame([("p", 4, 5, toks, src, [*toks[:4], "canit"])], schema)
    assert not sc.replays(script, altered).first()["ok"]
    twice = sc.invert(sc.invert(script))
    assert sorted(map(str, twice.collect())) == sorted(map(str, script.select(*twice.columns).collect()))
    back = sc.parse(sc.serialise(script, pairs))
    assert sorted((r["tag"], r["src"], r["tgt"]) for r in back.collect()) == sorted((r["tag"], r["src"], r["tgt"]) for r in script.collect())
    broken = script.unionByName(script.filter("tag = 'MORPH'"))
    assert {r["problem"] for r in sc.problems(broken, pairs).collect()} == {"written twice", "consumed twice"}


def test_worked_scores(spark):
    gold = spark.createDataFrame([("p", 0, 0, True), ("p", 1, 1, True), ("p", 2, 2, False)], "pair_id string, t int, s int, sure boolean")
    words = spark.createDataFrame([("p", t) for t in range(3)], "pair_id string, t int")
    pred = spark.createDataFrame([("p", 0, 0), ("p", 2, 2)], "pair_id string, t int, s int")
    r = so.link_scores(gold, pred).first()
    assert (r["precision"], r["recall"], r["f1"], r["aer"]) == (1.0, 0.5, round(2 / 3, 6), 0.25)
    acc = so.token_accuracy(words, gold, pred).first()
    assert (acc["right"], acc["total"]) == (2, 3)


def test_rank_auc_with_ties(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (0, 0.9)]
    df = spark.createDataFrame(rows, "gold int, score double")
    pos, neg = [s for g, s in rows if g], [s for g, s in rows if not g]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert so.rank_auc(df).first()["auc"] == round(want, 6)


def test_details_and_spellings(spark):
    rows = [("SUBST", "CASE+HYPER", "HYPER+CASE", False), ("MORPH", "MOOD+TENSE", "TENSE+MOOD", False), ("COPY", "CASE", "CASE", True), ("MERGE", "+3", "+3", False), ("MERGE", "3", "3", True)]
    df = spark.createDataFrame(rows, "op string, d string, want string, bad boolean")
    assert df.filter((lb.normalise_detail(F.col("op"), F.col("d")) != F.col("want")) | (lb.detail_error(F.col("op"), F.col("d")) != F.col("bad"))).count() == 0
    x = spark.createDataFrame([("SYN", "CASE"), ("POS", ""), ("MORPH", "CASE"), ("SYN", "SYN-DIST"), ("COPY", "")], "op string, d string")
    p = x.select("op", "d", lb.to_paper_op(F.col("op")).alias("po"), lb.to_paper_detail(F.col("op"), F.col("d"), revised=True).alias("pd"))
    assert p.filter((lb.from_paper_op(F.col("po"), F.col("pd")) != F.col("op")) | (lb.from_paper_detail(F.col("po"), F.col("pd")) != F.col("d"))).count() == 0


def raw_line(**over):
    line = {"id": "p1", "ref_type": "cit.", "source": ["a", "b", "c"], "target": ["x", "a", "b"], "links": [-1, 0, 1], "gated_tags": ["INS", "NOP", "MORPH"], "frames": [1, 0, 0],
            "dels": [0, 0, 1], "pred": {"links": [{"r": 1, "s": 0, "op": "NOP", "p": 0.123456789}]}, "record": {"benchmark_id": 7, "fold": 2, "source": {"author": "v"}, "reuse": {"author": "h"}}}
    return line | over


def test_released_record(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text(json.dumps(raw_line()) + "\n")
    r = io.released(io.read_json(spark, str(tmp_path), io.RAW)).first()
    assert [(e["reuse"], e["source"], e["label"], e["confidence"]) for e in r["links"]] == [(1, 0, "COPY", 0.12346), (2, 1, "INFLECT", None)]
    assert [(m["start"], m["end"]) for m in r["mark"]] == [(0, 1)]
    assert (r["insertions"], r["new_text"], r["deletions"], r["not_taken_up"]) == ([], [], [], [2])


def test_a_contradicting_record_fails(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text(json.dumps(raw_line(dels=[1, 0, 0])) + "\n")
    with pytest.raises(Exception, match="deletions disagree"):
        io.released(io.read_json(spark, str(tmp_path), io.RAW)).collect()


def test_log_lines(spark):
    df = spark.createDataFrame([("epoch 3/8  loss 0.4123",), ("[span_aligner] epoch 2/3: loss 0.51",), ("[nmt_aligner] layer fwd update 500/2000: guided loss 1.2e-2",), ("loss 3",)], "value string")
    got = {(r["tag"], r["step"], r["total"], r["loss"]) for r in io.curve_points(df).collect()}
    assert got == {("", 3, 8, 0.4123), ("span_aligner", 2, 3, 0.51), ("nmt_aligner", 500, 2000, 0.012)}


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "n_gladius.json").write_text('{"synonyms": ["ensis"]}')
    (tmp_path / "x_bad.json").write_text('{"synonyms": ["y"]}')
    (tmp_path / "v_cano.json").write_text('{"_error": "404"}')
    assert [tuple(r) for r in io.lexicon_files(spark, str(tmp_path)).collect()] == [("gladius", "n", "synonyms", "ensis")]


def test_replies(spark):
    replies = [
        ("a", "SYN first\n\nno, ANT\nthat is it"), ("b", "nothing"), ("c", "syn-dist"),
        ("d", 'x {"SYN": ["ensis", ["gladius", "sword"], " "], "hyper": [], "ANT": "no list", "HYPO": []} y'), ("e", "{broken"), ("f", None),
    ]
    df = spark.createDataFrame(replies, "id string, reply string")
    got = {r.id: (r.tag, r.rel) for r in df.select("id", io.last_reply_tag(F.col("reply"), ("SYN", "SYN-DIST", "ANT")).alias("tag"), io.reply_relations(F.col("reply")).alias("rel")).collect()}
    assert [got[k][0] for k in "abc"] == ["ANT", None, "SYN-DIST"]
    assert got["d"][1] == {"SYN": ["ensis", "gladius"], "HYPER": [], "HYPO": [], "ANT": []}
    assert all(got[k][1] == {"SYN": [], "HYPER": [], "HYPO": [], "ANT": []} for k in "abef")


def test_the_word_table_is_derived_once(spark):
    from palimpsest.operators import typing_ as ty

    src, toks = "arma uirum cano te".split(), "ut ait arma uirumque cano".split()
    w = table(spark, "p", 4, {2: 0, 3: 1, 4: 2}, toks, tags={2: "NOP", 3: "MORPH", 4: "NOP"}, frame=(0, 1))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # the mask's look ahead is not part of the script's plan, nor the join with the evidence of the formula rule's
    assert "lead(" in plan(ty.clean_mask(w)) and "lead(" not in plan(sc.decode_script(w, sources(spark, "p", src)))
    links = w.filter("s >= 0").select("pair_id", "t", "s")
    zeros = [F.lit(0).alias(c) for c in ("enclitic_stem_match", "enclitic_src", "enclitic_tgt", "same_lemma", "wn_syn", "wn_deriv", "wn_hyper", "wn_hypo", "wn_ant", "cos_missing", "same_pos", "both_names", "lemma_missing")]
    evidence = links.select("*", F.lit("a").alias("sw"), F.lit("a").alias("rw"), F.lit(1).alias("same_form"), F.lit(0.0).alias("cos"), *zeros)
    typed = ty.typed_words(w.select("pair_id", "n_s", "n_r", "t", "word", "norm"), links, evidence)
    assert "same_form" not in plan(typed)
    assert {(r.t, r.s, r.tag) for r in typed.collect()} == {(0, -1, "INS"), (1, -1, "INS"), (2, 0, "COPY"), (3, 1, "COPY"), (4, 2, "COPY")}
