from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import mining as mn
from palimpsest.operators import tokens as tk

SAME = [("ture", "Thure"), ("Chalybes", "Calybes"), ("tinguere", "tingere"), ("inpare", "impare"),
        ("inbellis", "imbellis"), ("Rhenus", "renus"), ("Uox,", "vox"), ("iam", "jam")]
DIFFERENT = [("anus", "annus"), ("anguis", "angis"), ("optuma", "optima"), ("arma", "amor")]


def test_normalise_folds(spark):
    df = spark.createDataFrame([(a, b, True) for a, b in SAME] + [(a, b, False) for a, b in DIFFERENT], "a string, b string, same boolean")
    bad = df.filter((tx.normalize(F.col("a")) == tx.normalize(F.col("b"))) != F.col("same"))
    assert bad.count() == 0


def test_spelling_key_and_sameness(spark):
    df = spark.createDataFrame([("temptare", "tentare"), ("haud", "haut"), ("Graii", "Grai"), ("quoties", "quotiens"), ("tendens", "tendensque")], "a string, b string")
    assert df.filter(tx.spelling_key(F.col("a")) != tx.spelling_key(F.col("b"))).count() == 0
    one = spark.createDataFrame([("coelum", "caelum", "tendens", "tendensque", "omnis", "omnes")], "a string, b string, c string, d string, e string, f string")
    n = lambda c: tx.normalize(F.col(c))
    row = one.select(tx.same("current", n("a"), n("b")), tx.same("+folds", n("a"), n("b")), tx.same("+enclitic", n("c"), n("d")),
                     tx.same("+enclitic", n("e"), n("f")), tx.same("+plural", n("e"), n("f"))).first()
    assert list(row) == [False, True, True, False, True]


def test_counterparts(spark):
    def words(s):
        return [("p", i, w) for i, w in enumerate(s.split())]

    a = spark.createDataFrame(words("arma virumque cano, Troiae et"), "pair_id string, i int, word string").withColumn("norm", tx.normalize(F.col("word")))
    b = spark.createDataFrame(words("arma virum canit poeta et"), "pair_id string, i int, word string").withColumn("norm", tx.normalize(F.col("word")))
    got = [r["hit"] for r in tk.counterparts(a, b).orderBy("i").collect()]
    assert got == [True, True, False, False, True]


def _passages(spark, texts):
    return spark.createDataFrame([(i, t, t.split(), len(t.split())) for i, t in enumerate(texts)], "pid long, txt string, toks array<string>, n int")


CORPUS = ["arma uirumque cano troiae qui primus"] * 2 + ["nox erat et caelo fulgebat luna", "cano arma semper hic poeta noster"]
QUERIES = ["arma cano uirum atque deos magnos", "luna fulgebat nocte serena alta caelo", "arma cano uirum atque deos alios"]


def test_overlap_miner(spark):
    c, q = _passages(spark, CORPUS), _passages(spark, QUERIES)
    gold = spark.createDataFrame([(QUERIES[2],)], "txt string")
    assert mn.overlap_pairs(c, q, gold=gold, min_shared=2, min_tokens=1).count() == 3


def test_both_index_plans_agree(spark):
    c, q = mn.distinct_passages(_passages(spark, CORPUS)), mn.distinct_passages(_passages(spark, QUERIES))
    small = mn.shared_counts(c, q, min_shared=1, max_df=2000)
    large = mn.shared_counts(c, q, min_shared=1, max_df=2000, hot_rows=1, broadcast_rows=0)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_passages_without_enough_hits_are_not_moved(spark, monkeypatch):
    from palimpsest.operators import kernels

    monkeypatch.setattr(kernels, "HITS", 3)
    c, q = _passages(spark, CORPUS), _passages(spark, [*QUERIES, *QUERIES, "x y z", CORPUS[0], ""])
    for floor in (1, 2, 3):
        small = mn.overlap_pairs(c, q, min_shared=floor, min_tokens=1)
        large = mn.overlap_pairs(c, q, min_shared=floor, min_tokens=1, broadcast_rows=0).select(small.columns)
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
        batches = q.select("pid", "txt", tx.content_tokens(F.col("txt"))).toArrow().to_batches()
        index = mn._index(mn.distinct_passages(c), 2000)[0].toArrow()
        held = [b.column(0).to_pylist() for b in kernels.hit_batches(batches, kernels.HitIndex.of(index["token"], index["pid"]), floor)]
        assert {p % 3 for h in held for p in h if p < 6} == ({0, 1, 2} if floor < 3 else {1}) and not any(6 in h or 8 in h for h in held)


def test_localise_trims_and_leaves_alone(spark):
    src = "decem tulerunt fastidia menses".split()
    long_ = ["w%d" % i for i in range(8)] + "decem mensum fastidia sustineret".split() + ["v%d" % i for i in range(8)]
    rows = [("a", src, long_, 4, 20), ("b", src, long_[:8], 4, 8)]
    df = spark.createDataFrame(rows, "pair_id string, s_norm array<string>, r_norm array<string>, n_s int, n_r int")
    got = {r["pair_id"]: (r["r_off"], r["r_len"]) for r in mn.localise(df).collect()}
    off, n = got["a"]
    assert n == 8 and {"decem", "fastidia"} <= set(long_[off : off + n])
    assert got["b"] == (0, 8)


def test_ranked_pairs_equals_one_pass_greedy(spark):
    rows = [(f"i{i:03d}", f"s{i % 3}", f"r{i % 7}", 0.9 + ((i * 37) % 100) / 1000) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, source string, reuse string, p double")
    want, used_r, used_s = [], set(), {}
    for i, s, r, p in sorted(rows, key=lambda x: (-x[3], x[0])):
        if r in used_r or used_s.get(s, 0) >= 2:
            continue
        want.append(i)
        used_r.add(r)
        used_s[s] = used_s.get(s, 0) + 1
    got = [r["id"] for r in mn.ranked_pairs(df, per_source=2).collect()]
    assert sorted(got) == sorted(want)


def test_vocabulary_is_counted_by_form(spark, tmp_path):
    from palimpsest.plans.base import Inputs
    from palimpsest.queries import evidence_q

    words = [("alpha", 3), ("alphb", 1), ("beta", 2), ("ab", 9), ("gamma", 1)]
    rows = [(w, w[:5], "n") for w, n in words for _ in range(n)]
    each = tk.candidate_vocabulary(spark.createDataFrame(rows, "norm string, lemma string, pos string"), frequent_cutoff=2)
    once = tk.candidate_vocabulary(spark.createDataFrame([(w, w[:5], "n", n) for w, n in words], "norm string, lemma string, pos string, n long"), frequent_cutoff=2)
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, once.collect())) and each.count() == 3
    b = Inputs(spark, "")
    toks = spark.createDataFrame([("s", 1, 1, 0, "Arma", "arma"), ("r", 2, 2, 0, "ab", "ab"), ("r", 2, 2, 1, "armaque", "armaque")],
                                 "side string, pid long, work long, i int, surface string, norm string")
    b.__dict__.update(tokens=toks, names=spark.createDataFrame([("Arma",)], "form string"), attested=spark.createDataFrame([("arma", 3)], "norm string, n long"))
    out = evidence_q._annotated(b)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()  # no word is moved
    got = {(r.surface, r.lemma, r.is_name, r.enclitic) for r in out.collect()}
    assert got == {("Arma", "arma", True, None), ("ab", None, False, None), ("armaque", "armaq", False, "que")}
