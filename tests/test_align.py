import itertools

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import align as al
from palimpsest.operators import em
from palimpsest.operators import staged as st
from palimpsest.operators.kernels import least_cost

FWD = [(0, 0, .8), (0, 1, .1), (0, -1, .1), (1, 1, .45), (1, 2, .35), (1, -1, .2), (2, 2, .6), (2, -1, .4)]
REV = [(0, 0, .9), (0, -1, .1), (1, 1, .5), (1, -1, .5), (2, 1, .7), (2, 2, .2), (2, -1, .1)]


def rows(spark):
    f = spark.createDataFrame([("p", t, s, p) for t, s, p in FWD], "pair_id string, t int, s int, p double")
    r = spark.createDataFrame([("p", s, t, p) for s, t, p in REV], "pair_id string, s int, t int, p double")
    return f, r


def links(df, n=3):
    got = {r["t"]: r["s"] for r in df.collect()}
    return [got.get(t, -1) for t in range(n)]


def test_decoders_on_the_worked_example(spark):
    f, r = rows(spark)
    assert links(al.default_decode(f, r, 0.3)) == [0, 2, -1]
    assert links(al.default_decode(f, r, 0.6)) == [0, -1, -1]
    assert links(al.mutual_best(f, r)) == [0, 1, -1]
    assert links(al.raw_decode(f)) == [0, 1, 2]
    assert links(al.threshold_decode(al.average(f, r), 0.5)) == [0, 2, -1]
    assert links(al.threshold_decode(f, 0.5)) == [0, -1, 2]
    assert links(al.intersect_links(f, r, 0.3).filter("rank = 1")) == [0, 1, -1]
    assert links(al.intersect_links(f, r, 0.6).filter("rank = 1")) == [0, -1, -1]
    mean = {(x["t"], x["s"]): round(x["p"], 3) for x in al.average(f, r).collect()}
    assert mean[(0, 0)] == .85 and mean[(1, 1)] == .475 and mean[(1, 2)] == .525 and mean[(2, 2)] == .4


def test_assignment_with_private_nulls(spark):
    cells = [(0, 0, .9), (0, 1, .5), (0, -1, .05), (1, 0, .8), (1, 1, .6), (1, -1, .1), (2, 2, .7), (2, -1, .3), (3, 3, .2), (3, -1, .8)]
    df = spark.createDataFrame([("p", *c) for c in cells], "pair_id string, t int, s int, p double")
    assert links(al.hungarian(df), 4) == [0, 1, 2, -1]


def test_kernel_is_optimal_on_small_grids():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 6))
        m = n + int(rng.integers(0, 3))
        cost = rng.integers(0, 20, size=(n, m)).astype(float)
        got = least_cost(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert len(set(got)) == n and sum(cost[i, got[i]] for i in range(n)) == best


def test_copy_links_move_forward(spark):
    df = spark.createDataFrame([("p", "a b c a".split(), "b a c a".split(), 4, 4)], "pair_id string, s_norm array<string>, r_norm array<string>, n_s int, n_r int")
    assert links(al.copy_links(df), 4) == [1, 3, -1, -1]


def _sides(spark, s, t):
    from palimpsest.functions import text as tx

    a = spark.createDataFrame([("p", i, w) for i, w in enumerate(s.split())], "pair_id string, s int, word string").withColumn("norm", tx.normalize(F.col("word")))
    b = spark.createDataFrame([("p", i, w) for i, w in enumerate(t.split())], "pair_id string, t int, word string").withColumn("norm", tx.normalize(F.col("word")))
    grid = a.select("pair_id", "s", F.col("norm").alias("sn")).join(b.select("pair_id", "t", F.col("norm").alias("rn")), "pair_id")
    return a, b, grid


def test_identical_runs_and_punctuation(spark):
    a, b, grid = _sides(spark, "arma uirumque cano Troiae et in", "ut ait Maro arma uirumque cano et in")
    state = spark.createDataFrame([("p", [])], f"pair_id string, links {st.LINKS}")
    got = st.identical_runs(state, grid, ("et", "in", "ut")).select(F.inline("links")).collect()
    assert sorted((r["s"], r["t"]) for r in got) == [(0, 3), (1, 4), (2, 5)]
    a, b, _ = _sides(spark, "arma cano .", "ait Maro arma cano .")
    assert [(r["s"], r["t"]) for r in st.punctuation(b, a).collect()] == [(2, 4)]


def _toy(spark):
    rng = np.random.default_rng(7)
    out = []
    for p in range(200):
        words = rng.choice(20, size=int(rng.integers(3, 9)), replace=False)
        target = [f"t{i}" for i in rng.permutation(words)]
        if rng.random() < 0.1:
            target.append("ins")
        for t, w in enumerate(target):
            out.append((f"p{p}", len(words), len(target), t, -1, em.NULL_WORD, w))
            out += [(f"p{p}", len(words), len(target), t, s, f"s{x}", w) for s, x in enumerate(words)]
    return spark.createDataFrame(out, "pair_id string, n_s int, n_r int, t int, s int, ws string, wt string")


def test_em_recovers_the_dictionary(spark):
    cells = _toy(spark).cache()
    theta, history = em.fit_lexical(cells, iterations=5)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    best = theta.filter(F.col("ws") != em.NULL_WORD).groupBy("ws").agg(F.max_by("wt", "theta").alias("wt")).collect()
    assert len(best) == 20 and all(r["wt"] == "t" + r["ws"][1:] for r in best)
    hmm, _, lls = em.fit_hmm(cells, theta, iterations=2)
    assert lls[1] >= lls[0]
    best = hmm.filter(F.col("ws") != em.NULL_WORD).groupBy("ws").agg(F.max_by("wt", "theta").alias("wt")).collect()
    assert all(r["wt"] == "t" + r["ws"][1:] for r in best)
