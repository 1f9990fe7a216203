from pyspark.sql import functions as F

from palimpsest.operators import negatives as ng
from palimpsest.operators import synth as sy


def corpus_of(spark, sizes):
    rows, pid = [], 0
    for author, n in sizes.items():
        for i in range(n):
            rows.append((pid, pid, 0, author, f"{author} passage number {i} of many words", 7))
            pid += 1
    df = spark.createDataFrame(rows, "pid long, work long, seg int, author string, txt string, n int")
    return df.withColumn("toks", F.split("txt", " "))


def attested_but(corpus, author, query, spare):
    """Every passage of the author is attested with the query, but for the pids ``spare``."""
    return corpus.filter((F.col("author") == author) & ~F.col("pid").isin(*spare)).select("txt", F.lit(query).alias("query_txt"))


def test_a_row_is_left_out_only_if_no_passage_is_usable(spark):
    corpus = corpus_of(spark, {"a": 300, "b": 40})
    query = "some query of exactly seven words here"
    attested = attested_but(corpus, "a", query, [123]).unionByName(attested_but(corpus, "b", query, []))
    rows = spark.createDataFrame([("x", "a", query, 7), ("y", "a", "another query of exactly seven words too", 7), ("z", "b", query, 7)],
                                 "id string, author string, query_txt string, n_q int")
    got = {r.id: r.pid for r in ng.easy(rows, corpus, attested).collect()}
    assert got["x"] == 123 and set(got) == {"x", "y"}


def test_the_first_usable_one_from_a_place_on(spark):
    corpus = corpus_of(spark, {"a": 100})
    index = ng.author_index(corpus).cache()
    order = [r.pid for r in index.orderBy("k").collect()]
    query = "some query of exactly seven words here"
    for k0, spare in ((1, [order[0]]), (90, [order[5], order[40]]), (50, [order[48]]), (3, [order[2], order[1]])):
        asked = spark.createDataFrame([("q", "a", query, 7, k0, 100)], "_id string, author string, query_txt string, n_q int, k0 long, n_author long")
        got = ng.first_usable_from(asked, index, attested_but(corpus, "a", query, spare), width=2).collect()
        want = next(order[(k0 - 1 + i) % 100] for i in range(100) if order[(k0 - 1 + i) % 100] in spare)
        assert [r.pid for r in got] == [want]


def test_mismatch_keeps_queries_whose_draws_fail(spark):
    corpus = corpus_of(spark, {"a": 60})
    query = "some query of exactly seven words here"
    queries = spark.createDataFrame([(query, "a")], "query_txt string, author string")
    got = ng.author_mismatch(queries, corpus.select("author", "pid", "txt", "n"), attested_but(corpus, "a", query, [33]), 10).collect()
    assert [(r.query_txt, r.pid) for r in got] == [(query, 33)]


def test_pool_selection_by_hand(spark):
    pool = [(f"p{i}", ["MORPH"] * (i % 7 == 0) + ["SUBST"] * (i % 5 == 0) + ["COPY"]) for i in range(200)]
    df = spark.createDataFrame(pool, "id string, tags array<string>").repartition(3)
    draws = {r.id: r.o for r in df.select("id", sy.tx.draw(1, F.col("id")).alias("o")).collect()}
    for size, floor in ((50, 10), (12, 10), (500, 60)):
        want, left = {}, sorted((i for i, _ in pool), key=draws.get)
        for tag in ("MORPH", "SUBST", None):
            picked = [i for i in left if tag is None or tag in dict(pool)[i]][: min(floor if tag else size, size - len(want))]
            want |= {i: tag or "fill" for i in picked}
            left = [i for i in left if i not in want]
        assert {r.id: r.why for r in sy.select_pool(df, size, ("MORPH", "SUBST"), rare_min=floor).collect()} == want


def test_most_shared_forms_block_by_block(spark, monkeypatch):
    import numpy as np
    import pytest

    monkeypatch.setattr(ng, "COMPARED", 7)
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{x}" for x in rng.choice(15, size=int(rng.integers(5, 9))))
    corpus = [(pid, "ab"[pid % 3 == 0], text()) for pid in range(60)]
    corpus += [(60 + i, a, t) for i, (_, a, t) in enumerate(corpus[:5])]  # copies
    corpus += corpus[7:20:2]  # the same row twice
    asked = [(f"r{i}", "abc"[i % 3], corpus[i][2], corpus[int(rng.integers(60))][2] if i % 4 else "x1 x2 x3 x4 x5 x6") for i in range(40)]
    barred = [(corpus[int(rng.integers(60))][2], asked[int(rng.integers(40))][3]) for _ in range(200)]
    asked.append(asked[5])
    rows = spark.createDataFrame([(*x, x[3].split(), len(x[3].split())) for x in asked], "id string, author string, cited_txt string, query_txt string, query_norm array<string>, n_q int")
    df = spark.createDataFrame([(p, a, t, t.split(), len(t.split())) for p, a, t in corpus], "pid long, author string, txt string, toks array<string>, n int")
    got = {r.id: (r.pid, r.n_shared) for r in ng.lexical(rows, df, spark.createDataFrame(barred, "txt string, query_txt string")).collect()}
    want = {}
    for i, author, cited, query in asked:
        usable = [(-len(set(t.split()) & set(query.split())) * corpus.count((p, a, t)) * (1 + (i == "r5")), p) for p, a, t in corpus
                  if a == author and t != cited and (t, query) not in barred and len(t.split()) >= 6 and len(query.split()) >= 6]
        if usable:
            n, p = min(usable)
            want[i] = (p, -n)
    assert got == want and {n for _, n in want.values()} >= {0, 5, 14}
    # no form of a passage is sent to the queries
    monkeypatch.setattr(ng, "usable", lambda *_: pytest.fail("passages were joined to rows"))
    few = rows.filter("author = 'a' and query_txt not like 'x1%' and n_q >= 6")
    assert ng.lexical(few.filter(F.col("id").isin([i for i, (_, n) in want.items() if n > 0])), df, df.limit(0).select("txt", F.col("txt").alias("query_txt"))).count() > 0
