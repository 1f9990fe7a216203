"""Negative pairs: passages of cited authors that are not the cited passage, drawn reproducibly.

Inputs: ``rows`` (id, author, cited_pid, query_txt, query_norm) are the labelled pairs whose query gets
a negative; ``corpus`` (pid, work, seg, author, txt, toks, n) holds every passage; ``attested``
(txt, query_txt) the labelled pairs that may never be negatives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.plans.lineage import cut, fits, hash_rank, is_empty


def usable(cands: DataFrame, attested: DataFrame, *, min_tokens: int = 6, max_tokens: int = 60) -> DataFrame:
    """Candidates (txt, query_txt, n, n_q) of the right length that no label attests."""
    fits = F.col("n").between(min_tokens, max_tokens) & F.col("n_q").between(min_tokens, max_tokens)
    return cands.filter(fits).join(attested.select("txt", "query_txt").distinct(), ["txt", "query_txt"], "left_anti")


def author_index(corpus: DataFrame) -> DataFrame:
    """Every passage with its place in its author's drawn order and the author's passage count."""
    ranked = hash_rank(corpus, tx.draw("easy", F.col("pid")), "k", by=["author"])
    sizes = corpus.groupBy("author").agg(F.count("*").alias("n_author"))
    return ranked.join(sizes, "author")


def first_usable_from(asked: DataFrame, index: DataFrame, attested: DataFrame, *, width: int = 16, **lengths) -> DataFrame:
    """The first usable passage of the author from each row's place on, in drawn order and around its end.

    ``asked`` is (key columns..., author, query_txt, n_q, k0, n_author) with one row per ``_id``; ``index`` comes from
    :func:`author_index`. Rows look at ``width`` passages, those without luck at eight times as many, and so on: only rows
    still without a passage are joined again, and never with more than what they have not seen. A row is left out only
    if none of the author's passages is usable."""
    passages = index.select("author", "k", "pid", "txt", "n")
    out, seen, left = None, 0, asked
    while True:
        offsets = F.explode(F.sequence(F.lit(seen), F.least(F.lit(seen + width), F.col("n_author")) - 1))
        near = left.filter(F.col("n_author") > seen).withColumn("_off", offsets)
        near = near.withColumn("k", F.pmod(F.col("k0") - 1 + F.col("_off"), F.col("n_author")) + 1).join(passages, ["author", "k"])
        found = cut(usable(near, attested, **lengths).groupBy("_id").agg(F.min_by(F.struct("pid", "txt"), "_off").alias("v")).select("_id", "v.*"))
        out = found if out is None else out.unionByName(found)
        seen, width = seen + width, width * 8
        left = cut(left.join(found.select("_id"), "_id", "left_anti").filter(F.col("n_author") > seen))
        if is_empty(left):
            return out


def easy(rows: DataFrame, corpus: DataFrame, attested: DataFrame, *, tries: int = 4, seed: int = 0) -> DataFrame:
    """A drawn passage of a cited author per row: the first usable one of ``tries`` draws. Rows whose draws all fail go on
    from their first draw in the author's drawn order, so a row is left out only if no passage of the author is usable."""
    # the passages are ranked and written once: the draws, and each round for rows without luck, read them
    index = cut(author_index(corpus.select("author", "pid", "txt", "n")))
    sizes = index.groupBy("author").agg(F.max("n_author").alias("n_author"))
    asked = rows.select("id", "author", "query_txt", "n_q").join(sizes, "author")
    place = lambda a: F.floor(tx.unit_draw(seed, F.col("id"), a) * F.col("n_author")).cast("long") + 1
    drawn = asked.withColumn("a", F.explode(F.sequence(F.lit(1), F.lit(tries)))).withColumn("k", place(F.col("a"))).drop("n_author")
    ok = usable(drawn.join(index.select("author", "k", "pid", "txt", "n"), ["author", "k"]), attested)
    first = cut(ok.groupBy("id").agg(F.min_by(F.struct("pid"), "a").alias("v")).select("id", "v.pid"))
    left = cut(asked.join(first, "id", "left_anti").withColumn("k0", place(F.lit(1))).withColumn("_id", F.col("id")))
    if is_empty(left):
        return first
    return first.unionByName(first_usable_from(left, index, attested).select(F.col("_id").alias("id"), "pid"))


#: Passages, and queries, of one author that a task compares at once.
COMPARED = 16_000


def _blocks(df: DataFrame, key: str, mine: str, other: str, sizes: DataFrame) -> DataFrame:
    """``df`` dealt into its author's blocks, ``mine``, by ``key``, and repeated for every block of the other side."""
    upto = lambda c: F.ceil(F.col(f"n_{c}") / COMPARED).cast("int")
    dealt = df.join(F.broadcast(sizes) if fits(sizes) else sizes, "author")
    dealt = dealt.withColumn(mine, F.pmod(F.xxhash64(key), upto(mine)).cast("int"))
    dealt = dealt.withColumn(other, F.explode(F.sequence(F.lit(0), upto(other) - 1)))
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return dealt.drop("n_p", "n_q").repartition(parts, "author", "p", "q")


def two_most_shared(queries: DataFrame, passages: DataFrame, barred: DataFrame) -> DataFrame:
    """(qid, n_shared, pid, txt): the two passages of the query's author that share most forms with it, the smaller pid first
    among equals. ``queries`` is (qid, author, query_txt, forms), ``passages`` (author, txt, pid, rows) with every text of an author once,
    ``barred`` (txt, query_txt) what may not meet. An author's passages and queries meet block by block; a pair of blocks counts
    the shared forms where it lies and hands on two passages per query."""
    from palimpsest.operators.kernels import most_shared

    sizes = passages.groupBy("author").agg(F.count("*").alias("n_p")).join(queries.groupBy("author").agg(F.count("*").alias("n_q")), "author")
    never = barred.select("txt", "query_txt").distinct().join(passages.select("author", "txt"), "txt")
    never = never.join(queries.select("author", "query_txt", "qid"), ["author", "query_txt"])
    never = never.groupBy("author", "txt").agg(F.collect_list("qid").alias("not_for"))
    sizes = cut(sizes)
    asked = _blocks(queries.select("author", "qid", "forms"), "qid", "q", "p", sizes)
    given = _blocks(passages.join(never, ["author", "txt"], "left"), "txt", "p", "q", sizes).select(
        "author", "p", "q", "pid", "txt", "rows", F.array_distinct(F.transform(F.split("txt", " "), lambda w: tx.normalize(w))).alias("forms"),
        F.coalesce("not_for", F.array().cast("array<bigint>")).alias("not_for"),
    )
    best = asked.groupBy("author", "p", "q").cogroup(given.groupBy("author", "p", "q")).applyInArrow(
        most_shared, "qid long, n_shared long, pid long, txt string"
    )
    w = W.partitionBy("qid").orderBy(F.desc("n_shared"), "pid")
    return best.withColumn("k", F.row_number().over(w)).filter("k <= 2")


def lexical(rows: DataFrame, corpus: DataFrame, attested: DataFrame) -> DataFrame:
    """The passage of the cited author with most forms of the query that is not the cited one; ties to
    the smaller pid. Equal queries of an author are asked once, and equal texts of an author stand for each other; as only one
    text can be the cited one, the two best texts per query are enough. Forms count once for every row of the passage, and of
    the query's id. A row that shares no form with any usable passage
    takes the author's usable passage of the smallest pid."""
    each = corpus.filter(F.col("n").between(6, 60)).groupBy("author", "txt", "pid").agg(F.count("*").alias("rows"))
    first = F.max_by(F.struct("pid", "rows"), F.struct(F.col("rows").alias("n"), (-F.col("pid")).alias("np"))).alias("v")
    passages = cut(each.groupBy("author", "txt").agg(first).select("author", "txt", "v.*"))
    forms = F.array_sort(F.array_distinct("query_norm")).alias("forms")
    asking = rows.filter(F.col("n_q").between(6, 60)).select("id", "author", "cited_txt", "query_txt", forms)
    asking = asking.groupBy(*asking.columns).agg(F.count("*").alias("_times"))
    queries = cut(asking.select("author", "query_txt", "forms").distinct().withColumn("qid", F.monotonically_increasing_id()))
    best = two_most_shared(queries, passages, attested).select("qid", "n_shared", "pid", "txt")
    cands = asking.join(queries.join(best, "qid"), ["author", "query_txt", "forms"]).filter(F.col("txt") != F.col("cited_txt"))
    cands = cands.withColumn("n_shared", F.col("n_shared") * F.col("_times"))
    first = F.struct(F.col("n_shared").alias("n"), (-F.col("pid")).alias("np"))
    found = cut(cands.groupBy("id").agg(F.max_by(F.struct("pid", "n_shared"), first).alias("v")).select("id", "v.pid", "v.n_shared"))
    left = cut(rows.select("id", "author", "cited_txt", "query_txt", "n_q").join(found, "id", "left_anti"))
    if is_empty(left):
        return found
    rest = usable(left.join(corpus.select("author", "pid", "txt", "n"), "author").filter("txt <> cited_txt"), attested)
    return found.unionByName(rest.groupBy("id").agg(F.min("pid").alias("pid")).withColumn("n_shared", F.lit(0).cast("bigint")))


def adjacent(rows: DataFrame, corpus: DataFrame, attested: DataFrame, *, seed: int = 0) -> DataFrame:
    """The passage just before or after the cited one in its work, the drawn side first."""
    near = rows.select(
        "id", "query_txt", "n_q", "cited_pid", F.explode(F.array(F.lit(-1), F.lit(1))).alias("step")
    ).select(
        "id", "query_txt", "n_q", "step", F.expr("cited_pid div 1000000").alias("work"),
        F.expr("cast(cited_pid % 1000000 + step as int)").alias("seg"),
    )
    cands = near.join(corpus.select("work", F.col("seg").cast("int").alias("seg"), "pid", "txt", "n"), ["work", "seg"])
    ok = usable(cands, attested)
    return ok.groupBy("id").agg(
        F.min_by("pid", tx.draw(seed, F.col("id"), F.col("step"))).alias("pid")
    )


def batch(parts: dict[str, DataFrame], rows: DataFrame, corpus: DataFrame, held: DataFrame, n: int, *, seed: int = 0) -> DataFrame:
    """``n // kinds`` negatives of each kind; no (source, query) twice, nothing held out on either side.

    ``parts`` maps a kind to (id, pid); ``held`` (nkey) lists normalised held-out texts.
    """
    per_kind = max(n // max(len(parts), 1), 1)
    union = None
    for order, (kind, df) in enumerate(parts.items()):
        part = df.select("id", "pid").withColumn("kind", F.lit(kind)).withColumn("o", F.lit(order))
        union = part if union is None else union.unionByName(part)
    full = union.join(rows.select("id", "query_txt"), "id").join(corpus.select("pid", "txt"), "pid")
    gone = held.select("nkey").distinct()
    clean = (
        full.withColumn("nkey", tx.normalize(F.col("query_txt")))
        .join(gone, "nkey", "left_anti")
        .withColumn("nkey", tx.normalize(F.col("txt")))
        .join(gone, "nkey", "left_anti")
        .drop("nkey")
    )
    once = clean.groupBy("txt", "query_txt").agg(F.min(F.struct("o", "id", "kind", "pid")).alias("v")).select("v.*")
    ranked = hash_rank(once, tx.draw(seed, F.col("kind"), F.col("id")), "k", by=["kind"])
    return ranked.filter(F.col("k") <= per_kind).select("kind", "id", "pid", "k")


def author_mismatch(
    queries: DataFrame, sources: DataFrame, attested: DataFrame, n: int, *, tries: int = 3, seed: int = 42
) -> DataFrame:
    """Pairs of a query and a labelled source of an author it cites, not attested; ``n`` in drawn order.

    ``queries`` is (query_txt, author), ``sources`` (author, pid, txt, n). Every usable one of ``tries`` draws counts; a query
    whose draws all fail takes the first usable source from its first draw on.
    """
    lengths = {"min_tokens": 4, "max_tokens": 1 << 30}
    ranked = hash_rank(sources, tx.draw(seed, F.col("pid")), "k", by=["author"])
    sizes = sources.groupBy("author").agg(F.count("*").alias("n_author"))
    asked = queries.distinct().join(sizes, "author").withColumn("n_q", F.size(tx.words(F.col("query_txt"))))
    place = lambda a: F.floor(tx.unit_draw(seed, F.col("query_txt"), F.col("author"), a) * F.col("n_author")).cast("long") + 1
    drawn = asked.withColumn("a", F.explode(F.sequence(F.lit(1), F.lit(tries)))).withColumn("k", place(F.col("a")))
    ok = usable(drawn.join(ranked.select("author", "k", "pid", "txt", "n"), ["author", "k"]), attested, **lengths)
    once = cut(ok.select("query_txt", "author", "pid", "txt").distinct())
    left = cut(asked.join(once.select("query_txt", "author"), ["query_txt", "author"], "left_anti").withColumn("k0", place(F.lit(1))))
    if not is_empty(left):
        left = left.withColumn("_id", F.struct("query_txt", "author"))
        more = first_usable_from(left, ranked, attested, **lengths)
        once = once.unionByName(more.select("_id.query_txt", "_id.author", "pid", "txt"))
    return once.withColumn("o", tx.draw(seed, F.col("query_txt"), F.col("pid"))).orderBy("o").limit(n)


def density_by_type(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Mean share of linked reuse words per pair label."""
    per = links.groupBy("pair_id").agg(F.count_distinct("t").alias("n_linked"))
    return (
        pairs.join(per, "pair_id", "left")
        .groupBy("pair_label")
        .agg(F.round(F.avg(F.coalesce("n_linked", F.lit(0)) / F.col("n_r")), 6).alias("density"))
    )


def safe_seeds(pairs: DataFrame, fold: int, *, min_tokens: int = 4) -> DataFrame:
    """Source texts outside the held fold and never in more than one fold."""
    per = pairs.groupBy("s_txt").agg(
        F.count_distinct("fold").alias("folds"), F.max((F.col("fold") == fold).cast("int")).alias("held"),
        F.max("n_s").alias("n_s"),
    )
    return per.filter((F.col("folds") == 1) & (F.col("held") == 0) & (F.col("n_s") >= min_tokens)).select("s_txt")
