"""Candidate pairs from an inverted index, pair guards, pools, splits and text localisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.plans.lineage import BROADCAST_ROWS, cut, fits, hash_rank, is_empty

#: A query word in more than this many passages is salted before the index join.
HOT_ROWS = 100_000

#: Corpus passages are broadcast with their texts up to this many, by a bounded count.
BROADCAST_TEXTS = 100_000


def distinct_passages(df: DataFrame) -> DataFrame:
    """One row per distinct text with its smallest pid. The words are read back off the text, so the
    aggregate carries one long per text and combines map-side."""
    once = df.groupBy("txt").agg(F.min("pid").alias("pid"))
    toks = F.split("txt", " ")
    return once.select("pid", "txt", toks.alias("toks"), F.size(toks).alias("n"))


def _content_rows(df: DataFrame) -> DataFrame:
    return df.select("pid", F.explode(tx.content_tokens(F.col("txt"))).alias("token"))


def _index(corpus: DataFrame, max_df: int) -> tuple[DataFrame, DataFrame]:
    """(token, pid) of the indexed words, and how many corpus passages hold each."""
    c = _content_rows(corpus)
    index_df = c.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") <= max_df)
    return c.join(index_df.select("token"), "token", "left_semi"), index_df


def shared_counts(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    min_shared: int,
    max_df: int,
    hot_rows: int = HOT_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(q, c, n_shared) for every pair that shares at least ``min_shared`` content words.

    The corpus side is the index: words in more than ``max_df`` corpus passages are not indexed (that
    is the operator's definition, not a guard). Two plans, chosen by the counted size of the index:

    * small index: it is broadcast, query passages stay where they are, and all hits of one passage
      meet in one task, so the counts combine before the only shuffle;
    * large index: sort-merge join on (word, salt). A query word in more than ``hot_rows`` passages
      would be one reducer's input; its index rows (at most ``max_df``) are copied once per salt and
      its query rows spread over the salts.
    """
    q = _content_rows(queries)
    index, index_df = _index(corpus, max_df)
    if fits(index, broadcast_rows):
        hits = q.withColumnRenamed("pid", "q").join(
            F.broadcast(index.withColumnRenamed("pid", "c")), "token"
        )
    else:
        hits = _salted_hits(index, index_df, q, hot_rows)
    return hits.groupBy("q", "c").agg(F.count("*").alias("n_shared")).filter(F.col("n_shared") >= min_shared)


def passage_hits(queries: DataFrame, index: DataFrame, *, min_shared: int) -> DataFrame:
    """(pid, txt, hits ARRAY<STRUCT<c, n_shared>>) of the passages (pid, txt) that share at least ``min_shared`` words with
    some passage of a small ``index`` (token, pid). A passage is counted where it lies; nothing is moved."""
    from palimpsest.operators.kernels import HitIndex, hit_batches

    table = index.select("token", F.col("pid").cast("long").alias("pid")).toArrow()
    sent = index.sparkSession.sparkContext.broadcast(HitIndex.of(table["token"], table["pid"]))

    def run(batches):
        yield from hit_batches(batches, sent.value, min_shared)

    return queries.select("pid", "txt", tx.content_tokens(F.col("txt")).alias("token")).mapInArrow(
        run, "pid long, txt string, hits array<struct<c: long, n_shared: long>>"
    )


def _salted_hits(index: DataFrame, index_df: DataFrame, q: DataFrame, hot_rows: int) -> DataFrame:
    # only the index vocabulary is counted on the query side
    q_df = (
        q.join(index_df.select("token"), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("q_df"))
        .withColumn("salts", F.ceil(F.col("q_df") / hot_rows).cast("int"))
    )
    spread = index.join(q_df.select("token", "salts"), "token").select(
        "token",
        F.col("pid").alias("c"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
    )
    # words above the threshold: at most total rows / hot_rows of them
    hot = q_df.filter("salts > 1").select("token", "salts")
    probe = q.join(hot, "token", "left").select(
        "token",
        F.col("pid").alias("q"),
        F.coalesce(F.pmod(F.xxhash64("pid"), F.col("salts")), F.lit(0)).cast("int").alias("salt"),
    )
    return probe.join(spread.hint("merge"), ["token", "salt"])


def overlap_pairs(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    gold: DataFrame | None = None,
    min_shared: int = 2,
    max_df: int = 2000,
    min_tokens: int = 6,
    max_tokens: int = 80,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Every (query, corpus) pair of distinct texts sharing at least ``min_shared`` content words.

    ``corpus`` and ``queries`` carry (pid, txt, toks, n); ``gold`` (txt) lists passages that may appear
    on neither side. Document frequency counts all corpus texts, as the index is built before the guard.
    A small index (by a bounded count) goes to the passages, beyond that the passages go to the index.
    """
    c = distinct_passages(corpus)
    long_enough = F.col("n").between(min_tokens, max_tokens)
    index = _index(c, max_df)[0]
    if fits(index, broadcast_rows):
        # only passages with enough hits are moved at all: copies of a text have the same hits, the smallest pid stands for them
        words = F.split("txt", " ")
        near = passage_hits(queries.filter(F.size(words).between(min_tokens, max_tokens)), index, min_shared=min_shared)
        q = near.groupBy("txt").agg(F.min("pid").alias("pid"), F.any_value("hits").alias("hits"))
        if gold is not None:
            q = q.join(gold.select("txt").distinct(), "txt", "left_anti")
        found = q.select(F.col("pid").alias("q"), F.col("txt").alias("r_txt"), F.inline("hits"))
    else:
        q = distinct_passages(queries).filter(long_enough)
        if gold is not None:
            q = q.join(gold.select("txt").distinct(), "txt", "left_anti")
        # dealt by pid once and written: a passage's hits are counted, and its text joined, where it lies
        q = cut(q.select("pid", "txt").repartition("pid"), laid=True)
        counts = shared_counts(c, q, min_shared=min_shared, max_df=max_df, broadcast_rows=broadcast_rows)
        found = counts.join(q.select(F.col("pid").alias("q"), F.col("txt").alias("r_txt")), "q")
    c_ok = c.filter(long_enough)
    if gold is not None:
        c_ok = c_ok.join(gold.select("txt").distinct(), "txt", "left_anti")
    left = c_ok.select(F.col("pid").alias("c"), F.col("txt").alias("s_txt"))
    left = F.broadcast(left) if fits(left, BROADCAST_TEXTS) else left
    both = found.join(left, "c").filter(F.col("s_txt") != F.col("r_txt"))
    # the words are read back off the texts, so no shuffle carries them
    return both.withColumn("s_tok", F.split("s_txt", " ")).withColumn("r_tok", F.split("r_txt", " "))


def guard_reason(
    source: Column, reuse: Column, in_gold: Column, *, min_tokens: int = 6, max_tokens: int = 80
) -> Column:
    """Why a pair is dropped, first reason first; NULL when it is kept."""
    n_s, n_r = F.size(tx.words(source)), F.size(tx.words(reuse))
    s, r = tx.squeeze(source), tx.squeeze(reuse)
    return (
        F.when((s == "") | (r == "") | (s == r), "dropped_empty_or_identical")
        .when(in_gold, "dropped_gold_passage")
        .when(
            ~n_s.between(min_tokens, max_tokens) | ~n_r.between(min_tokens, max_tokens), "dropped_length"
        )
    )


def guard_pairs(pairs: DataFrame, gold: DataFrame, *, min_tokens: int = 6, max_tokens: int = 80) -> DataFrame:
    """``pairs`` (source, reuse, …) with a ``reason`` column, NULL for pairs that pass."""
    g = gold.select(tx.squeeze(F.col("txt")).alias("_g")).distinct()
    keyed = pairs.withColumn("_s", tx.squeeze(F.col("source"))).withColumn("_r", tx.squeeze(F.col("reuse")))
    a = keyed.join(g.select(F.col("_g").alias("_s"), F.lit(True).alias("_in_s")), "_s", "left")
    b = a.join(g.select(F.col("_g").alias("_r"), F.lit(True).alias("_in_r")), "_r", "left")
    in_gold = F.col("_in_s").isNotNull() | F.col("_in_r").isNotNull()
    return b.withColumn(
        "reason",
        guard_reason(F.col("source"), F.col("reuse"), in_gold, min_tokens=min_tokens, max_tokens=max_tokens),
    ).drop("_s", "_r", "_in_s", "_in_r")


def best_k(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` corpus passages sharing most words, per query; ties to the smaller corpus id."""
    w = W.partitionBy("q").orderBy(F.desc("n_shared"), "c")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranked_pairs(
    pairs: DataFrame,
    *,
    min_p: float = 0.9,
    cap: int = 20000,
    per_source: int = 3,
    one_per_reuse: bool = True,
) -> DataFrame:
    """Best pairs first, each reuse text once, each source text at most ``per_source`` times, ``cap`` in all.

    ``pairs`` is (id, source, reuse, p) already through the guard. The greedy order is (p desc, id). One
    round keeps every pair that is first for its reuse and within its source's open places whatever
    happens elsewhere; rows it blocks leave, and the rounds go on until nothing is open. Equal to the
    one-pass greedy choice, without a global sort.
    """
    key = F.struct((-F.col("p")).alias("np"), F.col("id").alias("id"))
    open_ = cut(pairs.filter(F.col("p") >= min_p).select("id", "source", "reuse", "p"))
    parts: list[DataFrame] = []
    used = None
    while not is_empty(open_):
        ranked = open_
        if one_per_reuse:
            ranked = ranked.withColumn(
                "_ru", F.row_number().over(W.partitionBy("reuse").orderBy(F.desc("p"), "id"))
            )
        else:
            ranked = ranked.withColumn("_ru", F.lit(1))
        if per_source:
            ranked = ranked.withColumn(
                "_rs", F.row_number().over(W.partitionBy("source").orderBy(F.desc("p"), "id"))
            )
            if used is not None:
                ranked = ranked.join(used, "source", "left").withColumn(
                    "_room", per_source - F.coalesce("n_used", F.lit(0))
                )
            else:
                ranked = ranked.withColumn("_room", F.lit(per_source))
        else:
            ranked = ranked.withColumn("_rs", F.lit(1)).withColumn("_room", F.lit(1))
        take = cut(
            ranked.filter((F.col("_ru") == 1) & (F.col("_rs") <= F.col("_room"))).select(
                "id", "source", "reuse", "p"
            )
        )
        parts.append(take)
        rest = open_.join(take.select("id"), "id", "left_anti")
        if one_per_reuse:
            rest = rest.join(take.select("reuse").distinct(), "reuse", "left_anti")
        if per_source:
            now = take.groupBy("source").agg(F.count("*").alias("n_used"))
            if used is not None:
                now = used.unionByName(now).groupBy("source").agg(F.sum("n_used").alias("n_used"))
            used = cut(now)
            rest = rest.join(used.filter(F.col("n_used") >= per_source).select("source"), "source", "left_anti")
        open_ = cut(rest.select("id", "source", "reuse", "p"))
    if not parts:
        return pairs.select("id", "source", "reuse", "p").limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(key).limit(cap) if cap else out


def build_pool(first: DataFrame, second: DataFrame, *, seed: int = 1) -> DataFrame:
    """Union of two strata, the first occurrence of a text pair kept, in a seeded order.

    Both carry (id, source, reuse, stratum, score); ``first`` arrives before ``second``, then by id.
    """
    both = first.withColumn("arr", F.lit(0)).unionByName(second.withColumn("arr", F.lit(1)))
    kept = both.groupBy("source", "reuse").agg(
        F.min_by(F.struct("id", "stratum", "score"), F.struct("arr", "id")).alias("v")
    )
    rows = kept.select("source", "reuse", "v.*")
    return hash_rank(rows, tx.draw(seed, F.col("id")), "pos")


def pool_negatives(pairs: DataFrame, n: int, *, max_p: float = 0.1, seed: int = 1) -> DataFrame:
    """Half low-probability candidates, half re-pairings of their passages (source <> reuse).

    ``pairs`` is (id, source, reuse, p), guarded.
    """
    low = pairs.filter(F.col("p") <= max_p)
    lexical = hash_rank(low, tx.draw(seed, F.col("id")), "k").filter(F.col("k") <= n - n // 2)
    a = hash_rank(low.select("id", "source"), tx.draw(seed + 1, F.col("id")), "k").select("k", "source")
    b = hash_rank(low.select("id", "reuse"), tx.draw(seed, F.col("id")), "k").select("k", "reuse")
    mixed = a.join(b, "k").filter(F.col("source") != F.col("reuse"))
    # the first n // 2 of them in order: rows are ranked by k, a bounded top-n
    random = mixed.orderBy("k").limit(n // 2)
    return lexical.select(F.lit("lexical_low_p").alias("kind"), "source", "reuse").unionByName(
        random.select(F.lit("random").alias("kind"), "source", "reuse")
    )


def localise(pairs: DataFrame, *, slack: int = 4) -> DataFrame:
    """Trim the longer passage to the window that shares most words with the shorter.

    ``pairs`` carries (pair_id, s_norm, r_norm, n_s, n_r). The window's score is a difference of prefix
    sums over the hit flags, all inside the row: no shuffle. Ties go to the earlier window.
    """
    long_is_r = F.col("n_r") > F.col("n_s") + slack
    long_is_s = F.col("n_s") > F.col("n_r") + slack
    long_ = F.when(long_is_r, F.col("r_norm")).otherwise(F.col("s_norm"))
    short = F.when(long_is_r, F.col("s_norm")).otherwise(F.col("r_norm"))
    width = F.least(F.size(long_), F.size(short) + slack)
    hits = F.transform(long_, lambda w: F.array_contains(short, w).cast("int"))
    cum = F.aggregate(
        hits,
        F.array(F.lit(0)),
        lambda acc, h: F.concat(acc, F.array(F.element_at(acc, -1) + h)),
    )
    staged = pairs.withColumn("_cum", cum).withColumn("_w", width).withColumn("_n", F.size(long_))
    scores = F.transform(
        F.sequence(F.lit(0), F.col("_n") - F.col("_w")),
        lambda a: F.struct(
            (-(F.get("_cum", a + F.col("_w")) - F.get("_cum", a))).alias("neg"), a.alias("start")
        ),
    )
    start = F.when(long_is_r | long_is_s, F.array_min(scores)["start"]).otherwise(F.lit(0))
    return (
        staged.withColumn("start", start)
        .withColumn("r_off", F.when(long_is_r, F.col("start")).otherwise(0))
        .withColumn("s_off", F.when(long_is_s, F.col("start")).otherwise(0))
        .withColumn("r_len", F.when(long_is_r, F.col("_w")).otherwise(F.col("n_r")))
        .withColumn("s_len", F.when(long_is_s, F.col("_w")).otherwise(F.col("n_s")))
        .drop("_cum", "_w", "_n", "start")
    )


def grouped_validation(records: DataFrame, *, share: float = 0.2, seed: int = 1) -> DataFrame:
    """Whole groups go to validation, in drawn order, until it holds ``share`` of the records.

    ``records`` is (id, grp). The running total over groups uses the bucketed offsets, so no task
    sees all groups: bucket totals first, then a window inside each bucket.
    """
    sizes = records.groupBy("grp").agg(F.count("*").alias("n"))
    keyed = sizes.withColumn("_k", tx.draw(seed, F.col("grp"))).withColumn("_b", F.left("_k", F.lit(3)))
    per = keyed.groupBy("_b").agg(F.sum("n").alias("bn"))
    off = per.withColumn(
        "before", F.sum("bn").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("bn")
    ).withColumn("total", F.sum("bn").over(W.partitionBy()))
    run = keyed.withColumn(
        "inb",
        F.sum("n").over(W.partitionBy("_b").orderBy("_k", "grp").rowsBetween(W.unboundedPreceding, 0))
        - F.col("n"),
    ).join(off, "_b")
    side = run.select(
        "grp",
        F.when(F.col("before") + F.col("inb") < share * F.col("total"), "valid").otherwise("fit").alias("side"),
    )
    return records.join(side, "grp")


def curve_sample(records: DataFrame, n: int, *, seed: int = 0) -> DataFrame:
    """A nested stratified sample of ``n`` records: each label's share rounded, then topped up from the
    largest label or trimmed at the end. ``records`` is (id, label)."""
    ranked = hash_rank(records, tx.draw(seed, F.col("id")), "rn", by=["label"])
    sizes = records.groupBy("label").agg(F.count("*").alias("size"))
    # one row per label: a handful of rows, so the whole-table windows below are tiny
    every = W.partitionBy()
    plan = (
        sizes.withColumn("total", F.sum("size").over(every))
        .withColumn("take", F.bround(F.lit(float(n)) * F.col("size") / F.col("total"), 0).cast("long"))
        .withColumn("take", F.least("take", "size"))
        .withColumn("want", F.least(F.lit(n).cast("long"), F.col("total")))
        .withColumn("got", F.sum("take").over(every))
        .withColumn("is_largest", F.row_number().over(W.orderBy(F.desc("size"), "label")) == 1)
        .withColumn("after", F.sum("take").over(W.orderBy(F.desc("label")).rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("excess", F.greatest(F.col("got") - F.col("want"), F.lit(0)))
        .withColumn("cut", F.least(F.col("take"), F.greatest(F.col("excess") - F.coalesce("after", F.lit(0)), F.lit(0))))
        .withColumn(
            "take",
            F.col("take")
            - F.col("cut")
            + F.when(F.col("is_largest"), F.greatest(F.col("want") - F.col("got"), F.lit(0))).otherwise(0),
        )
        .select("label", "take")
    )
    return ranked.join(plan, "label").filter(F.col("rn") <= F.col("take")).select("id", "label", "rn")


def nested_fold_roles(records: DataFrame, fold: int, n_folds: int = 5) -> DataFrame:
    """A role per record: the held fold tests, the next one is the dev part of train."""
    dev = (fold + 1) % n_folds
    return records.withColumn(
        "role",
        F.when(F.col("fold") == fold, "test").when(F.col("fold") == dev, "dev").otherwise("train"),
    )


def leaky_flag(records: DataFrame, fold: int) -> DataFrame:
    """Test records of ``fold``, flagged when another fold holds the same source text."""
    test = records.filter(F.col("fold") == fold)
    seen = records.filter(F.col("fold") != fold).select("s_txt").distinct().withColumn("leaky", F.lit(True))
    return test.join(seen, "s_txt", "left").withColumn("leaky", F.coalesce("leaky", F.lit(False)))


def dedupe_pairs(records: DataFrame) -> DataFrame:
    """(id, kept_id): the first id of each text pair; dropped rows have another kept id."""
    first = records.groupBy("s_txt", "r_txt").agg(F.min("id").alias("kept_id"))
    return records.join(first, ["s_txt", "r_txt"]).select("id", "kept_id")


def interleave(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives and negatives alternating in drawn order: (pos, side, id)."""
    a = hash_rank(positives.select("id"), tx.draw("pos", F.col("id")), "k").withColumn("side", F.lit(0))
    b = hash_rank(negatives.select("id"), tx.draw("neg", F.col("id")), "k").withColumn("side", F.lit(1))
    both = a.unionByName(b)
    n_a = positives.agg(F.count("*").alias("na"))
    n_b = negatives.agg(F.count("*").alias("nb"))
    # two one-row aggregates joined on a constant key
    sizes = n_a.withColumn("j", F.lit(1)).join(n_b.withColumn("j", F.lit(1)), "j")
    other = F.when(F.col("side") == 0, F.least(F.col("k") - 1, F.col("nb"))).otherwise(
        F.least(F.col("k"), F.col("na"))
    )
    return (
        both.withColumn("j", F.lit(1))
        .join(F.broadcast(sizes), "j")
        .select((F.col("k") + other).alias("pos"), "side", "id")
    )
