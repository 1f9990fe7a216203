"""Scoring of links, scripts, annotations and score tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as tx


def word_decisions(rwords: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(pair_id, t, g, p): one gold and one predicted source per reuse word, -1 for none."""
    g = gold.select("pair_id", "t", F.col("s").alias("g"))
    p = pred.select("pair_id", "t", F.col("s").alias("p"))
    return (
        rwords.select("pair_id", "t", "norm")
        .join(g, ["pair_id", "t"], "left")
        .join(p, ["pair_id", "t"], "left")
        .select("pair_id", "t", "norm", F.coalesce("g", F.lit(-1)).alias("g"), F.coalesce("p", F.lit(-1)).alias("p"))
    )


def best_and_worst(rwords: DataFrame, swords: DataFrame, *, gold: DataFrame, pred: DataFrame, k: int = 5, min_links: int = 3) -> DataFrame:
    """The ``k`` worst and ``k`` best pairs to read: by accuracy, then by (hard) gold links."""
    words = word_decisions(rwords, gold, pred).join(
        swords.select("pair_id", F.col("s").alias("g"), F.col("norm").alias("sn")), ["pair_id", "g"], "left"
    )
    per = (
        words.groupBy("pair_id")
        .agg(
            F.avg((F.col("g") == F.col("p")).cast("int")).alias("acc"),
            F.count_if(F.col("g") >= 0).alias("links"),
            F.count_if((F.col("g") >= 0) & (F.col("sn") != F.col("norm"))).alias("hard"),
        )
        .filter(F.col("links") >= min_links)
    )

    def top(order: list[Column], side: str) -> DataFrame:
        rows = per.orderBy(*order).limit(k)
        return rows.select(F.lit(side).alias("side"), "pair_id", F.row_number().over(W.orderBy(*order)).alias("rank"))

    worst = top([F.asc("acc"), F.desc("links"), F.asc("pair_id")], "worst")
    best = top([F.desc("acc"), F.desc("hard"), F.desc("links"), F.asc("pair_id")], "best")
    return worst.unionByName(best)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall, F1; an empty side counts 0."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1")]


def compare_sets(gold: DataFrame, pred: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn of two item sets by one aggregate per item, optionally per group columns (a subset of keys)."""
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1)).withColumn("p", F.lit(0))
    p = pred.select(*keys).distinct().withColumn("g", F.lit(0)).withColumn("p", F.lit(1))
    item = g.unionByName(p).groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    counts = [
        F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"),
        F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"),
    ]
    return item.groupBy(*by).agg(*counts) if by else item.agg(*counts)


def with_prf(counts: DataFrame) -> DataFrame:
    return counts.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def script_items(script: DataFrame) -> DataFrame:
    """(pair_id, s, t, tag): each written place with its source, deletions and markers with their first source."""
    one = F.array(F.lit(-1))
    x = script.select("pair_id", "tag", F.when(F.size("src") == 0, one).otherwise(F.col("src")).alias("src"), F.when(F.size("tgt") == 0, one).otherwise(F.col("tgt")).alias("tgt"))
    return x.select("pair_id", "tag", "src", F.posexplode("tgt").alias("k", "t")).select(
        "pair_id", F.get("src", F.least("k", F.size("src") - 1)).alias("s"), "t", "tag"
    ).distinct()


def script_metrics(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Set scores of two scripts: alignment, typed, and each operation: (view, tag, tp, fp, fn, …)."""
    g, p = script_items(gold), script_items(pred)
    align = compare_sets(g, p, ["pair_id", "s", "t"]).select(F.lit("alignment").alias("view"), F.lit("").alias("tag"), "tp", "fp", "fn")
    typed = compare_sets(g, p, ["pair_id", "s", "t", "tag"]).select(F.lit("typed").alias("view"), F.lit("").alias("tag"), "tp", "fp", "fn")
    per = compare_sets(g, p, ["pair_id", "s", "t", "tag"], ["tag"]).select(F.lit("operation").alias("view"), "tag", "tp", "fp", "fn")
    return with_prf(align.unionByName(typed).unionByName(per))


def script_summary(gold: DataFrame, pred: DataFrame, trivial: DataFrame, replayed: DataFrame) -> DataFrame:
    """(metric, value): two sets of scripts compared as a whole.

    Alignment and typed scores; the same for the two floors, the script that copies place by place and the one that explains
    nothing (``trivial``: method, pair_id, tag, s, t); the mean F1 over the operations gold holds; links told exactly
    and links whose source is used at all; pairs without a script, which match nothing; and the share of scripts that write
    the reuse (``replayed``: pair_id, ok)."""
    g, p = script_items(gold), script_items(pred)
    keys = ["pair_id", "s", "t", "tag"]
    sides = {
        "alignment": (g.select(*keys[:3]), p.select(*keys[:3]), keys[:3]), "typed": (g, p, keys),
        "copy_only": (g, trivial.filter("method = 'copy_only'"), keys), "degenerate": (g, trivial.filter("method = 'degenerate'"), keys),
    }
    rows = None

    def add(df: DataFrame) -> None:
        nonlocal rows
        rows = df if rows is None else rows.unionByName(df)

    for name, (a, b, by) in sides.items():
        prf_ = with_prf(compare_sets(a, b, by))
        add(prf_.select(*[F.col(c).alias(f"{name} {c}") for c in ("precision", "recall", "f1")]).unpivot([], [f"{name} {c}" for c in ("precision", "recall", "f1")], "metric", "value"))
    per = compare_sets(g, p, keys, ["tag"]).filter("tp + fn > 0")
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    add(per.agg(F.round(F.avg(f1), 6).alias("value")).select(F.lit("macro typed f1").alias("metric"), "value"))
    link = lambda df: df.filter("s >= 0 and t >= 0").groupBy("pair_id", "t").agg(F.min("s").alias("s"))
    gl, pl = link(g), link(p)
    used = pl.select("pair_id", "s").distinct().withColumn("used", F.lit(1))
    x = gl.join(pl.select("pair_id", "t", F.col("s").alias("ps")), ["pair_id", "t"], "left").join(used, ["pair_id", "s"], "left")
    add(x.agg(
        F.round(F.avg(F.coalesce(F.col("ps") == F.col("s"), F.lit(False)).cast("int")), 6).alias("link strict"),
        F.round(F.avg(F.coalesce("used", F.lit(0))), 6).alias("link lenient"),
    ).unpivot([], ["link strict", "link lenient"], "metric", "value"))
    missing = gold.select("pair_id").distinct().join(pred.select("pair_id").distinct(), "pair_id", "left_anti")
    add(missing.agg(F.count("*").cast("double").alias("value")).select(F.lit("invalid").alias("metric"), "value"))
    add(replayed.agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("value")).select(F.lit("exec match").alias("metric"), "value"))
    return rows


def token_accuracy(words: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One decision per reuse word; "none" is a class; a merely possible link counts as right. ``gold`` has
    (pair_id, t, s, sure). Returns (pair_id, right, total)."""
    g = gold.groupBy("pair_id", "t").agg(F.max(F.col("sure").cast("int")).alias("sure"))
    p = pred.select("pair_id", "t", F.col("s").alias("p"))
    hit = gold.select("pair_id", "t", F.col("s").alias("p"), F.lit(1).alias("hit"))
    x = words.select("pair_id", "t").join(p, ["pair_id", "t"], "left").join(g, ["pair_id", "t"], "left").join(hit, ["pair_id", "t", "p"], "left")
    right = F.when(F.col("p").isNotNull(), F.coalesce("hit", F.lit(0))).otherwise(1 - F.coalesce("sure", F.lit(0)))
    return x.groupBy("pair_id").agg(F.sum(right).alias("right"), F.count("*").alias("total"))


def link_scores(gold: DataFrame, pred: DataFrame, *, alpha: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Sure/possible link scores: precision on possible, recall on sure links, F(alpha), F1, AER."""
    keys = [*(by or []), "pair_id", "t", "s"]
    g = gold.select(*keys, F.col("sure").cast("int").alias("sure"), F.lit(1).alias("poss"), F.lit(0).alias("a"))
    p = pred.select(*keys, F.lit(0).alias("sure"), F.lit(0).alias("poss"), F.lit(1).alias("a"))
    item = g.unionByName(p).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("sure", "poss", "a")])
    aggs = [
        F.sum(F.col("poss") * F.col("a")).alias("n_pa"), F.sum(F.col("sure") * F.col("a")).alias("n_sa"), F.sum("a").alias("n_pred"),
        F.sum("sure").alias("n_sure"), F.sum("poss").alias("n_possible"),
    ]
    n = item.groupBy(*by).agg(*aggs) if by else item.agg(*aggs)
    pr = F.when(F.col("n_pred") > 0, F.col("n_pa") / F.col("n_pred")).otherwise(0.0)
    rc = F.when(F.col("n_sure") > 0, F.col("n_sa") / F.col("n_sure")).otherwise(0.0)
    fa = F.when((pr > 0) & (rc > 0), 1.0 / (alpha / pr + (1 - alpha) / rc)).otherwise(0.0)
    aer = F.when(F.col("n_sure") + F.col("n_pred") > 0, 1.0 - (F.col("n_pa") + F.col("n_sa")) / (F.col("n_sure") + F.col("n_pred"))).otherwise(1.0)
    f1 = F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0)
    return n.select(*(by or []), "n_pred", "n_sure", "n_possible", *[F.round(c, 6).alias(a) for c, a in ((pr, "precision"), (rc, "recall"), (fa, "f"), (f1, "f1"), (aer, "aer"))])


def op_items(words: DataFrame, swords: DataFrame, level: str, *, keep: Column | None = None, with_source: bool = True) -> DataFrame:
    """Items of a typed word table at a level: (pair_id, side, i, s, label). ``keep`` unlinks the words it is
    false for; deletions are items of the source side."""
    from palimpsest.functions import labels as lb

    linked = F.col("s") >= 0 if keep is None else (F.col("s") >= 0) & keep
    op = F.when(linked, lb.canonical_op(F.col("tag"))).otherwise("INS")
    framed = ~linked & (F.col("frame") == 1)
    w = words.select("pair_id", F.lit("r").alias("side"), F.col("t").alias("i"), F.when(linked, F.col("s")).otherwise(-1).alias("s"), lb.collapse(level, op, framed).alias("label"))
    if not with_source:
        return w
    used = words.filter(linked).select("pair_id", "s").distinct()
    dels = swords.select("pair_id", "s").join(used, ["pair_id", "s"], "left_anti").select(
        "pair_id", F.lit("s").alias("side"), F.col("s").alias("i"), "s", lb.collapse(level, F.lit("DEL"), F.lit(False)).alias("label")
    )
    return w.unionByName(dels)


def op_scores(gold_words: DataFrame, pred_words: DataFrame, swords: DataFrame, level: str) -> DataFrame:
    """Per class: tp, fp, fn and scores. Possible-only items are hits when found and no misses when not.

    ``gold_words`` carries ``sure``; possible-only links make a word's "none" item unscored.
    """
    keys = ["pair_id", "side", "i", "s", "label"]
    every = op_items(gold_words, swords, level)
    sure = op_items(gold_words, swords, level, keep=F.col("sure"))
    loose = every.join(sure, keys, "left_anti")
    words = loose.filter("side = 'r'").select("pair_id", "side", "i").distinct().withColumn("x", F.lit(1))
    sure = sure.join(words, ["pair_id", "side", "i"], "left").filter("x is null or s >= 0").drop("x")
    pred = op_items(pred_words, swords, level)
    tagged = (
        sure.select(*keys, F.lit(1).alias("su"), F.lit(0).alias("po"), F.lit(0).alias("pr"))
        .unionByName(loose.select(*keys, F.lit(0).alias("su"), F.lit(1).alias("po"), F.lit(0).alias("pr")))
        .unionByName(pred.select(*keys, F.lit(0).alias("su"), F.lit(0).alias("po"), F.lit(1).alias("pr")))
        .groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("su", "po", "pr")])
    )
    hit = F.greatest("su", "po")
    counts = tagged.groupBy("label").agg(
        F.sum(F.col("pr") * hit).alias("tp"), F.sum(F.col("pr") * (1 - hit)).alias("fp"),
        F.sum(F.col("su") * (1 - F.col("pr"))).alias("fn"), F.sum("su").alias("sure"), F.sum(F.col("su") * F.col("pr")).alias("sure_found"),
    )
    return with_prf(counts)


def confusion(gold_words: DataFrame, pred_words: DataFrame, level: str) -> DataFrame:
    g = op_items(gold_words, gold_words, level, with_source=False).select("pair_id", "i", F.col("label").alias("gold"))
    p = op_items(pred_words, pred_words, level, with_source=False).select("pair_id", "i", F.col("label").alias("pred"))
    return g.join(p, ["pair_id", "i"]).groupBy("gold", "pred").agg(F.count("*").alias("n"))


def agreement(links_a: DataFrame, links_b: DataFrame) -> DataFrame:
    """IAA 2AB / (A + B) and Cohen's kappa over the cells either annotator linked."""
    c = compare_sets(links_a, links_b, ["pair_id", "t", "s"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    n = tp + fp + fn
    pa, pb = (tp + fn) / n, (tp + fp) / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    return c.select(
        F.round(2 * tp / (2 * tp + fp + fn), 6).alias("iaa"),
        F.round(F.when(pe < 1, (tp / n - pe) / (1 - pe)).otherwise(1.0), 6).alias("kappa"),
    )


def op_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Op accuracy and kappa on the links two typed link sets share: one row."""
    shared = a.select("pair_id", "t", "s", F.col("tag").alias("a")).join(b.select("pair_id", "t", "s", F.col("tag").alias("b")), ["pair_id", "t", "s"])
    conf = shared.groupBy("a", "b").agg(F.count("*").alias("n"))
    # at most labels squared rows from here on
    every = W.partitionBy()
    x = conf.withColumn("total", F.sum("n").over(every)).withColumn("ra", F.sum("n").over(W.partitionBy("a")))
    marg_b = conf.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("nb"))
    marg = conf.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("na")).join(marg_b, "k").agg(F.sum(F.col("na") * F.col("nb")).alias("cross"))
    obs = x.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.max("total").alias("total"))
    j = obs.withColumn("j", F.lit(1)).join(marg.withColumn("j", F.lit(1)), "j")
    po, pe = F.col("same") / F.col("total"), F.coalesce("cross", F.lit(0)) / (F.col("total") * F.col("total"))
    return j.select(F.col("total").alias("shared"), F.round(po, 6).alias("accuracy"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0), 6).alias("kappa"))


def query_scores(rows: DataFrame) -> DataFrame:
    """Macro and micro P/R/F1 and error rates over queries. ``rows`` is (query_id, gold, pred) with 0/1 flags."""
    g, p = F.col("gold"), F.col("pred")
    q = rows.groupBy("query_id").agg(
        F.sum(g * p).alias("tp"), F.sum((1 - g) * p).alias("fp"), F.sum(g * (1 - p)).alias("fn"), F.sum((1 - g) * (1 - p)).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    pr, rc = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    q = q.withColumn("pr", pr).withColumn("rc", rc).withColumn("f1", F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0)).withColumn("m", tp + fn > 0)
    only = lambda c: F.when(F.col("m"), c)
    a = q.agg(
        F.avg(only(F.col("pr"))).alias("macro_p"), F.avg(only(F.col("rc"))).alias("macro_r"), F.avg(only(F.col("f1"))).alias("macro_f1"),
        F.avg(fp / n).alias("fpr"), F.avg(fn / n).alias("fnr"), F.avg((fp + fn) / n).alias("smr"),
        F.sum(only(tp)).alias("tp"), F.sum(only(fp)).alias("fp"), F.sum(only(fn)).alias("fn"),
    )
    mp, mr, mf = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return a.select(*[F.round(c, 6).alias(c) for c in ("macro_p", "macro_r", "macro_f1", "fpr", "fnr", "smr")], mp.alias("micro_p"), mr.alias("micro_r"), mf.alias("micro_f1"))


def plateau_threshold(rows: DataFrame, *, tolerance: float = 0.01) -> DataFrame:
    """(max_f1, plateau_low, plateau_high) over thresholds .01 to .99. ``rows`` is (gold, score).

    Scores fall into hundredths first, so the grid sees at most two counts per hundredth however many
    rows there are.
    """
    binned = rows.groupBy(F.greatest(F.least(F.floor(F.round(F.col("score") * 100, 9)), F.lit(100)), F.lit(0)).alias("h"), "gold").agg(F.count("*").alias("n"))
    grid = binned.select("h", "gold", "n", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("k"))
    up = F.col("h") >= F.col("k")
    s = grid.groupBy("k").agg(
        F.sum(F.when(up & (F.col("gold") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(up & (F.col("gold") == 0), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~up & (F.col("gold") == 1), F.col("n")).otherwise(0)).alias("fn"),
    )
    f1 = F.coalesce(2 * F.col("tp") / F.when(F.col("tp") > 0, 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    f = s.withColumn("f1", f1).withColumn("top", F.max("f1").over(W.partitionBy()))
    near = F.when(F.col("f1") >= F.col("top") - tolerance, F.col("k"))
    return f.agg(
        F.min(F.when(F.col("f1") == F.col("top"), F.col("k"))).alias("max_f1"), F.min(near).alias("plateau_low"), F.max(near).alias("plateau_high")
    ).select(*[(F.col(c) / 100).alias(c) for c in ("max_f1", "plateau_low", "plateau_high")])


def recall_at(rows: DataFrame, ks: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """Mean share of a query's positives among its top k. ``rows`` is (query_id, item, gold, score).

    A positive's rank is 1 + the rows scored above it; only ranks up to the largest k are needed, so
    each hash part of a query is cut to its own top first.
    """
    top = max(ks)
    part = F.pmod(F.xxhash64("item"), F.lit(16))
    order = [F.desc("score"), F.asc("item")]
    pre = rows.withColumn("k", F.row_number().over(W.partitionBy("query_id", part).orderBy(*order))).filter(F.col("k") <= top)
    ranked = pre.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    total = rows.filter("gold = 1").groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranked.filter("gold = 1").groupBy("query_id").agg(*[F.count_if(F.col("k") <= x).alias(f"r{x}") for x in ks])
    return total.join(hits, "query_id", "left").agg(
        *[F.round(F.avg(F.coalesce(f"r{x}", F.lit(0)) / F.col("n")), 6).alias(f"recall_{x}") for x in ks]
    )


def rank_auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve with tie-averaged ranks. ``rows`` is (gold, score).

    Rows are first counted per distinct score; ranks are running sums in two levels (buckets of scores,
    then scores inside a bucket), so neither a hot score nor the whole table meets one task.
    """
    per = rows.groupBy("score").agg(F.sum("gold").alias("pos"), F.count("*").alias("n")).withColumn("b", F.floor(F.col("score") * 4096))
    off = per.groupBy("b").agg(F.sum("n").alias("bn")).withColumn(
        "before", F.sum("bn").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("bn")
    )
    inner = F.sum("n").over(W.partitionBy("b").orderBy("score").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    ranked = per.withColumn("inner", inner).join(off, "b")
    mean_rank = F.col("before") + F.col("inner") + (F.col("n") + 1) / 2.0
    a = ranked.agg(F.sum(F.col("pos") * mean_rank).alias("rs"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("m"))
    return a.select(F.round((F.col("rs") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("m")), 6).alias("auc"))


#: Cumulated chances of 0, 1, 2, ... under a Poisson distribution of mean 1, to nine places.
POISSON = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759, 0.999989751, 0.999998875)


def bootstrap_auc(rows: DataFrame, key: list[str], *, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """(auc, spread, replicates): the area under the ROC curve, ties counted half, and the standard deviation of the same
    area over Poisson bootstrap replicates. ``rows`` is (gold, score, key columns that tell the rows apart).

    Every row draws its weight in every replicate from its own key, so a replicate needs no sampling pass: a score's
    rows are summed where they lie into one array of weights per class, and a bucket of scores turns its arrays into the pairs
    won inside it, all replicates at once. The sums of the buckets before are carried ahead, so no task sees more than a
    bucket, with a score once per batch of rows. Replicate 0 counts every row once."""
    from palimpsest.operators.kernels import bucket_areas, weight_batches

    steps = np.array(POISSON)

    def run(batches):
        yield from weight_batches(batches, replicates, steps)

    drawn = rows.filter("score is not null").select(
        F.col("score").cast("double").alias("score"), F.col("gold").cast("int").alias("gold"), F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).alias("key")
    )
    each = drawn.mapInArrow(run, "score double, b long, pos array<long>, neg array<long>")
    per = each.groupBy("b").applyInArrow(bucket_areas, "b long, rep int, won double, pos long, neg long")
    upto = W.partitionBy("rep").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumn("before", F.sum("neg").over(upto) - F.col("neg"))
    won = F.sum(F.col("won") + F.col("pos") * F.col("before"))
    area = per.groupBy("rep").agg((won / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
    real = F.max(F.when(F.col("rep") == 0, F.col("auc")))
    return area.agg(F.round(real, 6).alias("auc"), F.round(F.stddev_pop(F.when(F.col("rep") > 0, F.col("auc"))), 6).alias("spread"), F.count(F.when(F.col("rep") > 0, F.col("auc"))).alias("replicates"))


def split_half(per_pair: DataFrame, *, n_splits: int = 10) -> DataFrame:
    """Does A beat B with one sign on every half of every drawn halving? ``per_pair`` is (id, a, b).

    Each split ranks the ids by its own draw through bucketed offsets and cuts in the middle.
    """
    from palimpsest.plans.lineage import hash_rank

    n = per_pair.count()
    seeds = per_pair.select("id", "a", "b", F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("seed"))
    ranked = hash_rank(seeds, tx.draw(F.col("seed"), F.col("id")), "k", by=["seed"])
    half = ranked.withColumn("half", F.when(F.col("k") <= n // 2, 0).otherwise(1))
    diff = half.groupBy("seed", "half").agg(F.avg(F.col("a") - F.col("b")).alias("d"))
    signed = diff.withColumn("sg", F.signum(F.round("d", 12)).cast("int"))
    first = F.first("sg").over(W.orderBy("seed", "half").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    judged = signed.withColumn("same", ((F.col("sg") != 0) & (F.col("sg") == first)).cast("int"))
    return judged.agg(F.sum("same").alias("agree"), F.count("*").alias("of"), F.round(F.avg("d"), 6).alias("mean_diff"))


def fold_aggregate(metrics: DataFrame) -> DataFrame:
    """Mean, min, max, population and sample spread per metric over folds: ``metrics`` is (fold, metric, value)."""
    return metrics.groupBy("metric").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"),
        F.round(F.stddev_pop("value"), 6).alias("std"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std_sample"), F.count("*").alias("n"),
    )


def check_annotation(links: DataFrame, spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Problems of hand annotation: (pair_id, severity, message, i). ``links`` is (pair_id, t, s, tag, detail)."""
    from palimpsest.functions import labels as lb

    ops = ("COPY", "MORPH", "SYN", "POS", "NE-SUB", "SUBST", "SPLIT", "MERGE")
    lexical = ("SYN", "POS", "NE-SUB", "SUBST")
    x = links.join(pairs.select("pair_id", "n_s", "n_r", "s_norm", "r_norm"), "pair_id")
    in_r, in_s = F.col("t").between(0, F.col("n_r") - 1), F.col("s").between(0, F.col("n_s") - 1)
    ok = x.filter(in_r & in_s & F.col("tag").isin(*ops)).withColumn("a", F.get("s_norm", F.col("s"))).withColumn("b", F.get("r_norm", F.col("t")))
    stem = F.left("a", F.lit(3)) == F.left("b", F.lit(3))

    def found(df: DataFrame, severity: str, message: str, at: str = "t") -> DataFrame:
        return df.select("pair_id", F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.col(at).alias("i"))

    shared = ok.groupBy("pair_id", "s").agg(F.count("*").alias("n"), F.min((F.col("tag") == "SPLIT").cast("int")).alias("splits"))
    span = spans.join(pairs.select("pair_id", "n_r"), "pair_id")
    covered = span.select("pair_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("t"))
    parts = [
        found(x.filter(~in_r), "error", "outside the reuse"),
        found(x.filter(in_r & ~in_s), "error", "outside the source"),
        found(x.filter(in_r & in_s & ~F.col("tag").isin(*ops)), "error", "not an edge operation"),
        found(ok.groupBy("pair_id", "t").agg(F.count("*").alias("n")).filter("n > 1"), "error", "linked twice"),
        found(ok.filter(lb.detail_error(F.col("tag"), F.col("detail"))), "error", "detail not in the closed list"),
        found(ok.filter((F.col("tag") == "MERGE") & (F.col("detail") == "")), "error", "MERGE without its second word"),
        found(shared.filter("n > 1 and splits = 0"), "error", "source shared without SPLIT", "s"),
        found(span.filter((F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.col("n_r"))), "error", "span outside the reuse", "start"),
        found(covered.join(ok.select("pair_id", "t").distinct(), ["pair_id", "t"], "left_semi"), "error", "word in a formula and linked"),
        found(ok.filter((F.col("tag") == "COPY") & (F.col("a") != F.col("b")) & stem), "warn", "COPY differs after folding"),
        found(ok.filter((F.col("tag") == "COPY") & (F.col("a") != F.col("b")) & ~stem), "warn", "COPY of different words"),
        found(ok.filter((F.col("tag") == "MORPH") & (F.col("a") == F.col("b"))), "warn", "MORPH of the same word"),
        found(ok.filter((F.col("tag") == "MORPH") & (F.col("a") != F.col("b")) & ~stem), "warn", "MORPH without a shared stem"),
        found(ok.filter(F.col("tag").isin(*lexical) & (F.col("a") == F.col("b"))), "warn", "lexical change of the same word"),
        found(ok.filter("tag = 'SPLIT'").groupBy("pair_id", "s").agg(F.count("*").alias("n")).filter("n = 1"), "warn", "SPLIT with one word", "s"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
