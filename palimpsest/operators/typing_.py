"""Naming the operation on a link, citing formulas, and repairs of a typed word table.

A typed word table is (pair_id, n_s, n_r, t, word, norm, s, tag, frame): s = -1 and tag 'INS' for an
unlinked word, frame 0/1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.plans.lineage import cut

# Words that announce a quotation.
FRAME_KEYWORDS = (
    "ait", "inquit", "dicit", "dixit", "scribit", "scripsit", "testatur", "loquitur", "canit", "cecinit",
    "legimus", "legitur", "dicens", "dicente",
)
# Tags that count as a substitution.
SUBST_LIKE = ("SUBST", "SYN", "SYN-DIST", "HYPER", "HYPO", "ANT", "NE-SUB", "POS")


def rule_tag(*, syn_cos: float = 0.65, ne_floor: float = 0.5, spelling_fold: bool = True) -> Column:
    """The ordered decision list over a feature row with the words ``sw`` and ``rw``."""
    c = F.col
    same = c("same_form") == 1
    if spelling_fold:
        same = same | (tx.spelling_key(c("sw")) == tx.spelling_key(c("rw")))
    close = (c("cos_missing") == 0) & (c("cos") >= syn_cos) & (c("same_pos") == 1)
    named = (c("both_names") == 1) & ((c("cos_missing") == 1) | (c("cos") >= ne_floor))
    return (
        F.when(same, "COPY")
        .when(c("enclitic_stem_match") == 1, F.when((c("enclitic_src") == 1) & (c("enclitic_tgt") == 0), "SPLIT").otherwise("MERGE"))
        .when(c("same_lemma") == 1, "MORPH")
        .when((c("wn_syn") == 1) | close, "SYN")
        .when(c("wn_deriv") == 1, "POS")
        .when(named, "NE-SUB")
        .otherwise("SUBST")
    )


def rule_type(links: DataFrame, evidence: DataFrame, **dials) -> DataFrame:
    """(pair_id, t, s, tag, outcome, detail) per link, from the evidence of its cell."""
    rows = links.select("pair_id", "t", "s").join(evidence, ["pair_id", "t", "s"]).withColumn("tag", rule_tag(**dials))
    lexical = F.col("tag").isin("SYN", "POS", "NE-SUB", "SUBST")
    outcome = (
        F.when(lexical & (F.col("lemma_missing") == 1), "lemma_missing")
        .when(F.col("tag") == "SUBST", "no_rel_found").otherwise("")
    )
    detail = F.when(
        lexical,
        F.when(F.col("wn_hyper") == 1, "HYPER").when(F.col("wn_hypo") == 1, "HYPO").when(F.col("wn_ant") == 1, "ANT").otherwise(""),
    ).otherwise("")
    return rows.withColumn("outcome", outcome).withColumn("detail", detail)


def typed_words(rwords: DataFrame, links: DataFrame, evidence: DataFrame, keywords: tuple[str, ...] = FRAME_KEYWORDS) -> DataFrame:
    """The word table of a set of links, rule-typed, with the citing-formula flags of the words left over."""
    typed = rule_type(links, evidence).select("pair_id", "t", "s", "tag")
    words = rwords.join(typed, ["pair_id", "t"], "left").select(
        "pair_id", "n_s", "n_r", "t", "word", "norm",
        F.coalesce("s", F.lit(-1)).alias("s"), F.coalesce("tag", F.lit("INS")).alias("tag"),
    )
    # the rule reads the words a dozen times: the joins above run once
    return formula_rule(cut(words, laid=True).withColumn("frame", F.lit(0)), keywords)


def ordered(words: DataFrame) -> DataFrame:
    """One row per pair with its words as an array in order: the shape the sequential rules fold over."""
    item = F.struct("t", "word", "norm", "s", *(["tag"] if "tag" in words.columns else []), *(["frame"] if "frame" in words.columns else []))
    return words.groupBy("pair_id").agg(F.array_sort(F.collect_list(item)).alias("w"))


# ---- citing formulas ---------------------------------------------------------------------------------


def sentence_starts(words: DataFrame) -> DataFrame:
    """``start``: the first word of the stretch that reaches back from t to the last strong stop or link."""
    w = W.partitionBy("pair_id").orderBy("t")
    stop = (F.lag("s").over(w) >= 0) | F.lag("word").over(w).rlike(r"[.;:?!]$")
    marked = words.withColumn("_open", F.when(stop | (F.col("t") == 0), F.col("t")))
    return marked.withColumn(
        "start", F.last("_open", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    ).drop("_open")


def colon_formula(words: DataFrame, *, max_len: int = 40) -> DataFrame:
    """The clause before a colon that stands right before the first link: (pair_id, t, frame = 1)."""
    first = words.filter("s >= 0").groupBy("pair_id").agg(F.min("t").alias("first"))
    at = sentence_starts(words).join(first, "pair_id").filter(
        (F.col("t") == F.col("first") - 1) & (F.col("first") >= 2) & F.col("word").endswith(":")
        & (F.col("t") - F.col("start") + 1 <= max_len)
    )
    return at.select("pair_id", F.explode(F.sequence("start", "t")).alias("t"), F.lit(1).alias("frame"))


def runs(df: DataFrame, flag: Column, *, extra: list[Column] | None = None) -> DataFrame:
    """Runs of consecutive flagged words: (pair_id, a, b), both ends inclusive."""
    on = df.filter(flag)
    w = W.partitionBy("pair_id").orderBy("t")
    isl = on.withColumn("_g", F.col("t") - F.row_number().over(w))
    return isl.groupBy("pair_id", "_g").agg(F.min("t").alias("a"), F.max("t").alias("b"), *(extra or [])).drop("_g")


def adjacent_formulas(words: DataFrame, *, max_gap: int = 2, one_span: bool = True) -> DataFrame:
    """Formula runs that end at most ``max_gap`` words before the next link; of several, the one whose next
    link comes first: (pair_id, a, b)."""
    w = W.partitionBy("pair_id").orderBy("t").rowsBetween(1, W.unboundedFollowing)
    nxt = words.withColumn("nxt", F.first(F.when(F.col("s") >= 0, F.col("t")), ignorenulls=True).over(w))
    spans = runs(nxt, F.col("frame") == 1, extra=[F.max_by("nxt", "t").alias("nxt")]).filter(F.col("nxt") - F.col("b") <= max_gap)
    if one_span:
        k = F.row_number().over(W.partitionBy("pair_id").orderBy("nxt", "a"))
        spans = spans.withColumn("k", k).filter("k = 1")
    return spans.select("pair_id", "a", "b")


def span_words(spans: DataFrame) -> DataFrame:
    return spans.select("pair_id", F.explode(F.sequence("a", "b")).alias("t"), F.lit(1).alias("frame"))


def set_frame(words: DataFrame, flagged: DataFrame) -> DataFrame:
    return words.drop("frame").join(flagged.select("pair_id", "t", "frame").distinct(), ["pair_id", "t"], "left").withColumn(
        "frame", F.coalesce("frame", F.lit(0))
    )


def extend_formulas(words: DataFrame, *, max_len: int = 40, colon_rule: bool = True) -> DataFrame:
    """Formula runs extended left to the sentence start; where a pair has none, the colon rule."""
    starts = sentence_starts(words)
    spans = runs(starts, F.col("frame") == 1, extra=[F.min_by("start", "t").alias("start")])
    wide = spans.select(
        "pair_id", F.when(F.col("b") - F.col("start") + 1 <= max_len, F.col("start")).otherwise(F.col("a")).alias("a"), "b"
    )
    flagged = span_words(wide)
    if colon_rule:
        bare = words.join(spans.select("pair_id").distinct(), "pair_id", "left_anti")
        flagged = flagged.unionByName(colon_formula(bare, max_len=max_len))
    return set_frame(words, flagged)


def formula_rule(words: DataFrame, keywords: tuple[str, ...] = FRAME_KEYWORDS) -> DataFrame:
    """Citing formulas on unlinked runs that hold a keyword: from the run's start to the first clause end at
    or after the keyword, else the keyword and a following capitalised word; then extension and adjacency."""
    w = W.partitionBy("pair_id").orderBy("t")
    linked = F.when(F.col("s") >= 0, 1).otherwise(0)
    isl = words.withColumn("_lk", F.sum(linked).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("s < 0")
    run = W.partitionBy("pair_id", "_lk")
    keyed = isl.withColumn("a", F.min("t").over(run)).withColumn("b", F.max("t").over(run)).withColumn(
        "k", F.min(F.when(F.col("norm").isin(*keywords), F.col("t"))).over(run)
    ).filter("k is not null")
    ends = keyed.withColumn(
        "e", F.min(F.when((F.col("t") >= F.col("k")) & tx.ends_clause(F.col("word")), F.col("t"))).over(run)
    ).withColumn("cap", F.max(F.when(F.col("t") == F.col("k") + 1, F.left("word", F.lit(1)).rlike(r"\p{Lu}"))).over(run))
    spans = ends.groupBy("pair_id", "_lk").agg(
        F.min("a").alias("a"),
        F.max(F.coalesce("e", F.when(F.col("cap"), F.col("k") + 1).otherwise(F.col("k")))).alias("b"),
    )
    flagged = set_frame(words, span_words(spans))
    wide = extend_formulas(flagged, colon_rule=False)
    wide = wide.withColumn("frame", F.when(F.col("s") >= 0, 0).otherwise(F.col("frame")))
    return set_frame(words, span_words(adjacent_formulas(wide)))


def clean_mask(words: DataFrame, *, min_run: int = 2) -> DataFrame:
    """Close one-word gaps in the formula flags, then drop runs shorter than ``min_run``; a link wins."""
    w = W.partitionBy("pair_id").orderBy("t")
    free = words.withColumn("frame", F.when(F.col("s") >= 0, 0).otherwise(F.col("frame")))
    filled = free.withColumn(
        "frame", F.when((F.lag("frame").over(w) == 1) & (F.lead("frame").over(w) == 1), 1).otherwise(F.col("frame"))
    )
    long_ = runs(filled, F.col("frame") == 1).filter(F.col("b") - F.col("a") + 1 >= min_run)
    return set_frame(words, span_words(long_))


# ---- repairs -------------------------------------------------------------------------------------------


def spelling_repair(words: DataFrame, swords: DataFrame) -> DataFrame:
    """A MORPH, SPLIT or MERGE whose two words share a spelling key is a copy."""
    src = swords.select("pair_id", "s", F.col("word").alias("_sw"))
    same = tx.spelling_key(F.col("_sw")) == tx.spelling_key(F.col("word"))
    return words.join(src, ["pair_id", "s"], "left").withColumn(
        "tag", F.when(F.col("tag").isin("MORPH", "SPLIT", "MERGE") & same, "NOP").otherwise(F.col("tag"))
    ).drop("_sw")


def geometry_repair(words: DataFrame, *, allow_size_mismatch: bool = True) -> DataFrame:
    """Decline substitutions whose source is not between the sources of the nearest other links."""
    anchor = (F.col("s") >= 0) & ~F.col("tag").isin(*SUBST_LIKE)
    w = W.partitionBy("pair_id").orderBy("t")
    left, right = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    at = F.when(anchor, F.struct("t", "s"))
    x = words.withColumn("_l", F.last(at, ignorenulls=True).over(left)).withColumn("_r", F.first(at, ignorenulls=True).over(right))
    ok_l = F.col("_l").isNull() | (F.col("s") > F.col("_l.s"))
    ok_r = F.col("_r").isNull() | (F.col("s") < F.col("_r.s"))
    if not allow_size_mismatch:
        ok_l = ok_l & (F.col("_l").isNull() | (F.col("s") - F.col("_l.s") == F.col("t") - F.col("_l.t")))
        ok_r = ok_r & (F.col("_r").isNull() | (F.col("_r.s") - F.col("s") == F.col("_r.t") - F.col("t")))
    bad = (F.col("s") >= 0) & F.col("tag").isin(*SUBST_LIKE) & ~(ok_l & ok_r)
    return x.select(
        *[c for c in words.columns if c not in ("s", "tag")],
        F.when(bad, -1).otherwise(F.col("s")).alias("s"), F.when(bad, "INS").otherwise(F.col("tag")).alias("tag"),
    )


def apply_repairs(words: DataFrame, swords: DataFrame) -> DataFrame:
    """Spelling, substitution geometry, formula adjacency, in this order."""
    fixed = geometry_repair(spelling_repair(words, swords))
    return set_frame(fixed, span_words(adjacent_formulas(fixed)))


def regimes(words: DataFrame, typed: DataFrame) -> DataFrame:
    """What the resources found on each word's link: form, lemma, relation, lemma_missing, no_rel_found, none."""
    t = typed.select("pair_id", "t", F.col("tag").alias("lookup_op"), "outcome")
    return words.join(t, ["pair_id", "t"], "left").withColumn(
        "regime",
        F.when(F.col("lookup_op").isNull(), "none")
        .when(F.col("outcome") != "", F.col("outcome"))
        .when(F.col("lookup_op") == "COPY", "form")
        .when(F.col("lookup_op").isin("MORPH", "SPLIT", "MERGE"), "lemma")
        .otherwise("relation"),
    )
