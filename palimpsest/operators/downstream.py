"""One feature row per pair, and classifiers on such rows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import labels as lb
from palimpsest.operators import script as sc
from palimpsest.plans.lineage import hash_rank

LEXICAL = ("SYN", "SYN-DIST", "HYPER", "HYPO", "ANT", "POS", "NE-SUB")
FEATURES = (
    "n_t", "n_s", "n_links", "link_rate_t", "link_rate_s", "longest_run", "n_runs", "copy_share", "morph_share", "subst_share",
    "lex_share", "card_share", "ins_rate", "del_rate", "longest_quote", "n_quotes", "quote_rate", "n_reorder", "reorder_share",
    "n_frame", "n_adapt", "p_mean", "p_min", "len_ratio", "verbatim", "allusion", "frame_mode", "nomatch",
)


def feature_rows(words: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lengths, link rates, runs, operation shares, quotes, reorders, formulas, link confidence, mode shares.

    ``words`` is a typed word table, ``links`` (pair_id, t, s, p). One wide aggregate per pair; the words of
    a pair are already in one partition, so the joins below move per-pair rows only.
    """
    on = F.col("s") >= 0
    w = W.partitionBy("pair_id").orderBy("t")
    runs = words.filter(on).withColumn("g", F.col("t") - F.row_number().over(w)).groupBy("pair_id", "g").agg(F.count("*").alias("n"))
    runs = runs.groupBy("pair_id").agg(F.max("n").alias("longest_run"), F.count("*").alias("n_runs"))
    tag = F.col("tag")
    n = lambda c: F.count_if(c)
    mode = lb.collapse("mode", F.coalesce(lb.canonical_op(tag), F.lit("INS")), F.col("frame") == 1)
    base = words.groupBy("pair_id").agg(
        n(on).alias("n_links"), n(on & tag.isin("COPY", "NOP")).alias("c_copy"), n(tag == "MORPH").alias("c_morph"), n(tag == "SUBST").alias("c_subst"),
        n(tag.isin(*LEXICAL)).alias("c_lex"), n(tag.isin("SPLIT", "MERGE")).alias("c_card"), n(~on & (F.col("frame") == 0)).alias("c_ins"),
        F.sum("frame").alias("n_frame"), *[n(mode == m).alias(f"m_{m}") for m in ("VERBATIM", "ALLUSION", "FRAME", "NOMATCH")],
    )
    q = sc.quotes(words).withColumn("len", F.col("b") - F.col("a") + 1).groupBy("pair_id").agg(
        F.max("len").alias("longest_quote"), F.count("*").alias("n_quotes"), F.sum("len").alias("quoted"))
    moved = sc.reordered(words).groupBy("pair_id").agg(F.count("*").alias("n_reorder"))
    adapt = sc.adapted(words).groupBy("pair_id").agg(F.count("*").alias("n_adapt"))
    claimed = links.groupBy("pair_id").agg(F.count_distinct("s").alias("claimed"), F.avg("p").alias("p_mean"), F.min("p").alias("p_min"))
    x = pairs.select("pair_id", "pair_label", "fold", F.col("n_r").alias("n_t"), "n_s").join(base, "pair_id")
    for df in (runs, q, moved, adapt, claimed):
        x = x.join(df, "pair_id", "left")
    x = x.fillna(0, ["longest_run", "n_runs", "longest_quote", "n_quotes", "quoted", "n_reorder", "n_adapt", "claimed", "p_mean", "p_min"])
    d, nt, ns = F.greatest("n_links", F.lit(1)), F.greatest("n_t", F.lit(1)), F.greatest("n_s", F.lit(1))
    share = lambda c, by, name: F.round(F.col(c) / by, 6).alias(name)
    return x.select(
        "pair_id", "pair_label", "fold", "n_t", "n_s", "n_links", share("n_links", nt, "link_rate_t"), share("n_links", ns, "link_rate_s"),
        "longest_run", "n_runs", share("c_copy", d, "copy_share"), share("c_morph", d, "morph_share"), share("c_subst", d, "subst_share"),
        share("c_lex", d, "lex_share"), share("c_card", d, "card_share"), share("c_ins", nt, "ins_rate"),
        F.round((F.col("n_s") - F.col("claimed")) / ns, 6).alias("del_rate"), "longest_quote", "n_quotes", share("quoted", nt, "quote_rate"),
        "n_reorder", share("n_reorder", d, "reorder_share"), "n_frame", "n_adapt", F.round("p_mean", 6).alias("p_mean"), F.round("p_min", 6).alias("p_min"),
        share("n_t", ns, "len_ratio"), share("m_VERBATIM", nt, "verbatim"), share("m_ALLUSION", nt, "allusion"), share("m_FRAME", nt, "frame_mode"), share("m_NOMATCH", nt, "nomatch"),
    )


FOLDS = range(5)
NEG_RATIO = 10


def sample_negatives(train: DataFrame) -> DataFrame:
    """All positives and at most ``NEG_RATIO`` times as many negatives, drawn by md5 key."""
    n = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    most = NEG_RATIO * max(n.get(1.0, 0), 1)
    if n.get(0.0, 0) <= most:
        return train
    drawn = hash_rank(train.filter("label = 0"), F.md5(F.col("pair_id").cast("string")), "_rk").filter(F.col("_rk") <= most)
    return train.filter("label = 1").unionByName(drawn.select(*train.columns))


def fold_models(data: DataFrame, *, trees: bool = False, sampled: bool = True) -> dict:
    """fold -> the model fitted on all other folds, where these hold both labels. ``data`` has ``label`` and ``fold``."""
    out = {}
    for fold in FOLDS:
        train = data.filter(~F.col("fold").eqNullSafe(fold))
        if train.select("label").distinct().count() < 2:
            continue
        steps = [VectorAssembler(inputCols=list(FEATURES), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
        model = GBTClassifier(maxIter=10, seed=1) if trees else LogisticRegression(maxIter=50)
        out[fold] = Pipeline(stages=[*steps, model]).fit(sample_negatives(train) if sampled else train)
    return out


def held_scores(data: DataFrame, models: dict) -> DataFrame:
    """(pair_id, fold, gold, predicted, score) of every row, by the model of its fold; nulls where that has none."""
    gold = F.col("label").cast("int").alias("gold")
    parts = [
        model.transform(data.filter(F.col("fold") == fold)).select(
            "pair_id", "fold", gold, F.col("prediction").cast("int").alias("predicted"),
            F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        for fold, model in models.items()
    ]
    rest = data.filter(~F.coalesce(F.col("fold").isin(*models), F.lit(False)) if models else F.lit(True))
    return reduce(DataFrame.unionByName, parts, rest.select(
        "pair_id", "fold", gold, F.lit(None).cast("int").alias("predicted"), F.lit(None).cast("double").alias("score")))


def reference_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", F.coalesce(F.col("pair_label").isin("cit", "cf"), F.lit(False)).cast("double"))


def classify(rows: DataFrame, *, trees: bool = False) -> DataFrame:
    """Reference or not: (pair_id, fold, gold, predicted, score) of every pair, fitted on the other folds."""
    data = reference_rows(rows)
    return held_scores(data, fold_models(data, trees=trees))


def type_macro_f1(rows: DataFrame) -> DataFrame:
    """(fold, n, macro_f1): cit. or cf. among the references, the mean F1 of the classes that gold or prediction have."""
    data = rows.filter(F.col("pair_label").isin("cit", "cf")).withColumn("label", (F.col("pair_label") == "cit").cast("double"))
    n = lambda g, p: F.count_if((F.col("gold") == g) & (F.col("predicted") == p))
    x = held_scores(data, fold_models(data, sampled=False)).filter("predicted is not null").groupBy("fold").agg(
        F.count("*").alias("n"), n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    wrong = F.col("fp") + F.col("fn")
    f1 = lambda right: F.when(F.col(right) + wrong > 0, 2 * F.col(right) / (2 * F.col(right) + wrong))
    both = F.filter(F.array(f1("tp"), f1("tn")), lambda v: v.isNotNull())
    return x.select("fold", "n", F.round(F.aggregate(both, F.lit(0.0), lambda a, v: a + v) / F.size(both), 6).alias("macro_f1"))


def coefficients(rows: DataFrame) -> DataFrame:
    """(feature, fold_0 ... fold_4, mean, sign_agreement): standardised coefficients of the reference classifier."""
    models = fold_models(reference_rows(rows))
    columns = {k: m.stages[-1].coefficients.toArray().tolist() for k, m in models.items()}
    out = []
    for i, name in enumerate(FEATURES):
        held = [c[i] for c in columns.values()]
        out.append((name, *[columns[k][i] if k in columns else None for k in FOLDS], sum(held) / len(held) if held else None,
                    max(sum(v > 0 for v in held), sum(v < 0 for v in held)) if held else None))
    schema = "feature string, " + "".join(f"fold_{k} double, " for k in FOLDS) + "mean double, sign_agreement int"
    return rows.sparkSession.createDataFrame(out, schema)
