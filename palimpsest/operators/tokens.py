"""Passages and word tables (tokenising, sameness, attested forms, counterparts, annotation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import text as tx

WINDOW = 24


def passages(df: DataFrame, work: str, *, size: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut every text into windows of ``size`` words. Narrow: no row leaves its partition."""
    # one greedy regular expression cuts the text into windows in a single linear pass
    window = "[^ ]+(?: [^ ]+){0,%d}" % (size - 1)
    cut = F.regexp_extract_all(tx.squeeze(F.col("text")), F.lit(window), F.lit(0))
    toks = F.split("txt", " ")
    return df.select(
        F.col(work).cast("long").alias("work"), *keep, F.posexplode(cut).alias("seg", "txt")
    ).select(
        (F.col("work") * 1000000 + F.col("seg")).alias("pid"),
        "work",
        "seg",
        *keep,
        toks.alias("toks"),
        F.size(toks).alias("n"),
        "txt",
    )


def token_table(passages_df: DataFrame) -> DataFrame:
    """(pid, i, surface, norm), one row per word."""
    return passages_df.select("pid", "work", F.posexplode("toks").alias("i", "surface")).withColumn(
        "norm", tx.normalize(F.col("surface"))
    )


def attested_forms(tokens: DataFrame, *, min_count: int = 3) -> DataFrame:
    """Normalised forms the corpus holds at least ``min_count`` times."""
    return (
        tokens.filter(F.col("norm") != "")
        .groupBy("norm")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_count)
    )


def counterparts(words: DataFrame, others: DataFrame, *, stem: int = 4) -> DataFrame:
    """Flag each word that has a counterpart (form, spelling key or stem) in the pair's other passage.

    ``words`` and ``others`` are (pair_id, i, word, norm). Three equi-joins on
    (pair, kind, value), never a product of the two passages.
    """

    def keyed(df: DataFrame) -> DataFrame:
        norm, n = F.col("norm"), F.length("norm")
        key = tx.spelling_key(F.col("word"))
        values = F.array(
            F.struct(F.lit("form").alias("kind"), norm.alias("val")),
            F.when(key != "", F.struct(F.lit("key").alias("kind"), key.alias("val"))),
            F.when(n >= stem, F.struct(F.lit("stem").alias("kind"), F.left(norm, F.lit(stem)).alias("val"))),
        )
        return df.filter(n >= 2).select("pair_id", "i", F.inline(F.array_compact(values)))

    there = keyed(others).select("pair_id", "kind", "val").distinct()
    hits = (
        keyed(words)
        .join(there, ["pair_id", "kind", "val"], "left_semi")
        .select("pair_id", "i")
        .distinct()
        .withColumn("hit", F.lit(True))
    )
    return words.join(hits, ["pair_id", "i"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def candidate_vocabulary(tokens: DataFrame, *, frequent_cutoff: int = 250) -> DataFrame:
    """Substitute candidates: distinct forms of three letters or more whose lemma is neither a function
    word nor among the most frequent. ``tokens`` carries (norm, lemma, pos), and ``n`` where a row stands for so many words;
    ties go by lemma."""
    lem = F.coalesce("lemma", "norm")
    n = F.col("n") if "n" in tokens.columns else F.lit(1)
    toks = tokens.select("norm", lem.alias("lemma"), F.coalesce("pos", F.lit("n")).alias("pos"), n.alias("n"))
    counts = toks.groupBy("lemma").agg(F.sum("n").alias("n"))
    frequent = counts.orderBy(F.desc("n"), "lemma").limit(frequent_cutoff).select("lemma")
    vocab = (
        toks.filter((F.length("norm") >= 3) & ~F.col("norm").isin(*tx.STOP_WORDS))
        .filter(~F.col("lemma").isin(*tx.STOP_WORDS))
        .groupBy("norm", "lemma")
        .agg(F.min("pos").alias("pos"))
    )
    return vocab.join(frequent, "lemma", "left_anti")


def candidates(vocab: DataFrame, asked: DataFrame, *, limit: int = 5) -> DataFrame:
    """Up to ``limit`` candidates per asked (lemma, pos): words of that part of speech with another lemma.

    A small pool per part of speech answers every question: the first words by form, enough of them
    that leaving out one lemma cannot empty the list (one lemma's forms are at most ``per_lemma``)."""
    # the first ``limit`` forms of each lemma, then the first 2 * limit forms of each part of speech
    first = vocab.withColumn(
        "k", F.row_number().over(W.partitionBy("pos", "lemma").orderBy("norm"))
    ).filter(F.col("k") <= limit)
    pool = first.withColumn(
        "k", F.row_number().over(W.partitionBy("pos").orderBy("norm"))
    ).filter(F.col("k") <= 2 * limit).drop("k")
    joined = asked.select(F.col("lemma").alias("asked"), "pos").distinct().join(
        pool.withColumnRenamed("lemma", "cand_lemma"), "pos"
    )
    return (
        joined.filter(F.col("asked") != F.col("cand_lemma"))
        .withColumn("rank", F.row_number().over(W.partitionBy("asked", "pos").orderBy("norm")))
        .filter(F.col("rank") <= limit)
        .select("asked", "pos", "rank", F.col("norm").alias("candidate"))
    )


def enclitic_split(words: DataFrame, attested: DataFrame, exceptions: tuple[str, ...]) -> DataFrame:
    """(…, stem, enclitic) for words that end in an enclitic, are no exception and whose stem is attested."""
    clean = F.regexp_replace("word", "[^A-Za-z]", "")
    low = F.lower(clean)
    options = F.filter(
        F.transform(
            F.array(*[F.lit(e) for e in ("que", "ue", "ve", "ne")]),
            lambda e: F.when(
                F.endswith(low, e) & (F.length(clean) - F.length(e) >= 3),
                F.struct(F.left(clean, F.length(clean) - F.length(e)).alias("stem"), e.alias("enclitic")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    rows = (
        words.filter(~low.isin(*exceptions) & low.rlike("(que|ue|ve|ne)$"))
        .select("*", F.posexplode(options).alias("_o", "_e"))
        .select(*words.columns, "_o", "_e.stem", "_e.enclitic")
        .withColumn("stem_norm", tx.normalize(F.col("stem")))
    )
    known = attested.select(F.col("norm").alias("stem_norm"))
    hits = rows.join(known, "stem_norm", "left_semi")
    w = W.partitionBy(*words.columns).orderBy("_o")
    return hits.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_o", "_k", "stem_norm")


def annotate(
    tokens: DataFrame,
    lemmas: DataFrame | None,
    names: DataFrame,
    enclitics: DataFrame,
) -> DataFrame:
    """Word table with lemma, pos, name, function-word and enclitic columns; unknown stays NULL. ``lemmas`` is None
    where the words carry lemma and pos already."""
    known = tokens if lemmas is None else tokens.join(lemmas.select("norm", "lemma", "pos"), "norm", "left")
    return (
        known
        .join(names.select(F.col("form").alias("clean"), F.lit(True).alias("listed")), "clean", "left")
        .join(enclitics.select("surface", "stem", "enclitic"), "surface", "left")
        .withColumn("is_name", F.coalesce("listed", F.lit(False)))
        .withColumn("is_stop", F.col("norm").isin(*tx.STOP_WORDS))
        .drop("listed")
    )


def coverage_summary(annotated: DataFrame) -> DataFrame:
    """Per passage of either side: how many words the tables know something about."""
    return annotated.groupBy("side", "pid").agg(
        F.count("*").alias("tokens"),
        F.count("lemma").alias("lemmatized"),
        F.count("pos").alias("with_features"),
        F.count_if("is_name").alias("proper_names"),
        F.count_if("is_stop").alias("function_words"),
        F.count("enclitic").alias("with_enclitic"),
        F.round(F.count("pos") / F.greatest(F.count("*"), F.lit(1)), 6).alias("feature_coverage"),
    )


def clean_form(word: Column) -> Column:
    """The word's letters only, case kept."""
    return F.regexp_replace(word, r"[^\p{L}]", "")


def name_hits(words: DataFrame, names: DataFrame) -> DataFrame:
    """Words that are capitalised and listed, case-sensitively, as a name."""
    keyed = words.withColumn("clean", clean_form(F.col("surface")))
    cap = keyed.filter(F.col("clean").rlike(r"^\p{Lu}"))
    return cap.join(names.select(F.col("form").alias("clean")).distinct(), "clean", "left_semi")


def ops_under_policy(rwords: DataFrame, swords: DataFrame, links: DataFrame, policy: str) -> DataFrame:
    """COPY, SUBST or INS per reuse word, under a notion of sameness."""
    src = swords.select("pair_id", "s", F.col("norm").alias("sn"))
    linked = links.select("pair_id", "t", "s").join(src, ["pair_id", "s"])
    return rwords.select("pair_id", "t", "norm").join(linked, ["pair_id", "t"], "left").select(
        "pair_id",
        "t",
        F.when(F.col("s").isNull(), "INS")
        .when(tx.same(policy, F.col("sn"), F.col("norm")), "COPY")
        .otherwise("SUBST")
        .alias("op"),
    )
