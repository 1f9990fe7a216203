"""Shared inputs of the queries: passages, mined pairs, word tables, cells and two link annotators.

One ``Inputs`` per (session, folder). The tables most queries start from (mined pairs, scored cells,
evidence, two sets of links) are written once to the checkpoint folder.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import align, evidence, lexicon, mining
from palimpsest.operators import tokens as tk
from palimpsest.plans.lineage import cut, fits, lay

#: Dial of the pair table (``spark.palimpsest.pairMinShared``): shared content words a pair needs before it is
#: sf0.1 and advises a higher floor downstream; what reuse the pairs below it hold has not been measured.
PAIR_MIN_SHARED = 3

#: Lemmas are broadcast with their vectors (64 numbers each in the driver tables) up to this many, by a bounded count.
BROADCAST_VECTORS = 200_000

#: A cell carries evidence from this cosine, or this edit similarity, on.
CLOSE, SIMILAR = 0.35, 0.4

#: The driver texts hold no Latin citing verbs; these frequent words stand for the keyword list.
KEYWORDS = ("the", "la", "de", "que", "der", "of")

_CACHE: dict[tuple[str, str], "Inputs"] = {}


def inputs(spark: SparkSession, folder: str) -> "Inputs":
    key = (spark.sparkContext.applicationId, folder)
    if key not in _CACHE:
        _CACHE[key] = Inputs(spark, folder)
    return _CACHE[key]


class Inputs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # every pair-local join and window below may use the pair table's own partitioning
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        cores = spark.sparkContext.defaultParallelism
        local = spark.sparkContext.master.startswith("local")
        self.n_parts = cores if local else max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose scan has at least one split per core. Only a small file is reshuffled; a
        table of many splits is read as it is."""
        df = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @staticmethod
    def keep(df: DataFrame, *, laid: bool = False) -> DataFrame:
        """An intermediate table many queries start from: written once to the checkpoint folder, so it
        survives a lost executor, is never mined twice, and later plans start at it. ``laid`` for what is made
        from the pair table inside its partitions."""
        return cut(df, laid=laid)

    def lay(self, df: DataFrame) -> DataFrame:
        """A kept table dealt as the pair table is."""
        return lay(df, self.n_parts, "pair_id")

    def deal(self, df: DataFrame) -> DataFrame:
        """The same for what has a short plan: planned without adaptive execution throughout, and written once."""
        return cut(df.repartition(self.n_parts, "pair_id"), laid=True)

    # ---- passages -------------------------------------------------------------------------

    @cached_property
    def src(self) -> DataFrame:
        """Benchmark passages: the earlier side."""
        return tk.passages(self.table("benchmark"), "item_id")

    @cached_property
    def reu(self) -> DataFrame:
        """Document passages: the later side; ``source`` plays the author."""
        docs = self.spread("documents").select("doc_id", "text", F.col("source").alias("author"), "lang")
        return tk.passages(docs, "doc_id", keep=("author", "lang"))

    @cached_property
    def tokens(self) -> DataFrame:
        """Word table of both sides."""
        cols = ["side", "pid", "work", "i", "surface", "norm"]
        a = tk.token_table(self.src).withColumn("side", F.lit("s")).select(*cols)
        b = tk.token_table(self.reu).withColumn("side", F.lit("r")).select(*cols)
        return a.unionByName(b)

    @cached_property
    def mined(self) -> DataFrame:
        return mining.overlap_pairs(self.src, self.reu)

    @cached_property
    def pairs(self) -> DataFrame:
        """Pairs that share enough content words, both sides tokenised and normalised."""
        floor = int(self.spark.conf.get("spark.palimpsest.pairMinShared", str(PAIR_MIN_SHARED)))
        raw = mining.overlap_pairs(self.src, self.reu, min_shared=floor)
        labels = self.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        works = self.table("documents").select(
            F.col("doc_id").alias("r_work"), F.col("source").alias("author"), "lang"
        )
        rows = raw.select(
            F.concat_ws("_", "c", "q").alias("pair_id"),
            F.col("c").alias("s_pid"),
            F.col("q").alias("r_pid"),
            F.expr("c div 1000000").alias("s_work"),
            F.expr("q div 1000000").alias("r_work"),
            "s_txt",
            "r_txt",
            "n_shared",
        )
        out = (
            rows.join(works, "r_work")
            .join(labels.withColumnRenamed("doc_id", "r_work"), "r_work", "left")
            .withColumn("fold", (F.col("r_work") % 5).cast("int"))
            .withColumn(
                "pair_label",
                F.when(F.col("quality") == 1, "cit").when(F.col("quality") == 0, "cf").otherwise("no_match"),
            )
            .drop("quality")
        )
        # texts and normal forms are kept as strings, a third of the arrays' size; no normal form holds a space
        for side in ("s", "r"):
            norms = F.transform(F.split(f"{side}_txt", " "), lambda w: tx.normalize(w))
            out = out.withColumn(f"{side}_norms", F.array_join(norms, " "))
        # hash-partitioned once: windows, aggregates and joins on pair_id reuse this layout
        out = self.lay(out)
        for side in ("s", "r"):
            out = out.withColumn(f"{side}_tok", F.split(f"{side}_txt", " ")).withColumn(f"{side}_norm", F.split(f"{side}_norms", " "))
        return out.withColumn("n_s", F.size("s_tok")).withColumn("n_r", F.size("r_tok")).drop("s_norms", "r_norms")

    # ---- word tables of the pairs -----------------------------------------------------------

    @cached_property
    def rwords(self) -> DataFrame:
        """(pair_id, t, word, norm): the reuse words of every pair."""
        return self._words("r", "t")

    @cached_property
    def swords(self) -> DataFrame:
        return self._words("s", "s")

    def _words(self, side: str, index: str) -> DataFrame:
        # a plain explode: where a filter leaves no such rows, the optimiser drops it, and a union keeps its layout
        numbered = F.transform(
            f"{side}_tok", lambda w, i: F.struct(i.alias(index), w.alias("word"), F.get(f"{side}_norm", i).alias("norm"))
        )
        return self.pairs.select("pair_id", "n_s", "n_r", F.explode(numbered).alias("w")).select("pair_id", "n_s", "n_r", "w.*")

    @cached_property
    def grid(self) -> DataFrame:
        """Every (t, s) cell of every pair, at most 24 x 24 of them, exploded inside the row."""
        return align.grid(self.pairs)

    @cached_property
    def cells(self) -> DataFrame:
        """Scored candidate cells in both directions: (pair_id, t, s, wgt, p_fwd, p_rev), no nulls."""
        return self.keep(align.form_cells(self.pairs), laid=True)

    @cached_property
    def fwd(self) -> DataFrame:
        """Forward rows (pair_id, t, s, p); the null is s = -1."""
        return align.rows_with_null(self.cells, self.rwords, "t", "p_fwd")

    @cached_property
    def rev(self) -> DataFrame:
        """Reverse rows (pair_id, s, t, p); the null is t = -1."""
        return align.rows_with_null(self.cells, self.swords, "s", "p_rev")

    @cached_property
    def gold(self) -> DataFrame:
        """The copy annotator's links: (pair_id, t, s)."""
        return self.keep(align.copy_links(self.pairs), laid=True)

    @cached_property
    def pred(self) -> DataFrame:
        """The mutual-best annotator's links: (pair_id, t, s, p)."""
        return self.keep(align.mutual_best(self.fwd, self.rev), laid=True)

    # ---- inputs of the pool and negative operators --------------------------------------------

    @cached_property
    def gold_texts(self) -> DataFrame:
        """Passages of documents labelled toxic stand for the annotated passages no pair may use."""
        toxic = self.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("work")).distinct()
        return self.reu.join(toxic, "work", "left_semi").select("txt")

    @cached_property
    def scored(self) -> DataFrame:
        """Guarded candidates with a drawn stand-in for a classifier's probability."""
        pid = F.concat_ws("_", "c", "q")
        return self.mined.select(
            pid.alias("id"), F.col("s_txt").alias("source"), F.col("r_txt").alias("reuse"), "n_shared",
            tx.unit_draw("p", pid).alias("p"),
        )

    @cached_property
    def wide(self) -> DataFrame:
        """Pairs whose reuse side is widened by the passage before and the one after. Only the passages beside a pair's
        own are looked for, and only those are dealt by pair; the pairs stay where they lie."""
        at = lambda d: F.struct((F.col("r_pid") + d).alias("pid"), F.lit(d).alias("d"))
        beside = self.pairs.select("pair_id", F.inline(F.array(at(-1), at(1)))).distinct()
        wanted = self.keep(beside.select("pid").distinct())
        near = self.reu.select("pid", "txt").join(F.broadcast(wanted) if fits(wanted) else wanted, "pid", "left_semi")
        context = self.lay(beside.join(near, "pid").select("pair_id", "d", "txt"))
        out = self.pairs
        for d, c in ((-1, "pre"), (1, "post")):
            out = out.join(context.filter(F.col("d") == d).select("pair_id", F.col("txt").alias(c)), "pair_id", "left")
        none = F.array().cast("array<string>")
        for c in ("pre", "post"):
            out = out.withColumn(c, F.coalesce(F.split(c, " "), none))
        norms = lambda c: F.transform(c, lambda w: tx.normalize(w))
        return (
            out.withColumn("r_tok", F.concat("pre", "r_tok", "post"))
            .withColumn("r_norm", F.concat(norms("pre"), "r_norm", norms("post")))
            .withColumn("n_r", F.size("r_tok"))
            .drop("pre", "post")
        )

    @cached_property
    def copies(self) -> DataFrame:
        """The mined pairs with every verbatim copy of the reuse passage as a record of its own."""
        copies = self.reu.select(F.col("pid").alias("copy_pid"), F.col("txt").alias("r_txt"))
        return self.pairs.drop("r_pid").join(copies, "r_txt").select(
            F.concat_ws("_", "s_pid", "copy_pid").alias("id"), "s_txt", "r_txt"
        )

    @cached_property
    def neg_corpus(self) -> DataFrame:
        return self.reu.select("pid", "work", "seg", "author", "txt", "toks", "n")

    @cached_property
    def neg_rows(self) -> DataFrame:
        """Labelled pairs outside fold 0, read as (query = benchmark side, cited = document side)."""
        return self.pairs.filter("fold <> 0").select(
            F.col("pair_id").alias("id"), "author", F.col("r_pid").alias("cited_pid"), F.col("r_txt").alias("cited_txt"),
            F.col("s_txt").alias("query_txt"), F.col("s_norm").alias("query_norm"), F.col("n_s").alias("n_q"),
        )

    @cached_property
    def attested_pairs(self) -> DataFrame:
        return self.pairs.select(F.col("r_txt").alias("txt"), F.col("s_txt").alias("query_txt"))

    # ---- lexicon and vectors -----------------------------------------------------------------

    @cached_property
    def forms(self) -> DataFrame:
        """The words as written with their counts: read off the corpus once, used by every word-level lookup."""
        return self.keep(self.tokens.groupBy("surface").agg(F.count("*").alias("n")))

    @cached_property
    def norms(self) -> DataFrame:
        """The vocabulary with its counts. A form is normalised once, however often it occurs."""
        norm = tx.normalize(F.col("surface")).alias("norm")
        return self.keep(self.forms.groupBy(norm).agg(F.sum("n").alias("n")))

    @cached_property
    def attested(self) -> DataFrame:
        """Normalised forms the corpus holds at least three times."""
        return self.norms.filter("norm <> '' and n >= 3")

    @cached_property
    def lexicon(self) -> DataFrame:
        return self.keep(lexicon.trimmed(lexicon.lexicon_standin(self.norms)))

    @cached_property
    def vectors(self) -> DataFrame:
        """(lemma, vec): lemmas hashed onto all rows of the embedding table; about one in eleven stays unknown."""
        n = self.table("embeddings").count()
        lemmas = self.norms.select(tx.lemma_standin(F.col("norm")).alias("lemma")).distinct().filter("lemma is not null")
        emb = self.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
        return lemmas.withColumn("vec_id", tx.bucket_draw(max(1, n * 11 // 10), F.col("lemma")).cast("long")).join(emb, "vec_id").select("lemma", "vec")

    # ---- evidence ------------------------------------------------------------------------------

    @cached_property
    def names(self) -> DataFrame:
        """Names: capitalised forms the benchmark holds at least twice inside a sentence."""
        inside = self.tokens.filter("side = 's' and i > 0").select(tk.clean_form(F.col("surface")).alias("form"))
        return inside.filter(F.col("form").rlike(r"^\p{Lu}")).groupBy("form").agg(F.count("*").alias("n")).filter("n >= 2")

    @cached_property
    def pair_words(self) -> DataFrame:
        """The distinct words of the pairs."""
        return self.rwords.select("word", "norm").unionByName(self.swords.select("word", "norm")).distinct()

    @cached_property
    def facts(self) -> DataFrame:
        """Names and enclitics among the words of the pairs."""
        return self.keep(evidence.word_facts(self.pair_words, self.names, self.attested))

    @cached_property
    def lemma_tables(self) -> tuple[DataFrame, DataFrame] | None:
        """(relation flags, lemma facts) of the lemmas of the pairs, where a bounded count has shown that both may be
        broadcast beside the word facts; None beyond that."""
        lemmas = self.keep(evidence.lemma_facts(self.pair_words, self.vectors, self.lexicon))
        known = lemmas.select("lemma")
        flags = lexicon.relation_flags(self.lexicon).join(known.withColumnRenamed("lemma", "la"), "la", "left_semi")
        flags = self.keep(flags.join(known.withColumnRenamed("lemma", "lb"), "lb", "left_semi"))
        small = fits(lemmas, BROADCAST_VECTORS) and fits(flags) and fits(self.facts)
        return (flags, lemmas) if small else None

    @cached_property
    def close_flags(self) -> DataFrame | None:
        """The relation flags with a column ``close``: 1 where the vectors may reach ``CLOSE``. None where they can not be
        broadcast."""
        if not self.lemma_tables:
            return None
        flags, lemmas = self.lemma_tables
        sources = self.swords.select(tx.lemma_standin(F.col("norm")).alias("la"))
        close = evidence.close_lemmas(sources, lemmas, CLOSE)
        if close is None or not fits(close):
            return None
        both = flags.withColumn("close", F.lit(0)).unionByName(close.withColumn("close", F.lit(1)), allowMissingColumns=True)
        names = [c for c in both.columns if c not in ("la", "lb")]
        both = self.keep(both.groupBy("la", "lb").agg(*[F.max(c).alias(c) for c in names]))
        return both if fits(both) else None

    def _telling(self) -> DataFrame:
        """The features of the cells that carry any evidence. Vectors are looked up only for cells that cheaper tests leave."""
        some = (F.col("tier") > 0) | (F.col("edit_ratio") >= SIMILAR) | (F.col("cos") >= CLOSE)
        if not self.close_flags:
            return self.evidence.filter(some)
        found = evidence.with_flags(evidence.cell_facts(self.rwords, self.swords, F.broadcast(self.facts)), self.close_flags)
        found = found.filter(evidence.may_tell(edit=SIMILAR)).drop("close")
        joined = evidence.with_lemma_facts(found, None, self.lemma_tables[1])
        return evidence.features(joined).withColumn("tier", evidence.tier()).filter(some)

    def _features(self, cells: DataFrame | None = None) -> DataFrame:
        """The evidence of all cells, or of ``cells`` (pair_id, t, s). Only tables of distinct words and lemmas are
        looked up; while they may be broadcast no cell is moved."""
        if self.lemma_tables:
            found = evidence.cell_facts(self.rwords, self.swords, F.broadcast(self.facts), cells)
            joined = evidence.with_lemma_facts(found, *self.lemma_tables)
        else:
            found = evidence.cell_facts(self.rwords, self.swords, self.facts, cells)
            flags = lexicon.relation_flags(self.lexicon)
            joined = evidence.with_lemma_pairs(found, evidence.lemma_pair_facts(found, flags, self.vectors, self.lexicon))
        return evidence.features(joined).withColumn("tier", evidence.tier())

    def _keep_evidence(self, df: DataFrame) -> DataFrame:
        return self.keep(df, laid=True) if self.lemma_tables else self.lay(df)

    @cached_property
    def evidence(self) -> DataFrame:
        """All 23 features of every cell."""
        return self._features()

    @cached_property
    def evid(self) -> DataFrame:
        """The cells that carry any evidence (a tier, a similar form or a close vector), kept."""
        return self._keep_evidence(self._telling())

    def telling(self) -> DataFrame:
        """The rows of ``evid``, for a query that keeps a narrow part of them: read where they are kept, else made anew."""
        return self.evid if "evid" in self.__dict__ else self._telling()

    @cached_property
    def tiers(self) -> DataFrame:
        return self.evid.filter("tier > 0")

    @cached_property
    def sims(self) -> DataFrame:
        """Word-vector cosines of the cells whose two lemmas are known: (pair_id, t, s, v)."""
        return self._keep_evidence(self.evidence.filter("cos_missing = 0").select("pair_id", "t", "s", "n_r", "n_s", F.round("cos", 9).alias("v")))

    def evidence_of(self, links: DataFrame) -> DataFrame:
        """The evidence of the cells of any ``links`` (pair_id, t, s), whether or not they are candidate cells."""
        return self._features(links.select("pair_id", "t", "s").distinct())

    def link_evidence(self, links: DataFrame) -> DataFrame:
        """The evidence of ``links`` among the candidate cells. Only their cells are looked at, unless all are kept already."""
        return self.cell_evidence if "cell_evidence" in self.__dict__ else self.evidence_of(links)

    @cached_property
    def cell_evidence(self) -> DataFrame:
        """The evidence of the scored candidate cells, whatever it says."""
        return self._keep_evidence(self._features(self.cells))

    # ---- scripts -------------------------------------------------------------------------------

    @cached_property
    def words(self) -> DataFrame:
        """The predicted triple per reuse word: (pair_id, n_s, n_r, t, word, norm, s, tag, frame)."""
        from palimpsest.operators import typing_ as ty

        return self.keep(ty.typed_words(self.rwords, self.pred, self.link_evidence(self.pred), KEYWORDS), laid=True)

    @cached_property
    def gold_words(self) -> DataFrame:
        from palimpsest.operators import typing_ as ty

        return self.keep(ty.typed_words(self.rwords, self.gold, self.link_evidence(self.gold), KEYWORDS), laid=True)

    @cached_property
    def script(self) -> DataFrame:
        from palimpsest.operators import script as sc

        return self.keep(sc.decode_script(self.words, self.swords), laid=True)

    @cached_property
    def gold_script(self) -> DataFrame:
        from palimpsest.operators import script as sc

        return self.keep(sc.decode_script(self.gold_words, self.swords), laid=True)
