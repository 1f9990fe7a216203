"""Lexicon tables: relations of lemmas, word-vector neighbours, lemma-to-sentence index.

A lexicon is (lemma, pos, relation, other); vectors are (lemma, vec).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.plans.lineage import cut

RELATIONS = ("synonyms", "hypernyms", "hyponyms", "antonyms", "derivatives")
LEMMA_OK = "^[a-z]{3,}$"


def lexicon_standin(norms: DataFrame) -> DataFrame:
    """A stand-in lexicon where none is given: lemmas that differ in their first letter only are chained.

    At most 26 lemmas share all letters but the first, so every window below is that small.
    """
    lemmas = (
        norms.select(tx.lemma_standin(F.col("norm")).alias("lemma")).distinct()
        .filter(F.col("lemma").rlike("^[a-z]{5}$"))
        .withColumn("pos", tx.pos_standin(F.col("lemma")))
    )
    w = W.partitionBy(F.substring("lemma", 2, 4)).orderBy("lemma")
    near = lemmas.select(
        "lemma", "pos",
        F.lead("lemma", 1).over(w).alias("synonyms"),
        F.lead("lemma", 2).over(w).alias("hypernyms"),
        F.lag("lemma", 2).over(w).alias("hyponyms"),
        F.lead("lemma", 3).over(w).alias("antonyms"),
        F.lead("lemma", 4).over(w).alias("derivatives"),
    )
    return near.unpivot(["lemma", "pos"], list(RELATIONS), "relation", "other").filter("other is not null")


def trimmed(lexicon: DataFrame, *, max_list: int = 24) -> DataFrame:
    """Relation lists longer than ``max_list`` are dropped whole: they discriminate nothing."""
    sizes = lexicon.groupBy("lemma", "pos", "relation").agg(F.count_distinct("other").alias("n"))
    ok = sizes.filter(F.col("n") <= max_list).select("lemma", "pos", "relation")
    return lexicon.join(ok, ["lemma", "pos", "relation"], "left_semi")


def directed(lexicon: DataFrame) -> DataFrame:
    """(la, lb, relation): lb stands in a relation to la, in either direction, over all parts of speech."""
    back = (
        F.when(F.col("relation") == "hypernyms", "hyponyms").when(F.col("relation") == "hyponyms", "hypernyms")
        .otherwise(F.col("relation"))
    )
    there = lexicon.select(F.col("lemma").alias("la"), F.col("other").alias("lb"), "relation")
    here = lexicon.select(F.col("other").alias("la"), F.col("lemma").alias("lb"), back.alias("relation"))
    return there.unionByName(here).distinct()


def relation_flags(lexicon: DataFrame) -> DataFrame:
    """One row per related lemma pair with a flag per relation."""
    d = directed(lexicon)
    return d.groupBy("la", "lb").agg(
        *[F.max((F.col("relation") == r).cast("int")).alias(f"wn_{s}") for r, s in
          zip(RELATIONS, ("syn", "hyper", "hypo", "ant", "deriv"))]
    )


def resource_pairs(lexicon: DataFrame) -> DataFrame:
    """SYN and POS pairs of lemmas, one per unordered pair and relation, the higher weight kept."""
    rel = F.when(F.col("relation") == "synonyms", "SYN").when(F.col("relation") == "derivatives", "POS")
    rows = lexicon.select(
        "lemma", F.lower("other").alias("other"), "pos", rel.alias("rel"), F.lit(1.0).alias("weight")
    ).filter(
        F.col("rel").isNotNull() & F.col("lemma").rlike(LEMMA_OK) & F.col("other").rlike(LEMMA_OK)
        & (F.col("lemma") != F.col("other"))
    )
    return rows.groupBy(
        F.least("lemma", "other").alias("lemma_a"), F.greatest("lemma", "other").alias("lemma_b"), "rel"
    ).agg(F.max("weight").alias("weight"), F.min_by("pos", F.struct(-F.col("weight"), F.col("pos"))).alias("pos"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array<double> columns, NULL when one is missing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def length(a: Column) -> Column:
    """Euclidean length of an array<double> column."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array<double> columns, NULL when one is missing."""
    return dot(a, b) / (length(a) * length(b))


def vector_neighbours(
    vectors: DataFrame, *, threshold: float = 0.6, top: int = 5, block_rows: int = 16000, asked: DataFrame | None = None
) -> DataFrame:
    """The ``top`` same-class neighbours with cosine >= threshold. ``vectors`` is (id, pos, vec); ``asked`` (id) names the rows
    whose neighbours, among all rows, are wanted, where these are not all: the work is then their number times the rows'.

    Exact and blocked: a class is hashed into blocks of about ``block_rows`` (smaller ones, up to four, where the class is
    small), every pair of blocks is one task that multiplies two matrices and hands on each row's best ``top`` only, so no
    pair list is ever shuffled and a class holding most rows spreads over blocks squared tasks. What is shuffled grows with
    the rows times the blocks. Products are made in single precision; what comes near a row's best is weighed in double.
    """
    def blocks(n: Column) -> Column:
        return F.greatest(F.ceil(n / block_rows), F.least(F.ceil(n / 2000), F.lit(4))).cast("int")

    sizes = vectors.groupBy("pos").agg(F.count("*").alias("n"))
    blocked = vectors.join(sizes, "pos").select(
        "pos", "id", F.col("vec").cast("array<double>").alias("vec"),
        blocks(F.col("n")).alias("nb"),
    ).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    left = blocked
    if asked is not None:
        # the asked rows are dealt to blocks by their own number
        left = cut(left.join(asked.select("id"), "id", "left_semi"))
        n_asked = left.groupBy("pos").agg(blocks(F.count("*")).alias("na"))
        left = left.join(F.broadcast(n_asked), "pos").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("na")).cast("int"))
        blocked = blocked.join(F.broadcast(n_asked), "pos")
    others_of = F.explode(F.sequence(F.lit(0), F.col("na" if asked is not None else "nb") - 1))
    left = left.select("pos", "id", "vec", F.lit(0).alias("side"), F.col("blk").alias("bi"), others.alias("bj"))
    right = blocked.select("pos", "id", "vec", F.lit(1).alias("side"), F.col("blk").alias("bj"), others_of.alias("bi"))

    def best(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        ids = np.asarray(table["id"])
        vec = table["vec"].combine_chunks()
        mat = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
        norm = np.sqrt((mat * mat).sum(axis=1, keepdims=True))
        mat = mat / np.where(norm == 0, 1.0, norm)
        sound = np.isfinite(mat).all(axis=1)
        a, b = np.flatnonzero((side == 0) & sound), np.flatnonzero((side == 1) & sound)
        out_a, out_b, out_c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        single, near = mat.astype(np.float32), mat.shape[1] * 1e-6  # what rounding may take off a product, and more
        right, right_ids = single[b].T.copy(), ids[b]
        for start in range(0, len(a) if len(b) else 0, 256):
            rows = a[start : start + 256]
            sims = single[rows] @ right
            sims[ids[rows][:, None] == right_ids[None, :]] = -2.0
            last = max(len(b) - top, 0)
            least = np.maximum(np.partition(sims, last, axis=1)[:, last], threshold) - near
            i, j = np.nonzero(sims >= least[:, None])
            cos = np.einsum("ij,ij->i", mat[rows[i]], mat[b[j]])
            keep = cos >= threshold
            i, j, cos = i[keep], j[keep], cos[keep]
            order = np.lexsort((-right_ids[j], -cos, i))
            i, j, cos = i[order], j[order], cos[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < top
            out_a.append(ids[rows[i[first]]])
            out_b.append(right_ids[j[first]])
            out_c.append(cos[first])
        out_a, out_b, out_c = (np.concatenate(x) for x in (out_a, out_b, out_c))
        pos = table["pos"][0].as_py()
        return pa.table({"pos": pa.array([pos] * len(out_a), table.schema.field("pos").type),
                         "a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()),
                         "cos": pa.array(out_c, pa.float64())})

    pos_type = vectors.schema["pos"].dataType.simpleString()
    found = left.unionByName(right).groupBy("pos", "bi", "bj").applyInArrow(best, f"pos {pos_type}, a long, b long, cos double")
    w = W.partitionBy("a").orderBy(F.desc("cos"), F.desc("b"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def lemma_sentences(
    passages: DataFrame, *, min_words: int = 8, max_words: int = 40, per_lemma: int = 40, seed: int = 1
) -> DataFrame:
    """(lemma, pid, i): the first place of each lemma in each passage, ``per_lemma`` drawn passages kept.

    ``passages`` is (pid, toks, n), distinct texts. A first cut per (lemma, hash bucket) keeps a lemma
    that is in every passage from ending up in one task.
    """
    rows = passages.filter(F.col("n").between(min_words, max_words)).select(
        "pid", F.posexplode(F.transform("toks", lambda w: tx.lemma_standin(tx.normalize(w)))).alias("i", "lemma")
    ).filter(F.col("lemma").rlike(LEMMA_OK))
    first = rows.groupBy("lemma", "pid").agg(F.min("i").alias("i")).withColumn("o", tx.draw(seed, F.col("lemma"), F.col("pid")))
    inner = W.partitionBy("lemma", F.left("o", F.lit(1))).orderBy("o")
    pre = first.withColumn("k", F.row_number().over(inner)).filter(F.col("k") <= per_lemma)
    w = W.partitionBy("lemma").orderBy("o")
    return pre.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_lemma).select("lemma", "pid", "i")


def keep_exemplified(pairs: DataFrame, sentences: DataFrame, *, min_sentences: int = 4) -> DataFrame:
    """Resource pairs whose two lemmas both have enough sentences."""
    ok = sentences.groupBy("lemma").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sentences)
    return pairs.join(ok.select(F.col("lemma").alias("lemma_a")), "lemma_a", "left_semi").join(
        ok.select(F.col("lemma").alias("lemma_b")), "lemma_b", "left_semi"
    )
