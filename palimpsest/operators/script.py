"""Edit scripts: what follows from the links, script rows, costs, validation and replay.

Script rows are (pair_id, seq, tag, src ARRAY<INT>, tgt ARRAY<INT>, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import labels as lb
from palimpsest.functions import text as tx
from palimpsest.operators import typing_ as ty
from palimpsest.plans.lineage import cut

COPIES = ("COPY", "NOP")


def first_links(links: DataFrame) -> DataFrame:
    """Per reuse word its first link by source index."""
    return links.groupBy("pair_id", "t").agg(F.min("s").alias("s"))


def unlinked_reuse(words: DataFrame) -> DataFrame:
    """(pair_id, i, op): MARK in a formula, INS strictly inside the linked stretch, NEW outside it."""
    every = W.partitionBy("pair_id")
    x = words.withColumn("lo", F.min(F.when(F.col("s") >= 0, F.col("t"))).over(every)).withColumn(
        "hi", F.max(F.when(F.col("s") >= 0, F.col("t"))).over(every)
    ).filter("s < 0")
    inside = (F.col("t") > F.col("lo")) & (F.col("t") < F.col("hi"))
    return x.select("pair_id", F.col("t").alias("i"), F.when(F.col("frame") == 1, "MARK").when(inside, "INS").otherwise("NEW").alias("op"))


def unlinked_source(links: DataFrame, swords: DataFrame) -> DataFrame:
    """(pair_id, i, op): DEL strictly inside the claimed stretch of the source, OUT outside it."""
    claimed = links.filter("s >= 0").select("pair_id", "s").distinct()
    span = claimed.groupBy("pair_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    free = swords.select("pair_id", "s").join(claimed, ["pair_id", "s"], "left_anti").join(span, "pair_id", "left")
    inside = (F.col("s") > F.col("lo")) & (F.col("s") < F.col("hi"))
    return free.select("pair_id", F.col("s").alias("i"), F.when(inside, "DEL").otherwise("OUT").alias("op"))


def quotes(words: DataFrame, *, minimum: int = 4) -> DataFrame:
    """Runs of copies with consecutive sources: (pair_id, a, b) with both ends inclusive."""
    w = W.partitionBy("pair_id", "d").orderBy("t")
    on = words.filter((F.col("s") >= 0) & F.col("tag").isin(*COPIES)).withColumn("d", F.col("t") - F.col("s"))
    isl = on.withColumn("g", F.col("t") - F.row_number().over(w))
    return isl.groupBy("pair_id", "d", "g").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).filter(
        F.col("n") >= minimum
    ).select("pair_id", "a", "b")


def longest_chain(values: Column) -> Column:
    """0-based places of one longest strictly increasing subsequence, by the patience rule.

    A fold inside the row: ``tails`` holds, per length, the place that ends a chain of that length, and
    ``back`` the place before each place in its chain.
    """
    value_at = lambda i: F.get(values, i)

    def step(acc: Column, i: Column) -> Column:
        k = F.size(F.filter(acc["tails"], lambda p: value_at(p) < value_at(i)))
        tails = F.concat(F.slice(acc["tails"], 1, k), F.array(i), F.slice(acc["tails"], k + 2, F.greatest(F.size(acc["tails"]) - k - 1, F.lit(0))))
        before = F.when(k > 0, F.get(acc["tails"], k - 1)).otherwise(F.lit(-1))
        return F.struct(tails.alias("tails"), F.concat(acc["back"], F.array(before)).alias("back"))

    none = F.array().cast("array<int>")
    places = F.sequence(F.lit(0), F.size(values) - 1)
    # walk the back pointers from the last tail: one step per chain member
    walk = lambda st: F.aggregate(
        st["tails"],
        F.array(F.element_at(st["tails"], -1)),
        lambda keep, _: F.when(
            F.get(st["back"], F.element_at(keep, -1)) >= 0,
            F.concat(keep, F.array(F.get(st["back"], F.element_at(keep, -1)))),
        ).otherwise(keep),
    )
    start = F.struct(none.alias("tails"), none.alias("back"))
    return F.when(F.size(values) > 0, F.aggregate(places, start, step, walk)).otherwise(none)


def reordered(links: DataFrame) -> DataFrame:
    """(pair_id, t): linked words outside the longest chain of links in source order."""
    per = links.filter("s >= 0").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("t", "s"))).alias("l"))
    per = per.filter(F.size("l") >= 2).withColumn("v", F.transform("l", lambda x: x["s"]))
    per = per.withColumn("keep", longest_chain(F.col("v")))
    return per.select("pair_id", "keep", F.posexplode("l").alias("k", "x")).filter(~F.array_contains("keep", F.col("k"))).select(
        "pair_id", F.col("x.t").alias("t")
    )


def dispersed(words: DataFrame) -> DataFrame:
    """(pair_id, t): clause-ending words from the first up to before the last linked word."""
    every = W.partitionBy("pair_id")
    x = words.withColumn("lo", F.min(F.when(F.col("s") >= 0, F.col("t"))).over(every)).withColumn(
        "hi", F.max(F.when(F.col("s") >= 0, F.col("t"))).over(every)
    )
    return x.filter((F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi")) & tx.ends_clause(F.col("word"))).select("pair_id", "t")


def adapted(words: DataFrame, *, max_gap: int = 1, min_subst: int = 2) -> DataFrame:
    """Linked regions with small gaps that hold several substitutions: (pair_id, a, b)."""
    w = W.partitionBy("pair_id").orderBy("t")
    on = words.filter("s >= 0").withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= max_gap + 1, 0).otherwise(1))
    blocks = on.withColumn("blk", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return blocks.groupBy("pair_id", "blk").agg(
        F.min("t").alias("a"), F.max("t").alias("b"), F.count_if(F.col("tag").isin(*ty.SUBST_LIKE)).alias("n")
    ).filter(F.col("n") >= min_subst).select("pair_id", "a", "b")


def decode_script(words: DataFrame, swords: DataFrame) -> DataFrame:
    """Script rows of a typed word table: formulas and quotes as one act each, links, insertions, deletions,
    then the markers. Equal forms are copies; a tag that is no link tag is a substitution."""
    src = swords.select("pair_id", "s", F.col("norm").alias("_sn"))
    w = words.join(src, ["pair_id", "s"], "left").withColumn(
        "tag", F.when(F.col("s") < 0, "INS").when((F.col("_sn") == F.col("norm")) | F.col("tag").isin(*COPIES), "NOP").otherwise(F.col("tag"))
    ).drop("_sn")
    # read a dozen times below: written once, where it lies
    w = cut(ty.clean_mask(w).select("pair_id", "t", "word", "s", "tag", "frame"), laid=True)
    none = F.array().cast("array<int>")
    frames = ty.runs(w, F.col("frame") == 1).select("pair_id", "a", "b", F.lit("FRAME").alias("act"))
    acts = frames.unionByName(quotes(w).withColumn("act", F.lit("QUOTE")))
    inside = acts.select("pair_id", "a", "act", F.explode(F.sequence("a", "b")).alias("t"))
    x = w.join(inside, ["pair_id", "t"], "left")
    write = x.groupBy("pair_id", F.coalesce("a", "t").alias("at"), F.coalesce("act", "tag").alias("tag")).agg(
        F.array_sort(F.collect_list(F.struct("t", "s"))).alias("l")
    ).select(
        "pair_id", F.lit(0).alias("part"), "at", "tag",
        F.filter(F.transform("l", lambda e: e["s"]), lambda s: s >= 0).alias("src"), F.transform("l", lambda e: e["t"]).alias("tgt"),
    )
    used = w.filter("s >= 0").select("pair_id", "s").distinct()
    dels = swords.select("pair_id", "s").join(used, ["pair_id", "s"], "left_anti").select(
        "pair_id", F.lit(1).alias("part"), F.col("s").alias("at"), F.lit("DEL").alias("tag"), F.array("s").alias("src"), none.alias("tgt")
    )
    link = w.filter("s >= 0").select("pair_id", "t", "s")
    moved = reordered(link).join(link, ["pair_id", "t"]).select(
        "pair_id", F.lit(2).alias("part"), F.col("t").alias("at"), F.lit("REORDER").alias("tag"), F.array("s").alias("src"), none.alias("tgt")
    )
    adapt = adapted(w).select("pair_id", "a", F.explode(F.sequence("a", "b")).alias("t")).join(link, ["pair_id", "t"]).groupBy("pair_id", "a").agg(
        F.array_sort(F.collect_list(F.struct("t", "s"))).alias("l")
    ).select("pair_id", F.lit(3).alias("part"), F.col("a").alias("at"), F.lit("ADAPT").alias("tag"), F.transform("l", lambda e: e["s"]).alias("src"), none.alias("tgt"))
    spread = dispersed(w).select("pair_id").distinct().join(
        link.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("t", "s"))).alias("l")), "pair_id"
    ).select("pair_id", F.lit(4).alias("part"), F.lit(0).alias("at"), F.lit("DISPERSE").alias("tag"), F.transform("l", lambda e: e["s"]).alias("src"), none.alias("tgt"))
    rows = write.unionByName(dels).unionByName(moved).unionByName(adapt).unionByName(spread)
    seq = F.row_number().over(W.partitionBy("pair_id").orderBy("part", "at")) - 1
    return rows.select("pair_id", seq.alias("seq"), "tag", "src", "tgt")


def per_word_view(script: DataFrame, rwords: DataFrame) -> DataFrame:
    """Tags, link, formula, quote and reorder flags per reuse word, read back from script rows."""
    acts = script.filter(~F.col("tag").isin("REORDER", "ADAPT", "DISPERSE", "DEL")).select(
        "pair_id", "tag", "src", F.posexplode("tgt").alias("k", "t")
    ).select("pair_id", "t", "tag", F.get("src", F.col("k")).alias("s"))
    v = rwords.select("pair_id", "t").join(acts, ["pair_id", "t"], "left").select(
        "pair_id", "t",
        F.when(F.col("tag") == "QUOTE", "NOP").when(F.col("tag").isNull() | (F.col("tag") == "FRAME"), "INS").otherwise(F.col("tag")).alias("tag"),
        F.coalesce("s", F.lit(-1)).alias("link"), (F.col("tag") == "FRAME").alias("frame"), (F.col("tag") == "QUOTE").alias("quote"),
    )
    moved = reordered(v.filter("link >= 0").select("pair_id", "t", F.col("link").alias("s"))).withColumn("reorder", F.lit(True))
    return v.join(moved, ["pair_id", "t"], "left").withColumn("reorder", F.coalesce("reorder", F.lit(False)))


def op_counts(script: DataFrame) -> DataFrame:
    return script.groupBy("pair_id", "tag").agg(F.count("*").alias("n"))


def costs(script: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cost and normalised cost per script (linear in the operation counts)."""
    per = script.groupBy("pair_id").agg(F.sum(lb.lookup("cost", F.col("tag"))).alias("cost"))
    return pairs.select("pair_id", "n_s", "n_r").join(per, "pair_id").select(
        "pair_id", "cost", (F.col("cost") / F.greatest("n_s", "n_r", F.lit(1))).alias("normalized")
    )


def invert(script: DataFrame) -> DataFrame:
    return script.select("pair_id", "seq", lb.lookup("inverse", F.col("tag")).alias("tag"), F.col("tgt").alias("src"), F.col("src").alias("tgt"))


def problems(script: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, problem, i): positions written twice or never, sources consumed twice or out of range."""
    live = script.filter(lb.lookup("role", F.col("tag")) != "m")
    tgt = live.select("pair_id", F.explode("tgt").alias("i"))
    src = live.select("pair_id", F.explode("src").alias("i"))
    twice = tgt.groupBy("pair_id", "i").agg(F.count("*").alias("n")).filter("n > 1").select("pair_id", F.lit("written twice").alias("problem"), "i")
    eaten = src.groupBy("pair_id", "i").agg(F.count("*").alias("n")).filter("n > 1").select("pair_id", F.lit("consumed twice").alias("problem"), "i")
    out = src.join(pairs.select("pair_id", "n_s"), "pair_id").filter((F.col("i") < 0) | (F.col("i") >= F.col("n_s"))).select(
        "pair_id", F.lit("out of range").alias("problem"), "i"
    )
    top = tgt.groupBy("pair_id").agg(F.max("i").alias("m"))
    gap = top.select("pair_id", F.explode(F.sequence(F.lit(0), "m")).alias("i")).join(tgt, ["pair_id", "i"], "left_anti").select(
        "pair_id", F.lit("never written").alias("problem"), "i"
    )
    return twice.unionByName(eaten).unionByName(out).unionByName(gap)


def replays(script: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, ok): the script is sound, writes every word of the reuse passage once, and what it copies from the
    source (single copies and quotes) is what the passage says there."""
    bad = problems(script, pairs).select("pair_id").distinct().withColumn("bad", F.lit(True))
    wrote = script.filter(lb.lookup("role", F.col("tag")) == "w").select("pair_id", F.explode("tgt").alias("t"))
    n = wrote.groupBy("pair_id").agg(F.count_distinct("t").alias("n_wrote"))
    copied = script.filter(F.col("tag").isin("NOP", "QUOTE")).select("pair_id", F.explode(F.arrays_zip("src", "tgt")).alias("c"))
    said = copied.join(pairs.select("pair_id", "s_norm", "r_norm"), "pair_id")
    other = said.filter(~F.get("s_norm", F.col("c.src")).eqNullSafe(F.get("r_norm", F.col("c.tgt"))))
    other = other.select("pair_id").distinct().withColumn("other", F.lit(True))
    whole = pairs.select("pair_id", "n_r").join(n, "pair_id", "left").join(bad, "pair_id", "left").join(other, "pair_id", "left")
    ok = F.col("bad").isNull() & F.col("other").isNull() & (F.coalesce("n_wrote", F.lit(0)) == F.col("n_r"))
    return whole.select("pair_id", ok.alias("ok"))


def serialise(script: DataFrame, pairs: DataFrame) -> DataFrame:
    """One line per pair: ``TAG src>tgt words`` joined by bars."""
    idx = lambda c: F.when(F.size(c) == 0, "-").otherwise(F.array_join(F.transform(c, lambda i: i.cast("string")), ","))
    x = script.join(pairs.select("pair_id", "r_tok"), "pair_id")
    toks = F.array_join(F.transform("tgt", lambda i: F.get("r_tok", i)), " ")
    line = F.concat(F.col("tag"), F.lit(" "), idx("src"), F.lit(">"), idx("tgt"), F.when(toks != "", F.concat(F.lit(" "), toks)).otherwise(""))
    per = x.withColumn("line", line).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return per.select("pair_id", F.array_join(F.transform("l", lambda e: e["line"]), " | ").alias("script"))


def parse(lines: DataFrame) -> DataFrame:
    """Script rows back from serialised text: (pair_id, seq, tag, src, tgt). Lines with an unknown tag give none."""
    pattern = r"<?([A-Z][A-Z\-]*)>?\s+([\d,]+|-)\s*>\s*([\d,]+|-)"
    ints = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))
    rows = lines.select("pair_id", F.posexplode(F.split("script", r"\|")).alias("seq", "chunk")).withColumn(
        "tag", F.regexp_extract("chunk", pattern, 1)
    ).filter("tag <> ''").select(
        "pair_id", "seq", "tag", ints(F.regexp_extract("chunk", pattern, 2)).alias("src"), ints(F.regexp_extract("chunk", pattern, 3)).alias("tgt")
    )
    unknown = rows.filter(lb.lookup("cost", F.col("tag")).isNull()).select("pair_id").distinct()
    return rows.join(unknown, "pair_id", "left_anti")


def label_shares(tags: DataFrame) -> DataFrame:
    """Share of each released label over all links. One row per label, so the total is a tiny window."""
    per = tags.select(lb.released_label(F.col("tag")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def pair_label(words: DataFrame) -> DataFrame:
    """cit where two adjacent copies stand in source order, else cf."""
    w = W.partitionBy("pair_id").orderBy("t")
    copy = (F.col("s") >= 0) & F.col("tag").isin(*COPIES)
    run = copy & F.lead(copy).over(w) & (F.lead("s").over(w) == F.col("s") + 1)
    return words.withColumn("run", F.coalesce(run, F.lit(False))).groupBy("pair_id").agg(
        F.when(F.bool_or("run"), "cit").otherwise("cf").alias("label")
    )


def cost_density(script: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cost outside formulas per word of the larger window (the passage without its formula words)."""
    formula = F.col("tag") == "FRAME"
    per = script.groupBy("pair_id").agg(
        F.sum(F.when(formula, 0.0).otherwise(lb.lookup("cost", F.col("tag")))).alias("c"),
        F.sum(F.when(formula, F.size("tgt")).otherwise(0)).alias("written"),
        F.sum(F.when(formula, F.size("src")).otherwise(0)).alias("consumed"),
    )
    wide = F.greatest(F.col("n_s") - F.col("consumed"), F.col("n_r") - F.col("written"), F.lit(1))
    return pairs.select("pair_id", "n_s", "n_r").join(per, "pair_id").select("pair_id", (F.col("c") / wide).alias("density"))


def positional_counts(pairs: DataFrame) -> DataFrame:
    """Operation counts of the script that only compares equal positions: (pair_id, NOP, INS, DEL)."""
    both = F.zip_with("s_norm", "r_norm", lambda a, b: F.coalesce(a == b, F.lit(False)))
    same = F.size(F.filter(both, lambda x: x))
    return pairs.select("pair_id", same.alias("nop"), (F.col("n_r") - same).alias("ins"), (F.col("n_s") - same).alias("del"))


def difficulty(script: DataFrame, pairs: DataFrame) -> DataFrame:
    """How hard a script is: operations, substitutions, shared words, and whether positions alone give it away."""
    plain = ("NOP", "INS", "DEL", "REORDER", "ADAPT", "DISPERSE", "QUOTE")
    per = script.groupBy("pair_id").agg(
        F.count("*").alias("n_operations"),
        F.count_if(~F.col("tag").isin(*plain)).alias("n_substitutions"),
        F.count_if(F.col("tag") == "NOP").alias("c_nop"), F.count_if(F.col("tag") == "INS").alias("c_ins"), F.count_if(F.col("tag") == "DEL").alias("c_del"),
    )
    shared = F.size(F.filter("r_norm", lambda w: F.array_contains(F.col("s_norm"), w)))
    base = positional_counts(pairs)
    return pairs.select("pair_id", (shared / F.greatest("n_r", F.lit(1))).alias("overlap")).join(per, "pair_id").join(base, "pair_id").select(
        "pair_id", "n_operations", "n_substitutions", "overlap",
        ((F.col("c_nop") == F.col("nop")) & (F.col("c_ins") == F.col("ins")) & (F.col("c_del") == F.col("del"))
         & (F.col("n_operations") == F.col("c_nop") + F.col("c_ins") + F.col("c_del"))).alias("positional"),
    )


def trivial_scripts(pairs: DataFrame) -> DataFrame:
    """The copy-by-position script and the delete-all-insert-all script: (method, pair_id, tag, s, t)."""
    shared = F.least("n_s", "n_r")
    cut_ = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    zero, none = F.lit(0), F.lit(-1)
    parts = (
        ("copy_only", "NOP", cut_(zero, shared), True, True),
        ("copy_only", "INS", cut_(shared, F.col("n_r")), False, True),
        ("copy_only", "DEL", cut_(shared, F.col("n_s")), True, False),
        ("degenerate", "DEL", cut_(zero, F.col("n_s")), True, False),
        ("degenerate", "INS", cut_(zero, F.col("n_r")), False, True),
    )
    out = None
    for method, tag, places, has_s, has_t in parts:
        rows = pairs.select(F.lit(method).alias("method"), "pair_id", F.lit(tag).alias("tag"), F.explode(places).alias("i")).select(
            "method", "pair_id", "tag", (F.col("i") if has_s else none).alias("s"), (F.col("i") if has_t else none).alias("t")
        )
        out = rows if out is None else out.unionByName(rows)
    return out
