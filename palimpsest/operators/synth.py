"""Synthetic pairs from real seed passages. Every draw is an md5 of its key, so any partitioning gives the same pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.plans.lineage import cut, hash_rank

# How often each change is drawn, and the structural ones that need no lexicon.
WEIGHTS = {
    "MORPH": 0.30, "SYN": 0.20, "SYN-DIST": 0.10, "HYPER": 0.06, "HYPO": 0.04, "DEL": 0.12, "INS": 0.12, "NE-SUB": 0.03, "ANT": 0.03,
}
STRUCTURAL = ("INS", "DEL")
# Spelling alternations that keep the spelling key.
SPELLING_RULES = (
    ("ae", "e"), ("e", "ae"), ("oe", "e"), ("i", "y"), ("nt", "mpt"), ("mpt", "nt"), ("f", "ph"), ("ph", "f"),
    ("^([aeiou])", "h$1"), ("^h", ""), (r"([bcdfglmnprst])\1", "$1"), ("([aeiou])([lmnrst])([aeiou])", "$1$2$2$3"),
    ("ii$", "i"), ("i$", "ii"), ("d$", "t"), ("t$", "d"), ("ies$", "iens"), ("iens$", "ies"), ("m$", "n"),
)


def usable_weights(weights: dict[str, float], realised: set[str]) -> dict[str, float]:
    """Weights over the tags a source can realise; what a dropped tag frees goes to other substitutions only."""
    keep = {t: w for t, w in weights.items() if t not in STRUCTURAL and t in realised}
    if not keep:
        return dict(weights)
    scale = sum(w for t, w in weights.items() if t not in STRUCTURAL) / sum(keep.values())
    out = {t: w * scale for t, w in keep.items()} | {t: w for t, w in weights.items() if t in STRUCTURAL}
    total = sum(out.values())
    return {t: w / total for t, w in out.items()}


#: Hypernyms of a lemma that the two-hop route follows.
HYPERNYMS = 6
TAG_OF = {"synonyms": "SYN", "hypernyms": "HYPER", "hyponyms": "HYPO", "antonyms": "ANT", "derivatives": "POS"}


def substitution_options(
    vocabulary: DataFrame, lexicon: DataFrame, attested: DataFrame, neighbours: DataFrame, names: DataFrame, *, max_list: int = 24
) -> DataFrame:
    """(lemma, tag, route, ord, form): every attested form that may replace a word of ``lemma``, by the relation's tag and
    by the route that leads there; a route of a smaller ``ord`` goes first.

    ``vocabulary`` is (norm, lemma), ``neighbours`` (lemma, other), ``names`` (norm). A form of the lexicon counts for its
    relation, another form of the lemma for MORPH, the next name in drawn order for NE-SUB; SYN-DIST first goes up to a
    hypernym and down to its other hyponyms, then to the neighbours in the vector space. The two hops fan out to
    ``HYPERNYMS`` times ``max_list`` lemmas at most, as longer relation lists are no evidence and are left out."""
    forms = vocabulary.join(attested.select("norm"), "norm", "left_semi").select("lemma", F.col("norm").alias("form")).distinct()
    other = forms.withColumnRenamed("lemma", "other")
    tag = F.create_map(*[F.lit(x) for kv in TAG_OF.items() for x in kv])

    def option(df: DataFrame, name: Column | str, route: str, order: int) -> DataFrame:
        name = F.lit(name) if isinstance(name, str) else name
        return df.select("lemma", name.alias("tag"), F.lit(route).alias("route"), F.lit(order).alias("ord"), "form")

    related = option(lexicon.join(other, "other"), tag[F.col("relation")], "lexicon", 0)
    morph = option(forms.groupBy("lemma").agg(F.max("form").alias("form"), F.count("*").alias("n")).filter("n > 1"), "MORPH", "form", 0)
    lists = lexicon.filter("relation = 'hyponyms'").groupBy("lemma").agg(F.collect_set("other").alias("down")).filter(F.size("down") <= max_list)
    up = lexicon.filter("relation = 'hypernyms'").groupBy("lemma").agg(F.slice(F.array_sort(F.collect_set("other")), 1, HYPERNYMS).alias("up"))
    hops = up.select("lemma", F.explode("up").alias("h")).join(lists.withColumnRenamed("lemma", "h"), "h")
    hops = hops.select("lemma", F.explode("down").alias("other")).filter("lemma <> other").distinct()
    sibling = option(hops.join(other, "other"), "SYN-DIST", "co-hyponym", 0)
    close = option(neighbours.join(other, "other"), "SYN-DIST", "vector", 1)
    known = hash_rank(names.select("norm").join(attested.select("norm"), "norm", "left_semi").distinct(), tx.draw("name", F.col("norm")))
    n_names = known.count()
    after = known.select((F.pmod(F.col("rn") - 2, F.lit(max(n_names, 1))) + 1).alias("rn"), F.col("norm").alias("form"))
    named = known.withColumn("lemma", tx.lemma_standin(F.col("norm"))).filter("lemma is not null").join(after, "rn").filter("form <> norm")
    named = option(named, "NE-SUB", "name", 0)
    out = related
    for part in (morph, sibling, close, named):
        out = out.unionByName(part)
    return out


def substitution_routes(options: DataFrame, *, seed: int = 4) -> DataFrame:
    """(lemma, tag, route, n_options, form): per lemma and tag the first route that leads anywhere, and one of its forms,
    drawn. Options are distinct, so a group is counted before it is drawn from and only its least draw is kept."""
    keyed = options.distinct().groupBy("lemma", "tag", "ord", "route").agg(
        F.count("*").alias("n_options"), F.min_by("form", tx.draw(seed, F.col("lemma"), F.col("tag"), F.col("form"))).alias("form")
    )
    first = keyed.groupBy("lemma", "tag").agg(F.min_by(F.struct("route", "n_options", "form"), "ord").alias("v"))
    return first.select("lemma", "tag", "v.route", "v.n_options", "v.form")


def generate(seeds: DataFrame, subs: DataFrame, weights: dict[str, float], *, variants: int = 4, seed: int = 42) -> DataFrame:
    """Script-first pairs: 1 to 5 drawn places per variant, each deleted, followed by an insertion, or replaced
    by a word a relation attests, as drawn by ``weights``; other words are kept, and so is a word without a
    substitute. ``seeds`` is (pid, toks). Rows are edits (pid, v, i, tag, word, new, ins), one per source word, in
    source order; ``ins`` is the inserted word, drawn from the passage."""
    x = seeds.select("pid", "toks", F.size("toks").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("v"))
    x = x.withColumn("k", tx.bucket_draw(5, seed, F.col("pid"), F.col("v"), "k") + 1)
    words = x.select("pid", "v", "k", "toks", F.posexplode("toks").alias("i", "word")).withColumn("o", tx.draw(seed, F.col("pid"), F.col("v"), F.col("i")))
    ranked = words.withColumn("r", F.row_number().over(W.partitionBy("pid", "v").orderBy("o")))
    u = tx.unit_draw(seed, F.col("pid"), F.col("v"), F.col("i"), "tag")
    *tags, final = [t for t in WEIGHTS if t in weights]
    kind, upto = F.lit(final), sum(weights[t] for t in tags)
    for t in reversed(tags):
        kind = F.when(u < upto, t).otherwise(kind)
        upto -= weights[t]
    want = F.when(F.col("r") <= F.col("k"), kind)
    at = F.floor(tx.unit_draw(seed, F.col("pid"), F.col("v"), F.col("i"), "ins") * F.size("toks")).cast("int")
    ranked = ranked.withColumn("ins", F.get("toks", at)).drop("toks")
    y = ranked.withColumn("want", want).withColumn("lemma", tx.lemma_standin(tx.normalize(F.col("word"))))
    z = y.join(subs.withColumnRenamed("tag", "want"), ["lemma", "want"], "left")
    tag = F.when(F.col("want").isin("DEL", "INS"), F.col("want")).when(F.col("form").isNotNull() & (F.col("form") != tx.normalize(F.col("word"))), F.col("want")).otherwise("NOP")
    return z.select("pid", "v", "i", tag.alias("tag"), "word", F.when(tag.isin("NOP", "INS"), F.col("word")).when(tag == "DEL", F.lit(None)).otherwise(F.col("form")).alias("new"), F.when(tag == "INS", F.col("ins")).alias("ins"))


def apply_edits(edits: DataFrame) -> DataFrame:
    """The variant of every edit list: target places by a running sum of widths (pid, v, i, t, tag, new)."""
    width = F.when(F.col("tag") == "DEL", 0).when(F.col("tag") == "INS", 2).otherwise(1)
    w = W.partitionBy("pid", "v").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return edits.withColumn("w", width).withColumn("t", (F.sum("w").over(w) - F.col("w")).cast("int"))


def variant_words(placed: DataFrame) -> DataFrame:
    """The words of every variant at their places: (pid, v, t, word)."""
    return placed.filter("w > 0").select(
        "pid", "v", F.col("t").alias("_t"), F.posexplode(F.filter(F.array("new", "ins"), lambda x: x.isNotNull())).alias("_k", "word")
    ).select("pid", "v", (F.col("_t") + F.col("_k")).cast("int").alias("t"), "word")


def variants_replay(placed: DataFrame) -> DataFrame:
    """(pid, v, ok, n_t): every target place of a variant is written exactly once, and read in order of places the
    words are those that the edits write in order of the source."""
    read = variant_words(placed).groupBy("pid", "v").agg(
        ((F.count("*") == F.count_distinct("t")) & (F.max("t") + 1 == F.count("*")) & (F.min("t") == 0)).alias("once"), F.count("*").alias("n_t"),
        F.transform(F.array_sort(F.collect_list(F.struct("t", "word"))), lambda x: x["word"]).alias("read"),
    )
    said = F.transform(F.array_sort(F.collect_list(F.struct("i", "new", "ins"))), lambda x: F.array(x["new"], x["ins"]))
    script = placed.groupBy("pid", "v").agg(F.filter(F.flatten(said), lambda x: x.isNotNull()).alias("said"))
    return read.join(script, ["pid", "v"]).select("pid", "v", (F.col("once") & (F.col("read") == F.col("said"))).alias("ok"), "n_t")


def acceptance(tokens: DataFrame, subs: DataFrame, *, target: float, sample: int = 3000, seed: int = 11) -> DataFrame:
    """(coverage, accept): the share of drawn words with a substitute, and target / coverage capped at 1."""
    drawn = tokens.withColumn("o", tx.draw(seed, F.col("pid"), F.col("i"))).orderBy("o").limit(sample)
    have = subs.select("lemma").distinct().withColumn("has", F.lit(1))
    x = drawn.withColumn("lemma", tx.lemma_standin(F.col("norm"))).join(have, "lemma", "left")
    c = F.avg(F.coalesce("has", F.lit(0)))
    return x.agg(F.round(c, 6).alias("coverage"), F.round(F.when(c > 0, F.least(F.lit(1.0), F.lit(target) / c)).otherwise(1.0), 6).alias("accept"))


def select_pool(pool: DataFrame, size: int, rare: tuple[str, ...], *, rare_min: int, seed: int = 1) -> DataFrame:
    """(id, why): per rare tag in order up to ``rare_min`` pairs that hold it, then a drawn fill up to ``size``.

    ``pool`` is (id, tags ARRAY). Pairs that hold the same rare tags differ in their draw alone, so only the first ``size``
    of each such class can ever be taken: one pass over the pool keeps those, and the rounds, each of which depends on
    the one before, run over that bounded remainder, every row of which is read once more to be marked."""
    has = F.filter(F.array(*[F.when(F.array_contains("tags", t), F.lit(t)) for t in rare]), lambda t: t.isNotNull())
    keyed = pool.select("id", has.alias("has"), tx.draw(seed, F.col("id")).alias("o"))
    first = F.row_number().over(W.partitionBy("has").orderBy("o"))
    left = cut(keyed.withColumn("k", first).filter(F.col("k") <= size).drop("k").withColumn("why", F.lit(None).cast("string")))
    taken = 0
    for tag in (*rare, None):
        want = size - taken if tag is None else min(rare_min, size - taken)
        if want <= 0:
            continue
        open_ = F.col("why").isNull() & (F.lit(True) if tag is None else F.array_contains("has", tag))
        last = left.filter(open_).select("o").orderBy("o").limit(want).agg(F.max("o").alias("o"), F.count("*").alias("n")).first()
        taken += last["n"]
        left = cut(left.withColumn("why", F.when(open_ & (F.col("o") <= F.lit(last["o"])), F.lit(tag or "fill")).otherwise(F.col("why"))))
    return left.filter("why is not null").select("id", "why")


def swap_halves(words: DataFrame, *, min_words: int = 6) -> DataFrame:
    """Word tables with the halves of the reuse exchanged at the clause end nearest the middle: (pair_id, t, t2, cut)."""
    n = F.col("n_r")
    mid = F.floor(n / 2).cast("int")
    end = F.when(tx.ends_clause(F.col("word")) & (F.col("t") < n - 1) & (F.col("t") + 1).between(2, n - 2), F.col("t") + 1)
    per = words.filter(n >= min_words).groupBy("pair_id", "n_r").agg(F.min(F.when(end.isNotNull(), F.struct(F.abs(end - mid).alias("d"), end.alias("c")))).alias("b"))
    cut = per.select("pair_id", F.coalesce("b.c", mid).alias("cut"))
    return words.join(cut, "pair_id").withColumn("t2", F.when(F.col("t") < F.col("cut"), F.col("t") + n - F.col("cut")).otherwise(F.col("t") - F.col("cut")))


def error_weighted(errors: DataFrame, k: int, *, floor: float = 0.3, seed: int = 1) -> DataFrame:
    """``k`` ids: a drawn floor share, the rest without replacement by error weight (-ln(u) / w keys). ``errors`` is (id, err)."""
    n_rand = round(floor * k)
    rand = errors.orderBy(tx.draw(seed, F.col("id"))).limit(n_rand).select("id", F.lit("random").alias("why"))
    rest = errors.filter("err > 0").join(rand.select("id"), "id", "left_anti")
    u = F.greatest(tx.unit_draw(seed + 1, F.col("id")), F.lit(1e-12))
    return rand.unionByName(rest.orderBy(F.round(-F.log(u) / F.col("err"), 9), "id").limit(k - n_rand).select("id", F.lit("error").alias("why")))
