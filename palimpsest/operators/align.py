"""Cells, decoders and link rules. Cells are (pair_id, t, s, p); the null candidate has s = -1.

All rules are local to a pair, so a chain of them needs one shuffle on ``pair_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.plans.lineage import cut, is_empty

#: Weight of the null against candidate weights of up to 1000, and the least weight of a candidate.
NULL_WEIGHT = 300
MIN_WEIGHT = 400


def grid(pairs: DataFrame) -> DataFrame:
    """All cells of a pair. Two nested explodes of arrays in the row: no join, no shuffle."""
    return (
        pairs.select(
            "pair_id", "n_s", "n_r", "s_tok", "s_norm",
            F.posexplode(F.arrays_zip("r_tok", "r_norm")).alias("t", "r"),
        )
        .select(
            "pair_id", "n_s", "n_r", "t", F.col("r.r_tok").alias("rw"), F.col("r.r_norm").alias("rn"),
            F.posexplode(F.arrays_zip("s_tok", "s_norm")).alias("s", "x"),
        )
        .select(
            "pair_id", "n_s", "n_r", "t", "s", "rw", "rn",
            F.col("x.s_tok").alias("sw"), F.col("x.s_norm").alias("sn"),
        )
    )


def form_weight(a: Column, b: Column) -> Column:
    """Edit similarity of two forms as a whole number of thousandths."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.floor((longest - F.levenshtein(a, b)) * 1000 / longest).cast("int")


def form_cells(pairs: DataFrame) -> DataFrame:
    """Candidate cells by form similarity, with row- and column-normalised probabilities.

    Whole-number weights keep the sums exact, so p is the same on every engine and partitioning.
    """
    base = grid(pairs).withColumn("wgt", form_weight(F.col("sn"), F.col("rn")))
    # a pair's cells are made in one task and the pair table is hashed on pair_id: no shuffle here
    cells = base.filter(F.col("wgt") >= MIN_WEIGHT)
    row, col = W.partitionBy("pair_id", "t"), W.partitionBy("pair_id", "s")
    return cells.select(
        "pair_id", "n_s", "n_r", "t", "s", "rw", "rn", "sw", "sn", "wgt",
        (F.col("wgt") / (F.sum("wgt").over(row) + NULL_WEIGHT)).alias("p_fwd"),
        (F.col("wgt") / (F.sum("wgt").over(col) + NULL_WEIGHT)).alias("p_rev"),
    )


def rows_with_null(cells: DataFrame, words: DataFrame, index: str, prob: str) -> DataFrame:
    """Score rows of one direction: the cells plus one null per word of that side."""
    other = "s" if index == "t" else "t"
    real = cells.select("pair_id", index, other, F.col(prob).alias("p"))
    mass = cells.groupBy("pair_id", index).agg(F.sum("wgt").alias("m"))
    null = (
        words.select("pair_id", index)
        .join(mass, ["pair_id", index], "left")
        .select(
            "pair_id", index, F.lit(-1).alias(other),
            (F.lit(NULL_WEIGHT) / (F.coalesce("m", F.lit(0)) + NULL_WEIGHT)).alias("p"),
        )
    )
    return real.unionByName(null)


def copy_links(pairs: DataFrame) -> DataFrame:
    """Identical forms linked left to right, the source cursor moving only forward.

    A fold over the reuse words inside the row: the state is (cursor, links so far).
    """
    step = lambda acc, w: F.struct(
        F.when(_next(acc, w) >= 0, _next(acc, w) + 1).otherwise(acc["cur"]).cast("int").alias("cur"),
        F.concat(acc["links"], F.array(_next(acc, w))).alias("links"),
    )
    start = F.struct(F.lit(0).alias("cur"), F.array().cast("array<int>").alias("links"))
    folded = F.aggregate("r_norm", start, step, lambda acc: acc["links"])
    return (
        pairs.select("pair_id", "n_s", "n_r", F.posexplode(folded).alias("t", "s"))
        .filter("s >= 0")
        .select("pair_id", "t", "s")
    )


def _next(acc: Column, w: Column) -> Column:
    """Position of ``w`` in the source at or after the cursor, or -1."""
    rest = F.slice(F.col("s_norm"), acc["cur"] + 1, F.greatest(F.col("n_s") - acc["cur"], F.lit(0)))
    found = F.array_position(rest, w).cast("int")
    return F.when(found > 0, acc["cur"] + found - 1).otherwise(F.lit(-1)).cast("int")


def best_cell(cells: DataFrame, by: str, of: str, *, larger_index: bool) -> DataFrame:
    """The best candidate per word: highest p, ties to the larger or the smaller index."""
    key = F.struct("p", F.col(of)) if larger_index else F.struct("p", -F.col(of))
    return cells.groupBy("pair_id", by).agg(
        F.max_by(F.struct(F.col(of), F.col("p")), key).alias("b")
    ).select("pair_id", by, F.col(f"b.{of}").alias(of), F.col("b.p").alias("p"))


def head(rows: DataFrame, by: str, of: str) -> DataFrame:
    """The head of each row, the null included; ties to the smaller index, the null last."""
    rank = F.when(F.col(of) < 0, 1 << 30).otherwise(F.col(of))
    return rows.groupBy("pair_id", by).agg(
        F.max_by(F.struct(F.col(of), F.col("p")), F.struct("p", -rank)).alias("b")
    ).select("pair_id", by, F.col(f"b.{of}").alias(of), F.col("b.p").alias("p"))


def mutual_best(fwd: DataFrame, rev: DataFrame, *, theta: float | None = None) -> DataFrame:
    """(t, s) that are each other's head; a null head blocks; with ``theta`` only if p >= theta."""
    a = head(fwd, "t", "s").filter("s >= 0")
    b = head(rev, "s", "t").filter("t >= 0").select("pair_id", "s", "t")
    out = a.join(b, ["pair_id", "t", "s"])
    return out if theta is None else out.filter(F.col("p") >= theta)


# ---- greedy and optimal assignment -------------------------------------------------------------


def greedy(cells: DataFrame, order: list[Column], *, cap: int = 1) -> DataFrame:
    """Best cells first, a word once, a source at most ``cap`` times. ``order`` must be total.

    A pair's cells (at most its two lengths multiplied) are sorted and folded inside one row, which is
    the sequential rule itself: no rounds, one shuffle on ``pair_id``.
    """
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("t"), F.col("s"))
    per = cells.groupBy("pair_id").agg(F.array_sort(F.collect_list(key)).alias("c"))

    def step(links: Column, c: Column) -> Column:
        taken = F.exists(links, lambda x: x["t"] == c["t"]) | (
            F.size(F.filter(links, lambda x: x["s"] == c["s"])) >= cap
        )
        return F.when(taken, links).otherwise(
            F.concat(links, F.array(F.struct(c["t"].alias("t"), c["s"].alias("s"))))
        )

    start = F.array().cast("array<struct<t:int,s:int>>")
    return per.select("pair_id", F.inline(F.aggregate("c", start, step)))


def null_of(rows: DataFrame) -> DataFrame:
    return rows.filter("s < 0").select("pair_id", "t", F.col("p").alias("p_null"))


def greedy_rows(rows: DataFrame, *, cap: int = 1) -> DataFrame:
    """Cells above the word's null, most probable first."""
    w = W.partitionBy("pair_id", "t")
    claims = rows.withColumn("p_null", F.max(F.when(F.col("s") < 0, F.col("p"))).over(w)).filter(
        (F.col("s") >= 0) & (F.col("p") > F.coalesce("p_null", F.lit(0.0)))
    )
    return greedy(claims, [-F.col("p")], cap=cap)


def greedy_best_cell(rows: DataFrame, theta: float) -> DataFrame:
    """Each word offers its best cell only; a source goes to the strongest offer above ``theta``."""
    best = best_cell(rows.filter("s >= 0"), "t", "s", larger_index=True).filter(F.col("p") > theta)
    w = W.partitionBy("pair_id", "s").orderBy(F.desc("p"), F.desc("t"))
    return best.withColumn("k", F.row_number().over(w)).filter("k = 1").select("pair_id", "t", "s")


def argmax(rows: DataFrame) -> DataFrame:
    """The best real cell of each word if it beats the word's null; ties to the larger source."""
    best = best_cell(rows.filter("s >= 0"), "t", "s", larger_index=True)
    return best.join(null_of(rows), ["pair_id", "t"], "left").filter(
        F.col("p") > F.coalesce("p_null", F.lit(0.0))
    ).select("pair_id", "t", "s", "p")


def raw_decode(rows: DataFrame) -> DataFrame:
    return head(rows, "t", "s").filter("s >= 0")


def threshold_decode(rows: DataFrame, theta: float | Column) -> DataFrame:
    best = best_cell(rows.filter("s >= 0"), "t", "s", larger_index=True)
    return best.filter(F.col("p") >= theta)


def average(fwd: DataFrame, rev: DataFrame) -> DataFrame:
    """Mean of both directions over the union of candidates, a missing side 0; the forward null stays."""
    # a union and a sum per cell instead of a full join: an outer join forgets that its rows lie by pair
    none = F.lit(0.0)
    f = fwd.filter("s >= 0").select("pair_id", "t", "s", F.col("p").alias("pf"), none.alias("pr"))
    r = rev.filter("t >= 0").select("pair_id", "t", "s", none.alias("pf"), F.col("p").alias("pr"))
    real = f.unionByName(r).groupBy("pair_id", "t", "s").agg(F.max("pf").alias("pf"), F.max("pr").alias("pr")).select(
        "pair_id", "t", "s", ((F.col("pf") + F.col("pr")) * 0.5).alias("p")
    )
    return real.unionByName(fwd.filter("s < 0").select("pair_id", "t", "s", "p"))


def with_threshold(rows: DataFrame, theta: float) -> DataFrame:
    """Real candidates below ``theta`` go; a word without a null gains one at ``theta``."""
    kept = rows.filter((F.col("s") < 0) | (F.col("p") >= theta))
    bare = rows.groupBy("pair_id", "t").agg(F.min("s").alias("m")).filter("m >= 0")
    return kept.unionByName(bare.select("pair_id", "t", F.lit(-1).alias("s"), F.lit(theta).alias("p")))


def _solve(per: DataFrame, *, nulls: bool) -> DataFrame:
    """Optimal one-to-one links of each row's cells (pair_id, c ARRAY<STRUCT<t,s,p>>), in Arrow batches."""
    from palimpsest.operators.kernels import assignment_batches

    def run(batches):
        yield from assignment_batches(batches, nulls)

    return per.select("pair_id", "c").mapInArrow(run, "pair_id string, t int, s int")


def optimal_pairs(candidates: DataFrame) -> DataFrame:
    """Minimum total cost one-to-one assignment over (pair_id, t, s, cost): the most links, then the least
    cost. A pair's cells are gathered once, where the pair lies; cells that do not compete are told apart there."""
    cheapest = candidates.groupBy("pair_id", "t", "s").agg(F.min("cost").alias("p"))
    return _solve(cheapest.groupBy("pair_id").agg(F.collect_list(F.struct("t", "s", "p")).alias("c")), nulls=False)


def hungarian(rows: DataFrame, *, kept: bool = False) -> DataFrame:
    """Links that maximise the summed probability, every word free to take its own null.

    A pair whose words all prefer different sources is optimal as it stands; only contested pairs go to
    the solver. ``kept`` tells that ``rows`` are written already.
    """
    rows = rows if kept else cut(rows, laid=True)  # read three times below; the plan above it runs once
    best = head_above_null(rows)
    clash = best.groupBy("pair_id", "s").agg(F.count("*").alias("n")).filter("n > 1").select("pair_id").distinct()
    easy = best.join(clash, "pair_id", "left_anti").select("pair_id", "t", "s")
    hard = rows.join(clash, "pair_id", "left_semi").groupBy("pair_id").agg(
        F.collect_list(F.struct("t", "s", "p")).alias("c")
    )
    return easy.unionByName(_solve(hard, nulls=True))


def assignment_cost(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """(pair_id, links, cost) of an assignment over (pair_id, t, s, cost): what has to be least, whichever of several equally
    good assignments was taken. Every pair with candidates has a row."""
    cheapest = candidates.groupBy("pair_id", "t", "s").agg(F.min("cost").alias("cost"))
    taken = links.select("pair_id", "t", "s", F.lit(1).alias("k"))
    x = cheapest.join(taken, ["pair_id", "t", "s"], "left")
    return x.groupBy("pair_id").agg(F.count("k").alias("links"), F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("cost"))), F.lit(0.0)).alias("cost"))


def assignment_value(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(pair_id, value): the summed probability of an assignment, an unlinked word counting with its null."""
    linked = links.select("pair_id", "t", F.col("s").alias("_s"))
    x = rows.join(linked, ["pair_id", "t"], "left").filter(F.col("s") == F.coalesce("_s", F.lit(-1)))
    return x.groupBy("pair_id").agg(F.round(F.sum("p"), 6).alias("value"))


def head_above_null(rows: DataFrame) -> DataFrame:
    best = best_cell(rows.filter("s >= 0"), "t", "s", larger_index=False)
    return best.join(null_of(rows), ["pair_id", "t"], "left").filter(
        F.col("p") > F.coalesce("p_null", F.lit(0.0))
    ).select("pair_id", "t", "s", "p")


def default_decode(fwd: DataFrame, rev: DataFrame | None, theta: float) -> DataFrame:
    rows = fwd if rev is None else average(fwd, rev)
    return hungarian(with_threshold(rows, theta))


# ---- agreement rules -----------------------------------------------------------------------------


def intersect(fwd: DataFrame, rev: DataFrame, c: float) -> DataFrame:
    """Rows restricted to cells above ``c`` in both directions; nulls stay."""
    other = rev.filter((F.col("t") >= 0) & (F.col("p") > c)).select("pair_id", "t", "s")
    kept = fwd.filter((F.col("s") >= 0) & (F.col("p") > c)).join(other, ["pair_id", "t", "s"], "left_semi")
    return kept.select("pair_id", "t", "s", "p").unionByName(fwd.filter("s < 0").select("pair_id", "t", "s", "p"))


def intersect_links(fwd: DataFrame, rev: DataFrame, c: float) -> DataFrame:
    """(pair_id, t, s, rank): the best kept candidate is the link, the rest are extra edges."""
    w = W.partitionBy("pair_id", "t").orderBy(F.desc("p"), F.desc("s"))
    return intersect(fwd, rev, c).filter("s >= 0").select("pair_id", "t", "s", F.row_number().over(w).alias("rank"))


def grow_diag_final(fwd: DataFrame, rev: DataFrame, *, final: str = "and") -> DataFrame:
    """Grow-diag-final(-and) over the two argmax alignments, as rounds over their union.

    In every round the union points beside an accepted point whose word or source is still free are candidates;
    the first in (t, s) order is accepted, until there is none. Then the points left are gone through in the same
    order: a point joins if both its sides are free ("and"), or either. Points with equal claims inside a round may
    so come in another order than in a scan that updates in place.
    """
    from palimpsest.operators.kernels import grown_batches

    f = argmax(fwd).select("pair_id", "t", "s", F.lit(1).alias("k"))
    back = argmax(rev.select("pair_id", F.col("s").alias("t"), F.col("t").alias("s"), "p"))
    r = back.select("pair_id", F.col("s").alias("t"), F.col("t").alias("s"), F.lit(2).alias("k"))
    points = f.unionByName(r).groupBy("pair_id", "t", "s").agg(F.sum("k").cast("int").alias("k"))
    # the forward probability that ranks the links is looked up where the points lie, and goes with them
    rated = points.join(fwd.select("pair_id", "t", "s", "p"), ["pair_id", "t", "s"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    per = rated.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("t", "s", "k", "p"))).alias("u"))

    def run(batches):
        yield from grown_batches(batches, final)

    return per.mapInArrow(run, "pair_id string, t int, s int, rank int")


def entropy_filter(fwd: DataFrame, rev: DataFrame, tau: float) -> DataFrame:
    """Drop the cells whose row and column are both too uncertain (entropy over log n)."""

    def spread(df: DataFrame, by: str, out: str) -> DataFrame:
        z = F.sum(F.when(F.col("p") > 1e-12, F.col("p"))).over(W.partitionBy("pair_id", by))
        q = F.col("p") / z
        terms = df.withColumn("h", F.when(F.col("p") > 1e-12, -q * F.log(q)).otherwise(0.0))
        n = F.greatest(F.count("*"), F.lit(2))
        return terms.groupBy("pair_id", by).agg((F.sum("h") / F.greatest(F.log(n), F.lit(1e-9))).alias(out))

    h_row, h_col = spread(fwd, "t", "hr"), spread(rev, "s", "hc")
    real = (
        fwd.filter("s >= 0").join(h_row, ["pair_id", "t"]).join(h_col, ["pair_id", "s"], "left")
        .filter(F.least("hr", F.coalesce("hc", F.lit(1.0))) <= tau)
    )
    return real.select("pair_id", "t", "s", "p").unionByName(fwd.filter("s < 0").select("pair_id", "t", "s", "p"))


def compose(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Keep a candidate only if every rule kept it; the null is the first rule's."""
    out = first.filter("s >= 0")
    for df in others:
        out = out.join(df.filter("s >= 0").select("pair_id", "t", "s"), ["pair_id", "t", "s"], "left_semi")
    return out.select("pair_id", "t", "s", "p").unionByName(first.filter("s < 0").select("pair_id", "t", "s", "p"))


def null_scale(rows: DataFrame, k: float) -> DataFrame:
    e = rows.withColumn("e", F.when(F.col("s") < 0, F.col("p") * k).otherwise(F.col("p")))
    z = F.sum("e").over(W.partitionBy("pair_id", "t"))
    return e.select("pair_id", "t", "s", (F.col("e") / F.when(z == 0, 1.0).otherwise(z)).alias("p"))


def softmax_shift(rows: DataFrame, bonus: Column) -> DataFrame:
    """Add ``bonus`` in log space and renormalise each word's row."""
    w = W.partitionBy("pair_id", "t")
    v = rows.withColumn("v", F.log(F.greatest("p", F.lit(1e-12))) + bonus)
    e = v.withColumn("e", F.exp(F.col("v") - F.max("v").over(w)))
    return e.select("pair_id", "t", "s", (F.col("e") / F.sum("e").over(w)).alias("p"))


def with_forms(rows: DataFrame, rwords: DataFrame, swords: DataFrame) -> DataFrame:
    """Rows with the normalised form of both words (the source's NULL at the null)."""
    r = rwords.select("pair_id", "t", F.col("norm").alias("rn"))
    s = swords.select("pair_id", "s", F.col("norm").alias("sn"))
    return rows.join(r, ["pair_id", "t"]).join(s, ["pair_id", "s"], "left")


def identity_bonus(rows: DataFrame, rwords: DataFrame, swords: DataFrame, w: float) -> DataFrame:
    full = with_forms(rows, rwords, swords)
    return softmax_shift(full, F.when(F.col("sn") == F.col("rn"), w).otherwise(0.0))


def lemma_rerank(rows: DataFrame, sims: DataFrame, *, weight: float, top_k: int, logit: bool) -> DataFrame:
    """Lift the ``top_k`` real cells of a word by ``weight`` times lemma similarity (pair_id, t, s, sim).

    Linear adds to p and renormalises; logit adds to log p. Unknown similarity lifts nothing.
    """
    real = W.partitionBy("pair_id", "t", F.col("s") >= 0).orderBy(F.desc("p"), "s")
    ranked = rows.select("pair_id", "t", "s", "p", F.row_number().over(real).alias("k")).join(
        sims.select("pair_id", "t", "s", "sim"), ["pair_id", "t", "s"], "left"
    )
    bonus = F.when((F.col("s") >= 0) & (F.col("k") <= top_k), weight * F.coalesce("sim", F.lit(0.0))).otherwise(0.0)
    if logit:
        return softmax_shift(ranked, bonus)
    e = ranked.withColumn("e", F.col("p") + bonus)
    z = F.sum("e").over(W.partitionBy("pair_id", "t"))
    return e.select("pair_id", "t", "s", (F.col("e") / F.when(z == 0, 1.0).otherwise(z)).alias("p"))


def rater_bonus(rows: DataFrame, links: DataFrame, beta: float) -> DataFrame:
    hit = links.select("pair_id", "t", "s", F.lit(beta).alias("b"))
    return rows.join(hit, ["pair_id", "t", "s"], "left").select(
        "pair_id", "t", "s", (F.col("p") + F.coalesce("b", F.lit(0.0))).alias("p")
    )


# ---- fragments -------------------------------------------------------------------------------------


def fragments(links: DataFrame, *, gap: int = 3) -> DataFrame:
    """Runs of linked words whose sources step by -1 .. gap + 1: (pair_id, blk, t0, t1, s_lo, s_hi)."""
    w = W.partitionBy("pair_id").orderBy("t")
    step = F.col("s") - F.lag("s").over(w)
    starts = links.withColumn("new", F.when(step.between(-1, gap + 1), 0).otherwise(1))
    return (
        starts.withColumn("blk", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("pair_id", "blk")
        .agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("s").alias("s_lo"), F.max("s").alias("s_hi"))
    )


def residual_regions(links: DataFrame, words: DataFrame, *, gap: int = 3) -> DataFrame:
    """(pair_id, t, lo, hi): where an unlinked word's source may lie, given the fragments around it."""
    blocks = fragments(links, gap=gap)
    per = blocks.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("t0", "t1", "s_lo", "s_hi"))).alias("b"))
    free = words.select("pair_id", "n_s", "t").join(links.select("pair_id", "t"), ["pair_id", "t"], "left_anti").join(per, "pair_id")
    t = F.col("t")
    inside = F.get(F.filter("b", lambda x: (x["t0"] < t) & (t < x["t1"])), F.lit(0))
    left = F.element_at(F.filter("b", lambda x: x["t1"] < t), -1)
    left = F.when(F.size(F.filter("b", lambda x: x["t1"] < t)) > 0, left)
    right = F.get(F.filter("b", lambda x: x["t0"] > t), F.lit(0))
    x = free.withColumn("i", inside).withColumn("l", left).withColumn("r", right)
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    ahead, behind = F.col("l.s_hi") < F.col("r.s_lo"), F.col("r.s_hi") < F.col("l.s_lo")
    lo = (
        F.when(F.col("i").isNotNull(), F.col("i.s_lo"))
        .when(both & ahead, F.col("l.s_hi") + 1).when(both & behind, F.col("r.s_hi") + 1).when(both, None)
        .when(F.col("l").isNotNull(), F.col("l.s_hi") + 1).when(F.col("r").isNotNull(), F.lit(0))
    )
    hi = (
        F.when(F.col("i").isNotNull(), F.col("i.s_hi"))
        .when(both & ahead, F.col("r.s_lo") - 1).when(both & behind, F.col("l.s_lo") - 1).when(both, None)
        .when(F.col("l").isNotNull(), F.col("n_s") - 1).when(F.col("r").isNotNull(), F.col("r.s_lo") - 1)
    )
    return x.select("pair_id", "t", lo.cast("int").alias("lo"), hi.cast("int").alias("hi")).filter("lo is not null")


def fragment_decode(fwd: DataFrame, rev: DataFrame, words: DataFrame, *, theta: float, scale: float = 0.5, gap: int = 3) -> DataFrame:
    """The default decode, then unlinked words may take unused sources of their region at a lower threshold."""
    # both lie by pair, as the rows given do: what follows moves nothing but the solver's links
    rows = cut(average(fwd, rev), laid=True)
    links = cut(hungarian(with_threshold(rows, theta)).repartition(rows.rdd.getNumPartitions(), "pair_id"), laid=True)
    low = theta * scale
    regions = residual_regions(links, words, gap=gap)
    cands = rows.filter((F.col("s") >= 0) & (F.col("p") >= low)).join(regions, ["pair_id", "t"]).filter(
        F.col("s").between(F.col("lo"), F.col("hi"))
    ).join(links.select("pair_id", "s"), ["pair_id", "s"], "left_anti").select("pair_id", "t", "s", "p")
    null = cands.select("pair_id", "t").distinct().select("pair_id", "t", F.lit(-1).alias("s"), F.lit(low).alias("p"))
    return links.unionByName(hungarian(cands.unionByName(null)))


def split_repair(links: DataFrame, rows: DataFrame, rwords: DataFrame, swords: DataFrame, theta: float) -> DataFrame:
    """Links an unlinked word gains: its best source is held by the adjacent word and both words spell it."""
    best = best_cell(rows.filter("s >= 0"), "t", "s", larger_index=True).filter(F.col("p") >= theta)
    free = best.join(links.select("pair_id", "t"), ["pair_id", "t"], "left_anti")
    # a source held twice counts as held by its last word
    holder = links.groupBy("pair_id", "s").agg(F.max("t").alias("h"))
    near = free.join(holder, ["pair_id", "s"]).filter(F.abs(F.col("h") - F.col("t")) == 1)
    r = rwords.select("pair_id", "t", "norm")
    full = (
        near.join(r.withColumnRenamed("norm", "nt"), ["pair_id", "t"])
        .join(r.select("pair_id", F.col("t").alias("h"), F.col("norm").alias("nh")), ["pair_id", "h"])
        .join(swords.select("pair_id", "s", F.col("norm").alias("ns")), ["pair_id", "s"])
        .withColumn("both", F.when(F.col("t") < F.col("h"), F.concat("nt", "nh")).otherwise(F.concat("nh", "nt")))
    )
    ok = (F.col("both") != "") & (
        F.startswith(F.col("ns"), F.col("both")) | F.startswith(F.col("both"), F.col("ns"))
    )
    return full.filter(ok).select("pair_id", "t", "s")


# ---- tuning ----------------------------------------------------------------------------------------


def tune_theta(rows: DataFrame, words: DataFrame, gold: DataFrame, grid: list[float]) -> DataFrame:
    """Token accuracy and link F1 per threshold, with the winner of each (ties to the larger threshold).

    One decode serves the whole grid: a word's best cell is found once and compared with each value.
    """
    best = best_cell(rows.filter("s >= 0"), "t", "s", larger_index=True)
    g = gold.select("pair_id", "t", F.col("s").alias("g"))
    per_word = words.select("pair_id", "t").join(best, ["pair_id", "t"], "left").join(g, ["pair_id", "t"], "left").select(
        F.coalesce("s", F.lit(-1)).alias("s"), F.coalesce("p", F.lit(-1.0)).alias("p"), F.coalesce("g", F.lit(-1)).alias("g")
    )
    thetas = F.explode(F.array(*[F.lit(x) for x in grid]))
    # words with equal (s = g, linked, gold) flags and p fall together before the grid is applied
    flat = per_word.groupBy(
        "p", (F.col("s") == F.col("g")).alias("hit"), (F.col("g") < 0).alias("gnone")
    ).agg(F.count("*").alias("n"))
    linked = F.col("p") >= F.col("theta")
    scores = flat.select("p", "hit", "gnone", "n", thetas.alias("theta")).groupBy("theta").agg(
        F.sum(F.when(linked & F.col("hit") & ~F.col("gnone"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(linked, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(~F.col("gnone"), F.col("n")).otherwise(0)).alias("g"),
        F.sum(F.when((linked & F.col("hit") & ~F.col("gnone")) | (~linked & F.col("gnone")), F.col("n")).otherwise(0)).alias("right"),
        F.sum("n").alias("total"),
    )
    scored = scores.select(
        "theta", (F.col("right") / F.col("total")).alias("token_accuracy"),
        F.coalesce(2 * F.col("tp") / F.when(F.col("a") + F.col("g") > 0, F.col("a") + F.col("g")), F.lit(0.0)).alias("link_f1"),
    )
    # one row per grid value
    every = W.partitionBy()
    return scored.withColumn("best_accuracy", F.max_by("theta", F.struct("token_accuracy", "theta")).over(every)).withColumn(
        "best_f1", F.max_by("theta", F.struct("link_f1", "theta")).over(every)
    )


def itermax(cells: DataFrame, *, n_max: int = 2, alpha: float = 0.9) -> DataFrame:
    """Mutual best links, repeated; a cell with one aligned side is faded by ``alpha``, with two it is zero.

    ``cells`` is (pair_id, t, s, v). Ties go to the smaller index."""
    pairs = None
    for _ in range(n_max):
        v = cells
        if pairs is not None:
            rows = pairs.select("pair_id", "t").distinct().withColumn("ra", F.lit(1))
            cols = pairs.select("pair_id", "s").distinct().withColumn("ca", F.lit(1))
            v = cells.join(rows, ["pair_id", "t"], "left").join(cols, ["pair_id", "s"], "left").withColumn(
                "v",
                F.when(F.col("ra").isNotNull() & F.col("ca").isNotNull(), 0.0)
                .when(F.col("ra").isNotNull() | F.col("ca").isNotNull(), F.col("v") * alpha)
                .otherwise(F.col("v")),
            )
        a = W.partitionBy("pair_id", "t").orderBy(F.desc("v"), "s")
        b = W.partitionBy("pair_id", "s").orderBy(F.desc("v"), "t")
        now = v.withColumn("ka", F.row_number().over(a)).withColumn("kb", F.row_number().over(b)).filter(
            "ka = 1 and kb = 1 and v > 0"
        ).select("pair_id", "t", "s")
        pairs = now if pairs is None else pairs.unionByName(now).distinct()
    return pairs


def sinkhorn(rows: DataFrame, pairs: DataFrame, *, iters: int = 10) -> DataFrame:
    """Balance a pair's score rows: log-domain row and column normalisation with a null bin per side. A pair is one
    Arrow row, so the rounds move and write nothing."""
    from palimpsest.operators.kernels import sinkhorn_batches

    def run(batches):
        yield from sinkhorn_batches(batches, iters)

    per = rows.groupBy("pair_id").agg(F.collect_list(F.struct("t", "s", "p")).alias("c"))
    per = pairs.select("pair_id", "n_s", "n_r").join(per, "pair_id")
    return per.select("pair_id", "n_s", "n_r", "c").mapInArrow(run, "pair_id string, t int, s int, p double")


def ensemble(a: DataFrame, b: DataFrame, rater: DataFrame, *, weight: float = 0.5, beta: float = 0.0, top: int = 6) -> DataFrame:
    """Weighted sum of two row sets, a bonus on the rater's cell, the best ``top`` kept, the null always."""
    x = a.select("pair_id", "t", "s", (F.col("p") * weight).alias("p"))
    y = b.select("pair_id", "t", "s", (F.col("p") * (1.0 - weight)).alias("p"))
    z = rater.select("pair_id", "t", "s", F.lit(beta).alias("p"))
    total = x.unionByName(y).unionByName(z).groupBy("pair_id", "t", "s").agg(F.sum("p").alias("p"))
    w = W.partitionBy("pair_id", "t").orderBy(F.desc(F.round("p", 9)), "s")
    return total.withColumn("k", F.row_number().over(w)).filter((F.col("k") <= top) | (F.col("s") < 0)).select(
        "pair_id", "t", "s", F.round("p", 6).alias("p")
    )


def agreed_edges(fwd: DataFrame, rev: DataFrame, rwords: DataFrame, swords: DataFrame, *, tau: float, tau_changed: float | None = None) -> DataFrame:
    """Edges both directions decode to each other, with mean p of at least ``tau``."""
    f = head(fwd, "t", "s").filter("s >= 0")
    r = head(rev, "s", "t").filter("t >= 0").withColumnRenamed("p", "pr")
    both = with_forms(f.join(r, ["pair_id", "t", "s"]), rwords, swords)
    p = (F.col("p") + F.col("pr")) * 0.5
    changed = F.col("sn") != F.col("rn")
    limit = F.lit(tau) if tau_changed is None else F.when(changed, tau_changed).otherwise(tau)
    return both.filter(p >= limit).select("pair_id", "t", "s", p.alias("p"), changed.alias("changed"))


def framed_edges(edges: DataFrame, *, window: int = 2, slack: int = 3, min_links: int = 3) -> DataFrame:
    """A changed-form edge needs ``min_links`` edges in its pair and one supporting edge nearby in order."""
    n = edges.withColumn("n", F.count("*").over(W.partitionBy("pair_id")))
    steps = F.array(*[F.lit(d) for d in range(-window, window + 1) if d])
    near = edges.select("pair_id", F.col("t").alias("ot"), F.col("s").alias("os"), F.explode(steps).alias("d")).select(
        "pair_id", "ot", "os", (F.col("ot") - F.col("d")).alias("t")
    )
    dt, ds = F.col("ot") - F.col("t"), F.col("os") - F.col("s")
    backed = edges.select("pair_id", "t", "s").join(near, ["pair_id", "t"]).filter(
        (ds != 0) & ((ds > 0) == (dt > 0)) & (F.abs(ds - dt) <= slack)
    ).select("pair_id", "t", "s").distinct().withColumn("backed", F.lit(True))
    return n.join(backed, ["pair_id", "t", "s"], "left").filter(
        ~F.col("changed") | ((F.col("n") >= min_links) & F.col("backed").isNotNull())
    ).drop("n", "backed")
