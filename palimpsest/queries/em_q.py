"""Fitted and staged aligners, self-training (A27-A43 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import align as al
from palimpsest.operators import em
from palimpsest.operators import evidence as ev
from palimpsest.operators import script as sc
from palimpsest.operators import staged as st
from palimpsest.operators import typing_ as ty
from palimpsest.plans.base import Inputs
from palimpsest.plans.lineage import cut
from palimpsest.queries import sqlkit as k
from palimpsest.queries.registry import query

_U = lambda n, w: f"case when {n}<>'' then {n} else lower({w}) end"
k.cte("em_cells", f"""select pair_id, n_s, n_r, t, s, {_U('sn','sw')} as ws, {_U('rn','rw')} as wt from grid
   union all select pair_id, n_s, n_r, t, -1, '<null>', {_U('norm','word')} from rwords""")
k.cte("em_cells_rev", f"""select pair_id, n_r as n_s, n_s as n_r, s as t, t as s, {_U('rn','rw')} as ws, {_U('sn','sw')} as wt from grid
   union all select pair_id, n_r, n_s, s, -1, '<null>', {_U('norm','word')} from swords""")
_L = lambda n, w: f"coalesce({k.lemma(n)}, {_U(n, w)})"
k.cte("em_cells_lem", f"""select pair_id, n_s, n_r, t, s, {_L('sn','sw')} as ws, {_L('rn','rw')} as wt from grid
   union all select pair_id, n_s, n_r, t, -1, '<null>', {_L('norm','word')} from rwords""")
STOP = ("the", "of", "and", "to", "in", "a", "is", "de", "la", "der", "que", "le")


def _cells(b: Inputs):
    if not hasattr(b, "_em_cells"):
        b._em_cells = cut(em.em_cells(b.grid, b.rwords), laid=True)
    return b._em_cells


def _fit(b: Inputs):
    """The fit over coded pairs; None where it goes cell by cell."""
    if not hasattr(b, "_em_fit"):
        b._em_fit = em.fitted(em.unit_arrays(b.pairs), iterations=5)
    return b._em_fit


def _lexical(b: Inputs, n: int = 5):
    if not hasattr(b, "_em_theta"):
        fit = _fit(b)
        b._em_theta = (fit.theta(), fit.history) if fit else em.fit_lexical(_cells(b), iterations=n)
    return b._em_theta


def _em_sql(n: int, tail: str) -> str:
    parts = ["th0 as materialized (select ws, wt, 1.0::DOUBLE/count(*) over (partition by ws) as theta from (select distinct ws, wt from em_cells) a)"]
    for i in range(n):
        parts.append(f"po{i} as materialized (select c.*, theta, sum(theta) over (partition by pair_id, t) as z from em_cells c join th{i} using(ws, wt))")
        parts.append(f"th{i+1} as materialized (select ws, wt, c/sum(c) over (partition by ws) as theta from (select ws, wt, sum(theta/z) as c from po{i} group by 1,2) a)")
    return "with " + ",\n".join(parts) + "\n" + tail


@query("A27_lexical_em_best", _em_sql(5, "select ws, wt, round(theta,6) as theta from (select *, row_number() over (partition by ws order by round(theta,9) desc, wt) as k from th5) z where k=1"))
def lexical_best(b: Inputs):
    theta, _ = _lexical(b)
    best = theta.groupBy("ws").agg(F.min_by(F.struct("wt", "theta"), F.struct((-F.round("theta", 9)).alias("a"), F.col("wt"))).alias("v"))
    return best.select("ws", "v.wt", F.round("v.theta", 6).alias("theta"))


@query("A27_lexical_em_likelihood", _em_sql(5, " union all ".join(
    f"select {i+1} as iteration, round(sum(ln(z)-ln(n_s+1)),3) as log_likelihood from po{i} where s=-1" for i in range(5))))
def likelihood(b: Inputs):
    _, history = _lexical(b)
    rows = b.pairs.limit(1).select(F.posexplode(F.array(*[F.lit(x) for x in history])).alias("i", "ll"))
    return rows.select((F.col("i") + 1).alias("iteration"), F.round("ll", 3).alias("log_likelihood"))


@query("A28_diagonal_em")
def diagonal(b: Inputs):
    fit = em.fitted(em.unit_arrays(b.pairs), iterations=3, prior=True)
    if fit:
        return fit.heads().withColumn("tension", F.lit(fit.tensions[-1]))
    theta, tensions = em.fit_diagonal(_cells(b), iterations=3)
    return em.predict_heads(_cells(b), theta, em.diagonal_prior(tensions[-1])).withColumn("tension", F.lit(tensions[-1]))


@query("A29_hmm_em")
def hmm(b: Inputs):
    theta, jump, _ = em.fit_hmm(_cells(b), _lexical(b)[0], iterations=2)
    best = theta.groupBy("ws").agg(F.max_by(F.struct("wt", "theta"), F.struct("theta", "wt")).alias("v"))
    return best.select("ws", "v.wt", "v.theta").withColumn("jump_one", F.lit(jump[11] / sum(jump)))


_PR = "case when s<0 then 1073741824 else s end"


@query("A30_em_predict", _em_sql(5, f"""select pair_id, t, s, round(p,6) as p from (select *, row_number() over (partition by pair_id, t order by round(p,9) desc, {_PR}) as k from (
   select pair_id, t, s, theta/sum(theta) over (partition by pair_id, t) as p from em_cells join th5 using(ws, wt)) a) z where k=1"""))
def predict(b: Inputs):
    fit = _fit(b)
    heads = fit.heads() if fit else em.predict_heads(_cells(b), _lexical(b)[0])
    return heads.withColumn("p", F.round("p", 6))


_HEADS = _em_sql(5, f"""select pair_id, t, s, round(p,6) as p from (select *, row_number() over (partition by pair_id, t order by round(p,9) desc, {_PR}) as k from (
   select pair_id, t, s, theta/sum(theta) over (partition by pair_id, t) as p from em_cells join th5 using(ws, wt)) a) z where k=1""")


@query("A30_em_reverse_heads", _HEADS.replace("em_cells", "em_cells_rev"))
def reverse_heads(b: Inputs):
    """The other direction: which reuse word explains every source word. ``t`` counts source words here."""
    fit = em.fitted(em.unit_arrays(b.pairs, back=True), iterations=5)
    if fit:
        return fit.heads().withColumn("p", F.round("p", 6))
    words = b.swords.select("pair_id", F.col("n_r").alias("n_s"), F.col("n_s").alias("n_r"), F.col("s").alias("t"), "word", "norm")
    cells = cut(em.em_cells(em.turned(b.grid), words), laid=True)
    return em.predict_heads(cells, em.fit_lexical(cells)[0]).withColumn("p", F.round("p", 6))


@query("A30_em_lemma_heads", _HEADS.replace("em_cells", "em_cells_lem"))
def lemma_heads(b: Inputs):
    fit = em.fitted(em.unit_arrays(b.pairs, lemmas=True), iterations=5)
    if fit:
        return fit.heads().withColumn("p", F.round("p", 6))
    cells = cut(em.em_cells(b.grid, b.rwords, lemmas=True), laid=True)
    return em.predict_heads(cells, em.fit_lexical(cells)[0]).withColumn("p", F.round("p", 6))


@query("A30_identity_dictionary", "select w, unnest([1,2]) as copy from (select distinct ws as w from em_cells where s>=0 intersect select distinct wt from em_cells) z")
def identity(b: Inputs):
    return em.identity_dictionary(_cells(b), 2)


# ---- the staged aligner in SQL: every stage folds over its candidates, a row at a time over all pairs at once ---------

_STOPS = ", ".join(k.q(w) for w in STOP)


def _stage(name: str, state: str, cands: str, cond: str, n: str = "1") -> None:
    """Registers ``name`` (pair_id, ss, ts, ll): ``state`` after the candidates (pair_id, i, s, t, ...) that meet ``cond``;
    ``ll`` holds s * 1000 + t."""
    k.cte(f"{name}_c", cands)
    new = lambda x: f"case when ok then list_concat(w.{{l}}, list_transform(range({n}), lambda z: {x})) else w.{{l}} end"
    k.cte(f"{name}_r", f"""select pair_id, 0::BIGINT as i, ss, ts, ll from {state}
     union all select w.pair_id, o.i, {new('(o.s+z)::INT').format(l='ss')}, {new('(o.t+z)::INT').format(l='ts')}, {new('((o.s+z)*1000+o.t+z)::INT').format(l='ll')}
       from {name}_r w join {name}_c o on o.pair_id=w.pair_id and o.i=w.i+1, lateral (select {cond} as ok) l""")
    k.RECURSIVE.add(f"{name}_r")
    k.cte(name, f"select pair_id, ss, ts, ll from (select *, row_number() over (partition by pair_id order by i desc) as k from {name}_r) z where k=1")


_FREE = "not list_contains(w.ss,o.s) and not list_contains(w.ts,o.t)"
_OPEN = "not list_contains(w.ss,x.s) and not list_contains(w.ts,x.t)"
_EMPTY = "[]::INT[]"
k.cte("sg_none", f"select pair_id, {_EMPTY} as ss, {_EMPTY} as ts, {_EMPTY} as ll from pairs")
k.cte("sg_punct", f"""select p.pair_id, coalesce(list(x.s::INT) filter (x.s is not null), {_EMPTY}) as ss, coalesce(list(x.t::INT) filter (x.s is not null), {_EMPTY}) as ts, coalesce(list((x.s*1000+x.t)::INT) filter (x.s is not null), {_EMPTY}) as ll
   from pairs p left join (select a.pair_id, a.s, z.t from (select *, row_number() over (partition by pair_id, word order by s) as k from swords where norm='') a
     join (select *, row_number() over (partition by pair_id, word order by t) as k from rwords where norm='') z on z.pair_id=a.pair_id and z.word=a.word and z.k=a.k) x on x.pair_id=p.pair_id group by 1""")
_RUNS = f"""select pair_id, s, t, n, row_number() over (partition by pair_id order by n desc, s, t) as i from (
   select pair_id, s0+o as s, t0+o as t, n, cs, o from (select *, unnest(range(2, len(cs)-o+1)) as n from (select *, unnest(range(0, len(cs)-1)) as o from (
     select pair_id, d, g, min(s) as s0, min(t) as t0, list(c order by t) as cs from (select pair_id, s, t, t-s as d, t-row_number() over (partition by pair_id, t-s order by t) as g, sn<>'' and sn not in ({_STOPS}) as c from grid where sn=rn) a
     group by 1,2,3) b) c) d) e where list_contains(list_slice(cs, o+1, o+n), true)"""
_CLASH = "len(list_filter(w.ss, lambda x: x>=o.s and x<o.s+o.n))=0 and len(list_filter(w.ts, lambda x: x>=o.t and x<o.t+o.n))=0"
_stage("sg_runs", "sg_punct", _RUNS, _CLASH, "o.n")
_stage("sg_only", "sg_none", _RUNS, _CLASH, "o.n")


def _stages(tag: str, lexical: float, weight: float) -> str:
    """The rest of the stages for one setting; returns the name of the state after all of them."""
    x = f"sg{tag}"
    k.cte(f"{x}_sim", f"""select pair_id, s, t, sn, rn, both_names, same_pos, sim from (select *, case when same_form=1 or same_lemma=1 or enclitic_stem_match=1 then 1.0::DOUBLE when wn_syn=1 or (cos_missing=0 and cos>=0.65 and same_pos=1) then {lexical}::DOUBLE else 0 end as sim
       from evidence where tier>0 or edit_ratio>=0.4 or cos>=0.35) z where sim>0""")
    k.cte(f"{x}_con", f"select pair_id, s, t, sim from {x}_sim where sn<>'' and rn<>'' and sn not in ({_STOPS}) and rn not in ({_STOPS}) and same_pos=1")
    k.cte(f"{x}_ctx", f"""select a.pair_id, a.s, a.t, a.sim, coalesce(sum(z.sim),0.0) as ctx, round({weight}*a.sim+(1-{weight})*coalesce(sum(z.sim),0.0),9) as score from {x}_con a
       left join {x}_con z on z.pair_id=a.pair_id and z.s<>a.s and z.t<>a.t and abs(z.s-a.s)<=3 and abs(z.t-a.t)<=3 group by 1,2,3,4""")
    order = lambda by, source: f"select *, row_number() over (partition by pair_id order by {by}) as i from ({source}) z"
    rivals = lambda source, test: f"select a.*, coalesce((select list(struct_pack(s := z.s, t := z.t)) from ({source}) z where z.pair_id=a.pair_id and {test}), []) as rivals from ({source}) a"
    _stage(f"{x}_names", "sg_runs", order("sim desc, s, t", f"select pair_id, s, t, sim from {x}_sim where both_names=1"), _FREE)
    _stage(f"{x}_near", f"{x}_names", order("score desc, s, t", f"select pair_id, s, t, score from {x}_ctx where ctx>0"), _FREE)
    _stage(f"{x}_alone", f"{x}_near", order("sim desc, s, t", rivals(f"select pair_id, s, t, sim from {x}_ctx where ctx=0", "z.sim>a.sim and (z.s=a.s or z.t=a.t)")),
           f"{_FREE} and len(list_filter(o.rivals, lambda x: {_OPEN}))=0")
    _stage(f"{x}_side", f"{x}_alone", order("s, t", f"select pair_id, s, t from {x}_sim"), f"{_FREE} and (list_contains(w.ll,((o.s-1)*1000+o.t-1)::INT) or list_contains(w.ll,((o.s+1)*1000+o.t+1)::INT))")
    return f"{x}_side"


_LEX, _WGT = (0.7, 0.9), (0.5, 0.9)
_SETTINGS = {(l, w): _stages(f"{i}", l, w) for i, (l, w) in enumerate((l, w) for l in _LEX for w in _WGT)}
_FULL = _SETTINGS[0.9, 0.9]
_BASE = _FULL.removesuffix("_side")
_PAIRS_OF = "select pair_id, unnest(ss) as s, unnest(ts) as t from {0}"
_EX = f"select pair_id, s, t from {_BASE}_sim where (sn='' or sn in ({_STOPS})) and (rn='' or rn in ({_STOPS})) and sim=1.0"
_stage("sg_lone", _FULL, f"select *, row_number() over (partition by pair_id order by s, t) as i from (select a.*, coalesce((select list(struct_pack(s := z.s, t := z.t)) from ({_EX}) z where z.pair_id=a.pair_id and (z.s=a.s)<>(z.t=a.t)), []) as rivals from ({_EX}) a) y",
       f"{_FREE} and len(list_filter(o.rivals, lambda x: {_OPEN}))=0")
_stage("sg_names_only", "sg_none", f"select pair_id, s, t, row_number() over (partition by pair_id order by sim desc, s, t) as i from {_BASE}_sim where both_names=1", _FREE)


@query("A38_dial_grid", "with c as (" + " union all ".join(
    f"select {l}::DOUBLE as lexical, {w}::DOUBLE as weight, count(g.pair_id) as tp, count(*)-count(g.pair_id) as fp from ({_PAIRS_OF.format(n)}) x left join gold g on g.pair_id=x.pair_id and g.s=x.s and g.t=x.t"
    for (l, w), n in _SETTINGS.items()) + """), n as (select count(*) as n from gold), f as (select c.*, n-tp as fn, round(2.0*tp/(tp+fp+n),6)::DOUBLE as f1 from c, n)
   select *, row_number() over (order by f1 desc, lexical, weight)=1 as best from f""")
def grid_of_dials(b: Inputs):
    return st.dial_grid(b.rwords, b.swords, b.grid, b.evid, STOP, b.gold, _LEX, _WGT)


@query("A37_fallback_links", f"select pair_id, s, t from ({_PAIRS_OF.format('sg_lone')}) a except select pair_id, s, t from ({_PAIRS_OF.format(_FULL)}) z")
def fallback_links(b: Inputs):
    """What the stop-word fallback adds to the stages before it."""
    sims = st.similar_cells(b.evid)
    state = cut(st.by_neighbours(st.in_context(st.named(st.opening(b.rwords, b.swords, b.grid, STOP), sims), sims, STOP), sims))
    stop = lambda c: (F.col(c) == "") | F.col(c).isin(*STOP)
    more = st.lone_matches(state, sims.filter(stop("sn") & stop("rn") & (F.col("sim") == 1.0))).select("pair_id", F.inline("links"))
    return more.join(state.select("pair_id", F.inline("links")), ["pair_id", "s", "t"], "left_anti")


@query("A31_similarity_classes", """select sim, count(*) as n from (select case when same_form=1 or same_lemma=1 or enclitic_stem_match=1 then 1.0 when wn_syn=1 or (cos_missing=0 and cos>=0.65 and same_pos=1) then 0.9 else 0 end::DOUBLE as sim from evidence
   join (select pair_id, t, s from cells) c using(pair_id, t, s)) z group by 1""")
def classes(b: Inputs):
    return b.cell_evidence.groupBy(st.word_similarity().alias("sim")).agg(F.count("*").alias("n"))


@query("A32_identical_runs", _PAIRS_OF.format("sg_only"))
def runs(b: Inputs):
    state = st._with(b.pairs.select("pair_id"), b.pairs.limit(0).select("pair_id", F.array().cast(st.LINKS).alias("links")))
    return st.identical_runs(state, b.grid, STOP).select("pair_id", F.inline("links"))


@query("A33_punctuation", """select a.pair_id, a.s, z.t from (select *, row_number() over (partition by pair_id, word order by s) as k from swords where norm='') a
   join (select *, row_number() over (partition by pair_id, word order by t) as k from rwords where norm='') z on z.pair_id=a.pair_id and z.word=a.word and z.k=a.k""")
def punctuation(b: Inputs):
    return st.punctuation(b.rwords, b.swords)


@query("A34_name_alignment", _PAIRS_OF.format("sg_names_only"))
def names(b: Inputs):
    sims = b.evid.withColumn("sim", st.word_similarity()).filter("sim > 0 and both_names = 1")
    state = b.pairs.select("pair_id", F.array().cast(st.LINKS).alias("links"))
    return st.best_first(state, sims, F.col("sim")).select("pair_id", F.inline("links"))


@query("A35_context_scores", f"select pair_id, s, t, score, round(ctx,6) as ctx from {_BASE}_ctx")
def context(b: Inputs):
    sims = b.evid.withColumn("sim", st.word_similarity()).filter("sim > 0")
    content = sims.filter((F.col("sn") != "") & ~F.col("sn").isin(*STOP) & ~F.col("rn").isin(*STOP) & (F.col("same_pos") == 1))
    return st.context_scores(sims, content.select("pair_id", "s", "t", "sim")).select("pair_id", "s", "t", "score", F.round("ctx", 6).alias("ctx"))


@query("A37_stop_words_by_neighbours", _PAIRS_OF.format("sg_lone"))
def neighbours(b: Inputs):
    return st.align(b.rwords, b.swords, b.grid, b.evid, STOP, fallback=True)


@query("A38_staged_aligner", _PAIRS_OF.format(_FULL))
def staged(b: Inputs):
    return st.align(b.rwords, b.swords, b.grid, b.evid, STOP)


@query("A40_stored_rows_redecoded")
def stored(b: Inputs):
    return _redecoded(b)[1].select("pair_id", "t", "s", "tag")


def _redecoded(b: Inputs):
    """The rows of the stored predictions, decoded anew, and the links with their types; no link is left without one."""
    if not hasattr(b, "_redecoded"):
        rows = cut(al.with_threshold(al.ensemble(b.fwd, ev.resource_rows(b.tiers, b.rwords), b.gold, beta=0.1), 0.3))
        links = cut(al.hungarian(rows))
        b._redecoded = rows, cut(ty.rule_type(links, b.evidence_of(links))), links
    return b._redecoded


@query("A40_links_lost", "select 0::BIGINT as lost")
def links_lost(b: Inputs):
    _, typed, links = _redecoded(b)
    return links.join(typed.select("pair_id", "t", "s"), ["pair_id", "t", "s"], "left_anti").agg(F.count("*").alias("lost"))


@query("A43_self_training_edges")
def self_training(b: Inputs):
    # edges, words and script are each read several times: written once, where their pair lies
    agreed = cut(al.agreed_edges(b.fwd, b.rev, b.rwords, b.swords, tau=0.5, tau_changed=0.3), laid=True)
    edges = cut(al.framed_edges(agreed), laid=True)
    typed = ty.rule_type(edges, b.evidence_of(edges)).select("pair_id", "t", "s", "tag")
    words = b.rwords.join(edges.select("pair_id", "t", "s"), ["pair_id", "t"], "left").select(
        "pair_id", "n_s", "n_r", "t", "word", "norm", F.coalesce("s", F.lit(-1)).alias("s"), F.when(F.col("s").isNull(), "INS").otherwise("SUBST").alias("tag"), F.lit(0).alias("frame"))
    script = cut(sc.decode_script(cut(words, laid=True), b.swords), laid=True)
    ok = sc.replays(script, b.pairs).filter("ok")
    tag = F.when(F.col("tag").isin("COPY", "MORPH"), F.col("tag")).otherwise("SUBST")
    return typed.join(ok.select("pair_id"), "pair_id", "left_semi").select("pair_id", "t", "s", tag.alias("op"), F.lit("self-training").alias("links"))
