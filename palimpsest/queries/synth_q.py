"""Synthetic pairs, resampling and relabelling (N rows, M10, M11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import align as al
from palimpsest.operators import lexicon as lx
from palimpsest.operators import mining as mn
from palimpsest.operators import synth as sy
from palimpsest.plans.base import Inputs
from palimpsest.plans.lineage import cut
from palimpsest.queries import score_q, script_q, sqlkit as k
from palimpsest.queries.registry import query

_LEM = k.lemma("norm")
#: Nearest vector rows a lemma's row leads to, and the cosine they need.
NEAREST, LEAST_COSINE = 2, 0.3
k.cte("sub_forms", f"select distinct {_LEM} as lemma, norm as form from all_tok where norm in (select norm from attested) and {_LEM} is not null")
k.cte("sub_hops", f"""select distinct a.lemma, z.other from (select lemma, other, row_number() over (partition by lemma order by other) as r from (select distinct lemma, other from lex where relation='hypernyms') x) a
   join (select distinct lemma, other from lex where relation='hyponyms') z on z.lemma=a.other where a.r<={sy.HYPERNYMS} and z.other<>a.lemma
   and z.lemma in (select lemma from lex where relation='hyponyms' group by 1 having count(distinct other)<=24)""")
k.cte("sub_rows", f"select lemma, {k.bucket('(select greatest(1, count(*)*11//10) from embeddings)', 'lemma')} as vid from (select distinct {_LEM} as lemma from all_tok) z where lemma is not null")
k.cte("sub_near", f"""select a.lemma, z.lemma as other from sub_rows a join (select a, b from (select x.vec_id as a, y.vec_id as b, row_number() over (partition by x.vec_id order by c desc, y.vec_id desc) as r from (
     select p.vec_id as pid_, q.vec_id as qid_, list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) as c from embeddings p join embeddings q on p.vec_id<>q.vec_id) w
     join embeddings x on x.vec_id=w.pid_ join embeddings y on y.vec_id=w.qid_ where c>={LEAST_COSINE}) v where r<={NEAREST}) n on n.a=a.vid join sub_rows z on z.vid=n.b""")
k.cte("sub_names", f"""select norm, {_LEM} as lemma, row_number() over (order by md5('name|'||norm)) as rn, count(*) over () as n from (select distinct {k.norm('form')} as norm from names) z where norm in (select norm from attested)""")
k.cte("sub_options", """select l.lemma, case l.relation when 'synonyms' then 'SYN' when 'hypernyms' then 'HYPER' when 'hyponyms' then 'HYPO' when 'antonyms' then 'ANT' else 'POS' end as tag, 'lexicon' as route, 0 as ord, f.form from lex l join sub_forms f on f.lemma=l.other
   union all select lemma, 'MORPH', 'form', 0, max(form) from sub_forms group by lemma having count(*)>1
   union all select h.lemma, 'SYN-DIST', 'co-hyponym', 0, f.form from sub_hops h join sub_forms f on f.lemma=h.other
   union all select v.lemma, 'SYN-DIST', 'vector', 1, f.form from sub_near v join sub_forms f on f.lemma=v.other
   union all select a.lemma, 'NE-SUB', 'name', 0, z.norm from sub_names a join sub_names z on z.rn=a.rn%a.n+1 where a.lemma is not null and z.norm<>a.norm""")
k.cte("subs", """select lemma, tag, route, n_options, form from (select *, row_number() over (partition by lemma, tag order by ord) as r from (
   select lemma, tag, route, ord, count(*) as n_options, min_by(form, md5('4|'||lemma||'|'||tag||'|'||form)) as form from (select distinct * from sub_options) z group by 1,2,3,4) y) x where r=1""")


def _options(b: Inputs):
    if not hasattr(b, "_sub_options"):
        vocab = b.norms.select("norm").withColumn("lemma", tx.lemma_standin(F.col("norm"))).filter("lemma is not null")
        emb = b.table("embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("pos"), F.col("embedding").alias("vec"))
        n = b.table("embeddings").count()
        rows = cut(vocab.select("lemma").distinct().withColumn("vid", tx.bucket_draw(max(1, n * 11 // 10), F.col("lemma")).cast("long")))
        asked = rows.select(F.col("vid").alias("id")).distinct()
        near = lx.vector_neighbours(emb, threshold=LEAST_COSINE, top=NEAREST, asked=asked).select("a", "b")
        close = rows.withColumnRenamed("vid", "a").join(near, "a").join(rows.select(F.col("lemma").alias("other"), F.col("vid").alias("b")), "b").select("lemma", "other")
        names = b.names.select(tx.normalize(F.col("form")).alias("norm"))
        b._sub_options = cut(sy.substitution_options(vocab, b.lexicon, b.attested, close, names))
    return b._sub_options


def _subs(b: Inputs):
    if not hasattr(b, "_subs_table"):
        b._subs_table = cut(sy.substitution_routes(_options(b)))
    return b._subs_table


_B = lambda n, e: k.bucket(n, e)
_WTS = ", ".join(f"({o}, '{t}', {w}, {t in sy.STRUCTURAL})" for o, (t, w) in enumerate(sy.WEIGHTS.items()))
k.cte("wts", f"""with a as (select * from (values {_WTS}) z(o, tag, w, st)), kept as (select * from a where st or tag in (select tag from subs)),
   c as (select *, case when st then w else w*(select sum(w) from a where not st)/(select sum(w) from kept where not st) end as w2 from kept),
   d as (select o, tag, w2/(select sum(w2) from c) as weight from c), e as (select *, sum(weight) over (order by o) as hi, row_number() over (order by o desc) as last from d)
   select tag, weight, hi-weight as lo, case when last=1 then 2 else hi end as hi from e""")
k.cte("edits", f"""with w as (select pid, v, i, word, {_B(5, "'42|'||pid||'|'||v||'|k'")}+1 as kk, row_number() over (partition by pid, v order by md5('42|'||pid||'|'||v||'|'||i)) as r, {k.udraw("'42|'||pid||'|'||v||'|'||i||'|tag'")} as kind, p.toks[1+floor({k.udraw("'42|'||pid||'|'||v||'|'||i||'|ins'")}*len(p.toks))::INT] as ins
     from (select pid, surface as word, i, unnest([1,2,3,4]) as v from all_tok where side='s') a join (select pid, toks from src_p) p using(pid)),
   y as (select *, case when r<=kk then wts.tag end as want, {k.norm('word')} as norm from w join wts on kind>=lo and kind<hi)
   select pid, v, i::INT as i, word, case when want in ('DEL','INS') then want when s.form is not null and s.form<>y.norm then want else 'NOP' end as tag, s.form, case when want='INS' then ins end as ins from y left join subs s on s.lemma={_LEM} and s.tag=y.want""")


def _edits(b: Inputs):
    return sy.generate(b.src.select("pid", "toks"), _subs(b), _weights(b))


def _weights(b: Inputs) -> dict[str, float]:
    have = {r["tag"] for r in _subs(b).select("tag").distinct().collect()}  # a handful of relation tags
    return sy.usable_weights(sy.WEIGHTS, have)


@query("N1_script_first_edits", "select pid, v, i, tag, case when tag in ('NOP','INS') then word when tag='DEL' then null else form end as new, ins from edits")
def edits(b: Inputs):
    return _edits(b).select("pid", "v", "i", "tag", "new", "ins")


@query("N1_yield_report", "select tag, count(*) as n from edits group by 1")
def yield_report(b: Inputs):
    return _edits(b).groupBy("tag").agg(F.count("*").alias("n"))


@query("N2_usable_weights", "select tag, n, round(weight,6)::DOUBLE as weight from (select tag, count(*) as n from edits group by 1) e left join wts using(tag)")
def weights(b: Inputs):
    w = F.create_map(*[F.lit(x) for kv in _weights(b).items() for x in kv])
    return _edits(b).groupBy("tag").agg(F.count("*").alias("n")).withColumn("weight", F.round(F.try_element_at(w, F.col("tag")), 6))


@query("N4_variant_words", """with x as (select *, (sum(w) over (partition by pid, v order by i rows unbounded preceding)-w)::INT as t from (select *, case tag when 'DEL' then 0 when 'INS' then 2 else 1 end as w from edits) z)
   select pid, v, t, case when tag in ('NOP','INS') then word else form end as word from x where tag<>'DEL' union all select pid, v, t+1, ins from x where tag='INS'""")
def variant_words(b: Inputs):
    return sy.variant_words(sy.apply_edits(_edits(b)))


@query("N3_cheaper_script")
def cheaper(b: Inputs):
    from palimpsest.functions import labels as lb

    plan = script_q._plan(b).groupBy("pair_id").agg(F.sum(lb.lookup("cost", F.col("tag"))).alias("planned"))
    have = b.script.groupBy("pair_id").agg(F.sum(lb.lookup("cost", F.col("tag"))).alias("given"))
    return plan.join(have, "pair_id").select("pair_id", F.least("planned", "given").alias("cost"), (F.col("planned") < F.col("given")).alias("replanned"))


@query("N4_applied_edits", """select pid, v, i, tag, (sum(w) over (partition by pid, v order by i rows unbounded preceding)-w)::INT as t from (select *, case tag when 'DEL' then 0 when 'INS' then 2 else 1 end as w from edits) z""")
def applied(b: Inputs):
    return sy.apply_edits(_edits(b)).select("pid", "v", "i", "tag", "t")


@query("N4_variants_replay", "select pid, v, true as ok, sum(case tag when 'DEL' then 0 when 'INS' then 2 else 1 end)::BIGINT as n_t from edits group by 1,2 having sum(case tag when 'DEL' then 0 when 'INS' then 2 else 1 end)>0")
def replay(b: Inputs):
    return sy.variants_replay(sy.apply_edits(_edits(b)))


@query("N7_substitution_lookup", "select lemma, tag, form from subs")
def lookup(b: Inputs):
    return _subs(b).select("lemma", "tag", "form")


@query("N7_substitution_routes", "select lemma, tag, route, n_options from subs")
def routes(b: Inputs):
    return _subs(b).select("lemma", "tag", "route", "n_options")


@query("N7_substitution_options", "select distinct lemma, tag, route, form from sub_options")
def every_option(b: Inputs):
    return _options(b).select("lemma", "tag", "route", "form").distinct()


@query("N9_acceptance", f"""select round(c,6) as coverage, round(case when c>0 then least(1.0, 0.228::DOUBLE/c) else 1.0 end,6) as accept from (select avg(({_LEM} in (select lemma from subs))::INT) as c from (
   select norm from all_tok where side='r' order by md5('11|'||pid||'|'||i) limit 3000) z where true) y""".replace(f"avg(({_LEM} in (select lemma from subs))::INT)", f"avg(coalesce({_LEM} in (select lemma from subs),false)::INT)"))
def acceptance(b: Inputs):
    return sy.acceptance(b.tokens.filter("side = 'r'").select("pid", "i", "norm"), _subs(b), target=0.228)


@query("N10_frame_pool", """select formula, count(*) as n from (select w.pair_id, string_agg(w.norm,' ' order by w.t) as formula, count(*) as c from words_p w join pairs p using(pair_id) where w.frame=1 and p.fold<>0 group by 1 having count(*) between 1 and 14) z group by 1""")
def frame_pool(b: Inputs):
    x = b.words.filter("frame = 1").join(b.pairs.filter("fold <> 0").select("pair_id"), "pair_id", "left_semi").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("t", "norm"))).alias("w"))
    return x.filter(F.size("w").between(1, 14)).groupBy(F.array_join(F.transform("w", lambda e: e["norm"]), " ").alias("formula")).agg(F.count("*").alias("n"))


@query("N11_pool_selection", """with t as (select pair_id as id, list(distinct tag) as tags, md5('1|'||pair_id) as o from words_p group by 1),
   a as (select id, 'MORPH' as why from t where list_contains(tags,'MORPH') order by o limit 40), z as (select id, 'SUBST' as why from t where list_contains(tags,'SUBST') and id not in (select id from a) order by o limit 40),
   f as (select id, 'fill' as why from t where id not in (select id from a) and id not in (select id from z) order by o limit (150-(select count(*) from a)-(select count(*) from z)))
   select * from a union all select * from z union all select * from f""")
def pool_selection(b: Inputs):
    return sy.select_pool(b.words.groupBy(F.col("pair_id").alias("id")).agg(F.collect_set("tag").alias("tags")), 150, ("MORPH", "SUBST"), rare_min=40)


@query("N12_synthetic_records")
def records(b: Inputs):
    placed = sy.apply_edits(cut(_edits(b)))
    ok = sy.variants_replay(placed).filter("ok")
    held = b.pairs.filter("fold = 0").select(F.col("s_pid").alias("pid")).distinct()
    links = placed.filter("tag <> 'DEL'").join(ok.select("pid", "v"), ["pid", "v"], "left_semi").join(held, "pid", "left_anti")
    one = links.select(F.concat_ws("_", "pid", "v").alias("id"), F.col("t").alias("r"), F.col("i").alias("s"), F.when(F.col("tag").isin("NOP", "INS"), "COPY").otherwise(F.col("tag")).alias("op"))
    return one.unionByName(one.select(F.concat("id", F.lit("~")).alias("id"), F.col("s").alias("r"), F.col("r").alias("s"), "op"))


@query("N13_swapped_halves", """with e as (select pair_id, n_r, n_r//2 as mid, min(case when regexp_matches(word,'[.;:?!]$') and t<n_r-1 and t+1 between 2 and n_r-2 then (abs(t+1-n_r//2), t+1) end) as bc from words_p where n_r>=6 group by 1,2),
   c as (select pair_id, coalesce(bc[2], mid)::INT as cut from e) select w.pair_id, w.t, (case when w.t<cut then w.t+n_r-cut else w.t-cut end)::INT as t2, w.s, cut from words_p w join c using(pair_id)""")
def halves(b: Inputs):
    return sy.swap_halves(b.words).select("pair_id", "t", "t2", "s", "cut")


@query("N14_error_weighted", f"""with e as (select pair_id as id, least(0.9, 1-"right"::DOUBLE/total) as err from tok_acc), r as (select id, 'random' as why from e order by md5('1|'||id) limit 30)
   select * from r union all select * from (select id, 'error' as why from e where err>0 and id not in (select id from r) order by round(-ln(greatest({k.udraw("'2|'||id")},1e-12))/err,9), id limit 70) z""")
def error_weighted(b: Inputs):
    from palimpsest.operators import score as so

    acc = so.token_accuracy(b.rwords, score_q._gold_links(b), b.pred)
    return sy.error_weighted(acc.select(F.col("pair_id").alias("id"), F.least(F.lit(0.9), 1 - F.col("right") / F.col("total")).alias("err")), 100)


def _inside(b: Inputs):
    """The localised pairs: windows cut out of the widened passages, kept where the pairs lie."""
    x = mn.localise(b.wide)
    cutout = lambda c, o, n: F.slice(c, F.col(o) + 1, F.col(n))
    x = x.withColumn("r_norm", cutout("r_norm", "r_off", "r_len")).withColumn("s_norm", cutout("s_norm", "s_off", "s_len")).withColumn(
        "r_tok", cutout("r_tok", "r_off", "r_len")).withColumn("s_tok", cutout("s_tok", "s_off", "s_len")).withColumn("n_all", F.col("n_r")).withColumn(
        "n_r", F.col("r_len")).withColumn("n_s", F.col("s_len"))
    return cut(x.select("pair_id", "n_s", "n_r", "n_all", "r_off", "s_off", "r_len", "s_tok", "s_norm", "r_tok", "r_norm"), laid=True)


@query("M10_relabelled_context")
def relabelled(b: Inputs):
    x = _inside(b)
    links = al.optimal_pairs(al.form_cells(x).select("pair_id", "t", "s", (1000 - F.col("wgt")).cast("double").alias("cost")))
    shift = x.select("pair_id", "r_off", "s_off", "r_len", "n_all")
    words = shift.select("*", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("t"))
    moved = links.join(shift, "pair_id").select("pair_id", (F.col("t") + F.col("r_off")).alias("t"), (F.col("s") + F.col("s_off")).alias("s"))
    inside = F.col("t").between(F.col("r_off"), F.col("r_off") + F.col("r_len") - 1)
    return words.join(moved, ["pair_id", "t"], "left").select("pair_id", "t", F.coalesce("s", F.lit(-1)).alias("s"), F.when(~inside, "FRAME").when(F.col("s").isNull(), "INS").otherwise("LINK").alias("op"))


@query("M11_planned_examples")
def planned(b: Inputs):
    x = _inside(b)
    links = al.optimal_pairs(al.form_cells(x).select("pair_id", "t", "s", (1000 - F.col("wgt")).cast("double").alias("cost")))
    n = links.groupBy("pair_id").agg(F.count("*").alias("links"))
    return x.select("pair_id", "n_s", "n_r").join(n, "pair_id").withColumn("ins", F.col("n_r") - F.col("links")).withColumn("del", F.col("n_s") - F.col("links"))
