"""Typing and frames (Y rows), script derivation (G rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import labels as lb
from palimpsest.operators import align as al
from palimpsest.operators import evidence as ev
from palimpsest.operators import script as sc
from palimpsest.operators import typing_ as ty
from palimpsest.plans.base import Inputs
from palimpsest.queries import sqlkit as k
from palimpsest.queries.registry import query

KW = "('the','la','de','que','der','of')"
SUB = "('SUBST','SYN','SYN-DIST','HYPER','HYPO','ANT','NE-SUB','POS')"
COST = "case tag " + " ".join(f"when '{r[0]}' then {r[1]}" for r in lb.OPERATION_ROWS) + " end::DOUBLE"


def _typed(links: str) -> str:
    return f"""select *, case when tag in ('SYN','POS','NE-SUB','SUBST') and lemma_missing=1 then 'lemma_missing' when tag='SUBST' then 'no_rel_found' else '' end as outcome,
     case when tag not in ('SYN','POS','NE-SUB','SUBST') then '' when wn_hyper=1 then 'HYPER' when wn_hypo=1 then 'HYPO' when wn_ant=1 then 'ANT' else '' end as detail
   from (select e.*, case when e.same_form=1 or {k.key('e.sw')}={k.key('e.rw')} then 'COPY' when enclitic_stem_match=1 then case when enclitic_src=1 and enclitic_tgt=0 then 'SPLIT' else 'MERGE' end
     when same_lemma=1 then 'MORPH' when wn_syn=1 or (cos_missing=0 and cos>=0.65 and same_pos=1) then 'SYN' when wn_deriv=1 then 'POS'
     when both_names=1 and (cos_missing=1 or cos>=0.5) then 'NE-SUB' else 'SUBST' end as tag from {links} l join evidence e using(pair_id, t, s)) y"""


def _words(typed: str) -> str:
    return f"""with w0 as (select r.pair_id, r.n_s, r.n_r, r.t, r.word, r.norm, coalesce(y.s,-1) as s, coalesce(y.tag,'INS') as tag from rwords r left join {typed} y on y.pair_id=r.pair_id and y.t=r.t),
   i0 as (select *, sum((s>=0)::INT) over (partition by pair_id order by t rows unbounded preceding) as lk from w0),
   i1 as (select *, min(t) over z as a, min(case when norm in {KW} then t end) over z as kk from i0 where s<0 window z as (partition by pair_id, lk)),
   i2 as (select pair_id, lk, min(a) as a, min(kk) as kk, min(case when t>=kk and regexp_matches(word,'[.;:?!]$') then t end) as e,
      bool_or(t=kk+1 and regexp_matches(left(word,1),'\\p{{Lu}}')) as cap from i1 where kk is not null group by 1,2),
   sp as (select pair_id, a, coalesce(e, case when cap then kk+1 else kk end) as b from i2),
   nx as (select sp.*, (select min(t) from w0 x where x.pair_id=sp.pair_id and x.t>sp.b and x.s>=0) as nxt from sp),
   one as (select * from (select *, row_number() over (partition by pair_id order by nxt, a) as q from nx where nxt-b<=2) o where q=1)
   select w0.*, (one.a is not null)::INT as frame from w0 left join one on one.pair_id=w0.pair_id and w0.t between one.a and one.b"""


k.cte("typed_pred", _typed("pred"))
k.cte("typed_gold", _typed("gold"))
k.cte("words_p", _words("typed_pred"))
k.cte("words_g", _words("typed_gold"))


@query("Y1_rule_typer", "select pair_id, t, s, tag, outcome, detail from typed_pred")
def rule_typer(b: Inputs):
    return ty.rule_type(b.pred, b.link_evidence(b.pred)).select("pair_id", "t", "s", "tag", "outcome", "detail")


@query("Y2_symbolic_typer", "select pair_id, t, s, tag from symb join cells using(pair_id, t, s)")
def symbolic(b: Inputs):
    return b.cell_evidence.select("pair_id", "t", "s", ev.symbolic_tag().alias("tag"))


@query("Y3_gate", """select y.pair_id, y.t, case when s.tag not in ('SUBST','SYN-DIST') then s.tag else y.tag end as tag from typed_pred y join symb s using(pair_id, t, s)""")
def gate(b: Inputs):
    said = ev.symbolic_tag()
    return ty.rule_type(b.pred, b.link_evidence(b.pred)).select("pair_id", "t", F.when(~said.isin("SUBST", "SYN-DIST"), said).otherwise(F.col("tag")).alias("tag"))


@query("Y4_formula_rule", "select pair_id, t from words_p where frame=1")
def formulas(b: Inputs):
    return b.words.filter("frame = 1").select("pair_id", "t")


k.cte("flagged", "select * replace ((s<0 and length(norm)<=3)::INT as frame) from words_p")


def _flagged(b: Inputs):
    return b.words.withColumn("frame", F.when((F.col("s") < 0) & (F.length("norm") <= 3), 1).otherwise(0))


k.cte("fruns", """select pair_id, min(t) as a, max(t) as b from (select *, t-row_number() over (partition by pair_id order by t) as g from flagged where frame=1) z group by pair_id, g""")
_ADJ = """select pair_id, a, b from (select *, row_number() over (partition by pair_id order by nxt, a) as q from (select f.*, (select min(t) from flagged x where x.pair_id=f.pair_id and x.t>f.b and x.s>=0) as nxt
   from fruns f) n where nxt-b<=2) o where q=1"""


@query("Y5_formula_adjacency", _ADJ)
def adjacency(b: Inputs):
    return ty.adjacent_formulas(_flagged(b))


k.cte("sstart", """select *, max(op) over (partition by pair_id order by t rows unbounded preceding) as start from (select *, case when t=0 or lag(s) over v>=0
     or regexp_matches(lag(word) over v,'[.;:?!]$') then t end as op from flagged window v as (partition by pair_id order by t)) z""")


@query("Y6_formula_extension", """with sp as (select f.pair_id, case when f.b-s.start+1<=40 then s.start else f.a end as a, f.b from fruns f join sstart s on s.pair_id=f.pair_id and s.t=f.a),
   bare as (select s.pair_id, s.start as a, s.t as b from sstart s join (select pair_id, min(t) as first from flagged where s>=0 group by 1) m on m.pair_id=s.pair_id and s.t=m.first-1
     where m.first>=2 and s.word like '%:' and s.pair_id not in (select pair_id from fruns) and s.t-s.start+1<=40),
   al as (select * from sp union all select * from bare)
   select distinct w.pair_id, w.t from flagged w join al on al.pair_id=w.pair_id and w.t between al.a and al.b""")
def extension(b: Inputs):
    return ty.extend_formulas(_flagged(b)).filter("frame = 1").select("pair_id", "t")


@query("Y7_clean_mask", """with f as (select *, case when lag(frame) over v=1 and lead(frame) over v=1 then 1 else frame end as f2 from (select * replace (case when s>=0 then 0 else frame end as frame) from flagged) z
     window v as (partition by pair_id order by t)),
   r as (select *, count(*) over (partition by pair_id, g) as n from (select pair_id, t, t-row_number() over (partition by pair_id order by t) as g from f where f2=1) y)
   select pair_id, t from r where n>=2""")
def clean(b: Inputs):
    return ty.clean_mask(_flagged(b)).filter("frame = 1").select("pair_id", "t")


k.cte("spelled", f"""select w.* replace (case when w.tag in ('MORPH','SPLIT','MERGE') and {k.key('x.word')}={k.key('w.word')} then 'NOP' else w.tag end as tag)
   from words_p w left join swords x on x.pair_id=w.pair_id and x.s=w.s""")


@query("Y8_spelling_repair", "select pair_id, t, tag from spelled")
def spelling(b: Inputs):
    return ty.spelling_repair(b.words, b.swords).select("pair_id", "t", "tag")


def _geo(src: str, strict: bool) -> str:
    x = " or (l is not null and s-l[2]<>t-l[1]) or (r is not null and r[2]-s<>r[1]-t)" if strict else ""
    return f"""select * exclude (l, r, bad) replace (case when bad then -1 else s end as s, case when bad then 'INS' else tag end as tag) from (
     select *, s>=0 and tag in {SUB} and ((l is not null and s<=l[2]) or (r is not null and s>=r[2]){x}) as bad from (
     select *, last_value(case when s>=0 and tag not in {SUB} then [t,s] end ignore nulls) over (partition by pair_id order by t rows between unbounded preceding and 1 preceding) as l,
       first_value(case when s>=0 and tag not in {SUB} then [t,s] end ignore nulls) over (partition by pair_id order by t rows between 1 following and unbounded following) as r from {src}) z) y"""


@query("Y9_geometry_repair", f"select pair_id, t, s, tag from ({_geo('words_p', False)}) q")
def geometry(b: Inputs):
    return ty.geometry_repair(b.words).select("pair_id", "t", "s", "tag")


@query("Y9_geometry_strict", f"select pair_id, t, s, tag from ({_geo('words_p', True)}) q")
def geometry_strict(b: Inputs):
    return ty.geometry_repair(b.words, allow_size_mismatch=False).select("pair_id", "t", "s", "tag")


k.cte("repaired", f"""with g as ({_geo('spelled', False)}),
   r as (select pair_id, min(t) as a, max(t) as b from (select *, t-row_number() over (partition by pair_id order by t) as gg from g where frame=1) z group by pair_id, gg),
   o as (select * from (select *, row_number() over (partition by pair_id order by nxt, a) as q from (select r.*, (select min(t) from g x where x.pair_id=r.pair_id and x.t>r.b and x.s>=0) as nxt from r) n where nxt-b<=2) m where q=1)
   select g.* replace ((o.a is not null)::INT as frame) from g left join o on o.pair_id=g.pair_id and g.t between o.a and o.b""")


@query("Y10_all_repairs", "select pair_id, t, s, tag, frame from repaired")
def repairs(b: Inputs):
    return ty.apply_repairs(b.words, b.swords).select("pair_id", "t", "s", "tag", "frame")


k.cte("regime", """select r.pair_id, r.t, case when y.tag is null then 'none' when y.outcome<>'' then y.outcome when y.tag='COPY' then 'form' when y.tag in ('MORPH','SPLIT','MERGE') then 'lemma' else 'relation' end as regime, y.tag
   from rwords r left join typed_pred y on y.pair_id=r.pair_id and y.t=r.t""")


def _regimes(b: Inputs):
    return ty.regimes(b.rwords, ty.rule_type(b.pred, b.link_evidence(b.pred)))


@query("Y11_regimes", "select pair_id, t, regime from regime")
def regimes(b: Inputs):
    return _regimes(b).select("pair_id", "t", "regime")


@query("Y12_coverage", """select tag, count(*) as n, round(count(*)::DOUBLE/sum(count(*)) over (),6) as share, round(avg((outcome='lemma_missing')::INT),6) as lemma_missing,
   round(avg((outcome='no_rel_found')::INT),6) as no_rel_found from typed_pred group by tag""")
def coverage(b: Inputs):
    from pyspark.sql import Window as W

    t = ty.rule_type(b.pred, b.link_evidence(b.pred)).groupBy("tag").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("outcome") == "lemma_missing").cast("int")), 6).alias("lemma_missing"),
        F.round(F.avg((F.col("outcome") == "no_rel_found").cast("int")), 6).alias("no_rel_found"))
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def _map_sql(level: str, op: str, frame: str) -> str:
    m = "case " + op + " " + " ".join(f"when '{a}' then '{v}'" for a, v in lb._TABLES[level].items()) + " end"
    fr = f"({frame} and {op}='INS')"
    return {"V3": f"case when {fr} then 'FRAME' else {m} end", "group": f"case when {fr} then 'structural' else {m} end",
            "mode": f"case when {frame} then 'FRAME' else {m} end"}.get(level, m)


k.cte("labels_p", "select pair_id, t, " + ", ".join(f"{_map_sql(l, 'tag', '(frame=1)')} as \"{l}\"" for l in lb.LEVELS) + " from words_p")


@query("Y13_label_collapses", "select pair_id, t, " + ", ".join(f'"{l}" as l_{l}' for l in lb.LEVELS) + " from labels_p")
def collapses(b: Inputs):
    op, fr = F.col("tag"), F.col("frame") == 1
    return b.words.select("pair_id", "t", *[lb.collapse(l, op, fr).alias(f"l_{l}") for l in lb.LEVELS])


k.cte("details", """select pair_id, t, tag as op, array_to_string(list_filter([case when tag in ('SUBST','SYN') then detail end, case when t%3=0 then 'MOOD' end, case when t%2=0 then 'CASE' end,
    case when t%7=0 then 'XX' end, case when t%11=0 then 'CASE' end], lambda x: x is not null and x<>''),'+') as detail from typed_pred""")


def _details(b: Inputs):
    t = F.col("t")
    d = F.array_join(F.filter(F.array(F.when(F.col("tag").isin("SUBST", "SYN"), F.col("detail")), F.when(t % 3 == 0, "MOOD"), F.when(t % 2 == 0, "CASE"),
                                      F.when(t % 7 == 0, "XX"), F.when(t % 11 == 0, "CASE")), lambda x: x.isNotNull() & (x != "")), "+")
    return ty.rule_type(b.pred, b.link_evidence(b.pred)).select("pair_id", "t", F.col("tag").alias("op"), d.alias("detail"))


_FEATS = "['CASE','NUMBER','GENDER','TENSE','MOOD','PERSON','VOICE','DEGREE']"
k.cte("parsed", f"""select *, list_filter(p, lambda x: list_contains(lx, x)) as lex_, list_filter(p, lambda x: list_contains({_FEATS}, x)) as mor_ from (select *, case when detail='' then []::VARCHAR[] else string_split(detail,'+') end as p,
   case op when 'SUBST' then ['HYPER','HYPO','CO-HYPO','ANT','META','NUM','PRON','FUNC','CONSTR'] when 'SYN' then ['SYN-DIST'] else []::VARCHAR[] end as lx from details) z""")
k.cte("normed", f"""select pair_id, t, op, detail, bad, case when op='MERGE' or bad then detail else array_to_string(list_concat(lex_, list_filter({_FEATS}, lambda f: list_contains(mor_, f))),'+') as norm_ from (
   select *, detail<>'' and (len(lex_)>1 or len(lex_)+len(mor_)<len(p) or (len(mor_)>0 and op not in ('MORPH','SYN','POS','NE-SUB','SUBST')) or len(mor_)<>len(list_distinct(mor_))) as bad from parsed) z""".replace("'+') as norm_", "'+') end as norm_"))


@query("Y14_detail_parsing", "select pair_id, t, op, detail, norm_ as normalised, case when detail='' then false when op='MERGE' then not regexp_full_match(detail,'\\+[0-9]+') else bad end as error from normed")
def details(b: Inputs):
    op, d = F.col("op"), F.col("detail")
    return _details(b).select("pair_id", "t", "op", "detail", lb.normalise_detail(op, d).alias("normalised"), lb.detail_error(op, d).alias("error"))


@query("Y15_paper_spelling", """select pair_id, t, case when op='MORPH' then 'INFLECT' when op in ('SYN','POS','NE-SUB') then 'SUBST' else op end as paper_op,
   case when op in ('SYN','POS','NE-SUB') and not regexp_matches(norm_,'^SYN-DIST') then case op when 'POS' then 'DERIV' else op end||case when norm_<>'' then '+'||norm_ else '' end else norm_ end as paper_detail,
   op as back_op from normed""")
def paper(b: Inputs):
    d = _details(b)
    out = d.select("pair_id", "t", lb.to_paper_op(F.col("op")).alias("paper_op"), lb.to_paper_detail(F.col("op"), F.col("detail"), revised=True).alias("paper_detail"))
    return out.withColumn("back_op", lb.from_paper_op(F.col("paper_op"), F.col("paper_detail")))


@query("Y16_type_prediction")
def type_prediction(b: Inputs):
    links = al.default_decode(b.fwd, b.rev, 0.4)
    return ty.typed_words(b.rwords, links, b.cell_evidence).select("pair_id", "t", "s", "tag", "frame")


# ---- scripts --------------------------------------------------------------------------------------------


@query("G1_first_links", "select pair_id, t, min(s) as s from cells group by 1,2")
def first(b: Inputs):
    return sc.first_links(b.cells)


_UN = """select 'reuse' as side, pair_id, t as i, case when frame=1 then 'MARK' when t>lo and t<hi then 'INS' else 'NEW' end as op from (
     select *, min(case when s>=0 then t end) over (partition by pair_id) as lo, max(case when s>=0 then t end) over (partition by pair_id) as hi from words_p) z where s<0
   union all select 'source', x.pair_id, x.s, case when x.s>lo and x.s<hi then 'DEL' else 'OUT' end from swords x
     left join (select pair_id, min(s) lo, max(s) hi from pred group by 1) c on c.pair_id=x.pair_id where (x.pair_id, x.s) not in (select pair_id, s from pred)"""


def _unlinked(b: Inputs):
    r = sc.unlinked_reuse(b.words).withColumn("side", F.lit("reuse"))
    return r.unionByName(sc.unlinked_source(b.pred, b.swords).withColumn("side", F.lit("source")))


@query("G2_unlinked_words", _UN)
def unlinked(b: Inputs):
    return _unlinked(b)


def _quote(words: str, n: int) -> str:
    return f"""select pair_id, min(t) as a, max(t) as b from (select *, t-row_number() over (partition by pair_id, t-s order by t) as g, t-s as d from {words} where s>=0 and tag in ('COPY','NOP')) z group by pair_id, d, g having count(*)>={n}"""


@query("G3_quote_runs", _quote("words_p", 4))
def quote_runs(b: Inputs):
    return sc.quotes(b.words)


@query("G4_reorder_counts", """with recursive o as (select pair_id, s, row_number() over (partition by pair_id order by t) as i from pred),
   w as (select pair_id, 0::BIGINT as i, []::INT[] as tails from (select distinct pair_id from o) d union all
     select w.pair_id, o.i, list_concat(list_concat(list_filter(w.tails, lambda x: x<o.s), [o.s]), list_slice(w.tails, len(list_filter(w.tails, lambda x: x<o.s))+2, len(w.tails)))
     from w join o on o.pair_id=w.pair_id and o.i=w.i+1)
   select pair_id, (i-len(tails))::BIGINT as moved from (select *, row_number() over (partition by pair_id order by i desc) as k from w) z where k=1 and i>len(tails)""")
def reorder_counts(b: Inputs):
    return sc.reordered(b.pred).groupBy("pair_id").agg(F.count("*").alias("moved"))


@query("G4_reorder_words", "select pair_id, t from moved")
def reorder_words(b: Inputs):
    return sc.reordered(b.pred)


k.cte("disp", """select pair_id, t from (select *, min(case when s>=0 then t end) over (partition by pair_id) as lo, max(case when s>=0 then t end) over (partition by pair_id) as hi from words_p) z
   where t>=lo and t<hi and regexp_matches(word,'[.;:?!]$')""")


@query("G5_disperse_words", "select pair_id, t from disp")
def disperse(b: Inputs):
    return sc.dispersed(b.words)


@query("G6_adapt_regions", f"""select pair_id, a, b from (select pair_id, min(t) as a, max(t) as b, sum((tag in {SUB})::INT) as n from (select *, sum(nw) over (partition by pair_id order by t rows unbounded preceding) as blk from (
   select *, case when t-lag(t) over (partition by pair_id order by t)<=2 then 0 else 1 end as nw from words_p where s>=0) x) y group by pair_id, blk) z where n>=2""")
def adapt(b: Inputs):
    return sc.adapted(b.words)


# the words outside the longest chain: tails by length and the place before each place, then the walk back
def _moved(links: str) -> str:
    return f"""with recursive vs as (select pair_id, list(s order by t) as l, list(t order by t) as tt from ({links}) z where s>=0 group by pair_id having count(*)>=2),
   w as (select pair_id, 0 as i, []::INT[] as tails, []::INT[] as back from vs union all
     select w.pair_id, w.i+1, list_concat(list_append(list_slice(w.tails,1,x.kk), w.i), list_slice(w.tails, x.kk+2, len(w.tails))), list_append(w.back, case when x.kk>0 then w.tails[x.kk] else -1 end)
     from w join vs using (pair_id), lateral (select len(list_filter(w.tails, lambda p: vs.l[p+1] < vs.l[w.i+1])) as kk) x where w.i < len(vs.l)),
   e as (select w.* from w join vs using (pair_id) where w.i=len(vs.l)),
   p as (select pair_id, tails[len(tails)] as at_, back from e union all select pair_id, back[at_+1], back from p where back[at_+1]>=0)
   select v.pair_id, v.tt[k+1] as t, v.l[k+1] as s from (select *, unnest(range(len(l))) as k from vs) v where (v.pair_id, k) not in (select pair_id, at_ from p)"""


k.cte("moved", _moved("select pair_id, t, s from pred"))
k.cte("moved_g", _moved("select pair_id, t, s from gold"))
# script rows in SQL
k.cte("norm_w", """select w.* replace (case when w.s<0 then 'INS' when x.norm=w.norm or w.tag in ('COPY','NOP') then 'NOP' else w.tag end as tag) from words_p w left join swords x on x.pair_id=w.pair_id and x.s=w.s""")
k.cte("clean_w", """with f as (select *, case when lag(fr) over v=1 and lead(fr) over v=1 then 1 else fr end as f2 from (select *, case when s>=0 then 0 else frame end as fr from norm_w) z window v as (partition by pair_id order by t)),
   r as (select *, count(*) over (partition by pair_id, g) as n, min(t) over (partition by pair_id, g) as a from (select pair_id, t, t-row_number() over (partition by pair_id order by t) as g from f where f2=1) y)
   select w.* exclude (frame), r.a as fa from norm_w w left join (select * from r where n>=2) r on r.pair_id=w.pair_id and r.t=w.t""")
k.cte("script_w", f"""with q as ({_quote('clean_w', 4)}),
   x as (select w.*, coalesce(w.fa, q.a, w.t) as at_, case when w.fa is not null then 'FRAME' when q.a is not null then 'QUOTE' else w.tag end as act from clean_w w left join q on q.pair_id=w.pair_id and w.t between q.a and q.b)
   select pair_id, act as tag, array_to_string(list_filter(list(s order by t), lambda i: i>=0),',') as src, array_to_string(list(t order by t),',') as tgt from x group by pair_id, at_, act""")
k.cte("script_all", f"""select pair_id, tag, src, tgt from script_w union all
   select pair_id, 'DEL', s::VARCHAR, '' from swords where (pair_id, s) not in (select pair_id, s from pred) union all
   select pair_id, 'REORDER', s::VARCHAR, '' from moved union all
   select pair_id, 'ADAPT', array_to_string(list(s order by t),','), '' from (select pair_id, t, s, blk, sum((tag in {SUB})::INT) over (partition by pair_id, blk) as n from (select *, sum(nw) over (partition by pair_id order by t rows unbounded preceding) as blk from (
     select *, case when t-lag(t) over (partition by pair_id order by t)<=2 then 0 else 1 end as nw from clean_w where s>=0) x) y) z where n>=2 group by pair_id, blk union all
   select pair_id, 'DISPERSE', array_to_string(list(s order by t),','), '' from pred where pair_id in (select pair_id from disp) group by pair_id""")


@query("G7_script_rows", "select pair_id, tag, src, tgt from script_all")
def script_rows(b: Inputs):
    idx = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return b.script.select("pair_id", "tag", idx("src").alias("src"), idx("tgt").alias("tgt"))


@query("G8_per_word_view", f"""with q as ({_quote('clean_w', 4)}) select w.pair_id, w.t, case when w.fa is not null then 'INS' else w.tag end as tag, case when w.fa is not null then -1 else w.s end as link,
   w.fa is not null as frame, q.a is not null as quote, w.fa is null and m.t is not null as reorder
   from clean_w w left join q on q.pair_id=w.pair_id and w.t between q.a and q.b left join moved m on m.pair_id=w.pair_id and m.t=w.t""")
def view(b: Inputs):
    return sc.per_word_view(b.script, b.rwords)


@query("G9_planned_script")
def planned(b: Inputs):
    return _plan(b)


def _plan(b: Inputs):
    named = b.telling().withColumn("tag", ev.relation_tag()).filter("tag is not null")
    # read four times below: five narrow columns are kept, not the evidence
    cands = b.keep(named.select("pair_id", "t", "s", "tag", lb.lookup("cost", F.col("tag")).alias("cost")), laid=bool(b.lemma_tables))
    links = al.optimal_pairs(cands)
    tags = links.join(cands.select("pair_id", "t", "s", "tag"), ["pair_id", "t", "s"])
    words = b.rwords.join(tags, ["pair_id", "t"], "left").withColumn("s", F.coalesce("s", F.lit(-1))).withColumn("tag", F.coalesce("tag", F.lit("INS")))
    moved = sc.reordered(words.select("pair_id", "t", "s")).join(links, ["pair_id", "t"]).select("pair_id", F.lit("REORDER").alias("tag"), "s", F.lit(-1).alias("t"))
    dels = b.swords.select("pair_id", "s").join(links.select("pair_id", "s"), ["pair_id", "s"], "left_anti").select("pair_id", F.lit("DEL").alias("tag"), "s", F.lit(-1).alias("t"))
    return words.select("pair_id", "tag", "s", "t").unionByName(dels).unionByName(moved)


@query("G10_op_counts", "select pair_id, tag, count(*) as n from script_all group by 1,2")
def op_counts(b: Inputs):
    return sc.op_counts(b.script)


@query("G10_costs", f"""select p.pair_id, round(c,6) as cost, round(c/greatest(n_s,n_r,1),6) as normalized from pairs p join (select pair_id, sum({COST}) as c from script_all group by 1) z using(pair_id)""")
def costs(b: Inputs):
    return sc.costs(b.script, b.pairs).select("pair_id", F.round("cost", 6).alias("cost"), F.round("normalized", 6).alias("normalized"))


_INV = "case tag when 'HYPER' then 'HYPO' when 'HYPO' then 'HYPER' when 'INS' then 'DEL' when 'DEL' then 'INS' when 'SPLIT' then 'MERGE' when 'MERGE' then 'SPLIT' else tag end"


@query("G11_inverted_script", f"select pair_id, {_INV} as tag, tgt as src, src as tgt from script_all")
def inverted(b: Inputs):
    idx = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return sc.invert(b.script).select("pair_id", "tag", idx("src").alias("src"), idx("tgt").alias("tgt"))


_CONS = """select pair_id, (unnest(string_split(src,',')))::INT as i from script_all where src<>'' and tag not in ('REORDER','ADAPT','DISPERSE')"""


@query("G12_script_problems", f"""with d as (select 'dup' as v, pair_id, tag, src, tgt from script_all union all select 'dup', pair_id, tag, src, tgt from script_all where tag='NOP')
   select pair_id, 'consumed twice' as problem, i from (select pair_id, (unnest(string_split(src,',')))::INT as i from d where src<>'' and tag not in ('REORDER','ADAPT','DISPERSE')) a group by 1,3 having count(*)>1
   union all select pair_id, 'written twice', i from (select pair_id, (unnest(string_split(tgt,',')))::INT as i from d where tgt<>'' and tag not in ('REORDER','ADAPT','DISPERSE')) b group by 1,3 having count(*)>1""")
def script_problems(b: Inputs):
    s = b.script
    return sc.problems(s.unionByName(s.filter("tag = 'NOP'")), b.pairs)


def replay_sql(select: str, norm: str = "r.norm") -> str:
    """Soundness, full coverage, and copied words that the passage holds (``norm`` is the passage's word)."""
    return f"""with t as (select pair_id, count(*) as n, count(distinct i) as d from (select pair_id, (unnest(string_split(tgt,',')))::INT as i from script_all where tgt<>'') a group by 1),
   c as (select pair_id, count(*)=count(distinct i) as ok from ({_CONS}) q group by 1),
   o as (select distinct x.pair_id from (select pair_id, unnest(string_split(src,','))::INT as s, unnest(string_split(tgt,','))::INT as t from script_all where tag in ('NOP','QUOTE')) x
     join swords s on s.pair_id=x.pair_id and s.s=x.s join rwords r on r.pair_id=x.pair_id and r.t=x.t where s.norm<>{norm}),
   v as (select p.pair_id, t.n=p.n_r and t.d=t.n and coalesce(c.ok,true) and o.pair_id is null as ok from pairs p join t using(pair_id) left join c on c.pair_id=p.pair_id left join o on o.pair_id=p.pair_id)
   {select}"""


@query("G13_replays", replay_sql("select pair_id, ok from v"))
def replay(b: Inputs):
    return sc.replays(b.script, b.pairs)


@query("G13_replays_altered", replay_sql("select pair_id, ok from v", "case when r.t=0 then r.norm||'x' else r.norm end"))
def replay_altered(b: Inputs):
    """The first word of every passage altered: a script that copies it no longer replays."""
    first = lambda w, i: F.when(i == 0, F.concat(w, F.lit("x"))).otherwise(w)
    return sc.replays(b.script, b.pairs.withColumn("r_norm", F.transform("r_norm", first)))


@query("G14_serialise_parse")
def serialise(b: Inputs):
    back = sc.parse(sc.serialise(b.script, b.pairs))
    return back.groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.size("src")).alias("sources"), F.sum(F.size("tgt")).alias("targets"))


@query("G15_cost_density", f"""select p.pair_id, round(c/greatest(n_s, n_r-w, 1),6) as density from pairs p join (select pair_id, sum(case when tag='FRAME' then 0 else {COST} end) as c,
   sum(case when tag='FRAME' then len(string_split(tgt,',')) else 0 end) as w from script_all group by 1) z using(pair_id)""")
def density(b: Inputs):
    return sc.cost_density(b.script, b.pairs).withColumn("density", F.round("density", 6))


k.cte("posn", "select r.pair_id, sum((x.norm is not null)::INT) as nop, count(*) as n from rwords r left join swords x on x.pair_id=r.pair_id and x.s=r.t and x.norm=r.norm group by 1")


@query("G16_difficulty", """select p.pair_id, z.n_operations, z.n_substitutions::BIGINT as n_substitutions, round(len(list_filter(r_norm, lambda w: list_contains(s_norm, w)))::DOUBLE/greatest(n_r,1),6) as overlap,
   z.nop=q.nop and z.ins=n_r-q.nop and z.del_=n_s-q.nop and z.n_operations=z.nop+z.ins+z.del_ as positional
   from pairs p join (select pair_id, count(*) as n_operations, sum((tag not in ('NOP','INS','DEL','REORDER','ADAPT','DISPERSE','QUOTE'))::INT) as n_substitutions,
     sum((tag='NOP')::INT) as nop, sum((tag='INS')::INT) as ins, sum((tag='DEL')::INT) as del_ from script_all group by 1) z using(pair_id) join posn q using(pair_id)""")
def difficulty(b: Inputs):
    return sc.difficulty(b.script, b.pairs).withColumn("overlap", F.round("overlap", 6))


@query("G17_trivial_scripts", """select 'copy_only' as method, pair_id, 'NOP' as tag, i as s, i as t from (select pair_id, unnest(range(least(n_s,n_r)))::INT as i from pairs) a
   union all select 'copy_only', pair_id, 'INS', -1, i from (select pair_id, unnest(range(least(n_s,n_r), n_r))::INT as i from pairs) b
   union all select 'copy_only', pair_id, 'DEL', i, -1 from (select pair_id, unnest(range(least(n_s,n_r), n_s))::INT as i from pairs) c
   union all select 'degenerate', pair_id, 'DEL', s, -1 from swords union all select 'degenerate', pair_id, 'INS', -1, t from rwords""")
def trivial(b: Inputs):
    return sc.trivial_scripts(b.pairs)


_REL = "case tag when 'COPY' then 'COPY' when 'NOP' then 'COPY' when 'MORPH' then 'INFLECT' when 'SPLIT' then 'SPLIT' when 'MERGE' then 'MERGE' else 'SUBST' end"


@query("G18_label_shares", f"select {_REL} as label, count(*) as n, round(count(*)::DOUBLE/sum(count(*)) over (),6) as share from words_p where s>=0 group by 1")
def shares(b: Inputs):
    return sc.label_shares(b.words.filter("s >= 0")).withColumn("share", F.round("share", 6))


@query("G19_pair_label", """select pair_id, case when bool_or(coalesce(c and nc and ns=s+1,false)) then 'cit' else 'cf' end as label from (select *, lead(c) over v as nc, lead(s) over v as ns from (
   select pair_id, t, s, s>=0 and tag in ('COPY','NOP') as c from words_p) z window v as (partition by pair_id order by t)) y group by pair_id""")
def pair_label(b: Inputs):
    return sc.pair_label(b.words)


@query("flagship_reuse_profile", f"""with u as ({_UN}) select p.s_work, p.r_work, count(distinct p.pair_id) as pairs, sum(l.n)::BIGINT as linked, sum(l.copies)::BIGINT as copied, sum(coalesce(x.ins,0))::BIGINT as inserted,
     sum(coalesce(x.dels,0))::BIGINT as deleted, sum(coalesce(q.n,0))::BIGINT as quotes, round(sum(l.copies)::DOUBLE/greatest(sum(l.n),1),6) as copy_share
   from pairs p join (select pair_id, sum((s>=0)::INT) as n, sum((s>=0 and tag in ('COPY','NOP'))::INT) as copies from words_p group by 1) l using(pair_id)
   left join (select pair_id, sum((op='INS')::INT) as ins, sum((op='DEL')::INT) as dels from u group by 1) x on x.pair_id=p.pair_id
   left join (select pair_id, count(*) as n from ({_quote('words_p', 4)}) qq group by 1) q on q.pair_id=p.pair_id group by 1,2""")
def flagship(b: Inputs):
    """Which benchmark passages are reused in which documents, and what became of their words."""
    linked = b.words.groupBy("pair_id").agg(F.count_if(F.col("s") >= 0).alias("n"),
                                            F.count_if((F.col("s") >= 0) & F.col("tag").isin("COPY", "NOP")).alias("copies"))
    left = _unlinked(b).groupBy("pair_id").agg(F.count_if(F.col("op") == "INS").alias("ins"), F.count_if(F.col("op") == "DEL").alias("dels"))
    q = sc.quotes(b.words).groupBy("pair_id").agg(F.count("*").alias("q"))
    x = b.pairs.select("pair_id", "s_work", "r_work").join(linked, "pair_id").join(left, "pair_id", "left").join(q, "pair_id", "left")
    zero = F.lit(0)
    return x.groupBy("s_work", "r_work").agg(
        F.count("*").alias("pairs"), F.sum("n").alias("linked"), F.sum("copies").alias("copied"), F.sum(F.coalesce("ins", zero)).alias("inserted"),
        F.sum(F.coalesce("dels", zero)).alias("deleted"), F.sum(F.coalesce("q", zero)).alias("quotes"),
        F.round(F.sum("copies") / F.greatest(F.sum("n"), F.lit(1)), 6).alias("copy_share"))
