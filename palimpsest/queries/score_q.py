"""Scoring and agreement (C rows)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import labels as lb
from palimpsest.functions import text as tx
from palimpsest.operators import script as sc
from palimpsest.operators import score as so
from palimpsest.operators import typing_ as ty
from palimpsest.plans.base import Inputs
from palimpsest.queries import script_q  # noqa: F401  (its shared expressions are reused below)
from palimpsest.queries import sqlkit as k
from palimpsest.queries.registry import query

# the gold script: the same expressions over the gold words
for _name in ("norm_w", "clean_w", "disp", "script_w", "script_all"):
    _sql = k.CTES[_name]
    for _a, _b in (("norm_w", "norm_g"), ("clean_w", "clean_g"), ("disp", "disp_g"), ("script_w", "script_g"), ("script_all", "script_gold"), ("words_p", "words_g"), ("moved", "moved_g"), ("pred", "gold")):
        _sql = re.sub(rf"\b{_a}\b", _b, _sql)
    k.cte({"norm_w": "norm_g", "clean_w": "clean_g", "disp": "disp_g", "script_w": "script_g", "script_all": "script_gold"}[_name], _sql)

k.cte("gold_links", "select pair_id, t, s, tag, length(norm)>=4 as sure from words_g where s>=0")


def PRF(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p, r = f"(case when {tp}+{fp}>0 then {tp}::DOUBLE/({tp}+{fp}) else 0 end)", f"(case when {tp}+{fn}>0 then {tp}::DOUBLE/({tp}+{fn}) else 0 end)"
    return f"round({p},6)::DOUBLE as precision, round({r},6)::DOUBLE as recall, round(case when {p}+{r}>0 then 2*{p}*{r}/({p}+{r}) else 0 end,6)::DOUBLE as f1"


def _sure(b: Inputs):
    return b.gold_words.withColumn("sure", F.length("norm") >= 4)


def _gold_links(b: Inputs):
    return _sure(b).filter("s >= 0").select("pair_id", "t", "s", "tag", "sure")


def _pred_links(b: Inputs):
    return b.words.filter("s >= 0").select("pair_id", "t", "s", "tag")


_ITEM = "coalesce(g.pair_id,p.pair_id) as pair_id, (g.pair_id is not null)::INT as g, (p.pair_id is not null)::INT as p"
_CNT = "sum(g*p)::BIGINT as tp, sum((1-g)*p)::BIGINT as fp, sum(g*(1-p))::BIGINT as fn"
k.cte("link_items", f"select {_ITEM} from gold g full join pred p on p.pair_id=g.pair_id and p.t=g.t and p.s=g.s")


@query("C1_prf_per_pair", f"select pair_id, tp, fp, fn, {PRF()} from (select pair_id, {_CNT} from link_items group by 1) z")
def prf(b: Inputs):
    return so.with_prf(so.compare_sets(b.gold, b.pred, ["pair_id", "t", "s"], ["pair_id"]))


def _items(script: str) -> str:
    return f"""select distinct pair_id, tag, src[least(kk+1,len(src))] as s, t from (select pair_id, tag, src, unnest(range(len(tgt)))::INT as kk, unnest(tgt) as t from (
      select pair_id, tag, case when src='' then [-1] else string_split(src,',')::INT[] end as src, case when tgt='' then [-1] else string_split(tgt,',')::INT[] end as tgt from {script}) a) b"""


k.cte("items_g", _items("script_gold"))
k.cte("items_p", _items("script_all"))
_TI = f"select coalesce(g.tag,p.tag) as tag, {_ITEM} from items_g g full join items_p p on p.pair_id=g.pair_id and p.t=g.t and p.s=g.s and p.tag=g.tag"


@query("C2_script_metrics", f"""with ti as ({_TI}), ai as (select {_ITEM} from (select distinct pair_id, s, t from items_g) g full join (select distinct pair_id, s, t from items_p) p on p.pair_id=g.pair_id and p.t=g.t and p.s=g.s),
   u as (select 'alignment' as "view", '' as tag, {_CNT} from ai union all select 'typed', '', {_CNT} from ti union all select 'operation', tag, {_CNT} from ti group by tag)
   select "view", tag, tp, fp, fn, {PRF()} from u""")
def script_metrics(b: Inputs):
    return so.script_metrics(b.gold_script, b.script)


_TRIVIAL = """select 'copy_only' as method, pair_id, 'NOP' as tag, i as s, i as t from (select pair_id, unnest(range(least(n_s,n_r)))::INT as i from pairs) a
   union all select 'copy_only', pair_id, 'INS', -1, i from (select pair_id, unnest(range(least(n_s,n_r), n_r))::INT as i from pairs) b
   union all select 'copy_only', pair_id, 'DEL', i, -1 from (select pair_id, unnest(range(least(n_s,n_r), n_s))::INT as i from pairs) c
   union all select 'degenerate', pair_id, 'DEL', s, -1 from swords union all select 'degenerate', pair_id, 'INS', -1, t from rwords"""
_FLOOR = "select {i} from items_g g full join (select * from ({t}) z where method='{m}') p on p.pair_id=g.pair_id and p.t=g.t and p.s=g.s and p.tag=g.tag"
_THREE = "unnest(['{n} precision','{n} recall','{n} f1']) as metric, unnest([precision, recall, f1]) as value"


def _counted(name: str, items: str) -> str:
    return f"select {_THREE.format(n=name)} from (select {PRF()} from (select {_CNT} from ({items}) i) c) d"


k.cte("replay_ok", script_q.replay_sql("select pair_id, ok from v"))


@query("C2_script_summary", f"""with ti as ({_TI}), ai as (select {_ITEM} from (select distinct pair_id, s, t from items_g) g full join (select distinct pair_id, s, t from items_p) p on p.pair_id=g.pair_id and p.t=g.t and p.s=g.s),
   ot as (select tag, {_CNT} from ti group by tag), gl as (select pair_id, t, min(s) as s from items_g where s>=0 and t>=0 group by 1,2), pl as (select pair_id, t, min(s) as s from items_p where s>=0 and t>=0 group by 1,2),
   lk as (select avg(coalesce(p.s=g.s,false)::INT) as strict, avg(((g.pair_id, g.s) in (select pair_id, s from pl))::INT) as lenient from gl g left join pl p on p.pair_id=g.pair_id and p.t=g.t)
   {_counted('alignment', 'select * from ai')} union all {_counted('typed', 'select * from ti')}
   union all {_counted('copy_only', _FLOOR.format(i=_ITEM, t=_TRIVIAL, m='copy_only'))} union all {_counted('degenerate', _FLOOR.format(i=_ITEM, t=_TRIVIAL, m='degenerate'))}
   union all select 'macro typed f1', round(avg(2.0*tp/(2*tp+fp+fn)),6)::DOUBLE from ot where tp+fn>0
   union all select 'link strict', round(strict,6) from lk union all select 'link lenient', round(lenient,6) from lk
   union all select 'invalid', (select count(*) from (select distinct pair_id from script_gold except select distinct pair_id from script_all) z)::DOUBLE
   union all select 'exec match', round(avg(ok::INT),6) from replay_ok""")
def script_summary(b: Inputs):
    return so.script_summary(b.gold_script, b.script, sc.trivial_scripts(b.pairs), sc.replays(b.script, b.pairs))


k.cte("tok_acc", """select w.pair_id, sum(case when p.s is not null then (h.pair_id is not null)::INT else 1-coalesce(g.sure,0) end)::BIGINT as "right", count(*) as total from rwords w
   left join pred p on p.pair_id=w.pair_id and p.t=w.t left join (select pair_id, t, max(sure::INT) as sure from gold_links group by 1,2) g on g.pair_id=w.pair_id and g.t=w.t
   left join gold_links h on h.pair_id=p.pair_id and h.t=p.t and h.s=p.s group by 1""")


@query("C3_token_accuracy", 'select pair_id, "right", total from tok_acc')
def token_accuracy(b: Inputs):
    return so.token_accuracy(b.rwords, _gold_links(b), b.pred)


def _links_sql(group: str = "") -> str:
    by = f"{group}," if group else ""
    grp = f"group by {group}" if group else ""
    return f"""select {by} n_pred, n_sure, n_possible, round(pr,6) as precision, round(rc,6) as recall, round(case when pr>0 and rc>0 then 1/(0.5/pr+0.5/rc) else 0 end,6) as f,
      round(case when pr+rc>0 then 2*pr*rc/(pr+rc) else 0 end,6) as f1, round(1-(n_pa+n_sa)::DOUBLE/(n_sure+n_pred),6) as aer from (
      select *, n_pa::DOUBLE/n_pred as pr, n_sa::DOUBLE/n_sure as rc from (select {by} sum(po*a)::BIGINT as n_pa, sum(su*a)::BIGINT as n_sa, sum(a)::BIGINT as n_pred, sum(su)::BIGINT as n_sure, sum(po)::BIGINT as n_possible from (
        select coalesce(g.pair_id,p.pair_id) as pair_id, coalesce(g.sure,false)::INT as su, (g.pair_id is not null)::INT as po, (p.pair_id is not null)::INT as a
        from gold_links g full join pred p on p.pair_id=g.pair_id and p.t=g.t and p.s=g.s) i join pairs using(pair_id) {grp}) x) y"""


@query("C4_link_scores", _links_sql())
def link_scores(b: Inputs):
    return so.link_scores(_gold_links(b), b.pred)


def _op_items(words: str, level: str, keep: str = "true") -> str:
    ok = f"(s>=0 and {keep})"
    op = f"case when {ok} then tag else 'INS' end"
    lab = script_q._map_sql(level, f"({op})", f"(not {ok} and frame=1)")
    d = lb._TABLES[level]["DEL"]
    return f"""select pair_id, 'r' as side, t as i, case when {ok} then s else -1 end as s, {lab} as label from {words}
      union all select pair_id, 's', s, s, '{d}' from swords where (pair_id, s) not in (select pair_id, s from {words} where {ok})"""


def _op_sql(level: str) -> str:
    return f"""with ev as ({_op_items('words_g', level)}), su0 as ({_op_items('words_g', level, 'length(norm)>=4')}),
      lo as (select * from ev except select * from su0), su as (select * from su0 where not (side='r' and s<0 and (pair_id, i) in (select pair_id, i from lo where side='r'))),
      u as (select *, 1 as su, 0 as po, 0 as pr from su union all select *, 0, 1, 0 from lo union all select *, 0, 0, 1 from ({_op_items('words_p', level)}) p),
      t as (select label, max(su) as su, max(po) as po, max(pr) as pr from u group by pair_id, side, i, s, label),
      c as (select label, sum(pr*greatest(su,po))::BIGINT as tp, sum(pr*(1-greatest(su,po)))::BIGINT as fp, sum(su*(1-pr))::BIGINT as fn, sum(su)::BIGINT as sure, sum(su*pr)::BIGINT as sure_found from t group by label)
      select *, {PRF()} from c"""


def _register_ops(level: str):
    @query(f"C5_op_scores_{level}", _op_sql(level))
    def op_scores(b: Inputs):
        return so.op_scores(_sure(b), b.words, b.swords, level)


for _level in lb.LEVELS:
    _register_ops(_level)


@query("C5_confusion", f"""select g.label as gold, p.label as pred, count(*) as n from (select * from ({_op_items('words_g','V1')}) a where side='r') g
   join (select * from ({_op_items('words_p','V1')}) z where side='r') p on p.pair_id=g.pair_id and p.i=g.i group by 1,2""")
def confusion(b: Inputs):
    return so.confusion(b.gold_words, b.words, "V1")


def _spans(words: str) -> str:
    return f"select pair_id, min(t) as a, max(t) as b from (select *, t-row_number() over (partition by pair_id order by t) as g from {words} where frame=1) z group by pair_id, g"


@query("C6_frame_scores", f"""select 'words' as "view", tp, fp, fn, {PRF()} from (select {_CNT} from (select {_ITEM} from (select * from words_g where frame=1) g full join (select * from words_p where frame=1) p on p.pair_id=g.pair_id and p.t=g.t) i) x
   union all select 'spans', tp, fp, fn, {PRF()} from (select {_CNT} from (select {_ITEM} from ({_spans('words_g')}) g full join ({_spans('words_p')}) p on p.pair_id=g.pair_id and p.a=g.a and p.b=g.b) i) x""")
def frame_scores(b: Inputs):
    on = F.col("frame") == 1
    words = so.compare_sets(b.gold_words.filter(on), b.words.filter(on), ["pair_id", "t"]).withColumn("view", F.lit("words"))
    spans = so.compare_sets(ty.runs(b.gold_words, on), ty.runs(b.words, on), ["pair_id", "a", "b"]).withColumn("view", F.lit("spans"))
    return so.with_prf(words.unionByName(spans).select("view", "tp", "fp", "fn"))


_DEL = "select pair_id, s from swords where (pair_id, s) not in (select pair_id, s from {l})"


@query("C7_structure_scores", f"""select 'quote' as "view", tp, fp, fn, {PRF()} from (select {_CNT} from (select {_ITEM} from ({script_q._quote('words_g',2)}) g full join ({script_q._quote('words_p',2)}) p on p.pair_id=g.pair_id and p.a=g.a and p.b=g.b) i) x
   union all select 'disperse', tp, fp, fn, {PRF()} from (select {_CNT} from (select {_ITEM} from (select distinct pair_id from disp_g) g full join (select distinct pair_id from disp) p on p.pair_id=g.pair_id) i) x
   union all select 'del', tp, fp, fn, {PRF()} from (select {_CNT} from (select {_ITEM} from ({_DEL.format(l='gold')}) g full join ({_DEL.format(l='pred')}) p on p.pair_id=g.pair_id and p.s=g.s) i) x""")
def structure(b: Inputs):
    gone = lambda l: b.swords.select("pair_id", "s").join(l.select("pair_id", "s"), ["pair_id", "s"], "left_anti")
    parts = (
        ("quote", sc.quotes(b.gold_words, minimum=2), sc.quotes(b.words, minimum=2), ["pair_id", "a", "b"]),
        ("disperse", sc.dispersed(b.gold_words), sc.dispersed(b.words), ["pair_id"]),
        ("del", gone(b.gold), gone(b.pred), ["pair_id", "s"]),
    )
    out = None
    for name, g, p, keys in parts:
        row = so.compare_sets(g, p, keys).select(F.lit(name).alias("view"), "tp", "fp", "fn")
        out = row if out is None else out.unionByName(row)
    return so.with_prf(out)


@query("C7_reorder_score", f"""select tp, fp, fn, {PRF()} from (select {_CNT} from (select {_ITEM} from (select pair_id, t from moved_g) g full join (select pair_id, t from moved) p on p.pair_id=g.pair_id and p.t=g.t) i) x""")
def reorder_score(b: Inputs):
    return so.with_prf(so.compare_sets(sc.reordered(b.gold), sc.reordered(b.pred), ["pair_id", "t"]))


@query("C8_replay_rate", script_q.replay_sql("select round(avg(ok::INT),6) as rate, count(*) as n from v"))
def replay_rate(b: Inputs):
    return sc.replays(b.script, b.pairs).agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("rate"), F.count("*").alias("n"))


@query("C9_invented_links", """select count(*) as pairs, sum(coalesce(n,0))::BIGINT as links, round(sum(coalesce(n,0))::DOUBLE/count(*),6) as links_per_pair, round(avg((coalesce(n,0)>0)::INT),6) as pairs_with_links
   from pairs p left join (select pair_id, count(*) as n from pred group by 1) l on l.pair_id=p.pair_id where pair_label='no_match'""")
def invented(b: Inputs):
    per = b.pred.groupBy("pair_id").agg(F.count("*").alias("n"))
    x = b.pairs.filter("pair_label = 'no_match'").join(per, "pair_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.agg(F.count("*").alias("pairs"), F.sum("n").alias("links"), F.round(F.sum("n") / F.count("*"), 6).alias("links_per_pair"),
                 F.round(F.avg((F.col("n") > 0).cast("int")), 6).alias("pairs_with_links"))


@query("C10_breakdowns", """select coalesce(p.pair_label,'all') as label, coalesce(r.regime,'all') as regime, count(*) as n, round(avg((g.s is not distinct from q.s)::INT),6) as accuracy
   from rwords w join pairs p on p.pair_id=w.pair_id join regime r on r.pair_id=w.pair_id and r.t=w.t left join gold g on g.pair_id=w.pair_id and g.t=w.t left join pred q on q.pair_id=w.pair_id and q.t=w.t
   group by grouping sets ((p.pair_label),(r.regime),())""")
def breakdowns(b: Inputs):
    reg = script_q._regimes(b).select("pair_id", "t", "regime")
    x = so.word_decisions(b.rwords, b.gold, b.pred).join(reg, ["pair_id", "t"]).join(b.pairs.select("pair_id", "pair_label"), "pair_id")
    g = x.groupingSets([["pair_label"], ["regime"], []], "pair_label", "regime").agg(F.count("*").alias("n"), F.round(F.avg((F.col("g") == F.col("p")).cast("int")), 6).alias("accuracy"))
    return g.select(F.coalesce("pair_label", F.lit("all")).alias("label"), F.coalesce("regime", F.lit("all")).alias("regime"), "n", "accuracy")


k.cte("grun", "select pair_id, t, s, count(*) over (partition by pair_id, d, g) as len from (select *, t-s as d, t-row_number() over (partition by pair_id, t-s order by t) as g from gold) z")


@query("C10_run_length", f"""select kind, tp, fp, fn, {PRF()} from (select kind, sum((p.s=g.s)::INT)::BIGINT as tp, sum((p.s<>g.s)::INT)::BIGINT as fp, sum((p.s is null or p.s<>g.s)::INT)::BIGINT as fn
   from (select *, case when len=1 then 'single' else 'multi' end as kind from grun) g left join pred p on p.pair_id=g.pair_id and p.t=g.t group by 1) z""")
def run_length(b: Inputs):
    w = W.partitionBy("pair_id", "d").orderBy("t")
    g = b.gold.withColumn("d", F.col("t") - F.col("s")).withColumn("g", F.col("t") - F.row_number().over(w))
    g = g.withColumn("len", F.count("*").over(W.partitionBy("pair_id", "d", "g")))
    x = g.select("pair_id", "t", "s", F.when(F.col("len") == 1, "single").otherwise("multi").alias("kind")).join(
        b.pred.select("pair_id", "t", F.col("s").alias("p")), ["pair_id", "t"], "left")
    c = x.groupBy("kind").agg(F.count_if(F.col("p") == F.col("s")).alias("tp"), F.count_if(F.col("p") != F.col("s")).alias("fp"),
                              F.count_if(F.col("p").isNull() | (F.col("p") != F.col("s"))).alias("fn"))
    return so.with_prf(c)


_FOLD = f"""select fold, 'token_accuracy' as metric, sum("right")::DOUBLE/sum(total) as value from tok_acc join pairs using(pair_id) group by fold
   union all select fold, 'link_f1', f1 from ({_links_sql('fold')}) l"""


def _fold_metrics(b: Inputs):
    folds = b.pairs.select("pair_id", "fold")
    acc = so.token_accuracy(b.rwords, _gold_links(b), b.pred).join(folds, "pair_id").groupBy("fold").agg(
        F.lit("token_accuracy").alias("metric"), (F.sum("right") / F.sum("total")).alias("value"))
    f1 = so.link_scores(_gold_links(b).join(folds, "pair_id"), b.pred.join(folds, "pair_id"), by=["fold"]).select("fold", F.lit("link_f1").alias("metric"), F.col("f1").alias("value"))
    return acc.unionByName(f1)


@query("C11_whole_score", f"select fold, metric, round(value,6) as value from ({_FOLD}) z")
def whole_score(b: Inputs):
    return _fold_metrics(b).withColumn("value", F.round("value", 6))


@query("C12_fold_aggregate", f"""select metric, round(avg(value),6) as mean, round(min(value),6) as lo, round(max(value),6) as hi, round(stddev_pop(value),6) as std, round(stddev_samp(value),6) as std_sample, count(*) as n from ({_FOLD}) z group by 1""")
def fold_aggregate(b: Inputs):
    return so.fold_aggregate(_fold_metrics(b))


@query("C13_split_half", """with a as (select w.pair_id as id, avg((coalesce(g.s,-1)=coalesce(p.s,-1))::INT) as a, avg((coalesce(g.s,-1)=coalesce(r.s,-1))::INT) as b from rwords w left join gold g on g.pair_id=w.pair_id and g.t=w.t
     left join pred p on p.pair_id=w.pair_id and p.t=w.t left join (select pair_id, t, s from fwd_head where s>=0) r on r.pair_id=w.pair_id and r.t=w.t group by 1),
   h as (select seed, a, b, (row_number() over (partition by seed order by md5(seed||'|'||id))<=(select count(*)//2 from a))::INT as half from a, (select unnest(range(1,11)) as seed) s),
   d as (select seed, 1-half as half, avg(a-b) as d from h group by 1,2), g as (select *, sign(round(d,12))::INT as sg from d)
   select sum((sg<>0 and sg=(select sg from g order by seed, half limit 1))::INT)::BIGINT as agree, count(*) as "of", round(avg(d),6) as mean_diff from g""")
def split_half(b: Inputs):
    from palimpsest.operators import align as al

    x = so.word_decisions(b.rwords, b.gold, b.pred).withColumn("ok", (F.col("g") == F.col("p")).cast("int"))
    y = so.word_decisions(b.rwords, b.gold, al.raw_decode(b.fwd)).withColumn("ok", (F.col("g") == F.col("p")).cast("int"))
    a = x.groupBy(F.col("pair_id").alias("id")).agg(F.avg("ok").alias("a"))
    return so.split_half(a.join(y.groupBy(F.col("pair_id").alias("id")).agg(F.avg("ok").alias("b")), "id"))


@query("C14_agreement", """select round(2*tp::DOUBLE/(2*tp+fp+fn),6) as iaa, round(case when pe<1 then (tp/n-pe)/(1-pe) else 1 end,6) as kappa from (select *, pa*pb+(1-pa)*(1-pb) as pe from (
   select tp::DOUBLE as tp, fp, fn, (tp+fp+fn)::DOUBLE as n, (tp+fn)::DOUBLE/(tp+fp+fn) as pa, (tp+fp)::DOUBLE/(tp+fp+fn) as pb from (select sum(g*p) as tp, sum((1-g)*p) as fp, sum(g*(1-p)) as fn from link_items) a) b) c""")
def agreement(b: Inputs):
    return so.agreement(b.gold, b.pred)


k.cte("tier_links", "select p.pair_id, p.t, p.s, case y.tag when 'NOP' then 'COPY' when 'SYN-DIST' then 'SYN' when 'HYPER' then 'SUBST' when 'HYPO' then 'SUBST' when 'ANT' then 'SUBST' else y.tag end as tag from pred p join symb y using(pair_id, t, s)")


@query("C15_annotation_agreement", """with sh as (select a.tag as a, z.tag as b from words_p a join tier_links z on z.pair_id=a.pair_id and z.t=a.t and z.s=a.s),
   n as (select count(*)::DOUBLE as n, sum((a=b)::INT)::DOUBLE as o from sh), c as (select sum(na*nb)::DOUBLE as c from (select a as k, count(*) na from sh group by 1) x join (select b as k, count(*) nb from sh group by 1) y using(k))
   select n::BIGINT as shared, round(o/n,6) as accuracy, round((o/n-c/(n*n))/(1-c/(n*n)),6) as kappa from n, c""")
def annotation_agreement(b: Inputs):
    from palimpsest.operators import evidence as ev

    other = b.pred.select("pair_id", "t", "s").join(b.cell_evidence, ["pair_id", "t", "s"]).select("pair_id", "t", "s", lb.canonical_op(ev.symbolic_tag()).alias("tag"))
    return so.op_agreement(_pred_links(b), other)


k.cte("annot", "select pair_id, t, s, tag, detail from (select r.pair_id, r.t, r.s+(case when r.t%13=0 then 30 else 0 end) as s, case when r.t%5=0 then 'COPY' when r.t%7=0 then 'FOO' else r.tag end as tag, case when r.t%3=0 then 'CASE' when r.t%11=0 then 'BAD' else '' end as detail from words_p r where r.s>=0) z")
_STEM = "left(a,3)=left(b,3)"


@query("C16_annotation_checker", f"""with x as (select l.*, n_s, n_r, s_norm[l.s+1] as a, r_norm[l.t+1] as b from annot l join pairs using(pair_id)),
   ok as (select * from x where s<n_s and tag in ('COPY','MORPH','SYN','POS','NE-SUB','SUBST','SPLIT','MERGE')), sp as ({_spans('flagged')})
   select pair_id, 'error' as severity, 'outside the source' as message, t as i from x where s>=n_s
   union all select pair_id, 'error', 'not an edge operation', t from x where s<n_s and tag='FOO'
   union all select pair_id, 'error', 'detail not in the closed list', t from ok where (detail='BAD') or (detail='CASE' and tag in ('COPY','SPLIT','MERGE'))
   union all select pair_id, 'error', 'MERGE without its second word', t from ok where tag='MERGE' and detail=''
   union all select pair_id, 'error', 'source shared without SPLIT', s from ok group by pair_id, s having count(*)>1 and min((tag='SPLIT')::INT)=0
   union all select distinct ok.pair_id, 'error', 'word in a formula and linked', ok.t from ok join sp on sp.pair_id=ok.pair_id and ok.t between sp.a and sp.b
   union all select pair_id, 'warn', 'COPY differs after folding', t from ok where tag='COPY' and a<>b and {_STEM}
   union all select pair_id, 'warn', 'COPY of different words', t from ok where tag='COPY' and a<>b and not {_STEM}
   union all select pair_id, 'warn', 'MORPH of the same word', t from ok where tag='MORPH' and a=b
   union all select pair_id, 'warn', 'MORPH without a shared stem', t from ok where tag='MORPH' and a<>b and not {_STEM}
   union all select pair_id, 'warn', 'lexical change of the same word', t from ok where tag in ('SYN','POS','NE-SUB','SUBST') and a=b
   union all select pair_id, 'warn', 'SPLIT with one word', s from ok where tag='SPLIT' group by pair_id, s having count(*)=1""")
def checker(b: Inputs):
    t = F.col("t")
    links = b.words.filter("s >= 0").select(
        "pair_id", "t", (F.col("s") + F.when(t % 13 == 0, 30).otherwise(0)).alias("s"),
        F.when(t % 5 == 0, "COPY").when(t % 7 == 0, "FOO").otherwise(F.col("tag")).alias("tag"),
        F.when(t % 3 == 0, "CASE").when(t % 11 == 0, "BAD").otherwise("").alias("detail"))
    spans = ty.runs(script_q._flagged(b), F.col("frame") == 1).select("pair_id", F.col("a").alias("start"), (F.col("b") + 1).alias("end"))
    return so.check_annotation(links, spans, b.pairs)


@query("C17_typed_sequence", f"""select label, tp, fp, fn, {PRF()} from (select label, sum((g=label and p=label)::INT)::BIGINT as tp, sum((g<>label and p=label)::INT)::BIGINT as fp, sum((g=label and p<>label)::INT)::BIGINT as fn from (
   select g.tag as g, p.tag as p, unnest(list_distinct([g.tag, p.tag])) as label from words_g g join words_p p on p.pair_id=g.pair_id and p.t=g.t) z group by 1) y""")
def typed_sequence(b: Inputs):
    x = b.gold_words.select("pair_id", "t", F.col("tag").alias("g")).join(b.words.select("pair_id", "t", F.col("tag").alias("p")), ["pair_id", "t"])
    c = x.groupBy("g", "p").agg(F.count("*").alias("n")).select("g", "p", "n", F.explode(F.array_distinct(F.array("g", "p"))).alias("label"))
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    l = F.col("label")
    return so.with_prf(c.groupBy("label").agg(n((F.col("g") == l) & (F.col("p") == l)).alias("tp"), n((F.col("g") != l) & (F.col("p") == l)).alias("fp"), n((F.col("g") == l) & (F.col("p") != l)).alias("fn")))


_FOUR = "case when s<0 then case when frame=1 then 'FRAME' else 'INS' end when tag in ('COPY','NOP') then 'COPY' else 'SUBST' end"


@query("C18_rescore_repaired", f"""select g, p, count(*) as n from (select {_FOUR.replace('s<0','g.s<0').replace('frame=1','g.frame=1').replace('tag in','g.tag in')} as g, {_FOUR.replace('s<0','p.s<0').replace('frame=1','p.frame=1').replace('tag in','p.tag in')} as p
   from words_g g join repaired p on p.pair_id=g.pair_id and p.t=g.t) z group by 1,2""")
def rescored(b: Inputs):
    four = F.when(F.col("s") < 0, F.when(F.col("frame") == 1, "FRAME").otherwise("INS")).when(F.col("tag").isin("COPY", "NOP"), "COPY").otherwise("SUBST")
    fixed = ty.apply_repairs(b.words, b.swords).select("pair_id", "t", four.alias("p"))
    return b.gold_words.select("pair_id", "t", four.alias("g")).join(fixed, ["pair_id", "t"]).groupBy("g", "p").agg(F.count("*").alias("n"))


# a score table over all candidate pairs: query = reuse passage, item = source passage
k.cte("ranking", f"""select q as query_id, c as item, case when n_shared>=3 then 1 else 0 end as gold, round({k.udraw("'s|'||c||'_'||q")}*0.5+least(n_shared,10)/20.0::DOUBLE,6) as score from mined""")


def _ranking(b: Inputs):
    pid = F.concat_ws("_", "c", "q")
    return b.mined.select(F.col("q").alias("query_id"), F.col("c").alias("item"), (F.col("n_shared") >= 3).cast("int").alias("gold"),
                          F.round(tx.unit_draw("s", pid) * 0.5 + F.least("n_shared", F.lit(10)) / 20.0, 6).alias("score"))


@query("C19_query_scores", f"""with r as (select *, (score>=0.4)::INT as pred from ranking), q as (select query_id, sum(gold*pred) as tp, sum((1-gold)*pred) as fp, sum(gold*(1-pred)) as fn, sum((1-gold)*(1-pred)) as tn from r group by 1),
   m as (select *, tp+fn>0 as mm, case when tp+fp>0 then tp::DOUBLE/(tp+fp) else 0 end as pr, case when tp+fn>0 then tp::DOUBLE/(tp+fn) else 0 end as rc, (tp+fp+fn+tn)::DOUBLE as n from q),
   f as (select *, case when pr+rc>0 then 2*pr*rc/(pr+rc) else 0 end as f1 from m),
   a as (select avg(pr) filter (mm) as macro_p, avg(rc) filter (mm) as macro_r, avg(f1) filter (mm) as macro_f1, avg(fp/n) as fpr, avg(fn/n) as fnr, avg((fp+fn)/n) as smr, sum(tp) filter (mm) as tp, sum(fp) filter (mm) as fp, sum(fn) filter (mm) as fn from f)
   select round(macro_p,6) as macro_p, round(macro_r,6) as macro_r, round(macro_f1,6) as macro_f1, round(fpr,6) as fpr, round(fnr,6) as fnr, round(smr,6) as smr,
     round(tp::DOUBLE/(tp+fp),6) as micro_p, round(tp::DOUBLE/(tp+fn),6) as micro_r, round(2*tp::DOUBLE/(2*tp+fp+fn),6) as micro_f1 from a""")
def query_scores(b: Inputs):
    return so.query_scores(_ranking(b).withColumn("pred", (F.col("score") >= 0.4).cast("int")))


@query("C20_plateau_threshold", """with f as (select k, coalesce(2*tp::DOUBLE/nullif(2*tp+fp+fn,0),0) as f1 from (select k, sum((h>=k and gold=1)::INT) as tp, sum((h>=k and gold=0)::INT) as fp, sum((h<k and gold=1)::INT) as fn from (
     select gold, greatest(least(floor(round(score*100,9)),100),0) as h from ranking) r, (select unnest(range(1,100)) as k) g group by k) z)
   select min(case when f1=m then k end)/100.0::DOUBLE as max_f1, min(case when f1>=m-0.01 then k end)/100.0::DOUBLE as plateau_low, max(case when f1>=m-0.01 then k end)/100.0::DOUBLE as plateau_high from (select *, max(f1) over () as m from f) y""")
def plateau(b: Inputs):
    return so.plateau_threshold(_ranking(b))


@query("C21_recall_at_k", """with r as (select *, row_number() over (partition by query_id order by score desc, item) as k from ranking)
   select round(avg(a),6) as recall_1, round(avg(z),6) as recall_2, round(avg(c),6) as recall_10 from (select query_id, sum((gold=1 and k<=1)::INT)::DOUBLE/sum(gold) as a, sum((gold=1 and k<=2)::INT)::DOUBLE/sum(gold) as z,
     sum((gold=1 and k<=10)::INT)::DOUBLE/sum(gold) as c from r group by 1 having sum(gold)>0) q""")
def recall(b: Inputs):
    return so.recall_at(_ranking(b), (1, 2, 10))


@query("C23_rank_auc", """select round((sum(case when gold=1 then rk else 0 end)-sum(gold)*(sum(gold)+1)/2.0::DOUBLE)/(sum(gold)*sum(1-gold))::DOUBLE,6) as auc from (
   select gold, (rank() over (order by score)+(count(*) over (partition by score)-1)/2.0::DOUBLE) as rk from ranking) z""")
def auc(b: Inputs):
    return so.rank_auc(_ranking(b))


#: Replicates of the registered query; each costs one weight per row.
REPLICATES = 50
_POISSON = "+".join(f"(u>={p})::INT" for p in so.POISSON)


@query("C23_bootstrap_auc", f"""with w as (select r.rep, score, gold, case when r.rep=0 then 1 else {_POISSON} end as w from (
     select gold, score, rep, {k.udraw("'1|'||query_id||'|'||item||'|'||rep")} as u from ranking, (select unnest(range({REPLICATES + 1})) as rep) z) r),
   p as (select rep, score, sum(w*gold)::DOUBLE as pos, sum(w*(1-gold))::DOUBLE as neg from w group by 1,2),
   c as (select *, sum(neg) over (partition by rep order by score rows unbounded preceding)-neg as below from p),
   a as (select rep, sum(pos*(below+neg/2))/nullif(sum(pos)*sum(neg),0) as auc from c group by 1)
   select round(max(case when rep=0 then auc end),6) as auc, round(stddev_pop(case when rep>0 then auc end),6) as spread, count(case when rep>0 then auc end) as replicates from a""")
def bootstrap(b: Inputs):
    return so.bootstrap_auc(_ranking(b), ["query_id", "item"], replicates=REPLICATES)


@query("C24_cosine_classes", """select class, count(*) as n, round(avg(v),6) as mean from (select case when p.s is null then 'random' when y.tag='COPY' then 'COPY' when y.tag='MORPH' then 'MORPH' else 'lexical' end as class, z.v
   from sims z left join pred p on p.pair_id=z.pair_id and p.t=z.t and p.s=z.s left join words_p y on y.pair_id=p.pair_id and y.t=p.t) q group by 1""")
def cosine_classes(b: Inputs):
    tags = _pred_links(b)
    x = b.sims.join(tags, ["pair_id", "t", "s"], "left")
    cls = F.when(F.col("tag").isNull(), "random").when(F.col("tag").isin("COPY", "MORPH"), F.col("tag")).otherwise("lexical")
    return x.groupBy(cls.alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("C25_difficulty_table", """with m as (select w.pair_id, avg((coalesce(g.s,-1)=coalesce(p.s,-1))::INT) as mutual, avg((coalesce(g.s,-1)=coalesce(r.s,-1))::INT) as raw from rwords w left join gold g on g.pair_id=w.pair_id and g.t=w.t
     left join pred p on p.pair_id=w.pair_id and p.t=w.t left join (select pair_id, t, s from fwd_head where s>=0) r on r.pair_id=w.pair_id and r.t=w.t group by 1)
   select pair_id, round(mutual,6) as mutual, round(raw,6) as raw, round((mutual+raw)/2,6) as mean, mutual<0.8 and raw<0.8 as failed_by_all from m""")
def difficulty(b: Inputs):
    from palimpsest.operators import align as al

    parts = [so.word_decisions(b.rwords, b.gold, l).select("pair_id", (F.col("g") == F.col("p")).cast("int").alias("ok"), F.lit(n).alias("method"))
             for n, l in (("mutual", b.pred), ("raw", al.raw_decode(b.fwd)))]
    t = parts[0].unionByName(parts[1]).groupBy("pair_id").pivot("method", ["mutual", "raw"]).agg(F.avg("ok"))
    m, r = F.col("mutual"), F.col("raw")
    return t.select("pair_id", F.round(m, 6).alias("mutual"), F.round(r, 6).alias("raw"), F.round((m + r) / 2, 6).alias("mean"), ((m < 0.8) & (r < 0.8)).alias("failed_by_all"))


@query("C26_leakage_split", """select leaky, count(*) as n, round(sum("right")::DOUBLE/sum(total),6) as token_accuracy from (select pair_id, s_txt in (select s_txt from pairs where fold<>1) as leaky from pairs where fold=1) l join tok_acc using(pair_id) group by 1""")
def leakage(b: Inputs):
    from palimpsest.operators import mining as mn

    flags = mn.leaky_flag(b.pairs, 1).select("pair_id", "leaky")
    return so.token_accuracy(b.rwords, _gold_links(b), b.pred).join(flags, "pair_id").groupBy("leaky").agg(
        F.count("*").alias("n"), F.round(F.sum("right") / F.sum("total"), 6).alias("token_accuracy"))


@query("C27_type_job", """select y.tag as op, count(*) as n, round(avg((y.tag=s.tag)::INT),6) as strict, round(avg((case y.tag when 'SYN-DIST' then 'SYN' else y.tag end=case s.tag when 'SYN-DIST' then 'SYN' when 'NOP' then 'COPY' else s.tag end)::INT),6) as lenient
   from typed_pred y join symb s using(pair_id, t, s) group by 1""")
def type_job(b: Inputs):
    from palimpsest.operators import evidence as ev

    said = ev.symbolic_tag()
    fold = lambda c: F.when(c == "SYN-DIST", "SYN").when(c == "NOP", "COPY").otherwise(c)
    x = ty.rule_type(b.pred, b.link_evidence(b.pred)).select(F.col("tag").alias("op"), said.alias("said"))
    return x.groupBy("op").agg(F.count("*").alias("n"), F.round(F.avg((F.col("op") == F.col("said")).cast("int")), 6).alias("strict"),
                               F.round(F.avg((fold(F.col("op")) == fold(F.col("said"))).cast("int")), 6).alias("lenient"))


@query("C28_propose_job", f"""with pr as (select {k.lemma('x.norm')} as a, {k.lemma('r.norm')} as b, p.tag from rel p join swords x on x.pair_id=p.pair_id and x.s=p.s join rwords r on r.pair_id=p.pair_id and r.t=p.t where p.tag not in ('NOP','MORPH'))
   select pr.tag, count(*) as n, round(avg((f.la is not null)::INT),6) as confirmed, round(avg((pr.b in (select {k.lemma('norm')} from attested where length(norm)>=3))::INT),6) as attested
   from pr left join rel_flags f on f.la=pr.a and f.lb=pr.b group by 1""")
def propose_job(b: Inputs):
    from palimpsest.operators import evidence as ev
    from palimpsest.operators import lexicon as lx

    props = b.evid.withColumn("tag", ev.relation_tag()).filter("tag not in ('NOP', 'MORPH')").select(
        tx.lemma_standin(F.col("sn")).alias("la"), tx.lemma_standin(F.col("rn")).alias("lb"), "tag")
    flags = lx.relation_flags(b.lexicon).select("la", "lb", F.lit(1).alias("c"))
    att = b.attested.select(tx.lemma_standin(F.col("norm")).alias("lb")).distinct().withColumn("at", F.lit(1))
    x = props.join(flags, ["la", "lb"], "left").join(att, "lb", "left")
    return x.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("c", F.lit(0))), 6).alias("confirmed"), F.round(F.avg(F.coalesce("at", F.lit(0))), 6).alias("attested"))


@query("C29_realism", f"""with m as (select 'pred' as origin, tag, s, t, pair_id from words_p union all select 'gold', tag, s, t, pair_id from words_g),
   a as (select origin, unnest(['link_rate','copy_rate','inflect_rate']) as metric, unnest([avg((s>=0)::INT), avg((tag='COPY')::INT), avg((tag='MORPH')::INT)]) as v from m group by 1)
   select metric, round(max(case when origin='gold' then v end),6) as wanted, round(max(case when origin='pred' then v end),6) as got,
     abs(max(case when origin='pred' then v end)-max(case when origin='gold' then v end))/greatest(max(case when origin='gold' then v end),1e-9)>0.25 as flagged from a group by 1""")
def realism(b: Inputs):
    def rates(df, origin):
        one = df.agg(F.avg((F.col("s") >= 0).cast("int")).alias("link_rate"), F.avg((F.col("tag") == "COPY").cast("int")).alias("copy_rate"), F.avg((F.col("tag") == "MORPH").cast("int")).alias("inflect_rate"))
        return one.unpivot([], ["link_rate", "copy_rate", "inflect_rate"], "metric", origin)

    x = rates(b.gold_words, "wanted").join(rates(b.words, "got"), "metric")
    gap = F.abs(F.col("got") - F.col("wanted")) / F.greatest("wanted", F.lit(1e-9))
    return x.select("metric", F.round("wanted", 6).alias("wanted"), F.round("got", 6).alias("got"), (gap > 0.25).alias("flagged"))
