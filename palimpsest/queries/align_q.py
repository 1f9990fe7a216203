"""Assignment, decoding and agreement (A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import align as al
from palimpsest.operators import evidence as ev
from palimpsest.plans.base import Inputs
from palimpsest.queries import sqlkit as k
from palimpsest.queries.registry import query


def greedy_sql(cells: str, order: str, cap: int = 1) -> str:
    return f"""with recursive go as materialized (select pair_id, t, s, row_number() over (partition by pair_id order by {order}) as i from ({cells}) z0),
   gw as (select pair_id, 0::BIGINT as i, []::INT[] as ts, []::INT[] as ss from (select distinct pair_id from go) d
     union all select w.pair_id, o.i, case when ok then list_append(w.ts,o.t) else w.ts end, case when ok then list_append(w.ss,o.s) else w.ss end
     from gw w join go o on o.pair_id=w.pair_id and o.i=w.i+1,
     lateral (select not list_contains(w.ts,o.t) and len(list_filter(w.ss, lambda x: x=o.s))<{cap} as ok) l),
   ge as (select pair_id, ts, ss, row_number() over (partition by pair_id order by i desc) as k from gw)
   select pair_id, unnest(ts)::INT as t, unnest(ss)::INT as s from ge where k=1"""


def best_value_sql(cells: str, out: str) -> str:
    """The greatest sum of ``p`` over one-to-one choices of (pair_id, t, s, p), s = -1 being a word's own null: word by word
    over all sets of sources that are taken and that a later word could still want. No solver's choice enters it."""
    return f"""with recursive vc as materialized (select pair_id, t, s, p, dense_rank() over (partition by pair_id order by t) as i from ({cells}) z0),
   vw as materialized (select pair_id, i, coalesce(bit_or(m) over (partition by pair_id order by i desc rows between unbounded preceding and 1 preceding),0) as live, max(i) over (partition by pair_id) as n
     from (select pair_id, i, bit_or(case when s>=0 then 1::BIGINT<<s else 0 end) as m from vc group by 1,2) z1),
   vd as (select pair_id, 0::BIGINT as i, 0::BIGINT as mask, 0.0::DOUBLE as v from (select distinct pair_id from vc) z2
     union all
     select pair_id, i, mask, max(v) from (select d.pair_id, w.i, (d.mask | case when x.s>=0 then 1::BIGINT<<x.s else 0 end) & w.live as mask, d.v+x.p as v
       from vd d join vw w on w.pair_id=d.pair_id and w.i=d.i+1 join vc x on x.pair_id=w.pair_id and x.i=w.i where x.s<0 or d.mask & (1::BIGINT<<x.s)=0) z3 group by 1,2,3)
   select d.pair_id, {out} from vd d join vw w on w.pair_id=d.pair_id and w.i=d.i and w.i=w.n group by 1"""


@query("A1_optimal_value", best_value_sql("select pair_id, t, s, (1000000-(1000-wgt))::DOUBLE as p from cells union all select distinct pair_id, t, -1, 0.0::DOUBLE from cells",
    "ceil(max(d.v)/1000000.0)::BIGINT as links, (ceil(max(d.v)/1000000.0)*1000000-max(d.v))::DOUBLE as cost"))
def optimal_value(b: Inputs):
    cells = b.cells.select("pair_id", "t", "s", (1000 - F.col("wgt")).cast("double").alias("cost"))
    return al.assignment_cost(al.optimal_pairs(cells), cells)


@query("A1_optimal_assignment")
def optimal(b: Inputs):
    return al.optimal_pairs(b.cells.select("pair_id", "t", "s", (1000 - F.col("wgt")).cast("double").alias("cost")))


@query("A2_greedy_assignment", greedy_sql("select pair_id, t, s, wgt from cells", "wgt desc, s, t"))
def greedy_cost(b: Inputs):
    return al.greedy(b.cells, [-F.col("wgt"), F.col("s")])


_BEST = "select pair_id, t, s, p from (select *, row_number() over (partition by pair_id, t order by p desc, s desc) as k from {rows} where s>=0) z where k=1"
k.cte("fwd_best", _BEST.format(rows="fwd"))
k.cte("fwd_null", "select pair_id, t, p as pn from fwd where s<0")


@query("A3_argmax_decode", "select b.pair_id, b.t, b.s from fwd_best b join fwd_null n using(pair_id, t) where b.p>n.pn")
def argmax(b: Inputs):
    return al.argmax(b.fwd).select("pair_id", "t", "s")


@query("A3_raw_decode", "select pair_id, t, s from fwd_head where s>=0")
def raw(b: Inputs):
    return al.raw_decode(b.fwd).select("pair_id", "t", "s")


_CLAIM = "select f.pair_id, f.t, f.s, f.p from fwd f join fwd_null n on n.pair_id=f.pair_id and n.t=f.t where f.s>=0 and f.p>n.pn"


@query("A4_greedy_cap1", greedy_sql(_CLAIM, "p desc, t, s"))
def greedy1(b: Inputs):
    return al.greedy_rows(b.fwd)


@query("A4_greedy_cap2", greedy_sql(_CLAIM, "p desc, t, s", 2))
def greedy2(b: Inputs):
    return al.greedy_rows(b.fwd, cap=2)


@query("A4_greedy_best_cell", """select pair_id, t, s from (select *, row_number() over (partition by pair_id, s order by p desc, t desc) as k2
   from fwd_best where p>0.3) z where k2=1""")
def greedy_best(b: Inputs):
    return al.greedy_best_cell(b.fwd, 0.3)


@query("A5_hungarian_value", best_value_sql("select pair_id, t, s, p from fwd", "round(max(d.v),6) as value"))
def hungarian_value(b: Inputs):
    return al.assignment_value(al.hungarian(b.fwd), b.fwd)


@query("A5_hungarian_with_nulls")
def hungarian(b: Inputs):
    return al.hungarian(b.fwd)


k.cte("sym", """select coalesce(f.pair_id,r.pair_id) as pair_id, coalesce(f.t,r.t) as t, coalesce(f.s,r.s) as s, (coalesce(f.p,0.0)+coalesce(r.p,0.0))*0.5 as p
   from (select * from fwd where s>=0) f full join (select * from rev where t>=0) r on f.pair_id=r.pair_id and f.t=r.t and f.s=r.s
   union all select pair_id, t, s, p from fwd where s<0""")


@query("A6_bidirectional_average", "select pair_id, t, s, round(p,6) as p from sym")
def average(b: Inputs):
    return al.average(b.fwd, b.rev).select("pair_id", "t", "s", F.round("p", 6).alias("p"))


@query("A7_threshold_rows", "select pair_id, t, s, round(p,6) as p from sym where s<0 or p>=0.4")
def threshold_rows(b: Inputs):
    return al.with_threshold(al.average(b.fwd, b.rev), 0.4).select("pair_id", "t", "s", F.round("p", 6).alias("p"))


@query("A7_threshold_decode", f"""select pair_id, t, s from ({_BEST.format(rows='sym')}) y where p>=0.4""")
def threshold_decode(b: Inputs):
    return al.threshold_decode(al.average(b.fwd, b.rev), 0.4).select("pair_id", "t", "s")


@query("A8_default_value", best_value_sql("select pair_id, t, s, p from sym where s<0 or p>=0.4", "round(max(d.v),6) as value"))
def default_value(b: Inputs):
    return al.assignment_value(al.default_decode(b.fwd, b.rev, 0.4), al.with_threshold(al.average(b.fwd, b.rev), 0.4))


@query("A8_default_decode")
def default(b: Inputs):
    return al.default_decode(b.fwd, b.rev, 0.4)


@query("A9_mutual_best", "select pair_id, t, s, round(p,6) as p from pred")
def mutual(b: Inputs):
    return b.pred.select("pair_id", "t", "s", F.round("p", 6).alias("p"))


@query("A9_mutual_threshold", "select pair_id, t, s from pred where p>=0.5")
def mutual_threshold(b: Inputs):
    return al.mutual_best(b.fwd, b.rev, theta=0.5).select("pair_id", "t", "s")


_INTER = "select f.pair_id, f.t, f.s, f.p from fwd f join rev r on r.pair_id=f.pair_id and r.t=f.t and r.s=f.s where f.s>=0 and f.t>=0 and f.p>0.3 and r.p>0.3"


@query("A10_intersection", f"select pair_id, t, s, row_number() over (partition by pair_id, t order by p desc, s desc)::INT as rank from ({_INTER}) z")
def intersection(b: Inputs):
    return al.intersect_links(b.fwd, b.rev, 0.3)


def _grow_sql(final: str) -> str:
    word, source = "len(list_filter(w.g, lambda a: a.t=x.t))>0", "len(list_filter(w.g, lambda a: a.s=x.s))>0"
    beside = "len(list_filter(w.g, lambda a: abs(a.t-x.t)<=1 and abs(a.s-x.s)<=1))>0"
    used = f"({word} or {source})" if final == "and" else f"({word} and {source})"
    am = "select b.pair_id, b.t, b.s from (select pair_id, {by}, {o}, row_number() over (partition by pair_id, {by} order by p desc, {o} desc) as k, p from {rows} where {o}>=0) b join (select pair_id, {by}, p as pn from {rows} where {o}<0) n on n.pair_id=b.pair_id and n.{by}=b.{by} where b.k=1 and b.p>n.pn"
    f, r = am.format(by="t", o="s", rows="fwd"), am.format(by="s", o="t", rows="rev")
    return f"""with recursive pt as materialized (select pair_id, t, s, count(*) as k from (select * from ({f}) a union all select * from ({r}) b) z group by 1,2,3),
   one as materialized (select pair_id, t, s, row_number() over (partition by pair_id order by t, s) as i from pt where k=1),
   w as (select pair_id, coalesce(list({{'t': t, 's': s}}) filter (k=2), []) as g, true as more from pt group by pair_id union all
     select w.pair_id, case when c.t is not null then list_append(w.g, {{'t': c.t, 's': c.s}}) else w.g end, c.t is not null
     from w left join lateral (select x.t, x.s from one x where x.pair_id=w.pair_id and not list_contains(w.g, {{'t': x.t, 's': x.s}}) and not ({word} and {source}) and {beside} order by x.t, x.s limit 1) c on true where w.more),
   v as (select pair_id, 0::BIGINT as i, g from w where not more union all
     select w.pair_id, x.i, case when list_contains(w.g, {{'t': x.t, 's': x.s}}) or {used} then w.g else list_append(w.g, {{'t': x.t, 's': x.s}}) end from v w join one x on x.pair_id=w.pair_id and x.i=w.i+1),
   e as (select pair_id, unnest(g) as q from (select *, row_number() over (partition by pair_id order by i desc) as k from v) z where k=1)
   select e.pair_id, q.t::INT as t, q.s::INT as s, row_number() over (partition by e.pair_id, q.t order by coalesce(f.p,0) desc, q.s desc)::INT as rank
   from e left join fwd f on f.pair_id=e.pair_id and f.t=q.t and f.s=q.s"""


@query("A11_grow_diag_final_and", _grow_sql("and"))
def grow_and(b: Inputs):
    return al.grow_diag_final(b.fwd, b.rev)


@query("A11_grow_diag_final", _grow_sql("or"))
def grow_or(b: Inputs):
    return al.grow_diag_final(b.fwd, b.rev, final="or")


def _ent(rows: str, by: str) -> str:
    return f"""select pair_id, {by}, sum(case when p>1e-12 then -(p/z)*ln(p/z) else 0 end)/greatest(ln(greatest(count(*),2)),1e-9) as h
      from (select *, sum(case when p>1e-12 then p end) over (partition by pair_id, {by}) as z from {rows}) e group by pair_id, {by}"""


_ENTF = f"""select f.pair_id, f.t, f.s, f.p from fwd f join ({_ent('fwd','t')}) a on a.pair_id=f.pair_id and a.t=f.t
   left join ({_ent('rev','s')}) c on c.pair_id=f.pair_id and c.s=f.s where f.s>=0 and least(a.h, coalesce(c.h,1.0))<=0.8
   union all select * from fwd where s<0"""


@query("A12_entropy_filter", f"select pair_id, t, s, round(p,6) as p from ({_ENTF}) z")
def entropy(b: Inputs):
    return al.entropy_filter(b.fwd, b.rev, 0.8).select("pair_id", "t", "s", F.round("p", 6).alias("p"))


@query("A12_compose", f"select pair_id, t, s from ({_INTER}) i where (pair_id, t, s) in (select pair_id, t, s from ({_ENTF}) z) union all select pair_id, t, s from fwd where s<0")
def compose(b: Inputs):
    return al.compose(al.intersect(b.fwd, b.rev, 0.3), al.entropy_filter(b.fwd, b.rev, 0.8)).select("pair_id", "t", "s")


@query("A13_null_scale", """select pair_id, t, s, round(e/sum(e) over (partition by pair_id, t),6) as p from (select *, case when s<0 then p*3 else p end as e from fwd) z""")
def null_scale(b: Inputs):
    return al.null_scale(b.fwd, 3.0).select("pair_id", "t", "s", F.round("p", 6).alias("p"))


def _shift(rows: str) -> str:
    return f"""select pair_id, t, s, round(e/sum(e) over (partition by pair_id, t),6) as p from (select *, exp(v-max(v) over (partition by pair_id, t)) as e from ({rows}) x) y"""


@query("A14_identity_bonus", _shift("""select f.pair_id, f.t, f.s, ln(greatest(p,1e-12))+case when x.norm=r.norm then 2.0 else 0.0 end as v from fwd f
   join rwords r on r.pair_id=f.pair_id and r.t=f.t left join swords x on x.pair_id=f.pair_id and x.s=f.s"""))
def identity(b: Inputs):
    return al.identity_bonus(b.fwd, b.rwords, b.swords, 2.0).select("pair_id", "t", "s", F.round("p", 6).alias("p"))


k.cte("lemma_sim", "select pair_id, t, s, case when same_form=1 or same_lemma=1 then 1.0 when cos_missing=0 then round(cos,9) end as sim from evidence where lemma_missing=0")
_RR = """select f.pair_id, f.t, f.s, f.p, case when f.s>=0 and row_number() over (partition by f.pair_id, f.t, f.s>=0 order by f.p desc, f.s)<=3 then 0.5*coalesce(l.sim,0.0) else 0.0 end as bonus
   from fwd f left join lemma_sim l on l.pair_id=f.pair_id and l.t=f.t and l.s=f.s"""


def _lemma_sims(b: Inputs):
    return b.cell_evidence.filter("lemma_missing = 0").select(
        "pair_id", "t", "s",
        F.when((F.col("same_form") == 1) | (F.col("same_lemma") == 1), 1.0).when(F.col("cos_missing") == 0, F.round("cos", 9)).alias("sim"),
    )


@query("A15_lemma_rerank_linear", f"select pair_id, t, s, round((p+bonus)/sum(p+bonus) over (partition by pair_id, t),6) as p from ({_RR}) z")
def rerank_linear(b: Inputs):
    return al.lemma_rerank(b.fwd, _lemma_sims(b), weight=0.5, top_k=3, logit=False).select("pair_id", "t", "s", F.round("p", 6).alias("p"))


@query("A15_lemma_rerank_logit", _shift(f"select pair_id, t, s, ln(greatest(p,1e-12))+bonus as v from ({_RR}) q"))
def rerank_logit(b: Inputs):
    return al.lemma_rerank(b.fwd, _lemma_sims(b), weight=0.5, top_k=3, logit=True).select("pair_id", "t", "s", F.round("p", 6).alias("p"))


@query("A16_decode_stack")
def stack(b: Inputs):
    rows = al.identity_bonus(b.fwd, b.rwords, b.swords, 2.0)
    rows = al.lemma_rerank(rows, _lemma_sims(b), weight=0.5, top_k=3, logit=False)
    rows = al.rater_bonus(al.null_scale(rows, 1.5), b.gold, 0.1)
    return al.default_decode(rows, b.rev, 0.4)


k.cte("frag", """select pair_id, blk, min(t) as t0, max(t) as t1, min(s) as s_lo, max(s) as s_hi from (
   select *, sum(nw) over (partition by pair_id order by t rows unbounded preceding) as blk from (
     select pair_id, t, s, case when s-lag(s) over (partition by pair_id order by t) between -1 and 4 then 0 else 1 end as nw from pred) a) b group by pair_id, blk""")


@query("A17_fragments", "select pair_id, blk::BIGINT as blk, t0, t1, s_lo, s_hi from frag")
def fragments(b: Inputs):
    return al.fragments(b.pred)


@query("A18_residual_region", """with f as (select w.pair_id, w.t, w.n_s from rwords w where (pair_id, t) not in (select pair_id, t from pred)
     and pair_id in (select pair_id from frag)),
   x as (select f.*, (select min((s_lo, s_hi)) from frag i where i.pair_id=f.pair_id and i.t0<f.t and f.t<i.t1) as ins,
     (select arg_max((s_lo, s_hi), t1) from frag l where l.pair_id=f.pair_id and l.t1<f.t) as lf,
     (select arg_min((s_lo, s_hi), t0) from frag r where r.pair_id=f.pair_id and r.t0>f.t) as rg from f),
   y as (select pair_id, t, case when ins is not null then ins[1] when lf is not null and rg is not null then
       case when lf[2]<rg[1] then lf[2]+1 when rg[2]<lf[1] then rg[2]+1 end when lf is not null then lf[2]+1 when rg is not null then 0 end as lo,
     case when ins is not null then ins[2] when lf is not null and rg is not null then
       case when lf[2]<rg[1] then rg[1]-1 when rg[2]<lf[1] then lf[1]-1 end when lf is not null then n_s-1 when rg is not null then rg[1]-1 end as hi from x)
   select pair_id, t, lo::INT as lo, hi::INT as hi from y where lo is not null""")
def residual(b: Inputs):
    return al.residual_regions(b.pred, b.rwords)


@query("A19_fragment_decode")
def fragment_decode(b: Inputs):
    return al.fragment_decode(b.fwd, b.rev, b.rwords, theta=0.5)


@query("A20_split_repair", """with h as (select pair_id, s, max(t) as h from pred group by 1,2),
   c as (select b.pair_id, b.t, b.s, h.h from fwd_best b join h on h.pair_id=b.pair_id and h.s=b.s where b.p>=0.15 and abs(h.h-b.t)=1
     and (b.pair_id, b.t) not in (select pair_id, t from pred)),
   d as (select c.pair_id, c.t, c.s, x.norm as ns, case when c.t<c.h then a.norm||z.norm else z.norm||a.norm end as both_
     from c join rwords a on a.pair_id=c.pair_id and a.t=c.t join rwords z on z.pair_id=c.pair_id and z.t=c.h join swords x on x.pair_id=c.pair_id and x.s=c.s)
   select pair_id, t, s from d where both_<>'' and (starts_with(ns,both_) or starts_with(both_,ns))""")
def split_repair(b: Inputs):
    return al.split_repair(b.pred, b.fwd, b.rwords, b.swords, 0.15)


GRID = [round(0.05 * i, 2) for i in range(1, 20)]


@query("A21_tune_null_threshold", f"""with w as (select coalesce(b.s,-1) as s, coalesce(b.p,-1) as p, coalesce(g.s,-1) as g from rwords r
     left join fwd_best b on b.pair_id=r.pair_id and b.t=r.t left join gold g on g.pair_id=r.pair_id and g.t=r.t),
   sc as (select theta, sum((p>=theta and s=g and g>=0)::INT) as tp, sum((p>=theta)::INT) as a, sum((g>=0)::INT) as gg,
     sum(((p>=theta and s=g and g>=0) or (p<theta and g<0))::INT) as r, count(*) as n from w, (select unnest({GRID})::DOUBLE as theta) th group by theta),
   q as (select theta, r::DOUBLE/n as token_accuracy, 2.0::DOUBLE*tp/(a+gg) as link_f1 from sc)
   select theta, round(token_accuracy,6) as token_accuracy, round(link_f1,6) as link_f1, (select theta from q order by token_accuracy desc, theta desc limit 1) as best_accuracy,
     (select theta from q order by link_f1 desc, theta desc limit 1) as best_f1 from q""")
def tune(b: Inputs):
    return al.tune_theta(b.fwd, b.rwords, b.gold, GRID).withColumn("token_accuracy", F.round("token_accuracy", 6)).withColumn("link_f1", F.round("link_f1", 6))


def _mb(v: str) -> str:
    return f"""select pair_id, t, s from (select *, row_number() over (partition by pair_id, t order by v desc, s) as ka,
      row_number() over (partition by pair_id, s order by v desc, t) as kb from ({v}) m) z where ka=1 and kb=1 and v>0"""


@query("A22_itermax", f"""with one as ({_mb('select pair_id, t, s, wgt::DOUBLE as v from cells')}),
   two as ({_mb("""select c.pair_id, c.t, c.s, case when a.t is not null and z.s is not null then 0 when a.t is not null or z.s is not null then c.wgt*0.9::DOUBLE else c.wgt end::DOUBLE as v
     from cells c left join (select distinct pair_id, t from one) a on a.pair_id=c.pair_id and a.t=c.t left join (select distinct pair_id, s from one) z on z.pair_id=c.pair_id and z.s=c.s""")})
   select * from one union select * from two""")
def itermax(b: Inputs):
    return al.itermax(b.cells.select("pair_id", "t", "s", F.col("wgt").cast("double").alias("v")))


def _sinkhorn_sql(iters: int) -> str:
    parts = ["""x0 as (select g.*, case when g.t=g.n_r then 0.0 else coalesce(z.z,-30.0) end::DOUBLE as z, z.z is not null as asked, 0.0::DOUBLE as u, 0.0::DOUBLE as v
       from (select pair_id, n_s, n_r, t, unnest(range(n_s+1))::INT as s from (select pair_id, n_s, n_r, unnest(range(n_r+1))::INT as t from pairs) a) g
       left join (select f.pair_id, f.t, case when f.s<0 then p.n_s else f.s end as s, ln(greatest(f.p,1e-12)) as z from fwd f join pairs p using(pair_id)) z
       on z.pair_id=g.pair_id and z.t=g.t and z.s=g.s)"""]
    mu = "case when t=n_r then ln(n_s)-ln(n_r+n_s) else -ln(n_r+n_s) end"
    nu = "case when s=n_s then ln(n_r)-ln(n_r+n_s) else -ln(n_r+n_s) end"
    for i in range(iters):
        parts.append(f"y{i} as (select * replace ({mu}-ln(sum(exp(z+v)) over (partition by pair_id, t)) as u) from x{i})")
        parts.append(f"x{i+1} as (select * replace ({nu}-ln(sum(exp(z+u)) over (partition by pair_id, s)) as v) from y{i})")
    return "with " + ",\n".join(parts) + f"\nselect pair_id, t, case when s=n_s then -1 else s end as s, round(exp(z+u+v+ln(n_r+n_s)),6) as p from x{iters} where asked"


@query("A23_sinkhorn", _sinkhorn_sql(10))
def sinkhorn(b: Inputs):
    return al.sinkhorn(b.fwd, b.pairs).select("pair_id", "t", "s", F.round("p", 6).alias("p"))


@query("A25_copy_links", "select pair_id, t, s from gold")
def copy_links(b: Inputs):
    return b.gold


@query("A26_floor_rows", """select 'do_nothing' as method, pair_id, t, -1 as s, 'INS' as tag from rwords
   union all select 'gold_links', g.pair_id, g.t, g.s, case when x.norm=r.norm then 'COPY' else 'SUBST' end from gold g
     join rwords r using(pair_id, t) join swords x on x.pair_id=g.pair_id and x.s=g.s
   union all select 'all_insert', pair_id, t, -1, 'INS' from rwords union all select 'all_insert', pair_id, -1, s, 'DEL' from swords""")
def floors(b: Inputs):
    none = b.rwords.select(F.lit("do_nothing").alias("method"), "pair_id", "t", F.lit(-1).alias("s"), F.lit("INS").alias("tag"))
    ins = none.withColumn("method", F.lit("all_insert"))
    dels = b.swords.select(F.lit("all_insert").alias("method"), "pair_id", F.lit(-1).alias("t"), "s", F.lit("DEL").alias("tag"))
    links = al.with_forms(b.gold, b.rwords, b.swords).select(
        F.lit("gold_links").alias("method"), "pair_id", "t", "s", F.when(F.col("sn") == F.col("rn"), "COPY").otherwise("SUBST").alias("tag"))
    return none.unionByName(ins).unionByName(dels).unionByName(links)


@query("A39_ensemble_rows", """select pair_id, t, s, round(p,6) as p from (select *, row_number() over (partition by pair_id, t order by round(p,9) desc, s) as k from (
     select pair_id, t, s, sum(p) as p from (select pair_id, t, s, 0.5*p as p from fwd union all select pair_id, t, s, 0.5*p from resource_rows
       union all select pair_id, t, s, 0.3 from gold) u group by all) y) z where k<=6 or s<0""")
def ensemble(b: Inputs):
    return al.ensemble(b.fwd, ev.resource_rows(b.tiers, b.rwords), b.gold, beta=0.3)


k.cte("agreed", """select a.pair_id, a.t, a.s, (a.p+b.p)*0.5 as p, r.norm<>x.norm as changed from fwd_head a join rev_head b on b.pair_id=a.pair_id and b.t=a.t and b.s=a.s
   join rwords r on r.pair_id=a.pair_id and r.t=a.t join swords x on x.pair_id=a.pair_id and x.s=a.s where a.s>=0 and (a.p+b.p)*0.5>=case when r.norm<>x.norm then 0.3 else 0.5 end""")


def _agreed(b: Inputs):
    return al.agreed_edges(b.fwd, b.rev, b.rwords, b.swords, tau=0.5, tau_changed=0.3)


@query("A41_agreed_edges", "select pair_id, t, s, round(p,4) as p, changed from agreed")
def agreed(b: Inputs):
    return _agreed(b).withColumn("p", F.round("p", 4))


k.cte("framed", """select e.* from (select *, count(*) over (partition by pair_id) as n from agreed) e where not changed or (n>=3 and exists (
   select 1 from agreed o where o.pair_id=e.pair_id and o.t<>e.t and abs(o.t-e.t)<=2 and o.s<>e.s and (o.s>e.s)=(o.t>e.t) and abs((o.s-e.s)-(o.t-e.t))<=3))""")


@query("A42_framed_edges", "select pair_id, t, s, changed from framed")
def framed(b: Inputs):
    return al.framed_edges(_agreed(b)).select("pair_id", "t", "s", "changed")
