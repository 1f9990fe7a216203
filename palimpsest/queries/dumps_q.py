"""Prediction dumps written and read back (S14), decoded anew (A40), and taken as teacher labels (S20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import align as al
from palimpsest.operators import typing_ as ty
from palimpsest.plans.base import Inputs
from palimpsest.plans.lineage import cut
from palimpsest.queries import io_q
from palimpsest.queries import sqlkit as k
from palimpsest.queries.align_q import best_value_sql
from palimpsest.queries.registry import query
from palimpsest.sources import dumps

THETA = 0.3
#: Cells this alike are edges of a word beside its link.
EXTRA = 700

k.cte("dump_extra", f"select c.pair_id, c.t, c.s, 'COPY' as op from cells c join words_p w on w.pair_id=c.pair_id and w.t=c.t where w.s>=0 and c.s<>w.s and c.wgt>={EXTRA}")
k.cte("dump_fwd", f"select pair_id, t, s, round(p,{dumps.DIGITS}) as p from (select *, row_number() over (partition by pair_id, t order by p desc, s) as r from fwd) z where r<={dumps.TOP_K}")
k.cte("dump_rev", f"select pair_id, t, s, round(p,{dumps.DIGITS}) as p from (select *, row_number() over (partition by pair_id, s order by p desc, t) as r from rev) z where r<={dumps.TOP_K}")
k.cte("dump_sym", f"""with m as (select coalesce(f.pair_id,r.pair_id) as pair_id, coalesce(f.t,r.t) as t, coalesce(f.s,r.s) as s, (coalesce(f.p,0.0)+coalesce(r.p,0.0))*0.5::DOUBLE as p
     from (select * from dump_fwd where s>=0) f full join (select * from dump_rev where t>=0) r on f.pair_id=r.pair_id and f.t=r.t and f.s=r.s
     union all select pair_id, t, s, p from dump_fwd where s<0)
   select pair_id, t, s, p from m where s<0 or p>={THETA} union all select pair_id, t, -1, {THETA}::DOUBLE from m group by 1,2 having min(s)>=0""")


def dump(b: Inputs):
    """The dump of the predicted scripts, through a file."""
    if not hasattr(b, "_dump"):
        links = b.pred.select("pair_id", "t", "s", "p")
        words = b.words.select("pair_id", "t", "s", "tag", "frame").join(links, ["pair_id", "t", "s"], "left")
        held = b.words.filter("s >= 0").select("pair_id", "t", F.col("s").alias("own"))
        extra = b.cells.filter(F.col("wgt") >= EXTRA).join(held, ["pair_id", "t"]).filter("s <> own").select("pair_id", "t", "s", F.lit("COPY").alias("op"))
        out = dumps.dump_table(b.pairs, words, extra, b.fwd, b.rev, {"decode": "mutual"})
        b._dump = dumps.read_dump(b.spark, io_q._written(b, out))
    return b._dump


@query("S14_dump_words", f"select w.pair_id, w.t, w.s, w.tag, w.frame, round(p.p,{dumps.DIGITS}) as p from words_p w left join pred p on p.pair_id=w.pair_id and p.t=w.t and p.s=w.s")
def words(b: Inputs):
    return dumps.dump_words(dump(b))


@query("S14_dump_extra_edges", "select pair_id, t as r, s, op from dump_extra")
def extra(b: Inputs):
    return dumps.dump_extra(dump(b))


@query("S14_dump_rows", "select 'top' as side, * from dump_fwd union all select 'rev_top', * from dump_rev")
def rows(b: Inputs):
    side = lambda name, reverse: dumps.dump_rows(dump(b), reverse=reverse).select(F.lit(name).alias("side"), "*")
    return side("top", False).unionByName(side("rev_top", True))


@query("S14_dump_spans", """select pair_id, min(t)::INT as start, (max(t)+1)::INT as "end", 'FRAME' as label from (
   select pair_id, t, t-row_number() over (partition by pair_id order by t) as g from words_p where frame=1) z group by pair_id, g""")
def spans(b: Inputs):
    return dumps.dump_spans(dump(b))


@query("S14_dump_deletions", "select pair_id, s from swords where (pair_id, s) not in (select pair_id, s from words_p where s>=0)")
def deletions(b: Inputs):
    return dump(b).select(F.col("id").alias("pair_id"), F.posexplode("pred.dels").alias("s", "gone")).filter("gone = 1").select("pair_id", "s")


def redecoded(b: Inputs):
    if not hasattr(b, "_dump_redecoded"):
        # what comes from a file lies anyhow: its rows are dealt by pair once, and decoded where they lie
        stored = dump(b).select("id", "record", F.struct("pred.top", "pred.rev_top").alias("pred")).repartition(b.n_parts, "id")
        rows_ = cut(al.with_threshold(al.average(dumps.dump_rows(stored), dumps.dump_rows(stored, reverse=True)), THETA), laid=True)
        b._dump_redecoded = rows_, b.deal(al.hungarian(rows_, kept=True))
    return b._dump_redecoded


@query("A40_dump_value", best_value_sql("select pair_id, t, s, p from dump_sym", "round(max(d.v),6) as value"))
def value(b: Inputs):
    rows_, links = redecoded(b)
    return al.assignment_value(links, rows_)


@query("A40_dump_links_lost", "select 0::BIGINT as lost")
def lost(b: Inputs):
    links = redecoded(b)[1]
    typed = ty.rule_type(links, b.evidence_of(links)).select("pair_id", "t", "s")
    return links.join(typed, ["pair_id", "t", "s"], "left_anti").agg(F.count("*").alias("lost"))


@query("S20_distilled_records", """select 'distill/'||p.pair_id as id, count(w.t) filter (w.s>=0) as links, coalesce(string_agg(w.t||'-'||w.s||'-'||w.tag, ' ' order by w.t) filter (w.s>=0), '') as edges,
   'mutual' as teacher from pairs p left join words_p w on w.pair_id=p.pair_id group by p.pair_id""")
def distilled(b: Inputs):
    x = dumps.distilled(dump(b), teacher="mutual")
    edge = F.transform("links", lambda e: F.concat_ws("-", e["r"].cast("string"), e["s"].cast("string"), e["op"]))
    return x.select("id", F.size("links").cast("long").alias("links"), F.array_join(edge, " ").alias("edges"), F.col("provenance")["links"].alias("teacher"))
