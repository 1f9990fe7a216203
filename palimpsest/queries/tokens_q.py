"""Word-level queries (T rows)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import text as tx
from palimpsest.operators import tokens as tk
from palimpsest.plans.base import Inputs
from palimpsest.queries import sqlkit as k
from palimpsest.queries.registry import query


@query("T1_tokenise", "select side, pid, i, surface from all_tok")
def tokenise(b: Inputs):
    return b.tokens.select("side", "pid", "i", "surface")


@query("T2_normalise", "select norm, count(*) as n, count(distinct surface) as surfaces from all_tok group by norm")
def normalise(b: Inputs):
    return b.tokens.groupBy("norm").agg(F.count("*").alias("n"), F.count_distinct("surface").alias("surfaces"))


@query("T3_spelling_key", f"""select key, count(*) as forms, min(surface) as first_form from (
   select surface, {k.key('surface')} as key from (select distinct surface from all_tok) a) z group by key""")
def spelling_keys(b: Inputs):
    forms = b.tokens.select("surface").distinct().withColumn("key", tx.spelling_key(F.col("surface")))
    return forms.groupBy("key").agg(F.count("*").alias("forms"), F.min("surface").alias("first_form"))


_EXT = f"""select pair_id, t, s, sn, rn, {k.extended('sn')} as se, {k.extended('rn')} as re from cells"""


@query("T4_sameness_policies", f"""select pair_id, t, s, sn=rn as same_current, se=re as same_folds,
   se=re or {k.drop_enclitic('se')}={k.drop_enclitic('re')} as same_enclitic,
   se=re or {k.drop_enclitic('se')}={k.drop_enclitic('re')} or
     {k.plural(k.drop_enclitic('se'))}={k.plural(k.drop_enclitic('re'))} as same_plural from ({_EXT}) z""")
def sameness(b: Inputs):
    sn, rn = F.col("sn"), F.col("rn")
    return b.cells.select(
        "pair_id", "t", "s",
        tx.same("current", sn, rn).alias("same_current"),
        tx.same("+folds", sn, rn).alias("same_folds"),
        tx.same("+enclitic", sn, rn).alias("same_enclitic"),
        tx.same("+plural", sn, rn).alias("same_plural"),
    )


@query("T5_ops_under_policy", f"""select r.pair_id, r.t, case when p.s is null then 'INS'
     when {k.extended('x.norm')}={k.extended('r.norm')} or
       {k.drop_enclitic(k.extended('x.norm'))}={k.drop_enclitic(k.extended('r.norm'))} then 'COPY' else 'SUBST' end as op
   from rwords r left join pred p on p.pair_id=r.pair_id and p.t=r.t
   left join swords x on x.pair_id=p.pair_id and x.s=p.s""")
def ops_under_policy(b: Inputs):
    return tk.ops_under_policy(b.rwords, b.swords, b.pred, "+enclitic")


@query("T6_content_words", """select side, pid, token from (select 's' as side, pid, token from src_ct
   union all select 'r', pid, token from reu_ct) z""")
def content_words(b: Inputs):
    from palimpsest.operators.mining import distinct_passages

    parts = [
        distinct_passages(df).select(F.lit(side).alias("side"), "pid", F.explode(tx.content_tokens(F.col("txt"))).alias("token"))
        for side, df in (("s", b.src), ("r", b.reu))
    ]
    return parts[0].unionByName(parts[1])


@query("T7_attested_forms", "select norm, count(*) as n from all_tok where norm<>'' group by norm having count(*)>=3")
def attested(b: Inputs):
    return tk.attested_forms(b.tokens)


_CP = lambda tab, idx: f"""select pair_id, {idx} as i, word, norm, {k.key('word')} as key from {tab} where length(norm)>=2"""


@query("T8_counterparts", f"""with a as ({_CP('rwords', 't')}), o as ({_CP('swords', 's')}),
   hit as (select a.pair_id, a.i from a join o on a.pair_id=o.pair_id and a.norm=o.norm
     union select a.pair_id, a.i from a join o on a.pair_id=o.pair_id and a.key=o.key and a.key<>''
     union select a.pair_id, a.i from a join o on a.pair_id=o.pair_id and left(a.norm,4)=left(o.norm,4)
        and length(a.norm)>=4 and length(o.norm)>=4)
   select r.pair_id, r.t as i, h.i is not null as hit from rwords r left join hit h on h.pair_id=r.pair_id and h.i=r.t""")
def counterparts(b: Inputs):
    mine = b.rwords.select("pair_id", F.col("t").alias("i"), "word", "norm")
    other = b.swords.select("pair_id", F.col("s").alias("i"), "word", "norm")
    return tk.counterparts(mine, other).select("pair_id", "i", "hit")
