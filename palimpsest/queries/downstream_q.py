"""Feature rows (G20) and classifiers on them (C22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import downstream as ds
from palimpsest.plans.base import Inputs
from palimpsest.plans.lineage import cut
from palimpsest.queries import script_q
from palimpsest.queries.registry import query

SQL = f"""with rn as (select pair_id, max(n) as longest_run, count(*) as n_runs from (select pair_id, count(*) as n from (select pair_id, t-row_number() over (partition by pair_id order by t) as g from words_p where s>=0) a group by pair_id, g) b group by 1),
   q as (select pair_id, max(b-a+1) as longest_quote, count(*) as n_quotes, sum(b-a+1) as quoted from ({script_q._quote('words_p', 4)}) z group by 1),
   c as (select pair_id, count(*) as n_links, sum((tag='COPY')::INT) as cp, sum((tag='MORPH')::INT) as mo, sum((tag='SUBST')::INT) as su from words_p where s>=0 group by 1),
   f as (select pair_id, sum(frame) as n_frame, sum((s<0 and frame=0)::INT) as ins from words_p group by 1), p as (select pair_id, avg(p) as pm, min(p) as pn from pred group by 1)
   select x.pair_id, x.n_r as n_t, x.n_s, c.n_links, round(c.n_links::DOUBLE/x.n_r,6) as link_rate_t, rn.longest_run, rn.n_runs, round(cp::DOUBLE/c.n_links,6) as copy_share, round(mo::DOUBLE/c.n_links,6) as morph_share,
     round(su::DOUBLE/c.n_links,6) as subst_share, round(ins::DOUBLE/x.n_r,6) as ins_rate, round((x.n_s-c.n_links)::DOUBLE/x.n_s,6) as del_rate, coalesce(longest_quote,0)::BIGINT as longest_quote, coalesce(n_quotes,0)::BIGINT as n_quotes,
     round(coalesce(quoted,0)::DOUBLE/x.n_r,6) as quote_rate, n_frame::BIGINT as n_frame, round(pm,6) as p_mean, round(pn,6) as p_min, round(x.n_r::DOUBLE/x.n_s,6) as len_ratio
   from pairs x join c using(pair_id) join rn using(pair_id) join f using(pair_id) join p using(pair_id) left join q using(pair_id)"""
COLS = ("pair_id", "n_t", "n_s", "n_links", "link_rate_t", "longest_run", "n_runs", "copy_share", "morph_share", "subst_share", "ins_rate", "del_rate",
        "longest_quote", "n_quotes", "quote_rate", "n_frame", "p_mean", "p_min", "len_ratio")


@query("G20_feature_rows", SQL)
def features(b: Inputs):
    return ds.feature_rows(b.words, b.pred, b.pairs).filter("n_links > 0").select(*COLS)


def _rows(b: Inputs):
    return cut(ds.feature_rows(b.words, b.pred, b.pairs))


@query("C22_reference_classifier")
def classifier(b: Inputs):
    return ds.classify(_rows(b)).select("pair_id", "gold", F.round("score", 4).alias("score"))


@query("C22_boosted_trees")
def trees(b: Inputs):
    return ds.classify(_rows(b), trees=True).select("pair_id", "gold", F.round("score", 4).alias("score"))


@query("C22_type_macro_f1")
def type_macro_f1(b: Inputs):
    return ds.type_macro_f1(_rows(b))


@query("C22_coefficients")
def coefficients(b: Inputs):
    return ds.coefficients(_rows(b))
