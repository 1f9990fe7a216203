"""Candidate mining, pools, negatives and splits (M rows)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import text as tx
from palimpsest.operators import lexicon as lx
from palimpsest.operators import mining as mn
from palimpsest.operators import negatives as ng
from palimpsest.plans.base import Inputs
from palimpsest.queries import sqlkit as k
from palimpsest.queries.registry import query


@query("M1_overlap_pairs", """select m.c, m.q, n_shared from mined m
   where r_txt not in (select txt from gold_texts) and s_txt not in (select txt from gold_texts)""")
def overlap(b: Inputs):
    return mn.overlap_pairs(b.src, b.reu, gold=b.gold_texts).select("c", "q", "n_shared")


@query("M2_guard_report", """select coalesce(reason,'kept') as reason, count(*) as n from (
   select case when a.txt=b.txt then 'dropped_empty_or_identical'
     when a.txt in (select txt from gold_texts) or b.txt in (select txt from gold_texts) then 'dropped_gold_passage'
     when a.n not between 6 and 80 or b.n not between 6 and 80 then 'dropped_length' end as reason
   from mined_all m join src_u a on a.pid=m.c join reu_u b on b.pid=m.q where m.n_shared>=2) z group by all""")
def guard_report(b: Inputs):
    c, q = mn.distinct_passages(b.src), mn.distinct_passages(b.reu)
    counts = mn.shared_counts(c, q, min_shared=2, max_df=2000)
    cands = counts.join(c.select(F.col("pid").alias("c"), F.col("txt").alias("source")), "c").join(
        q.select(F.col("pid").alias("q"), F.col("txt").alias("reuse")), "q"
    )
    out = mn.guard_pairs(cands, b.gold_texts)
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("M3_length_bounded_texts", """select side, pid, n from (select 's' as side, pid, n from src_p
   union all select 'r', pid, n from reu_p) z where n between 6 and 23""")
def length_bounded(b: Inputs):
    cols = ["side", "pid", "n"]
    both = b.src.withColumn("side", F.lit("s")).select(cols).unionByName(b.reu.withColumn("side", F.lit("r")).select(cols))
    return both.filter(F.col("n").between(6, 23))


@query("M4_best_k_per_query", """select q, c, n_shared, rank from (select q, c, n_shared,
   row_number() over (partition by q order by n_shared desc, c) as rank from mined) z where rank<=5""")
def best_k(b: Inputs):
    return mn.best_k(b.mined, 5).select("q", "c", "n_shared", "rank")


@query("M5_ranked_pairs", """with recursive ord as (select id, source, reuse, row_number() over (order by p desc, id) as i
     from scored where p>=0.9),
   walk as (select 0::BIGINT as i, []::VARCHAR[] as rs, []::VARCHAR[] as ss, []::VARCHAR[] as ids
     union all select o.i,
       case when ok then list_append(w.rs, md5(o.reuse)) else w.rs end, case when ok then list_append(w.ss, md5(o.source)) else w.ss end,
       case when ok then list_append(w.ids, o.id) else w.ids end
     from walk w join ord o on o.i=w.i+1,
     lateral (select not list_contains(w.rs, md5(o.reuse)) and len(list_filter(w.ss, lambda x: x=md5(o.source)))<3 as ok) l)
   select unnest(ids) as id from (select ids from walk order by i desc limit 1) z""")
def ranked(b: Inputs):
    return mn.ranked_pairs(b.scored).select("id")


@query("M6_graded_selection", """select 'a_'||id as id, case when n_shared>=4 then 'grade4' else 'grade3' end as stratum,
   n_shared::DOUBLE as score from scored where n_shared>=3 and reuse not in (select txt from gold_texts)
   and source not in (select txt from gold_texts)""")
def graded(b: Inputs):
    return _graded(b).select("id", "stratum", "score")


def _graded(b: Inputs):
    kept = mn.guard_pairs(b.scored.filter("n_shared >= 3"), b.gold_texts).filter("reason is null")
    return kept.select(
        F.concat(F.lit("a_"), "id").alias("id"), "source", "reuse",
        F.when(F.col("n_shared") >= 4, "grade4").otherwise("grade3").alias("stratum"),
        F.col("n_shared").cast("double").alias("score"),
    )


@query("M7_pool_build", """with u as (select 'a_'||id as id, source, reuse, case when n_shared>=4 then 'grade4' else 'grade3' end as stratum, 0 as arr
      from scored where n_shared>=3 and reuse not in (select txt from gold_texts) and source not in (select txt from gold_texts)
    union all select 'm_'||id, source, reuse, 'ranked', 1 from scored where p>=0.5),
   d as (select id, stratum from (select *, row_number() over (partition by source, reuse order by arr, id) r from u) z where r=1)
   select id, stratum, row_number() over (order by md5('1|'||id)) as pos from d""")
def pool(b: Inputs):
    second = b.scored.filter("p >= 0.5").select(
        F.concat(F.lit("m_"), "id").alias("id"), "source", "reuse", F.lit("ranked").alias("stratum"), F.col("p").alias("score")
    )
    return mn.build_pool(_graded(b), second).select("id", "stratum", "pos")


@query("M8_pool_negatives", """with low as (select *, row_number() over (order by md5('1|'||id)) as kb,
     row_number() over (order by md5('2|'||id)) as ka from scored where p<=0.1)
   select 'lexical_low_p' as kind, source, reuse from low where kb<=100
   union all select 'random', source, reuse from (select a.source, z.reuse, a.ka from low a join low z on a.ka=z.kb
     where a.source<>z.reuse order by a.ka limit 100) y""")
def pool_negatives(b: Inputs):
    return mn.pool_negatives(b.scored, 200)


@query("M9_localised_window", """with h as (select pair_id, n_s, n_r, case when n_r>n_s+4 then 'r' when n_s>n_r+4 then 's' end as side,
      case when n_r>n_s+4 then r_norm else s_norm end as lg, case when n_r>n_s+4 then s_norm else r_norm end as sh from wide),
   f as (select *, list_transform(lg, lambda w: list_contains(sh, w)::INT) as hit, least(len(lg), len(sh)+4)::INT as wd from h),
   sc as (select pair_id, unnest(range(0,(len(lg)-wd+1)::INT)) as a, hit, wd from f where side is not null),
   b as (select pair_id, arg_max(a, (list_sum(list_slice(hit,(a+1)::INT,(a+wd)::INT)), -a)) as a from sc group by pair_id)
   select f.pair_id, case when side='r' then b.a else 0 end::INT as r_off, case when side='s' then b.a else 0 end::INT as s_off,
     case when side='r' then wd else n_r end as r_len, case when side='s' then wd else n_s end as s_len
   from f left join b on b.pair_id=f.pair_id""")
def localised(b: Inputs):
    return mn.localise(b.wide).select("pair_id", "r_off", "s_off", "r_len", "s_len")


_TRIES = """select r.id, r.query_txt, r.n_q, r.author, a from neg_rows r, (select unnest([1,2,3,4]) a) t"""
_OK = """c.n between 6 and 60 and d.n_q between 6 and 60 and not exists (select 1 from attested_pairs x where x.txt=c.txt and x.query_txt=d.query_txt)"""
k.cte("neg_index", "select *, row_number() over (partition by author order by md5('easy|'||pid)) as k, count(*) over (partition by author) as n_author from reu_p")
k.cte("neg_draws", f"""select t.*, floor({k.udraw("'0|'||t.id||'|'||t.a")}*z.n_author)::BIGINT+1 as k from ({_TRIES}) t join (select author, count(*) n_author from reu_p group by author) z using(author)""")
k.cte("neg_first", f"""select id, pid from (select d.id, c.pid, row_number() over (partition by d.id order by d.a) as o from neg_draws d join neg_index c on c.author=d.author and c.k=d.k where {_OK}) y where o=1""")
k.cte("neg_easy", f"""select id, pid from neg_first union all
   select id, pid from (select d.id, c.pid, row_number() over (partition by d.id order by (c.k-d.k+c.n_author)%c.n_author) as o
     from neg_draws d join neg_index c on c.author=d.author where d.a=1 and d.id not in (select id from neg_first) and {_OK}) y where o=1""")
k.cte("neg_lexical", f"""select id, pid, n_shared from (select d.id, c.pid, s.n_shared,
     row_number() over (partition by d.id order by s.n_shared desc, c.pid) as o
   from neg_rows d join (select q.id, f.pid, count(*) as n_shared from
       (select distinct id, author, unnest(query_norm) f from neg_rows) q
       join (select distinct author, pid, {k.norm('w')} as f from (select author, pid, unnest(toks) w from reu_p) x) f
         on f.author=q.author and f.f=q.f group by all) s on s.id=d.id
   join reu_p c on c.pid=s.pid where c.txt<>d.cited_txt and {_OK}) y where o=1""")
k.cte("neg_adjacent", f"""select id, pid from (select d.id, c.pid, row_number() over (partition by d.id order by md5('0|'||d.id||'|'||d.step)) as o
   from (select *, unnest([-1,1]) as step from neg_rows) d join reu_p c on c.work=d.cited_pid//1000000 and c.seg=d.cited_pid%1000000+d.step
   where {_OK}) y where o=1""")


def _easy(b: Inputs):
    return ng.easy(b.neg_rows, b.neg_corpus, b.attested_pairs)


def _lexical(b: Inputs):
    return ng.lexical(b.neg_rows, b.neg_corpus, b.attested_pairs)


def _adjacent(b: Inputs):
    return ng.adjacent(b.neg_rows, b.neg_corpus, b.attested_pairs)


@query("M12_negatives_easy", "select id, pid from neg_easy")
def easy(b: Inputs):
    return _easy(b)


@query("M13_negatives_lexical", "select id, pid, n_shared from neg_lexical")
def lexical(b: Inputs):
    return _lexical(b)


@query("M14_negatives_adjacent", "select id, pid from neg_adjacent")
def adjacent(b: Inputs):
    return _adjacent(b)


_held = f"select {k.norm('s_txt')} as nk from pairs where fold=0 union select {k.norm('r_txt')} from pairs where fold=0"
k.cte("neg_batch", f"""select kind, id, pid, k from (select kind, id, pid, row_number() over (partition by kind order by md5('0|'||kind||'|'||id)) as k
  from (select kind, id, pid, row_number() over (partition by txt, query_txt order by o, id, kind, pid) as r from (
     select u.*, n.query_txt, c.txt from (select 'easy' as kind, 0 as o, id, pid from neg_easy union all
       select 'lexical', 1, id, pid from neg_lexical union all select 'adjacent', 2, id, pid from neg_adjacent) u
     join neg_rows n on n.id=u.id join reu_p c on c.pid=u.pid) z
   where {k.norm('query_txt')} not in (select nk from ({_held}) h1) and {k.norm('txt')} not in (select nk from ({_held}) h2)) y
  where r=1) x where k<=33""")


def _batch(b: Inputs):
    held = b.pairs.filter("fold = 0").select(F.explode(F.array("s_txt", "r_txt")).alias("x")).select(tx.normalize(F.col("x")).alias("nkey"))
    parts = {"easy": _easy(b), "lexical": _lexical(b), "adjacent": _adjacent(b)}
    return ng.batch(parts, b.neg_rows, b.neg_corpus, held, 100)


@query("M15_negatives_batch", "select kind, id, pid, k from neg_batch")
def batch(b: Inputs):
    return _batch(b)


_OK16 = "c.n>=4 and d.n_q>=4 and not exists (select 1 from attested_pairs x where x.txt=c.txt and x.query_txt=d.query_txt)"


@query("M16_author_mismatch", f"""with src as (select distinct author, r_pid as pid, r_txt as txt, n_r as n from pairs where fold<>0),
   ranked as materialized (select *, row_number() over (partition by author order by md5('42|'||pid)) k, count(*) over (partition by author) as n_author from src),
   dr as materialized (select q.query_txt, q.author, len(string_split(q.query_txt,' ')) as n_q, a, floor({k.udraw("'42|'||q.query_txt||'|'||q.author||'|'||a")}*z.n_author)::BIGINT+1 as k
     from (select distinct s_txt as query_txt, author from pairs where fold<>0) q
     join (select author, count(*) n_author from src group by author) z using(author), (select unnest([1,2,3]) a) t),
   hit as materialized (select distinct d.query_txt, d.author, c.pid from dr d join ranked c on c.author=d.author and c.k=d.k where {_OK16}),
   more as (select query_txt, author, pid from (select d.query_txt, d.author, c.pid, row_number() over (partition by d.query_txt, d.author order by (c.k-d.k+c.n_author)%c.n_author) as o
     from dr d join ranked c on c.author=d.author where d.a=1 and (d.query_txt, d.author) not in (select query_txt, author from hit) and {_OK16}) y where o=1)
   select query_txt, author, pid from (select * from hit union all select * from more) z order by md5('42|'||query_txt||'|'||pid) limit 150""")
def mismatch(b: Inputs):
    train = b.pairs.filter("fold <> 0")
    src = train.select("author", F.col("r_pid").alias("pid"), F.col("r_txt").alias("txt"), F.col("n_r").alias("n")).distinct()
    queries = train.select(F.col("s_txt").alias("query_txt"), "author")
    return ng.author_mismatch(queries, src, b.attested_pairs, 150).select("query_txt", "author", "pid")


@query("M17_link_density", """select pair_label, round(avg(coalesce(k,0)::DOUBLE/n_r),6) as density from pairs p
   left join (select pair_id, count(distinct t) k from gold group by 1) g on g.pair_id=p.pair_id group by pair_label""")
def density(b: Inputs):
    return ng.density_by_type(b.pairs, b.gold)


@query("M18_safe_seeds", """select s_txt from pairs group by s_txt having count(distinct fold)=1 and max((fold=0)::INT)=0 and max(n_s)>=4""")
def seeds(b: Inputs):
    return ng.safe_seeds(b.pairs, 0)


@query("M19_nested_fold_split", """select role, fold, count(*) as n from (select fold, case fold when 2 then 'test' when 3 then 'dev'
   else 'train' end as role from pairs) z group by all""")
def fold_roles(b: Inputs):
    return mn.nested_fold_roles(b.pairs, 2).groupBy("role", "fold").agg(F.count("*").alias("n"))


@query("M20_grouped_validation", """with g as (select r_txt, count(*) n from pairs group by 1),
   c as (select r_txt, sum(n) over (order by md5('1|'||r_txt), r_txt rows unbounded preceding)-n as before, sum(n) over () as total from g)
   select pair_id as id, case when before<0.2*total then 'valid' else 'fit' end as side from pairs join c using(r_txt)""")
def validation(b: Inputs):
    return mn.grouped_validation(b.pairs.select(F.col("pair_id").alias("id"), F.col("r_txt").alias("grp"))).select("id", "side")


@query("M21_nested_sample", """with s as (select pair_label as label, count(*) size from pairs group by 1),
   p as (select label, size, least(round_even(100.0::DOUBLE*size/sum(size) over (),0)::BIGINT, size) as take, sum(size) over () as total,
      row_number() over (order by size desc, label)=1 as big from s),
   p2 as (select *, sum(take) over () as got, least(100, total) as want,
      coalesce(sum(take) over (order by label desc rows between unbounded preceding and 1 preceding),0) as after from p),
   p3 as (select label, take - least(take, greatest(greatest(got-want,0)-after,0)) + case when big then greatest(want-got,0) else 0 end as take from p2)
   select id, r.label, rn from (select pair_id as id, pair_label as label, row_number() over (partition by pair_label order by md5('0|'||pair_id)) rn
     from pairs) r join p3 on p3.label=r.label where rn<=take""")
def curve(b: Inputs):
    return mn.curve_sample(b.pairs.select(F.col("pair_id").alias("id"), F.col("pair_label").alias("label")), 100)


@query("M22_leaky_pairs", """select pair_id, s_txt in (select s_txt from pairs where fold<>1) as leaky from pairs where fold=1""")
def leaky(b: Inputs):
    return mn.leaky_flag(b.pairs, 1).select("pair_id", "leaky")


@query("M23_dedupe_pairs", "select id, min(id) over (partition by s_txt, r_txt) as kept_id from copies")
def dedupe(b: Inputs):
    return mn.dedupe_pairs(b.copies)


@query("M24_interleave", """with a as (select pair_id as id, row_number() over (order by md5('pos|'||pair_id)) k from pairs where pair_label<>'no_match'),
   z as (select pair_id as id, row_number() over (order by md5('neg|'||pair_id)) k from pairs where pair_label='no_match')
   select row_number() over (order by k, side) as pos, side, id from (select k, 0 as side, id from a union all select k, 1, id from z) y""")
def interleaved(b: Inputs):
    pos = b.pairs.filter("pair_label <> 'no_match'").select(F.col("pair_id").alias("id"))
    neg = b.pairs.filter("pair_label = 'no_match'").select(F.col("pair_id").alias("id"))
    return mn.interleave(pos, neg)


@query("M25_hard_negative_counts", "select kind, count(*) as n, 0 as label from neg_batch group by kind")
def hard_negatives(b: Inputs):
    return _batch(b).groupBy("kind").agg(F.count("*").alias("n"), F.lit(0).alias("label"))


@query("M26_resource_pairs", """select least(lemma,other) as lemma_a, greatest(lemma,other) as lemma_b, rel, max(1.0::DOUBLE) as weight, min(pos) as pos
   from (select lemma, lower(other) as other, pos, case relation when 'synonyms' then 'SYN' when 'derivatives' then 'POS' end as rel from lex) z
   where rel is not null and regexp_full_match(lemma,'[a-z]{3,}') and regexp_full_match(other,'[a-z]{3,}') and lemma<>other group by all""")
def resource_pairs(b: Inputs):
    return lx.resource_pairs(b.lexicon)


@query("M27_vector_neighbours", """select a, b, round(cos,6) as cos, rank from (select *, row_number() over (partition by a order by cos desc, b desc) as rank from (
     select x.vec_id as a, y.vec_id as b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) as cos
     from embeddings x join embeddings y on x.label=y.label and x.vec_id<>y.vec_id) z where cos>=0.3) w where rank<=5""")
def neighbours(b: Inputs):
    vec = b.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("pos"), F.col("embedding").alias("vec"))
    return lx.vector_neighbours(vec, threshold=0.3).select("a", "b", F.round("cos", 6).alias("cos"), "rank")


_SENT = f"""select lemma, pid, i from (select *, row_number() over (partition by lemma order by md5('1|'||lemma||'|'||pid)) as o from (
   select {k.lemma('norm')} as lemma, pid, min(i)::INT as i from all_tok where side='r' and pid in (select pid from reu_u where n between 8 and 40)
   group by all) z where regexp_full_match(lemma,'[a-z]{{3,}}')) y where o<=40"""


@query("M28_lemma_sentences", _SENT)
def sentences(b: Inputs):
    return lx.lemma_sentences(mn.distinct_passages(b.reu))


@query("M28_exemplified_pairs", f"""with ok as (select lemma from ({_SENT}) s group by lemma having count(*)>=4)
   select distinct least(lemma,other) as lemma_a, greatest(lemma,other) as lemma_b, case relation when 'synonyms' then 'SYN' else 'POS' end as rel
   from lex where relation in ('synonyms','derivatives') and lemma in (from ok) and other in (from ok)""")
def exemplified(b: Inputs):
    sents = lx.lemma_sentences(mn.distinct_passages(b.reu))
    return lx.keep_exemplified(lx.resource_pairs(b.lexicon), sents).select("lemma_a", "lemma_b", "rel")


_ACC = """with w as (select r.pair_id, r.t, coalesce(g.s,-1) as g, coalesce(p.s,-1) as p, rn.norm as rnorm, x.norm as snorm from rwords r
     left join gold g on g.pair_id=r.pair_id and g.t=r.t left join pred p on p.pair_id=r.pair_id and p.t=r.t
     left join rwords rn on rn.pair_id=r.pair_id and rn.t=r.t left join swords x on x.pair_id=r.pair_id and x.s=p.s)"""


@query("M29_best_and_worst", """with w as (select r.pair_id, r.t, coalesce(g.s,-1) as g, coalesce(p.s,-1) as p, g.s is not null and x.norm<>r.norm as hard from rwords r
     left join gold g on g.pair_id=r.pair_id and g.t=r.t left join pred p on p.pair_id=r.pair_id and p.t=r.t
     left join swords x on x.pair_id=g.pair_id and x.s=g.s),
   a as (select pair_id, avg((g=p)::INT) as acc, sum((g>=0)::INT) as links, sum(hard::INT) as hard from w group by 1 having sum((g>=0)::INT)>=3)
   select 'worst' as side, pair_id, rank from (select pair_id, row_number() over (order by acc, links desc, pair_id) as rank from a) x where rank<=5
   union all select 'best', pair_id, rank from (select pair_id, row_number() over (order by acc desc, hard desc, links desc, pair_id) as rank from a) y where rank<=5""")
def samples(b: Inputs):
    from palimpsest.operators import score as sc

    return sc.best_and_worst(b.rwords, b.swords, gold=b.gold, pred=b.pred)
