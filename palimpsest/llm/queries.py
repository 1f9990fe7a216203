"""The registered queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import quality
from palimpsest.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.bpe import round_trip_digest

    return round_trip_digest(table(spark, sf_dir, "documents"))


OP2_SQL = """
with line as (
    select doc_id, unnest(parts) as line, unnest(range(len(parts))) as i
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)
), keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from line
), shared as (
    select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), judged as (
    select k.*, s.key is not null and k.doc_id is distinct from s.keeper as dropped from keyed k left join shared s using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from judged group by doc_id
"""


@query("op2_line_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), digest=True)


OP3_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), term as (
    select vec_id, unnest(e) as w, unnest(range(len(e))) as d from v
), scored as (
    select q.vec_id as query_id, c.vec_id, sum(q.w * c.w)::bigint as score
    from term q join term c on q.d = c.d and q.vec_id <> c.vec_id
    where q.vec_id % 20 = 0 group by 1, 2
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 20
"""


@query("op3_block_topk", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


@query("op4_token_matrices")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.token_matrix import packed_matrices

    return packed_matrices(table(spark, sf_dir, "documents"))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.best_fit import pack

    return pack(table(spark, sf_dir, "documents"))


@query("op7_byte_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.shard import shards

    return shards(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with recursive word as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as w from documents
), raw as materialized (
    select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from word where len(w) > 0)
), size as materialized (
    select doc_id, count(*) as n from raw group by doc_id
), link as materialized (
    select x.doc_id as a, y.doc_id as b from raw x join raw y on x.g = y.g and x.doc_id <> y.doc_id
    join size sx on sx.doc_id = x.doc_id join size sy on sy.doc_id = y.doc_id
    group by x.doc_id, y.doc_id, sx.n, sy.n having 100 * count(*) >= 75 * (sx.n + sy.n - count(*))
), reach(a, b) as (
    select doc_id, doc_id from size union select reach.a, link.b from reach join link on link.a = reach.b
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(r.c, d.doc_id) as component_id
from documents d left join size s using (doc_id) left join (select a as doc_id, min(b) as c from reach group by a) r using (doc_id)
"""


@query("op8_ngram_jaccard", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with word as (
    select doc_id, lang, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
    select doc_id, unnest(range(1, len(w) - 3)) as i, w from word where len(w) >= 5
), gram as (
    select doc_id, i, w[i:i + 4] as g from windows
), twice as (
    select doc_id, i, count(*) over (partition by doc_id, g) as c from gram
), covered as (
    select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from twice where c >= 2) group by doc_id
), line as (
    select doc_id, l from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l from documents)
    where regexp_matches(l, '[^\x20\x09-\x0D]')
), lines as (
    select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup from line group by doc_id
), base as (
    select word.doc_id, lang, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup, 0) as n_dup_lines,
        coalesce(c.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines
    from word left join covered c using (doc_id) left join lines using (doc_id)
), ruled as (
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base
), valued as (
    select doc_id, lang, source, base_failed, unnest([
        {{'f': 'word_length', 'v': word_chars * 100 // nullif(n_words, 0)}}, {{'f': 'symbols', 'v': n_symbols * 1000 // nullif(n_words, 0)}},
        {{'f': 'dup_lines', 'v': n_dup_lines * 1000 // nullif(n_lines, 0)}}, {{'f': 'repeats', 'v': n_repeat_words * 1000 // nullif(n_words, 0)}}
    ], recursive := true) from ruled
), sketch as (
    select level, case when level >= 1 then lang end as lang, case when level = 2 then source end as source, f,
        v - v % (1::bigint << greatest(length(bin(v)) - 7, 0)) as bucket, count(*) as n
    from valued, (select unnest([0, 1, 2]) as level) where not base_failed group by all
), cum as (
    select *, sum(n) over (partition by level, lang, source, f order by bucket) as c,
        sum(n) over (partition by level, lang, source, f) as total from sketch
), quart as (
    select level, lang, source, f, max(total) as total, min(bucket) filter (c * 4 >= total) as q1,
        min(bucket) filter (c * 4 >= total * 2) as q2, min(bucket) filter (c * 4 >= total * 3) as q3
    from cum group by all
), bound as (
    select *, q2 + {reach} * greatest(q2 - q1, s) as high, case when f = 'word_length' then q2 - {reach} * greatest(q3 - q2, s) else -1 end as low
    from quart join (values {floors}) as t(f, s) using (f) where level = 0 or total >= {min_group}
), verdict as (
    select v.doc_id, bool_and(v.v between b.low and b.high) as inside
    from valued v join bound b on v.f = b.f and (b.level = 0 or v.lang is not distinct from b.lang)
        and (b.level < 2 or v.source is not distinct from b.source)
    where b.level = (
        select max(x.level) from bound x where x.f = v.f and (x.level = 0 or v.lang is not distinct from x.lang)
            and (x.level < 2 or v.source is not distinct from x.source)
    )
    group by v.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    coalesce(not base_failed and inside, false) as kept
from ruled left join verdict using (doc_id)
""".format(
    reach=quality.REACH, min_group=quality.MIN_GROUP, floors=", ".join(f"('{n}', {f[1]})" for n, f in quality.FEATURES.items())
)


@query("op9_quality_rules", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query("op12_byte_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.byte_bpe import round_trip_digest

    return round_trip_digest(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.whiten import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
with recursive tab as (
    select list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), src as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint) as key
    from conversations
), kinds as (
    select src.*, xor(list_reduce(list_prepend(4294967295, key), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 20 as kind
    from src, tab
), damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from (select *, unnest(case when kind = 3 then [0, 1] else [0] end) from kinds where kind <> 0)
), numbered as materialized (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
        regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') as bare, left(role, 1) as initial from damaged
), row_ as materialized (
    select *, case when bare = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
        when right(bare, 1) not in ('.', '!', '?') then 't' else 'f' end as fault,
        coalesce(lead(initial) over (partition by conv_id order by i), '-') as following from numbered
), conv as (
    select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
        count(*) filter (following <> '-' and initial || following not in ('su', 'ua', 'au')) as illegal
    from row_ group by conv_id
), state(s, following, role) as (
    values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')
), inserted as (
    select s, 0 as k, s as t from state union all select s, 1, following from state
    union all select a.s, 2, b.following from state a join state b on b.s = a.following
    union all select a.s, 3, c.following from state a join state b on b.s = a.following join state c on c.s = b.following
), edit(name, cost) as (
    values ('D', 3), ('K', 0), ('R', 2)
), walk as (
    select conv_id, 0::bigint as i, 0 as s, {'cost': 0::bigint, 'audit': ''} as best from conv
    union all
    select conv_id, i, s, min(best) from (
        select w.conv_id, r.i, case when name = 'D' then x.t when name = 'K' and r.initial = 's' then 1 else st.following end as s,
            {'cost': w.best.cost + 2 * k + e.cost + case when name <> 'D' and fault = 't' then 1 else 0 end,
             'audit': w.best.audit || repeat('I', k) || name} as best
        from walk w join row_ r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1
            join inserted x on x.s = w.s join state st on st.s = x.t, edit e
        where name = 'D' or (fault in ('f', 't') and (name = 'R' or r.initial = left(st.role, 1) or (r.initial = 's' and x.t = 0)))
    ) group by conv_id, i, s
), solved as (
    select w.conv_id, min({'cost': w.best.cost + 2 * k, 'audit': w.best.audit || repeat('I', k)}) as best
    from walk w join conv on conv.conv_id is not distinct from w.conv_id and conv.n = w.i join inserted x on x.s = w.s
    where x.t in (0, 3) group by w.conv_id
), letters as (
    select conv_id, unnest(string_split(best.audit, '')) as edit, unnest(range(1, length(best.audit) + 1)) as pos from solved where best.audit <> ''
), placed as (
    select *, count(*) filter (edit <> 'I') over (partition by conv_id order by pos) as i,
        count(*) filter (edit <> 'D') over (partition by conv_id order by pos) as place from letters
), kept as (
    select p.*, r.role, r.text, coalesce(max(case when p.edit = 'K' and r.initial = 's' then 1 else 0 end) over (partition by p.conv_id), 0) as lead_s
    from placed p left join row_ r on r.conv_id is not distinct from p.conv_id and r.i = p.i and p.edit <> 'I'
    where p.edit <> 'D'
), written as (
    select conv_id, string_agg(
        case when edit = 'K' then role when (place - lead_s) % 2 = 1 then 'user' else 'assistant' end || ':' ||
        case when edit = 'I' then '' else text end, chr(10) order by pos) as repaired
    from kept group by conv_id
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
    coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(s.best.cost, 0)::bigint as cost,
    coalesce(s.best.audit, '') as audit, sha256(coalesce(w.repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join conv c on c.conv_id is not distinct from o.conv_id
    left join solved s on s.conv_id is not distinct from o.conv_id left join written w on w.conv_id is not distinct from o.conv_id
"""


@query("op11_conversation_repair", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.repair import damaged_and_repaired

    return damaged_and_repaired(table(spark, sf_dir, "conversations"))
