"""SQL text for the checks: word expressions and the shared table expressions, composed on demand."""

from __future__ import annotations

import re

from palimpsest.functions import text as tx

WS = tx.WS
LETTERS = ("ß", "#")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    out = f"replace(replace(lower(strip_accents({x})),'j','i'),'v','u')"
    for old, new in tx.VARIANT_FOLDS:
        out = f"replace({out},{q(old)},{q(new)})"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}_]', '', 'g')"


def drop_enclitic(x: str) -> str:
    return (
        f"(case when ends_with({x},'que') and length({x})>=6 then left({x},length({x})-3) "
        f"when ends_with({x},'ue') and length({x})>=5 then left({x},length({x})-2) "
        f"when ends_with({x},'ne') and length({x})>=5 then left({x},length({x})-2) else {x} end)"
    )


def folded(x: str, keep: str = "a-z") -> str:
    return f"regexp_replace(replace(replace(lower({x}),'v','u'),'j','i'),'[^{keep}]','','g')"


def key(x: str) -> str:
    """Spelling key of a column (pass a plain column name)."""
    out = drop_enclitic("_k")
    for old, new in (("ae", "e"), ("oe", "e"), ("y", "i"), ("mpt", "nt"), ("cq", "q"), ("dq", "q"),
                     ("gue", "ge"), ("ph", "f"), ("h", "")):
        out = f"replace({out},{q(old)},{q(new)})"
    for ch in "abcdefghijklmnopqrstuvwxyz0123456789":
        out = f"replace({out},'{ch}{ch}','{ch}')"
    for pattern, new in (("d$", "t"), ("ns$", "s"), ("nst", "st"), ("ens$", "es"), ("n$", "m")):
        flag = ", 'g'"
        out = f"regexp_replace({out},{q(pattern)},{q(new)}{flag})"
    return f"(list_transform([{folded(x, '0-9a-z')}], lambda _k: {out})[1])"


def extended(x: str) -> str:
    t = f"replace({x},'oe','ae')"
    cases = " ".join(
        f"when ends_with({t},{q(a)}) then left({t},length({t})-{len(a)})||{q(b)}" for a, b in tx.ARCHAIC_ENDINGS
    )
    return f"(case {cases} else {t} end)"


def plural(x: str) -> str:
    return f"(case when ends_with({x},'is') or ends_with({x},'es') then left({x},length({x})-2)||'es' else {x} end)"


def lemma(n: str) -> str:
    return f"(case when length({n})>=3 then left({n},5) end)"


def pos(l: str) -> str:
    return (
        f"(case when right({l},1) in ('e','t','r') then 'v' when right({l},1) in ('s','d','n') then 'n' "
        f"when {l} is not null then 'a' end)"
    )


def lev(a: str, b: str) -> str:
    """Edit distance over characters: DuckDB counts bytes, so the letters beyond ASCII that
    normalised words keep are mapped to one byte each first."""
    f, t = LETTERS
    return f"levenshtein(translate({a},{q(f)},{q(t)}),translate({b},{q(f)},{q(t)}))"


STOP = "(" + ",".join(q(w) for w in tx.STOP_WORDS) + ")"


def bucket(n: int, expr: str) -> str:
    return f"(('0x'||left(md5({expr}),6))::BIGINT % {n})"


def udraw(expr: str) -> str:
    return f"(('0x'||left(md5({expr}),8))::BIGINT / 4294967296.0::DOUBLE)"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x},'{WS}'), lambda w: w<>'')"


#: Shared table expressions: name -> SQL. A query that mentions a name gets it, and what it needs.
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _passages(table: str, work: str, keep: str = "") -> str:
    return f"""select work*1000000+seg as pid, work, seg{keep}, toks, len(toks) as n, array_to_string(toks,' ') as txt
      from (select work, seg{keep}, list_slice(w, seg*24+1, seg*24+24) as toks
            from (select work{keep}, w, unnest(range((len(w)+23)//24)) as seg
                  from (select {work} as work{keep}, {words('text')} as w from {table}) x0) x1) x2"""


cte("src_p", _passages("benchmark", "item_id"))
cte("reu_p", _passages("(select doc_id, text, source as author, lang from documents)", "doc_id", ", author, lang"))
cte("all_tok", f"""select side, pid, work, i, surface, {norm('surface')} as norm from (
    select 's' side, pid, work, unnest(range(len(toks))) i, unnest(toks) surface from src_p
    union all select 'r', pid, work, unnest(range(len(toks))), unnest(toks) from reu_p) z""")
cte("src_u", "select * from src_p where pid in (select min(pid) from src_p group by txt)")
cte("reu_u", "select * from reu_p where pid in (select min(pid) from reu_p group by txt)")
for _side in ("src", "reu"):
    cte(f"{_side}_ct", f"""select distinct pid, token from (
        select pid, {folded('unnest(toks)')} as token from {_side}_u) z where length(token)>=4 and token not in {STOP}""")
cte("mined_all", """select q, c, count(*) as n_shared from (
      select a.pid as q, b.pid as c from reu_ct a join src_ct b using(token)
      where token in (select token from src_ct group by token having count(*)<=2000)) z group by q, c""")
cte("mined", """select m.q, m.c, m.n_shared, a.txt as s_txt, b.txt as r_txt, a.toks as s_tok, b.toks as r_tok
    from mined_all m join src_u a on a.pid=m.c join reu_u b on b.pid=m.q
    where m.n_shared>=2 and a.n between 6 and 80 and b.n between 6 and 80 and a.txt<>b.txt""")
cte("pairs", f"""select m.c||'_'||m.q as pair_id, m.c as s_pid, m.q as r_pid, m.c//1000000 as s_work, m.q//1000000 as r_work,
      s_txt, r_txt, s_tok, r_tok, len(s_tok)::INT as n_s, len(r_tok)::INT as n_r, n_shared, d.source as author, d.lang as lang,
      ((m.q//1000000)%5)::INT as fold,
      case l.quality when 1 then 'cit' when 0 then 'cf' else 'no_match' end as pair_label,
      list_transform(s_tok, lambda w: {norm('w')}) as s_norm, list_transform(r_tok, lambda w: {norm('w')}) as r_norm
    from mined m join documents d on d.doc_id=m.q//1000000
    left join (select doc_id, max(quality) quality from labels group by doc_id) l on l.doc_id=m.q//1000000
    where n_shared>=3""")
cte("rwords", """select pair_id, n_s, n_r, (unnest(range(n_r)))::INT as t, unnest(r_tok) as word, unnest(r_norm) as norm from pairs""")
cte("swords", """select pair_id, n_s, n_r, (unnest(range(n_s)))::INT as s, unnest(s_tok) as word, unnest(s_norm) as norm from pairs""")
cte("grid", """select r.pair_id, r.n_s, r.n_r, t, s, r.word as rw, r.norm as rn, x.word as sw, x.norm as sn
    from rwords r join swords x using(pair_id)""")
cte("cells0", f"""select *, ((greatest(length(sn),length(rn),1)-{lev('sn','rn')})*1000 // greatest(length(sn),length(rn),1))::INT as wgt from grid""")
cte("cells", """select *, wgt::DOUBLE/(sum(wgt) over (partition by pair_id,t)+300)::DOUBLE as p_fwd,
    wgt::DOUBLE/(sum(wgt) over (partition by pair_id,s)+300)::DOUBLE as p_rev from cells0 where wgt>=400""")
cte("fwd", """select pair_id, t, s, p_fwd as p from cells union all
    select w.pair_id, w.t, -1, 300::DOUBLE/(coalesce(m,0)+300)::DOUBLE from rwords w
    left join (select pair_id, t, sum(wgt) m from cells group by all) z on z.pair_id=w.pair_id and z.t=w.t""")
cte("rev", """select pair_id, s, t, p_rev as p from cells union all
    select w.pair_id, w.s, -1, 300::DOUBLE/(coalesce(m,0)+300)::DOUBLE from swords w
    left join (select pair_id, s, sum(wgt) m from cells group by all) z on z.pair_id=w.pair_id and z.s=w.s""")
# the copy annotator, one reuse word per step of a recursion over all pairs at once
cte("gold_steps", """select pair_id, -1::INT as t, -1::INT as s, 0::INT as cur from pairs
    union all
    select g.pair_id, g.t+1, coalesce(n.s,-1)::INT, coalesce(n.s+1, g.cur)::INT from gold_steps g
    join rwords r on r.pair_id=g.pair_id and r.t=g.t+1
    left join lateral (select min(x.s) as s from swords x where x.pair_id=g.pair_id and x.s>=g.cur and x.norm=r.norm) n on true""")
cte("gold", "select pair_id, t, s from gold_steps where s>=0")
cte("fwd_head", """select pair_id, t, s, p from (select *, row_number() over (partition by pair_id,t
    order by p desc, case when s<0 then 1073741824 else s end) k from fwd) z where k=1""")
cte("rev_head", """select pair_id, s, t, p from (select *, row_number() over (partition by pair_id,s
    order by p desc, case when t<0 then 1073741824 else t end) k from rev) z where k=1""")
cte("pred", """select a.pair_id, a.t, a.s, a.p from fwd_head a join rev_head b
    on a.pair_id=b.pair_id and a.t=b.t and a.s=b.s where a.s>=0 and a.t>=0""")

cte("gold_texts", "select txt from reu_p where work in (select doc_id from labels where toxic=1)")
cte("scored", f"""select c||'_'||q as id, s_txt as source, r_txt as reuse, n_shared, {udraw("'p|'||c||'_'||q")} as p from mined""")
cte("wide", f"""select *, list_transform(r_tok, lambda w: {norm('w')}) as r_norm, len(r_tok)::INT as n_r from (
   select p.* exclude (r_tok, r_norm, n_r), list_concat(list_concat(coalesce(a.toks,[]), p.r_tok), coalesce(z.toks,[])) as r_tok
   from pairs p left join reu_p a on a.pid=p.r_pid-1 left join reu_p z on z.pid=p.r_pid+1) w0""")
cte("copies", "select p.s_pid||'_'||r.pid as id, p.s_txt, p.r_txt from pairs p join reu_p r on r.txt=p.r_txt")
cte("neg_rows", """select pair_id as id, author, r_pid as cited_pid, r_txt as cited_txt, s_txt as query_txt,
   s_norm as query_norm, n_s as n_q from pairs where fold<>0""")
cte("attested_pairs", "select distinct r_txt as txt, s_txt as query_txt from pairs")
cte("lex0", f"""select lemma, {pos('lemma')} as pos, lead(lemma,1) over w as synonyms, lead(lemma,2) over w as hypernyms,
   lag(lemma,2) over w as hyponyms, lead(lemma,3) over w as antonyms, lead(lemma,4) over w as derivatives
   from (select distinct {lemma('norm')} as lemma from all_tok) z where regexp_full_match(lemma,'[a-z]{{5}}')
   window w as (partition by substr(lemma,2,4) order by lemma)""")
cte("lexicon", """select lemma, pos, unnest(['synonyms','hypernyms','hyponyms','antonyms','derivatives']) as relation,
   unnest([synonyms,hypernyms,hyponyms,antonyms,derivatives]) as other from lex0""")
cte("lex", "select * from lexicon where other is not null")
cte("vectors", f"""select lemma, embedding::DOUBLE[] as vec from (
   select lemma, {bucket("(select greatest(1, count(*)*11//10) from embeddings)",'lemma')} as vid from (select distinct {lemma('norm')} as lemma from all_tok) z where lemma is not null) y
   join embeddings e on e.vec_id=y.vid""")

_EXC = "('quoque','denique','neque','atque','usque','itaque','namque','undique')"
cte("names", r"""select form, count(*) as n from (select regexp_replace(surface,'[^\p{L}]','','g') as form from all_tok where side='s' and i>0) z
   where regexp_matches(form,'^\p{Lu}') group by form having count(*)>=2""")
cte("attested", "select norm from all_tok where norm<>'' group by norm having count(*)>=3")
cte("enc", f"""select word, stem, stem_norm, enclitic from (select *, row_number() over (partition by word order by o) as rk from (
   select word, o, e as enclitic, left(cl, length(cl)-length(e)) as stem, {norm('left(cl, length(cl)-length(e))')} as stem_norm from (
     select word, cl, unnest([0,1,2,3]) as o, unnest(['que','ue','ve','ne']) as e from (
       select word, regexp_replace(word,'[^A-Za-z]','','g') as cl from (select word from rwords union select word from swords) w0) w1
     where lower(cl) not in {_EXC}) w2 where ends_with(lower(cl),e) and length(cl)-length(e)>=3) w3
   where stem_norm in (select norm from attested)) w4 where rk=1""")
cte("facts", f"""select w.word, w.norm, {lemma('w.norm')} as lemma, {pos(lemma('w.norm'))} as pos,
   regexp_matches(regexp_replace(w.word,'^[^A-Za-z]+',''),'^[A-Z]') as cap,
   regexp_replace(w.word,'[^\\p{{L}}]','','g') in (select form from names) and regexp_matches(regexp_replace(w.word,'[^\\p{{L}}]','','g'),'^\\p{{Lu}}') as is_name,
   e.stem_norm, e.enclitic from (select word, norm from rwords union select word, norm from swords) w left join enc e on e.word=w.word""")
cte("rel_flags", """select la, lb, max((relation='synonyms')::INT) wn_syn, max((relation='hypernyms')::INT) wn_hyper, max((relation='hyponyms')::INT) wn_hypo,
   max((relation='antonyms')::INT) wn_ant, max((relation='derivatives')::INT) wn_deriv from (
     select lemma as la, other as lb, relation from lex union all
     select other, lemma, case relation when 'hypernyms' then 'hyponyms' when 'hyponyms' then 'hypernyms' else relation end from lex) z group by la, lb""")
cte("evidence", f"""select *, case when same_form=1 then 4 when same_lemma=1 then 3 when enclitic_stem_match=1 and enclitic_src<>enclitic_tgt then 2
     when wn_any=1 or both_names=1 then 1 else 0 end as tier from (
   select g.pair_id, g.t, g.s, g.n_r, g.n_s, g.rw, g.sw, g.rn, g.sn, (g.sn=g.rn)::INT as same_form,
     coalesce(a.lemma=b.lemma and g.sn<>g.rn, false)::INT as same_lemma, (a.lemma is null or b.lemma is null)::INT as lemma_missing,
     coalesce(f.wn_syn,0) wn_syn, coalesce(f.wn_hyper,0) wn_hyper, coalesce(f.wn_hypo,0) wn_hypo, coalesce(f.wn_ant,0) wn_ant, coalesce(f.wn_deriv,0) wn_deriv,
     greatest(coalesce(f.wn_syn,0),coalesce(f.wn_hyper,0),coalesce(f.wn_hypo,0),coalesce(f.wn_ant,0),coalesce(f.wn_deriv,0)) wn_any,
     (a.lemma is null or b.lemma is null or pr.lemma is null)::INT as wn_missing,
     coalesce(least(greatest(list_cosine_similarity(va.vec,vb.vec),0.0),1.0),0.0) as cos, (va.vec is null or vb.vec is null)::INT as cos_missing,
     (a.is_name and b.is_name)::INT both_names, (a.is_name or b.is_name)::INT either_name,
     (a.stem_norm is not null)::INT enclitic_src, (b.stem_norm is not null)::INT enclitic_tgt,
     (coalesce(a.stem_norm=g.rn,false) or coalesce(b.stem_norm=g.sn,false) or coalesce({lemma('a.stem_norm')}=b.lemma and g.sn<>g.rn,false)
       or coalesce({lemma('b.stem_norm')}=a.lemma and g.sn<>g.rn,false))::INT enclitic_stem_match,
     coalesce(list_position(list_transform(range(1,least(length(g.sn),length(g.rn))+1), lambda i: substr(g.sn,i,1)<>substr(g.rn,i,1)), true)-1,
       least(length(g.sn),length(g.rn)))::DOUBLE/greatest(length(g.sn),length(g.rn),1) as prefix_ratio,
     1.0::DOUBLE-{lev('g.sn','g.rn')}::DOUBLE/greatest(length(g.sn),length(g.rn),1) as edit_ratio,
     least(length(g.sn),length(g.rn))::DOUBLE/greatest(length(g.sn),length(g.rn),1) as len_ratio,
     (a.cap=b.cap)::INT same_case, coalesce(a.pos=b.pos,false)::INT same_pos,
     least(greatest(0.5::DOUBLE+(g.t::DOUBLE/greatest(g.n_r,1)-g.s::DOUBLE/greatest(g.n_s,1))/2.0::DOUBLE,0.0),1.0) as rel_position
   from grid g join facts a on a.word=g.sw join facts b on b.word=g.rw
   left join rel_flags f on f.la=a.lemma and f.lb=b.lemma left join vectors va on va.lemma=a.lemma left join vectors vb on vb.lemma=b.lemma
   left join (select distinct lemma from lex) pr on pr.lemma=a.lemma) z""")
cte("tiers", "select * from evidence where tier>0")
cte("sims", "select pair_id, t, s, n_r, n_s, round(cos,9) as v from evidence where cos_missing=0")

RECURSIVE = {"gold_steps"}


def with_ctes(sql: str) -> str:
    """``sql`` with the shared expressions it mentions in front, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()
    recursive = False

    def visit(text: str) -> None:
        for name in CTES:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(CTES[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql
    head = ",\n".join(f"{name} as materialized ({CTES[name]})" if name not in RECURSIVE
                      else f"{name} as ({CTES[name]})" for name in order)
    recursive = any(n in RECURSIVE for n in order)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        recursive, body = True, "," + body[len("with recursive "):]
        return f"with recursive {head}\n{body}"
    if body.lower().startswith("with "):
        body = "," + body[5:]
        return f"with {'recursive ' if recursive else ''}{head}\n{body}"
    return f"with {'recursive ' if recursive else ''}{head}\n{body}"
