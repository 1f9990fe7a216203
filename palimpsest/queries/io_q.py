"""Sources and sinks (S rows). Files are written from the driver tables to a fresh folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import labels as lb
from palimpsest.operators import mining as mn
from palimpsest.plans.base import Inputs
from palimpsest.queries import script_q, sqlkit as k
from palimpsest.queries.registry import query
from palimpsest.sources import records as io

TAGS = ("COPY", "MORPH", "SUBST", "SYN", "SYN-DIST", "POS", "NE-SUB", "SPLIT", "MERGE", "HYPER", "HYPO", "ANT")


def raw_table(b: Inputs):
    """The pairs in the raw prediction format."""
    per = b.words.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("t", "s", "tag", "frame"))).alias("w"))
    p = b.pred.groupBy("pair_id").agg(F.collect_list(F.struct(F.col("t").alias("r"), "s", F.lit("").alias("op"), "p")).alias("pl"))
    x = b.pairs.join(per, "pair_id").join(p, "pair_id", "left")
    links = F.transform("w", lambda e: e["s"])
    side = lambda w: F.struct(F.lit(None).cast("string").alias("author"), F.col(w).cast("string").alias("work"), F.lit(None).cast("string").alias("citation"))
    return x.select(
        F.col("pair_id").alias("id"), F.lit("cit.").alias("ref_type"), F.col("s_tok").alias("source"), F.col("r_tok").alias("target"), links.alias("links"),
        F.transform("w", lambda e: F.when(e["tag"] == "COPY", "NOP").otherwise(e["tag"])).alias("gated_tags"), F.transform("w", lambda e: e["frame"]).alias("frames"),
        F.transform(F.sequence(F.lit(0), F.col("n_s") - 1), lambda i: F.when(F.array_contains(links, i), 0).otherwise(1)).alias("dels"),
        F.struct(F.col("pl").alias("links")).alias("pred"),
        F.struct(F.lit(0).alias("benchmark_id"), "fold", side("s_work").alias("source"), side("r_work").alias("reuse")).alias("record"),
    )


def record_table(b: Inputs):
    """The gold pairs as records in the paper's spelling."""
    edges = b.words.filter("s >= 0").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("t").alias("r"), "s", lb.to_paper_op(F.col("tag")).alias("op"), F.lit(None).cast("boolean").alias("sure"),
        lb.to_paper_detail(F.col("tag"), F.lit(""), revised=True).alias("detail"), F.lit(None).cast("double").alias("p")))).alias("links"))
    return b.pairs.join(edges, "pair_id").select(
        F.col("pair_id").alias("id"), "fold", F.struct(F.col("s_work").cast("string").alias("work"), F.col("s_tok").alias("tokens")).alias("source"),
        F.struct(F.col("r_work").cast("string").alias("work"), F.col("r_tok").alias("tokens")).alias("reuse"), "pair_label", "links", F.col("lang").alias("split"), F.lit("seen").alias("note"))


def _written(b: Inputs, df, fmt: str = "json") -> str:
    path = io.scratch(b.spark)
    df.write.format(fmt).option("compression", "gzip" if fmt == "json" else "snappy").save(path)
    return path


def _records(b: Inputs):
    return io.records(io.read_json(b.spark, _written(b, record_table(b)), io.RECORD))


@query("S1_read_raw_predictions", "select r.pair_id as id, count(*) as words, sum((s>=0)::INT)::BIGINT as linked from words_p r group by 1")
def raw(b: Inputs):
    df = io.read_json(b.spark, _written(b, raw_table(b)), io.RAW)
    return df.select("id", F.size("target").cast("long").alias("words"), F.size(F.filter("links", lambda s: s >= 0)).cast("long").alias("linked"))


@query("S2_read_records", "select pair_id as id, t as r, s, tag as op, true as sure, 'gold' as level from words_p where s>=0")
def records(b: Inputs):
    return _records(b).select("id", "level", F.explode("links").alias("e")).select("id", "e.r", "e.s", "e.op", "e.sure", "level")


@query("S3_capped_load", """select pair_id as id, lang as split from (select *, row_number() over (partition by lang order by pair_id) as k from pairs where pair_id in (select pair_id from pred)) z
   where lang<>'en' or k<=50""")
def capped(b: Inputs):
    return io.capped(_records(b).select("id", "split"), {"en": 50}, "id")


@query("S4_write_records", """select pair_id as id, t as r, case when tag='MORPH' then 'INFLECT' when tag in ('SYN','POS','NE-SUB') then 'SUBST' else tag end as op,
   case tag when 'SYN' then 'SYN' when 'POS' then 'DERIV' when 'NE-SUB' then 'NE-SUB' else '' end as detail from words_p where s>=0""")
def written(b: Inputs):
    path = _written(b, io.paper_records(_records(b)).select("id", "links"))
    return io.read_json(b.spark, path, f"id string, links array<{io.EDGE}>").select("id", F.explode("links").alias("e")).select("id", "e.r", "e.op", "e.detail")


@query("S5_export_folds", "select fold, count(*) as pairs from pairs group by 1")
def export(b: Inputs):
    paths = []
    rows = raw_table(b)
    for fold in range(5):
        paths.append(_written(b, rows.filter(F.col("record.fold") == fold).coalesce(1)))
    return io.export_folds(b.spark, paths, io.scratch(b.spark))


@query("S6_released_records", f"""with u as ({script_q._UN}), q as ({script_q._quote('words_p', 4)})
   select p.pair_id as id, coalesce(l.links,'') as links, coalesce(u1.ins,'') as insertions, coalesce(u1.nw,'') as new_text, coalesce(u1.dl,'') as deletions, coalesce(u1.ot,'') as not_taken_up, coalesce(q1.n,0) as quotes
   from pairs p left join (select w.pair_id, string_agg(w.t||':'||w.s||':'||{script_q._REL.replace('tag','w.tag')}||':'||round(r.p,5), ',' order by w.t) as links from words_p w join pred r on r.pair_id=w.pair_id and r.t=w.t group by 1) l using(pair_id)
   left join (select pair_id, string_agg(case when side='reuse' and op='INS' then i end, ',' order by i) as ins, string_agg(case when op='NEW' then i end, ',' order by i) as nw, string_agg(case when op='DEL' then i end, ',' order by i) as dl,
     string_agg(case when op='OUT' then i end, ',' order by i) as ot from u group by 1) u1 using(pair_id) left join (select pair_id, count(*) as n from q group by 1) q1 using(pair_id)""")
def released(b: Inputs):
    out = io.released(io.read_json(b.spark, _written(b, raw_table(b)), io.RAW))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    link = F.array_join(F.transform("links", lambda e: F.concat_ws(":", e["reuse"], e["source"], e["label"], e["confidence"])), ",")
    return out.select("id", link.alias("links"), text("insertions"), text("new_text"), text("deletions"), text("not_taken_up"), F.size("patterns.quote").cast("long").alias("quotes"))


@query("S7_cross_fold_passages", "select s_txt, count(distinct fold) as folds from pairs group by 1 having count(distinct fold)>1")
def cross_fold(b: Inputs):
    path = io.scratch(b.spark)
    b.pairs.select("pair_id", "fold", "s_txt").write.option("header", True).option("escape", '"').csv(path)
    back = b.spark.read.schema("pair_id string, fold int, s_txt string").option("header", True).option("escape", '"').csv(path)
    return back.groupBy("s_txt").agg(F.count_distinct("fold").alias("folds")).filter("folds > 1")


@query("S8_pairs_by_fold", "select fold=1 as held_out, count(*) as pairs, count(distinct s_txt) as sources from pairs group by 1")
def by_fold(b: Inputs):
    return b.pairs.groupBy((F.col("fold") == 1).alias("held_out")).agg(F.count("*").alias("pairs"), F.count_distinct("s_txt").alias("sources"))


@query("S9_exception_format", """select r.pair_id as id, 'reuse' as side, r.t as i, coalesce(g.tag,'INS') as op from rwords r left join words_g g on g.pair_id=r.pair_id and g.t=r.t and g.s>=0
   union all select pair_id, 'source', s, 'DEL' from swords where (pair_id, s) not in (select pair_id, s from gold)""")
def exceptions(b: Inputs):
    labels = b.gold_words.filter("s >= 0").select(F.col("pair_id").alias("id"), "s", "t", F.col("tag").alias("op"))
    return io.exception_format(b.pairs.select(F.col("pair_id").alias("id"), "n_s", "n_r"), labels)


@query("S10_typed_pool", """select pair_id, case when pair_label='cf' then 'cf.' else 'cit.' end as ref_type, pair_label='no_match' as unmatched from pairs""")
def typed_pool(b: Inputs):
    labels = b.pairs.filter("pair_label <> 'no_match'").select("r_txt", "s_txt", F.concat("pair_label", F.lit(".")).alias("ref_type"))
    return io.typed_pool(b.pairs.select("pair_id", "r_txt", "s_txt"), labels)


@query("S11_pool_strata", """select case when n_shared>=4 then 'grade4' else 'grade3' end as stratum, count(*) as n, round(avg(n_shared),6) as score from scored where n_shared>=3 group by 1""")
def strata(b: Inputs):
    pool = b.scored.filter("n_shared >= 3").select("id", F.when(F.col("n_shared") >= 4, "grade4").otherwise("grade3").alias("stratum"), F.col("n_shared").cast("double").alias("score"),
                                                 F.split("source", " ").alias("source_tokens"), F.split("reuse", " ").alias("reuse_tokens"))
    back = io.read_json(b.spark, _written(b, pool), "id string, stratum string, score double, source_tokens array<string>, reuse_tokens array<string>")
    return back.groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))


@query("S12_both_orientations", "select s_txt as a, r_txt as b from pairs union all select r_txt, s_txt from pairs")
def orientations(b: Inputs):
    one = b.pairs.select(F.col("s_txt").alias("a"), F.col("r_txt").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))


@query("S13_swapped_records", "select pair_id||'~' as id, s as r, t as s, case tag when 'SPLIT' then 'MERGE' when 'MERGE' then 'SPLIT' else tag end as op from words_p where s>=0")
def swapped(b: Inputs):
    return io.swapped(_records(b)).select("id", F.explode("links").alias("e")).select("id", "e.r", "e.s", "e.op")


@query("S14_prediction_dump", """select pair_id, t, s, round(p,6) as p from (select *, row_number() over (partition by pair_id, t order by p desc, s) as k from fwd) z where k<=6""")
def dump(b: Inputs):
    rows = b.fwd.groupBy("pair_id", "t").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("neg"), "s", "p"))), 1, 6).alias("row"))
    path = _written(b, rows)
    back = io.read_json(b.spark, path, "pair_id string, t int, row array<struct<neg: double, s: int, p: double>>")
    return back.select("pair_id", "t", F.explode("row").alias("c")).select("pair_id", "t", "c.s", F.round("c.p", 6).alias("p"))


@query("S15_triple_and_edges", """select pair_id, t, s, row_number() over (partition by pair_id, t order by s)>1 as extra from cells where wgt>=600""")
def triple(b: Inputs):
    first, rest = io.edges_to_words(b.cells.filter("wgt >= 600").select("pair_id", "t", "s"))
    return first.withColumn("extra", F.lit(False)).unionByName(rest.withColumn("extra", F.lit(True)))


@query("S16_annotations", "select pair_id as id, t as r, s, tag as op from words_g where s>=0 and pair_id in (select pair_id from pred)")
def annotations(b: Inputs):
    edge = F.struct(F.col("t").alias("r"), "s", F.lower("tag").alias("op"), F.lit(True).alias("sure"), F.lit("").alias("detail"))
    new = b.gold_words.filter("s >= 0").groupBy("pair_id").agg(F.collect_list(edge).alias("links")).select(F.col("pair_id").alias("id"), F.lit(2).alias("line"), "links")
    old = new.withColumn("line", F.lit(1)).withColumn("links", F.slice("links", 1, 1))
    path = _written(b, new.unionByName(old))
    lines = io.read_json(b.spark, path, io.ANNOTATION + ", line int")
    known, _ = io.last_annotations(lines, b.pred.select(F.col("pair_id").alias("id")).distinct())
    return known.select("id", "r", "s", "op")


@query("S18_review_join", "select l.doc_id, l.quality, p.pair_id, p.n_shared from labels l join pairs p on p.r_work=l.doc_id")
def review(b: Inputs):
    return b.table("labels").join(b.pairs, F.col("doc_id") == F.col("r_work")).select("doc_id", "quality", "pair_id", "n_shared")


@query("S19_extra_pairs", "select pair_id as id, count(*) as links from gold group by 1")
def extra(b: Inputs):
    edges = b.gold.groupBy("pair_id").agg(F.collect_list(F.struct(F.col("t").alias("r"), "s")).alias("links")).select(F.col("pair_id").alias("id"), "links")
    back = io.read_json(b.spark, _written(b, edges), f"id string, links array<{io.EDGE}>")
    return back.select("id", F.size("links").cast("long").alias("links"))


@query("S20_teacher_labels", "select pair_id as id, t as r, s, tag as op, 'teacher' as links from words_p where s>=0")
def teacher(b: Inputs):
    return b.words.filter("s >= 0").select(F.col("pair_id").alias("id"), F.col("t").alias("r"), "s", F.col("tag").alias("op"), F.lit("teacher").alias("links"))


@query("S21_review_filters", """select p.pair_id, round(min(r.p),6) as min_confidence from pairs p join pred r using(pair_id) where contains(lower(r_txt),'the') and p.pair_id in (select pair_id from words_p where tag='MORPH')
   group by 1 order by min_confidence, 1""")
def filters(b: Inputs):
    has = b.words.filter("tag = 'MORPH'").select("pair_id").distinct()
    conf = b.pred.groupBy("pair_id").agg(F.round(F.min("p"), 6).alias("min_confidence"))
    return b.pairs.filter(F.contains(F.lower("r_txt"), F.lit("the"))).join(has, "pair_id", "left_semi").join(conf, "pair_id").select("pair_id", "min_confidence").orderBy("min_confidence", "pair_id")


@query("S22_reply_tags", "select pair_id, t, tag from typed_pred")
def replies(b: Inputs):
    text = F.concat(F.lit("I would say "), F.lower("tag"), F.lit(" here, for word "), "t")
    return b.words.filter("s >= 0").select("pair_id", "t", io.reply_tag(text, TAGS).alias("tag"))


@query("S22_last_tags", "select pair_id, t, tag from typed_pred")
def last_tags(b: Inputs):
    text = F.concat(F.lit("SYN came to mind first.\n\nIn the end "), F.lower("tag"), F.lit("\n \nno more to say, word "), "t")
    return b.words.filter("s >= 0").select("pair_id", "t", io.last_reply_tag(text, TAGS).alias("tag"))


@query("S22_reply_relations", """select lemma, case relation when 'synonyms' then 'SYN' when 'hypernyms' then 'HYPER' when 'hyponyms' then 'HYPO' else 'ANT' end as relation, other from lex
   where relation in ('synonyms','hypernyms','hyponyms','antonyms')""")
def reply_relations(b: Inputs):
    listed = lambda r: F.filter(F.collect_list(F.when(F.col("relation") == r, F.col("other"))), lambda w: w.isNotNull())
    glossed = F.transform(listed("hypernyms"), lambda w: F.array(w, F.lit("a gloss")))
    said = b.lexicon.groupBy("lemma").agg(F.to_json(F.struct(
        listed("synonyms").alias("SYN"), glossed.alias("HYPER"), listed("hyponyms").alias("hypo"), listed("antonyms").alias("ant"), F.lit(3).alias("n"))).alias("json"))
    reply = F.concat(F.lit("Here they are:\n"), "json", F.lit("\nThat is all."))
    return said.select("lemma", F.explode(io.reply_relations(reply)).alias("relation", "w")).select("lemma", "relation", F.explode("w").alias("other"))


@query("S23_losses", "select 'run' as tag, 'stage two update' as stage, (t+1)::INT as step, n_r as total, round((t+1)/1000.0,6)::DOUBLE as loss, count(*) as n from rwords group by 3,4,5")
def losses(b: Inputs):
    loss = ((F.col("t") + 1) / 1000.0).cast("string")
    lines = b.rwords.select(F.concat(F.lit("[run] stage two update "), F.col("t") + 1, F.lit("/"), "n_r", F.lit(": mean loss "), loss).alias("value"))
    return io.curve_points(lines).groupBy("tag", "stage", "step", "total", F.round("loss", 6).alias("loss")).agg(F.count("*").alias("n"))


@query("S23_loss_points", "select 'run' as tag, 'epoch' as stage, (t+1)::INT as step, n_r as total, count(*) as n from rwords group by 3,4")
def curve(b: Inputs):
    lines = b.rwords.select(F.concat(F.lit("[run] epoch "), F.col("t") + 1, F.lit("/"), "n_r", F.lit(": loss 0.5")).alias("value"))
    return io.curve_points(lines).groupBy("tag", "stage", "step", "total").agg(F.count("*").alias("n"))
