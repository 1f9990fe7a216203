"""Files in and out: raw predictions, records in both spellings, exports per fold, dumps, annotations, logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import labels as lb
from palimpsest.operators import script as sc
from palimpsest.plans import lineage

RAW = """id string, ref_type string, source array<string>, target array<string>, links array<int>,
  gated_tags array<string>, frames array<int>, dels array<int>,
  pred struct<links: array<struct<r: int, s: int, op: string, p: double>>>,
  record struct<benchmark_id: int, fold: int, source: struct<author: string, work: string, citation: string>,
    reuse: struct<author: string, work: string, citation: string>>"""
EDGE = "struct<r: int, s: int, op: string, sure: boolean, detail: string, p: double>"
RECORD = f"""id string, level string, fold int, benchmark_id int, source struct<work: string, tokens: array<string>>,
  reuse struct<work: string, tokens: array<string>>, pair_label string, links array<{EDGE}>,
  spans array<struct<start: int, end: int, label: string>>, annotation map<string,string>, note string,
  lookup map<string,string>, split string"""
ANNOTATION = f"""id string, links array<{EDGE}>, words array<struct<t: int, source: int, op: string, sure: boolean, comment: string>>,
  spans array<struct<start: int, end: int, label: string>>, note string"""
LEXICON_FILE = """synonyms array<string>, hypernyms array<string>, hyponyms array<string>, antonyms array<string>,
  derivatives array<string>, _error string"""


def scratch(spark: SparkSession) -> str:
    """A fresh folder under the checkpoint folder, which every executor can reach."""
    lineage.cut(spark.range(1))  # sets the folder where a session has none
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/io-{uuid.uuid4().hex}"


def read_json(spark: SparkSession, path: str, schema: str, *, multi_line: bool = False) -> DataFrame:
    """JSON lines with a declared schema; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


# ---- raw predictions to released records ---------------------------------------------------------------


def raw_problems() -> Column:
    """Why a raw record contradicts itself, NULL when it does not."""
    n = F.size("target")
    claimed = F.array_distinct(F.filter("links", lambda s: s >= 0))
    free = F.filter(F.sequence(F.lit(0), F.size("source") - 1), lambda i: ~F.array_contains(claimed, i))
    flagged = F.filter(F.sequence(F.lit(0), F.size("dels") - 1), lambda i: F.get("dels", i) != 0)
    untagged = F.exists(
        F.sequence(F.lit(0), n - 1),
        lambda i: (F.get("links", i) >= 0) & lb.released_label(F.coalesce(F.get("gated_tags", i), F.lit(""))).isNull(),
    )
    return (
        F.when((F.size("links") != n) | (F.size("gated_tags") != n) | (F.size("frames") != n), "per-word lists do not match the reuse")
        .when(F.size("dels") != F.size("source"), "deletions do not match the source")
        .when(untagged, "unknown link tag")
        .when(free != flagged, "the deletions disagree with the links")
    )


def released_links(raw: DataFrame) -> DataFrame:
    """(id, reuse, source, label, relation, confidence), one row per linked word."""
    words = raw.select("id", "pred", F.posexplode(F.arrays_zip("links", "gated_tags")).alias("r", "w")).filter("w.links >= 0")
    mine = F.filter(F.col("pred.links"), lambda x: (x["r"] == F.col("r")) & (x["s"] == F.col("w.links")))
    return words.select(
        "id", F.col("r").alias("reuse"), F.col("w.links").alias("source"), lb.released_label(F.col("w.gated_tags")).alias("label"),
        lb.released_relation(F.col("w.gated_tags")).alias("relation"), F.round(F.get(mine, F.lit(0))["p"], 5).alias("confidence"),
    )


def word_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reuse words (with links, tags, formula flags) and source words of raw records."""
    words = raw.select("id", F.posexplode(F.arrays_zip("target", "links", "gated_tags", "frames")).alias("t", "w")).select(
        F.col("id").alias("pair_id"), "t", F.col("w.target").alias("word"), F.col("w.links").alias("s"),
        F.when(F.col("w.links") >= 0, F.col("w.gated_tags")).otherwise("INS").alias("tag"),
        F.when((F.col("w.links") < 0) & (F.col("w.frames") != 0), 1).otherwise(0).alias("frame"),
    )
    swords = raw.select(F.col("id").alias("pair_id"), F.posexplode("source").alias("s", "word"))
    return words, swords


def released(raw: DataFrame) -> DataFrame:
    """Released records (schema 2). A record that contradicts itself fails the job."""
    sound = raw.withColumn("_p", raw_problems()).filter(F.assert_true(F.col("_p").isNull(), F.concat_ws(": ", "id", "_p")).isNull()).drop("_p")
    words, swords = word_tables(sound)
    ordered = lambda c: F.array_sort(F.collect_list(c))
    links = released_links(sound).groupBy("id").agg(ordered(F.struct("reuse", "source", "label", "relation", "confidence")).alias("links"))
    from palimpsest.operators import typing_ as ty

    half = F.struct(F.col("a").alias("start"), (F.col("b") + 1).alias("end"))
    mark = ty.runs(words, F.col("frame") == 1).groupBy("pair_id").agg(ordered(half).alias("mark"))
    left = sc.unlinked_reuse(words).unionByName(sc.unlinked_source(words, swords)).groupBy("pair_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("op") == op, F.col("i")))).alias(name)
          for op, name in (("INS", "insertions"), ("NEW", "new_text"), ("DEL", "deletions"), ("OUT", "not_taken_up"))]
    )
    quote = sc.quotes(words).groupBy("pair_id").agg(ordered(half).alias("quote"))
    moved = sc.reordered(words).groupBy("pair_id").agg(ordered(F.col("t")).alias("reorder"))
    spread = sc.dispersed(words).groupBy("pair_id").agg(ordered(F.col("t")).alias("disperse"))
    out = sound.drop("links").join(links, "id", "left")
    for df in (mark, left, quote, moved, spread):
        out = out.join(df.withColumnRenamed("pair_id", "id"), "id", "left")
    none_i, none_s = F.array().cast("array<int>"), F.array().cast("array<struct<start:int,end:int>>")
    side = lambda k, toks: F.struct(F.col(f"record.{k}.author").alias("author"), F.col(f"record.{k}.work").alias("work"), F.col(f"record.{k}.citation").alias("citation"), F.col(toks).alias("tokens"))
    ints = lambda c: F.coalesce(c, none_i).alias(c)
    return out.select(
        "id", F.col("record.benchmark_id").alias("benchmark_id"), F.col("record.fold").alias("fold"), F.col("ref_type").alias("reference_type"),
        side("source", "source").alias("source"), side("reuse", "target").alias("reuse"), F.coalesce("links", F.from_json(F.lit("[]"), "array<struct<reuse:int,source:int,label:string,relation:string,confidence:double>>")).alias("links"),
        F.coalesce("mark", none_s).alias("mark"), *[ints(c) for c in ("insertions", "new_text", "deletions", "not_taken_up")],
        F.struct(F.coalesce("quote", none_s).alias("quote"), ints("reorder"), ints("disperse")).alias("patterns"),
    )


def export_folds(spark: SparkSession, paths: list[str], out: str, *, fmt: str = "parquet") -> DataFrame:
    """Raw files to released records, one partition folder per fold; pairs per fold come back. A file that
    holds more than one fold fails."""
    raw = spark.read.schema(RAW).option("mode", "FAILFAST").json(paths).withColumn("_file", F.input_file_name())
    folds = raw.groupBy("_file").agg(F.count_distinct("record.fold").alias("n"), F.count_if(F.col("record.fold").isNull()).alias("none"))
    if folds.filter("n <> 1 or none > 0").limit(1).count():
        raise ValueError("expected the pairs of exactly one fold in every file")
    released(raw.drop("_file")).write.partitionBy("fold").format(fmt).save(out)
    return spark.read.format(fmt).load(out).groupBy("fold").agg(F.count("*").alias("pairs"))


# ---- records -------------------------------------------------------------------------------------------


def records(raw: DataFrame) -> DataFrame:
    """Records of either spelling with their defaults filled in and the code's own labels."""
    edges = F.transform(
        F.coalesce("links", F.from_json(F.lit("[]"), f"array<{EDGE}>")),
        lambda e: F.struct(
            e["r"].alias("r"), e["s"].alias("s"), lb.from_paper_op(e["op"], e["detail"]).alias("op"), F.coalesce(e["sure"], F.lit(True)).alias("sure"),
            lb.from_paper_detail(e["op"], e["detail"]).alias("detail"), e["p"].alias("p"),
        ),
    )
    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["label"] == "MARK", "FRAME").otherwise(x["label"]).alias("label")))
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_concat(F.coalesce("annotation", empty), F.when(F.col("note").isNotNull(), F.create_map(F.lit("note"), "note")).otherwise(empty), F.coalesce("lookup", empty))
    return raw.select(
        "id", F.coalesce("level", F.lit("gold")).alias("level"), F.coalesce("fold", F.lit(-1)).alias("fold"), F.coalesce("pair_label", F.lit("cit")).alias("pair_label"),
        "source", "reuse", edges.alias("links"), spans.alias("spans"), merged.alias("annotation"), "split",
    )


def paper_records(recs: DataFrame) -> DataFrame:
    """The same records in the released spelling of operations and spans."""
    edges = F.transform("links", lambda e: F.struct(e["r"].alias("r"), e["s"].alias("s"), lb.to_paper_op(e["op"]).alias("op"), e["sure"].alias("sure"), lb.to_paper_detail(e["op"], e["detail"], revised=True).alias("detail"), e["p"].alias("p")))
    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["label"] == "FRAME", "MARK").otherwise(x["label"]).alias("label")))
    return recs.withColumn("links", edges).withColumn("spans", spans)


def swapped(recs: DataFrame) -> DataFrame:
    """Sides exchanged, links inverted, SPLIT and MERGE traded, spans dropped."""
    edges = F.transform("links", lambda e: F.struct(e["s"].alias("r"), e["r"].alias("s"), F.when(e["op"] == "SPLIT", "MERGE").when(e["op"] == "MERGE", "SPLIT").otherwise(e["op"]).alias("op"), e["sure"].alias("sure"), e["detail"].alias("detail"), e["p"].alias("p")))
    return recs.select(F.concat("id", F.lit("~")).alias("id"), F.col("reuse").alias("source"), F.col("source").alias("reuse"), edges.alias("links"))


def capped(rows: DataFrame, caps: dict[str, int], order: str) -> DataFrame:
    """The first rows of each capped split; other splits whole."""
    limit = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("split")]
    w = W.partitionBy("split").orderBy(order)
    cap = rows.filter(limit.isNotNull()).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_k")
    return cap.unionByName(rows.filter(limit.isNull()))


def edges_to_words(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first link of every word, and the rest as extra edges."""
    w = W.partitionBy("pair_id", "t").orderBy("s")
    ranked = links.withColumn("_k", F.row_number().over(w))
    return ranked.filter("_k = 1").drop("_k"), ranked.filter("_k > 1").drop("_k")


def last_annotations(lines: DataFrame, gold_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last line per id as links in the code's labels, and the ids the gold does not know."""
    last = lines.groupBy("id").agg(F.max_by(F.struct("links", "words", "spans"), "line").alias("v")).select("id", "v.*")
    per_word = F.transform(
        F.filter("words", lambda w: w["source"] >= 0),
        lambda w: F.struct(w["t"].alias("r"), w["source"].alias("s"), w["op"].alias("op"), F.coalesce(w["sure"], F.lit(True)).alias("sure"), F.lit("").alias("detail"), F.lit(None).cast("double").alias("p")),
    )
    both = F.when(F.size(F.coalesce("words", F.from_json(F.lit("[]"), "array<struct<t:int,source:int,op:string,sure:boolean,comment:string>>"))) > 0, per_word).otherwise(F.col("links"))
    known = last.join(gold_ids, "id", "left_semi").select("id", F.explode(both).alias("e")).select(
        "id", "e.r", "e.s", lb.canonical_op(F.upper("e.op")).alias("op"), F.coalesce("e.sure", F.lit(True)).alias("sure")
    )
    return known, last.join(gold_ids, "id", "left_anti").select("id")


def exception_format(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per-word labels from a list of exceptions: unlisted reuse words are INS, unlisted source words DEL.
    ``pairs`` is (id, n_s, n_r), ``labels`` (id, s, t, op)."""
    t = pairs.select("id", F.explode(F.sequence(F.lit(0), F.col("n_r") - 1)).alias("t"))
    s = pairs.select("id", F.explode(F.sequence(F.lit(0), F.col("n_s") - 1)).alias("s"))
    reuse = t.join(labels, ["id", "t"], "left").select("id", F.lit("reuse").alias("side"), F.col("t").alias("i"), F.coalesce("op", F.lit("INS")).alias("op"))
    gone = s.join(labels.select("id", "s"), ["id", "s"], "left_anti").select("id", F.lit("source").alias("side"), F.col("s").alias("i"), F.lit("DEL").alias("op"))
    return reuse.unionByName(gone)


def typed_pool(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Ground-truth pairs typed by their texts; cit. beats cf.; unmatched pairs are cit. and counted."""
    rank = F.when(F.col("ref_type") == "cit.", 0).otherwise(1)
    one = labels.groupBy(F.trim("r_txt").alias("r_txt"), F.trim("s_txt").alias("s_txt")).agg(F.min_by("ref_type", rank).alias("ref_type"))
    x = pairs.withColumn("r_txt", F.trim("r_txt")).withColumn("s_txt", F.trim("s_txt")).join(one, ["r_txt", "s_txt"], "left")
    return x.select("pair_id", F.coalesce("ref_type", F.lit("cit.")).alias("ref_type"), F.col("ref_type").isNull().alias("unmatched"))


# ---- model replies, logs, lexicon files -------------------------------------------------------------------


def reply_tag(reply: Column, tags: tuple[str, ...]) -> Column:
    """The earliest tag a reply names, the longest where two start together."""
    text = F.upper(reply)
    found = F.filter(
        F.transform(F.array(*[F.lit(t) for t in tags]), lambda t: F.struct(F.instr(text, t).alias("at"), (-F.length(t)).alias("neg"), t.alias("tag"))),
        lambda x: x["at"] > 0,
    )
    return F.array_min(found)["tag"]


def last_reply_tag(reply: Column, tags: tuple[str, ...]) -> Column:
    """The tag of the last line that names one; NULL where none does."""
    lines = F.filter(F.split(reply, r"\r\n|[\n\r]"), lambda line: F.trim(line) != "")
    named = F.filter(F.transform(F.reverse(lines), lambda line: reply_tag(line, tags)), lambda t: t.isNotNull())
    return F.coalesce(F.get(named, F.lit(0)), reply_tag(reply, tags))


REPLY_RELATIONS = ("SYN", "HYPER", "HYPO", "ANT")


def reply_relations(reply: Column) -> Column:
    """MAP<relation, words> of the JSON block in a reply, from its first brace to its last: the four relations by their name
    or its small letters, each a list of words or of (word, gloss) lists. What is no such list, and a reply without a block
    or with a broken one, gives empty lists."""
    block = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    held = F.from_json(block, "map<string,string>")
    none = F.array().cast("array<string>")

    def words(name: str) -> Column:
        raw = F.coalesce(F.nullif(F.try_element_at(held, F.lit(name)), F.lit("[]")), F.try_element_at(held, F.lit(name.lower())))
        items = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>"))
        first = lambda x: F.when(F.startswith(x, F.lit("[")), F.get(F.from_json(x, "array<string>"), F.lit(0))).otherwise(x)
        return F.filter(F.transform(F.coalesce(items, none), lambda x: F.trim(first(x))), lambda w: w.isNotNull() & (w != ""))

    return F.create_map(*[x for name in REPLY_RELATIONS for x in (F.lit(name), words(name))])


def curve_points(lines: DataFrame) -> DataFrame:
    """(tag, stage, step, total, loss) of training log lines; lines without a step are ignored."""
    pattern = r"(?:\[([a-z_0-9]+)\]\s+)?(.*?)\b(epoch|update)\s+(\d+)/(\d+):?\s+.*?loss\s+([0-9.]+(?:e-?[0-9]+)?)"
    g = lambda i: F.regexp_extract("value", pattern, i)
    return lines.filter(F.col("value").rlike(pattern)).select(
        g(1).alias("tag"), F.trim(F.concat(g(2), g(3))).alias("stage"), g(4).cast("int").alias("step"), g(5).cast("int").alias("total"), g(6).cast("double").alias("loss")
    )


def lexicon_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per ``<pos>_<lemma>`` to (lemma, pos, relation, other); bad names and errors are skipped."""
    raw = spark.read.schema(LEXICON_FILE).option("multiLine", True).json(path).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    pos = F.create_map(*[F.lit(x) for x in ("n", "n", "v", "v", "a", "a", "r", "r")])[F.regexp_extract("name", r"^([a-z])_", 1)]
    ok = raw.withColumn("pos", pos).withColumn("lemma", F.regexp_extract("name", r"^[a-z]_([a-z]{3,})$", 1)).filter("pos is not null and lemma <> '' and _error is null")
    rel = ("synonyms", "hypernyms", "hyponyms", "antonyms", "derivatives")
    both = F.explode(F.array(*[F.struct(F.lit(r).alias("relation"), F.col(r).alias("others")) for r in rel]))
    return ok.select("lemma", "pos", both.alias("x")).select("lemma", "pos", "x.relation", F.explode("x.others").alias("other"))
