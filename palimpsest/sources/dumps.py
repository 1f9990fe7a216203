"""Prediction dumps: one JSON object per pair with the record, what was predicted for it, and the rows it was decoded from.

JSON lines for exchange, or Parquet with the same nested fields, of which a reader of the links or of the rows reads those alone.
Everything below the pair is bounded by its two passages, so a pair is one row from end to end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.records import read_json

#: Candidates of a word, or of a source word, that a dump keeps.
TOP_K = 6
DIGITS = 5
CELL = "struct<i: int, p: double>"
EDGE = "struct<r: int, s: int, op: string, p: double>"
SPAN = "struct<start: int, end: int, label: string>"
RECORD = "struct<source: array<string>, reuse: array<string>>"
PRED = (
    f"struct<links: array<{EDGE}>, frame_spans: array<{SPAN}>, top: array<array<{CELL}>>, rev_top: array<array<{CELL}>>, "
    "dels: array<int>, tags: array<string>, meta: map<string, string>>"
)
DUMP = f"id string, record {RECORD}, pred {PRED}"


def top_rows(rows: DataFrame, at: str, other: str, places: Column) -> DataFrame:
    """(pair_id, top): per place ``at`` of a pair, in order, its ``TOP_K`` best candidates, the more probable first, then the
    smaller place; a place without a row has none. ``places`` counts the pair's places and is a column of ``rows``."""
    best = F.transform(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("k"), F.col(other).alias("i"), "p"))), 1, TOP_K),
        lambda c: F.struct(c["i"].cast("int").alias("i"), F.round(c["p"], DIGITS).alias("p")),
    )
    per = rows.filter(F.col(at) >= 0).groupBy("pair_id", at).agg(best.alias("best"), F.first(places).alias("n"))
    held = per.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct(at, "best"))).alias("of"), F.first("n").alias("n"))
    none = F.array().cast(f"array<{CELL}>")
    filled = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("of", i.cast("int")), none))
    return held.select("pair_id", filled.alias("top"))


def frame_spans(frame: Column) -> Column:
    """Runs of flagged words as spans that end before ``end``."""
    on = lambda i: F.coalesce(F.get(frame, i), F.lit(0)) == 1
    begins = F.filter(F.sequence(F.lit(0), F.size(frame) - 1), lambda i: on(i) & ((i == 0) | ~on(i - 1)))
    length = lambda b: F.coalesce(F.array_min(F.filter(F.sequence(b, F.size(frame)), lambda j: ~on(j))), F.size(frame))
    return F.transform(begins, lambda b: F.struct(b.cast("int").alias("start"), length(b).cast("int").alias("end"), F.lit("FRAME").alias("label")))


def dump_table(pairs: DataFrame, words: DataFrame, extra: DataFrame, fwd: DataFrame, rev: DataFrame, meta: dict[str, str]) -> DataFrame:
    """The rows of a dump. ``words`` is (pair_id, t, s, tag, frame, p) with one row per reuse word, ``extra`` (pair_id, t, s, op)
    the edges beyond a word's first, ``fwd`` and ``rev`` the rows of both directions, nulls included."""
    word = F.struct("t", "s", "tag", "frame", "p")
    per = words.groupBy("pair_id").agg(F.array_sort(F.collect_list(word)).alias("w"))
    more = extra.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("r"), "s", "op"))).alias("more"))
    sizes = pairs.select("pair_id", "n_s", "n_r")
    top = top_rows(fwd.join(sizes, "pair_id"), "t", "s", F.col("n_r"))
    rev_top = top_rows(rev.join(sizes, "pair_id"), "s", "t", F.col("n_s")).withColumnRenamed("top", "rev_top")
    x = pairs.join(per, "pair_id").join(more, "pair_id", "left").join(top, "pair_id", "left").join(rev_top, "pair_id", "left")
    edge = lambda r, s, op, p: F.struct(r.cast("int").alias("r"), s.cast("int").alias("s"), op.alias("op"), F.round(p, DIGITS).alias("p"))
    first = F.transform(F.filter("w", lambda w: w["s"] >= 0), lambda w: edge(w["t"], w["s"], w["tag"], w["p"]))
    rest = F.transform(F.coalesce("more", F.array()), lambda e: edge(e["r"], e["s"], e["op"], F.lit(None).cast("double")))
    linked = F.transform("w", lambda w: w["s"])
    gone = F.transform(F.sequence(F.lit(0), F.col("n_s") - 1), lambda s: (~F.array_contains(linked, s.cast("int"))).cast("int"))
    return x.select(
        F.col("pair_id").alias("id"), F.struct(F.col("s_tok").alias("source"), F.col("r_tok").alias("reuse")).alias("record"),
        F.struct(
            F.concat(first, rest).alias("links"), frame_spans(F.transform("w", lambda w: w["frame"])).alias("frame_spans"), "top", "rev_top",
            gone.alias("dels"), F.transform("w", lambda w: w["tag"]).alias("tags"), F.create_map(*[F.lit(y) for kv in meta.items() for y in kv]).alias("meta"),
        ).alias("pred"),
    )


def read_dump(spark: SparkSession, path: str, *, fmt: str = "json") -> DataFrame:
    return read_json(spark, path, DUMP) if fmt == "json" else spark.read.schema(DUMP).format(fmt).load(path)


def dump_words(dump: DataFrame) -> DataFrame:
    """(pair_id, t, s, tag, frame, p): the prediction per reuse word. A word's first edge is its link; a stored tag goes before
    the edge's operation; frame flags come from the spans."""
    t = F.sequence(F.lit(0), F.size("record.reuse") - 1)
    links, spans = F.coalesce("pred.links", F.array()), F.coalesce("pred.frame_spans", F.array())
    first = lambda i: F.get(F.filter(links, lambda e: e["r"] == i), F.lit(0))
    flag = lambda i: F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])).cast("int")
    tag = lambda i: F.coalesce(F.nullif(F.get("pred.tags", i), F.lit("")), first(i)["op"], F.lit(""))
    row = lambda i: F.struct(
        i.cast("int").alias("t"), F.coalesce(first(i)["s"], F.lit(-1)).alias("s"), tag(i).alias("tag"), flag(i).alias("frame"), first(i)["p"].alias("p")
    )
    return dump.select(F.col("id").alias("pair_id"), F.inline(F.transform(t, row)))


def dump_extra(dump: DataFrame) -> DataFrame:
    """(pair_id, r, s, op): edges of a word that has one already, and edges outside the reuse."""
    links, n = F.coalesce("pred.links", F.array()), F.size("record.reuse")
    later = F.filter(links, lambda e, i: (e["r"] < 0) | (e["r"] >= n) | F.exists(F.slice(links, F.lit(1), i), lambda z: z["r"] == e["r"]))
    return dump.select(F.col("id").alias("pair_id"), F.inline(later)).drop("p")


def dump_spans(dump: DataFrame) -> DataFrame:
    return dump.select(F.col("id").alias("pair_id"), F.inline("pred.frame_spans"))


def dump_rows(dump: DataFrame, *, reverse: bool = False) -> DataFrame:
    """(pair_id, t, s, p) of the stored rows of either direction; the null of a direction is -1. A pair without stored
    rows gets the null of every word for certain, so that it decodes to no links."""
    field, n = ("pred.rev_top", F.size("record.source")) if reverse else ("pred.top", F.size("record.reuse"))
    certain = F.transform(F.sequence(F.lit(1), n), lambda _: F.array(F.struct(F.lit(-1).alias("i"), F.lit(1.0).alias("p"))))
    held = F.when(F.size(F.col(field)) == n, F.col(field)).otherwise(certain.cast(f"array<array<{CELL}>>"))
    at, other = ("s", "t") if reverse else ("t", "s")
    rows = dump.select(F.col("id").alias("pair_id"), F.posexplode(held).alias(at, "row"))
    return rows.select("pair_id", at, F.inline("row")).select("pair_id", F.col(at), F.col("i").alias(other), "p").select("pair_id", "t", "s", "p")


def distilled(dump: DataFrame, *, teacher: str) -> DataFrame:
    """Teacher labels as records: (id, source, reuse, links, spans, provenance). Every link of the dump is an edge with its
    operation, every run of a formula a span; a pair in which the teacher links nothing stays, for it teaches the null."""
    words = dump_words(dump).filter("s >= 0").groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("t").alias("r"), "s", F.when(F.col("tag") == "", "SUBST").otherwise(F.col("tag")).alias("op")))).alias("links")
    )
    x = dump.join(words.withColumnRenamed("pair_id", "id"), "id", "left")
    none = F.array().cast("array<struct<r:int,s:int,op:string>>")
    return x.select(
        F.concat(F.lit("distill/"), "id").alias("id"), "record.source", "record.reuse", F.coalesce("links", none).alias("links"), F.col("pred.frame_spans").alias("spans"),
        F.create_map(F.lit("links"), F.lit(teacher), F.lit("fine_ops"), F.lit(f"{teacher}-rule-typer")).alias("provenance"),
    )
