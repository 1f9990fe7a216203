"""Quality rules with adaptive thresholds.

Features are counted per document. Per language and source, every feature has a quantile sketch: counts by
bucket, a bucket being a whole number with all but its leading seven bits cleared (relative width 1/64). Sketches
merge by adding counts, in any order and from any number of tasks, so they are one grouped count in Spark. Each
group's own median and quartiles give its thresholds: a value further from the median than ``reach`` spreads is an
outlier. Small groups use their language's thresholds, small languages those of the whole table. Thresholds come
back to the documents by a join on language and source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import Words, bounded_batches, hash_spans, mix64, slices, spans
from palimpsest.plans.lineage import cut, fits

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1

#: name -> (value in whole numbers, smallest spread that counts, whether low values are outliers too).
#: A spread is the distance between the median and a quartile; the floors keep groups of nearly equal
#: documents from rejecting ordinary ones.
FEATURES: dict[str, tuple[str, int, bool]] = {
    "word_length": ("word_chars * 100 div nullif(n_words, 0)", 60, True),  # hundredths of a code point per word
    "symbols": ("n_symbols * 1000 div nullif(n_words, 0)", 40, False),  # per thousand words
    "dup_lines": ("n_dup_lines * 1000 div nullif(n_lines, 0)", 100, False),  # per thousand lines with a word
    "repeats": ("n_repeat_words * 1000 div nullif(n_words, 0)", 40, False),  # per thousand words
}
REACH = 6
MIN_GROUP = 200


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is there an equal key, is there an equal key before)"""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    same = held[1:] == held[:-1]
    later, some = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    some[order[1:]] = same
    some[order[:-1]] |= same
    return some, later


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a column, and ``n_lines``, its lines with a word."""
    words = Words(column, lower=False)
    data, offsets, first = words.data, words.offsets, words.first
    n_words = np.diff(first)

    def total(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets])

    n_blank = total(np.isin(data, list(b" \t\n\x0b\x0c\r")))
    n_points = total((data & 0xC0) != 0x80)
    out = {"n_words": n_words, "word_chars": n_points - n_blank, "n_symbols": total(_SYMBOL[data])}

    start, end = spans(data != 10, offsets)
    with_word = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    start, end = start[with_word], end[with_word]
    text = np.searchsorted(offsets, start, side="right") - 1
    _, later = _repeated(hash_spans(data, start, end) ^ mix64(text.astype(np.uint64)))
    out["n_lines"] = np.bincount(text, minlength=len(column))
    out["n_dup_lines"] = np.bincount(text[later], minlength=len(column))

    window, w_first = words.windows(WINDOW)
    of = np.repeat(np.arange(len(column)), np.diff(w_first))
    some, _ = _repeated(window ^ mix64(of.astype(np.uint64)))
    begin = first[of[some]] + np.flatnonzero(some) - w_first[of[some]]
    edge = np.bincount(begin, minlength=first[-1] + 1) - np.bincount(begin + WINDOW, minlength=first[-1] + 1)[: first[-1] + 1]
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[: first[-1]] > 0)])
    out["n_repeat_words"] = np.diff(covered[first])
    return out


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = count_texts(batch.column("text"))
            named = {n: batch.column(n) for n in ("doc_id", "lang", "source")}
            named |= {n: pa.array(found[n], pa.int64()) for n in ("n_lines", *COUNTS)}
            yield pa.RecordBatch.from_arrays(list(named.values()), names=list(named))

    source = bounded_batches(docs).selectExpr(
        f"cast(`{id_col}` as bigint) doc_id", f"cast(`{lang_col}` as string) lang",
        f"cast(`{source_col}` as string) source", f"`{text_col}` text",
    )
    schema = "doc_id bigint, lang string, source string, n_lines bigint, " + ", ".join(f"{n} bigint" for n in COUNTS)
    return source.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def bucket(value: str) -> str:
    """SQL for the sketch's bucket of a whole number >= 0: all but its leading seven bits cleared."""
    return f"({value}) - ({value}) % (1L << greatest(length(bin({value})) - 7, 0))"


def sketches(rows: DataFrame) -> DataFrame:
    """(level, lang, source, feature, bucket, n): counts by bucket for each language and source, each language,
    and the whole table (level 2, 1, 0), of the rows that the base rules keep."""
    named = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.expr(bucket(value)).alias("bucket"))
        for name, (value, _, _) in FEATURES.items()
    ])
    finest = (
        rows.filter("not base_failed").select("lang", "source", F.explode(named).alias("x"))
        .groupBy("lang", "source", "x.feature", "x.bucket").agg(F.count("*").alias("n"))
    )
    # coarser sketches are sums of finer ones
    levels = F.array(*[
        F.struct(
            F.lit(level).alias("level"), (F.col("lang") if level else F.lit(None)).alias("lang"),
            (F.col("source") if level == 2 else F.lit(None)).alias("source"),
        )
        for level in (2, 1, 0)
    ])
    return (
        finest.select(F.explode(levels).alias("g"), "feature", "bucket", "n")
        .groupBy("g.level", "g.lang", "g.source", "feature", "bucket").agg(F.sum("n").alias("n"))
    )


def thresholds(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(level, lang, source, n_docs, and low_/high_ of every feature), from merged sketches."""
    group = ["level", "lang", "source", "feature"]
    upto = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    cum = found.withColumn("_c", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(W.partitionBy(*group)))
    quartiles = cum.groupBy(*group).agg(
        F.max("_all").alias("n_docs"),
        *[F.min(F.when(F.col("_c") * 4 >= F.col("_all") * k, F.col("bucket"))).alias(f"q{k}") for k in (1, 2, 3)],
    )
    low, high = [], []
    for name, (_, floor, two_sided) in FEATURES.items():
        here = F.col("feature") == name
        high.append(F.max(F.when(here, F.expr(f"q2 + {reach} * greatest(q2 - q1, {floor})"))).alias(f"high_{name}"))
        if two_sided:
            low.append(F.max(F.when(here, F.expr(f"q2 - {reach} * greatest(q3 - q2, {floor})"))).alias(f"low_{name}"))
    return quartiles.groupBy("level", "lang", "source").agg(F.max("n_docs").alias("n_docs"), *low, *high)


def _limits() -> list[str]:
    return [f"low_{n}" for n, f in FEATURES.items() if f[2]] + [f"high_{n}" for n in FEATURES]


def judged(rows: DataFrame, reach: int = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """``rows`` of :func:`counted` with ``base_failed`` and ``kept``."""
    rows = cut(rows.withColumn("base_failed", base_failed()))
    limits = cut(thresholds(sketches(rows), reach))
    for level, keys in ((2, ["lang", "source"]), (1, ["lang"]), (0, [])):
        own = limits.filter((F.col("level") == level) & (F.col("n_docs") >= (min_group if level else 0))).select(
            *[F.col(k).alias(f"_{k}{level}") for k in keys], *[F.col(n).alias(f"{n}_{level}") for n in _limits()]
        )
        on = [F.col(k).eqNullSafe(F.col(f"_{k}{level}")) for k in keys] or [F.lit(True)]
        side = F.broadcast(own) if not keys or fits(own) else own
        rows = rows.join(side, on, "left").drop(*[f"_{k}{level}" for k in keys])
    inside = F.lit(True)
    for name, (value, _, two_sided) in FEATURES.items():
        v = F.expr(value)
        pick = lambda side: F.coalesce(*[F.col(f"{side}_{name}_{level}") for level in (2, 1, 0)])  # noqa: B023, E731
        inside = inside & (v <= pick("high"))
        if two_sided:
            inside = inside & (v >= pick("low"))
    kept = F.coalesce(~F.col("base_failed") & inside, F.lit(False))
    return rows.withColumn("kept", kept).drop(*[f"{n}_{level}" for n in _limits() for level in (2, 1, 0)])


def quality(
    docs: DataFrame, reach: int = REACH, min_group: int = MIN_GROUP, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    A null text has no words and fails the base rules; null languages and sources are groups of their own.
    Repeated rows are judged alike and count as often as they stand there. The verdict does not depend on order,
    partitions or ties. An empty table gives no rows; other columns are not read.
    """
    return judged(counted(docs, id_col, text_col, lang_col, source_col), reach, min_group).select(
        "doc_id", *COUNTS, "base_failed", "kept"
    )


def keep_quality(docs: DataFrame, reach: int = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with their own columns; rows with one id go or stay
    together, and stay if one of them is kept. A row without an id is judged with the others without one."""
    mark = "_kept" + "_" * max(len(n) for n in docs.columns)
    good = quality(docs, reach, min_group).filter("kept").select(F.col("doc_id").alias(mark)).distinct()
    on = docs["doc_id"].cast("bigint").eqNullSafe(F.col(mark))
    return docs.join(F.broadcast(good) if fits(good) else good, on, "left_semi")
