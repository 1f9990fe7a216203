"""Language identification by compression.

For every language a raw-content zstandard dictionary is cut from a bounded sample of labelled documents. A text
is compressed in pieces with each dictionary; the language whose dictionary gives the fewest bytes wins. The
margin to the second language, as a share of the best size, becomes the score, and narrow margins are rejected.

Texts are reduced to lower-case letters and single blanks first, so that symbols, digits and capitals, which
differ between documents and not between languages, cost nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, held_out, slices
from palimpsest.plans.lineage import fits

#: The sample: so many documents of each language at most, and so many characters of each.
SAMPLE_DOCS = 512
SAMPLE_CHARS = 512
#: Characters of a text compressed at a time. Short pieces keep a text from becoming its own dictionary.
PIECE_CHARS = 1024
#: Texts up to this length are compressed from every word on, because one size in bytes is too coarse for them.
SHORT_CHARS = 200
#: A margin under this share of the best size is too narrow to tell.
MARGIN = 0.002
#: A margin of this share or more scores 1.
SURE = 0.1
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters_only(text: str | None) -> str:
    """Lower-case words of letters with one blank between them; '' if there is no letter. The class also takes
    numerals that are no decimal digits, so the result is tested for letters where it is short."""
    out = _OTHER.sub(" ", text.lower()).strip() if text else ""
    return out if len(out) > 40 or any(c.isalpha() for c in out) else ""


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Language -> sampled characters, at most ``SAMPLE_DOCS`` x ``SAMPLE_CHARS`` of each, chosen by hash of the
    id among documents whose crc32 modulo 4 is not 2. The number of languages is that of distinct labels."""
    labelled = bounded_batches(docs).select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    # a hash threshold leaves about four times the sample of every language, so no language is sorted whole
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    few = labelled.join(F.broadcast(sizes) if fits(sizes) else sizes, "lang").withColumn("draw", draw).filter(
        F.col("draw") * F.col("n") < F.lit((4 * SAMPLE_DOCS) << 30)
    )
    at = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)))
    part = F.substring(F.col("text"), (at + 1).cast("int"), F.lit(SAMPLE_CHARS))
    order = W.partitionBy("lang").orderBy("draw", "doc_id", "part")
    chosen = few.select("lang", "draw", "doc_id", part.alias("part")).withColumn("rn", F.row_number().over(order))
    out: dict[str, list[str]] = {}
    for row in chosen.filter(F.col("rn") <= SAMPLE_DOCS).orderBy("lang", "rn").collect():
        out.setdefault(row["lang"], []).append(row["part"])
    return out


def dictionaries(parts: dict[str, list[str]]) -> dict[str, bytes]:
    """Raw dictionary contents by language, the languages in order; those without a letter are left out."""
    held = {lang: " ".join(filter(None, map(letters_only, texts))).encode("utf-8") for lang, texts in sorted(parts.items())}
    return {lang: raw for lang, raw in held.items() if raw}


def pieces(plain: str) -> list[bytes]:
    n = len(plain)
    if n <= SHORT_CHARS:
        return [plain[i:].encode("utf-8") for i in [0, *(m.end() for m in re.finditer(" ", plain))]]
    k = round(n / PIECE_CHARS) or 1
    return [plain[i * n // k: (i + 1) * n // k].encode("utf-8") for i in range(k)]


class Compressors:
    def __init__(self, contents: dict[str, bytes]):
        self.langs = list(contents)
        self.by_lang = []
        for raw in contents.values():
            how = zstd.ZstdCompressionParameters(
                window_log=19, hash_log=18, chain_log=18, search_log=3, min_match=4, strategy=zstd.STRATEGY_GREEDY,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            held = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            self.by_lang.append(zstd.ZstdCompressor(dict_data=held, compression_params=how).compress)

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, margin over the second as a share of the best size). Ties go to the first label in order."""
        plain = letters_only(text)
        if not plain or not self.langs:
            return UNKNOWN, 0.0
        parts = pieces(plain)
        sizes = [sum([len(compress(p)) for p in parts]) for compress in self.by_lang]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        return self.langs[best], (min(rest) - sizes[best]) / sizes[best] if rest else 1.0


def _judge(contents: dict[str, bytes], texts: list[str | None]) -> list[tuple[str, float]]:
    if not _OPENED or _OPENED[0] != contents:
        _OPENED[:] = [contents, Compressors(contents)]
    return [_OPENED[1].classify(t) for t in texts]


_OPENED: list = []


def identify(
    docs: DataFrame, contents: dict[str, bytes] | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", margin: float = MARGIN,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row.

    ``lang_pred`` is the best language of the whole text, 'und' if the text is null or has no letter, or if
    nothing could be learned. ``score`` grows with the margin, 0.5 for a tie and 1 from ``SURE`` on; 0 for 'und'.
    ``rejected``: 'und', or the margin is under ``margin``. Predictions read the text alone; repeated rows have equal
    ones. An empty table gives no rows; columns besides the three named are not read.
    """
    contents = dictionaries(sample(docs, id_col, text_col, lang_col)) if contents is None else contents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = _judge(contents, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()),
                    pa.array([0.0 if x[0] == UNKNOWN else 0.5 + 0.5 * min(1.0, x[1] / SURE) for x in found], pa.float64()),
                    pa.array([x[0] == UNKNOWN or x[1] < margin for x in found], pa.bool_()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    number = F.col(f"`{id_col}`").cast("bigint")
    source = bounded_batches(docs).select(number.alias("doc_id"), held_out(number, 4).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is told by at least ``margin``, with their own columns. Texts are judged
    where they are and not moved."""
    contents = dictionaries(sample(docs, "doc_id", "text", "lang"))

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], whole.schema.names[at]):
                found = _judge(contents, batch.column(at).to_pylist())
                kept = batch.filter(pa.array([x[0] != UNKNOWN and x[1] >= margin for x in found], pa.bool_()))
                yield kept.rename_columns(names)

    names = docs.columns
    # columns go by number on the way in, whatever characters their names have
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, docs.schema)
