"""Language-model scores of whole documents.

Words of all training documents are counted in Spark. The most frequent ones become the vocabulary of a gated
recurrent network (:mod:`palimpsest.llm.gru`); every other word is the network's unknown word times the word's
own share among the words outside the vocabulary, so scores are probabilities of the very text.

The network is trained where the documents are: each task trains a copy on its training documents, and copies are
averaged by tokens in Spark. The rounds before the last only give the copies a common start and take a hashed share
of the documents; the last round trains on all of them.

Counts of the more frequent words (up to ``LOOKUP`` of them) go to every task. The rare words a document holds
beyond them are joined to the full counts in Spark; none of them is frequent, so that join has no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Words, bounded_batches, held_out, slices
from palimpsest.llm.gru import Gru, Trainer
from palimpsest.plans.lineage import cut

#: Words of the network's vocabulary, the unknown word and the end among them.
VOCABULARY = 2048
#: One training document in so many trains the network in the rounds before the last, and all of them in the last.
TRAIN_ONE_IN = 16
ROUNDS = 2
#: Texts of a training step, at least and at most: a pass over the texts held has ``PASS_STEPS`` batches where it can.
BATCH_DOCS = (16, 128)
PASS_STEPS = 12
#: Tokens of a step's window, and tokens of the texts that are sorted by length together.
WINDOW = 64
HELD_TOKENS = 6_000_000
#: Copies that are averaged at most; more tasks than that are joined to so many.
COPIES = 4096
#: Words whose counts are sent to every task: 12 bytes each.
LOOKUP = 1_000_000
#: Distinct words a task holds before it passes its counts on.
HELD = 2_000_000


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c): how often every word (as a 64-bit hash) occurs in the texts of ``training``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "c"])

        for batch in slices(batches, "text"):
            new, n = np.unique(Words(batch.column("text")).hash, return_counts=True)
            keys, counts = _totals(np.concatenate([keys, new]), np.concatenate([counts, n]))
            if len(keys) > HELD:
                yield rows()
                keys, counts = keys[:0], counts[:0]
        yield rows()

    return training.select("text").mapInArrow(run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """What every task knows: counts of frequent words, the network's ids, and the totals."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n_words: int, n_types: int, n_docs: int):
        by = np.argsort(words)
        self.words, self.counts = words[by], counts[by]
        self.n_docs = n_docs
        self.total = n_words + n_docs  # N, with the ends
        self.types = n_types + (1 if n_docs else 0)  # V, with the end
        # the vocabulary: most frequent first, ties by hash
        top = np.lexsort((self.words, -self.counts))[: VOCABULARY - 2]
        outside = n_words - int(self.counts[top].sum())
        freq = np.concatenate([self.counts[top], [outside, n_docs]])  # ..., unknown, end
        rank = np.argsort(-freq, kind="stable")
        new = np.empty(len(freq), np.int64)
        new[rank] = np.arange(len(freq))
        self.unknown, self.end, self.freq = int(new[-2]), int(new[-1]), freq[rank].astype(np.float64)
        self.ids = np.full(len(self.words), self.unknown, np.int32)
        self.ids[top] = new[: len(top)]
        self.outside_total = outside + (n_types - len(top)) + 1  # the share of a word outside: (c + 1) of this

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of every word, whether it is there)"""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        # in order, each word once: neighbours in the table are then looked up one after the other
        each, back = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, each), len(self.words) - 1)
        return at[back], (self.words[at] == each)[back]

    def sequences(self, hashes: np.ndarray, first: np.ndarray, found: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(network ids of all texts, each followed by the end, and where each begins); ``found`` is what :meth:`find` says."""
        at, there = found or self.find(hashes)
        ids = np.where(there, self.ids[at], self.unknown) if len(self.ids) else np.full(len(hashes), self.unknown)
        return np.insert(ids, first[1:], self.end), first + np.arange(len(first))


def learn_counts(training: DataFrame) -> tuple[DataFrame, Lexicon]:
    counts = cut(word_counts(training))
    n_docs = training.count()
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # counts by their leading bits: a few thousand rows at most
    leading = "c - c % (1L << greatest(length(bin(c)) - 7, 0))"
    sizes = {r["b"]: r["n"] for r in counts.groupBy(F.expr(leading).alias("b")).agg(F.count("*").alias("n")).collect()}
    least, n = 0, 0
    for b in sorted(sizes, reverse=True):
        n += sizes[b]
        if n > LOOKUP:
            break
        least = b
    frequent = counts.filter(F.col("c") >= least) if n <= LOOKUP or least else counts.limit(0)
    held = frequent.toArrow()  # at most LOOKUP rows
    words, c = (np.asarray(held.column(k)).astype(np.int64) for k in ("word", "c"))
    return counts, Lexicon(words.view(np.uint64), c, int(whole["n"]), int(whole["v"]), n_docs)


# ---- training ------------------------------------------------------------------------------------


def train(training: DataFrame, lexicon, start: np.ndarray | None, rate: float, one_in: int = 1) -> np.ndarray:
    """The average of copies trained on ``training``, weighted by their tokens, from ``start``; with ``one_in``, on
    one document in so many."""
    spark = training.sparkSession
    sent = spark.sparkContext.broadcast(start)
    share = training if one_in == 1 else training.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(one_in)) == 0)
    share = share.select("text")
    if share.rdd.getNumPartitions() > COPIES:
        share = share.coalesce(COPIES)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        model = Gru(known.freq)
        if sent.value is not None:
            model.load(sent.value)
        trainer = Trainer(model, rate)
        held: list[np.ndarray] = []

        def learn() -> None:
            """One pass over the texts held: texts of like length side by side, batches in drawn order."""
            order = np.argsort([len(t) for t in held], kind="stable").tolist()
            size = max(BATCH_DOCS[0], min(BATCH_DOCS[1], len(order) // PASS_STEPS))
            groups = [order[i: i + size] for i in range(0, len(order), size)]
            for k in np.random.default_rng(len(order)).permutation(len(groups)).tolist():
                trainer.fit([held[i] for i in groups[k]], known.end, WINDOW)
            held.clear()

        tokens = 0
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            ids, first = known.sequences(words.hash, words.first)
            held += [ids[a:b].astype(np.int32) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            tokens += len(ids)
            if tokens > HELD_TOKENS:
                learn()
                tokens = 0
        learn()
        part = TaskContext.get().partitionId() % 64
        total = model.vector().astype(np.float64) * trainer.tokens
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([trainer.tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())],
            ["part", "tokens", "total"],
        )

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in rows.column("total"))
        n = int(np.asarray(rows.column("tokens")).sum())
        return pa.table({
            "part": pa.array([0], pa.int32()), "tokens": pa.array([n], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())
        })

    schema = "part int, tokens bigint, total binary"
    sums = share.mapInArrow(fit, schema).filter("tokens > 0").groupBy("part").applyInArrow(add, schema).collect()
    tokens = sum(r["tokens"] for r in sums)  # at most 64 rows of one network each
    if not tokens:
        return Gru(lexicon.value.freq).vector() if start is None else start
    return (sum(np.frombuffer(r["total"], np.float64) for r in sums) / tokens).astype(np.float32)


# ---- the operator --------------------------------------------------------------------------------


_PART = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare binary"


def _scored(source: DataFrame, lexicon, weights) -> DataFrame:
    """Every row's scores but for its rare words, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        model = Gru(known.freq).load(weights.value)
        base_per_token = np.log10(known.total + known.types + 1)
        outside_per_word = np.log10(known.outside_total)
        pending: list[tuple] = []  # columns of a slice but the network's, its ids, and where each text's begin

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([np.zeros(0, np.int32), *[x[1] for x in pending]])
            begin, at = [np.zeros(1, np.int64)], 0
            for _, some, first in pending:
                begin.append(first[1:] + at)
                at += len(some)
            likelihood = model.log_likelihood(ids, np.concatenate(begin), known.end)
            columns = [pa.concat_arrays([x[0][i] for x in pending]) for i in range(7)]
            pending.clear()
            columns[5] = pa.array(np.asarray(columns[5]) + likelihood)
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PART.split(", ")])

        tokens = 0
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            hashes, first = words.hash, words.first
            n = np.diff(first)
            at, there = known.find(hashes)
            c = np.where(there, known.counts[at], 0) if len(known.words) else np.zeros(len(hashes), np.int64)
            logs = np.log10(c + 1.0)
            outside = ~there | (known.ids[at] == known.unknown) if len(known.words) else ~there

            def per_text(x: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(x)])[first])  # noqa: B023

            def summed(x: np.ndarray) -> np.ndarray:
                return np.bincount(np.repeat(np.arange(len(n)), n), weights=x, minlength=len(n))  # noqa: B023

            ids, begin = known.sequences(hashes, first, (at, there))
            beside = summed(np.where(outside, logs, 0.0)) - per_text(outside) * outside_per_word
            base = summed(logs) + np.log10(known.n_docs + 1.0) - (n + 1) * base_per_token
            rare = [hashes[a:b][~there[a:b]].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            columns = [
                batch.column("doc_id"), batch.column("held_out"), pa.array(n + 1, pa.int64()),
                pa.array(per_text(there) + (known.n_docs > 0), pa.int64()), pa.array(base), pa.array(beside), pa.array(rare, pa.binary()),
            ]
            pending.append((columns, ids.astype(np.int32), begin))
            tokens += len(ids)
            if tokens > HELD_TOKENS:
                yield flush()
                tokens = 0
        if pending:
            yield flush()

    return source.select("doc_id", "held_out", "text").mapInArrow(run, _PART)


def _rare_words(rows: DataFrame) -> DataFrame:
    """(key, word, k): the rare words of every row and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x, np.uint64) for x in batch.column("rare").to_pylist()]
            key = np.repeat(np.asarray(batch.column("key")), [len(x) for x in held])
            word = np.concatenate([np.zeros(0, np.uint64), *held])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(word.view(np.int64))], ["key", "word"])

    return rows.select("key", "rare").filter("length(rare) > 0").mapInArrow(run, "key bigint, word bigint")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are the words, A-Z lower-cased, and one end. Rows whose crc32 of the id is 2 modulo 7 are held out; all
    others are counted. ``base_score``: log10 of the add-one unigram probability; ``score``: log10 of the network's.
    A null text is the end alone. Repeated rows count, and are scored, as often as they stand there. Without any
    training row nothing is known and the base score is 0. An empty table gives no rows; other columns are not read.

    ``base_score`` does not depend on how the table is split. ``score`` does: every task trains a copy of the network on
    the training texts of its partition, and the copies are averaged, so another split gives another (equally trained)
    network. Within one network a text's score does not depend on the texts beside it.
    """
    spark = docs.sparkSession
    number = F.col(f"`{id_col}`").cast("bigint")
    source = bounded_batches(docs).select(number.alias("doc_id"), held_out(number, 7).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    training = source.filter("not held_out")
    counts, learned = learn_counts(training)
    lexicon = spark.sparkContext.broadcast(learned)
    weights = None
    for turn in range(ROUNDS):
        weights = train(training, lexicon, weights, 0.01 / (turn + 1), 1 if turn == ROUNDS - 1 else TRAIN_ONE_IN)
    rows = cut(_scored(source, lexicon, spark.sparkContext.broadcast(weights))).withColumn("key", F.monotonically_increasing_id())
    rare = _rare_words(rows).join(counts, "word").groupBy("key").agg(
        F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("known")
    )
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return rows.drop("rare").join(rare, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"),
        F.lit(learned.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
