import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common, jaccard, langid, line_dedup, lm, quality, shard
from palimpsest.llm.gru import Gru, Trainer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_hashes_do_not_depend_on_place():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé ") for _ in range(rng.choice([1, 5, 70000]))).replace(" ", "x") for _ in range(12)]
    import pyarrow as pa

    one = {w: common.Words(pa.array([w])).hash[0] for w in words}
    got = common.Words(pa.array([" ".join(words[:6]), None, "\n".join(words[6:])]))
    assert got.hash.tolist() == [one[w] for w in words]
    assert got.first.tolist() == [0, 6, 6, 12]
    assert len(set(one.values())) == len(set(words))


# ---- line dedup -------------------------------------------------------------------------------


def brute_lines(rows, min_docs=5, min_chars=40):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    where = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= min_chars and r[0] is not None:
                where[key(line)].add(r[0])
    out = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(where[key(x)]) >= min_docs and r[0] != max(where[key(x)]))]
        out[(r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("probe_keys", [line_dedup.PROBE_KEYS, 0])
def test_line_dedup_equals_brute_force(docs, rows, probe_keys):
    found = line_dedup.dedup_lines(docs, digest=True, probe_keys=probe_keys)
    want = brute_lines(rows)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert any(k[2] for k in want)
    whole = line_dedup.dedup_lines(docs, probe_keys=probe_keys)
    assert whole.columns == [*docs.columns, "n_dropped"]  # n_lines is taken
    assert whole.filter("text is null").count() == 1


def test_line_dedup_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)
    a[:50] = a[0]  # equal halves
    made = line_dedup.Shard.from_bytes(line_dedup.Shard(a, b, np.arange(5000), np.arange(5000)).to_bytes())
    assert sorted(made.hash.index(a, b).tolist()) == list(range(5000))
    held, keeper = made.probe(a, b)
    assert held.all() and keeper.tolist() == list(range(5000))
    assert not made.probe(b, a)[0].any()
    assert line_dedup.PerfectHash(a[:0], b[:0]).size == 0


# ---- quality ----------------------------------------------------------------------------------


def brute_counts(text):
    words, text = WORD.findall(text or ""), text or ""
    grams = defaultdict(list)
    for i in range(len(words) - 4):
        grams[tuple(words[i:i + 5])].append(i)
    covered = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_counts_equal_brute_force(docs, rows, empty):
    found = quality.quality(docs).collect()
    want = Counter((r[0], *brute_counts(r[1])) for r in rows)
    assert Counter(tuple(r)[:6] for r in found) == want
    for r in found:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.quality(empty).count() == 0


def test_quality_thresholds_follow_their_group(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(600):  # source "sym" writes symbols as a rule, source "plain" does not
        words = [word(5) for _ in range(60)]
        if i % 2:
            words = [w + ("#" if k % 2 else "") for k, w in enumerate(words)]
        rows.append((i, " ".join(words), "xx", "sym" if i % 2 else "plain"))
    rows.append((1000, " ".join(word(5) + "#" for _ in range(60)), "xx", "plain"))
    rows.append((1001, " ".join(word(5) for _ in range(60)), "xx", "plain"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.quality(frame).filter("kept").collect()}
    assert 1000 not in kept and 1001 in kept and len(kept) == 601


def test_sketches_merge(docs):
    rows = quality.counted(docs).withColumn("base_failed", quality.base_failed())
    once = quality.sketches(rows)
    parts = rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 <> 0 or doc_id is null")
    both = quality.sketches(parts[0]).union(quality.sketches(parts[1]))
    both = both.groupBy("level", "lang", "source", "feature", "bucket").agg(F.sum("n").alias("n"))
    assert once.exceptAll(both).count() == both.exceptAll(once).count() == 0


# ---- language ID --------------------------------------------------------------------------------


def test_language_is_told_on_held_out_rows(docs, rows, empty):
    found = {r.doc_id: r for r in langid.identify(docs).collect() if r.doc_id is not None}
    for r in rows:
        if r[0] is not None and r[0] != 7:
            assert found[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2)
            assert 0 <= found[r[0]].score <= 1
    ok = [found[r[0]].lang_pred == r[2] for r in rows[:120] if found[r[0]].held_out]
    assert sum(ok) >= 0.95 * len(ok)
    for doc_id in (300, 301, 302, 305):
        assert found[doc_id].lang_pred == "und" and found[doc_id].rejected and found[doc_id].score == 0
    assert langid.identify(empty).count() == 0


def test_nothing_learned_is_unknown(spark):
    frame = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(frame).collect()] == ["und"]


def test_kept_rows_keep_their_columns(docs):
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert kept.filter("text is null or trim(text) = ''").count() == 0 and kept.count() > 100


# ---- shards -------------------------------------------------------------------------------------


def test_shards_are_contiguous_and_even(docs, rows, empty):
    found = shard.shards(docs, n_shards=7).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    by = defaultdict(list)
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    total, most = sum(r.size for r in found), max(r.size for r in found)
    last = -2
    for s in sorted(by):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(by[s], key=lambda r: r.slot)]
        assert ids == sorted(ids) and ids[0] >= last
        last = ids[-1]
        assert abs(sum(r.size for r in by[s]) - total / 7) <= most
    assert shard.shards(empty).count() == 0


def test_one_id_can_fill_several_shards(spark):
    frame = spark.range(4000).selectExpr("cast(5 as bigint) doc_id", "'equal text' text")
    found = shard.shards(frame).groupBy("shard").count().collect()
    assert len(found) == 40 and {r["count"] for r in found} == {100}


# ---- n-gram Jaccard -------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for r in rows:
        words = WORD.findall((r[1] or "").translate(LOW))
        n = min(5, len(words))
        sets.append({tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            common_ = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or 100 * common_ >= 75 * (len(sets[i]) + len(sets[j]) - common_):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least[find(i)], r[0])
    return Counter((r[0], len(sets[i]), least[find(i)] if r[0] is not None else None) for i, r in enumerate(rows))


def test_near_duplicates_equal_brute_force(docs, rows, empty):
    found = jaccard.near_duplicates(docs)
    assert Counter(tuple(r) for r in found.collect()) == brute_components(rows)
    assert jaccard.near_duplicates(empty).count() == 0


def test_long_lists_in_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 0)  # everything is left to the last round
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "CROSS_POSTINGS", 100)
    monkeypatch.setattr(jaccard, "BUCKET_POSTINGS", 500)
    monkeypatch.setattr(jaccard, "PACK_GROUPS", 16)
    assert Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == brute_components(rows)


def test_bitmaps_never_rule_out_a_link():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for most in (400, 3000):
        for _ in range(100):
            n, m = rng.integers(1, most, 2)
            x = rng.integers(0, 2**62, n + m, dtype=np.uint64)
            a, b = x[:n], np.concatenate([x[: n - n // 8], x[n: n + m // 8]])
            maps = jaccard.Bitmaps(pa.array(jaccard._bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))))
            one = np.array([0])
            differ = jaccard.bits_that_differ(maps, one, maps, one + 1)
            same = len(set(a.tolist()) & set(b.tolist()))
            assert differ[0] <= len(a) + len(b) - 2 * same
            if 100 * same >= 75 * (len(a) + len(b) - same):
                assert jaccard.bitmaps_allow(differ, np.array([len(a)]), np.array([len(b)]), 75, 100)[0]


# ---- language model -------------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    model = Gru(np.arange(20, 0, -1).astype(float), hidden=5, width=4)
    for k, v in model.p.items():
        model.p[k] = v.astype(np.float64) + rng.normal(0, 0.2, v.shape) * (v > -1e8)
    seqs = [rng.integers(0, 20, n) for n in (7, 5, 7)]
    held = {}

    class Watched(Trainer):
        def _update(self, grads, n):
            held.update(grads)

    Watched(model).fit(seqs, 3)
    first = np.cumsum([0] + [len(s) for s in seqs])
    loss = lambda: -model.log_likelihood(np.concatenate(seqs), first, 3).sum() * np.log(10)
    for k, v in model.p.items():
        flat, grad = v.reshape(-1), held[k].reshape(-1)
        for i in rng.choice(len(flat), 4):
            if flat[i] > -1e8:
                old = flat[i]
                flat[i] = old + 1e-3
                up = loss()
                flat[i] = old - 1e-3
                down = loss()
                flat[i] = old
                assert abs((up - down) / 2e-3 - grad[i]) < 1e-2 * max(1, abs(grad[i]))


def test_state_goes_over_windows_and_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    model = Gru(rng.integers(1, 99, 30).astype(float), hidden=6, width=4)
    model.p["cw"] += rng.normal(0, 1, model.p["cw"].shape).astype(np.float32)
    ids = rng.integers(0, 30, 700)
    first = np.array([0, 500, 500, 503, 700])
    whole = model.log_likelihood(ids, first, 0, window=1000)
    assert np.allclose(whole, model.log_likelihood(ids, first, 0, window=7), atol=1e-4) and whole[1] == 0
    ends = np.array([model.log_likelihood(np.array([4, 9, k]), np.array([0, 3]), 0)[0] for k in range(30)])
    start = model.log_likelihood(np.array([4, 9]), np.array([0, 2]), 0)[0]
    assert abs((10 ** (ends - start)).sum() - 1) < 1e-4


@pytest.mark.parametrize("lookup", [lm.LOOKUP, 60])
def test_base_scores_equal_brute_force(docs, rows, monkeypatch, lookup):
    monkeypatch.setattr(lm, "LOOKUP", lookup)
    monkeypatch.setattr(lm, "VOCABULARY", 40)
    monkeypatch.setattr(lm, "TRAIN_ONE_IN", 2)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [WORD.findall((r[1] or "").translate(LOW)) for r in rows]
    counts = Counter(w for r, ws in zip(rows, tokens, strict=True) if not out(r[0]) for w in ws)
    ends = sum(not out(r[0]) for r in rows)
    total, types = sum(counts.values()) + ends, len(counts) + 1
    want = sorted(
        (-1 if r[0] is None else r[0], out(r[0]), len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, total,
         round(sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in ws) + np.log10((ends + 1) / (total + types + 1)), 4))
        for r, ws in zip(rows, tokens, strict=True)
    )
    found = lm.score_documents(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:5], round(r.base_score, 4)) for r in found) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in found)


def test_held_out_texts_are_told_better_than_by_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAIN_ONE_IN", 2)
    rng = random.Random(4)
    words = [[f"{x}{k}" for k in range(40)] for x in "ab"]  # two languages without a common word
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(80))) for i in range(600)]
    found = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).filter("held_out").collect()
    gain = sum(r.score - r.base_score for r in found) / sum(r.n_tokens for r in found)
    assert gain > 0.15  # of log10(2) = 0.3 at most


def test_every_training_document_reaches_the_network(spark):
    """At the values in use; no training row's id falls into the share of the first round."""
    rng = random.Random(4)
    words = [[f"{x}{k}" for k in range(40)] for x in "ab"]
    place = "pmod(xxhash64(id, 5), 16)"
    ids = {r.id: r.at for r in spark.range(100).selectExpr("id", f"{place} at").collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    known, asked = next(i for i in ids if ids[i] and not out(i)), next(i for i in ids if out(i))
    rows = [(asked if i >= 600 else known, " ".join(rng.choice(words[i % 2]) for _ in range(80))) for i in range(700)]
    found = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).filter("held_out").collect()
    assert len(found) == 100 and lm.TRAIN_ONE_IN == 16
    assert sum(r.score - r.base_score for r in found) / sum(r.n_tokens for r in found) > 0.15


def test_language_model_of_nothing(empty, spark):
    assert lm.score_documents(empty).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    frame = spark.createDataFrame([(only, "never seen")], "doc_id long, text string")
    got = lm.score_documents(frame).collect()[0]
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0)
