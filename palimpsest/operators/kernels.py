"""Pair-local numeric kernels for Arrow batches: one row per pair, at most a few hundred cells in it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def least_cost_cells(adj: list[list[tuple[int, float]]], null: list[float]) -> list[int]:
    """Column per row of a minimum-cost assignment, -1 for a row at its own null; by shortest augmenting paths over the cells
    there are. ``adj`` holds (column, cost) per row, columns rising; ``null`` what leaving each row alone costs."""
    row_pot = [0.0] * len(adj)
    col_pot: dict[int, float] = {}
    owner: dict[int, int] = {}
    out = [-1] * len(adj)
    for start in range(len(adj)):
        dist: dict[int, float] = {}
        back: dict[int, int] = {}
        done: dict[int, float] = {}
        row, base = start, 0.0
        alone, last = float("inf"), -1  # the cheapest null reached, and whose it is
        while True:
            pot = row_pot[row]
            for c, w in adj[row]:
                reach = base + w - pot - col_pot.get(c, 0.0)
                if c not in done and reach < dist.get(c, float("inf")):
                    dist[c], back[c] = reach, row
            reach = base + null[row] - pot
            if (reach, row) < (alone, last):
                alone, last = reach, row
            base, col = min(((d, c) for c, d in dist.items()), default=(float("inf"), -1))
            if alone < base:
                base, col = alone, -1
                break
            done[col] = dist.pop(col)
            if col not in owner:
                break
            row = owner[col]
        row_pot[start] += base
        for c, d in done.items():
            if c in owner:
                row_pot[owner[c]] += base - d
            col_pot[c] = col_pot.get(c, 0.0) + d - base
        if col < 0:
            row, col = last, out[last]
            out[row] = -1
        else:
            row = -1
        # the path is turned over from its end: a freed column goes to the row it was reached from
        while row != start:
            row = back[col]
            owner[col] = row
            out[row], col = col, out[row]
    return out


def least_cost(cost: np.ndarray) -> np.ndarray:
    """Column per row of a minimum-cost assignment of a whole matrix (rows <= columns)."""
    return np.array(least_cost_cells([list(enumerate(row)) for row in cost.tolist()], [float("inf")] * len(cost)))


def _links(cells: Iterable[tuple[int, int, float]], nulls: bool) -> list[tuple[int, int]]:
    """The best links of a pair's cells (t, s, p): with ``nulls`` the greatest sum, else the most links, then the least cost."""
    null: dict[int, float] = {}
    at: dict[int, list[tuple[int, float]]] = {}
    total = 1.0
    for t, s, p in cells:
        total += abs(p) + 1.0
        if s < 0:
            null[t] = -p
        else:
            at.setdefault(t, []).append((s, -p if nulls else p))
    words = sorted(at)
    # a word's null costs its probability, or more than any pairing
    picked = least_cost_cells([sorted(at[t]) for t in words], [null.get(t, 0.0) if nulls else total for t in words])
    return [(t, s) for t, s in zip(words, picked) if s >= 0]


def assignment_batches(batches: Iterator[pa.RecordBatch], nulls: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ts, ss = [], [], []
        cells = batch.column(1)
        t, s, p = (x.to_pylist() for x in cells.flatten().flatten())
        upto = np.cumsum(pc.list_value_length(cells).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        a = 0
        for pair, b in zip(batch.column(0).to_pylist(), upto):
            for link in _links(zip(t[a:b], s[a:b], p[a:b]), nulls):
                ids.append(pair)
                ts.append(link[0])
                ss.append(link[1])
            a = b
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(ts, pa.int32()), pa.array(ss, pa.int32())], ["pair_id", "t", "s"]
        )


def grown_links(both: list[tuple[int, int]], one: list[tuple[int, int]], final: str) -> list[tuple[int, int]]:
    """Grow-diag-final of one pair: ``both`` are the points of either direction, ``one`` the others in (t, s) order."""
    got = set(both)
    words, sources = {t for t, _ in both}, {s for _, s in both}

    def add(t: int, s: int) -> None:
        got.add((t, s))
        words.add(t)
        sources.add(s)

    near = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
    # the first open point in order joins, then all are looked at anew, until none is open
    more = True
    while more:
        more = False
        for t, s in one:
            if (t, s) not in got and not (t in words and s in sources) and any((t + i, s + j) in got for i, j in near):
                add(t, s)
                more = True
                break
    for t, s in one:
        used = (t in words or s in sources) if final == "and" else (t in words and s in sources)
        if (t, s) not in got and not used:
            add(t, s)
    return list(got)


def grown_batches(batches: Iterator[pa.RecordBatch], final: str) -> Iterator[pa.RecordBatch]:
    """(pair_id, t, s, rank) of Arrow rows (pair_id, u ARRAY<STRUCT<t, s, k, p>>), whose points lie in (t, s) order; k = 3 for
    both. A word's links are ranked by p, then by the larger source."""
    for batch in batches:
        ids, ts, ss, ranks = [], [], [], []
        points = batch.column(1)
        t, s, k, p = (x.to_pylist() for x in points.flatten().flatten())
        upto = np.cumsum(pc.list_value_length(points).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        a = 0
        for pair, b in zip(batch.column(0).to_pylist(), upto):
            rated = {(t[i], s[i]): p[i] for i in range(a, b)}
            both = [(t[i], s[i]) for i in range(a, b) if k[i] == 3]
            one = [(t[i], s[i]) for i in range(a, b) if k[i] != 3]
            word, rank = None, 0
            for link in sorted(grown_links(both, one, final), key=lambda x: (x[0], -rated[x], -x[1])):
                rank = rank + 1 if link[0] == word else 1
                word = link[0]
                ids.append(pair)
                ts.append(word)
                ss.append(link[1])
                ranks.append(rank)
            a = b
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), *(pa.array(x, pa.int32()) for x in (ts, ss, ranks))], ["pair_id", "t", "s", "rank"]
        )


class HitIndex(NamedTuple):
    """An inverted index: the words, where each word's passages begin in ``at``, and the passages' ids."""

    words: pa.Array
    start: np.ndarray
    at: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, words: pa.ChunkedArray, pids: pa.ChunkedArray) -> "HitIndex":
        ids, at = np.unique(pids.to_numpy(), return_inverse=True)
        coded = words.combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]).astype(np.int64)
        return cls(coded.dictionary, start, at[np.argsort(code, kind="stable")].astype(np.int64), ids)


#: Hits counted at once: 8 bytes each, in a few arrays.
HITS = 2_000_000


def hit_batches(batches: Iterator[pa.RecordBatch], index: HitIndex, min_shared: int) -> Iterator[pa.RecordBatch]:
    """(pid, txt, hits) of the passages (pid, txt, words) that share ``min_shared`` words with a passage of the index."""
    kind = pa.list_(pa.struct([("c", pa.int64()), ("n_shared", pa.int64())]))
    for batch in batches:
        row = pc.list_parent_indices(batch.column(2)).to_numpy(zero_copy_only=False)
        code = pc.index_in(batch.column(2).flatten(), value_set=index.words).fill_null(-1).to_numpy(zero_copy_only=False)
        row, code = row[code >= 0], code[code >= 0]
        n = index.start[code + 1] - index.start[code]
        upto = np.cumsum(n)
        # pieces end between passages; one passage has at most its words' passages
        ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1 if len(row) else np.zeros(0, np.int64)
        keys, counts, a = [], [], 0
        while a < len(row):
            base = upto[a - 1] if a else 0
            b = int(ends[max(np.searchsorted(upto[ends - 1], base + HITS, side="right") - 1, np.searchsorted(ends, a, side="right"))])
            size = n[a:b]
            first = np.repeat(index.start[code[a:b]] - (upto[a:b] - size - base), size)
            at = index.at[first + np.arange(len(first))]
            key, count = np.unique(np.repeat(row[a:b], size).astype(np.int64) * max(len(index.ids), 1) + at, return_counts=True)
            keys.append(key[count >= min_shared])
            counts.append(count[count >= min_shared])
            a = b
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        held, begin = np.unique(key // max(len(index.ids), 1), return_index=True)
        hits = pa.StructArray.from_arrays([pa.array(index.ids[key % max(len(index.ids), 1)], pa.int64()), pa.array(count, pa.int64())], ["c", "n_shared"])
        offsets = pa.array(np.append(begin, len(key)).astype(np.int32))
        taken = pa.array(held, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(taken), batch.column(1).take(taken), pa.ListArray.from_arrays(offsets, hits).cast(kind)], ["pid", "txt", "hits"]
        )


def most_shared(queries: pa.Table, passages: pa.Table) -> pa.Table:
    """(qid, n_shared, pid, txt): for every query (qid, forms) the two passages (pid, txt, forms, rows, not_for) that hold most of
    its forms, each counted once for every row the passage has, the smaller pid first; never one whose ``not_for`` names the
    query, nor one without a form of it."""
    passages = passages.sort_by("pid")
    n = passages.num_rows
    col = lambda table, name: table.column(name).combine_chunks()
    words = col(passages, "forms")
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    df = np.bincount(code, minlength=len(coded.dictionary)) if len(code) else np.zeros(0, np.int64)
    start = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
    at = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)[np.argsort(code, kind="stable")]
    # the passages of a frequent form are marked in a row of their own; at most 32 times a passage's forms are frequent
    marked: dict[int, np.ndarray] = {}
    for c in np.flatnonzero(df > n // 32).tolist():
        marked[c] = np.zeros(n, np.int16)
        marked[c][at[start[c] : start[c + 1]]] = 1
    times = col(passages, "rows").to_numpy(zero_copy_only=False)
    often = bool((times > 1).any())
    qids = col(queries, "qid").to_numpy(zero_copy_only=False)
    barred: dict[int, list[int]] = {}
    lists = col(passages, "not_for")
    for p, q in zip(pc.list_parent_indices(lists).to_pylist(), lists.flatten().to_pylist()):
        barred.setdefault(q, []).append(p)
    asked = col(queries, "forms")
    found = pc.index_in(asked.flatten(), value_set=coded.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
    upto = np.cumsum(pc.list_value_length(asked).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    out: list[tuple[int, int, int]] = []
    a = 0
    for q, b in zip(qids.tolist(), upto):
        count = np.zeros(n, np.int16)
        for c in found[a:b].tolist():
            if c in marked:
                count += marked[c]
            elif c >= 0:
                count[at[start[c] : start[c + 1]]] += 1
        a = b
        count[barred.get(q, [])] = 0
        count = count * times if often else count
        for _ in range(2):
            best = int(count.argmax()) if n else 0
            if not n or not count[best]:
                break
            out.append((q, int(count[best]), best))
            count[best] = 0
    q, k, best = (pa.array([x[i] for x in out], pa.int64()) for i in range(3))
    return pa.table({"qid": q, "n_shared": k, "pid": col(passages, "pid").take(best), "txt": col(passages, "txt").take(best)})


def replicate_weights(keys: list[bytes], tails: list[bytes], steps: np.ndarray) -> np.ndarray:
    """[key, replicate] how often a key's row counts: the quantile of the first 32 bits of md5(key + tail) over ``steps``."""
    digests = b"".join([md5(key + tail).digest() for key in keys for tail in tails])
    u = np.frombuffer(digests, ">u4")[::4].reshape(len(keys), len(tails)) / 4294967296.0
    return np.searchsorted(steps, u, side="right")


def weight_batches(batches: Iterator[pa.RecordBatch], replicates: int, steps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(score, b, pos, neg): per score of a batch (score, gold, key) the summed weights of both classes, one number per
    replicate; replicate 0 counts a row once. ``b`` is the score's bucket."""
    tails = [f"|{i}".encode() for i in range(1, replicates + 1)]
    for batch in batches:
        if not batch.num_rows:
            continue
        score, gold = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        weight = np.ones((len(score), replicates + 1), np.int64)
        weight[:, 1:] = replicate_weights([k.encode() for k in batch.column(2).to_pylist()], tails, steps)
        order = np.argsort(score, kind="stable")
        score, gold, weight = score[order], gold[order], weight[order]
        begin = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        sums = [np.add.reduceat(weight * (gold == g)[:, None], begin, axis=0) for g in (1, 0)]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1) * (replicates + 1), pa.int32()), pa.array(x.ravel(), pa.int64())) for x in sums]
        at = score[begin]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.floor(at * 4096).astype(np.int64)), *lists], ["score", "b", "pos", "neg"])


def bucket_areas(rows: pa.Table) -> pa.Table:
    """(b, rep, won, pos, neg) of one bucket's rows (score, b, pos, neg): per replicate the pairs won inside it and its weights."""
    rows = rows.sort_by("score")
    score = rows.column("score").to_numpy()
    pos, neg = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(score), -1) for c in ("pos", "neg"))
    begin = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    pos, neg = (np.add.reduceat(x, begin, axis=0) for x in (pos, neg))
    won = (pos * (np.cumsum(neg, axis=0) - neg / 2.0)).sum(axis=0)
    n = len(won)
    return pa.table({"b": pa.array(np.full(n, rows.column("b")[0].as_py())), "rep": pa.array(np.arange(n), pa.int32()), "won": won, "pos": pos.sum(axis=0), "neg": neg.sum(axis=0)})


#: Cosines computed at once, at 8 bytes.
COSINES = 4_000_000


def close_batches(batches: Iterator[pa.RecordBatch], words: pa.Array, units: np.ndarray, floor: float) -> Iterator[pa.RecordBatch]:
    """(la, lb) of every word lb of the batches (lemma, vec, len) whose cosine with word la of ``words`` is at least ``floor``;
    ``units`` holds a vector of length one per word."""
    step = max(1, COSINES // max(len(words), 1))
    for batch in batches:
        vec = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, units.shape[1])
        vec = vec / batch.column(2).to_numpy(zero_copy_only=False)[:, None]
        for start in range(0, batch.num_rows, step):
            b, a = np.nonzero(vec[start : start + step] @ units.T >= floor)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), batch.column(0).take(pa.array(b + start))], ["la", "lb"])


def forward_backward(theta: np.ndarray, jump: np.ndarray, p0: float, smooth: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors [I + 1, J] (row 0 the null), expected jump counts and the log-likelihood of one pair.

    ``theta`` is [I + 1, J] with the null in row 0; every source place has a null twin that remembers it.
    """
    n, length = theta.shape[0] - 1, theta.shape[1]
    reach = (len(jump) - 1) // 2
    place = np.arange(n)
    width = np.clip(place[None, :] - place[:, None], -reach, reach) + reach
    move = jump[width] / jump[width].sum(axis=1, keepdims=True)
    real = (1.0 - p0) * ((1.0 - smooth) * move + smooth / n)
    emit = theta[1:]
    null = theta[0]
    # alpha over real places and over their null twins; both leave from the same remembered place
    a_real, a_null = np.zeros((n, length)), np.zeros((n, length))
    scale = np.zeros(length)
    for j in range(length):
        if j == 0:
            r, z = (1.0 - p0) / n * np.ones(n), p0 / n * np.ones(n)
        else:
            mass = a_real[:, j - 1] + a_null[:, j - 1]
            r, z = mass @ real, p0 * mass
        r, z = r * emit[:, j], z * null[j]
        scale[j] = max(r.sum() + z.sum(), 1e-300)
        a_real[:, j], a_null[:, j] = r / scale[j], z / scale[j]
    # both twins of a place see the same future, so one beta per place is enough
    beta = np.ones((n, length))
    counts = np.zeros(len(jump))
    for j in range(length - 2, -1, -1):
        nxt = beta[:, j + 1] / scale[j + 1]
        beta[:, j] = real @ (emit[:, j + 1] * nxt) + p0 * null[j + 1] * nxt
    for j in range(1, length):
        mass = a_real[:, j - 1] + a_null[:, j - 1]
        step = mass[:, None] * real * (emit[:, j] * beta[:, j] / scale[j])[None, :]
        np.add.at(counts, width.ravel(), step.ravel())
    gamma = np.vstack([(a_null * beta).sum(axis=0, keepdims=True), a_real * beta])
    gamma /= np.maximum(gamma.sum(axis=0, keepdims=True), 1e-300)
    return gamma, counts, float(np.log(scale).sum())


def hmm_batches(
    batches: Iterator[pa.RecordBatch], jump: list[float], p0: float, smooth: float
) -> Iterator[pa.RecordBatch]:
    """Rows (pair_id, n_s, n_r, cells[(t, s, theta)]) to posteriors, jump counts (t = -1) and the
    log-likelihood (t = -2)."""
    jumps = np.array(jump)
    for batch in batches:
        ids, ts, ss, ps = [], [], [], []
        for pair, n_s, n_r, cells in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            theta = np.full((n_s + 1, n_r), 1e-6)
            for c in cells:
                theta[c["s"] + 1, c["t"]] = c["theta"]
            gamma, counts, ll = forward_backward(theta, jumps, p0, smooth)
            grid_s, grid_t = np.meshgrid(np.arange(-1, n_s), np.arange(n_r), indexing="ij")
            ids += [pair] * (gamma.size + len(counts) + 1)
            ts += grid_t.ravel().tolist() + [-1] * len(counts) + [-2]
            ss += grid_s.ravel().tolist() + list(range(len(counts))) + [0]
            ps += gamma.ravel().tolist() + counts.tolist() + [ll]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(ts, pa.int32()), pa.array(ss, pa.int32()), pa.array(ps, pa.float64())],
            ["pair_id", "t", "s", "p"],
        )


def balance(z: np.ndarray, iters: int) -> np.ndarray:
    """Log-domain row and column normalisation of one pair's scores [J + 1, I + 1], the null bins last."""
    n_r, n_s = z.shape[0] - 1, z.shape[1] - 1
    norm = -np.log(n_r + n_s)
    mu, nu = np.full(n_r + 1, norm), np.full(n_s + 1, norm)
    mu[n_r] += np.log(n_s)
    nu[n_s] += np.log(n_r)
    u, v = np.zeros(n_r + 1), np.zeros(n_s + 1)
    for _ in range(iters):
        u = mu - np.log(np.exp(z + v).sum(axis=1))
        v = nu - np.log(np.exp(z + u[:, None]).sum(axis=0))
    return np.exp(z + u[:, None] + v - norm)


def sinkhorn_batches(batches: Iterator[pa.RecordBatch], iters: int) -> Iterator[pa.RecordBatch]:
    """Rows (pair_id, n_s, n_r, cells[(t, s, p)], the null at s = -1) to the balanced p of the same cells."""
    for batch in batches:
        cells = batch.column(3).flatten()
        t, s, p = (np.asarray(cells.field(i)) for i in range(3))
        n_s, n_r = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        sizes = np.asarray(batch.column(3).value_lengths())
        ends = np.cumsum(sizes)
        out = np.zeros(len(p))
        for k, (a, b) in enumerate(zip(ends - sizes, ends)):
            z = np.full((n_r[k] + 1, n_s[k] + 1), -30.0)
            z[n_r[k]] = 0.0
            # the null column stands at s = n_s, the last one
            z[t[a:b], s[a:b]] = np.log(np.maximum(p[a:b], 1e-12))
            out[a:b] = balance(z, iters)[t[a:b], s[a:b]]
        pair = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays([pair, cells.field(0), cells.field(1), pa.array(out)], ["pair_id", "t", "s", "p"])
