"""A gated recurrent language model in numpy with a class-factored softmax.

Words of the model's vocabulary are ids in order of frequency; class k holds ids k*S to (k+1)*S-1, so a word costs
one softmax over classes and one over the words of its class. Biases start at the logs of the counts: before
any training the model is the unigram model, and training adds what depends on the state.
"""

from __future__ import annotations

import numpy as np

_SHUT = -1e9
#: Rows of a softmax at a time: a whole window of a batch, so each class is one product.
_ROWS = 8192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.tanh(0.5 * x)
    out += 1.0
    out *= 0.5
    return out


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of column ``at`` of every row, the rows' sums of exponentials). ``x`` becomes the exponentials, so
    one pass of them serves values and gradients."""
    rows = np.arange(len(x))
    x -= x.max(axis=-1, keepdims=True)
    chosen = x[rows, at]
    np.exp(x, out=x)
    total = x.sum(axis=-1)
    return chosen - np.log(total), total


class Gru:
    """Parameters in ``p``: embedding, input and recurrent weights of the gates (update, reset, new), class and
    word outputs."""

    def __init__(self, counts: np.ndarray, hidden: int = 24, width: int = 16, seed: int = 1):
        n = len(counts)
        self.hidden, self.size = hidden, max(1, int(np.ceil(np.sqrt(n))))
        classes = -(-n // self.size)
        rng = np.random.default_rng(seed)
        full = np.zeros(classes * self.size)
        full[:n] = counts + 1.0
        full = full.reshape(classes, self.size)
        self.p = {
            "embed": rng.normal(0, 0.3, (n, width)),
            "wx": rng.normal(0, 0.4 / np.sqrt(width), (width, 3 * hidden)),
            "wb": np.concatenate([np.ones(hidden), np.zeros(2 * hidden)]),  # states are kept at first
            "wh": rng.normal(0, 0.6 / np.sqrt(hidden), (hidden, 3 * hidden)),
            "cw": np.zeros((classes, hidden)),
            "cb": np.log(full.sum(axis=1) / full.sum()),
            "ow": np.zeros((classes, self.size, hidden)),
            "ob": np.where(full > 0, np.log(np.maximum(full, 1e-9)), _SHUT),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    # ---- parameters as one vector, to be averaged ----------------------------------------------

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(np.float32)

    def load(self, flat: np.ndarray) -> "Gru":
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at: at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    # ---- forward -----------------------------------------------------------------------------------

    def _step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        m = self.hidden
        g = h @ self.p["wh"]
        zr = _sigmoid(x[:, : 2 * m] + g[:, : 2 * m])
        z, r = zr[:, :m], zr[:, m:]
        new = np.tanh(x[:, 2 * m:] + r * g[:, 2 * m:])
        return new + z * (h - new), z, r, new, g[:, 2 * m:]

    def _outputs(self, states: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log probability of every target given its state; with ``grads``, adds the gradients of the
        negative sum to it and returns those of the states as well."""
        p, size = self.p, self.size
        out = np.zeros(len(target))
        back = None if grads is None else np.empty_like(states)
        for begin in range(0, len(target), _ROWS):
            part = slice(begin, begin + _ROWS)
            kind = target[part] // size
            order = np.argsort(kind, kind="stable")  # rows of one class side by side
            kind, slot, here = kind[order], (target[part] % size)[order], states[part][order]
            rows = np.arange(len(kind))
            outer = here @ p["cw"].T
            outer += p["cb"]
            log_kind, total_kind = _softmax(outer, kind)
            cuts = np.flatnonzero(np.diff(kind, prepend=-1))
            classes = list(zip(kind[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(kind)], strict=True))
            inner = np.empty((len(kind), size), here.dtype)
            for k, a, b in classes:
                np.matmul(here[a:b], p["ow"][k].T, out=inner[a:b])
                inner[a:b] += p["ob"][k]
            log_slot, total_slot = _softmax(inner, slot)
            out[begin + order] = log_kind.astype(np.float64) + log_slot
            if grads is None:
                continue
            d = outer
            d /= total_kind[:, None]
            d[rows, kind] -= 1
            grads["cw"] += d.T @ here
            grads["cb"] += d.sum(axis=0)
            d_here = d @ p["cw"]
            d = inner
            d /= total_slot[:, None]
            d[rows, slot] -= 1
            for k, a, b in classes:
                grads["ow"][k] += d[a:b].T @ here[a:b]
                d_here[a:b] += d[a:b] @ p["ow"][k]
            if len(cuts):
                grads["ob"][kind[cuts]] += np.add.reduceat(d, cuts, axis=0)
            back[begin + order] = d_here
        return out, back

    def log_likelihood(self, ids: np.ndarray, first: np.ndarray, begin: int, window: int = 32) -> np.ndarray:
        """log10 probability of every sequence ids[first[i]: first[i + 1]]. Each starts from the zero state and the
        token ``begin``; all are walked in windows, the state carried from one window to the next, to the end."""
        length = np.diff(first)
        total = np.zeros(len(length))
        order = np.argsort(-length, kind="stable")
        inputs = (self.p["embed"] @ self.p["wx"] + self.p["wb"]).astype(np.float32)
        previous = np.concatenate([[begin], ids[:-1]]).astype(np.int64) if len(ids) else ids
        previous[first[:-1][length > 0]] = begin
        start, left = first[:-1][order], length[order]
        h = np.zeros((len(order), self.hidden), np.float32)
        most = int(left.max(initial=0))
        longer = np.searchsorted(-left, -np.arange(most), side="left").tolist()  # sequences longer than t
        for at in range(0, most, window):
            states, target, owner = [], [], []
            for t in range(at, min(most, at + window)):
                n = longer[t]
                h = h[:n]
                where = start[:n] + t
                h = self._step(inputs[previous[where]], h)[0]
                states.append(h)
                target.append(ids[where])
                owner.append(order[:n])
            found, _ = self._outputs(np.concatenate(states), np.concatenate(target).astype(np.int64))
            total += np.bincount(np.concatenate(owner), weights=found, minlength=len(total))
        return total / np.log(10.0)


class Trainer:
    """Truncated backpropagation through time with Adam."""

    def __init__(self, model: Gru, rate: float = 0.01):
        self.model, self.rate, self.turn, self.tokens = model, rate, 0, 0
        self.mean = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.var = {k: np.zeros_like(v) for k, v in model.p.items()}

    def _update(self, grads: dict[str, np.ndarray], n: int) -> None:
        self.turn += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / n
        scale = (1.0 / n) * min(1.0, 1.0 / max(norm, 1e-12))
        for k, g in grads.items():
            g = g * scale
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.var[k] += 0.001 * (g * g - self.var[k])
            step = (self.mean[k] / (1 - 0.9**self.turn)) / (np.sqrt(self.var[k] / (1 - 0.999**self.turn)) + 1e-8)
            self.model.p[k] -= (self.rate * step).astype(np.float32)

    @staticmethod
    def _window(sequences: list[np.ndarray], length: np.ndarray, at: int, window: int, begin: int) -> tuple[np.ndarray, ...]:
        """(alive, tokens before, tokens) of a window of sequences sorted from long to short, place by place."""
        wide = min(window, int(length[0]) - at)
        n = np.minimum(length - at, wide)
        alive = np.arange(wide)[:, None] < n
        held = np.concatenate([s[at: at + wide] for s in sequences])
        block = np.zeros((len(sequences), wide + 1), np.int64)
        block[:, 0] = [s[at - 1] for s in sequences] if at else begin
        block[:, 1:][alive.T] = held
        block = block.T
        return alive, block[:-1][alive], block[1:][alive]

    def fit(self, sequences: list[np.ndarray], begin: int, window: int = 32) -> None:
        """One pass over a batch of sequences, window by window, the state carried and its gradient cut between them."""
        model, p = self.model, self.model.p
        m = model.hidden
        sequences = sorted((s for s in sequences if len(s)), key=lambda s: -len(s))
        length = np.array([len(s) for s in sequences], np.int64)
        h = np.zeros((len(sequences), m), np.float32)
        for at in range(0, int(length.max(initial=0)), window):
            live = int(np.searchsorted(-length, -at, side="left"))
            sequences, length, h = sequences[:live], length[:live], h[:live].copy()
            alive, token, flat = self._window(sequences, length, at, window, begin)
            ends = np.cumsum(alive.sum(axis=1)).tolist()
            places = list(zip([0, *ends[:-1]], ends, strict=True))
            embedded = p["embed"][token]
            x = embedded @ p["wx"] + p["wb"]
            old, z, r, new, gn, states = (np.empty((len(flat), m), x.dtype) for _ in range(6))
            for a, b in places:
                old[a:b] = h[: b - a]
                states[a:b], z[a:b], r[a:b], new[a:b], gn[a:b] = model._step(x[a:b], old[a:b])
                h[: b - a] = states[a:b]
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            _, back = model._outputs(states, flat, grads)
            by_z, by_new, by_r = (old - new) * z * (1 - z), (1 - z) * (1 - new * new), gn * r * (1 - r)
            d_x, d_g = np.empty_like(x), np.empty_like(x)
            dh = np.zeros((0, m), x.dtype)
            for a, b in reversed(places):
                d = back[a:b]
                d[: len(dh)] += dh
                d_x[a:b, :m] = d * by_z[a:b]
                d_new = d * by_new[a:b]
                d_x[a:b, m: 2 * m] = d_new * by_r[a:b]
                d_x[a:b, 2 * m:] = d_new
                d_g[a:b, : 2 * m] = d_x[a:b, : 2 * m]
                d_g[a:b, 2 * m:] = d_new * r[a:b]
                dh = d * z[a:b] + d_g[a:b] @ p["wh"].T
            grads["wh"] += old.T @ d_g
            grads["wb"] += d_x.sum(axis=0)
            grads["wx"] += embedded.T @ d_x
            order = np.argsort(token, kind="stable")
            cuts = np.flatnonzero(np.diff(token[order], prepend=-1))
            grads["embed"][token[order[cuts]]] += np.add.reduceat((d_x @ p["wx"].T)[order], cuts, axis=0)
            self.tokens += len(flat)
            self._update(grads, len(flat))
