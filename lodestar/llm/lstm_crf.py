"""A character-level bidirectional LSTM with a conditional random field on top, trained in numpy, run by `graphs`.

A character enters by its id and by the hash of the word it belongs to, both through tables that are
the input projections themselves, so no matrix product is needed for the input.
"""

from __future__ import annotations

import numpy as np

from . import graphs
from .graphs import node
from .gru import touched_rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class LstmCrf:
    def __init__(self, tags: int, chars: int, words: int, hidden: int = 20, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        f = lambda x: x.astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self._ready: list[graphs.Recurrent] = []
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"C{d}"] = f(rng.normal(size=(chars, 4 * hidden)) * 0.3)
            self.p[f"W{d}"] = f(rng.normal(size=(words, 4 * hidden)) * 0.02)
            self.p[f"U{d}"] = f(rng.normal(size=(hidden, 4 * hidden)) * hidden**-0.5)
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1.0  # forget little at first
            self.p[f"b{d}"] = f(bias)
        self.p["V"] = f(rng.normal(size=(2 * hidden, tags)) * (2 * hidden) ** -0.5)
        self.p["vb"] = f(np.zeros(tags))
        self.p["A"] = f(np.zeros((tags, tags)))

    def _run(self, d: str, chars: np.ndarray, words: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States; chars, words: time × batch."""
        hs, u = self.hidden, self.p[f"U{d}"]
        table_c, table_w = self.p[f"C{d}"] + self.p[f"b{d}"], self.p[f"W{d}"]
        steps = range(len(chars)) if d == "f" else range(len(chars) - 1, -1, -1)
        out = np.empty((*chars.shape, hs), np.float32)
        h = np.zeros((chars.shape[1], hs), np.float32)
        c = np.zeros_like(h)
        for t in steps:
            g = h @ u
            g += table_c[chars[t]]
            g += table_w[words[t]]
            gates = _sigmoid(g[:, : 3 * hs])
            i, f, o = gates[:, :hs], gates[:, hs : 2 * hs], gates[:, 2 * hs :]
            n = np.tanh(g[:, 3 * hs :])
            new = f * c + i * n
            tc = np.tanh(new)
            if kept is not None:
                kept.append((t, h, c, i, f, o, n, tc))
            c = new
            h = o * tc
            out[t] = h
        return out

    def _emit(self, d: str, chars: np.ndarray, words: np.ndarray, begin: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        """Add what the states of one direction give the tags to `out`: one sequence after the other.

        Sequences come longest first, so the running ones are always the first of them. Nothing is kept for
        the gradients. A sigmoid is (tanh of half + 1) / 2: with s the tangents of the gates and states
        doubled, the cell is (s_f c + c + s_i n + n) / 2 and the doubled state s_o tanh c + tanh c, so that
        no gate is ever rescaled.
        """
        hs, n = self.hidden, len(begin)
        scale = np.ones(4 * hs, np.float32)
        scale[: 3 * hs] = 0.5
        u, table_c, table_w = self.p[f"U{d}"] * scale * 0.5, (self.p[f"C{d}"] + self.p[f"b{d}"]) * scale, self.p[f"W{d}"] * scale
        every_g, every_x = np.empty((n, 4 * hs), np.float32), np.empty((n, 4 * hs), np.float32)
        every_h, every_c, every_y = (np.zeros((n, hs), np.float32) for _ in range(3))
        every_z = np.empty((n, self.tags), np.float32)
        v = self.p["V"][:hs] if d == "f" else self.p["V"][hs:]
        v = v * np.float32(0.5)
        to = np.cumsum(size) - size
        ends = size - 1
        running = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        for t, k in enumerate(running):
            g, x, h, c, y, z = every_g[:k], every_x[:k], every_h[:k], every_c[:k], every_y[:k], every_z[:k]
            at = t if d == "f" else ends[:k] - t
            place = begin[:k] + at
            np.matmul(h, u, out=g)
            np.take(table_c, chars[place], axis=0, out=x, mode="clip")
            g += x
            np.take(table_w, words[place], axis=0, out=x, mode="clip")
            g += x
            np.tanh(g, out=g)
            np.multiply(g[:, hs : 2 * hs], c, out=y)
            c += y
            np.multiply(g[:, :hs], g[:, 3 * hs :], out=y)
            c += y
            c += g[:, 3 * hs :]
            c *= 0.5
            np.tanh(c, out=y)
            np.multiply(g[:, 2 * hs : 3 * hs], y, out=h)
            h += y
            np.matmul(h, v, out=z)
            place = to[:k] + at
            z += out[place]
            out[place] = z

    def _graph(self) -> graphs.Recurrent:
        """Both directions for the network as it is at the first call, which must be done with training."""
        if not self._ready:
            hs, steps = self.hidden, []
            nodes = [
                node("Gather", "C chars", "by_char"), node("Gather", "W words", "by_word"), node("Add", "by_char by_word", "x"), node("Gemm", "h U x", "g"),
                node("Split", "g", "gates new", axis=1, split=[3 * hs, hs]), node("Sigmoid", "gates", "s"), node("Tanh", "new", "n"), node("Split", "s", "i f o", axis=1, split=[hs] * 3),
                node("Mul", "f c", "fc"), node("Mul", "i n", "in"), node("Add", "fc in", "c_next"), node("Tanh", "c_next", "y"), node("Mul", "o y", "h_next"), node("MatMul", "h_next V", "e"),
            ]
            for q, d in enumerate("fb"):
                steps.append((nodes, {"C": self.p[f"C{d}"] + self.p[f"b{d}"], "W": self.p[f"W{d}"], "U": self.p[f"U{d}"], "V": self.p["V"][q * hs : (q + 1) * hs]}))
            self._ready.append(graphs.Recurrent(steps, {"h": "h_next", "c": "c_next"}, ["chars", "words"], hs))
        return self._ready[0]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": []}

    def emissions(self, chars: np.ndarray, words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each position of the sequences [begin : begin + size], longest first, one after the other."""
        out = np.empty((int(size.sum()), self.tags), np.float32)
        out[:] = self.p["vb"]
        if graphs.AVAILABLE:
            self._graph().add([chars, words], begin, size, out)
        else:
            for d in "fb":
                self._emit(d, chars, words, begin, size, out)
        return out

    def path(self, e: np.ndarray) -> np.ndarray:
        """The likeliest tags of one sequence of emissions (time × tags) of any length, by Viterbi.

        Where tag 0 leads every other by more than any two transitions could make up, every best path
        goes through it: there the sequence falls into stretches, which are searched side by side,
        longest first, with tag 0 fixed before and after each.
        """
        a = self.p["A"].astype(np.float32)
        out = np.zeros(len(e), np.int8)
        if not len(e):
            return out
        other = e[:, 1].copy()
        for k in range(2, self.tags):
            np.maximum(other, e[:, k], out=other)
        # of a path x, k, y over x, 0, y
        gain = (a[:, 1:, None] + a[None, 1:, :] - a[:, :1, None] - a[None, :1, :]).max()
        open_ = (other - e[:, 0] + max(0.0, float(gain)) >= 0).astype(np.int8)
        edge = np.diff(open_, prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = last - first
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        if not len(size):
            return out
        longest = int(size[0])
        active = np.searchsorted(-size, -np.arange(longest), "left")  # stretches longer than t
        back = []
        score = e[first] + a[0]
        for t in range(1, longest):
            k = active[t]
            s = score[:k, :, None] + a[None]
            back.append(s.argmax(axis=1).astype(np.int8))
            score[:k] = s.max(axis=1) + e[first[:k] + t]
        state = (score + a[:, 0]).argmax(axis=1)  # where each stretch ends
        for t in range(longest - 1, -1, -1):
            k = active[t]
            out[first[:k] + t] = state[:k]
            if t:
                state[:k] = back[t - 1][np.arange(k), state[:k]]
        return out

    def gradients(self, chars: np.ndarray, words: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags (time × batch) by position, and its gradients.

        Those of the large word tables are (rows, values) of the rows that the batch touches.
        """
        p, hs, k = self.p, self.hidden, self.tags
        self._ready = []
        kept: dict[str, list] = {"f": [], "b": []}
        states = [self._run(d, chars, words, kept[d]) for d in "fb"]
        both = np.concatenate(states, axis=2)
        e, a = both @ p["V"] + p["vb"], p["A"]
        steps, batch, _ = e.shape
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + a[None], 1) + e[t]
        beta[-1] = 0
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsumexp(a[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsumexp(alpha[-1], 1)
        total = steps * batch
        gold = np.take_along_axis(e, tags[..., None], 2).sum(axis=(0, 2)) + a[tags[:-1], tags[1:]].sum(axis=0)
        loss = float((z - gold).sum() / total)
        de = np.exp(alpha + beta - z[None, :, None])
        np.put_along_axis(de, tags[..., None], np.take_along_axis(de, tags[..., None], 2) - 1, 2)
        de = (de / total).astype(np.float32)
        da = np.zeros((k, k))
        for t in range(1, steps):
            da += np.exp(alpha[t - 1][:, :, None] + a[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(da, (tags[:-1].ravel(), tags[1:].ravel()), -1)
        g = {"A": (da / total).astype(np.float32), "V": both.reshape(-1, 2 * hs).T @ de.reshape(-1, k), "vb": de.sum(axis=(0, 1))}
        dboth = de @ p["V"].T
        for q, d in enumerate("fb"):
            u = p[f"U{d}"]
            dx = np.empty((steps, batch, 4 * hs), np.float32)
            gu = np.zeros_like(u)
            dh, dc = np.zeros((batch, hs), np.float32), np.zeros((batch, hs), np.float32)
            for t, h, c, i, f, o, n, tc in reversed(kept[d]):
                dh = dh + dboth[t][:, q * hs : (q + 1) * hs]
                dc = dc + dh * o * (1 - tc * tc)
                x = np.concatenate([dc * n * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - n * n)], axis=1)
                dx[t] = x
                gu += h.T @ x
                dh, dc = x @ u.T, dc * f
            flat = dx.reshape(-1, 4 * hs)
            g[f"U{d}"], g[f"b{d}"] = gu, flat.sum(axis=0)
            g[f"C{d}"] = _rows_summed(chars.ravel(), flat, len(p[f"C{d}"]))
            g[f"W{d}"] = touched_rows(words.ravel(), flat)
        return loss, g


def _rows_summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of `rows` by `index`, as an array of `n` rows."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    at, sums = touched_rows(index, rows)
    out[at] = sums
    return out
