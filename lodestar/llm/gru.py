"""A bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time, run by `graphs`.

Every byte is a position. It enters with the two bytes before it, hashed, through a table of each
direction that is the gates' input projection itself.
"""

from __future__ import annotations

import numpy as np

from . import graphs
from .graphs import node

#: Buckets of the hashed three bytes.
BUCKETS = 1 << 13
#: What a gate takes to be closed whatever the state, which is within 1 and so adds far less.
CLOSED = -1000.0


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes that end with each byte; before the first stand blanks."""
    x = data.astype(np.uint32)
    one, two = np.empty_like(x), np.empty_like(x)
    one[:1], two[:2] = 32, 32
    one[1:], two[2:] = x[:-1], x[:-2]
    h = (x | one << np.uint32(8) | two << np.uint32(16)) * np.uint32(2654435761)
    return (h >> np.uint32(19)).astype(np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the half-argument tangent, which is fast."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class ByteGRU:
    """Class logits of every byte of sequences."""

    def __init__(self, classes: int, hidden: int = 16, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
        self.hidden = hidden
        self._ready: list = []
        self.p = {
            "T": normal(2 * BUCKETS, 3 * hidden, by=0.02),  # the backward direction's rows follow the forward one's
            "U": normal(2, hidden, 3 * hidden, by=hidden**-0.5),
            "c": np.zeros((2, 1, 3 * hidden), np.float32),
            "V": normal(2 * hidden, classes, by=(2 * hidden) ** -0.5),
            "vb": np.zeros(classes, np.float32),
        }

    def logits(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Class logits (bytes × classes) of the sequences data[begin : begin + size], one after the other.

        Sequences come longest first. Without `graphs` they go step by step in numpy, where the running ones are
        the first of them and, with s the tangents of the half arguments of the gates, r u is (s_r u + u) / 2 and
        the new state is n + s_z d + d with d = (h - n) / 2, so that no gate is ever rescaled. States become
        logits at once, as writing them out would cost more than the network.
        """
        out = np.empty((int(size.sum()), len(self.p["vb"])), np.float32)
        if len(size) and graphs.AVAILABLE:
            sums, place = self._graph().sums(trigrams(data), begin, size)
            out[:] = sums[:, np.repeat(place - np.cumsum(size) + size, size) + np.arange(len(out))].T
            out += self.p["vb"]
        elif len(size):
            tri = trigrams(data)
            at = np.cumsum(size) - size
            running = np.searchsorted(-size, -np.arange(int(size[0])), "left")
            for d in (0, 1):
                self._direction(d, tri, begin, size, at, running, out)
        return out

    def summed(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, pieces: np.ndarray, owner: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of logits (classes × pieces) over the pieces of `lengths` bytes from `pieces` on, each in the sequence `owner`,
        from where the graph leaves them. The pieces of a sequence follow each other without gaps."""
        sums, place = self._graph().sums(trigrams(data), begin, size)
        count = np.bincount(owner, minlength=len(size))
        some = np.argsort(place, kind="stable")
        some = some[count[some] > 0]  # sequences in the order of their places
        count, first = count[some], np.searchsorted(owner, some)
        order = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(owner))  # pieces likewise
        at = (place[owner] + pieces - begin[owner])[order]
        last = np.cumsum(count)
        # behind a sequence's last piece the sum goes on to the next sequence's first, and is not used
        edges = np.insert(at, last, at[last - 1] + lengths[order][last - 1])
        out = np.empty((len(sums), len(owner)), np.float32)
        out[:, order] = np.delete(np.add.reduceat(sums, edges, axis=1), last + np.arange(len(last)), axis=1)
        out += self.p["vb"][:, None] * lengths.astype(np.float32)
        return out

    def _graph(self) -> graphs.Lanes:
        """Both directions for the network as it is at the first call, which must be done with training."""
        if not self._ready:
            hs, steps = self.hidden, []
            nodes = [
                node("Gather", "TG x", "to_gates"), node("Gather", "TN x", "to_new"), node("Gemm", "h UG to_gates", "gates"), node("Sigmoid", "gates", "s"),
                node("Split", "s", "z r", axis=1, split=[hs, hs]), node("MatMul", "h UN", "u"), node("Mul", "r u", "ru"), node("Add", "ru to_new", "new"), node("Tanh", "new", "n"),
                node("Sub", "h n", "d"), node("Mul", "z d", "zd"), node("Add", "n zd", "h_next"), node("Gemm", "V h_next", "e", transA=1, transB=1),
            ]
            for d in (0, 1):
                u, t = self.p["U"][d], self.p["T"][d * BUCKETS : (d + 1) * BUCKETS] + self.p["c"][d]
                # the row behind the last bucket's closes both gates and adds nothing: the new state is zero
                gates, new = (np.vstack([x, np.full_like(x[:1], by)]) for x, by in ((t[:, : 2 * hs], CLOSED), (t[:, 2 * hs :], 0)))
                steps.append((nodes, {"TG": gates, "TN": new, "UG": u[:, : 2 * hs], "UN": u[:, 2 * hs :], "V": self.p["V"][d * hs : (d + 1) * hs]}))
            self._ready.append(graphs.Lanes(steps, hs, BUCKETS))
        return self._ready[0]

    def _tables(self) -> list[tuple[np.ndarray, ...]]:
        """For each direction what the gates and the new state take from the state and from the input; for
        the network as it is at the first call, which must be done with training."""
        if not self._ready:
            hs, half = self.hidden, np.float32(0.5)
            for d in (0, 1):
                u, t = self.p["U"][d], self.p["T"][d * BUCKETS : (d + 1) * BUCKETS] + self.p["c"][d]
                self._ready.append((u[:, : 2 * hs] * half, u[:, 2 * hs :] * half, t[:, : 2 * hs] * half, np.ascontiguousarray(t[:, 2 * hs :])))
        return self._ready

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": []}

    def _direction(self, d: int, tri: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray, running: np.ndarray, out: np.ndarray) -> None:
        hs, n = self.hidden, len(size)
        u_gates, u_new, t_gates, t_new = self._tables()[d]
        v_own, bias = self.p["V"][d * hs : (d + 1) * hs], self.p["vb"]
        every = [np.empty((n, w), np.float32) for w in (2 * hs, 2 * hs, hs, hs, hs, len(bias))] + [np.zeros((n, hs), np.float32)]
        ends = size - 1
        for t, k in enumerate(running):
            g, x, v, w, y, z, h = (e[:k] for e in every)
            where = t if d == 0 else ends[:k] - t
            place = begin[:k] + where
            three = tri[place]
            np.matmul(h, u_gates, out=g)
            np.take(t_gates, three, axis=0, out=x, mode="clip")
            g += x
            np.tanh(g, out=g)
            np.matmul(h, u_new, out=v)
            np.multiply(g[:, hs:], v, out=w)
            w += v
            np.take(t_new, three, axis=0, out=y, mode="clip")
            w += y
            np.tanh(w, out=w)
            h -= w
            h *= 0.5
            np.multiply(g[:, :hs], h, out=y)
            h += y
            h += w
            np.matmul(h, v_own, out=z)
            place = at[:k] + where
            if d:
                z += out[place]
            else:
                z += bias
            out[place] = z

    def gradients(self, data: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy of windows of bytes (time × batch), and its gradients.

        Those of the table of three bytes are (rows, values) of the rows that the batch touches.
        """
        p, hs = self.p, self.hidden
        self._ready = []
        steps, batch = data.shape
        tri = trigrams(data.T.ravel()).reshape(batch, steps).T  # the first two of a window see the last of another: noise
        tri = np.stack([tri, tri[::-1] + BUCKETS], axis=1)  # time × direction × batch
        x = p["T"][tri] + p["c"]
        h = np.zeros((2, batch, hs), np.float32)
        kept, states = [], np.empty((steps, 2, batch, hs), np.float32)
        for t in range(steps):
            hu = np.matmul(h, p["U"])
            gates = sigmoid(x[t][..., : 2 * hs] + hu[..., : 2 * hs])
            z, r, un = gates[..., :hs], gates[..., hs:], hu[..., 2 * hs :]
            n = np.tanh(x[t][..., 2 * hs :] + r * un)
            kept.append((h, z, r, n, un))
            h = n + z * (h - n)
            states[t] = h
        joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        y = joined @ p["V"] + p["vb"]
        y -= y.max(axis=2, keepdims=True)
        prob = np.exp(y)
        prob /= prob.sum(axis=2, keepdims=True)
        picked = np.take_along_axis(prob, target[..., None], 2)[..., 0]
        total = max(float(weight.sum()), 1.0)
        loss = float(-(np.log(picked + 1e-9) * weight).sum() / total)
        dy = prob
        np.put_along_axis(dy, target[..., None], picked[..., None] - 1, 2)
        dy *= (weight / total)[..., None]
        dy = dy.astype(np.float32)
        g = {"V": joined.reshape(-1, 2 * hs).T @ dy.reshape(-1, dy.shape[2]), "vb": dy.sum(axis=(0, 1)), "U": np.zeros_like(p["U"])}
        djoined = dy @ p["V"].T
        dstates = np.stack([djoined[..., :hs], djoined[::-1, :, hs:]], axis=1)
        dx = np.empty((steps, 2, batch, 3 * hs), np.float32)
        ut = p["U"].transpose(0, 2, 1)
        dh = np.zeros((2, batch, hs), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, n, un = kept[t]
            dh = dh + dstates[t]
            dn = dh * (1 - z) * (1 - n * n)
            d = dx[t]
            d[..., :hs] = dh * (h - n) * z * (1 - z)
            d[..., hs : 2 * hs] = dn * un * r * (1 - r)
            d[..., 2 * hs :] = dn
            du = d.copy()
            du[..., 2 * hs :] *= r
            g["U"] += np.matmul(h.transpose(0, 2, 1), du)
            dh = dh * z + np.matmul(du, ut)
        flat = dx.reshape(-1, 3 * hs)
        g["c"] = dx.sum(axis=(0, 2))[:, None]
        g["T"] = touched_rows(tri.ravel(), flat)
        return loss, g


def touched_rows(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different indexes and the sums of their `rows`."""
    order = np.argsort(index, kind="stable")
    sorted_index = index[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_index[1:] != sorted_index[:-1]]))
    return sorted_index[starts], np.add.reduceat(rows[order], starts, axis=0)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict, clip: float = 5.0) -> None:
        """One step. A gradient may be (rows, values); only these rows and their moments then move."""
        self.t += 1
        parts = {k: g if isinstance(g, tuple) else (slice(None), g) for k, g in grads.items()}
        norm = float(np.sqrt(sum((g * g).sum() for _, g in parts.values())))
        scale = min(1.0, clip / (norm + 1e-9))
        for k, (at, g) in parts.items():
            g = g * scale
            m = 0.9 * self.m[k][at] + 0.1 * g
            v = 0.999 * self.v[k][at] + 0.001 * g * g
            self.m[k][at], self.v[k][at] = m, v
            step = self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
            self.params[k][at] -= step.astype(np.float32)
