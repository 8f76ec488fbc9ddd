"""Recurrent layers run by onnxruntime, several times as fast as step by step in numpy, to the same results.

The graphs are written as ONNX messages, so the package onnx is not needed. Where onnxruntime is not installed,
`AVAILABLE` is false and the networks go on in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

try:
    import onnxruntime

    AVAILABLE = True
except ImportError:
    AVAILABLE = False

#: Sequences that go through a graph side by side, at most: what a step holds of them stays in the cache. Fewer,
#: but not under LEAST, where the shortest would have less than NEAR of the longest's length.
BLOCK, LEAST, NEAR = 512, 128, 0.85
#: Lanes that sequences are dealt to, at most; numbers from a third of it on are tried by STEP, as some fit the sequences far
#: better than others. A step costs as much as so many lanes besides.
LANES, STEP, BESIDES = 960, 40, 100

_FLOAT, _INT32 = 1, 6


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | str | bytes) -> bytes:
    """A field of a message: a number, or anything that has a length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _tensor(name: str, x: np.ndarray) -> bytes:
    return b"".join(_field(1, n) for n in x.shape) + _field(2, _FLOAT) + _field(8, name) + _field(9, x.astype("<f4").tobytes())


def _value(name: str, kind: int, dims: list[str]) -> bytes:
    shape = b"".join(_field(1, _field(2, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def _attribute(name: str, value: int | list[int] | bytes) -> bytes:
    """A number, numbers, or a graph."""
    if isinstance(value, int):
        return _field(1, name) + _field(3, value) + _field(20, 2)
    if isinstance(value, list):
        return _field(1, name) + b"".join(_field(8, n) for n in value) + _field(20, 7)
    return _field(1, name) + _field(6, value) + _field(20, 5)


def node(op: str, inputs: str, outputs: str, **attributes: int | list[int] | bytes) -> bytes:
    """An operator; names are parted by blanks."""
    named = [*(_field(1, x) for x in inputs.split()), *(_field(2, x) for x in outputs.split()), _field(4, op)]
    return b"".join([*named, *(_field(5, _attribute(k, v)) for k, v in attributes.items())])


def _graph(nodes: list[bytes], name: str, tensors: dict[str, np.ndarray], inputs: dict[str, tuple[int, list[str]]], outputs: dict[str, tuple[int, list[str]]]) -> bytes:
    parts = [*(_field(1, n) for n in nodes), _field(2, name), *(_field(5, _tensor(k, x)) for k, x in tensors.items())]
    return b"".join([*parts, *(_field(11, _value(k, *x)) for k, x in inputs.items()), *(_field(12, _value(k, *x)) for k, x in outputs.items())])


def _session(graph: bytes) -> onnxruntime.InferenceSession:
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
    options.log_severity_level = 3
    return onnxruntime.InferenceSession(_field(1, 8) + _field(7, graph) + _field(8, _field(2, 12)), options, providers=["CPUExecutionProvider"])


class Recurrent:
    """A layer for each direction, whose outputs add up.

    `steps` has the nodes and the tensors of one step forward and of one backward. A step takes the states
    (`states`: their names and those after the step) and the numbers of `inputs`, and gives `e`.
    """

    def __init__(self, steps: list[tuple[list[bytes], dict[str, np.ndarray]]], states: dict[str, str], inputs: list[str], hidden: int) -> None:
        self.inputs, self.hidden = inputs, hidden
        state, number = (_FLOAT, ["n", "hidden"]), (_INT32, ["n"])
        scans, fed, given = [], {"zero": state}, {}
        for d, (nodes, tensors) in enumerate(steps):
            body = _graph(nodes, f"step{d}", tensors, dict.fromkeys(states, state) | dict.fromkeys(inputs, number), dict.fromkeys(states.values(), state) | {"e": (_FLOAT, ["n", "tags"])})
            ends = " ".join(f"{x}{d}" for x in states)
            scans.append(node("Scan", " ".join(["zero"] * len(states) + [f"{x}{d}" for x in inputs]), f"{ends} e{d}", body=body, num_scan_inputs=len(inputs)))
            fed |= {f"{x}{d}": (_INT32, ["t", "n"]) for x in inputs}
            given[f"e{d}"] = (_FLOAT, ["t", "n", "tags"])
        self.session = _session(_graph(scans, "layers", {}, fed, given))

    def pairs(self, numbers: list[np.ndarray], begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Which sequence, and what each direction gives at its positions, for the sequences [begin : begin + size] of
        `numbers`, longest first. Shorter ones are filled up behind their ends, where nothing is read."""
        numbers = [x.astype(np.int32, copy=False) for x in numbers]
        i = 0
        while i < len(size) and size[i]:
            near = int(np.searchsorted(-size, -NEAR * size[i], "right"))
            own = slice(i, min(max(near, i + LEAST), i + BLOCK))
            b, n = begin[own], size[own]
            t, last = np.arange(n[0])[:, None], np.maximum(n - 1, 0)
            ahead = b + (t if n[-1] == n[0] else np.minimum(t, last))
            fed = {"zero": np.zeros((len(n), self.hidden), np.float32)}
            for name, x in zip(self.inputs, numbers):
                fed[f"{name}0"] = x[ahead]
                fed[f"{name}1"] = np.ascontiguousarray(fed[f"{name}0"][::-1]) if n[-1] == n[0] else x[2 * b + last - ahead]
            forward, backward = self.session.run(None, fed)
            for j, m in enumerate(n.tolist()):
                yield i + j, forward[:m, j], backward[:m, j][::-1]
            i += len(n)

    def add(self, numbers: list[np.ndarray], begin: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        """Add what both directions give to `out`, where the sequences stand one after the other."""
        to = (np.cumsum(size) - size).tolist()
        for j, forward, backward in self.pairs(numbers, begin, size):
            part = out[to[j] : to[j] + len(forward)]
            part += forward
            part += backward


class Lanes:
    """A layer for each direction, whose outputs add up, over sequences one after the other in lanes of equal lengths.

    `steps` has the nodes and the tensors of one step forward and of one backward. A step takes the state `h` and the
    number `x` of each lane, and gives `h_next` and `e` (tags × lanes). The number `rest` stands between sequences and
    must bring any state to zero, so that no sequence sees another and none is filled up to the length of others.
    """

    def __init__(self, steps: list[tuple[list[bytes], dict[str, np.ndarray]]], hidden: int, rest: int) -> None:
        self.hidden, self.rest = hidden, rest
        state, number = (_FLOAT, ["n", "hidden"]), (_INT32, ["n"])
        scans = []
        for d, (nodes, tensors) in enumerate(steps):
            body = _graph(nodes, f"step{d}", tensors, {"h": state, "x": number}, {"h_next": state, "e": (_FLOAT, ["tags", "n"])})
            scans.append(node("Scan", "zero x", f"h{d} e{d}", body=body, num_scan_inputs=1, scan_input_directions=[d], scan_output_directions=[d]))
        nodes = [*scans, node("Add", "e0 e1", "sum"), node("Flatten", "sum", "flat", axis=1), node("Transpose", "flat", "out", perm=[1, 0])]
        graph = _graph(nodes, "lanes", {}, {"zero": state, "x": (_INT32, ["t", "n"])}, {"out": (_FLOAT, ["rows", "t"])})
        self.session = _session(graph)

    def sums(self, x: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What both directions give (tags × places), and the first place of each of the sequences x[begin : begin + size];
        behind the last place of a sequence there is one that belongs to none."""
        lane, start, lanes, length = dealt(size)
        place = lane * length + start
        own = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        grid = np.full(lanes * length, self.rest, np.int32)
        grid[np.repeat(place - np.cumsum(size) + size, size) + np.arange(len(own))] = x[own]
        fed = {"zero": np.zeros((lanes, self.hidden), np.float32), "x": np.ascontiguousarray(grid.reshape(lanes, length).T)}
        (out,) = self.session.run(None, fed)
        return out.reshape(-1, lanes * length), place


def dealt(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Lane and start of sequences, longest first to the emptiest lanes, the number of lanes, and their length."""
    order = np.argsort(-size, kind="stable")
    taken = size[order] + 1
    most = min(LANES, -(-int(taken.sum()) // int(taken[0])))
    fits = [(_lanes(taken, n)[2] * (n + BESIDES), n) for n in {most, *range(LANES // 3, most, STEP)}]
    lanes = min(fits)[1]
    lane, start = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    lane[order], start[order], length = _lanes(taken, lanes)
    return lane, start, lanes, length


def _lanes(taken: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, int]:
    fill, lane, start = np.zeros(lanes, np.int64), np.empty(len(taken), np.int64), np.empty(len(taken), np.int64)
    for i in range(0, len(taken), lanes):
        own = taken[i : i + lanes]
        to = np.argsort(fill, kind="stable")[: len(own)]
        lane[i : i + lanes], start[i : i + lanes] = to, fill[to]
        fill[to] += own
    return lane, start, int(fill.max())
