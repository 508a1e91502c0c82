"""A small causal self-attention model: one attention layer, one feed-forward layer, two-level output.

With one head as wide as the model only the products of query and key weights (``M``) and of value
and output weights (``V``) matter, so these are what is stored. The token distribution is
p(class) * p(token | class) with ``SIDE`` classes of ``SIDE`` tokens by frequency, so that each token
costs 2 * SIDE exponentials and all next tokens' probabilities sum to one. Windows hold ``WINDOW``
inputs, of which the last ``STRIDE`` predict: windows overlap, and each token of a text is predicted
once, with WINDOW - STRIDE to WINDOW - 1 tokens before it. Places before a text's start hold the
start mark. Blocks of windows are small enough for a core's cache. Passes are made by onnxruntime (``lm_graph``), or by numpy
where that is not there or parameters are in double precision.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterable

import numpy as np

SIDE, WIDTH, HIDDEN, WINDOW, STRIDE = 64, 24, 48, 32, 24
VOCABULARY = SIDE * SIDE
#: Windows that are scored together, and that a step of training takes.
BLOCK = 256
STEP = 512
#: Windows of a step that pass together where graphs are used.
PART = 128
_LOG10 = float(np.log(10.0))
_BACK = WINDOW - STRIDE
_ONES = np.ones(max(WINDOW, SIDE), dtype=np.float32)
#: A late place sees no place after its own.
_SEEN = (np.arange(WINDOW)[None, :] <= np.arange(_BACK, WINDOW)[:, None]).astype(np.float32)


def windows(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: the inputs of each window, and the places in ``tokens`` that it predicts (-1: none).

    The input of a place is the token before it, or the start mark (VOCABULARY).
    """
    count = -(-lengths // STRIDE)
    start, room = np.cumsum(lengths) - lengths, count * STRIDE + _BACK + 1
    base = np.cumsum(room) - room
    line = np.full(int(room.sum()), VOCABULARY, dtype=np.int64)
    line[np.arange(len(tokens)) + np.repeat(base + _BACK + 1 - start, lengths)] = tokens
    k = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    inputs = line[(np.repeat(base, count) + k)[:, None] + np.arange(WINDOW)]
    place = (np.repeat(start, count) + k)[:, None] + np.arange(STRIDE)
    return inputs, np.where(place < np.repeat(start + lengths, count)[:, None], place, -1)


class Model:
    """Parameters, loss with gradients, training and scoring."""

    def __init__(self, counts: np.ndarray, seed: int = 5):
        """``counts``: how often each token stands in the training texts; they set the classes and the first output biases."""
        rng = np.random.default_rng(seed)
        order = np.argsort(-counts, kind="stable")
        self.place = np.empty(VOCABULARY, dtype=np.int64)  # token -> class * SIDE + rank in it
        self.place[order] = np.arange(VOCABULARY)
        share = ((counts[order] + 0.5) / (counts.sum() + 0.5 * VOCABULARY)).reshape(SIDE, SIDE)
        d = lambda *s, k=1.0: (rng.normal(size=s) * k / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "E": (rng.normal(size=(VOCABULARY + 1, WIDTH)) * 0.3).astype(np.float32), "P": (rng.normal(size=(WINDOW, WIDTH)) * 0.1).astype(np.float32), "M": d(WIDTH, WIDTH, k=0.5), "V": d(WIDTH, WIDTH, k=0.5),
            "A": d(WIDTH, HIDDEN), "a": np.zeros(HIDDEN, dtype=np.float32), "B": d(HIDDEN, WIDTH, k=0.5),
            "C": d(WIDTH, SIDE, k=0.1), "c": np.log(share.sum(1)).astype(np.float32), "T": (rng.normal(size=(SIDE, WIDTH, SIDE)) * 0.02).astype(np.float32), "t": np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
        }

    def _forward(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Hidden rows of the last STRIDE places of each window; every place sees itself and those before it."""
        p = self.p
        x = p["E"].take(ids, axis=0)
        x += p["P"]
        late = np.ascontiguousarray(x[:, _BACK:]).reshape(-1, WIDTH)
        q = (late @ p["M"]).reshape(-1, STRIDE, WIDTH)
        s = q @ x.transpose(0, 2, 1)
        np.clip(s, -50, 50, out=s)  # then no maximum need be taken off
        np.exp(s, out=s)
        s *= _SEEN
        total = s.reshape(-1, WINDOW) @ _ONES[:WINDOW]
        np.divide(1, total, out=total)
        y = (s @ x).reshape(-1, WIDTH)
        y *= total[:, None]
        u = y @ p["V"]
        u += late
        f = u @ p["A"]
        f += p["a"]
        np.maximum(f, 0, out=f)
        h = f @ p["B"]
        h += u
        if keep is not None:
            s *= total.reshape(-1, STRIDE, 1)
            keep.update(x=x, late=late, q=q, s=s, y=y, u=u, f=f)
        return h

    def _out(self, h: np.ndarray, place: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probabilities of the places after hidden rows; with ``grads``, also the gradient of their negative sum by h.

        Rows are sorted by class, so that each class is one product.
        """
        p, every = self.p, np.arange(len(h))
        order = np.argsort((place // SIDE).astype(np.int16), kind="stable")
        place = place.take(order)
        group, rank = place // SIDE, place % SIDE
        ends = np.searchsorted(group, np.arange(SIDE + 1)).tolist()
        h = h.take(order, axis=0)
        outer, inner = h @ p["C"], np.empty((len(h), SIDE), dtype=h.dtype)
        outer += p["c"]
        parts = [(k, slice(ends[k], ends[k + 1])) for k in range(SIDE) if ends[k] < ends[k + 1]]
        for k, at in parts:
            np.matmul(h[at], p["T"][k], out=inner[at])
            inner[at] += p["t"][k]
        logs, totals = [], []
        for z, at in ((outer, group), (inner, rank)):
            np.clip(z, -60, 60, out=z)
            mine = z[every, at]
            np.exp(z, out=z)
            totals.append(z @ _ONES[:SIDE])
            logs.append(mine - np.log(totals[-1]))
        out = np.empty_like(logs[0])
        out[order] = logs[0] + logs[1]
        if grads is None:
            return out, None
        for z, total, at in ((outer, totals[0], group), (inner, totals[1], rank)):
            z *= (1 / total)[:, None]
            z[every, at] -= 1
        grads["C"], grads["c"], back = h.T @ outer, _ones(len(h)) @ outer, outer @ p["C"].T
        grads["T"], grads["t"] = np.zeros_like(p["T"]), np.zeros_like(p["t"])
        for k, at in parts:
            z = inner[at]
            np.matmul(h[at].T, z, out=grads["T"][k])
            np.matmul(_ones(len(z)), z, out=grads["t"][k])
            back[at] += z @ p["T"][k].T
        where = np.empty(len(h), dtype=np.int64)
        where[order] = every
        return out, back.take(where, axis=0)

    def _graph(self):
        """``lm_graph``, if it can run this model's passes: they are in float32, and onnxruntime must be there."""
        from weftline.llm import lm_graph

        return lm_graph if self.p["E"].dtype == np.float32 and lm_graph.usable() else None

    def _classes(self, h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]], np.ndarray]:
        """The order of hidden rows by class; the rows, with a one for the biases, and places in it; where each class lies, and its tokens' logits."""
        order = np.argsort((place // SIDE).astype(np.int16), kind="stable")
        one, place = np.ones((len(h), WIDTH + 1), dtype=h.dtype), place.take(order)
        one[:, :WIDTH] = h.take(order, axis=0)
        ends = np.searchsorted(place // SIDE, np.arange(SIDE + 1)).tolist()
        inner, parts = np.empty((len(h), SIDE), dtype=h.dtype), [(k, slice(ends[k], ends[k + 1])) for k in range(SIDE) if ends[k] < ends[k + 1]]
        weights = np.concatenate([self.p["T"], self.p["t"][:, None]], axis=1)
        for k, at in parts:
            np.matmul(one[at], weights[k], out=inner[at])
        return order, one, place, parts, inner

    def _first(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """What the graphs of forward passes take."""
        return self.p | {"e": self.p["E"].take(inputs, axis=0)}

    def _last(self, **more: np.ndarray) -> dict[str, np.ndarray]:
        """What the graphs of the output take."""
        return {"C1": np.concatenate([self.p["C"], self.p["c"][None]])} | more

    def _graph_loss(self, graph, tokens: np.ndarray, inputs: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """``loss`` by ``lm_graph``: windows pass in parts that a core's cache holds, the output's classes all at once."""
        p, target, size = self.p, target.ravel(), PART * STRIDE
        keep = [graph.run("forward", self._first(inputs[a : a + PART])) for a in range(0, len(inputs), PART)]
        hidden, there = np.concatenate([k["h"] for k in keep]), np.flatnonzero(target >= 0)
        order, h, place, parts, inner = self._classes(hidden.take(there, axis=0), self.place[tokens[target[there]]])
        got = graph.run("output", self._last(g=h, inner=inner))
        every, group, rank, n, out = np.arange(len(h)), place // SIDE, place % SIDE, max(1, len(h)), 0.0
        for z, at in ((got["outer_p"], group), (got["inner_p"], rank)):
            flat, at = z.reshape(-1), every * SIDE + at
            mine = flat.take(at)
            out += np.log(np.maximum(mine, 1e-37)).sum(dtype=np.float64)
            flat[at] = mine - 1
        outer, inner = graph.run("outer", {"d": got["outer_p"], "g": h, "C": p["C"]}), got["inner_p"]
        back, last = outer["back"], np.zeros((SIDE, WIDTH + 1, SIDE), dtype=np.float32)
        for k, at in parts:
            z = inner[at]
            np.matmul(h[at].T, z, out=last[k])
            back[at] += z @ p["T"][k].T
        dh = np.zeros_like(hidden)
        dh[there[order]] = back
        more = [graph.run("backward", p | k | {"dh": dh[i * size : (i + 1) * size]}) for i, k in enumerate(keep)]
        g = {k: sum(m["g" + k] for m in more) for k in "MVAaBP"}
        g["B"], g["C"], g["c"], g["T"], g["t"] = np.ascontiguousarray(g["B"].T), outer["gC"][:WIDTH], outer["gC"][WIDTH], last[:, :WIDTH], last[:, WIDTH]
        g["E"] = np.zeros_like(p["E"])
        for i, m in enumerate(more):
            g["E"] = graph.run("input", {"E0": g["E"], "place": inputs[i * PART : (i + 1) * PART].reshape(-1, 1), "rows_dx": m["dx"].reshape(-1, WIDTH)})["gE"]
        for v in g.values():
            v /= n
        return -out / n, g

    def loss(self, tokens: np.ndarray, inputs: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log probability of the predicted places, and its gradient by every parameter."""
        if graph := self._graph():
            return self._graph_loss(graph, tokens, inputs, target)
        p, keep, g = self.p, {}, {}
        h, target = self._forward(inputs, keep), target.ravel()
        there = np.flatnonzero(target >= 0)
        whole = len(there) == len(target)
        out, back = self._out(h if whole else h.take(there, axis=0), self.place[tokens[target if whole else target[there]]], g)
        dh = back
        if not whole:
            dh = np.zeros_like(h)
            dh[there] = back
        one, x, s = _ones(len(h)), keep["x"], keep["s"]
        g["B"] = keep["f"].T @ dh
        df = dh @ p["B"].T
        df *= keep["f"] > 0
        g["A"], g["a"] = keep["u"].T @ df, one @ df
        du = df @ p["A"].T
        du += dh
        g["V"] = keep["y"].T @ du
        dy = du @ p["V"].T
        same = np.einsum("ij,ij->i", dy, keep["y"]).reshape(-1, STRIDE, 1)
        dy = dy.reshape(-1, STRIDE, WIDTH)
        ds = dy @ x.transpose(0, 2, 1)
        ds -= same
        ds *= s
        dx = s.transpose(0, 2, 1) @ dy
        dx += ds.transpose(0, 2, 1) @ keep["q"]
        dq = (ds @ x).reshape(-1, WIDTH)
        g["M"] = keep["late"].T @ dq
        du += dq @ p["M"].T
        dx[:, _BACK:] += du.reshape(-1, STRIDE, WIDTH)
        g["P"] = (_ones(len(dx)) @ dx.reshape(len(dx), -1)).reshape(WINDOW, WIDTH)
        g["E"] = np.zeros_like(p["E"])
        ids = inputs.ravel()
        order = np.argsort(ids.astype(np.int16), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        g["E"][ids[first]] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, axis=0), first, axis=0)
        n = max(1, len(out))
        for v in g.values():
            v /= n
        return -float(out.sum(dtype=np.float64)) / n, g

    def learn(self, groups: Iterable[tuple[np.ndarray, np.ndarray]], rate: float, batch: int = STEP, seed: int = 9) -> int:
        """Adam over every window of groups of texts (tokens, lengths), each taken once; how many there were."""
        rng, adam, n = np.random.default_rng(seed), _Adam(self), 0
        for tokens, lengths in groups:
            inputs, target = windows(tokens, lengths)
            order = rng.permutation(len(inputs))
            for a in range(0, len(order), batch):
                take = order[a : a + batch]
                adam.step(tokens, inputs[take], target[take], rate * min(1.0, (adam.n + 1) / 20) * len(take) / batch)
            n += len(inputs)
        return n

    def trained(self) -> np.ndarray:
        """All parameters, end to end."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def put(self, values: np.ndarray) -> None:
        """Sets all parameters from one array."""
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def copy(self) -> Model:
        """A model with the same classes and parameters of its own."""
        out = Model.__new__(Model)
        out.place, out.p = self.place, {k: v.copy() for k, v in self.p.items()}
        return out

    def score(self, tokens: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """The log10 probability of each token of texts laid end to end, given those before it in its text."""
        out, graph = np.zeros(len(tokens)), self._graph()
        inputs, target = windows(tokens, lengths)
        for a in range(0, len(inputs), block):
            t = target[a : a + block].ravel()
            there = np.flatnonzero(t >= 0)
            t = t[there]
            if graph:
                h = graph.run("hidden", self._first(inputs[a : a + block]))["h"].take(there, axis=0)
                order, h, place, _, inner = self._classes(h, self.place[tokens[t]])
                got = graph.run("scores", self._last(g=h, inner=inner, group=(place // SIDE)[:, None], rank=(place % SIDE)[:, None]))
                out[t[order]] = (got["outer_l"] + got["inner_l"]).ravel()
            else:
                out[t] = self._out(self._forward(inputs[a : a + block]).take(there, axis=0), self.place[tokens[t]])[0]
        return out / _LOG10


def keep_memory() -> None:
    """Lets this process keep freed arrays for the next ones: else each is mapped and cleared anew, which costs as much as the products."""
    import ctypes

    with contextlib.suppress(AttributeError, OSError):  # only the C library of Linux has it
        for what in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            ctypes.CDLL(None).mallopt(what, 256 << 20)


def _ones(n: int) -> np.ndarray:
    return np.ones(n, dtype=np.float32)


class _Adam:
    """Steps of Adam over a model's parameters."""

    def __init__(self, model: Model):
        self.model, self.n = model, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))

    def step(self, tokens: np.ndarray, inputs: np.ndarray, target: np.ndarray, rate: float) -> None:
        self.n += 1
        _, g = self.model.loss(tokens, inputs, target)
        one, two = rate / (1 - 0.9**self.n), 1 / np.sqrt(1 - 0.99**self.n)
        for k, first in self.first.items():
            second, d = self.second[k], g[k]
            first *= np.float32(0.9)
            first += np.float32(0.1) * d
            d *= d
            d *= np.float32(0.01)
            second *= np.float32(0.99)
            second += d
            self.model.p[k] -= np.float32(one) * first / (np.sqrt(second) * np.float32(two) + np.float32(1e-6))
