"""The passes of ``lm_model.Model`` as graphs for onnxruntime on one thread, float32.

They are the sums of ``Model._forward``, ``_out`` and ``loss`` in the same order, with parameters as inputs, since each
step changes them. Models are written in their wire form here, as the ``onnx`` package need not be there.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

from weftline.llm.lm_model import _BACK, _SEEN, HIDDEN, SIDE, STRIDE, WIDTH, WINDOW

#: What a place that is not seen adds before the softmax.
_UNSEEN = -1e30


def _varint(n: int) -> bytes:
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(key: int, value: int | float | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(key << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(key << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(key << 3 | 2) + _varint(len(value)) + value


def _node(op: str, ins: str, out: str, **attributes: int | str) -> bytes:
    domain = "com.microsoft" if op == "FusedMatMul" else ""
    values = (_field(5, _field(1, k) + (_field(4, v) + _field(20, 3) if isinstance(v, str) else _field(3, v) + _field(20, 2))) for k, v in attributes.items())
    return _field(1, b"".join([*(_field(1, x) for x in ins.split()), _field(2, out), _field(4, op), *values, _field(7, domain)]))


def _value(key: int, name: str, shape: tuple, kind: int = 1) -> bytes:
    dims = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in shape)
    return _field(key, _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, dims))))


def _constant(name: str, a: np.ndarray) -> bytes:
    return _field(5, b"".join(_field(1, d) for d in a.shape) + _field(2, 7 if a.dtype == np.int64 else 1) + _field(8, name) + _field(9, a.tobytes()))


_SHAPES = {
    "e": ("n", WINDOW, WIDTH), "place": ("m", 1), "rows_dx": ("m", WIDTH), "gE": ("v", WIDTH), "E0": ("v", WIDTH), "P": (WINDOW, WIDTH), "M": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "A": (WIDTH, HIDDEN), "a": (HIDDEN,), "B": (HIDDEN, WIDTH), "C": (WIDTH, SIDE), "C1": (WIDTH + 1, SIDE),
    "x": ("n", WINDOW, WIDTH), "late": ("r", WIDTH), "q": ("n", STRIDE, WIDTH), "s": ("n", STRIDE, WINDOW), "y": ("n", STRIDE, WIDTH), "u": ("r", WIDTH), "f": ("r", HIDDEN), "h": ("r", WIDTH), "dh": ("r", WIDTH),
    "g": ("r", WIDTH + 1), "z": ("r", SIDE), "inner": ("r", SIDE), "group": ("r", 1), "rank": ("r", 1), "outer_p": ("r", SIDE), "inner_p": ("r", SIDE), "outer_l": ("r", 1), "inner_l": ("r", 1), "d": ("r", SIDE),
    "gM": (WIDTH, WIDTH), "gV": (WIDTH, WIDTH), "gA": (WIDTH, HIDDEN), "ga": (HIDDEN,), "gB": (WIDTH, HIDDEN), "gP": (WINDOW, WIDTH), "dx": ("n", WINDOW, WIDTH), "gC": (WIDTH + 1, SIDE), "back": ("r", WIDTH),
}
_CONSTANTS = {
    "unseen": np.where(_SEEN > 0, 0, _UNSEEN).astype(np.float32), "rows": np.array([-1, WIDTH]), "windows": np.array([-1, STRIDE, WIDTH]), "from": np.array([_BACK]), "to": np.array([WINDOW]), "one": np.array([1]),
    "zero": np.array([0]), "last": np.array([-1]), "pads": np.array([0, _BACK, 0, 0, 0, 0]),
}

_FORWARD = [
    _node("Add", "e P", "x"), _node("Slice", "x from to one", "xl"), _node("Reshape", "xl rows", "late"),
    _node("MatMul", "late M", "q2"), _node("Reshape", "q2 windows", "q"), _node("FusedMatMul", "q x", "qx", transB=1), _node("Add", "qx unseen", "s0"), _node("Softmax", "s0", "s"),
    _node("MatMul", "s x", "y"), _node("Reshape", "y rows", "y2"), _node("MatMul", "y2 V", "yv"), _node("Add", "yv late", "u"),
    _node("MatMul", "u A", "ua"), _node("Add", "ua a", "uaa"), _node("Relu", "uaa", "f"), _node("MatMul", "f B", "fb"), _node("Add", "fb u", "h"),
]
_SCORES = [
    _node("MatMul", "g C1", "z"), _node("LogSoftmax", "z", "zl"), _node("GatherElements", "zl group", "outer_l", axis=1),
    _node("LogSoftmax", "inner", "il"), _node("GatherElements", "il rank", "inner_l", axis=1),
]
_OUTPUT = [_node("MatMul", "g C1", "z"), _node("Softmax", "z", "outer_p"), _node("Softmax", "inner", "inner_p")]
_OUTER = [_node("FusedMatMul", "d C", "back", transB=1), _node("FusedMatMul", "g d", "gC", transA=1)]
_INPUT = [_node("ScatterND", "E0 place rows_dx", "gE", reduction="add")]
_BACKWARD = [
    _node("Reshape", "y rows", "y2"), _node("Reshape", "q rows", "q2"),
    _node("FusedMatMul", "dh f", "gB", transA=1), _node("FusedMatMul", "dh B", "df0", transB=1), _node("Sign", "f", "on"), _node("Mul", "on df0", "df"),
    _node("FusedMatMul", "u df", "gA", transA=1), _node("ReduceSum", "df zero", "ga", keepdims=0), _node("FusedMatMul", "df A", "dfa", transB=1), _node("Add", "dfa dh", "du"),
    _node("FusedMatMul", "y2 du", "gV", transA=1), _node("FusedMatMul", "du V", "dy2", transB=1), _node("Reshape", "dy2 windows", "dy"),
    _node("Mul", "dy y", "dyy"), _node("ReduceSum", "dyy last", "same"), _node("FusedMatMul", "dy x", "dyx", transB=1), _node("Sub", "dyx same", "ds0"), _node("Mul", "ds0 s", "ds"),
    _node("FusedMatMul", "s dy", "dx1", transA=1), _node("FusedMatMul", "ds q", "dx2", transA=1), _node("MatMul", "ds x", "dq"), _node("Reshape", "dq rows", "dq2"),
    _node("FusedMatMul", "late dq2", "gM", transA=1), _node("FusedMatMul", "dq2 M", "dl0", transB=1), _node("Add", "dl0 du", "dl"), _node("Reshape", "dl windows", "dl3"), _node("Pad", "dl3 pads", "dl4"),
    _node("Add", "dx1 dx2", "dx3"), _node("Add", "dx3 dl4", "dx"), _node("ReduceSum", "dx zero", "gP", keepdims=0),
]
_GRAPHS = {
    "hidden": (_FORWARD, "e P M V A a B", "h"), "forward": (_FORWARD, "e P M V A a B", "h x late q s y u f"), "scores": (_SCORES, "g C1 inner group rank", "outer_l inner_l"),
    "output": (_OUTPUT, "g C1 inner", "outer_p inner_p"), "outer": (_OUTER, "d g C", "back gC"), "input": (_INPUT, "E0 place rows_dx", "gE"), "backward": (_BACKWARD, "x late q s y u f dh M V A B", "dx gM gV gA ga gB gP"),
}


@functools.cache
def _session(name: str):
    import onnxruntime as ort

    nodes, ins, outs = _GRAPHS[name]
    text = b"".join(nodes)
    constants = [_constant(k, v) for k, v in _CONSTANTS.items() if _field(1, k) in text]
    graph = [text, _field(2, name), *constants, *(_value(11, k, _SHAPES[k], 7 if k in ("place", "group", "rank") else 1) for k in ins.split()), *(_value(12, k, _SHAPES[k]) for k in outs.split())]
    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    model = _field(1, 8) + _field(7, b"".join(graph)) + _field(8, _field(1, "") + _field(2, 17)) + _field(8, _field(1, "com.microsoft") + _field(2, 1))
    return ort.InferenceSession(model, options, providers=["CPUExecutionProvider"]), ins.split(), outs.split()


def run(name: str, values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The outputs of a graph by name; ``values`` holds its inputs, and may hold more."""
    session, ins, outs = _session(name)
    return dict(zip(outs, session.run(outs, {k: values[k] for k in ins}), strict=True))


@functools.cache
def usable() -> bool:
    """Whether onnxruntime is there and runs these graphs; else numpy does the same."""
    try:
        return all(_session(name) for name in _GRAPHS)
    except Exception:
        return False
