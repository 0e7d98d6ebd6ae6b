"""Layers over batches of windows: arrays are (windows, positions, channels) in binary32. In memory positions come last,
since channels can be few and loops over them short.

Every window of a batch has the same length, so nothing is masked. Products are matrix products, so sums are taken in
the order that the BLAS takes them; ``exact_dot`` is the order of lanes and fused steps that the format fixes, for
comparing single values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.float32(1e-5)
PRIME = 2**31 - 1
#: Values of states that a scan holds at once, beyond those of one step.
STATES = 1 << 17


def fused(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b + c of binary32 values, rounded once: the sum in binary64 is rounded to odd before the last rounding."""
    product = a.astype(np.float64) * b.astype(np.float64)
    c = c.astype(np.float64)
    total = product + c
    part = total - product
    lost = (product - (total - part)) + (c - part)
    even = (total.view(np.int64) & 1) == 0
    toward = np.where(lost > 0, np.inf, -np.inf)
    odd = np.where((lost != 0) & np.isfinite(total) & even, np.nextafter(total, toward), total)
    return odd.astype(np.float32)


def exact_dot(a: np.ndarray, x: np.ndarray) -> np.float32:
    """Eight lanes of fused steps, their fixed sum, then the rest one by one."""
    a, x = np.asarray(a, np.float32), np.asarray(x, np.float32)
    whole = len(a) // 8 * 8
    lane = np.zeros(8, np.float32)
    for i in range(0, whole, 8):
        lane = fused(a[i : i + 8], x[i : i + 8], lane)
    half = lane[:4] + lane[4:]
    r = (half[0] + half[1]) + (half[2] + half[3])
    for i in range(whole, len(a)):
        r = r + a[i] * x[i]
    return np.float32(r)


def rms_factor(x: np.ndarray) -> np.ndarray:
    d = x.shape[-1]
    if d < 8:  # the order in which NumPy sums so few, without its loop for each position
        q = np.square(x[..., 0], dtype=np.float64)
        for j in range(1, d):
            q += np.square(x[..., j], dtype=np.float64)
        q = (q / d).astype(np.float32)[..., None]
    else:
        q = (x.astype(np.float64, order="C") ** 2).mean(-1, keepdims=True).astype(np.float32)
    return np.float32(1) / np.sqrt(q + EPS)


def row_sum(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis in the order that NumPy has for up to 128 neighbours in memory."""
    n = x.shape[-1]
    if n > 128:
        return np.ascontiguousarray(x).sum(-1)
    lanes, rest = [x[..., j] for j in range(min(n, 8))], range(n // 8 * 8, n)
    if n < 8:
        lanes, rest = lanes[:1], range(1, n)
    for at in range(8, n - 7, 8):
        lanes = [lane + x[..., at + j] for j, lane in enumerate(lanes)]
    while len(lanes) > 1:
        lanes = [a + b for a, b in zip(lanes[::2], lanes[1::2])]
    out = lanes[0]
    for j in rest:
        out = out + x[..., j]
    return out


def rms_norm(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = x * rms_factor(x)
    out *= weight
    return out


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w.T``, window by window."""
    return np.matmul(w, x.swapaxes(1, 2)).swapaxes(1, 2)


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.exp(-x)
        out += np.float32(1)
        return np.divide(np.float32(1), out, out=out if isinstance(out, np.ndarray) else None)


def silu(x: np.ndarray) -> np.ndarray:
    return x * sigmoid(x)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.where(x > 20, x, np.log1p(np.exp(np.minimum(x, np.float32(20)))))


def ternary(packed: np.ndarray, scales: np.ndarray, columns: int, group: int) -> np.ndarray:
    """Weights of two-bit codes, four a byte from the low bits up; 3 and padding other than 0 are refused by None."""
    codes = (packed[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    codes = codes.reshape(len(packed), -1)
    if (codes == 3).any() or codes[:, columns:].any():
        return None
    value = np.array([0, 1, -1], np.float32)[codes[:, :columns]]
    return value * np.repeat(scales, group, axis=1)


@dataclass
class Ngrams:
    """Hashed n-gram rows, concatenated by order and hash head, projected and added to the stream."""

    orders: list[int]
    heads: int
    tables: list[np.ndarray]  # by order, then head: (buckets, part)
    proj: np.ndarray
    gate_bias: float | None = None

    @property
    def history(self) -> int:
        return max(self.orders) - 1

    def rows(self, data: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Concatenated rows for (windows, T) bytes; ``before``: (windows, m) bytes that precede them, m <= history."""
        n, t = data.shape
        missing = self.history - before.shape[1]
        codes = np.concatenate([np.zeros((n, missing), np.int64), before.astype(np.int64), data.astype(np.int64)], 1)
        parts = []
        for i, order in enumerate(self.orders):
            for h in range(self.heads):
                table = self.tables[i * self.heads + h]
                v = np.full((n, t), (1000 * i + 7 + 7919 * h) % PRIME, np.int64)
                for k in range(order - 1, -1, -1):
                    v = (v * 257 + codes[:, self.history - k : self.history - k + t] + 1) % PRIME
                parts.append(table[v % len(table)])
        return np.concatenate(parts, -1)

    def __call__(self, x: np.ndarray, data: np.ndarray, before: np.ndarray) -> np.ndarray:
        e = linear(self.rows(data, before), self.proj)
        if self.gate_bias is None:
            return x + e
        s = np.ascontiguousarray(x * rms_factor(x) * (e * rms_factor(e))).sum(-1, keepdims=True, dtype=np.float32)
        return x + sigmoid(s / np.sqrt(np.float32(x.shape[-1])) + np.float32(self.gate_bias)) * e


@dataclass
class StateSpace:
    """Selective state-space block: projections, a short causal convolution, and a scan with an input-dependent decay."""

    norm: np.ndarray
    in_proj: np.ndarray
    dt_proj: np.ndarray
    dt_bias: np.ndarray
    a_log: np.ndarray
    d: np.ndarray
    gated_norm: np.ndarray
    out_proj: np.ndarray
    heads: int
    width: int
    states: int
    groups: int
    taps: int
    conv: np.ndarray | None = None  # (channels, taps)
    conv_bias: np.ndarray | None = None
    direction: str = "causal"

    streams = property(lambda self: self.direction == "causal")

    def start(self, n: int) -> dict:
        """What a causal block remembers between chunks."""
        channels = self.heads * self.width + 2 * self.groups * self.states
        return {
            "rows": np.zeros((n, max(self.taps - 1, 0), channels), np.float32),
            "scan": np.zeros((n, self.heads, self.width, self.states), np.float32),
        }

    def _mixed(self, xbc: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if not self.taps:
            return silu(xbc)
        n, t, channels = xbc.shape
        padded = np.empty((n, channels, t + self.taps - 1), np.float32).swapaxes(1, 2)
        padded[:, : self.taps - 1], padded[:, self.taps - 1 :] = rows, xbc
        acc = padded[:, :t] * self.conv[:, 0]
        acc += self.conv_bias
        for k in range(1, self.taps):
            acc += padded[:, k : k + t] * self.conv[:, k]
        return silu(acc)

    def _scan(self, u: np.ndarray, dt: np.ndarray, decay: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y without the D term, last state)."""
        n, t, _ = u.shape
        inner, each = self.heads * self.width, self.heads // self.groups
        x = u[..., :inner].reshape(n, t, self.heads, self.width)
        b, c = (
            np.repeat(part.reshape(n, t, self.groups, self.states), each, axis=2) if each > 1 else part.reshape(n, t, self.groups, self.states)
            for part in np.split(u[..., inner:], 2, axis=-1)
        )
        y, fed = np.empty_like(x), dt[..., None] * x
        some = max(1, STATES // max(1, s.size))  # steps whose states are held at once
        for at in range(0, t, some):
            part = slice(at, at + some)
            held = np.moveaxis(fed[:, part, :, :, None] * b[:, part, :, None, :], 1, 0).copy()
            keeps = np.moveaxis(decay[:, part, :, None, None], 1, 0).copy()
            for i in range(len(held)):
                held[i] += keeps[i] * s
                s = held[i]
            seen = np.moveaxis(c[:, part], 1, 0)
            if self.states < 8:
                y[:, part] = np.moveaxis(row_sum(held * seen[..., None, :]), 0, 1)
            else:
                y[:, part] = np.moveaxis(np.matmul(held, seen[..., None])[..., 0], 0, 1)
        return x, y, s.copy()

    def __call__(self, x: np.ndarray, state: dict | None = None) -> np.ndarray:
        n, t, _ = x.shape
        inner = self.heads * self.width
        state = self.start(n) if state is None else state
        xn = rms_norm(x, self.norm)
        z, xbc = np.split(linear(xn, self.in_proj), [inner], axis=-1)
        dt = softplus(self.dt_bias + linear(xn, self.dt_proj))
        decay = np.exp(-np.exp(self.a_log) * dt)
        skip = self.d[:, None]
        v, y, last = self._scan(self._mixed(xbc, state["rows"]), dt, decay, state["scan"])
        if self.direction == "causal":
            if self.taps > 1:
                state["rows"] = np.concatenate([state["rows"], xbc[:, -(self.taps - 1) :]], 1)[:, -(self.taps - 1) :].copy()
            state["scan"], y = last, y + skip * v
        else:
            fresh = self.start(n)
            w, back, _ = self._scan(self._mixed(xbc[:, ::-1], fresh["rows"]), dt[:, ::-1], decay[:, ::-1], fresh["scan"])
            if self.direction == "bimamba":
                y = (y + skip * v) + (back + skip * w)[:, ::-1]
            else:  # hydra: each side sees only what is beyond the position
                none = np.zeros_like(y[:, :1])
                ahead = np.concatenate([back[:, ::-1][:, 1:], none], 1)
                y = (np.concatenate([none, y[:, :-1]], 1) + ahead) + skip * v
        y = y.reshape(n, t, inner) * silu(z)
        y = (lambda g: g * rms_factor(g))(y.reshape(n, t, self.groups, -1)).reshape(n, t, inner) * self.gated_norm
        return x + linear(y, self.out_proj)


@dataclass
class Attention:
    """Causal softmax attention with rotary positions."""

    norm: np.ndarray
    qkv: np.ndarray
    out: np.ndarray
    heads: int

    streams = False

    def __call__(self, x: np.ndarray, state: dict | None = None) -> np.ndarray:
        n, t, d = x.shape
        q, k, v = (
            part.reshape(n, t, self.heads, -1).transpose(0, 2, 1, 3)
            for part in np.split(rms_norm(x, self.norm) @ self.qkv.T, 3, axis=-1)
        )
        q, k = self._turned(q), self._turned(k)
        e = q @ k.transpose(0, 1, 3, 2) * (np.float32(1) / np.sqrt(np.float32(q.shape[-1])))
        e = np.where(np.tri(t, dtype=bool), e, -np.inf)
        w = np.exp(e - e.max(-1, keepdims=True))
        y = (w / w.sum(-1, keepdims=True)) @ v
        return x + y.transpose(0, 2, 1, 3).reshape(n, t, d) @ self.out.T

    @staticmethod
    def _turned(v: np.ndarray) -> np.ndarray:
        half = v.shape[-1] // 2
        step = np.float32(-np.log(10000.0) / half)
        angle = np.arange(v.shape[-2], dtype=np.float32)[:, None] * np.exp(np.arange(half, dtype=np.float32) * step)
        cos, sin, a, b = np.cos(angle), np.sin(angle), v[..., :half], v[..., half:]
        return np.concatenate([a * cos - b * sin, a * sin + b * cos], -1)


def inside(t: int, sizes: np.ndarray) -> np.ndarray:
    """Which of t positions belong to windows of these sizes: (windows, t, 1)."""
    return (np.arange(t) < sizes[:, None])[..., None]


def lookahead(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each position also sees ``weight.shape[1]`` positions to its right; past the end they are 0."""
    t, k = h.shape[1], weight.shape[1]
    padded = np.concatenate([h, np.zeros((len(h), k, h.shape[2]), np.float32)], 1)
    acc = sum(padded[:, j : j + t] * weight[:, j - 1] for j in range(1, k + 1))
    return h + acc
