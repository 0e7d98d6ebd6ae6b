"""A byte model assembled from a container: what it declares, and its forward pass over batches of windows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from . import gguf
from .gguf import ModelError
from .labels import spans_of, viterbi
from .layers import Attention, Ngrams, StateSpace, exact_dot, inside, linear, lookahead, rms_factor, rms_norm, row_sum, sigmoid, silu, ternary  # noqa: F401

# Fixed values of the format: versions that are read, features, names.
NEWEST = 3
FEATURES = ("attention", "lookahead", "ngram_gate", "ngram_layer", "ngram_heads", "multilabel", "score", "ordinal", "byte_map", "query", "stream")
POOLINGS = {"last": 1, "mean": 1, "max": 1, "last_mean": 2, "max_mean": 2}
AGGREGATES = {
    "choice": ["max", "mean", "vote", "any"],
    "multilabel": ["max", "mean", "any"],
    "score": ["mean", "max", "min"],
    "ordinal": ["max", "mean"],
}
HEADS = [*AGGREGATES, "tag", "byte_map", "exit"]
SCHEME = "BIOES:O,B-e,I-e,E-e,S-e"
MOST_CELLS, MOST_ROW, MOST_ENTITIES, MOST_ATTENDED = 1 << 24, 1 << 20, 256, 8192
#: Bits of a window's flags.
SKIPPED, EXITED, GATED = 1, 2, 4


class Keys:
    """Metadata of one architecture: keys are looked up below its name; values are checked."""

    def __init__(self, meta: dict):
        self.meta = meta
        self.arch = meta.get("general.architecture")
        if not isinstance(self.arch, str) or not self.arch:
            raise ModelError("general.architecture")

    def get(self, key: str, default=None):
        return self.meta.get(f"{self.arch}.{key}", default)

    def has(self, key: str) -> bool:
        return f"{self.arch}.{key}" in self.meta

    def integer(self, key: str, default: int | None, low: int, high: int) -> int:
        v = self.get(key, default)
        if v is None or isinstance(v, bool) or not isinstance(v, int) or not low <= v <= high:
            raise ModelError(f"{key} is {v!r}; an integer in {low}..{high} is wanted")
        return v

    def number(self, key: str, default: float | None) -> float:
        v = self.get(key, default)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not np.isfinite(np.float32(v)):
            raise ModelError(f"{key} is {v!r}; a finite number is wanted")
        return float(np.float32(v))

    def text(self, key: str, default: str) -> str:
        v = self.get(key, default)
        if not isinstance(v, str):
            raise ModelError(f"{key} is no string")
        return v

    def numbers(self, key: str, n: int, default: float) -> np.ndarray:
        v = self.get(key, [default] * n)
        if not isinstance(v, list) or len(v) != n or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in v):
            raise ModelError(f"{key}: {n} numbers are wanted")
        out = np.array(v, np.float32)
        if not np.isfinite(out).all():
            raise ModelError(f"{key} is not finite")
        return out

    def names(self, key: str, n: int) -> list[str]:
        v = self.get(key)
        if v is None:
            return []
        if not isinstance(v, list) or len(v) != n or not all(isinstance(x, str) for x in v):
            raise ModelError(f"{key}: {n} names are wanted")
        return v


class Weights:
    """Tensors by name and shape; remembers which were used, since an unused one means another model."""

    def __init__(self, tensors: dict[str, np.ndarray], group: int):
        self.tensors, self.group, self.used = tensors, group, set()

    def has(self, name: str) -> bool:
        return name in self.tensors

    def get(self, name: str, *shape: int | None, packed: bool = False) -> np.ndarray:
        if name not in self.tensors:
            raise ModelError(f"{name} is missing")
        x = self.tensors[name]
        self.used.add(name)
        if (x.dtype == np.uint8) != packed:
            raise ModelError(f"{name} has another type")
        if x.ndim != len(shape) or any(w is not None and w != g for w, g in zip(shape, x.shape)):
            raise ModelError(f"{name} has shape {x.shape}; {shape} is wanted")
        if not packed and not np.isfinite(x).all():
            raise ModelError(f"{name} is not finite")
        return x

    def scalar(self, name: str) -> float:
        return float(self.get(name, *([1] if self.tensors.get(name, np.zeros(1)).ndim else [])).reshape(()))

    def linear(self, name: str, out: int, into: int) -> np.ndarray:
        if not self.has(f"{name}.packed"):
            return self.get(name, out, into)
        if self.group <= 0 or into % self.group:
            raise ModelError(f"{name}: the group does not divide {into}")
        codes = self.get(f"{name}.packed", out, -(-into // 4), packed=True)
        w = ternary(codes, self.get(f"{name}.scales", out, into // self.group), into, self.group)
        if w is None:
            raise ModelError(f"{name} holds an invalid code")
        return w


def softmax_rows(v: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        e = np.exp(v - np.fmax(np.float32(-1e30), np.fmax.reduce(v, axis=-1))[..., None])
        return e / e.sum(-1, keepdims=True)


def first_largest(p: np.ndarray) -> np.ndarray:
    """Index of the first largest value; NaN is never the largest, and without any number it is 0."""
    if p.shape[-1] > 16:
        return np.where(np.isnan(p), -np.inf, p).argmax(-1)
    best, at = np.where(np.isnan(p[..., 0]), -np.inf, p[..., 0]), np.zeros(p.shape[:-1], np.int8)
    for j in range(1, p.shape[-1]):
        np.copyto(at, j, where=p[..., j] > best)
        best = np.fmax(best, p[..., j])
    return at


def largest(p: np.ndarray) -> np.ndarray:
    """The largest value, as ``fmax`` has it."""
    if p.shape[-1] > 16:
        return np.fmax.reduce(p, axis=-1)
    best = p[..., 0]
    for j in range(1, p.shape[-1]):
        best = np.fmax(best, p[..., j])
    return best


@dataclass
class HeadResult:
    """Of the windows ``rows`` of a batch: values and label, or spans, or a class for each byte."""

    rows: np.ndarray
    values: np.ndarray | None = None
    label: np.ndarray | None = None
    positive: np.ndarray | None = None
    spans: list | None = None
    classes: np.ndarray | list | None = None


@dataclass
class Head:
    index: int
    kind: str
    name: str
    labels: list[str]
    gated_by: int = -1
    aggregate: str = ""
    pooling: str = "last_mean"
    parts: dict = field(default_factory=dict)

    def pooled(self, h: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        def one(how: str) -> np.ndarray:
            if how == "last":
                return h[:, -1] if sizes is None else h[np.arange(len(h)), sizes - 1]
            if how == "max":
                own = h if sizes is None else np.where(inside(h.shape[1], sizes), h, np.float32(-1e30))
                return np.fmax(np.float32(-1e30), np.fmax.reduce(own, axis=1))
            if sizes is None:
                return np.ascontiguousarray(h).mean(1, dtype=np.float32)
            return np.ascontiguousarray(np.where(inside(h.shape[1], sizes), h, np.float32(0))).sum(1, dtype=np.float32) / sizes[:, None].astype(np.float32)

        return np.concatenate([one(how) for how in self.pooling.split("_")], -1)

    def _mlp(self, h: np.ndarray, sizes: np.ndarray | None) -> np.ndarray:
        p = self.parts
        return silu(self.pooled(h, sizes) @ p["w0"].T + p["b0"]) @ p["w2"].T + p["b2"]

    def run(self, h: np.ndarray, rows: np.ndarray, bias: np.ndarray | None, skip: int, sizes: np.ndarray | None = None) -> HeadResult:
        """``h``: hidden states of the windows ``rows``; ``skip``: positions of a query prefix; ``sizes``: how many
        positions each window has, where not all."""
        p, out = self.parts, HeadResult(rows)
        if self.kind == "choice":
            out.values = softmax_rows(self._mlp(h, sizes) / np.float32(p["temperature"]))
            out.label = first_largest(out.values)
            out.positive = out.label != 0
        elif self.kind == "multilabel":
            out.values = sigmoid(self._mlp(h, sizes) / np.float32(p["temperature"]))
            out.positive = (out.values >= p["thresholds"]).any(-1)
        elif self.kind == "score":
            out.values = self._mlp(h, sizes) * p["scale"] + p["offset"]
        elif self.kind == "ordinal":
            out.values = sigmoid(self.pooled(h, sizes) @ p["w"].T + p["b"])
            out.label = (out.values > 0.5).sum(-1)
            out.positive = out.label > 0
        else:
            a = linear(h, p["w"])
            a += p["b"]
            if self.kind == "byte_map":
                out.classes = first_largest(a)[:, skip:].astype(np.uint8)
                if sizes is not None:
                    out.classes = [one[: z - skip] for one, z in zip(out.classes, sizes)]
            else:
                top = np.fmax(np.float32(-1e30), largest(a))[..., None]
                logp = a - (top + np.log(row_sum(np.exp(a - top)))[..., None])
                k = self.parts["entities"]
                paths = viterbi(logp, k, self.parts["bias"] if bias is None else bias, sizes)
                found = [spans_of(path, lp, k) for path, lp in zip(paths, logp)]
                out.spans = [[(max(s, skip) - skip, z - skip, e, c) for s, z, e, c in one if z > skip] for one in found]
        return out


@dataclass
class Query:
    region: int
    most: int
    prefix: str = "?"
    suffix: str = "\n"
    pad: str = "\n"

    def header(self, names: list[str]) -> bytes:
        if len(names) > self.most:
            raise ValueError(f"at most {self.most} queries")
        head = "".join(self.prefix + n + self.suffix for n in names).encode()
        if len(head) > self.region:
            raise ValueError("the queries do not fit their region")
        return head.ljust(self.region, self.pad.encode())


@dataclass
class WindowBatch:
    """Of n windows: flags, label and 1 - p[0] of the first choice head (NaN: none), hidden states, results by head."""

    flags: np.ndarray
    label: np.ndarray
    p_positive: np.ndarray
    hidden: np.ndarray
    alive: np.ndarray
    heads: dict[int, HeadResult]
    sizes: np.ndarray | None = None


class Network:
    """Immutable; one for each worker."""

    def __init__(self, data: bytes):
        box = gguf.parse(data)
        self.keys = k = Keys(box.meta)
        self.version = k.get("format_version")
        if isinstance(self.version, bool) or not isinstance(self.version, int) or self.version < 2:
            raise ModelError("format_version")
        if self.version > NEWEST:
            raise ModelError(f"format version {self.version}", "unsupported")
        if unknown := [f for f in k.get("required_features", []) if f not in FEATURES]:
            raise ModelError(f"features {unknown}", "unsupported")
        self.d, self.n_layers = k.integer("d_model", None, 1, 65536), k.integer("n_layers", None, 1, 4096)
        if k.has("tern.type") and not k.text("tern.type", "").endswith("_tern2"):
            raise ModelError("tern.type", "unsupported")
        if k.text("tern.encoding", "00=0,01=+1,10=-1") != "00=0,01=+1,10=-1":
            raise ModelError("tern.encoding", "unsupported")
        w = Weights(box.tensors, k.integer("tern.group", 0, 0, 1 << 31))
        self.widest = [self.d]
        self.embed, self.out_norm = w.get("embed.weight", 256, self.d), w.get("out_norm.weight", self.d)
        self.embed_rows = np.ascontiguousarray(self.embed.T)
        self._windows()
        self.ngrams, self.ngram_layer = self._ngrams(w), k.integer("ngram.layer", 0, 0, self.n_layers - 1)
        self.blocks = [self._block(w, i) for i in range(self.n_layers)]
        self.look = w.get("look.conv_w", self.d, None) if w.has("look.conv_w") else None
        taps = 0 if self.look is None else self.look.shape[1]
        if taps > 1024 or (k.has("lookahead") and k.integer("lookahead", None, 0, 1024) != taps):
            raise ModelError("lookahead")
        self._heads(w)
        if rest := sorted(set(box.tensors) - w.used):
            raise ModelError(f"tensors that the model does not use: {rest[:3]}", "unsupported")
        if self.stream and (self.look is not None or self.query or self.exit or not all(b.streams for b in self.blocks)):
            raise ModelError("the stream context with a part that cannot stream")
        if self.window * max(self.widest) > MOST_CELLS:
            raise ModelError("a window would need too much memory")
        self.name = str(box.meta.get("general.name", ""))

    def _windows(self) -> None:
        k = self.keys
        context = k.text("context", "window")
        if context not in ("window", "stream"):
            raise ModelError("context", "unsupported")
        self.stream = context == "stream"
        self.window = k.integer("window.size", 512, 1, 1 << 20)
        self.query = None
        if k.has("query.region"):
            region, most = k.integer("query.region", None, 1, min(1 << 20, self.window - 1)), k.integer("query.max", None, 1, 1024)
            pad = k.text("query.pad", "\n")
            if len(pad.encode()) != 1:
                raise ModelError("query.pad")
            self.query = Query(region, most, k.text("query.prefix", "?"), k.text("query.suffix", "\n"), pad)
        span = self.window - (self.query.region if self.query else 0)
        self.span, self.stride = span, k.integer("window.stride", span - span // 4, 1, span)
        self.least = k.integer("window.min", min(24, span), 1, (1 << 24) if self.stream else span)
        self.profile = k.text("profile", "none")

    def _ngrams(self, w: Weights) -> Ngrams | None:
        k, found = self.keys, {}
        for name in w.tensors:
            if m := re.fullmatch(r"ngram\.(\d+)\.(?:(\d+)\.)?table", name):
                found.setdefault(int(m[1]), []).append(m[2])
        orders = sorted(found)
        if k.has("ngram.orders") and k.get("ngram.orders") != orders:
            raise ModelError("ngram.orders")
        heads, bits = k.integer("ngram.heads", 1, 1, 64), k.integer("ngram.bits", 32, 4, 32)
        if bits not in (4, 32):
            raise ModelError("ngram.bits", "unsupported")
        if not orders:
            return None
        if orders[0] < 1 or orders[-1] > 64:
            raise ModelError("n-gram orders")
        tables = []
        for n in orders:
            for h in range(heads):
                name = f"ngram.{n}" if heads == 1 else f"ngram.{n}.{h}"
                if bits == 32:
                    tables.append(w.get(f"{name}.table", None, None))
                    continue
                packed = w.get(f"{name}.table", None, None, packed=True)
                nibbles = np.stack([packed & 15, packed >> 4], -1).reshape(len(packed), -1).astype(np.int8)
                signed = np.where(nibbles > 7, nibbles - 16, nibbles).astype(np.float32)
                tables.append(signed * w.get(f"{name}.scale", len(packed))[:, None])
        if len({t.shape for t in tables}) != 1:
            raise ModelError("n-gram tables differ in shape")
        buckets, part = tables[0].shape
        for key, is_ in (("ngram.buckets", buckets), ("ngram.dim", part * heads)):
            if k.get(key, 0) not in (0, is_):
                raise ModelError(key)
        width = part * len(tables)
        if buckets > 1 << 24 or width > 65536:
            raise ModelError("n-gram tables are too large")
        bias = w.scalar("ngram.gate_bias") if k.get("ngram.gate", False) else None
        return Ngrams(orders, heads, tables, w.get("ngram.proj.weight", self.d, width), bias)

    def _block(self, w: Weights, i: int):
        k, at, d = self.keys, f"blocks.{i}", self.d
        kind = k.text(f"block.{i}.type", "ssm_v2")
        if kind == "attention":
            head_dim = k.integer(f"block.{i}.head_dim", 64, 2, 4096)
            heads = k.integer(f"block.{i}.n_heads", d // head_dim, 1, 65536)
            if head_dim % 2 or heads * head_dim != d:
                raise ModelError(f"block {i}: heads")
            if self.window > MOST_ATTENDED:
                raise ModelError(f"block {i}: the window is too long for attention")
            self.widest.append(3 * d)
            return Attention(w.get(f"{at}.norm.weight", d), w.linear(f"{at}.qkv.weight", 3 * d, d), w.linear(f"{at}.out.weight", d, d), heads)
        if kind != "ssm_v2":
            raise ModelError(f"block type {kind}", "unsupported")
        own = lambda key, low: k.integer(f"block.{i}.{key}", k.get(key), low, 4096)
        heads, width, states, groups, taps = own("n_heads", 1), own("d_head", 1), own("d_state", 1), own("n_groups", 1), own("conv_width", 0)
        direction = k.text(f"block.{i}.direction", k.text("direction", "causal"))
        if direction not in ("causal", "bimamba", "hydra"):
            raise ModelError(f"direction {direction}", "unsupported")
        inner, channels = heads * width, heads * width + 2 * groups * states
        if heads % groups or taps > 64 or inner + channels > MOST_ROW or inner * states > MOST_ROW:
            raise ModelError(f"block {i}: sizes")
        self.widest.append(inner + channels)
        return StateSpace(
            norm=w.get(f"{at}.norm.weight", d),
            in_proj=w.linear(f"{at}.in_proj.weight", inner + channels, d),
            dt_proj=w.get(f"{at}.dt_proj.weight", heads, d),
            dt_bias=w.get(f"{at}.dt_bias", heads),
            a_log=w.get(f"{at}.A_log", heads),
            d=w.get(f"{at}.D", heads),
            gated_norm=w.get(f"{at}.gated_norm.weight", inner),
            out_proj=w.linear(f"{at}.out_proj.weight", d, inner),
            heads=heads, width=width, states=states, groups=groups, taps=taps, direction=direction,
            conv=w.get(f"{at}.conv1d.weight", channels, 1, taps)[:, 0] if taps else None,
            conv_bias=w.get(f"{at}.conv1d.bias", channels) if taps else None,
        )

    def _heads(self, w: Weights) -> None:
        k, d = self.keys, self.d
        self.heads, self.exit, names = [], None, set()
        for i in range(k.integer("head.count", 1, 0, 64)):
            key, at = f"head.{i}", f"heads.{i}"
            kind = k.text(f"{key}.type", "choice")
            if kind not in HEADS:
                raise ModelError(f"head type {kind}", "unsupported")
            name = k.text(f"{key}.name", kind)
            while name in names:
                name += f"_{i}"
            names.add(name)
            if kind == "exit":
                self._exit(w, key, at)
                continue
            head = Head(i, kind, name, [], k.integer(f"{key}.gated_by", -1, -1, 63))
            if kind in AGGREGATES:
                head.aggregate = k.text(f"{key}.aggregate", AGGREGATES[kind][0])
                head.pooling = k.text(f"{key}.pooling", "last_mean")
                if head.aggregate not in AGGREGATES[kind] or head.pooling not in POOLINGS:
                    raise ModelError(f"{key}: aggregate or pooling", "unsupported")
            pooled = d * POOLINGS[head.pooling]
            if kind in ("choice", "multilabel", "score"):
                w0, w2 = w.get(f"{at}.mlp.0.weight", None, pooled), w.get(f"{at}.mlp.2.weight", None, None)
                n = len(w2)
                head.parts = {"w0": w0, "b0": w.get(f"{at}.mlp.0.bias", len(w0)), "w2": w.get(f"{at}.mlp.2.weight", n, len(w0)), "b2": w.get(f"{at}.mlp.2.bias", n)}
                if kind != "score":
                    head.parts["temperature"] = t = k.number(f"{key}.temperature", 1.0)
                    if t <= 0:
                        raise ModelError(f"{key}.temperature")
                if kind == "multilabel":
                    head.parts["thresholds"] = k.numbers(f"{key}.thresholds", n, 0.5)
                if kind == "score":
                    head.parts |= {"scale": k.numbers(f"{key}.scale", n, 1.0), "offset": k.numbers(f"{key}.offset", n, 0.0)}
            elif kind == "ordinal":
                b = np.sort(w.get(f"{at}.b", None))[::-1]
                head.parts, n = {"w": w.get(f"{at}.w.weight", 1, pooled), "b": b}, len(b) + 1
            else:
                weight = w.get(f"{at}.proj.weight", None, d)
                n = len(weight)
                head.parts = {"w": weight, "b": w.get(f"{at}.proj.bias", n)}
                if kind == "tag":
                    n = self._tag(head, key, n)
                elif not 2 <= n <= 256:
                    raise ModelError(f"{key}: classes")
            head.labels = k.names(f"{key}.labels", n)
            self.heads.append(head)
        by_index = {h.index: h for h in self.heads}
        for h in self.heads:
            g = by_index.get(h.gated_by)
            if h.gated_by >= 0 and (g is None or g is h or g.gated_by >= 0 or g.kind not in ("choice", "multilabel", "ordinal")):
                raise ModelError(f"head {h.index}: gated_by")

    def _tag(self, head: Head, key: str, n: int) -> int:
        k, entities = self.keys, (n - 1) // 4
        if n != 1 + 4 * entities or not 1 <= entities <= MOST_ENTITIES or any(h.kind == "tag" for h in self.heads):
            raise ModelError(f"{key}: labels of the tag head")
        if k.get(f"{key}.n_entities", entities) != entities or k.get(f"{key}.n_labels", n) != n:
            raise ModelError(f"{key}: counts")
        if k.text(f"{key}.scheme", SCHEME) != SCHEME:
            raise ModelError(f"{key}.scheme", "unsupported")
        head.parts |= {"entities": entities, "bias": k.numbers(f"{key}.operating_bias_vec", entities, k.number(f"{key}.operating_bias", 0.0))}
        self.widest.append(n)
        return entities

    def _exit(self, w: Weights, key: str, at: str) -> None:
        k = self.keys
        if self.exit or self.n_layers < 2:
            raise ModelError(f"{key}: exit")
        if k.text(f"{key}.features", "") != "rms_max_mean":
            raise ModelError(f"{key}.features", "unsupported")
        self.exit = {
            "layer": k.integer(f"{key}.layer", None, 1, self.n_layers - 1),
            "threshold": k.number(f"{key}.threshold", None),
            "w": w.get(f"{at}.proj.weight", 1, 2 * self.d)[0].astype(np.float64),
            "b": float(w.get(f"{at}.proj.bias", 1)[0]),
        }

    @property
    def entities(self) -> list[str]:
        """Names of the tag head's types."""
        tag = next((h for h in self.heads if h.kind == "tag"), None)
        return (tag.labels or [f"entity_{i}" for i in range(tag.parts["entities"])]) if tag else []

    def describe(self) -> dict:
        heads = [{"index": h.index, "type": h.kind, "name": h.name, "labels": h.labels, "aggregate": h.aggregate, "gated_by": h.gated_by} for h in self.heads]
        window = {"size": self.window, "stride": self.stride, "min": self.least}
        return {"name": self.name, "format_version": self.version, "d_model": self.d, "layers": self.n_layers, "profile": self.profile, "context": "stream" if self.stream else "window", "window": window, "heads": heads}

    @property
    def pads(self) -> bool:
        """Whether what follows a window's bytes has no influence on them, so that windows of several sizes can share a
        batch."""
        return all(b.streams and isinstance(b, StateSpace) for b in self.blocks)

    def padded(self, size: int) -> int:
        """The length to which a window of ``size`` is filled up, by its size alone: an eighth more at most, or 64."""
        if not self.pads:
            return size
        step = max(64, 1 << max(0, size.bit_length() - 4))
        filled = -(-size // step) * step
        return self.window if size <= self.window < filled else filled

    def _exits(self, x: np.ndarray, sizes: np.ndarray | None) -> np.ndarray:
        v = x * rms_factor(x)
        if sizes is None:
            top, mean = np.fmax.reduce(v, axis=1), np.ascontiguousarray(v).mean(1, dtype=np.float64)
        else:
            own = inside(v.shape[1], sizes)
            top, mean = np.fmax.reduce(np.where(own, v, np.float32(-np.inf)), axis=1), np.ascontiguousarray(np.where(own, v, np.float32(0))).sum(1, dtype=np.float64) / sizes[:, None]
        f = np.concatenate([top.astype(np.float64), mean.astype(np.float32)], -1)
        return self.exit["b"] + f @ self.exit["w"] < self.exit["threshold"]

    def start(self, n: int) -> dict:
        """Carried state of a stream model for n streams."""
        return {"bytes": np.zeros((n, 0), np.uint8), "blocks": [b.start(n) for b in self.blocks]}

    def hidden(self, data: np.ndarray, early_exit: bool = False, state: dict | None = None, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(final hidden states, which windows were not stopped early) of windows (n, T) of bytes, T > 0."""
        before = np.zeros((len(data), 0), np.uint8) if state is None else state["bytes"]
        x, alive = np.ascontiguousarray(np.moveaxis(np.take(self.embed_rows, data, axis=1), 0, 1)).swapaxes(1, 2), np.ones(len(data), bool)
        for i, block in enumerate(self.blocks):
            some = slice(None) if alive.all() else alive
            if self.ngrams and self.ngram_layer == i:
                x[some] = self.ngrams(x[some], data[some], before[some])
            x[some] = block(x[some], None if state is None else state["blocks"][i])
            if early_exit and self.exit and self.exit["layer"] == i + 1:
                alive = ~self._exits(x, sizes)
                if not alive.any():
                    break
        if state is not None and self.ngrams:
            state["bytes"] = np.concatenate([before, data], 1)[:, max(0, before.shape[1] + data.shape[1] - self.ngrams.history) :]
        h = rms_norm(x, self.out_norm)
        if self.look is None:
            return h, alive
        return lookahead(h if sizes is None else np.where(inside(h.shape[1], sizes), h, np.float32(0)), self.look), alive

    def run(
        self, data: np.ndarray, early_exit: bool = False, ungated: bool = False, bias: np.ndarray | None = None, skip: int = 0, state: dict | None = None, sizes: np.ndarray | None = None
    ) -> WindowBatch:
        """``skip``: positions of a query prefix, which is part of ``data``; ``bias``: one value for each entity.
        ``sizes``: of how many positions each window is, prefix included, where ``data`` is filled up; for a model that
        ``pads``, and of ``state`` only what such a window leaves is of no use."""
        h, alive = self.hidden(data, early_exit, state, sizes)
        n, done = len(data), {}
        out = WindowBatch(np.where(alive, 0, EXITED), np.full(n, -1), np.full(n, np.nan, np.float32), h, alive, done, sizes)
        for head in sorted(self.heads, key=lambda x: x.gated_by >= 0):
            rows = np.flatnonzero(alive)
            if head.gated_by >= 0 and not ungated:
                gate = done.get(head.gated_by)
                rows = gate.rows[gate.positive] if gate else rows[:0]
                out.flags[np.setdiff1d(np.flatnonzero(alive), rows)] |= GATED
            if len(rows):
                all_ = len(rows) == n
                done[head.index] = head.run(h if all_ else h[rows], rows, bias, skip, sizes if sizes is None or all_ else sizes[rows])
        if first := next((x for x in self.heads if x.kind == "choice" and x.index in done), None):
            got = done[first.index]
            out.label[got.rows], out.p_positive[got.rows] = got.label, np.float32(1) - got.values[:, 0]
        out.label[~alive] = 0
        return out

    def digests(self, batch: WindowBatch) -> np.ndarray:
        """64-bit FNV-1a of each window's hidden states and the values of its heads, in head order."""
        h = np.full(len(batch.hidden), 0xCBF29CE484222325, np.uint64)

        def feed(rows: np.ndarray, values: np.ndarray) -> None:
            for b in np.ascontiguousarray(values, "<f4").reshape(len(rows), -1).view(np.uint8).T:
                h[rows] = (h[rows] ^ b) * np.uint64(0x100000001B3)

        sizes = np.full(len(h), batch.hidden.shape[1]) if batch.sizes is None else batch.sizes
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            feed(rows, batch.hidden[rows, :size])
        for index in sorted(batch.heads):
            if (got := batch.heads[index]).values is not None:
                feed(got.rows, got.values)
        return h
