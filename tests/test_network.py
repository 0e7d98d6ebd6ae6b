"""Byte models: containers, layers against plain loops, heads, refusals, and runs over DataFrames."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions.bytestr import byte_string
from spanforge.model import gguf, layers
from spanforge.model.gguf import ModelError
from spanforge.model.network import EXITED, GATED, SKIPPED, Network
from spanforge.model.run import Options, head_values, run_streams, run_windows, scan_documents, spans, window_totals
from spanforge.streaming.chunks import chunks

ARCH = "bytes"


def made(seed=0, d=12, kinds=("causal",), heads=(("choice", {}), ("tag", {})), ngrams=(), meta=None, look=0):
    """A random model: its metadata and tensors."""
    r = np.random.default_rng(seed)
    normal = lambda *s: r.normal(0, 0.5, s).astype(np.float32)
    m = {"general.architecture": ARCH, "general.name": f"made-{seed}", f"{ARCH}.format_version": 3, f"{ARCH}.d_model": d, f"{ARCH}.n_layers": len(kinds), f"{ARCH}.head.count": len(heads)}
    m |= {f"{ARCH}.{k}": v for k, v in (("n_heads", 4), ("d_head", 3), ("d_state", 10), ("n_groups", 2), ("conv_width", 4), ("window.size", 48), ("window.min", 1))}
    t = {"embed.weight": normal(256, d), "out_norm.weight": 1 + normal(d)}
    for i, kind in enumerate(kinds):
        at = f"blocks.{i}."
        t[at + "norm.weight"] = 1 + normal(d)
        if kind == "attention":
            m |= {f"{ARCH}.block.{i}.type": "attention", f"{ARCH}.block.{i}.head_dim": d // 2}
            t |= {at + "qkv.weight": normal(3 * d, d), at + "out.weight": normal(d, d)}
            continue
        m[f"{ARCH}.block.{i}.direction"] = kind
        inner, channels = 12, 12 + 2 * 2 * 10
        t |= {at + "in_proj.weight": normal(inner + channels, d), at + "dt_proj.weight": normal(4, d), at + "dt_bias": normal(4), at + "A_log": normal(4), at + "D": normal(4)}
        t |= {at + "conv1d.weight": normal(channels, 1, 4), at + "conv1d.bias": normal(channels), at + "gated_norm.weight": 1 + normal(inner), at + "out_proj.weight": normal(d, inner)}
    for i, (kind, own) in enumerate(heads):
        m |= {f"{ARCH}.head.{i}.type": kind} | {f"{ARCH}.head.{i}.{k}": v for k, v in own.items()}
        at, pooled = f"heads.{i}.", d * (1 if own.get("pooling") in ("last", "mean", "max") else 2)
        if kind in ("choice", "multilabel", "score"):
            t |= {at + "mlp.0.weight": normal(7, pooled), at + "mlp.0.bias": normal(7), at + "mlp.2.weight": normal(3, 7), at + "mlp.2.bias": normal(3)}
        elif kind == "ordinal":
            t |= {at + "w.weight": normal(1, pooled), at + "b": normal(3)}
        elif kind == "exit":
            t |= {at + "proj.weight": normal(1, 2 * d), at + "proj.bias": normal(1)}
        else:
            n = 9 if kind == "tag" else 5
            t |= {at + "proj.weight": normal(n, d), at + "proj.bias": normal(n)}
    for n in ngrams:
        t[f"ngram.{n}.table"] = normal(31, 5)
    if ngrams:
        t["ngram.proj.weight"] = normal(d, 5 * len(ngrams))
    if look:
        t["look.conv_w"] = normal(d, look)
    return m | {f"{ARCH}.{k}": v for k, v in (meta or {}).items()}, t


def model(*args, **kw):
    return gguf.build(*made(*args, **kw))


def data(n, t, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (n, t)).astype(np.uint8)


def test_container_round_trip():
    m = {"a": True, "b": -5, "c": 1.5, "d": "é", "e": [1, 2], "f": ["x", "yz"], "g": [[1], [2, 3]], "h": []}
    t = {"x": np.arange(6, dtype=np.float32).reshape(2, 3), "y": np.arange(5, dtype=np.uint8), "z": np.float32(3)}
    box = gguf.parse(gguf.build(m, t))
    assert box.meta == m and all(np.array_equal(box.tensors[k], t[k]) for k in t)


@pytest.mark.parametrize("cut", [0, 3, 7, 20, 60, 200])
def test_truncated_containers_are_refused(cut):
    with pytest.raises(ModelError):
        gguf.parse(model()[:cut])


def naive_block(x, t, at, direction):
    """The block of ``made`` in plain loops of binary64, one window (T, d)."""
    H, P, N, G, K, inner = 4, 3, 10, 2, 4, 12
    w = {k[len(at) :]: v.astype(float) for k, v in t.items() if k.startswith(at)}
    norm = lambda v, g: [a / math.sqrt(sum(b * b for b in v) / len(v) + 1e-5) * c for a, c in zip(v, g)]
    xn = np.array([norm(row, w["norm.weight"]) for row in x])
    p = xn @ w["in_proj.weight"].T
    dt = np.log1p(np.exp(xn @ w["dt_proj.weight"].T + w["dt_bias"]))

    def scan(p, dt, with_d):
        u = np.zeros((len(p), inner + 2 * G * N))
        for i in range(len(p)):
            for c in range(u.shape[1]):
                acc = w["conv1d.bias"][c] + sum(w["conv1d.weight"][c, 0, k] * p[i - (K - 1) + k, inner + c] for k in range(K) if i - (K - 1) + k >= 0)
                u[i, c] = acc / (1 + math.exp(-acc))
        y, s = np.zeros((len(p), inner)), np.zeros((H, P, N))
        for i in range(len(p)):
            for h in range(H):
                g = h // (H // G)
                b, c = u[i, inner + g * N : inner + (g + 1) * N], u[i, inner + G * N + g * N : inner + G * N + (g + 1) * N]
                for q in range(P):
                    s[h, q] = math.exp(-math.exp(w["A_log"][h]) * dt[i, h]) * s[h, q] + dt[i, h] * u[i, h * P + q] * b
                    y[i, h * P + q] = s[h, q] @ c + with_d * w["D"][h] * u[i, h * P + q]
        return y, u[:, :inner]

    y, v = scan(p, dt, direction != "hydra")
    if direction != "causal":
        back = scan(p[::-1], dt[::-1], direction != "hydra")[0]
        T = len(p)
        if direction == "bimamba":
            y = np.array([y[i] + back[T - 1 - i] for i in range(T)])
        else:
            y = np.array([(y[i - 1] if i else 0) + (back[T - 2 - i] if i < T - 1 else 0) + np.repeat(w["D"], P) * v[i] for i in range(T)])
    z = p[:, :inner]
    y = y * z / (1 + np.exp(-z))
    y = np.array([sum((list(np.array(norm(row[g * 6 : g * 6 + 6], w["gated_norm.weight"][g * 6 : g * 6 + 6]))) for g in range(G)), []) for row in y])
    return x + y @ w["out_proj.weight"].T


@pytest.mark.parametrize("direction", ["causal", "bimamba", "hydra"])
def test_state_space_equals_loops(direction):
    _, t = made(3, kinds=(direction,))
    net = Network(model(3, kinds=(direction,)))
    x = np.random.default_rng(5).normal(0, 1, (2, 9, 12)).astype(np.float32)
    got = net.blocks[0](x)
    for i in range(2):
        assert np.allclose(got[i], naive_block(x[i].astype(float), t, "blocks.0.", direction), rtol=1e-4, atol=1e-5)


def test_attention_equals_loops():
    _, t = made(4, kinds=("attention",))
    block = Network(model(4, kinds=("attention",))).blocks[0]
    x = np.random.default_rng(6).normal(0, 1, (1, 7, 12))
    w = {k: v.astype(float) for k, v in t.items()}
    xn = x[0] / np.sqrt((x[0] ** 2).mean(-1, keepdims=True) + 1e-5) * w["blocks.0.norm.weight"]
    qkv = xn @ w["blocks.0.qkv.weight"].T
    y = np.zeros((7, 12))
    for j in range(2):
        q, k, v = (qkv[:, part * 12 + j * 6 : part * 12 + j * 6 + 6].copy() for part in range(3))
        for a in (q, k):
            for i in range(7):
                for m in range(3):
                    c, s = math.cos(i * 10000 ** (-m / 3)), math.sin(i * 10000 ** (-m / 3))
                    a[i, m], a[i, m + 3] = a[i, m] * c - a[i, m + 3] * s, a[i, m] * s + a[i, m + 3] * c
        for i in range(7):
            e = np.array([k[u] @ q[i] / math.sqrt(6) for u in range(i + 1)])
            e = np.exp(e - e.max())
            y[i, j * 6 : j * 6 + 6] = (e / e.sum()) @ v[: i + 1]
    assert np.allclose(block(x.astype(np.float32))[0], x[0] + y @ w["blocks.0.out.weight"].T, rtol=1e-4, atol=1e-5)


def test_ngram_rows_and_gate():
    net = Network(model(5, ngrams=(2, 4)))
    b = data(1, 9)[0]
    rows = net.ngrams.rows(b[None], np.zeros((1, 0), np.uint8))[0]
    for t in range(9):
        want = []
        for i, n in enumerate((2, 4)):
            v = 1000 * i + 7
            for k in range(n - 1, -1, -1):
                v = (v * 257 + (int(b[t - k]) if t >= k else 0) + 1) % (2**31 - 1)
            want.append(net.ngrams.tables[i][v % 31])
        assert np.array_equal(rows[t], np.concatenate(want))
    m, t = made(5, ngrams=(2,), meta={"ngram.gate": True})
    gated = Network(gguf.build(m, t | {"ngram.gate_bias": np.float32(50)}))  # the gate is open
    assert np.allclose(gated.hidden(b[None])[0], Network(gguf.build(*made(5, ngrams=(2,)))).hidden(b[None])[0], atol=1e-5)


def test_packed_weights():
    m, t = made(6, meta={"tern.group": 4, "tern.type": "own_tern2", "ngram.bits": 4}, ngrams=(3,))
    w = np.random.default_rng(0).integers(-1, 2, (12, 12))
    packed = np.zeros((12, 3), np.uint8)
    for j in range(12):
        packed[:, j // 4] |= (np.where(w[:, j] < 0, 2, w[:, j]) << 2 * (j % 4)).astype(np.uint8)
    scales = np.random.default_rng(1).uniform(0.1, 1, (12, 3)).astype(np.float32)
    del t["blocks.0.out_proj.weight"]
    nibbles = np.random.default_rng(2).integers(-8, 8, (31, 6))
    t |= {"blocks.0.out_proj.weight.packed": packed, "blocks.0.out_proj.weight.scales": scales, "ngram.3.scale": np.full(31, 0.5, np.float32), "ngram.proj.weight": np.ones((12, 6), np.float32)}
    t["ngram.3.table"] = ((nibbles[:, ::2] & 15) | ((nibbles[:, 1::2] & 15) << 4)).astype(np.uint8)
    net = Network(gguf.build(m, t))
    assert np.allclose(net.blocks[0].out_proj, w * np.repeat(scales, 4, 1))
    assert np.allclose(net.ngrams.tables[0], nibbles * 0.5)
    packed[3, 2] |= 3
    with pytest.raises(ModelError):
        Network(gguf.build(m, t))


def test_fused_steps_round_once():
    r = np.random.default_rng(2)
    a, b, c = (r.normal(0, 1, 500).astype(np.float32) * np.float32(2.0) ** r.integers(-20, 20, 500).astype(np.float32) for _ in range(3))
    for x, y, z, got in zip(a, b, c, layers.fused(a, b, c)):
        exact = Fraction(float(x)) * Fraction(float(y)) + Fraction(float(z))
        near = [np.nextafter(np.float32(got), np.float32(s)) for s in (-np.inf, np.inf)]
        assert all(abs(Fraction(float(got)) - exact) <= abs(Fraction(float(n)) - exact) for n in near)
    v = r.normal(0, 1, (2, 37)).astype(np.float32)
    assert layers.exact_dot(*v) == pytest.approx(float(v[0].astype(float) @ v[1].astype(float)), abs=1e-5)


ALL = (("choice", {"pooling": "last"}), ("multilabel", {"pooling": "max", "gated_by": 0}), ("score", {"pooling": "mean", "scale": [2.0, 1.0, 0.5]}), ("ordinal", {"pooling": "max_mean"}), ("tag", {"gated_by": 0, "labels": ["A", "B"]}), ("byte_map", {}), ("exit", {"layer": 1, "features": "rms_max_mean", "threshold": 0.3}))


def test_heads_gates_and_exit():
    net = Network(model(7, kinds=("causal", "hydra"), heads=ALL, look=2))
    x = data(40, 30)
    got = net.run(x)
    p = got.heads[0].values
    assert np.allclose(p.sum(-1), 1, atol=1e-5) and np.array_equal(got.label, p.argmax(-1)) and np.allclose(got.p_positive, 1 - p[:, 0])
    on = np.flatnonzero(got.label)
    assert 0 < len(on) < 40 and np.array_equal(got.heads[1].rows, on) and np.array_equal(got.heads[4].rows, on)
    assert np.array_equal(got.flags & GATED > 0, got.label == 0)
    assert len(net.run(x, ungated=True).heads[4].rows) == 40
    assert got.heads[5].classes.shape == (40, 30) and set(got.heads[3].label) <= {0, 1, 2, 3}
    for net.exit["threshold"] in np.linspace(-30, 30, 121):  # one that stops some windows
        early = net.run(x, early_exit=True)
        if 10 <= (early.flags & EXITED > 0).sum():
            break
    gone = early.flags & EXITED > 0
    assert 0 < gone.sum() < 40 and not early.label[gone].any() and np.allclose(early.hidden[~gone], got.hidden[~gone], atol=1e-4)
    alone = [net.run(x[i : i + 1]).hidden[0] for i in range(5)]
    assert np.allclose(alone, got.hidden[:5], atol=1e-4)  # a batch is many windows, not one
    assert net.entities == ["A", "B"] and [h.name for h in net.heads][:2] == ["choice", "multilabel"]
    assert len(set(net.digests(got))) == 40 and np.array_equal(net.digests(got), net.digests(got))


@pytest.mark.parametrize(
    "change, status",
    [
        ({"format_version": 4}, "unsupported"), ({"format_version": 1}, "format"), ({"d_model": 13}, "format"), ({"required_features": ["magic"]}, "unsupported"),
        ({"block.0.type": "lstm"}, "unsupported"), ({"block.0.direction": "up"}, "unsupported"), ({"head.0.type": "oracle"}, "unsupported"), ({"head.0.temperature": -1.0}, "format"),
        ({"head.0.pooling": "median"}, "unsupported"), ({"head.1.scheme": "IO"}, "unsupported"), ({"head.1.gated_by": 1}, "format"), ({"window.stride": 49}, "format"),
        ({"context": "stream", "window.min": 1, "block.0.direction": "hydra"}, "format"), ({"head.1.labels": ["one"]}, "format"), ({"n_groups": 3}, "format"), ({"head.1.operating_bias": float("nan")}, "format"),
        ({"head.1.n_entities": 3}, "format"), ({"lookahead": 2}, "format"), ({"window.size": 1 << 20}, "format"),
    ],
)
def test_refusals(change, status):
    with pytest.raises(ModelError) as e:
        Network(model(1, meta=change))
    assert e.value.status == status


def test_unused_and_bad_tensors_are_refused():
    m, t = made(1)
    for extra, status in (({"left.over": np.zeros(3)}, "unsupported"), ({"blocks.0.D": np.full(4, np.nan)}, "format"), ({"blocks.0.D": np.zeros(5)}, "format"), ({"embed.weight": np.zeros((256, 12), np.uint8)}, "format")):
        with pytest.raises(ModelError) as e:
            Network(gguf.build(m, t | extra))
        assert e.value.status == status


def flag_model(members: bytes):
    """Marks every byte of a class as a span of its own: what it finds is known exactly."""
    m, t = made(0, d=8, heads=(("choice", {}), ("tag", {"labels": ["FLAG", "NONE"]})))
    t["blocks.0.out_proj.weight"] = np.zeros((8, 12), np.float32)
    t["embed.weight"] = np.tile(np.eye(8, dtype=np.float32)[0], (256, 1))
    t["embed.weight"][list(members)] = np.eye(8)[1]
    t["out_norm.weight"] = np.ones(8)
    w = np.zeros((9, 8), np.float32)
    w[0, 0] = w[4, 1] = 20
    return gguf.build(m, t | {"heads.1.proj.weight": w, "heads.1.proj.bias": np.zeros(9, np.float32)})


def test_scan_equals_expression(spark):
    rows = [(1, "Ab1 É" * 50 + "Zz9"), (2, "x"), (3, ""), (4, None), (5, "Q" * 100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", byte_string(F.col("text")).alias("s"))
    flag = flag_model(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    for parts in (1, 4):
        got = scan_documents(docs.repartition(parts), flag, options=Options(digest=True, batch=3))
        found = {(r.doc_id, r.start, r.end, r.type) for r in spans(got, Network(flag).entities).collect()}
        want = {(i, p, p + 1, "FLAG") for i, t in rows for p, b in enumerate((t or "").encode()) if 65 <= b <= 90}
        assert found == want
    totals = {r.doc_id: r.windows for r in window_totals(got).collect()}
    assert totals == {1: 9, 2: 1, 5: 3}
    assert head_values(got, 0).count() == 13 and got.where("length(digest) = 16").count() == 13


def test_runs_skip_and_query(spark):
    wins = spark.createDataFrame([(1, 0, 0, bytearray(b"abc"), True), (1, 1, 3, bytearray(b"AbC"), None), (1, 2, 6, bytearray(b""), False)], "doc_id bigint, win int, start int, content binary, skipped boolean")
    got = {r.win: r for r in run_windows(wins, flag_model(b"AC")).collect()}
    assert got[0].flags == SKIPPED and got[0].heads == [] and got[2].heads == [] and got[1].flags == 0
    assert [(s.start, s.end) for s in got[1].heads[1].spans] == [(3, 4), (5, 6)]
    m, t = gguf.parse(flag_model(b"AC")).meta, gguf.parse(flag_model(b"AC")).tensors
    asked = gguf.build(m | {f"{ARCH}.query.region": 8, f"{ARCH}.query.max": 2}, t)
    got = {r.win: r for r in run_windows(wins, asked, options=Options(queries=("A",))).collect()}
    assert [(s.start, s.end) for s in got[1].heads[1].spans] == [(3, 4), (5, 6)]  # the A of the header is no finding
    with pytest.raises(ValueError):
        Network(asked).query.header(["too long a name"])


@pytest.mark.parametrize("size", [3, 7, 100])
def test_stream_equals_one_pass(spark, size):
    stream = model(9, kinds=("causal", "causal"), heads=(("choice", {}), ("byte_map", {})), ngrams=(2, 3), meta={"context": "stream", "window.size": size})
    net = Network(stream)
    bodies = {1: data(1, 50, 2)[0], 2: data(1, 3, 3)[0], 3: data(1, 0)[0]}
    docs = spark.createDataFrame([(i, bytearray(b.tobytes())) for i, b in bodies.items()], "doc_id bigint, content binary")
    rows = run_streams(chunks(docs, size).repartition(5), stream).orderBy("doc_id", "win").collect()
    for i, body in bodies.items():
        joined = b"".join(bytes(h.classes) for r in rows if r.doc_id == i for h in r.heads if h.head == 1)
        whole = net.run(body[None]).heads[1].classes[0].tobytes() if len(body) else b""
        assert joined == whole
        assert [r.start for r in rows if r.doc_id == i] == list(range(0, len(body), size))
