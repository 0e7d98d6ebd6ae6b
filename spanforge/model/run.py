"""Byte models over DataFrames: windows or streams of documents in, one row a window out.

The model's bytes are broadcast and parsed once in a worker. The window is the unit of work: a long document spreads
over tasks. A stream model needs a document's chunks in order, so its chunks are sorted within partitions and state is
carried from batch to batch. A task holds about 4 MB of chunks and a state for each of their documents, however long a
document is; chunks of several documents run together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefilter import mark_prefiltered
from ..operators.windows import slice_of, whole_windows, windows
from .network import SKIPPED, Network, WindowBatch

SPAN = T.StructType([T.StructField(n, t, False) for n, t in (("start", T.LongType()), ("end", T.LongType()), ("type", T.IntegerType()), ("confidence", T.FloatType()))])
HEAD = T.StructType(
    [
        T.StructField("head", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("values", T.ArrayType(T.FloatType())),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("classes", T.BinaryType()),
    ]
)
RESULT = [
    T.StructField("win", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("p_positive", T.FloatType()),
    T.StructField("digest", T.StringType()),
    T.StructField("heads", T.ArrayType(HEAD)),
]


@dataclass(frozen=True)
class Options:
    early_exit: bool = False
    ungated: bool = False
    bias: tuple[float, ...] | None = None
    queries: tuple[str, ...] = ()
    digest: bool = False
    batch: int = 64
    #: Rule of the windows that are evaluated (none: all), and one window a document instead of sliding ones.
    prefilter: str | None = None
    whole: bool = False
    least: int | None = None


_LOADED: dict[str, Network] = {}


def network(data: bytes) -> Network:
    """The model of a worker process; another one replaces it."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Network(data)
    return _LOADED[key]


def _rows(batch: WindowBatch, starts: list[int], digests) -> list[dict]:
    """One dict a window: what ``RESULT`` has after length."""
    out = []
    for i in range(len(batch.flags)):
        label, p = int(batch.label[i]), float(batch.p_positive[i])
        out.append({"flags": int(batch.flags[i]), "label": None if label < 0 else label, "p_positive": None if np.isnan(p) else p, "heads": []})
        out[-1]["digest"] = None if digests is None else f"{int(digests[i]):016x}"
    for index, got in sorted(batch.heads.items()):
        for j, i in enumerate(got.rows.tolist()):
            spans = None if got.spans is None else [{"start": a + starts[i], "end": z + starts[i], "type": e, "confidence": c} for a, z, e, c in got.spans[j]]
            out[i]["heads"].append(
                {
                    "head": index,
                    "label": None if got.label is None else int(got.label[j]),
                    "values": None if got.values is None else got.values[j].tolist(),
                    "spans": spans,
                    "classes": None if got.classes is None else got.classes[j].tobytes(),
                }
            )
    return out


def _matrix(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The bytes of windows, filled up to a width, and their sizes where not all have it."""
    data = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in raw), np.uint8).reshape(len(raw), width)
    sizes = np.array([len(b) for b in raw])
    return data, None if (sizes == width).all() else sizes


#: Values of the widest layer that a batch of windows may have, and input rows that are dealt into batches together.
CELLS, ROWS = 1 << 19, 1024


def _batches(m: Network, raw: list[bytes], least: int, pad: bool = True) -> Iterator[tuple[list[int], np.ndarray, np.ndarray | None]]:
    """(places, bytes, sizes) of windows that run together: of one length, once they are filled up; ``least`` of them, or
    as many as ``CELLS`` holds. A window's answer does not depend on the others."""
    by_width: dict[int, list[int]] = {}
    for i, b in enumerate(raw):
        by_width.setdefault(m.padded(len(b)) if pad else len(b), []).append(i)
    for width, all_ in sorted(by_width.items()):
        n = max(least, CELLS // (width * max(m.widest)))
        for at in range(0, len(all_), n):
            yield all_[at : at + n], *_matrix([raw[i] for i in all_[at : at + n]], width)


def run_windows(wins: DataFrame, model: bytes, key: str = "doc_id", options: Options = Options()) -> DataFrame:
    """(key, win, start, length, flags, label, p_positive, digest, heads) of windows (key, win, start, content, skipped).

    ``skipped`` is optional: such windows are not evaluated and have the flag for it. Spans are at document offsets.
    A window without bytes has no heads."""
    shared, o = wins.sparkSession.sparkContext.broadcast(bytes(model)), options
    probe = Network(bytes(model))
    header = probe.query.header(list(o.queries)) if probe.query else b""
    if o.queries and not probe.query:
        raise ValueError("the model takes no queries")
    if o.bias is not None and len(o.bias) != len(probe.entities):
        raise ValueError("one bias for each type of the tag head is wanted")
    skipped = F.coalesce("skipped", F.lit(False)) if "skipped" in wins.columns else F.lit(False)
    use = wins.select(key, F.col("win").cast("bigint").alias("win"), F.col("start").cast("bigint").alias("start"), "content", skipped.alias("skipped"))
    schema = T.StructType([use.schema[key], *RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = network(shared.value)
        bias = None if o.bias is None else np.array(o.bias)
        for whole in batches:
            for part in _parts(whole, max(ROWS, o.batch)):
                rows = [{key: r[key], "win": r["win"], "start": r["start"], "length": len(r["content"] or b""), "flags": SKIPPED * r["skipped"], "label": None, "p_positive": None, "digest": None, "heads": []} for r in part]
                live = [i for i, r in enumerate(part) if r["content"] and not r["skipped"]]
                raw = [header + part[i]["content"] for i in live]
                for places, data, sizes in _batches(m, raw, o.batch):
                    some = [live[i] for i in places]
                    got = m.run(data, o.early_exit, o.ungated, bias, len(header), sizes=sizes)
                    for i, r in zip(some, _rows(got, [part[i]["start"] for i in some], m.digests(got) if o.digest else None)):
                        rows[i] |= r
                yield from pa.Table.from_pylist(rows, _arrow(schema)).to_batches()

    return use.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, rows: int, most: int = 1 << 22) -> Iterator[list[dict]]:
    """The rows of a batch, as many at a time as ``rows`` and about ``most`` bytes allow."""
    each = max(1, min(rows, most * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, each):
        yield batch.slice(at, each).to_pylist()


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def scan_documents(docs: DataFrame, model: bytes, key: str = "doc_id", s: str = "s", window: int | None = None, stride: int | None = None, options: Options = Options()) -> DataFrame:
    """``run_windows`` over byte strings, cut as the model declares or as the caller wants it. With a prefilter, windows
    that no part of its rule touches are skipped; with ``whole`` a document that is not empty is one window."""
    m = Network(bytes(model))
    span = (window or m.window) - (m.query.region if m.query else 0)
    stride = stride or (m.stride if window is None else span - span // 4)
    least = m.least if options.least is None else options.least
    d = docs.select(key, s)
    wins = whole_windows(d, F.length(s)) if options.whole else windows(d, F.length(s), span, stride, min(least, span))
    if options.prefilter:
        wins = mark_prefiltered(wins, options.prefilter, s)
    wins = wins.withColumn("content", F.encode(slice_of(F.col(s), F.col("start"), F.col("length")), "ISO-8859-1"))
    return run_windows(wins, model, key, options)


def run_streams(chunks: DataFrame, model: bytes, key: str = "doc_id", options: Options = Options()) -> DataFrame:
    """One row a chunk of chunks (key, seq, content) of consecutive bytes: as one pass over each whole document."""
    shared, o = chunks.sparkSession.sparkContext.broadcast(bytes(model)), options
    if not Network(bytes(model)).stream:
        raise ValueError("the model does not stream")
    use = chunks.select(key, F.col("seq").cast("bigint").alias("seq"), "content").repartition(key).sortWithinPartitions(key, "seq")
    schema = T.StructType([use.schema[key], *RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, open_ = network(shared.value), None  # (key, state, offset) of the document that the last rows left open
        bias = None if o.bias is None else np.array(o.bias)
        for whole in batches:
            for part in _parts(whole, ROWS):
                part = [r for r in part if r["content"]]
                docs: list[list[int]] = []  # places of each document's chunks
                for i, r in enumerate(part):
                    if i and r[key] == part[i - 1][key]:
                        docs[-1].append(i)
                    else:
                        docs.append([i])
                if not docs:
                    continue
                goes_on = open_ is not None and open_[0] == part[0][key]
                states = [open_[1] if goes_on and d == 0 else None for d in range(len(docs))]
                at, rows = [open_[2] if goes_on and d == 0 else 0 for d in range(len(docs))], [None] * len(part)
                for turn in range(max(map(len, docs))):
                    due = [d for d in range(len(docs)) if turn < len(docs[d])]
                    # only what ends its document can be filled up: of the others the state is needed
                    ends = [turn == len(docs[d]) - 1 and d < len(docs) - 1 for d in due]
                    for end in (True, False):
                        own = [d for d, e in zip(due, ends) if e == end]
                        raw = [part[docs[d][turn]]["content"] for d in own]
                        for places, data, sizes in _batches(m, raw, o.batch, pad=end):
                            some = [own[i] for i in places]
                            state = _stacked([states[d] or m.start(1) for d in some])
                            got = m.run(data, ungated=o.ungated, bias=bias, state=state, sizes=sizes)
                            made = _rows(got, [at[d] for d in some], m.digests(got) if o.digest else None)
                            for j, d in enumerate(some):
                                r = part[docs[d][turn]]
                                rows[docs[d][turn]] = {key: r[key], "win": r["seq"], "start": at[d], "length": len(r["content"])} | made[j]
                                states[d], at[d] = None if end else _taken(state, j), at[d] + len(r["content"])
                open_ = (part[-1][key], states[-1], at[-1])
                yield from pa.Table.from_pylist(rows, _arrow(schema)).to_batches()

    return use.mapInArrow(run, schema)


def _stacked(states: list[dict]) -> dict:
    """One state of several streams. Histories of bytes that are shorter are filled up with zeros, as n-grams read what
    precedes a document."""
    most = max(s["bytes"].shape[1] for s in states)
    blocks = [{k: np.concatenate([s["blocks"][i][k] for s in states]) for k in one} for i, one in enumerate(states[0]["blocks"])]
    return {"bytes": np.concatenate([np.pad(s["bytes"], ((0, 0), (most - s["bytes"].shape[1], 0))) for s in states]), "blocks": blocks}


def _taken(state: dict, j: int) -> dict:
    return {"bytes": state["bytes"][j : j + 1], "blocks": [{k: v[j : j + 1] for k, v in one.items()} for one in state["blocks"]]}


def spans(results: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """(key, win, start, end, type, conf): the tag head's spans with the names of their types."""
    each = results.select(key, "win", F.explode("heads").alias("h")).select(key, "win", F.explode("h.spans").alias("x"))
    name = F.get(F.array(*map(F.lit, names)).cast("array<string>"), F.col("x.type"))
    return each.select(key, "win", F.col("x.start").alias("start"), F.col("x.end").alias("end"), name.alias("type"), F.col("x.confidence").alias("conf"))


def head_values(results: DataFrame, head: int, key: str = "doc_id") -> DataFrame:
    """(key, win, values, label) of the windows where a head was computed; input of the aggregates of ``heads``."""
    found = results.select(key, "win", F.explode("heads").alias("h")).where(F.col("h.head") == head)
    return found.select(key, "win", "h.values", "h.label")


def window_totals(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, windows, skipped, exited, positive, max_positive)."""
    bit = lambda b: F.count_if(F.col("flags").bitwiseAND(F.lit(b)) > 0)
    return results.groupBy(key).agg(
        F.count(F.lit(1)).alias("windows"), bit(1).alias("skipped"), bit(2).alias("exited"), F.count_if(F.col("label") != 0).alias("positive"), F.max(F.nanvl("p_positive", F.lit(0.0))).alias("max_positive")
    )
