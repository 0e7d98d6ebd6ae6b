"""Scans windows with a byte model inside ``mapInArrow``; the model is broadcast once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import log_softmax, spans_of, viterbi


@dataclass
class ByteClassModel:
    """Marks each byte of a class as a span of its own: its answer is known exactly, so scans can be checked."""

    classes: tuple[bytes, ...]
    gain: float = 20.0

    @property
    def entities(self) -> int:
        return len(self.classes)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Label scores (n, T, 1 + 4 * entities) of padded windows of bytes (n, T)."""
        out = np.zeros((*x.shape, 1 + 4 * self.entities), np.float32)
        for e, members in enumerate(self.classes):
            out[..., 4 + 4 * e] = np.where(np.isin(x, np.frombuffer(members, np.uint8)), self.gain, -self.gain)
        return out


def scan_windows(wins: DataFrame, model, key: str = "doc_id", batch: int = 256) -> DataFrame:
    """(key, win, start, end, type, conf) of windows (key, win, start, content): spans at document offsets.

    The window is the unit of work, so one long document is spread over tasks. A batch's windows share one padded
    matrix; what a worker holds is bounded by ``batch`` windows."""
    shared = wins.sparkSession.sparkContext.broadcast(model)
    schema = f"{key} bigint, win bigint, start bigint, end bigint, type int, conf float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                keys, win, starts, raw = (part.column(i).to_pylist() for i in range(4))
                width = max(map(len, raw), default=0)
                x = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in raw), np.uint8).reshape(len(raw), width)
                logp = log_softmax(m.logits(x).astype(np.float64)) if width else np.zeros((len(raw), 0, 1))
                rows = []
                for length in sorted(set(map(len, raw))):  # padding must not take part in a path
                    some = [i for i, b in enumerate(raw) if len(b) == length]
                    for i, path in zip(some, viterbi(logp[some, :length], m.entities)):
                        rows += [(keys[i], win[i], starts[i] + a, starts[i] + z, e, c) for a, z, e, c in spans_of(path, logp[i, :length], m.entities)]
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int64()] * 4 + [pa.int32(), pa.float32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[key, "win", "start", "end", "type", "conf"])

    return wins.select(key, F.col("win").cast("bigint").alias("win"), F.col("start").cast("bigint").alias("start"), "content").mapInArrow(run, schema)
