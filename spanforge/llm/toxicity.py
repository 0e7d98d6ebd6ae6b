"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the buckets of its words, its pairs of neighbours and its pairs with one word between, each once.
Training keeps a rate for each coordinate and an L1 bound, so few buckets get a weight; those go to the executors.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean

#: Labelled rows that the fit reads at most: those with the least hash of their id. Their texts are read whole, and each
#: gives at most 2**BITS features.
FIT_ROWS, BITS = 16_384, 20
REMEMBERED = 300_000
#: Features that are counted at a time, and rows that the fit's workers get in a batch.
PART, BATCH = 1 << 18, 1024
WORD = re.compile(r"\w+").findall


class Hasher:
    """Feature buckets of a text; remembers word hashes."""

    def __init__(self, bits: int = BITS):
        self.bits, self.known = bits, {}

    def __call__(self, text: str) -> np.ndarray:
        words = WORD(text.lower())
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words).difference(known):
                b = w.encode()
                known[w] = zlib.crc32(b) << 32 | zlib.crc32(b, 0x5BD1E995)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        skip = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] + np.uint64(1)
        mixed = np.concatenate([h, pair, skip]) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int32)

    def features(self, text: str | None) -> np.ndarray:
        return np.unique(self(text or ""))


@dataclass
class FtrlModel:
    """Buckets with a weight, sorted; all others weigh 0."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS
    _dense: np.ndarray | None = field(default=None, repr=False, compare=False)

    def score(self, features: np.ndarray) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << self.bits, np.float32)
            self._dense[self.index] = self.weight
        w = self._dense[features]
        hit = np.flatnonzero(w)
        if len(hit) > 1:
            hit = hit[np.unique(features[hit], return_index=True)[1]]
        return float(1 / (1 + np.exp(-np.clip(self.bias + w[hit].sum(dtype=np.float64), -30, 30))))

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}


def _ftrl(flat: np.ndarray, ends: np.ndarray, labels: np.ndarray, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, least: int) -> FtrlModel:
    """``flat`` holds the features of all rows in order, row i up to ``ends[i]``; it is overwritten by those of them that
    count, row by row, so that the fit takes little more memory than its features."""
    seen = np.zeros(1 << bits, np.int64)
    for at in range(0, len(flat), PART):
        seen += np.bincount(flat[at : at + PART], minlength=1 << bits)
    enough, y = seen >= least, labels.astype(float)
    kept, start, size = np.empty(len(ends), np.int64), 0, 0
    for i, end in enumerate(ends.tolist()):
        x, start = flat[start:end], end
        x = x[enough[x]]
        flat[size : size + len(x)] = x
        kept[i] = size = size + len(x)
    ends = kept
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bz = bn = bias = 0.0
    for _ in range(epochs):
        start = 0
        for end, label in zip(ends.tolist(), y.tolist()):
            x, start = flat[start:end], end
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            bias = -bz / ((beta + np.sqrt(bn)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - label
            more = nx + g * g
            z[x] = zx + g - (np.sqrt(more) - np.sqrt(nx)) / alpha * w
            n[x] = more
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * bias
            bn += g * g
    some = np.flatnonzero(np.abs(z) > l1)
    w = -(z[some] - np.sign(z[some]) * l1) / ((beta + np.sqrt(n[some])) / alpha + l2)
    return FtrlModel(some.astype(np.int32), w.astype(np.float32), float(bias) if len(y) else -2.0, bits)


#: Rates, bounds and passes of the fit. Buckets of fewer than ``least`` texts are left out: one text's rare words would
#: explain its label and starve the words that texts share.
RATES = {"alpha": 1.0, "beta": 1.0, "l1": 2.0, "l2": 0.02, "epochs": 8, "least": 3}


def fit(rows: list[tuple[str | None, int]], bits: int = BITS, **rates) -> FtrlModel:
    """FTRL-proximal over (text, label 0 or 1) in the given order, ``epochs`` times."""
    hasher = Hasher(bits)
    features = [hasher.features(t) for t, _ in rows]
    flat = np.concatenate([np.empty(0, np.int32), *features])
    return _ftrl(flat, np.cumsum([len(x) for x in features], dtype=np.int64), np.array([y for _, y in rows]), bits, **RATES | rates)


def fit_frame(sample: DataFrame, bits: int = BITS, **rates) -> FtrlModel:
    """``fit`` of a ``labelled_sample`` on the executors: features are made where the texts are; one task passes over
    them, in the order of the ids' hashes, as one array of 4 bytes each. The driver sees the weights alone, which the L1
    bound keeps few."""
    rates = RATES | rates

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = pa.array([hasher.features(t) for t in part.column("t").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("id"), part.column("y"), x], names=["h", "id", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, counts, labels = array("i"), [0], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            counts += pc.list_value_length(batch.column(1)).to_pylist()
            flat.frombytes(batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint8))
        pa.default_memory_pool().release_unused()  # the worker lives on and serves later stages
        got = _ftrl(np.frombuffer(flat, np.int32), np.cumsum(counts, dtype=np.int64)[1:], np.array(labels), bits, **rates)
        index, weight = np.append(got.index, -1), np.append(got.weight, got.bias)  # the bias last, as bucket -1
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.array(weight, pa.float64())], names=["bucket", "weight"])

    kind = sample.schema["id"].dataType.simpleString()
    made = sample.select("h", "id", "y", "t").mapInArrow(lean(features), f"h bigint, id {kind}, y int, x array<int>")
    one = made.repartition(1).sortWithinPartitions("h", "id").select("y", "x")
    conf, name = sample.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = conf.get(name)
    conf.set(name, BATCH)  # a row has thousands of features
    try:
        got = one.mapInArrow(lean(learn), "bucket int, weight double").toArrow()
    finally:
        conf.set(name, rows)
    if not got.num_rows:  # no row, so no task
        return fit([], bits)
    index, weight = got.column("bucket").to_numpy(), got.column("weight").to_numpy()
    return FtrlModel(index[:-1], weight[:-1].astype(np.float32), float(weight[-1]), bits)


def score_toxicity(docs: DataFrame, model: FtrlModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row: how likely label 1 is for the whole text, 0 to 1. Null counts as empty; an empty text has
    the score of the bias; repeated rows score alike, each by itself. Other columns are ignored; an empty table gives an
    empty result. The weights are as many as the L1 bound leaves, at most 2**bits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = shared.value, Hasher(shared.value.bits)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                score = [known.score(hasher(t or "")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], names=["id", "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(lean(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: FtrlModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns stay as they are. One pass, no join."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = shared.value, Hasher(shared.value.bits)
        at = columns.index(text_col)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                clean = [known.score(hasher(t or "")) < threshold for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
