"""Quality scores from compression with dictionaries of good and of bad labelled text.

A zstandard dictionary is trained for each label. A text is compressed with both; the difference of the two sizes over
the text's length says which texts it resembles. A logistic fit of that one number on labelled texts that trained no
dictionary makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, lean, written

#: Labelled rows that a fit reads at most: those with the least hash of their id. Their texts are read whole.
FIT_ROWS = 12_000
DICT_BYTES, LEVEL = 65_536, 3
#: Files at most that the sample is written to, however many partitions a session deals it to. Texts compressed at a time.
FILES, PART = 8, 1024
#: The trainer takes a text in pieces of so many bytes.
PIECE = 16_384
#: What a text's length counts more than it is, so that the shortest have a small difference.
LENGTH_MORE = 20


@dataclass
class CompressionClassifier:
    good: bytes
    bad: bytes
    weights: tuple[float, float] = (0.0, 0.0)
    level: int = LEVEL

    def compressors(self):
        made = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """(size by the bad dictionary - size by the good one) / length."""
        good, bad = self.compressors()
        sizes = np.array([(len(bad.compress(t)) - len(good.compress(t)), len(t) + LENGTH_MORE) for t in texts], float).reshape(-1, 2)
        return sizes[:, 0] / sizes[:, 1]

    def score(self, texts: list[bytes]) -> np.ndarray:
        bias, slope = self.weights
        return 1 / (1 + np.exp(-np.clip(bias + slope * self.differences(texts), -30, 30)))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode()


def dictionary(texts: list[bytes], dict_bytes: int = DICT_BYTES) -> bytes:
    """A dictionary of whole texts. Where they are too few for the trainer, it is their last bytes as they are; without
    any text it is one byte, which matches nothing."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(dict_bytes, [p for p in pieces if len(p) >= 8], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-dict_bytes:].rjust(8, b"\0")


def calibrated(differences: np.ndarray, labels: np.ndarray, ridge: float = 1e-4, rounds: int = 100) -> tuple[float, float]:
    """Bias and slope of a logistic fit by Newton's steps; of one label alone, the bias is its smoothed log odds."""
    y = np.asarray(labels, float)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return float(np.log(share / (1 - share))), 0.0
    x, w = np.column_stack([np.ones(len(y)), np.asarray(differences, float) * 10]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * w), -5, 5)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1] * 10)


def fit(rows: list[tuple[str | None, int]], dict_bytes: int = DICT_BYTES) -> CompressionClassifier:
    """``rows``: (text, label 0 or 1). Even rows train the dictionaries, odd rows the calibration."""
    data = [(_bytes(t), int(y)) for t, y in rows]
    good, bad = (dictionary([t for t, y in data[::2] if y == label], dict_bytes) for label in (1, 0))
    model, held = CompressionClassifier(good, bad), data[1::2]
    model.weights = calibrated(model.differences([t for t, _ in held]), np.array([y for _, y in held]))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int, learn_from=None) -> DataFrame:
    """(h, id, y, t): whole texts of at most ``rows`` labelled documents, those with the least hash ``h`` of their id.

    An id labelled more than once has its highest label; labels other than 0 and 1 and null ids are left out. Of an id
    on several rows of ``docs`` the least text is read, so that the sample is one row an id. An id without a row has
    none. The ids are broadcast: they are at most ``rows``."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    if learn_from is not None:
        known = known.where(learn_from(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    found = texts.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min("t").alias("t"))
    return found.select(F.xxhash64(F.lit(11), "id").alias("h"), "id", "y", "t")


def fit_frame(sample: DataFrame, dict_bytes: int = DICT_BYTES) -> CompressionClassifier:
    """``fit`` on the executors: one task trains the dictionaries from half of the ``labelled_sample``; the other half is
    compressed where it is. The driver sees two dictionaries and, for each row of that half, two numbers."""
    # a process is started for each local file that is written, and until it runs, the executor's memory counts twice
    sample = written(sample.withColumn("half", F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(2))).coalesce(FILES), "sample")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: tuple[list, list] = ([], [])
        for batch in batches:
            for start in range(0, batch.num_rows, PART):
                part = batch.slice(start, PART)
                for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    texts[y].append(_bytes(t))
        made = [dictionary(texts[label], dict_bytes) for label in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(made, pa.binary())], names=["y", "dictionary"])

    one = sample.where("half = 0").repartition(1).sortWithinPartitions("h", "id").select("y", "t")
    found = {r.y: bytes(r.dictionary) for r in one.mapInArrow(lean(train), "y int, dictionary binary").collect()}
    model = CompressionClassifier(*(found.get(label) or dictionary([]) for label in (1, 0)))  # no row, no task

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PART):
                part = batch.slice(start, PART)
                d = model.differences([_bytes(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(d, pa.float64())], names=["y", "d"])

    held = sample.where("half = 1").select("y", "t").mapInArrow(lean(compress), "y int, d double").toArrow()
    forget(sample)
    y, d = held.column("y").to_numpy(), held.column("d").to_numpy()
    order = np.lexsort((y, d))  # sums do not depend on the partitioning
    model.weights = calibrated(d[order], y[order])
    return model


def score_quality(docs: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row: how likely label 1 is for the whole text, 0 to 1. Null counts as empty; an empty text has
    a score like any other; repeated rows score alike, each by itself. Other columns are ignored; an empty table gives an
    empty result. Compressors are made once for ``PART`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PART):
                part = batch.slice(start, PART)
                score = model.score([_bytes(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], names=["id", "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(lean(run), f"id {kind}, score double").withColumnRenamed("id", id_col)
