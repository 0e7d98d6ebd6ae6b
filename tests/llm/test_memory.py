"""What Python workers hold between tasks, and how many files a sample has."""

import os
import random
import re

import public_tokenizers
import pyarrow as pa

from spanforge.llm import quality_classifier
from spanforge.llm.byte_bpe import encode_decode


def workers(spark):
    """MB of the workers' own memory by process; several jobs, because idle workers take turns."""

    def size(batches):
        for _ in batches:
            pass
        with open("/proc/self/status") as f:
            kb = int(re.search(r"RssAnon:\s+(\d+)", f.read())[1])
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([kb / 1024])], names=["pid", "mb"])

    return {r.pid: r.mb for _ in range(4) for r in spark.range(0, 2, 1, 2).mapInArrow(size, "pid bigint, mb double").collect()}


def table(spark, folder, rows, words):
    """Random words of which hardly any is there twice, in two files."""
    r, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyzäöü"
    text = lambda: " ".join("".join(r.choices(letters, k=9)) for _ in range(words))
    path = f"{folder}/{rows}"
    spark.createDataFrame([(i, text(), i % 2) for i in range(rows)], "doc_id bigint, text string, quality int").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def growth(spark, folder, work):
    """MB that the worker that grows most holds more after a larger table than after a small one."""
    small = table(spark, folder, 4, 4)
    for _ in range(4):
        work(small)
    before = workers(spark)
    work(table(spark, folder, 1200, 160))
    after = workers(spark)
    return max(after[p] - before[p] for p in before.keys() & after.keys())


def test_encoders_give_memory_back(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = lambda docs: encode_decode(docs, path, public_tokenizers.PATTERN, decoded_col="d").write.format("noop").mode("overwrite").save()
    assert growth(spark, tmp_path, coded) < 20


def test_sample_is_few_files(spark, tmp_path, monkeypatch):
    files = []
    monkeypatch.setattr(quality_classifier, "forget", lambda sample: files.extend(sample.inputFiles()))
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        docs = table(spark, tmp_path, 300, 3)
        quality_classifier.fit_frame(quality_classifier.labelled_sample(docs, docs, "quality", "doc_id", "text", 10_000))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert 0 < len(files) <= quality_classifier.FILES
