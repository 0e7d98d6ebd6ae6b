"""Steps whose cost must not grow faster than their input."""

import gzip
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge import api
from spanforge.model import labels
from spanforge.model.network import Network
from spanforge.model.run import _batches, _rows, run_streams, spans
from spanforge.operators import heads, intervals
from spanforge.operators import redact as R
from spanforge.operators.prefilter import mark_prefiltered
from spanforge.operators.windows import windows
from spanforge.plans import catalog, models, registry, scores  # noqa: F401
from spanforge.plans.models import flag_model
from spanforge.sources import archives
from spanforge.streaming.chunks import chunks


def some_bytes(n, seed):
    return bytes(np.random.default_rng(seed).choice(np.frombuffer(b"aB c9.", np.uint8), n))


def test_windows_of_many_sizes_share_few_batches():
    m = Network(flag_model())
    raw = [some_bytes(n, n) for n in range(1, 513, 2)]
    found, runs = [None] * len(raw), 0
    for places, data, sizes in _batches(m, raw, 64):
        runs += 1
        for i, r in zip(places, _rows(m.run(data, sizes=sizes), [0] * len(places), None)):
            found[i] = r
    assert runs <= 8
    for b, r in zip(raw, found):
        assert r == _rows(m.run(np.frombuffer(b, np.uint8)[None]), [0], None)[0]


@pytest.mark.parametrize("scale", [0.1, 1, 20])
def test_best_labels_that_may_follow_each_other_are_the_path(scale):
    r = np.random.default_rng(5)
    score = (r.normal(0, scale, (60, 40, 9))).astype(np.float32)
    score[::2, :, 0] += 4 * scale  # mostly O: no step by step
    score[::2, ::7, 4] += 9 * scale
    logp, sizes = labels.log_softmax(score), r.integers(1, 41, 60)
    path, clear = labels._alone(logp, 2, sizes)
    assert 0 < clear.sum() < 60
    every = labels.viterbi(logp, 2, None, sizes)
    assert np.array_equal(every, labels._stepwise(logp, 2, sizes))
    for i, n in enumerate(sizes):
        assert np.array_equal(every[i, :n], labels.viterbi(logp[i : i + 1, :n], 2)[0]) and not every[i, n:].any()


def test_streams_of_documents_run_together(spark):
    texts = [(i, some_bytes(n, i)) for i, n in enumerate([1, 63, 64, 65, 700, 128, 4000, 3, 640, 64])]
    d = spark.createDataFrame(texts, "doc_id bigint, content binary")
    got = spans(run_streams(chunks(d, 64), flag_model(stream=True)), ["C0", "C1"]).select("doc_id", "start", "type")
    want = {(i, at, "C0" if c == ord("B") else "C1") for i, b in texts for at, c in enumerate(b) if c in b"B9"}
    rows = got.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("ordered", [True, False])
def test_regions_of_classes_take_one_pass(spark, ordered, monkeypatch):
    """As ``byte_map_regions`` has them, in parts of few windows, and without a row for each run in a join."""
    monkeypatch.setattr(heads, "TAKEN", 100)
    texts = [(i, some_bytes(n, i) if i % 3 else b"a" * n) for i, n in enumerate([1, 20, 21, 16, 17, 0, 300, 5, 64, 40, 40, 7])]
    d = spark.createDataFrame(texts, "doc_id bigint, content binary").coalesce(1)
    wins = windows(d.withColumn("s", F.decode("content", "ISO-8859-1")), F.octet_length("content"), 20, 12, 1)
    wins = wins.select("doc_id", "win", "start", F.encode(F.substr("s", (F.col("start") + 1).cast("int"), F.col("length").cast("int")), "ISO-8859-1").alias("classes"))
    wins = wins if ordered else wins.orderBy(F.hash("doc_id", "win"))
    table = bytes({32: 0, 57: 2}.get(b, 1) for b in range(256))
    made = heads.class_regions(wins, table=table, without=0, ordered=ordered)
    want = {(i, m.start(), m.end(), 2 if m[0][0] == 57 else 1) for i, b in texts for m in re.finditer(b"9+|[^9 ]+", b)}
    got = [tuple(r) for r in made.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = made._jdf.queryExecution().toString()
    assert "Join" not in plan and ("Exchange" not in plan or not ordered)


def test_values_that_are_no_text_stay_apart(spark):
    """Two values that differ in a byte of a cut character alone, as they are cut by shifted spans, are two values."""
    body = "a,é b,я a,é b,я".encode()
    docs = spark.createDataFrame([(1, body.decode("latin-1"))], "doc_id bigint, s string")
    at = [i for i, b in enumerate(body) if b == ord(",")]
    rows = [(1, i, a, a + 2, "X", 0.5, "rules") for i, a in enumerate(at)]  # a comma and the first byte of a character
    made = R.markers(docs, spark.createDataFrame(rows, "doc_id bigint, ord bigint, start bigint, end bigint, type string, conf double, source string"))
    assert [r.marker for r in made.orderBy("start").collect()] == ["[X_1]", "[X_2]", "[X_1]", "[X_2]"]


@pytest.mark.parametrize("name", ["line_rule_score", "masking_f2", "masking_by_task", "masking_everything", "restore_roundtrip", "redact_callers_spans", "vote_members_count", "vote_by_overlap", "spans_of_callers"])
def test_texts_are_searched_once(spark, name):
    """Detectors read the texts in one scan, however often their spans count."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{40}, 0) AS") == 1


def test_votes_are_counted_without_pairs(spark):
    r = np.random.default_rng(3)
    rows = [(int(d), i, int(a), int(a + n), str(t), int(m)) for i, (d, a, n, t, m) in enumerate(zip(r.integers(0, 4, 300), r.integers(0, 60, 300), r.integers(0, 6, 300), r.choice(list("AB"), 300), r.integers(0, 4, 300)))]
    made = intervals.vote_counts(spark.createDataFrame(rows + rows[:20], "doc_id bigint, ord bigint, start bigint, end bigint, type string, member int"))
    want = {x: len({y[5] for y in rows if y[0] == x[0] and y[4] == x[4] and y[2] < x[3] and x[2] < y[3]}) for x in rows}
    assert sorted(map(tuple, made.collect())) == sorted((*x, n) for x, n in want.items() if n)
    assert "Join" not in made._jdf.queryExecution().toString()


def test_prefilter_tries_a_run_once(spark):
    """A text of runs that are a byte too short costs its length, not its length times theirs; a stretch that is printable
    throughout is a run and no array."""
    s = ("x" * 3999 + "\n") * 60
    d = spark.createDataFrame([(i, s, 0, len(s)) for i in range(16)], "doc_id bigint, s string, start bigint, length bigint")
    began = time.time()
    for rule in ("A4000", "D4000x4000"):
        made = mark_prefiltered(d, rule)
        assert all(r.skipped for r in made.collect()) and "_dense" not in made._jdf.queryExecution().toString()
    assert time.time() - began < 8


def test_decisions_make_no_views(spark, monkeypatch):
    """A decision needs no text beside each finding."""
    monkeypatch.setattr(api, "masked_views", None)
    docs = spark.createDataFrame([(1, "a", b"no"), (2, "b", b"4 and 5"), (3, "c", None)], "doc_id bigint, file string, content binary")
    made = api.Detector([flag_model((b"0123456789", b""))] * 2, "none").decide(docs, api.Request(votes=2))
    assert {tuple(r) for r in made.collect()} == {(1, False), (2, True), (3, False)}


def test_members_are_passed_on_in_parts(spark):
    """Neither a batch for each archive nor all members of a batch at once; archives are packed a few at a time."""
    body = bytes(20_000)
    packed = [gzip.compress(bytes([i % 7]) + body, mtime=0) for i in range(300)]
    whole = pa.RecordBatch.from_arrays([pa.array([f"{i}.gz" for i in range(300)]), pa.array(packed, pa.binary())], names=["path", "content"])
    made = list(archives._expanded(iter([whole]), None, lambda name: True))
    assert sum(b.num_rows for b in made) == 300 and 5 <= len(made) <= 30 and max(b.nbytes for b in made) < 2 * archives.PASSED
    assert "ArrowEvalPython" not in models.archives(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
