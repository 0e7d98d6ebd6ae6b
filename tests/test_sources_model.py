import gzip
import io
import itertools
import tarfile
import zipfile

import numpy as np
from pyspark.sql import functions as F

from spanforge.model.labels import log_softmax, spans_of, transitions, viterbi
from spanforge.model.scan import ByteClassModel, scan_windows
from spanforge.operators.windows import slice_of, windows
from spanforge.sinks.reports import artifact_uri, fingerprints, json_lines, sarif_document
from spanforge.sources.archives import Limits, expand_archive, expand_archives, member_name
from spanforge.sources.files import added_lines, in_memory, read_files, select_inputs
from spanforge.streaming.chunks import _runs, chunks, runs_of_stream


def zipped(items, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for n, b in items:
            z.writestr(n, b)
    return out.getvalue()


def tarred(items):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n, b in items:
            i = tarfile.TarInfo(n)
            i.size = len(b)
            t.addfile(i, io.BytesIO(b))
    return out.getvalue()


def test_archives(spark):
    inner = zipped([("a.txt", b"alpha"), ("d/", b"")])
    nested = tarred([("x/in.zip", inner), ("long/" * 40 + "b.txt", b"beta")])
    data = gzip.compress(nested[:700]) + gzip.compress(nested[700:])
    got = dict((n, c) for n, c, w in expand_archive("p.tgz", data) if w is None)
    assert got == {"p.tgz!/p.tar!/x/in.zip!/a.txt": b"alpha", "p.tgz!/p.tar!/" + "long/" * 40 + "b.txt": b"beta"}
    bomb = zipped([("z", b"\0" * 5_000_000)])
    assert [w for *_, w in expand_archive("b.zip", bomb, Limits(ratio=10, slack=1000))] == ["over the budget"]
    assert expand_archive("t.zip", inner, wanted=lambda n: n.endswith(".py")) == []
    assert [w for *_, w in expand_archive("d.zip", zipped([("i.zip", inner)]), Limits(depth=1))] == ["nested too deeply"]
    assert expand_archive("plain", b"text") == [("plain", b"text", None)]
    assert len(member_name("o", "x" * 9000).encode()) < 4200
    rows = expand_archives(in_memory(spark, [("p.tgz", data), ("plain", b"text"), ("bad.zip", b"PK\3\4" + b"\0" * 30)])).collect()
    assert {(r.path, r.failure) for r in rows if r.failure} == {("bad.zip", "no end of central directory")} and len(rows) == 4


def test_files(spark, tmp_path):
    (tmp_path / "sub" / "vendor").mkdir(parents=True)
    for n, b in (("a.py", b"x"), ("sub/b.py", b"y" * 90), ("sub/empty.py", b""), ("sub/vendor/c.py", b"z"), ("pic.bin", b"q")):
        (tmp_path / n).write_bytes(b)
    docs, failures = select_inputs(read_files(spark, str(tmp_path)), 50, source_text_only=True)
    assert [r.path.rsplit("/", 1)[1] for r in docs.collect()] == ["a.py"]
    assert [r.file.rsplit("/", 1)[1] for r in failures.collect()] == ["b.py"]
    patch = "+++ b/f.py\n@@ -1,2 +3,4 @@\n@@ -9 +12 @@ def\n@@ -20,2 +20,0 @@\nBinary files a/i and b/i differ"
    assert sorted(map(tuple, added_lines(spark, patch).collect())) == [("f.py", 3, 6), ("f.py", 12, 12), ("i", 1, 1 << 40)]


def test_viterbi_equals_exhaustive():
    r = np.random.default_rng(1)
    logp = log_softmax(r.normal(size=(6, 5, 5)) * 3)
    first, pair, last = transitions(1)
    for i, path in enumerate(viterbi(logp, 1)):
        cost = lambda p: first[p[0]] + last[p[-1]] + sum(logp[i, t, x] for t, x in enumerate(p)) + sum(pair[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert abs(cost(path) - max(map(cost, itertools.product(range(5), repeat=5)))) < 1e-9
    assert spans_of(np.array([1, 2, 3, 0, 4]), np.zeros((5, 5)), 1) == [(0, 3, 0, 1.0), (4, 5, 0, 1.0)]


def test_scan_equals_regex(spark):
    text = "Ab1 " * 50 + "Zz9"
    d = spark.createDataFrame([(1, text), (2, "x"), (3, "")], "doc_id bigint, s string")
    w = windows(d, F.length("s"), 64, 48, 1).withColumn("content", F.encode(slice_of(F.col("s"), F.col("start"), F.col("length")), "ISO-8859-1"))
    for parts in (1, 5):
        got = {(r.doc_id, r.start, r.type) for r in scan_windows(w.repartition(parts), ByteClassModel((b"AZ", b"0123456789"))).collect()}
        assert got == {(1, i, "AZ".find(c) < 0) for i, c in enumerate(text) if c in "AZ0123456789"}


def test_reports(spark):
    rows = [("a b/ü.py", "K", "error", 1, 2, 1, "s***t"), ("a b/ü.py", "K", "error", 3, 1, 3, "s***t")]
    d = fingerprints(spark.createDataFrame(rows, "file string, kind string, severity string, line int, col int, end_line int, masked string"), ["line"])
    marks = [r.fingerprint for r in d.orderBy("line").collect()]
    assert marks[0][:24] == marks[1][:24] and [m[24:] for m in marks] == ["/0", "/1"]
    assert '"uri": "a%20b/%C3%BC.py"' in sarif_document(d)
    assert d.select(artifact_uri(F.lit("C:\\x y")).alias("u")).first().u == "file:///C:/x%20y"
    lines = json_lines(d, spark.createDataFrame([("f", "too large")], "file string, reason string")).collect()
    assert len(lines) == 3 and lines[-1].value == '{"file":"f","not_scanned":"too large"}'


def test_stream_equals_one_pass(spark, tmp_path):
    body = b"aa11a222" * 9 + b"33"
    docs = spark.createDataFrame([(1, bytearray(body)), (2, bytearray(b"x")), (3, bytearray(b""))], "doc_id bigint, content binary")
    parts = chunks(docs, 5)
    assert b"".join(bytes(r.content) for r in parts.where("doc_id = 1").orderBy("seq").collect()) == body
    source = str(tmp_path / "in")
    for seq in range(3):
        piece = parts.where(F.floor(F.col("seq") / 6) == seq)
        piece.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = runs_of_stream(stream, b"0123456789").writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.start, r.end) for r in spark.table("runs").where("doc_id = 1").collect())
    found, open_ = _runs(body, frozenset(b"0123456789"), 0, -1)
    assert got == sorted([*found, (open_, len(body))])
