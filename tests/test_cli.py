"""The command line from end to end, private files and reports."""

import io
import json
import os
import stat
import sys

import pytest
from pyspark.sql import functions as F

from spanforge import __main__ as M
from spanforge.model.network import Network
from spanforge.sinks.reports import sarif_document, write_private

from test_network import flag_model

CAPITALS = flag_model(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@pytest.fixture
def place(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(M, "session", lambda: spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    (tmp_path / "m.gguf").write_bytes(CAPITALS)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ab Cd\nxY")
    (tmp_path / "in" / "b.txt").write_text("none")
    return tmp_path


def run(capsys, *argv):
    status = M.main([str(x) for x in argv])
    return status, capsys.readouterr().out


def test_scan_and_decide(place, capsys, monkeypatch):
    status, out = run(capsys, "scan", place / "in", "--model", place / "m.gguf", "--exclude", "c.*")
    lines = {os.path.basename(x["file"]): x for x in map(json.loads, out.splitlines())}
    assert status == 1 and [(f["start"], f["line"], f["column"], f["kind"]) for f in lines["a.txt"]["findings"]] == [(3, 1, 4, "FLAG"), (7, 2, 2, "FLAG")]
    assert lines["b.txt"]["findings"] == [] and "snippet" not in lines["a.txt"]["findings"][0]
    status, out = run(capsys, "scan", place / "in", "--model", place / "m.gguf", "--format", "json")
    stats = json.loads(out)["stats"]
    assert (stats["documents"], stats["findings"], stats["errors"], stats["failures"], stats["kinds"]) == (2, 2, 2, 0, [{"kind": "FLAG", "count": 2}])
    status, out = run(capsys, "scan", place / "in", "--model", place / "m.gguf", "--format", "sarif")
    assert len(json.loads(out)["runs"][0]["results"]) == 2
    status, out = run(capsys, "decide", place / "in", "--model", place / "m.gguf")
    assert status == 1 and {os.path.basename(x["file"]): x["positive"] for x in map(json.loads, out.splitlines())} == {"a.txt": True, "b.txt": False}
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(b"only Q")))
    status, out = run(capsys, "scan", "-", "--model", place / "m.gguf")
    assert status == 1 and json.loads(out)["file"] == "<stdin>"


def test_redact_and_restore(place, capsys):
    assert M.main(["redact", str(place / "in"), "--model", str(place / "m.gguf"), "--output", str(place / "out")]) == 0
    made = {str(p.relative_to(place / "out")).rsplit("/", 1)[1]: p for p in (place / "out").rglob("*") if p.is_file()}
    assert set(made) == {f"{x}.txt.{y}" for x in "ab" for y in ("redacted", "report.json", "map.json")}
    assert made["a.txt.redacted"].read_text() == "ab [FLAG_1]d\nx[FLAG_2]" and stat.S_IMODE(made["a.txt.redacted"].stat().st_mode) == 0o600
    assert M.main(["restore", str(made["a.txt.redacted"]), "--map", str(made["a.txt.map.json"]), "--output", str(place / "back")]) == 0
    assert (place / "back").read_text() == "ab Cd\nxY"
    assert M.main(["restore", str(made["a.txt.redacted"]), "--map", str(made["b.txt.map.json"])]) == 2
    (place / "spans.json").write_text('[[0, 2, "WORD"], [3, 5, "NAME"]]')
    assert M.main(["redact", str(place / "in" / "a.txt"), "--spans", str(place / "spans.json"), "--output", str(place / "own")]) == 0
    assert next((place / "own").rglob("*.redacted")).read_text() == "[WORD_1] [NAME_1]\nxY"


def test_info_verify_bench(place, capsys):
    import hashlib

    entry = {"name": "caps", "version": "1", "files": [{"role": "model", "file": "m.gguf", "sha256": hashlib.sha256(CAPITALS).hexdigest(), "size": len(CAPITALS)}]}
    (place / "c.json").write_text(json.dumps({"schema": 1, "models": [entry]}))
    assert run(capsys, "verify", "--catalog", place / "c.json", "--models", place) == (0, "caps 1 m.gguf ok\n")
    status, out = run(capsys, "info", "--model", "caps", "--catalog", place / "c.json", "--models", place)
    assert status == 0 and json.loads(out) == json.loads(json.dumps(Network(CAPITALS).describe()))
    status, out = run(capsys, "bench", "--model", place / "m.gguf", "--sizes", "64", "--repeats", "2")
    assert set(json.loads(out)["64"]) == {"p50_ms", "p95_ms", "kb_per_s"}
    assert M.percentile([3, 1, 2], 0.5) == 2 and M.percentile([3, 1, 2], 0.99) == 3
    with pytest.raises(SystemExit):
        M.model_bytes(M.session(), "nothing", str(place / "c.json"), str(place))


def test_private_files(spark, tmp_path):
    (tmp_path / "there").write_text("old")
    os.symlink(tmp_path / "there", tmp_path / "link")
    rows = [("a/b", b"1"), ("there", b"new"), ("link", b"x"), ("../out", b"x"), ("/abs", b"x"), ("", b"x"), (None, b"x"), ("c", None)]
    d = spark.createDataFrame([(n, None if b is None else bytearray(b)) for n, b in rows], "name string, content binary")
    got = {r.name: r.written for r in write_private(d, str(tmp_path)).collect()}
    assert got == {"a/b": True, "there": False, "link": False, "../out": False, "/abs": False, "": False, None: False, "c": True}
    assert (tmp_path / "there").read_text() == "old" and (tmp_path / "a" / "b").read_bytes() == b"1"
    assert {r.written for r in write_private(d.where("name IN ('a/b', 'c')"), str(tmp_path)).collect()} == {True}  # a task that runs again


def test_large_sarif_is_refused(spark):
    d = spark.range(3).select(F.lit("f").alias("file"), F.lit("K").alias("kind"), F.lit("error").alias("severity"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit(1).alias("end_line"), F.lit("m").alias("masked"), F.lit("p").alias("fingerprint"))
    with pytest.raises(ValueError):
        sarif_document(d, most=2)
