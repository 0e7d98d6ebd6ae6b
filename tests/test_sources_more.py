"""Walks, standard input, reports of other tools, spans files, the model catalogue, evaluation by resampling."""

import bisect
import hashlib
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions.bytestr import byte_string, code_point_column
from spanforge.model import catalog as M
from spanforge.operators import evaluate as E
from spanforge.operators.windows import whole_windows
from spanforge.sources import findings as R
from spanforge.sources import walk as W
from spanforge.sources.files import added_lines, on_added_lines, staged, working_changes


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_walk(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "skip").mkdir()
    for name, body in (("z.py", b"12"), ("a/b.py", b"345"), ("a/deep/c.py", b"6"), ("a/empty.py", b""), ("a/big.py", b"x" * 50), ("skip/d.py", b"7")):
        (tmp_path / name).write_bytes(body)
    os.symlink(tmp_path / "z.py", tmp_path / "link.py")
    os.symlink(tmp_path / "a", tmp_path / "loop")
    root = str(tmp_path)
    files, failures = W.walk(spark, [root, root + "/z.py"], 10, keeps_folder=lambda p: p != "skip", deepest=1)
    name = tmp_path.name
    assert rows(files) == sorted([(f"{root}/z.py", f"{name}/z.py", 2), (f"{root}/a/b.py", f"{name}/a/b.py", 3), (f"{root}/z.py", "z.py", 2)], key=repr)
    assert rows(failures) == sorted([(f"{root}/a/big.py", W.TOO_LARGE), (f"{root}/a/deep", W.TOO_DEEP)], key=repr)
    got = {r.path: r.content for r in W.read_listed(files.union(spark.createDataFrame([("/gone", "gone", 1)], files.schema))).collect()}
    assert got == {f"{root}/z.py": b"12", f"{root}/a/b.py": b"345", "/gone": None}
    assert rows(W.walk(spark, [root + "/none"], 10)[1])[0][0].endswith("/none")
    shown = spark.createDataFrame([("src", "a/b"), ("/x/tests", "a"), ("../up/docs/", ""), ("./src/", "t"), ("C:\\y\\z", "q")], "given string, below string")
    assert [r.r for r in shown.select(W.rule_path(F.col("given"), F.col("below")).alias("r")).collect()] == ["src/a/b", "tests/a", "docs", "./src/t", "z/q"]
    assert [W.outside(p) for p in ("src", "/x", "..", "a/../../b", "C:/x", "./a")] == [False, True, True, True, True, False]


def test_standard_input_and_programs(spark, tmp_path):
    docs, failures = W.standard_input(spark, 5, io.BytesIO(b"12345"))
    assert [(r.path, r.content) for r in docs.collect()] == [("<stdin>", b"12345")] and failures.count() == 0
    docs, failures = W.standard_input(spark, 5, io.BytesIO(b"123456"))
    assert docs.count() == 0 and rows(failures) == [("<stdin>", W.TOO_LARGE)]
    tool = tmp_path / "tool"
    tool.write_text("x")
    tool.chmod(0o755)
    assert W.find_program("tool", f".:{tmp_path}") == str(tool) and W.find_program("tool", ".") is None


def test_reports(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    own = write("own.jsonl", '{"findings": [{"file": "x/data/a.py", "line": 3, "end_line": 5}, {"path": "b\\\\c.py", "line": 1}]}\n{"line": 7, "file": "data/d"}\n')
    assert rows(R.located_findings(R.read_report(spark, own, "findings"))) == sorted([("data/a.py", 3, 3, None), ("b/c.py", 1, 1, None), ("data/d", 7, 1, None)], key=repr)
    leaks = write("leaks.json", '[{"File": "./a", "StartLine": 2, "EndLine": 4}]')
    assert rows(R.flagged_lines(R.located_findings(R.read_report(spark, leaks, "gitleaks")))) == [("a", 2), ("a", 3), ("a", 4)]
    hog = write("hog.jsonl", "\n".join(json.dumps({"SourceMetadata": {"Data": {"Filesystem": {"file": "f", "line": n}}}, "Raw": raw}) for n, raw in ((0, "first"), (1, "second"), (2, "no"))) + '\n{"other": 1}\n')
    report = R.read_report(spark, hog, "trufflehog")
    lines = spark.createDataFrame([("f", 1, "a first b"), ("f", 2, "second"), ("f", 3, "zzz")], "file string, line bigint, text string")
    assert report.count() == 3 and R.first_line(report, lines) == 0
    assert R.first_line(report.withColumn("line", F.col("line") + 1), lines) == 1
    flags = write("flags.jsonl", '{"f": "r1.txt", "flags": [{"l": 2}, {"l": 5, "n": 2}]}\n')
    regions = spark.createDataFrame([("r1.txt", "data/q.py", 100)], "name string, file string, line_offset bigint")
    assert rows(R.located_findings(R.read_report(spark, flags, "flags"), regions).select("file", "line", "lines")) == [("data/q.py", 102, 1), ("data/q.py", 105, 2)]
    with pytest.raises(ValueError):
        R.read_report(spark, flags, "other")


def test_spans_files(spark):
    texts = spark.createDataFrame([(1, '[[0, 4, "A"], [5, 9, "B", 0.5, "rules"], {"start": 2, "end": 3, "type": "C", "confidence": 1}]'), (2, "[]"), (3, "{"), (4, '[[1, "x", "A"]]'), (5, None)], "doc_id int, body string")
    good, bad = R.read_spans(texts)
    assert rows(good) == [(1, 0, 0, 4, "A", 1.0, ""), (1, 1, 5, 9, "B", 0.5, "rules"), (1, 2, 2, 3, "C", 1.0, "")]
    assert sorted(r.doc_id for r in bad.collect()) == [3, 4, 5]


def test_model_catalogue(spark, tmp_path):
    digest = hashlib.sha256(b"model").hexdigest()
    entry = lambda n, v, r="", f="m.gguf", **k: {"name": n, "version": v, "min_runtime": r, "files": [{"role": "model", "file": f, "sha256": digest, "size": 5, **k}]}
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"schema": 1, "models": [entry("a", "1.9"), entry("a", "1.10"), entry("a", "2.0", "9.1", f="n.gguf"), entry("b", "1", "99", f="o.gguf", size=6), entry("", "1")]}))
    c = M.read_catalog(spark, str(path))
    best = lambda spec: [(r.version, r.runs) for r in M.find(c, spec, "3.2").collect()]
    assert (best("a"), best("a@1.9"), best("b"), best("none"), best("a@7")) == ([("1.10", True)], [("1.9", True)], [("1", False)], [], [])
    assert M.version_less("1.9", "1.10") and not M.version_less("1.0", "1") and M.version_less("1", "1.0.1")
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "m.gguf").write_bytes(b"model")
    (tmp_path / "files" / "o.gguf").write_bytes(b"model")
    files = spark.read.format("binaryFile").load(str(tmp_path / "files"))
    assert {(r.file, r.state) for r in M.verified(c, files).collect()} == {("m.gguf", "ok"), ("n.gguf", "missing"), ("o.gguf", "size")}
    path.write_text(json.dumps({"schema": 1, "models": [entry("a", "1", f="../m.gguf")]}))
    with pytest.raises(Exception, match="plain name"):
        M.read_catalog(spark, str(path)).collect()
    assert [M.looks_like_path(x) for x in ("m.gguf", "./m", "a/b", "pii", "pii@2")] == [True, True, True, False, False]
    assert M.type_bias("B=-2, A=0.5", ["A", "B", "C"], [1, 1, 1]) == [0.5, -2.0, 1]
    for wrong in ("D=1", "A", "A=inf"):
        with pytest.raises(ValueError):
            M.type_bias(wrong, ["A"], [0])


def f1_by_hand(counts):
    tp, fp, fn = (sum(c[i] for c in counts) for i in range(3))
    p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return 2 * p * r / (p + r) if p + r else 0.0


def test_resampling(spark):
    r = random.Random(3)
    make = lambda: {f"repo{i}": tuple(r.randint(0, 9) for _ in range(3)) for i in range(23)}
    a, b = make(), make()
    del b["repo5"]
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "repository string, tp bigint, fp bigint, fn bigint")
    g, names, f1s = random.Random(7), sorted(a), []
    for _ in range(200):
        f1s.append(f1_by_hand([a[names[g.randrange(len(names))]] for _ in names]))
    f1s.sort()
    assert E.bootstrap_f1(frame(a), 200) == pytest.approx([f1s[5], f1s[194]])
    g, diffs, none = random.Random(7), [], (0, 0, 0)
    for _ in range(200):
        drawn = [names[g.randrange(len(names))] for _ in names]
        diffs.append(f1_by_hand([b.get(n, none) for n in drawn]) - f1_by_hand([a[n] for n in drawn]))
    diffs.sort()
    got = E.paired_difference(frame(a), frame(b), 200)
    assert got[0] == pytest.approx(f1_by_hand(b.values()) - f1_by_hand(a.values())) and got[1] == pytest.approx([diffs[5], diffs[194]]) and got[2] == 23
    assert E.bootstrap_f1(frame({})) == [0.0, 0.0] and E.paired_difference(frame({}), frame({})) == (0.0, [0.0, 0.0], 0)
    positives = {k: v[0] for k, v in a.items()}
    order = sorted(positives, key=lambda n: (-positives[n], hashlib.sha256(f"7:{n}".encode()).hexdigest()))
    g, want = random.Random(7), {}
    for i in range(0, len(order), 2):
        pair = order[i : i + 2]
        g.shuffle(pair)
        want |= dict(zip(pair, ("dev", "test")))
    assert dict(rows(E.split_in_pairs(spark.createDataFrame(list(positives.items()), "repository string, positives bigint")))) == want


def test_per_repository(spark):
    units = [("f1", 1, 1, 3, True, "r1"), ("f1", 2, 5, 5, False, "r1"), ("f2", 3, 1, 1, True, "r2"), ("f2", 4, 1, 1, False, "r2"), ("f3", 5, 2, 2, False, "r3")]
    u = spark.createDataFrame(units, "file string, unit int, first bigint, last bigint, positive boolean, repository string")
    lines = spark.createDataFrame([("f1", 2), ("f1", 5), ("f2", 1), ("f9", 1)], "file string, line bigint")
    assert rows(E.per_repository(u, lines)) == [("r1", 1, 1, 0), ("r2", 1, 0, 0), ("r3", 0, 0, 0)]


def test_characters_and_columns(spark):
    text = "aé中😀b\nñ x"
    raw, cum = text.encode(), [0]
    for c in text:
        cum.append(cum[-1] + len(c.encode()))
    spans = [(a, z) for a in range(len(raw)) for z in range(a + 1, len(raw) + 1)]
    d = spark.createDataFrame([(a, z, text) for a, z in spans], "start bigint, end bigint, text string").withColumn("s", byte_string(F.col("text")))
    got = {(r.start, r.end): tuple(r.c) for r in d.select("start", "end", E.characters_of(F.col("s"), F.col("start"), F.col("end")).alias("c")).collect()}
    assert got == {(a, z): (bisect.bisect_right(cum, a) - 1, min(len(text), bisect.bisect_left(cum, z))) for a, z in spans}
    at = raw.index("x".encode())
    assert d.where("start = 0 AND end = 1").select(code_point_column(F.col("s"), F.lit(at)).alias("c")).first().c == 3


def test_masking_rates(spark):
    span = "task string, doc_id int, start bigint, end bigint"
    gold = spark.createDataFrame([("t", 1, 0, 4), ("t", 1, 2, 6)], span)
    texts = spark.createDataFrame([("t", 1, "x" * 10), ("u", 2, "y" * 5), ("u", 3, "")], "task string, doc_id int, text string")
    sizes = texts.groupBy("task").agg(F.sum(F.char_length("text")).alias("chars"))
    got = {r.task: r for r in E.masking_rates(gold, E.mask_everything(texts), sizes).collect()}
    assert (got["t"].precision, got["t"].recall, got["t"].fpr) == (0.6, 1.0, 1.0) and (got["u"].f1, got["u"].fpr) == (0.0, 1.0)
    mean = E.mean_of_tasks(E.masking_rates(gold, E.mask_everything(texts), sizes)).first()
    assert mean.tasks == 2 and mean.precision == pytest.approx(0.3)


def test_added_lines_and_whole_windows(spark):
    ranges = added_lines(spark, "+++ b/f\n@@ -1 +3,2 @@\n")
    found = spark.createDataFrame([("f", 1, 2), ("f", 1, 3), ("f", 4, 4), ("f", 5, 9), ("g", 3, 3)], "file string, line bigint, end_line bigint")
    assert rows(on_added_lines(found, ranges)) == [("f", 1, 3), ("f", 4, 4)]
    docs = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "doc_id int, s string")
    assert rows(whole_windows(docs, F.length("s")).select("doc_id", "win", "start", "length")) == [(1, 0, 0, 3)]


def test_git(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "old.txt").write_text("one\ntwo\n")
    git("add", ".")
    git("commit", "-qm", "first")
    (tmp_path / "old.txt").write_text("one\nnew\ntwo\n")
    for name, body in (("ä b.txt", b"staged\n\nbytes\0"), ("empty", b""), ("large", b"x" * 99)):
        (tmp_path / name).write_bytes(body)
    git("add", "ä b.txt", "empty", "large", "old.txt")
    (tmp_path / "old.txt").write_text("one\nnew\ntwo\nthree\n")  # not staged any more
    docs, failures = staged(spark, str(tmp_path), 50)
    assert {r.path: bytes(r.content) for r in docs.collect()} == {"ä b.txt": b"staged\n\nbytes\0", "old.txt": b"one\nnew\ntwo\n"}
    assert rows(failures) == [("large", "larger than the limit")]
    added = {r.file: (r.first, r.last) for r in added_lines(spark, working_changes(str(tmp_path), "HEAD")).where("file = 'old.txt'").collect()}
    assert added and set(rows(added_lines(spark, working_changes(str(tmp_path), "HEAD")).where("file = 'old.txt'"))) == {("old.txt", 2, 2), ("old.txt", 4, 4)}
    with pytest.raises(ValueError):
        working_changes(str(tmp_path), "--output=x")
