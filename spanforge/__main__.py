"""Command line: ``python -m spanforge COMMAND ...`` runs scans, decisions, redactions and restorations on Spark."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import PROFILES, Detector, Request
from .functions.bytestr import byte_string, to_bytes
from .functions.values import excluded
from .model import catalog as C
from .model.network import Network
from .model.run import Options, scan_documents
from .operators import redact as R
from .sinks import reports as S
from .sources import findings as X
from .sources import walk as W
from .sources.archives import expand_archives
from .sources.files import added_lines, in_memory, on_added_lines, staged, working_changes


def percentile(values: list[float], p: float) -> float:
    """The value at the place p * n of the sorted ones, the last at most."""
    ordered = sorted(values)
    return ordered[min(len(ordered) - 1, int(p * len(ordered)))]


def session() -> SparkSession:
    spark = SparkSession.builder.appName("spanforge").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            import tempfile

            if not spark.sparkContext.master.startswith("local"):
                raise SystemExit("spark.checkpoint.dir must name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="spanforge-")
        spark.sparkContext.setCheckpointDir(found)
    return spark


def model_bytes(spark: SparkSession, spec: str, catalog: str | None, folder: str) -> bytes:
    """A model by its file, or by its name in a catalog with its file in ``folder``, checked by size and hash."""
    if not C.looks_like_path(spec):
        if not catalog:
            raise SystemExit(f"{spec} is a name, and no --catalog is given")
        entry = C.find(C.read_catalog(spark, catalog), spec, "3.0")
        state = C.verified(entry, spark.read.format("binaryFile").load(folder)).collect()
        if not state or any(r.state != "ok" for r in state):
            raise SystemExit(f"{spec}: " + (", ".join(f"{r.file} {r.state}" for r in state) or "unknown"))
        spec = os.path.join(folder, state[0].file)
    with open(spec, "rb") as f:
        return f.read()


def detector(spark: SparkSession, a) -> tuple[Detector, Request]:
    d = Detector([model_bytes(spark, m, a.catalog, a.models) for m in a.model], a.profile)
    bias = tuple(C.type_bias(a.type_bias, d.networks[0].entities, [0.0] * len(d.networks[0].entities))) if a.type_bias else None
    options = Options(prefilter=a.prefilter, bias=bias, queries=tuple(a.query))
    return d, Request(votes=a.votes, min_confidence=a.min_confidence, window=a.window, stride=a.stride, reveal=a.reveal, options=options)


def inputs(spark: SparkSession, a, d: Detector) -> tuple[DataFrame, DataFrame]:
    """((doc_id, file, path, content), failures) of the paths, of standard input for ``-``, or of what git has staged;
    archives are expanded."""
    limit = PROFILES[d.profile]
    if getattr(a, "staged", False):
        files, failures = staged(spark, a.paths[0] if a.paths else ".", limit)
        files = files.withColumn("rule", F.col("path"))
    elif a.paths == ["-"]:
        files, failures = W.standard_input(spark, limit)
        files = files.withColumn("rule", F.col("path"))
    else:
        listed, failures = W.walk(spark, a.paths, limit, keeps_folder=lambda p: p.split("/")[-1] != ".git")
        files = W.read_listed(listed)
    keep = d.wants_file(F.substring_index("rule", "/", -1)) & d.wants_folder(F.col("rule")) & ~excluded(F.col("rule"), a.exclude)
    files = files.where(keep)
    members = expand_archives(files).select(F.col("path").alias("file"), "content", "failure", F.col("file").alias("_path"))
    rules = files.select(F.col("path").alias("_path"), F.col("rule").alias("path")).distinct()
    failures = failures.union(members.where("failure IS NOT NULL").select("file", F.col("failure").alias("reason")))
    docs = members.where("failure IS NULL").join(rules, "_path").select(F.xxhash64("file").alias("doc_id"), "file", "path", "content")
    return docs, failures


def write(lines: DataFrame, to: str | None) -> None:
    """One line a row: to a folder of text files, or to standard output."""
    if to:
        lines.select("value").write.mode("errorifexists").text(to)
        return
    for r in lines.toLocalIterator():
        print(r.value)


def scan(spark, a) -> int:
    d, request = detector(spark, a)
    docs, failures = inputs(spark, a, d)
    found = d.detect(docs, request)
    findings = found.findings
    if a.tests == "no":
        findings = findings.where("severity <> 'warning'")
    if a.diff:
        patch = working_changes(a.paths[0] if a.paths and os.path.isdir(a.paths[0]) else ".", a.diff)
        findings = on_added_lines(findings.withColumn("end_line", F.coalesce("end_line", "line")), added_lines(spark, patch))
    found.findings, found.failures = findings.checkpoint(), found.failures.union(failures)
    if a.format == "jsonl":
        write(S.detection_lines(found), a.output)
    elif a.format == "sarif":
        marked = S.fingerprints(found.findings.withColumn("masked", F.col("snippet_masked")), ["start"]).withColumn("end_line", F.coalesce("end_line", "line")).withColumn("col", F.col("column"))
        write(spark.createDataFrame([(S.sarif_document(marked),)], "value string"), a.output)
    else:
        write(S.scan_report(found, found.failures, d.profile, len(d.models), request.votes), a.output)
    return S.exit_status(found.findings, found.failures, a.strict)


def decide(spark, a) -> int:
    d, request = detector(spark, a)
    docs, failures = inputs(spark, a, d)
    out = d.decide(docs, request).join(docs.select("doc_id", "file"), "doc_id")
    write(out.select(F.to_json(F.struct("file", "positive")).alias("value")), a.output)
    return 2 if failures.limit(1).count() else int(out.where("positive").limit(1).count() > 0)


def redact(spark, a) -> int:
    """Copies, reports and maps go to --output as ``NAME.redacted``, ``NAME.report.json`` and ``NAME.map.json``."""
    if a.spans:
        with open(a.paths[0], "rb") as f, open(a.spans) as s:
            docs = in_memory(spark, [(a.paths[0], f.read())]).select(F.lit(1).cast("bigint").alias("doc_id"), F.col("path").alias("file"), F.decode("content", "ISO-8859-1").alias("s"))
            spans, bad = X.read_spans(spark.createDataFrame([(1, s.read())], "doc_id bigint, body string"))
        if why := bad.first():
            raise SystemExit(why.reason)
        done = R.redact(docs, spans).withColumn("content", to_bytes(F.col("out"))).withColumn("refused", F.lit(None).cast("string"))
        names = docs.select("doc_id", "file")
    else:
        d, request = detector(spark, a)
        docs, _ = inputs(spark, a, d)
        done, names = d.redact(docs, request, a.types), docs.select("doc_id", "file")
    done = done.checkpoint()
    good = done.where("refused IS NULL")
    report = R.report(good).select("doc_id", F.encode(F.to_json(F.struct("*")), "UTF-8").alias("content"), F.lit(".report.json").alias("end"))
    maps = R.restore_map(good).select("doc_id", F.encode("map", "UTF-8").alias("content"), F.lit(".map.json").alias("end"))
    files = good.select("doc_id", "content", F.lit(".redacted").alias("end")).union(report).union(maps).join(names, "doc_id")
    name = F.concat(F.regexp_replace(F.regexp_replace("file", r"^(\.?\.?/)+", ""), "[^A-Za-z0-9._/\\-]", "_"), "end")
    state = S.write_private(files.select(name.alias("name"), "content"), os.path.abspath(a.output)).checkpoint()
    for r in state.where("NOT written").toLocalIterator():
        print(f"{r.name}: {r.reason}", file=sys.stderr)
    return 2 if state.where("NOT written").limit(1).count() or done.where("refused IS NOT NULL").limit(1).count() else 0


def restore(spark, a) -> int:
    with open(a.paths[0], "rb") as f, open(a.map) as m:
        copies = spark.createDataFrame([(1, bytearray(f.read()), m.read())], "doc_id int, content binary, map string")
    d = copies.select("doc_id", F.decode("content", "ISO-8859-1").alias("out"), "map")
    r = R.restore(d, d.select("doc_id", "map")).select(to_bytes(F.col("s")).alias("content"), "refused").first()
    if r.refused:
        print(f"the map does not fit: {r.refused}", file=sys.stderr)
        return 2
    sys.stdout.buffer.write(bytes(r.content)) if not a.output else open(a.output, "xb").write(bytes(r.content))
    return 0


def info(spark, a) -> int:
    for m in a.model:
        print(json.dumps(Network(model_bytes(spark, m, a.catalog, a.models)).describe()))
    return 0


def verify(spark, a) -> int:
    state = C.verified(C.read_catalog(spark, a.catalog), spark.read.format("binaryFile").load(a.models)).orderBy("name", "version", "file").collect()
    for r in state:
        print(r.name, r.version, r.file, r.state)
    return int(any(r.state not in ("ok", "missing") for r in state))


def bench(spark, a) -> int:
    """Seconds of a scan at each size, and the throughput over the largest."""
    model, out = model_bytes(spark, a.model[0], a.catalog, a.models), {}
    for size in map(int, a.sizes.split(",")):
        d = spark.createDataFrame([(1, "x" * size)], "doc_id int, t string").select("doc_id", byte_string(F.col("t")).alias("s"))
        took = []
        for _ in range(a.repeats):
            began = time.perf_counter()
            scan_documents(d, model).count()
            took.append(time.perf_counter() - began)
        out[size] = {"p50_ms": round(1000 * percentile(took, 0.5), 2), "p95_ms": round(1000 * percentile(took, 0.95), 2), "kb_per_s": round(size / 1024 / percentile(took, 0.5), 1)}
    print(json.dumps(out))
    return 0


COMMANDS = {"scan": scan, "decide": decide, "redact": redact, "restore": restore, "info": info, "verify": verify, "bench": bench}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanforge", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("paths", nargs="*", help="files and folders; - is standard input")
    p.add_argument("--model", action="append", default=[], help="a file or a name of the catalog; several vote")
    p.add_argument("--catalog")
    p.add_argument("--models", default="models", help="the folder of the catalog's files")
    p.add_argument("--profile", choices=PROFILES)
    p.add_argument("--format", choices=("jsonl", "json", "sarif"), default="jsonl")
    p.add_argument("--output")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--staged", action="store_true")
    p.add_argument("--diff", help="only findings on lines that are new against this git revision")
    p.add_argument("--tests", choices=("yes", "no"), default="yes")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--reveal", action="store_true")
    p.add_argument("--votes", type=int, default=0)
    p.add_argument("--min-confidence", type=float, default=0.0)
    p.add_argument("--window", type=int)
    p.add_argument("--stride", type=int)
    p.add_argument("--prefilter")
    p.add_argument("--type-bias", default="")
    p.add_argument("--query", action="append", default=[])
    p.add_argument("--types")
    p.add_argument("--spans")
    p.add_argument("--map")
    p.add_argument("--sizes", default="64,1024")
    p.add_argument("--repeats", type=int, default=5)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return COMMANDS[a.command](session(), a)


if __name__ == "__main__":
    sys.exit(main())
