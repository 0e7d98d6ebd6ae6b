"""Findings as JSON Lines, a report with totals, and SARIF."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def json_lines(results: DataFrame, failures: DataFrame) -> DataFrame:
    """(value): one JSON object for each input, or for each failure ``{"file", "not_scanned"}``."""
    bad = failures.select(F.to_json(F.struct("file", F.col("reason").alias("not_scanned"))).alias("value"))
    return results.select(F.to_json(F.struct("*")).alias("value")).union(bad)


def artifact_uri(path: Column) -> Column:
    """A path as a URI: '/' as separator, './' dropped, other characters percent-encoded; a drive gets ``file:///``."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    coded = F.array_join(F.transform(F.split(p, "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/")
    return F.when(p.rlike("^[A-Za-z]:/"), F.concat(F.lit("file:///"), F.regexp_replace(coded, "^([A-Za-z])%3A", "$1:"))).otherwise(coded)


def fingerprints(findings: DataFrame, order: list[str]) -> DataFrame:
    """``findings`` (file, masked, ...) with ``fingerprint``: hash of URI and masked text, and the occurrence."""
    uri = artifact_uri(F.col("file"))
    n = F.row_number().over(Window.partitionBy("file", "masked").orderBy(*order)) - 1
    mark = F.left(F.sha2(F.concat(uri, F.lit("\n"), F.col("masked")), 256), F.lit(24))
    return findings.withColumn("fingerprint", F.concat(mark, F.lit("/"), n.cast("string")))


def totals(findings: DataFrame) -> DataFrame:
    """One row: findings, files with findings, errors and warnings."""
    return findings.agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_distinct("file").alias("files_with_findings"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


def exit_status(findings: DataFrame, failures: DataFrame, strict: bool = False) -> int:
    """2 if something was not scanned, 1 if there are errors (with ``strict`` warnings too), else 0."""
    if failures.limit(1).count():
        return 2
    bad = findings if strict else findings.where("severity = 'error'")
    return int(bad.limit(1).count() > 0)


def sarif_results(findings: DataFrame) -> DataFrame:
    """(value): one SARIF result object each of findings (file, kind, severity, line, col, end_line, masked, fingerprint)."""
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"), F.col("end_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(artifact_uri(F.col("file")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    body = F.struct(
        F.col("kind").alias("ruleId"),
        F.col("severity").alias("level"),
        F.struct(F.concat("kind", F.lit(": "), "masked").alias("text")).alias("message"),
        F.array(place).alias("locations"),
        F.struct(F.col("fingerprint").alias("spanforge/v1")).alias("partialFingerprints"),
    )
    return findings.select(F.to_json(body).alias("value"))


def sarif_document(findings: DataFrame, version: str = "0", most: int = 100_000) -> str:
    """A whole SARIF file on the driver. One of more than ``most`` results is refused, not cut: ``sarif_results`` has
    them as a DataFrame of any size."""
    rows = sarif_results(findings).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} results: write sarif_results instead")
    results = [json.loads(r.value) for r in rows]
    rules = list(dict.fromkeys(r["ruleId"] for r in results))
    driver = {"name": "spanforge", "version": version, "rules": [{"id": r} for r in rules]}
    return json.dumps({"version": "2.1.0", "$schema": SARIF_SCHEMA, "runs": [{"tool": {"driver": driver}, "results": results}]}, ensure_ascii=False)


def scan_report(found, failures: DataFrame, profile: str, models: int, votes: int) -> DataFrame:
    """(value): the whole report of a detection as one JSON object: profile, models, votes_needed, statistics, and the
    numbers of findings by severity and kind. What grows with the input stays in ``json_lines``."""
    sums = found.documents.agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "windows", "windows_skipped", "windows_exited", "positive_windows")],
    )
    kinds = found.findings.groupBy("kind").count().agg(F.array_sort(F.collect_list(F.struct("kind", "count"))).alias("kinds"))
    counts = totals(found.findings)
    bad = failures.agg(F.count(F.lit(1)).alias("failures"))
    one = sums
    for more in (counts, kinds, bad):
        one = one.join(F.broadcast(more))  # one row each
    head = [F.lit(profile).alias("profile"), F.lit(models).alias("models"), F.lit(votes).alias("votes_needed")]
    return one.select(F.to_json(F.struct(*head, F.struct(*one.columns).alias("stats"))).alias("value"))


def detection_lines(found) -> DataFrame:
    """(value): one JSON object for each document with its findings in order, and one for each failure."""
    own = [c for c in found.findings.columns if c not in ("doc_id", "file")]
    lists = found.findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", *[c for c in own if c not in ("start", "end")]))).alias("findings"))
    none = F.array().cast(lists.schema["findings"].dataType)
    d = found.documents.join(lists, "doc_id", "left").withColumn("findings", F.coalesce("findings", none))
    return json_lines(d.drop("doc_id"), found.failures)


def write_private(files: DataFrame, folder: str) -> DataFrame:
    """Writes (name, content) below a folder that all executors share and returns (name, written, reason).

    A file is made anew with access for its owner alone; an existing file or a link of that name is not followed and not
    replaced. A name that leads out of the folder is refused. Tasks that run again find their own file and say so."""
    import os

    import pyarrow as pa

    def put(name: str | None, body: bytes | None) -> str | None:
        parts = (name or "").split("/")
        if not name or os.path.isabs(name) or any(p in ("", ".", "..") for p in parts):
            return "not a name below the folder"
        at = os.path.join(folder, name)
        try:
            os.makedirs(os.path.dirname(at), mode=0o700, exist_ok=True)
            with os.fdopen(os.open(at, os.O_WRONLY | os.O_CREAT | os.O_EXCL | getattr(os, "O_NOFOLLOW", 0), 0o600), "wb") as f:
                f.write(body or b"")
        except FileExistsError:
            if not os.path.islink(at) and os.path.isfile(at):
                with open(at, "rb") as f:
                    return None if f.read() == (body or b"") else "a file of this name is there"
            return "a file of this name is there"
        except OSError as e:
            return e.strerror or "not writable"
        return None

    def run(batches):
        for batch in batches:
            names, bodies = (c.to_pylist() for c in batch.columns)
            why = [put(n, b) for n, b in zip(names, bodies)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w is None for w in why]), pa.array(why, pa.string())], names=["name", "written", "reason"])

    return files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, written boolean, reason string")
