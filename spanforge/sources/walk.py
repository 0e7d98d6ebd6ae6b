"""Folders walked on the driver: names, sizes and paths; contents are read by the executors or not at all."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import in_memory

DEEPEST = 128
TOO_DEEP, TOO_LARGE = "the folder lies too deep", "larger than the limit"


def outside(path: str) -> bool:
    """Whether a path as it was given lies outside the project: absolute, or climbing out of the working folder."""
    plain = os.path.normpath(path.replace("\\", "/"))
    return plain.startswith("/") or bool(re.match("[A-Za-z]:", plain)) or plain.split("/")[0] == ".."


def rule_path(given: Column, relative: Column) -> Column:
    """The path that rules about folders see: of a root outside the project only its own last name counts."""
    plain = F.rtrim(F.replace(given, F.lit("\\"), F.lit("/")), F.lit("/"))
    away = plain.rlike(r"^(/|[A-Za-z]:)") | plain.rlike(r"^(\./)*\.\.(/|$)")
    root = F.when(away, F.substring_index(plain, "/", -1)).otherwise(plain)
    return F.when(F.length(relative) > 0, F.concat(root, F.lit("/"), relative)).otherwise(root)


def _entries(root: str, keeps_folder: Callable[[str], bool], deepest: int) -> Iterator[tuple[str, int | None, str | None]]:
    """(path below the root, size, failure): a folder's files by name, then its folders; links are not followed."""
    waiting = [("", 0)]
    while waiting:
        below, depth = waiting.pop()
        if depth > deepest:
            yield below, None, TOO_DEEP
            continue
        try:
            with os.scandir(os.path.join(root, below)) as found:
                items = sorted(found, key=lambda e: e.name)
        except OSError as e:
            yield below, None, e.strerror or "not readable"
            continue
        path = lambda e: f"{below}/{e.name}" if below else e.name  # noqa: B023, E731
        for e in items:
            if e.is_file(follow_symlinks=False):
                yield path(e), e.stat(follow_symlinks=False).st_size, None
        folders = [e for e in items if e.is_dir(follow_symlinks=False) and keeps_folder(path(e))]
        waiting += [(path(e), depth + 1) for e in reversed(folders)]


def walk(spark: SparkSession, roots: list[str], limit: int, keeps_file=lambda p: True, keeps_folder=lambda p: True, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame]:
    """(files, failures): (path, rule, length) of the files below each root, and (file, reason) of what is too deep, too
    large or not readable. Empty files are left out. The listing is the driver's; ``read_listed`` reads contents where
    the tasks are."""
    files, failures = [], []
    for given in roots:
        shown = given.replace("\\", "/").rstrip("/")
        start = os.path.basename(os.path.abspath(given)) if outside(given) else shown
        if os.path.isfile(given):
            found = [("", os.path.getsize(given), None)]
        else:
            found = _entries(given, keeps_folder, deepest)
        for below, size, why in found:
            path = f"{shown}/{below}" if below else shown
            if why is None and size > limit:
                why = TOO_LARGE
            if why:
                failures.append((path, why))
            elif size and keeps_file(below or start):
                files.append((path, f"{start}/{below}" if below else start, size))
    return spark.createDataFrame(files, "path string, rule string, length bigint"), spark.createDataFrame(failures, "file string, reason string")


def read_listed(files: DataFrame) -> DataFrame:
    """(path, rule, length, content) of listed files that every executor can open; one that is gone has null content."""

    def body(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):  # one file at a time, so that a task holds one
                part, content = batch.slice(at, 1), None
                try:
                    with open(part.column(0)[0].as_py(), "rb") as f:
                        content = f.read()
                except OSError:
                    pass
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([content], pa.binary())], names=["path", "rule", "length", "content"])

    return files.select("path", "rule", "length").mapInArrow(body, "path string, rule string, length bigint, content binary")


def standard_input(spark: SparkSession, limit: int, stream=None) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of standard input as one document named ``<stdin>``; no more than the limit is read."""
    data = (stream or sys.stdin.buffer).read(limit + 1)
    large = len(data) > limit
    failures = spark.createDataFrame([("<stdin>", TOO_LARGE)] if large else [], "file string, reason string")
    return in_memory(spark, [] if large or not data else [("<stdin>", data)]), failures


def find_program(name: str, path: str | None = None) -> str | None:
    """A program in the absolute folders of PATH only, never in the working folder."""
    for folder in (os.environ.get("PATH", "") if path is None else path).split(os.pathsep):
        full = os.path.join(folder, name)
        if os.path.isabs(folder) and os.path.isfile(full) and os.access(full, os.X_OK):
            return full
    return None
