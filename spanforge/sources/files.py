"""Documents from files, tables, bytes and git changes, with failures as rows."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import excluded, in_dependency_folder, is_source_text_name


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of all files below a folder. Filters on path and length reach the source, so contents of
    files that they drop are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def in_memory(spark: SparkSession, items: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame([(n, len(b), bytearray(b)) for n, b in items], "path string, length bigint, content binary")


def from_column(table: DataFrame, name: str, text: str) -> DataFrame:
    """A text column as documents."""
    body = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return table.select(F.col(name).cast("string").alias("path"), F.octet_length(body).cast("bigint").alias("length"), body.alias("content"))


def select_inputs(files: DataFrame, limit: int, exclude: list[str] = (), source_text_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, failures): empty files are skipped, excluded ones dropped, those over the limit are failures."""
    keep = ~excluded(F.col("path"), list(exclude))
    if source_text_only:
        keep &= is_source_text_name(F.element_at(F.split("path", "/"), -1)) & ~in_dependency_folder(F.col("path"))
    else:
        keep &= ~F.array_contains(F.split("path", "/"), ".git")
    wanted = files.where(keep)
    failures = wanted.where(F.col("length") > limit).select(F.col("path").alias("file"), F.lit("larger than the limit").alias("reason"))
    return wanted.where((F.col("length") > 0) & (F.col("length") <= limit)), failures


def added_lines(spark: SparkSession, patch: str) -> DataFrame:
    """file, first, last of the lines that a unified diff without context adds; a binary file's are all."""
    rows, file = [], None
    for x in patch.split("\n"):
        if x.startswith("+++ b/"):
            file = x[6:]
        elif x.startswith("Binary files ") and " and b/" in x:
            rows.append((x.split(" and b/")[1].removesuffix(" differ"), 1, 1 << 40))
        elif x.startswith("@@ ") and file:
            at, _, n = x.split("+")[1].split(" ")[0].partition(",")
            if (n or "1") != "0":
                rows.append((file, int(at), int(at) + int(n or 1) - 1))
    return spark.createDataFrame(rows, "file string, first bigint, last bigint")


def on_added_lines(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings (file, line, end_line, ...) that meet a range (file, first, last) of added lines. A patch's ranges are as
    many as its hunks; files with many are joined like any other key."""
    r = ranges.select(F.col("file").alias("_file"), "first", "last")
    meets = (F.col("file") == F.col("_file")) & (F.col("line") <= F.col("last")) & (F.col("first") <= F.col("end_line"))
    return findings.join(r, meets, "left_semi")


def staged(spark: SparkSession, repository: str, limit: int = 1 << 30) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of what is staged in a git repository on the driver; submodules and empty blobs are skipped,
    blobs over the limit are failures and are not read. Two processes, whatever the number of blobs."""

    def git(*a: str, given: bytes = b"") -> bytes:
        return subprocess.run(["git", "-C", repository, *a], input=given, capture_output=True, check=True).stdout

    parts = git("diff", "--raw", "-z", "--cached", "--diff-filter=ACMRT", "--no-renames").split(b"\0")
    blobs = []
    for meta, name in zip(parts[::2], parts[1::2]):
        _, mode, _, blob, _ = meta.decode().split(" ")
        if mode != "160000":
            blobs.append((blob, name.decode("utf-8", "replace")))
    asked = lambda some: "".join(f"{blob}\n" for blob, _ in some).encode()
    sizes = [int(line.rsplit(b" ", 1)[1]) for line in git("cat-file", "--batch-check", given=asked(blobs)).splitlines()]
    wanted = [b for b, size in zip(blobs, sizes) if 0 < size <= limit]
    large = [(name, "larger than the limit") for (_, name), size in zip(blobs, sizes) if size > limit]
    out, items, at = git("cat-file", "--batch", given=asked(wanted)), [], 0
    for _, name in wanted:  # "id type size", a line feed, the content, a line feed
        end = out.index(b"\n", at)
        size = int(out[at:end].rsplit(b" ", 1)[1])
        items.append((name, out[end + 1 : end + 1 + size]))
        at = end + size + 2
    return in_memory(spark, items), spark.createDataFrame(large, "file string, reason string")


def working_changes(repository: str, ref: str) -> str:
    """The patch without context of the working tree against ``ref``."""
    if ref.startswith("-"):
        raise ValueError("a ref may not start with '-'")
    return subprocess.run(["git", "-C", repository, "diff", "-U0", ref, "--"], capture_output=True, check=True, text=True).stdout
