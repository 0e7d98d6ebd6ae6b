"""Models by name: a catalog of versions and files with their sizes and hashes, and options on a model's types."""

from __future__ import annotations

import math
import re
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "name string, version string, summary string, profile string, min_runtime string, files array<struct<role:string,file:string,url:string,sha256:string,size:bigint>>"
FILE_NAME = r"[A-Za-z0-9._\-]+\.gguf"


def looks_like_path(spec: str) -> bool:
    """A model given by its file rather than by its name."""
    return spec.endswith(".gguf") or spec.startswith(".") or "/" in spec or "\\" in spec


def version_key(version: str) -> list[int]:
    return [int(m[0]) if (m := re.match(r"\s*[+-]?\d+", x)) else 0 for x in version.split(".")]


def version_less(a: str, b: str) -> bool:
    """By the numbers between points; missing ones are 0."""
    for x, y in zip_longest(version_key(a), version_key(b), fillvalue=0):
        if x != y:
            return x < y
    return False


def version_order(version: Column, places: int = 8) -> Column:
    """An array that orders versions as ``version_less`` does, for up to ``places`` numbers."""
    numbers = F.transform(F.split(version, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), places)), 1, places)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a catalog file ``{"schema": 1, "models": [...]}``; another schema, or a file name that is no plain name,
    raises when it is read."""
    whole = spark.read.option("multiLine", True).schema(f"schema int, models array<struct<{re.sub('(^|, )([a-z_0-9]+) ', r'\1\2:', ENTRY)}>>").json(path)
    known = F.when(F.coalesce(F.col("schema"), F.lit(0)) == 1, F.col("models")).otherwise(F.raise_error(F.lit("the catalog has an unknown schema")))
    e = whole.select(F.explode_outer(known).alias("m")).where("m IS NOT NULL").select("m.*").where("name <> ''")
    plain = F.forall(F.coalesce("files", F.array().cast("array<struct<role:string,file:string,url:string,sha256:string,size:bigint>>")), lambda x: x["file"].rlike(f"^{FILE_NAME}$"))
    return e.withColumn("files", F.when(plain, F.col("files")).otherwise(F.raise_error(F.lit("a catalog file must be a plain name"))))


def newest(catalog: DataFrame, runtime: str) -> DataFrame:
    """Of each name the newest version that ``runtime`` can run, else the newest of all."""
    here = version_order(F.lit(runtime))
    runs = (F.coalesce("min_runtime", F.lit("")) == "") | (version_order(F.col("min_runtime")) <= here)
    rank = F.struct(runs.alias("runs"), version_order(F.col("version")).alias("order"), "version")
    best = catalog.groupBy("name").agg(F.max_by(F.struct(*catalog.columns, runs.alias("runs")), rank).alias("e"))
    return best.select("e.*")


def find(catalog: DataFrame, spec: str, runtime: str) -> DataFrame:
    """The entry for ``name`` or ``name@version``; no row for an unknown one."""
    name, _, version = spec.partition("@")
    own = catalog.where(F.col("name") == name)
    return own.where(F.col("version") == version).withColumn("runs", F.lit(True)).limit(1) if version else newest(own, runtime)


def verified(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(name, version, file, state): ``ok``, ``missing``, ``size`` or ``sha256`` of each catalog file against ``files``
    (path, length, content), as ``binaryFile`` reads a folder. Hashes are made where the files are read."""
    have = files.select(F.substring_index("path", "/", -1).alias("_file"), "length", F.sha2("content", 256).alias("hash"))
    want = entries.select("name", "version", F.explode("files").alias("f"))
    d = want.join(have, F.col("f.file") == F.col("_file"), "left")
    state = (
        F.when(F.col("hash").isNull(), "missing")
        .when((F.coalesce("f.size", F.lit(-1)) >= 0) & (F.col("f.size") != F.col("length")), "size")
        .when(F.lower("f.sha256") != F.col("hash"), "sha256")
        .otherwise("ok")
    )
    return d.select("name", "version", F.col("f.file").alias("file"), state.alias("state"))


def type_bias(spec: str, types: list[str], biases: list[float]) -> list[float]:
    """The biases of a model's types with those of ``TYPE=number,...`` put in; others stay."""
    out = list(biases)
    for item in filter(None, (x.strip() for x in spec.split(","))):
        name, equals, value = item.partition("=")
        if not equals or name not in types:
            raise ValueError(f"the model has no type for {item!r}; known: {', '.join(types)}")
        number = float(value)
        if not math.isfinite(number):
            raise ValueError(f"{item!r} is no finite number")
        out[types.index(name)] = number
    return out
