"""Findings of other tools and caller's spans as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields that a report of each format has, as far as they are read.
FORMATS = {
    "findings": "findings array<struct<file:string,path:string,line:bigint,end_line:bigint>>, file string, path string, line bigint, end_line bigint",
    "gitleaks": "File string, StartLine bigint, EndLine bigint",
    "trufflehog": "SourceMetadata struct<Data:struct<Filesystem:struct<file:string,line:bigint>>>, Raw string",
    "flags": "f string, flags array<struct<l:bigint,n:bigint>>",
}


def read_report(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, line, lines, raw) of a report of JSON Lines or of JSON lists; ``raw`` only where the format has it."""
    if kind not in FORMATS:
        raise ValueError(f"unknown report: {kind}; known: {', '.join(FORMATS)}")
    whole = spark.read.schema(FORMATS[kind]).option("multiLine", kind == "gitleaks").json(path)
    none = F.lit(None).cast("string").alias("raw")
    slashes = lambda c: F.replace(c, F.lit("\\"), F.lit("/")).alias("file")
    if kind == "findings":
        one = F.when(F.col("line").isNotNull(), F.array(F.struct("file", "path", "line", "end_line")))
        d = whole.select(F.explode_outer(F.coalesce("findings", one)).alias("x")).where("x.line IS NOT NULL")
        lines = F.greatest(F.coalesce(F.col("x.end_line"), F.col("x.line")) - F.col("x.line") + 1, F.lit(1))
        return d.select(slashes(F.coalesce("x.file", "x.path")), F.col("x.line").alias("line"), lines.alias("lines"), none)
    if kind == "gitleaks":
        return whole.where("File IS NOT NULL").select(slashes(F.col("File")), F.col("StartLine").alias("line"), (F.col("EndLine") - F.col("StartLine") + 1).alias("lines"), none)
    if kind == "trufflehog":
        at = F.col("SourceMetadata.Data.Filesystem")
        return whole.where(at["file"].isNotNull()).select(slashes(at["file"]), F.coalesce(at["line"], F.lit(0)).alias("line"), F.lit(1).cast("bigint").alias("lines"), F.col("Raw").alias("raw"))
    d = whole.where("f IS NOT NULL").select("f", F.explode_outer("flags").alias("x")).where("x IS NOT NULL")
    return d.select(slashes(F.col("f")), F.col("x.l").alias("line"), F.coalesce("x.n", F.lit(1)).alias("lines"), none)


def first_line(report: DataFrame, lines: DataFrame) -> int:
    """Whether a report counts lines from 0 or from 1: the start of each raw value is looked for in ``lines`` (file, line
    from 1, text) on the line of that number and on the one after it; the more frequent wins, 1 on a tie."""
    start = F.left(F.trim(F.substring_index(F.coalesce("raw", F.lit("")), "\n", 1)), F.lit(20))
    r = report.where(F.length(start) > 0).select("file", F.col("line").alias("at"), start.alias("start"))
    met = r.join(lines, (r.file == lines.file) & (lines.line.between(r["at"], r["at"] + 1)) & F.contains(lines.text, r["start"]))
    best = met.groupBy(r.file, "at", "start").agg(F.min("line").alias("line"))
    votes = best.agg(F.count_if(F.col("line") == F.col("at")).alias("one"), F.count_if(F.col("line") > F.col("at")).alias("zero")).first()
    return 0 if votes.zero > votes.one else 1


def located_findings(report: DataFrame, regions: DataFrame | None = None, root: str = "data/") -> DataFrame:
    """``report`` at project paths: what stands before ``root`` in a path goes; a finding in a scanned region (name,
    file, line_offset) moves to the file it was cut from."""
    at = F.instr("file", F.lit(root))
    plain = F.when(at > 0, F.substr("file", at)).otherwise(F.regexp_replace("file", r"^[./]+", ""))
    if regions is None:
        return report.withColumn("file", plain)
    r = regions.select(F.col("name").alias("_name"), F.col("file").alias("_file"), "line_offset")
    d = report.withColumn("_name", F.substring_index("file", "/", -1)).join(r, "_name", "left")
    return d.withColumn("line", F.col("line") + F.coalesce("line_offset", F.lit(0))).withColumn("file", F.coalesce("_file", plain)).drop("_name", "_file", "line_offset")


def flagged_lines(report: DataFrame) -> DataFrame:
    """(file, line): each line that a finding covers, once."""
    return report.select("file", F.explode(F.sequence("line", F.col("line") + F.col("lines") - 1)).alias("line")).distinct()


ITEM = "start double, end double, type string, confidence double, source string"


def read_spans(texts: DataFrame, key: str = "doc_id", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(spans, refused) of JSON lists of spans, each ``[start, end, type, confidence?, source?]`` or an object with these
    names. A list with an item that has no numeric start and end and no type is refused as a whole."""
    items = texts.select(key, F.from_json(body, "array<string>").alias("items"))
    bad = items.where("items IS NULL").select(key, F.lit("no JSON list of spans").alias("reason"))
    each = items.where("items IS NOT NULL").select(key, F.posexplode_outer("items").alias("ord", "item")).where("ord IS NOT NULL")
    listed = F.from_json("item", "array<string>")
    number = lambda i: F.try_to_number(F.get("l", F.lit(i)), F.lit("999999999999999")).cast("double")
    each = each.withColumn("l", F.when(F.col("item").startswith("["), listed))
    of_list = F.struct(number(0).alias("start"), number(1).alias("end"), F.get("l", F.lit(2)).alias("type"), F.get("l", F.lit(3)).try_cast("double").alias("confidence"), F.get("l", F.lit(4)).alias("source"))
    each = each.withColumn("x", F.when(F.col("l").isNotNull(), of_list).otherwise(F.from_json("item", ITEM)))
    each = each.withColumn("ok", F.coalesce(F.col("x.start").isNotNull() & F.col("x.end").isNotNull() & F.col("x.type").isNotNull(), F.lit(False)))
    wrong = each.where(~F.col("ok")).select(key).distinct()
    bad = bad.union(wrong.select(key, F.lit("every span needs a numeric start and end and a type").alias("reason")))
    good = each.withColumn("ok", F.bool_and("ok").over(Window.partitionBy(key))).where("ok").select(
        key, F.col("ord").cast("bigint").alias("ord"), F.col("x.start").cast("bigint").alias("start"), F.col("x.end").cast("bigint").alias("end"), "x.type",
        F.coalesce("x.confidence", F.lit(1.0)).alias("conf"), F.coalesce("x.source", F.lit("")).alias("source"),
    )
    return good, bad
