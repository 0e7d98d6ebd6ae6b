"""Spans for queries over the documents: a few simple detectors and shifted copies. They are inputs, not detectors to
rely on: the engine takes spans from rules, models or callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytestr import byte_string, located

#: type, expression that Java and RE2 read alike, confidence, source
DETECTORS = [
    ("EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[a-z]{2,}", 0.75, "rules"),
    ("IP", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0.5, "rules"),
    ("PHONE", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.625, "rules"),
    ("CREDIT_CARD", r"[0-9]{16}", 0.5, "rules"),
    ("SECRET", r"[0-9a-f]{40}", 0.875, "model"),
]
#: What every match of a detector holds.
NEEDS = {"EMAIL": "@", "IP": ".", "PHONE": "+1 ("}
#: How copies of the spans are changed: member, shift of start and end, type, confidence, source
COPIES = [(0, 0, 0, None, 0.0, None), (1, 3, 3, "CONTACT", 0.125, "model"), (2, -3, -1, None, -0.25, "model")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", byte_string(F.col("text")).alias("s"))


def _detected(docs: DataFrame) -> DataFrame:
    """``docs`` with ``found``: what all detectors find in the row."""
    own = docs.columns
    d = located(docs, [p for _, p, _, _ in DETECTORS], needs=[NEEDS.get(t) for t, _, _, _ in DETECTORS])

    def typed(i: int, t: str, c: float, source: str) -> Column:
        return F.transform(
            f"x{i}",
            lambda x: F.struct(
                x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.lit(t).alias("type"), F.lit(c).alias("conf"), F.lit(source).alias("source"),
                (x["ord"] + i * 1_000_000).alias("ord"),
            ),
        )

    return d.select(*own, F.concat(*[typed(i, t, c, source) for i, (t, _, c, source) in enumerate(DETECTORS)]).alias("found"))


def plain_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of the documents, start, end, value, type, conf, source, ord. One pass, no shuffle."""
    d = _detected(docs).select(*keep, F.explode_outer("found").alias("f"))
    return d.where("f IS NOT NULL").select(*keep, "f.*")


def spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of the documents, ord, start, end, type, conf, source, member, base64: with conflicts, ties and an ensemble of three. The
    copies are made in the document's row."""

    def copy(x: Column, m: int, a: int, z: int, t: str | None, c: float, source: str | None) -> Column:
        return F.struct(
            (x["ord"] + m * 100_000_000).alias("ord"),
            F.greatest(x["start"] + a, F.lit(0).cast("bigint")).alias("start"),
            (x["end"] + z).alias("end"),
            (F.lit(t) if t else x["type"]).alias("type"),
            (x["conf"] + c).alias("conf"),
            (F.lit(source) if source else x["source"]).alias("source"),
            F.lit(m).alias("member"),
            F.lit(m == 1).alias("base64"),
        )

    d = _detected(docs).select(*keep, F.length("s").alias("n"), "found")
    d = d.select(*keep, "n", F.explode_outer(F.flatten(F.transform("found", lambda x: F.array(*[copy(x, *how) for how in COPIES])))).alias("f"))
    return d.where("f IS NOT NULL AND f.end <= n").select(*keep, "f.*")


def matches_sql(name: str, pattern: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """The CTE of ``matches`` for DuckDB: offsets are bytes, as strlen counts them."""
    p = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT {key}, ord, m AS value, (sum(strlen(g) + coalesce(strlen(m), 0)) OVER (PARTITION BY {key} ORDER BY ord))::BIGINT AS "end",
         (sum(strlen(g) + coalesce(strlen(m), 0)) OVER (PARTITION BY {key} ORDER BY ord) - strlen(m))::BIGINT AS start
  FROM (SELECT {key}, unnest(range(len(g)))::BIGINT AS ord, unnest(g) AS g, unnest(list_resize(m, len(g))) AS m
        FROM (SELECT {key}, string_split_regex({text}, '{p}') AS g, regexp_extract_all({text}, '{p}') AS m FROM {table})))"""


def spans_sql() -> str:
    parts = [matches_sql(f"x{i}", p) for i, (_, p, _, _) in enumerate(DETECTORS)]
    base = " UNION ALL ".join(
        f"SELECT doc_id, start, \"end\", value, '{t}' AS type, {c}::DOUBLE AS conf, '{s}' AS source, {i * 1_000_000} + ord AS ord FROM x{i} WHERE value IS NOT NULL"
        for i, (t, _, c, s) in enumerate(DETECTORS)
    )
    copies = " UNION ALL ".join(
        f"SELECT doc_id, ord + {m * 100_000_000} AS ord, greatest(start + ({a}), 0) AS start, \"end\" + ({z}) AS \"end\", "
        + (f"'{t}'" if t else "type")
        + f" AS type, conf + ({c}) AS conf, "
        + (f"'{s}'" if s else "source")
        + f" AS source, {m} AS member, {str(m == 1).lower()} AS base64 FROM base"
        for m, a, z, t, c, s in COPIES
    )
    return ",\n".join([*parts, f"base AS ({base})", f"every AS ({copies})", 'spans AS (SELECT e.* FROM every e JOIN documents d USING (doc_id) WHERE e."end" <= strlen(d.text))'])


#: Every byte of every span, its best owner by rank: the painter that checks ``resolve`` (another way than its sweep).
PAINT = """
ok AS (SELECT * FROM spans WHERE start >= 0 AND start < "end"),
tt AS (SELECT doc_id, type, min(ord) AS tix FROM ok GROUP BY ALL),
u1 AS (SELECT *, max("end") OVER (PARTITION BY doc_id, type ORDER BY start, "end" DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ok),
u2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR start >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, type ORDER BY start, "end" DESC, ord ROWS UNBOUNDED PRECEDING) AS isl FROM u1),
un AS (SELECT doc_id, type, isl, min(start) AS start, max("end") AS "end", max(conf) AS conf, string_agg(DISTINCT source, '+' ORDER BY source) AS source FROM u2 GROUP BY ALL),
px AS (SELECT un.*, tt.tix, unnest(range(start, "end")) AS p FROM un JOIN tt USING (doc_id, type)),
pw AS (SELECT *, row_number() OVER (PARTITION BY doc_id, p ORDER BY (type IN ('CREDIT_CARD', 'DNI_NIE', 'EMAIL', 'IBAN', 'IP', 'URL_CREDENTIALS') AND contains(source, 'rules')) DESC, conf DESC, "end" - start DESC, tix, start) AS rn FROM px),
pp AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, type, isl ORDER BY p) AS g FROM pw WHERE rn = 1),
resolved AS (SELECT doc_id, type, min(p) AS start, max(p) + 1 AS "end", max(conf) AS conf, min(source) AS source FROM pp GROUP BY doc_id, type, isl, g)"""
