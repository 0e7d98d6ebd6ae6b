"""Exact deduplication by a 128-bit content hash, with bytes compared inside each hash group. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, written

#: Hashes of groups of two and more that are broadcast to pick the texts to compare; more are joined by a shuffle.
BROADCAST_GROUPS = 1_000_000


def content_hash(text: Column) -> Column:
    """128 bits of a text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def _shared_hashes(hashes: DataFrame) -> DataFrame:
    """Hashes (_h) that two rows or more have; a hint to broadcast them where they are few enough."""
    met = hashes.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    shared = written(met.where("_n > 1").select("_h"), "shared-hashes")
    return F.broadcast(shared) if shared.count() <= BROADCAST_GROUPS else shared


def _equal_texts(base: DataFrame, rows: DataFrame, best) -> DataFrame:
    """(_h, _sha, _keep, _size) of each text whose hash ``rows`` has more than once, from ``base`` (_id, _text).

    A hash that one row has stands for one text. The texts of all other hashes meet in an aggregate by (hash, text), so
    bytes are compared: a collision gives two groups. Copies merge before the shuffle, so a group of any size is one row
    a task, and texts without a partner do not move."""
    texts = base.select("_id", "_text", content_hash(F.col("_text")).alias("_h"))
    return (
        texts.join(_shared_hashes(rows), "_h", "left_semi")
        .groupBy("_h", "_text")
        .agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .select("_h", F.unhex(F.sha2("_text", 256)).alias("_sha"), "_keep", "_size")
    )


def mark_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min"
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. ``keep`` names the id that
    stays, ``min`` or ``max``.

    Rows are grouped by hash; bytes are compared in the groups of two and more, the only texts that are shuffled. Rows
    find their group by both digests; a hot digest is a skewed join, which AQE splits.

    Null ids: such rows count in group_size and never displace a row with an id; a group without any id has a null
    keep_id and all its rows are marked as kept. Rows repeated with the same id and text are one document: each gets the
    same answer. Other columns of ``docs`` are ignored, whatever their names. An empty table gives an empty result.
    """
    best = {"min": F.min, "max": F.max}[keep]
    base = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.col(text_col)).alias("_text"))
    rows = written(
        base.select("_id", content_hash(F.col("_text")).alias("_h"), F.unhex(F.sha2("_text", 256)).alias("_sha")), "hashes"
    )
    groups = _equal_texts(base, rows, best)
    found = rows.join(groups, ["_h", "_sha"], "left")
    alone = F.col("_size").isNull()
    return found.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min"
) -> DataFrame:
    """``docs`` with one row of each distinct text (as ``mark_exact_duplicates`` compares them): the one with the
    smallest or largest id; all its columns stay as they are.

    Rows go by their text, never by their id: an id on two different texts keeps both. A row without an id stays only
    where its text has no row with one. Of rows that are alike in text and id, one stays, by a hash of
    all its columns. Only rows whose hash is shared are shuffled, by (hash, text); each task has merged its copies before,
    so a group of any size is one row a task. An empty table stays empty.
    """
    columns, types = docs.columns, dict(docs.dtypes)
    cell = {c: F.col(f"`{c}`") for c in columns}
    row = F.struct(*[cell[c].alias(f"c{i}") for i, c in enumerate(columns)])
    d = docs.select(row.alias("_row"), cell[id_col].alias("_id"), ascii_lower(cell[text_col]).alias("_text"))
    d = d.withColumn("_h", content_hash(F.col("_text")))
    shared = _shared_hashes(d.select("_h"))
    alone = d.join(shared, "_h", "left_anti").select("_row")
    cells = [F.col(f"_row.c{i}") for i in range(len(columns))]
    tie = F.xxhash64(*[F.to_json(x) if "map<" in types[c] else x for c, x in zip(columns, cells)])
    has_id = F.col("_id").isNotNull()
    order = F.struct(has_id if keep == "max" else ~has_id, F.col("_id"), tie)
    best = {"min": F.min_by, "max": F.max_by}[keep]
    copies = d.join(shared, "_h", "left_semi").select("_h", "_text", "_row", order.alias("_order"))
    one = copies.groupBy("_h", "_text").agg(best("_row", "_order").alias("_row")).select("_row")
    return alone.union(one).select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(columns)])
