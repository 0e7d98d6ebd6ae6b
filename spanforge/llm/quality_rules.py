"""Quality rules: base counts and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Two multinomials over buckets of hashed n-grams (tokens and their neighbour pairs) are counted, one of trusted target
texts and one of the whole raw corpus. A text's ratio is the sum of log target over raw of its n-grams, divided by their
number; texts below a fixed threshold are not kept. There is no random draw: the same corpus gives the same verdicts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import constant_array, text_or_empty, words_of

BUCKETS = 1 << 16
#: Trusted ids that are broadcast to mark their texts; more are joined by a shuffle. All of them are counted either way.
BROADCAST_IDS = 1_000_000
#: Of the mean log ratio of a text's n-grams. Fixed, not fitted to a corpus; a test holds it against held-out labels.
THRESHOLD = -0.6
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+"


def _token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(TOKEN), 0), lambda t: F.xxhash64(t))


def _bucket(value: Column) -> Column:
    return F.pmod(value, F.lit(BUCKETS)).cast("int")


def _pair(h: Column, i: Column) -> Column:
    return _bucket(F.xxhash64(F.get(h, i), F.get(h, i + 1)))


def ratio_weights(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, smoothing: float = 1.0) -> list[float]:
    """log p(target) - log p(raw) of each bucket. ``trusted`` has a column ``id``; the texts of all its ids are counted as
    target and all texts as raw. The counts are at most ``BUCKETS`` rows."""
    ids = trusted.where("id IS NOT NULL").select("id").distinct()
    marks = ids.select("id", F.lit(1).alias("t"))
    marks = F.broadcast(marks) if ids.count() <= BROADCAST_IDS else marks
    # joined before they are hashed: where the join is a shuffle, the texts are smaller than their hashes
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, "id", "left")
    rows = rows.select("t", _token_hashes(F.col("text")).alias("h"))
    pairs = F.when(F.size("h") > 1, F.transform(F.sequence(F.lit(0), F.size("h") - 2), lambda i: _pair(F.col("h"), i)))
    grams = F.concat(F.transform("h", _bucket), F.coalesce(pairs, F.array().cast("array<int>")))
    counts = (
        rows.select(F.coalesce("t", F.lit(0)).alias("t"), F.explode_outer(grams).alias("b"))
        .where("b IS NOT NULL")
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
        .collect()
    )
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r.b], target[r.b] = r.raw, r.target
    if not sum(target):
        return [0.0] * BUCKETS
    of = lambda n, all_: math.log((n + smoothing) / (all_ + smoothing * BUCKETS))
    all_raw, all_target = sum(raw), sum(target)
    return [round(of(t, all_target) - of(r, all_raw), 6) for t, r in zip(target, raw)]


def _base(docs: DataFrame, id_col: str, text_col: str, weights: list[float]) -> DataFrame:
    """Columns are built up level by level, so that no lambda holds an expression that is evaluated again."""
    text = text_or_empty(F.col(text_col))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"), words_of(F.col(text_col)).alias("w"), lines.alias("lines"), _token_hashes(text).alias("h"))
    w, h = F.col("w"), F.col("h")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    table = constant_array(weights, "double")
    ratio = F.aggregate(
        F.sequence(F.lit(0), F.size(h) - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.get(table, _bucket(F.get(h, i))) + F.when(i > 0, F.get(table, _pair(h, i - 1))).otherwise(0.0),
    )
    d = d.select(
        "id",
        F.size(w).alias("n_words"),
        F.char_length(F.array_join(w, "")).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size(w) >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("x"),
        F.when(F.size(h) > 0, ratio / (2 * F.size(h) - 1)).otherwise(0.0).alias("ratio"),
    )
    counts = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "ratio"]
    placed = F.sort_array(F.transform("x", lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.select(*counts, F.when(F.size(F.array_distinct("x")) < F.size("x"), placed).otherwise(none).alias("s"))
    s = F.col("s")
    same = lambda v, k: F.coalesce(v["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(v["h"] == F.get(s, k + 1)["h"], F.lit(False))
    d = d.select(*counts, F.sort_array(F.transform(F.filter(s, same), lambda v: v["i"])).alias("at"))
    at = F.col("at")
    widths = F.transform(at, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - v, F.lit(3))))
    return d.select(*counts, F.aggregate(widths, F.lit(0), lambda acc, v: acc + v).alias("n_repeat_words"))


def quality_rules(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    ratio.

    base_failed: fewer than 50 words, or over half of the words in three-word windows that the text holds twice or more
    (windows are compared by 64-bit hashes). kept: not base_failed, and the ratio reaches ``threshold``. Null counts as
    empty, has no words and fails. Without trusted texts all ratios are 0, so that the base alone decides. Repeated rows
    are scored each by itself; other columns are ignored; an empty table gives an empty result.
    """
    weights = ratio_weights(docs, trusted, id_col, text_col)
    d = _base(docs, id_col, text_col, weights)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    whole = [F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return d.select(
        F.col("id").alias(id_col), *whole, failed.alias("base_failed"), (~failed & (F.col("ratio") >= threshold)).alias("kept"), "ratio"
    )
