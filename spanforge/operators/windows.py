"""Sliding byte windows over documents, and which of them a prefilter keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def geometry(window: int, stride: int | None = None, least: int = 1) -> tuple[int, int, int]:
    """Window, stride (by default three quarters of the window) and least length; refuses what leaves gaps."""
    stride = window - window // 4 if stride is None else stride
    if window < 1 or not 0 < stride <= window or not 0 < least <= window:
        raise ValueError(f"geometry {window}/{stride}/{least}")
    return window, stride, least


def nominal_windows(n: Column, window: int, stride: int) -> Column:
    return F.when(n <= window, 1).otherwise(F.ceil((n - window) / stride) + 1).cast("bigint")


def windows(docs: DataFrame, size: Column, window: int, stride: int | None = None, least: int = 1) -> DataFrame:
    """``docs`` with win, start and length for each window.

    Starts are multiples of the stride; the last window is the first that reaches the end. Where it would be shorter
    than ``least``, a whole window at the end of the document replaces it. Documents shorter than ``least`` have none.
    Narrow: rows are only multiplied.
    """
    window, stride, least = geometry(window, stride, least)
    d = docs.withColumn("_size", size.cast("bigint")).where(F.col("_size") >= least)
    n = F.col("_size")
    d = d.withColumn("_count", nominal_windows(n, window, stride)).withColumn("win", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_count") - 1)))
    start = F.col("win") * stride
    tail = (F.col("win") == F.col("_count") - 1) & (n - start < least) & (F.col("win") > 0)
    start = F.when(tail, n - window).otherwise(start)
    return d.withColumn("start", start).withColumn("length", F.least(F.lit(window).cast("bigint"), n - F.col("start"))).drop("_size", "_count")


def whole_windows(docs: DataFrame, size: Column) -> DataFrame:
    """``docs`` with win, start and length: one window for each document that is not empty."""
    zero = F.lit(0).cast("bigint")
    return docs.withColumn("win", zero).withColumn("start", zero).withColumn("length", size.cast("bigint")).where("length > 0")


def slice_of(s: Column, start: Column, length: Column) -> Column:
    return F.substr(s, (start + 1).cast("int"), length.cast("int"))


def query_prefix(names: list[str], region: int) -> str:
    """The header that a query model reads before the document's bytes, filled up with line ends."""
    head = "".join(f"?{n}\n" for n in names)
    if len(head.encode()) > region:
        raise ValueError("the queries do not fit their region")
    return head.ljust(region, "\n")


def ngram_rows(codes: Column, at: Column, order: int, order_index: int, head: int, buckets: int) -> Column:
    """Row of a hashed n-gram table for the ``order`` bytes that end at 0-based position ``at`` of an array of codes."""
    m = 2**31 - 1
    v = F.lit((1000 * order_index + 7 + 7919 * head) % m).cast("bigint")
    for k in range(order - 1, -1, -1):
        c = F.when(at >= k, F.get(codes, at - k)).otherwise(0)
        v = (v * 257 + c + 1) % m
    return v % buckets
