"""Byte strings: one character for each byte (ISO-8859-1), so that string positions are byte offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_string(text: Column) -> Column:
    """The UTF-8 bytes of a string; null counts as empty."""
    return F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1")


def to_bytes(s: Column) -> Column:
    return F.encode(s, "ISO-8859-1")


def to_text(s: Column) -> Column:
    """UTF-8 text of a byte string; invalid sequences become U+FFFD."""
    return F.make_valid_utf8(to_bytes(s).cast("string"))


def base64_line(content: Column) -> Column:
    """Base64 without the line breaks that ``base64`` puts in after 76 characters."""
    return F.translate(F.base64(content), "\r\n", "")


#: Elements that a running sum takes together.
RUN = 64


def running_sums(d: DataFrame, lengths: list[str]) -> DataFrame:
    """``d`` with each named array of numbers replaced by its running sums, made in the row: sums inside runs of elements
    first, then over the runs, so that a long array costs little more than its length. Level by level, because what a
    lambda refers to more than once must be a column."""
    rest = [c for c in d.columns if c not in lengths]

    def level(make) -> None:
        nonlocal d
        d = d.select(*rest, *[make(F.col(c)).alias(c) for c in lengths])

    def sums(numbers: Column, value=lambda x: x) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("sums"), F.lit(0).cast("bigint").alias("at"))
        add = lambda acc, x: F.struct(F.concat(acc["sums"], F.array(acc["at"] + value(x))).alias("sums"), (acc["at"] + value(x)).alias("at"))
        return F.aggregate(numbers, start, add, lambda acc: acc["sums"])

    level(lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0)), F.lit(RUN)), lambda b: F.slice(c, b + 1, F.lit(RUN))))
    level(lambda c: F.transform(c, lambda run: sums(run)))
    level(lambda c: F.struct(c.alias("inside"), sums(c, lambda run: F.coalesce(F.try_element_at(run, F.lit(-1)), F.lit(0))).alias("upto")))
    level(lambda c: F.flatten(F.transform(c["inside"], lambda run, i: F.transform(run, lambda x: x + F.when(i > 0, F.get(c["upto"], i - 1)).otherwise(0)))))
    return d


def located(docs: DataFrame, patterns: list[str], s: str = "s", needs: list[str | None] | None = None) -> DataFrame:
    """``docs`` with x0, x1, ...: the matches of each pattern in the byte string column, in order, as an array of (ord,
    start, end, value). One pass over the rows, without a shuffle. ``needs``: text that each match of a pattern holds, so
    that rows without it are not searched; rows without a match are not split."""
    own, n = [F.col(c) for c in docs.columns], range(len(patterns))
    none = F.array().cast("array<string>")
    held = lambda i, c: F.when(F.contains(s, F.lit(needs[i])), c).when(F.col(s).isNotNull(), none) if needs and needs[i] else c
    d = docs.select(*own, *[held(i, F.regexp_extract_all(s, F.lit(p), 0)).alias(f"_m{i}") for i, p in enumerate(patterns)])
    d = d.select("*", *[F.when(F.size(f"_m{i}") > 0, F.split(s, p)).when(F.col(f"_m{i}").isNotNull(), none).alias(f"_g{i}") for i, p in enumerate(patterns)])
    length = lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("bigint")
    found = [F.col(f"_m{i}") for i in n]
    d = d.select(*own, *found, *[F.zip_with(f"_g{i}", f"_m{i}", length).alias(f"_n{i}") for i in n])
    d = running_sums(d, [f"_n{i}" for i in n])
    ends = [F.slice(f"_n{i}", F.lit(1), F.size(f"_m{i}")) for i in n]
    span = lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"))
    d = d.select(*own, *[F.zip_with(f"_m{i}", ends[i], span).alias(f"x{i}") for i in n])
    placed = lambda x, i: F.struct(i.cast("bigint").alias("ord"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))
    return d.select(*own, *[F.transform(f"x{i}", placed).alias(f"x{i}") for i in n])


def matches(docs: DataFrame, pattern: str, key: str = "doc_id", s: str = "s") -> DataFrame:
    """(key, ord, start, end, value) of every match of ``pattern`` in the byte string column, in order. Narrow: rows are
    only multiplied."""
    d = located(docs.select(key, s), [pattern], s)
    return d.select(key, F.explode_outer("x0").alias("x")).where("x IS NOT NULL").select(key, "x.*")


def line_of(s: Column, at: Column) -> Column:
    """1-based line of a byte offset."""
    prefix = F.substr(s, F.lit(1), at.cast("int"))
    return (F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def column_of(s: Column, at: Column) -> Column:
    """1-based column, in bytes, of a byte offset."""
    return (F.length(F.substring_index(F.substr(s, F.lit(1), at.cast("int")), "\n", -1)) + 1).cast("bigint")


def code_point_column(s: Column, at: Column) -> Column:
    """1-based column of a byte offset in characters of the UTF-8 text, as reports count columns."""
    return (F.char_length(to_text(F.substring_index(F.substr(s, F.lit(1), at.cast("int")), "\n", -1))) + 1).cast("bigint")


def line_around(s: Column, start: Column, end: Column) -> Column:
    before = F.substring_index(F.substr(s, F.lit(1), start.cast("int")), "\n", -1)
    after = F.substring_index(F.substr(s, (end + 1).cast("int")), "\n", 1)
    return F.concat(before, F.substr(s, (start + 1).cast("int"), (end - start).cast("int")), after)
