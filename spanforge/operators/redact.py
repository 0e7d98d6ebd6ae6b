"""Redaction by typed spans: markers, the redacted copy with its check, report and map, and restoration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytestr import base64_line, running_sums, to_bytes, to_text
from ..functions.values import normalize_value
from .intervals import resolve


def spliced(s: Column, pieces: Column, start: str, end: str, text: str) -> Column:
    """``s`` with each piece's [start, end) replaced by its text; ``pieces`` is a column, in order."""
    before = lambda i: F.when(i > 0, F.get(pieces, i - 1)[end]).otherwise(F.lit(0))
    gap = lambda x, i: F.substr(s, (before(i) + 1).cast("int"), (x[start] - before(i)).cast("int"))
    done = F.array_join(F.transform(pieces, lambda x, i: F.concat(gap(x, i), x[text])), "")
    last = F.coalesce(F.try_element_at(pieces, F.lit(-1))[end], F.lit(0))
    return F.concat(done, F.substr(s, (last + 1).cast("int")))


def _with(x: Column, fields: list[str], **more: Column) -> Column:
    return F.struct(*[x[f].alias(f) for f in fields], *[c.alias(name) for name, c in more.items()])


def _entries(docs: DataFrame, spans: DataFrame, key: str, s: str) -> DataFrame:
    """(key, s, entries) of every document: its resolved spans in order with value, marker, out_start and out_end.

    Numbers count values of a type by their first appearance, above the highest number that the document's own
    ``[TYPE_n]`` already has. The spans of a document come together once and meet its text in one join; all else happens
    in its row, level by level, because what a lambda refers to more than once must be a column."""
    fields = ["start", "end", "type", "conf", "source"]
    lists = resolve(spans, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("e"))
    none = F.array().cast(lists.schema["e"].dataType)
    d = docs.select(key, F.col(s).alias("s")).join(lists, key, "left").withColumn("e", F.coalesce("e", none))
    value = lambda x: F.substr("s", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
    d = d.withColumn("e", F.transform("e", lambda x: _with(x, fields, value=value(x))))
    fields += ["value"]
    # bytes that are no text keep values apart, though they read alike
    rest = lambda v: F.when(F.is_valid_utf8(to_bytes(v).cast("string")), "").otherwise(F.concat(F.lit("\0"), v))
    norm = lambda x: F.concat(x["type"], F.lit("\0"), normalize_value(x["type"], to_text(x["value"])), rest(x["value"]))
    d = d.withColumn("e", F.transform("e", lambda x: _with(x, fields, norm=norm(x))))
    d = d.withColumn("names", F.array_distinct(F.transform("e", lambda x: x["norm"])))
    d = d.withColumn("types", F.array_distinct(F.transform("e", lambda x: x["type"])))
    taken = lambda t: F.regexp_extract_all("s", F.concat(F.lit(r"\["), t, F.lit(r"_([0-9]{1,9})\]")), 1)
    base = lambda t: F.coalesce(F.array_max(F.transform(taken(t), lambda n: n.cast("bigint"))), F.lit(0).cast("bigint"))
    d = d.withColumn("types", F.transform("types", lambda t: F.struct(t.alias("type"), base(t).alias("base"))))
    own = lambda t: F.filter("names", lambda n: F.substring_index(n, "\0", 1) == t["type"])
    numbered = F.transform("types", lambda t: F.transform(own(t), lambda n, i: F.struct(n.alias("norm"), (i + 1 + t["base"]).alias("n"))))
    d = d.withColumn("numbers", F.map_from_entries(F.flatten(numbered)))
    marker = lambda x: F.concat(F.lit("["), x["type"], F.lit("_"), F.try_element_at("numbers", x["norm"]).cast("string"), F.lit("]"))
    d = d.withColumn("e", F.transform("e", lambda x: _with(x, [*fields, "norm"], marker=marker(x))))
    fields += ["norm", "marker"]
    d = d.select(key, "s", "e", F.transform("e", lambda x: F.length(x["marker"]) - (x["end"] - x["start"])).alias("grown"))
    d = running_sums(d, ["grown"])
    out_end = lambda x, i: x["end"] + F.get("grown", i)
    made = lambda x, i: _with(x, fields, out_start=out_end(x, i) - F.length(x["marker"]), out_end=out_end(x, i))
    return d.select(key, "s", F.transform("e", made).alias("entries"))


def markers(docs: DataFrame, spans: DataFrame, key: str = "doc_id", s: str = "s") -> DataFrame:
    """Resolved spans (key, start, end, type, conf, source) with value, norm, marker, out_start and out_end."""
    d = _entries(docs, spans, key, s).select(key, F.explode_outer("entries").alias("x")).where("x IS NOT NULL").select(key, "x.*")
    return d.withColumn("norm", F.substr("norm", F.length("type") + 2))


def redact(docs: DataFrame, spans: DataFrame, key: str = "doc_id", s: str = "s") -> DataFrame:
    """(key, s, out, entries): the redacted byte string of every document. The check that what is between the markers is
    the original, byte for byte, is part of the plan and raises. To make rows of ``entries`` use ``explode_outer``: for a
    plain ``explode`` the optimizer infers a filter and pushes it below, where it makes all the steps again."""
    d = _entries(docs, spans, key, s)
    names = ["start", "end", "type", "marker", "conf", "source", "out_start", "out_end", "value"]
    d = d.withColumn("entries", F.transform("entries", lambda x: _with(x, names)))
    d = d.withColumn("out", spliced(F.col("s"), F.col("entries"), "start", "end", "marker"))
    back = spliced(F.col("out"), F.col("entries"), "out_start", "out_end", "value")
    return d.select(key, "s", F.when(back == F.col("s"), F.col("out")).otherwise(F.raise_error(F.lit("the copy differs outside the markers"))).alias("out"), "entries")


def whole_characters(spans: DataFrame, docs: DataFrame, key: str = "doc_id", s: str = "s") -> DataFrame:
    """``spans`` of ``docs`` (UTF-8 byte strings) widened to whole characters; spans of other documents stay."""
    d = spans.join(docs.select(key, F.col(s).alias("_s")), key, "left")
    before = F.reverse(F.substr("_s", F.greatest(F.col("start") - 2, F.lit(1)).cast("int"), F.least(F.col("start") + 1, F.lit(4)).cast("int")))
    back = F.length(F.regexp_extract(before, "^[\x80-\xbf]{0,3}", 0))
    more = F.length(F.regexp_extract(F.substr("_s", (F.col("end") + 1).cast("int"), F.lit(3)), "^[\x80-\xbf]*", 0))
    new = {"start": (F.col("start") - F.coalesce(back, F.lit(0))).cast("bigint"), "end": (F.col("end") + F.coalesce(more, F.lit(0))).cast("bigint")}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in spans.columns])


def report(redacted: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, sha256_in, sha256_out, spans, counts) and the columns ``keep``: values never appear."""
    kinds = F.transform("entries", lambda x: x["type"])
    counts = F.map_from_entries(
        F.transform(F.array_sort(F.array_distinct(kinds)), lambda t: F.struct(t, F.size(F.filter(kinds, lambda x: x == t))))
    )
    return redacted.select(
        key,
        F.sha2(to_bytes(F.col("s")), 256).alias("sha256_in"),
        F.sha2(to_bytes(F.col("out")), 256).alias("sha256_out"),
        F.size("entries").cast("bigint").alias("spans"),
        counts.alias("counts"),
        *keep,
    )


def restore_map(redacted: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, map) and the columns ``keep``: JSON with version, sha256_out and, for each marker, offsets and the value in base64."""
    items = F.transform(
        "entries",
        lambda x: F.struct(x["marker"].alias("marker"), x["out_start"].alias("start"), x["out_end"].alias("end"), base64_line(to_bytes(x["value"])).alias("value_b64")),
    )
    body = F.struct(F.lit(1).alias("version"), F.sha2(to_bytes(F.col("out")), 256).alias("sha256_out"), items.alias("entries"))
    return redacted.select(key, F.to_json(body).alias("map"), *keep)


MAP_TYPE = "version int, sha256_out string, entries array<struct<marker:string,start:bigint,end:bigint,value_b64:string>>"


def restore(copies: DataFrame, maps: DataFrame, key: str = "doc_id", out: str = "out") -> DataFrame:
    """(key, s, refused): the original byte string of a redacted one, or why its map does not fit."""
    return restored(copies.select(key, F.col(out).alias("out")).join(maps, key), key)


def restored(both: DataFrame, key: str = "doc_id") -> DataFrame:
    """``restore`` of copies that stand beside their maps (key, out, map)."""
    d = both.select(key, "out", F.from_json("map", MAP_TYPE).alias("m"))
    placed = F.forall("m.entries", lambda x: F.substr("out", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")) == x["marker"])
    why = (
        F.when(F.col("m.version").isNull() | (F.col("m.version") != 1), "version")
        .when(F.coalesce(F.col("m.sha256_out") != F.sha2(to_bytes(F.col("out")), 256), F.lit(True)), "sha256")
        .when(F.col("m.entries").isNull() | F.exists("m.entries", lambda x: x["start"].isNull() | x["end"].isNull() | (x["start"] < 0)), "offset")
        .when(~F.coalesce(placed, F.lit(False)), "marker")
        .when(F.exists("m.entries", lambda x: x["value_b64"].isNull() | ~x["value_b64"].rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")), "base64")
    )
    d = d.withColumn("refused", why)
    pieces = F.transform("m.entries", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.decode(F.unbase64(x["value_b64"]), "ISO-8859-1").alias("text")))
    d = d.withColumn("pieces", F.when(F.col("refused").isNull(), pieces))
    return d.select(key, F.when(F.col("refused").isNull(), spliced(F.col("out"), F.col("pieces"), "start", "end", "text")).alias("s"), "refused")
