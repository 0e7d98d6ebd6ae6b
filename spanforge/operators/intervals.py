"""Interval algebra over spans (doc_id, ord, start, end, type, conf, source, member): merges, resolution, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALIDATED = ("CREDIT_CARD", "DNI_NIE", "EMAIL", "IBAN", "IP", "URL_CREDENTIALS")


def islands(spans: DataFrame, by: list[str], joins: Column, order: list | None = None) -> DataFrame:
    """``spans`` with ``island``: a new one starts where ``joins``, in terms of start and ``reach`` (the furthest end
    so far), does not hold."""
    order = order or ["start", "end"]
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    d = spans.withColumn("reach", F.max("end").over(so_far))
    d = d.withColumn("fresh", F.when(F.col("reach").isNotNull() & joins, 0).otherwise(1))
    return d.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("reach", "fresh")


def merge_nearby(spans: DataFrame, gap: int, key: str = "doc_id") -> DataFrame:
    """Spans at most ``gap`` bytes apart become one, with the highest confidence and the type of its first holder."""
    d = islands(spans, [key], F.col("start") <= F.col("reach") + gap)
    best = F.max_by("type", F.struct(F.col("conf"), -F.col("start"), -F.col("end")))
    return d.groupBy(key, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("conf").alias("conf"), best.alias("type")
    ).drop("island")


def joined_sources() -> Column:
    parts = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("source", r"\+")))))
    return F.when(F.count_distinct("source") == 1, F.min("source")).otherwise(F.array_join(parts, "+"))


def same_type_union(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapping spans of a type become one; touching ones stay two."""
    d = islands(spans, [key, "type"], F.col("start") < F.col("reach"), ["start", F.desc("end"), "ord"])
    return d.groupBy(key, "type", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("conf").alias("conf"), joined_sources().alias("source")
    )


def resolve(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Who owns each byte: validated rule spans first, then confidence, length, type order and start; losers keep the
    pieces that are left. Empty and negative spans are dropped.

    One shuffle, by document: windows and groups below keep to it. A document's spans fall into clusters that overlap
    nothing else; inside a cluster, boundaries cut elementary intervals, each goes to its best span, and neighbours of
    one owner are joined again."""
    ok = spans.where("start >= 0 AND start < end").select(key, "ord", "start", "end", "type", "conf", "source").repartition(key)
    ok = ok.withColumn("tix", F.min("ord").over(Window.partitionBy(key, "type")))
    d = islands(ok, [key, "type"], F.col("start") < F.col("reach"), ["start", F.desc("end"), "ord"])
    m = d.groupBy(key, "type", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("conf").alias("conf"), joined_sources().alias("source"), F.min("tix").alias("tix")
    )
    m = islands(m.withColumnRenamed("island", "own"), [key], F.col("start") < F.col("reach"))
    valid = (F.col("type").isin(*VALIDATED) & F.contains("source", F.lit("rules"))).cast("int")
    rank = F.struct(valid.alias("r0"), F.col("conf").alias("r1"), (F.col("end") - F.col("start")).alias("r2"), (-F.col("tix")).alias("r3"), (-F.col("start")).alias("r4"), "start", "end", "type", "own", "conf", "source")
    c = m.groupBy(key, "island").agg(F.collect_list(rank).alias("m"))
    cuts = F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda x: F.array(x["start"], x["end"])))))
    c = c.select(key, "island", "m", cuts.alias("cuts"))
    best = lambda a, z: F.array_max(F.filter("m", lambda x: (x["start"] <= a) & (z <= x["end"])))
    pieces = F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), lambda a, i: F.struct(a.alias("a"), F.get("cuts", i + 1).alias("z"), best(a, F.get("cuts", i + 1)).alias("o")))
    c = c.select(key, "island", pieces.alias("p"))
    p = F.col("p")
    goes_on = lambda x, i: F.coalesce((F.get(p, i - 1)["o"]["type"] == x["o"]["type"]) & (F.get(p, i - 1)["o"]["own"] == x["o"]["own"]), F.lit(False))
    heads = F.filter(F.transform(p, lambda x, i: F.when(~goes_on(x, i), F.struct(i.alias("i"), x["a"].alias("a"), x["o"].alias("o")))), lambda h: h.isNotNull())
    c = c.select(key, "p", heads.alias("h"))
    last = lambda i: F.get("p", F.coalesce(F.get("h", i + 1)["i"], F.size("p")) - 1)["z"]
    whole = F.transform("h", lambda h, i: F.struct(h["a"].alias("start"), last(i).alias("end"), h["o"]["type"].alias("type"), h["o"]["conf"].alias("conf"), h["o"]["source"].alias("source")))
    return c.select(key, F.explode_outer(whole).alias("w")).where("w IS NOT NULL").select(key, "w.*")


def hidden(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapping or touching spans, whatever their type, as (start, end, base64)."""
    d = islands(spans, [key], F.col("start") <= F.col("reach"))
    return d.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("base64").alias("base64")).drop("island")


def votes_needed(members: int, votes: int = 0) -> int:
    if not 0 <= votes <= members:
        raise ValueError("votes")
    return votes or members // 2 + 1


def vote_counts(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``spans`` with ``votes``: how many members have a span of the type that overlaps it; one row for equal ones.

    One shuffle, by document, and no pairs: each span asks each member at its end for the furthest end among the member's
    spans that start before."""
    own, w = spans.columns, Window.partitionBy(key, "type")
    d = spans.where(F.col(key).isNotNull() & F.col("type").isNotNull()).repartition(key).distinct().withColumn("_members", F.collect_set("member").over(w))
    kind = spans.schema["member"].dataType
    event = lambda asks, m, at, reach: F.struct(F.lit(asks).alias("asks"), m.cast(kind).alias("m"), at.cast("bigint").alias("at"), reach.cast("bigint").alias("reach"))
    shown = F.array(event(1, F.col("member"), F.col("start"), F.col("end")))
    asked = F.transform("_members", lambda m: event(0, m, F.col("end"), F.lit(None)))
    d = d.select(*own, F.explode_outer(F.concat(shown, asked)).alias("_x"))
    met = F.max("_x.reach").over(Window.partitionBy(key, "type", "_x.m").orderBy("_x.at", "_x.asks").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_met", met).where((F.col("_x.asks") == 0) & (F.col("_met") > F.col("start")))
    return d.groupBy(*own).agg(F.count(F.lit(1)).alias("votes"))


def vote_by_offset(spans: DataFrame, votes: int, key: str = "doc_id") -> DataFrame:
    """Of the spans with one start the first member's, if ``votes`` members have one."""
    first = F.min_by(F.struct("end", "type"), F.struct("member", "end"))
    return (
        spans.groupBy(key, "start")
        .agg(F.count_distinct("member").alias("votes"), F.min("member").alias("member"), first.alias("f"))
        .where(F.col("votes") >= votes)
        .select(key, "start", "votes", "member", "f.*")
    )


def vote_by_overlap(spans: DataFrame, votes: int, key: str = "doc_id") -> DataFrame:
    """Spans in order of start and member; one that overlaps a kept span of its type is dropped, else it is kept if
    ``votes`` members have an overlapping one. Kept or not depends on what was kept before, so each (document, type) is
    folded in order; the state is the furthest kept end."""
    counted = vote_counts(spans, key).where(F.col("votes") >= votes)
    rows = F.array_sort(F.collect_list(F.struct("start", "member", "end", "votes")))
    fold = F.aggregate(
        "rows",
        F.struct(F.lit(-1).cast("bigint").alias("reach"), F.array().cast("array<struct<start:bigint,member:int,end:bigint,votes:bigint>>").alias("kept")),
        lambda acc, x: F.when(
            (x["start"] >= acc["reach"]) & (x["votes"] >= votes),
            F.struct(x["end"].alias("reach"), F.concat(acc["kept"], F.array(x)).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    grouped = counted.groupBy(key, "type").agg(rows.alias("rows"))
    return grouped.select(key, "type", F.explode_outer(fold).alias("k")).where("k IS NOT NULL").select(key, "type", "k.*")


def field_attribution(spans: DataFrame, queries: list[str], s: str = "s") -> DataFrame:
    """``spans`` (start, and the document's byte string) with ``field``: the query whose last occurrence that ends before
    the span on its line starts last; the first query on a tie, null without any. In the span's row: the line before the
    span is searched from its end, so occurrences may overlap."""
    line = F.substring_index(F.substr(s, F.lit(1), F.col("start").cast("int")), "\n", -1)
    d = spans.withColumn("_line", line)
    last = lambda q: F.length("_line") - F.instr(F.reverse("_line"), F.lit(q[::-1])) - len(q) + 1
    codes = [q.encode().decode("latin-1") for q in queries]
    found = [F.when(F.contains("_line", F.lit(c)), F.struct(last(c).alias("at"), F.lit(-i).alias("first"), F.lit(q).alias("field"))) for i, (q, c) in enumerate(zip(queries, codes))]
    return d.withColumn("field", F.array_max(F.array_compact(F.array(*found)))["field"]).drop("_line")


def touching(spans: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans that overlap any range (key, start, end): a semi-join on the key with a range condition."""
    r = ranges.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(r, (F.col(key) == F.col("_k")) & (F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")), "left_semi")


def inside(spans: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans that some range contains."""
    r = ranges.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(r, (F.col(key) == F.col("_k")) & (F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e")), "left_semi")
