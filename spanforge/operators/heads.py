"""Head outputs of windows and how a document's windows are summed up. ``rows``: key, win, values (logits or shares)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def softmax(v: Column) -> Column:
    """Shares of logits, in double; project ``v`` first."""
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def first_argmax(v: Column) -> Column:
    return (F.array_position(v, F.array_max(v)) - 1).cast("bigint")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def choice_max(rows: DataFrame, key: str) -> DataFrame:
    """The window with the highest finite 1 - p[0], the earliest on a tie; if none is finite, the earliest."""
    score = 1 - F.get("values", F.lit(0))
    rank = F.struct(finite(score), F.when(finite(score), score), -F.col("win"))
    return rows.groupBy(key).agg(F.max_by(F.struct("win", "values"), rank).alias("b")).select(
        key, F.col("b.win").alias("win"), first_argmax(F.col("b.values")).alias("label"), F.get("b.values", F.lit(0)).alias("p0")
    )


def elementwise(rows: DataFrame, key: str, how: str = "mean") -> DataFrame:
    """(key, values): mean, max or min of each position over the windows, in window order. NaN counts as 0 for max."""
    each = rows.select(key, "win", F.posexplode("values").alias("i", "v"))
    if how == "mean":
        each = each.groupBy(key, "i").agg(F.array_sort(F.collect_list(F.struct("win", F.col("v").cast("double").alias("v")))).alias("l"))
        each = each.select(key, "i", (F.aggregate("l", F.lit(0.0), lambda a, x: a + x["v"]) / F.size("l")).alias("v"))
    else:
        f = {"max": F.max, "min": F.min}[how]
        each = each.groupBy(key, "i").agg(f(F.nanvl("v", F.lit(0.0))).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return each.groupBy(key).agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def choice_vote(rows: DataFrame, key: str) -> DataFrame:
    """The label that most windows have, the lowest on a tie, and its share."""
    n = rows.select(key, first_argmax(F.col("values")).alias("label")).groupBy(key, "label").count()
    return n.groupBy(key).agg(
        F.max_by("label", F.struct("count", -F.col("label"))).alias("label"), (F.max("count") / F.sum("count")).alias("share")
    )


def ordinal_level(v: Column) -> Column:
    """How many sorted thresholds the shares pass."""
    return F.size(F.filter(v, lambda p: p > 0.5)).cast("bigint")


def ordinal_max(rows: DataFrame, key: str) -> DataFrame:
    level = ordinal_level(F.col("values"))
    return rows.withColumn("level", level).groupBy(key).agg(
        F.max("level").alias("level"), F.max_by("win", F.struct("level", -F.col("win"))).alias("win")
    )


def byte_map_regions(wins: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Maximal regions of one class. ``classes``: (key, start, end, class) runs inside windows ``wins`` (key, win, start,
    length, in order): each byte takes the earliest window that covers it."""
    w = Window.partitionBy(key).orderBy("win").rowsBetween(Window.unboundedPreceding, -1)
    own = wins.withColumn("from", F.greatest("start", F.coalesce(F.max(F.col("start") + F.col("length")).over(w), F.lit(0))))
    own = own.select(key, "win", "from", (F.col("start") + F.col("length")).alias("to"))
    part = classes.join(own, [key, "win"]).select(key, F.greatest("start", "from").alias("start"), F.least("end", "to").alias("end"), "class").where("start < end")
    o = Window.partitionBy(key).orderBy("start")
    fresh = F.when((F.lag("class").over(o) == F.col("class")) & (F.lag("end").over(o) == F.col("start")), 0).otherwise(1)
    part = part.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("class").alias("class")).drop("g")


#: Bytes of windows that ``class_regions`` takes at once.
TAKEN = 1 << 20


def class_regions(rows: DataFrame, key: str = "doc_id", table: bytes | None = None, without: int | None = None, ordered: bool = False) -> DataFrame:
    """``byte_map_regions`` of windows (key, win, start, classes) whose classes are bytes, one for each position, or the
    bytes that ``table`` gives a class each; regions of the class ``without`` are left out.

    One pass over each document's windows in order, and no row for a run before it is whole. ``ordered``: windows stand in
    their partition as they were cut from their documents, so nothing moves; else a shuffle puts them so."""
    use = rows.select(key, "win", F.col("start").cast("bigint").alias("start"), "classes")
    use = (use if ordered else use.repartition(key).sortWithinPartitions(key, "win")).select(key, "start", "classes")
    schema = T.StructType([use.schema[key], T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("class", T.IntegerType())])
    lookup = None if table is None else np.frombuffer(table, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind = [key, "start", "end", "class"], None
        held, reach = None, 0  # the region that the next window may carry on: (key, start, end, class); end of its document so far

        def table_of(keys: pa.Array, *columns: np.ndarray) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

        for whole in batches:
            kind, each = whole.schema.field(0).type, max(1, TAKEN * whole.num_rows // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, each):
                part = whole.slice(at, each)
                keys, raw = part.column(0), part.column(2).to_pylist()
                own, sizes = keys.to_pylist(), np.array([len(b or b"") for b in raw])
                starts = part.column(1).to_numpy()
                fresh = np.array([a != b for a, b in zip(own, [held[0] if held else None, *own])])
                fresh[0] |= held is None
                doc = np.cumsum(fresh)
                # the furthest end of a document's windows so far, by a running maximum that each document lifts
                lift = doc.astype(np.int64) << 40
                upto = np.maximum.accumulate(np.concatenate([[reach], starts + sizes + lift]))
                begins = np.maximum(starts, upto[:-1] - lift)
                lost = np.minimum(begins - starts, sizes)
                row = np.repeat(np.arange(len(own)), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = place >= lost[row]
                row, place = row[keep], place[keep] + starts[row[keep]]
                value = np.frombuffer(b"".join(b or b"" for b in raw), np.uint8)[keep]
                value = value if lookup is None else lookup[value]
                reach = int(upto[-1] - lift[-1])
                if not len(row):
                    if fresh.any():
                        if held and held[2] > held[1] and held[3] != without:
                            yield table_of(pa.array([held[0]], kind), *([x] for x in held[1:]))
                        held = (own[-1], 0, 0, -1)
                    continue
                cut = np.flatnonzero((value[1:] != value[:-1]) | (place[1:] != place[:-1] + 1) | (doc[row[1:]] != doc[row[:-1]])) + 1
                first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(row)]]) - 1
                a, z, c, r = place[first], place[last] + 1, value[first].astype(np.int32), row[first]
                if held:
                    if doc[r[0]] == 0 and held[2] == a[0] and held[3] == c[0]:
                        a[0] = held[1]
                    elif held[2] > held[1] and held[3] != without:
                        yield table_of(pa.array([held[0]], kind), *([x] for x in held[1:]))
                # what is held is of the part's last document
                held = (own[-1], int(a[-1]), int(z[-1]), int(c[-1])) if doc[r[-1]] == doc[-1] else None
                done = slice(0, -1) if held else slice(None)
                held = held or (own[-1], 0, 0, -1)
                a, z, c, r = a[done], z[done], c[done], r[done]
                if without is not None:
                    a, z, c, r = (x[c != without] for x in (a, z, c, r))
                if len(a):
                    yield table_of(keys.take(pa.array(r)), a, z, c)
        if held and held[2] > held[1] and held[3] != without:
            yield table_of(pa.array([held[0]], kind), *([x] for x in held[1:]))

    return use.mapInArrow(run, schema)
