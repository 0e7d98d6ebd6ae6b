"""Mixing sources to target weights by fixed-length blocks.

Each source's words are laid on a line in a keyed order of its documents and cut into blocks of ``block_words``, fewer
in a source of few words. Each source has as many slots as its target has blocks; how many of them an output shard gets
is a multinomial draw, so that the totals come out at the targets. A source's slots number its blocks through keyed
pseudorandom permutations, one for each pass over the source, and blocks join the slots by index. A block is taken at
most once a pass, so no document exceeds the number of passes times its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import lean, text_or_empty, words_of, written

#: Targets are made on the driver, from one row for each source; shards are at most so many.
MAX_SHARDS = 4096
#: Sources whose table is broadcast; more are joined by a shuffle. Slots that one row makes, and about so many a task.
BROADCAST_SOURCES, PIECE, TASK_SLOTS = 10_000, 1 << 16, 250_000
#: Blocks that a source has at least, where it has as many words. Documents of a part of a source's line, about.
LEAST_BLOCKS, PART_ROWS = 256, 2_000


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], most: float) -> dict[str | None, float]:
    """Words wanted from each source. Sources by code point, null last, take ``weights`` in turn and share all words;
    a target stops at ``most`` times its source's size, and the excess is shared again by weight."""
    order = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size, out, left = dict(sizes), {}, float(sum(n for _, n in sizes))
    open_ = [s for s in order]
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(most * size[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def shard_draws(slots: int, shards: int, seed: int, source: int) -> np.ndarray:
    """How many of a source's slots fall on each shard: a multinomial draw of its own, whoever makes it."""
    return np.random.Generator(np.random.Philox(key=(seed, source))).multinomial(slots, np.full(shards, 1 / shards))


def _shard_counts(shards: int, seed: int):
    """sx, blocks, width, slots of sources to (shard, sx, blocks, width, n, first): slots of a shard and those of the
    shards before it. Drawn on the executors: a source has a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sx, blocks, width, slots in zip(*(c.to_pylist() for c in batch.columns)):
                n = shard_draws(slots, shards, seed, sx)
                first, some = np.cumsum(n) - n, np.flatnonzero(n)
                same = lambda v: pa.array(np.full(len(some), v), pa.int64())
                columns = [pa.array(some), same(sx), same(blocks), same(width), pa.array(n[some]), pa.array(first[some])]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "sx", "blocks", "width", "n", "first"])

    return run


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of [0, size): four Feistel rounds over the next even power of two, walked until inside."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    key = key.astype(np.uint64)
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            z = (right + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & mask[todo])
        x[todo] = (left << half[todo]) | right
        todo = todo[x[todo] >= size[todo].astype(np.uint64)]
    return x.astype(np.int64)


def _block_of(seed: int):
    @F.pandas_udf("bigint")
    def block(source: pd.Series, slot: pd.Series, blocks: pd.Series) -> pd.Series:
        n = blocks.to_numpy(np.int64)
        key = (np.uint64(seed) << np.uint64(40)) + (source.to_numpy(np.uint64) << np.uint64(20)) + (slot // n).to_numpy(np.uint64)
        return pd.Series(permuted((slot % n).to_numpy(np.int64), n, key))

    return block


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    max_repeats: int = 3,
    block_words: int = 64,
    shard_slots: int = 1024,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: id, size (words), source_size, target (its source's), taken (words the mix takes).

    Null text has size 0 and is not taken; null is a source of its own, the last. Rows with equal id, text and source are
    interchangeable: which of them gives which words is not defined, but the sums are. Reruns agree, whatever the
    partitioning. Other columns are ignored; an empty table gives an empty result. At scale raise ``block_words``: slots
    are as many as words / ``block_words``. The driver holds one row per source.
    """
    mixed = _mixed(docs, id_col, text_col, source_col, weights, max_repeats, block_words, shard_slots, seed)
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _before(parts: DataFrame) -> DataFrame:
    """(sx, part, at): words of a source in the parts before. Sums go over runs of parts first, so that no window holds
    all parts of a large source."""
    run = F.floor(F.col("part") / 1024).cast("int")
    parts = parts.withColumn("run", run)
    so_far = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = parts.groupBy("sx", "run").agg(F.sum("words").alias("words"))
    runs = runs.select("sx", "run", so_far(Window.partitionBy("sx").orderBy("run")).alias("before"))
    inner = parts.withColumn("inside", so_far(Window.partitionBy("sx", "run").orderBy("part")))
    return inner.join(runs, ["sx", "run"]).select("sx", "part", (F.col("before") + F.col("inside")).alias("at"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, max_repeats: int, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """``mix_sources`` with sx (the source's number), part (of its line) and h (hash of the text)."""
    sized = written(
        docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_or_empty(F.col(text_col))).alias("h")).select(
            "id", "source", F.size("w").cast("bigint").alias("size"), "h"
        ),
        "sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    targets = source_targets([(r.source, r["size"]) for r in totals], weights, max_repeats)
    table = []
    for ix, r in enumerate(sorted(totals, key=lambda r: (r.source is None, r.source or ""))):
        width = max(1, min(block_words, r["size"] // LEAST_BLOCKS))
        blocks = math.ceil(r["size"] / width)
        # the last block is short: slots are counted in the source's mean block
        slots = min(max_repeats * blocks, round(targets[r.source] * blocks / r["size"])) if blocks else 0
        table.append((ix, r.source, r["size"], targets[r.source], blocks, width, slots))
    spark, all_slots, rows = docs.sparkSession, sum(t[-1] for t in table), sum(r.rows for r in totals)
    sources = spark.createDataFrame(table, "sx bigint, source_name string, source_size bigint, target double, blocks bigint, width bigint, slots bigint")
    shards = max(1, min(MAX_SHARDS, math.ceil(all_slots / shard_slots)))
    dealt = sources.where("slots > 0").select("sx", "blocks", "width", "slots").repartition("sx")
    counts = dealt.mapInArrow(lean(_shard_counts(shards, seed)), "shard bigint, sx bigint, blocks bigint, width bigint, n bigint, first bigint")
    pieces = counts.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(PIECE).cast("bigint"))))
    slot = F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("at") + PIECE, F.col("n")) - 1)
    taken = (
        pieces.repartition(min(20_000, 1 + all_slots // TASK_SLOTS), "shard", "sx", "at")
        .select("sx", "blocks", F.explode(slot).alias("slot"))
        .select("sx", _block_of(seed)("sx", "slot", "blocks").alias("block"))
        .groupBy("sx", "block")
        .agg(F.count(F.lit(1)).alias("times"))
    )

    if len(table) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    known = sized.join(sources, sized.source.eqNullSafe(sources.source_name)).drop("source", "source_name", "slots", "blocks")
    parts = 16 + rows // PART_ROWS  # of each source's line, so that no window holds a large source's documents
    known = known.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "id", "h"), F.lit(parts)).cast("int"))
    starts = _before(known.groupBy("sx", "part").agg(F.sum("size").alias("words")))
    inside = Window.partitionBy("sx", "part").orderBy("id", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = known.withColumn("upto", F.sum("size").over(inside)).join(starts, ["sx", "part"])
    lines = lines.withColumn("start", F.col("at") + F.col("upto") - F.col("size"))
    return _taken(lines, taken)


def _taken(lines: DataFrame, taken: DataFrame) -> DataFrame:
    first, last, width = F.col("start"), F.col("start") + F.col("size"), F.col("width")
    whole = lambda x: F.floor(x / width).cast("bigint")
    some = lines.where("size > 0").withColumn("block", F.explode(F.sequence(whole(first), whole(last - 1))))
    overlap = F.least(last, (F.col("block") + 1) * width) - F.greatest(first, F.col("block") * width)
    # the blocks come from a few rows of sources, so the optimizer takes them for few and would broadcast them all
    taken = taken.hint("merge")
    out = ["id", "size", "source_size", "target", "sx", "part", "h"]
    words = (
        some.withColumn("words", overlap)
        .join(taken, ["sx", "block"], "left")
        .groupBy("start", *out)
        .agg(F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0))).cast("bigint").alias("taken"))
        .select(*out, "taken")
    )
    none = lines.where("size = 0").select(*out, F.lit(0).cast("bigint").alias("taken"))
    return words.union(none)


def apply_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    max_repeats: int = 3,
    block_words: int = 64,
    shard_slots: int = 1024,
    seed: int = 7,
) -> DataFrame:
    """``docs`` as the mix repeats them: a document whose words are taken x times on average is there floor(x) or
    ceil(x) times, so some are gone and none is there more than ``max_repeats`` times. Documents without words have no
    share in the mix and pass once. Rows with one id are one document: what is taken of them together decides how often
    each is there.

    Which documents are rounded up is a systematic draw: those of a part of a source's line, by size, share the sum of
    their fractions, so a source's words differ from what is taken of it by less than its longest document a part, and
    by far less in sum.
    """
    mix = _mixed(docs, id_col, text_col, source_col, weights, max_repeats, block_words, shard_slots, seed)
    mix = mix.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("size", "taken")], *[F.min(c).alias(c) for c in ("sx", "part", "h")])
    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1.0))
    # in units of 2**-40: sums of integers do not depend on their order
    mix = mix.withColumn("whole", F.floor(share)).withColumn("rest", ((share - F.floor(share)) * (1 << 40)).cast("bigint"))
    line = Window.partitionBy("sx", "part").orderBy("size", "h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.pmod(F.xxhash64(F.lit(seed + 1), "sx", "part"), F.lit(1 << 40))
    mix = mix.withColumn("upto", F.sum("rest").over(line) + offset)
    steps = F.floor(F.col("upto") / (1 << 40)) - F.floor((F.col("upto") - F.col("rest")) / (1 << 40))
    times = (F.col("whole") + steps).cast("int")
    copies = mix.select(F.col("id").alias("__mix_id"), times.alias("__mix_times")).where("__mix_times > 0")
    out = docs.join(copies, docs[id_col].eqNullSafe(F.col("__mix_id")))
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times")))).select(*[docs[c] for c in docs.columns])
