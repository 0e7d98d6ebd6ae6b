"""Byte streams in chunks with carried state, and continuous scans.

A chunk is numbered within its document. State is what a model needs of the bytes before: here the class and start of
the run that the last chunk left open, so that runs over chunk borders come out as in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "doc_id bigint, start bigint, end bigint, closed boolean"
STATE = "next bigint, offset bigint, open bigint"


def _runs(chunk: bytes, wanted: frozenset, offset: int, open_: int) -> tuple[list[tuple[int, int]], int]:
    """Closed runs of wanted bytes in a chunk at ``offset``, and where an open one starts (-1: none)."""
    out = []
    for i, b in enumerate(chunk):
        if b in wanted:
            open_ = offset + i if open_ < 0 else open_
        elif open_ >= 0:
            out.append((open_, offset + i))
            open_ = -1
    return out, open_


def chunks(docs: DataFrame, size: int, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, seq, last, content): consecutive pieces of ``size`` bytes; the last may be shorter."""
    n = F.octet_length(content)
    d = docs.where(n > 0).withColumn("_n", F.ceil(n / size).cast("bigint"))
    d = d.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    body = F.substr(content, (F.col("seq") * size + 1).cast("int"), F.lit(size))
    return d.select(key, "seq", (F.col("seq") == F.col("_n") - 1).alias("last"), body.alias("content"))


def runs_of_stream(stream: DataFrame, members: bytes) -> DataFrame:
    """(doc_id, start, end, closed) of maximal runs of ``members`` in a stream of chunks (doc_id, seq, last, content).

    Chunks of a document must arrive in order, batch by batch; a late or missing one raises. State is dropped with the
    last chunk."""
    wanted = frozenset(members)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, offset, open_ = state.get if state.exists else (0, 0, -1)
        rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.seq)
        out, ended = [], False
        for r in rows:
            if r.seq != following:
                raise ValueError(f"chunk {r.seq} of document {key[0]} where {following} was due")
            found, open_ = _runs(bytes(r.content), wanted, offset, open_)
            out += [(key[0], a, z, True) for a, z in found]
            following, offset, ended = following + 1, offset + len(r.content), bool(r.last)
        if ended:
            out += [(key[0], open_, offset, False)] if open_ >= 0 else []
            state.remove()
        else:
            state.update((following, offset, open_))
        yield pd.DataFrame(out, columns=["doc_id", "start", "end", "closed"])

    return stream.groupBy("doc_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def scan_continuously(stream: DataFrame, scan, path: str, checkpoint: str):
    """Writes ``scan(batch)`` of each micro-batch of a file stream as Parquet; ``scan`` is stateless."""

    def write(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
