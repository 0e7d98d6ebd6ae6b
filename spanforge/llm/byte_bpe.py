"""Byte-level BPE encoding and decoding over padded matrices.

Distinct pieces of a chunk of texts are bucketed by length and laid out as padded matrices of token ids, one row a
piece. In each round every row merges its leftmost pair of the least rank; pair ranks come from an open-addressing hash
table over pairs of ids, only the two pairs beside the merge are looked up again, and rows without a pair that merges
leave the matrix. A piece longer than ``LONGEST`` is a matrix by itself, row after row of ``LONGEST`` positions: with the
least rank of each row kept, a round looks at the rows' leasts and at one row, so rounds do not become quadratic.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import lean

#: Rank of a pair that does not merge.
NONE = np.int32(2**31 - 1)
LONGEST = 256
BUCKETS = (4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, LONGEST)
#: Pieces a worker remembers in a task, characters whose pieces are encoded together, and cells of a matrix.
REMEMBERED, CHUNK, CELLS = 200_000, 2_000_000, 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class PairTable:
    """Open addressing over (left id, right id) -> id of the joined token."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = array("q"), array("i")  # no tuples: they would leave the worker's memory in pieces
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if (left := ranks.get(t[:i])) is not None and (right := ranks.get(t[i:])) is not None:
                    keys.append(left << 32 | right)
                    values.append(r)
        self.bits = max(4, (len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._hash(keys)
        while len(keys):
            free = self.keys[at] < 0
            slots, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[slots >= 0]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + ~free[rest]) & (len(self.keys) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined pairs; a negative id is padding and joins with nothing."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys = np.where((left < 0) | (right < 0), -2, keys)
        flat = keys.ravel()
        at = self._hash(flat)
        seen = self.keys[at]
        out = np.where(seen == flat, self.values[at], NONE)
        todo = np.flatnonzero((seen != flat) & (seen >= 0) & (flat >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[todo]]
            hit = seen == flat[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out.reshape(keys.shape)


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(self.ranks)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.forget()

    def forget(self) -> None:
        """Known pieces have numbers; the ids of piece i lie between ends i and i + 1."""
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("i", [0])

    def _keep(self, piece: str, ids: list[int]) -> None:
        self.known[piece] = len(self.known)
        self.flat.extend(ids)
        self.ends.append(len(self.flat))

    def merge_rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of at most ``width`` bytes."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < length[:, None], self.single[raw], np.int32(-1)).astype(np.int32)
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        out: list[list[int]] = [[]] * n
        where, cols = np.arange(n), np.arange(width)
        while len(where):
            at = rank.argmin(1)
            row = np.arange(len(where))
            best = rank[row, at]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[where[i]] = ids[i, : length[i]].tolist()
                keep = ~done
                where, ids, rank, length, at, best = where[keep], ids[keep], rank[keep], length[keep], at[keep], best[keep]
                if not len(where):
                    break
                width = int(length.max())
                ids, rank, cols = ids[:, :width], rank[:, :width], cols[:width]
                row = np.arange(len(where))
            take = np.minimum(cols + (cols > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            length -= 1
            ids[row, length] = -1
            ids[row, at] = best
            rank[row, length] = NONE
            right = np.minimum(at + 1, width - 1)
            rank[row, at] = np.where(at + 1 < length, self.pairs.rank(best, ids[row, right]), NONE)
            left = np.maximum(at - 1, 0)
            rank[row, left] = np.where(at > 0, self.pairs.rank(ids[row, left], best), rank[row, left])
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one long piece. Cells stay where they are; links skip those that have merged into their left one."""
        n, rows = len(piece), -(-len(piece) // LONGEST)
        codes = self.single[np.frombuffer(piece, np.uint8)]
        flat = np.full(rows * LONGEST, NONE, np.int32)
        flat[: n - 1] = self.pairs.rank(codes[:-1], codes[1:])
        rank, ids = flat.reshape(rows, LONGEST), codes.tolist()
        least = rank.min(1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        joined, bytes_of = self.ranks.get, self.bytes_of
        while (best := int(least[row := int(least.argmin())])) != NONE:
            i = row * LONGEST + int(rank[row].argmin())
            j, left = after[i], before[i]
            ids[i], ids[j] = best, -1
            after[i] = right = after[j]
            flat[j] = flat[i] = NONE
            if right < n:
                before[right] = i
                flat[i] = joined(bytes_of[best] + bytes_of[ids[right]], NONE)
            if left >= 0:
                flat[left] = joined(bytes_of[ids[left]] + bytes_of[best], NONE)
            for r in {row, j // LONGEST, max(left, 0) // LONGEST}:
                least[r] = rank[r].min()
        return [x for x in ids if x >= 0]

    def learn(self, pieces) -> None:
        """Encodes the pieces that are not known yet."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = list(pieces)
        buckets: dict[int, list[str]] = {}
        for p in new:
            b = p.encode()
            if (whole := self.ranks.get(b)) is not None:
                self._keep(p, [whole])
            elif len(b) > LONGEST:
                self._keep(p, self.merge_long(b))
            else:
                buckets.setdefault(next(w for w in BUCKETS if len(b) <= w), []).append(p)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for p, ids in zip(part, self.merge_rows([p.encode() for p in part], width)):
                    self._keep(p, ids)

    def _ids(self, pieces: list[str]) -> np.ndarray:
        """Ids of known pieces, one after another."""
        number = np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces))
        flat, ends = np.frombuffer(self.flat, np.int32), np.frombuffer(self.ends, np.int32)
        first, size = ends[number], ends[number + 1] - ends[number]
        upto = np.cumsum(size, dtype=np.int64)
        return flat[np.repeat(first - upto + size, size) + np.arange(upto[-1])] if len(pieces) else np.empty(0, np.int32)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; texts are taken in chunks of bounded length, a longer one by itself."""
        chunk, held = [], 0
        for t in chain(texts, [None]):
            if chunk and (t is None or held + len(t) > CHUNK):
                split = [self.split(x) for x in chunk]
                self.learn(set(chain.from_iterable(split)))
                yield from map(self._ids, split)
                chunk, held = [], 0
            if t is not None:
                chunk.append(t)
                held += len(t)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One for each worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode_decode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None
) -> DataFrame:
    """``docs`` with ``ids_col``: array<int>, the ids of the whole text without special tokens (null: empty), and with
    ``decoded_col``, where named: the bytes that decoding those ids gives. ``path`` is a rank file that every executor
    can open; ``pattern`` splits a text into pieces that are encoded separately. Other columns pass through; columns of
    the new names are replaced."""
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))]
    new += [T.StructField(decoded_col, T.BinaryType())] if decoded_col else []
    names = {f.name for f in new}
    kept = [f for f in docs.schema.fields if f.name not in names]
    order = [f.name for f in kept]
    schema = T.StructType(kept + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            start = 0
            while start < batch.num_rows or (start == 0 and not batch.num_rows):
                part = batch.slice(start, 512)
                start += max(1, part.num_rows)
                ids = list(bpe.encode([t or "" for t in part.column(text_col).to_pylist()]))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                arrays = [part.column(c) for c in order]
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                if decoded_col:
                    arrays.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*order, *(f.name for f in new)])
        bpe.forget()  # between tasks a worker holds the vocabulary alone

    use = docs.drop(*[n for n in names if n in docs.columns and n != text_col])
    return use.mapInArrow(lean(run), schema)
