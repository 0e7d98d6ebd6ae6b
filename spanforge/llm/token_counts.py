"""Greedy word-piece counts by a linear longest-match automaton.

The automaton is a trie of the vocabulary's byte strings. A node without an edge for the next byte follows its failure
link: the greedy pieces of its string are popped, and the link leads to the node of what is left of it. How many pieces
that pops is stored with the node, so a word's count needs one pass over its bytes and no piece is ever built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import load_ranks

REMEMBERED = 300_000
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


class LongestMatch:
    """``vocabulary`` must hold every single byte, so that every word has pieces."""

    def __init__(self, vocabulary):
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for token in vocabulary:
            at = 0
            for b in token:
                if b not in edges[at]:
                    edges[at][b] = len(edges)
                    edges.append({})
                    final.append(False)
                at = edges[at][b]
            final[at] = True
        if len(edges[0]) < 256 or not all(final[n] for n in edges[0].values()):
            raise ValueError("the vocabulary lacks single bytes")
        fail, pops = [-1] * len(edges), [0] * len(edges)
        level = [0]
        while level:
            following = []
            for u in level:
                for b, v in edges[u].items():
                    following.append(v)
                    if final[v]:
                        fail[v], pops[v] = 0, 1
                        continue
                    z, n = fail[u], pops[u]
                    while z >= 0 and b not in edges[z]:
                        z, n = fail[z], n + pops[z]
                    fail[v], pops[v] = edges[z][b], n
            level = following
        self.edges, self.fail, self.pops = edges, fail, pops
        self.known: dict[str, int] = {}

    def count(self, word: bytes) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        at = n = 0
        for b in word:
            while b not in edges[at]:
                n += pops[at]
                at = fail[at]
            at = edges[at][b]
        while at > 0:
            n += pops[at]
            at = fail[at]
        return n

    def of_text(self, text: str) -> tuple[int, int]:
        """Words and pieces; each word is counted with the space that starts a word in the vocabulary."""
        words, known = WORDS(text), self.known
        try:
            return len(words), sum(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self.count(b" " + w.encode())
            return len(words), sum(map(known.__getitem__, words))


_LOADED: dict[str, LongestMatch] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_tokens. Words are what spaces and TAB..CR separate in the whole text;
    pieces are taken greedily, longest first, from the vocabulary of the rank file at ``path``, in which a word starts
    with a space. Null counts as empty: 0 and 0. Other columns are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = LongestMatch(load_ranks(path))
        automaton = _LOADED[path]
        for batch in batches:
            got = [automaton.of_text(t or "") for t in batch.column(1).to_pylist()]
            words, tokens = pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), words, tokens], names=["id", "n_words", "n_tokens"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_words bigint, n_tokens bigint").withColumnRenamed("id", id_col)
