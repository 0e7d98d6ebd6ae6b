import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken

from spanforge.llm.byte_bpe import ByteBpe, encode_decode, load_ranks
from spanforge.llm.mixing import apply_mix, mix_sources, permuted, shard_draws, source_targets

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, token_ids string, size string, sx int"


def texts():
    r = random.Random(5)
    alphabet = "abcdefg ABC  \n\t\r'sll 0123456789.,!?éèüñ中文字ß😀  \x1c\x85́\x00-_#$%"
    out = ["", " ", "\n\n  x", "a" * 3000, "the " * 500, "xyzzy" * 900, " " * 700 + "a", "it's we'll I'M", "\U0001f600" * 200, "qwerty7" * 7001, "é" * 600]
    return out + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 400))) for _ in range(400)]


def test_bpe_equals_tiktoken(spark):
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, None, None, None, "old", None, None) for i, t in [*rows, (10_000, None)]], SCHEMA)
    for r in encode_decode(df, PATH, P.PATTERN, decoded_col="bytes").collect():
        text = dict(rows).get(r.doc_id) or ""
        assert list(r.token_ids) == want.encode_ordinary(text), repr(text[:80])
        assert bytes(r.bytes) == text.encode()
    assert encode_decode(df.limit(0), PATH, P.PATTERN).collect() == []


def test_long_and_padded_agree():
    bpe = ByteBpe(PATH, P.PATTERN)
    r = random.Random(1)
    for _ in range(200):
        piece = bytes(r.choice(b"thereinandoshe\xc3\xa9 ") for _ in range(r.randint(2, 200)))
        assert bpe.merge_rows([piece, b"ab"], 256)[0] == bpe.merge_long(piece)


def test_targets_and_draws():
    got = source_targets([("b", 100), ("a", 10), (None, 1000), ("c", 0)], (5, 2, 1), 3)
    assert got["a"] == 30 and got["c"] == 0 and abs(sum(got.values()) - 1110) < 1e-6
    assert all(got[s] <= 3 * n + 1e-9 for s, n in (("b", 100), ("a", 10), (None, 1000), ("c", 0)))
    for i, n in enumerate([1000, 50, 0, 7]):
        counts = shard_draws(n, 17, 3, i)
        assert counts.sum() == n and len(counts) == 17 and (counts == shard_draws(n, 17, 3, i)).all()
    assert (shard_draws(1000, 17, 3, 0) != shard_draws(1000, 17, 3, 1)).any()
    assert abs(shard_draws(170_000, 17, 3, 0) - 10_000).max() < 600
    for n in (1, 2, 3, 17, 1000):
        x = permuted(np.arange(n), np.full(n, n), np.full(n, 99))
        assert sorted(x) == list(range(n))


def test_mix_equals_a_walk_over_words(spark):
    """The same mix word by word: each source's line of words, its blocks, the slots that number them."""
    import xxhash

    def hash64(*parts: bytes) -> int:
        seed = 42
        for b in parts:
            seed = xxhash.xxh64_intdigest(b, seed)
        return seed - (1 << 64) if seed >> 63 else seed

    number = lambda v, n: v.to_bytes(n, "little", signed=True)
    r = random.Random(11)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 90))), r.choice(["a", "b", "b", "b", None])) for i in range(300)] + [(300, None, "a"), (301, "one two", "tiny")]
    df = spark.createDataFrame([(i, t, None, s, None, None, None, 1) for i, t, s in rows], SCHEMA)
    got = {x.doc_id: x for x in mix_sources(df, block_words=8, shard_slots=64).collect()}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((hash64(number(7, 4), number(i, 8), number(hash64((t or "").encode()), 8)) % (16 + len(rows) // 2000), i))
    want = source_targets([(s, sum(size[i] for _, i in m)) for s, m in by.items()], (5, 2, 1), 3)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    for sx, s in enumerate(names):
        line = [i for _, i in sorted(by[s]) for _ in range(size[i])]
        width = max(1, min(8, len(line) // 256))
        blocks = -(-len(line) // width)
        slots = min(3 * blocks, round(want[s] * blocks / len(line)))
        taken = defaultdict(int)
        for k in range(slots):
            key = (7 << 40) + (sx << 20) + k // blocks
            block = int(permuted(np.array([k % blocks]), np.array([blocks]), np.array([key]))[0])
            for i in line[block * width : (block + 1) * width]:
                taken[i] += 1
        for _, i in by[s]:
            assert got[i].taken == taken[i], (s, i)
            assert (got[i]["size"], got[i].source_size) == (size[i], len(line)) and abs(got[i].target - want[s]) < 1e-6


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 300), r.choice(["s1", "s2", "s3", None] + ["hot"] * 4)) for i in range(400)] + [(400, None, "s1"), (401, "a b", "solo")]
    make = lambda rows: spark.createDataFrame([(i, t, None, s, None, None, None, 1) for i, t, s in rows], SCHEMA)
    got = mix_sources(make(rows), block_words=16).collect()
    again = mix_sources(make(rows).repartition(7), block_words=16).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    source, words = {i: s for i, _, s in rows}, {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sums, sizes = defaultdict(int), defaultdict(int)
    for x in got:
        assert x["size"] == words[x.doc_id] and 0 <= x.taken <= 3 * x["size"]
        sums[source[x.doc_id]] += x.taken
        sizes[source[x.doc_id]] += x["size"]
    want = source_targets(list(sizes.items()), (5, 2, 1), 3)
    for x in got:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 and abs(sums[s] - want[s]) <= 16
    out = apply_mix(make(rows), block_words=16)
    assert out.columns == make(rows).columns
    copies = [x.doc_id for x in out.collect()]
    assert set(copies) <= set(words) and copies.count(400) == 1
    for s in want:
        there = sum(words[i] for i in copies if source[i] == s)
        assert abs(there - want[s]) <= 0.03 * want[s] + 2 * max(words[i] for i in words if source[i] == s)
    assert mix_sources(make([])).collect() == [] and apply_mix(make([])).collect() == []
    same = apply_mix(make([(1, "a b c", "s"), (1, "a b c", "s"), (None, "q", None), (None, None, "s")]), block_words=1, weights=(1,)).collect()
    assert sum(x.doc_id == 1 for x in same) == 2 and len(same) <= 8
    twice = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (2, None, "s"), (None, "q", None)]
    assert len(mix_sources(make(twice)).collect()) == 5
