import hashlib
import random
import re

from pyspark.sql import types as T

from spanforge.llm.exact_dedup import drop_exact_duplicates, mark_exact_duplicates
from spanforge.llm.near_dedup import drop_near_duplicates, near_duplicates

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, id string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", None, None) for i, t in rows], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_components(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
        s = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets[i] = s
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def made_up(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = " ".join(r.choice(vocab) for _ in range(30))
    rows = []
    for _ in range(n):
        kind = r.random()
        if rows and kind < 0.5:
            base = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.randint(0, 4)):
                base[r.randrange(len(base))] = r.choice(vocab)
            if r.random() < 0.3:
                base = base[: r.randint(1, len(base))]
            text = " ".join(base)
        elif kind < 0.7:
            text = common + " " + " ".join(r.choice(vocab) for _ in range(r.randint(0, 12)))
        else:
            text = " ".join(r.choice(vocab) for _ in range(r.randint(0, 120)))
        rows.append((len(rows) * 3 + 1, text))
    return rows + [(100001, None), (100004, ""), (100007, " \t\n"), (100010, "Solo"), (100013, "solo "), (100016, "SOLO")]


def test_exact_matches_brute_force(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "a b "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 200_000), (9, "X" * 200_000), (8, "x" * 200_000), (None, "a b"), (None, "only")]
    got = {(r.doc_id, r.text_sha256): r for r in mark_exact_duplicates(docs(spark, rows), keep="max").collect()}
    for i, t in rows:
        same = [j for j, u in rows if lower(u) == lower(t)]
        ids = [j for j in same if j is not None]
        r = got[i, hashlib.sha256(lower(t).encode()).hexdigest()]
        assert (r.keep_id, r.group_size, r.kept) == (max(ids) if ids else None, len(same), i == (max(ids) if ids else None))
    left = drop_exact_duplicates(docs(spark, rows), keep="max")
    assert left.columns == docs(spark, rows).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 3, 5, 6, 7, 9]


def test_drop_goes_by_text_not_by_id(spark):
    rows = [(1, "x"), (1, "y"), (2, "x"), (3, "X"), (None, "x"), (None, "X"), (4, "z"), (4, "z"), (None, None), (None, ""), (5, "Y ")]
    for keep, best in (("max", 3), ("min", 1)):
        left = drop_exact_duplicates(docs(spark, rows), keep=keep).collect()
        assert sorted((str(r.doc_id), lower(r.text)) for r in left) == sorted([(str(best), "x"), ("1", "y"), ("4", "z"), ("None", ""), ("5", "y ")])
        kept = {(r.doc_id, r.text_sha256) for r in mark_exact_duplicates(docs(spark, rows), keep=keep).where("kept").collect()}
        assert {(r.doc_id, hashlib.sha256(lower(r.text).encode()).hexdigest()) for r in left} == kept
    assert drop_exact_duplicates(docs(spark, [])).collect() == []


def test_bytes_tell_collisions_of_the_hash_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    from spanforge.llm import exact_dedup as E

    monkeypatch.setattr(E, "content_hash", lambda text: F.unhex(F.left(F.md5(text), F.lit(2))))
    for bound in (1_000_000, 0):
        monkeypatch.setattr(E, "BROADCAST_GROUPS", bound)
        rows = [(i, f"text {i % 700}") for i in range(1000)]
        got = {r.doc_id: (r.keep_id, r.group_size) for r in mark_exact_duplicates(docs(spark, rows), keep="max").collect()}
        assert got == {i: ((i + 700 if i < 300 else i), 1 + (i < 300 or i >= 700)) for i in range(1000)}
        assert sorted(r.doc_id for r in drop_exact_duplicates(docs(spark, rows), keep="min").collect()) == list(range(700))


def test_exact_empty(spark):
    assert mark_exact_duplicates(docs(spark, [])).collect() == []


def test_near_matches_brute_force(spark):
    for size, seed in ((2, 1), (5, 2)):
        rows = made_up(seed, 260)
        want = brute_components(rows, size)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, rows), shingle=size).collect()}
        assert got == want
        assert len(set(c for _, c in want.values())) < len(rows) - 20


def test_near_nulls_repeats_empty(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (2, "A B C D"), (None, "a b c d"), (7, "q")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs(spark, rows), shingle=2).collect()), key=str)
    assert got == sorted([(5, 2, False), (5, 2, False), (2, 2, True), (None, None, True), (7, 7, True)], key=str)
    assert near_duplicates(docs(spark, []), shingle=2).collect() == []
    left = drop_near_duplicates(docs(spark, rows), shingle=2)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "7", "None"]


def test_drop_near_goes_by_id_and_text(spark):
    rows = [(1, "a b c d"), (2, "A B c d"), (2, "quite other words"), (3, "e f g"), (3, "e f g"), (4, "E F G")]
    left = drop_near_duplicates(docs(spark, rows), shingle=2).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, "a b c d"), (2, "quite other words"), (3, "e f g"), (3, "e f g")]


def test_long_lists_go_block_by_block(spark, monkeypatch):
    import spanforge.llm.near_dedup as N

    monkeypatch.setattr(N, "SMALL", 3)
    monkeypatch.setattr(N, "BLOCK", 7)
    rows = made_up(9, 160)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, rows), shingle=2).collect()}
    assert got == brute_components(rows, 2)


def mostly_shared(seed, pairs, n, ordinary):
    """Pairs at similarity 0.8: a text of words that many documents share but for ``ordinary``, and it with a fifth of its own."""
    r = random.Random(seed)
    pool = [f"h{i}" for i in range(2 * n)]
    rows = []
    for p in range(pairs):
        base = r.sample(pool, n * 4 // 5 - ordinary) + [f"o{p}x{i}" for i in range(ordinary)]
        rows += [(2 * p, " ".join(base)), (2 * p + 1, " ".join(base + [f"a{p}x{i}" for i in range(n // 5)]))]
    return rows


def missed(spark, rows, size=1):
    want = brute_components(rows, size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, rows), shingle=size).collect()}
    assert set(got) == set(want)
    return sorted(i for i in want if got[i] != want[i])


def test_few_shared_runs_are_candidates(spark):
    """Documents that share one to three keys with all others together are compared like all others."""
    assert missed(spark, mostly_shared(1, 40, 300, 9)) == []


def test_shared_part_all_hot(spark):
    """Of a full sketch, more values than their share may be a document's own."""
    assert missed(spark, mostly_shared(1, 60, 300, 0)) == []


def test_boilerplate_of_any_share(spark):
    """Sets over k of which 30, 60 and 90 % are passages that all others have too; links at 0.8 and a little above."""
    for share in (30, 60, 90):
        r = random.Random(share)
        passage, rows = [f"p{i}" for i in range(4 * share)], []
        for p in range(60):
            own = [f"o{p}x{i}" for i in range(400 - 4 * share)]
            for j, more in enumerate((0, r.randint(60, 100), r.randint(95, 140))):
                rows.append((3 * p + j, " ".join(passage + own + [f"m{p}x{j}x{i}" for i in range(more)])))
        assert missed(spark, rows) == []
