import random

from pyspark.sql import functions as F

from spanforge.functions import values as V
from spanforge.functions.bytestr import byte_string, matches
from spanforge.operators import intervals as I
from spanforge.operators import redact as R
from spanforge.operators import windows as W

SPAN = "doc_id bigint, ord bigint, start bigint, end bigint, type string, conf double, source string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_windows_cover_every_byte(spark):
    r = random.Random(4)
    for _ in range(12):
        window = r.randint(1, 80)
        stride, least = r.randint(1, window), r.randint(1, window)
        sizes = [(i, r.randint(0, 400)) for i in range(40)]
        d = spark.createDataFrame(sizes, "doc_id bigint, n bigint")
        by = {}
        for x in W.windows(d, F.col("n"), window, stride, least).collect():
            by.setdefault(x.doc_id, []).append((x.start, x.start + x.length))
        for i, n in sizes:
            got = sorted(by.get(i, []))
            if n < least:
                assert not got
                continue
            assert {p for a, z in got for p in range(a, z)} == set(range(n))
            assert len(got) == (1 if n <= window else -(-(n - window) // stride) + 1)
            assert all(z - a >= least for a, z in got)


def test_matches_are_byte_offsets(spark):
    texts = [(1, "é a1 ß22é3"), (2, ""), (3, None), (4, "7")]
    d = spark.createDataFrame(texts, "doc_id bigint, text string").select("doc_id", byte_string(F.col("text")).alias("s"))
    got = {(r.doc_id, r.start, r.end) for r in matches(d, "[0-9]+").collect()}
    assert got == {(1, 4, 5), (1, 8, 10), (1, 12, 13), (4, 0, 1)}


def paint(spans, n):
    """Byte by byte: the owner of each byte of one document."""
    types = {}
    for s in sorted(spans, key=lambda s: s[0]):
        types.setdefault(s[3], s[0])
    union = []
    for t in types:
        for o, a, z, _, c, src in sorted((s for s in spans if s[3] == t), key=lambda s: (s[1], -s[2], s[0])):
            if union and union[-1][2] == t and a < union[-1][1]:
                u = union[-1]
                u[1], u[3] = max(u[1], z), max(u[3], c)
                u[4] |= set(src.split("+"))
            else:
                union.append([a, z, t, c, set(src.split("+"))])
    rank = lambda u: (u[2] in I.VALIDATED and "rules" in u[4], u[3], u[1] - u[0], -types[u[2]], -u[0])
    owner = [max((u for u in union if u[0] <= p < u[1]), key=rank, default=None) for p in range(n)]
    out, p = [], 0
    while p < n:
        q = p
        while q < n and owner[q] is owner[p]:
            q += 1
        if owner[p]:
            out.append((p, q, owner[p][2], owner[p][3], "+".join(sorted(owner[p][4]))))
        p = q
    return out


def random_spans(r, docs):
    rows = []
    for d in range(docs):
        for o in range(r.randint(0, 7)):
            a = r.randint(0, 50)
            rows.append((d, o, a, a + r.randint(1, 20), r.choice(["EMAIL", "NAME", "IP"]), r.choice([0.25, 0.5, 0.75]), r.choice(["model", "rules"])))
    return rows


def test_resolve_equals_painter(spark):
    rows = random_spans(random.Random(8), 120)
    got = {}
    for x in I.resolve(spark.createDataFrame(rows, SPAN)).collect():
        got.setdefault(x.doc_id, []).append((x.start, x.end, x.type, x.conf, x.source))
    for d in range(120):
        assert sorted(got.get(d, [])) == paint([r[1:] for r in rows if r[0] == d], 80)


def test_redaction_round_trip(spark):
    r = random.Random(3)
    rows = [x for x in random_spans(r, 60)]
    texts = [(d, "".join(r.choice("ab c\n9é[]") for _ in range(70))) for d in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").select("doc_id", byte_string(F.col("text")).alias("s")).cache()
    done = R.redact(docs, spark.createDataFrame(rows, SPAN)).cache()
    back = {x.doc_id: (x.s, x.refused) for x in R.restore(done, R.restore_map(done)).collect()}
    assert back == {d: (t.encode().decode("latin-1"), None) for d, t in texts}
    broken = done.withColumn("out", F.concat("out", F.lit("!")))
    assert {x.refused for x in R.restore(broken, R.restore_map(done)).collect()} == {"sha256"}


def test_markers_count_values_above_existing_ones(spark):
    s = "x [EMAIL_7] Ana@b.io ana@B.io bob@b.io"
    docs = spark.createDataFrame([(1, s)], "doc_id bigint, s string")
    spans = spark.createDataFrame([(1, i, a, z, "EMAIL", 0.5, "model") for i, (a, z) in enumerate([(12, 20), (21, 29), (30, 38)])], SPAN)
    assert R.redact(docs, spans).first().out == "x [EMAIL_7] [EMAIL_8] [EMAIL_8] [EMAIL_9]"


def test_vote_by_overlap(spark):
    rows = [(1, "T", 0, 5, 0), (1, "T", 3, 8, 1), (1, "T", 7, 9, 2), (1, "T", 20, 22, 0), (1, "U", 0, 5, 2)]
    d = spark.createDataFrame(rows, "doc_id bigint, type string, start bigint, end bigint, member int")
    got = [(x.type, x.start, x.end, x.votes) for x in I.vote_by_overlap(d, 2).collect()]
    assert sorted(got) == [("T", 0, 5, 2), ("T", 7, 9, 2)]


def test_mask_and_normalise(spark):
    cases = {"": "*", "secret": "******", "12345678": "12******", "a" * 15: "aa" + "*" * 12, "abcdefghijklmnop": "abcd**********op", "é" * 40: "éééé" + "*" * 12 + "éé", "ab\ncd": "** … (2 lines)", "-----BEGIN RSA PRIVATE KEY-----\nx": "-----BEGIN RSA PRIVATE KEY----- … (2 lines)"}
    for text, want in cases.items():
        assert one(spark, V.mask(F.lit(text))) == want
    for kind, value, want in [
        ("EMAIL", " A@B.IO\n", "a@b.io"), ("PHONE", "+34 612 345 678", "612345678"), ("PHONE", "0034 612345678", "612345678"), ("PHONE", "212-555-0123", "2125550123"),
        ("PHONE", "+1 (212) 555-0123", "2125550123"), ("IBAN", "es12 3456-7", "ES1234567"), ("IP", "[::A]", "::a"), ("PERSON_NAME", "  JOSÉ   Müller ", "jose muller"), ("SECRET", "Ab", "Ab"),
    ]:
        assert one(spark, V.normalize_value(F.lit(kind), F.lit(value))) == want


def test_paths(spark):
    soft = ["tests/a.py", "a/Doc/x.c", "a\\MOCK\\b", "README.md", "pkg/test_a.py", "a.test.js", "user_spec.rb", "UserTest.java", "Tests.cs", "test.kt"]
    hard = ["src/latest.py", "Latest.java", "a/b.c", ".md", "contest.js", "test_a.js"]
    d = spark.createDataFrame([(p,) for p in soft + hard], "p string").select("p", V.path_severity(F.col("p")).alias("s"))
    assert {r.p for r in d.collect() if r.s == "warning"} == set(soft)
    rules = ["*.log", "/build/", "a/**/z", "tmp?"]
    d = spark.createDataFrame([(p,) for p in ["x.log", "d/x.log", "build/a", "c/build/a", "a/z", "a/b/c/z", "q/a/z", "tmp1/x", "tmp", "x.logs"]], "p string")
    got = {r.p for r in d.where(V.excluded(F.col("p"), rules)).collect()}
    assert got == {"x.log", "d/x.log", "build/a", "a/z", "a/b/c/z", "tmp1/x"}
