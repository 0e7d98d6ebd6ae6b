"""The queries of the engine over the standard tables, each with the same query for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytestr as B
from ..functions import values as V
from ..operators import heads as H
from ..operators import intervals as I
from ..operators import redact as R
from ..operators import windows as W
from ..operators.prefilter import mark_prefiltered
from ..sinks import reports as S
from ..sources.files import added_lines, on_added_lines
from .fixtures import PAINT, matches_sql, plain_spans, read, spans, spans_sql, texts
from .registry import QUERIES, SQL, query


def _windows_sql(window: int, stride: int, least: int) -> str:
    return f"""win AS (SELECT doc_id, text, n, win, CASE WHEN win = c - 1 AND win > 0 AND n - win * {stride} < {least} THEN n - {window} ELSE win * {stride} END AS start
  FROM (SELECT doc_id, text, strlen(text) AS n, CASE WHEN strlen(text) <= {window} THEN 1 ELSE ceil((strlen(text) - {window}) / {stride}.0)::BIGINT + 1 END AS c,
               unnest(range(CASE WHEN strlen(text) <= {window} THEN 1 ELSE ceil((strlen(text) - {window}) / {stride}.0)::BIGINT + 1 END)) AS win
        FROM documents WHERE strlen(text) >= {least})),
wins AS (SELECT doc_id, text, win, start, least({window}, n - start)::BIGINT AS length FROM win)"""


def _wins(spark, sf_dir, window=512, stride=384, least=24):
    return W.windows(texts(spark, sf_dir), F.length("s"), window, stride, least)


@query(f"WITH {_windows_sql(512, 384, 24)} SELECT doc_id, win, start, length FROM wins")
def windows_documents(spark, sf_dir):
    return _wins(spark, sf_dir).select("doc_id", "win", "start", "length")


@query(f"WITH {_windows_sql(64, 64, 24)} SELECT doc_id, win, start, length FROM wins")
def windows_tail_aligned(spark, sf_dir):
    return _wins(spark, sf_dir, 64, 64, 24).select("doc_id", "win", "start", "length")


@query(
    f"""WITH {_windows_sql(512, 384, 24)}
SELECT doc_id, win, sha256(unhex(substr(hex(encode(text)), (2 * start + 1)::BIGINT, (2 * length)::BIGINT))) AS sha256 FROM wins"""
)
def window_slice_sha256(spark, sf_dir):
    cut = W.slice_of(F.col("s"), F.col("start"), F.col("length"))
    return _wins(spark, sf_dir).select("doc_id", "win", F.sha2(B.to_bytes(cut), 256).alias("sha256"))


@query(
    r"""SELECT doc_id, rpad('?name' || chr(10) || '?value' || chr(10), 24, chr(10)) || left(text, 40) AS payload
FROM documents WHERE strlen(text) = length(text)"""
)
def query_template_prefix(spark, sf_dir):
    ascii_docs = texts(spark, sf_dir).where(~F.col("s").rlike("[\x80-\xff]"))
    return ascii_docs.select("doc_id", F.concat(F.lit(W.query_prefix(["name", "value"], 24)), F.left("s", F.lit(40))).alias("payload"))


@query(
    f"""WITH {_windows_sql(488, 384, 24)}
SELECT doc_id, win, sha256(unhex(hex(encode(rpad('?name' || chr(10) || '?value' || chr(10), 24, chr(10)))) || substr(hex(encode(text)), (2 * start + 1)::BIGINT, (2 * length)::BIGINT))) AS sha256 FROM wins"""
)
def query_template_windows(spark, sf_dir):
    """What a query model of 512 bytes reads: its region of 24 bytes, then each window of all documents."""
    cut = W.slice_of(F.col("s"), F.col("start"), F.col("length"))
    payload = F.concat(F.lit(W.query_prefix(["name", "value"], 24)), cut)
    return _wins(spark, sf_dir, 512 - 24).select("doc_id", "win", F.sha2(B.to_bytes(payload), 256).alias("sha256"))


@query(
    f"""WITH {_windows_sql(512, 384, 24)}, {matches_sql("r", r"[\x20-\x7e\t]{64,}")}
SELECT doc_id, win, NOT EXISTS (SELECT 1 FROM r WHERE r.value IS NOT NULL AND r.doc_id = w.doc_id AND r.start < w.start + w.length AND w.start < r."end") AS skipped FROM wins w"""
)
def prefilter_ascii(spark, sf_dir):
    return mark_prefiltered(_wins(spark, sf_dir), "A64").select("doc_id", "win", "skipped")


@query(
    f"""WITH {_windows_sql(512, 384, 24)}, {matches_sql("r", r"[\x20-\x7e\t]{200,}")}, {matches_sql("q", r"[\x20-\x7e\t]{300,}")}
SELECT doc_id, win, NOT EXISTS (SELECT 1 FROM r WHERE r.value IS NOT NULL AND r.doc_id = w.doc_id AND r.start < w.start + w.length AND w.start < r."end") AS a200,
  NOT EXISTS (SELECT 1 FROM q WHERE q.value IS NOT NULL AND q.doc_id = w.doc_id AND q.start < w.start + w.length AND w.start < q."end") AS d300 FROM wins w"""
)
def prefilter_rules(spark, sf_dir):
    """A slice of 300 bytes that are all printable is a run of 300; no document holds UTF-16 or repeats at a period."""
    d = mark_prefiltered(_wins(spark, sf_dir), "A200+U200").withColumnRenamed("skipped", "a200")
    return mark_prefiltered(d, "D300x300+P2x400").select("doc_id", "win", "a200", F.col("skipped").alias("d300"))


@query("SELECT doc_id, 0::BIGINT AS win, 0::BIGINT AS start, strlen(text)::BIGINT AS length FROM documents WHERE strlen(text) > 0")
def windows_whole(spark, sf_dir):
    return W.whole_windows(texts(spark, sf_dir), F.length("s")).select("doc_id", "win", "start", "length")


@query(
    """WITH b AS (SELECT item_id, list_transform(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ','), ','), lambda x: ('0x' || x)::BIGINT) AS c FROM benchmark),
p AS (SELECT item_id, c, unnest(range(len(c))) AS t FROM b),
v AS (SELECT (((((1007 * 257 + CASE WHEN t >= 2 THEN c[t - 1] ELSE 0 END + 1) % 2147483647) * 257 + CASE WHEN t >= 1 THEN c[t] ELSE 0 END + 1) % 2147483647) * 257 + c[t + 1] + 1) % 2147483647 % 64 AS bucket FROM p)
SELECT bucket::BIGINT AS bucket, count(*) AS n FROM v GROUP BY bucket"""
)
def ngram_bucket_histogram(spark, sf_dir):
    d = read(spark, sf_dir, "benchmark").select(B.byte_string(F.col("text")).alias("s"))
    d = d.select(F.transform(F.filter(F.split("s", ""), lambda x: x != ""), lambda x: F.ascii(x)).alias("c"))
    d = d.select("c", F.posexplode("c").alias("t", "_"))
    return d.select(W.ngram_rows(F.col("c"), F.col("t"), 3, 1, 0, 64).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH b AS (SELECT item_id, list_transform(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ','), ','), lambda x: ('0x' || x)::BIGINT) AS c FROM benchmark),
p AS (SELECT item_id, c, unnest(range(len(c))) AS t FROM b), o AS (SELECT * FROM (VALUES (2, 0, 1), (3, 1, 0), (4, 2, 3)) v(o, i, h)),
v0 AS (SELECT item_id, t, o.o, o.h, c, (1000 * i + 7 + 7919 * h)::BIGINT AS v FROM p, o),
v1 AS (SELECT *, CASE WHEN o >= 4 THEN (v * 257 + CASE WHEN t >= 3 THEN c[t - 2] ELSE 0 END + 1) % 2147483647 ELSE v END AS a FROM v0),
v2 AS (SELECT *, CASE WHEN o >= 3 THEN (a * 257 + CASE WHEN t >= 2 THEN c[t - 1] ELSE 0 END + 1) % 2147483647 ELSE a END AS b FROM v1),
v3 AS (SELECT o, h, (((b * 257 + CASE WHEN t >= 1 THEN c[t] ELSE 0 END + 1) % 2147483647) * 257 + c[t + 1] + 1) % 2147483647 % 1009 AS bucket FROM v2)
SELECT o::INT AS "order", h::INT AS head, bucket::BIGINT AS bucket, count(*) AS n FROM v3 GROUP BY ALL"""
)
def ngram_orders_and_heads(spark, sf_dir):
    d = read(spark, sf_dir, "benchmark").select(B.byte_string(F.col("text")).alias("s"))
    d = d.select(F.transform(F.filter(F.split("s", ""), lambda x: x != ""), lambda x: F.ascii(x)).alias("c"))
    d = d.select("c", F.posexplode("c").alias("t", "_"))
    kinds = [F.struct(F.lit(o).alias("order"), F.lit(h).alias("head"), W.ngram_rows(F.col("c"), F.col("t"), o, i, h, 1009).alias("bucket")) for o, i, h in ((2, 0, 1), (3, 1, 0), (4, 2, 3))]
    return d.select(F.inline(F.array(*kinds))).groupBy("order", "head", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _flags(pattern: str):
    def run(spark, sf_dir):
        m = B.matches(texts(spark, sf_dir), pattern)
        return m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.max("end").alias("last"))

    return run


for _name, _pattern in (("flag_upper_spans", "[A-Z]"), ("flag_digit_spans", "[0-9]")):
    QUERIES[_name] = _flags(_pattern)
    SQL[_name] = f'WITH {matches_sql("m", _pattern)} SELECT doc_id, count(*) AS n, sum(start)::BIGINT AS starts, max("end") AS last FROM m WHERE value IS NOT NULL GROUP BY doc_id'


@query(
    f"""WITH {matches_sql("m", "[0-9]+")},
a AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM m WHERE value IS NOT NULL),
b AS (SELECT *, sum(CASE WHEN start <= pe + 4 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT doc_id, min(start) AS start, max("end") AS "end" FROM b GROUP BY doc_id, g"""
)
def merge_nearby_gap4(spark, sf_dir):
    m = B.matches(texts(spark, sf_dir), "[0-9]+").withColumn("conf", F.lit(1.0)).withColumn("type", F.lit("DIGITS"))
    return I.merge_nearby(m, 4).select("doc_id", "start", "end")


@query(f'WITH {spans_sql()}, {PAINT} SELECT doc_id, type, start, "end", conf, source FROM un')
def same_type_union(spark, sf_dir):
    return I.same_type_union(spans(texts(spark, sf_dir))).select("doc_id", "type", "start", "end", "conf", "source")


@query(f'WITH {spans_sql()}, {PAINT} SELECT doc_id, type, start, "end", conf, source FROM resolved')
def resolve_typed(spark, sf_dir):
    return I.resolve(spans(texts(spark, sf_dir))).select("doc_id", "type", "start", "end", "conf", "source")


@query(
    f"""WITH {spans_sql()}, b AS (SELECT DISTINCT doc_id, unnest(range(start, "end")) AS p FROM spans),
t AS (SELECT DISTINCT doc_id, unnest([start, "end"]) AS p FROM spans),
g AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM b),
h AS (SELECT doc_id, min(p) AS start, max(p) + 1 AS "end" FROM g GROUP BY doc_id, g)
SELECT h.doc_id, h.start, h."end", bool_or(s.base64) AS base64 FROM h JOIN spans s ON s.doc_id = h.doc_id AND s.start >= h.start AND s."end" <= h."end" GROUP BY ALL"""
)
def hidden_merge(spark, sf_dir):
    return I.hidden(spans(texts(spark, sf_dir))).select("doc_id", "start", "end", "base64")


@query(
    f"""WITH {spans_sql()} SELECT a.doc_id, a.ord, a.member, count(DISTINCT b.member) AS votes
FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND a.type = b.type AND b.start < a."end" AND a.start < b."end" GROUP BY ALL"""
)
def vote_members_count(spark, sf_dir):
    return I.vote_counts(spans(texts(spark, sf_dir))).select("doc_id", "ord", "member", "votes")


@query(
    f"""WITH {spans_sql()}, s AS (SELECT doc_id, member, type, "end", start - CASE WHEN member = 1 AND ord % 2 = 0 THEN 3 ELSE 0 END AS start FROM spans)
SELECT doc_id, start, count(DISTINCT member) AS votes, min(member) AS member, arg_min("end", member * 1000000 + "end") AS "end" FROM s GROUP BY doc_id, start HAVING count(DISTINCT member) >= 2"""
)
def vote_by_offset(spark, sf_dir):
    """Two votes are wanted; every other span of the second member is moved back to where the first one's starts."""
    moved = F.when((F.col("member") == 1) & (F.col("ord") % 2 == 0), 3).otherwise(0)
    s = spans(texts(spark, sf_dir)).withColumn("start", F.col("start") - moved)
    return I.vote_by_offset(s, 2).select("doc_id", "start", "votes", "member", "end")


@query(
    f"""WITH RECURSIVE {spans_sql()}, c AS (SELECT a.doc_id, a.type, a.ord, a.start, a.member, a."end", count(DISTINCT b.member) AS votes
  FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND a.type = b.type AND b.start < a."end" AND a.start < b."end" GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY start, member, "end", votes, ord) AS rn FROM c),
f AS (SELECT doc_id, type, 0::BIGINT AS rn, -1::BIGINT AS reach, false AS kept FROM n WHERE rn = 1
  UNION ALL SELECT n.doc_id, n.type, n.rn, CASE WHEN n.start >= f.reach AND n.votes >= 2 THEN n."end" ELSE f.reach END, n.start >= f.reach AND n.votes >= 2
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.type = f.type AND n.rn = f.rn + 1)
SELECT n.doc_id, n.type, n.start, n.member, n."end", n.votes FROM f JOIN n USING (doc_id, type, rn) WHERE f.kept"""
)
def vote_by_overlap(spark, sf_dir):
    return I.vote_by_overlap(spans(texts(spark, sf_dir)), 2).select("doc_id", "type", "start", "member", "end", "votes")


QUESTIONS = ["the", "de", "token ="]


def _attribution_sql() -> str:
    parts = [matches_sql(f"q{i}", q) for i, q in enumerate(QUESTIONS)]
    union = " UNION ALL ".join(f"SELECT doc_id, {i} AS q, '{q}' AS field, start, \"end\" FROM q{i} WHERE value IS NOT NULL" for i, q in enumerate(QUESTIONS))
    return f"""WITH {spans_sql()}, {", ".join(parts)}, o AS ({union}), {matches_sql("nl", chr(10))},
f AS (SELECT b.doc_id, b.ord, b.start, coalesce(max(nl."end"), 0) AS ls FROM base b LEFT JOIN nl ON nl.doc_id = b.doc_id AND nl.value IS NOT NULL AND nl."end" <= b.start GROUP BY ALL)
SELECT f.doc_id, f.ord, arg_max(o.field, o.start * 10 - o.q) AS field FROM f LEFT JOIN o ON o.doc_id = f.doc_id AND o.start >= f.ls AND o."end" <= f.start GROUP BY f.doc_id, f.ord"""


@query(_attribution_sql())
def query_field_attribution(spark, sf_dir):
    return I.field_attribution(plain_spans(texts(spark, sf_dir), ("doc_id", "s")), QUESTIONS).select("doc_id", "ord", "field")


@query(
    f"""WITH {spans_sql()}, l AS (SELECT b.doc_id, b.ord, b.start, b."end", d.text, unhex(substr(hex(encode(d.text)), 1, (2 * b.start)::BIGINT)) AS pre FROM base b JOIN documents d USING (doc_id))
SELECT doc_id, ord, (1 + len(regexp_extract_all(decode(pre), chr(10))))::BIGINT AS line,
       (strlen(regexp_extract(decode(pre), '[^' || chr(10) || ']*$')) + 1)::BIGINT AS col FROM l"""
)
def line_col_locate(spark, sf_dir):
    d = texts(spark, sf_dir)
    f = plain_spans(d, ("doc_id", "s"))
    return f.select("doc_id", "ord", B.line_of(F.col("s"), F.col("start")).alias("line"), B.column_of(F.col("s"), F.col("start")).alias("col"))


@query(
    f"""WITH {spans_sql()}, l AS (SELECT b.doc_id, b.ord, (1 + len(regexp_extract_all(decode(unhex(substr(hex(encode(d.text)), 1, (2 * b.start)::BIGINT))), chr(10))))::BIGINT AS line FROM base b JOIN documents d USING (doc_id))
SELECT doc_id, ord, line FROM l WHERE line BETWEEN 2 AND 3 OR line >= 5"""
)
def added_lines_filter(spark, sf_dir):
    """The ranges come out of a patch, as the engine reads it."""
    patch = "+++ b/doc\n@@ -1 +2,2 @@\n@@ -4,0 +3 @@\n@@ -9,9 +5,900000 @@\n@@ -7,3 +900 @@\n"
    lines = line_col_locate(spark, sf_dir).withColumn("file", F.lit("doc")).withColumn("end_line", F.col("line"))
    return on_added_lines(lines, added_lines(spark, patch)).select("doc_id", "ord", "line")


@query(
    """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(lower(path), '(^|[/\\\\])(test|tests|spec|specs|__tests__|testdata|test-data|fixture|fixtures|jvmtest|androidtest|example|examples|sample|samples|doc|docs|mock|mocks|__mocks__|e2e|cypress)($|[/\\\\])')
  OR regexp_matches(lower(path), '[^/\\\\]\\.(md|markdown|mdx|rst|adoc|asciidoc)$') OR regexp_matches(lower(path), '(^|[/\\\\])test_[^/\\\\]*\\.py$')
  OR regexp_matches(lower(path), '[^/\\\\][._-](test|tests|spec|specs)\\.[a-z0-9]+$') THEN 'warning' ELSE 'error' END AS severity FROM p"""
)
def path_severity_urls(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    return read(spark, sf_dir, "pages").select("page_id", V.path_severity(path).alias("severity"))


FOLDERS = ["src", "tests", "node_modules", "a/Target", "target/x", "docs", "lib/.venv/b", "build.d"]
NAMES = ["app.py", "Makefile", "pic.PNG", "dockerfile.prod", "x.KT", "a.tar.gz", ".env", "notes.md", "UserTest.java", "Latest.java"]
_RULED = f"""WITH f AS (SELECT page_id, list_extract([{", ".join(f"'{x}'" for x in FOLDERS)}], (page_id % 8 + 1)::BIGINT) AS folder, list_extract([{", ".join(f"'{x}'" for x in NAMES)}], (page_id * 7 % 10 + 1)::BIGINT) AS name FROM pages)"""


@query(
    _RULED
    + f""" SELECT page_id, folder || '/' || name AS path, list_contains([{", ".join(f"'{x}'" for x in V.SOURCE_EXTENSIONS)}], regexp_extract(lower(name), '[^.]*$'))
  OR list_contains([{", ".join(f"'{x}'" for x in V.SOURCE_NAMES)}], lower(name)) OR regexp_matches(lower(name), '^(dockerfile|jenkinsfile)') AS source_text,
  len(list_intersect(string_split(folder, '/'), [{", ".join(f"'{x}'" for x in V.DEPENDENCY_FOLDERS)}])) > 0 AS dependency,
  folder[1:3] = 'lib' OR name[-4:] = '.PNG' OR folder[1:4] = 'docs' AS excluded,
  CASE WHEN folder IN ('tests', 'docs') OR name IN ('notes.md', 'UserTest.java') THEN 'warning' ELSE 'error' END AS severity FROM f"""
)
def path_rules(spark, sf_dir):
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    d = read(spark, sf_dir, "pages").select("page_id", pick(FOLDERS, F.col("page_id") % 8).alias("folder"), pick(NAMES, F.col("page_id") * 7 % 10).alias("name"))
    d = d.withColumn("path", F.concat("folder", F.lit("/"), "name"))
    return d.select(
        "page_id",
        "path",
        V.is_source_text_name(F.col("name")).alias("source_text"),
        V.in_dependency_folder(F.col("path")).alias("dependency"),
        V.excluded(F.col("path"), ["*.PNG", "/lib/", "docs/"]).alias("excluded"),
        V.path_severity(F.col("path")).alias("severity"),
    )


@query(
    """SELECT page_id, regexp_matches(url, '(?:^|/)[^/]*1(?:/|$)|(?:^|/)p[^/]/') AS excluded FROM pages"""
)
def exclusions(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", V.excluded(F.col("url"), ["*1", "# comment", "p?/"]).alias("excluded"))


MASK_SQL = """CASE WHEN n >= 16 THEN left(f, 4) || repeat('*', least(n - 6, 12)::BIGINT) || right(f, 2) WHEN n >= 8 THEN left(f, 2) || repeat('*', least(n - 2, 12)::BIGINT)
  ELSE repeat('*', greatest(n, 1)::BIGINT) END || CASE WHEN k > 1 THEN ' … (' || k || ' lines)' ELSE '' END"""


@query(
    f"""WITH d AS (SELECT doc_id, regexp_replace(string_split(text, chr(10))[1], '\\r+$', '') AS f, length(text) - length(replace(text, chr(10), '')) + 1 AS k FROM documents),
e AS (SELECT *, length(f) AS n FROM d) SELECT doc_id, {MASK_SQL} AS masked FROM e"""
)
def mask_values(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", V.mask(F.col("text")).alias("masked"))


@query(
    f"""WITH {spans_sql()}, t AS (SELECT b.doc_id, b.ord, b.start, b."end", strlen(regexp_extract(decode(unhex(substr(hex(encode(d.text)), 1, (2 * b.start)::BIGINT))), '[A-Za-z0-9+/_.~-]*$')) AS l,
  strlen(regexp_extract(decode(unhex(substr(hex(encode(d.text)), (2 * b."end" + 1)::BIGINT))), '^[A-Za-z0-9+/_.~=-]*')) AS r FROM base b JOIN documents d USING (doc_id))
SELECT doc_id, ord, (start - l)::BIGINT AS start, ("end" + r)::BIGINT AS "end" FROM t"""
)
def token_widen(spark, sf_dir):
    d = texts(spark, sf_dir)
    f = plain_spans(d, ("doc_id", "s"))
    left = V.widen_left(F.substr("s", F.lit(1), F.col("start").cast("int")))
    right = V.widen_right(F.substr("s", (F.col("end") + 1).cast("int")))
    return f.select("doc_id", "ord", (F.col("start") - left).alias("start"), (F.col("end") + right).alias("end"))


NORM_SQL = """CASE WHEN type = 'EMAIL' THEN lower(value) WHEN type = 'PHONE' THEN substr(regexp_replace(value, '[^0-9]', '', 'g'), 2) WHEN type = 'CREDIT_CARD' THEN upper(regexp_replace(value, '[\\s.-]', '', 'g'))
  WHEN type = 'IP' THEN lower(trim(value, '[]')) ELSE value END"""


@query(f"WITH {spans_sql()} SELECT doc_id, ord, {NORM_SQL} AS norm FROM base")
def normalize_values(spark, sf_dir):
    return plain_spans(texts(spark, sf_dir)).select("doc_id", "ord", V.normalize_value(F.col("type"), F.col("value")).alias("norm"))


_MARKED = f"""WITH {spans_sql()}, {PAINT},
v AS (SELECT r.*, coalesce(TRY(decode(unhex(substr(hex(encode(d.text)), (2 * start + 1)::BIGINT, (2 * ("end" - start))::BIGINT)))),
        substr(hex(encode(d.text)), (2 * start + 1)::BIGINT, (2 * ("end" - start))::BIGINT)) AS value FROM resolved r JOIN documents d USING (doc_id)),
n AS (SELECT *, CASE WHEN type = 'PHONE' THEN CASE WHEN contains(value, '+') THEN substr(regexp_replace(value, '[^0-9]', '', 'g'), 2) ELSE regexp_replace(value, '[^0-9]', '', 'g') END
        WHEN type = 'EMAIL' THEN lower(trim(value)) WHEN type = 'CREDIT_CARD' THEN upper(regexp_replace(value, '[\\s.-]', '', 'g')) WHEN type = 'IP' THEN lower(value) ELSE value END AS norm FROM v),
k AS (SELECT *, min(start) OVER (PARTITION BY doc_id, type, norm) AS first FROM n),
m AS (SELECT *, '[' || type || '_' || dense_rank() OVER (PARTITION BY doc_id, type ORDER BY first) || ']' AS marker FROM k)"""


@query(
    _MARKED
    + """, o AS (SELECT *, sum(strlen(marker) - ("end" - start)) OVER (PARTITION BY doc_id ORDER BY start) AS g FROM m)
SELECT doc_id, start, "end", marker, ("end" + g - strlen(marker))::BIGINT AS out_start, ("end" + g)::BIGINT AS out_end FROM o"""
)
def redact_markers(spark, sf_dir):
    d = texts(spark, sf_dir)
    return R.markers(d, spans(d)).select("doc_id", "start", "end", "marker", "out_start", "out_end")


@query(
    _MARKED
    + """, o AS (SELECT doc_id, start, "end", marker, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS p FROM m),
q AS (SELECT o.doc_id, string_agg(substr(hex(encode(d.text)), (2 * p + 1)::BIGINT, (2 * (start - p))::BIGINT) || hex(encode(marker)), '' ORDER BY start) AS h, max("end") AS z FROM o JOIN documents d USING (doc_id) GROUP BY o.doc_id)
SELECT d.doc_id, sha256(unhex(coalesce(q.h, '') || substr(hex(encode(d.text)), (2 * coalesce(q.z, 0) + 1)::BIGINT))) AS sha256_out FROM documents d LEFT JOIN q USING (doc_id)"""
)
def redact_output(spark, sf_dir):
    d = texts(spark, sf_dir)
    return R.report(R.redact(d, spans(d))).select("doc_id", "sha256_out")


@query(
    _MARKED
    + """, o AS (SELECT *, sum(strlen(marker) - ("end" - start)) OVER (PARTITION BY doc_id ORDER BY start) AS g, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i,
  substr(hex(encode(text)), (2 * start + 1)::BIGINT, (2 * ("end" - start))::BIGINT) AS raw FROM m JOIN documents USING (doc_id))
SELECT doc_id, 1 AS version, i::INT AS i, marker, ("end" + g - strlen(marker))::BIGINT AS start, ("end" + g)::BIGINT AS "end", base64(unhex(raw)) AS value_b64 FROM o"""
)
def redact_map(spark, sf_dir):
    """The fields of the JSON that a restoration reads."""
    d = texts(spark, sf_dir)
    m = R.restore_map(R.redact(d, spans(d))).select("doc_id", F.from_json("map", R.MAP_TYPE).alias("m"))
    each = m.select("doc_id", F.col("m.version").alias("version"), F.posexplode_outer("m.entries").alias("i", "x")).where("i IS NOT NULL")
    return each.select("doc_id", "version", "i", "x.*")


@query("SELECT doc_id, sha256(text) AS sha256, NULL::VARCHAR AS refused FROM documents")
def restore_roundtrip(spark, sf_dir):
    d = texts(spark, sf_dir)
    back = R.restored(R.restore_map(R.redact(d, spans(d)), keep=("out",)))
    return back.select("doc_id", F.sha2(B.to_bytes(F.col("s")), 256).alias("sha256"), "refused")


def _logits(spark, sf_dir, k=4):
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), F.col("vec_id").alias("win"), F.transform(F.slice("embedding", 1, k), lambda x: x.cast("double")).alias("values"))


_E = "e AS (SELECT label AS key, vec_id AS win, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS v FROM embeddings)"


@query(f"WITH {_E}, b AS (SELECT key, arg_max({{'win': win, 'v': v}}, {{'s': 1 - v[1], 'w': -win}}) AS b FROM e GROUP BY key) SELECT key, b.win AS win, list_position(b.v, list_max(b.v)) - 1 AS label FROM b")
def agg_choice_max(spark, sf_dir):
    return H.choice_max(_logits(spark, sf_dir), "key").select("key", "win", "label")


@query(f"WITH {_E} SELECT key, round(avg(v[1]), 6) AS v0, round(avg(v[2]), 6) AS v1, round(avg(v[3]), 6) AS v2 FROM e GROUP BY key")
def agg_choice_mean(spark, sf_dir):
    m = H.elementwise(_logits(spark, sf_dir), "key")
    return m.select("key", *[F.round(F.get("values", F.lit(i)), 6).alias(f"v{i}") for i in range(3)])


@query(
    f"WITH {_E}, l AS (SELECT key, list_position(v, list_max(v)) - 1 AS label, count(*) AS c FROM e GROUP BY ALL) SELECT key, arg_max(label, c * 100 - label) AS label, max(c) / sum(c) AS share FROM l GROUP BY key"
)
def agg_choice_vote(spark, sf_dir):
    return H.choice_vote(_logits(spark, sf_dir), "key")


@query(f"WITH {_E} SELECT key, round(max(1 / (1 + exp(-v[1]))), 6) AS p0, max(1 / (1 + exp(-v[2]))) >= 0.55 AS on1 FROM e GROUP BY key")
def agg_multilabel(spark, sf_dir):
    p = _logits(spark, sf_dir).withColumn("values", F.transform("values", lambda x: 1 / (1 + F.exp(-x))))
    m = H.elementwise(p, "key", "max")
    return m.select("key", F.round(F.get("values", F.lit(0)), 6).alias("p0"), (F.get("values", F.lit(1)) >= 0.55).alias("on1"))


@query(f"WITH {_E} SELECT key, round(avg(v[1] * 2 + 1), 6) AS mean, round(max(v[1] * 2 + 1), 6) AS most, round(min(v[1] * 2 + 1), 6) AS least FROM e GROUP BY key")
def agg_score(spark, sf_dir):
    s = _logits(spark, sf_dir).withColumn("values", F.array(F.get("values", F.lit(0)) * 2 + 1))
    how = {"mean": "mean", "most": "max", "least": "min"}
    each = [H.elementwise(s, "key", f).select("key", F.round(F.get("values", F.lit(0)), 6).alias(name)) for name, f in how.items()]
    return each[0].join(each[1], "key").join(each[2], "key")


@query(f"WITH {_E}, m AS (SELECT key, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] AS v FROM e GROUP BY key) SELECT key, (list_position(v, list_max(v)) - 1)::BIGINT AS label FROM m")
def agg_choice_mean_label(spark, sf_dir):
    return H.elementwise(_logits(spark, sf_dir), "key").select("key", H.first_argmax(F.col("values")).alias("label"))


@query(f"WITH {_E}, s AS (SELECT key, win, list_transform(v, lambda x: exp(x - list_max(v))) AS x FROM e) SELECT key, win, round(x[1] / list_sum(x), 6) AS p0, round(x[4] / list_sum(x), 6) AS p3 FROM s")
def head_softmax(spark, sf_dir):
    p = _logits(spark, sf_dir).select("key", "win", H.softmax(F.col("values")).alias("p"))
    return p.select("key", "win", *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in (0, 3)])


@query(f"WITH {_E} SELECT key, round(avg(1 / (1 + exp(-v[1]))), 6) AS p0, round(avg(1 / (1 + exp(-v[2]))), 6) AS p1, avg(1 / (1 + exp(-v[1]))) >= 0.5 AS on0 FROM e GROUP BY key")
def agg_multilabel_mean(spark, sf_dir):
    p = _logits(spark, sf_dir).withColumn("values", F.transform("values", lambda x: 1 / (1 + F.exp(-x))))
    m = H.elementwise(p, "key", "mean")
    return m.select("key", *[F.round(F.get("values", F.lit(i)), 6).alias(f"p{i}") for i in range(2)], (F.get("values", F.lit(0)) >= 0.5).alias("on0"))


@query(f"WITH {_E} SELECT key, (round(avg(1 / (1 + exp(-v[1]))), 9) > 0.5)::INT + (round(avg(1 / (1 + exp(-v[2]))), 9) > 0.5)::INT AS level FROM e GROUP BY key")
def agg_ordinal_mean(spark, sf_dir):
    p = _logits(spark, sf_dir, 2).withColumn("values", F.transform("values", lambda x: 1 / (1 + F.exp(-x))))
    m = H.elementwise(p, "key").select("key", F.transform("values", lambda x: F.round(x, 9)).alias("values"))
    return m.select("key", H.ordinal_level(F.col("values")).cast("int").alias("level"))


@query(
    f"WITH {_E}, l AS (SELECT key, win, len(list_filter(v, lambda x: 1 / (1 + exp(-x)) > 0.5)) AS level FROM e) SELECT key, max(level) AS level, arg_max(win, level * 1000000 - win) AS win FROM l GROUP BY key"
)
def agg_ordinal(spark, sf_dir):
    p = _logits(spark, sf_dir).withColumn("values", F.transform("values", lambda x: 1 / (1 + F.exp(-x))))
    return H.ordinal_max(p, "key").select("key", "level", "win")


@query(
    f"""WITH {matches_sql("m", "[A-Za-z]+|[0-9]+|[ ]+")}
SELECT doc_id, start, "end", CASE WHEN value[1] = ' ' THEN 'space' WHEN value[1] BETWEEN '0' AND '9' THEN 'digit' ELSE 'letter' END AS "class" FROM m WHERE value IS NOT NULL"""
)
def byte_map_runs(spark, sf_dir):
    d = texts(spark, sf_dir)
    wins = W.windows(d, F.length("s"), 512, 384, 1)
    parts = wins.select("doc_id", "win", "start", B.to_bytes(W.slice_of(F.col("s"), F.col("start"), F.col("length"))).alias("classes"))
    kinds = ["other", "letter", "digit", "space"]
    table = bytes(1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if b == 32 else 0 for b in range(128)) + bytes(128)
    runs = H.class_regions(parts, table=table, without=0, ordered=True)
    return runs.select("doc_id", "start", "end", F.get(F.array(*map(F.lit, kinds)), F.col("class")).alias("class"))


@query(
    f"""WITH {spans_sql()} SELECT count(*) AS findings, count(DISTINCT doc_id) AS files_with_findings, count(*) FILTER (source = 'rules') AS errors, count(*) FILTER (source <> 'rules') AS warnings FROM spans"""
)
def report_totals(spark, sf_dir):
    found = spans(texts(spark, sf_dir)).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), F.when(F.col("source") == "rules", "error").otherwise("warning").alias("severity"))
    return S.totals(found)


_PRINTED = f"""WITH {spans_sql()}, m AS (SELECT doc_id, ord, type, start, "end", conf, value AS f, length(value) AS n, 1 AS k FROM base), x AS (SELECT doc_id, ord, type, start, "end", conf, {MASK_SQL} AS masked FROM m)"""


def _printed(spark, sf_dir):
    d = plain_spans(texts(spark, sf_dir)).withColumn("masked", V.mask(F.col("value"))).withColumn("file", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    return S.fingerprints(d, ["start", "ord"])


@query(_PRINTED + """ SELECT doc_id, ord, left(sha256('doc%20' || doc_id || chr(10) || masked), 24) || '/' || (row_number() OVER (PARTITION BY doc_id, masked ORDER BY start, ord) - 1) AS fingerprint FROM x""")
def sarif_fingerprints(spark, sf_dir):
    return _printed(spark, sf_dir).select("doc_id", "ord", "fingerprint")


@query(
    _PRINTED
    + """ SELECT type AS rule, 'doc%20' || doc_id AS uri, type || ': ' || masked AS message, start + 1 AS line, left(sha256('doc%20' || doc_id || chr(10) || masked), 24) || '/' || (row_number() OVER (PARTITION BY doc_id, masked ORDER BY start, ord) - 1) AS mark FROM x"""
)
def sarif_results(spark, sf_dir):
    """The fields of each SARIF result, as a reader of the JSON finds them."""
    d = _printed(spark, sf_dir).withColumn("kind", F.col("type")).withColumn("severity", F.lit("error"))
    d = d.withColumn("line", F.col("start") + 1).withColumn("col", F.lit(1)).withColumn("end_line", F.col("start") + 1)
    at = "$.locations[0].physicalLocation"
    field = lambda path: F.get_json_object("value", path)
    return S.sarif_results(d).select(
        field("$.ruleId").alias("rule"), field(f"{at}.artifactLocation.uri").alias("uri"), field("$.message.text").alias("message"),
        field(f"{at}.region.startLine").cast("bigint").alias("line"), F.regexp_extract("value", r'/v1":"([^"]+)"', 1).alias("mark"),
    )


@query(
    f"""WITH {spans_sql()}, r AS (SELECT DISTINCT doc_id FROM base) SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN 'larger than the limit' END AS not_scanned, CASE WHEN d.doc_id % 5 > 0 THEN d.lang END AS lang FROM documents d"""
)
def json_lines(spark, sf_dir):
    """One JSON object a document or failure, read back."""
    d = read(spark, sf_dir, "documents").withColumn("file", F.col("doc_id").cast("string"))
    bad = d.where("doc_id % 5 = 0").select("file", F.lit("larger than the limit").alias("reason"))
    lines = S.json_lines(d.where("doc_id % 5 > 0").select("file", "lang"), bad)
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return lines.select(field("file").cast("bigint").alias("doc_id"), field("not_scanned").alias("not_scanned"), field("lang").alias("lang"))


@query(
    f"""WITH {spans_sql()}, f AS (SELECT DISTINCT b.doc_id FROM base b), l AS (SELECT doc_id, quality FROM labels)
SELECT count(*) FILTER (quality = 0 AND f.doc_id IS NOT NULL) AS tp, count(*) FILTER (quality = 1 AND f.doc_id IS NOT NULL) AS fp, count(*) FILTER (quality = 0 AND f.doc_id IS NULL) AS fn FROM l LEFT JOIN f USING (doc_id)"""
)
def line_rule_score(spark, sf_dir):
    from ..operators.evaluate import line_rule
    d = texts(spark, sf_dir)
    lines = plain_spans(d).select(F.col("doc_id").alias("file"), F.lit(1).cast("bigint").alias("line"))
    units = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("file"), F.col("doc_id").alias("unit"), F.lit(1).cast("bigint").alias("first"), F.lit(9).cast("bigint").alias("last"), (F.col("quality") == 0).alias("positive"))
    return line_rule(units, lines).select("tp", "fp", "fn")


@query(
    f"""WITH {spans_sql()}, g AS (SELECT DISTINCT doc_id, unnest(range(start, "end")) AS p FROM spans WHERE member = 0), p AS (SELECT DISTINCT doc_id, unnest(range(start, "end")) AS p FROM spans WHERE member = 1),
c AS (SELECT (SELECT count(*) FROM p) AS pred, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM p JOIN g USING (doc_id, p)) AS "both")
SELECT pred, gold, "both", round(5 * ("both" / pred) * ("both" / gold) / (4 * ("both" / pred) + "both" / gold), 6) AS f2 FROM c"""
)
def masking_f2(spark, sf_dir):
    from ..operators.evaluate import masking_of_sides

    s = spans(texts(spark, sf_dir)).where("member < 2").withColumn("task", F.lit("all"))
    m = masking_of_sides(s.withColumn("predicted", F.col("member") == 1))
    return m.select("pred", "gold", "both", F.round("f2", 6).alias("f2"))


CATEGORIES = ["Password", "Key:Private Key", "Token", "AWS Client ID", "UUID:Salt", "URL Credentials", "Secret:Other", "Other"]


@query(
    """SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'password' WHEN 1 THEN 'private_key' WHEN 2 THEN 'token_or_auth' WHEN 3 THEN 'provider_pattern'
  WHEN 4 THEN 'uuid_salt_nonce' WHEN 5 THEN 'url_or_basic_auth' WHEN 6 THEN 'generic_key_or_secret' ELSE 'other' END AS family FROM part"""
)
def category_case(spark, sf_dir):
    named = F.get(F.array(*map(F.lit, CATEGORIES)), F.col("p_size") % 8)
    return read(spark, sf_dir, "part").select("p_partkey", V.macro_category(named).alias("family"))


@query(
    """WITH r AS (SELECT doc_id, strlen(text) AS n, unnest([0, 1000, 5000]) AS a0, unnest([40, 1100, 5100]) AS z0 FROM documents),
s AS (SELECT doc_id, n, (greatest(a0 - 768, 0) // 384) * 384 AS a, least(n, z0 + 768) AS z1 FROM r WHERE a0 < n),
t AS (SELECT doc_id, a, least(n, greatest(0, ceil((z1 - 512) / 384.0)::BIGINT) * 384 + 512) AS z FROM s),
u AS (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pz FROM t),
v AS (SELECT *, sum(CASE WHEN a <= pz THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM u)
SELECT doc_id, min(a)::BIGINT AS start, max(z)::BIGINT AS "end" FROM v GROUP BY doc_id, g"""
)
def scan_regions(spark, sf_dir):
    from ..operators.evaluate import scan_regions as regions

    d = read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n"))
    parts = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(z).cast("bigint").alias("z")) for a, z in ((0, 40), (1000, 1100), (5000, 5100))])
    r = d.select("doc_id", "n", F.inline(parts)).where("a < n").select("doc_id", "n", F.col("a").alias("start"), F.col("z").alias("end"))
    return regions(r, 512, 384, 768)
