"""The queries op1 to op10 over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_classifier, toxicity
from .byte_bpe import encode_decode
from .exact_dedup import mark_exact_duplicates
from .licenses import SHINGLE, scan_licenses, templates
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .pii import replace_pii
from .quality_rules import quality_rules
from .token_counts import count_tokens


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op1_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = encode_decode(docs, path, public_tokenizers.PATTERN, decoded_col="decoded")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _labelled(spark, sf_dir, label: str, rows: int) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn_from = lambda i: ~held_out(i)
    return quality_classifier.labelled_sample(documents(spark, sf_dir), labels, label, "doc_id", "text", rows, learn_from)


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def op5_quality_classifier(spark, sf_dir):
    model = quality_classifier.fit_frame(_labelled(spark, sf_dir, "quality", quality_classifier.FIT_ROWS))
    return _scored(quality_classifier.score_quality(documents(spark, sf_dir), model), 0.3)


def toxicity_model(spark, sf_dir) -> toxicity.FtrlModel:
    return toxicity.fit_frame(_labelled(spark, sf_dir, "toxic", toxicity.FIT_ROWS))


def op6_toxicity(spark, sf_dir):
    return _scored(toxicity.score_toxicity(documents(spark, sf_dir), toxicity_model(spark, sf_dir)), 0.5)


def op2_pii_surrogates(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return replace_pii(docs, key="surrogates of the corpus").select("doc_id", "entities", "text")


def op3_quality_rules(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").where(~held_out(F.col("doc_id")))
    return quality_rules(documents(spark, sf_dir), labels.select(F.col("doc_id").alias("id")))


def op4_license_scan(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir))


def op8_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_mix_sources(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir))


def op7_exact_dedup(spark, sf_dir):
    return mark_exact_duplicates(documents(spark, sf_dir), keep="max")


def op10_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), shingle=2, percent=80)


OP7_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                                 WHEN len(w) = 1 THEN w ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

def _op4_sql() -> str:
    """All windows and templates compared exactly; the operator compares those that share a band."""
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in templates().items())
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    shingles = f"list_transform(range(1, greatest(len(w) - {SHINGLE - 2}, 1)), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))"
    return f"""
WITH t0(license, body) AS (VALUES {rows}),
t1 AS (SELECT license, {words.format("body")} AS w FROM t0),
t AS (SELECT license, len(w) AS n, unnest(list_distinct({shingles})) AS s FROM t1),
z AS (SELECT license, count(*) AS size FROM t GROUP BY license),
d1 AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
d2 AS (SELECT doc_id, {shingles} AS s FROM d1),
h AS (SELECT * FROM (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS j FROM d2) WHERE s IN (SELECT s FROM t)),
a AS (SELECT DISTINCT h.doc_id, h.j, t.n FROM h JOIN t USING (s)),
c AS (SELECT a.doc_id, a.j, t.license, count(DISTINCT h.s) AS same FROM a JOIN h ON h.doc_id = a.doc_id AND h.j BETWEEN a.j AND a.j + a.n - {SHINGLE}
      JOIN t ON t.s = h.s AND t.n = a.n GROUP BY ALL),
f AS (SELECT c.doc_id, c.license, c.j, c.same / z.size AS share FROM c JOIN z USING (license) WHERE 100 * c.same >= 80 * z.size),
b AS (SELECT doc_id, license, max(share) AS containment, count(*) AS windows FROM f GROUP BY ALL)
SELECT b.doc_id, b.license, b.containment, min(f.j)::BIGINT AS word, b.windows FROM b JOIN f ON f.doc_id = b.doc_id AND f.license = b.license AND f.share = b.containment GROUP BY ALL
"""


def _op8_sql() -> str:
    """Greedy pieces of each distinct word, longest first, as hexadecimal prefixes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return rf"""
WITH RECURSIVE v AS (SELECT hex(from_base64(t)) AS t FROM read_csv('{path}', delim=' ', header=false, quote='', escape='', columns={{'t': 'VARCHAR', 'r': 'INT'}})),
lengths AS (SELECT DISTINCT length(t) AS n FROM v),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT DISTINCT unnest(w) AS word FROM d),
r AS (SELECT word, hex(encode(' ' || word)) AS h, 1::BIGINT AS pos, 0::BIGINT AS n FROM words
  UNION ALL SELECT word, h, pos + size, n + 1 FROM (
    SELECT r.word, r.h, r.pos, r.n, max(l.n) AS size FROM r JOIN lengths l ON l.n <= length(r.h) - r.pos + 1 JOIN v ON v.t = substr(r.h, r.pos, l.n) GROUP BY ALL)),
c AS (SELECT word, max(n) AS n FROM r GROUP BY word),
e AS (SELECT doc_id, unnest(w) AS word FROM d),
s AS (SELECT doc_id, count(*) AS n_words, sum(c.n)::BIGINT AS n_tokens FROM e JOIN c USING (word) GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(s.n_tokens, 0)::BIGINT AS n_tokens FROM d LEFT JOIN s USING (doc_id)
"""


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_quality_rules": op3_quality_rules,
    "op4_license_scan": op4_license_scan,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_mix_sources": op9_mix_sources,
    "op7_exact_dedup": op7_exact_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

ORACLE_SQL = {"op4_license_scan": _op4_sql(), "op8_token_counts": _op8_sql(), "op7_exact_dedup": OP7_SQL, "op10_minhash_near_dedup": OP10_SQL}
