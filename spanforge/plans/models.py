"""Queries of models, archives and streams whose answers SQL knows: a model that flags bytes of a class, archives made of
documents, chunks of their bytes."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import Detector, Request
from ..functions import bytestr as B
from ..model import gguf
from ..model.run import Options, head_values, run_streams, run_windows, scan_documents, spans, window_totals
from ..operators import heads as H
from ..operators import windows as W
from ..sources.archives import expand_archives, give_back
from ..streaming.chunks import chunks
from .catalog import _windows_sql
from .fixtures import matches_sql, read, texts
from .registry import query

ARCH = "flags"
CAPITALS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def flag_model(classes: tuple[bytes, ...] = (CAPITALS, DIGITS), window: int = 512, stream: bool = False) -> bytes:
    """A model whose answers are known: it tags each byte of a class as a span of its own, says which class each byte has,
    and whether a window holds one. Every class has a direction of its own in the hidden states, and nothing else does
    anything."""
    n = len(classes)
    d = 4 * -(-(n + 1) // 4)
    meta = {
        "general.architecture": ARCH, f"{ARCH}.format_version": 3, f"{ARCH}.d_model": d, f"{ARCH}.n_layers": 1, f"{ARCH}.n_heads": 1, f"{ARCH}.d_head": 2,
        f"{ARCH}.d_state": 2, f"{ARCH}.n_groups": 1, f"{ARCH}.conv_width": 2, f"{ARCH}.window.size": window, f"{ARCH}.window.min": 1, f"{ARCH}.block.0.direction": "causal",
        f"{ARCH}.head.count": 3, f"{ARCH}.head.0.type": "choice", f"{ARCH}.head.0.pooling": "max", f"{ARCH}.head.1.type": "tag", f"{ARCH}.head.1.labels": [f"C{i}" for i in range(n)], f"{ARCH}.head.2.type": "byte_map",
    }
    if stream:
        meta[f"{ARCH}.context"] = "stream"
    zero = lambda *s: np.zeros(s, np.float32)
    at = "blocks.0."
    channels = 2 + 2 * 2
    t = {"embed.weight": np.tile(np.eye(d, dtype=np.float32)[n], (256, 1)), "out_norm.weight": np.ones(d, np.float32), at + "norm.weight": np.ones(d, np.float32)}
    for i, members in enumerate(classes):
        t["embed.weight"][list(members)] = np.eye(d)[i]
    t |= {at + "in_proj.weight": zero(2 + channels, d), at + "dt_proj.weight": zero(1, d), at + "dt_bias": zero(1), at + "A_log": zero(1), at + "D": zero(1), at + "conv1d.weight": zero(channels, 1, 2)}
    t |= {at + "conv1d.bias": zero(channels), at + "gated_norm.weight": np.ones(2, np.float32), at + "out_proj.weight": zero(d, 2)}
    # the head of windows: class 0 without a byte of the first class, else class 1; through a SiLU, so well apart
    t |= {"heads.0.mlp.0.weight": zero(2, d), "heads.0.mlp.0.bias": zero(2), "heads.0.mlp.2.weight": zero(2, 2), "heads.0.mlp.2.bias": np.array([5, 0], np.float32)}
    t["heads.0.mlp.0.weight"][0, 0] = 10
    t["heads.0.mlp.2.weight"][1, 0] = 10
    tag, classes_of = zero(1 + 4 * n, d), zero(1 + n, d)
    tag[0, n] = classes_of[0, n] = 20
    for i in range(n):
        tag[4 + 4 * i, i] = classes_of[1 + i, i] = 20
    return gguf.build(meta, t | {"heads.1.proj.weight": tag, "heads.1.proj.bias": zero(1 + 4 * n), "heads.2.proj.weight": classes_of, "heads.2.proj.bias": zero(1 + n)})


_FLAGS = f"""{matches_sql("a", "[A-Z]")}, {matches_sql("b", "[0-9]")},
f AS (SELECT doc_id, start, "end", 'C0' AS type FROM a WHERE value IS NOT NULL UNION ALL SELECT doc_id, start, "end", 'C1' FROM b WHERE value IS NOT NULL)"""


def _scanned(spark, sf_dir, **options) -> DataFrame:
    return scan_documents(texts(spark, sf_dir), flag_model(), options=Options(**options))


@query(f'WITH {_FLAGS} SELECT doc_id, start, "end", type FROM f')
def model_spans(spark, sf_dir):
    """Spans of the tag head over all windows, each byte once."""
    return spans(_scanned(spark, sf_dir), ["C0", "C1"]).select("doc_id", "start", "end", "type").distinct()


@query(f"""WITH {_windows_sql(512, 384, 1)} SELECT doc_id, win, regexp_matches(text[(start + 1)::BIGINT:(start + length)::BIGINT], '[A-Z]')::INT AS label FROM wins WHERE strlen(text) = length(text)""")
def model_choice_labels(spark, sf_dir):
    """Whether each window of the ASCII documents holds a capital, as the choice head says."""
    d = texts(spark, sf_dir).where(~F.col("s").rlike("[\x80-\xff]"))
    r = scan_documents(d, flag_model())
    return head_values(r, 0).select("doc_id", "win", F.col("label").cast("int").alias("label"))


@query(
    f"""WITH {_windows_sql(512, 384, 1)}, {_FLAGS}, c AS (SELECT w.doc_id, w.win, count(f.start) FILTER (f.type = 'C0') AS capitals FROM wins w LEFT JOIN f ON f.doc_id = w.doc_id AND f.start >= w.start AND f.start < w.start + w.length GROUP BY ALL)
SELECT doc_id, count(*) AS windows, count(*) FILTER (capitals > 0) AS positive FROM c GROUP BY doc_id"""
)
def model_window_totals(spark, sf_dir):
    return window_totals(_scanned(spark, sf_dir)).select("doc_id", "windows", "positive")


@query(f"WITH {_FLAGS} SELECT d.doc_id, (count(f.start) > 0)::BIGINT AS label FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id AND f.type = 'C0' WHERE strlen(text) > 0 GROUP BY d.doc_id")
def model_choice_by_document(spark, sf_dir):
    """The choice head's answer for whole documents: the window that is surest of a capital decides."""
    r = head_values(_scanned(spark, sf_dir), 0).select("doc_id", "win", F.transform("values", lambda x: x.cast("double")).alias("values"))
    return H.choice_max(r, "doc_id").select("doc_id", "label")


@query(
    f"""WITH {matches_sql("m", "[A-Z]+|[0-9]+|[^A-Z0-9]+")} SELECT doc_id, start, "end", CASE WHEN regexp_matches(value, '^[A-Z]') THEN 1 WHEN regexp_matches(value, '^[0-9]') THEN 2 ELSE 0 END AS "class" FROM m WHERE value IS NOT NULL"""
)
def model_byte_map(spark, sf_dir):
    """Regions of one class of byte, from the byte map of each window."""
    own = _scanned(spark, sf_dir).select("doc_id", "win", "start", F.explode("heads").alias("h")).where("h.head = 2")
    return H.class_regions(own.select("doc_id", "win", "start", F.col("h.classes").alias("classes")), ordered=True)


@query(
    f"""WITH {_windows_sql(512, 384, 1)}, {matches_sql("r", r"[\x20-\x7e\t]{400,}")}
SELECT doc_id, win, (NOT EXISTS (SELECT 1 FROM r WHERE r.value IS NOT NULL AND r.doc_id = w.doc_id AND r.start < w.start + w.length AND w.start < r."end"))::INT AS flags FROM wins w"""
)
def model_skipped_windows(spark, sf_dir):
    """The flag of windows that a prefilter kept from the model."""
    return _scanned(spark, sf_dir, prefilter="A400").select("doc_id", "win", "flags")


@query(f'WITH {_FLAGS} SELECT doc_id, start, "end", type FROM f')
def model_stream_spans(spark, sf_dir):
    """The same bytes as chunks of 4096 with carried state."""
    parts = chunks(texts(spark, sf_dir).select("doc_id", B.to_bytes(F.col("s")).alias("content")), 4096)
    return spans(run_streams(parts, flag_model(stream=True)), ["C0", "C1"]).select("doc_id", "start", "end", "type")


@query(f'WITH {_windows_sql(512, 384, 1)} SELECT doc_id, win, start, length::INT AS length, 3 AS heads FROM wins')
def model_window_results(spark, sf_dir):
    """One row a window, of windows that the caller cut."""
    wins = W.windows(texts(spark, sf_dir), F.length("s"), 512, 384, 1)
    wins = wins.withColumn("content", B.to_bytes(W.slice_of(F.col("s"), F.col("start"), F.col("length"))))
    return run_windows(wins, flag_model()).select("doc_id", "win", "start", "length", F.size("heads").alias("heads"))


def _documents(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


_LINED = f"""{matches_sql("b", "[0-9]")}, l AS (SELECT b.*, 'C0' AS type, unhex(substr(hex(encode(d.text)), 1, (2 * b.start)::BIGINT)) AS pre FROM b JOIN documents d USING (doc_id) WHERE b.value IS NOT NULL)"""


@query(
    f"""WITH {_LINED} SELECT doc_id, start, "end", type AS kind, 'error' AS severity, (1 + len(regexp_extract_all(decode(pre), chr(10))))::BIGINT AS line,
  (strlen(regexp_extract(decode(pre), '[^' || chr(10) || ']*$')) + 1)::BIGINT AS col, (length(regexp_extract(decode(pre), '[^' || chr(10) || ']*$')) + 1)::BIGINT AS "column", '*' AS snippet_masked FROM l"""
)
def detector_findings(spark, sf_dir):
    """Findings of a detector without rules, with their places in bytes and in characters."""
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(_shared(spark))
    found = Detector([flag_model((DIGITS, b""))], "none").detect(_documents(spark, sf_dir))
    return found.findings.select("doc_id", "start", "end", "kind", "severity", "line", "col", "column", "snippet_masked")


@query(
    f"""WITH {_FLAGS}, {matches_sql("k", "[0-9]")} SELECT d.doc_id, count(k.start) > 0 AS positive FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.value IS NOT NULL GROUP BY d.doc_id"""
)
def detector_decisions(spark, sf_dir):
    """Whether two of three models find anything: one flags digits, one capitals and digits, one nothing else."""
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(_shared(spark))
    three = [flag_model((c, b"")) for c in (DIGITS, CAPITALS + DIGITS, b"\x7f")]
    return Detector(three, "none").decide(_documents(spark, sf_dir), Request(votes=2))


@query(
    f"""WITH {matches_sql("m", "[0-9]")}, v AS (SELECT *, min(start) OVER (PARTITION BY doc_id, value) AS first FROM m WHERE value IS NOT NULL),
k AS (SELECT *, '[C1_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY first) || ']' AS marker FROM v),
o AS (SELECT doc_id, start, "end", marker, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS p FROM k),
q AS (SELECT o.doc_id, string_agg(substr(hex(encode(d.text)), (2 * p + 1)::BIGINT, (2 * (start - p))::BIGINT) || hex(encode(marker)), '' ORDER BY start) AS h, max("end") AS z FROM o JOIN documents d USING (doc_id) GROUP BY o.doc_id)
SELECT d.doc_id, sha256(unhex(coalesce(q.h, '') || substr(hex(encode(d.text)), (2 * coalesce(q.z, 0) + 1)::BIGINT))) AS sha256_out FROM documents d LEFT JOIN q USING (doc_id)"""
)
def detector_redaction(spark, sf_dir):
    """Copies of documents by what a model finds in them; capitals are found but not asked for."""
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(_shared(spark))
    out = Detector([flag_model()], "redact").redact(_documents(spark, sf_dir).drop("file"), types="C1")
    return out.select("doc_id", F.sha2("content", 256).alias("sha256_out"))


def _shared(spark) -> str:
    """``spark.checkpoint.dir``; a folder of our own in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spanforge-")
    return found


# --- archives ---------------------------------------------------------------------------------------------------------


def _packed(kind: int, name: str, body: bytes) -> bytes:
    """A zip, a gzip, a tar, a zip in a gzip'ed tar, or the plain bytes."""
    out = io.BytesIO()
    if kind in (0, 3):
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("dir/", b"")
            z.writestr(f"dir/{name}", body)
        if kind == 0:
            return out.getvalue()
        return gzip.compress(_tar("in.zip", out.getvalue()), mtime=0)
    return {1: gzip.compress(body, mtime=0), 2: _tar(f"a/{name}", body), 4: body}[kind]


def _tar(name: str, body: bytes) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        entry = tarfile.TarInfo(name)
        entry.size = len(body)
        t.addfile(entry, io.BytesIO(body))
    return out.getvalue()


def archives(spark, sf_dir) -> DataFrame:
    """(path, content): each document in an archive of one of five kinds, by its id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    ids, paths, bodies = (c.to_pylist() for c in batch.slice(at, 64).columns)
                    made = [_packed(i % 5, f"{i}.txt", b) for i, b in zip(ids, bodies)]
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], names=["path", "content"])
        finally:
            give_back()

    end = F.get(F.array(*map(F.lit, (".zip", ".gz", ".tar", ".tgz", ".txt"))), (F.col("doc_id") % 5).cast("int"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), end).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    return d.mapInArrow(pack, "path string, content binary")


@query(
    """SELECT doc_id || list_extract(['.zip', '.gz', '.tar', '.tgz', '.txt'], (doc_id % 5 + 1)::BIGINT) AS file,
  list_extract([doc_id || '.zip!/dir/' || doc_id || '.txt', doc_id || '.gz!/' || doc_id, doc_id || '.tar!/a/' || doc_id || '.txt', doc_id || '.tgz!/' || doc_id || '.tar!/in.zip!/dir/' || doc_id || '.txt', doc_id || '.txt'], (doc_id % 5 + 1)::BIGINT) AS path,
  sha256(text) AS sha256 FROM documents WHERE strlen(text) > 0"""
)
def archive_members(spark, sf_dir):
    """Every document out of its archive, whole and under its name."""
    found = expand_archives(archives(spark, sf_dir)).where("failure IS NULL AND octet_length(content) > 0")
    return found.select("file", "path", F.sha2("content", 256).alias("sha256"))


@query("SELECT doc_id || '.zip' AS file, 'broken or too large' AS failure FROM documents WHERE doc_id % 5 = 0 AND strlen(text) > 3000")
def archive_budgets(spark, sf_dir):
    """Zip members of more than 3000 bytes are failures, not errors."""
    from ..sources.archives import Limits

    d = archives(spark, sf_dir).where(F.col("path").endswith(".zip"))
    return expand_archives(d, Limits(member=3000)).where("failure IS NOT NULL").select("file", "failure")


@query(
    """WITH c AS (SELECT doc_id, text, unnest(range(ceil(strlen(text) / 700.0)::BIGINT)) AS seq, ceil(strlen(text) / 700.0)::BIGINT AS n FROM documents WHERE strlen(text) > 0)
SELECT doc_id, seq, seq = n - 1 AS last, sha256(unhex(substr(hex(encode(text)), (1400 * seq + 1)::BIGINT, 1400))) AS sha256 FROM c"""
)
def byte_chunks(spark, sf_dir):
    parts = chunks(texts(spark, sf_dir).select("doc_id", B.to_bytes(F.col("s")).alias("content")), 700)
    return parts.select("doc_id", "seq", "last", F.sha2("content", 256).alias("sha256"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 5000 THEN 'larger than the limit' END AS reason FROM documents WHERE strlen(text) > 0 AND doc_id % 7 > 0")
def selected_inputs(spark, sf_dir):
    """Documents as files: empty ones skipped, excluded ones dropped, large ones failures."""
    from ..sources.files import from_column, select_inputs

    d = read(spark, sf_dir, "documents")
    d = d.withColumn("name", F.concat(F.when(F.col("doc_id") % 7 == 0, "skip/").otherwise("src/"), F.col("doc_id").cast("string"), F.lit(".py")))
    good, bad = select_inputs(from_column(d, "name", "text"), 5000, ["/skip/"], True)
    number = lambda c: F.regexp_extract(c, r"(\d+)\.py$", 1).cast("bigint").alias("doc_id")
    return good.select(number("path"), F.lit(None).cast("string").alias("reason")).union(bad.select(number("file"), "reason"))

