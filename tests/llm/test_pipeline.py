"""The five stages, each on its own input, against brute force."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm.byte_bpe import load_ranks
from spanforge.llm.mixing import source_targets
from spanforge.llm.queries import QUERIES

from test_dedup import brute_components, lower

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of each stage's input and, last, of the result."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs.collect())
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    return [*out, docs.collect()]


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_toxicity_stage(spark, stages):
    """Exactly the documents that op6 predicts go."""
    bad = {r.doc_id for r in QUERIES["op6_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert ids(stages[1]) == ids(r for r in stages[0] if r.doc_id not in bad)


def test_exact_stage(stages):
    keep = {}
    for r in stages[1]:
        keep[lower(r.text)] = max(r.doc_id, keep.get(lower(r.text), r.doc_id))
    assert ids(stages[2]) == Counter(keep.values())


def test_near_stage(stages):
    found = brute_components([(r.doc_id, r.text) for r in stages[2]], 5)
    assert ids(stages[3]) == Counter({c for _, c in found.values()})
    assert len(stages[3]) < len(stages[2])


def test_mix_stage(stages):
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in stages[3]}
    source = {r.doc_id: r.source for r in stages[3]}
    times = ids(stages[4])
    assert set(times) <= set(size) and max(times.values()) <= 3
    assert all(times[i] == 1 for i, n in size.items() if n == 0)
    sizes, got, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, n in size.items():
        sizes[source[i]] += n
        got[source[i]] += n * times[i]
        most[source[i]] = max(most[source[i]], n)
    for s, want in source_targets(list(sizes.items()), (5, 2, 1), 3).items():  # whole documents are repeated, so one counts
        assert abs(got[s] - want) <= 0.02 * want + 2 * most[s]


def test_encode_stage(stages):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert ids(stages[5]) == ids(stages[4])
    text = {r.doc_id: r.text or "" for r in stages[4]}
    for r in stages[5]:
        want = plain.encode_ordinary(text[r.doc_id])
        assert r.token_ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages(spark, stages):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()
    assert Counter(got) == Counter((r.doc_id, r.ids_sha256) for r in stages[5])
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"spanforge-mix"}  # what the last stage reads


def test_stages_on_nulls_repeats_and_nothing(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b c d e f g " * 30, "en", "a", 1), (3, "a b c d e f g " * 30, "en", "a", 1), (None, "some words of a text", None, "b", 9)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).count()
    kept = corpus_pipeline.exact_dedup(spark, spark.createDataFrame(odd, schema), SF)
    assert sorted(str(r.doc_id) for r in kept.select(F.col("doc_id")).collect()) == ["2", "3", "None"]  # a text stays once
