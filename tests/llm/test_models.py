"""Token counts against greedy matching, classifiers by held-out accuracy, edge cases of their inputs."""

import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest

from spanforge.llm import quality_classifier, queries, toxicity
from spanforge.llm.byte_bpe import load_ranks
from spanforge.llm.token_counts import LongestMatch, count_tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, id string, n_words string"
SF = "/root/testdata/sf0.1"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "old", "x", "y") for i, t in rows], SCHEMA)


def greedy(word, vocabulary, longest):
    n = at = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        n += 1
    return n


def test_automaton_equals_greedy_matching():
    r = random.Random(3)
    for _ in range(30):
        tokens = {bytes([b]) for b in range(256)} | {bytes(r.choice(b"abc") for _ in range(r.randint(2, 7))) for _ in range(r.randint(1, 60))}
        automaton = LongestMatch(tokens)
        for _ in range(60):
            word = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 40)))
            assert automaton.count(word) == greedy(word, tokens, 7)
    with pytest.raises(ValueError):
        LongestMatch([b"a", b"b"])


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = set(load_ranks(path))
    longest = max(map(len, vocabulary))
    r = random.Random(6)
    texts = ["", " \n", "Hello world", "naïve 中文 😀\x1c\x85", "supercalifragilistic " * 3000, "x" * 50_000]
    texts += ["".join(r.choice("the cat sat on-a_mat 19,.é \n\t") for _ in range(r.randint(0, 300))) for _ in range(100)]
    rows = [*enumerate(texts), (999, None), (2, texts[2])]
    got = count_tokens(docs(spark, rows), path).collect()
    assert len(got) == len(rows)
    for x in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", dict(rows)[x.doc_id] or "")
        assert (x.n_words, x.n_tokens) == (len(words), sum(greedy(b" " + w.encode(), vocabulary, longest) for w in words))
    assert count_tokens(docs(spark, []), path).collect() == []


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    label = np.asarray(label, bool)
    return (order[label].sum() - label.sum() * (label.sum() + 1) / 2) / (label.sum() * (~label).sum())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name, label, threshold, least", [("op5_quality_classifier", "quality", 0.3, 0.85), ("op6_toxicity", "toxic", 0.5, 0.9)])
def test_held_out_accuracy(spark, name, label, threshold, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.QUERIES[name](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) in (0, 1)]
    score, predicted, truth = map(np.array, zip(*held))
    assert auc(score, truth) >= least
    assert (predicted == truth).mean() >= max(truth.mean(), 1 - truth.mean()) - 0.05


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_quality_rules_on_held_out_rows(spark):
    """Of labelled documents that the target was not counted from and that pass the base rules, good ones are kept and
    bad ones are not."""
    sf = SF.replace("sf0.1", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op3_quality_rules"](spark, sf).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    seen = [(labels[r.doc_id], r.kept) for r in rows if labels.get(r.doc_id) in (0, 1) and not r.base_failed]
    assert len(seen) > 20 and sum(y == kept for y, kept in seen) >= 0.95 * len(seen)


ROWS = [(1, "a fine text " * 30), (2, None), (3, ""), (4, "you idiot " * 40), (4, "you idiot " * 40), (None, "x"), (5, "long " * 200_000)]


@pytest.mark.parametrize("fit, score", [(quality_classifier.fit, quality_classifier.score_quality), (toxicity.fit, toxicity.score_toxicity)])
def test_scores_of_odd_inputs(spark, fit, score):
    """Null and empty texts score alike; repeated rows too; without labels, or with one label only, scores still come."""
    r = random.Random(1)
    words = lambda kind: " ".join(f"{kind}{r.randint(0, 40)}" for _ in range(60))
    both = [(words("good" if i % 3 else "bad"), int(i % 3 > 0)) for i in range(90)]
    for rows in (both, both[:0], [(t, 1) for t, _ in both[:9]], [(None, 0), ("", 1)]):
        got = score(docs(spark, ROWS), fit(rows)).collect()
        assert len(got) == len(ROWS) and all(0 <= x.score <= 1 for x in got)
        by_id = {}
        for x in got:
            assert by_id.setdefault(x.doc_id, x.score) == x.score
        assert by_id[2] == by_id[3]
    model = fit(both)
    trial = docs(spark, [(i, words("good" if i % 2 else "bad")) for i in range(40)])
    got = {x.doc_id: x.score for x in score(trial, model).collect()}
    assert min(got[i] for i in range(1, 40, 2)) > max(got[i] for i in range(0, 40, 2))
    assert score(docs(spark, []), model).collect() == []


def test_sample_learns_from_allowed_rows_only(spark):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(50)] + [(7, 1, None), (None, 1, 1), (8, None, 1)], "doc_id bigint, quality int, toxic int")
    table = docs(spark, [(i, f"text {i}") for i in range(60)] + [(1, f"text {i}") for i in range(100, 600)])
    sample = lambda rows, learn: quality_classifier.labelled_sample(table, labels, "quality", "doc_id", "text", rows, learn).collect()
    used = sorted((r.id, r.y, r.t) for r in sample(1000, lambda i: ~queries.held_out(i)))
    assert used == [(i, i % 2, "text 1" if i == 1 else f"text {i}") for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    assert len(sample(10, None)) == 10
    many = quality_classifier.labelled_sample(table, labels.where("doc_id = 1"), "quality", "doc_id", "text", 10).collect()
    assert [(r.id, r.t) for r in many] == [(1, "text 1")]  # one row of the 501


@pytest.fixture(scope="module")
def telling(spark):
    """Texts of a label that differ after 100 000 characters only, ids, labels."""
    r = random.Random(8)
    noise = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    rows = [(i, noise(20_000) + " " + " ".join([f"vile{r.randint(0, 9)} scum" if i % 2 else f"kind{r.randint(0, 9)} folk" for _ in range(40)])) for i in range(24)]
    assert all(len(t) > 100_000 and min(t.find("vile"), t.find("kind")) < 0 for _, t in rows)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    return docs(spark, rows), labels


def test_fits_read_whole_texts(spark, telling):
    table, labels = telling
    sample = quality_classifier.labelled_sample(table, labels, "toxic", "doc_id", "text", 100)
    model = toxicity.fit_frame(sample)
    hasher = toxicity.Hasher(model.bits)
    assert model.score(hasher("vile3 scum vile4 scum")) > 0.5 > model.score(hasher("kind3 folk kind4 folk"))
    want = toxicity.fit([(x.t, x.y) for x in sorted(sample.collect(), key=lambda x: (x.h, x.id))])
    assert (model.index == want.index).all() and (model.weight == want.weight).all() and model.bias == pytest.approx(want.bias)


def test_frame_fits_without_rows(spark):
    empty = quality_classifier.labelled_sample(docs(spark, []), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), "quality", "doc_id", "text", 9)
    assert quality_classifier.fit_frame(empty).weights == (0.0, 0.0)
    assert len(toxicity.fit_frame(empty).index) == 0


def ftrl_by_the_book(rows, alpha, beta, l1, l2, epochs, least):
    """One coordinate at a time in dictionaries, as the algorithm is published."""
    from collections import Counter, defaultdict
    from math import exp, sqrt

    seen = Counter(f for x, _ in rows for f in x)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if i != "bias" and abs(z[i]) <= l1:
            return 0.0
        if i == "bias":
            return -z[i] / ((beta + sqrt(n[i])) / alpha)
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            active = [f for f in x if seen[f] >= least] + ["bias"]
            w = {i: weight(i) for i in active}
            g = 1 / (1 + exp(-max(-30, min(30, sum(w.values()))))) - y
            for i in active:
                sigma = (sqrt(n[i] + g * g) - sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if i != "bias" and weight(i)}


def test_ftrl_takes_little_more_memory_than_its_features():
    """An executor's workers share its memory: counting and leaving out rare features must not copy them all."""
    rows, each = 2000, 2000
    flat = np.tile(np.arange(each, dtype=np.int32) * 2, rows)
    flat[each - 1] = 4001  # one text's alone
    ends, labels = np.arange(1, rows + 1) * each, np.arange(rows) % 2
    tracemalloc.start()
    model = toxicity._ftrl(flat, ends, labels, 12, **toxicity.RATES | {"epochs": 1, "l1": 0.0})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.index.tolist() == list(range(0, 2 * each, 2))
    assert peak < flat.nbytes / 2


def test_ftrl_equals_the_book():
    r = random.Random(4)
    rows = [(" ".join(r.choice("abcdefghij") + str(r.randint(0, 9)) for _ in range(30)) + (" vile scum" if i % 3 == 0 else " kind"), int(i % 3 == 0)) for i in range(120)]
    hasher = toxicity.Hasher()
    want = ftrl_by_the_book([(hasher.features(t).tolist(), y) for t, y in rows], **toxicity.RATES)
    model = toxicity.fit(rows)
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(want, rel=1e-4)


def test_features_are_words_pairs_and_skip_pairs():
    hasher = toxicity.Hasher()
    one = lambda t: set(hasher.features(t).tolist())
    assert len(one("a b c d")) == 4 + 3 + 2
    assert one("A b c") - one("a") - one("b") - one("c") - one("a b") - one("b c") == one("a B c") - one("a b") - one("b c")
    assert len((one("a x c") & one("a y c")) - one("a") - one("c")) == 1  # the skip-pair


def test_score_is_the_calibrated_size_difference():
    import zstandard

    r = random.Random(5)
    words = lambda kind: " ".join(f"{kind}{r.randint(0, 40)}" for _ in range(60))
    model = quality_classifier.fit([(words("good" if i % 3 else "bad"), int(i % 3 > 0)) for i in range(120)])
    for t in ["", "x", words("good"), words("bad"), words("other") * 50]:
        size = {}
        for name in ("good", "bad"):
            d = zstandard.ZstdCompressionDict(getattr(model, name))
            d.precompute_compress(level=quality_classifier.LEVEL)
            size[name] = len(zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(t.encode()))
        z = model.weights[0] + model.weights[1] * (size["bad"] - size["good"]) / (len(t.encode()) + 20)
        assert model.score([t.encode()])[0] == pytest.approx(1 / (1 + np.exp(-z)))
    assert model.weights[1] > 0


def test_toxicity_weights_are_few():
    r = random.Random(2)
    rows = [(" ".join(r.choice([*"abcdefghij"]) + str(r.randint(0, 30)) for _ in range(80)) + (" vile scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.fit(rows)
    assert 0 < len(model.index) < 500
    hasher = toxicity.Hasher(model.bits)
    assert model.score(hasher("all fine vile scum here")) > 0.5 > model.score(hasher("all fine here"))
    assert model.score(hasher("")) == model.score(hasher("  ")) == pytest.approx(1 / (1 + np.exp(-model.bias)))
