"""Scores of findings: the line rule, precision and recall, masked characters, regions to scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands


def line_rule(units: DataFrame, lines: DataFrame) -> DataFrame:
    """tp, fp, fn, outside, precision, recall, f1. ``units``: file, unit, first, last, positive; ``lines``: file, line of
    findings. A flagged line in positive units counts them once each; only a line in none counts negative ones."""
    flagged = lines.select("file", "line").distinct()
    met = flagged.join(units, "file", "left").withColumn("hit", F.coalesce(F.col("line").between(F.col("first"), F.col("last")), F.lit(False)))
    # one pass over the findings: what a line meets is known in its rows, and a line in no unit is counted in its first
    w, own = Window.partitionBy("file", "line"), F.col("positive").cast("int")
    met = met.withColumn("best", F.max(F.when(F.col("hit"), own)).over(w)).withColumn("n", F.row_number().over(w.orderBy("unit")))
    none, yes = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    hits = met.select("file", "unit", none.alias("pos"), none.alias("neg"), F.coalesce(F.col("hit") & (own == F.col("best")), F.lit(False)).alias("used"), (F.col("best").isNull() & (F.col("n") == 1)).cast("bigint").alias("outside"))
    each = units.select("file", "unit", F.when(F.col("positive"), yes).otherwise(none).alias("pos"), F.when(~F.col("positive"), yes).otherwise(none).alias("neg"), F.lit(False).alias("used"), none.alias("outside"))
    scored = hits.unionByName(each).groupBy("file", "unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bool_or("used").alias("used"), F.sum("outside").alias("outside"))
    scored = scored.withColumn("used", F.col("used") & F.col("unit").isNotNull())
    total = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0)).cast("bigint")
    used = F.col("used")
    both = scored.agg(total("pos", used).alias("tp"), total("neg", used).alias("fp"), total("pos", ~used).alias("fn"), total("outside", F.lit(True)).alias("outside"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return both.select("*", zero(p).alias("precision"), zero(r).alias("recall"), zero(F.try_divide(2 * p * r, p + r)).alias("f1"))


def merged(spans: DataFrame) -> DataFrame:
    d = islands(spans.select("task", "doc_id", "start", "end"), ["task", "doc_id"], F.col("start") <= F.col("reach"))
    return d.groupBy("task", "doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def masking_score(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """task, pred, gold, both (characters), precision, recall, f1, f2 of spans (task, doc_id, start, end)."""
    side = lambda d, predicted: d.select("task", "doc_id", "start", "end", F.lit(predicted).alias("predicted"))
    return masking_of_sides(side(gold, False).unionByName(side(pred, True)))


def masking_of_sides(spans: DataFrame) -> DataFrame:
    """``masking_score`` of gold and predicted spans together (task, doc_id, start, end, predicted).

    One shuffle, by document: a span covers what lies beyond the furthest end before it, among its side's spans and among
    all; what both sides cover is what they cover each less what they cover together."""
    at = F.struct("start", "end")
    before = lambda *by: F.max("end").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    d = spans.select("task", "doc_id", "start", "end", "predicted").repartition("task", "doc_id")
    d = d.withColumn("own", before("task", "doc_id", "predicted")).withColumn("all", before("task", "doc_id"))
    new = lambda c: F.greatest(F.col("end") - F.greatest("start", F.coalesce(c, "start")), F.lit(0))
    d = d.groupBy("task").agg(*[F.sum(F.when(F.col("predicted") == p, new("own")).otherwise(0)).alias(c) for c, p in (("pred", True), ("gold", False))], F.sum(new("all")).alias("together"))
    d = d.select("task", "pred", "gold", (F.col("pred") + F.col("gold") - F.col("together")).alias("both"))
    d = d.na.fill(0)
    pr, rc = F.coalesce(F.try_divide("both", "pred"), F.lit(0.0)), F.coalesce(F.try_divide("both", "gold"), F.lit(0.0))
    f = lambda b: F.coalesce(F.try_divide((1 + b * b) * pr * rc, b * b * pr + rc), F.lit(0.0))
    return d.select("task", "pred", "gold", "both", pr.alias("precision"), rc.alias("recall"), f(1).alias("f1"), f(2).alias("f2"))


def scan_regions(ranges: DataFrame, window: int, stride: int, margin: int) -> DataFrame:
    """(doc_id, start, end) that give a scan the windows it would see around ranges (doc_id, n, start, end)."""
    a = F.floor(F.greatest(F.col("start") - margin, F.lit(0)) / stride) * stride
    z = F.least("n", F.col("end") + margin)
    z = F.least(F.col("n"), F.greatest(F.lit(0), F.ceil((z - window) / stride)) * stride + window)
    d = ranges.select("doc_id", a.cast("bigint").alias("start"), z.cast("bigint").alias("end"))
    d = islands(d, ["doc_id"], F.col("start") <= F.col("reach"))
    return d.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def per_repository(units: DataFrame, lines: DataFrame) -> DataFrame:
    """(repository, tp, fp, fn) by the line rule; ``units`` also have ``repository``. What a resampling draws from."""
    flagged = lines.select("file", "line").distinct()
    met = flagged.join(units, "file").where(F.col("line").between(F.col("first"), F.col("last")))
    best = met.groupBy("file", "line").agg(F.max(F.col("positive").cast("int")).alias("best"))
    used = met.join(best, ["file", "line"]).where(F.col("positive").cast("int") == F.col("best")).select("file", "unit").distinct()
    scored = units.join(used.withColumn("used", F.lit(True)), ["file", "unit"], "left").withColumn("used", F.col("used").isNotNull())
    return scored.groupBy("repository").agg(
        F.count_if(F.col("positive") & F.col("used")).alias("tp"),
        F.count_if(~F.col("positive") & F.col("used")).alias("fp"),
        F.count_if(F.col("positive") & ~F.col("used")).alias("fn"),
    )


def f1_score(tp, fp, fn):
    """F1 of counts, 0 without any: (2 tp) / (2 tp + fp + fn)."""
    import numpy as np

    tp, fp, fn = (np.asarray(x, float) for x in (tp, fp, fn))
    precision = np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)
    recall = np.divide(tp, tp + fn, out=np.zeros_like(tp), where=tp + fn > 0)
    both = precision + recall
    return np.divide(2 * precision * recall, both, out=np.zeros_like(tp), where=both > 0)


def resamples(repositories: int, samples: int = 1000, seed: int = 7):
    """How often each of ``repositories`` is in each resample: draws with replacement of the standard generator, in its
    order. One row a resample; repositories are few, documents never come here."""
    import random

    import numpy as np

    r = random.Random(seed)
    draws = [[r.randrange(repositories) for _ in range(repositories)] for _ in range(samples)]
    return np.stack([np.bincount(d, minlength=repositories) for d in draws])


def interval(values, samples: int) -> list[float]:
    ordered = sorted(float(x) for x in values)
    return [ordered[int(0.025 * samples)], ordered[int(0.975 * samples) - 1]]


def bootstrap_f1(counts: DataFrame, samples: int = 1000, seed: int = 7) -> list[float]:
    """95 % interval of F1 over resampled repositories of ``per_repository``; [0, 0] without any."""
    rows = counts.orderBy("repository").select("tp", "fp", "fn").collect()
    if not rows:
        return [0.0, 0.0]
    import numpy as np

    sums = resamples(len(rows), samples, seed) @ np.array(rows)
    return interval(f1_score(*sums.T), samples)


def paired_difference(a: DataFrame, b: DataFrame, samples: int = 1000, seed: int = 7) -> tuple[float, list[float], int]:
    """F1 of ``b`` less that of ``a``, its 95 % interval and the repositories: each resample scores both."""
    import numpy as np

    both = a.select("repository", *[F.col(c).alias(f"a_{c}") for c in ("tp", "fp", "fn")]).join(b, "repository", "full").na.fill(0)
    rows = np.array(both.orderBy("repository").select("a_tp", "a_fp", "a_fn", "tp", "fp", "fn").collect()).reshape(-1, 6)
    if not len(rows):
        return 0.0, [0.0, 0.0], 0
    score = lambda sums: f1_score(*sums[..., 3:].T) - f1_score(*sums[..., :3].T)
    return float(score(rows.sum(0))), interval(score(resamples(len(rows), samples, seed) @ rows), samples), len(rows)


def split_in_pairs(counts: DataFrame, seed: int = 7) -> DataFrame:
    """(repository, part) of ``counts`` (repository, positives): ``dev`` or ``test``. Repositories in order of their
    positives, most first, then of a keyed hash, go in pairs; a coin of the standard generator decides in each."""
    import random

    spark = counts.sparkSession
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), "repository"), 256)
    names = [r.repository for r in counts.orderBy(F.desc("positives"), mark).select("repository").collect()]
    r, rows = random.Random(seed), []
    for at in range(0, len(names), 2):
        pair = names[at : at + 2]
        r.shuffle(pair)
        rows += zip(pair, ("dev", "test"))
    return spark.createDataFrame(rows, "repository string, part string")


def masking_rates(gold: DataFrame, pred: DataFrame, sizes: DataFrame) -> DataFrame:
    """``masking_score`` with fpr: of the characters (task, chars in ``sizes``) that are not gold, the share predicted.
    Tasks without any span score 0."""
    return masking_rates_of(masking_score(gold, pred), sizes)


def masking_rates_of(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """``masking_rates`` of what ``masking_score`` gave."""
    d = sizes.join(scores, "task", "left").na.fill(0)
    rest = F.col("chars") - F.col("gold")
    return d.withColumn("fpr", F.when(rest > 0, (F.col("pred") - F.col("both")) / rest).otherwise(F.lit(0.0)))


def mean_of_tasks(scores: DataFrame) -> DataFrame:
    """One row: precision, recall, f1 and f2 as means over the tasks, and how many there are."""
    return scores.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "f2")], F.count(F.lit(1)).alias("tasks"))


def mask_everything(texts: DataFrame) -> DataFrame:
    """The trivial prediction: one span over all characters of each text (task, doc_id, text)."""
    return texts.select("task", "doc_id", F.lit(0).cast("bigint").alias("start"), F.char_length("text").cast("bigint").alias("end")).where("end > 0")


def characters_of(s: Column, a: Column, z: Column) -> Column:
    """(start, end) in characters of the bytes [a, z) of a UTF-8 byte string, rounded outwards to whole characters."""
    first = lambda n: F.length(F.regexp_replace(F.substr(s, F.lit(1), n.cast("int")), "[\x80-\xbf]", ""))
    inside = F.substr(s, (a + 1).cast("int"), F.lit(1)).rlike("^[\x80-\xbf]")
    start = first(a) - F.when(inside, 1).otherwise(0)
    return F.struct(F.greatest(start, F.lit(0)).cast("bigint").alias("start"), first(z).cast("bigint").alias("end"))
