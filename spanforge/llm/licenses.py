"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

DataFrame functions only. Words are runs of a-z and 0-9 after lower-casing. A window starts at every word whose shingle
occurs in some template (a window without such a shingle has nothing in common with a template), once for each length of
a template that has it, so windows overlap. Its MinHash signature is cut into ``BANDS`` bands of ``ROWS`` rows: a window
with similarity s to a template shares a band with probability 1 - (1 - s**ROWS)**BANDS, over 0.999999 at s = 0.8.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import constant_array, text_or_empty

BANDS, ROWS, SHINGLE = 20, 2, 5
BITS = 1 << 18
#: Shingles of a part of a document.
PART = 4096

#: Public license texts, headers and one-line notices: a name after ``==`` and its text up to the next.
TEXTS = "license_texts.txt"


def templates() -> dict[str, str]:
    """The texts that come with the package, read through its loader, so also from an archive."""
    text = pkgutil.get_data(__package__, TEXTS).decode()
    parts = re.split(r"^== (.+)\n", text, flags=re.MULTILINE)[1:]
    return dict(zip(parts[::2], parts[1::2]))


def _words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _shingle_at(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)])


def _bands(shingles: Column) -> Column:
    """Band hashes of a column of shingles."""
    low = lambda seed: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, seed)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[low(b * ROWS + r) for r in range(ROWS)])
    )


def template_table(spark: SparkSession, licenses: dict[str, str]) -> DataFrame:
    """license, n (words), set (shingles). Templates shorter than a shingle are refused."""
    rows = [(name, _words(text)) for name, text in licenses.items()]
    if short := [name for name, w in rows if len(w) < SHINGLE]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    t = spark.createDataFrame(rows, "license string, w array<string>")
    at = F.sequence(F.lit(0), F.size("w") - SHINGLE)
    return t.select("license", F.size("w").alias("n"), F.array_distinct(F.transform(at, lambda i: _shingle_at(F.col("w"), i))).alias("set"))


def scan_licenses(
    docs: DataFrame, licenses: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", percent: int = 80
) -> DataFrame:
    """One row per row of ``docs`` and license found: id, license, containment (share of the template's shingles, the
    most of any window), word (position of the first such window), windows (number of windows that reach ``percent``).

    Texts are read whole. Null and empty texts give no rows, nor does a text without a match; rows with one id are one
    document. Other columns are ignored; an empty table gives an empty result. ``licenses`` (name: text, by default
    ``templates()``) come from the caller's program, not from the corpus: tables of them are broadcast.
    """
    spark = docs.sparkSession
    table = template_table(spark, licenses or templates())
    known = [(r.license, r.n, r.set) for r in table.collect()]
    lengths, all_shingles = sorted({n for _, n, _ in known}), sorted({s for _, _, x in known for s in x})
    bits = [0] * (BITS // 64)
    for s in all_shingles:
        bits[(s % BITS) >> 6] |= 1 << (s % 64)
    mask = constant_array([x - (1 << 64) if x >> 63 else x for x in bits], "bigint")
    split = F.array_remove(F.split(F.lower(text_or_empty(F.col(text_col))), "[^a-z0-9]+"), "")
    d = docs.select(F.col(id_col).alias("id"), split.alias("w"))
    d = d.select("id", F.when(F.size("w") >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), lambda i: _shingle_at(F.col("w"), i))).alias("s"))

    def maybe(v: Column) -> Column:
        b = F.pmod(v, F.lit(BITS)).cast("int")
        return F.getbit(F.get(mask, F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1

    placed = F.transform("s", lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    d = d.select("id", "s", F.filter(placed, lambda x: maybe(x["v"])).alias("hits"))
    # parts of the document where templates may be, then the windows of each length that start at a shingle of a template
    # of that length: no row carries more than a part
    some = lambda b: F.filter("hits", lambda x: (x["i"] >= b) & (x["i"] < b + PART))
    part = lambda b: F.struct(b.alias("base"), F.slice("s", b + 1, F.lit(PART + lengths[-1])).alias("s"), some(b).alias("hits"))
    parts = F.when(F.size("hits") > 0, F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(PART)), part))
    d = d.select("id", F.explode_outer(parts).alias("p")).where("p IS NOT NULL").select("id", "p.base", "p.s", "p.hits")

    def places(n: int) -> Column:
        own = constant_array(sorted({s for _, m, x in known if m == n for s in x}), "bigint")
        here = F.filter("hits", lambda x: F.array_contains(own, x["v"]))
        return F.transform(
            here, lambda x: F.struct(x["i"].alias("word"), F.lit(n).alias("n"), F.slice("s", x["i"] - F.col("base") + 1, F.lit(n - SHINGLE + 1)).alias("set"))
        )

    d = d.select("id", F.explode_outer(F.concat(*map(places, lengths))).alias("w")).where("w IS NOT NULL")
    windows = d.select("id", "w.word", "w.n", F.array_distinct("w.set").alias("set"))
    probes = windows.select("id", "word", "n", "set", F.explode(_bands(F.col("set"))).alias("band"))
    stored = table.select("license", F.col("n").alias("tn"), F.col("set").alias("tset"), F.explode(_bands(F.col("set"))).alias("band"))
    found = probes.join(F.broadcast(stored), (probes.band == stored.band) & (probes.n == stored.tn)).drop("band")
    share = F.size(F.array_intersect("set", "tset")) / F.size("tset")
    found = found.select("id", "word", "license", share.alias("share")).where(F.col("share") * 100 >= percent).distinct()
    best = found.groupBy("id", "license").agg(
        F.max(F.struct("share", (-F.col("word")).alias("w"))).alias("b"), F.count(F.lit(1)).alias("windows")
    )
    return best.select(
        F.col("id").alias(id_col), "license", F.col("b.share").alias("containment"), (-F.col("b.w")).cast("bigint").alias("word"), "windows"
    )
