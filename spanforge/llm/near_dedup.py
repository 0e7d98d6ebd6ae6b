"""Near-duplicate components from bottom-k sketches of one hash function.

A document's set is its distinct word shingles, hashed to 64 bits; its sketch is the k smallest hashes. Inverted lists
of retained values generate overlaps, the sketch of the union estimates their similarity, and the full sets verify it.

Sets with similarity t or more have ``least_shared`` retained values in common or more: t of a whole set, and t*k less
``MARGIN`` standard deviations of a sample's count where a sketch is full (at k = 96 and t = 0.8: 54 to 72 of 96, by the
set's size; to share fewer has a chance below 1e-7). So a document whose sketch has fewer values that any other sketch has is not similar to
anything, and all others need to be listed under their rarest shared values only: if each leaves out ``least_shared`` - 1
of them, the most frequent by one order of all values, similar documents still meet in a list. That keeps common phrases
out of the lists without a cap: a value that a third of the corpus has is a list of only those documents that have
little else, and these are mostly alike.

Within a list, members are first compared with the list's most central member, which links a group of copies in a
number of comparisons linear in its size. Members of a list that are still in different components are then compared
with each other: as pairs in short lists, and in long ones as pairs of blocks, so that rows stay few and each pair of
blocks is a row by itself. Either way overlaps and estimates from the sketches select and the full sets decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, forget, text_or_empty, words_of, written

#: Standard deviations by which a sample's count may fall short of its expectation.
MARGIN = 6
#: Members of a list whose pairs are rows of their own, and of a block whose pairs are compared inside a row.
SMALL, BLOCK = 32, 32
#: Ids that are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_set(words: Column, size: int) -> Column:
    """Distinct hashed shingles of a column of words (not an expression); fewer words than ``size`` make one shingle."""
    n = F.size(words)
    whole = F.array(F.xxhash64(F.lit("whole"), words))
    shingles = F.transform(
        F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])
    )
    return F.when(n >= size, F.array_distinct(shingles)).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, text digest, set) of (id, text)."""
    digest = F.unhex(F.md5(text_or_empty(F.col("text"))))
    words = docs.select("id", digest.alias("digest"), words_of(ascii_lower(F.col("text"))).alias("words"))
    return words.select("id", "digest", shingle_set(F.col("words"), size).alias("set"))


def least_shared(n: Column, k: int, percent: int) -> Column:
    """How many retained values a set of ``n`` shares with any set that is similar to it, at least. Of the larger of
    two similar sets the other has t or more, so of its k least values t*k, less the margin of k draws without
    replacement out of n/t at most. A set of fewer than t*k is like whole sketches only: t*n values."""
    t = percent / 100
    sampled = t * k - MARGIN * F.sqrt(k * t * (1 - t) * F.greatest(F.lit(0.0), 1 - k * t / n))
    whole = F.ceil(n * percent / 100)
    return F.greatest(F.lit(1), F.when(n < t * k, whole).otherwise(F.least(whole, F.ceil(sampled)))).cast("int")


def least_overlap(na: Column, nb: Column, k: int, percent: int) -> Column:
    """The same for two sets of known sizes, where the larger one is sampled: they share t/(1+t) of both sizes or more."""
    t, most = percent / 100, F.greatest(na, nb)
    q = t / (1 + t) * (1 + F.least(na, nb) / most)
    return (F.floor(q * k - MARGIN * F.sqrt(k * q * (1 - q) * F.greatest(F.lit(0.0), 1 - k / most))) - 1).cast("int")


def _lists(reps: DataFrame, percent: int, k: int) -> DataFrame:
    """(key, id, n, members): documents under their rarest shared values, all that may be similar to others."""
    values = reps.select("id", "n", F.explode("sketch").alias("key"))
    many = values.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = values.join(many, "key").groupBy("id").agg(F.min("n").alias("n"), F.collect_list(F.struct("many", "key")).alias("shared"))
    rare = F.size("shared") - least_shared(F.col("n"), k, percent) + 1  # of at most k values
    kept = shared.select("id", "n", F.slice(F.array_sort("shared"), 1, F.greatest(rare, F.lit(0))).alias("rare"))
    listed = written(kept.select("id", "n", F.explode("rare.key").alias("key")), "listed")
    members = listed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    out = written(listed.join(members, "key"), "lists")
    forget(listed)
    return out


def _alike_sizes(a, b, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _side(what: DataFrame, x: str, *columns: str) -> DataFrame:
    return what.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])


def _enough(shared: Column, na: Column, nb: Column, percent: int) -> Column:
    return shared * 100 >= (na + nb - shared) * percent


def _likely(a: Column, b: Column, k: int, percent: int) -> Column:
    """Whether the sketch of the union, made of two sketches, allows the similarity. ``a`` and ``b``: columns or the
    variables of a lambda, not expressions."""
    t = percent / 100
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    size = F.least(F.lit(k), F.size(F.array_union(a, b)))
    return both / size >= t - MARGIN * F.sqrt(F.lit(t * (1 - t)) / size)


def _full_sets(ids: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(id, set) of the documents in question: a set is made again from its text rather than kept for all. An id on
    several texts has several."""
    few = ids.count() <= BROADCAST_IDS
    sets = _sets(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi"), shingle)
    return written(sets.dropDuplicates(["id", "digest"]).select("id", "set"), "sets")


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that the union's sketch does not rule out and the full sets confirm. A sketch that is
    not full is the full set."""
    near = pairs.join(_side(reps, "a", "n", "sketch"), "a").join(_side(reps, "b", "n", "sketch"), "b")
    whole, shared = F.greatest("n_a", "n_b") <= k, F.size(F.array_intersect("sketch_a", "sketch_b"))
    decided = F.when(whole, _enough(shared, F.col("n_a"), F.col("n_b"), percent)).otherwise(_likely(F.col("sketch_a"), F.col("sketch_b"), k, percent))
    near = written(near.where(decided).select("a", "b", whole.alias("whole")), "near")
    open_ = near.where("NOT whole")
    wanted = written(open_.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    sets = _full_sets(wanted, texts, shingle)
    full = open_.select("a", "b").join(_side(sets, "a", "set"), "a").join(_side(sets, "b", "set"), "b")
    i = F.size(F.array_intersect("set_a", "set_b"))
    same = full.select("a", "b", i.alias("i"), F.size("set_a").alias("x"), F.size("set_b").alias("y"))
    same = same.where(_enough(F.col("i"), F.col("x"), F.col("y"), percent)).select("a", "b")
    links = written(near.where("whole").select("a", "b").union(same).distinct(), "links")
    for d in (near, wanted, sets):
        forget(d)
    return links


def _in_blocks(members: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, k: int, percent: int) -> DataFrame:
    """Links (a, b) between members (family, id, c, n) of a family that are in different components.

    The family is the component that prevails in a long list; those outside it are compared with all its members. Members
    are dealt to cells by size class, of which only neighbours can hold similar sets, and cells to blocks. A row of the
    join is one pair of blocks, found by all its coordinates, so a family of any size is spread over all tasks. The
    sketches' overlap, as an estimate of the similarity of sets of these sizes, and then the full sets decide inside the
    row; of a document's links with the block's documents one a component leaves it, which joins the same components as
    all of them."""
    step = -F.log(F.lit(percent / 100))
    d = members.select("family", "id", "c", "n", (F.col("c") != F.col("family")).alias("out"), F.floor(F.log("n") / step).cast("int").alias("size"))
    cells = written(d.groupBy("family", "out", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("bigint").alias("blocks")), "cells")
    wanted = written(members.where(F.col("n") > k).select("id").distinct(), "wanted")
    sets = _full_sets(wanted, texts, shingle)
    d = d.join(cells, ["family", "out", "size"]).join(reps.select("id", "n", "sketch"), ["id", "n"]).join(sets, "id", "left")
    d = d.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    row = F.struct("id", "c", "n", "sketch", F.coalesce("set", "sketch").alias("set"))
    d = written(d.groupBy("family", "out", "size", "block").agg(F.collect_list(row).alias("rows")), "blocks")
    cx, cy = (cells.select("family", *[F.col(c).alias(c + e) for c in ("out", "size", "blocks")]) for e in "xy")
    near = F.abs(F.col("sizex") - F.col("sizey")) <= 1
    plan = cx.where("outx").join(cy, "family").where(near & (~F.col("outy") | (F.col("sizex") <= F.col("sizey"))))
    at = ["family", "sizex", "outy", "sizey", "bx", "by"]
    count = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    x = d.where("out").select("family", F.col("size").alias("sizex"), F.col("block").alias("bx"), F.col("rows").alias("x"))
    x = x.join(plan, ["family", "sizex"]).withColumn("by", count("blocksy"))
    y = d.select("family", F.col("out").alias("outy"), F.col("size").alias("sizey"), F.col("block").alias("by"), F.col("rows").alias("y"))
    y = y.join(plan, ["family", "outy", "sizey"]).withColumn("bx", count("blocksx"))
    once = ~F.col("outy") | (F.col("sizex") < F.col("sizey")) | (F.col("bx") <= F.col("by"))
    # a number of parts of our own: rows are few and take long, so merging partitions by their bytes would undo the deal
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = x.where(once).select(*at, "x").repartition(tasks, *at).join(y.where(once).select(*at, "y").repartition(tasks, *at), at)

    def similar(p: Column, q: Column) -> Column:
        alike = (p["c"] != q["c"]) & _alike_sizes(p["n"], q["n"], percent)
        overlap = F.size(F.array_intersect(p["sketch"], q["sketch"])) >= least_overlap(p["n"], q["n"], k, percent)
        exact = _enough(F.size(F.array_intersect(p["set"], q["set"])), F.size(p["set"]), F.size(q["set"]), percent)
        return alike & ((F.greatest(p["n"], q["n"]) <= k) | overlap) & exact

    kind = members.schema["id"].dataType.simpleString()

    def links(p: Column) -> Column:
        met = F.struct(F.array().cast(f"array<{kind}>").alias("seen"), F.array().cast(f"array<struct<a:{kind},b:{kind}>>").alias("links"))
        more = lambda acc, q: F.struct(
            F.concat(acc["seen"], F.array(q["c"])).alias("seen"),
            F.concat(acc["links"], F.array(F.struct(F.least(p["id"], q["id"]).alias("a"), F.greatest(p["id"], q["id"]).alias("b")))).alias("links"),
        )
        add = lambda acc, q: F.when(~F.array_contains(acc["seen"], q["c"]) & similar(p, q), more(acc, q)).otherwise(acc)
        return F.aggregate("y", met, add, lambda acc: acc["links"])

    found = F.flatten(F.transform("x", links))
    out = written(both.select(F.explode_outer(found).alias("l")).where("l IS NOT NULL").select("l.a", "l.b").distinct(), "links")
    for t in (cells, wanted, sets, d):
        forget(t)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of links (a, b) reaches. Smallest labels and pointer jumping."""
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(edges, "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).withColumnRenamed("a", "id"), "labels")
    while True:
        spread = edges.join(labels, edges.b == labels.id).select(F.col("a").alias("id"), "c")
        least = spread.union(labels).groupBy("id").agg(F.min("c").alias("c"))
        there = labels.select(F.col("id").alias("c"), F.col("c").alias("up"))
        jumped = least.join(there, "c", "left").select("id", F.least("c", F.coalesce("up", "c")).alias("c"))
        now = written(jumped, "labels")
        changed = now.join(labels.withColumnRenamed("c", "was"), "id").where(F.col("c") != F.col("was")).limit(1).count()
        forget(labels)
        labels = now
        if not changed:
            forget(edges)
            return labels.select("id", F.col("c").alias("component"))


def _star(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each list's most central member, the one whose lists are the largest, with its other members."""
    weight = lists.groupBy("id").agg(F.sum("members").alias("w"))
    centre = lists.join(weight, "id").groupBy("key").agg(F.max_by(F.struct("id", "n"), F.struct(F.col("w"), F.xxhash64("id"))).alias("c"))
    # a table, so that both sides of the join come from a shuffle and a long list can be split over tasks
    centre = written(centre.select("key", F.col("c.id").alias("centre"), F.col("c.n").alias("cn")), "centres")
    star = lists.join(centre, "key").where((F.col("id") != F.col("centre")) & _alike_sizes("n", "cn", percent))
    star = written(star.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "star")
    forget(centre)
    return star


def _marks(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, k: int) -> DataFrame:
    """(id, digest, n, component, kept) of each row of ``docs``."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ordered = _sets(texts, shingle).select("id", "digest", F.sort_array("set").alias("set"))
    rows = written(
        ordered.select(
            "id",
            "digest",
            F.size("set").alias("n"),
            F.xxhash64("set").alias("d1"),
            F.xxhash64(F.lit(17), F.col("set")).alias("d2"),
            F.slice("set", 1, k).alias("sketch"),
        ),
        "sketches",
    )
    known = rows.where("n > 0 AND id IS NOT NULL")
    classes = written(known.groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.any_value("sketch").alias("sketch")), "classes")
    reps = classes.select("id", "n", "sketch")
    lists = _lists(reps, percent, k)
    star = _star(lists, percent)
    links = _verified(star, reps, texts, shingle, k, percent)
    label = components(links)

    member = lists.join(label, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    parts = member.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m"), F.max_by("c", F.struct("m", "c")).alias("family"))
    mixed = written(mixed.where("parts > 1").select("key", "m", "family"), "mixed")  # as the centres
    member = written(member.join(mixed, "key"), "members")
    x, y = (member.where(F.col("m") <= SMALL).select("key", *[F.col(c).alias(c + e) for c in ("id", "n", "c")]) for e in "ab")
    rest = x.join(y, (x.key == y.key) & (F.col("ida") < F.col("idb")) & (F.col("ca") != F.col("cb")) & _alike_sizes("na", "nb", percent))
    rest = rest.select(F.col("ida").alias("a"), F.col("idb").alias("b"))
    rest = written(rest.distinct().join(star, ["a", "b"], "left_anti"), "rest")
    long = _in_blocks(member.where(F.col("m") > SMALL).select("family", "id", "c", "n").distinct(), reps, texts, shingle, k, percent)
    label = components(links.union(_verified(rest, reps, texts, shingle, k, percent)).union(long))
    for d in (lists, star, mixed, member, long, rest):
        forget(d)

    found = classes.join(label, "id", "left").select("d1", "d2", "n", F.coalesce("component", "id").alias("component"))
    marked = rows.select("id", "digest", "n", "d1", "d2").join(found, ["d1", "d2", "n"], "left")
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "id"))
    return marked.select("id", "digest", "n", component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, k: int = 96
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept.

    Links: 100 * |A and B| >= ``percent`` * |A or B| over the sets of distinct ``shingle``-word shingles of the text
    with A-Z lower-cased. Fewer words make one shingle of all; no words or null make an empty set, linked with nothing.
    Equal sets (128 hash bits and size) are one class, so copies cost one row each. Null ids link with nothing: their
    component_id is null and kept is true. Rows with one id are one document, linked where any of its texts is. Other
    columns are ignored; an empty table gives an empty result.
    """
    marks = _marks(docs, id_col, text_col, shingle, percent, k)
    return marks.select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.col("component").alias("component_id"), "kept"
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, k: int = 96
) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay as they are. Rows go
    by id and text, so that an id on two texts loses only the one that ``near_duplicates`` does not keep."""
    marks = _marks(docs, id_col, text_col, shingle, percent, k)
    gone = marks.where(~F.col("kept")).select(F.col("id").alias("__gone_id"), F.col("digest").alias("__gone_text")).distinct()
    digest = F.unhex(F.md5(text_or_empty(docs[text_col])))
    return docs.join(gone, (docs[id_col] == F.col("__gone_id")) & (digest == F.col("__gone_text")), "left_anti")
