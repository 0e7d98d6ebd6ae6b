"""Masked views: the line or string around a finding with every found byte in it hidden."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, context_range
from ..functions.values import PEM_HEADER, TOKEN
from .code_rules import printable_string

CUT = 160
_left, _right = re.compile(f"[{TOKEN}]*$"), re.compile(f"[{TOKEN}=]*")
_pem = re.compile(PEM_HEADER)
_edges = re.compile(f"^[{SPACE}]+|[{SPACE}]+$".replace("\\\\", "\\"))


def masked(text: str) -> str:
    """``values.mask`` of one value."""
    first, *more = text.split("\n")
    first = first.rstrip("\r")
    n = len(first)
    head, tail = (4, 2) if n >= 16 else (2, 0) if n >= 8 else (0, 0)
    hidden = first if _pem.match(first) else first[:head] + "*" * min(max(n - head - tail, 1), 12) + first[n - tail :]
    return f"{hidden} … ({len(more) + 1} lines)" if more else hidden


def decoded(s: str, ascii_only: bool) -> str:
    if ascii_only:
        return "".join(c if c < "\x80" else "�" for c in s)
    return s.encode("latin-1").decode("utf-8", "replace")


def cut(text: str) -> str:
    return text if len(text) <= CUT else text[:CUT] + "…"


def gaps(lo: int, hi: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of [lo, hi) no range covers."""
    out = []
    for a, z in sorted(covered):
        if a > lo:
            out.append((lo, min(a, hi)))
        lo = max(lo, z)
        if lo >= hi:
            return out
    return [*out, (lo, hi)]


def view(s: str, lo: int, hi: int, found: list, hidden: list, ascii_only: bool) -> str:
    """[lo, hi) of a byte string with the parts of ``found`` and of ``hidden`` (start, end, base64) in it masked, each
    with the whole token around it; overlapping ones count as one, whose first text stands for all."""

    def replaced(a: int, z: int, base64: bool, size: int) -> tuple[int, int, str]:
        if base64 and not ascii_only:
            return a, z, f"[base64 blob, {size} B]"
        a -= len(_left.search(s[lo:a])[0]) if a > lo and s[a - 1] != "=" else 0
        z += len(_right.match(s, z, hi)[0])
        return a, z, masked(decoded(s[a:z], ascii_only))

    parts = [replaced(max(a, lo), min(z, hi), b, z - a) for a, z, b in found if a < hi and lo < z]
    seen = [(a, z) for a, z, _ in parts if a < z]
    for a, z, b in hidden:
        if a < hi and lo < z:
            parts += [replaced(x, y, b, z - a) for x, y in gaps(max(a, lo), min(z, hi), seen)]
    out, at = [], lo
    for a, z, text in sorted(parts, key=lambda p: p[0]):
        if a >= at:
            out += [decoded(s[at:a], ascii_only), text]
            at = z
        else:
            at = max(at, z)
    return "".join(out) + decoded(s[at:hi], ascii_only)


def _meeting(items: list, reach: list[int], lo: int, hi: int) -> list:
    """Of items sorted by start those that meet [lo, hi); ``reach``: the furthest end so far."""
    return [x for x in items[bisect_left(reach, lo + 1) : bisect_left(items, (hi,))] if x[1] > lo]


def _reach(items: list) -> list[int]:
    out, far = [], -1
    for x in items:
        far = max(far, x[1])
        out.append(far)
    return out


def masked_views(docs: DataFrame, findings: DataFrame, hidden: DataFrame, key: str = "doc_id", s: str = "s", binary: bool = False) -> DataFrame:
    """``findings`` (key, start, end, base64, ...) with ``view``: the masked line of a text, or with ``binary`` the masked
    printable string. ``hidden`` (key, start, end, base64): all that any model found. Documents are joined with what was
    found in them; a view costs what it shows, not what the document holds."""
    place = printable_string(F.col(s), F.col("start"), F.col("end")) if binary else context_range(F.col(s), F.col("start"), F.col("end"))
    span = lambda *c: F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("base64").alias("base64"), *c)
    all_hidden = hidden.groupBy(key).agg(F.array_sort(F.collect_list(span())).alias("hidden"))
    own = findings.join(docs.select(key, s), key).withColumn("_r", place)
    own = own.withColumn("_row", F.struct(*findings.columns))
    lists = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "base64", F.col("_r").alias("r"), F.col("_row").alias("row")))).alias("found"))
    d = docs.select(key, s).join(lists, key).join(all_hidden, key, "left")
    return d.select(F.explode(F.arrays_zip(F.col("found.row").alias("row"), _views(binary)(F.col(s), F.col("found"), F.col("hidden")).alias("view"))).alias("x")).select("x.row.*", "x.view")


def _views(binary: bool):
    @F.pandas_udf("array<string>")
    def run(bodies: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, found, hidden in bodies:
            yield pd.Series([_document_views(a, b, [] if c is None else c, binary) for a, b, c in zip(s, found, hidden)])

    return run


def _document_views(s: str, found, hidden, binary: bool) -> list[str]:
    items = sorted((int(x["start"]), int(x["end"]), bool(x["base64"])) for x in found)
    rest = sorted((int(x["start"]), int(x["end"]), bool(x["base64"])) for x in hidden)
    far, far_rest = _reach(items), _reach(rest)
    out, known = [], {}
    for x in found:
        lo, hi = tuple(dict(x["r"]).values()) if isinstance(x["r"], dict) else tuple(x["r"])
        text = known.get((lo, hi))
        if text is None:
            text = view(s, lo, hi, _meeting(items, far, lo, hi), _meeting(rest, far_rest, lo, hi), binary)
            text = known[lo, hi] = cut(text if binary else _edges.sub("", text))
        out.append("(inside a base64) " + text if x["base64"] and not binary else text)
    return out


def masked_snippet(s: Column, a: Column, z: Column) -> Column:
    from ..functions.bytestr import to_text
    from ..functions.values import mask

    return mask(to_text(F.substr(s, (a + 1).cast("int"), (z - a).cast("int"))))
