"""Which windows a model has to see at all: rules over the bytes around a window."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytestr import running_sums

DEFAULT = "A16+U16"
PRINTABLE = r"\x20-\x7e\t"
MOST = 4096
_PART = re.compile(r"([AU])([0-9]+)|([PD])([0-9]+)x([0-9]+)")


@dataclass(frozen=True)
class Part:
    """``A`` and ``U``: a run of ``x`` characters; ``P``: ``y`` repeats at a period up to ``x``; ``D``: ``y`` of ``x``."""

    kind: str
    x: int
    y: int = 0

    def __post_init__(self):
        numbers = [self.x] + [self.y] * (self.kind in "PD")
        if not all(1 <= n <= MOST for n in numbers) or self.kind == "P" and self.x < 2 or self.kind == "D" and self.y > self.x:
            raise ValueError(f"prefilter {self.kind}{self.x}: numbers out of range")

    @property
    def counts(self) -> bool:
        """Whether bytes must be counted: a stretch that is printable throughout is a run."""
        return self.kind == "D" and self.y < self.x

    def reach(self) -> int:
        """Bytes on each side of a window in which what touches it can lie."""
        return {"A": self.x - 1, "U": 2 * self.x - 1, "P": self.x + self.y - 1, "D": self.x - 1}[self.kind]

    def expressions(self) -> list[tuple[int, str]]:
        """(reach, expression) that find the least stretch of each sort in the bytes within reach."""
        # only a run's first byte is tried: from each of its bytes a long run that is too short would be read again
        if self.kind == "A" or self.kind == "D" and self.x == self.y:
            return [(self.x - 1, f"(?<![{PRINTABLE}])[{PRINTABLE}]{{{self.x}}}")]
        if self.kind == "U":
            return [(2 * self.x - 1, f"(?<![{PRINTABLE}]\\x00)(?:[{PRINTABLE}]\\x00){{{self.x}}}")]
        found = []
        for q in range(2, self.x + 1):  # y equal pairs at distance q are y + q bytes of that period
            times, rest = divmod(self.y, q)
            size = self.y + q
            again = (f"\\1{{{times}}}" if times else "") + ("\\2" if rest else "")
            block = f"((.{{{rest}}}).{{{q - rest}}})" if rest else f"(.{{{q}}})"
            found.append((size - 1, f"(?s)(?={block}{again})(?!(.)\\{3 if rest else 2}{{{size - 1}}})"))
        return found


def parse(rule: str = DEFAULT) -> list[Part]:
    """The parts of a rule like ``A16+U16+P8x64+D32x28``; refuses all else."""
    parts = []
    for text in rule.split("+"):
        found = _PART.fullmatch(text)
        if not found:
            raise ValueError(f"no prefilter rule: {rule}")
        kind, numbers = found[1] or found[3], [int(n) for n in (found[2], found[4], found[5]) if n]
        parts.append(Part(kind, *numbers))
    return parts


def mark_prefiltered(wins: DataFrame, rule: str = DEFAULT, s: str = "s") -> DataFrame:
    """``wins`` (start, length, and the document's byte string) with ``skipped``: no part of the rule touches the window.

    What touches a window shows in the bytes around it, so each window is judged in its row: no join, and a long
    document costs what its windows cost. Null byte strings have no window to keep."""
    parts, own = parse(rule), wins.columns
    near = lambda n: F.substr(s, (F.greatest(F.col("start") - n, F.lit(0)) + 1).cast("int"), (F.col("start") + F.col("length") + n - F.greatest(F.col("start") - n, F.lit(0))).cast("int"))
    tests: list[Column] = [near(reach).rlike(x) for p in parts if not p.counts for reach, x in p.expressions()]
    d, dense = wins, [p for p in parts if p.counts]
    if dense:  # bytes that are not printable, and how far apart they are, say it: text has few of them
        names = [f"_dense{i}" for i in range(len(dense))]
        for name, p in zip(names, dense):
            d = d.withColumn(name, F.transform(F.split(near(p.reach()), f"[^{PRINTABLE}]"), lambda run: (F.length(run) + 1).cast("bigint")))
        d = running_sums(d, names)
        for name, p in zip(names, dense):
            c, others = F.col(name), p.x - p.y + 1
            end = lambda i: F.get(c, F.least(i + others, F.size(c)) - 1) - 1  # noqa: B023, E731
            first = lambda i: F.when(i > 0, F.get(c, i - 1)).otherwise(0)  # noqa: B023, E731
            tests.append(F.exists(F.sequence(F.lit(0), F.greatest(F.size(c) - others, F.lit(0))), lambda i: end(i) - first(i) >= p.x))  # noqa: B023
    return d.withColumn("skipped", ~F.coalesce(reduce(or_, tests), F.lit(False))).select(*own, "skipped")
