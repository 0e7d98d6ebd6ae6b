"""Prefilter rules against a check of every stretch of every window."""

import random

import pytest

from spanforge.operators.prefilter import mark_prefiltered, parse


def printable(b):
    return 0x20 <= b < 0x7F or b == 9


def touched(d, s, length, p):
    """Whether any stretch that the part describes meets [s, s + length)."""
    n, e = len(d), s + length
    meets = lambda a, z: a < e and z > s
    if p.kind == "A":
        return any(all(map(printable, d[i : i + p.x])) and meets(i, i + p.x) for i in range(n - p.x + 1))
    if p.kind == "U":
        pair = lambda i: printable(d[i]) and d[i + 1] == 0
        return any(all(pair(i + 2 * k) for k in range(p.x)) and meets(i, i + 2 * p.x) for i in range(n - 2 * p.x + 1))
    if p.kind == "P":
        size = lambda q: q + p.y
        return any(d[i : i + p.y] == d[i + q : i + size(q)] and len(set(d[i : i + size(q)])) > 1 and meets(i, i + size(q)) for q in range(2, p.x + 1) for i in range(n - size(q) + 1))
    return any(sum(map(printable, d[i : i + p.x])) >= p.y and meets(i, i + p.x) for i in range(n - p.x + 1))


@pytest.fixture(scope="module")
def bodies():
    r, out = random.Random(1), []
    for _ in range(120):
        b = b""
        for _ in range(r.randint(0, 8)):
            b += r.choice(
                [
                    bytes(r.choice(b"abc \t") for _ in range(r.randint(1, 9))),
                    b"".join(bytes([r.choice(b"xyz"), 0]) for _ in range(r.randint(1, 6))),
                    bytes(r.choice([0, 1, 200, 255]) for _ in range(r.randint(1, 9))),
                    bytes(r.choice([1, 2, 3]) for _ in range(r.randint(1, 3))) * r.randint(1, 5),
                    bytes(r.randint(1, 12)),
                ]
            )
        out.append(b)
    return out


@pytest.mark.parametrize("rule", ["A5", "U3", "P3x4", "P4x9", "P2x1", "D6x5", "D4x4", "D12x1", "A6+U4", "D9x3+A8"])
def test_windows_that_a_rule_touches(spark, bodies, rule):
    rows = [(i, b.decode("latin-1"), s, min(7, len(b) - s)) for i, b in enumerate(bodies) for s in range(0, len(b), 5)]
    d = spark.createDataFrame([*rows, (999, None, 0, 5)], "doc_id int, s string, start bigint, length bigint")
    got = {(x.doc_id, x.start): x.skipped for x in mark_prefiltered(d, rule).collect()}
    assert got.pop((999, 0))
    assert got == {(i, s): not any(touched(bodies[i], s, n, p) for p in parse(rule)) for i, _, s, n in rows}


@pytest.mark.parametrize("rule", ["", "A", "A0", "A4097", "B5", "P1x3", "P3", "D4x5", "A5+", "a5", "A5 +U3", "D4x0"])
def test_rules_that_are_refused(rule):
    with pytest.raises(ValueError):
        parse(rule)
