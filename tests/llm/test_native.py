"""Surrogates, quality rules and license scans against brute force."""

import math
import random
from collections import Counter

import pytest
import regex
import xxhash

from spanforge.llm import licenses as L
from spanforge.llm import pii as P
from spanforge.llm import quality_rules as Q

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, entities string, t string, word int, ratio int, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "old", "clash", 3, 4, "id") for i, t in rows], SCHEMA)


# --- surrogates -------------------------------------------------------------------------------------------------------

PERSONAL = [
    (1, "Write to Anna.Schmidt@example.com or +49 (170) 555-0147. Ms. Alice Brown knows."),
    (2, "anna.schmidt@EXAMPLE.com again, from 192.168.7.14; card 4111 1111 1111 1111 and 4111111111111111."),
    (3, "Mr Robert Keller met Mr. Robert Keller; Мария Иванова and Νικόλαος Παππάς too."),
    (4, "token = \"" + "0123456789abcdef0123456789abcdef01234567" + "\" end"),
    (5, "token = \"" + "0123456789ABCDEF0123456789ABCDEF01234567" + "\" END"),
    (6, "nothing here: 1.2.3 and 10.0.0.999 and a@b"),
    (7, None),
    (8, ""),
    (9, "x " * 50_000 + "late.comer@example.org " + "y " * 50_000),
    (9, "x " * 50_000 + "late.comer@example.org " + "y " * 50_000),
    (None, "anna.schmidt@example.com"),
]
ANY = regex.compile(P.ANY.replace(r"\k<sep>", r"\g<sep>"))


def mentions(text):
    return [m[0] for m in ANY.finditer(text or "")]


def shape(text):
    """Digits, letters by case and script, and everything else as it is."""
    out = ""
    for c in text:
        if c.isdigit():
            out += "9"
        elif c.isalpha():
            script = next(s for s in ("Latin", "Cyrillic", "Greek") if regex.match(rf"\p{{{s}}}", c))
            out += script[0].upper() if c.isupper() else script[0].lower()
        else:
            out += c
    return out


def test_surrogates(spark):
    got = P.replace_pii(docs(spark, PERSONAL), key="k")
    assert got.columns == [*[c for c in docs(spark, []).columns if c != "entities"], "entities"]
    rows = {(r.doc_id, r.text) for r in got.collect()}
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(PERSONAL) and len(rows) == len(PERSONAL) - 1  # equal rows stay equal
    assert by_id[7].text is None and by_id[7].entities == 0 and by_id[8].text == "" and by_id[6].text == PERSONAL[5][1]
    originals = {m for _, t in PERSONAL for m in mentions(t)}
    fate, held = {}, {}
    for i, t in PERSONAL:
        want, new = mentions(t), mentions(by_id[i].text)
        assert len(want) == len(new) == by_id[i].entities
        assert ANY.sub("\0", t or "") == ANY.sub("\0", by_id[i].text or "")  # the rest of the text stays
        for a, b in zip(want, new):
            assert b not in originals
            one = P_norm(a)
            assert fate.setdefault(one, P_norm(b)) == P_norm(b)  # coreferent
            assert held.setdefault(P_norm(b), one) == one  # distinct
            if "@" not in a and not regex.match(r"\p{L}+\.? ?\p{Lu}", a) and "." not in a and len(a) != 40:
                assert shape(a)[-4:] == shape(b)[-4:]
    assert by_id[3].text.split()[0] == "Mr" and " met Mr. " in by_id[3].text
    cyrillic, greek = [m for m in mentions(by_id[3].text) if regex.match(r"\p{Cyrillic}|\p{Greek}", m)]
    assert cyrillic.split()[0] in P.GIVEN["cyrillic", "f"] and greek.split()[0] in P.GIVEN["greek", "m"]
    assert regex.fullmatch(r"[0-9a-f]{40}", mentions(by_id[4].text)[0]) and regex.fullmatch(r"[0-9A-F]{40}", mentions(by_id[5].text)[0])
    assert mentions(by_id[2].text)[0] == mentions(by_id[1].text)[0].lower()


def P_norm(value):
    if "@" in value or regex.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    if value[0] in "+(" or regex.fullmatch(r"[\d \-]{16,19}", value):
        return regex.sub(r"\D", "", value)
    return regex.sub(r"^(\p{L}+)\. ", r"\1 ", value)


def test_surrogates_again_and_empty(spark):
    a = sorted(map(str, P.replace_pii(docs(spark, PERSONAL).repartition(3), key="k").collect()))
    assert a == sorted(map(str, P.replace_pii(docs(spark, PERSONAL).repartition(1), key="k").collect()))
    assert a != sorted(map(str, P.replace_pii(docs(spark, PERSONAL), key="other").collect()))
    assert P.replace_pii(docs(spark, []), key="k").collect() == []


def test_colliding_draws_are_drawn_again(spark):
    """Three-digit groups leave few values: all of one prefix are present, so draws must avoid the corpus and each other."""
    rows = [(i, f"call +1 10 100 {i:03d}x or +1 10 200 {i:03d}.") for i in range(60)]
    got = [m for r in P.replace_pii(docs(spark, rows), key="k").collect() for m in mentions(r.text)]
    before = {m for _, t in rows for m in mentions(t)}
    assert len(set(got)) == len(got) == len(before) and not before & set(got)


def test_narrow_formats_have_surrogates_for_all(spark):
    """However many values share a format with few values of its own, all get distinct surrogates."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{low[i % 26]}@site{i}.com wrote. Mr {upper[i // 26 % 26]}{low[i % 26]}, call +4917055{i:05d}.") for i in range(1000)]
    out = {r.doc_id: mentions(r.text) for r in P.replace_pii(docs(spark, rows), key="k").collect()}
    for j in range(3):
        before, after = [mentions(t)[j] for _, t in rows], [out[i][j] for i, _ in rows]
        assert len({P_norm(x) for x in after}) == len({P_norm(x) for x in before})
        assert not {P_norm(x) for x in after} & {P_norm(x) for x in before}


def test_numbers_are_one_entity_in_any_grouping(spark):
    rows = [(1, "+491705550147"), (2, "+49 170 555 0147"), (3, "+49 (170) 555-0147"), (4, "+44 20 7946 0958"), (5, "+33 1 23 45 67 89"), (6, "(555) 123-4567"), (7, "+1234567")]
    got = {r.doc_id: r.text for r in P.replace_pii(docs(spark, rows), key="k").collect()}
    plain = lambda t: regex.sub(r"\D", "", t)
    assert plain(got[1]) == plain(got[2]) == plain(got[3]) != "491705550147"
    assert got[7] == "+1234567"  # too short
    for i, t in rows[:6]:
        assert shape(got[i]) == shape(t) and got[i] != t and got[i][:3] == t[:3] or i == 6
    assert shape(got[6]) == "(999) 999-9999" and got[6] != rows[5][1]


def test_names(spark):
    rows = [(1, "Anna Maria Schmidt-Keller and Dr. O'Brien; my name is Zorka Petrovna Quux, said Robert McDonald's friend."), (2, "the word Name: in front of lower case")]
    got = {r.doc_id: r for r in P.replace_pii(docs(spark, rows), key="k").collect()}
    assert got[1].entities == 4 and got[2].entities == 0 and got[2].text == rows[1][1]
    assert shape(regex.sub(r"^\w+ \w+ ", "", got[1].text.split(" and ")[0])) == shape("Schmidt-Keller")
    assert not {"Anna", "Schmidt-Keller", "O'Brien", "Zorka", "Petrovna", "Quux", "McDonald"} & set(regex.split(r"[ ,.;]+|'s", got[1].text)) - set(P.GIVEN["latin", "f"])
    first, second = got[1].text.split(" ")[:2]
    assert first in P.GIVEN["latin", "f"] and second in {n for (script, _), names in P.GIVEN.items() if script == "latin" for n in names}


def scanned(text):
    """Addresses, hexadecimal secrets and card numbers by walking over tokens, without the operator's expression."""
    found = []
    for word in regex.split(r"[\s,;()\"]+", text):
        word = word.strip(".!?:")
        local, at, host = word.partition("@")
        if at and local and host.count("@") == 0 and "." in host and all(host.split(".")) and host.rsplit(".", 1)[1].isalpha() and len(host.rsplit(".", 1)[1]) > 1:
            found.append(word)
        elif word.count(".") == 3 and all(x.isdigit() and int(x) < 256 and len(x) < 4 for x in word.split(".")):
            found.append(word)
        elif len(word) == 40 and all(c in "0123456789abcdef" for c in word) or len(word) == 16 and word.isdigit():
            found.append(word)
    return found


def test_detection_equals_a_scanner(spark):
    r = random.Random(12)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    kinds = [
        lambda: pick("abcxyz", 1) + pick("abc123", 6) + "@" + pick("abc", 4) + ".org",
        lambda: ".".join(str(r.randint(1, 400)) for _ in range(4)),
        lambda: pick("0123456789abcdef", r.choice([39, 40, 41])),
        lambda: pick("0123456789", r.choice([15, 16, 17])),
        lambda: pick("abcdefgh", 5),
        lambda: pick("ab@.", 5),
    ]
    for _ in range(400):
        text = " ".join(r.choice(kinds)() + r.choice(["", ",", ";", "!"]) for _ in range(12))
        if ".@" not in text and "@." not in text and ".." not in text and "@@" not in text:
            assert mentions(text) == scanned(text), text


# --- quality rules ----------------------------------------------------------------------------------------------------

WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
TOKEN = regex.compile(Q.TOKEN)


def hash64(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def grams(text):
    h = [hash64(t) for t in TOKEN.findall(text or "")]
    return [x % Q.BUCKETS for x in h] + [hash64(a, b) % Q.BUCKETS for a, b in zip(h, h[1:])]


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(inside)


def rule_rows():
    r = random.Random(4)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(60)]
    rows = []
    for i in range(80):
        words = [r.choice(good if i % 2 else bad) for _ in range(r.randint(1, 150))]
        rows.append((i, "".join(w + r.choice([" ", " ", ", ", "\n", "\t", " # ", "\r\n", "  "]) for w in words)))
    rows += [(100, None), (101, ""), (102, " \n\t\n"), (103, "a b c " * 4000), (104, "same line\nsame line\n\n\nother\nsame line"), (105, "é中😀 " * 60), (106, "\x1c\x85  x " * 30)]
    return [*rows, (0, rows[0][1])]


def test_quality_rules(spark):
    rows = rule_rows()
    trusted = [1, 3, 5, 7, 9, 11, 13, 15]
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()) + Q.BUCKETS, sum(target.values()) + Q.BUCKETS
    weight = lambda b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw)
    got = Q.quality_rules(docs(spark, rows), spark.createDataFrame([(i,) for i in trusted], "id bigint")).collect()
    assert len(got) == len(rows)
    of, verdicts = dict(rows), set()
    for r in got:
        n, chars, symbols, dups, repeats = base(of[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats), r.doc_id
        g = grams(of[r.doc_id])
        ratio = sum(map(weight, g)) / len(g) if g else 0.0
        assert r.ratio == pytest.approx(ratio, abs=1e-5)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert r.kept == (not r.base_failed and r.ratio >= Q.THRESHOLD)
        verdicts.add((r.base_failed, r.kept))
    assert len(verdicts) >= 2


def test_quality_rules_without_target_or_rows(spark):
    none = spark.createDataFrame([], "id bigint")
    got = Q.quality_rules(docs(spark, rule_rows()), none).collect()
    assert all(r.ratio == 0 and r.kept == (not r.base_failed) for r in got)
    assert Q.quality_rules(docs(spark, []), none).collect() == []


@pytest.mark.parametrize("broadcast_ids", [Q.BROADCAST_IDS, 100])
def test_quality_rules_count_all_trusted_texts(spark, monkeypatch, broadcast_ids):
    """However many ids are trusted, whether they are broadcast or joined by a shuffle."""
    monkeypatch.setattr(Q, "BROADCAST_IDS", broadcast_ids)
    rows, trusted = 24_000, 21_000
    table = spark.range(rows).selectExpr("id AS doc_id", "concat('common word', id % 5) AS text")
    twice = spark.range(trusted).union(spark.range(100)).union(spark.createDataFrame([(None,), (-1,)], "id bigint"))
    raw, target = Counter(), Counter()
    for i in range(5):
        g = grams(f"common word{i}")
        raw.update({b: g.count(b) * rows // 5 for b in set(g)})
        target.update({b: g.count(b) * trusted // 5 for b in set(g)})
    n_raw, n_target = sum(raw.values()) + Q.BUCKETS, sum(target.values()) + Q.BUCKETS
    got = Q.ratio_weights(table, twice, "doc_id", "text")
    assert got == pytest.approx([math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in range(Q.BUCKETS)], abs=1e-5)


# --- license scans ----------------------------------------------------------------------------------------------------


TEMPLATES = L.templates()


def brute_licenses(text, templates, percent=80):
    w = L._words(text or "")
    out = {}
    for name, t in templates.items():
        tw = L._words(t)
        want = {tuple(tw[i : i + L.SHINGLE]) for i in range(len(tw) - L.SHINGLE + 1)}
        starts = set().union(*all_shingles([x for x in templates.values() if len(L._words(x)) == len(tw)]))
        hits = {}
        for a in range(len(w) - L.SHINGLE + 1):
            if tuple(w[a : a + L.SHINGLE]) not in starts:
                continue  # windows start at a shingle of a template of their length
            part = w[a : a + len(tw)]
            own = {tuple(part[i : i + L.SHINGLE]) for i in range(len(part) - L.SHINGLE + 1)}
            if 100 * len(own & want) >= percent * len(want):
                hits[a] = len(own & want) / len(want)
        if hits:
            best = max(hits.values())
            out[name] = (round(best, 9), min(a for a, s in hits.items() if s == best), len(hits))
    return out


def all_shingles(texts):
    for t in texts:
        w = L._words(t)
        yield {tuple(w[i : i + L.SHINGLE]) for i in range(len(w) - L.SHINGLE + 1)}


def test_license_scan(spark):
    r = random.Random(8)
    filler = [f"word{i}" for i in range(50)]
    rows = [(900, None), (901, ""), (902, "the license"), (903, "Licensed under CC BY 4.0")]
    for i in range(60):
        words = [r.choice(filler) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            t = r.choice(list(TEMPLATES.values())).split()
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = r.choice(filler + ["License", "the"])
            at = r.randint(0, len(words))
            words[at:at] = t
        rows.append((i, " ".join(w.upper() if r.random() < 0.2 else w for w in words)))
    rows.append((950, "filler " * 60_000 + TEMPLATES["MIT"] + " filler" * 1000))
    rows.append((0, dict(rows)[0]))
    got = {}
    for x in L.scan_licenses(docs(spark, rows)).collect():
        got[x.doc_id, x.license] = (round(x.containment, 9), x.word, x.windows)
    want = {(i, k): v for i, t in rows if i != 950 for k, v in brute_licenses(t, TEMPLATES).items()}
    assert got.pop((950, "MIT"))[:2] == (1.0, 60_000)
    assert got == want and len(want) > 20


def test_long_documents_go_in_parts(spark, monkeypatch):
    """Windows that begin in one part of a document and end in another are whole."""
    r, few = random.Random(9), {k: t for k, t in TEMPLATES.items() if "line" in k or k in ("ISC", "MIT line")}
    rows = []
    for i in range(12):
        words = ["filler"] * 40
        for _ in range(6):
            at = r.randint(0, len(words))
            words[at:at] = r.choice(list(few.values())).split()
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(L, "PART", 7)
    got = {(x.doc_id, x.license): (round(x.containment, 9), x.word, x.windows) for x in L.scan_licenses(docs(spark, rows), few).collect()}
    assert got == {(i, k): v for i, t in rows for k, v in brute_licenses(t, few).items()}
    assert L.scan_licenses(docs(spark, [])).collect() == []


def test_band_probability():
    """A window at the threshold shares a band with a probability over 0.999."""
    for s in (0.8, 0.9, 1.0):
        assert 1 - (1 - s**L.ROWS) ** L.BANDS > 0.999999
    with pytest.raises(ValueError):
        L.template_table(None, {"short": "only three words"})
