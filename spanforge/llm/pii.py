"""Surrogates for personal data: keyed, consistent with type, script, gender and format, distinct and coreferent.

DataFrame functions only. Entities are found by one expression over the whole text. The distinct normalised values of
all documents get a surrogate each from a keyed hash; a surrogate that another value has, or that is itself a value of
the corpus, is drawn again until none is, so different values stay different and equal values stay equal everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import forget, text_or_empty, written

_L = r"\p{L}\p{N}._%+\-"
EMAIL = rf"(?<![{_L}])[{_L}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*\.[A-Za-z]{{2,}}+(?![A-Za-z0-9])"
#: A number with its country code in the usual grouping, else in others; or three digits in parentheses before seven.
PHONE = (
    r"(?<![\d+])\+\d{1,3}[ \-]?(?:\(\d{2,4}\)|\d{2,4})[ \-]?\d{3}[ \-]?\d{3,4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}(?:[ \-]?\d{1,4}){3,5}+(?!\.?\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)"
)
#: Country codes of one and two digits; all others have three.
COUNTRY = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90",
    "91", "92", "93", "94", "95", "98",
)
CODE = rf"^\+(?:{'|'.join(COUNTRY)}|\d{{3}})"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]?\d)"
CARD = r"(?<![\w])(?:\d{16}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4})(?![\w])"
SECRET = r"(?<![\w])(?:[0-9a-f]{40}|[0-9A-F]{40})(?![\w])"
#: Given names by script and gender. A person is a title, given names or both before a surname, or two or three
#: capitalised words after one of ``CUES``.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carmen Catherine Charlotte Christine Elizabeth Emily Emma Françoise Ingrid Isabel Jennifer Johanna Julia Katharina Laura Margaret Maria Martina Mary Patricia Sabine Sarah Sophie Susanne Teresa Véronique Victoria".split(),
    ("latin", "m"): "Alejandro Benjamin Charles Christopher Daniel David Dietrich Edward Fernando François Friedrich Guillermo Heinrich James John Jonathan Joseph Martin Matthew Michael Nicholas Patrick Paul Peter Richard Robert Sebastian Thomas Théodore William".split(),
    ("cyrillic", "f"): "Анастасия Анна Валентина Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Андрей Владимир Дмитрий Иван Константин Михаил Николай Павел Сергей Фёдор Юрий".split(),
    ("greek", "f"): "Αικατερίνη Ελένη Ευαγγελία Ιωάννα Κωνσταντίνα Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αλέξανδρος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Χρήστος".split(),
}
TITLES = {
    "m": "Mr Herr Señor Monsieur Sr Господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Señora Madame Mme Sra Госпожа Κυρία".split(),
    "": "Dr Prof Professor Доктор Профессор".split(),
}
CUES = ("my name is ", "My name is ", "Name: ", "name: ", "Author: ", "author: ", "Signed by ", "signed by ", "Patient: ", "Contact: ")
_names = "|".join(sorted({n for names in GIVEN.values() for n in names}))
_titles = "|".join(t for titles in TITLES.values() for t in titles)
_surname = r"(?:\p{Lu}\p{L}++|\p{Lu}(?=['’]))(?:['’\-]\p{Lu}\p{L}++)*+"
PERSON = (
    rf"(?<![\p{{L}}])(?:(?:{_titles})\.? (?:(?:{_names}) ){{0,2}}|(?:(?:{_names}) ){{1,3}}){_surname}(?![\p{{L}}])"
    rf"|(?<=\b(?:{'|'.join(CUES)})){_surname}(?: {_surname}){{1,2}}+(?![\p{{L}}])"
)
ANY = "|".join(f"(?:{p})" for p in (EMAIL, PHONE, IP, CARD.replace(r"\1", r"\k<sep>").replace(r"([ \-])", r"(?<sep>[ \-])"), SECRET, PERSON))
TYPES = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "PERSON")


def entity_type(value: Column) -> Column:
    return (
        F.when(F.contains(value, F.lit("@")), "EMAIL")
        .when(value.startswith("+") | value.startswith("("), "PHONE")
        .when(value.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "IP")
        .when(value.rlike(r"^[\d \-]{16,19}$"), "CARD")
        .when(value.rlike(r"^[0-9A-Fa-f]{40}$"), "SECRET")
        .otherwise("PERSON")
    )


def normalised(kind: Column, value: Column) -> Column:
    """What makes two mentions one entity: case of e-mails and secrets, and separators of numbers, do not count."""
    return (
        F.when(kind.isin("EMAIL", "SECRET"), F.lower(value))
        .when(kind == "PHONE", F.concat(F.regexp_extract(value, CODE, 0), F.lit("/"), F.regexp_replace(F.regexp_replace(value, CODE, ""), r"\D", "")))
        .when(kind == "CARD", F.regexp_replace(value, r"\D", ""))
        .when(kind == "PERSON", F.regexp_replace(value, rf"^({_titles})\.? ", r"$1 "))
        .otherwise(value)
    )


def _drawn(seed: Column, text: Column, i: Column, c: Column) -> Column:
    """A character of c's kind: a digit for a digit, a letter of the same script and case for a letter, else c."""
    h = F.xxhash64(seed, i)
    of = lambda letters: F.substr(F.lit(letters), (F.pmod(h, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
    return (
        F.when(c.between("0", "9"), of("0123456789"))
        .when(c.between("a", "z"), of("abcdefghijklmnopqrstuvwxyz"))
        .when(c.between("A", "Z"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(c.between("а", "я"), of("абвгдежзиклмнопрстуфхцчшэюя"))
        .when(c.between("А", "Я"), of("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
        .when(c.between("α", "ω"), of("αβγδεζηθικλμνξοπρστυφχψω"))
        .when(c.between("Α", "Ω"), of("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"))
        .when(c.rlike(r"^\p{Lu}$"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(c.rlike(r"^\p{L}$"), of("abcdefghijklmnopqrstuvwxyz"))
        .otherwise(c)
    )


def _chars(seed: Column, text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _drawn(seed, text, i, c)), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a 16-digit string."""
    d = F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1)) * c.cast("int"))
    return F.aggregate(d, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))


def surrogate(key: str, kind: Column, value: Column, round_: int) -> Column:
    """The draw of a round for a normalised value. What later rounds draw from grows: letters or digits are added to
    e-mail names, surnames and phone numbers, and addresses may leave their network, so that however many values share
    a narrow format, all get surrogates of their own."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, F.lit(str(round_))), 256)
    number = lambda name, n: F.pmod(F.xxhash64(seed, F.lit(name)), F.lit(n))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    host = F.when(domain.rlike(r"\.?example\.(com|org|net)$"), F.regexp_replace(domain, r"\d+", "")).otherwise(F.lit("mail.example.com"))
    host = F.concat(F.regexp_extract(host, r"^[^.]*", 0), F.when(domain.rlike(r"^[^.]*\d"), number("host", 90).cast("string")).otherwise(""), F.regexp_extract(host, r"\..*$", 0))
    local = F.concat(local, F.lit("a" * round_))
    octet = lambda name, n, least: (number(name, n) + least).cast("string")
    first = F.substring_index(value, ".", 1)
    network = F.when(first.isin("10", "127") & F.lit(round_ < 3), first).otherwise(octet("a", 200, 11))
    card = _chars(seed, value)
    check = F.pmod(10 - _luhn(F.concat(F.left(card, F.lit(15)), F.lit("0"))), F.lit(10)).cast("string")
    rest = F.concat(F.substring_index(value, "/", -1), F.lit("0" * max(0, round_ - 2)))
    hexed = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.lower(F.hex(F.pmod(F.xxhash64(seed, i), F.lit(16))))), "")
    return (
        F.when(kind == "EMAIL", F.concat(_chars(seed, local), F.lit("@"), host))
        .when(kind == "PHONE", F.concat(F.substring_index(value, "/", 1), F.lit("/"), _chars(seed, rest)))
        .when(kind == "IP", F.concat_ws(".", network, octet("b", 256, 0), octet("c", 256, 0), octet("d", 254, 1)))
        .when(kind == "CARD", F.when(_luhn(value) % 10 == 0, F.concat(F.left(card, F.lit(15)), check)).otherwise(card))
        .when(kind == "SECRET", hexed)
        .otherwise(_person(seed, value, round_))
    )


def _person(seed: Column, value: Column, round_: int) -> Column:
    """The title stays; each given name becomes another of its script and gender, other words one of their script."""
    title = F.regexp_extract(value, rf"^((?:{_titles}) )?", 0)
    given = F.regexp_extract(value, rf"^(?:(?:{_titles}) )?((?:(?:{_names}) )*)", 1)

    def other(name: Column, at: Column) -> Column:
        new = name
        for i, names in enumerate(GIVEN.values()):
            pick = F.get(F.array(*map(F.lit, names)), F.pmod(F.xxhash64(seed, F.lit(i), at), F.lit(len(names))).cast("int"))
            new = F.when(name.isin(names), pick).otherwise(new)
        return new

    new = F.array_join(F.transform(F.split(given, " "), other), " ")  # the last part is empty: a space ends the names
    rest = F.substr(value, F.length(title) + F.length(given) + 1)
    return F.concat(title, new, _chars(seed, F.concat(rest, F.lit("a" * round_))))


def _filled(kind: Column, original: Column, drawn: Column) -> Column:
    """The surrogate in the mention's own format: separators of numbers, upper case, the point after a title."""
    plain = F.regexp_replace(drawn, r"^(\+\d+)?/", "")
    lead = F.when(kind == "PHONE", F.length(F.regexp_extract(original, CODE, 0))).otherwise(0)
    spread = F.aggregate(
        F.split(F.substr(original, lead + 1), ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda acc, c: F.when(
            c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substr(plain, acc["n"] + 1, F.lit(1))).alias("out"), (acc["n"] + 1).alias("n"))
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n"))),
        lambda acc: F.concat(acc["out"], F.substr(plain, acc["n"] + 1)),
    )
    pointed = original.rlike(rf"^({_titles})\. ")
    return (
        F.when(kind.isin("PHONE", "CARD"), F.concat(F.left(original, lead), spread))
        .when(kind.isin("EMAIL", "SECRET") & (original == F.upper(original)), F.upper(drawn))
        .when((kind == "PERSON") & pointed, F.regexp_replace(drawn, rf"^({_titles}) ", r"$1. "))
        .otherwise(drawn)
    )


def surrogate_table(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, drawn) for distinct normalised values (kind, value): all drawn differ, and none is in ``values``.
    Rounds go on until every value has one; each draws from more than the round before."""
    pending, done, round_ = values, None, 0
    while True:
        cand = pending.withColumn("drawn", surrogate(key, F.col("kind"), F.col("value"), round_))
        first = cand.groupBy("kind", "drawn").agg(F.min("value").alias("value"))
        free = first.join(values.select("kind", F.col("value").alias("drawn")), ["kind", "drawn"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        free = written(free.select("kind", "value", "drawn"), "surrogates")
        rest = written(pending.join(free.select("kind", "value"), ["kind", "value"], "left_anti"), "pending")
        done = free if done is None else done.union(free)
        if pending is not values:
            forget(pending)
        if not rest.limit(1).count():
            return done
        pending, round_ = rest, round_ + 1


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", entities_col: str = "entities") -> DataFrame:
    """``docs`` with e-mail addresses, phone numbers (with a country code, or national ones whose first three digits are
    in parentheses), IPv4 addresses, 16-digit card numbers, 40-digit hexadecimal secrets and person names of the whole
    text replaced by their surrogates, and ``entities_col``: how many there were. Names are found by titles, by given
    names of ``GIVEN`` and after ``CUES``; an untitled name that has none of these is not found.

    The same key gives the same surrogates on every run over the same corpus. Null texts stay null with 0 entities, empty
    texts stay empty; repeated rows are replaced alike, each by itself. All other columns stay; a column named like
    ``entities_col`` is replaced. An empty table gives an empty result. The texts are searched once and written with what
    was found; texts without entities do not move after that.
    """
    text = text_or_empty(F.col(text_col))
    kept = [c for c in docs.columns if c != entities_col]
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(kept)])
    d = docs.select(row.alias("row"), F.regexp_extract_all(text, F.lit(ANY), 0).alias("m"), text.alias("t"))
    gaps = F.when(F.size("m") > 0, F.split("t", ANY))
    d = written(d.select(F.monotonically_increasing_id().alias("uid"), "row", "m", gaps.alias("gaps")), "entities")
    plain = d.where(F.size("m") == 0).select("row", F.col(f"row.c{kept.index(text_col)}").cast("string").alias("t"), F.lit(0).alias("n"))
    hit = d.where(F.size("m") > 0)
    mentions = hit.select("uid", F.posexplode("m").alias("pos", "original"))
    mentions = mentions.withColumn("kind", entity_type(F.col("original")))
    mentions = mentions.withColumn("value", normalised(F.col("kind"), F.col("original")))
    values = written(mentions.select("kind", "value").distinct(), "values")
    table = surrogate_table(values, key)
    given = mentions.join(table, ["kind", "value"])
    given = given.select("uid", "pos", _filled(F.col("kind"), F.col("original"), F.col("drawn")).alias("new"))
    lists = given.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("new"))
    filled = hit.join(lists, "uid").select("row", "gaps", F.concat(F.transform("new", lambda x: x["new"]), F.array(F.lit(""))).alias("new"))
    filled = filled.select("row", F.array_join(F.zip_with("gaps", "new", lambda g, r: F.concat(g, r)), "").alias("t"), (F.size("new") - 1).alias("n"))
    out = plain.union(filled)
    columns = [
        F.when(F.col(f"row.c{i}").isNull(), F.lit(None)).otherwise(F.col("t")).alias(c) if c == text_col else F.col(f"row.c{i}").alias(c)
        for i, c in enumerate(kept)
    ]
    return out.select(*columns, F.col("n").alias(entities_col))
