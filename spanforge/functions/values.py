"""Masking, normalisation of typed values, severity of paths, names of source files, exclusion globs."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of a key's PEM header.
PEM_WORDS = (
    "BLOCK", "DSA", "EC", "ECDSA", "ED25519", "ED448", "ENCRYPTED", "KEY", "OPENSSH", "PGP", "PRIVATE", "PUBLIC",
    "RSA", "SSH2", "X25519", "X448",
)
PEM_HEADER = rf"^-----BEGIN (?:(?:{'|'.join(PEM_WORDS)}) )*KEY(?: BLOCK)?-----$"


def mask(text: Column) -> Column:
    """The first line with its inside hidden: from 16 characters on 4 and 2 stay, from 8 on 2, else none."""
    first = F.regexp_replace(F.substring_index(text, "\n", 1), r"\r+$", "")
    n = F.char_length(first)
    keep = F.when(n >= 16, 4).when(n >= 8, 2).otherwise(0)
    tail = F.when(n >= 16, 2).otherwise(0)
    stars = F.repeat(F.lit("*"), F.least(F.greatest(n - keep - tail, F.lit(1)), F.lit(12)).cast("int"))
    shown = F.when(first.rlike(PEM_HEADER), first).otherwise(F.concat(F.left(first, keep), stars, F.right(first, tail)))
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.when(lines > 1, F.concat(shown, F.lit(" … ("), lines.cast("string"), F.lit(" lines)"))).otherwise(shown)


TOKEN = r"A-Za-z0-9+/_\-.~"


def widen_left(before: Column) -> Column:
    """How many bytes before a span belong to its token."""
    return F.length(F.regexp_extract(F.reverse(before), rf"^[{TOKEN}]*", 0))


def widen_right(after: Column) -> Column:
    """How many bytes after a span belong to its token; '=' only here."""
    return F.length(F.regexp_extract(after, rf"^[{TOKEN}=]*", 0))


def cut(text: Column, limit: int = 160) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


# E.164 country codes of two digits.
TWO_DIGIT_CODES = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51",
    "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90",
    "91", "92", "93", "94", "95", "98",
)


def normalize_value(kind: Column, value: Column) -> Column:
    """What counts as the same value of a type: case of e-mails, separators and country codes of numbers, and so on."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    plus = value.rlike(r"^[^0-9]*\+")
    zeros = ~plus & digits.startswith("00")
    rest = F.when(zeros, F.substr(digits, F.lit(3))).otherwise(digits)
    code = (
        F.when(F.length(rest) == 0, 0)
        .when(F.left(rest, F.lit(1)).isin("1", "7"), 1)
        .when(F.length(rest) < 2, 0)
        .when(F.left(rest, F.lit(2)).isin(*TWO_DIGIT_CODES), 2)
        .when(F.length(rest) >= 3, 3)
        .otherwise(0)
    )
    phone = F.when(plus | zeros, F.substr(rest, code + 1)).otherwise(digits)
    return (
        F.when(kind == "EMAIL", F.lower(F.regexp_replace(value, r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$", "")))
        .when(kind == "PHONE", phone)
        .when(kind.isin("IBAN", "CREDIT_CARD", "DNI_NIE", "PASSPORT"), F.upper(F.regexp_replace(value, r"[ \t\n\r\f\x0b.\-]", "")))
        .when(kind == "IP", F.lower(F.regexp_replace(value, r"^[\[\]]+|[\[\]]+$", "")))
        .when(kind.isin("PERSON_NAME", "ADDRESS"), fold_name(value))
        .otherwise(value)
    )


def _folding() -> tuple[str, str]:
    """Lower-case Latin, Greek and Cyrillic letters with marks, and their base letters."""
    marked = [chr(c) for c in (*range(0xDF, 0x180), *range(0x3AC, 0x3CF), *range(0x430, 0x460)) if chr(c).islower()]
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in marked]
    pairs += [("ø", "o"), ("đ", "d"), ("ł", "l"), ("ı", "i"), ("ς", "σ")]
    return "".join(a for a, b in pairs if a != b), "".join(b for a, b in pairs if a != b)


MARKED, PLAIN = _folding()


def fold_name(value: Column) -> Column:
    """Lower case, without marks and invisible characters, one space between words."""
    low = F.regexp_replace(F.lower(value), r"[̀-ͯ­​-‏⁠﻿]", "")
    return F.trim(F.regexp_replace(F.translate(low, MARKED, PLAIN), r"[\s ]+", " "))


# Folders of tests, examples and documents.
SEVERITY_PARTS = (
    "__mocks__", "__tests__", "androidtest", "cypress", "doc", "docs", "e2e", "example", "examples", "fixture",
    "fixtures", "jvmtest", "mock", "mocks", "sample", "samples", "spec", "specs", "test", "test-data", "testdata",
    "tests",
)


def path_severity(path: Column) -> Column:
    """``warning`` for tests, examples and documents, else ``error``. Both separators count; ASCII case does not."""
    low = F.lower(path)
    parts = F.split(low, r"[/\\]")
    name, low_name = F.element_at(F.split(path, r"[/\\]"), -1), F.element_at(parts, -1)
    has_dot = low_name.rlike(r"^.+\.[^.]*$")
    soft = (
        F.arrays_overlap(parts, F.array(*map(F.lit, SEVERITY_PARTS)))
        | (has_dot & low_name.rlike(r"\.(md|markdown|mdx|rst|adoc|asciidoc)$"))
        | low_name.rlike(r"^test_.*\.py$")
        | low_name.rlike(r"[._\-](test|tests|spec|specs)\.[a-z0-9]+$")
        | name.rlike(r"Tests?\.(?i:cs|kt|java|scala|swift)$")
        | low_name.rlike(r"^tests?\.(cs|kt|java|scala|swift)$")
    )
    return F.when(soft, "warning").otherwise("error")


# Extensions and names of source text, folders of dependencies and of version control.
SOURCE_EXTENSIONS = (
    "adoc", "bash", "c", "cc", "cfg", "cjs", "cnf", "conf", "cpp", "cs", "csv", "dart", "dockerfile", "env", "erb",
    "ex", "exs", "go", "gradle", "groovy", "h", "hh", "hpp", "htm", "html", "htpasswd", "ini", "ipynb", "j2", "java",
    "js", "json", "jsx", "key", "kt", "kts", "lua", "m", "md", "mjs", "pem", "php", "pl", "plist", "properties",
    "ps1", "psm1", "py", "r", "rb", "rs", "rst", "scala", "sh", "sql", "swift", "tf", "tfstate", "tfvars", "toml",
    "tpl", "ts", "tsx", "txt", "vue", "xml", "yaml", "yml", "zsh",
)
SOURCE_NAMES = (
    ".dockercfg", ".env", ".envrc", ".git-credentials", ".netrc", ".npmrc", ".pgpass", ".pypirc", "brewfile",
    "caddyfile", "config", "credentials", "dockerfile", "gemfile", "jenkinsfile", "justfile", "makefile", "procfile",
    "rakefile", "vagrantfile",
)
DEPENDENCY_FOLDERS = (
    ".git", ".next", ".venv", "__pycache__", "build", "dist", "node_modules", "target", "vendor", "venv",
)


def is_source_text_name(name: Column) -> Column:
    low = F.replace(F.lower(name), F.lit("K"), F.lit("k"))
    extension = F.element_at(F.split(low, r"\."), -1)
    return extension.isin(*SOURCE_EXTENSIONS) | low.isin(*SOURCE_NAMES) | low.rlike("^(dockerfile|jenkinsfile)")


def in_dependency_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, DEPENDENCY_FOLDERS)))


def exclusion_regex(pattern: str) -> str | None:
    """An anchored expression for one line of an exclusion file; null for blank lines and comments."""
    line = pattern.lstrip("﻿").rstrip()
    if not line or line.startswith("#"):
        return None
    if line.startswith("!") or "[" in line:
        raise ValueError(f"unsupported exclusion: {line}")
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored = "/" in line
    out, i, line = "", 0, line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line[i] in "*?":
            out, i = out + ("[^/]*" if line[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + re.sub(r"([^A-Za-z0-9_/\- ])", r"\\\1", line[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern of a .gitignore subset matches the path or a folder above it."""
    known = [r for r in map(exclusion_regex, patterns) if r]
    return path.rlike("|".join(f"(?:{r})" for r in known)) if known else F.lit(False)


# Categories that name no provider.
GENERIC_CATEGORIES = (
    "API", "Auth", "Bearer Authorization", "Credential", "JSON Web Token", "Key", "Nonce", "OTP / 2FA Secret",
    "Other", "Salt", "Secret", "Token", "UUID",
)


def macro_category(categories: Column) -> Column:
    """Coarse family of a ':'-separated list of categories."""
    low, parts = F.lower(F.replace(categories, F.lit(":"), F.lit(" "))), F.split(categories, ":")
    any_of = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return (
        F.when(low.rlike("private key|jwk|pkcs"), "private_key")
        .when(low.rlike("password|passwd|securestring|curl"), "password")
        .when(low.rlike("url credentials|basic authorization"), "url_or_basic_auth")
        .when(F.size(F.array_except(parts, F.array(*map(F.lit, GENERIC_CATEGORIES)))) > 0, "provider_pattern")
        .when(any_of("Token", "Auth", "Bearer Authorization", "JSON Web Token"), "token_or_auth")
        .when(any_of("Key", "Secret", "API", "Credential", "OTP / 2FA Secret"), "generic_key_or_secret")
        .when(any_of("UUID", "Salt", "Nonce"), "uuid_salt_nonce")
        .otherwise("other")
    )
