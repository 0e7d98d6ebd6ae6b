"""Text of byte strings: UTF-16 documents, white space, the context of a finding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode and the ASCII separators have it.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
MARGIN, SPAN = 256, 4096


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{SPACE}]+", ""), f"[{SPACE}]++$", "")


def _pairs(low_first: bool) -> str:
    """Well-formed UTF-16 as bytes; possessive, so that it matches in a loop."""
    unit = lambda high: f"[\\x00-\\xff][{high}]" if low_first else f"[{high}][\\x00-\\xff]"
    return f"^(?:{unit('\\x00-\\xd7\\xe0-\\xff')}|{unit('\\xd8-\\xdb')}{unit('\\xdc-\\xdf')})*+$"


def utf16_text(s: Column) -> Column:
    """The text of a byte string that starts with a UTF-16 mark and is well formed, else null."""
    body = F.substr(s, F.lit(3))
    raw = F.encode(body, "ISO-8859-1")
    little = s.startswith("\xff\xfe") & body.rlike("(?s)" + _pairs(True))
    big = s.startswith("\xfe\xff") & body.rlike("(?s)" + _pairs(False))
    return F.when(little, F.decode(F.when(little, raw), "UTF-16LE")).when(big, F.decode(F.when(big, raw), "UTF-16BE"))


def context_range(s: Column, a: Column, z: Column) -> Column:
    """(lo, hi): the line that [a, z) starts on, or its part from ``MARGIN`` bytes before the finding to as many after
    it, of which ``SPAN`` bytes count; cut between characters."""
    first = a - F.length(F.substring_index(F.substr(s, F.lit(1), a.cast("int")), "\n", -1))
    last = a + F.length(F.substring_index(F.substr(s, (a + 1).cast("int")), "\n", 1))
    low = F.greatest(first, a - MARGIN)
    reach = F.least(F.greatest(z, a), a + SPAN) + MARGIN
    high = F.least(last, reach)
    inside = F.substr(s, (low + 1).cast("int"), F.lit(3))
    skip = F.when(low > first, F.least(F.length(F.regexp_extract(inside, "^[\\x80-\\xbf]*", 0)), a - low)).otherwise(0)
    tail = F.substr(s, (high - 2).cast("int"), F.lit(4))  # the three bytes before the cut and the first one after it
    goes_on = F.regexp_extract(F.reverse(tail), "^[\\x80-\\xbf]{1,3}", 0)
    back = F.when(high < last, F.least(F.length(goes_on), high - a)).otherwise(0)
    return F.struct((low + skip).cast("bigint").alias("lo"), (high - back).cast("bigint").alias("hi"))
