"""Archive expansion as a table function: zip, gzip and tar members, nested, within budgets; failures are rows."""

from __future__ import annotations

import ctypes
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Limits:
    """What an archive may cost: all bytes that are decompressed count, and failures beyond ``failures`` become one row."""

    depth: int = 3
    member: int = 64 << 20
    total: int = 256 << 20
    ratio: int = 200
    slack: int = 1 << 20
    entries: int = 100_000
    failures: int = 1000


def is_zip(b: bytes) -> bool:
    return len(b) >= 22 and b[:4] in (b"PK\3\4", b"PK\5\6")


def is_gzip(b: bytes) -> bool:
    return len(b) >= 18 and b[:3] == b"\x1f\x8b\x08"


def _octal(raw: bytes) -> int | None:
    if raw[:1] == b"\x80":
        return int.from_bytes(raw[1:], "big")
    digits = raw.strip(b" \0")
    try:
        return int(digits, 8) if digits else 0
    except ValueError:
        return None


def is_tar(b: bytes) -> bool:
    if len(b) < 512 or b[257:262] != b"ustar":
        return False
    return sum(b[:148]) + 256 + sum(b[156:512]) == _octal(b[148:156])


def is_archive(b: bytes) -> bool:
    return is_zip(b) or is_gzip(b) or is_tar(b)


def member_name(outer: str, inner: str, most: int = 4096) -> str:
    """``outer!/inner``; a very long inner name loses its middle."""
    raw = inner.encode()
    if len(raw) > most:
        head = raw[: most // 4].decode(errors="ignore")
        inner = head + "…" + raw[len(raw) - (most - most // 4 - 3) :].decode(errors="ignore")
    return f"{outer}!/{inner}"


@dataclass
class Expander:
    limits: Limits
    wanted: Callable[[str], bool]
    charged: int = 0
    entries: int = 0
    packed: int = 0
    failed: int = 0
    rows: list = field(default_factory=list)

    def fail(self, name: str, why: str) -> None:
        self.failed += 1
        if self.failed <= self.limits.failures:
            self.rows.append((name, None, why))

    def room(self) -> int:
        return min(self.limits.total - self.charged, self.packed * self.limits.ratio + self.limits.slack - self.charged)

    def inflate(self, data: bytes, wbits: int, most: int) -> tuple[bytes | None, int]:
        """At most ``most`` bytes of a deflate stream, and how much of the input it took; None if broken or larger."""
        d = zlib.decompressobj(wbits)
        try:
            out = d.decompress(data, most + 1)
        except zlib.error:
            return None, 0
        self.charged += len(out)
        if len(out) > most or not d.eof:
            return None, 0
        return out, len(data) - len(d.unused_data)

    def add(self, name: str, content: bytes, depth: int) -> None:
        if is_archive(content):
            if depth >= self.limits.depth:
                return self.fail(name, "nested too deeply")
            return self.expand(name, content, depth + 1)
        if len(content) > self.limits.member:
            return self.fail(name, "member too large")
        if self.wanted(name) and content:
            self.rows.append((name, content, None))

    def count(self, name: str) -> bool:
        self.entries += 1
        if self.entries == self.limits.entries + 1:
            self.fail(name, "too many entries")
        return self.entries <= self.limits.entries

    def expand(self, name: str, data: bytes, depth: int = 1) -> None:
        if depth == 1:
            self.packed = len(data)
        (self.zip if is_zip(data) else self.gzip if is_gzip(data) else self.tar)(name, data, depth)

    def zip(self, name: str, b: bytes, depth: int) -> None:
        end = b.rfind(b"PK\5\6", max(0, len(b) - 65_557))
        if end < 0 or end + 22 > len(b):
            return self.fail(name, "no end of central directory")
        count, _, at = struct.unpack("<HII", b[end + 10 : end + 20])
        taken: list[tuple[int, int]] = []
        for _ in range(count):
            if b[at : at + 4] != b"PK\1\2" or at + 46 > len(b):
                return self.fail(name, "broken central directory")
            flags, method = struct.unpack("<HH", b[at + 8 : at + 12])
            packed, size, n, extra, note = struct.unpack("<IIHHH", b[at + 20 : at + 34])
            (local,) = struct.unpack("<I", b[at + 42 : at + 46])
            inner = b[at + 46 : at + 46 + n].decode("utf-8", "replace")
            at += 46 + n + extra + note
            if inner.endswith("/"):
                continue
            full = member_name(name, inner)
            if not self.count(full):
                return
            if 0xFFFFFFFF in (packed, size, local):
                self.fail(full, "zip64")
                continue
            if flags & 1:
                self.fail(full, "encrypted")
                continue
            if method not in (0, 8):
                self.fail(full, "unknown method")
                continue
            if b[local : local + 4] != b"PK\3\4" or local + 30 > len(b):
                self.fail(full, "broken header")
                continue
            skip = local + 30 + sum(struct.unpack("<HH", b[local + 26 : local + 30]))
            if skip + packed > len(b):
                self.fail(full, "truncated")
                continue
            if any(x < skip + packed and local < y for x, y in taken):
                return self.fail(full, "members overlap")
            taken.append((local, skip + packed))
            raw = b[skip : skip + packed]
            if not self.wanted(full) and not self.starts_like_archive(raw, method):
                continue
            most = min(self.limits.member, self.room())
            if method:
                content, _ = self.inflate(raw, -15, max(0, most))
            else:
                content = raw if len(raw) <= most else None
                self.charged += len(raw)
            if content is None or len(content) != size:
                self.fail(full, "over the budget" if most < self.limits.member else "broken or too large")
            else:
                self.add(full, content, depth)

    @staticmethod
    def starts_like_archive(raw: bytes, method: int) -> bool:
        try:
            head = zlib.decompressobj(-15).decompress(raw[:4096], 512) if method else raw[:512]
        except zlib.error:
            return False
        return head[:4] in (b"PK\3\4", b"PK\5\6") or head[:3] == b"\x1f\x8b\x08" or is_tar(head)

    def gzip(self, name: str, b: bytes, depth: int) -> None:
        inner, out, at = "", [], 0
        held = 0
        while b[at : at + 2] == b"\x1f\x8b":
            flags, p = b[at + 3], at + 10
            if flags & 4:
                p += 2 + int.from_bytes(b[p : p + 2], "little")
            for bit in (8, 16):
                if flags & bit:
                    z = b.find(b"\0", p)
                    if z < 0:
                        return self.fail(name, "broken gzip header")
                    if bit == 8 and not inner:
                        inner = b[p:z].decode("latin-1")
                    p = z + 1
            p += 2 if flags & 2 else 0
            part, used = self.inflate(b[p:], -15, max(0, min(self.limits.member - held, self.room())))
            if part is None:
                return self.fail(name, "broken or too large")
            out.append(part)
            held += len(part)
            at = p + used + 8
        leaf = name.rsplit("/", 1)[-1].rsplit("\\", 1)[-1]
        fallback = leaf[:-4] + ".tar" if leaf.lower().endswith(".tgz") else leaf[:-3] if leaf.lower().endswith(".gz") else leaf
        self.count(name)
        self.add(member_name(name, inner or fallback), b"".join(out), depth)

    def tar(self, name: str, b: bytes, depth: int) -> None:
        at, long_name = 0, ""
        while at + 512 <= len(b) and any(b[at : at + 512]):
            h, size = b[at : at + 512], _octal(b[at + 124 : at + 136])
            if size is None or at + 512 + size > len(b):
                return self.fail(name, "truncated")
            body, kind = b[at + 512 : at + 512 + size], h[156:157]
            at += 512 + (size + 511) // 512 * 512
            inner = h[:100].split(b"\0")[0].decode("utf-8", "replace")
            if h[345:346] != b"\0" and h[257:262] == b"ustar":
                inner = h[345:500].split(b"\0")[0].decode("utf-8", "replace") + "/" + inner
            if kind == b"L":
                long_name = body.split(b"\0")[0].decode("utf-8", "replace")
            elif kind == b"x":
                found = [x.split(b"path=", 1)[1] for x in body.split(b"\n") if b" path=" in x]
                long_name = found[-1].decode("utf-8", "replace") if found else long_name
            else:
                full, long_name = member_name(name, long_name or inner), ""
                if kind in (b"0", b"\0", b"7"):
                    if not self.count(full):
                        return
                    self.add(full, body, depth)


def expand_archive(name: str, data: bytes, limits: Limits | None = None, wanted: Callable[[str], bool] = lambda n: True) -> list:
    """(name, content, failure) rows of one input; what is no archive is its own only row."""
    if not is_archive(data):
        return [(name, data, None)]
    e = Expander(limits or Limits(), wanted)
    e.expand(name, data)
    if e.failed > e.limits.failures:
        e.rows.append((name, None, f"{e.failed - e.limits.failures} more failures"))
    return e.rows


#: Bytes of members that are passed on together.
PASSED = 1 << 20


def give_back() -> None:
    """Returns freed memory of a Python worker, which lives on after its task, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _expanded(batches: Iterator[pa.RecordBatch], limits: Limits | None, wanted: Callable[[str], bool]) -> Iterator[pa.RecordBatch]:
    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.binary(), pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "path", "content", "failure"])

    try:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):  # one archive at a time: a batch of them is not copied whole
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for name, body, why in expand_archive(path or "", content or b"", limits, wanted):
                    rows.append((path, name, body, why))
                    held += len(body or b"") + len(name)
                if held > PASSED:
                    yield table_of(rows)
                    rows, held = [], 0
            if rows:
                yield table_of(rows)
    finally:
        give_back()


def expand_archives(files: DataFrame, limits: Limits | None = None, wanted: Callable[[str], bool] = lambda n: True) -> DataFrame:
    """(file, path, content, failure) of ``files`` (path, content): one row a member or failure. Narrow; a task holds
    one archive's members at a time, within its budget, and ``PASSED`` bytes of members before it."""

    return files.select("path", "content").mapInArrow(lambda batches: _expanded(batches, limits, wanted), "file string, path string, content binary, failure string")
