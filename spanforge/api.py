"""Detectors: models and a profile over documents; findings, documents, head decisions and redacted copies as DataFrames.

    found = Detector([model_bytes], profile="none").detect(docs)      # docs: doc_id, file, content
    found.findings.show()
    Detector([model_bytes]).redact(docs)                              # doc_id, s, out, entries

The profiles ``secrets-code`` and ``secrets-binary`` follow the order of rules that this package reconstructed.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import bytestr as B
from .functions import values as V
from .functions.text import utf16_text
from .functions.values import in_dependency_folder, is_source_text_name, path_severity
from .model.network import Network
from .model.run import Options, head_values, scan_documents, spans, window_totals
from .operators import code_rules as C
from .operators import heads as H
from .operators import intervals as I
from .operators import redact as R
from .operators.views import masked_views

# The profiles, and the largest input of each in bytes.
PROFILES = {"none": 1 << 30, "redact": 1 << 30, "secrets-code": 4_000_000, "secrets-binary": 64 << 20}
TOO_SHORT = "the input is shorter than the model's shortest window: not analyzed"


@dataclass(frozen=True)
class Request:
    votes: int = 0
    min_confidence: float = 0.0
    window: int | None = None
    stride: int | None = None
    reveal: bool = False
    gap: int = 4
    marker: str = "spanforge:allow"
    strings_only: bool = True
    options: Options = field(default_factory=Options)


@dataclass
class Detection:
    """``findings``, ``documents`` and ``failures`` are DataFrames; ``heads``: head name to a DataFrame by document;
    ``per_model``: what each member found before the vote."""

    findings: DataFrame
    documents: DataFrame
    failures: DataFrame
    heads: dict[str, DataFrame]
    per_model: DataFrame


class Detector:
    def __init__(self, models: list[bytes], profile: str | None = None, key: str = "doc_id"):
        self.models, self.key = [bytes(m) for m in models], key
        self.networks = [Network(m) for m in self.models]
        if not models or len({tuple(n.entities) for n in self.networks}) > 1:
            raise ValueError("one model or more, with the same types, are wanted")
        self.profile = profile or self.networks[0].profile
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile {self.profile}; known: {', '.join(PROFILES)}")

    def wants_file(self, name: Column) -> Column:
        return is_source_text_name(name) if self.profile == "secrets-code" else F.lit(True)

    def wants_folder(self, path: Column) -> Column:
        return ~in_dependency_folder(path) if self.profile == "secrets-code" else ~F.array_contains(F.split(path, "/"), ".git")

    def severity(self, path: Column) -> Column:
        return path_severity(path) if self.profile == "secrets-code" else F.lit("error")

    def _documents(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((key, file, s), failures); UTF-16 is read as UTF-8 by ``secrets-code``."""
        size = F.octet_length("content")
        failures = docs.where(size > PROFILES[self.profile]).select("file", F.lit("larger than the limit").alias("reason"))
        s = F.decode(F.coalesce("content", F.lit(b"")), "ISO-8859-1")
        if self.profile == "secrets-code":
            wide = utf16_text(s)
            s = F.when(wide.isNotNull(), B.byte_string(wide)).otherwise(s)
        return docs.where(size.isNull() | (size <= PROFILES[self.profile])).select(self.key, "file", s.alias("s")), failures

    def _scanned(self, d: DataFrame, request: Request) -> list[DataFrame]:
        """Window results of each member, cut from their lineage: several outputs read them."""
        return [self._results(d, m, request).checkpoint() for m in self.models]

    def _results(self, d: DataFrame, model: bytes, request: Request) -> DataFrame:
        return scan_documents(d, model, self.key, "s", request.window, request.stride, request.options)

    def _found(self, results: DataFrame, d: DataFrame, request: Request, model: bytes) -> DataFrame:
        """(key, ord, start, end, type, conf, base64, inner_start, inner_end) that one member reports."""
        key, raw = self.key, spans(results, self.networks[0].entities, self.key)
        raw = raw.withColumn("source", F.lit("model")).withColumn("ord", self._order(F.col("type")))
        none = [F.lit(False).alias("base64"), F.lit(None).cast("bigint").alias("inner_start"), F.lit(None).cast("bigint").alias("inner_end")]
        plain = [key, "start", "end", "type", "conf", *none]
        if self.profile in ("none", "redact"):
            return I.resolve(raw, key).select(*plain)
        near = I.merge_nearby(raw, request.gap, key)
        if self.profile == "secrets-binary":
            return self._strings(near, d, request).select(*plain)
        return self._with_decoded(self._code(near, d, request, key).select(*plain), d, request, model)

    def _with_decoded(self, found: DataFrame, d: DataFrame, request: Request, model: bytes) -> DataFrame:
        """``found`` with what the model finds in the decoded text of readable base64 runs: such a finding stands for the
        whole run, with its own offsets inside; what was found in the undecoded run goes. Runs that decode to a name and
        a password stay as they are."""
        key = self.key
        blobs = C.readable_base64(d.select(key, "s"), key)
        blobs = blobs.where(~C.is_basic_auth(F.col("decoded"))).select(F.concat_ws(":", key, "start").alias("_run"), F.col(key).alias("_key"), F.col("start").alias("_a"), F.col("end").alias("_z"), F.col("decoded").alias("s")).checkpoint()
        results = scan_documents(blobs, model, "_run", "s", request.window, request.stride, request.options)
        near = I.merge_nearby(spans(results, self.networks[0].entities, "_run"), request.gap, "_run")
        inner = self._code(near, blobs, request, "_run").join(blobs.drop("s"), "_run")
        inner = inner.select(F.col("_key").alias(key), F.col("_a").alias("start"), F.col("_z").alias("end"), "type", "conf", F.lit(True).alias("base64"), F.col("start").alias("inner_start"), F.col("end").alias("inner_end"))
        within = (F.col(key) == F.col("_key")) & (F.col("_a") <= F.col("start")) & (F.col("end") <= F.col("_z"))
        return found.join(blobs.select("_key", "_a", "_z"), within, "left_anti").unionByName(inner)

    def _order(self, kind: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, self.networks[0].entities)).cast("array<string>"), kind)

    def _code(self, near: DataFrame, d: DataFrame, request: Request, key: str) -> DataFrame:
        docs = d.select(key, "s")
        payloads = C.data_uri_payloads(docs, key)
        r = payloads.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        kept = near.join(r, (F.col(key) == F.col("_k")) & (F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e")), "left_anti")
        cut = C.split_at_assignments(kept, docs, key).join(docs, key)
        s, a, z = F.col("s"), F.col("start"), F.col("end")
        value, literal = C.snap_to_value(s, a, z), C.snap_to_literal(s, a, z)
        cut = cut.withColumn("v", value).withColumn("l", literal)
        moved = (F.col("v.start") != a) | (F.col("v.end") != z)
        cut = cut.withColumn("r", F.when(moved, F.col("v")).otherwise(F.col("l")))
        cut = cut.withColumn("start", F.col("r.start")).withColumn("end", F.col("r.end")).drop("v", "l", "r")
        lined = C.line_around(s, a, z)  # a finding that is most of a short line becomes the line without its blanks
        most = (F.col("end") - F.col("start")) * 10 >= (lined["end"] - lined["start"]) * 9
        cut = cut.withColumn("w", F.when(most, lined)).withColumn("start", F.coalesce("w.start", "start")).withColumn("end", F.coalesce("w.end", "end")).drop("w")
        cut = cut.where(~C.is_documentation_example(s, a, z) & ~C.is_allowed(s, a, request.marker)).drop("s")
        whole = C.extend_to_block(cut, C.private_key_blocks(docs, key), key)
        return whole.groupBy(key, "start", "end").agg(F.max_by("type", F.struct("conf", "type")).alias("type"), F.max("conf").alias("conf"))

    def _strings(self, near: DataFrame, d: DataFrame, request: Request) -> DataFrame:
        key, s, a, z = self.key, F.col("s"), F.col("start"), F.col("end")
        own = near.join(d.select(key, "s"), key)
        if request.strings_only:
            own = own.where(C.touches_printable(s, a, z))
        own = own.withColumn("r", C.printable_string(s, a, z))
        own = own.withColumn("string", C.ascii_view(F.substr(s, (F.col("r.start") + 1).cast("int"), (F.col("r.end") - F.col("r.start")).cast("int"))))
        meta = C.manifest_lines(d.select(key, "s"), key).select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        own = own.join(meta, (F.col(key) == F.col("_k")) & (F.col("_s") <= F.col("r.start")) & (F.col("r.end") <= F.col("_e")), "left_anti")
        first = C.fold_repeats(own.select(key, "start", "end", "string"), key).select(key, "start", "end")
        return own.drop("s", "r", "string").join(first, [key, "start", "end"], "left_semi")

    def _voted(self, members: list[DataFrame], d: DataFrame, request: Request) -> DataFrame:
        key, need = self.key, I.votes_needed(len(members), request.votes)
        every = reduce(DataFrame.unionByName, [m.withColumn("member", F.lit(i)) for i, m in enumerate(members)])
        if len(members) == 1:
            return every.withColumn("votes", F.lit(1).cast("bigint"))
        if self.profile == "secrets-binary":
            kept = I.vote_by_offset(every, need, key).select(key, "start", "votes", "member")
            return every.join(kept, [key, "start", "member"])
        if self.profile == "secrets-code":
            at = every.join(d.select(key, "s"), key)
            text = F.substr("s", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
            at = at.withColumn("line", B.line_of(F.col("s"), F.col("start"))).withColumn("col", B.column_of(F.col("s"), F.col("start")))
            at = at.withColumn("points", F.char_length(B.to_text(text))).withColumn("multiline", F.contains(text, F.lit("\n"))).drop("s")
            kept = C.vote_by_line(at, need, key).select(key, "line", "col", "member", "votes").distinct()
            return at.join(kept, [key, "line", "col", "member"]).drop("line", "col", "points", "multiline")
        kept = I.vote_by_overlap(every, need, key).select(key, "type", "start", "end", "member", "votes").distinct()
        return every.join(kept, [key, "type", "start", "end", "member"])

    def detect(self, docs: DataFrame, request: Request = Request()) -> Detection:
        """``docs``: key (unique), file, content; and path, where severity goes by another path than the file name."""
        key = self.key
        docs = docs if "path" in docs.columns else docs.withColumn("path", F.col("file"))
        d, failures = self._documents(docs)
        results = self._scanned(d, request)
        members = [self._found(r, d, request, m).checkpoint() for r, m in zip(results, self.models)]
        findings = self._voted(members, d, request).where(F.col("conf") >= request.min_confidence).drop("member").checkpoint()
        raw = [spans(r, self.networks[0].entities, key).select(key, "start", "end", F.lit(False).alias("base64")) for r in results]
        hidden = I.hidden(reduce(DataFrame.union, [*raw, *[m.select(key, "start", "end", "base64") for m in members]]), key)
        binary = self.profile == "secrets-binary"
        seen = masked_views(d, findings, hidden, key, "s", binary)
        s, a, z = F.col("s"), F.col("start"), F.col("end")
        out = seen.join(d, key).join(docs.select(key, "path"), key)
        run = F.substr(s, (a + 1).cast("int"), (z - a).cast("int"))
        inner = F.substr(C.decoded_run(run), (F.col("inner_start") + 1).cast("int"), (F.col("inner_end") - F.col("inner_start")).cast("int"))
        value = F.when(F.col("base64"), inner).otherwise(run)
        last = B.line_of(s, a) + F.length(run) - F.length(F.replace(run, F.lit("\n"), F.lit("")))
        place = (
            [F.concat(F.lit("0x"), F.lower(F.hex("start"))).alias("offset_hex")]
            if binary
            else [B.line_of(s, a).alias("line"), B.column_of(s, a).alias("col"), B.code_point_column(s, a).alias("column"), F.when(~F.col("base64"), last).alias("end_line")]
        )
        place += [F.col("base64").alias("inside_base64"), "inner_start", "inner_end"]
        clear = [B.to_text(value).alias("snippet")] if request.reveal else []
        out = out.select(
            key, "file", F.col("type").alias("kind"), self.severity(F.col("path")).alias("severity"), "start", "end", *place, F.col("conf").alias("confidence"), "votes",
            V.mask(B.to_text(value)).alias("snippet_masked"), F.col("view").alias("string_masked" if binary else "context_masked"), *clear,
        )
        totals = window_totals(results[0], key)
        per = d.select(key, "file", F.length("s").cast("bigint").alias("bytes")).join(totals, key, "left")
        count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias({"skipped": "windows_skipped", "exited": "windows_exited", "positive": "positive_windows"}.get(c, c))
        note = F.when((F.col("bytes") > 0) & F.col("windows").isNull(), TOO_SHORT)
        documents = per.select(key, "file", "bytes", *map(count, ("windows", "skipped", "exited", "positive")), note.alias("note"))
        per_model = reduce(DataFrame.unionByName, [m.withColumn("member", F.lit(i)) for i, m in enumerate(members)])
        return Detection(out, documents, failures, self._heads(results[0]), per_model)

    def _heads(self, results: DataFrame) -> dict[str, DataFrame]:
        """Each window-level head's answer by document, as the head's own rule sums its windows up."""
        out = {}
        for h in self.networks[0].heads:
            rows = head_values(results, h.index, self.key).select(self.key, "win", F.transform("values", lambda x: x.cast("double")).alias("values"))
            if h.kind == "choice":
                out[h.name] = H.choice_vote(rows, self.key) if h.aggregate == "vote" else H.elementwise(rows, self.key).withColumn("label", H.first_argmax(F.col("values"))) if h.aggregate == "mean" else H.choice_max(rows, self.key)
            elif h.kind in ("multilabel", "score"):
                out[h.name] = H.elementwise(rows, self.key, {"any": "max"}.get(h.aggregate, h.aggregate))
            elif h.kind == "ordinal":
                out[h.name] = H.ordinal_max(rows, self.key) if h.aggregate == "max" else H.elementwise(rows, self.key).withColumn("level", H.ordinal_level(F.col("values")))
        return out

    def decide(self, docs: DataFrame, request: Request = Request()) -> DataFrame:
        """(key, positive): any finding; without a tag head, a class other than 0 of the first choice head. Places and
        views of findings are not made for it."""
        d, _ = self._documents(docs)
        if self.networks[0].entities:
            members = [self._found(self._results(d, m, request), d, request, m).checkpoint() for m in self.models]
            hit = self._voted(members, d, request).where(F.col("conf") >= request.min_confidence).select(self.key).distinct()
        else:
            name = next(h.name for h in self.networks[0].heads if h.kind == "choice")
            hit = self._heads(self._results(d, self.models[0], request))[name].where("label != 0").select(self.key)
        return docs.select(self.key).join(hit.withColumn("positive", F.lit(True)), self.key, "left").na.fill(False)

    def redact(self, docs: DataFrame, request: Request = Request(), types: list[str] | str | None = None) -> DataFrame:
        """(key, s, out, entries, content, encoding, refused): redacted copies by what the detector finds in each whole
        document, however short. ``types``: those that are redacted, as a list or with commas.

        A document in UTF-16 is searched as text; ``content`` is its copy in its own encoding, which ``encoding`` names,
        with whole characters replaced. One over the profile's limit has no copy, and ``refused`` says so."""
        key = self.key
        d, failures = self._documents(docs.withColumn("file", F.col(key).cast("string")))
        raw = F.decode(F.coalesce("content", F.lit(b"")), "ISO-8859-1")
        encoding = F.when(utf16_text(raw).isNotNull(), F.when(raw.startswith("\xff\xfe"), "UTF-16LE").otherwise("UTF-16BE"))
        wide = docs.select(key, encoding.alias("encoding"), F.when(encoding.isNotNull(), B.byte_string(utf16_text(raw))).alias("wide"))
        d = d.select(key, "s").join(wide, key).select(key, F.coalesce("wide", "s").alias("s"), "encoding")
        request = replace(request, options=replace(request.options, least=1))
        members = [self._found(r, d, request, m) for r, m in zip(self._scanned(d, request), self.models)]
        found = self._voted(members, d, request).where(F.col("conf") >= request.min_confidence)
        if types:
            found = found.where(F.col("type").isin(types.split(",") if isinstance(types, str) else types))
        found = found.withColumn("source", F.lit("model")).withColumn("ord", self._order(F.col("type")))
        found = R.whole_characters(found.select(key, "ord", "start", "end", "type", "conf", "source"), d.where("encoding IS NOT NULL"), key)
        out = R.redact(d, found, key).join(d.select(key, "encoding"), key)
        little, big = (F.concat(F.lit(mark), F.encode(B.to_text(F.col("out")), name)) for mark, name in ((b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")))
        content = F.when(F.col("encoding") == "UTF-16LE", little).when(F.col("encoding") == "UTF-16BE", big).otherwise(B.to_bytes(F.col("out")))
        out = out.select(key, "s", "out", "entries", content.alias("content"), "encoding", F.lit(None).cast("string").alias("refused"))
        kind = docs.schema[key].dataType
        refused = failures.select(F.col("file").cast(kind).alias(key), *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("s", "out", "entries", "content", "encoding")], F.col("reason").alias("refused"))
        return out.union(refused)
