"""Verification: what must be gone from an output is gone, and the certificate that says so.

Checks are struct(id, passed, detail); details never hold a secret, only its hash. Null texts count as empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact_text, let, normalize_text

FORMAT = "redact-certificate/v1"
#: Bytes that a form of a secret has at least to be looked for.
LEAST_BYTES = 4
CHECK = "struct<id:string,passed:boolean,detail:string>"


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def forms(output: Column) -> Column:
    """struct(plain, compact): the forms in which secrets are looked for. Bind them once for an output, not for each secret."""
    text = F.coalesce(output, F.lit(""))
    return F.struct(normalize_text(text).alias("plain"), compact_text(text).alias("compact"))


def in_forms(secret: Column, of: Column) -> Column:
    """Whether the secret's plain or its compact form is in the output's; forms under LEAST_BYTES are not looked for."""
    found = lambda form: lambda s: (F.octet_length(s) >= LEAST_BYTES) & form.contains(s)
    return F.coalesce(let(normalize_text(secret), found(of["plain"])) | let(compact_text(secret), found(of["compact"])), F.lit(False))


def still_there(secret: Column, output: Column) -> Column:
    """in_forms() for an output and a single secret."""
    return let(forms(output), lambda of: in_forms(secret, of))


def text_removal(secrets: Column, output: Column) -> Column:
    """The check that none of an array of secrets is in the output; its detail lists the hashes of those that are."""
    left = let(forms(output), lambda of: F.filter(F.coalesce(secrets, F.array().cast("array<string>")), lambda s: in_forms(s, of)))
    return let(left, lambda x: F.struct(F.lit("text-removal").alias("id"), (F.size(x) == 0).alias("passed"), F.array_join(F.transform(x, sha256_hex), ",").alias("detail")))


def secrets_of(regions: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "source_text") -> DataFrame:
    """Distinct texts of the regions that are included."""
    return regions.where(F.col("included") & (F.length(text) > 0)).select(*keys, F.col(text).alias("secret")).distinct()


def verify_text(outputs: DataFrame, secrets: DataFrame, key: str = "doc_id", text: str = "masked") -> DataFrame:
    """key, checks, passed: text-removal for every output, those without secrets too.

    Secrets of one output are looked for where its text is: the join is by document, on the secrets grouped first.
    """
    grouped = secrets.groupBy(key).agg(F.sort_array(F.collect_set("secret")).alias("secrets_"))
    joined = outputs.select(key, F.col(text).alias("text_")).join(grouped, key, "left")
    out = joined.select(key, F.array(text_removal(F.col("secrets_"), F.col("text_"))).alias("checks"))
    return out.withColumn("passed", F.forall("checks", lambda c: c.passed))


def certify(outcome: DataFrame) -> DataFrame:
    """A certificate for each row that passed; rows that failed have none.

    Needs doc_id, input, output (texts or binary), input_pages, output_pages, redactions (array of page_index, category,
    confidence, text), checks. Refuses outputs with other page counts, redactions on pages that aren't there, and
    confidences that are no numbers.
    """
    ok = F.forall("checks", lambda c: c.passed) & (F.size("checks") > 0)
    sane = F.forall("redactions", lambda r: r.confidence.isNotNull() & ~F.isnan(r.confidence) & r.page_index.between(0, F.col("output_pages") - 1))
    hashed = F.transform(
        "redactions",
        lambda r: F.struct(r.page_index.alias("pageIndex"), r.category.alias("category"), F.round(F.least(F.greatest(r.confidence, F.lit(0.0)), F.lit(1.0)), 3).alias("confidence"), sha256_hex(r.text).alias("textSha256")),
    )
    side = lambda name: F.struct(sha256_hex(F.col(name)).alias("sha256"), F.col(f"{name}_pages").alias("pageCount"))
    clean = F.transform("checks", lambda c: F.struct(c.id.alias("id"), c.passed.alias("passed"), F.lit("").alias("detail")))
    return outcome.where(ok & sane & (F.col("input_pages") == F.col("output_pages"))).select(
        "doc_id",
        F.to_json(
            F.struct(
                F.lit(FORMAT).alias("format"),
                F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
                F.struct(F.lit("inkveil").alias("name"), F.lit("0.1.0").alias("version")).alias("tool"),
                side("input").alias("input"),
                side("output").alias("output"),
                hashed.alias("redactions"),
                F.struct(F.lit(True).alias("passed"), clean.alias("checks")).alias("verification"),
            )
        ).alias("certificate"),
    )


_CERTIFICATE = (
    "format string, createdAt string, tool struct<name:string,version:string>, input struct<sha256:string,pageCount:int>, output struct<sha256:string,pageCount:int>, "
    "redactions array<struct<pageIndex:int,category:string,confidence:double,textSha256:string>>, verification struct<passed:boolean,checks:array<struct<id:string,passed:boolean,detail:string>>>"
)
_HASH = "^[0-9a-f]{64}$"


def has_other_fields(json: Column, known: tuple[str, ...]) -> Column:
    """Whether a JSON object has fields beside the known ones; null isn't an object and has none."""
    return F.coalesce(F.size(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, known)))) > 0, F.lit(False))


def _unknown(json: Column) -> Column:
    parts = F.from_json(json, "tool string, input string, output string, redactions array<string>, verification string")
    checks = F.from_json(parts.verification, "checks array<string>").checks
    any_ = lambda items, known: F.coalesce(F.exists(items, lambda x: has_other_fields(x, known)), F.lit(False))
    return (
        has_other_fields(json, ("format", "createdAt", "tool", "input", "output", "redactions", "verification"))
        | has_other_fields(parts.tool, ("name", "version")) | has_other_fields(parts.input, ("sha256", "pageCount")) | has_other_fields(parts.output, ("sha256", "pageCount"))
        | has_other_fields(parts.verification, ("passed", "checks")) | any_(parts.redactions, ("pageIndex", "category", "confidence", "textSha256")) | any_(checks, ("id", "passed", "detail"))
    )


def certificate_errors(json: Column) -> Column:
    """Codes of what is wrong with a certificate; empty for a sound one.

    Stricter than the format asks: a time that certify() doesn't write, a file without pages and a verification without
    checks are errors as well.
    """
    from ..functions.catalog import GROUPS

    c = F.from_json(json, _CERTIFICATE)
    keys = F.json_object_keys(json)
    found = [
        ("not-json", c.isNull() | keys.isNull()),
        ("unknown-field", _unknown(json)),
        ("format", ~c.format.eqNullSafe(F.lit(FORMAT))),
        ("created-at", ~F.coalesce(c.createdAt.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.lit(False))),
        ("hash", ~F.coalesce(c.input.sha256.rlike(_HASH) & c.output.sha256.rlike(_HASH), F.lit(False))),
        ("page-count", ~F.coalesce((c.input.pageCount == c.output.pageCount) & (c.output.pageCount > 0), F.lit(False))),
        ("redaction", ~F.coalesce(F.forall(c.redactions, lambda r: r.pageIndex.between(0, c.output.pageCount - 1) & r.category.isin(*GROUPS) & r.confidence.between(0, 1) & r.textSha256.rlike(_HASH)), F.lit(False))),
        ("verification", ~F.coalesce(c.verification.passed & (F.size(c.verification.checks) > 0) & F.forall(c.verification.checks, lambda x: x.passed), F.lit(False))),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in found)))


def certificate_matches(json: Column, output: Column) -> Column:
    return F.coalesce(F.get_json_object(json, "$.output.sha256") == sha256_hex(output), F.lit(False))


# --- bytes of a PDF file ---

_DELIMITERS = b"()<>[]{}/% \t\r\n\f\0"


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(data: bytes) -> bytes:
    """A string of a PDF file without its brackets: escapes and line ends resolved."""

    def one(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\r\n", b"\r", b"\n") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|[\s\S])", one, data)


def _hexadecimal(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def info_text(data: bytes) -> str:
    """A string of the document information: UTF-16 with a mark, or without one where it is ASCII, else UTF-8. Never dropped."""
    for mark, kind in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if data.startswith(mark):
            whole = data[2 : 2 + (len(data) - 2) // 2 * 2]
            try:
                return whole.decode(kind)
            except UnicodeDecodeError:
                break
    else:
        if len(data) >= 6 and len(data) % 2 == 0 and not any(data[::2]) and max(data[1::2]) < 128:
            return data[1::2].decode()
    return data.decode("utf-8", "replace")


#: Keys of the document information, as a snapshot names them.
INFO = {b"/Title": "title", b"/Author": "author", b"/Subject": "subject", b"/Keywords": "keywords", b"/Creator": "creator", b"/Producer": "producer"}


def metadata_snapshot(data: bytes) -> dict[str, str]:
    """The information strings of a PDF file, from its dictionaries outside streams; the first one that isn't blank counts.

    A value of white space alone that isn't empty is shown as a replacement character, for it may hide something.
    """
    out: dict[str, str] = {}
    for key, value in scan_pdf(data)[2]:
        name = INFO.get(key)
        if name and not out.get(name):
            text = info_text(value)
            out[name] = text if text.strip() or not value or not value.strip(b" \t\r\n\f\0") else "\ufffd"
    return out


def is_encrypted(data: bytes) -> bool:
    return b"/Encrypt" in scan_pdf(data)[1]


def scan_pdf(data: bytes) -> tuple[bytes, list[bytes], list[tuple[bytes, bytes]]]:
    """data with stream bodies blanked, the names outside strings, comments and streams, and the strings that follow a name.

    A body begins after "stream" and a line end, where the keyword follows a dictionary, and ends at "endstream".
    """
    out, names, strings, at, n = bytearray(data), [], [], 0, len(data)
    last = b""
    while at < n:
        c = data[at : at + 1]
        if c == b"%":
            ends = [e for e in (data.find(b"\n", at), data.find(b"\r", at)) if e >= 0]
            at = min(ends, default=n)
        elif c == b"(":
            depth, at, begin = 1, at + 1, at + 1
            while at < n and depth:
                if data[at] == 0x5C:
                    at += 1
                elif data[at] == 0x28:
                    depth += 1
                elif data[at] == 0x29:
                    depth -= 1
                at += 1
            if last == b"/":
                strings.append((names[-1], _literal(data[begin : at - 1 if not depth else n])))
            last = b")"
        elif data[at : at + 2] in (b"<<", b">>"):
            last, at = data[at : at + 2], at + 2
        elif c == b"<":
            end = data.find(b">", at)
            if last == b"/":
                strings.append((names[-1], _hexadecimal(data[at + 1 : n if end < 0 else end])))
            at = n if end < 0 else end + 1
            last = b">"
        elif c == b"/":
            end = at + 1
            while end < n and data[end] not in _DELIMITERS:
                end += 1
            names.append(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data[at:end]))
            at, last = end, b"/"
        elif c in b" \t\r\n\f\0[]{})>":
            at += 1
        else:
            end = at
            while end < n and data[end] not in _DELIMITERS:
                end += 1
            word = data[at:end]
            at = end
            if word == b"stream" and last == b">>" and data[at : at + 1] in (b"\r", b"\n"):
                body = at + (2 if data[at : at + 2] == b"\r\n" else 1)
                end = data.find(b"endstream", body)
                end = n if end < 0 else end
                out[body:end] = b" " * (end - body)
                at = end
            last = word
    return bytes(out), names, strings


def check_pdf(data: bytes, secrets: list[bytes]) -> list[tuple[str, bool, str]]:
    """The checks on a file's bytes: metadata-clean, annotations-removed, raw-byte-scan, full-save."""
    import hashlib

    blank, names, _ = scan_pdf(data)
    info = metadata_snapshot(data)
    filled = [k for k in ("title", "author", "subject", "keywords") if info.get(k, "").strip()]
    metadata = bool(filled) or b"<?xpacket" in data or b"/Metadata" in names
    left = []
    for s in secrets:
        forms = {s, b"".join(s.split())}
        if any(len(f) >= LEAST_BYTES and f in blank for f in forms):
            left.append(hashlib.sha256(s).hexdigest())
    return [
        ("metadata-clean", not metadata, ",".join(filled)),
        ("annotations-removed", names.count(b"/Annots") == 0, str(names.count(b"/Annots"))),
        ("raw-byte-scan", not left, ",".join(left)),
        ("full-save", b"/Prev" not in names, ""),
    ]
