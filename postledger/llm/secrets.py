"""Secrets: fixed patterns, and encoded keys and tokens confirmed by their structure."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postledger.llm.workers import sliced
from postledger.shared import cut

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "private_key", "signed_token")
PRIVATE_KEY, SIGNED_TOKEN = 3, 4

# Fixed patterns and lengths. A run that is too short at its start is too short at
# every later start as well, so the least length can stand in the pattern.
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ASSIGNED = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

# Candidates by form: armoured block, three dotted segments, base64 run, hex run. A run
# is a candidate if its first byte can begin a structure that is looked for.
FORMS = (
    re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----([^-]*)-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    re.compile(r"(?<![A-Za-z0-9_.-])e[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?![A-Za-z0-9_-])"),
    re.compile(r"(?<![A-Za-z0-9+/_-])(?:M|b3BlbnNzaC1r)[A-Za-z0-9+/_-]{22,}={0,2}"),
    re.compile(r"(?<![0-9A-Fa-f])(?:30|6f70656e7373682d6b6579|6F70656E7373682D6B6579)[0-9A-Fa-f]{30,}"),
)
ARMOURED, DOTTED, BASE64, HEXED = range(4)

OPENSSH = b"openssh-key-v1\0"
# Bytes of a signature by algorithm, least and most.
SIGNATURES = {
    "HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64),
    "RS256": (128, 1024), "RS384": (128, 1024), "RS512": (128, 1024),
    "PS256": (128, 1024), "PS384": (128, 1024), "PS512": (128, 1024),
    "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114),
}
INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of every match of the fixed patterns that is long enough."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGNED]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str) -> Iterator[tuple[int, int, int, str]]:
    """``form, start, end, token`` of what may be an encoded structure."""
    armoured = []
    for form, pattern in enumerate(FORMS):
        for m in pattern.finditer(text):
            if form == ARMOURED:
                armoured.append((m.start(), m.end()))
                # Line ends may be escaped where a key stands in a string.
                yield form, m.start(), m.end(), re.sub(r"\\[nr]|[\s\"',\\]", "", m[1])
            elif not any(a <= m.start() < b for a, b in armoured):
                yield form, m.start(), m.end(), m[0]


def unbase64(token: str) -> bytes | None:
    """The bytes of plain or url-safe base64, with or without padding."""
    bare = token.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents that fill ``data`` exactly; None if the lengths do not add up."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one sequence with the fields of a private key, lengths nested to the last byte."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [tag for tag, _ in items]
    first = items[0][1]
    # A version, then only integers: RSA has nine, DSA six.
    if tags[0] == INTEGER and first in (b"\0", b"\1") and set(tags) == {INTEGER} and len(tags) in (6, 9):
        return all(len(x) >= 1 for _, x in items) and len(items[1][1]) >= 32
    # Version 1 and a secret number: a key on a curve.
    if tags[:2] == [INTEGER, OCTETS] and first == b"\1":
        return 16 <= len(items[1][1]) <= 80 and all(tag in (0xA0, 0xA1) for tag in tags[2:])
    # A key wrapped with its algorithm, behind a version if it is not encrypted.
    if tags[0] == INTEGER and first in (b"\0", b"\1"):
        items, tags = items[1:], tags[1:]
    elif tags != [SEQUENCE, OCTETS]:
        return False
    if tags[:2] != [SEQUENCE, OCTETS]:
        return False
    algorithm = der_items(items[0][1])
    return bool(algorithm) and algorithm[0][0] == OBJECT and len(algorithm[0][1]) >= 3 and len(items[1][1]) >= 16


def is_openssh_key(data: bytes) -> bool:
    """Whether counted fields follow the mark and fill the rest exactly."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def number() -> int:
        nonlocal at
        at += 4
        return int.from_bytes(data[at - 4 : at], "big") if at <= len(data) else 1 << 40

    def field() -> bytes:
        nonlocal at
        size = number()
        at += size
        return data[at - size : at] if at <= len(data) else b""

    cipher, kdf, _ = field(), field(), field()
    keys = number()
    if not cipher or not kdf or not 1 <= keys <= 64:
        return False
    return all(field() for _ in range(keys)) and bool(field()) and at == len(data)


def is_signed_token(token: str) -> bool:
    """Whether the header names an algorithm, the claims are an object and the signature has its length."""
    header, claims, signature = map(unbase64, token.split("."))
    try:
        header, claims = json.loads(header or b""), json.loads(claims or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or signature is None:
        return False
    least, most = SIGNATURES.get(header.get("alg") if isinstance(header.get("alg"), str) else "", (1, 0))
    return least <= len(signature) <= most


def confirmed_kind(form: int, token: str) -> int | None:
    if form == DOTTED:
        return SIGNED_TOKEN if is_signed_token(token) else None
    if form == HEXED:
        data = bytes.fromhex(token) if len(token) % 2 == 0 else None
    else:
        data = unbase64(token)
    return PRIVATE_KEY if data and (is_der_key(data) or is_openssh_key(data)) else None


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
CANDIDATE = pa.struct([("form", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("token", pa.string())])
SPAN_SQL = "struct<start:bigint,kind:int,end:bigint>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in sliced(iter([batch])):
            texts = [text or "" for text in part.column(1).to_pylist()]
            spans = [[dict(zip(("start", "kind", "end"), s)) for s in base_spans(text)] for text in texts]
            met = [[dict(zip(("form", "start", "end", "token"), c)) for c in candidates(text)] for text in texts]
            rows = pa.array(range(row, row + len(texts)), pa.int64())
            row += len(texts)
            yield pa.RecordBatch.from_arrays([rows, part.column(0), pa.array(spans, pa.list_(SPAN)), pa.array(met, pa.list_(CANDIDATE))], ["row", "doc_id", "spans", "met"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        forms, tokens = (batch.column(i).to_pylist() for i in (0, 1))
        kinds = pa.array([confirmed_kind(f, t) for f, t in zip(forms, tokens)], pa.int32())
        found = kinds.is_valid()
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(found), batch.column(1).filter(found), kinds.filter(found)], ["form", "token", "kind"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed``, one row per input row.

    The counts and ``base_sha256`` are those of the fixed patterns. Armoured blocks, dotted
    triples, base64 and hex runs are candidates besides: each different one is decoded once,
    wherever it stands, and reported if it is a private key (its encoding names the
    fields, its nested lengths fill it to the last byte) or a signed token (its header
    names an algorithm, its signature has that algorithm's length). ``spans`` lists
    ``kind:start:end`` of these ``n_confirmed`` and of the base spans by start, then kind.
    Offsets are code points, ends exclusive. Texts are read once and do not move.

    NULL text counts as empty: no spans, the digest of the empty string. Repeated rows
    and NULL ids are rows of their own. An empty table gives an empty table; other
    columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    candidate = "struct<form:int,start:bigint,end:bigint,token:string>"
    # Settled, so that a row keeps its number.
    rows = cut(docs.mapInArrow(_scan, f"row long, doc_id {kind}, spans array<{SPAN_SQL}>, met array<{candidate}>"), "secret-spans")
    met = rows.select("row", F.explode("met").alias("m")).select("row", "m.*")
    confirmed = met.select("form", "token").distinct().mapInArrow(_confirm, "form int, token string, kind int")
    found = (
        met.join(confirmed, ["form", "token"])
        .groupBy("row")
        .agg(F.collect_set(F.struct("start", "kind", "end")).alias("found"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    confirmed_spans = F.coalesce("found", F.array().cast(f"array<{SPAN_SQL}>"))
    return rows.select("row", "doc_id", "spans").join(found, "row", "left").select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)],
        F.sha2(joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("spans", confirmed_spans)).alias("spans"),
        F.size(confirmed_spans).cast("long").alias("n_confirmed"),
    )
