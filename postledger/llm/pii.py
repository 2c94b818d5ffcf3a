"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postledger.shared import cut

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. A run of digits, or of name characters, is entered at its start
# only, which finds the same leftmost matches without trying every later start.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9]")
HINT = re.compile(r"[0-9@]+")

LONGEST = 64  # characters of a candidate
AROUND = 80  # characters of context
MIN_PRECISION = 0.8  # share of known instances among all that a pattern has
MIN_SUPPORT = 3.0  # sum of the scores of its instances
MIN_SCORE = 0.8  # from here on an instance counts as known in the next round
ROUNDS = 3


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # characters before this belong to a match
    for m in DOMAIN.finditer(text):
        begin = m.start()
        while begin > free and text[begin - 1] in NAME:
            begin -= 1
        if begin < m.start():
            yield begin, m.end()
            free = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` of every match that passes its kind's test."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            spans.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = "".join(DIGITS.findall(m.group())) if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGITS.findall(m.group())) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def loose_kinds(token: str) -> int:
    """Bits of the kinds whose identifiers could look like this token."""
    digits = len(DIGITS.findall(token))
    bits = 0
    if "@" in token and len(token) >= 5:
        bits |= 1
    if digits and re.fullmatch(r"[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,7}", token):
        bits |= 2
    if 12 <= digits <= 19 and re.fullmatch(r"[0-9](?:[ -]?[0-9])+", token):
        bits |= 4
    if 7 <= digits <= 15 and re.fullmatch(r"\+?[0-9(][0-9().-]*[0-9]", token):
        bits |= 8
    return bits


def _word(text: str) -> str:
    return text.strip(".,;:!?()[]{}<>\"'").lower()


def contexts(text: str, start: int, end: int) -> tuple[str, str] | None:
    """Two lexical patterns: the two words before, and the words on both sides."""
    left = text[max(0, start - AROUND) : start].split()[-2:]
    right = text[end : end + AROUND].split()[:1]
    left, right = [_word(w) for w in left], [_word(w) for w in right]
    if not left or not left[-1]:
        return None
    return " ".join([*left, "_"]), " ".join([left[-1], "_", *right])


def candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or @ that no base span touches."""
    taken = sorted((a, b) for _, a, b in spans)
    at, done = 0, 0
    for m in HINT.finditer(text):
        if m.start() < done:
            continue
        begin, end = m.start(), m.end()
        while begin > 0 and not text[begin - 1].isspace() and m.start() - begin <= LONGEST:
            begin -= 1
        while end < len(text) and not text[end].isspace() and end - m.end() <= LONGEST:
            end += 1
        done = end
        while begin < end and text[begin] in ".,;:!?()[]{}<>\"'":
            begin += 1
        while end > begin and text[end - 1] in ".,;:!?()[]{}<>\"'":
            end -= 1
        while at < len(taken) and taken[at][1] <= begin:
            at += 1
        if begin < end <= begin + LONGEST and not (at < len(taken) and taken[at][0] < end):
            yield begin, end


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("loose", pa.int32()), ("patterns", pa.list_(pa.string()))])
NAMES = ["row", "doc_id", "spans", "mentions"]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        spans, mentions, keys = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            own = sorted(base_spans(text))
            met = []
            for kind, a, b in [*own, *((-1, a, b) for a, b in candidates(text, own))]:
                token = text[a:b] if b - a <= LONGEST else hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()
                patterns = contexts(text, a, b)
                if patterns:
                    met.append({"kind": kind, "start": a, "end": b, "instance": token, "loose": loose_kinds(token) if kind < 0 else 1 << kind, "patterns": list(dict.fromkeys(patterns))})
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
            mentions.append(met)
            keys.append(row)
            row += 1
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), pa.array(spans, pa.list_(SPAN)), pa.array(mentions, pa.list_(MENTION))], NAMES)


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row its base spans, and every mention with its contexts; settled, so ``row`` stays."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = "struct<kind:int,start:bigint,end:bigint>"
    mention = "struct<kind:int,start:bigint,end:bigint,instance:string,loose:int,patterns:array<string>>"
    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut(rows.mapInArrow(_extract, f"row long, doc_id {kind}, spans array<{span}>, mentions array<{mention}>"), "pii-spans")


def bootstrap(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, kind, precision``: contexts that announce one kind of identifier.

    The graph has an edge for every pattern and instance met together anywhere, however
    often, so copies of a text add nothing. Base matches start with score 1 for their
    kind. Each round scores a pattern by the scores of its instances against their
    number, keeps those above MIN_PRECISION and MIN_SUPPORT, and scores every
    instance by 1 - product(1 - precision) over the kept patterns of a kind that it
    could be. Instances above MIN_SCORE count as known in the next round.
    """
    edges = mentions.select(F.explode("patterns").alias("pattern"), "instance", "kind", "loose")
    # Of one instance's mentions a base match wins.
    edges = cut(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("loose").alias("loose")), "pii-edges")
    degrees = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SUPPORT)
    seeds = edges.where("kind >= 0").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0))
    known, good = seeds, None
    for _ in range(rounds):
        sums = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("support"))
        good = (
            sums.where(F.col("support") >= MIN_SUPPORT)
            .join(degrees, "pattern")
            .select("pattern", "kind", (F.col("support") / F.col("n")).alias("precision"))
            .where(F.col("precision") >= MIN_PRECISION)
        )
        good = cut(good, "pii-patterns")
        # log(1 - p) adds up where 1 - p multiplies; certain patterns count as 0.999.
        miss = F.sum(F.log(1 - F.least("precision", F.lit(0.999))))
        found = (
            edges.where("kind < 0")
            .join(good.withColumnRenamed("kind", "as_kind"), "pattern")
            .where(F.expr("(loose & shiftleft(1, as_kind)) > 0"))
            .groupBy("instance", F.col("as_kind").alias("kind"))
            .agg((1 - F.exp(miss)).alias("score"))
            .where(F.col("score") >= MIN_SCORE)
        )
        known = cut(seeds.unionByName(found), "pii-known")
    return good


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found``, one row per input row.

    The counts and ``base_sha256`` are those of the fixed patterns; ``spans`` lists
    ``kind:start:end`` by kind, then start, of these and of the ``n_found`` identifiers that
    high-confidence contexts announce. Offsets are code points, ends exclusive.

    NULL text counts as empty: no spans, the digest of the empty string. Repeated
    rows and NULL ids are rows of their own. An empty table gives an empty table;
    other columns are not read.
    """
    rows = extract(docs, id_col, text_col)
    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    patterns = bootstrap(mentions, rounds)
    # A hot pattern's mentions are split by the adaptive skew join; the other side has a row per pattern.
    new = (
        mentions.where("kind < 0 and loose > 0")
        .select("row", "start", "end", "loose", F.explode("patterns").alias("pattern"))
        .join(patterns.withColumnRenamed("kind", "as_kind"), "pattern")
        .where(F.expr("(loose & shiftleft(1, as_kind)) > 0"))
        .groupBy("row", "start", "end")
        .agg(F.max_by("as_kind", F.struct("precision", -F.col("as_kind"))).alias("kind"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    found = F.coalesce("found", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select("row", "doc_id", "spans").join(new, "row", "left").select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("spans", found)).alias("spans"),
        F.size(found).cast("long").alias("n_found"),
    )
