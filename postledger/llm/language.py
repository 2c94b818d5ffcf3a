"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postledger.llm.workers import once, sliced

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 256  # bounds the matrix that every task gets: 256 x 32768 x 4 bytes
UNKNOWN = "und"
SCALE = 1 << 20  # log-probabilities are whole multiples of 1/SCALE, so sums do not depend on their order
PIECE = 1 << 18  # characters worked on at once


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts by their places in the batch, about PIECE characters at a time; a longer text comes in several pieces."""
    places, held, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), PIECE):
            part = text[at : at + PIECE]
            places.append(i)
            held.append(part)
            size += len(part)
            if size >= PIECE:
                yield places, held
                places, held, size = [], [], 0
    if held:
        yield places, held


def gram_buckets(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of letters and word ends.

    A run of other characters counts as one word end, so digits, marks and layout
    have no say in the language.
    """
    lower = [t.lower() for t in texts]
    letters = once("letters", _letter_table)
    code = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])
    letter = letters[np.minimum(code, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    letter, owner = letter[keep], owner[keep]
    code = np.where(letter, code[keep], 32).astype(np.uint64)
    found, whose = [], []
    for n in ORDERS:
        last = len(code) - n + 1
        if last <= 0:
            continue
        h = np.full(last, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ code[k : k + last]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        own = owner[:last] == owner[n - 1 :] if n > 1 else letter
        found.append((h[own] >> np.uint64(20)).astype(np.int64) & (buckets - 1))
        whose.append(owner[:last][own])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(whose)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in sliced(batches):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for places, held in _pieces(texts):
            names, label = np.unique([langs[i] for i in places], return_inverse=True)
            bucket, owner = gram_buckets(held)
            n = np.bincount(label[owner] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for row, name in zip(n, names.tolist()):
                counts[name] = counts[name] + row if name in counts else row
    for name, row in counts.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])


class Model:
    """Languages and their scaled log-probabilities by bucket."""

    def __init__(self, langs: list[str], priors: np.ndarray, matrix: np.ndarray):
        self.langs, self.priors, self.matrix = langs, priors, matrix

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scaled log-likelihoods (text x language), and the n-grams of each text."""
        total = np.zeros((len(texts), len(self.langs)))
        grams = np.zeros(len(texts), dtype=np.int64)
        for places, held in _pieces(texts):
            bucket, owner = gram_buckets(held)
            at = np.array(places)
            np.add.at(grams, at, np.bincount(owner, minlength=len(held)))
            for j in range(len(self.langs)):
                # Whole numbers below 2**53: these sums are exact.
                np.add.at(total[:, j], at, np.bincount(owner, weights=self.matrix[j][bucket], minlength=len(held)))
        return total, grams

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, grams = self.sums(texts)
        logs = total / SCALE + self.priors
        logs -= logs.max(axis=1, keepdims=True)
        share = np.exp(logs)
        share /= share.sum(axis=1, keepdims=True)
        best = logs.argmax(axis=1)
        known = grams > 0
        names = [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
        return names, np.where(known, share[np.arange(len(texts)), best], 0.0)


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> Model:
    """Fit the model on all rows with a language.

    Counts are made per task with numpy and added up by Spark. The driver gets one
    number per language and bucket; more than ``max_languages`` languages are an error.
    """
    labelled = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    docs = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(docs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    langs = sorted(docs)
    counted = labelled.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), BUCKETS))
    place = {lang: i for i, lang in enumerate(langs)}
    counts[counted["lang"].map(place).to_numpy(dtype=int), counted["bucket"].to_numpy(dtype=int)] = counted["n"].to_numpy()
    matrix = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + BUCKETS))
    priors = np.log(np.array([docs[lang] for lang in langs]) / max(1, sum(docs.values()))) if langs else np.empty(0)
    return Model(langs, priors, np.round(matrix * SCALE).astype(np.int32))


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The ``carry`` columns of every row with ``lang_pred`` and ``score``, from the text alone.

    ``score`` is the posterior probability of the language; ``und`` with score 0 stands
    for texts that are NULL or without any letter. Equal scores go to the first
    language in code point order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double"
    # A text that is carried anyway travels once.
    at = carry.index(text_col) if text_col in carry else len(carry)
    width = len(carry)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, scores = shared.value.predict(batch.column(at).to_pylist())
            columns = [batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names[:width], "lang_pred", "score"])

    sent = kept if at < width else docs.select(*carry, F.col(text_col).alias("_text_to_score"))
    return sent.mapInArrow(score, schema)


def language_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per input row.

    The model learns from the rows that are not held out and have a language; rows
    with a NULL id are not held out. NULL, empty and letterless texts get ``und`` and
    0. Without any labelled row all texts do. Repeated rows are repeated; other
    columns are not read. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows.where(~held_out(F.col("doc_id"))))
    return identify(rows.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.5) -> DataFrame:
    """The rows whose text has a language, with all their columns.

    A document is rejected if it has no letter or no language reaches ``least_score``.
    The model learns as in :func:`language_labels`. If no row is labelled, nothing can
    be told and all rows with a letter stay.
    """
    model = train(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    if not model.langs:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    # Columns travel under numbers, so no name can clash with the predictions.
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    labelled = identify(numbered, model, numbered.columns, f"c{names.index(text_col)}")
    return labelled.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).drop("lang_pred", "score").toDF(*names)
