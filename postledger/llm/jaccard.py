"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postledger.llm.components import components
from postledger.llm.rows import without
from postledger.llm.shingles import mixed, shingle_sets
from postledger.llm.workers import short_batches, sliced
from postledger.shared import cut

WIDTH = 5
# Frequencies are counted in this many hashed classes: a bounded table (1 MB) whatever the corpus.
CLASSES = 1 << 18
CLASS_BITS = 18
SALTED_ROWS = 20_000  # documents of one frequent n-gram that share a first leader
LOOK_BACK = 4  # earlier n-grams of a document that are compared before a pair is made again
SEMI_ROWS = 1_000_000  # longest list of ids that is sent to every task: 8 MB

# A pair links when 100 * common >= 75 * union, that is 7 * common >= 3 * (size + size).


def least_common(a, b):
    """Smallest number of common n-grams of two linked sets of these sizes (numpy, or columns by SQL)."""
    return -(-3 * (a + b) // 7)


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def part_sizes(grams: np.ndarray) -> bytes:
    """How many n-grams fall into each of a power of two of hash ranges, about four in each."""
    bits = max(4, int(len(grams) // 4).bit_length())
    n = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(n, 255).astype(np.uint8).tobytes()


def part_bound(x: bytes, y: bytes) -> int | None:
    """Upper bound of the common n-grams: no range holds more than its smaller side. None if a range is full."""
    a, b = (np.frombuffer(z, dtype=np.uint8) for z in (x, y))
    if (a == 255).any() or (b == 255).any():
        return None
    k = min(len(a), len(b))
    return int(np.minimum(*(z.astype(np.int64).reshape(k, -1).sum(axis=1) for z in (a, b))).sum())


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        x, n, y, m = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
        good = []
        for i in range(batch.num_rows):
            bound = part_bound(x[i], y[i])
            good.append(bound is None or bound >= least_common(n[i], m[i]))
        mask = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def plausible(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs that the sizes of their sets' parts leave possible.

    This is the suffix filter before any text moves: both sets are cut at the same
    hashes and each part bounds what can be common. ``parts`` is about a tenth of
    the text and drops nearly all pairs that share little but a frequent passage.
    """
    kind = parts.schema["doc_id"].dataType.simpleString()
    one = lambda name, x: parts.select(F.col("doc_id").alias(name), F.col("parts").alias(x), F.col("n").alias(f"n{x}"))
    both = pairs.join(one("a", "x"), "a").join(one("b", "y"), "b").select("a", "b", "x", "nx", "y", "ny")
    # A pair comes more than once only if an id does.
    return both.mapInArrow(_plausible, f"a {kind}, b {kind}").distinct()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size and 128-bit digest; per task the frequency of each class."""
    counts = np.zeros(CLASSES, dtype=np.int64)
    names = ["doc_id", "n", "sum", "mix", "parts", "class", "count"]
    kind = None
    for batch in sliced(batches):
        kind = batch.schema.types[0]
        n, total, mix, parts = [], [], [], []
        for grams in shingle_sets(batch.column(1).to_pylist(), WIDTH):
            np.add.at(counts, (grams >> np.uint64(64 - CLASS_BITS)).astype(np.int64), 1)
            n.append(len(grams))
            total.append(grams.sum(dtype=np.uint64))
            mix.append(np.bitwise_xor.reduce(mixed(grams + np.uint64(1)), initial=np.uint64(0)))
            parts.append(part_sizes(grams))
        none = pa.nulls(len(n), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (total, mix)), pa.array(parts, pa.binary()), none, pa.nulls(len(n), pa.int64())], names
        )
    at = np.flatnonzero(counts)
    if kind is not None:
        gone = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), gone, gone, gone, pa.nulls(len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names)


def summaries(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Per document ``doc_id, n, sum, mix, parts``; and the number of documents by class of n-gram."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    read = cut(rows.mapInArrow(_summaries, f"doc_id {kind}, n long, sum long, mix long, parts binary, class int, count long"), "ngram-sets")
    counted = read.where("class is not null").groupBy("class").agg(F.sum("count").alias("n")).toPandas()
    counts = np.zeros(CLASSES, dtype=np.int64)
    counts[counted["class"].to_numpy(dtype=int)] = counted["n"].to_numpy()
    return read.where("class is null").select("doc_id", "n", "sum", "mix", "parts"), counts


def prefix_rows(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """``gram, salt, salts, doc_id, size, at``: the rarest n-grams of every document.

    N-grams are ordered by the frequency of their class, then by hash: one order for
    all documents. Documents with equal sets in one task give their rows once. An
    n-gram whose class is frequent is dealt over several ``salts``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    usual = int(counts.mean()) * 4

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in sliced(batches):
            ids = batch.column(0)
            out: list[list] = [[], [], [], []]
            for i, grams in enumerate(shingle_sets(batch.column(1).to_pylist(), WIDTH)):
                digest = (len(grams), grams.tobytes() if len(grams) < 8 else (int(grams.sum(dtype=np.uint64)), int(grams[0]), int(grams[-1])))
                if not len(grams) or digest in seen:
                    continue
                seen.add(digest)
                df = counts[(grams >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]
                first = np.argsort(df, kind="stable")[: prefix_length(len(grams))]
                for held, x in zip(out, (grams[first], df[first], np.full(len(first), i), np.full(len(first), len(grams)))):
                    held.append(x)
            if not out[0]:
                continue
            gram, df, owner, size = (np.concatenate(x) for x in out)
            begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            at = np.arange(len(owner)) - np.repeat(begins, np.diff(np.append(begins, len(owner))))
            # Rows of a class above the usual may belong to one n-gram: leave room for that.
            salts = np.maximum(1, (df - usual) // SALTED_ROWS + 1)
            salt = (mixed(owner.astype(np.uint64) * np.uint64(7919) + at.astype(np.uint64)) % salts.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(salt), pa.array(salts.astype(np.int32)), ids.take(pa.array(owner)), pa.array(size.astype(np.int32)), pa.array(at.astype(np.int32))],
                ["gram", "salt", "salts", "doc_id", "size", "at"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(prefixes, f"gram long, salt int, salts int, doc_id {kind}, size int, at int")


def could_link(a: str, b: str) -> Column:
    """Length and positional filter of two prefix rows of one n-gram."""
    size = lambda x: F.col(f"{x}.size")
    least = F.ceil(3 * (size(a) + size(b)) / 7)
    reach = 1 + F.least(size(a) - F.col(f"{a}.at") - 1, size(b) - F.col(f"{b}.at") - 1)
    return (4 * size(a) >= 3 * size(b)) & (4 * size(b) >= 3 * size(a)) & (reach >= least)


def suffix_bound(x: np.ndarray, y: np.ndarray, need: int, depth: int = 3) -> int:
    """Upper bound of the common elements of two sorted sets.

    Splitting both at the middle of the longer bounds the common ones of each half by
    the smaller half; halves are split again only while the bound is not below ``need``.
    """
    bound = min(len(x), len(y))
    if depth == 0 or bound < 8 or bound < need:
        return bound
    if len(x) < len(y):
        x, y = y, x
    middle = len(x) // 2
    at = int(np.searchsorted(y, x[middle]))
    low, high = min(middle, at), min(len(x) - middle, len(y) - at)
    if low + high < need:
        return low + high
    low = suffix_bound(x[:middle], y[:at], need - high, depth - 1)
    return low + suffix_bound(x[middle:], y[at:], need - low, depth - 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        good = []
        left, right = shingle_sets(batch.column(2).to_pylist(), WIDTH), shingle_sets(batch.column(3).to_pylist(), WIDTH)
        for x, y in zip(left, right):
            need = least_common(len(x), len(y))
            linked = bool(len(x)) and suffix_bound(x, y, need) >= need and len(np.intersect1d(x, y, assume_unique=True)) >= need
            good.append(linked)
        mask = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets really link, each checked once on the whole texts."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ngram-ids")
    listed = F.broadcast(ids) if ids.count() <= SEMI_ROWS else ids
    # One text per id, whatever repeats.
    texts = cut(rows.join(listed, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("text").alias("text")), "ngram-texts")
    kind = rows.schema["doc_id"].dataType.simpleString()
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return cut(both.mapInArrow(_verify, f"a {kind}, b {kind}"), "ngram-links")


def pairs_of(joined: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(f"{a}.doc_id"), F.col(f"{b}.doc_id")
    return joined.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a != b").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per input row.

    Documents link when the Jaccard similarity of their sets of 5-word shingles is at
    least 0.75; ``component_id`` is the smallest id reachable by links.

    1. Documents with equal sets form a class; its smallest id stands for it.
    2. Every class gives prefix rows of its rarest n-grams. In each group of one
       n-gram the first document leads, and only pairs with a leader are made: as
       many as rows, however large the group. Those that pass the length, positional
       and suffix filters are verified on the texts, which gives most links.
    3. Pairs of documents that meet in a group but are still in different components
       are all checked: rows outside a group's largest component are joined with the
       whole group. Pairs inside one component need no check, so nothing is lost and
       a group of near copies never gives all its pairs. Documents that differ too
       much meet again in most of their n-grams; a pair is not made again if an n-gram
       shortly before was common to both, as it was made in that one's group.

    NULL, empty and blank texts have no n-grams and link with nothing, nor do rows with
    a NULL id, whose ``component_id`` is NULL. Rows of one id count as one document, by
    one of its texts, so ids should be unique; repeated rows are repeated in the
    result. An empty table gives an empty table; other columns are not read.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets, counts = summaries(rows)
    filled = sets.where("n > 0 and doc_id is not null")
    classes = filled.groupBy("n", "sum", "mix").agg(F.min("doc_id").alias("rep"))
    members = cut(filled.join(classes, ["n", "sum", "mix"]).groupBy("doc_id").agg(F.min("rep").alias("rep")), "ngram-classes")

    group = Window.partitionBy("gram", "salt")
    named = rows.where("doc_id is not null")
    shared = (
        prefix_rows(named, counts)
        .withColumn("met", F.count(F.lit(1)).over(group))
        .where("met > 1 or salts > 1")
        .join(members, "doc_id")
        .select("gram", "salt", "salts", F.col("rep").alias("doc_id"), "size", "at")
        .distinct()
    )
    shared = cut(shared, "ngram-shared")
    one = F.struct("doc_id", "size", "at")
    leaders = shared.groupBy("gram", "salt", "salts").agg(F.min(one).alias("x"))
    heads = leaders.where("salts > 1").groupBy("gram").agg(F.min("x").alias("y"))
    rows_of = shared.select("gram", "salt", one.alias("y"))
    first = pairs_of(rows_of.join(leaders, ["gram", "salt"]).where(could_link("x", "y")), "x", "y").unionByName(
        pairs_of(leaders.where("salts > 1").join(heads, "gram").where(could_link("x", "y")), "x", "y")
    )
    parts = filled.select("doc_id", "n", "parts")
    first = cut(plausible(first.distinct(), parts), "ngram-pairs")
    links = verified(first, named).unionByName(members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b"))
    nodes = components(links)

    placed = shared.select("gram", "doc_id", "size", "at").distinct().join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    before = F.collect_list("gram").over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(-LOOK_BACK, -1))
    placed = cut(placed.withColumn("root", F.coalesce("root", "doc_id")).withColumn("before", before), "ngram-placed")
    sizes = placed.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed_groups = sizes.groupBy("gram").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("gram", "main")
    within = placed.join(mixed_groups, "gram").select("gram", "main", "root", F.struct("doc_id", "size", "at", "before").alias("x"))
    minor = within.where("root != main").select("gram", F.col("root").alias("other"), F.col("x").alias("y"))
    # Of two rows outside the main component the pair is made from one side only.
    across = (F.col("root") != F.col("other")) & ((F.col("root") == F.col("main")) | (F.col("x.doc_id") < F.col("y.doc_id")))
    # A pair that has just met in an earlier group of both documents was made there.
    anew = ~F.arrays_overlap("x.before", "y.before")
    second = cut(pairs_of(within.join(minor, "gram").where(across & could_link("x", "y") & anew), "x", "y"), "ngram-second")
    second = cut(plausible(second.join(first, ["a", "b"], "left_anti"), parts), "ngram-pairs")
    more = verified(second, named)
    nodes = components(nodes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return (
        sets.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its component, with all their columns; NULL ids stay."""
    decided = jaccard_components(docs, id_col, text_col)
    dropped = cut(decided.where("doc_id != component_id").select("doc_id").distinct(), "ngram-dropped")
    return without(docs, dropped, None, id_col)
