"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postledger.llm.rows import single, text_key, without
from postledger.shared import cut

WHITE = r"[\x20\x09-\x0D]+"
RUNS = 64
FAN_IN = 8


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, text_key, sha, proof``: one narrow row per document, NULL text as empty.

    ``proof`` (length and a second hash of the normalised text) verifies that two
    texts of one digest are the same; rows that differ in it are never merged.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace(text, WHITE, "")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).alias("n_chars"),
        text_key(F.col(text_col)).alias("text_key"),
        F.unhex(F.sha2(bare.cast("binary"), 256)).alias("sha"),
        F.xxhash64(F.length(bare), bare).alias("proof"),
    )


def merge_runs(digests: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct text: ``sha, proof, keep_id, group_size``.

    Every row starts in one of ``runs`` runs. In each round ``fan_in`` neighbouring
    runs exchange their rows and become one: a sort-based aggregate merges equal
    digests, keeping the row that stays and the size so far. A group that holds a
    third of all rows is thus spread over all runs and shrinks to one row per run
    and task before any two runs meet. Of equal texts the longest original stays,
    then the smallest id; a NULL id stays only if it is alone.
    """
    level = digests.select(
        F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(runs)).alias("run"),
        "sha",
        "proof",
        F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("anonymous"), "doc_id").alias("best"),
        F.lit(1).cast("long").alias("n"),
    )
    merged = False
    while runs > 1 or not merged:
        runs, merged = -(-runs // fan_in), True
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in))
            .groupBy("run", "sha", "proof")
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
    return level.select("sha", "proof", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Every document with the document that stays for it.

    Texts are equal when they agree after deleting space, tab, LF, VT, FF and CR.
    Returns ``doc_id, keep_id, group_size, kept, text_sha256, text_key``, one row per
    input row; ``text_key`` is a hash of the text as it stands.

    NULL text counts as empty, so all NULL, empty and blank texts form one group. A
    NULL id is an ordinary row whose ``kept`` says whether the group keeps a NULL id.
    Repeated rows count in ``group_size``; if their id stays, all of them say ``kept``.
    An empty table gives an empty table; other columns are not read.
    """
    digests = cut(digest_rows(docs, id_col, text_col), "exact-digests")
    groups = merge_runs(digests, runs, fan_in)
    return digests.join(groups, ["sha", "proof"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "text_key",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat id and text one stays."""
    decided = cut(exact_groups(docs, id_col, text_col), "exact-decided")
    left = without(docs, decided.where(~F.col("kept")).select("doc_id", "text_key"), text_col, id_col)
    repeated = decided.where("kept").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return single(left, cut(repeated.select("doc_id", "text_key"), "exact-repeated"), text_col, id_col)
