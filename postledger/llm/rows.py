"""Taking decisions back to whole rows, without moving texts where that can be avoided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SMALL_LIST = 1_000_000  # longest list of keys, in rows, that is sent to every task: about 16 MB

ID, TEXT = "_row_key_id", "_row_key_text"


def text_key(text: Column) -> Column:
    """Tells the texts of rows apart that share an id; NULL counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _listed(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(SMALL_LIST + 1).count() <= SMALL_LIST else keys


def without(docs: DataFrame, keys: DataFrame, text_col: str | None = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows whose key is not in ``keys`` (``doc_id``, and ``text_key`` if ``text_col`` is given).

    A list of checked length goes to every task and no row moves; a longer one is
    joined by shuffle. ``keys`` must be a stored or cheap table.
    """
    same = F.col(id_col).eqNullSafe(F.col(ID))
    listed = keys.select(F.col("doc_id").alias(ID), *([F.col("text_key").alias(TEXT)] if text_col else []))
    if text_col:
        same = same & (text_key(F.col(text_col)) == F.col(TEXT))
    return docs.join(_listed(listed), same, "left_anti")


def single(docs: DataFrame, repeated: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each key of ``repeated`` (``doc_id, text_key``), all rows of other keys."""
    if repeated.isEmpty():
        return docs
    listed = _listed(repeated.select(F.col("doc_id").alias(ID), F.col("text_key").alias(TEXT)).distinct())
    same = F.col(id_col).eqNullSafe(F.col(ID)) & (text_key(F.col(text_col)) == F.col(TEXT))
    return docs.join(listed, same, "left_anti").unionByName(docs.join(listed, same, "left_semi").dropDuplicates([id_col, text_col]))
