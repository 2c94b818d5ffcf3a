"""Deduplication in arrival order, on one key and on two keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from postledger.functions.links import url_key
from postledger.functions.text import strip
from postledger.shared import cut, new_path


def first_by_key(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The first row per key in arrival order.

    The winner is found by a partial aggregate on the narrow columns and joined
    back on the order column, which is unique: no window over a heavy key, and
    wide columns move only for winners.
    """
    winners = rows.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return rows.join(winners, order, "left_semi")


def last_by_key(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The last row per key, at the position of the first (``first_pos``)."""
    ends = rows.groupBy(*keys).agg(F.max(order).alias(order), F.min(order).alias("first_pos"))
    return rows.join(ends.select(order, "first_pos"), order, "inner")


def _keyed(rows: DataFrame, exact_url: bool) -> DataFrame:
    """Narrow working columns: pos, id, url key, and for odd spellings a guard.

    With slash-blind comparison a url with two or more trailing slashes is only
    equal to itself and to an earlier spelling without any slash: it keeps its
    own key, and ``guard`` names the bare spelling.
    """
    if exact_url:
        return rows.select("pos", "id", F.col("url").alias("ukey"), F.lit(False).alias("bare"), F.lit(None).cast("string").alias("guard"))
    text = strip(F.col("url"))
    key = url_key(F.col("url"))
    slashes = F.length(text) - F.length(key)
    return rows.select(
        "pos",
        "id",
        F.when(slashes > 1, text).otherwise(key).alias("ukey"),
        F.coalesce(slashes == 0, F.lit(False)).alias("bare"),
        F.when(slashes > 1, key).alias("guard"),
    )


def _two_first(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Per key the positions of its first two rows.

    The rank filter is pushed below the shuffle: a task passes on two rows of a key at most.
    """
    order = Window.partitionBy(key).orderBy("pos")
    first = rows.where(F.col(key).isNotNull()).select(key, "pos").withColumn("_rank", F.row_number().over(order)).where("_rank <= 2")
    return first.groupBy(F.col(key).alias(f"_{name}")).agg(F.collect_list("pos").alias(name))


def _with_earlier(active: DataFrame, guarded: bool) -> DataFrame:
    """The open rows with ``earlier``: the earlier open rows that could block them, none, one or at least two.

    If a row has one such row only, it is among the first two of its id, url or guard.
    """
    by_id, by_url = _two_first(active, "id", "same_id"), _two_first(active, "ukey", "same_url")
    rows = active.join(by_id, F.col("id") == F.col("_same_id"), "left")
    # Rows without a url, or without a guard, meet nothing: they do not go into the joins.
    empty = F.lit(None).cast("array<long>")
    linked = rows.where("ukey is not null").join(by_url, F.col("ukey") == F.col("_same_url"))
    rows = linked.drop("_same_url").unionByName(rows.where("ukey is null").withColumn("same_url", empty)).withColumn("same_guard", empty)
    if guarded:
        bare = _two_first(active.where("bare").select(F.col("ukey").alias("guard"), "pos"), "guard", "same_guard")
        apart = rows.where("guard is not null").drop("same_guard").join(bare, F.col("guard") == F.col("_same_guard"), "left").drop("_same_guard")
        rows = rows.where("guard is null").unionByName(apart)
    none = F.array().cast("array<long>")
    met = F.array_distinct(F.concat(*[F.coalesce(c, none) for c in ("same_id", "same_url", "same_guard")]))
    return rows.select("pos", "id", "ukey", "bare", "guard", F.filter(met, lambda p: p < F.col("pos")).alias("earlier"))


def _ends(chains: DataFrame) -> DataFrame:
    """``pos, end, odd``: where each chain of single earlier rows ends, and if it takes an odd number of steps.

    Pointers are doubled twice a round: after n rounds they span 4^n rows. Chains that
    have reached their end are set aside. ``chains`` has ``pos`` and ``end``, the one earlier row.
    """
    far = cut(chains.withColumn("odd", F.lit(True)), "dedup-chains")
    while True:
        for _ in range(2):
            on = far.select(F.col("pos").alias("end"), F.col("end").alias("_next"), F.col("odd").alias("_odd"))
            far = far.join(on, "end", "left").select(
                "pos", F.coalesce("_next", "end").alias("end"), F.when(F.col("_odd"), ~F.col("odd")).otherwise(F.col("odd")).alias("odd"), F.col("_next").isNotNull().alias("moved")
            )
        far = cut(far, "dedup-chains")
        if far.where("moved").isEmpty():
            return far.drop("moved")
        far = far.drop("moved")


def _without_blocked(active: DataFrame, winners: DataFrame, guarded: bool) -> DataFrame:
    """Rows not yet decided once the winners' ids and urls are taken."""
    columns = ["pos", "id", "ukey", "bare", "guard"]
    left = active.join(winners.select("id"), "id", "left_anti")
    # Rows without a url, or without a guard, meet nothing: they do not go into the joins.
    linked = left.where("ukey is not null").join(winners.where("ukey is not null").select("ukey"), "ukey", "left_anti")
    if guarded:
        taken = winners.where("bare").select(F.col("ukey").alias("guard"), F.col("pos").alias("bare_pos"))
        apart = linked.where("guard is not null").join(taken, "guard", "left").where(
            F.col("bare_pos").isNull() | (F.col("bare_pos") > F.col("pos"))
        )
        linked = linked.where("guard is null").select(*columns).unionByName(apart.select(*columns))
    return left.where("ukey is null").select(*columns).unionByName(linked.select(*columns))


def greedy_matching(rows: DataFrame, exact_url: bool = False) -> DataFrame:
    """Positions kept by the rule "keep a row iff no earlier kept row shares its id or url".

    ``rows`` has unique ``pos``, non-empty ``id`` and ``url`` (NULL if none). Rows
    that were dropped do not reserve their keys, so this is not a grouping by
    either key. Equal (id, url) pairs are collapsed first; only their earliest row can
    be kept. Then it works in rounds until nothing is left. A row without an earlier
    open row of its keys is kept. A row with exactly one is kept iff that one is not, so
    chains of such rows are decided at once by pointer doubling, in steps that grow with
    the logarithm of their length. Rows that touch a kept key are dropped; rows with
    several earlier ones wait for the next round. Kept rows of all rounds go to one table.

    The number of rounds is the depth to which rows with several undecided earlier
    rows depend on each other, at most half the longest such path; the rule itself
    has no form that bounds this for every input.
    """
    active = (
        _keyed(rows, exact_url)
        .groupBy("id", "ukey", "bare", "guard")
        .agg(F.min("pos").alias("pos"))
        .select("pos", "id", "ukey", "bare", "guard")
    )
    spark = rows.sparkSession
    active = cut(active, "dedup-open")
    guarded = not active.where("guard is not null").isEmpty()
    path = new_path(spark, "dedup-kept")
    active.select("pos").limit(0).write.parquet(path)
    kind = active.select("pos").schema
    while not active.isEmpty():
        marked = cut(_with_earlier(active, guarded), "dedup-round")
        winners = marked.where(F.size("earlier") == 0)
        chains = marked.where(F.size("earlier") == 1).select("pos", F.col("earlier")[0].alias("end"))
        if not chains.join(chains.select(F.col("pos").alias("end")), "end", "left_semi").isEmpty():
            # Only chains that end at a kept row are decided: an even number of steps away, a row is kept like it.
            ended = _ends(chains).where("not odd").join(winners.select(F.col("pos").alias("end")), "end", "left_semi")
            winners = cut(winners.unionByName(marked.join(ended.select("pos"), "pos", "left_semi")), "dedup-won")
        winners.select("pos").write.mode("append").parquet(path)
        active = cut(_without_blocked(marked.drop("earlier"), winners.drop("earlier"), guarded), "dedup-open")
    return spark.read.schema(kind).parquet(path)


def dedup_two_keys(rows: DataFrame, exact_url: bool = False) -> DataFrame:
    """Whole rows kept by :func:`greedy_matching` (``source_id``, ``url``, ``pos``)."""
    narrow = rows.select(
        "pos",
        F.col("source_id").alias("id"),
        F.when(F.col("url") != "", F.col("url")).alias("url"),
    )
    return rows.join(greedy_matching(narrow, exact_url), "pos", "left_semi")
