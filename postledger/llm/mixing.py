"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postledger.llm.rows import ID, TEXT, single, text_key
from postledger.operators.ids import arrival_ids
from postledger.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, n_docs, source_size, target`` from rows of ``source, size``.

    Sources in code point order, NULL last, weigh ``weights`` in turn. The level of
    the water is rest / weight, where ``rest`` is what the sources below their cap
    share; each round clamps the sources whose share would exceed ``max_epochs``
    times their size and shares the excess among the others by weight, until no
    source is above. Only the two sums of a round reach the driver.
    """
    sources = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    sources = arrival_ids(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"], name="_rank")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = cut(
        sources.select("source", "n_docs", "source_size", "_rank", turn.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap")),
        "mix-sources",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    rest, weight, clamped = total, None, -1
    while True:
        above = F.lit(False) if weight is None else wide("cap") * F.lit(weight).cast("decimal(17,0)") < wide("weight") * F.lit(rest).cast("decimal(17,0)")
        state = sources.select(above.alias("above"), "cap", "weight").agg(
            F.coalesce(F.sum(F.when(F.col("above"), F.col("cap"))), F.lit(0)).alias("caps"),
            F.coalesce(F.sum(F.when(~F.col("above"), F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(F.col("above"), 1)).alias("n"),
        ).first()
        if state["n"] == clamped or not state["weight"]:
            break
        rest, weight, clamped = total - state["caps"], state["weight"], state["n"]
    share = F.lit(0.0) if not weight else (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(weight))
    return sources.select("source", "_rank", "n_docs", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """How often each document enters the mix.

    Returns ``doc_id, size, source_size, target, copies, taken, text_key``, one row per input
    row: ``copies`` is the whole part of target / source_size for every document,
    plus one for the fraction of them that a systematic draw picks. The draw walks
    the documents of a source by size, ties in seeded order, and takes evenly spaced
    ones, so each source's words come within about one long document of its target.
    Positions come from a range partitioning, in which a source with a third of
    the rows spans many tasks. The same rows and seed give the same copies.

    NULL or blank text has size 0. NULL is a source of its own, the last one. NULL
    ids sort first. Repeated rows are drawn one by one. An empty table gives an empty
    table; other columns are not read.
    """
    sizes = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            text_key(F.col(text_col)).alias("text_key"),
        ),
        "mix-sizes",
    )
    # A counter by source joins sizes, never texts; sources are few against documents, but of unproven number.
    targets = source_targets(sizes, weights, max_epochs)
    draw = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = arrival_ids(
        sizes.withColumn("_last", F.col("source").isNull()).withColumn("_draw", draw),
        ["_last", "source", "size", "_draw", "doc_id"],
        name="_place",
    )
    firsts = placed.groupBy("source").agg(F.min("_place").alias("_first"))
    targets = targets.join(firsts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), "source_size", "target", "_first"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part, at = F.col("_rate") - F.floor("_rate"), F.col("_place") - F.col("_first")
    drawn = F.floor((at + 1) * part + 0.5) - F.floor(at * part + 0.5)
    return (
        placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_rate", rate)
        .withColumn("copies", (F.floor("_rate") + drawn).cast("long"))
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_key")
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix, with all their columns: each as often as its copies say.

    Rows that repeat id and text share their copies.
    """
    mix = cut(mix_sources(docs, id_col, text_col, source_col, **options), "mix-copies")
    totals = mix.groupBy("doc_id", "text_key").agg(F.sum("copies").alias("_row_copies"), F.count(F.lit(1)).alias("_row_n"))
    totals = cut(totals.withColumnsRenamed({"doc_id": ID, "text_key": TEXT}), "mix-totals")
    one = single(docs, totals.where("_row_n > 1").select(F.col(ID).alias("doc_id"), F.col(TEXT).alias("text_key")), text_col, id_col)
    taken = totals.where("_row_copies > 0").drop("_row_n")
    same = F.col(id_col).eqNullSafe(F.col(ID)) & (text_key(F.col(text_col)) == F.col(TEXT))
    repeated = one.join(taken, same).withColumn("_row_copy", F.explode(F.sequence(F.lit(1), F.col("_row_copies"))))
    return repeated.select(*docs.columns)
