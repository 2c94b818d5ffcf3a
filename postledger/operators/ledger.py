"""The ledger: repeated sightings of postings folded into one row per key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from postledger.functions.text import display_company
from postledger.operators.ids import arrival_ids
from postledger.schemas import COMPANIES, JOBS, JOB_DEFAULTS, conform
from postledger.shared import HEAVY_SHARE, SMALL_ROWS, cut

KEY = ["source", "source_id"]

# Largest fold, in characters of its texts, that is broadcast to the stored side.
SMALL_TEXT = 32_000_000

# Attributes that the latest sighting overwrites, also by NULL.
ATTRIBUTES = [
    "company", "title", "location", "remote", "url", "description", "posted_at",
    "match_score", "matched_keywords", "missing_keywords", "raw",
]

BUCKET = T.StructField("bucket", T.IntegerType())

# Attributes that may be as long as a document.
LONG = ["description", "raw"]


def _present(df: DataFrame, names: list[str]) -> list[str]:
    return [name for name in names if name in df.columns]


def fold_sightings(batch: DataFrame) -> DataFrame:
    """One row per key: count, first and last time, attributes of the last sighting.

    ``batch`` carries ``seen_at`` and the arrival order ``pos``. All aggregates
    combine on the map side, so a key with a third of the rows leaves each task
    as one row.
    """
    latest = F.struct("seen_at", "pos")
    attributes = F.struct(*_present(batch, [*ATTRIBUTES, "row"]))
    folded = batch.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("seen_count"),
        F.min(latest).alias("_first"),
        F.max(latest).alias("_last"),
        F.max_by(attributes, latest).alias("_attributes"),
    )
    return folded.select(
        *KEY,
        "seen_count",
        F.col("_first.seen_at").alias("first_seen_at"),
        F.col("_first.pos").alias("first_pos"),
        F.col("_last.seen_at").alias("last_seen_at"),
        F.col("_last.pos").alias("last_pos"),
        "_attributes.*",
    )


def combine_folds(folds: DataFrame) -> DataFrame:
    """Fold of several folds: the result of one pass over all their sightings."""
    latest = F.struct(F.col("last_seen_at").alias("seen_at"), F.col("last_pos").alias("pos"))
    attributes = F.struct(*_present(folds, ATTRIBUTES))
    merged = folds.groupBy(*KEY).agg(
        F.sum("seen_count").alias("seen_count"),
        F.min(F.struct(F.col("first_seen_at").alias("seen_at"), F.col("first_pos").alias("pos"))).alias("_first"),
        F.max(latest).alias("_last"),
        F.max_by(attributes, latest).alias("_attributes"),
    )
    return merged.select(
        *KEY,
        "seen_count",
        F.col("_first.seen_at").alias("first_seen_at"),
        F.col("_first.pos").alias("first_pos"),
        F.col("_last.seen_at").alias("last_seen_at"),
        F.col("_last.pos").alias("last_pos"),
        "_attributes.*",
    )


def upsert_folds(state: DataFrame, fold: DataFrame, how: str = "full_outer") -> DataFrame:
    """New state from the old one and a fold of new sightings, joined on the key.

    Both sides have one row per key. Unmatched state stays, unmatched folds are
    inserted with status ``new``, matched rows keep first time and status, count
    up, and take the attributes of whichever side saw the posting last. With
    ``how="left"`` only the rows of the old state are returned.
    """
    old, new = state.alias("old"), fold.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in KEY]
    joined = old.join(new, on, how)
    has_old, has_new = F.col("old.seen_count").isNotNull(), F.col("new.seen_count").isNotNull()
    newer = has_new & (
        ~has_old
        | (
            F.struct(F.col("new.last_seen_at").alias("t"), F.col("new.last_pos").alias("p"))
            >= F.struct(
                F.col("old.last_seen_at").alias("t"), F.coalesce(F.col("old.last_pos"), F.lit(-1)).alias("p")
            )
        )
    )

    def pick(name: str) -> Column:
        if name in ("source", "source_id"):
            return F.coalesce(F.col(f"old.{name}"), F.col(f"new.{name}"))
        if name == "seen_count":
            return F.coalesce(F.col("old.seen_count"), F.lit(0)) + F.coalesce(F.col("new.seen_count"), F.lit(0))
        if name == "first_seen_at":
            return F.least(F.col("old.first_seen_at"), F.col("new.first_seen_at"))
        if name == "status":
            return F.coalesce(F.col("old.status"), F.lit("new"))
        if name not in fold.columns:
            return F.col(f"old.{name}")
        if name not in state.columns:
            return F.when(has_new, F.col(f"new.{name}"))
        return F.when(newer, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))

    # The first position only orders new keys; it is not part of the state.
    names = [*state.columns, *[name for name in fold.columns if name not in state.columns]]
    names = [name for name in names if name != "first_pos"]
    if "status" not in names:
        names.append("status")
    return joined.select(*[pick(name).alias(name) if name != "status" or "status" in state.columns
                           else F.lit("new").alias("status") for name in names])


def sighting_counts(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Per source: found rows, keys not yet in the state, and the rest as updates."""
    keys = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    known = state.select(*KEY, F.lit(True).alias("known"))
    marked = keys.join(known, KEY, "left")
    counts = marked.groupBy("source").agg(
        F.sum("n").alias("found_count"),
        F.count_if(F.col("known").isNull()).alias("new_count"),
    )
    return counts.withColumn("updated_count", F.col("found_count") - F.col("new_count"))


def company_names(batch: DataFrame) -> DataFrame:
    """Distinct stored company names of a batch with their first time and position."""
    first = F.min(F.struct("seen_at", "pos"))
    return (
        batch.groupBy(display_company(F.col("company")).alias("name"))
        .agg(first.alias("_first"))
        .select("name", F.col("_first.seen_at").alias("first_seen_at"), F.col("_first.pos").alias("pos"))
    )


def grow_companies(companies: DataFrame, batch: DataFrame) -> DataFrame:
    """Companies plus those first named in the batch, numbered in arrival order."""
    fresh = company_names(batch).join(companies.select("name"), "name", "left_anti")
    start = companies.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = arrival_ids(fresh, ["first_seen_at", "pos"], start)
    return companies.unionByName(conform(numbered, COMPANIES))


@dataclass
class BucketUpsert:
    """New rows of the touched buckets, new companies, and counts per source."""

    jobs: DataFrame
    companies: DataFrame
    counts: DataFrame
    buckets: list[int]


def _fits(fold: DataFrame) -> bool:
    """Whether a stored fold is small by rows and by the lengths of its texts."""
    texts = [f.name for f in fold.schema.fields if f.dataType.simpleString() in ("string", "array<string>")]
    size = [F.length(F.col(c).cast("string")) for c in texts]
    chars = F.sum(sum((F.coalesce(n, F.lit(0)) for n in size), F.lit(0).cast("bigint")))
    rows, total = fold.agg(F.count(F.lit(1)), F.coalesce(chars, F.lit(0))).first()
    return rows <= SMALL_ROWS and total <= SMALL_TEXT


def _with_texts(rows: DataFrame, fold: DataFrame, texts: DataFrame, bucket: Column) -> DataFrame:
    """Rows, each of one key and named by ``row``, with their long attributes, gathered by bucket.

    The texts move once: rows and texts meet by ``row`` inside the bucket they are written
    to, which is dealt over more tasks for each SMALL_ROWS keys it gets. Of a key with many
    sightings, only the text that stays leaves its task.
    """
    n, keys, buckets = fold.agg(F.sum("seen_count"), F.count(F.lit(1)), F.count_distinct(bucket)).first()
    # Fewer than HEAVY_SHARE keys.
    heavy = fold.where(F.col("seen_count") * HEAVY_SHARE > (n or 0)).select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("row").alias("_stays"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    texts = texts.join(F.broadcast(heavy), same, "left").where("_stays is null or _stays = row")
    slot = F.pmod(F.xxhash64("row"), F.lit(1 + (keys or 0) // (max(buckets or 0, 1) * SMALL_ROWS)))
    place = ["bucket", "slot"]
    texts = texts.select(bucket.alias("bucket"), slot.alias("slot"), "row", *_present(texts, LONG)).repartition(*place)
    rows = rows.withColumns({"bucket": bucket, "slot": slot}).repartition(*place)
    return rows.join(texts, [*place, "row"]).drop("slot", "row")


def _merge_small(jobs: DataFrame, named: DataFrame, top_id: int, bucket: Column, texts: None) -> tuple[DataFrame, DataFrame]:
    """The touched jobs after a fold that is broadcast, and the ids of its new keys."""
    known = cut(jobs.select(*KEY).join(F.broadcast(named.select(*KEY)), KEY, "left_semi"), "known")
    fresh = named.join(known, KEY, "left_anti")
    ids = arrival_ids(fresh.select(*KEY, "first_seen_at", "first_pos"), ["first_seen_at", "first_pos"], top_id)
    ids = ids.select(*KEY, "id")
    inserted = upsert_folds(jobs.limit(0), fresh).drop("id").join(ids, KEY)
    kept = upsert_folds(jobs, F.broadcast(named.join(known, KEY, "left_semi")), "left")
    kept, inserted = (conform(part, JOBS).withColumn("bucket", bucket) for part in (kept, inserted))
    # New rows are gathered by bucket; stored ones are, as they have not moved.
    return kept.unionByName(inserted.hint("rebalance", "bucket")), ids


def _merge_large(jobs: DataFrame, named: DataFrame, top_id: int, bucket: Column, texts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The touched jobs after a fold of any size, and the ids of its new keys."""
    given = {*named.columns, *(_present(texts, LONG) if texts is not None else [])}
    counted = ["first_seen_at", "last_seen_at", "last_pos", "seen_count"]
    # What a fold does not tell stays as it is stored.
    stays = [name for name in jobs.columns if name not in given]
    old = jobs.select(*KEY, *[F.col(name).alias(f"old_{name}") for name in [*counted, *stays]])
    met = named.join(old, KEY, "left")
    has_old = F.col("old_seen_count").isNotNull()
    newer = ~has_old | (
        F.struct(F.col("last_seen_at").alias("t"), F.col("last_pos").alias("p"))
        >= F.struct(F.col("old_last_seen_at").alias("t"), F.coalesce(F.col("old_last_pos"), F.lit(-1)).alias("p"))
    )
    met = met.select(
        *[name for name in named.columns if name not in ("seen_count", "first_seen_at")],
        *[F.col(f"old_{name}").alias(name) for name in stays if name != "status"],
        F.coalesce("old_status", F.lit("new")).alias("status"),
        (F.col("seen_count") + F.coalesce("old_seen_count", F.lit(0))).alias("seen_count"),
        F.least("first_seen_at", "old_first_seen_at").alias("first_seen_at"),
        has_old.alias("known"),
        newer.alias("newer"),
    )
    met = cut(met, "met")
    fresh = met.where("not known").select(*KEY, "first_seen_at", "first_pos")
    ids = arrival_ids(fresh, ["first_seen_at", "first_pos"], top_id).select(*KEY, "id")
    numbered = met.where("not known").drop("id").join(ids, KEY)
    rows = met.where("known and newer").unionByName(numbered)
    if texts is None:
        rows = rows.withColumn("bucket", bucket).hint("rebalance", "bucket")
    else:
        rows = _with_texts(rows, named, texts, bucket)
    rows = conform(rows.drop("first_pos"), T.StructType([*JOBS.fields, BUCKET]))
    if jobs.count() > met.where("known and newer").count():
        later = met.select(*KEY, "newer", F.col("seen_count").alias("_seen"), F.col("first_seen_at").alias("_first"))
        kept = jobs.join(later, KEY, "left").where("newer is null or not newer")
        kept = kept.withColumns({"seen_count": F.coalesce("_seen", "seen_count"), "first_seen_at": F.coalesce("_first", "first_seen_at")})
        rows = rows.unionByName(conform(kept, JOBS).withColumn("bucket", bucket).hint("rebalance", "bucket"))
    return rows, ids


def upsert_buckets(
    stored: Callable[[list[int]], DataFrame],
    companies: DataFrame,
    batch: DataFrame,
    top_id: int,
    bucket: Column,
    texts: DataFrame | None = None,
) -> BucketUpsert:
    """Fold a batch into the buckets of the jobs table that its keys fall into.

    ``stored`` reads the jobs of some buckets, ``bucket`` is the bucket of a key and
    ``top_id`` the largest id in use. A fold of checked size is broadcast, so stored
    rows stay in the tasks that read them. A larger one meets the short columns of the
    stored rows by shuffle; whole stored rows are moved only if some keep their attributes,
    that is if they are not in the batch or were seen after it. Results are those of
    :func:`upsert_postings`.

    The long attributes may come apart from the batch: then ``texts`` has them with
    the key and ``row``, which names a row of both. It must give the same rows whenever read.
    """
    start = companies.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh_names = company_names(batch).join(companies.select("name"), "name", "left_anti")
    added = conform(arrival_ids(fresh_names, ["first_seen_at", "pos"], start), COMPANIES)
    numbers = companies.unionByName(added).select(F.col("name").alias("company"), F.col("id").alias("company_id"))
    fold = fold_sightings(batch.withColumn("company", display_company(F.col("company"))))
    named = cut(fold.join(numbers, "company", "left").drop("company"), "fold")
    if texts is not None and named.count() <= SMALL_ROWS:
        named = cut(texts.select("row", *_present(texts, LONG)).join(F.broadcast(named), "row").drop("row"), "fold-texts")
        texts = None
    # No more numbers than buckets.
    touched = sorted(r[0] for r in named.select(bucket.alias("b")).distinct().collect())
    jobs = conform(stored(touched), JOBS, JOB_DEFAULTS)
    merge = _merge_small if texts is None and _fits(named) else _merge_large
    rows, ids = merge(jobs, named, top_id, bucket, texts)
    found = batch.groupBy("source").agg(F.count(F.lit(1)).alias("found_count"))
    new = ids.groupBy("source").agg(F.count(F.lit(1)).alias("new_count"))
    counts = found.join(new, "source", "left").fillna(0, ["new_count"])
    counts = counts.withColumn("updated_count", F.col("found_count") - F.col("new_count"))
    return BucketUpsert(rows, added, counts, touched)


@dataclass
class Upsert:
    """New jobs and companies tables, and counts per source."""

    jobs: DataFrame
    companies: DataFrame
    counts: DataFrame


def upsert_postings(jobs: DataFrame, companies: DataFrame, batch: DataFrame) -> Upsert:
    """Fold a batch of scored postings into the jobs and companies tables.

    Only keys that are new get an id, in order of their first sighting. A company
    that a posting leaves stays in the dimension.
    """
    jobs = conform(jobs, JOBS, JOB_DEFAULTS)
    grown = grow_companies(companies, batch)
    fold = fold_sightings(batch.withColumn("company", display_company(F.col("company"))))
    numbers = grown.select(F.col("name").alias("company"), F.col("id").alias("company_id"))
    named = fold.join(numbers, "company", "left").drop("company")
    named = cut(named, "fold")
    # Only the keys of new postings are numbered: three short columns.
    start = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = named.select(*KEY, "first_seen_at", "first_pos").join(jobs.select(*KEY), KEY, "left_anti")
    fresh = arrival_ids(fresh, ["first_seen_at", "first_pos"], start).select(*KEY, F.col("id").alias("_new_id"))
    merged = upsert_folds(jobs, named).join(fresh, KEY, "left").withColumn("id", F.coalesce("id", "_new_id"))
    return Upsert(conform(merged, JOBS), grown, sighting_counts(batch, jobs))
