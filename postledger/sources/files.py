"""Landed CSV files and plain text files."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from postledger.functions.text import blank_to_null, or_default, parse_flag
from postledger.operators.exclusion import company_excluded, title_excluded
from postledger.schemas import LANDING, LANDING_COLUMNS, POSTING, conform
from postledger.shared import cut, is_small

# Longest table of file blocks that is broadcast; at 128 MB a block this is about
# 60 TB of text. A longer one is joined by shuffle.
BLOCK_ROWS = 500_000

_FILE_BITS = 40  # pos = file order in the high bits, row number in the low ones


def with_row_numbers(rows: DataFrame, settled: bool = False) -> DataFrame:
    """Add ``row_no``, from 1 within each file, and ``all_no``, from 1 over all files by name.

    Rows of one file block are numbered where they were read; blocks are shifted
    by the sizes of the blocks before them. The rows are settled first: files
    could be split otherwise the next time they are read; ``settled`` says that they
    lie written already. The table of shifts has one row per file block, not per row.
    """
    if not settled:
        rows = cut(rows, "landed", compression="zstd")
    blocks = rows.groupBy("_file", "_block").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    in_all = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first") + 1
    shifts = cut(blocks.select("_file", "_block", before(in_file).alias("_shift"), before(in_all).alias("_all")), "blocks")
    if is_small(shifts, BLOCK_ROWS):
        shifts = F.broadcast(shifts)
    joined = rows.join(shifts, ["_file", "_block"])
    return joined.withColumns({"row_no": (F.col("_m") + F.col("_shift")).cast("bigint"), "all_no": (F.col("_m") + F.col("_all")).cast("bigint")})


def _csv_reader(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("encoding", "UTF-8")
    )


def _landed_files(spark: SparkSession, paths: list[str]) -> list[tuple[int, str, str]]:
    """``path number, file, header line`` of every landed file, in path order, then by name.

    One job for all paths reads the first line of every file; the driver gets one
    short row per file. A path that does not exist has no files.
    """
    parts = []
    for order, path in enumerate(paths):
        try:
            lines = spark.read.text(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        parts.append(
            lines.select(
                F.lit(order).alias("n"), F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), "value",
            ).where("block = 0")
        )
    if not parts:
        return []
    heads = reduce(DataFrame.unionByName, parts).groupBy("n", "file").agg(F.min_by("value", "m").alias("head"))
    return [(r["n"], r["file"], r["head"]) for r in heads.orderBy("n", "file").collect()]


def read_landing(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """Rows of landed CSV files as text, with ``path``, ``file_order``, ``row_no`` and ``pos``.

    Every file of every path is read by its own header line: files with one header
    are read together, columns are found by name, absent ones are NULL. A missing
    path is empty. ``path`` is the path as given where it names one file, else
    the file's own. ``pos`` is unique: the file's number, then the row's. ``multi_line=False``
    lets large files be split; then a cell may not contain a line break.
    """
    landed = _landed_files(spark, paths)
    groups: dict[str, list[tuple[int, str, str]]] = {}
    for number, (order, file, head) in enumerate(landed):
        single = sum(1 for n, _, _ in landed if n == order) == 1 and file.endswith(paths[order].rsplit("/", 1)[-1])
        groups.setdefault(head, []).append((number, file, paths[order] if single else file))
    parts = []
    for files in groups.values():
        rows = _csv_reader(spark, multi_line).csv([file for _, file, _ in files])
        cells = sorted(name for name in rows.columns if name)
        # The cells are written once, by their place; raw is made of them when it is read.
        place = {name: f"c{i}" for i, name in enumerate(rows.columns)}
        raw = F.to_json(F.struct(*[F.coalesce(F.col(place[c]), F.lit("")).alias(c) for c in cells]))
        named = [
            (F.col(place[name]) if name in place else F.lit(None).cast("string")).alias(name)
            for name in [*LANDING_COLUMNS, "easy_apply"]
        ]
        order = spark.createDataFrame(files, "file_order int, _file string, path string")
        parts.append(
            rows.select(
                *[F.col(f"`{name}`").alias(place[name]) for name in rows.columns if name],
                F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_m"),
            )
            .transform(with_row_numbers)
            .select(*named, raw.alias("raw"), "_file", "row_no")
            # One row per file.
            .join(F.broadcast(order), "_file")
            .select(*LANDING_COLUMNS, "easy_apply", "raw", "path", "file_order", "row_no", "_file")
        )
    if not parts:
        empty = "easy_apply string, raw string, path string, file_order int, row_no bigint, _file string"
        fields = ", ".join(f"{f.name} string" for f in LANDING.fields)
        return spark.createDataFrame([], f"{fields}, {empty}").withColumn("pos", F.lit(0).cast("bigint"))
    result = reduce(DataFrame.unionByName, parts)
    return result.withColumn("pos", F.shiftleft(F.col("file_order").cast("bigint"), _FILE_BITS) + F.col("row_no"))


def csv_postings(
    spark: SparkSession,
    name: str,
    path: str,
    exclude_title_keywords: list[str] | None = None,
    exclude_companies: list[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Postings of a landed CSV file, with the source's own exclusions applied."""
    rows = read_landing(spark, [path], multi_line)
    return shape_landing(rows, name, F.col("path"), exclude_title_keywords, exclude_companies)


def shape_landing(
    rows: DataFrame,
    name: str,
    path: Column,
    exclude_title_keywords: list[str] | None = None,
    exclude_companies: list[str] | None = None,
) -> DataFrame:
    """Postings from numbered landing rows: ids, defaults, flags, exclusions."""
    shaped = rows.select(
        F.lit(name).alias("source"),
        F.coalesce(
            blank_to_null(F.col("source_id")),
            blank_to_null(F.col("url")),
            F.concat(path, F.lit(":"), F.col("row_no").cast("string")),
        ).alias("source_id"),
        or_default(F.col("title"), "Untitled").alias("title"),
        or_default(F.col("company"), "Unknown").alias("company"),
        blank_to_null(F.col("location")).alias("location"),
        blank_to_null(F.col("url")).alias("url"),
        or_default(F.col("description"), "").alias("description"),
        blank_to_null(F.col("posted_at")).alias("posted_at"),
        parse_flag(F.col("remote")).alias("remote"),
        "raw",
        "pos",
        *[c for c in rows.columns if c == "seen_at"],
    )
    if exclude_title_keywords:
        shaped = shaped.where(~title_excluded(F.col("title"), exclude_title_keywords))
    if exclude_companies:
        shaped = shaped.where(~company_excluded(F.col("company"), exclude_companies))
    if "seen_at" in rows.columns:
        return shaped
    return conform(shaped, POSTING)


def landing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the CSV files that land in a folder: ``_file`` and ``seen_at``, its time of writing."""
    return (
        spark.readStream.format("text").option("wholetext", True).load(folder)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("seen_at"),
        )
    )


def stream_postings(
    batch: DataFrame,
    name: str,
    exclude_title_keywords: list[str] | None = None,
    exclude_companies: list[str] | None = None,
) -> DataFrame:
    """Postings of one micro-batch of :func:`landing_stream`, each file by its own header.

    They are seen at the time their file was written, so a replay of the batch
    gives the same sightings. ``pos`` orders the files of a batch by name.
    """
    spark = batch.sparkSession
    files = [(r["_file"], r["seen_at"]) for r in batch.select("_file", "seen_at").distinct().orderBy("_file").collect()]
    times = spark.createDataFrame(files, "path string, seen_at timestamp_ntz")
    rows = read_landing(spark, [file for file, _ in files])
    # One row per file; the path of a row is that file.
    rows = rows.join(F.broadcast(times), "path")
    return shape_landing(rows, name, F.col("path"), exclude_title_keywords, exclude_companies)


def read_profile_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file: ``profile_id`` (the file) and the whole text."""
    return (
        spark.read.text(paths, wholetext=True)
        .select(F.col("_metadata.file_path").alias("profile_id"), F.col("value").alias("cv_text"))
    )
