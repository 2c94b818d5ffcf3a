"""License scans: an exact set-similarity join of text blocks and license templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The characters between words, the phrases, and the templates.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
    ],
    "cc-by-nc": ["this work is licensed under cc by nc 4 0", "creative commons attribution noncommercial license"],
    "cc-by-sa": ["creative commons attribution sharealike license"],
    "gpl-3": ["gnu general public license version 3"],
    "gpl-2": ["gnu general public license version 2"],
    "lgpl": ["gnu lesser general public license"],
    "mpl-2": ["mozilla public license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
}
THRESHOLD = 80  # per cent of a template's words that a block must hold
STRIDE = 16  # words between the blocks of the shortest templates; a block has twice as many


def stride_of(words: int, threshold: int = THRESHOLD) -> int:
    """The distance of the blocks for a template of so many words, a power of two.

    Long templates get room for a passage with as many foreign words as the threshold
    lets differ.
    """
    if words <= STRIDE + 1:
        return STRIDE
    return 1 << (-(-100 * words // max(threshold, 1)) - 2).bit_length()


def words_of(text: Column) -> Column:
    """The words, with A-Z in lower case and all other letters as they are."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, GAP), lambda w: w != "")


def template_rows(templates: dict[str, list[str]] = TEMPLATES, threshold: int = THRESHOLD) -> list[tuple]:
    """``template, label, tokens, need, stride``; ``need`` different words must be shared."""
    rows = []
    for label, texts in templates.items():
        for text in texts:
            tokens = sorted(set(text.split()))
            rows.append((len(rows), label, tokens, -(-threshold * len(tokens) // 100), stride_of(len(text.split()), threshold)))
    return rows


def token_ranks(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words, rarest first, by their number of documents over all rows."""
    seen = words.select(F.explode(F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]))).alias("token"))
    counts = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matched_templates(words: DataFrame, keys: list[str], templates: dict[str, list[str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """``keys, label, score``: every (row, label) with a block that holds a template.

    Blocks are windows of 2 s words at every s words, so any passage of s + 1 words
    lies whole in one; s follows the length of the template (:func:`stride_of`), and the
    templates of one s share their blocks. What is found is thus every passage of up to
    s + 1 words, wherever it begins; a longer one that is spread over more words is found
    where a block holds enough of it. Let r be the words shared by a block and a
    template of m distinct words; the block meets the template when
    100 r >= threshold m. Words are put in one global order, rarest first. A match
    must hold one of the first m - need + 1 words of the template (prefix filter),
    have at least ``need`` words (length filter), and, given that its first shared
    word stands at place i of the template and leaves k of the block's ordered
    template words, can share at most 1 + min(m - i - 1, k) (positional filter).
    What is left is counted exactly.
    """
    rows = template_rows(templates, threshold)
    vocabulary = sorted({w for row in rows for w in row[2]})
    order = token_ranks(words, vocabulary)
    found = [
        _matched_at(words, keys, order, [row for row in rows if row[4] == stride], stride)
        for stride in sorted({row[4] for row in rows})
    ]
    if not found:
        return words.limit(0).select(*keys, F.lit("").alias("label"), F.lit(0.0).alias("score"))
    return reduce(DataFrame.unionByName, found).groupBy(*keys, "label").agg(F.max("score").alias("score"))


def _matched_at(words: DataFrame, keys: list[str], order: list[str], rows: list[tuple], stride: int) -> DataFrame:
    """``keys, label, score`` of every match of templates whose blocks stand ``stride`` words apart."""
    rank = {w: i for i, w in enumerate(order)}
    ranked = F.array(*[F.lit(w) for w in order])
    table = []
    for template, label, tokens, need, _ in rows:
        ranks = sorted(rank[w] for w in tokens)
        table += [(p, i, template, label, ranks, len(ranks), need) for i, p in enumerate(ranks[: len(ranks) - need + 1])]
    # As long as the list of templates, whatever the documents.
    columns = "token int, at int, template int, label string, ranks array<int>, size int, need int"
    prefixes = F.broadcast(words.sparkSession.createDataFrame(table, columns))
    rare = F.array(*[F.lit(order[p]) for p in sorted({row[0] for row in table})])
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - stride - 1, F.lit(0)), F.lit(stride))
    blocks = (
        words.where(F.arrays_overlap("words", rare))
        .select(*keys, F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, 2 * stride))).alias("block"))
        .where(F.arrays_overlap("block", rare))
        .select(*keys, F.size(F.array_distinct("block")).alias("length"), F.array_intersect(ranked, "block").alias("shared"))
        # array_intersect keeps the order of the ranked list: rarest first.
        .select(*keys, "length", F.transform("shared", lambda w: (F.array_position(ranked, w) - 1).cast("int")).alias("shared"))
    )
    pairs = (
        blocks.select(*keys, "length", "shared", F.posexplode("shared").alias("place", "token"))
        .join(prefixes, "token")
        .where(F.col("length") >= F.col("need"))
        .where(F.least(F.col("size") - F.col("at") - 1, F.size("shared") - F.col("place") - 1) + 1 >= F.col("need"))
        .withColumn("common", F.size(F.array_intersect("shared", "ranks")))
        .where("common >= need")
    )
    return pairs.select(*keys, "label", (F.col("common") / F.col("size")).alias("score"))


def places(line: Column, phrase: str) -> Column:
    """Word numbers at which the phrase starts in a line of words between spaces; NULL if nowhere."""
    length = len(phrase.split())
    # The closing space is only looked at: the next phrase may begin with it.
    words = F.transform(F.split(line, f" {phrase}(?= )"), lambda piece: F.regexp_count(piece, F.lit("[^ ]+")))
    ahead = lambda k: F.aggregate(F.slice(words, F.lit(1), k), F.lit(0), lambda total, n: total + n) + (k - 1) * length
    return F.when(line.contains(f" {phrase} "), F.transform(F.sequence(F.lit(1), F.size(words) - 1), ahead))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """License phrases and templates found in every document.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score`` with one row per input row. ``base_labels`` come from the phrases, whose
    places ``n_base``, ``first_word`` and ``last_word`` count; ``labels`` adds those of the
    templates. ``score`` is the largest share of a template's words found in one
    block, 1 where a phrase stands, 0 without any.

    NULL text counts as empty and gives no words. Repeated rows, rows of one id with
    different texts and NULL ids are rows of their own: templates are looked up by
    id and text hash. An empty table gives an empty table; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_text"), words_of(text).alias("words"))
    found = matched_templates(words, ["doc_id", "_text"], templates, threshold)
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")).agg(F.collect_set("label").alias("_more"), F.max("score").alias("_score"))

    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    narrow = words.select("doc_id", "_text", F.size("words").cast("long").alias("n_words"), line.alias("_line"))
    narrow = narrow.withColumns({f"_{label}": places(F.col("_line"), phrase) for label, phrase in phrases.items()})
    narrow = narrow.withColumn("_starts", F.flatten(F.array(*[F.coalesce(f"_{label}", F.array().cast("array<int>")) for label in phrases])))
    base = F.array_compact(F.array(*[F.when(F.col(f"_{label}").isNotNull(), F.lit(label)) for label in phrases]))
    narrow = narrow.select(
        "doc_id",
        "_text",
        "n_words",
        F.size("_starts").cast("long").alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"),
        F.array_max("_starts").cast("long").alias("last_word"),
        base.alias("_base"),
    )
    joined = narrow.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    more = F.coalesce(F.col("_more"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
