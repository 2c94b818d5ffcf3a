"""Substring deduplication with compact windows over min-hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postledger.llm.components import components
from postledger.llm.shingles import batch_words, chain, mixed
from postledger.llm.workers import sliced
from postledger.shared import cut

WIDTH = 5  # words of a shingle
PASSAGE = 50  # words of the shortest passage
HASHES = 4  # min-hash functions
AGREE = 1  # functions that must agree before a pair is verified
REACH = 16  # shingles between the two points that a window is matched by
PERCENT = 75  # similarity of two passages' shingle sets
REST = PASSAGE - WIDTH  # shingles of the shortest passage beside its minimum
FEW_PAIRS = 10_000  # places of open groups are paired as a whole if they give no more pairs than this
GAP = 12  # shingles in a row that may differ: two edits side by side
TOGETHER = 1 << 16  # shingles hashed at once


def compact_windows(h: np.ndarray, least: int, tied: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """``left, centre, right`` (inclusive) of every compact window at least ``least`` wide.

    The windows are the wide nodes of the Cartesian tree over the hashes: every passage
    of that width inside ``left..right`` that holds ``centre`` has its minimum there.
    Of equal minima the middle one parts the window, so that runs of one hash stay shallow.
    ``tied``, if it is known, tells for each hash whether another equals it.
    """
    found, open_ = [], [(0, len(h))] if len(h) >= least else []
    while open_:
        a, b = open_.pop()
        part = h[a:b]
        c = a + int(part.argmin())
        if tied is None or tied[c]:
            equal = np.flatnonzero(part == h[c])
            c = a + int(equal[len(equal) // 2])
        found.append((a, c, b - 1))
        if c - a >= least:
            open_.append((a, c))
        if b - c > least:
            open_.append((c + 1, b))
    return found


def seeds() -> np.ndarray:
    return mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _wide_texts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, shingles and where each text's begin, of the texts that can hold a passage; about TOGETHER at a time."""
    owner, held, size = [], [], 0
    for i, words in enumerate(batch_words(texts)):
        if len(words) >= PASSAGE:
            owner.append(i)
            held.append(words)
            size += len(words)
        if size >= TOGETHER:
            yield np.array(owner), *_shingles(held)
            owner, held, size = [], [], 0
    if owner:
        yield np.array(owner), *_shingles(held)


def _shingles(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of several texts, hashed together, and where each text's begin."""
    ends = np.cumsum([len(words) for words in held])
    keep = np.ones(ends[-1], dtype=bool)
    for k in range(1, WIDTH):
        keep[ends - k] = False  # these would run into the next text
    flat = chain(np.concatenate(held), WIDTH)[keep[: ends[-1] - WIDTH + 1]]
    return flat, np.concatenate(([0], ends - (WIDTH - 1) * np.arange(1, len(ends) + 1)))


def repeated(values: np.ndarray) -> np.ndarray:
    """For each value whether it comes more than once."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    found = np.zeros(len(values), dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least, salts = PASSAGE - WIDTH + 1, seeds()
    for batch in sliced(batches):
        for owner, flat, begins in _wide_texts(batch.column(1).to_pylist()):
            spans = list(zip(begins[:-1].tolist(), begins[1:].tolist()))
            tied = [repeated(flat[begin:end]) for begin, end in spans]
            found, many = [], []
            for salt in salts:
                hashes = mixed(flat ^ salt)
                for (begin, end), ties in zip(spans, tied):
                    windows = compact_windows(hashes[begin:end], least, ties)
                    found += windows
                    many.append(len(windows))
            windows = np.array(found, dtype=np.int64)
            fn = np.repeat(np.repeat(np.arange(HASHES), len(owner)), many)
            text = np.repeat(np.tile(np.arange(len(owner)), HASHES), many)
            left, centre, right = windows.T
            # The window is known by its minimum and a second shingle on one side.
            for step in (-REACH, REACH):
                other = centre + step
                good = np.flatnonzero((other >= left) & (other <= right))
                begin = begins[text[good]]
                pair = mixed(flat[begin + centre[good]] + fn[good].astype(np.uint64) + np.uint64(1)) ^ mixed(flat[begin + other[good]] + np.uint64(step + 100))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pair.view(np.int64)),
                        pa.array(fn[good].astype(np.int32)),
                        batch.column(0).take(pa.array(owner[text[good]])),
                        *(pa.array(windows[good, k].astype(np.int32)) for k in range(3)),
                    ],
                    ["key", "fn", "doc_id", "left", "centre", "right"],
                )


class Sequence:
    """The shingles of a text in order of place, and sorted."""

    def __init__(self, words: np.ndarray):
        self.grams = chain(words, WIDTH)
        self.order = np.argsort(self.grams, kind="stable")
        self.ranked = self.grams[self.order]
        same = np.concatenate(([False], self.ranked[1:] == self.ranked[:-1]))
        # The first of equal shingles in the sorted order numbers them all.
        self.number = np.empty(len(same), dtype=np.int64)
        self.number[self.order] = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        self.earlier = np.full(len(same), -1)  # the last place before with the same shingle
        self.earlier[self.order[same]] = self.order[np.flatnonzero(same) - 1]


def passages(x: Sequence, y: Sequence, anchors: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """The near-duplicate passages of two texts around their common shingles ``cx, cy``."""
    where = np.minimum(np.searchsorted(y.ranked, x.grams), len(y.grams) - 1)
    # Of equal shingles of y, the one at or after the same offset.
    same = y.ranked[where] == x.grams
    p = np.flatnonzero(same)
    q = y.order[where[p]]
    number = np.where(same, where, len(y.grams))  # as y numbers them
    done: list[tuple[int, int, int, int]] = []
    for cx, cy in anchors:
        # Anchors inside a passage that was found need no second look.
        if any(a <= cx < b and c <= cy < d for a, b, c, d in done):
            continue
        if found := _passage_at(x, y, p, q, number, cx, cy):
            done.append(found)
    return done


def _passage_at(x: Sequence, y: Sequence, p: np.ndarray, q: np.ndarray, number: np.ndarray, cx: int, cy: int) -> tuple[int, int, int, int] | None:
    """The near-duplicate passages of two shingle sequences around a common shingle.

    Shingles p of x that y has (at q) near the same offset are matched. The passage is the
    first run of matches around the anchor that is long enough and whose sets are similar
    enough: the run that no more than GAP differing shingles interrupt, its densest
    part, or the part without any difference.
    """
    straight = np.clip(p - cx + cy, 0, len(y.grams) - 1)
    q = np.where(y.number[straight] == number[p], straight, q)
    near = np.abs((p - cx) - (q - cy)) <= 2 * GAP + np.abs(p - cx) // 8
    p, q = p[near], q[near]
    at = int(np.searchsorted(p, cx))
    if at >= len(p) or p[at] != cx:
        return None
    for begin, end in _runs(p, q, at):
        xs, xe = int(p[begin]), int(p[end])
        ys, ye = int(q[begin : end + 1].min()), int(q[begin : end + 1].max())
        if min(xe - xs, ye - ys) < PASSAGE - WIDTH:
            continue
        first = x.earlier[xs : xe + 1] < xs  # each shingle of the passage once
        held = np.zeros(len(y.grams) + 1, dtype=bool)
        held[y.number[ys : ye + 1]] = True
        common = int((held[number[xs : xe + 1]] & first).sum())
        either = int(first.sum()) + int((y.earlier[ys : ye + 1] < ys).sum()) - common
        if 100 * common >= PERCENT * either:
            return xs, xe + WIDTH, ys, ye + WIDTH
    return None


def _runs(p: np.ndarray, q: np.ndarray, at: int) -> Iterator[tuple[int, int]]:
    """Runs of the matched places p around number ``at``, the widest kind first."""

    def between(breaks: np.ndarray) -> tuple[int, int]:
        before, after = breaks[breaks < at], breaks[breaks >= at]
        return (int(before[-1]) + 1 if len(before) else 0), (int(after[0]) if len(after) else len(p) - 1)

    def unbroken(gap: int) -> tuple[int, int]:
        return between(np.flatnonzero(np.diff(p) > gap + 1))

    def dense() -> tuple[int, int]:
        # Six matches make up for one shingle that differs on both sides: 6 / (6 + 2) = 0.75.
        gain = np.arange(len(p)) * 7 - (p - p[0]) * 6
        right = at + int(np.flatnonzero(gain[at:] == gain[at:].max())[-1])
        left = int(np.flatnonzero(gain[: at + 1] == gain[: at + 1].min())[0])
        return left, right

    yield unbroken(GAP)
    yield dense()
    yield unbroken(0)
    # Matches at other offsets can spoil the run; that at the anchor's own offset is equal word for word.
    yield between(np.flatnonzero((np.diff(p) > 1) | (np.diff(q) != 1)))


def _sequences(batch: pa.RecordBatch, last: list) -> Iterator[tuple[Sequence, Sequence]]:
    """Both texts of each row (columns 3 and 4). Rows of one leader mostly come together: its text is read once for them."""
    leads = batch.column(1).to_pylist()
    new = [i for i, lead in enumerate(leads) if lead != (leads[i - 1] if i else last[0])]
    lead_words = batch_words(batch.column(4).take(pa.array(new, pa.int64())).to_pylist())
    for lead, words in zip(leads, batch_words(batch.column(3).to_pylist())):
        if lead != last[0]:
            last[:] = lead, Sequence(next(lead_words))
        yield Sequence(words), last[1]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = [None, None]
    for batch in sliced(batches):
        out: list[list[int]] = [[], [], [], [], []]
        anchors = batch.column(2).to_pylist()
        for i, (x, y) in enumerate(_sequences(batch, last)):
            for found in passages(x, y, sorted((r["cx"], r["cy"]) for r in anchors[i])):
                for held, value in zip(out, (i, *found)):
                    held.append(value)
        rows = pa.array(out[0], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(v, pa.int32()) for v in out[1:])], ["doc_id", "lead_id", "start", "end", "lead_start", "lead_end"]
        )


def common_run(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, step: int) -> np.ndarray:
    """How many shingles next to each anchor, on the side of ``step``, are equal one by one; REST at most."""
    way = np.arange(1, REST + 1) * step
    at, to = cx[:, None] + way, cy[:, None] + way
    inside = (at >= 0) & (at < len(x)) & (to >= 0) & (to < len(y))
    equal = inside & (x[np.clip(at, 0, len(x) - 1)] == y[np.clip(to, 0, len(y) - 1)])
    return np.where(equal.all(axis=1), REST, equal.argmin(axis=1))


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each place of a group once per side: keyed by how far it follows the leader there and by the shingle that parts them."""
    last, names = [None, None], ["key", "doc_id", "left", "centre", "right", "root"]
    for batch in sliced(batches):
        places = batch.column(2)
        begins, flat = places.offsets.to_numpy() - places.offsets[0].as_py(), places.flatten()
        group, cx, cy = (flat.field(name).to_numpy() for name in ("key", "centre", "y"))
        keys, rows = [], []
        for i, (x, y) in enumerate(_sequences(batch, last)):
            here = np.arange(begins[i], begins[i + 1])
            for step in (-1, 1):
                run = common_run(x.grams, y.grams, cx[here], cy[here], step)
                parted = cx[here] + step * (run + 1)
                good = np.flatnonzero((run < REST) & (parted >= 0) & (parted < len(x.grams)))
                keys.append(mixed(mixed(group[here[good]].view(np.uint64)) + x.grams[parted[good]]) ^ mixed((2 * run[good] + (step > 0) + 1).astype(np.uint64)))
                rows.append(here[good])
        if not rows:
            continue
        rows = np.concatenate(rows)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(begins))
        taken = flat.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(pa.array(owner[rows])), *(taken.field(name) for name in names[2:])], names
        )


def _merged(found: DataFrame) -> DataFrame:
    """``doc_id, spans``: the found passages of each document, those that meet made one."""
    spans = found.select("doc_id", "start", "end").unionByName(found.select(F.col("lead_id").alias("doc_id"), F.col("lead_start").alias("start"), F.col("lead_end").alias("end")))
    # A leader's span comes once per follower: equal ones go before the spans of a document meet.
    spans = spans.distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    merged = F.expr(
        """aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (done, s) ->
             if(size(done) > 0 and s.start <= element_at(done, -1).end,
                concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start, greatest(element_at(done, -1).end, s.end) as end))),
                concat(done, array(s))))"""
    )
    return spans.select("doc_id", merged.alias("spans"))


def _led(windows: DataFrame, *others: str) -> DataFrame:
    """The places of each signature that several documents have, but the first, with that one as ``y``.

    The first place of the smallest document leads. ``near``: seen from the leader's offset
    the two windows overlap by a passage.
    """
    place = ("doc_id", "left", "centre", "right")
    group = Window.partitionBy("key").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        windows.select("key", *others, *place, F.first(F.struct(*place)).over(group).alias("y"), F.last("doc_id").over(group).alias("last"))
        .where("y.doc_id != last and (doc_id != y.doc_id or centre != y.centre)")
        .select("key", *others, *place, F.col("y.doc_id").alias("lead_id"), F.col("y.centre").alias("y"), _near().alias("near"))
    )


def _near() -> Column:
    shift = F.col("y.centre") - F.col("centre")
    overlap = F.least(F.col("right") + shift, F.col("y.right")) - F.greatest(F.col("left") + shift, F.col("y.left")) + 1
    return overlap >= PASSAGE - WIDTH + 1


def _paired(places: DataFrame) -> DataFrame:
    """All pairs of places of a group, of two documents."""
    others = places.select("key", F.struct("doc_id", "left", "centre", "right").alias("y"))
    return places.join(others, "key").where("doc_id > y.doc_id").select(*places.columns, F.col("y.doc_id").alias("lead_id"), F.col("y.centre").alias("y"), _near().alias("near"))


def _open(places: DataFrame) -> DataFrame:
    """The places of groups that more than one document shares and whose passages are not all one component's."""
    group = Window.partitionBy("key")
    over = lambda x: x.over(group)
    return (
        places.withColumn("several", over(F.min("doc_id")) != over(F.max("doc_id")))
        .withColumn("apart", (over(F.count("root")) < over(F.count(F.lit(1)))) | (over(F.min("root")) != over(F.max("root"))))
        .where("several and apart")
        .drop("several", "apart")
    )


def _named_in(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is on either side of a pair."""
    ids = cut(pairs.select("doc_id").distinct().unionByName(pairs.select(F.col("lead_id").alias("doc_id")).distinct()).distinct(), "windows-ids")
    return rows.join(F.broadcast(ids) if ids.count() <= 1_000_000 else ids, "doc_id", "left_semi")


def _with_texts(pairs: DataFrame, texts: DataFrame, held: str) -> DataFrame:
    return (
        pairs.join(texts, "doc_id")
        .join(texts.select(F.col("doc_id").alias("lead_id"), F.col("text").alias("lead_text")), "lead_id")
        .select("doc_id", "lead_id", held, "text", "lead_text")
    )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of at least 50 words that other documents have too, or nearly so.

    Returns ``doc_id, start_word, end_word, group_id, n_docs``: a merged span of words per
    row (from 0, end exclusive), the smallest document reachable by shared passages,
    and how many documents that group has. Documents without such a passage have no row.

    1. For each of HASHES min-hash functions the compact windows of a document are the
       wide nodes of its Cartesian tree. A passage lies whole in the window of its
       minimum, so two documents with the passage have windows with one signature.
    2. Windows are grouped by signature (the minimum and one shingle REACH away, so
       that a common line alone does not bring strangers together). The first place of
       the smallest document of a group leads it; every other is joined with the leader only.
    3. For each pair the windows must overlap the leader's at one offset for AGREE functions;
       the texts then decide: passages grow around the anchors and must have similar sets.
    4. Places of a group that are not all in passages of one component meet again. Two
       that share a longer run of shingles with each other than with the leader leave it
       at one place by one shingle, on the left or on the right: each such branch is a
       group of its own with its own leader, and goes through steps 3 and 4. The run a
       group is known to share grows each time and a branch begins at most REST shingles
       from the minimum, so there are at most 2 x REST rounds, and a place is in two
       branches at most: no group gives all its pairs. Only when all pairs left are at most
       FEW_PAIRS, or a hundredth of the places that met at first, are they made in one step.

    So a passage that two documents have word for word links them, whoever leads their groups;
    one that differs in some words does so if a minimum, the shingle beside it and the run
    up to the leader's end are common. Rows with NULL id
    or text, and texts under 50 words, have no passage. Rows of one id count as
    one document, by one of its texts. An empty table gives an empty table; other
    columns are not read.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    windows = rows.mapInArrow(_windows, f"key long, fn int, doc_id {kind}, left int, centre int, right int")
    shared = cut(_led(windows, "fn"), "windows-shared")
    texts = cut(_named_in(shared, rows).groupBy("doc_id").agg(F.first("text").alias("text")), "windows-texts")

    def verified(met: DataFrame, texts: DataFrame, least: int) -> DataFrame:
        anchors = (
            met.where("near and doc_id != lead_id")
            .groupBy("doc_id", "lead_id")
            .agg(F.count_distinct("fn").alias("functions"), F.collect_set(F.struct(F.col("centre").alias("cx"), F.col("y").alias("cy"))).alias("anchors"))
            .where(F.col("functions") >= least)
        )
        anchors = cut(anchors.select("doc_id", "lead_id", "anchors"), "windows-pairs")
        return cut(_with_texts(anchors, texts, "anchors").mapInArrow(_verify, f"doc_id {kind}, lead_id {kind}, start int, `end` int, lead_start int, lead_end int"), "windows-found")

    found = verified(shared, texts, AGREE)
    groups = components(found, "doc_id", "lead_id")
    few = max(FEW_PAIRS, shared.count() // 100)
    # From here on a group is one leader's place with all that met it.
    places = shared.withColumn("key", F.xxhash64("lead_id", "y"))
    while True:
        known = _merged(found).join(groups.withColumnRenamed("node", "doc_id"), "doc_id")
        inside = F.exists("spans", lambda s: (s["start"] <= F.col("centre")) & (F.col("centre") < s["end"]))
        place = ["key", "lead_id", "y", "doc_id", "centre"]
        placed = places.join(known, "doc_id", "left").select(*place, "left", "right", F.when(inside, F.col("root")).alias("root"))
        one = _open(placed).groupBy(*place).agg(F.min("left").alias("left"), F.max("right").alias("right"), F.first("root").alias("root"))
        unsettled = cut(one, "windows-unsettled")
        if unsettled.isEmpty():
            break
        # The texts still needed are fewer each time.
        texts = cut(_named_in(unsettled, texts), "windows-texts")
        held = F.collect_list(F.struct("key", "left", "centre", "right", "root", "y")).alias("places")
        apart = _with_texts(unsettled.groupBy("doc_id", "lead_id").agg(held), texts, "places")
        branches = apart.mapInArrow(_branches, f"key long, doc_id {kind}, left int, centre int, right int, root {kind}")
        branches = cut(_open(branches).withColumn("fn", F.lit(0)), "windows-branches")
        left = branches.groupBy("key").count().agg(F.sum(F.expr("count * (count - 1)"))).first()[0]
        if not left:
            break
        last = left <= few
        met = branches.transform(_paired) if last else cut(_led(branches, "fn", "root"), "windows-shared")
        more = verified(met, texts, 1)
        places = met.drop("root")
        if more.isEmpty():
            if last:
                break
            continue
        found = found.unionByName(more)
        groups = components(groups.select(F.col("node").alias("doc_id"), F.col("root").alias("lead_id")).unionByName(more.select("doc_id", "lead_id")), "doc_id", "lead_id")
        if last:
            break
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n_docs"))
    return (
        _merged(found).select("doc_id", F.explode("spans").alias("span"))
        .join(groups.withColumnRenamed("node", "doc_id"), "doc_id")
        .join(sizes, "root")
        .select("doc_id", F.col("span.start").cast("long").alias("start_word"), F.col("span.end").cast("long").alias("end_word"), F.col("root").alias("group_id"), "n_docs")
    )
