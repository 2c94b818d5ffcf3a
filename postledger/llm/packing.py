"""Best-fit packing of token sequences, improved by swaps."""

from __future__ import annotations

import array
import json
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postledger.llm.workers import once
from postledger.shared import cut

CAPACITY = 2048
GROUP_PIECES = 8192  # pieces packed together in one task
END = 0  # this id closes every document

# Fixed value: how the vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others in order for letters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def text_coder(path: str) -> Callable[[str], list[int]]:
    """The function from text to ids for a vocabulary file of the ``tokenizers`` library.

    Its ids are those of that library without special tokens added around a text; the
    strings of special tokens inside a text give these tokens' ids. Merges rank by
    their id, which lets a faster encoder take the same steps.
    """
    import tiktoken

    with open(path, encoding="utf-8") as lines:
        described = json.load(lines)
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    letters = byte_of_letter()
    ranks = {bytes(letters[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
    return partial(tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special).encode, allowed_special="all")


def cut_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, salt``: every document in pieces of at most ``capacity`` ids.

    A longer document gives full pieces after a first one that takes what is left over.
    ``salt`` spreads the pieces over groups; it counts rows, so equal rows differ.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = ids.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once(f"coder:{vocabulary}", lambda: text_coder(vocabulary))
        row = 0
        for batch in batches:
            owner, piece, start, length, crc, salt = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                n = len(coded := [*coder(text), END])
                data = memoryview(array.array("I", coded).tobytes())
                begin, end, k = 0, (n - 1) % capacity + 1, 0
                while begin < n:
                    part = zlib.crc32(data[4 * begin : 4 * end])
                    owner.append(i)
                    piece.append(k)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(part)
                    row += 1
                    salt.append(zlib.crc32(row.to_bytes(8, "little"), part))
                    begin, end, k = end, end + capacity, k + 1
            columns = [batch.column(0).take(pa.array(owner, pa.int64()))]
            columns += [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, salt))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return ids.mapInArrow(encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt long")


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the bin it fills best."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        rooms = open_rooms >> n
        if rooms:
            room = n + (rooms & -rooms).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - n].append(b)
        open_rooms |= 1 << (room - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY, rounds: int = 30) -> list[list[int]]:
    """Local search between underfull bins.

    In each round the emptiest bins give to fuller ones: an item moves into the room
    of another bin, or is exchanged for a shorter one, or two of the giver's items for
    one, so that the other bin gets as full as it can. Each step takes ids from an
    emptier to a fuller bin, so the sum of squared fills grows and the search ends;
    bins that become empty are dropped.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    for _ in range(rounds):
        under = [b for b in range(len(bins)) if 0 < fill[b] < capacity]
        under.sort(key=lambda b: fill[b])
        # What could take an item's place: its length and the room of its bin. Length 0 is a plain move.
        offers = sorted((lengths[i] + capacity - fill[b], lengths[i], b, i) for b in under for i in bins[b])
        offers += sorted((capacity - fill[b], 0, b, -1) for b in under)
        offers.sort()
        keys = [o[0] for o in offers]
        touched: set[int] = set()
        changed = False

        def best(size: int, giver: int, limit: int = 64) -> tuple | None:
            """The offer that ``size`` fills best, in a bin at least as full as the giver."""
            at = bisect_left(keys, size)
            for o in offers[at : at + limit]:
                b = o[2]
                if b != giver and b not in touched and o[1] < size and fill[b] >= fill[giver]:
                    return o
            return None

        for giver in under[: max(64, len(under) // 4)]:
            if giver in touched or not bins[giver]:
                continue
            items = sorted(bins[giver], key=lambda i: -lengths[i])
            choices = [((i,), best(lengths[i], giver)) for i in items]
            pairs = [(x, y) for k, x in enumerate(items[:8]) for y in items[k + 1 : 8]]
            choices += [(p, best(lengths[p[0]] + lengths[p[1]], giver)) for p in pairs]
            choices = [(given, o) for given, o in choices if o]
            if not choices:
                continue
            # A move first; then the step that leaves the least room.
            given, (key, taken, b, back) = min(choices, key=lambda c: (c[1][1] > 0, c[1][0] - sum(lengths[i] for i in c[0])))
            size = sum(lengths[i] for i in given)
            for i in given:
                bins[giver].remove(i)
                bins[b].append(i)
            if back >= 0:
                bins[b].remove(back)
                bins[giver].append(back)
            fill[giver] -= size - taken
            fill[b] += size - taken
            touched |= {giver, b}
            changed = True
        if not changed:
            break
    return [b for b in bins if b]


def _pack(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece", "salt"], kind="stable").reset_index(drop=True)
    lengths = rows["length"].tolist()
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    number, offset, fill = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for k, items in enumerate(bins):
        at = 0
        for i in items:
            number[i], offset[i] = k, at
            at += lengths[i]
        fill[items] = at
    return rows.assign(sequence_id=rows["part"].astype("int64") * (1 << 32) + number, offset=offset, fill=fill)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``sequence_id, offset`` for rows of ``doc_id, piece, length, salt`` and others.

    Pieces are dealt by salt into groups of about ``group_pieces``, which tasks pack on
    their own. What lies in sequences less than 95 per cent full afterwards is dealt
    and packed once more, so the few ends of all groups fill each other up.
    ``pieces`` must be a stored table.
    """
    carried = [c for c in pieces.columns if c != "salt"]
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in pieces.columns) + ", part long, sequence_id long, offset long, fill long"

    def packed(rows: DataFrame, first_part: int) -> tuple[DataFrame, int]:
        parts = max(1, -(-rows.count() // group_pieces))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("salt"), F.lit(parts)) + first_part)
        return dealt.groupBy("part").applyInPandas(lambda group: _pack(group, capacity), schema), first_part + parts

    first, parts = packed(pieces, 0)
    first = cut(first, "pack-first")
    loose = F.col("fill") < int(capacity * 0.95)
    second, _ = packed(first.where(loose).select(*pieces.columns), parts)
    return first.where(~loose).unionByName(second).select(*carried, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Where every piece of every document stands in sequences of at most ``capacity`` ids.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A
    document's ids are those of the byte-level vocabulary at ``vocabulary`` (a file of
    the ``tokenizers`` library, readable on every executor), then id 0.

    NULL text counts as empty and gives the one id 0. NULL ids and repeated rows are
    documents of their own, each packed once. An empty table gives an empty table;
    other columns are not read. Sequence numbers are unique, otherwise arbitrary.
    """
    return pack_pieces(cut(cut_pieces(docs, vocabulary, id_col, text_col, capacity), "pack-pieces"), capacity, group_pieces)
