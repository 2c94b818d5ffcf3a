"""Hashed word shingles of whole texts, computed with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from postledger.llm.workers import once

PIECE = 1 << 18  # bytes hashed at once
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint64)
    fold[ord("A") : ord("Z") + 1] += 32
    white = np.zeros(256, dtype=bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    return fold + np.uint64(1), white, _powers(BASE, PIECE), _powers(INVERSE, PIECE)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, A-Z folded, white space as separator."""
    fold, white, powers, inverse = once("word tables", _tables)
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    if len(raw) > len(powers):
        powers, inverse = _powers(BASE, len(raw)), _powers(INVERSE, len(raw))
    gap = white[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(gap, np.uint64(0), fold[raw] * powers[: len(raw)]))))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def text_words(text: str) -> np.ndarray:
    """Word hashes of one text; a long one is read in pieces that end at white space."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= PIECE:
        return word_hashes(data)
    parts, at = [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        parts.append(word_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def batch_words(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text, hashing short texts together."""
    at = 0
    while at < len(texts):
        held, size = [], 0
        while at < len(texts) and (not held or size + len(held[-1]) < PIECE):
            held.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(held[-1]) + 1
            at += 1
            if size >= PIECE:
                break
        if len(held) == 1:
            yield text_words(held[0].decode("utf-8", "surrogatepass"))
            continue
        # A closing mark of each text: a word of one byte that UTF-8 never has.
        words = word_hashes(b" \xff ".join(held) + b" \xff")
        mark = word_hashes(b"\xff")[0]
        ends = np.flatnonzero(words == mark)
        begin = 0
        for end in ends.tolist():
            yield words[begin:end]
            begin = end + 1


def chain(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of ``width`` words, in order of place; one for a shorter text, none for an empty one."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    h = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h = mixed(h ^ words[k : n - width + 1 + k]) + np.uint64(k + 1)
    return h


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for words in batch_words(texts):
        yield np.unique(chain(words, width))
