"""Pairs of documents and vectors against brute force."""

import random
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from edge_rows import edge_documents, edited, frame, words  # noqa: E402

from postledger.llm import jaccard, shingles, vectors, windows  # noqa: E402
from postledger.llm.components import components  # noqa: E402


def plain_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_shingles(text):
    w = plain_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_word_hashes_do_not_depend_on_neighbours(monkeypatch):
    texts = ["A b\tc", "", None, "Ünï 𝔘", "x " * 3000, "one", "long" * 700 + " end"]
    together = [w.tolist() for w in shingles.batch_words(texts)]
    assert together == [shingles.text_words(t or "").tolist() for t in texts]
    assert [len(w) for w in together] == [len(plain_words(t)) for t in texts]
    whole = shingles.text_words("x yy zzz " * 4000)
    monkeypatch.setattr(shingles, "PIECE", 1000)
    assert shingles.text_words("x yy zzz " * 4000).tolist() == whole.tolist()
    assert len(set(shingles.text_words("a b ab ba A").tolist())) == 4


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = roots({n for p in links for n in p}, links)
    assert got == {n: r for n, r in expected.items() if n in got}
    assert {n for p in links if p[0] != p[1] for n in p} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_jaccard(rows):
    sets = {i: plain_shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 7 * len(sets[a] & sets[b]) >= 3 * (len(sets[a]) + len(sets[b]))]
    found = roots(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def family_rows():
    """Families of near copies, near-misses at the threshold, a passage that strangers share."""
    rng = random.Random(4)
    rows, passage = [], words("passage", 40, 10_000)
    for f in range(12):
        base = words(f"f{f}", rng.choice([6, 20, 60, 120]), 10_000)
        for _ in range(rng.randrange(1, 9)):
            rows.append(edited(base, {rng.randrange(len(base)) for _ in range(rng.choice([0, 1, 1, 2, 4, 6]))}))
    rows += [passage + words(f"s{i}", n, 10_000) for i, n in enumerate([5, 8, 10, 12, 14, 30] * 3)]
    rows += [words("t", 4), words("t", 4), words("t", 3), ["solo"], ["Solo"], []]
    return [(i * 3 + 1, " ".join(w)) for i, w in enumerate(rows)]


def test_ngram_jaccard_equals_brute_force(spark):
    rows = family_rows()
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_jaccard(rows)


def test_frequent_ngrams_are_dealt_over_salts(spark, monkeypatch):
    # Every class counts as frequent: all groups are salted, and the result must not change.
    monkeypatch.setattr(jaccard, "SALTED_ROWS", 1)
    rows = family_rows()
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_jaccard(rows)


def test_filters_keep_every_link():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n, m = rng.integers(1, 400, 2)
        pool = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
        x, y = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        common = len(np.intersect1d(x, y))
        need = jaccard.least_common(len(x), len(y))
        assert (100 * common >= 75 * (len(x) + len(y) - common)) == (common >= need)
        assert jaccard.part_bound(jaccard.part_sizes(x), jaccard.part_sizes(y)) >= common
        assert jaccard.suffix_bound(x, y, need) >= min(common, need)


def test_ngram_jaccard_edges(spark):
    out = jaccard.jaccard_components(frame(spark)).collect()
    assert len(out) == len(edge_documents())
    by_id = {r["doc_id"]: r for r in out}
    assert all(by_id[i]["component_id"] == 1 for i in (1, 2, 3)) and by_id[9]["component_id"] == 8
    assert all(by_id[i]["component_id"] == i and by_id[i]["n_shingles"] == 0 for i in (4, 5, 6))
    assert by_id[None]["component_id"] is None and by_id[14]["n_shingles"] == 1
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    left = jaccard.drop_near_copies(frame(spark))
    assert left.columns == frame(spark).columns and set(map(tuple, left.collect())) <= set(edge_documents())
    assert not {2, 3, 9} & {r["doc_id"] for r in left.collect()}


def plain_links(rows):
    units = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, dtype=float)
        v = v / np.abs(v).max()
        units[i] = v / np.linalg.norm(v)
    return [(a, b) for a in units for b in units if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size in [1] * 40 + [2] * 15 + [5, 30, 90]:
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * 0.05).tolist() for _ in range(size)]
    rows += [rows[3]] * 7 + [[2.5 * x for x in rows[3]], [], None, [0.0] * 16, [1.0, None], [float("nan")] * 16, [float("inf")] * 16, [1e300] * 16, [1e-300] * 16, [1.0] * 3, [2.0] * 3]
    rows = [(i * 2 + 1, v) for i, v in enumerate(rows)] + [(None, rows[3])]
    frame_ = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, n long, root long")
    found = vectors.near_duplicate_vectors(frame_).cache()
    links = plain_links(rows)
    root = roots([i for i, _ in rows if i is not None], links)
    degree = {i: sum(i in p for p in links) for i in root}
    got = {r["vec_id"]: r for r in found.collect()}
    assert len(got) == len(rows) and got[None]["component_id"] is None and got[None]["n_links"] == 0
    assert sum(min(got[i]["n_links"], degree[i]) for i in root) >= 0.95 * sum(degree.values())
    assert all(got[i]["n_links"] <= degree[i] for i in root)
    assert sum(got[i]["component_id"] == root[i] for i in root) >= 0.95 * len(root)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in root)
    assert vectors.audit_recall(frame_, found) >= 0.95
    assert vectors.near_duplicate_vectors(frame_.limit(0)).count() == 0


def test_windows_of_a_batch_are_those_of_each_text():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, size=n)) for n in (0, 49, 50, 51, 300, 700)] + ["a b " * 200, None]
    batch = lambda at: pa.RecordBatch.from_arrays([pa.array(at), pa.array([texts[i] for i in at], pa.string())], ["doc_id", "text"])
    rows = lambda at: [tuple(r.values()) for b in windows._windows(iter([batch(at)])) for r in b.to_pylist()]
    together, alone = rows(list(range(len(texts)))), [r for i in range(len(texts)) for r in rows([i])]
    assert together and sorted(together) == sorted(alone)
    for i in (4, 6):
        grams = shingles.chain(next(shingles.batch_words([texts[i]])), windows.WIDTH)
        for f, salt in enumerate(windows.seeds()):
            least = windows.PASSAGE - windows.WIDTH + 1
            plain = windows.compact_windows(shingles.mixed(grams ^ salt), least)
            assert plain == windows.compact_windows(shingles.mixed(grams ^ salt), least, windows.repeated(grams))
            assert {r[3:] for r in together if r[1] == f and r[2] == i} <= set(plain)


def test_compact_windows_cover_every_passage():
    rng = np.random.default_rng(5)
    for n, values in ((60, 1000), (200, 40), (90, 1), (10, 5)):
        h = rng.integers(0, values, n).astype(np.uint64)
        found = windows.compact_windows(h, 8)
        for a in range(n - 7):
            for b in range(a + 7, n):
                assert any(left <= a and b <= right and a <= c <= b and h[c] == h[a : b + 1].min() for left, c, right in found)
        assert len(found) <= n


def test_repeated_passages(spark):
    passage, other = words("p", 60, 10_000), words("q", 55, 10_000)
    fill = lambda s, n: words(s, n, 10_000)
    rows = [
        (1, fill("a", 80) + passage + fill("b", 20)),
        (2, passage + fill("c", 100)),
        (3, fill("d", 10) + edited(passage, {30}) + fill("e", 30) + other),
        (4, other + fill("f", 60)),
        (5, fill("g", 200)),
        (6, fill("h", 40) + passage[:30] + fill("i", 40)),  # too short a passage
        (7, passage[:40]),
    ]
    rows = [(i, " ".join(w).upper() if i == 2 else " ".join(w)) for i, w in rows] + [(8, None), (None, " ".join(passage)), (9, "")]
    out = windows.repeated_passages(spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, start long, root long")).collect()
    spans = {(r["doc_id"], r["start_word"], r["end_word"]) for r in out}
    assert {(1, 80, 140), (2, 0, 60), (4, 0, 55)} <= spans
    assert {r["doc_id"] for r in out} == {1, 2, 3, 4} and {r["group_id"] for r in out} == {1}
    assert all(r["n_docs"] == 4 for r in out)
    assert {r["doc_id"] for r in windows.repeated_passages(frame(spark)).collect()} == {1, 2, 3, 8, 9, 13}
    assert windows.repeated_passages(frame(spark, [])).count() == 0


def _led_by_a_stranger(seed):
    """Texts whose common passage has signatures only in a line of 45 words that the first text has too."""
    line, own = words(f"line{seed}", 45, 10_000), words(f"own{seed}", 7, 10_000)
    fill = lambda s, n: words(f"{s}{seed}", n, 10_000)
    stranger = line + fill("a", 30)
    return [stranger, fill("b", 30) + line + own + fill("c", 30), fill("d", 40) + line + own + fill("e", 20), stranger + line + own + fill("f", 9)]


def _signatures(text):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(text)])], ["doc_id", "text"])
    return {r["key"] for b in windows._windows(iter([batch])) for r in b.to_pylist()}


@pytest.mark.parametrize("few", [0, 10_000])
def test_passages_of_members_that_a_stranger_leads(spark, monkeypatch, few):
    monkeypatch.setattr(windows, "FEW_PAIRS", few)
    seed = next(s for s in range(500) if _signatures(_led_by_a_stranger(s)[1]) & _signatures(_led_by_a_stranger(s)[2]) <= _signatures(_led_by_a_stranger(s)[0]))
    stranger, one, two, both = (" ".join(t) for t in _led_by_a_stranger(seed))
    of = lambda rows: {(r["doc_id"], r["start_word"], r["end_word"], r["group_id"], r["n_docs"]) for r in windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert of([(1, stranger), (2, one), (3, two)]) == {(2, 30, 82, 2, 2), (3, 40, 92, 2, 2)}
    # Strangers alone have nothing in common but the line.
    assert of([(i, " ".join(stranger.split()[:45] + words(f"s{i}", 30, 10_000))) for i in range(1, 30)]) == set()
    # The leader's first place of the line is not the one that holds the passage.
    assert of([(1, both), (3, two)]) == {(1, 75, 127, 1, 2), (3, 40, 92, 1, 2)}


@pytest.mark.parametrize("few", [0, 10_000])
def test_passages_equal_brute_force_over_words(spark, monkeypatch, few):
    monkeypatch.setattr(windows, "FEW_PAIRS", few)
    rng = random.Random(11)
    line, rows = words("line", 40, 10_000), []
    for f in range(12):
        own = words(f"own{f}", rng.randrange(4, 20), 10_000)
        for m in range(rng.randrange(1, 4)):
            rows.append(words(f"a{f}-{m}", 30, 10_000) + line + own[: rng.randrange(1, 25)] + words(f"b{f}-{m}", 25, 10_000))
    grams = [{tuple(w[i : i + 50]) for i in range(len(w) - 49)} for w in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if grams[a] & grams[b]]
    expected = {n: r for n, r in roots(range(len(rows)), links).items() if any(n in p for p in links)}
    got = windows.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")).collect()
    found = {r["doc_id"]: r["group_id"] for r in got}
    assert expected and all(n in found for n in expected) and all(found[a] == found[b] for a, b in links)


def test_every_exact_passage_is_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for r in docs.collect():
        w = plain_words(r["text"])
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(r["doc_id"])
    shared = set().union(*[s for s in seen.values() if len(s) > 1])
    assert shared <= {r["doc_id"] for r in windows.repeated_passages(docs).collect()}
