"""Two-key deduplication against row-by-row processing."""

import random

import pytest

from postledger.operators import dedup, merge

SCHEMA = "pos bigint, source_id string, url string"


def spellings(url):
    bare = url.rstrip("/")
    return {url, bare} | (set() if url.endswith("/") else {url + "/"})


def one_by_one(rows, exact=False):
    ids, urls, kept = set(), set(), []
    for pos, ident, url in sorted(rows):
        mine = ({url} if exact else spellings(url)) if url else set()
        if ident in ids or mine & urls:
            continue
        kept.append(pos)
        ids.add(ident)
        if url:
            urls.add(url)
    return kept


def random_rows(rng, n, ids, urls):
    ends = ["", "", "/", "//", "///"]
    rows = []
    for pos in range(n):
        url = rng.choice(["", f"http://h/{rng.randrange(urls)}" + rng.choice(ends)])
        rows.append((pos, f"i{rng.randrange(ids)}", url))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("exact", [False, True])
def test_rounds_equal_row_by_row(spark, seed, exact):
    rng = random.Random(seed)
    rows = random_rows(rng, 250, rng.choice([5, 80, 200]), rng.choice([4, 60, 150]))
    expected = one_by_one(rows, exact)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = dedup.dedup_two_keys(frame, exact)
    assert sorted(r.pos for r in got.collect()) == expected


def test_long_chain_of_dependencies(spark):
    # Each row shares its id with one neighbour and its url with the other.
    rows = [(i, f"i{(i + 1) // 2}", f"u{i // 2}") for i in range(60)]
    got = dedup.dedup_two_keys(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.pos for r in got.collect()) == one_by_one(rows) == list(range(0, 60, 2))


def test_chains_take_logarithmic_rounds(spark, monkeypatch):
    # One chain of 100,000 rows, another that ends at a row with two earlier ones.
    n = 100_000
    rows = [(i, f"i{(i + 1) // 2}", f"u{i // 2}") for i in range(n)]
    rows += [(n, "a", "x"), (n + 1, "b", "y"), (n + 2, "a", "y"), *((n + 3 + i, f"c{(i + 1) // 2}", f"y{(i + 2) // 2}") for i in range(50))]
    writes = []
    written = dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df, label: (writes.append(label), written(df, label))[1])
    got = dedup.greedy_matching(spark.createDataFrame(rows, "pos bigint, id string, url string"))
    assert sorted(r.pos for r in got.collect()) == one_by_one(rows)
    assert len(writes) <= 20


@pytest.mark.parametrize("seed", range(3))
def test_sparse_rows_with_chains_and_odd_spellings(spark, seed):
    # Most rows have one earlier row: chains of all lengths, forks, and guards.
    rng = random.Random(100 + seed)
    rows = random_rows(rng, 400, 300, 260)
    for exact in (False, True):
        got = dedup.dedup_two_keys(spark.createDataFrame(rows, SCHEMA), exact)
        assert sorted(r.pos for r in got.collect()) == one_by_one(rows, exact)


def test_heavy_id_and_repeated_pairs(spark):
    rows = [(i, "hot" if i % 3 else f"i{i}", f"u{i % 7}") for i in range(300)]
    got = dedup.dedup_two_keys(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.pos for r in got.collect()) == one_by_one(rows)


def test_first_and_last_by_key(spark):
    rows = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z")], SCHEMA)
    assert {(r.source_id, r.pos) for r in dedup.first_by_key(rows, ["source_id"]).collect()} == {("a", 1), ("b", 2)}
    assert {(r.source_id, r.pos, r.first_pos) for r in dedup.last_by_key(rows, ["source_id"]).collect()} == {("a", 3, 1), ("b", 2, 2)}


def landed(spark, rows):
    return spark.createDataFrame(rows, "pos bigint, source_id string, title string, company string, url string, description string")


def test_merge_decisions_and_counts(spark):
    existing = spark.createDataFrame(
        [("old-1", "T", "Good", "http://e/1/"), ("old-2", "T", "Bad Co", "http://e/2")],
        "source_id string, title string, company string, url string",
    )
    ledger = spark.createDataFrame([("led-1", "http://l/1"), ("", None)], "source_id string, url string")
    new = landed(spark, [
        (1, "", "T", "C", "", ""),                      # no id
        (2, "a", "T", "the BAD co", "", ""),            # company
        (3, "b", "Intern", "C", "", "easy apply"),      # title
        (4, "c", "Internal", "C", "http://e/1", "Easy  Apply"),  # url of a kept row
        (5, "old-2", "T", "C", "http://e/2", "easy apply"),      # row was removed: free again
        (6, "led-1", "T", "C", "", "easy apply"),       # id in the ledger
        (7, "d", "T", "C", "http://l/1/", "easy apply"),  # url in the ledger
        (8, "e", "T", "C", "http://n/1", "easy apply"),
        (9, "f", "T", "C", "http://n/1/", "easy apply"),  # url of row 8
        (10, " g ", " T ", "C", "", "no"),              # not easy
        (11, "h", "T", "C", "", "easy apply"),
        (12, "h", "T", "C", "http://n/2", "easy apply"),  # id of row 11
        (13, "k", "T", "C", "http://n/2", "easy apply"),  # row 12 reserved nothing
    ])
    rules = merge.MergeRules(["bad co"], [" intern"], easy_apply_only=True)
    done = merge.merge_rows(new, existing, ledger, rules)
    got = {r.pos: r.decision for r in done.decisions.collect()}
    assert got == {
        1: "skipped", 2: "excluded", 3: "excluded", 4: "skipped", 5: "imported", 6: "skipped", 7: "skipped",
        8: "imported", 9: "skipped", 10: "excluded", 11: "imported", 12: "skipped", 13: "imported",
    }
    assert {r.decision: r.n for r in done.counts.collect()} == {"skipped": 5 + 1, "excluded": 3 + 1, "imported": 4}
    assert sorted(r.source_id for r in done.merged.collect()) == ["e", "h", "k", "old-1", "old-2"]


def test_import_fills_ids_and_compares_urls_exactly(spark):
    import hashlib

    new = landed(spark, [
        (1, "", "T", "C", "http://x", ""),
        (2, "", "T", "C", "http://x/", ""),
        (3, "", "T", "C", "http://x", ""),
        (4, "", "T", "C", "", ""),
        (5, "z", "", "C", "", ""),
    ])
    rules = merge.MergeRules(require_id=False, exact_url=True)
    done = merge.merge_rows(new, rules=rules)
    got = {r.pos: (r.decision, r.source_id) for r in done.decisions.collect()}
    digest = lambda s: "manual-" + hashlib.sha256(s.encode()).hexdigest()[:16]
    assert got[1] == ("imported", digest("http://x"))
    assert got[2] == ("imported", digest("http://x/"))
    assert got[3][0] == "skipped"
    assert got[4] == ("imported", digest("T|C|"))
    assert got[5][0] == "skipped"
