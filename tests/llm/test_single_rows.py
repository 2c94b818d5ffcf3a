"""Personal data, language, licenses, exact copies: one row at a time against plain Python."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from edge_rows import edge_documents, frame  # noqa: E402

from postledger.llm import exact, language, licenses, pii  # noqa: E402

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "phone":
            return 8 <= len(digits) <= 15
        if kind == "card":
            total = sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return True

    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text or "") if good(k, m.group())]


def test_base_spans_equal_plain_search():
    rng = random.Random(5)
    pieces = ["a@b.co", "@", "x.y_z", ".", "-", " ", "+", "1", "255", "256", "4539578763621486", "1.2.3.4", "(", ")", "é", "007", "a@b", "\n", "+1 (988) 555-2485", "00"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        found = [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)]
        assert found == plain_spans(text), text


def test_base_spans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 300_000):
        pii.base_spans(text)


def test_personal_data_edges(spark):
    out = pii.find_personal_data(frame(spark)).collect()
    assert len(out) == len(edge_documents())
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in out)
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_contexts_announce_unseen_identifiers(spark):
    rng = random.Random(3)
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    rows = [(i, f"text {number(2)} please dial our hotline +1{number(9)} today or tomorrow") for i in range(20)]
    rows += [(20, "now dial our hotline 5551234567 today"), (21, "the order 5557654321 came"), (22, None)]
    out = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[20][1].index("5551234567")
    assert out[20]["spans"] == f"phone:{at}:{at + 10}" and out[20]["n_phone"] == 0 and out[20]["n_found"] == 1
    assert out[21]["spans"] == "" and out[22]["spans"] == ""
    assert all(out[i]["n_phone"] == 1 and out[i]["n_found"] == 0 for i in range(20))


def test_language_edges_and_held_out(spark, sf_dir):
    out = language.language_labels(frame(spark)).collect()
    assert len(out) == len(edge_documents())
    assert all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (4, 5, 6, 7))
    assert by_id[8]["lang_pred"] in ("en", "de")
    assert language.language_labels(frame(spark, [])).count() == 0
    unlabelled = frame(spark, [(i, t, None, *rest) for i, t, _, *rest in edge_documents()])
    assert {r["lang_pred"] for r in language.language_labels(unlabelled).collect()} == {"und"}

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    joined = language.language_labels(docs).where("held_out").join(docs, "doc_id").collect()
    assert joined and sum(r["lang"] == r["lang_pred"] for r in joined) / len(joined) >= 0.98


def test_language_score_does_not_depend_on_batches(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", 1, *[0.1, 1, True, 1, 1, 1, 1]) for i, t in enumerate(["the cat sat", "der Hund lief", "a house", "ein Haus"] * 5)]
    one = sorted(map(tuple, language.language_labels(frame(spark, rows).coalesce(1)).collect()))
    many = sorted(map(tuple, language.language_labels(frame(spark, rows).repartition(7)).collect()))
    assert one == many


def plain_licenses(text, known=licenses.TEMPLATES):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = defaultdict(list)
    for label, phrase in licenses.PHRASES.items():
        p = phrase.split()
        places[label] = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
    starts = sorted(s for v in places.values() for s in v)
    labels = {k for k, v in places.items() if v}
    score = 0.0
    for label, templates in known.items():
        for t in templates:
            need = set(t.split())
            stride = licenses.stride_of(len(t.split()))
            for i in range(0, max(len(ws) - stride - 1, 0) + 1, stride):
                share = len(need & set(ws[i : i + 2 * stride]))
                if 100 * share >= licenses.THRESHOLD * len(need):
                    labels.add(label)
                    score = max(score, share / len(need))
    base = sorted(k for k, v in places.items() if v)
    return (len(ws), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(base), ",".join(sorted(labels)), 1.0 if starts else score)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = sorted({w for ts in licenses.TEMPLATES.values() for t in ts for w in t.split()}) + list(licenses.PHRASES.values()) + ["Foo", "bär", "K9"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(70)))) for i in range(150)]
    rows += [(200, "CC BY-NC BY-NC, under the MIT License under the mit license!"), (201, None), (202, ""), (203, "cc by nc " * 50), (None, "Apache License, Version 2.0"), (204, "under the MIT"), (204, "under the MIT")]
    rows += [(300 + i, t.upper() + " İ tail") for i, t in enumerate(t for ts in licenses.TEMPLATES.values() for t in ts)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter((i, *plain_licenses(t)) for i, t in rows)
    assert len(licenses.scan_licenses(frame(spark)).collect()) == len(edge_documents())
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_long_templates_are_found_at_every_offset(spark):
    """Templates of 36 and 500 words, with a fifth of their words replaced, wherever they begin."""
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(400)]
    long = {"x": [" ".join(rng.sample(pool, 36))], "y": [" ".join(rng.choice(pool) for _ in range(500))], **licenses.TEMPLATES}
    rows = []
    for label in "xy":
        template = long[label][0].split()
        need = len(set(template)) - len(set(template)) // 5
        for offset in [*range(0, 40), 63, 64, 65, 511, 1023, 1500]:
            gone = set(rng.sample(sorted(set(template)), len(set(template)) - need))
            passage = ["other" if w in gone else w for w in template]
            rows.append((len(rows), " ".join(["a"] * offset + passage + ["b"] * rng.randrange(1200))))
    planted = len(rows)
    rows += [(planted + i, " ".join(rng.choice(pool) for _ in range(rng.randrange(700)))) for i in range(30)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=long).collect()
    assert Counter(map(tuple, got)) == Counter((i, *plain_licenses(t, long)) for i, t in rows)
    found = {r.doc_id: r.labels.split(",") for r in got}
    assert all(("x" if i < planted // 2 else "y") in found[i] for i in range(planted))
    assert licenses.scan_licenses(spark.createDataFrame(rows[:1], "doc_id long, text string"), templates={}).first().labels == ""


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i))
    out = []
    for i, t, *_ in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[bare])[2]
        out.append((i, keep, len(groups[bare]), keep == i, hashlib.sha256(bare.encode()).hexdigest()))
    return out


def test_exact_groups_equal_brute_force(spark):
    rng = random.Random(1)
    rows = edge_documents() + [(100 + i, rng.choice(["a b", "ab", "a  b", "c", " ", "é"]), None, None, None, *[None] * 7) for i in range(60)]
    for runs, fan_in in ((64, 8), (5, 2), (1, 2)):
        got = exact.exact_groups(frame(spark, rows), runs=runs, fan_in=fan_in).drop("text_key").collect()
        assert Counter(map(tuple, got)) == Counter(plain_groups(rows))
    assert exact.exact_groups(frame(spark, [])).count() == 0


def test_exact_stage_keeps_one_whole_row(spark):
    left = exact.drop_exact_copies(frame(spark))
    assert left.columns == frame(spark).columns
    rows = [tuple(r) for r in left.collect()]
    assert sorted(r[0] for r in rows if r[0] is not None) == [2, 3, 6, 7, 8, 9, 10, 12, 13, 14]
    assert [r[1] for r in rows if r[0] is None] == ["no id here at all"]
    assert set(rows) <= set(edge_documents())


def test_language_stage(spark):
    left = language.keep_identified(frame(spark))
    assert left.columns == frame(spark).columns
    rows = [tuple(r) for r in left.collect()]
    assert set(rows) <= set(edge_documents())
    assert not {4, 5, 6, 7} & {r[0] for r in rows} and {1, 2, 3, 8} <= {r[0] for r in rows}
