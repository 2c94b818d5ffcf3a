"""Merkle manifest, whitening and secret scans against plain Python."""

import base64
import hashlib
import json
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from edge_rows import edge_documents, frame  # noqa: E402

from postledger.llm import merkle, secrets, whitening  # noqa: E402


# ---- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((run[: at % 8], run[at % 8 + 1 :]))
        at //= 8
    return out


def plain_manifest(rows):
    """Rows of doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append(plain_tree([plain_leaf(r) for r in groups[g]]))
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for k, (g, tree) in enumerate(zip(order, trees)):
        for at, r in enumerate(groups[g]):
            path = plain_path(tree, at) + plain_path(top, k)
            node = tree[0][at]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = r[4] and re.sub("[A-Z]", lambda m: m[0].lower(), r[4])
                node = plain_leaf((*r[:4], text))
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            proof = sha("".join("".join(a + b) for a, b in path))
            out.append((r[0], tree[0][at], tree[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return Counter(out)


def found_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree long, node string, pos long")
    out = merkle.merkle_manifest(docs).collect()
    assert all((r["copied"] is None) or r["copied"][-1] == r["folded_root"] for r in out)
    return Counter(tuple(r)[:-1] for r in out)


def manifest_rows(n, langs, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", None]), rng.choice(langs), rng.choice([None, i]), rng.choice(["Text Ä " + str(i), "low", "", None])) for i in rng.sample(range(10 * n), n)]


def test_manifest_equals_plain_trees(spark):
    rows = manifest_rows(700, ["en", "en", "en", "de", "Ж", "", None])
    rows += rows[:3] + [(rows[0][0], "s", rows[0][2], 5, "Other text of one id"), (None, None, None, None, None), (4, "s", "xx", 1, "Lone"), (9, "s", "en", 1, "LONG Word " * 200_000)]
    assert found_manifest(spark, rows) == plain_manifest(rows)


def test_manifest_of_many_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", merkle.FAN)
    rows = manifest_rows(600, ["en"] * 60 + [f"l{i}" for i in range(70)] + [None])
    assert found_manifest(spark, rows) == plain_manifest(rows)


def test_manifest_edges(spark):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in edge_documents()]
    assert found_manifest(spark, rows) == plain_manifest(rows)
    for few in (rows[:1], [(None,) * 5] * 3, []):
        assert found_manifest(spark, few) == plain_manifest(few)


def test_versions_copy_paths_only():
    leaves = [sha(str(i)) for i in range(100)]
    levels = merkle.block_levels(leaves, 100)
    before = [list(level) for level in levels]
    nodes = merkle.copied_path(merkle.siblings(levels, 77), sha("changed"))
    assert levels == before  # the base tree stays as it was
    own = plain_tree([*leaves[:77], sha("changed"), *leaves[78:]])
    assert nodes == [level[77 // 8**k] for k, level in enumerate(own)]
    differ = [(k, i) for k, level in enumerate(own) for i, node in enumerate(level) if node != levels[k][i]]
    assert differ == [(k, 77 // 8**k) for k in range(len(own))]


# ---- Whitening


def plain_whitening(vectors, k=8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=np.int64)
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return deviation, centred @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check_whitening(out, vectors, k):
    """``vectors`` by id; each id once."""
    ids = sorted(vectors)
    deviation, w, explained = plain_whitening([vectors[i] for i in ids], k)
    got = {(r["vec_id"], r["component"]): r for r in out}
    assert len(got) == len(out) == len(ids) * k
    for c in range(1, k + 1):
        mine = np.array([got[i, c]["whitened"] for i in ids])
        theirs = w[:, c - 1] * np.sign(mine @ w[:, c - 1])
        assert np.abs(mine - theirs).max() < 1e-7
        assert abs(got[ids[0], c]["explained"] / explained[c - 1] - 1) < 1e-9
    assert [got[i, 1]["deviation"] for i in ids] == deviation
    assert {r["n"] for r in out} == {len(ids)}
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-8


def test_whitening_equals_plain(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in rows.collect()}
    check_whitening(whitening.whiten(rows).collect(), vectors, 8)


VECTORS = "vec_id long, embedding array<double>, n long, w int, v string, component int, whitened double"


def test_whitening_leaves_out_broken_vectors(spark):
    rng = np.random.default_rng(1)
    good = {i: (rng.standard_normal(5) * [9, 5, 3, 2, 1]).tolist() for i in range(50)}
    bad = [(100, None), (101, []), (102, [1.0, None, 0, 0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0, 0, 0, 0.0]), (105, [float("-inf"), 0, 0, 0, 0.0])]
    frame = lambda rows: spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], 1, 2, "v", 3, 4.0) for i, v in rows], VECTORS)
    check_whitening(whitening.whiten(frame([*good.items(), *bad])).collect(), good, 5)
    assert whitening.whiten(frame(bad)).count() == whitening.whiten(frame([])).count() == 0

    # Repeated rows and NULL ids count as often as they come.
    out = whitening.whiten(frame([*good.items(), *good.items(), (None, good[3]), (None, good[3])])).collect()
    assert len(out) == 102 * 5 and {r["n"] for r in out} == {102}
    assert out[0]["identity_error"] < 1e-8

    equal = whitening.whiten(frame([(i, [1.0, 2.0]) for i in range(9)])).collect()
    assert len(equal) == 18
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in equal} == {(0.0, 0.0, 0.0, 0)}
    line = whitening.whiten(frame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()
    assert {r["whitened"] for r in line if r["component"] > 1} == {0.0} and line[0]["identity_error"] < 1e-8
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(frame([(1, [1.0]), (2, [1.0, 2.0])]))


@pytest.mark.parametrize("n, k", [(1, 1), (2, 2), (7, 3), (64, 8), (64, 64), (150, 8)])
def test_components_equal_a_plain_eigensolver(n, k):
    rng = np.random.default_rng(n * k)
    basis = np.linalg.qr(rng.standard_normal((n, n)))[0]
    for spectrum in (rng.uniform(1, 2, n), 2.0 ** -np.arange(n), 1 + 1e-9 * rng.uniform(size=n), np.repeat([4.0, 3.0, 1.0], n)[: 3 * n : 3], np.ones(n), np.zeros(n)):
        v = (basis * spectrum) @ basis.T
        v = (v + v.T) / 2
        values, vectors = whitening.leading_components(v, k)
        size = max(np.linalg.norm(v), 1e-300)
        assert vectors.shape == (n, k)
        assert np.abs(values - np.sort(spectrum)[::-1][:k]).max() <= 1e-13 * max(size, 1)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
        assert np.linalg.norm(v @ vectors - vectors * values) <= 1e-13 * size * n


def test_deviations_are_exact_or_null():
    x = np.array([[1 << 40, 0], [0, 1]])
    total = x.sum(axis=0)
    assert whitening.squared_deviations(x, 2, total) == [None, None]
    x = np.array([[100_000, 3], [99_000, 4]])
    assert whitening.squared_deviations(x, 2, x.sum(axis=0)) == [1_000_001, 1_000_001]


# ---- Secrets

PLAIN = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"AKIA[A-Z0-9]+", 18),
    ("hex", r"[0-9a-f]+", 16),
]


def plain_base(text):
    spans = []
    for k, (_, pattern, least) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(m.lastindex or 0)) >= least:
                spans.append((m.start(), k, m.end()))
    return sorted(spans)


def test_base_spans_equal_plain_search():
    rng = random.Random(7)
    pieces = ["password", "PassWd", "secret", "ſecret", "toKen", "toKen", "api_key", "apikey", "'", '"', " ", "  ", ":", "=", "abcdef", "0123456789", "AKIA", "AKIAAKIA", "ABCDEFGHIJ", "Z9", "é", "\t", ".", "-", "/+", "deadbeefdeadbeef"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(16)))
        assert secrets.base_spans(text) == plain_base(text), text


def test_scans_are_linear():
    for text in ("password" * 50_000, "password" + " " * 500_000, "a" * 500_000, "AKIA" * 100_000, "M" * 500_000, "eyJ." * 100_000, "-----BEGIN PRIVATE KEY-----" * 20_000, "30" * 200_000, "e" * 500_000, "token=" * 80_000):
        secrets.base_spans(text)
        list(secrets.candidates(text))


def tlv(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 | 2]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def der_keys(rng):
    number = lambda n: tlv(2, b"\x41" + rng.randbytes(n - 1))
    rsa = tlv(0x30, tlv(2, b"\0"), number(128), tlv(2, b"\1\0\1"), number(128), *[number(64) for _ in range(5)])
    dsa = tlv(0x30, tlv(2, b"\0"), number(128), number(20), number(128), number(128), number(20))
    curve = tlv(0x30, tlv(2, b"\1"), tlv(4, rng.randbytes(32)), tlv(0xA0, tlv(6, b"\x2a\x86\x48\xce\x3d")))
    kind = tlv(0x30, tlv(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), tlv(5))
    return {"rsa": rsa, "dsa": dsa, "curve": curve, "wrapped": tlv(0x30, tlv(2, b"\0"), kind, tlv(4, rsa)), "encrypted": tlv(0x30, kind, tlv(4, rng.randbytes(64)))}


def openssh_key(rng):
    field = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(rng.randbytes(51)) + field(rng.randbytes(136))


def signed(alg, signature, claims={"sub": "1"}):
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return ".".join(part(x) for x in (json.dumps({"alg": alg, "typ": "JWT"}).encode(), json.dumps(claims).encode(), signature))


def armoured(data, name="RSA PRIVATE KEY", end="\n"):
    body = base64.b64encode(data).decode()
    return f"-----BEGIN {name}-----{end}" + end.join(body[i : i + 64] for i in range(0, len(body), 64)) + f"{end}-----END {name}-----"


def secret_texts():
    """Texts with the kinds and tokens that must be confirmed, none where there is nothing."""
    rng = random.Random(4)
    keys = der_keys(rng)
    good = []
    for data in (*keys.values(), openssh_key(rng)):
        good += [("private_key", armoured(data)), ("private_key", armoured(data, "PRIVATE KEY", "\\n")), ("private_key", base64.b64encode(data).decode()), ("private_key", base64.urlsafe_b64encode(data).decode().rstrip("=")), ("private_key", data.hex()), ("private_key", data.hex().upper())]
    good += [("signed_token", signed(alg, rng.randbytes(n))) for alg, n in (("HS256", 32), ("RS256", 256), ("ES512", 132))]
    rsa = keys["rsa"]
    bad = [
        base64.b64encode(rsa[:-1]).decode(),  # shorter than its length says
        base64.b64encode(rsa + b"\0").decode(),
        base64.b64encode(rsa[:9] + bytes([rsa[9] ^ 64]) + rsa[10:]).decode(),  # an inner length that does not fit
        base64.b64encode(tlv(0x30, tlv(2, b"\0"), tlv(4, b"x" * 90))).decode(),
        base64.b64encode(tlv(0x30, tlv(0x30, tlv(2, b"\1")), tlv(3, rng.randbytes(90)))).decode(),  # like a public key
        base64.b64encode(openssh_key(rng)[:-1]).decode(),
        "M" + base64.b64encode(rng.randbytes(90)).decode()[1:],
        "30" + rng.randbytes(60).hex(),
        signed("HS256", rng.randbytes(31)), signed("none", b""), signed("XX", rng.randbytes(32)), signed("HS256", rng.randbytes(32), [1]),
        "e30.e30.AAAA", "eyJ.eyJ.eyJ", "example.com.org", armoured(b"plain text that is no key at all", "PRIVATE KEY"),
    ]
    return good, bad


def test_structures_are_confirmed(spark):
    good, bad = secret_texts()
    rows, expected = [], {}
    for i, (kind, token) in enumerate(good):
        text = f"é𝔘 before {token} after, again: {token}."
        at = [m.start() for m in re.finditer(re.escape(token), text)]
        rows.append((i, text))
        expected[i] = [(a, a + len(token)) for a in at], kind
    rows += [(1000 + i, f"x {token} y") for i, token in enumerate(bad)]
    out = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (spans, kind) in expected.items():
        found = [s.split(":") for s in out[i]["spans"].split(",")]
        assert [(int(a), int(b)) for k, a, b in found if k == kind] == spans, rows[i]
        assert out[i]["n_confirmed"] == 2
    assert [rows[len(good) + i - 1000] for i, r in out.items() if i >= 1000 and r["n_confirmed"]] == []
    for i, text in rows:
        check_secret_row(out[i], text)


def check_secret_row(r, text):
    base = plain_base(text)
    listed = ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in base)
    assert r["base_sha256"] == sha(listed)
    assert [r[f"n_{name}"] for name, _, _ in PLAIN] == [sum(k == i for _, k, _ in base) for i in range(3)]
    spans = [s.split(":") for s in r["spans"].split(",")] if r["spans"] else []
    assert ",".join(":".join(s) for s in spans if s[0] in [name for name, _, _ in PLAIN]) == listed
    order = [(int(a), secrets.KINDS.index(k), int(b)) for k, a, b in spans]
    assert order == sorted(order) and len(order) == len(base) + r["n_confirmed"]


def test_secrets_in_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = secrets.find_secrets(docs).collect()
    assert len(out) == len(texts) and sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in out) > 0
    for r in out:
        check_secret_row(r, texts[r["doc_id"]])


def test_secret_edges(spark):
    out = secrets.find_secrets(frame(spark)).collect()
    assert len(out) == len(edge_documents())
    assert all(r["spans"] == "" and r["base_sha256"] == sha("") and r["n_confirmed"] == 0 for r in out if r["doc_id"] is None)
    assert secrets.find_secrets(frame(spark, [])).count() == 0
    key = armoured(der_keys(random.Random(1))["rsa"])
    long = "Plain words here. " * 120_000 + key
    extra = [(i, text, "en", "s", 1, 0.5, 7, True, 1, 2, 3, 4) for i, text in [(1, key), (1, key), (1, "other"), (None, key), (2, long)]]
    out = secrets.find_secrets(frame(spark, extra)).collect()
    assert sorted((str(r["doc_id"]), r["n_confirmed"]) for r in out) == [("1", 0), ("1", 1), ("1", 1), ("2", 1), ("None", 1)]
    assert next(r for r in out if r["doc_id"] == 2)["spans"].split(",")[-1] == f"private_key:{len(long) - len(key)}:{len(long)}"
