"""Mixing, packing, chat formatting and the whole pipeline."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from edge_rows import edge_documents, frame  # noqa: E402

from postledger.llm import chat, mixing, packing  # noqa: E402
from postledger.llm.queries import CONTROL_TEXT, op10_chat_format, vocabulary  # noqa: E402


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        if not free:
            return {s: 3.0 * sizes[s] for s in order}
        above = {s for s in order if s not in capped and rest * weight[s] > 3 * sizes[s] * free}
        if not above:
            return {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        capped |= above


def check_mix(rows, out):
    sizes = Counter()
    for i, t, _, s, *_ in rows:
        sizes[s] += len((t or "").split())
    targets, taken, longest = plain_targets(sizes), Counter(), Counter()
    by_id = {i: s for i, _, _, s, *_ in rows}
    for r in out:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    assert all(abs(taken[s] - targets[s]) <= 2 * longest[s] + 1 for s in sizes)


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), None, rng.choice(["a", "B", "é", "z", "", None] + ["hot"] * 6), 1, *[None] * 7) for i in range(600)]
    one = mixing.mix_sources(frame(spark, rows)).collect()
    check_mix(rows, one)
    again = mixing.mix_sources(frame(spark, rows).repartition(9)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, again))
    assert sorted(map(tuple, one)) != sorted(map(tuple, mixing.mix_sources(frame(spark, rows), seed=18).collect()))


def test_mix_edges(spark):
    assert len(mixing.mix_sources(frame(spark)).collect()) == len(edge_documents())
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    blank = [(i, None, None, None, None, *[None] * 7) for i in range(3)]
    assert [r["taken"] for r in mixing.mix_sources(frame(spark, blank)).collect()] == [0, 0, 0]
    taken = mixing.take_mix(frame(spark))
    assert taken.columns == frame(spark).columns
    expected = Counter()
    for r in mixing.mix_sources(frame(spark)).collect():
        expected[(r["doc_id"], r["text_key"])] += r["copies"]
    assert sum(expected.values()) == taken.count()
    assert set(map(tuple, taken.collect())) <= set(edge_documents())
    assert Counter(r["doc_id"] for r in taken.collect()) == Counter({i: n for i, n in _by_id(expected).items() if n})


def _by_id(copies):
    out = Counter()
    for (i, _), n in copies.items():
        out[i] += n
    return out


def token_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [coder.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_ids_are_those_of_the_dealt_tokenizer():
    rng = random.Random(11)
    pieces = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "'s", "'LL", "word", "Ünï", "日本", "𝔘", "123", "½", "_", "--", "\x00", "\u200d", "é", "...", "\r\n", "\U0001f600"]
    texts = ["<|endoftext|> x", "", "<|endoftext|>" * 3, " <|endoftext|>", "x" * 3000, " " * 3000, "ab " * 200_000]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x300), rng.randrange(0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(30))) for _ in range(3000)]
    coder = packing.text_coder(vocabulary())
    assert coder("<|endoftext|> x") == [50256, 2124]
    for text, expected in zip(texts, token_ids(texts)):
        assert [*coder(text), 0] == expected, text[:100]


def check_packing(rows, out):
    ids = token_ids([t for _, t in rows])
    pieces = Counter()
    for (i, _), x in zip(rows, ids):
        first = (len(x) - 1) % 2048 + 1
        cuts = [0, *range(first, len(x) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces[(i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == pieces
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), sum(map(len, ids))


def test_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for group in (8192, 40):
        out = packing.pack_documents(docs, vocabulary(), group_pieces=group).collect()
        n, total = check_packing([tuple(r) for r in docs.collect()], out)
        assert n <= -(-total // 2048) * 1.02 + 1
    rows = [r[:2] for r in edge_documents()] + [(50, "a  b \n c <|endoftext|> 's  "), (51, " " * 3000), (52, "x" * 9000)]
    out = packing.pack_documents(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, piece long, length long"), vocabulary()).collect()
    check_packing(rows, out)
    assert packing.pack_documents(frame(spark, []), vocabulary()).count() == 0


def test_swaps_empty_bins():
    # Best fit leaves 5 + 3 and 4 + 4 style gaps; the search must not lose or break anything.
    rng = random.Random(6)
    for _ in range(60):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))]
        bins = [[i] for i in range(len(lengths))]
        squares = sum(n * n for n in lengths)
        better = packing.improve(bins, lengths, 100)
        assert sorted(i for b in better for i in b) == list(range(len(lengths)))
        fills = [sum(lengths[i] for i in b) for b in better]
        assert max(fills) <= 100 and len(better) <= len(lengths) and sum(f * f for f in fills) >= squares
        assert len(better) <= sum(lengths) / 100 * 1.5 + 2


def test_escapes_round_trip(spark):
    texts = ["", "&", "&lt;", "&amp;lb;", "<|turn|>user<|text|>", "<", "[INST]", "a&b<c[d", "</s>[INST] ok [/INST]", "&&lt;<[", CONTROL_TEXT]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    out = out.select("t", "e", chat.unescape(out["e"]).alias("back")).collect()
    assert all(r["t"] == r["back"] and "<" not in r["e"] and "[" not in r["e"] for r in out)


def test_chats_read_back(spark):
    rng = random.Random(7)
    bits = ["<|end|>", "<|and|>", "<|text|>", "<|turn|>", "[INST]", "&lt;", "&", "hello", "é𝔘", "\n", ""]
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "<|x|>", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(5))])))
    rows += [(50, None, "user", "a"), (50, 1, "user", "b"), (50, 1, "user", "b"), (50, 1, "assistant", "c"), (None, 0, "user", "x")]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    formatted = chat.format_chats(data).cache()
    chats = defaultdict(list)
    for c, t, role, text in rows:
        chats[c].append(((t is not None, t or 0), role or "", text or ""))
    expected = {c: [(r, x) for _, r, x in sorted(v)] for c, v in chats.items()}
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_chats(formatted).collect()}
    assert back == expected
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in chat.chat_digests(formatted).collect():
        turns = expected[r["conv_id"]]
        loss = "".join(x for role, x in turns if role == "assistant")
        told = "".join(f"{a}\n{b}\n" for a, b in turns)
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), digest(told), len(loss), digest(loss))
    one = {r["conv_id"]: r["formatted"] for r in formatted.collect()}[50]
    # Adjacent turns of a role share one header.
    assert one == "<|turn|>user<|text|>a<|end|><|turn|>assistant<|text|>c<|end|><|turn|>user<|text|>b<|and|>b<|end|>"
    assert chat.chat_digests(chat.format_chats(data.limit(0))).count() == 0


def test_chat_query_has_the_control_conversation(spark, sf_dir):
    row = op10_chat_format(spark, sf_dir).where("conv_id = -1").first()
    assert row["n_turns"] == 2 and row["loss_chars"] == len(CONTROL_TEXT)
    assert row["loss_sha256"] == hashlib.sha256(CONTROL_TEXT.encode()).hexdigest()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == frame(spark).columns, name
    assert set(map(tuple, docs.collect())) <= set(edge_documents())
    # 1 equals 2 but for white space, 3 and 9 are near copies, 4 to 7 have no letters.
    assert not {1, 3, 4, 5, 6, 7, 9} & {r["doc_id"] for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
    nothing = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, sf_dir)
    assert nothing.count() == 0
