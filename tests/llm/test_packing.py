import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from signalloom.llm import packing_dp as p


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens_are_the_librarys(exact):
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "é", "ß", "1", ".", "!", "'s", "'", "\t", "_", "\r", "\xa0", "日", "x y", "-", "<|endoftext|>", "²", "\x00", "ǅ"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert p.encoder().encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)


def test_plan_against_all_cuts():
    rng = random.Random(2)
    for _ in range(150):
        positions = [0, *itertools.accumulate(rng.randint(1, 60) for _ in range(rng.randint(1, 9)))]
        penalties = [0.0] + [rng.choice([0.0, 1.0, 24.0]) for _ in positions[1:]]

        def cost(cuts, positions=positions, penalties=penalties):
            edges = [0, *cuts]
            if any(b - a > 128 for a, b in zip(edges, edges[1:])):
                return float("inf")
            # powers of two below 64 are padded, as the plan counts them
            pad = lambda n: 128 - n if n < 64 else p.padding(n, 128)
            return sum(pad(b - a) + p.PER_SEQUENCE for a, b in zip(edges, edges[1:])) + sum(penalties[positions.index(c)] for c in cuts)

        inner = positions[1:-1]
        best = min(cost([*c, positions[-1]]) for k in range(len(inner) + 1) for c in itertools.combinations(inner, k))
        assert cost(p.plan(positions, penalties, 128)) == pytest.approx(best)


def check(pieces, texts, exact, capacity):
    ids = {d: exact.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length > 0 and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(texts)
    for d, rows in by_doc.items():
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == [0, *itertools.accumulate(r.length for r in rows)][:-1] and sum(r.length for r in rows) == len(ids[d])
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *itertools.accumulate(r.length for r in rows)][:-1] and sum(r.length for r in rows) <= capacity
    return [sum(r.length for r in rows) for rows in by_sequence.values()]


def test_documents(spark, sf_dir, exact):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    lengths = check(p.pack(docs).collect(), texts, exact, 2048)
    assert sum(map(p.padding, lengths)) < 0.02 * sum(lengths)


def test_order_is_kept(spark):
    docs = spark.createDataFrame([(i, f"Sentence {i}. " * (i % 7)) for i in range(300)], "doc_id long, text string").coalesce(1)
    rows = sorted(p.pack(docs, capacity=128).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert [k for k, _ in itertools.groupby(r.doc_id for r in rows)] == list(range(300))


def test_odd_rows(spark, no_docs, exact):
    texts = {1: None, 2: "", 3: "word " * 40_000, 4: "x" * 30_000, 5: "日本 " * 3000, None: "no id"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS offset")
    check(p.pack(docs).collect(), texts, exact, 2048)
    assert p.pack(no_docs).count() == 0
    with_ids = p.pack(docs, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in with_ids)
    with pytest.raises(ValueError):
        p.pack(docs, capacity=10)


def test_small_blocks(monkeypatch, exact):
    monkeypatch.setattr(p, "BLOCK_TOKENS", 500)
    stream, got = p._Stream(128), []
    rng, total = random.Random(3), 0
    for d in range(40):
        ids = np.arange(rng.randint(0, 400), dtype="<u4")
        stream.add(d, ids, np.array([i for i in range(1, len(ids)) if i % 37 == 0], np.int64))
        total += len(ids) + 1
        if stream.tokens >= 500:
            got += list(stream.sequences(False))
    got += list(stream.sequences(True))
    assert sum(len(x[3]) for s in got for x in s) == total and all(sum(len(x[3]) for x in s) <= 128 for s in got)


def test_both_libraries_agree_on_every_character():
    """The splitting pattern knows classes of characters only, so each is tried in every kind of place."""
    e = p.encoder()
    points = [c for c in range(p.COMPARED) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)} {chr(c)}{chr(c)}x{chr(c)}1 '{chr(c)}s \n{chr(c)}\t{chr(c)}. {chr(c)}'s" for c in points]
    for i in range(0, len(texts), 20_000):
        slow = e.exact.encode_batch(texts[i : i + 20_000], add_special_tokens=False)
        assert e.fast.encode_ordinary_batch(texts[i : i + 20_000]) == [x.ids for x in slow]
    rng = random.Random(12)
    pools = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x500), (0x590, 0x700), (0x900, 0xA00), (0x2000, 0x2070), (0x3040, 0x3100), (0x4E00, 0x5000), (0xAC00, 0xAD00), (0x1F300, 0x1F700)]
    mixed = ["".join(chr(rng.randrange(*rng.choice(pools))) if rng.random() < 0.8 else rng.choice([" ", "  ", "\n", "'s", "'ll", "1", ".", "\r\n"]) for _ in range(rng.randint(1, 60))) for _ in range(20_000)]
    assert [e.encode(t).tolist() for t in mixed] == [x.ids for x in e.exact.encode_batch(mixed, add_special_tokens=False)]
    for t in ("a<|endoftext|>b", "\U00030000 x", ""):
        assert e.encode(t).tolist() == e.exact.encode(t, add_special_tokens=False).ids
