"""Runs of repeated words against a brute-force search."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import periodic_runs as pr


def brute_runs(w):
    """All maximal stretches by period, then only those whose smallest period it is."""
    n, found = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            start, length = i, j + p - i
            x = w[start : start + length]
            smaller = any(all(x[k] == x[k + q] for k in range(length - q)) for q in range(1, p))
            if length >= max(6, 4 * p) and not smaller:
                found.append((start, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, plant):
    words = (text or "").replace("\x0b", " ").replace("\x0c", " ").translate({9: " ", 10: " ", 13: " "}).split(" ")
    w = [x for x in words if x]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) & 0xFFFFFFFF
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, = (g % n,)
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = None
    for s, length, p in runs:
        if best is None or length * best[2] > best[1] * p:
            best = (s, length, p)
    return (
        doc_id,
        len(runs),
        *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_random_words(letters):
    rng = random.Random(letters)
    for _ in range(150):
        w = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):  # repeat a stretch
            if w:
                a, p = rng.randrange(len(w)), rng.randrange(1, 9)
                w[a:a] = (w[a : a + p] * rng.randrange(1, 9))[: rng.randrange(1, 50)]
        assert pr.find_runs(np.array(w, np.int32)) == brute_runs(w), w


def test_nested_periods_and_ties():
    for text in ("ab" * 8 + "c", ("aab" * 4 + "c") * 5, "aaaaaab" * 6, "a" * 5, "a" * 6, "abcabcabcab", "abcabcabcabc" + "x" + "abab" * 2):
        w = [ord(c) for c in text]
        assert pr.find_runs(np.array(w)) == brute_runs(w), text
    # equal exponents: the smallest start, then the smallest period
    assert pr.strongest([(9, 12, 3), (2, 8, 2), (2, 4, 1)]) == (2, 4, 1)
    assert pr.strongest([(0, 9, 2), (1, 13, 3)]) == (0, 9, 2)


def test_chunks_do_not_matter(monkeypatch):
    rng = random.Random(5)
    w = [rng.randrange(50) for _ in range(700)]
    w[100:420] = (w[100:140] * 8)[:320]
    w[500:600] = [7] * 100
    whole = pr.find_runs(np.array(w, np.int32))
    assert whole == brute_runs(w)
    monkeypatch.setattr(pr, "_CELLS", 64)
    monkeypatch.setattr(pr, "_CHUNK", (2, 4))
    monkeypatch.setattr(pr, "_PIECE", 7)
    assert pr.find_runs(np.array(w, np.int32)) == whole
    text = " ".join(f"w{x}" for x in w).encode()
    ids, words = pr.word_numbers(text)
    assert [words[i] for i in ids] == text.split()
    assert b"".join(pr._joined(ids, words, np.ones(len(ids), bool))) == text


def test_long_texts_take_near_linear_time():
    start = time.time()
    assert pr.find_runs(np.zeros(1_000_000, np.int32)) == [(0, 1_000_000, 1)]
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2, 200_000).astype(np.int32)
    assert len(pr.find_runs(w)) > 1000
    period = rng.integers(0, 1000, 30_000).astype(np.int32)
    assert pr.find_runs(np.tile(period, 20)) == [(0, 600_000, 30_000)]
    assert len(pr.word_numbers(b"x" * 5_000_000)[0]) == 1
    assert time.time() - start < 60


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in pr.run_digests(docs, plant=True).collect()}
    assert len(got) == len(rows)
    assert sum(r[1] for r in got.values()) > 5
    for r in rows:
        assert got[r.doc_id] == brute(r.doc_id, r.text, True)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = [tuple(r) for r in pr.run_digests(odd_docs, plant=True).collect()]
    plain = [brute(r.doc_id, r.text, True) for r in rows if r.doc_id != 6]
    assert sorted(map(str, (x for x in got if x[0] != 6))) == sorted(map(str, plain))
    assert [x[1:6] for x in got if x[0] == 6] == [(1, 0, 40_000, 1, 40_000_000)]
    assert [tuple(r) for r in pr.runs(odd_docs).collect()] == [(6, 0, 40_000, 1)]
    out = pr.collapse(odd_docs)
    assert out.columns == odd_docs.columns
    texts = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
    assert texts == {(r.doc_id, "word" if r.doc_id == 6 else r.text) for r in rows}
    assert out.count() == odd_docs.count()
    for empty in (pr.run_digests(no_docs), pr.runs(no_docs), pr.collapse(no_docs)):
        assert empty.count() == 0


def test_text_column_of_another_name(spark):
    df = spark.createDataFrame([(1, "go go go go go go stop")], "k int, body string")
    assert pr.collapse(df, "body").first().body == "go stop"
    assert tuple(pr.runs(df, "k", "body").first()) == (1, 0, 6, 1)
    assert pr.run_digests(df.withColumn("doc_id", F.lit("clash")), id_col="k", text_col="body").first().n_runs == 1
