"""Divergences of sources against DuckDB and against loops."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from signalloom.llm import source_divergence as sd

from ..compare import connect, duck_rows, spark_rows


def brute(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def smooth(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        of = {s: smooth(counts[lang, s]) for x, s in groups if x == lang}
        whole = smooth(sum((counts[lang, s] for s in of), Counter()))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in of.items():
            pairs = [(o, sum(f(p[t], of[o][t]) for t in kept)) for o in of if o != s]
            own = [(t, f(p[t], whole[t])) for t in kept if counts[lang, s][t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def result(df):
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(tuple(r) for r in df.collect())


def test_query_against_sql(spark, sf_dir):
    name = "op13_source_divergence"
    assert spark_rows(sd.QUERIES[name](spark, sf_dir)) == duck_rows(connect(sf_dir), sd.ORACLE_SQL[name])


@pytest.mark.parametrize("piece, cell", [(1 << 21, 1 << 14), (40, 16)])
def test_against_loops(spark, monkeypatch, piece, cell):
    monkeypatch.setattr(sd, "_PIECE", piece)
    monkeypatch.setattr(sd, "CELL_ENTRIES", cell)
    rng = random.Random(3)
    words = ["Alpha", "beta", "ÉTÉ", "été", "日本語", "x1y", "don't", "Zeta", "a", "ALPHA", "β", "n" * 90]
    rows = []
    for i in range(240):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None, "é"])
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "-", "9", "", "\x00", "_"]) for _ in range(rng.randrange(30)))
        rows.append((lang, source, rng.choice([text, text, text, None])))
    rows += [("xx", "only", "seldom words here"), ("xx", "other", "1 2 3"), ("yy", "alone", "hm")] + [("en", "copies", "Same same SAME")] * 30
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert result(sd.divergences(df)) == brute(rows)
    assert result(sd.divergences(df, least_docs=1, top=2)) == brute(rows, 1, 2)


def test_terms_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(sd.xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    text = b"aa bb cc aa b a bb bb aaaa \xc3\xa9 \xc3\xa9"
    buf = np.frombuffer(text, np.uint8)
    starts, ends = sd._slices(buf, np.array([0]))
    number, terms = sd._groups(buf, starts, ends)
    assert [terms[k] for k in number] == text.split()
    _, _, n, docs, terms = sd._piece_counts([text, b"aa", b"bb aa"], [0, 1, 0])
    assert n.sum() == len(text.split()) + 3


def test_terms_do_not_cross_documents():
    owner, term, n, docs, terms = sd._piece_counts([b"ab", b"cd", b"", b"9", b"ab"], [0, 0, 0, 0, 1])
    assert sorted((o, terms[t], c, d) for o, t, c, d in zip(owner, term, n, docs)) == [(0, b"ab", 1, 1), (0, b"cd", 1, 1), (1, b"ab", 1, 1)]


def test_cells_against_all_terms():
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((5, 40)) < 0.3, rng.integers(1, 10**9, (5, 40)), 0)
    dense[0, dense.sum(axis=0) == 0] = 5
    dense[3] = 0  # a source without terms
    absent = rng.integers(1, 1000, 5)
    source, term = np.nonzero(dense)
    full = np.where(dense > 0, dense, absent[:, None])
    want = [[sd._distance(full[a], full[b]).sum() for b in range(5)] for a in range(5)]
    assert sd.cell_distances(source, term, dense[source, term], absent).tolist() == np.array(want).tolist()


def test_counts_beyond_a_long(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**17, 3 * 10**17, 5)], "n long, total long, v long")
    assert df.select(sd._smoothed(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (10**17 + 2) // (3 * 10**17 + 10)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.select("lang", "source", "text").collect()]
    assert result(sd.divergences(odd_docs)) == brute(rows)
    assert result(sd.divergences(odd_docs, least_docs=1)) == brute(rows, 1)
    assert sd.divergences(no_docs).count() == 0
    assert sd.term_counts(no_docs).count() == 0


def test_a_long_text(spark):
    big = ("word" * 10 + " ") * 150_000
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "source": ["s"], "text": [big]})
    rows = [x for b in sd._count_batches(iter([batch])) for x in b.to_pylist()]
    assert [(r["term"], r["n"], r["docs"]) for r in rows] == [("", 0, 0), ("word" * 10, 150_000, 1)]
