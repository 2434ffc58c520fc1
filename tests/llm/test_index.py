import hashlib
import random
import re

import pytest

from signalloom.llm import positional_index as p

from ..compare import connect, duck_rows, spark_rows

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_FOLD))


def plain(docs, items, window=13):
    wanted = {}
    for k, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(t) for t in wanted}:
            for i in range(len(w) - n + 1):
                if ks := wanted.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ks
        ids = ",".join(sorted(str(k) for k in found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("small_vocabulary", [True, False])
def test_against_brute_force(spark, monkeypatch, small_vocabulary):
    if not small_vocabulary:
        monkeypatch.setattr(p, "VOCABULARY_TERMS", 3)
        monkeypatch.setattr(p, "BROADCAST_BYTES", 0)
    rng = random.Random(4)
    vocabulary = ["a", "b", "C", "é", "É", "x1", "日本"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "_", "\n"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((1, 2, 5, 13, 14, 30, 40, 0))] + [(8, None), (9, text(20))]
    docs = [(i, text(rng.randint(0, 30)) + rng.choice([items[k][1] or "" for k in (3, 4, 5, 6, 9)]) + text(rng.randint(0, 30))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, items[5][1]), (62, text(9)), (63, items[6][1]), (63, items[6][1])]
    assert rows_of(p.contamination(*frames(spark, docs, items))) == plain(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "two three"), (None, "four"), (2, ""), (3, None)], "item_id long, text string")
    got = p.contamination(odd_docs, items)
    assert got.count() == 9
    one = [r for r in got.collect() if r.doc_id == 1][0]
    assert (one.n_words, one.n_hit, one.contaminated) == (5, 3, True)
    assert p.decontaminate(odd_docs, items).count() == 6 and p.decontaminate(odd_docs, items).columns == odd_docs.columns
    assert p.contamination(no_docs, items).count() == 0
    assert p.contamination(odd_docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = [(1, item), (2, item.replace("w5 ", "w5 extra ")), (3, item.replace("w5 ", "other ")), (4, " ".join(reversed(item.split())))]
    docs, items = frames(spark, docs, [(1, item)])
    items = p.item_words(items)
    index = p.build_index(docs)
    found = lambda **k: {r.doc_id for r in p.matches(index, items, **k).collect()}
    assert found() == {1} and found(slop=1) == {1, 2} and found(missing=1) == {1, 3}


def test_query_is_duckdbs(spark, sf_dir):
    db = connect(sf_dir)
    assert spark_rows(p.op4_positional_index(spark, sf_dir)) == duck_rows(db, p.ORACLE_SQL["op4_positional_index"])
