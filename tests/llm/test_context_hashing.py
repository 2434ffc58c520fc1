import hashlib
import random
import re
import zlib

import pytest

from signalloom.llm import context_hashing as c


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 14))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert c.common_subsequence(a, b) == table[-1][-1]


def test_window_hash_sees_seven_bytes():
    rng = random.Random(2)
    a, b = (bytes(rng.choices(range(256), k=200)) for _ in range(2))
    same = b"the same ending"
    assert (c._window_hashes(a + same)[-9:] == c._window_hashes(b + same)[-9:]).all()


def test_likeness():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    text = " ".join(word() for _ in range(600))
    own = c.fingerprint(text)
    assert own == c.fingerprint(text) and c.likeness(own, own) == 1.0
    assert c.likeness(own, c.fingerprint(text[:2000] + "some new words" + text[2000:])) > 0.8
    assert c.likeness(own, c.fingerprint(" ".join(word() for _ in range(600)))) < 0.2
    assert 0.3 < c.likeness(own, c.fingerprint(c.edited(text, " ".join(word() for _ in range(600))))) < 0.9
    assert c.likeness(c.fingerprint(""), own) == 0.0 and c.likeness(c.fingerprint(""), c.fingerprint("")) == 1.0


def plain_fingerprint(text):
    """Byte by byte: a chunk ends where the hash of the last seven bytes leaves block - 1."""
    data, letters = text.encode(), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    if not data:
        return "3::"
    hashes = []
    for i in range(len(data)):
        h = sum((data[i - k] + 1) * pow(0x9E3779B1, k + 1, 2**32) for k in range(min(7, i + 1))) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        hashes.append(h ^ h >> 13)

    def signature(size):
        out, start = "", 0
        for i, h in enumerate(hashes):
            # a boundary of a block is one of every smaller block too
            if all(h % (3 << j) == (3 << j) - 1 for j in range((size // 3).bit_length())) and len(out) < 63:
                out += letters[zlib.crc32(data[start : i + 1]) % 64]
                start = i + 1
        return out + (letters[zlib.crc32(data[start:]) % 64] if start < len(data) else "")

    def boundaries(size):
        return sum(h % size == size - 1 for h in hashes)

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and boundaries(block) < 32:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def plain_likeness(a, b):
    """Best similarity over shared block sizes, by a table of edits without replacement."""
    if a == b:
        return 1.0
    best = 0.0
    (x, *xs), (y, *ys) = a.split(":"), b.split(":")
    for i, s in enumerate(xs):
        for j, t in enumerate(ys):
            if int(x) << i != int(y) << j or not s or not t:
                continue
            s, t = (re.sub(r"(.)\1{3,}", r"\1\1\1", z) for z in (s, t))
            n = min(4, len(s), len(t))
            if not any(s[k : k + n] in t for k in range(len(s) - n + 1)):
                continue
            row = list(range(len(t) + 1))
            for p, u in enumerate(s):
                row, old = [p + 1], row
                for q, v in enumerate(t):
                    row.append(old[q] if u == v else 1 + min(old[q + 1], row[q]))
            best = max(best, 1 - row[-1] / (len(s) + len(t)))
    return best


def test_fingerprints_against_loops(spark, sf_dir):
    rng = random.Random(7)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += ["".join(rng.choices("ab é日.", k=k)) for k in (1, 5, 6, 7, 8, 190, 193, 400, 3000)] + ["a" * 2000, "ab" * 900]
    for text, other in zip(texts, texts[1:]):
        changed = c.edited(text, other)
        for x in (text, changed):
            assert c.fingerprint(x) == plain_fingerprint(x)
        for x, y in ((text, changed), (text, other)):
            assert c.likeness(c.fingerprint(x), c.fingerprint(y)) == pytest.approx(plain_likeness(plain_fingerprint(x), plain_fingerprint(y)))


def test_edits_are_nearer_than_neighbours(spark):
    """On a whole table: half of a text is told from a text of its own."""
    got = c.fingerprints_with_edits(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_chars >= 200")
    apart = got.where("near_edited > near_next").count() / got.count()
    assert apart > 0.9, apart


def test_edit():
    assert c.edited("abcde", "xyz") == "abcxy" and c.edited("abcdef", "x") == "abcx" and c.edited("", "x") == "" and c.edited("a", "") == "a"


def plain(rows):
    out = []
    for i, (d, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        other = c.edited(text, following)
        a, b, n = c.fingerprint(text), c.fingerprint(other), c.fingerprint(following)
        out.append((d, len(text), hashlib.sha256(other.encode()).hexdigest(), a, b, round(c.likeness(a, b), 6), round(c.likeness(a, n), 6)))
    return out


@pytest.mark.parametrize("n", [1, 2, 150])
def test_neighbours(spark, n):
    rng = random.Random(n)
    rows = [(d, "".join(rng.choices("abc é日.", k=rng.choice([0, 1, 7, 300])))) for d in rng.sample(range(10_000), n)]
    got = c.fingerprints_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(plain(sorted(rows, reverse=True)))


def test_odd_rows(spark, odd_docs, no_docs):
    got = c.fingerprints_with_edits(odd_docs).collect()
    assert len(got) == 9 and {r.fingerprint for r in got if r.doc_id in (2, 3)} == {"3::"}
    assert {r.near_edited for r in got if r.doc_id == 3} == {1.0}
    assert c.fingerprints_with_edits(no_docs).count() == 0
