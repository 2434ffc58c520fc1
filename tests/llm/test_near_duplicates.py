import random

import xxhash
from pyspark.sql import functions as F

from signalloom.llm import components, simhash_bktree as s


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius=3):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def plain_words(text):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]


def plain_set(text):
    words = plain_words(text)
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_word_fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(plain_words(text))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near_copies(texts):
    """The group of each text: alike by shingles within what word fingerprints link."""
    candidates, sets = groups([plain_word_fingerprint(t) for t in texts], 7), [plain_set(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if candidates[i] == candidates[j] and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_fingerprint():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["Ab", "é", "É", " ", "  ", "\t", "\n", "\x0b", "\xa0", "\x85", "z"]) for _ in range(rng.randint(0, 40)))
        assert s.fingerprint(text.encode()) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == xxhash.xxh64("a b c".encode(), 42).intdigest() - (1 << 64) * (xxhash.xxh64("a b c".encode(), 42).intdigest() >> 63)


def test_bk_tree():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(10)})
    tree = s.BKTree()
    for v in values + values[:5]:
        tree.add(v)
    for q in values[:100] + base:
        assert sorted(tree.search(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)
    assert s.BKTree().search(1, 3) == []


def linked(spark, values, tree_nodes):
    fps = spark.createDataFrame([(v - (1 << 64) * (v >> 63),) for v in values], "fp long")
    found = components.components(s.links(fps, tree_nodes=tree_nodes))
    root = {r.node: r.root for r in found.collect()}
    return [root.get(v - (1 << 64) * (v >> 63), v - (1 << 64) * (v >> 63)) for v in values]


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)})
    want = groups(values)
    for nodes in (2048, 3):  # whole shards, and shards cut into many trees
        got = linked(spark, values, nodes)
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_masks():
    for n, radius in ((1000, 3), (10**8, 3), (10**11, 3), (10**6, 6)):
        masks = s.shard_masks(n, radius)
        rng = random.Random(n)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x ^ sum(1 << b for b in rng.sample(range(64), radius))
            assert any(x & m == y & m for m in masks)
        assert n / 2 ** min(m.bit_count() for m in masks) <= 2 * s.SHARD_NODES
    assert len(s.shard_masks(1000, 3)) == 10


def test_wider_radius(spark, monkeypatch):
    rng = random.Random(9)
    values = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in [rng.getrandbits(64) for _ in range(30)] for _ in range(8)})
    monkeypatch.setattr(s, "SHARD_NODES", 0)  # the longest keys
    for radius in (0, 3, 6):
        fps = spark.createDataFrame([(v - (1 << 64) * (v >> 63),) for v in values], "fp long")
        root = {r.node: r.root for r in components.components(s.links(fps, radius)).collect()}
        got = [root.get(v - (1 << 64) * (v >> 63), v - (1 << 64) * (v >> 63)) for v in values]
        want = groups(values, radius)
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_components_of_a_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1, 0), (5, 5), (1000, 1001)], "a long, b long")
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert all(found[i] == 0 for i in range(n + 1)) and found[1001] == 1000 and len(found) == n + 3
    assert components.components(edges.limit(0)).count() == 0


def test_near_duplicates(spark, odd_docs, no_docs):
    got = s.near_duplicates(odd_docs).collect()
    assert len(got) == 9
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert {by[k].component_id for k in (1, 5)} == {1}
    assert {by[k].fingerprint for k in (2, 3, 4)} == {"0" * 16} and {by[k].component_id for k in (2, 3, 4)} == {2}
    assert by[None].component_id is None
    assert s.near_duplicates(no_docs).count() == 0


def test_documents_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    root = groups(fps)
    least = {}
    for g, r in zip(root, rows):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in s.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, root)}


def test_one_of_each(spark, odd_docs, no_docs):
    kept = s.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 6), (False, 7), (True, 0)]
    assert s.one_of_each(no_docs).count() == 0


def near_copies(rng, bases=12, each=6, words=60):
    """Texts with a few words changed, inserted or dropped; most stay alike."""
    vocabulary, out = [f"w{i}" for i in range(400)], []
    for _ in range(bases):
        base = rng.choices(vocabulary, k=words)
        for _ in range(each):
            seq = list(base)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(seq))
                seq[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [seq[at], rng.choice(vocabulary)]])
            out.append(rng.choice([" ", "\n"]).join(seq))
    return out


def test_near_copies_against_all_pairs(spark, monkeypatch):
    rng = random.Random(12)
    texts = near_copies(rng) + ["", " ", "short text", "Short TEXT", "short text here", "a b c d e", "a b c d f"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(5)
    root, least = plain_near_copies([t for _, t in rows]), {}
    for g, (d, _) in zip(root, rows):
        least[g] = min(least.get(g, d), d)
    whole = sorted(r.doc_id for r in s.one_of_each(df).collect())
    assert whole == sorted(least.values()) and 12 <= len(whole) < 40
    monkeypatch.setattr(s, "BLOCK_TEXTS", 3)  # groups in many blocks
    assert sorted(r.doc_id for r in s.one_of_each(df).collect()) == whole


def test_alike_is_exact():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ({rng.randrange(40) for _ in range(rng.randrange(30))} for _ in range(2))
        x, y = (s.np.array(sorted(v), s.np.uint64) for v in (a, b))
        want = len(a & b) * 5 >= len(a | b) * 4
        assert s.alike(x, y) == want and s.alike(y, x) == want
        if want and a:
            assert set(s._first_hashes(x)) & set(s._first_hashes(y))


def test_recall_of_near_copies(spark):
    """Of the pairs that are alike by all their shingles, how many end in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 100").select("doc_id", "text")
    rng = random.Random(6)
    edited = []
    for r in docs.limit(150).collect():
        words = r.text.split(" ")
        for _ in range(max(1, len(words) // 70)):
            words[rng.randrange(len(words))] = "changed"
        if len(plain_set(r.text) & plain_set(" ".join(words))) * 5 >= len(plain_set(r.text) | plain_set(" ".join(words))) * 4:
            edited.append((r.doc_id + 1_000_000, " ".join(words)))
    kept = {r.doc_id for r in s.one_of_each(docs.unionByName(spark.createDataFrame(edited, docs.schema))).collect()}
    assert len(edited) > 100 and sum(d not in kept for d, _ in edited) >= 0.9 * len(edited)


def test_short_texts():
    assert s.fingerprint(b"") == 0 and s.fingerprint(b"a") == plain_fingerprint("a")


def test_chunks_of_shingles(monkeypatch):
    """A long text's shingles are hashed some at a time."""
    rng = random.Random(8)
    text = " ".join(rng.choice(["aa", "b", "Cc", "d"]) + str(rng.randrange(30)) for _ in range(300))
    want = s.fingerprint(text.encode()), s.fingerprint(text.encode(), 1, True), s.shingle_set(text.encode()).tolist()
    assert want[:2] == (plain_fingerprint(text), plain_word_fingerprint(text)) and len(want[2]) == len(plain_set(text))
    monkeypatch.setattr(s, "_CHUNK", 7)
    assert (s.fingerprint(text.encode()), s.fingerprint(text.encode(), 1, True), s.shingle_set(text.encode()).tolist()) == want


def test_growing_tables_are_not_broadcast(spark, tmp_path):
    """Whatever looks small to the planner: the driver would hold it whole."""
    spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long").write.parquet(f"{tmp_path}/edges")
    spark.createDataFrame([(i, "one two three four five six " + "x" * (i % 3)) for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    edges, docs = spark.read.parquet(f"{tmp_path}/edges"), spark.read.parquet(f"{tmp_path}/docs")
    for df in (s.links(edges.select(F.col("a").alias("fp"))), components._large_star(edges), components._small_star(edges), s.near_duplicates(docs), s.one_of_each(docs)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
