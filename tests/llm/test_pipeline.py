"""The pipeline's stages on a small table, each against a plain version of its decision."""

import re

import corpus_pipeline
from signalloom.llm import common, language_viterbi, packing_dp, registry, secret_tokens, simhash_bktree, toxicity_ordinal

from .test_index import plain as plain_contamination
from .test_near_duplicates import plain_near_copies


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "packing"]
    docs = common.documents(spark, sf_dir)
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in common.benchmark(spark, sf_dir).collect()]
    model = toxicity_ordinal.train(docs, common.labels(spark, sf_dir))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
        if name == "toxicity":
            kept = [(d, t) for d, t in kept if model.above(model.row(t.encode()))[0] < toxicity_ordinal.REJECT]
        elif name == "simhash_near_dedup":
            root, least = plain_near_copies([t for _, t in kept]), {}
            for g, (d, _) in zip(root, kept):
                least[g] = min(least.get(g, d), d)
            kept = [(d, t) for g, (d, t) in zip(root, kept) if least[g] == d]
        elif name == "benchmark_decontamination":
            bad = {r[0] for r in plain_contamination(kept, items) if r[-1]}
            kept = [(d, t) for d, t in kept if d not in bad]
        elif name == "secret_scans":
            find = secret_tokens._finder(secret_tokens.LIMIT, secret_tokens.VOCABULARY)
            left = {r.doc_id: r for r in docs.collect()}
            assert set(left) == {d for d, _ in kept}
            for d, t in kept:
                base, added = find(t)
                assert (left[d].text == t) == (not base + added) and len(re.findall(r"\[SECRET\]", left[d].text)) <= len(base + added) and left[d].n_chars == len(left[d].text)
            kept = [(d, left[d].text) for d, _ in kept]
        if name != "packing":
            assert docs.columns == columns and sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(kept)
    pieces = docs.collect()
    encode = packing_dp.encoder().encode
    assert {d: n for d, n in ((r.doc_id, r.doc_tokens) for r in pieces)} == {d: len(encode(t)) + 1 for d, t in kept}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sum(r.length for r in whole.collect()) == sum(r.length for r in pieces)


def test_stages_on_odd_tables(spark, sf_dir, odd_docs, no_docs):
    """Nulls, empty and long texts, repeats and clashing names go through every stage; what stays keeps its columns."""
    want = {"toxicity": 9, "simhash_near_dedup": 5, "benchmark_decontamination": 5, "secret_scans": 5}
    docs, none = odd_docs, no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs, none = common.materialise(stage(spark, docs, sf_dir), name), common.materialise(stage(spark, none, sf_dir), name)
        assert none.count() == 0
        if name in want:
            assert docs.columns == odd_docs.columns and docs.count() == want[name]
            assert {r["a.b"] for r in docs.collect()} == {"a.b"} and {r["__p"] for r in docs.collect()} == {"__p"}
    assert {r.doc_id for r in docs.collect()} == {None, 1, 2, 6, 7}


def test_registry(spark, sf_dir):
    names = list(registry.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and set(registry.oracle_sql()) <= set(names)
    assert simhash_bktree.RADIUS == 3 and language_viterbi.FOLDS == 5 and corpus_pipeline.ORACLE_SQL is None


def test_checkpoint_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    try:
        common.shared_dir(Session())
        raise AssertionError("a cluster without a shared folder must be refused")
    except RuntimeError:
        pass
