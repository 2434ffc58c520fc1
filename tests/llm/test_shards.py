import zlib

import numpy as np
import pytest

from signalloom.llm import common, hypergeometric_shards as h


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    for good, bad, n in ((300, 700, 50), (5, 5, 5), (2, 10_000, 9_000)):
        x = np.array([h.hypergeometric(rng, good, bad, n) for _ in range(4000)])
        want = np.random.default_rng(2).hypergeometric(good, bad, n, 100_000)
        sd = max(want.std(), 0.01)
        assert abs(x.mean() - want.mean()) < 0.1 * sd + 0.01 and abs(x.std() - want.std()) < 0.08 * sd + 0.01
        assert x.min() >= max(0, n - bad) and x.max() <= min(n, good)
    big = h.hypergeometric(rng, 10**10, 3 * 10**10, 30_000)  # beyond what common samplers take
    assert 7000 < big < 8000


def test_matrix_margins():
    m = np.array(h.communication_matrix([10, 0, 33, 7], [25, 25], 5))
    assert m.sum(axis=1).tolist() == [10, 0, 33, 7] and m.sum(axis=0).tolist() == [25, 25]
    with pytest.raises(ValueError):
        h.communication_matrix([1], [2], 1)


@pytest.mark.parametrize("cell_rows", [100_000, 5])
def test_shuffle(spark, cell_rows):
    rows = spark.range(1000).repartition(7, "id").selectExpr("id", "'x' AS shard")
    got = h.shuffle_into_shards(rows, 24, cell_rows=cell_rows).collect()
    assert sorted(r.id for r in got) == list(range(1000)) and {r.shard for r in got} == {"x"}
    by = {}
    for r in got:
        by.setdefault(r.shard_, []).append(r.slot)
    assert sorted(map(len, by.values())) == [41] * 8 + [42] * 16 and all(sorted(v) == list(range(len(v))) for v in by.values())
    again = h.shuffle_into_shards(rows, 24, cell_rows=cell_rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_shuffle_is_uniform(spark):
    """Where a row comes from says nothing about where it goes."""
    rows = spark.range(0, 6000, 1, 6).selectExpr("id")
    got = np.array([(r.id // 1000, r.shard, r.slot) for r in h.shuffle_into_shards(rows, 4).collect()])
    table = np.array([[((got[:, 0] == p) & (got[:, 1] == s)).sum() for s in range(4)] for p in range(6)])
    assert abs(table - 250).max() < 75
    assert abs(np.corrcoef(got[:, 0], got[:, 2])[0, 1]) < 0.06


def test_matrix_law():
    """Every cell follows the hypergeometric law of its row and column, below and above the library's bound."""
    for scale, bound in ((1, h.LIBRARY_ROWS), (1, 10)):
        h_bound, h.LIBRARY_ROWS = h.LIBRARY_ROWS, bound
        try:
            draws = np.array([h.communication_matrix([30, 20, 0, 50], [40, 35, 25], s) for s in range(1500)])
        finally:
            h.LIBRARY_ROWS = h_bound
        for i, n in enumerate((30, 20, 0, 50)):
            for j, c in enumerate((40, 35, 25)):
                want = np.random.default_rng(1).hypergeometric(c, 100 - c, n, 100_000) if n else np.zeros(2)
                assert abs(draws[:, i, j].mean() - want.mean()) < 0.25 and abs(draws[:, i, j].std() - want.std()) < 0.2
    many = h.communication_matrix([1000] * 3000, h.shard_sizes(3_000_000, 24), 3)
    assert np.array(many).sum(axis=0).tolist() == [125_000] * 24


def test_changed_partitions_stop_the_job(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 4)
    for other in (spark.range(0, 990, 1, 4), spark.range(0, 1010, 1, 4)):
        with monkeypatch.context() as m:
            m.setattr(h, "packed", lambda _, **also: common.packed(other, **also))
            with pytest.raises(Exception, match="partitions changed"):
                h.shuffle_into_shards(rows, 3).collect()


def test_odd_rows(spark, odd_docs, no_docs):
    got = h.shuffle_into_shards(odd_docs, 3)
    assert got.count() == 9 and {"shard", "slot", "shard_", "slot_"} <= set(got.columns)
    assert h.shuffle_into_shards(no_docs, 3).count() == 0
    clashing = odd_docs.where("doc_id <> 5").drop("shard", "slot")
    same = h.shuffle_into_shards(clashing, 3).drop("shard", "slot")
    assert same.columns == clashing.columns and sorted(map(str, same.collect())) == sorted(map(str, clashing.collect()))
    with pytest.raises(ValueError):
        h.shuffle_into_shards(no_docs, 0)


def test_query(spark, sf_dir):
    got = h.op2_hypergeometric_shards(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(texts) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    for r in got:
        b = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(b) + 8, zlib.crc32(b))
    sizes = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
