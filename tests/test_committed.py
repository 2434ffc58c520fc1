"""Tables and shards whose changes are all or nothing."""

import pytest
from pyspark.sql import functions as F

from signalloom.operators import sampling, selection
from signalloom.sources import sinks
from signalloom.sources.committed import ChangedMeanwhile, CommittedTable, Files


def ids(df):
    return sorted(r.id for r in df.collect())


def shards(spark, folder):
    return {p.name: ids(spark.read.parquet(str(p))) for p in sorted(folder.glob("part-*.parquet"))}


def test_append_replace_and_versions(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.latest() == 0
    assert table.append(spark.range(3)) == 1
    assert table.append(spark.range(3, 5)) == 2
    assert ids(table.read()) == [0, 1, 2, 3, 4] and ids(table.read(1)) == [0, 1, 2]
    assert table.replace(table.read().where("id % 2 = 0")) == 3  # from itself
    assert ids(table.read()) == [0, 2, 4]
    with pytest.raises(ValueError):
        table.append(spark.range(2).withColumn("x", F.lit(1)))
    assert table.vacuum() == 3 and table.versions() == [3] and ids(table.read()) == [0, 2, 4]
    assert table.replace(spark.range(0)) == 4 and ids(table.read()) == []


def test_a_broken_change_changes_nothing(spark, tmp_path, monkeypatch):
    table = CommittedTable(spark, str(tmp_path / "t"))
    table.append(spark.range(3))

    def fails(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(Files, "move", fails)
        with pytest.raises(OSError):
            table.append(spark.range(3, 6))
    assert ids(table.read()) == [0, 1, 2] and table.versions() == [1]
    table.append(spark.range(6, 8))
    assert ids(table.read()) == [0, 1, 2, 6, 7]
    assert table.vacuum() == 1  # what the broken change left


def test_changes_that_meet(spark, tmp_path):
    one, other = (CommittedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.append(spark.range(2))
    base = one.latest()
    other.append(spark.range(2, 4))
    with pytest.raises(ChangedMeanwhile):
        one.replace(spark.range(1), base)
    assert ids(one.read()) == [0, 1, 2, 3]
    met = []

    def combine(known, arrived):
        if not met:
            met.append(other.append(spark.range(10, 11)))
        return known.unionByName(arrived).distinct()

    one.merge(spark.range(3, 6), combine)
    assert ids(one.read()) == [0, 1, 2, 3, 4, 5, 10]


def test_upserts(spark, tmp_path):
    kind = "topic_id int, author string, first_year int"
    table = CommittedTable(spark, str(tmp_path / "t"))
    for rows in ([(1, "A", 2000), (1, "B", 2001)], [(1, "A", 1999), (2, "C", 2005)]):
        table.merge(spark.createDataFrame(rows, kind), sinks.upsert_first_years)
    assert sorted(map(tuple, table.read().collect())) == [(1, "A", 1999), (1, "B", 2001), (2, "C", 2005)]
    docs = CommittedTable(spark, str(tmp_path / "d"))
    kind = "k int, v string, o int"
    docs.insert_new(spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "n", 1)], kind), "k", "o")
    docs.insert_new(spark.createDataFrame([(1, "c", 0), (2, "d", None), (None, "m", 0)], kind), "k", "o")
    assert sorted(map(str, (tuple(r) for r in docs.read().collect()))) == ["(1, 'a', 1)", "(2, 'd', None)", "(None, 'n', 1)"]


def test_shards_go_on_after_those_that_are_there(spark, tmp_path):
    folder = tmp_path / "s"
    assert sinks.write_shards(spark.range(25), str(folder), 10, "id") == 2
    assert sinks.write_shards(spark.range(100, 160), str(folder), 10, "id") == 6
    found = shards(spark, folder)
    assert list(found) == [f"part-{k:05d}.parquet" for k in range(8)]
    assert found["part-00002.parquet"] == list(range(100, 110)) and found["part-00007.parquet"] == list(range(150, 160))
    assert sinks.write_shards(spark.range(5), str(folder), 10, "id") == 0
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith((".", "part-"))) == []


def test_shards_survive_a_break_between_renames(spark, tmp_path, monkeypatch):
    folder, move, done = tmp_path / "s", Files.move, []

    def breaks(self, name, to):
        if len(done) == 2:
            raise OSError("gone")
        done.append(to)
        return move(self, name, to)

    with monkeypatch.context() as m:
        m.setattr(Files, "move", breaks)
        with pytest.raises(OSError):
            sinks.write_shards(spark.range(50), str(folder), 10, "id")
    assert len(shards(spark, folder)) == 2
    assert sinks.write_shards(spark.range(50, 70), str(folder), 10, "id") == 2
    found = shards(spark, folder)
    assert len(found) == 7 and sorted(x for rows in found.values() for x in rows) == list(range(70))


def test_shards_of_equal_order_and_of_maps(spark, tmp_path):
    rows = spark.range(40).select("id", F.lit(1).alias("same"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        assert sinks.write_shards(rows, str(tmp_path / "s"), 10, "same") == 4
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    found = shards(spark, tmp_path / "s")
    assert [len(x) for x in found.values()] == [10] * 4 and sorted(x for r in found.values() for x in r) == list(range(40))


def test_a_table_is_replaced_when_the_new_one_is_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    sinks.write_corpus(spark.range(5), path)
    sinks.write_corpus(spark.read.parquet(path).where("id > 2"), path)  # from itself
    assert ids(spark.read.parquet(path)) == [3, 4]
    with pytest.raises(Exception):
        sinks.write_corpus(spark.range(3).select(F.expr("raise_error('no')").alias("id")), path)
    assert ids(spark.read.parquet(path)) == [3, 4]
    move, done = Files.move, []

    def breaks(self, name, to):
        if done:
            raise OSError("gone")
        done.append(to)
        return move(self, name, to)

    with monkeypatch.context() as m:
        m.setattr(Files, "move", breaks)
        with pytest.raises(OSError):
            sinks.write_corpus(spark.range(7), path)
    sinks.write_corpus(spark.range(8), path)
    assert ids(spark.read.parquet(path)) == list(range(8))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["c"]


def test_scores_that_are_no_numbers_come_last(spark):
    rows = spark.createDataFrame([(i, float("nan") if i < 50 else None if i < 60 else float(i)) for i in range(100)], "id int, s double")
    kept = selection.keep_top_share(rows, "s", "id").collect()
    assert len(kept) == 85 and {r.id for r in kept} >= set(range(60, 100))
    assert selection.keep_top_share(rows.where("s is null or isnan(s)"), "s", "id", 0.5).count() == 30


def test_rows_without_order(spark):
    rows = spark.createDataFrame([("a", None, "x"), ("a", None, "w"), ("b", None, "y"), ("b", 2, "z"), (None, 1, "n"), (None, 1, "m")], "k string, o int, v string")
    assert sorted(map(str, map(tuple, selection.keep_first(rows, "k", "o").collect()))) == ["('a', None, 'w')", "('b', 2, 'z')", "(None, 1, 'm')"]
    assert sorted(map(str, map(tuple, selection.first_position_last_value(rows, "k", "o").collect()))) == ["('a', None, 'x')", "('b', 2, 'z')", "(None, 1, 'n')"]
    maps = rows.withColumn("m", F.create_map("v", "o")).withColumn("deep", F.struct(F.create_map(F.coalesce("v", F.lit("")), "o").alias("x")))
    assert selection.keep_first(maps, "k", "o").count() == 3 and selection.first_position_last_value(maps, "k", "o").count() == 3


def test_samples_of_rows_with_maps(spark):
    rows = spark.range(60).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("s"), F.create_map(F.lit("a"), F.col("id") % 2).alias("m"), F.array(F.struct(F.create_map(F.lit(1), "id").alias("n"))).alias("deep"))
    split = sampling.exact_stratified_split(rows, "s", "k", {"train": 0.5, "test": 0.5})
    assert split.count() == 60 and {(r.split): r["count"] for r in split.groupBy("split").count().collect()} == {"train": 30, "test": 30}
    assert sampling.seeded_subsample(rows, "k", 13).count() == 13
    quotas = spark.createDataFrame([(0, 4), (1, 5)], "s long, quota long")
    assert sampling.quota_sample(rows, "s", "k", quotas).count() == 9
