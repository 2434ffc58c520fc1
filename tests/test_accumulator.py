"""Features that follow arriving works against batch runs over all works so far."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators import history, text_geometry
from signalloom.sources.committed import CommittedTable
from signalloom.streaming import accumulator, counts

KIND = "doc_id int, topic_id int, pub_year string, vector array<double>"


def batch_rows(rows):
    """topic_id and pub_year to the batch features."""
    works = rows.withColumn("pub_year", F.expr("try_cast(try_cast(pub_year as double) as int)")).where("topic_id is not null and pub_year is not null")
    dynamics = history.topic_dynamics(works.select("topic_id", "pub_year")).distinct().collect()
    n = {(r.topic_id, r.pub_year): r["count"] for r in works.groupBy("topic_id", "pub_year").count().collect()}
    past = {(r.topic_id, r.pub_year): (r.n, r.norm) for r in text_geometry.past_centroids(works.withColumn("vector", text_geometry.sparse(F.col("vector")))).collect()}
    return {(r.topic_id, r.pub_year): (n[r.topic_id, r.pub_year], *r[2:], *past.get((r.topic_id, r.pub_year), (0, 0.0))) for r in dynamics}


def works_of(spark, rng, ids, years):
    rows = [(int(i), int(rng.integers(4)) if i % 17 else None, str(int(rng.choice(years))) if i % 13 else "no year", rng.random(3).tolist() if i % 5 else None) for i in ids]
    return spark.createDataFrame(rows, KIND)


def test_equals_the_batch_after_each_arrival_and_restart(spark, tmp_path):
    rng = np.random.default_rng(8)
    folder, table = str(tmp_path / "in"), CommittedTable(spark, str(tmp_path / "out"))
    # years arrive in order, then late ones
    for k, years in enumerate(([2018, 2019], [2020, 2021], [2017, 2019, 2022])):
        works_of(spark, rng, range(60 * k, 60 * k + 60), years).coalesce(2).write.mode("append").parquet(folder)
        features = accumulator.running_features(counts.arriving(spark, folder, KIND))
        accumulator.maintain_features(features, table, str(tmp_path / "cp")).awaitTermination(120)  # a new query each time
        want = batch_rows(spark.read.schema(KIND).parquet(folder))
        got = {(int(r.topic_id), r.pub_year): tuple(r[2:-1]) for r in table.read().collect()}
        assert got.keys() == want.keys()
        for key, row in want.items():
            assert np.allclose(got[key], row), key


def test_works_that_come_too_late(spark, tmp_path):
    folder, table = str(tmp_path / "in"), CommittedTable(spark, str(tmp_path / "out"))
    for rows in ([(1, 7, "2020", [1.0]), (2, 7, "2021", None)], [(3, 7, "2018", [1.0]), (4, 7, "2020", [3.0]), (5, 8, "1990", None)]):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)
        features = accumulator.running_features(counts.arriving(spark, folder, KIND), late_years=1)
        accumulator.maintain_features(features, table, str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.topic_id, r.pub_year): r for r in table.read().collect()}
    assert set(got) == {("7", 2020), ("7", 2021), ("8", 1990)}
    assert got["7", 2021].topic_local_volume == 2 and got["7", 2021].cluster_density == pytest.approx(2.0) and got["7", 2021].late == 1
