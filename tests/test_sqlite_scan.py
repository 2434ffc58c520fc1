"""SQLite tables read by ranges of row ids, with filters pushed down."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from signalloom.sources.sqlite_scan import sqlite_scan


def test_scan_join_and_filters(spark, tmp_path):
    path = str(tmp_path / "state.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE documents (doc_id TEXT PRIMARY KEY, stratum TEXT, payload TEXT, "a b" REAL)')
        db.execute("CREATE TABLE strata (name TEXT PRIMARY KEY, quota INTEGER)")
        db.execute("CREATE TABLE empty_one (x INTEGER)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(f"W{i}", f"s{i % 3}", json.dumps({"year": 2000 + i % 5}), None if i % 7 == 0 else i / 2) for i in range(250)])
        db.executemany("INSERT INTO strata VALUES (?, ?)", [(f"s{i}", 10 * i) for i in range(4)])
    docs = sqlite_scan(spark, path, "documents", {"doc_id": "string", "stratum": "string", "payload": "string", "a b": "double"}, rows_per_task=60)
    assert docs.count() == 250 and docs.rdd.getNumPartitions() == 5
    strata = sqlite_scan(spark, path, "strata", {"name": "string", "quota": "long"})
    status = strata.join(docs, F.col("name") == F.col("stratum"), "left").groupBy("name", "quota").agg(F.count("doc_id").alias("n")).orderBy("name").collect()
    assert [tuple(r) for r in status] == [("s0", 0, 84), ("s1", 10, 83), ("s2", 20, 83), ("s3", 30, 0)]
    few = sqlite_scan(spark, path, "documents", {"doc_id": "string"}, [("stratum", "in", ["s1", "s2"]), ("a b", ">=", 100), ("doc_id", "<>", "W201")])
    assert {r.doc_id for r in few.collect()} == {f"W{i}" for i in range(200, 250) if i % 3 and i % 7 and i != 201}
    with pytest.raises(ValueError):
        sqlite_scan(spark, path, "documents", {"doc_id": "string"}, [("doc_id", "like", "W%")])
    assert docs.where("`a b` is null").count() == 36
    assert docs.where(F.get_json_object("payload", "$.year") == "2004").count() == 50
    assert sqlite_scan(spark, path, "empty_one", {"x": "int"}).count() == 0
