import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from signalloom.plans import cards, collection
from signalloom.sources import sinks

ROOT = Path(__file__).resolve().parent.parent


def test_resumed_collection(spark):
    population = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("stratum"))
    strata = spark.createDataFrame([("0", 150), ("1", 5), ("2", 7)], "stratum string, quota long")
    none = population.limit(0)
    whole = {r.doc_id for r in collection.resume(population, strata, none).collect()}
    first = collection.resume(population, strata.withColumn("quota", F.least("quota", F.lit(60))), none)
    assert first.count() == 65
    both = {r.doc_id for r in first.collect()} | {r.doc_id for r in collection.resume(population, strata, first).collect()}
    assert both == whole and len(whole) == 155
    assert {r.stratum: r.collected for r in collection.status(strata, first).collect()} == {"0": 60, "1": 5, "2": 0}


def test_union_keeps_order(spark):
    schema = "doc_id string, position int, v int"
    topics = spark.createDataFrame([("A", 0, 1), ("B", 1, 1), ("C", 2, 1)], schema)
    seeds = spark.createDataFrame([("S", 0, 2), ("B", 1, 2)], schema)
    assert [(r.doc_id, r.v) for r in collection.union_works(topics, seeds).orderBy("position").collect()] == [("A", 1), ("B", 2), ("C", 1), ("S", 2)]


def test_cards(spark):
    chosen = spark.createDataFrame([("W1", 1, 99.0), ("W2", 2, 90.0)], "doc_id string, rank int, confidence double")
    corpus = spark.createDataFrame(
        [("W1", 1, "T", None, "journal", None, "10.1/x", '[{"institutions": [{"display_name": "Acme", "type": "company"}]}]'), ("W1", 2, "later", None, None, None, None, None), ("W3", 3, "x", None, None, None, None, None)],
        "doc_id string, row int, title string, pub_date string, source_tier string, article_url string, doi string, authorships_json string",
    )
    got = {r.doc_id: r for r in cards.cards(chosen, corpus).collect()}
    assert (got["W1"].slug, got["W1"].title, got["W1"].date, got["W1"].link, got["W1"].companies) == ("result-1", "T", "None", "https://doi.org/10.1/x", ["Acme"])
    assert (got["W2"].title, got["W2"].companies) == ("None", [])


def test_next_output(spark, tmp_path):
    rows = spark.range(1)
    assert [sinks.write_next(rows, str(tmp_path))[-7:] for _ in range(2)] == ["output1", "output2"]


def without(tmp_path, *names):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*names, ".git", "__pycache__", ".pytest_cache"))
    return tmp_path / "repo"


REST = "import __spark_entry__ as e; q = e.queries(); assert 'emergence_label' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_rest_works_without_training_data(tmp_path, gone):
    """The engine's queries and tests are there when the training-data operators are not."""
    repo = without(tmp_path, *gone)
    subprocess.run([sys.executable, "-B", "-c", REST], cwd=repo, check=True, timeout=120)
    found = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=repo, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0 and "test_functions.py" in found.stdout and "tests/llm" not in found.stdout, found.stdout[-2000:]
    code = "from pyspark.sql import SparkSession; import __spark_entry__ as e; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert e.queries()['stratified_split'](s, '/root/testdata/sf0.001').count() > 0"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=repo, check=True, timeout=300)


def test_rest_works_without_their_libraries():
    hidden = "import sys; sys.modules['xxhash'] = sys.modules['tiktoken'] = None; " + REST
    subprocess.run([sys.executable, "-B", "-c", hidden], cwd=ROOT, check=True, timeout=120)
