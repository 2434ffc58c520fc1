"""Search over postings against the scan of the texts."""

import random

import pytest
from pyspark.sql import functions as F

from signalloom.sources import providers, term_index


@pytest.fixture(scope="module")
def works(spark):
    rng = random.Random(2)
    words = "Sensors sensor glucose studies study implant lens optics gases a the of monitoring METALS metal x1 processes".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(i, text(4) or None, rng.choice([text(30), text(30), None]), 2018 + i % 4 if i % 13 else None, rng.choice([["r"], [], None])) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, title string, abstract_text string, pub_year int, referenced_works_ids array<string>").repartition(4).persist()


@pytest.fixture(scope="module", params=[(4_000_000, 1_000_000), (300, 60)])
def index(request, works, spark, tmp_path_factory):
    before = term_index.FOLDER_POSTINGS, term_index.FILE_POSTINGS
    term_index.FOLDER_POSTINGS, term_index.FILE_POSTINGS = request.param
    try:
        return term_index.build(works, str(tmp_path_factory.mktemp("index")))
    finally:
        term_index.FOLDER_POSTINGS, term_index.FILE_POSTINGS = before


@pytest.mark.parametrize("query", ["glucose sensor implant", "metals", "the study of processes and gases", "unseen words here", "the of", ""])
@pytest.mark.parametrize("good", [False, True])
def test_same_as_the_scan(spark, works, index, query, good):
    years = [2019, 2020, 2021]
    scan = providers.TableSearch(works).search(query, 40, years, good).select("doc_id", "pub_year")
    found = term_index.IndexedSearch(index).search(query, 40, years, good)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, scan.collect()))


def test_same_seeds(spark, works, index):
    one, other = (sorted(map(tuple, providers.recover_seeds("glucose sensor implant study", [2018, 2019], p, spark, 50, 20).collect())) for p in (providers.TableSearch(works), term_index.IndexedSearch(index)))
    assert one == other and one


def test_no_text_is_read(spark, works, index):
    plan = term_index.IndexedSearch(index).search("glucose sensor", 10, [2019])._jdf.queryExecution().executedPlan().toString()
    assert "abstract_text" not in plan and "title" not in plan
    plan = index.hits("glucose sensor")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    assert "term" in plan.split("PushedFilters")[1]


def test_topics_and_empty(spark, works, index, tmp_path):
    search = term_index.IndexedSearch(index, works.withColumn("topic_id", F.lit(5)))
    found, total = search.by_topic(5, 3, [2019])
    assert found.count() == 3 and total == works.where("pub_year = 2019").count()
    with pytest.raises(ValueError):
        term_index.IndexedSearch(index).by_topic(5, 3, [2019])
    empty = term_index.build(works.limit(0), str(tmp_path / "none"))
    assert empty.matches("glucose").count() == 0
