"""A paged service as a table, and its collection in commits."""

import json

import pytest
from pyspark.sql import functions as F

from signalloom.sources import paged
from signalloom.sources.committed import CommittedTable

NAME = "signalloom.sources.paged:RecordedPages"
KIND = "doc_id string, title string"


@pytest.fixture
def folder(tmp_path):
    n = 0
    for year, pages in ((2020, 7), (2021, 3), (2023, 1)):
        at = tmp_path / "pages" / str(year)
        at.mkdir(parents=True)
        for p in range(1, pages + 1):
            works = [] if (year, p) == (2021, 2) else [{"doc_id": f"W{n + i}", "title": f"t{year}"} for i in range(5)]
            n += 4  # the last work of a page is the first of the next
            (at / f"{p}.json").write_text(json.dumps(works))
    return str(tmp_path / "pages")


def test_scan_and_tests(spark, folder):
    years = [2020, 2021, 2022, 2023]
    pages = paged.read_pages(spark, NAME, {"folder": folder}, years)
    assert pages.where("place >= 0").count() == 50 and pages.where("place = -1").count() == 11
    assert pages.rdd.getNumPartitions() == 4  # of up to four pages each
    some = paged.read_pages(spark, NAME, {"folder": folder}, years, tests=[("year", ">=", 2021), ("page", "in", [1, 3])])
    assert sorted({(r.year, r.page) for r in some.collect()}) == [(2021, 1), (2021, 3), (2023, 1)]
    assert some.rdd.getNumPartitions() == 2
    assert paged.read_pages(spark, NAME, {"folder": folder}, years, tests=[("year", "=", 1999)]).count() == 0
    with pytest.raises(ValueError):
        paged.read_pages(spark, NAME, {"folder": folder}, years, tests=[("payload", "=", "x")])


def test_a_query_leaves_the_next_one_alone(spark, folder):
    """What one query filters is not missing from another over the same frame."""
    pages = paged.read_pages(spark, NAME, {"folder": folder}, [2020, 2021, 2023])
    assert pages.where("year = 2021").count() == 3 + 10
    assert pages.count() == 61 and pages.where("payload is not null").count() == 50


def test_resumed_collection_is_the_whole_one(spark, folder, tmp_path, monkeypatch):
    years = [2020, 2021, 2023]
    whole = CommittedTable(spark, str(tmp_path / "whole"))
    assert paged.collect_pages(whole, NAME, {"folder": folder}, years)
    assert whole.latest() == 1
    parts = CommittedTable(spark, str(tmp_path / "parts"))
    append, calls = CommittedTable.append, []

    def breaks(self, rows):
        if len(calls) == 2:
            raise OSError("gone")
        calls.append(1)
        return append(self, rows)

    with monkeypatch.context() as m:
        m.setattr(CommittedTable, "append", breaks)
        with pytest.raises(OSError):
            paged.collect_pages(parts, NAME, {"folder": folder}, years, 3)
    assert parts.read().where("place = -1").count() == 6
    assert paged.collect_pages(parts, NAME, {"folder": folder}, years, 3)
    assert parts.latest() == 4
    rows = lambda t: sorted(map(str, t.read().collect()))
    assert rows(parts) == rows(whole)
    assert paged.collect_pages(parts, NAME, {"folder": folder}, years) and parts.latest() == 4
    works = paged.collected_works(parts, KIND)
    assert works.count() == 45 - 3 and works.select(F.count_distinct("doc_id")).first()[0] == works.count()
    few = paged.collected_works(parts, KIND, quota=6)
    assert sorted(r.doc_id for r in few.where("title = 't2020'").collect()) == ["W0", "W1", "W2", "W3", "W4", "W5"]


def test_a_paused_service(spark, folder, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    assert not paged.collect_pages(table, "signalloom.sources.paged:AlwaysPaused", {}, [2020])
    assert table.read().count() == 0
