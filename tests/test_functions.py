import re

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from signalloom.functions import numbers, predicates, records, texts
from signalloom.plans import table_queries
from signalloom.sources import tables


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("index, strict, lenient", [({"world": [1], "Hello": [0]}, "Hello world", "Hello world"), ({"incomplete": [1]}, None, "incomplete"), ({"a": [0], "b": [0]}, None, "a b"), ({}, None, None), (None, None, None), ({"a": [-1, 0]}, None, "a a")])
def test_abstracts(spark, index, strict, lenient):
    schema = "i map<string, array<int>>"
    assert one(spark, schema, (index,), texts.strict_abstract(F.col("i"))) == strict
    assert one(spark, schema, (index,), texts.lenient_abstract(F.col("i"))) == lenient


def test_inverted_index_of_a_long_text(spark):
    rng = random.Random(5)
    words = [rng.choice(["a", "of", "", "é"] + [f"w{k}" for k in range(9000)]) for _ in range(20_000)] + ["last"]
    plain = {}
    for i, w in enumerate(words):
        plain.setdefault(w, []).append(i + 2)
    assert one(spark, "x array<string>", (words,), texts.inverted_index(F.col("x"), 2)) == plain
    assert one(spark, "x array<string>", (words,), texts.strict_abstract(texts.inverted_index(F.col("x")))) == " ".join(words)
    assert one(spark, "x array<string>", (None,), texts.inverted_index(F.col("x"))) is None


def test_abstract_rebuild_reads_whole_texts(spark, sf_dir):
    rows = table_queries.abstract_rebuild(spark, sf_dir).join(tables.table(spark, sf_dir, "documents"), "doc_id")
    assert rows.where(F.char_length("text") > 300).count() > 0
    assert rows.where((F.col("lenient") != F.col("text")) | ((F.col("doc_id") % 3 != 1) & (F.col("strict") != F.col("text")))).count() == 0


@pytest.mark.parametrize("x, expected", [("https://x.org/W1", "W1"), ("W1", "W1"), ("", None), (None, None)])
def test_short_id(spark, x, expected):
    assert one(spark, "x string", (x,), texts.short_id(F.col("x"))) == expected


@pytest.mark.parametrize("x, expected", [(None, None), (float("nan"), "nan"), (7.0, 5.0), (-9.0, -5.0), (1.5, 1.5)])
def test_clip_keeps_null_and_nan(spark, x, expected):
    found = one(spark, "x double", (x,), numbers.clip(F.col("x")))
    assert (str(found) if expected == "nan" else found) == expected


@pytest.mark.parametrize("x, expected", [("2020", 2020), ("2020.9", 2020), ("abc", None), (None, None)])
def test_years(spark, x, expected):
    assert one(spark, "x string", (x,), numbers.as_year(F.col("x"))) == expected


@pytest.mark.parametrize(
    "title, kind, abstract, expected",
    [
        ("A survey of cells", None, None, True), ("Recent advances in cells", None, None, True), ("Обзор методов", None, None, True), ("Meta-analysis of trials", None, None, True),
        ("Cells", "Review", None, True), ("Cells", "article", "Here, we critically review cells", True), ("Cells", None, "This paper reviews cells", True), ("Surveyed cells", None, None, False),
        ("Reviewer behaviour", None, "We measure", False), (None, None, None, False),
    ],
)
def test_reviews(spark, title, kind, abstract, expected):
    assert one(spark, "t string, k string, a string", (title, kind, abstract), predicates.is_review(F.col("t"), F.col("k"), F.col("a"))) is expected


def test_ion_gate(spark):
    rows = [("W1", "Lithium cells", "sodium once"), ("W2", "Cells", "none"), ("W3", "New cathode for sodium-ion batteries", ""), ("W4", "Cells", "Sodium salts and sodium"), ("W5", "Na-ion storage", "")]
    df = spark.createDataFrame(rows, "id string, t string, a string")
    found = df.where(predicates.matches_ion(F.col("t"), F.col("a"), "sodium-ion batteries")).collect()
    assert [r.id for r in found] == ["W3", "W4", "W5"]
    assert df.where(predicates.matches_ion(F.col("t"), F.col("a"), "solar cells")).count() == 5


def test_quantum_gate(spark):
    df = spark.createDataFrame([("W1", "Phosphor thermometry", ""), ("W2", "Nitrogen vacancy probes", ""), ("W3", "Probes", "with entangled photons")], "id string, t string, a string")
    found = df.where(predicates.matches_quantum_sensing(F.col("t"), F.col("a"), "quantum sensors")).collect()
    assert [r.id for r in found] == ["W2", "W3"]


def test_query_match(spark):
    df = spark.createDataFrame([("W1", "Glucose monitoring implant sensor"), ("W2", "Optics of lenses")], "id string, t string")
    assert [r.id for r in df.where(predicates.matches_query(F.col("t"), F.lit("implant glucose sensor"))).collect()] == ["W1"]


def test_numeric_grounding(spark):
    source = "The device shows a loss of 1.7 and 0.3 dB in all measured bands. " * 5
    check = lambda result, text: one(spark, "r string, s string", (result, text), predicates.grounded_numbers(F.col("r"), F.col("s")))
    assert check("1,7 and 0,3 dB", source)
    assert not check("9.8 dB", source)
    assert not check("1.7 dB", "1.7 " * 100)
    assert not check("1.7 dB", None)


def test_numbers_late_in_a_result_are_checked(spark, tmp_path):
    source = "The device shows a loss of 1.7 dB in all measured bands. " * 5
    rows = [(2, source + "It weighs 99 g."), (3, source), (4, source), (5, source)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.grounded for r in table_queries.numeric_grounding(spark, str(tmp_path)).collect()}
    assert got == {2: True, 3: False, 4: True, 5: True}


@pytest.mark.parametrize("text, valid", [("Новый метод", True), ("новый метод", False), ("Методmix", False), ("None", False), (None, False), ("слоВо", False), ("Метод.и", False)])
def test_generated_text(spark, text, valid):
    assert one(spark, "x string", (text,), predicates.valid_generated(F.col("x"))) is valid


@pytest.mark.parametrize("title, expected", [("A systematic review of AI, VR, and LLM applications in special education", "special education ai"), ("", ""), (None, "")])
def test_search_phrase(spark, title, expected):
    assert one(spark, "x string", (title,), texts.search_phrase(F.col("x"))) == expected


@pytest.mark.parametrize("title, abstract, expected", [
    ("Port Scan Detection in IoT Networks", "A port scan of IoT devices. Port scan attacks.", '"Port Scan" AND IoT'),
    ("Hard carbon for sodium storage", "hard carbon anodes hard carbon", '"Hard carbon" AND sodium'),
    ("Sodium storage", "x y", '"sodium ion"'),
    ("Zinc Air cells", "ZA cells", '"Zinc Air"'),
    ("Deep learning: networks for tumor imaging", "tumor networks learning imaging", '"tumor imaging"'),
    ("Running buildings", "the building runs while run", None),
    ("On the", "nothing", None),
    (None, None, None),
])
def test_thematic_query(spark, title, abstract, expected):
    rows = spark.createDataFrame([(title, abstract)], "thematic_parts string, a string")
    got = texts.with_thematic_query(rows, "thematic_parts", "a")
    assert got.columns == ["thematic_parts", "a", "thematic"] and got.first().thematic == expected


def test_thematic_query_as_in_sql(spark, tmp_path):
    """Scores that tie exactly, words beside letters that are no ASCII, control characters."""
    titles = (
        "Toererster thndhahe a reblest ores ershsh oueshe eronthst ha. Ofererednt.",
        "Networks detecting faults ma\u00e7on dit of networks detecting",
        "Sturdy turbines f\u00fcr Gr\u00fcnes in M\u00e9nage \u00b2on roofs",
        "Hopping\u0001 cats\u0002 sitting on pyramids\u0001s singing\u0002",
        None,
    )
    rows = [(k, t, "en", "a") for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        expected = db.execute(table_queries.ORACLE_SQL["thematic_phrases"]).fetchall()
    assert sorted(map(tuple, table_queries.thematic_phrases(spark, str(tmp_path)).collect())) == sorted(expected)


@pytest.mark.parametrize("text", ["Running buildings Processes sees gases bring processing", "3cats é-dogs hopping adding Singing", None])
def test_word_stems(spark, text):
    def plain(w):
        if len(w) > 6 and w.endswith("ing"):
            return w[:-4] if w[-4] == w[-5] else w[:-3]
        return w[:-1] if len(w) > 4 and w.endswith("s") else w

    words = [w.lower() for w in re.findall("[A-Za-z][A-Za-z0-9]*", text or "")]
    assert one(spark, "x string", (text,), texts.word_stems(F.col("x"))) == [plain(w) for w in words]


def test_query_variants(spark):
    check = lambda q: one(spark, "x string", (q,), texts.query_variants(F.col("x")))
    assert check("a b  c d") == ["a b c", "a b", "a"] and check("a") == [] and check("") == []


def test_titles_and_signals(spark):
    check = lambda f, *x: one(spark, "x string, y string", x, f(F.col("x"), F.col("y")))
    assert check(predicates.valid_title, "Новый метод", "A new method") and not check(predicates.valid_title, "A new method", "A new method")
    assert not check(predicates.valid_title, "Alpha beta gamma delta метод", "x") and check(predicates.valid_title, "None", " ")
    assert check(predicates.valid_description, "None", None) and not check(predicates.valid_description, "None", "text") and not check(predicates.valid_description, None, "text")
    assert one(spark, "x string", ("Ключевые факторы для этой статьи не выделены. И",), predicates.generic_signal(F.col("x"))) is True
    assert one(spark, "x string", ("```json\n{}\n```",), texts.without_fence(F.col("x"))) == "{}"
    assert one(spark, "x string", ("A b. C d! E",), texts.first_sentences(F.col("x"), 2)) == "A b. C d!"


def test_fresh(spark):
    df = spark.sql("select current_timestamp() - interval 23 hours as a, current_timestamp() - interval 25 hours as b, cast(null as timestamp) as c")
    assert tuple(df.select(*(predicates.fresh(F.col(c)) for c in "abc")).first()) == (True, False, False)


def test_cache_keys(spark):
    import hashlib

    got = one(spark, "x string, y string", ("q", None), F.struct(texts.cache_key(F.col("x"), F.col("y")).alias("k"), texts.cache_name(F.col("x"), F.lit("a/b c")).alias("n")))
    assert got.k == hashlib.sha256(b'["q",null]').hexdigest()
    assert got.n == hashlib.sha256(b"q").hexdigest()[:16] + "_a_b_c.json"


def test_authorships(spark):
    schema = "a array<struct<author: struct<id: string>, institutions: array<struct<display_name: string, type: string>>>>"
    both = ([{"author": {"id": "x/A1"}, "institutions": [{"display_name": "B", "type": "company"}]}, {"author": {"id": "x/A1"}, "institutions": [{"display_name": "A", "type": "education"}]}],)
    part = ([{"author": {"id": None}, "institutions": []}, {"author": {"id": "A2"}, "institutions": [{"display_name": "A", "type": "company"}]}],)
    assert one(spark, schema, both, records.commercial_maturity(F.col("a"))) == 0.5
    assert one(spark, schema, part, records.commercial_maturity(F.col("a"))) is None
    assert one(spark, schema, part, records.affiliation_coverage(F.col("a"))) == 0.5
    assert one(spark, schema, ([],), records.affiliation_coverage(F.col("a"))) is None
    assert one(spark, schema, both, records.author_ids(F.col("a"))) == ["A1"]
    assert one(spark, schema, both, records.affiliations(F.col("a"))) == ["A", "B"]


def test_company_names(spark):
    import json

    institutions = [{"display_name": n, "type": t} for n, t in (("Acme", "company"), ("ACME", "Company"), (" ", "company"), ("Uni", "education"), ("B", "company"), ("C", "company"), ("D", "company"), ("E", "company"))]
    check = lambda x: one(spark, "x string", (x,), records.company_names(F.col("x")))
    assert check(json.dumps([{"institutions": institutions}, {"institutions": None}])) == ["Acme", "B", "C", "D"]
    assert check("not json") == [] and check(None) == []


def test_corpus_rows(spark):
    work = {
        "id": "https://x/W1", "publication_year": 2020, "title": "T", "type": "article", "cited_by_count": 3, "abstract_inverted_index": {"b": [1], "a": [0]},
        "primary_topic": {"id": "x/T1", "display_name": "topic", "domain": {"id": "x/3"}, "field": {"id": "x/22"}}, "referenced_works": ["x/R1"], "authorships": [],
        "primary_location": {"landing_page_url": None, "source": {"id": "S", "display_name": "s", "type": "journal"}},
    }
    bad = [work | {"id": None}, work | {"referenced_works": []}, work | {"publication_year": 1900}, work | {"abstract_inverted_index": {"a": [1]}}, work | {"primary_topic": None}]
    found = records.corpus_rows(spark.createDataFrame([work, *bad], records.RAW_WORK), 2010, 2026, 2019).collect()
    assert len(found) == 1
    row = found[0]
    assert (row.doc_id, row.abstract_text, row.source_tier, row.is_engineering, row.split, row.domain_id) == ("W1", "a b", "journal", True, "inference", "3")
    assert records.search_rows(spark.createDataFrame([work], records.RAW_WORK)).first().primary_topic_id == "T1"


@pytest.mark.parametrize("url, doi, expected", [("https://a", "x", "https://a"), ("ftp://a", "https://doi.org/1", "https://doi.org/1"), (None, "10.1/x", "https://doi.org/10.1/x")])
def test_links(spark, url, doi, expected):
    assert one(spark, "u string, d string", (url, doi), records.article_link(F.col("u"), F.col("d"), F.lit("W1"))) == expected


def test_year_roles(spark):
    roles = {"past_support_only": (2015,), "train": (2018,), "valid": (2019,), "test": (2020,), "target_support_only": (2021,)}
    df = spark.createDataFrame([(y,) for y in (2014, 2015, 2018, 2019, 2020, 2021, 2025)], "y int")
    found = [tuple(r) for r in df.select(records.split_label(F.col("y"), roles, 2016), records.target_status(F.col("y"), roles, 2020)).collect()]
    assert found == [("train_candidates", "pending"), ("past_support", "past_support_only"), ("train_candidates", "pending"), ("valid_candidates", "pending"), ("test_candidates", "pending"), ("target_support", "future_window_incomplete"), ("inference", "future_window_incomplete")]


def test_compact(spark):
    assert one(spark, "x string", ("a" * 4000 + "b" * 2000,), texts.compact(F.col("x"))) == "a" * 3750 + " … " + "b" * 1250
    assert one(spark, "x string", ("short",), texts.compact(F.col("x"))) == "short"


def test_stems_of_long_runs(spark):
    """One look at each run, however long: a blob of letters and digits without a space."""
    import time

    blob = "ab1" * 700_000
    start = time.time()
    got = one(spark, "x string", (f"{blob}s {blob}ing 12 34abcds runnings",), texts.word_stems(F.col("x")))
    assert [len(w) for w in got] == [2_100_000, 2_100_000, 4, 7] and got[2:] == ["abcd", "running"]
    assert time.time() - start < 30
