import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.functions import texts
from signalloom.operators import citations, evidence, history, labels, metrics, model, quality, ranks, sampling, selection, text_geometry
from signalloom.plans import table_queries
from signalloom.plans.features import build_features, score_and_select
from signalloom.sources import providers, sinks, tables
from signalloom.streaming import counts as stream

WORK = "doc_id int, pub_year string, topic_id int, domain_id string, source_id int, authors_ids array<int>"


@pytest.fixture(scope="module")
def odd(spark):
    """Works with every key missing once, a year that is none, and repeats."""
    rows = [
        (1, "2018", 1, "d", 7, [1, 2]), (2, "2019", 1, "d", 7, [2]), (3, "2020", 1, "d", 8, []), (4, "2021", 1, "e", None, [3]), (5, "abc", 1, "d", 7, [1]),
        (6, None, 1, "d", 7, None), (7, "2021", None, "d", 7, [1]), (8, "2021", 1, None, 7, [1]), (9, "2021", 1, "d", 7, [1]), (9, "2021", 1, "d", 7, [1]),
    ]
    return spark.createDataFrame(rows, WORK)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_topic_dynamics(odd):
    found = history.topic_dynamics(odd)
    assert found.count() == 10
    r = by_id(found)
    assert (r[9].topic_historical_volume, r[9].topic_age_years) == (3.0, 3.0)
    assert r[9].topic_publication_growth == 0.0
    for k in (5, 6, 7):
        assert (r[k].topic_historical_volume, r[k].topic_publication_growth, r[k].topic_age_years) == (0.0, 0.0, 0.0)


def test_history_is_strict(odd):
    r = by_id(history.topic_local_volume(odd))
    assert [r[k].topic_local_volume for k in (1, 2, 3, 4, 9)] == [0.0, 1.0, 2.0, 3.0, 3.0]
    r = by_id(history.topic_local_volume(odd, F.col("doc_id") != 2))
    assert [r[k].topic_local_volume for k in (1, 2, 3, 4)] == [0.0, 1.0, 1.0, 2.0]


def test_source_history(odd):
    r = by_id(history.source_history(odd))
    assert (r[9].source_history_count, r[9].topic_source_diversity) == (2.0, 2.0)
    assert r[9].source_novelty == pytest.approx(1 / np.log(4))
    assert (r[4].source_history_count, r[4].source_novelty) == (0.0, 0.0)


def test_topic_domain(odd):
    r = by_id(history.topic_domain(odd))
    assert r[9].domain_history_count == 3.0 and r[9].topic_domain_age_years == 3.0 and r[9].ppmi_domain_score == 0.0
    assert r[4].topic_domain_rarity == pytest.approx(1 / np.log(2)) and r[8].topic_domain_rarity == 0.0


def test_authors(odd):
    r = by_id(history.author_dynamics(odd))
    assert r[3].historical_author_count == 1.0 and r[9].historical_author_count == 0.0 and r[2].historical_author_count == 2.0


def test_empty_works(spark):
    none = spark.createDataFrame([], WORK)
    for f in (history.topic_dynamics, history.author_dynamics, history.topic_domain, history.source_history, labels.emergence_label):
        assert f(none).count() == 0


def test_golden_labels(spark):
    r = {x.pub_year: x for x in labels.label_rates(tables.line_works(spark, "/root/testdata/sf0.01")).collect()}
    assert {y: x.positives for y, x in r.items()} == {1995: 1209, 1996: 1140, 1997: 1032, 1998: 1044, 1999: 1025, 2000: 1081, 2001: 0}
    assert {y: x.works for y, x in r.items()} == {1995: 8840, 1996: 8931, 1997: 8715, 1998: 8900, 1999: 8589, 2000: 8762, 2001: 7263}


def test_golden_means(spark):
    works = tables.works(spark, "/root/testdata/sf0.01").persist()
    found = build_features(works, label=False)
    want = {"ppmi_domain_score": 0.144060, "topic_domain_rarity": 0.436724, "domain_history_count": 1280.361067, "topic_domain_age_years": 2.823667, "source_history_count": 5.258333, "topic_source_diversity": 56.8208, "topic_publication_growth": 0.749961, "topic_growth_acceleration": -0.003235, "author_growth_rate": 0.744338, "historical_author_count": 82.1562}
    means = found.agg(*(F.avg(c).alias(c) for c in want)).first()
    assert {c: round(means[c], 6) for c in want} == want
    works.unpersist()


def test_population_growth(spark):
    counts = {2008: 1, 2009: 1, 2010: 1, 2011: 900, 2012: 900, 2013: 4, 2014: 4, 2015: 4, 2016: 900}
    rows = spark.createDataFrame([(1, y, n) for y, n in counts.items()], "topic_id int, pub_year int, n int")
    r = {x.pub_year: x.future_growth_ratio for x in labels.population_growth(rows).collect()}
    assert r[2010] == pytest.approx(4)


def test_new_authors(spark):
    rows = spark.createDataFrame([(1, "2014", ["A1"]), (1, "2000", ["A1"]), (1, "2013", ["A2", "A2"])], "topic_id int, pub_year string, authors_ids array<string>")
    assert {r.pub_year: r.authors for r in labels.new_authors(rows).collect()} == {2000: 1, 2013: 1}


def test_citations(spark):
    schema = "doc_id int, pub_year int, counts_by_year string, referenced_works_ids string"
    good = '[{"year": 2019, "cited_by_count": 1}, {"year": 2020, "cited_by_count": 9}, {"year": 2020, "cited_by_count": 3}, {"year": 2021, "cited_by_count": 50}]'
    df = spark.createDataFrame([(1, 2020, good, '["a", "b"]'), (2, 2020, "not json", "not json"), (3, None, good, None), (4, 2020, None, "[]")], schema)
    r = by_id(citations.reference_features(citations.citation_features(df)))
    assert (r[1].citation_velocity, r[1].citation_acceleration, r[1].reference_count, r[1].has_reference_list) == (4.0, 1.0, 2.0, 1)
    for k in (2, 3, 4):
        assert (r[k].citation_velocity, r[k].citation_acceleration, r[k].reference_count, r[k].has_reference_list) == (0.0, 0.0, 0.0, 0)


def test_text_geometry_means(spark):
    found = text_geometry.text_geometry(tables.vectors(spark, "/root/testdata/sf0.01"))
    want = {"novelty_raw": 0.997419, "cluster_density": 0.199463, "nearest_topic_similarity": 0.159831, "cross_topic_gap": -0.157249}
    means = found.agg(*(F.avg(c).alias(c) for c in want)).first()
    assert {c: round(means[c], 6) for c in want} == want


def test_text_geometry_without_topic(spark):
    rows = [(1, 1, 2020, [1.0, 0.0]), (2, 2, 2020, [0.0, 1.0]), (3, None, 2021, [1.0, 0.0]), (4, 1, None, [1.0, 0.0]), (5, 1, 2021, [0.6, 0.8])]
    r = by_id(text_geometry.text_geometry(spark.createDataFrame(rows, "doc_id int, topic_id int, pub_year int, vector array<double>")))
    assert (r[3].novelty_raw, r[3].nearest_topic_similarity) == (1.0, 1.0)
    assert (r[4].novelty_raw, r[4].nearest_topic_similarity, r[4].is_outlier_cluster) == (1.0, 0.0, 0)
    assert (round(r[5].topic_centroid_similarity, 6), round(r[5].nearest_topic_similarity, 6), round(r[5].cross_topic_gap, 6)) == (0.6, 0.8, -0.2)


def test_allocation(spark):
    df = spark.createDataFrame([(str(y), 1) for y in range(2010, 2027)], "key string, weight long")
    quota = {r.key: r.quota for r in sampling.allocate(df, 1_000_000).collect()}
    assert sum(quota.values()) == 1_000_000 and set(quota.values()) == {58823, 58824}


def test_strata(spark):
    def planned(works, total):
        rows = [(2020, d, n, 10 if d == "3" else 0) for d, n in works.items()]
        return sampling.strata(spark.createDataFrame(rows, "year int, domain string, works long, engineering long"), total).orderBy("stratum").collect()

    plan = planned({"1": 100, "2": 100, "3": 100, "4": 100}, 40)
    assert [(p.stratum, p.quota, p.population) for p in plan] == [("2020-1", 10, 100), ("2020-2", 10, 100), ("2020-3-engineering", 3, 10), ("2020-3-other", 7, 90), ("2020-4", 10, 100)]
    assert all(p.enough for p in plan)
    assert [p.enough for p in planned({"1": 1, "3": 20}, 300)] == [False, False, False]


def test_repeated_keys_fill_a_quota(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("k"), F.lit("s").alias("a.b"), F.col("id").alias("row"), F.lit(1).alias("rank"))
    got = sampling.quota_sample(rows, "a.b", "k", spark.createDataFrame([("s", 500)], "`a.b` string, quota long"))
    assert got.columns == rows.columns and got.count() == 500 and got.select("k").distinct().count() == 1
    copies = rows.select("k", F.lit("s").alias("s"))
    assert sampling.quota_sample(copies, "s", "k", spark.createDataFrame([("s", 150_001)], "s string, quota long")).count() == 150_001
    assert sampling.seeded_subsample(rows, "k", 77).count() == 77 and sampling.seeded_subsample(rows.limit(5), "k", 77).count() == 5
    assert sampling.seeded_subsample(rows.limit(0), "k", 7).count() == 0


def test_null_targets_keep_their_rows(spark):
    rows = spark.range(100).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("id"), F.when(F.col("id") % 5 != 0, F.col("id") % 2).alias("y"))
    got = sampling.exact_stratified_split(rows, "y", "id", {"a": 0.5, "b": 0.5})
    assert got.count() == 100
    assert {(r.y, r.split): r["count"] for r in got.groupBy("y", "split").count().collect()} == {(k, s): n for k, n in ((None, 10), (0, 20), (1, 20)) for s in "ab"}


def test_sample_is_the_least_by_hash(spark):
    import hashlib

    rows = spark.range(5000).select(F.col("id"), F.lit(0).alias("s"))
    got = {r.id for r in sampling.quota_sample(rows, "s", "id", spark.createDataFrame([(0, 123)], "s int, quota long")).collect()}
    assert got == set(sorted(range(5000), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())[:123])


def test_quantiles_and_sums(spark):
    rng = np.random.default_rng(1)
    data = [(g, float(v)) for g in "ab" for v in rng.integers(0, 40, 301)]
    counts = spark.createDataFrame(data, "g string, v double").groupBy("g", "v").count().withColumnRenamed("count", "n").repartition(3)
    members = spark.createDataFrame([("a", "a"), ("both", "a"), ("both", "b")], "w string, g string")
    got = {(r.w, r.share): r.value for r in ranks.quantiles(counts, members, [0.0, 0.3, 0.95, 1.0]).collect()}
    for w, groups in (("a", "a"), ("both", "ab")):
        values = [v for g, v in data if g in groups]
        assert {q: got[w, q] for q in (0.0, 0.3, 0.95, 1.0)} == pytest.approx({q: float(np.quantile(values, q)) for q in (0.0, 0.3, 0.95, 1.0)})
    assert ranks.quantiles(counts.limit(0), members, [0.5]).count() == 0
    odd = spark.createDataFrame([(1, 2, 3), (1, 5, 4), (2, 7, 5)], "at int, part int, `a.b` int")
    assert sorted(map(tuple, ranks.cumulative(odd, "at", ["a.b"]).collect())) == [(1, 2, 3, 7), (1, 5, 4, 7), (2, 7, 5, 12)]


def test_describe_keeps_empty_columns(spark):
    r = {x.name: x for x in quality.describe(spark.createDataFrame([(1.0, None), (float("nan"), None), (4.0, None)], "a double, b double"), "a", "b").collect()}
    assert (r["a"].n, r["a"].median, r["a"].outliers) == (2, 2.5, 0) and (r["b"].n, r["b"].median, r["b"].outliers) == (0, None, 0)


def test_text_features_take_history_only(spark):
    works = tables.topic_works(spark, "/root/testdata/sf0.001").withColumns({"source_id": F.lit(1), "authors_ids": F.array(F.lit(1)), "referenced_works_ids": F.array(F.lit(1)), "counts_by_year": F.lit("[]"), "commercial_maturity_index": F.lit(0.0)})
    vectors = works.select("doc_id", F.array(F.lit(0.6), F.lit(0.8)).alias("vector"))
    found = build_features(works, F.lit(False), vectors, label=False)
    names = ("topic_centroid_similarity", "cluster_density", "topic_local_volume", "nearest_topic_similarity", "cross_topic_gap", "is_outlier_cluster", "topic_historical_volume")
    r = found.agg(F.min("novelty_raw").alias("novelty"), *(F.sum(F.abs(c)).alias(c) for c in names)).first()
    assert r.novelty == 1.0 and [r[c] for c in names] == [0.0] * len(names)
    assert build_features(works, None, vectors, label=False).agg(F.min("novelty_raw")).first()[0] < 0.1


def test_geometry_in_pieces(spark, monkeypatch):
    """Many parts and blocks give what one gives."""
    works = tables.vectors(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted((r.doc_id, *(round(x, 9) for x in r[3:])) for r in df.collect())
    whole = key(text_geometry.text_geometry(works))
    monkeypatch.setattr(text_geometry, "BLOCK_TOPICS", 2)
    monkeypatch.setattr(text_geometry, "PART_WORKS", 7)
    monkeypatch.setattr(text_geometry, "SUM_WORKS", 3)
    assert key(text_geometry.text_geometry(works)) == whole


def test_hashed_texts_against_loops(spark):
    """Sparse vectors of texts, held against dense loops over all pairs of works and centroids."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa the of".split()
    rows = [(i, i % 4 if i % 9 else None, 2018 + i % 5 if i % 11 else None, " ".join(words[(i * j + j * j) % len(words)] for j in range(1, 2 + i % 7)) if i % 13 else None) for i in range(90)]
    works = text_geometry.hashed_vectors(spark.createDataFrame(rows, "doc_id int, topic_id int, pub_year int, text string"))
    assert works.schema["vector"].dataType.simpleString() == text_geometry.SPARSE.simpleString()
    got = by_id(text_geometry.text_geometry(works))
    dense = {}
    for r in works.collect():
        v = np.zeros(text_geometry.BUCKETS)
        v[r.vector.i] = r.vector.x
        assert abs(v @ v - bool(r.vector.i)) < 1e-9 and len(r.vector.i) <= 7
        dense[r.doc_id] = (r.topic_id, r.pub_year, v)
    placed = {y for t, y, _ in dense.values() if t is not None and y is not None}
    for i, (topic, year, v) in dense.items():
        past = {}
        for t, y, w in dense.values():
            if t is not None and y is not None and year is not None and y < year:
                past.setdefault(t, []).append(w)
        mean = {t: np.mean(ws, axis=0) for t, ws in past.items()}
        norm = {t: np.linalg.norm(m) for t, m in mean.items() if np.linalg.norm(m) > 1e-12} if year in placed else {}
        sims = {t: float(v @ mean[t]) / norm[t] for t in norm}
        own = sims.get(topic, 0.0)
        others = [s for t, s in sims.items() if t != topic]
        nearest = max(others) if others and len(norm) >= 2 else 0.0
        assert abs(got[i].novelty_raw - (1 - own if topic in sims else 1)) < 1e-9 and abs(got[i].nearest_topic_similarity - nearest) < 1e-9
        assert abs(got[i].topic_centroid_similarity - own) < 1e-9 and got[i].topic_local_volume == (len(past.get(topic, [])) if topic is not None else 0)


def test_sums_follow_the_entries(spark):
    """What leaves a centroid's exchange are entries, not dimensions."""
    rows = [(i, i % 3, 2018 + i % 2, [0.0] * 500 + [1.0]) for i in range(40)]
    works = spark.createDataFrame(rows, "doc_id int, topic_id int, pub_year int, v array<double>").select("doc_id", "topic_id", "pub_year", text_geometry.sparse(F.col("v")).alias("vector"))
    found = text_geometry.past_centroids(works).collect()
    assert len(found) == 3 and all(r.centroid.i == [500] and r.norm == 1.0 for r in found)


def test_quota_sample_is_exact(spark):
    rows = spark.range(20000).select(F.col("id"), (F.col("id") % 3).alias("s"))
    quotas = spark.createDataFrame([(0, 150), (1, 7000), (2, 1)], "s long, quota long")
    got = sampling.quota_sample(rows, "s", "id", quotas)
    assert {r.s: r["count"] for r in got.groupBy("s").count().collect()} == {0: 150, 1: 6667, 2: 1}


def test_splits(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    exact = sampling.exact_stratified_split(rows, "y", "id", {"train": 0.7, "valid": 0.15, "test": 0.15})
    assert {(r.y, r.split): r["count"] for r in exact.groupBy("y", "split").count().collect()} == {(0, "train"): 1890, (0, "valid"): 405, (0, "test"): 405, (1, "train"): 210, (1, "valid"): 45, (1, "test"): 45}
    loose = sampling.stratified_split(rows, "y", "id", {"train": 0.7, "valid": 0.15, "test": 0.15})
    assert 1900 < loose.where("split = 'train'").count() < 2300


def test_dedup(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "id string, pos int, v string")
    assert sorted(map(tuple, selection.first_position_last_value(rows, "id", "pos").collect())) == [("a", 1, "z"), ("b", 2, "y")]
    assert sorted(map(tuple, selection.keep_first(rows, "id", "pos").collect())) == [("a", 1, "x"), ("b", 2, "y")]
    assert selection.subset_of(rows.where("id = 'a'"), rows, "id") and not selection.subset_of(rows, rows.where("id = 'a'"), "id")
    assert selection.keep_top_share(rows.limit(1), "pos", "id").count() == 1


def test_diverse_top(spark):
    rows = spark.createDataFrame([(0, 99.0, "a", [1.0, 0.0]), (1, 98.0, "b", [0.99, 0.01]), (2, 90.0, "c", [0.0, 1.0]), (3, 89.0, " C ", [0.0, -1.0])], "doc_id int, confidence double, text string, vector array<double>")
    got = selection.diverse_top(rows, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.diversity_max_similarity) for r in got] == [(0, 0.0), (2, 0.0)]
    assert [r.doc_id for r in selection.diverse_top(rows, 9).orderBy("rank").collect()] == [0, 2]
    with pytest.raises(ValueError):
        selection.diverse_top(rows, 2, 1.5)


def test_relevant_diverse_top(spark):
    rows = spark.createDataFrame([(i, 100.0 - i, f"t{i}", "a", [float(i == j) for j in range(50)]) for i in range(50)], "doc_id int, confidence double, title string, abstract string, vector array<double>")
    asked = []

    def judge(query, works):
        asked.append(len(works))
        return [w["id"] for w in works if w["id"] % 2] + [999]

    assert selection.relevant_diverse_top(rows, judge, "q", limit=12) == list(range(1, 24, 2))
    assert asked == [20, 20]


@pytest.mark.parametrize("ties", [False, True])
def test_metrics_against_loops(spark, ties):
    rng = np.random.default_rng(3)
    y = (rng.random(300) < 0.3).astype(int)
    s = np.round(rng.random(300) + 0.4 * y, 1 if ties else 6)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    ap = sum(((s >= t) & (y == 1)).sum() / (s >= t).sum() * ((s == t) & (y == 1)).sum() for t in np.unique(s)) / y.sum()
    assert metrics.average_precision(df).first()[0] == pytest.approx(ap)
    table = {r.threshold: r for r in metrics.threshold_table(df).collect()}
    assert len(table) == len(np.unique(s))
    best = max(table.values(), key=lambda r: (r.f1, -r.threshold))
    assert metrics.best_threshold(df) == best.threshold


def test_threshold_points(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("y"), F.col("id").cast("double").alias("score"))
    got = [r.threshold for r in metrics.threshold_table(df, points=100).orderBy("threshold").collect()]
    assert got == [float(i) for i in np.linspace(0, 4999, 100, dtype=int)]


def test_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, score double")
    assert metrics.roc_auc(df).first()[0] is None and metrics.threshold_table(df).count() == 0


def test_validate(spark):
    row = [("W1", 2021, "1", "text", None)]
    schema = "doc_id string, pub_year int, domain_id string, abstract_text string, target_emergence int"
    r = quality.validate_corpus(spark.createDataFrame(row, schema), 2020, 1).first()
    assert r.passed and r.rows == 1
    r = quality.validate_corpus(spark.createDataFrame([*row, ("W1", 2022, "1", "", 1)], schema), 2020).first()
    assert (r.passed, r.duplicate_doc_ids, r.null_abstract_text, r.invalid_future_targets) == (False, 1, 1, 1)


def test_chart(spark):
    def drawn(*counts):
        rows = spark.createDataFrame([(2020 + i, n) for i, n in enumerate(counts)], "year int, count int")
        return evidence.chart(rows, 70, 592, 35, 165).orderBy("year").collect()

    assert drawn(7)[0].ticks == [0, 2, 4, 6, 8] and drawn(13)[0].ticks == [0, 5, 10, 15]
    assert [(p.x, p.y) for p in drawn(0, 13)] == [(70, 165), (592, 52)]
    assert drawn(0)[0].ticks == [0, 1] and drawn(None)[0].y == 165 and drawn(41)[0].step == 20 and drawn() == []


def test_per_year(spark):
    works = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("glucose sensors").alias("title"), F.when(F.col("id") != 3, "x").alias("abstract_text"), (2020 + F.col("id") % 3).cast("int").alias("pub_year"), (F.col("id") % 2).alias("topic_id"))
    got = evidence.per_year(works, "glucose sensor", 0, (2020, 2021), 8)
    assert {(r.pub_year, r.total, r.exhaustive): r["count"] for r in got.groupBy("pub_year", "total", "exhaustive").count().collect()} == {(2020, 9, False): 8, (2021, 8, True): 8}


def test_evidence(spark):
    rows = [("W1", "Glucose sensors in implants", "sensor glucose implant", "https://a", None, [1.0, 0.0], 3), ("W2", "Glucose sensors implants", "x", "https://b", "d1", [0.9, 0.1], 5), ("W3", "Glucose sensors implants", "x", "https://c", "d1", [1.0, 0.05], 1), ("W4", "Other", "x", "https://d", None, [1.0, 0.0], 9), ("W5", "Glucose sensors implants", "x", "https://e", None, [0.0, 1.0], 9)]
    df = spark.createDataFrame(rows, "doc_id string, title string, abstract string, url string, doi string, vector array<double>, cited_by_count int")
    found = evidence.candidates(df, "Glucose sensors implants", [1.0, 0.0])
    assert {r.doc_id for r in found.collect()} == {"W1", "W2", "W3"}
    assert [r.doc_id for r in evidence.top_sources(found, "W1").collect()] == ["W3"]


def test_model(spark):
    rng = np.random.default_rng(0)
    data = [(i, 2020, float(a), float(b), "x" if c else None, int(a + 0.3 * c > 0.6)) for i, (a, b, c) in enumerate(zip(rng.random(400), rng.random(400), rng.random(400) > 0.5))]
    rows = model.model_input(spark.createDataFrame(data, "doc_id int, pub_year int, a double, b double, source_tier string, target_emergence int"))
    fitted = model.train(rows, iterations=4, depth=3)
    scored = model.score(rows, fitted, 0.4)
    assert metrics.roc_auc(scored.select(F.col("target_emergence").alias("y"), F.col("probability").alias("score"))).first()[0] > 0.95
    assert model.importances(fitted)[0][0] == "a"
    leaves = model.ensemble(fitted.stages[-1])
    x = np.array([r.features.toArray() for r in scored.limit(20).collect()])
    margin = np.array([float(fitted.stages[-1].predictRaw(r.features)[1]) for r in scored.limit(20).collect()]) / 2  # raw is twice the ensemble's sum or the sum
    phi = model.shapley(leaves, x).sum(axis=1)
    base = margin - phi if np.ptp(margin - phi) < 1e-6 else 2 * margin - phi
    assert np.ptp(base) < 1e-6  # contributions add up to the margin, but for one constant
    with pytest.raises(ValueError):
        model.model_input(rows, ["missing_feature"])


def test_shares(spark):
    rows = spark.createDataFrame([(1, 2025, 4.0, 2.0, 6.0, None, None), (2, 2025, 0.0, 0.0, 0.0, None, "t")], "doc_id int, pub_year int, topic_historical_volume double, topic_local_volume double, historical_author_count double, commercial_maturity_index double, source_tier string")
    r = by_id(model.model_input(rows))[1]
    assert (round(r.topic_historical_share, 4), round(r.topic_local_share, 4), round(r.historical_author_share, 4)) == (2.0, 1.0, 3.0)
    assert (r.commercial_maturity_index, r.source_tier, r.split) == (-1.0, "missing", "inference")


def test_recovery(spark):
    works = spark.createDataFrame([("W1", "Glucose monitoring", "implant sensor", 2020, ["r"]), ("W2", "Optics", "implant of lenses", 2020, ["r"])], "doc_id string, title string, abstract_text string, pub_year int, referenced_works_ids array<string>")
    search = providers.TableSearch(works)
    assert [tuple(r) for r in providers.recover_seeds("implant glucose sensor", [2020], search, spark).collect()] == [("W1", 0)]
    budget = providers.TimeBudget(0)
    assert providers.recover_seeds("implant glucose sensor", [2020], search, spark, budget=budget).count() == 0 and budget.partial
    assert providers.searches(spark, "a b c") == [("a b c", False), ("a b", True), ("a b", False), ("a", True), ("a", False)]
    found, total = search.by_topic(None, 1, [2020]) if "topic_id" in works.columns else providers.TableSearch(works.withColumn("topic_id", F.lit(5))).by_topic(5, 1, [2020])
    assert found.count() == 1 and total == 2
    assert [tuple(r) for r in providers.TableSearch(works.withColumn("topic_id", F.lit(5))).count_by_year(5).collect()] == [(2020, 2)]


class Reply:
    def __init__(self, status=200, left=None):
        self.status, self.headers, self.body = status, {} if left is None else {"x-ratelimit-remaining": str(left)}, {"status": status}


def client(*replies, **options):
    waits, left = [], list(replies)

    def call(url, params):
        answer = left.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    return providers.RateLimitedClient(call, sleep=waits.append, clock=lambda: 0.0, **options), waits


def test_client_tries_again():
    c, waits = client(OSError(), Reply(503), Reply(), rate=10, quota=3)
    assert c.get("u") == {"status": 200} and 1 in waits and 2 in waits
    with pytest.raises(providers.Paused):
        c.get("u")


@pytest.mark.parametrize("status", [401, 403, 429])
def test_client_pauses_when_refused(status):
    c, _ = client(Reply(status))
    with pytest.raises(providers.Paused):
        c.get("u")
    assert c.used == 1


def test_client_minds_what_is_left():
    c, _ = client(Reply(left=10), Reply())
    c.get("u")
    with pytest.raises(providers.Paused):
        c.get("u")
    with pytest.raises(RuntimeError):
        client(Reply(404))[0].get("u")


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"a": 1}')
    (tmp_path / ".env").write_text("# keys\nexport OTHER_KEY='k'\n")
    monkeypatch.delenv("OTHER_KEY", raising=False)
    assert providers.configuration(str(tmp_path / "c.json"), "OTHER_KEY", str(tmp_path / ".env")) == {"a": 1, "api_key": "k"}
    assert providers.configuration(str(tmp_path / "c.json"), "OTHER_KEY")["api_key"] == ""


def test_small_sources(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "db") as db:
        db.execute("create table t (a int, b text)")
        db.execute("insert into t values (1, 'x')")
    assert [tuple(r) for r in providers.sqlite_table(spark, str(tmp_path / "db"), "select a, b from t", "a int, b string").collect()] == [(1, "x")]
    from signalloom.sources.committed import CommittedTable

    cache, asked = CommittedTable(spark, str(tmp_path / "cache")), []
    cache.append(spark.createDataFrame([(1, "old"), (3, "other")], "k int, v string"))

    def fetch(missing):
        asked.append(sorted(r.k for r in missing.collect()))
        return missing.withColumn("v", F.lit("new"))

    keys = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    for _ in range(2):  # what was fetched is kept
        assert sorted(map(tuple, providers.read_through(keys, cache, "k", fetch).collect())) == [(1, "old"), (2, "new")]
    assert asked == [[2]]
    assert tables.probe(spark, "/root/testdata/sf0.001/region.parquet") == (5, {"r_regionkey": "int", "r_name": "string"})
    assert texts.safe_name("  A b/C! ") == "a_b_c" and texts.safe_name("!!") == "query"


def test_rankers(spark):
    rng = np.random.default_rng(3)
    data = [(i, 2018 + i % 3, float(a), float(b), int(a > 0.7)) for i, (a, b) in enumerate(rng.random((600, 2)))]
    rows = model.model_input(spark.createDataFrame(data, "doc_id int, pub_year int, a double, b double, target_emergence int"))
    known, later = rows.where("pub_year < 2020"), rows.where("pub_year = 2020")
    ranker = model.train_ranker(known, most=60)
    positives = later.where("target_emergence = 1").count()
    for found in (ranker, model.train(known.withColumn("strength", F.col("target_emergence") * 2.0), "strength", iterations=4, depth=3, mode="regression")):
        best = model.rank_score(later, found).orderBy(F.desc("rank_score")).limit(positives)
        assert best.agg(F.avg("target_emergence")).first()[0] > 0.9
    pairs = model.training_pairs(model._finite(model.Pipeline(stages=model._assembly(known, "target_emergence", ())).fit(known).transform(known)), "pub_year", "doc_id", "target_emergence", 60)
    assert {r["count"] for r in pairs.groupBy("g").count().collect()} == {60}
    with pytest.raises(ValueError):
        model.train(known, mode="other")


def test_early_stop_and_weights(spark):
    rng = np.random.default_rng(4)
    data = [(i, 2020, float(a), int(rng.random() < 0.1), i % 4 == 0) for i, a in enumerate(rng.random(400))]
    rows = model.model_input(spark.createDataFrame(data, "doc_id int, pub_year int, a double, target_emergence int, held boolean"))
    stopped = model.train(rows.drop("held").withColumn("v", F.col("doc_id") % 4), iterations=20, depth=3, validation=F.col("doc_id") % 4 == 0, tolerance=0.05)
    assert len(stopped.stages[-1].trees) < 20
    plain, even = (model.train(rows.drop("held"), iterations=2, depth=2, balanced=b) for b in (False, True))
    mean = lambda m: model.score(rows.drop("held"), m).agg(F.avg("probability")).first()[0]
    assert mean(even) > mean(plain) + 0.1


def test_shap_report(spark):
    rows = spark.createDataFrame([([("a", 1.0, 0.5), ("b", 1.0, -2.0)],), ([("a", 1.0, -1.5), ("b", 1.0, 0.0)],)], "shap_values array<struct<feature: string, value: double, shap: double>>")
    assert {r.feature: r.mean_abs_shap for r in model.shap_report(rows).collect()} == {"a": 1.0, "b": 1.0}


def test_shards(spark, tmp_path):
    rows = spark.range(25).select(F.col("id"), F.lit("x").alias("v")).repartition(5)
    assert sinks.write_shards(rows, str(tmp_path / "s"), 10, "id") == 2
    assert sorted(p.name for p in (tmp_path / "s").glob("part-*")) == ["part-00000.parquet", "part-00001.parquet"]
    assert {r.id for r in spark.read.parquet(str(tmp_path / "s" / "part-00001.parquet")).collect()} == set(range(10, 20))
    assert sinks.write_shards(rows, str(tmp_path / "t"), 10, "id", whole_only=False) == 3


def test_reports_and_age(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "n int, s string")
    for kind in ("csv", "json"):
        sinks.write_report(rows, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0].s == "a" and spark.read.json(str(tmp_path / "json")).first().n == 1
    import os

    os.utime(tmp_path / "csv", (1, 1))
    assert sinks.newer(spark, str(tmp_path / "json"), str(tmp_path / "csv"), str(tmp_path / "nothing"))
    assert not sinks.newer(spark, str(tmp_path / "csv"), str(tmp_path / "json")) and not sinks.newer(spark, str(tmp_path / "nothing"))
    known = spark.createDataFrame([(1, "old", 0)], "k int, v string, o int")
    arrived = spark.createDataFrame([(1, "new", 1), (2, "b", 2), (2, "a", 1)], known.schema)
    assert sorted(tuple(r)[:2] for r in sinks.insert_new(known, arrived, "k", "o").collect()) == [(1, "old"), (2, "a")]


def test_workers_find_the_package(tmp_path):
    """Python stages run from another working folder."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
assert e.queries()["diverse_top15"](spark, "/root/testdata/sf0.001").count() > 0
assert e.queries()["vector_geometry"](spark, "/root/testdata/sf0.001").count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2019, 1), ("b", 2022, None)], "doc_id string, pub_year int, target_emergence int")
    manifest = sinks.export(rows, str(tmp_path / "out"), 2020)
    assert {r.name: r.rows for r in manifest.collect()} == {"full": 2, "inference": 1, "training": 1}
    sinks.write_versioned(rows, str(tmp_path / "v"))
    cached = spark.read.json(str(tmp_path / "v"))
    assert sinks.cache_is_ready(cached, rows, ["doc_id"], {"version": "1"}) and not sinks.cache_is_ready(cached, rows.limit(0), ["doc_id"], {"version": "1"})
    assert not sinks.cache_is_ready(cached, rows, ["nothing"], {"version": "1"})
    known = spark.createDataFrame([(1, "A", 2000)], "topic_id int, author string, first_year int")
    assert [tuple(r) for r in sinks.upsert_first_years(known, spark.createDataFrame([(1, "A", 1999)], known.schema)).collect()] == [(1, "A", 1999)]


def test_streaming_counts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2020"), (1, "2020"), (2, "x")], "topic_id int, pub_year string")
    rows.write.parquet(str(tmp_path / "in"))
    q = stream.maintain(stream.topic_year_counts(stream.arriving(spark, str(tmp_path / "in"), "topic_id int, pub_year string")), "stream_counts", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("stream_counts").collect()] == [(1, 2020, 2)]


def test_select_end_to_end(spark):
    works = tables.works(spark, "/root/testdata/sf0.001").persist()
    features = build_features(works).persist()
    fitted = model.train(model.model_input(features).where("pub_year <= 1997"), iterations=2, depth=2)
    articles = works.select("doc_id", F.concat(F.lit("title "), "doc_id").alias("title"), F.lit("text").alias("abstract"), F.lit("article").alias("work_type"), F.array(*(F.when(F.col("doc_id") % 20 == i, 1.0).otherwise(0.0) for i in range(20))).alias("vector"))
    got = score_and_select(features.where("pub_year > 1997"), fitted, articles, limit=5).collect()
    assert len(got) == 5 and all(r.shap_values for r in got)


def test_text_novelty_hashes_each_text_once(spark, sf_dir):
    """What it returns reads what was hashed, never the texts again; vectors never become dense."""
    assert not any("documents" in f for f in table_queries.text_novelty(spark, sf_dir).inputFiles())
    rows = text_geometry.hashed_vectors(spark.createDataFrame([(1, "Deep nets, deep seas"), (2, "the"), (3, None)], "doc_id long, text string"))
    assert "vector_to_array" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.vector.i, [round(x, 9) for x in r.vector.x]) for r in rows.collect()}
    assert got[2] == got[3] == ([], []) and sorted(got[1][1]) == [0.40824829, 0.40824829, 0.816496581] and got[1][0] == sorted(got[1][0])
