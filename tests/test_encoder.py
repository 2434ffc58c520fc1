"""The learned encoder against a dense decomposition."""

import numpy as np
import pytest

from signalloom.operators import encoder
from signalloom.sources import tables


def dense(spark, rows, terms):
    counts = encoder._counts(rows, "text", terms).select("__counts").collect()
    x = np.zeros((len(counts), terms))
    for k, r in enumerate(counts):
        x[k, r[0].i] = r[0].x
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    x = x * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def test_directions_are_those_of_the_dense_matrix(spark):
    rows = tables.text_works(spark, "/root/testdata/sf0.001").selectExpr("abstract_text as text").repartition(3).persist()
    found = encoder.fit_encoder(rows, "text", size=8, terms=256, passes=6)
    x = dense(spark, rows, 256)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(found.singular, s[:8], rtol=1e-3)
    # the angle between the leading subspaces
    overlap = np.linalg.svd(found.directions[:, :5].T @ v[:8].T)[1]
    assert overlap.min() > 0.99
    assert np.allclose(found.directions.T @ found.directions, np.eye(8), atol=1e-8)


def test_neighbours_by_code_are_those_by_terms(spark):
    """Of each text's nearest five by all terms, how many its code finds among its own nearest ten."""
    rows = tables.text_works(spark, "/root/testdata/sf0.001").where("length(abstract_text) > 300").selectExpr("doc_id", "abstract_text as text").persist()
    fitted = encoder.fit_encoder(rows, "text", size=64, terms=1024)
    codes = np.array([r.vector for r in fitted.encode(rows, "text").orderBy("doc_id").collect()])
    x = dense(spark, rows.orderBy("doc_id"), 1024)
    assert np.allclose(np.linalg.norm(codes, axis=1), 1)
    full, coded = x @ x.T, codes @ codes.T
    for m in (full, coded):
        np.fill_diagonal(m, -2)
    hits = [len(set(np.argsort(-f)[:5]) & set(np.argsort(-c)[:10])) / 5 for f, c in zip(full, coded)]
    assert np.mean(hits) >= 0.7


def test_odd_texts(spark):
    rows = spark.createDataFrame([(1, "alpha beta beta"), (2, None), (3, ""), (4, "gamma alpha"), (5, "the of")], "id int, `te.xt` string")
    fitted = encoder.fit_encoder(rows, "te.xt", size=4, terms=64)
    found = {r.id: r.vector for r in fitted.encode(rows, "te.xt").collect()}
    assert found[2] == found[3] == found[5] == [0.0] * 4
    assert abs(np.linalg.norm(found[1]) - 1) < 1e-9 and (fitted.singular[2:] < 1e-6).all()
    assert fitted.encode(rows.limit(0), "te.xt").count() == 0
    assert encoder.fit_encoder(rows.limit(0), "te.xt", size=2, terms=8).singular.tolist() == [0.0, 0.0]
    with pytest.raises(ValueError):
        encoder.fit_encoder(rows, "te.xt", size=9, terms=8)
