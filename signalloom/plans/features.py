"""All features of a corpus in one plan, and what follows from them: scores and a diverse top list."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_review
from ..operators import citations, history, labels, model, selection, text_geometry

#: The columns of a feature row, in order.
META = ("doc_id", "pub_year", "topic_id", "domain_id", "source_id", "source_tier", "commercial_maturity_index")


def build_features(works: DataFrame, is_history: Column | None = None, vectors: DataFrame | None = None, label: bool = True) -> DataFrame:
    """works with the topic, author, graph, source, reference and citation features; with
    ``vectors`` (doc_id, vector) those of the text; with ``label`` target_emergence. All features,
    those of the text too, take their past from the rows of ``is_history`` only.

    Each step counts the works by key and year and joins those small tables; only the text
    features meet vectors. works is read several times: pass a table, or a persisted frame.
    """
    found = citations.citation_features(citations.reference_features(works))
    found = history.topic_dynamics(works, is_history, found)
    found = history.author_dynamics(works, is_history, found)
    found = history.topic_domain(works, is_history, found)
    found = history.source_history(works, is_history, found)
    if vectors is not None:
        placed = works.select("doc_id", "topic_id", "pub_year", history.history_rows(is_history).alias("__past")).join(vectors, "doc_id")
        geometry = text_geometry.text_geometry(placed, F.col("__past")).drop("topic_id", "pub_year")
        found = found.join(geometry, "doc_id", "left")
    else:
        found = history.topic_local_volume(works, is_history, found)
    if label:
        marked = labels.emergence_label(works.select("doc_id", "topic_id", "pub_year")).select("doc_id", "target_emergence")
        found = found.join(marked, "doc_id")
    return found.drop("authors_ids", "referenced_works_ids", "counts_by_year")


def score_and_select(features: DataFrame, classifier: PipelineModel, articles: DataFrame, threshold: float = 0.5, limit: int = 15) -> DataFrame:
    """Up to ``limit`` articles (doc_id, title, abstract, work_type, vector) by confidence, without
    reviews, mutually dissimilar, with each one's confidence and contributions."""
    scored = model.score(model.model_input(features), classifier, threshold).select("doc_id", "model_confidence", "features")
    known = articles.where(~is_review(F.col("title"), F.col("work_type"), F.col("abstract")))
    text = F.concat_ws(" ", "title", "abstract")
    ranked = scored.join(known, "doc_id").select("doc_id", F.col("model_confidence").alias("confidence"), text.alias("text"), "vector", "features")
    chosen = selection.diverse_top(ranked, limit)
    return chosen.join(scored.select("doc_id", "features"), "doc_id").select(*chosen.columns, model.contributions(classifier, F.col("features")).alias("shap_values"))
