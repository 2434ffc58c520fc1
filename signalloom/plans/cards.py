"""Result cards: the chosen works with what is shown of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import article_link, company_names, display_value
from ..operators.selection import keep_first_join


def cards(chosen: DataFrame, corpus: DataFrame) -> DataFrame:
    """chosen (doc_id, rank, confidence), at most a few rows, with slug, title, source, date, link
    and companies from the first corpus row (doc_id, row, title, pub_date, source_tier,
    article_url, doi, authorships_json) of each."""
    wanted = corpus.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    shown = keep_first_join(chosen, wanted, "doc_id", "row")
    return shown.select(
        "doc_id",
        "rank",
        F.concat(F.lit("result-"), F.col("rank").cast("string")).alias("slug"),
        "confidence",
        display_value(F.col("title")).alias("title"),
        display_value(F.col("pub_date")).alias("date"),
        display_value(F.col("source_tier")).alias("source"),
        article_link(F.col("article_url"), F.col("doi"), F.col("doc_id")).alias("link"),
        company_names(F.col("authorships_json")).alias("companies"),
    )
