"""Raw works, as an API returns them, to rows of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import lenient_abstract, short_id, strict_abstract

#: The nested record of a work (a DDL schema).
RAW_WORK = (
    "id string, doi string, publication_year int, publication_date string, title string, type string, cited_by_count bigint, "
    "abstract_inverted_index map<string, array<int>>, "
    "primary_topic struct<id: string, display_name: string, domain: struct<id: string>, field: struct<id: string>>, "
    "topics array<struct<id: string, display_name: string>>, keywords array<struct<display_name: string>>, language string, "
    "primary_location struct<landing_page_url: string, source: struct<id: string, display_name: string, type: string>>, "
    "authorships array<struct<author: struct<id: string, display_name: string>, institutions: array<struct<display_name: string, type: string>>>>, "
    "referenced_works array<string>, counts_by_year array<struct<year: int, cited_by_count: bigint>>"
)


def source_tier(work_type: Column, source_type: Column) -> Column:
    """preprint or patent by the work, else conference or journal by its source, else other."""
    return F.when(work_type.isin("preprint", "patent"), work_type).when(source_type.isin("conference", "journal"), source_type).otherwise("other")


def _listed(a: Column) -> Column:
    return F.coalesce(F.size(F.filter(a, lambda x: F.coalesce(F.size(x["institutions"]), F.lit(0)) > 0)), F.lit(0))


def commercial_maturity(authorships: Column) -> Column:
    """Share of authorships with a company, if every one names institutions; else null."""
    company = F.filter(authorships, lambda x: F.coalesce(F.exists(x["institutions"], lambda i: i["type"] == "company"), F.lit(False)))
    n = F.size(authorships)
    return F.when((n > 0) & (_listed(authorships) == n), F.size(company) / n)


def affiliation_coverage(authorships: Column) -> Column:
    """Share of authorships that name institutions; null without authorships."""
    n = F.size(authorships)
    return F.when(n > 0, _listed(authorships) / n)


def author_ids(authorships: Column) -> Column:
    """Distinct short ids of authors, in order."""
    ids = F.transform(F.coalesce(authorships, F.array()), lambda x: short_id(x["author"]["id"]))
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))


def affiliations(authorships: Column) -> Column:
    """Distinct names of institutions, sorted."""
    names = F.flatten(F.transform(authorships, lambda x: F.coalesce(F.transform(x["institutions"], lambda i: i["display_name"]), F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != ""))))


_AUTHORSHIPS = "array<struct<institutions: array<struct<display_name: string, type: string>>>>"


def company_names(authorships_json: Column, limit: int = 4) -> Column:
    """The first distinct companies (whatever their case) of a JSON list of authorships."""
    entries = F.coalesce(F.from_json(authorships_json, _AUTHORSHIPS), F.array().cast(_AUTHORSHIPS))
    institutions = F.flatten(F.transform(F.filter(entries, lambda x: x["institutions"].isNotNull()), lambda x: x["institutions"]))
    named = F.filter(institutions, lambda i: F.coalesce((F.lower(i["type"]) == "company") & (F.trim(i["display_name"]) != ""), F.lit(False)))
    names = F.transform(named, lambda i: F.trim(i["display_name"]))
    first = F.filter(names, lambda x, k: F.array_position(F.transform(names, F.lower), F.lower(x)) == k + 1)
    return F.slice(first, 1, limit)


def corpus_rows(raw: DataFrame, start_year: int, end_year: int, training_end_year: int, stratum: str = "") -> DataFrame:
    """Rows of a corpus from raw works; works without id, whole abstract, references, topic or a
    year in the range are left out."""
    topic, place = F.col("primary_topic"), F.col("primary_location.source")
    abstract = strict_abstract(F.col("abstract_inverted_index"))
    references = F.transform(F.filter(F.coalesce("referenced_works", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), short_id)
    year = F.col("publication_year")
    rows = raw.withColumns({"__abstract": abstract, "__references": references})
    sound = (F.length("__abstract") > 0) & (F.col("id") != "") & year.between(start_year, end_year) & (F.size("__references") > 0) & (topic["id"] != "")
    early = year <= training_end_year
    return rows.where(sound).select(
        short_id(F.col("id")).alias("doc_id"),
        year.alias("pub_year"),
        F.col("publication_date").alias("pub_date"),
        "title",
        F.col("__abstract").alias("abstract_text"),
        source_tier(F.col("type"), place["type"]).alias("source_tier"),
        topic["display_name"].alias("primary_topic"),
        short_id(topic["id"]).alias("primary_topic_id"),
        short_id(topic["domain"]["id"]).alias("domain_id"),
        short_id(topic["field"]["id"]).alias("field_id"),
        author_ids(F.col("authorships")).alias("authors_ids"),
        F.coalesce(affiliations(F.col("authorships")), F.array().cast("array<string>")).alias("affiliations"),
        F.col("cited_by_count").alias("citations_at_cutoff"),
        F.col("__references").alias("referenced_works_ids"),
        F.to_json("counts_by_year").alias("counts_by_year"),
        F.to_json("authorships").alias("authorships_json"),
        F.to_json("topics").alias("topics_json"),
        place["id"].alias("source_id"),
        "doi",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"),
        F.lit(stratum).alias("stratum"),
        F.coalesce(short_id(topic["field"]["id"]) == "22", F.lit(False)).alias("is_engineering"),
        commercial_maturity(F.col("authorships")).alias("commercial_maturity_index"),
        affiliation_coverage(F.col("authorships")).alias("affiliation_coverage"),
        F.lit(1).alias("has_ref_data"),
        F.lit(None).cast("int").alias("target_emergence"),
        F.when(early, "pending").otherwise("future_window_incomplete").alias("target_status"),
        F.when(early, "train_candidates").otherwise("inference").alias("split"),
    )


def search_rows(raw: DataFrame) -> DataFrame:
    """Flat rows of works found by a search: lenient abstracts, topics and keywords as lists."""
    source = F.col("primary_location.source")
    return raw.select(
        short_id(F.col("id")).alias("doc_id"),
        F.col("publication_year").alias("pub_year"),
        F.col("publication_date").alias("pub_date"),
        "title",
        lenient_abstract(F.col("abstract_inverted_index")).alias("abstract_text"),
        F.col("type").alias("work_type"),
        "language",
        F.transform("topics", lambda t: t["display_name"]).alias("topics"),
        F.transform("keywords", lambda t: t["display_name"]).alias("keywords"),
        short_id(F.col("primary_topic.id")).alias("primary_topic_id"),
        source_tier(F.col("type"), source["type"]).alias("source_tier"),
        source["id"].alias("source_id"),
        F.col("primary_location.landing_page_url").alias("article_url"),
        "doi",
        author_ids(F.col("authorships")).alias("authors_ids"),
        F.coalesce(affiliations(F.col("authorships")), F.array().cast("array<string>")).alias("affiliations"),
        commercial_maturity(F.col("authorships")).alias("commercial_maturity_index"),
        affiliation_coverage(F.col("authorships")).alias("affiliation_coverage"),
        F.coalesce(F.transform("referenced_works", short_id), F.array().cast("array<string>")).alias("referenced_works_ids"),
        F.to_json("counts_by_year").alias("counts_by_year"),
        F.col("cited_by_count").alias("citations_at_cutoff"),
    )


def inference_rows(raw: DataFrame, query: str, source_ids: Column | None = None) -> DataFrame:
    """Rows of the corpus' schema for works that a search found for a query: all raw works stay,
    also those without abstract or references; nothing about their future is known."""
    topic, place = F.col("primary_topic"), F.col("primary_location.source")
    field = short_id(topic["field"]["id"])
    named = F.coalesce("authorships", F.array().cast(dict(raw.dtypes)["authorships"]))
    references = F.transform(F.filter(F.coalesce("referenced_works", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), short_id)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    return raw.select(
        short_id(F.col("id")).alias("doc_id"),
        F.col("publication_year").alias("pub_year"),
        F.col("publication_date").alias("pub_date"),
        "title",
        lenient_abstract(F.col("abstract_inverted_index")).alias("abstract_text"),
        F.col("type").alias("work_type"),
        source_tier(F.col("type"), place["type"]).alias("source_tier"),
        topic["display_name"].alias("primary_topic"),
        short_id(topic["id"]).alias("primary_topic_id"),
        short_id(topic["domain"]["id"]).alias("domain_id"),
        field.alias("field_id"),
        author_ids(named).alias("authors_ids"),
        F.coalesce(affiliations(named), F.array().cast("array<string>")).alias("affiliations"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citations_at_cutoff"),
        references.alias("referenced_works_ids"),
        F.coalesce(F.to_json("counts_by_year"), F.lit("[]")).alias("counts_by_year"),
        F.to_json(named).alias("authorships_json"),
        F.coalesce(F.to_json("topics"), F.lit("[]")).alias("topics_json"),
        (place["id"] if source_ids is None else source_ids).alias("source_id"),
        "doi",
        F.col("primary_location.landing_page_url").alias("article_url"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"),
        F.lit(query).alias("stratum"),
        F.coalesce(field == "22", F.lit(False)).alias("is_engineering"),
        commercial_maturity(named).alias("commercial_maturity_index"),
        affiliation_coverage(named).alias("affiliation_coverage"),
        (F.size(references) > 0).cast("int").alias("has_ref_data"),
        *none("int", "target_emergence"),
        F.lit("inference").alias("target_status"),
        *none("int", "target_population"),
        F.lit("inference").alias("split"),
        *none("bigint", "new_authors_baseline", "new_authors_future"),
        *none("double", "future_growth_ratio", "new_authors_growth_ratio"),
    )


def article_link(article_url: Column, doi: Column, doc_id: Column) -> Column:
    """The first web address of: the article's page, its DOI, the DOI under doi.org, its entry."""
    web = lambda x: F.when(x.rlike("^https?://"), x)
    return F.coalesce(web(article_url), web(doi), F.when(F.trim(doi).startswith("10."), F.concat(F.lit("https://doi.org/"), F.trim(doi))), F.concat(F.lit("https://openalex.org/"), doc_id))


def display_value(x: Column) -> Column:
    return F.when(x.isNull() | (F.trim(x) == ""), "None").otherwise(x)


def split_label(year: Column, roles: dict[str, tuple[int, ...]], training_end_year: int) -> Column:
    """The role of a year: the first of roles that lists it, else by the last training year."""
    names = {"past_support_only": "past_support", "train": "train_candidates", "valid": "valid_candidates", "test": "test_candidates", "target_support_only": "target_support"}
    out = F.when(F.lit(False), "")
    for role, name in names.items():
        out = out.when(year.isin(*roles.get(role, ())), name)
    return out.when(year <= training_end_year, "train_candidates").otherwise("inference")


def target_status(year: Column, roles: dict[str, tuple[int, ...]], training_end_year: int) -> Column:
    return (
        F.when(year.isin(*roles.get("past_support_only", ())), "past_support_only")
        .when(year.isin(*roles.get("target_support_only", ())) | (year > training_end_year), "future_window_incomplete")
        .otherwise("pending")
    )
