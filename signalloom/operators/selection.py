"""Deduplication, top lists and greedy selection. Every tie is broken by a column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import normal_space
from ..sources.scratch import holds_map, quoted, ship
from .ranks import cumulative


def _tie(rows: DataFrame, columns: list[str]) -> list[Column]:
    """The columns as something that can be ordered: those that hold a map as JSON."""
    return [F.to_json(F.struct(quoted(c))) if holds_map(rows.schema[c].dataType) else quoted(c) for c in columns]


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row of least order: an aggregate, so copies are reduced before the exchange.

    Rows without order come last, NaN just before them; rows of equal order go by their other
    columns. A null key is a key like any other."""
    rest = [c for c in rows.columns if c != key]
    ranked = F.struct(quoted(order).isNull(), quoted(order), *_tie(rows, [c for c in rest if c != order]))
    found = rows.groupBy(quoted(key).alias("key")).agg(F.min_by(F.struct(*map(quoted, rows.columns)), ranked).alias("row"))
    return found.select("row.*")


def first_position_last_value(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the last row, at the first one's position.

    A row without order is last only where all of its key are; rows of equal order go by their
    other columns."""
    rest = [c for c in rows.columns if c not in (key, order)]
    ranked = F.struct(quoted(order).isNotNull(), quoted(order), *_tie(rows, rest))
    found = rows.groupBy(quoted(key).alias("key")).agg(F.min(quoted(order)).alias("at"), F.max_by(F.struct(*map(quoted, rows.columns)), ranked).alias("row"))
    return found.select(*((F.col("at") if c == order else F.col("row").getField(c)).alias(c) for c in rows.columns))


def keep_first_join(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """left with the columns of the first right row of its key."""
    return left.join(keep_first(right, key, order).drop(order), key, "left")


def subset_of(left: DataFrame, right: DataFrame, key: str) -> bool:
    """Whether every key of left is one of right's."""
    return left.select(key).join(right.select(key), key, "left_anti").isEmpty()


def top_per_group(rows: DataFrame, group: str, score: Column, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(score.desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keep_top_share(rows: DataFrame, score: str, tie: str, remove: float = 0.15) -> DataFrame:
    """The best floor(n * (1 - remove)) rows, one at least; null and NaN scores come last, as one.

    The score at which they end follows from counts by score, so most rows pass a plain filter;
    only those of that very score are ordered by the tie."""
    number = F.col(score).cast("double")
    value = F.coalesce(F.when(~F.isnan(number), number), F.lit(float("-inf")))
    counts = rows.groupBy((-value).alias("down")).agg(F.count("*").alias("n")).persist()
    keep = max(1, int((counts.agg(F.sum("n")).first()[0] or 0) * (1 - remove)))
    edge = cumulative(counts, "down", ["n"]).where(F.col("cum_n") >= keep).orderBy("down").limit(1).first()
    counts.unpersist()
    if edge is None:
        return rows.limit(0)
    above = rows.where(value > -edge.down)
    return above.unionByName(rows.where(value == -edge.down).orderBy(tie).limit(keep - (edge.cum_n - edge.n)))


def relevance_floor(rows: DataFrame, score: str, seed: Column) -> DataFrame:
    """Rows at least as relevant as the least relevant seed; all rows if there is no seed."""
    least = rows.where(seed).agg(F.min(score).alias("__floor"))
    return rows.join(F.broadcast(least)).where(F.col("__floor").isNull() | (F.col(score) >= F.col("__floor"))).drop("__floor")


def discover_topics(works: DataFrame, topics: str = "topics") -> DataFrame:
    """(name, id, frequency) of the topics listed by works, in mentions; the first id stays.

    works has doc_id, the order of works, and topics, a list of (id, display_name)."""
    each = works.select("doc_id", F.posexplode(topics).alias("at", "topic"))
    return each.groupBy(F.col("topic.display_name").alias("name")).agg(F.min_by("topic.id", F.struct("doc_id", "at")).alias("id"), F.count("*").alias("frequency"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar_to(rows: DataFrame, vector: str, query: list[float], name: str = "similarity") -> DataFrame:
    """rows with the cosine to one query vector, a literal of the plan."""
    return rows.withColumn(name, cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query))))


def walk(texts: list[str], vectors: np.ndarray, limit: int, threshold: float) -> tuple[list[int], list[float]]:
    """Indexes chosen in order, and each one's greatest similarity to those before it: exact
    repeats of a normalised text and too similar ones are skipped."""
    chosen, greatest, seen = [], [], set()
    for i, (text, v) in enumerate(zip(texts, vectors)):
        if len(chosen) == limit:
            break
        if text and text in seen:
            continue
        most = float(np.max(vectors[chosen] @ v)) if chosen else 0.0
        if most > threshold:
            continue
        chosen.append(i)
        greatest.append(round(most, 6))
        seen.add(text)
    return chosen, greatest


def diverse_top(rows: DataFrame, limit: int = 15, threshold: float = 0.78, pool: int = 240) -> DataFrame:
    """Up to ``limit`` rows (doc_id, confidence, text, vector) by confidence, mutually dissimilar,
    with diversity_max_similarity and rank. Walks the best ``pool`` candidates, which is all that
    ever reaches one task; vectors have length 1."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    best = rows.select("doc_id", "confidence", normal_space(F.coalesce("text", F.lit(""))).alias("text"), "vector").orderBy(F.col("confidence").desc(), "doc_id").limit(pool)

    def chosen(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["confidence", "doc_id"], ascending=[False, True], kind="stable")
        at, most = walk(frame["text"].tolist(), np.stack(frame["vector"].to_numpy()), limit, threshold)
        found = frame.iloc[at]
        return pd.DataFrame({"doc_id": found["doc_id"].to_numpy(), "confidence": found["confidence"].to_numpy(), "diversity_max_similarity": most, "rank": np.arange(1, len(at) + 1)})

    kind = dict(rows.dtypes)["doc_id"]
    ship(rows.sparkSession)
    return best.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(chosen, f"doc_id {kind}, confidence double, diversity_max_similarity double, rank int")


def relevant_diverse_top(rows: DataFrame, judge, query: str, limit: int = 15, threshold: float = 0.78, batch: int = 20, pool: int = 240) -> list:
    """Ids of up to ``limit`` rows that the judge finds relevant and that are mutually dissimilar.

    judge(query, works) takes batches of at most ``batch`` dicts and returns the relevant ids;
    ids it wasn't given are ignored. Batches stop as soon as enough rows are chosen."""
    best = rows.select("doc_id", "confidence", "title", "abstract", "vector").orderBy(F.col("confidence").desc(), "doc_id").limit(pool).collect()
    accepted: list = []
    for i in range(0, len(best), batch):
        part = best[i : i + batch]
        kept = set(judge(query, [{"id": r.doc_id, "title": r.title, "abstract": r.abstract} for r in part]))
        accepted += [r for r in part if r.doc_id in kept]
        if accepted:
            texts = [" ".join(f"{r.title or ''} {r.abstract or ''}".lower().split()) for r in accepted]
            at, _ = walk(texts, np.array([r.vector for r in accepted], float), limit, threshold)
            if len(at) == limit or i + batch >= len(best):
                return [accepted[k].doc_id for k in at]
    return [accepted[k].doc_id for k in at] if accepted else []


def top_factors(contributions: Column, k: int) -> Column:
    """The greatest positive (feature, value) entries of a list."""
    positive = F.filter(contributions, lambda x: x["value"] > 0)
    ordered = F.array_sort(positive, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    return F.slice(ordered, 1, k)
