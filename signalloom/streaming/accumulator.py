"""Topic features that follow arriving works, whatever the order of their years.

Each topic keeps a count and a sum of vectors for each year. When works of a year arrive, that
year's row and those of the topic's later years are given out anew, so a consumer that keeps the
last row of a topic and year has what a batch run over all works so far would give. Works that
come too late can be held off by a rule. Before the exchange each task adds up its works by topic
and year: a topic with a third of all works sends a row a task and year.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.numbers import LOG_CLIP, as_year
from ..sources.committed import CommittedTable
from ..sources.scratch import ship

_SUMS = "topic_id string, pub_year int, n long, m long, total array<double>"
FEATURES = (
    "topic_id string, pub_year int, n long, topic_historical_volume double, topic_publication_growth double, "
    "topic_growth_acceleration double, topic_age_years double, topic_local_volume double, cluster_density double, late long"
)


def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's works by topic and year."""
    for frame in frames:
        rows = []
        for (topic, year), part in frame.groupby(["topic_id", "pub_year"], sort=False):
            vectors = [np.asarray(v, float) for v in part["vector"] if v is not None]
            rows.append((topic, year, len(part), len(vectors), _sum(vectors).tolist()))
        yield pd.DataFrame(rows, columns=["topic_id", "pub_year", "n", "m", "total"])


def _sum(vectors: list[np.ndarray]) -> np.ndarray:
    """Of vectors, the shorter ones as if they ended in zeros."""
    out = np.zeros(max(map(len, vectors), default=0))
    for v in vectors:
        out[: len(v)] += v
    return out


def yearly_features(counts: dict[int, int], sums: dict[int, tuple[int, np.ndarray]], year: int) -> tuple:
    """(volume, growth, acceleration, age, past works with vectors, their centroid's norm) of one
    topic and year; sums has the number of vectors with their sum."""
    ratio = lambda a, b: math.log2((counts.get(a, 0) + 1) / (counts.get(b, 0) + 1))
    clip = lambda x: max(-LOG_CLIP, min(LOG_CLIP, x))
    recent = ratio(year - 1, year - 2)
    past = [y for y in counts if y < year]
    works = sum(sums[y][0] for y in past)
    norm = float(np.linalg.norm(_sum([sums[y][1] for y in past]) / works)) if works else 0.0
    return (
        float(sum(counts.get(year - k, 0) for k in (1, 2, 3))),
        clip(recent),
        clip(recent - ratio(year - 2, year - 3)),
        float(max(0, year - min(counts))),
        float(works),
        norm,
    )


class TopicYears(StatefulProcessor):
    """State by topic: for each year its count and sum of vectors, the latest year, and how many works were late."""

    def __init__(self, late_years: int | None) -> None:
        self.late_years = late_years

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.years = handle.getMapState("years", "year int", "n long, m long, total array<double>")
        self.seen = handle.getValueState("seen", "latest int, late long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.seen.get() if self.seen.exists() else None
        latest, late = (held[0], held[1]) if held else (None, 0)
        counts, sums = {}, {}
        for (year,), (n, m, total) in self.years.iterator():
            counts[year], sums[year] = n, (m, np.asarray(total, float))
        touched: set[int] = set()
        for frame in rows:
            for year, n, m, total in zip(frame["pub_year"].tolist(), frame["n"].tolist(), frame["m"].tolist(), frame["total"]):
                if self.late_years is not None and latest is not None and year < latest - self.late_years:
                    late += n
                    continue
                counts[year] = counts.get(year, 0) + n
                before = sums.get(year, (0, np.zeros(0)))
                sums[year] = (before[0] + m, _sum([before[1], np.asarray(total, float)]))
                touched.add(year)
        for year in touched:
            self.years.updateValue((year,), (counts[year], sums[year][0], sums[year][1].tolist()))
        if counts:
            self.seen.update((max(counts), late))
        changed = sorted(y for y in counts if touched and y >= min(touched))
        out = [(key[0], y, counts[y], *yearly_features(counts, sums, y), late) for y in changed]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])

    def close(self) -> None:
        pass


def running_features(works: DataFrame, late_years: int | None = None) -> DataFrame:
    """The rows that arriving works change: topic_id (as text), pub_year, n, the four features of
    ``topic_dynamics``, topic_local_volume and cluster_density of the years before, and late.

    works is a stream of topic_id, pub_year and ``vector`` (array of doubles, or null). Works without topic
    or year are left out. With ``late_years`` works of a year more than so many before the
    topic's latest of earlier batches are not counted, but in ``late``, the topic's number of such works;
    without it every late work corrects the years after its own."""
    spark = works.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    vector = F.col("vector").cast("array<double>") if "vector" in works.columns else F.lit(None).cast("array<double>")
    valid = works.select(F.col("topic_id").cast("string").alias("topic_id"), as_year(F.col("pub_year")).alias("pub_year"), vector.alias("vector")).where("topic_id is not null and pub_year is not null")
    return valid.mapInPandas(_added, _SUMS).groupBy("topic_id").transformWithStateInPandas(TopicYears(late_years), FEATURES, "Update", "None")


def maintain_features(features: DataFrame, table: CommittedTable, checkpoint: str) -> StreamingQuery:
    """Keeps the last row of each topic and year in a committed table. A batch that is run again
    after a failure puts the same rows in place, so nothing counts twice."""

    def newest(known: DataFrame, arrived: DataFrame) -> DataFrame:
        return known.join(arrived.select("topic_id", "pub_year"), ["topic_id", "pub_year"], "left_anti").select(*arrived.columns).unionByName(arrived)

    def put(batch: DataFrame, _: int) -> None:
        kept = batch.persist()  # the state is not run twice for one batch
        try:
            if not kept.isEmpty():
                table.merge(kept, newest)
        finally:
            kept.unpersist()

    return features.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
