"""Where results go."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import cumulative
from .committed import Files
from .scratch import materialise, packed, quoted, row_hash

VERSION = "1"
#: Marks a folder whose job has ended well.
WHOLE = "_whole"


def write_corpus(rows: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Parquet with zstd; with ``rows_per_file`` in files of at most so many rows.

    A table that is there is replaced only when the new one is whole: it is written beside it and
    takes its name then, so rows may be read from the old one. Of a call that breaks between the
    two renames, the next one finds the whole new table and puts it in place first."""
    folder, _, name = path.rstrip("/").rpartition("/")
    files = Files(rows.sparkSession, folder)
    _take_name(files, name)
    out = rows.write.mode("overwrite").option("compression", "zstd")
    (out.option("maxRecordsPerFile", rows_per_file) if rows_per_file else out).parquet(f"{folder}/_new-{name}")
    files.write(f"_new-{name}/{WHOLE}", "")
    _take_name(files, name)


def _take_name(files: Files, name: str) -> None:
    """Puts a whole table that was written beside the named one in its place."""
    if files.exists(f"_new-{name}/{WHOLE}"):
        files.delete(f"_old-{name}")
        if files.exists(name) and not files.move(name, f"_old-{name}"):
            raise FileExistsError(f"{files.root}/_old-{name}")
        if not files.move(f"_new-{name}", name):
            raise FileExistsError(f"{files.root}/{name}")
    files.delete(f"_old-{name}")


def write_shards(rows: DataFrame, folder: str, rows_per_file: int, order: str, whole_only: bool = True) -> int:
    """rows in files part-00000.parquet, part-00001.parquet, ... of exactly ``rows_per_file`` rows
    each, in ascending order; returns how many. With ``whole_only`` rows of a last, short file are
    held back for a later run. Rows of equal order keep it by a hash of the row.

    A later call goes on after the files that are there. New files are first written whole to a
    folder of their own under their final numbers, then renamed one by one, never onto another
    file; a call that breaks meanwhile is finished by the next one."""
    spark = rows.sparkSession
    files = Files(spark, folder)
    _finish_shards(files)
    have = [int(m[1]) for n in files.names() if (m := re.fullmatch(r"part-(\d+)\.parquet", n))]
    after = max(have, default=-1) + 1
    each = packed(rows, at=quoted(order), hash=row_hash(rows), one=F.lit(1))
    placed = materialise(cumulative(each, "at", ["one"]), "shards")
    total = placed.count()
    count = total // rows_per_file if whole_only else -(-total // rows_per_file)
    if not count:
        return 0
    place = F.col("cum_one") - F.row_number().over(Window.partitionBy("cum_one").orderBy("hash"))
    numbered = placed.select("row", place.alias("place")).select("row.*", F.floor(F.col("place") / rows_per_file).alias("__shard")).where(F.col("__shard") < count)
    staged = f"_staged-{uuid.uuid4().hex}"
    dealt = numbered.withColumn("__shard", F.col("__shard") + after).repartition(count, "__shard")
    # one file a shard, whatever limit the session sets
    dealt.write.option("compression", "zstd").option("maxRecordsPerFile", 0).partitionBy("__shard").parquet(f"{files.root}/{staged}")
    files.write(f"{staged}/{WHOLE}", "")
    _finish_shards(files)
    return count


def _finish_shards(files: Files) -> None:
    """Renames what whole staged folders still hold; others were never finished and go."""
    for staged in [n for n in files.names() if n.startswith("_staged-")]:
        for shard in files.names(staged) if files.exists(f"{staged}/{WHOLE}") else ():
            if shard.startswith("__shard="):
                [part] = [n for n in files.names(f"{staged}/{shard}") if n.startswith("part-")] or [None]
                name = f"part-{int(shard.removeprefix('__shard=')):05d}.parquet"
                if part and not files.move(f"{staged}/{shard}/{part}", name):
                    raise FileExistsError(f"{files.root}/{name}")
        files.delete(staged)


def export(rows: DataFrame, path: str, training_end_year: int) -> DataFrame:
    """The full corpus, ``inference`` (later years) and ``training`` (labelled), and a manifest
    (name, rows) that is returned and written."""
    write_corpus(rows, f"{path}/full")
    saved = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/full")
    parts = {"full": saved, "inference": saved.where(F.col("pub_year") > training_end_year), "training": saved.where("target_emergence is not null")}
    for name in ("inference", "training"):
        write_corpus(parts[name], f"{path}/{name}")
    manifest = None
    for name, part in parts.items():
        one = part.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        manifest = one if manifest is None else manifest.unionByName(one)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result in one file."""
    out = rows.coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


def write_next(rows: DataFrame, folder: str, name: str = "output") -> str:
    """JSON in the first free folder output1, output2, ... of ``folder``; returns its path."""
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    n = 1
    while True:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}{n}")
        if not path.getFileSystem(conf).exists(path):
            rows.write.json(f"{folder}/{name}{n}")
            return f"{folder}/{name}{n}"
        n += 1


def write_versioned(rows: DataFrame, path: str, version: str = VERSION) -> None:
    rows.withColumns({"version": F.lit(version), "generated_at": F.current_timestamp()}).write.mode("overwrite").json(path)


def newer(spark: SparkSession, path: str, *than: str) -> bool:
    """Whether a file or folder exists and is no older than the others that exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path

    def modified(name: str) -> int | None:
        p = hadoop(name)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None

    at = modified(path)
    return at is not None and all(t is None or t <= at for t in map(modified, than))


def cache_is_ready(cached: DataFrame, corpus: DataFrame, columns: list[str], versions: dict[str, str], most: int = 15) -> bool:
    """Whether a cached result has the columns, few enough rows, current versions, and ids that
    are all in the corpus."""
    if not set(columns) | set(versions) <= set(cached.columns):
        return False
    one = cached.agg(F.count("*").alias("n"), *(F.bool_and(F.col(c) == v).alias(c) for c, v in versions.items())).first()
    if not 0 < one["n"] <= most or not all(one[c] for c in versions):
        return False
    return cached.select("doc_id").join(corpus.select("doc_id"), "doc_id", "left_anti").isEmpty()


def upsert_first_years(known: DataFrame, arrived: DataFrame) -> DataFrame:
    """(topic_id, author, first_year): the least year of each."""
    return known.unionByName(arrived).groupBy("topic_id", "author").agg(F.min("first_year").alias("first_year"))


def insert_new(known: DataFrame, arrived: DataFrame, key: str, order: str) -> DataFrame:
    """known and the first of each new key."""
    from ..operators.selection import keep_first

    return known.unionByName(keep_first(arrived, key, order).join(known.select(key), key, "left_anti").select(*known.columns))
