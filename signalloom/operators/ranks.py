"""Running sums, quantiles and ranks over orders that no single task can hold.

Rows are written first, so nothing above them runs twice. A table of a hundred thousand rows is
ordered by one task; a larger one is dealt to range partitions and written with their partition's
number, so that a row's partition is the same each time it is read. Totals by partition are a
small table; what runs within a partition starts from the total of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import holds_map, materialise, packed, quoted

#: Range partitions that values are dealt to at least.
PIECES = 16
#: Rows that one task may order.
FEW_ROWS = 1 << 17
_EARLIER = (Window.unboundedPreceding, -1)


def cumulative(rows: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """rows with ``cum_<x>``, the running sum in ascending order, rows of equal order being one."""
    names = {f"s{i}": x for i, x in enumerate(sums)}
    each = packed(rows, at=quoted(order), **{k: quoted(x) for k, x in names.items()})
    held = materialise(each, "rows")
    if held.count() <= FEW_ROWS:
        upto = Window.orderBy("at")
        return held.coalesce(1).select("row.*", *(F.sum(k).over(upto).alias(f"cum_{x}") for k, x in names.items()))
    placed = materialise(held.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("part").agg(*(F.sum(k).alias(k) for k in names))
    before = Window.orderBy("part").rowsBetween(*_EARLIER)
    starts = totals.select("part", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"start_{k}") for k in names))
    within = Window.partitionBy("part").orderBy("at")
    joined = placed.join(F.broadcast(starts), "part")
    return joined.select("row.*", *((F.sum(k).over(within) + F.col(f"start_{k}")).alias(f"cum_{x}") for k, x in names.items()))


def quantiles(counts: DataFrame, members: DataFrame, shares: list[float], written: bool = False) -> DataFrame:
    """(w, share, value): exact interpolated quantiles of the values of each w, which draws from
    the groups g that members (w, g) lists for it. counts has g, v (not null) and n; ``written``
    says that it is a written table already.

    Only the partitions in which a quantile lies are looked into. members is a small table (years
    by earlier years, names); both it and the totals are broadcast.
    """
    # small partitions: one of them is ordered for each quantile
    pieces = max(PIECES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = counts.select("g", "v", "n") if written else materialise(counts.select("g", "v", "n"), "values")
    few = held.count() <= FEW_ROWS
    placed = held.withColumn("part", F.lit(0)) if few else materialise(held.repartitionByRange(pieces, "v").withColumn("part", F.spark_partition_id()), "value-ranges")
    members = F.broadcast(members.select("w", "g"))
    totals = placed.groupBy("g", "part").agg(F.sum("n").alias("n")).join(members, "g").groupBy("w", "part").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy("w").orderBy("part").rowsBetween(*_EARLIER)
    spans = totals.select("w", "part", "n", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("w")).alias("total"))
    position = F.col("share") * (F.col("total") - 1)
    asked = spans.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    asked = asked.select("*", (position - F.floor(position)).alias("rest"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(position).alias("k")), F.struct(F.lit(1).alias("side"), F.ceil(position).alias("k")))).alias("x"))
    hits = asked.where((F.col("x.k") >= F.col("start")) & (F.col("x.k") < F.col("start") + F.col("n"))).select("w", "part", "share", "rest", "x.side", (F.col("x.k") - F.col("start")).alias("k"))
    inside = placed.join(members, "g").join(F.broadcast(hits.select("w", "part").distinct()), ["w", "part"]).groupBy("w", "part", "v").agg(F.sum("n").alias("n"))
    running = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("w", "part").orderBy("v")))
    found = running.join(F.broadcast(hits), ["w", "part"]).where(F.col("upto") > F.col("k")).groupBy("w", "share", "rest", "side").agg(F.min("v").alias("v"))
    ends = found.groupBy("w", "share", "rest").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("high"))
    return ends.select("w", "share", (F.col("low") + F.col("rest") * (F.col("high") - F.col("low"))).alias("value"))


def at_cuts(rows: DataFrame, stratum: Column, order: Column, tie: Column, cuts: DataFrame) -> DataFrame:
    """(row, part) for rows of the strata that cuts (s, cuts) lists: part is the number of its
    stratum's cuts, ascending numbers of rows, that lie before the row in the order given.

    order is a hexadecimal hash. Counts by its first digits say for nearly all rows on which side
    of a cut they are, without moving them; only the rows of the digits in which a cut lies are
    ordered, copies of a row as one row with a count, so repeated keys and rows do no harm.
    Nulls are a stratum and a tie like any other.
    """
    each = packed(rows, s=stratum, o=order, k=tie).withColumn("h", F.substring("o", 1, 4))
    heads = each.groupBy("s", "h").agg(F.count("*").alias("n"))
    starts = heads.select("s", "h", "n", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("h").rowsBetween(*_EARLIER)), F.lit(0)).alias("start"))
    asked = cuts.select(F.col("s").alias("c_s"), "cuts", F.posexplode_outer("cuts").alias("i", "c"))
    lie = starts.join(asked, F.col("s").eqNullSafe(F.col("c_s"))).where(F.col("start") + F.col("n") > F.col("c"))
    first = lie.groupBy("c_s", "i", "c").agg(F.min(F.struct("h", "start")).alias("x"))
    marks = first.select("c_s", F.struct("x.h", (F.col("x.start") < F.col("c")).alias("inside"), "x.start").alias("m")).groupBy("c_s").agg(F.collect_list("m").alias("marks"))
    limits = cuts.select(F.col("s").alias("c_s"), "cuts").join(marks.withColumnRenamed("c_s", "m_s"), F.col("c_s").eqNullSafe(F.col("m_s")), "left").select("c_s", "cuts", F.coalesce("marks", F.array().cast(marks.schema["marks"].dataType)).alias("marks"))
    known = each.join(limits, F.col("s").eqNullSafe(F.col("c_s")))
    split = F.exists("marks", lambda m: m["inside"] & (m["h"] == F.col("h")))
    passed = F.size(F.filter("marks", lambda m: (m["h"] < F.col("h")) | ((m["h"] == F.col("h")) & ~m["inside"])))
    sure = known.where(~split).select("row", passed.alias("part"))

    here = F.element_at(F.filter("marks", lambda m: m["h"] == F.col("h")), 1)["start"]
    # rows that hold a map can't be grouped as they are: their JSON stands for them
    same = F.to_json("row") if holds_map(rows.schema) else F.col("row")
    copies = known.where(split).groupBy("s", "h", "o", "k", same.alias("same"), "cuts", here.alias("base")).agg(F.count("*").alias("n"), F.first("row").alias("row")).withColumn("t", F.xxhash64("same")).drop("same")
    placed = materialise(copies.repartitionByRange("s", "h", "o", "k", "t").withColumn("part", F.spark_partition_id()), "cuts")
    totals = placed.groupBy("s", "h", "part").agg(F.sum("n").alias("n"))
    offsets = totals.select(F.struct("s", "h").alias("g"), "part", F.coalesce(F.sum("n").over(Window.partitionBy("s", "h").orderBy("part").rowsBetween(*_EARLIER)), F.lit(0)).alias("offset"))
    upto = F.sum("n").over(Window.partitionBy("s", "h", "part").orderBy("o", "k", "t").rowsBetween(*_EARLIER))
    inner = placed.withColumn("before", F.coalesce(upto, F.lit(0))).withColumn("g", F.struct("s", "h"))
    ranked = inner.join(offsets.withColumnRenamed("part", "of"), inner["g"].eqNullSafe(offsets["g"]) & (F.col("part") == F.col("of"))).select("row", "cuts", (F.col("base") + F.col("offset") + F.col("before")).alias("start"), "n")
    single = ranked.select("row", "cuts", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("rank"))
    return sure.unionByName(single.select("row", F.size(F.filter("cuts", lambda c: c <= F.col("rank"))).alias("part")))
