"""Shapes over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inventa.sources.shared import prepare


def runs(df: DataFrame, group: list[str], place: str, flag: Column, min_gap: int) -> DataFrame:
    """Half-open runs [start, end) of true places; runs that are fewer than min_gap places apart are one. The last run
    ends after its last true place, unless fewer than min_gap false places follow it: then it ends with the group."""
    ends = df.groupBy(*group).agg((F.max(place) + 1).alias("__n"))
    w = W.partitionBy(*group).orderBy(place)
    on = df.where(flag).withColumn("__before", F.lag(place).over(w))
    marked = on.withColumn("__run", F.sum((F.col("__before").isNull() | (F.col(place) - F.col("__before") - 1 >= min_gap)).cast("int")).over(w))
    out = marked.groupBy(*group, "__run").agg(F.min(place).alias("start"), (F.max(place) + 1).alias("end"))
    last = F.max("__run").over(W.partitionBy(*group))
    joined = out.withColumn("__last", last == F.col("__run")).join(ends, group)
    tail = F.col("__n") - F.col("end")
    return joined.select(*group, "start", F.when(F.col("__last") & (tail > 0) & (tail < min_gap), F.col("__n")).otherwise(F.col("end")).alias("end"))


def remaining_after(items: DataFrame, step: int, page: str = "page") -> DataFrame:
    """Per row what is needed on pages after the step; rows with nothing left are not there."""
    return items.where(F.col(page) > step).groupBy("row_id").agg(F.sum(F.coalesce("qty", F.lit(1))).alias("remaining"), F.bool_or(F.col("qty").isNull()).alias("unsure"), F.count_distinct(page).alias("n_pages"))


def remaining_all(items: DataFrame, doc: str, page: str = "page") -> DataFrame:
    """(doc, page, row_id, remaining) for every page of a document and every row of it that is still needed after the page."""
    per = items.groupBy(doc, "row_id", page).agg(F.sum(F.coalesce("qty", F.lit(1))).alias("q"))
    steps = items.select(doc, F.col(page).alias("__step")).distinct()
    last = per.groupBy(doc, "row_id").agg(F.max(page).alias("__last"))
    need = last.join(steps, doc).where(F.col("__step") < F.col("__last")).select(doc, "row_id", F.col("__step").alias(page))
    dense = need.join(per, [doc, "row_id", page], "full")
    w = W.partitionBy(doc, "row_id").orderBy(page).rowsBetween(1, W.unboundedFollowing)
    return dense.select(doc, page, "row_id", F.coalesce(F.sum("q").over(w), F.lit(0)).alias("remaining")).where("remaining > 0")


def hue_clusters(df: DataFrame, doc: str, key: str, hue: str, step: float = 22.0) -> DataFrame:
    """(doc, key, cluster, unrolled): hues of a document cut at the largest gap of the circle, unrolled from there, a new
    cluster wherever the next is at least `step` away."""
    every, order = W.partitionBy(doc), W.partitionBy(doc).orderBy(hue, key)
    gaps = df.select(doc, key, hue).withColumns({"i": F.row_number().over(order), "n": F.count("*").over(every)})
    gaps = gaps.withColumn("gap", F.coalesce(F.lead(hue).over(order), F.first(hue).over(order) + 360) - F.col(hue))
    cut = gaps.withColumn("cut", -F.max(F.struct("gap", (-F.col("i")).alias("j"))).over(every)["j"])
    stays = (F.col("i") > F.col("cut")) | (F.col("cut") == F.col("n"))
    turned = cut.withColumn("unrolled", F.when(stays, F.col(hue)).otherwise(F.col(hue) + 360))
    by = W.partitionBy(doc).orderBy("unrolled", key)
    fresh = (F.col("unrolled") - F.lag("unrolled").over(by) >= step).cast("int")
    return turned.withColumn("__fresh", F.coalesce(fresh, F.lit(0))).withColumn("cluster", F.sum("__fresh").over(by)).select(doc, key, "cluster", "unrolled")


def circular_centroid(df: DataFrame, group: list[str], unrolled: str, weight: str) -> DataFrame:
    return df.groupBy(*group).agg(F.pmod(F.sum(F.col(unrolled) * F.col(weight)) / F.sum(weight), F.lit(360.0)).alias("centre"))


def moving(df: DataFrame, group: list[str], order: str, value: str, reach: int) -> DataFrame:
    """Sum, least and largest of the neighbours within reach, itself included."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumns({"around": F.sum(value).over(w), "low": F.min(value).over(w), "high": F.max(value).over(w)})


def top_k(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def global_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """`df` with a rank from 1 over all its rows, in no single task: rows are ranged over partitions in that order,
    ranked inside each, and moved by what the partitions before hold. The ranges are checkpointed, so that both uses see the same ones."""
    prepare(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    upto = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # one row a partition
    before = ranged.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(upto, F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + inside).alias(name))
