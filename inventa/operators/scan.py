"""Which pages and boxes are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_range(df: DataFrame, first: int | None, last: int | None, n_pages: int, page: str = "page") -> DataFrame:
    """Pages from first to last, both clamped into 1..n_pages; a missing first is 1, a missing last is first. The filter reaches the scan."""
    lo = max(1, min(n_pages, first or 1))
    hi = max(lo, min(n_pages, last or lo))
    return df.where(F.col(page).between(lo, hi))


def systematic_sample(df: DataFrame, first: int, n: int, wanted: int = 8, page: str = "page") -> DataFrame:
    """Every k-th page, k so that about `wanted` of n pages are taken. Not random."""
    step = max(1, n // wanted)
    return df.where((F.col(page) >= first) & ((F.col(page) - first) % step == 0))


def at_scales(df: DataFrame, scales: list[float]) -> DataFrame:
    """Each row once for each of a few scales."""
    return df.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))


def consistent_boxes(df: DataFrame, box: list[str], scale: str, slot: str, n_scales: int) -> DataFrame:
    """Boxes seen at all scales with the same number of slots at each."""
    per = df.groupBy(*box, scale).agg(F.count_distinct(slot).alias("slots"))
    return per.groupBy(*box).agg(F.count("*").alias("scales"), F.min("slots").alias("slots"), F.max("slots").alias("most")).where((F.col("scales") == n_scales) & (F.col("slots") == F.col("most"))).drop("most")


def zoom(area, box, per: float = 20000.0, margin: float = 1.3, cap: float = 4.0, most: float = 4.5e6, least: float = 1.05):
    """How much a callout is enlarged before it is measured again, by the area of its largest picture; null where that is
    not worth it. An enlarged callout has no more than `most` pixels."""
    k = F.least(F.lit(cap), F.greatest(F.lit(1.0), F.sqrt(F.lit(per * margin) / F.nullif(area, F.lit(0.0)))))
    bound = F.when(box * k * k > most, F.sqrt(F.lit(most) / box)).otherwise(k)
    return F.when((k > least) & (bound > least), bound)
