"""Totals, votes and statistics over items."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inventa.operators.windows import global_rank


def parts_list(items: DataFrame) -> DataFrame:
    """Per row: pieces (an unread quantity counts 1), whether any was unread, pages. Counted anew from items whenever they change."""
    return items.groupBy("row_id").agg(
        F.sum(F.coalesce("qty", F.lit(1))).alias("count"),
        F.bool_or(F.col("qty").isNull()).alias("unsure"),
        F.count_distinct("page").alias("n_pages"),
        F.min("page").alias("first_page"),
    )


def summary(items: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row: rows, pieces, pages with items, unread quantities and, if `pages` (one row for each page that was read) is given, how many those are."""
    out = items.agg(F.count_distinct("row_id").alias("rows"), F.sum(F.coalesce("qty", F.lit(1))).alias("pieces"), F.count_distinct("page").alias("pages_with_items"), F.count_if(F.col("qty").isNull()).alias("unread"))
    return out if pages is None else out.join(F.broadcast(pages.agg(F.count_distinct("page").alias("pages"))))  # one row


def modal_bin_mean(px: DataFrame, group: list[str], channels: list[str], order: str, shift: int = 3) -> DataFrame:
    """Mean colour of the fullest bin of each group; of equally full bins the one seen first."""
    width = 8 - shift
    key = None
    for c in channels:
        part = F.shiftright(F.col(c), shift)
        key = part if key is None else F.shiftleft(key, width).bitwiseOR(part)
    bins = px.withColumn("bin", key).groupBy(*group, "bin").agg(F.count("*").alias("n"), F.min(order).alias("seen"), *[F.avg(c).alias(c) for c in channels])
    best = F.max(F.struct("n", (-F.col("seen")).alias("earliest"), "bin", *channels)).alias("best")
    return bins.groupBy(*group).agg(best).select(*group, F.col("best.n").alias("n"), F.col("best.bin").alias("bin"), *[F.col(f"best.{c}").alias(c) for c in channels])


def dominant_colour(px: DataFrame, group: list[str], channels: list[str], order: str, share: float = 0.10, reach: float = 45) -> DataFrame:
    """Mean of the fullest bin if it holds enough, else the mean of the pixels around the bin mean that has most of them within reach."""
    from inventa.functions.scalars import chebyshev

    top = modal_bin_mean(px, group, channels, order, 5)
    total = px.groupBy(*group).agg(F.count("*").alias("total"))
    joined = top.join(total, group)
    plain = joined.where(F.col("n") >= share * F.col("total")).select(*group, *channels)
    rest = joined.where(F.col("n") < share * F.col("total")).select(*group)
    key = sum((F.shiftright(F.col(c), 5) * 8 ** (len(channels) - 1 - i) for i, c in enumerate(channels)), F.lit(0))
    few = px.join(rest, group, "left_semi")
    means = few.groupBy(*group, key.alias("bin")).agg(*[F.avg(c).alias(f"m_{c}") for c in channels], F.min(order).alias("seen"))
    near = few.join(means, group).where(chebyshev([F.col(c) for c in channels], [F.col(f"m_{c}") for c in channels]) <= reach)
    sums = near.groupBy(*group, "bin", "seen").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in channels])
    best = F.max(F.struct("n", (-F.col("seen")).alias("earliest"), *channels)).alias("best")
    return plain.unionByName(sums.groupBy(*group).agg(best).select(*group, *[F.col(f"best.{c}").alias(c) for c in channels]))


def weighted_vote(df: DataFrame, key: str, weight: str, value: str, page: str | None = None, pages: int = 0, least: float = 0) -> DataFrame:
    """The key with most weight (and enough pages, and enough weight), and the weighted mean of the value there."""
    aggs = [F.sum(weight).alias("weight"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("fill")]
    if page:
        aggs.append(F.count_distinct(page).alias("pages"))
    out = df.groupBy(key).agg(*aggs).where(F.col("weight") >= least)
    if page:
        out = out.where(F.col("pages") >= pages)
    return out.orderBy(F.desc("weight"), key).limit(1)


CELLS = 1024


def order_statistics(df: DataFrame, group: list[str], value: Column, picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(group, names): of each group's sorted values the ones at the given places, which are functions of how many there are (from 0).
    Equal values are one row; cells of equal width between least and largest are counted, and only those that hold a
    place are sorted, so no group is gathered. A cell that holds most values is sorted by one task, on disk if need be."""
    each = [F.col(g) for g in group]
    counted = df.where(value.isNotNull()).groupBy(*group, value.alias("__v")).agg(F.count("*").alias("__n"))
    bounds = counted.groupBy(*group).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum("__n").alias("__all"))
    located = counted.join(bounds, group) if group else counted.join(F.broadcast(bounds))  # one row where there is no group
    width = F.nullif((F.col("__high") - F.col("__low")).cast("double"), F.lit(0.0))
    cell = F.coalesce(F.least(F.floor((F.col("__v") - F.col("__low")) / width * CELLS), F.lit(CELLS - 1)), F.lit(0))
    located = located.withColumn("__cell", cell)
    before = F.coalesce(F.sum("__m").over(W.partitionBy(*each).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = located.groupBy(*group, "__cell").agg(F.sum("__n").alias("__m"), F.first("__all").alias("__all")).withColumn("__before", before)  # CELLS rows a group at most
    holds = reduce(Column.__or__, [(f(F.col("__all")) >= F.col("__before")) & (f(F.col("__all")) < F.col("__before") + F.col("__m")) for f in picks.values()])
    few = located.join(cells.where(holds).select(*group, "__cell", "__before"), [*group, "__cell"])
    upto = F.col("__before") + F.sum("__n").over(W.partitionBy(*each, F.col("__cell")).orderBy("__v"))
    placed = few.withColumn("__upto", upto)
    at = lambda f: F.max(F.when((f(F.col("__all")) < F.col("__upto")) & (f(F.col("__all")) >= F.col("__upto") - F.col("__n")), F.col("__v")))
    return placed.groupBy(*group).agg(*[at(f).alias(name) for name, f in picks.items()])


def upper_median_of(df: DataFrame, group: list[str], value: Column, name: str) -> DataFrame:
    """Of n values number n div 2, from 0."""
    return order_statistics(df, group, value, {name: lambda n: F.floor(n / 2)})


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, linear between neighbours."""
    picks = {}
    for name, share in shares.items():
        picks[f"__a_{name}"] = lambda n, p=share: F.floor((n - 1) * F.lit(p))
        picks[f"__b_{name}"] = lambda n, p=share: F.ceil((n - 1) * F.lit(p))
    found = order_statistics(df, group, F.col(value), picks)
    n = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("__n"))
    both = found.join(n, group) if group else found.join(F.broadcast(n))  # one row where there is no group
    place = lambda p: (F.col("__n") - 1) * F.lit(p)
    out = [(F.col(f"__a_{k}") + (F.col(f"__b_{k}") - F.col(f"__a_{k}")) * (place(p) - F.floor(place(p)))).alias(k) for k, p in shares.items()]
    return both.select(*group, *out)


def near_median(df: DataFrame, group: list[str], value: str, tolerance: float) -> DataFrame:
    """Rows whose value is within a share of the group's upper median; all of the group where none is."""
    joined = df.join(upper_median_of(df, group, F.col(value), "__median"), group)
    flagged = joined.withColumn("__near", F.abs(F.col(value) - F.col("__median")) <= tolerance * F.col("__median"))
    any_near = flagged.groupBy(*group).agg(F.bool_or("__near").alias("__any"))
    return flagged.join(any_near, group).where(F.col("__near") | ~F.col("__any")).drop("__near", "__any").withColumnRenamed("__median", "median")


def near_medians(df: DataFrame, group: list[str], tolerance: dict[str, float]) -> DataFrame:
    """near_median by several values at once: a row must be near in all of them."""
    joined = df
    for v in tolerance:
        joined = joined.join(upper_median_of(df, group, F.col(v), f"__m_{v}"), group)
    near = reduce(Column.__and__, [F.abs(F.col(v) - F.col(f"__m_{v}")) <= t * F.col(f"__m_{v}") for v, t in tolerance.items()])
    flagged = joined.withColumn("__near", near)
    any_near = flagged.groupBy(*group).agg(F.bool_or("__near").alias("__any"))
    return flagged.join(any_near, group).where(F.col("__near") | ~F.col("__any")).select(*df.columns)


def believable(df: DataFrame, pitch: str, share: float = 0.34) -> DataFrame:
    """Readings whose pitch is not far below the upper median of positive ones; a missing pitch passes, and so do all where there is no median."""
    med = upper_median_of(df.where(F.col(pitch) > 0), [], F.col(pitch), "__median")
    return df.join(F.broadcast(med.agg(F.max("__median").alias("__median")))).where(F.col(pitch).isNull() | (F.col(pitch) <= 0) | F.col("__median").isNull() | (F.col(pitch) >= share * F.col("__median"))).drop("__median")  # one row


def size_vote(readings: DataFrame, lone_error: float | None = 0.10) -> DataFrame:
    """(row_id, size, n, share): a size that two or more readings and more than half of them name, or a lone reading of small error. readings: row_id, size, ord, err."""
    per = readings.groupBy("row_id", "size").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.min("err").alias("err"))
    all_ = W.partitionBy("row_id")
    ranked = per.withColumn("total", F.sum("n").over(all_)).withColumn("rank", F.row_number().over(all_.orderBy(F.desc("n"), "first_ord")))
    won = (F.col("n") >= 2) & (2 * F.col("n") > F.col("total"))
    if lone_error is not None:
        won = won | ((F.col("total") == 1) & (F.col("err") <= lone_error))
    return ranked.where((F.col("rank") == 1) & won).select("row_id", "size", "n", (F.col("n") / F.col("total")).alias("share"))


def row_split(readings: DataFrame) -> DataFrame:
    """(row_id, size, n, new_row): each size other than a row's most frequent one with two or more readings becomes a row
    after the last one, in the order of the rows' first readings and of the sizes' frequency. readings: row_id, size, ord."""
    per = readings.groupBy("row_id", "size").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    all_ = W.partitionBy("row_id")
    ranked = per.withColumn("rank", F.row_number().over(all_.orderBy(F.desc("n"), "first_ord"))).withColumn("row_ord", F.min("first_ord").over(all_))
    # The most frequent size keeps the row, whether it won or not.
    losing = ranked.where((F.col("rank") > 1) & (F.col("n") >= 2))
    top = readings.agg(F.max("row_id").alias("__top"))
    numbered = global_rank(losing, "row_ord", "row_id", "rank", name="__k")
    return numbered.join(F.broadcast(top)).select("row_id", "size", "n", (F.col("__top") + F.col("__k")).alias("new_row"))  # one row


def split_items(items: DataFrame, readings: DataFrame, key: list[str]) -> DataFrame:
    """Items with the rows that `row_split` moves them to; items without a reading stay. readings: `key`, row_id, size, ord.
    Lists, pages and doubts of the rows are counted anew from the result (`parts_list`)."""
    moved = readings.join(row_split(readings).select("row_id", "size", "new_row"), ["row_id", "size"]).select(*key, "new_row")
    out = items.join(moved, key, "left")
    return out.withColumn("row_id", F.coalesce("new_row", "row_id")).drop("new_row").select(*items.columns)


def strict_majority(df: DataFrame, group: str, value: str) -> DataFrame:
    per = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return per.withColumn("total", F.sum("n").over(W.partitionBy(group))).where(2 * F.col("n") > F.col("total"))


def scale_agreement(df: DataFrame, slot: list[str], scales: int, size: str) -> DataFrame:
    """Slots measured at all, at every scale, and with one size at every scale; slots where two or more readings agree on the commonest size, and those of them where all do."""
    per = df.groupBy(*slot, size).agg(F.count(size).alias("n")).groupBy(*slot).agg(F.sum("n").alias("measured"), F.count_if(F.col("n") > 0).alias("sizes"), F.max("n").alias("top"))
    m, one = F.col("measured"), F.col("sizes") == 1
    voted = F.col("top") >= 2
    return per.agg(F.count("*").alias("slots"), F.count_if(m >= 1).alias("measured"), F.count_if(m >= scales).alias("at_all"), F.count_if((m >= scales) & one).alias("agree"), F.count_if(voted).alias("voted"), F.count_if(voted & one).alias("unanimous"))


def agreed_sizes(df: DataFrame, slot: list[str], scales: int, size: str, top: int = 16) -> DataFrame:
    """(size, slots): the commonest sizes of slots that were measured alike at every scale."""
    per = df.groupBy(*slot).agg(F.count(size).alias("m"), F.min(size).alias(size), F.max(size).alias("high"))
    return per.where((F.col("m") >= scales) & (F.col(size) == F.col("high"))).groupBy(size).agg(F.count("*").alias("slots")).orderBy(F.desc("slots"), size).limit(top)


def bit_majority(df: DataFrame, group: str, bits: str, n: int) -> DataFrame:
    """(group, prototype): a bit is set if more than half of the members have it. bits: packed integer of n bits."""
    share = [F.when(2 * F.sum(F.shiftright(F.col(bits), n - 1 - i).bitwiseAND(1)) > F.count("*"), "1").otherwise("0") for i in range(n)]
    return df.groupBy(group).agg(F.concat(*share).alias("prototype"), F.count("*").alias("members"))


def last_share(df: DataFrame, label: str, group: list[str], order: list[str], bar: float = 0.8) -> DataFrame:
    """How often a label stands last in its group, and whether that is nearly always."""
    n, at = F.count("*").over(W.partitionBy(*group)), F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("__last", (n == at).cast("int")).groupBy(label).agg(F.count("*").alias("n"), F.avg("__last").alias("share")).withColumn("is_suffix", F.col("share") > bar)


def error_rates(pairs: DataFrame, distance: str, same: str, threshold: float, hard: Column | None = None) -> DataFrame:
    """Share of same pairs beyond the threshold, and of other pairs within it; with `hard`, also of those other pairs that look alike."""
    d, s = F.col(distance), F.col(same)
    within = (d <= threshold).cast("double")
    more = [] if hard is None else [F.coalesce(F.avg(F.when(~s & hard, within)), F.lit(0.0)).alias("hard_merge_rate"), F.count_if(~s & hard).alias("hard_pairs")]
    return pairs.agg(F.avg(F.when(s, (d > threshold).cast("double"))).alias("duplicate_rate"), F.avg(F.when(~s, within)).alias("merge_rate"), F.count_if(s).alias("same_pairs"), F.count_if(~s).alias("other_pairs"), *more)


def rates_by_threshold(pairs: DataFrame, distance: str, same: str, thresholds: list[float]) -> DataFrame:
    """(threshold, false_splits, caught): shares of same and of other pairs beyond each of a few thresholds."""
    d, s = F.col(distance), F.col(same)
    aggs = [a for k, t in enumerate(thresholds) for a in (F.avg(F.when(s, (d > t).cast("double"))).alias(f"a{k}"), F.avg(F.when(~s, (d > t).cast("double"))).alias(f"b{k}"))]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{k}").alias("false_splits"), F.col(f"b{k}").alias("caught")) for k, t in enumerate(thresholds)])
    return pairs.agg(*aggs).select(F.inline(rows))


def threshold_sweep(pairs: DataFrame, distance: str, same: str, low: float, high: float, points: int) -> DataFrame:
    """The first grid point of least duplicate plus merge rate. Pairs are counted by grid cell first, so no pair meets the grid."""
    step = (high - low) / (points - 1)
    cell = F.least(F.greatest(F.ceil((F.col(distance) - low) / step), F.lit(0)), F.lit(points)).cast("long")  # the first point that is not below
    cells = pairs.groupBy(cell.alias("cell")).agg(F.count_if(F.col(same)).alias("same"), F.count_if(~F.col(same)).alias("other"))
    spark = pairs.sparkSession
    grid = spark.range(points).select(F.col("id").alias("cell"))
    every = grid.join(cells, "cell", "full").select("cell", F.coalesce("same", F.lit(0)).alias("same"), F.coalesce("other", F.lit(0)).alias("other"))
    up, all_ = W.orderBy("cell"), W.partitionBy()
    rates = every.select("cell", ((F.sum("same").over(all_) - F.sum("same").over(up)) / F.nullif(F.sum("same").over(all_), F.lit(0))).alias("duplicate_rate"), (F.sum("other").over(up) / F.nullif(F.sum("other").over(all_), F.lit(0))).alias("merge_rate")).where(F.col("cell") < points)
    best = F.min(F.struct((F.col("duplicate_rate") + F.col("merge_rate")).alias("err"), "cell", "duplicate_rate", "merge_rate")).alias("b")
    return rates.agg(best).select((F.lit(low) + F.col("b.cell") * F.lit(step)).alias("threshold"), "b.duplicate_rate", "b.merge_rate")


def percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    plain = df.agg(F.avg(value).alias("mean"), F.max(value).alias("largest"))
    return plain.join(F.broadcast(quantiles(df, [], value, shares)))  # one row


def holdout_by_quantile(df: DataFrame, group: str, page: str, share: float = 0.8) -> DataFrame:
    """is_test: whether the page lies above its group's quantile. Quantiles are one row a group."""
    cut = quantiles(df, [group], page, {"__cut": share})
    return df.join(cut, group).withColumn("is_test", F.col(page) > F.col("__cut")).drop("__cut")


def box_audit(df: DataFrame, box: str, version: str, slot: str) -> DataFrame:
    """Boxes that versions cut into different numbers of slots, and the slots that this touches."""
    per = df.groupBy(box, version).agg(F.count_distinct(slot).alias("n")).groupBy(box).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return per.agg(F.count("*").alias("boxes"), F.count_if(F.col("low") != F.col("high")).alias("cut_differently"), F.coalesce(F.sum(F.when(F.col("low") != F.col("high"), F.col("high"))), F.lit(0)).alias("slots_affected"))


def suspicious_pairs(pairs: DataFrame, distance: str, colour_gap: str, near: float = 0.12, alike: float = 8) -> DataFrame:
    """Pairs of different parts of one box that look the same: most likely one part that was cut in two."""
    return pairs.where((F.col(distance) < near) & (F.col(colour_gap) < alike))


def spread(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg((F.max(value) - F.min(value)).alias("spread"))


def accept_model(old_dup: Column, old_merge: Column, new_dup: Column, new_merge: Column, slack: float = 0.005) -> Column:
    """Whether a candidate's worse metric slips little, or its better one gains three times the slip."""
    slip = F.greatest(new_dup - old_dup, new_merge - old_merge)
    gain = F.greatest(old_dup - new_dup, old_merge - new_merge)
    return (slip <= slack) | (gain >= 3 * slip)


