"""Joins by nearness, by rule and by shared keys.

The small side of the theta joins (templates, anchors, leaders) is broadcast only after its rows were counted against
BROADCAST_ROWS; beyond that an error says that bins are asked for (`in_bins`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from inventa.operators.windows import global_rank

BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint, after its rows were counted."""
    if (n := df.limit(BROADCAST_ROWS + 1).count()) > BROADCAST_ROWS:
        raise ValueError(f"more than {n - 1} rows can't meet all others; use in_bins")
    return F.broadcast(df)


def argmin(left: DataFrame, right: DataFrame, keys: list[str], distance: Callable[[Column], Column], order: str, keep: list[str], eligible: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each row of left (by `keys`) the eligible row of right with the least distance; the first in `order` wins ties. `keep`: columns of right.
    Right is one array of rows that meets each row of left on its spot: no pair is a row, so none is sorted or sent."""
    names = [order, *[k for k in keep if k != order]]
    rows = small(right).groupBy().agg(F.collect_list(F.struct(*right.columns)).alias("__rows"))
    met = left.join(F.broadcast(rows))  # one row
    among = F.col("__rows") if eligible is None else F.filter("__rows", eligible)
    best = F.array_min(F.transform(among, lambda t: F.struct(distance(t).alias("distance"), *[t[n].alias(n) for n in names])))
    found = met.select(*keys, best.alias("best")).where("best is not null")
    return found.groupBy(*keys).agg(F.min("best").alias("best")).select(*keys, "best.*")


def nearest_template(items: DataFrame, templates: DataFrame, keys: list[str], distance: Callable[[Column], Column], keep: list[str], order: str = "ord") -> DataFrame:
    return argmin(items, templates, keys, distance, order, keep)


def nearest_with_veto(items: DataFrame, rows: DataFrame, keys: list[str], eligible: Callable[[Column], Column], distance: Callable[[Column], Column], order: str, tolerance: float, keep: list[str]) -> DataFrame:
    """Nearest row among those that no veto rules out, if within the tolerance (inclusive)."""
    return argmin(items, rows, keys, distance, order, keep, eligible).where(F.col("distance") <= tolerance)


def in_bins(items: DataFrame, rows: DataFrame, channels: list[tuple[str, str]], veto: float) -> DataFrame:
    """All pairs whose channels differ by at most `veto`, as an equi-join: an item lies in one bin of that width, a row is put in its own bin and all neighbours. Exact, and neither side has to be small.
    Rows are broadcast only after they were counted in all their bins; else both sides are shuffled, whatever the sizes of files suggest."""
    bins = [f"__bin{i}" for i in range(len(channels))]
    where = lambda c: F.floor(F.col(c) / F.lit(float(veto))).cast("int")
    right = rows
    for (_, r), b in zip(channels, bins):
        right = right.withColumn(b, F.explode(F.array(where(r) - 1, where(r), where(r) + 1)))
    left = items.select("*", *[where(c).alias(b) for (c, _), b in zip(channels, bins)])
    near = reduce(Column.__and__, [F.abs(F.col(c) - F.col(r)) <= veto for c, r in channels])
    few = rows.limit(BROADCAST_ROWS + 1).count() * 3 ** len(channels) <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right.hint("merge"), bins).where(near).drop(*bins)


def nearest_in_bins(items: DataFrame, rows: DataFrame, keys: list[str], channels: list[tuple[str, str]], veto: float, eligible: Column, distance: Column, order: str, tolerance: float, keep: list[str]) -> DataFrame:
    """nearest_with_veto for rows that are too many to broadcast."""
    best = F.min(F.struct(distance.alias("distance"), F.col(order), *[F.col(k) for k in keep if k != order])).alias("best")
    met = in_bins(items, rows, channels, veto).where(eligible).groupBy(*keys).agg(best).select(*keys, "best.*")
    return met.where(F.col("distance") <= tolerance)


def first_match(items: DataFrame, rows: DataFrame, keys: list[str], channels: list[tuple[str, str]], most: float, colour: Column, grid: Column, order: str, shape: float = 40, strong: float = 20, usual: float = 24) -> DataFrame:
    """The first row in order, not the nearest, whose colour and picture are near: the rule for items without an embedding.
    A picture that is nearly equal (`strong`) lets the colour drift up to `most`, else `usual` is the limit; only pairs
    whose channels differ by at most `most` are compared at all."""
    met = in_bins(items, rows, channels, most).withColumn("__grid", grid)
    rule = (F.col("__grid") <= shape) & (colour <= F.when(F.col("__grid") <= strong, F.lit(most)).otherwise(F.lit(usual)))
    return met.where(rule).groupBy(*keys).agg(F.min(order).alias(order))


def pairs(df: DataFrame, equal: list[str], order: str, differ: str | None = None) -> DataFrame:
    """Pairs a < b of rows equal in some columns: positive pairs; with `differ`, those of unlike groups: negative pairs."""
    a, b = df.alias("a"), df.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in equal]
    on.append(F.col(f"a.{differ}") < F.col(f"b.{differ}") if differ else F.col(f"a.{order}") < F.col(f"b.{order}"))
    return a.join(b, reduce(Column.__and__, on))


def near_pairs(df: DataFrame, equal: list[str], order: str, channels: list[str], most: float, near: Callable[[str, str], Column], block: int = 2000, task_pairs: int = 8_000_000) -> DataFrame:
    """(a, b): `order` of all pairs a < b of rows equal in some columns, of which no channel differs by more than `most` and for which `near`,
    a column of two aliases that does not depend on their order, holds. Rows lie in bins of width `most` and meet those of
    their own bin and of the half of its neighbours that lies ahead. Bins are cut into blocks, and there is a task for
    each `task_pairs` pairs to be looked at, so none grows with the table; the pairs themselves are quadratic, as the question is."""
    bins = [f"__bin{i}" for i in range(len(channels))]
    keys = [*equal, *bins]
    ahead = [d for d in product((-1, 0, 1), repeat=len(bins)) if d >= (0,) * len(bins)]

    def sent(rows: DataFrame) -> DataFrame:
        to = F.explode(F.array(*[F.struct(*[(F.col(b) + x).alias(b) for b, x in zip(bins, d)], F.lit(not any(d)).alias("__own")) for d in ahead])).alias("__to")
        return rows.select(*[c for c in rows.columns if c not in bins], to).select(*[c for c in rows.columns if c not in bins], "__to.*")

    rows = df.withColumns({b: F.floor(F.col(c) / F.lit(float(most))).cast("int") for c, b in zip(channels, bins)})
    cells = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    met = sent(cells.withColumnRenamed("__n", "__m")).join(cells, keys).agg(F.sum(F.col("__n").cast("double") * F.col("__m"))).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(met // task_pairs) + 1)
    blocks = cells.select(*keys, F.explode(F.sequence(F.lit(0), F.ceil(F.col("__n") / block).cast("int") - 1)).alias("__block"))
    keys = [*keys, "__block"]
    right = rows.withColumn("__block", F.floor((F.row_number().over(W.partitionBy(*keys[:-1]).orderBy(order)) - 1) / block).cast("int"))
    left = sent(rows).join(blocks, keys[:-1])
    a, b = left.repartition(tasks, *keys).alias("a"), right.repartition(tasks, *keys).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    on += [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= most for c in channels]
    i, j = F.col(f"a.{order}"), F.col(f"b.{order}")
    on.append(F.when(F.col("a.__own"), i < j).otherwise(i != j) & near("a", "b"))
    return a.join(b.hint("shuffle_hash"), reduce(Column.__and__, on)).select(F.least(i, j).alias("a"), F.greatest(i, j).alias("b"))


def training_pairs(df: DataFrame, group: str, box: str, order: str, value: Callable[[str], Column], name: str = "d", also: list[str] = ()) -> DataFrame:
    """(i, j, same, name, a_*, b_*): pairs of one group are the same part, pairs of one box and different groups are not.
    Both are equi-joins, as large as groups and boxes are. value: a column of aliases a and b; also: further columns of both."""
    picked = lambda same: [F.col(f"a.{order}").alias("i"), F.col(f"b.{order}").alias("j"), F.lit(same).alias("same"), value("").alias(name), *[F.col(f"{t}.{c}").alias(f"{t}_{c}") for c in also for t in "ab"]]
    return pairs(df, [group], order).select(*picked(True)).unionByName(pairs(df, [box], order, group).select(*picked(False)))


def theta_negatives(df: DataFrame, order: str, draws: int, differ: Callable[[str, str], Column], a: int = 7919, b: int = 104_729) -> DataFrame:
    """(i, j): drawn pairs that a rule tells apart for certain. The population is quadratic, so a number of draws is given:
    draw k takes the rows of rank k a and k b (both modulo the number of rows). differ: a column of two aliases."""
    placed = global_rank(df, order, name="__rank").withColumn("__rank", F.col("__rank") - 1)
    n = df.agg(F.count("*").alias("__n"))
    drawn = df.sparkSession.range(draws).join(F.broadcast(n)).select(((F.col("id") * a + 13) % F.col("__n")).alias("__a"), ((F.col("id") * b + 71) % F.col("__n")).alias("__b"))  # one row
    met = drawn.join(placed.alias("a"), F.col("__a") == F.col("a.__rank")).join(placed.alias("b"), F.col("__b") == F.col("b.__rank"))
    return met.where(differ("a", "b")).select(F.col(f"a.{order}").alias("i"), F.col(f"b.{order}").alias("j"))


def outermost(rects: DataFrame, key: str, group: list[str], edges: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """Rectangles that no larger one (or equal one of smaller key) of their group contains."""
    x0, y0, x1, y1 = edges
    area = lambda t: (F.col(f"{t}.{x1}") - F.col(f"{t}.{x0}")) * (F.col(f"{t}.{y1}") - F.col(f"{t}.{y0}"))
    on = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group]
    on += [F.col(f"b.{x0}") <= F.col(f"a.{x0}"), F.col(f"b.{y0}") <= F.col(f"a.{y0}"), F.col(f"b.{x1}") >= F.col(f"a.{x1}"), F.col(f"b.{y1}") >= F.col(f"a.{y1}")]
    on.append((area("b") > area("a")) | ((area("b") == area("a")) & (F.col(f"b.{key}") < F.col(f"a.{key}"))))
    return rects.alias("a").join(rects.alias("b"), reduce(Column.__and__, on), "left_anti")


def centres(df: DataFrame, row: str, vector: str, dim: int) -> DataFrame:
    """(row, centre): mean of each row's vectors, at unit length."""
    mean = F.array(*[F.avg(F.get(vector, F.lit(k)).cast("double")) for k in range(dim)])
    length = F.sqrt(F.aggregate("__m", F.lit(0.0), lambda s, x: s + x * x))
    return df.groupBy(row).agg(mean.alias("__m")).select(row, F.transform("__m", lambda x: x / length).alias("centre"))


def twins(df: DataFrame, key: str, vector: str, n: int, block: int = 2000) -> DataFrame:
    """(a, b, distance) of the n closest pairs. Rows are cut in blocks; each two blocks meet in one task, which multiplies them and sends on its n closest pairs."""
    blocks = max(1, -(-df.count() // block))
    own = df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("p"))
    met = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("k", "v", "p", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x, k, p = np.stack(pdf["v"].to_numpy()).astype(float), pdf["k"].to_numpy(), pdf["p"].to_numpy()
        same, found = pdf["i"].iloc[0] == pdf["j"].iloc[0], []
        for s in range(0, len(x), 256):
            d = np.sqrt(((x[s : s + 256, None] - x[None]) ** 2).sum(2)) if x.shape[1] < 8 else np.stack([np.sqrt(((x - r) ** 2).sum(1)) for r in x[s : s + 256]])
            wanted = k[s : s + 256, None] < k
            if not same:
                wanted &= p[s : s + 256, None] != p
            a, b = np.nonzero(wanted)
            few = np.lexsort((k[b], k[a + s], d[a, b]))[:n]
            found.append(pd.DataFrame({"a": k[a[few] + s], "b": k[b[few]], "distance": d[a[few], b[few]]}))
        return pd.concat(found).sort_values(["distance", "a", "b"]).head(n)

    return met.groupBy("i", "j").applyInPandas(near, "a long, b long, distance double").orderBy("distance", "a", "b").limit(n)


def least_gaps(df: DataFrame, group: str, key: str, vector: str, a: Column, b: Column, block: int = 4096) -> DataFrame:
    """(group, gap): the least distance between rows of the sides a and b of each group, null where none of their pairs has one. Sides are cut
    in blocks of about `block` rows; each two of them meet in one task, as a product of matrices. Only pairs whose product may be the
    least are then measured one by one. That is quadratic in the size of a group, as the question is."""
    own = df.select(F.col(group).alias("g"), F.xxhash64(key).alias("h"), F.col(vector).alias("v"), a.alias("a"), b.alias("b")).where(F.col("g").isNotNull())
    sides = own.groupBy("g").agg(F.count_if("a").alias("m"), F.count_if("b").alias("n")).where("m > 0 and n > 0")
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    placed = own.where(whole).join(sides, "g").select("g", F.size("v").alias("d"), "v", "a", "b", *[F.ceil(F.col(n) / block).cast("int").alias(n) for n in "mn"], "h")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod("h", F.col(n)).cast("int")
    left = placed.where("a").select("g", "d", at("m").alias("i"), every("n").alias("j"), "v")
    right = placed.where("b").select("g", "d", every("m").alias("i"), at("n").alias("j"), "v").toDF("g", "d", "i", "j", "v")

    def near(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"g": [], "gap": []})
        x, y = (np.stack(f["v"].to_numpy()).astype(float) for f in (p, q))
        sx, sy, best = (x * x).sum(1), (y * y).sum(1), np.inf
        slack = 1e-12 * (sx.max() + sy.max())
        for s in range(0, len(x), 512):
            d = sx[s : s + 512, None] + sy - 2 * (x[s : s + 512] @ y.T)
            i, j = np.nonzero(d <= min(d.min(), best * best) + slack)
            for k in range(0, len(i), 4096):
                best = min(best, float(np.sqrt(((x[s + i[k : k + 4096]] - y[j[k : k + 4096]]) ** 2).sum(1)).min()))
                if best == 0:
                    break
        return pd.DataFrame({"g": p["g"].iloc[:1], "gap": [best]})

    kind = df.schema[group].dataType.simpleString()
    on = ["g", "d", "i", "j"]
    gaps = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(near, f"g {kind}, gap double").groupBy("g").agg(F.min("gap").alias("gap"))
    return sides.join(gaps, "g", "left").select(F.col("g").alias(group), "gap")


def lookup(refs: DataFrame, items: DataFrame, on: list[str]) -> DataFrame:
    """References resolved to items; those that lead nowhere are skipped."""
    return refs.join(items, on)


def sides_overlap(sides: DataFrame, pair: str, side: str, row: str) -> DataFrame:
    """For each pair whether its sides a and b share a row."""
    s = lambda v: F.coalesce(F.collect_set(F.when(F.col(side) == v, F.col(row))), F.array().cast(T.ArrayType(sides.schema[row].dataType)))
    return sides.groupBy(pair).agg(s("a").alias("x"), s("b").alias("y")).select(pair, F.arrays_overlap("x", "y").alias("merged"))


def nearest_label(parts: DataFrame, labels: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Each part (x, y) to the label (lx, ly, label_ord) of its group at the least cost: dx + dy, dy three times where the label is above."""
    dy = F.col("ly") - F.col("y")
    cost = F.abs(F.col("lx") - F.col("x")) + F.when(dy < 0, -3 * dy).otherwise(dy)
    best = F.min(F.struct(cost.alias("cost"), "label_ord")).alias("best")
    return parts.join(labels, group).groupBy(*keys).agg(best).select(*keys, "best.*")
