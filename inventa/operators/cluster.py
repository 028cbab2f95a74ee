"""Groupings that depend on order or on a fixed point.

Greedy leader clustering reads items in order, so a group (one document's items) is one task; distances to all leaders
are computed at once and leaders, not items, fill the memory. Components go by minimum labels with pointer jumping in
DataFrames, so a graph is never in one place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inventa.functions.scalars import HUES

def leaders(points: np.ndarray, tolerance: float, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], nearest: bool = True, eligible: Callable[[np.ndarray, int], np.ndarray] | None = None) -> np.ndarray:
    """Row of each point in order: the nearest (or else the first) leader within the tolerance, or a new row whose leader it is for good."""
    rows, heads, n = np.empty(len(points), np.int64), np.empty(len(points), np.int64), 0
    led = np.empty_like(points)  # the leaders' points, side by side
    for i, p in enumerate(points):
        if n:
            d = distance(led[:n], p)
            if eligible is not None:
                d = np.where(eligible(heads[:n], i), d, np.inf)
            j = int(np.argmin(d)) if nearest else int(np.argmax(d <= tolerance))
            if d[j] <= tolerance:
                rows[i] = j
                continue
        heads[n], led[n], rows[i] = i, p, n
        n += 1
    return rows


def l2(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - p) ** 2).sum(1))


def bit_distance(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ p).sum(1)


def leader_clusters(df: DataFrame, group: str, order: str, vector: str, tolerance: float, colour: str | None = None, aspect: str | None = None, colour_veto: float = 45, aspect_veto: float = 0.09) -> DataFrame:
    """(group, order, row_id): embeddings by distance, under hard vetoes where colour or aspect are given."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        c = np.stack(pdf[colour].to_numpy()).astype(float) if colour else None
        a = pdf[aspect].to_numpy(float) if aspect else None

        def ok(heads: np.ndarray, i: int) -> np.ndarray:
            fine = np.ones(len(heads), bool)
            if c is not None:
                fine &= np.abs(c[heads] - c[i]).max(1) <= colour_veto
            if a is not None:
                fine &= np.abs(a[heads] - a[i]) <= aspect_veto
            return fine

        return pd.DataFrame({group: pdf[group], order: pdf[order], "row_id": leaders(x, tolerance, l2, True, ok if colour or aspect else None)})

    cols = [group, order, vector, *[x for x in (colour, aspect) if x]]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*cols).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, row_id long")


def leader_clusters_bits(df: DataFrame, group: str, order: str, bits: str, tolerance: int, nearest: bool = True) -> DataFrame:
    """(group, order, row_id): packed bit patterns (long) by Hamming distance."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[bits].to_numpy(np.int64).view(np.uint64)[:, None]
        return pd.DataFrame({group: pdf[group], order: pdf[order], "row_id": leaders(x, tolerance, bit_distance, nearest)})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(group, order, F.col(bits).cast("long").alias(bits)).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, row_id long")


def farthest(x: np.ndarray, block: int = 512) -> tuple[int, int]:
    """The first pair of largest distance, by products of blocks: no more than `block` rows of distances are held."""
    square, best = (x * x).sum(1), (-1.0, 0, 0)
    for k in range(0, len(x), block):
        d = square[k : k + block, None] + square - 2 * (x[k : k + block] @ x.T)
        at = int(np.argmax(d))
        if d.ravel()[at] > best[0] + 1e-12:
            best = float(d.ravel()[at]), k + at // len(x), at % len(x)
    return best[1], best[2]


def two_means(x: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Halves of unit vectors, seeded by the farthest pair, and the distance of their centres."""
    if len(x) < 2:
        return np.zeros(len(x), np.int64), 0.0
    i, j = farthest(x)
    centres, side = np.stack([x[i], x[j]]), None
    for _ in range(rounds):
        new = np.argmin(np.stack([((x - c) ** 2).sum(1) for c in centres], 1), 1)
        if side is not None and (new == side).all():
            break
        side = new
        for k in (0, 1):
            if (side == k).any():
                m = x[side == k].mean(0)
                centres[k] = m / max(np.linalg.norm(m), 1e-12)
    return side, float(np.linalg.norm(centres[0] - centres[1]))


def split_rows(df: DataFrame, row: str, order: str, vector: str) -> DataFrame:
    """(row, order, side, gap): each row cut in two."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        side, gap = two_means(np.stack(pdf[vector].to_numpy()).astype(float))
        return pd.DataFrame({row: pdf[row], order: pdf[order], "side": side, "gap": gap})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(row, order, vector).groupBy(row).applyInPandas(run, f"{row} {kinds[row]}, {order} {kinds[order]}, side long, gap double")


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id that edges lead to. Labels go to neighbours and jump to the label's own label; each round is checkpointed."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct()
    both = both.checkpoint()
    labels = both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        new = labels.join(near, "id").select("id", F.least("component", "near").alias("low"), "component")
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("next"))
        new = new.join(jump, "low", "left").select("id", F.least("low", F.coalesce("next", "low")).alias("component"), F.col("component").alias("was")).checkpoint()
        changed = new.where("component <> was").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def fold_small(clusters: list[dict], least: int = 2) -> list[dict]:
    """Clusters in order of hue after small ones with compound names, from right to left, went to the nearer neighbour (the
    one before on ties). A cluster has n, low, high (unrolled hues), weight, moment and members; there is no wrap-around,
    since the circle was cut where it is emptiest."""
    live = [dict(c) for c in clusters]
    for c in live:
        c["centre"] = c["moment"] / c["weight"] % 360
    for i in range(len(live) - 1, -1, -1):
        if len(live) < 2 or live[i]["n"] >= least or "-" not in name_of_hue(live[i]["centre"]):
            continue
        before = live[i]["low"] - live[i - 1]["high"] if i else np.inf
        after = live[i + 1]["low"] - live[i]["high"] if i + 1 < len(live) else np.inf
        to = live[i - 1 if before <= after else i + 1]
        for k in ("n", "weight", "moment", "members"):
            to[k] = to[k] + live[i][k]
        to["low"], to["high"] = min(to["low"], live[i]["low"]), max(to["high"], live[i]["high"])
        to["centre"] = to["moment"] / to["weight"] % 360
        del live[i]
    return live


def name_of_hue(h: float) -> str:
    """scalars.hue_name of one value."""
    near = sorted((min(abs(h - v) % 360, 360 - abs(h - v) % 360), i) for i, (_, v) in enumerate(HUES))[:2]
    if near[0][0] <= 18:
        return HUES[near[0][1]][0]
    low, high = sorted(i for _, i in near)
    low, high = (high, low) if (low, high) == (0, len(HUES) - 1) else (low, high)
    return f"{HUES[low][0]}-{HUES[high][0]}"


def folded_clusters(per: DataFrame, doc: str) -> DataFrame:
    """(doc, cluster, family, centre) of clusters (doc, cluster, n, low, high, weight, moment) after folding; clusters of one name are one family, whose order is its least centre."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{**r, "members": [r["cluster"]]} for r in pdf.sort_values("cluster").to_dict("records")]
        out = [(m, name_of_hue(c["centre"]), c["centre"]) for c in fold_small(rows) for m in c["members"]]
        return pd.DataFrame({doc: pdf[doc].iloc[0], "cluster": [m for m, _, _ in out], "family": [f for _, f, _ in out], "centre": [x for _, _, x in out]})

    kind = per.schema[doc].dataType.simpleString()
    return per.groupBy(doc).applyInPandas(run, f"{doc} {kind}, cluster long, family string, centre double")
