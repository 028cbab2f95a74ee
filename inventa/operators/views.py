"""Finished lists in the orders that readers ask for. Each gives a rank column, so the order survives as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inventa.functions.scalars import colour_category, colour_sort_key, half_up, hsl, hue_name
from inventa.operators.cluster import folded_clusters
from inventa.operators.windows import global_rank, hue_clusters


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """rank over the whole list, however long it is."""
    return global_rank(df, *order)


def by_count(rows: DataFrame, ascending: bool = False) -> DataFrame:
    return ranked(rows, F.col("count").asc() if ascending else F.col("count").desc(), F.col("row_id"))


def by_first_page(rows: DataFrame) -> DataFrame:
    return ranked(rows, F.col("first_page"), F.col("row_id"))


def by_colour(rows: DataFrame) -> DataFrame:
    return ranked(rows.withColumn("colour_key", colour_sort_key(F.col("r"), F.col("g"), F.col("b"))), F.col("colour_key"), F.col("row_id"))


def colour_groups(rows: DataFrame) -> DataFrame:
    """family, its order (black, grey, white, brown, then hues) and the rank inside it by count."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    fixed, hue = colour_category(r, g, b), hsl(r, g, b)["h"]
    named = rows.withColumn("hue", hue).withColumn("family", F.coalesce(fixed, hue_name(hue))).withColumn("fixed", fixed.isNotNull())
    first = F.when(F.col("fixed"), F.array_position(F.array(*map(F.lit, ("black", "grey", "white", "brown"))), F.col("family")).cast("double") - 5)
    w = W.partitionBy("family")
    out = named.withColumn("family_order", F.coalesce(first, F.min(F.when(~F.col("fixed"), F.col("hue"))).over(w)))
    return out.withColumn("place", F.row_number().over(w.orderBy(F.desc("count"), "row_id")).cast("long"))


def part_entries(items: DataFrame, row_id: int) -> DataFrame:
    """Where a part occurs."""
    return items.where(F.col("row_id") == row_id)


def first_pages(items: DataFrame, row: str = "row_id", page: str = "page", most: int = 8) -> DataFrame:
    """(row, pages, n_pages): the first pages of each row, as many as a summary shows, and how many there are."""
    w = W.partitionBy(row)
    placed = items.select(row, page).distinct().select(row, page, F.row_number().over(w.orderBy(page)).alias("__k"))
    return placed.groupBy(row).agg(F.array_sort(F.collect_list(F.when(F.col("__k") <= most, F.col(page)))).alias("pages"), F.count("*").alias("n_pages"))


def publish(items: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, payload): one JSON document for each name, with its first and last page and its rows.

    items: name, row_id, page, item_ord, qty, rect (struct of x, y, w, h, or null); rows: row_id, thumb, size (array of
    two, or null), colour (array of three). A row says its picture t, count c, doubt u, sorted pages p, size s, where it
    occurs e (page, quantity, rectangle to four digits) and colour a. A document is gathered in one row, which it is."""
    r4 = F.when(F.col("rect").isNotNull(), F.array(*[half_up(F.col(f"rect.{c}"), 4) for c in "xywh"]))
    entries = F.array_sort(F.collect_list(F.struct("page", "item_ord", "qty", r4.alias("r"))))
    per = items.groupBy("name", "row_id").agg(F.sum(F.coalesce("qty", F.lit(1))).alias("c"), F.bool_or(F.col("qty").isNull()).alias("u"), F.array_sort(F.collect_set("page")).alias("p"), entries.alias("e"))
    full = per.join(rows.select("row_id", F.col("thumb").alias("t"), F.col("size").alias("s"), F.col("colour").alias("a")), "row_id", "left")
    said = F.transform("e", lambda x: F.struct(x["page"].alias("p"), x["qty"].alias("q"), x["r"].alias("r")))
    body = F.array_sort(F.collect_list(F.struct("row_id", "t", "c", "u", "p", "s", said.alias("e"), "a")))
    docs = full.groupBy("name").agg(F.min(F.array_min("p")).alias("from"), F.max(F.array_max("p")).alias("to"), body.alias("rows"))
    return docs.select("name", F.to_json(F.struct("name", "from", "to", "rows"), {"ignoreNullFields": "false"}).alias("payload"))


def adopt(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Rows of published documents, (name, row_id, t, c, u, p, s, e, a); a missing colour is mid grey."""
    entry = "array<struct<p:long,q:long,r:array<double>>>"
    schema = f"name string, from long, to long, rows array<struct<row_id:long,t:string,c:long,u:boolean,p:array<long>,s:array<int>,e:{entry},a:array<double>>>"
    grey = F.array(*[F.lit(128.0)] * 3)
    return payloads.select(F.from_json(column, schema).alias("d")).select("d.name", F.inline("d.rows")).withColumn("a", F.coalesce("a", grey))


def sheet(df: DataFrame, group: str, order: list, tiles: int, columns: int) -> DataFrame:
    """Backing table of a contact sheet: the first tiles of each group, and the line and column where each stands."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long") - 1
    return df.withColumn("tile", place).where(F.col("tile") < tiles).withColumns({"line": F.floor(F.col("tile") / columns), "column": F.col("tile") % columns})


def hue_families(rows: DataFrame, doc: str) -> DataFrame:
    """(doc, row_id, family, family_order, place): fixed families first (black, grey, white, brown), then the clusters of
    hues of each document, small compound ones folded into their neighbours and those of one name merged, by centre; inside
    a family by count. rows: doc, row_id, r, g, b, count. The clusters of a document are few and are folded in one task."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    fixed = colour_category(r, g, b)
    named = rows.select(doc, "row_id", "count", fixed.alias("fixed"), hsl(r, g, b)["h"].alias("hue"))
    free = named.where("fixed is null")
    found = hue_clusters(free, doc, "row_id", "hue").join(free.select(doc, "row_id", "count"), [doc, "row_id"])
    per = found.groupBy(doc, "cluster").agg(F.count("*").alias("n"), F.min("unrolled").alias("low"), F.max("unrolled").alias("high"), F.sum("count").alias("weight"), F.sum(F.col("unrolled") * F.col("count")).alias("moment"))
    folded = folded_clusters(per, doc)
    where = found.join(folded, [doc, "cluster"]).select(doc, "row_id", "count", "family", "centre")
    order = F.array_position(F.array(*map(F.lit, ("black", "grey", "white", "brown"))), F.col("fixed")).cast("double") - 5
    every = named.where("fixed is not null").select(doc, "row_id", "count", F.col("fixed").alias("family"), order.alias("centre")).unionByName(where)
    w = W.partitionBy(doc, "family")
    return every.select(doc, "row_id", "family", F.min("centre").over(w).alias("family_order"), F.row_number().over(w.orderBy(F.desc("count"), "row_id")).cast("long").alias("place"))
