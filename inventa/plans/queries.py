"""Queries over the tables at hand, each beside the SQL that says the same.

Order lines stand for items (order = page, part = row, supplier = box); a quantity above 45 counts as unread. Colours and
bit patterns are derived from keys, so that any engine derives them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inventa.functions import scalars as S
from inventa.operators import aggregate as A
from inventa.operators import cluster as C
from inventa.operators import kernels as K
from inventa.operators import match as M
from inventa.operators import regions as R
from inventa.operators import scan as SC
from inventa.operators import state as ST
from inventa.operators import views as V
from inventa.operators import windows as WN
from inventa.sources.items import items, ordinals, parts, read, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ITEMS = """items AS (
  SELECT l_orderkey AS page, l_partkey AS row_id, CASE WHEN l_quantity <= 45 THEN l_quantity::BIGINT END AS qty,
    l_suppkey AS box, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem)"""
ORDINALS = ITEMS + """, placed AS (
  SELECT *, row_number() OVER (PARTITION BY page ORDER BY l_linenumber, row_id, box, l_quantity, l_shipdate, l_extendedprice) - 1 AS item_ord
  FROM items)"""
PARTS = """parts AS (
  SELECT p_partkey AS row_id, (p_partkey * 37 % 256)::INT AS r, (p_partkey * 59 % 256)::INT AS g, (p_partkey * 83 % 256)::INT AS b,
    p_size AS size, p_name AS name, p_retailprice AS price FROM part)"""
HSL = PARTS + """, hi AS (
  SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS mx, least(r, g, b) / 255.0::DOUBLE AS mn, r / 255.0::DOUBLE AS rr, g / 255.0::DOUBLE AS gg, b / 255.0::DOUBLE AS bb FROM parts),
hsl AS (
  SELECT *, (mx + mn) / 2 * 100 AS l,
    CASE WHEN mx = mn THEN 0.0::DOUBLE WHEN (mx + mn) / 2 > 0.5 THEN (mx - mn) / (2.0::DOUBLE - mx - mn) ELSE (mx - mn) / (mx + mn) END AS s,
    60 * CASE WHEN mx = mn THEN 0.0::DOUBLE WHEN mx = rr THEN (gg - bb) / (mx - mn) + CASE WHEN gg < bb THEN 6 ELSE 0 END
      WHEN mx = gg THEN (bb - rr) / (mx - mn) + 2 ELSE (rr - gg) / (mx - mn) + 4 END AS h
  FROM hi),
fixed AS (
  SELECT *, CASE
    WHEN l < 15 AND greatest(r, g, b) - least(r, g, b) < 30 THEN 'black'
    WHEN l > 90 THEN 'white'
    WHEN s < CASE WHEN h BETWEEN 195 AND 235 THEN 0.22::DOUBLE ELSE 0.13::DOUBLE END
      THEN CASE WHEN l > 82 THEN 'white' WHEN l < 25 THEN 'black' ELSE 'grey' END
    WHEN h >= 18 AND h < 50 AND l >= 10 AND l <= 62 AND s < 0.65::DOUBLE THEN 'brown'
    WHEN h >= 30 AND h < 46 AND l > 68 AND l <= 88 THEN 'brown' END AS category
  FROM hsl)"""
ANCHORS = "anchors(i, n, v) AS (VALUES " + ", ".join(f"({i}, '{n}', {v}::DOUBLE)" for i, (n, v) in enumerate(S.HUES)) + ")"
NAMED = HSL + ", " + ANCHORS + """, near AS (
  SELECT row_id, i, n, d, row_number() OVER (PARTITION BY row_id ORDER BY d, i, n) AS k
  FROM (SELECT row_id, i, n, least(abs(h - v) % 360, 360 - abs(h - v) % 360) AS d FROM fixed, anchors)),
names AS (
  SELECT row_id, CASE WHEN min(d) <= 18 THEN max(CASE WHEN k = 1 THEN n END)
    WHEN min(i) = 0 AND max(i) = 7 THEN arg_max(n, i) || '-' || arg_min(n, i)
    ELSE arg_min(n, i) || '-' || arg_max(n, i) END AS hue_name, min(d) AS distance
  FROM near WHERE k <= 2 GROUP BY row_id)"""


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _dist(a: str, b: str):
    return S.euclidean(F.col(a), F.col(b))


DIST = "sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: power({a}[i]::DOUBLE - {b}[i]::DOUBLE, 2))))"

# Scans and lists -----------------------------------------------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT page, row_id, qty FROM items WHERE page BETWEEN 100 AND 400")
def page_range_scan(spark, sf):
    return SC.page_range(items(spark, sf), 100, 400, 1_000_000).select("page", "row_id", "qty")


@query("SELECT o_orderkey AS page, o_totalprice AS total FROM orders WHERE o_orderkey >= 1 AND (o_orderkey - 1) % 125 = 0")
def systematic_page_sample(spark, sf):
    pages = read(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_totalprice").alias("total"))
    return SC.systematic_sample(pages, 1, 1000)


@query("""SELECT o_orderkey AS page, s.scale FROM orders, (VALUES (3.0::DOUBLE), (2.4::DOUBLE), (1.9::DOUBLE)) s(scale)""")
def pages_at_scales(spark, sf):
    return SC.at_scales(read(spark, sf, "orders").select(F.col("o_orderkey").alias("page")), [3.0, 2.4, 1.9])


@query(f"""WITH {ITEMS} SELECT row_id, sum(coalesce(qty, 1))::BIGINT AS count, bool_or(qty IS NULL) AS unsure,
  count(DISTINCT page) AS n_pages, min(page) AS first_page FROM items GROUP BY row_id""")
def parts_list(spark, sf):
    return A.parts_list(items(spark, sf))


@query(f"""WITH {ITEMS} SELECT count(DISTINCT row_id) AS rows, sum(coalesce(qty, 1))::BIGINT AS pieces,
  count(DISTINCT page) AS pages_with_items, count(*) FILTER (qty IS NULL) AS unread, (SELECT count(DISTINCT o_orderkey) FROM orders) AS pages FROM items""")
def parts_summary(spark, sf):
    return A.summary(items(spark, sf), read(spark, sf, "orders").select(F.col("o_orderkey").alias("page")))


LIST = f"""WITH {ITEMS}, list AS (
  SELECT row_id, sum(coalesce(qty, 1))::BIGINT AS count, min(page) AS first_page FROM items GROUP BY row_id) """


@query(LIST + "SELECT row_id, count, row_number() OVER (ORDER BY count DESC, row_id) AS rank FROM list")
def sort_count_desc(spark, sf):
    return V.by_count(A.parts_list(items(spark, sf)).select("row_id", "count"))


@query(LIST + "SELECT row_id, count, row_number() OVER (ORDER BY count, row_id) AS rank FROM list")
def sort_count_asc(spark, sf):
    return V.by_count(A.parts_list(items(spark, sf)).select("row_id", "count"), True)


@query(LIST + "SELECT row_id, first_page, row_number() OVER (ORDER BY first_page, row_id) AS rank FROM list")
def sort_first_page(spark, sf):
    return V.by_first_page(A.parts_list(items(spark, sf)).select("row_id", "first_page"))


@query(f"""WITH {HSL} SELECT row_id, round(CASE WHEN s < 0.15::DOUBLE THEN 400 + l ELSE h END, 6) AS colour_key,
  row_number() OVER (ORDER BY round(CASE WHEN s < 0.15::DOUBLE THEN 400 + l ELSE h END, 6), row_id) AS rank FROM hsl""")
def sort_color(spark, sf):
    p = parts(spark, sf).withColumn("colour_key", F.round(S.colour_sort_key(F.col("r"), F.col("g"), F.col("b")), 6))
    return V.ranked(p.select("row_id", "colour_key"), F.col("colour_key"), F.col("row_id"))


@query(f"""WITH {NAMED}, l AS (
  SELECT f.row_id, f.h, coalesce(f.category, names.hue_name) AS family, f.category IS NOT NULL AS is_fixed, f.size::BIGINT AS count FROM fixed f JOIN names USING (row_id))
SELECT row_id, family, row_number() OVER (PARTITION BY family ORDER BY count DESC, row_id) AS place,
  round(CASE WHEN is_fixed THEN list_position(['black', 'grey', 'white', 'brown'], family)::DOUBLE - 5
    ELSE min(CASE WHEN NOT is_fixed THEN h END) OVER (PARTITION BY family) END, 6) AS family_order FROM l""")
def color_groups(spark, sf):
    rows = parts(spark, sf).withColumn("count", F.col("size").cast("long"))
    return V.colour_groups(rows).select("row_id", "family", "place", F.round("family_order", 6).alias("family_order"))


# Scalars -------------------------------------------------------------------------------------------------------------


@query(f"WITH {HSL} SELECT row_id, round(h, 6) AS h, round(s, 6) AS s, round(l, 6) AS l FROM hsl")
def hsl_from_rgb(spark, sf):
    x = S.hsl(F.col("r"), F.col("g"), F.col("b"))
    return parts(spark, sf).select("row_id", *[F.round(v, 6).alias(k) for k, v in x.items()])


@query(f"WITH {HSL} SELECT row_id, category FROM fixed")
def color_category(spark, sf):
    return parts(spark, sf).select("row_id", S.colour_category(F.col("r"), F.col("g"), F.col("b")).alias("category"))


@query(f"WITH {NAMED} SELECT row_id, hue_name, round(distance, 6) AS distance FROM names")
def nearest_hue_anchor(spark, sf):
    h = S.hsl(F.col("r"), F.col("g"), F.col("b"))["h"]
    d = F.least(*[S.hue_distance(h, F.lit(float(v))) for _, v in S.HUES])
    return parts(spark, sf).select("row_id", S.hue_name(h).alias("hue_name"), F.round(d, 6).alias("distance"))


@query("""SELECT event_id, CASE WHEN try_cast(d AS BIGINT) BETWEEN 1 AND 200 THEN try_cast(d AS BIGINT) END AS qty
FROM (SELECT event_id, CASE WHEN regexp_matches(t, '^[0-9]+[xX]*$') THEN regexp_replace(t, '[xX]+$', '') END AS d
  FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'x' WHEN event_id % 5 = 0 THEN 'a' || event_id ELSE (event_id % 300) || CASE WHEN event_id % 2 = 0 THEN 'X' ELSE 'xx' END END AS t FROM events))""")
def parse_quantity(spark, sf):
    i = F.col("event_id")
    text = F.when(i % 7 == 0, "x").when(i % 5 == 0, F.concat(F.lit("a"), i.cast("string"))).otherwise(F.concat((i % 300).cast("string"), F.when(i % 2 == 0, "X").otherwise("xx")))
    return read(spark, sf, "events").select("event_id", S.parse_quantity(text).alias("qty"))


@query(f"""WITH {ITEMS}, p AS (SELECT row_id, list_sort(list(DISTINCT page)) AS pages FROM items GROUP BY row_id)
SELECT row_id, CASE WHEN len(pages) <= 8 THEN array_to_string(pages, ', ')
  ELSE array_to_string(pages[1:7], ', ') || ' +' || (len(pages) - 7) END AS pages FROM p""")
def page_summary(spark, sf):
    return V.first_pages(items(spark, sf)).select("row_id", S.page_summary(F.col("pages"), 8, F.col("n_pages")).alias("pages"))


@query("""WITH v AS (SELECT p_partkey AS row_id, (p_partkey % 3) || '.' || (p_partkey % 11) AS a, (p_partkey % 2) || '.' || (p_partkey % 13) || '.' || (p_partkey % 5) AS b FROM part)
SELECT row_id, list_concat(list_transform(string_split(a, '.'), lambda x: x::INT), [0]) > list_transform(string_split(b, '.'), lambda x: x::INT) AS newer FROM v""")
def version_compare(spark, sf):
    k = F.col("row_id")
    a = F.concat_ws(".", (k % 3).cast("string"), (k % 11).cast("string"))
    b = F.concat_ws(".", (k % 2).cast("string"), (k % 13).cast("string"), (k % 5).cast("string"))
    return parts(spark, sf).select("row_id", S.newer_version(a, b).alias("newer"))


@query("""WITH a AS (SELECT event_id, greatest(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)), 0)::BIGINT AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN s // 60 || ' min' WHEN s < 86400 THEN s // 3600 || ' h'
  WHEN s < 2592000 THEN s // 86400 || ' d' WHEN s < 31104000 THEN s // 2592000 || ' mo' ELSE s // 31104000 || ' y' END AS age FROM a""")
def time_ago(spark, sf):
    return read(spark, sf, "events").select("event_id", S.time_ago(F.col("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("age"))


@query("""SELECT p_partkey AS row_id, CASE WHEN p_size % 10 = 1 AND p_size % 100 <> 11 THEN 'one' WHEN p_size % 10 BETWEEN 2 AND 4 AND p_size % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS form,
  replace(replace(replace(replace(replace(p_name || '<&>"' || chr(39), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS safe, p_name || '::' || p_size AS file_key,
  floor((p_size + 1) / 60.0::DOUBLE * 100 + 0.5)::BIGINT AS progress, floor(p_retailprice * 10 + 0.5) / 10 AS price,
  greatest(0, least(25, p_size)) AS clamped, greatest(p_size, 4) || '×' || least(p_size, 4) AS label, round(ln(p_size / 7.0::DOUBLE), 6) AS aspect FROM part""")
def item_labels(spark, sf):
    n = F.col("size")
    safe = S.escape_html(F.concat("name", F.lit("<&>\"'")))
    return parts(spark, sf).select(
        "row_id", S.plural(n, F.lit("one"), F.lit("few"), F.lit("many")).alias("form"), safe.alias("safe"), S.file_key(F.col("name"), n).alias("file_key"),
        S.progress(n, F.lit(60)).alias("progress"), S.half_up(F.col("price"), 1).alias("price"), S.clamp(n, 0, 25).alias("clamped"),
        S.size_label(n, F.lit(4)).alias("label"), F.round(S.log_aspect(n, F.lit(7.0)), 6).alias("aspect"),
    )


@query("SELECT p_partkey AS row_id, lpad(to_hex(p_partkey), 6, '0') AS hex, bit_count(p_partkey)::BIGINT AS ones FROM part")
def hex_bits_roundtrip(spark, sf):
    p = parts(spark, sf).withColumn("bits", S.bits_from_hex(F.lpad(F.hex("row_id"), 6, "0"), 24))
    return p.select("row_id", F.upper(S.hex_from_bits(F.col("bits"))).alias("hex"), F.aggregate("bits", F.lit(0), lambda s, x: s + x).cast("long").alias("ones"))


@query("""SELECT p_partkey AS row_id, round((5.0::DOUBLE * 7 - 2 * p_size) / 31, 6) AS x, round((3.0::DOUBLE * p_size - 4 * 5) / 31 , 6) AS y FROM part""".replace("(5.0::DOUBLE * 7 - 2 * p_size) / 31", "(5.0::DOUBLE * 9 - 2 * p_size) / 19").replace("(3.0::DOUBLE * p_size - 4 * 5) / 31", "(3.0::DOUBLE * p_size - 4 * 5) / 19"))
def stud_solve(spark, sf):
    lit = lambda v: F.lit(float(v))
    x, y = S.cramer(lit(3), lit(2), lit(4), lit(9), lit(5), F.col("size").cast("double"))
    return parts(spark, sf).select("row_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


# Windows -------------------------------------------------------------------------------------------------------------


@query(f"WITH {ORDINALS} SELECT page, item_ord, row_id, qty FROM placed")
def page_ordinal(spark, sf):
    return ordinals(items(spark, sf)).select("page", "item_ord", "row_id", "qty")


@query(f"WITH {ITEMS} SELECT page, row_id, qty, p_name AS name FROM items JOIN part ON p_partkey = row_id WHERE page = 77")
def step_items(spark, sf):
    return items(spark, sf).where("page = 77").join(parts(spark, sf).select("row_id", "name"), "row_id").select("page", "row_id", "qty", "name")


@query(f"""WITH {ITEMS} SELECT row_id, sum(coalesce(qty, 1))::BIGINT AS remaining, bool_or(qty IS NULL) AS unsure, count(DISTINCT page) AS n_pages
FROM items WHERE page > 7000 GROUP BY row_id""")
def remaining_after_step(spark, sf):
    return WN.remaining_after(items(spark, sf), 7000)


@query(f"""WITH {ITEMS}, i AS (SELECT o_custkey AS doc, items.* FROM items JOIN orders ON o_orderkey = page),
per AS (SELECT doc, row_id, page, sum(coalesce(qty, 1)) AS q FROM i GROUP BY ALL), steps AS (SELECT DISTINCT doc, page AS step FROM i)
SELECT steps.doc, step AS page, row_id, sum(q)::BIGINT AS remaining FROM steps JOIN per ON per.doc = steps.doc AND page > step GROUP BY ALL""")
def remaining_all_steps(spark, sf):
    """All orders of a customer are one document."""
    docs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("doc"))
    return WN.remaining_all(items(spark, sf).join(docs, "page"), "doc")


@query(f"""WITH {ORDINALS} SELECT page, item_ord, qty, sum(coalesce(qty, 1)) OVER ()::BIGINT AS pieces, count(*) OVER () AS entries FROM placed WHERE row_id = 42""")
def part_occurrences(spark, sf):
    found = V.part_entries(ordinals(items(spark, sf)), 42).select("page", "item_ord", "qty")
    totals = found.agg(F.sum(F.coalesce("qty", F.lit(1))).alias("pieces"), F.count("*").alias("entries"))
    return found.join(F.broadcast(totals))  # one row


HUE = NAMED + """, g AS (
  SELECT doc, row_id, hue, row_number() OVER w AS i, coalesce(lead(hue) OVER w, first(hue) OVER w + 360) - hue AS gap
  FROM (SELECT size AS doc, row_id, round(h, 3) AS hue FROM fixed WHERE category IS NULL) WINDOW w AS (PARTITION BY doc ORDER BY hue, row_id)),
cut AS (SELECT doc, i AS c FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY gap DESC, i) AS o FROM g) WHERE o = 1),
t AS (SELECT doc, row_id, CASE WHEN i > c OR c = count(*) OVER (PARTITION BY doc) THEN hue ELSE hue + 360 END AS u FROM g JOIN cut USING (doc)),
k AS (SELECT doc, row_id, u, CASE WHEN u - lag(u) OVER (PARTITION BY doc ORDER BY u, row_id) >= 22 THEN 1 ELSE 0 END AS f FROM t),
cl AS (SELECT doc, row_id, u, sum(f) OVER (PARTITION BY doc ORDER BY u, row_id)::BIGINT AS cluster FROM k)"""


@query(f"WITH {HUE} SELECT doc, row_id, cluster, round(u, 3) AS unrolled FROM cl")
def hue_gap_clusters(spark, sf):
    """Parts of one size are one document."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    p = parts(spark, sf).where(S.colour_category(r, g, b).isNull()).select(F.col("size").alias("doc"), "row_id", F.round(S.hsl(r, g, b)["h"], 3).alias("hue"))
    return WN.hue_clusters(p, "doc", "row_id", "hue").select("doc", "row_id", "cluster", F.round("unrolled", 3).alias("unrolled"))


@query(f"WITH {HUE} SELECT doc, cluster, round((((sum(u * row_id) / sum(row_id)) % 360) + 360) % 360, 4) AS centre FROM cl GROUP BY doc, cluster")
def hue_cluster_centres(spark, sf):
    return WN.circular_centroid(hue_gap_clusters(spark, sf), ["doc", "cluster"], "unrolled", "row_id").select("doc", "cluster", F.round("centre", 4).alias("centre"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value > 30 AS f FROM events),
n AS (SELECT user_id, max(i) + 1 AS n FROM e GROUP BY user_id),
m AS (SELECT user_id, i, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) - 1 AS gap FROM e WHERE f),
r AS (SELECT user_id, i, sum(CASE WHEN gap IS NULL OR gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS k FROM m),
s AS (SELECT user_id, k, min(i) AS start, max(i) + 1 AS e FROM r GROUP BY ALL)
SELECT user_id, start, CASE WHEN k = max(k) OVER (PARTITION BY user_id) AND n > e AND n - e < 2 THEN n ELSE e END AS "end" FROM s JOIN n USING (user_id)""")
def gap_runs(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").select("user_id", (F.row_number().over(w).cast("long") - 1).alias("i"), "value")
    return WN.runs(e, ["user_id"], "i", F.col("value") > 30, 2)


@query("""SELECT event_id, round(sum(value) OVER w, 4) AS around, min(value) OVER w AS low, max(value) OVER w AS high FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def moving_neighbourhood(spark, sf):
    e = WN.moving(read(spark, sf, "events"), ["user_id"], "event_id", "value", 4)
    return e.select("event_id", F.round("around", 4).alias("around"), "low", "high")


@query(f"""WITH {ITEMS} SELECT box, row_id, page, l_extendedprice AS price, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY box ORDER BY l_extendedprice DESC, page, row_id) AS rank FROM items) WHERE rank <= 2""")
def largest_two_per_box(spark, sf):
    return WN.top_k(items(spark, sf), ["box"], [F.desc("l_extendedprice"), "page", "row_id"], 2).select("box", "row_id", "page", F.col("l_extendedprice").alias("price"), "rank")


# Votes and statistics ------------------------------------------------------------------------------------------------


@query("""WITH b AS (
  SELECT p_size AS doc, (((k * 37 % 256) >> 3) << 10) | (((k * 59 % 256) >> 3) << 5) | ((k * 83 % 256) >> 3) AS bin, count(*) AS n, min(k) AS seen,
    avg(k * 37 % 256) AS r, avg(k * 59 % 256) AS g, avg(k * 83 % 256) AS b FROM (SELECT p_size, p_partkey AS k FROM part) GROUP BY ALL)
SELECT doc, n, bin::INT AS bin, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, seen) AS k FROM b) WHERE k = 1""")
def modal_bin_mean(spark, sf):
    out = A.modal_bin_mean(parts(spark, sf).withColumnRenamed("size", "doc"), ["doc"], ["r", "g", "b"], "row_id")
    return out.select("doc", "n", F.col("bin").cast("int").alias("bin"), *[F.round(c, 6).alias(c) for c in "rgb"])


@query("""WITH px AS (SELECT p_size AS doc, p_partkey AS k, p_partkey * 37 % 256 AS r, p_partkey * 59 % 256 AS g, p_partkey * 83 % 256 AS b FROM part),
bins AS (SELECT doc, (r >> 5) * 64 + (g >> 5) * 8 + (b >> 5) AS bin, count(*) AS n, min(k) AS seen, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM px GROUP BY ALL),
top AS (SELECT doc, max(n) AS n, sum(n) AS total FROM bins GROUP BY doc),
plain AS (SELECT doc, mr AS r, mg AS g, mb AS b FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, seen) AS o FROM bins) x JOIN top t USING (doc) WHERE o = 1 AND t.n >= 0.1::DOUBLE * total),
seek AS (SELECT x.doc, x.bin, x.seen, count(*) AS n, avg(p.r) AS r, avg(p.g) AS g, avg(p.b) AS b FROM bins x JOIN top t ON t.doc = x.doc AND t.n < 0.1::DOUBLE * total
  JOIN px p ON p.doc = x.doc AND greatest(abs(p.r - mr), abs(p.g - mg), abs(p.b - mb)) <= 45 GROUP BY ALL)
SELECT doc, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM plain
UNION ALL SELECT doc, round(r, 6), round(g, 6), round(b, 6) FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, seen) AS o FROM seek) WHERE o = 1""")
def dominant_colour(spark, sf):
    out = A.dominant_colour(parts(spark, sf).withColumnRenamed("size", "doc"), ["doc"], ["r", "g", "b"], "row_id")
    return out.select("doc", *[F.round(c, 6).alias(c) for c in "rgb"])


@query(f"""WITH {ITEMS} SELECT box, round(sum(l_extendedprice), 2) AS weight, count(DISTINCT page) AS pages, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 6) AS fill
FROM items GROUP BY box HAVING count(DISTINCT page) >= 3 ORDER BY sum(l_extendedprice) DESC, box LIMIT 1""")
def weighted_fill_vote(spark, sf):
    v = A.weighted_vote(items(spark, sf), "box", "l_extendedprice", "l_quantity", "page", 3)
    return v.select("box", F.round("weight", 2).alias("weight"), "pages", F.round("fill", 6).alias("fill"))


@query(f"""WITH {ITEMS}, m AS (SELECT box, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS median FROM items GROUP BY box),
j AS (SELECT *, abs(l_quantity - median) <= 0.3::DOUBLE * median AS near FROM items JOIN m USING (box)),
k AS (SELECT *, bool_or(near) OVER (PARTITION BY box) AS any_near FROM j)
SELECT box, page, row_id, l_quantity AS quantity, median FROM k WHERE near OR NOT any_near""")
def upper_median_filter(spark, sf):
    return A.near_median(items(spark, sf), ["box"], "l_quantity", 0.3).select("box", "page", "row_id", F.col("l_quantity").alias("quantity"), "median")


@query("""WITH m AS (SELECT list_sort(list(value))[len(list(value)) // 2 + 1] AS med FROM events WHERE value > 0)
SELECT event_id, value FROM events, m WHERE value IS NULL OR value <= 0 OR value >= 0.34::DOUBLE * med""")
def believable_pitch(spark, sf):
    return A.believable(read(spark, sf, "events").select("event_id", "value"), "value")


READ = f"""WITH {ORDINALS}, readings AS (
  SELECT row_id, (l_quantity::BIGINT % 4) AS size, page * 1000 + item_ord AS ord, (page % 20) / 100.0::DOUBLE AS err FROM placed),
per AS (SELECT row_id, size, count(*) AS n, min(ord) AS first_ord, min(err) AS err FROM readings GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY row_id) AS total, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, first_ord) AS rank FROM per) """


def _readings(spark, sf) -> DataFrame:
    i = ordinals(items(spark, sf))
    return i.select("row_id", (F.col("l_quantity").cast("long") % 4).alias("size"), (F.col("page") * 1000 + F.col("item_ord")).alias("ord"), ((F.col("page") % 20) / F.lit(100.0)).alias("err"))


@query(READ + "SELECT row_id, size, n, round(n / total::DOUBLE, 6) AS share FROM ranked WHERE rank = 1 AND ((n >= 2 AND 2 * n > total) OR (total = 1 AND err <= 0.1::DOUBLE))")
def size_vote(spark, sf):
    return A.size_vote(_readings(spark, sf)).select("row_id", "size", "n", F.round("share", 6).alias("share"))


SPLIT = READ + """, moved AS (
  SELECT row_id, size, n, (SELECT max(row_id) FROM readings) + row_number() OVER (ORDER BY row_ord, row_id, rank) AS new_row
  FROM (SELECT *, min(first_ord) OVER (PARTITION BY row_id) AS row_ord FROM ranked) WHERE rank > 1 AND n >= 2) """


@query(SPLIT + "SELECT row_id, size, n, new_row FROM moved")
def row_split(spark, sf):
    return A.row_split(_readings(spark, sf))


@query(SPLIT + """SELECT coalesce(m.new_row, p.row_id) AS row_id, sum(coalesce(qty, 1))::BIGINT AS count, bool_or(qty IS NULL) AS unsure, count(DISTINCT page) AS n_pages, min(page) AS first_page
FROM placed p LEFT JOIN moved m ON m.row_id = p.row_id AND m.size = p.l_quantity::BIGINT % 4 GROUP BY 1""")
def row_split_recount(spark, sf):
    """The list after quantities have moved to the new rows."""
    i = ordinals(items(spark, sf))
    r = i.select("page", "item_ord", "row_id", (F.col("l_quantity").cast("long") % 4).alias("size"), (F.col("page") * 1000 + F.col("item_ord")).alias("ord"))
    return A.parts_list(A.split_items(i, r, ["page", "item_ord"]))


@query(READ + "SELECT row_id, size, n FROM ranked WHERE 2 * n > total")
def slot_vote(spark, sf):
    return A.strict_majority(_readings(spark, sf), "row_id", "size").select("row_id", "size", "n")


AGREE = f"""WITH {ITEMS}, m AS (SELECT page, CASE WHEN qty % 3 > 0 THEN qty % 3 END AS size FROM items),
s AS (SELECT page, count(size) AS m, count(DISTINCT size) AS k, min(size) AS size FROM m GROUP BY page),
t AS (SELECT page, max(n) AS top FROM (SELECT page, size, count(size) AS n FROM m GROUP BY ALL) GROUP BY page) """


@query(AGREE + """SELECT count(*) AS slots, count(*) FILTER (m >= 1) AS measured, count(*) FILTER (m >= 3) AS at_all, count(*) FILTER (m >= 3 AND k = 1) AS agree,
  count(*) FILTER (top >= 2) AS voted, count(*) FILTER (top >= 2 AND k = 1) AS unanimous FROM s JOIN t USING (page)""")
def scale_agreement(spark, sf):
    i = items(spark, sf).withColumn("size", F.when(F.col("qty") % 3 > 0, F.col("qty") % 3))
    return A.scale_agreement(i, ["page"], 3, "size")


@query(AGREE + "SELECT size, count(*) AS slots FROM s WHERE m >= 3 AND k = 1 GROUP BY size ORDER BY slots DESC, size LIMIT 16")
def agreed_sizes_top16(spark, sf):
    i = items(spark, sf).withColumn("size", F.when(F.col("qty") % 3 > 0, F.col("qty") % 3))
    return A.agreed_sizes(i, ["page"], 3, "size")


@query(f"""WITH {ITEMS}, per AS (SELECT page, l_linenumber % 3 AS scale, count(DISTINCT row_id) AS slots FROM items GROUP BY ALL)
SELECT page, count(*) AS scales, min(slots) AS slots FROM per GROUP BY page HAVING count(*) = 3 AND min(slots) = max(slots)""")
def consistent_boxes(spark, sf):
    return SC.consistent_boxes(items(spark, sf).withColumn("scale", F.col("l_linenumber") % 3), ["page"], "scale", "row_id", 3)


@query("""SELECT p_size AS size, count(*) AS members, """ + " || ".join(f"CASE WHEN 2 * sum((p_partkey >> {9 - i}) & 1) > count(*) THEN '1' ELSE '0' END" for i in range(10)) + " AS prototype FROM part GROUP BY p_size")
def bitwise_majority(spark, sf):
    return A.bit_majority(parts(spark, sf).withColumn("bits", F.col("row_id") % 1024), "size", "bits", 10)


@query(f"""WITH {ORDINALS}, l AS (SELECT qty % 10 AS label, CASE WHEN item_ord = max(item_ord) OVER (PARTITION BY page) THEN 1 ELSE 0 END AS last FROM placed)
SELECT label, count(*) AS n, round(avg(last), 6) AS share, avg(last) > 0.8::DOUBLE AS is_suffix FROM l GROUP BY label""")
def last_position_share(spark, sf):
    i = ordinals(items(spark, sf)).withColumn("label", F.col("qty") % 10)
    return A.last_share(i, "label", ["page"], ["item_ord"]).select("label", "n", F.round("share", 6).alias("share"), "is_suffix")


VECTORS = """e AS (SELECT vec_id, embedding, vec_id // 4 AS slot, vec_id // 32 AS box, label, vec_id * 37 % 256 AS shade, ln((3 + vec_id % 13) / (3.0::DOUBLE + vec_id % 7)) AS aspect FROM embeddings)"""
PAIRS = VECTORS + ", pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, a.slot = b.slot AS same, a.box AS box, abs(a.shade - b.shade) AS gap, abs(a.aspect - b.aspect) AS skew, " + DIST.format(a="a.embedding", b="b.embedding") + """ AS d
  FROM e a JOIN e b ON (a.slot = b.slot AND a.vec_id < b.vec_id) OR (a.box = b.box AND a.slot < b.slot))"""


def _vectors(spark, sf) -> DataFrame:
    """Four vectors are one slot, eight slots one box."""
    k = F.col("vec_id")
    aspect = F.ln((3 + k % 13) / (F.lit(3.0) + k % 7))
    return read(spark, sf, "embeddings").select("vec_id", "embedding", F.floor(k / 4).alias("slot"), F.floor(k / 32).alias("box"), "label", (k * 37 % 256).alias("shade"), aspect.alias("aspect"))


def _pairs(spark, sf) -> DataFrame:
    p = M.training_pairs(_vectors(spark, sf), "slot", "box", "vec_id", lambda _: _dist("a.embedding", "b.embedding"), also=["shade", "aspect", "box"])
    return p.withColumns({"gap": F.abs(F.col("a_shade") - F.col("b_shade")), "skew": F.abs(F.col("a_aspect") - F.col("b_aspect"))})


@query(f"""WITH {PAIRS} SELECT round(avg(CASE WHEN same THEN (d > 1.3)::INT END), 6) AS duplicate_rate, round(avg(CASE WHEN NOT same THEN (d <= 1.3)::INT END), 6) AS merge_rate,
  count(*) FILTER (same) AS same_pairs, count(*) FILTER (NOT same) AS other_pairs, round(coalesce(avg(CASE WHEN NOT same AND gap < 30 AND skew < 0.1::DOUBLE THEN (d <= 1.3)::INT END), 0), 6) AS hard_merge_rate,
  count(*) FILTER (NOT same AND gap < 30 AND skew < 0.1::DOUBLE) AS hard_pairs FROM pairs""")
def error_rates_at_threshold(spark, sf):
    """Pairs of one slot are one part, those of one box and different slots are not; hard ones differ little in colour and shape."""
    r = A.error_rates(_pairs(spark, sf), "d", "same", 1.3, (F.col("gap") < 30) & (F.col("skew") < 0.1))
    return r.select(*[F.round(c, 6).alias(c) for c in ("duplicate_rate", "merge_rate", "hard_merge_rate")], "same_pairs", "other_pairs", "hard_pairs")


def _sweep_sql(low: float, high: float, points: int) -> str:
    step = (high - low) / (points - 1)
    t = f"({low}::DOUBLE + k * {step!r}::DOUBLE)"
    return f"""WITH {PAIRS}, grid AS (SELECT unnest(range(0, {points})) AS k), r AS (
  SELECT k, avg(CASE WHEN same THEN (d > {t})::INT END) AS dup, avg(CASE WHEN NOT same THEN (d <= {t})::INT END) AS mrg FROM pairs, grid GROUP BY k)
SELECT round({t}, 6) AS threshold, round(dup, 6) AS duplicate_rate, round(mrg, 6) AS merge_rate FROM r ORDER BY round(dup + mrg, 12), k LIMIT 1"""


def _sweep(spark, sf, low: float, high: float, points: int) -> DataFrame:
    r = A.threshold_sweep(_pairs(spark, sf), "d", "same", low, high, points)
    return r.select(*[F.round(c, 6).alias(c) for c in ("threshold", "duplicate_rate", "merge_rate")])


@query(_sweep_sql(0.0, 2.0, 400))
def threshold_sweep(spark, sf):
    """The grid of training."""
    return _sweep(spark, sf, 0.0, 2.0, 400)


@query(_sweep_sql(0.02, 1.5, 300))
def threshold_sweep_300(spark, sf):
    """The grid of quality control."""
    return _sweep(spark, sf, 0.02, 1.5, 300)


@query(f"""WITH {PAIRS} SELECT t AS threshold, round(avg(CASE WHEN same THEN (gap > t)::INT END), 6) AS false_splits, round(avg(CASE WHEN NOT same THEN (gap > t)::INT END), 6) AS caught
FROM pairs, (VALUES (12.0::DOUBLE), (16), (20), (24), (30), (40), (50)) g(t) GROUP BY t""")
def veto_rates(spark, sf):
    """What each colour veto would cost and catch."""
    r = A.rates_by_threshold(_pairs(spark, sf), "gap", "same", [12, 16, 20, 24, 30, 40, 50])
    return r.select("threshold", F.round("false_splits", 6).alias("false_splits"), F.round("caught", 6).alias("caught"))


@query(f"WITH {PAIRS} SELECT box, i, j, round(d, 6) AS distance, gap FROM pairs WHERE NOT same AND d < 1.2::DOUBLE AND gap < 40")
def suspicious_pairs(spark, sf):
    """Slots of one box that look alike."""
    p = A.suspicious_pairs(_pairs(spark, sf).where("not same"), "d", "gap", 1.2, 40)
    return p.select(F.col("a_box").alias("box"), "i", "j", F.round("d", 6).alias("distance"), "gap")


@query(f"""WITH {VECTORS}, x AS (SELECT vec_id, shade, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM e),
d AS (SELECT (k * 7919 + 13) % n AS a, (k * 104729 + 71) % n AS b FROM (SELECT unnest(range(0, 5000)) AS k), (SELECT count(*) AS n FROM e))
SELECT p.vec_id AS i, q.vec_id AS j FROM d JOIN x p ON p.r = d.a JOIN x q ON q.r = d.b WHERE abs(p.shade - q.shade) > 90""")
def theta_negatives(spark, sf):
    """Drawn pairs whose colours are too far apart for one part."""
    return M.theta_negatives(_vectors(spark, sf), "vec_id", 5000, lambda a, b: F.abs(F.col(f"{a}.shade") - F.col(f"{b}.shade")) > 90)


@query("""SELECT round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS largest, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.999), 4) AS p999 FROM lineitem""")
def percentile_report(spark, sf):
    r = A.percentiles(read(spark, sf, "lineitem"), "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p999": 0.999})
    return r.select(F.round("mean", 4).alias("mean"), "largest", *[F.round(c, 4).alias(c) for c in ("p05", "p50", "p95", "p999")])


@query("""SELECT o_orderkey AS page, o_orderpriority AS doc, o_orderkey > quantile_cont(o_orderkey::DOUBLE, 0.8) OVER (PARTITION BY o_orderpriority) AS is_test FROM orders""")
def holdout_split(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderpriority").alias("doc"))
    return A.holdout_by_quantile(o, "doc", "page")


@query(f"""WITH {ITEMS}, per AS (SELECT box, l_linenumber AS v, count(DISTINCT row_id) AS n FROM items GROUP BY ALL), b AS (SELECT box, min(n) AS low, max(n) AS high FROM per GROUP BY box)
SELECT count(*) AS boxes, count(*) FILTER (low <> high) AS cut_differently, coalesce(sum(CASE WHEN low <> high THEN high END), 0)::BIGINT AS slots_affected FROM b""")
def dataset_audit(spark, sf):
    return A.box_audit(items(spark, sf), "box", "l_linenumber", "row_id")


@query(f"""WITH {ITEMS} SELECT box, max(l_quantity) - min(l_quantity) AS spread FROM items GROUP BY box""")
def spread_per_slot(spark, sf):
    return A.spread(items(spark, sf), ["box"], "l_quantity")


@query(f"""WITH {ITEMS}, s AS (SELECT row_id, max(l_extendedprice) - min(l_extendedprice) AS d FROM items GROUP BY row_id)
SELECT round(avg(d), 4) AS mean, max(d) AS largest, round(quantile_cont(d, 0.95), 4) AS p95, round(quantile_cont(d, 0.99), 4) AS p99 FROM s""")
def spread_percentiles(spark, sf):
    r = A.percentiles(A.spread(items(spark, sf), ["row_id"], "l_extendedprice"), "spread", {"p95": 0.95, "p99": 0.99})
    return r.select(F.round("mean", 4).alias("mean"), "largest", F.round("p95", 4).alias("p95"), F.round("p99", 4).alias("p99"))


@query("""WITH m AS (SELECT o_orderkey AS page, (o_orderkey % 10) / 1000.0::DOUBLE AS od, (o_orderkey % 7) / 1000.0::DOUBLE AS om, (o_orderkey % 13) / 1000.0::DOUBLE AS nd, (o_orderkey % 11) / 1000.0::DOUBLE AS nm FROM orders)
SELECT page, greatest(nd - od, nm - om) <= 0.005::DOUBLE OR greatest(od - nd, om - nm) >= 3 * greatest(nd - od, nm - om) AS accepted FROM m""")
def finetune_gate(spark, sf):
    k = F.col("o_orderkey")
    m = lambda n: (k % n) / F.lit(1000.0)
    return read(spark, sf, "orders").select(k.alias("page"), A.accept_model(m(10), m(7), m(13), m(11)).alias("accepted"))


# Matching ------------------------------------------------------------------------------------------------------------

TEMPLATES = [(i, (i * 331 + 77) % 1024, chr(48 + i)) for i in range(10)]
TEMPLATE_SQL = "templates(ord, bits, label) AS (VALUES " + ", ".join(f"({i}, {b}, '{n}')" for i, b, n in TEMPLATES) + ")"


@query(f"""WITH {TEMPLATE_SQL}, d AS (SELECT p_partkey AS row_id, ord, label, bit_count(xor(p_partkey % 1024, bits::BIGINT))::INT AS distance FROM part, templates)
SELECT row_id, distance, ord, label FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, ord) AS k FROM d) WHERE k = 1""")
def nearest_template_hamming(spark, sf):
    t = spark.createDataFrame(TEMPLATES, "ord int, bits long, label string")
    p = spread(parts(spark, sf).select("row_id", (F.col("row_id") % 1024).alias("own")))
    return M.nearest_template(p, t, ["row_id"], lambda x: S.hamming_packed(F.col("own"), x["bits"]), ["label"])


@query(f"""WITH {VECTORS}, heads AS (SELECT min(vec_id) AS row_id FROM e GROUP BY label),
d AS (SELECT a.vec_id, b.vec_id AS row_id, {DIST.format(a='a.embedding', b='b.embedding')} AS d FROM e a JOIN e b
  ON b.vec_id IN (SELECT row_id FROM heads) AND a.vec_id NOT IN (SELECT row_id FROM heads)
  WHERE abs(a.shade - b.shade) <= 45 AND abs(a.vec_id * 59 % 256 - b.vec_id * 59 % 256) <= 45 AND abs(a.vec_id * 83 % 256 - b.vec_id * 83 % 256) <= 45 AND abs(a.aspect - b.aspect) <= 0.5::DOUBLE)
SELECT vec_id, row_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, row_id) AS k FROM d) WHERE k = 1 AND d <= 1.45""")
def nearest_neighbor_veto(spark, sf):
    """The first vector of each label is a row, the others are new; colours of three channels and shapes have a veto."""
    k = F.col("vec_id")
    e = _vectors(spark, sf).withColumns({"green": (k * 59 % 256).cast("int"), "blue": (k * 83 % 256).cast("int")})
    cols = ["vec_id", "embedding", "shade", "green", "blue", "aspect"]
    rows = e.groupBy("label").agg(F.min(F.struct(*cols)).alias("h")).select(*[F.col(f"h.{c}").alias(f"head_{c}") for c in cols]).withColumnRenamed("head_vec_id", "row_id")
    new = e.join(rows.select(F.col("row_id").alias("vec_id")), "vec_id", "left_anti")
    gap = S.chebyshev([F.col(c) for c in ("shade", "green", "blue")], [F.col(f"head_{c}") for c in ("shade", "green", "blue")])
    ok = ~R.vetoed(gap, F.col("aspect") - F.col("head_aspect"), 45, 0.5)
    out = M.nearest_in_bins(new, rows, ["vec_id"], [("shade", "head_shade")], 45, ok, _dist("embedding", "head_embedding"), "row_id", 1.45, [])
    return out.select("vec_id", "row_id", F.round("distance", 6).alias("distance"))


GRID = """c AS (SELECT row_id, y, x, (row_id * (3 + y * 4 + x) * 7) % 256 AS v, (row_id + y * 2 + x) % 4 > 0 AS f FROM parts, (SELECT unnest(range(0, 4)) AS y), (SELECT unnest(range(0, 4)) AS x)),
sh AS (SELECT unnest(range(-2, 3)) AS dy, s.dx FROM (SELECT unnest(range(-2, 3)) AS dx) s)"""


@query(f"""WITH {PARTS}, {GRID}, heads AS (SELECT min(row_id) AS row_id FROM parts GROUP BY size), h AS (SELECT parts.* FROM parts JOIN heads USING (row_id)),
near AS (SELECT a.row_id AS item, b.row_id AS row_id, greatest(abs(a.r - b.r), abs(a.g - b.g), abs(a.b - b.b)) AS cd FROM parts a JOIN h b ON a.row_id NOT IN (SELECT row_id FROM heads)
  AND greatest(abs(a.r - b.r), abs(a.g - b.g), abs(a.b - b.b)) <= 40),
cells AS (SELECT n.item, n.row_id, dy, dx, a.f AS fa, coalesce(b.f, false) AS fb, a.v AS va, b.v AS vb FROM near n JOIN c a ON a.row_id = n.row_id, sh
  LEFT JOIN c b ON b.row_id = n.item AND b.y = a.y - dy AND b.x = a.x - dx),
per AS (SELECT item, row_id, dy, dx, sum(CASE WHEN fa AND fb THEN abs(va - vb) ELSE 255 END)::DOUBLE / count(*) AS d FROM cells WHERE fa OR fb GROUP BY ALL),
g AS (SELECT item, row_id, min(d) AS gd FROM per GROUP BY ALL)
SELECT item, min(row_id) AS row_id FROM near JOIN g USING (item, row_id) WHERE gd <= 90 AND cd <= CASE WHEN gd <= 70 THEN 40 ELSE 24 END GROUP BY item""".replace("a.row_id = n.row_id, sh\n  LEFT JOIN", "a.row_id = n.row_id CROSS JOIN sh\n  LEFT JOIN"))
def first_match_rule(spark, sf):
    """The first part of each size is a row, the others are new: colour and the distance of small pictures decide."""
    k = F.col("row_id")
    cells = [(y, x) for y in range(4) for x in range(4)]
    grid = F.array(*[(k * (3 + y * 4 + x) * 7 % 256).cast("double") for y, x in cells])
    filled = F.array(*[(k + y * 2 + x) % 4 > 0 for y, x in cells])
    p = spread(parts(spark, sf).select("row_id", "size", *"rgb"))
    first = p.groupBy("size").agg(F.min("row_id").alias("row_id")).select("row_id")
    heads = p.join(first, "row_id").select("row_id", *[F.col(c).alias(f"h{c}") for c in "rgb"], grid.alias("hgrid"), filled.alias("hfilled"))
    new = p.join(first, "row_id", "left_anti").select(k.alias("item"), *"rgb", grid.alias("grid"), filled.alias("filled"))
    colour = S.chebyshev([F.col(c) for c in "rgb"], [F.col(f"h{c}") for c in "rgb"])
    gap = K.grid_gap("hgrid", "grid", "hfilled", "filled")
    return M.first_match(new, heads, ["item"], [(c, f"h{c}") for c in "rgb"], 40, colour, gap, "row_id", 90, 70)


@query(f"""WITH {ORDINALS} SELECT a.row_id, a.page AS page_a, b.page AS page_b FROM placed a JOIN placed b ON a.row_id = b.row_id AND a.page * 1000 + a.item_ord < b.page * 1000 + b.item_ord""")
def positive_pairs(spark, sf):
    i = ordinals(items(spark, sf)).select("row_id", "page", (F.col("page") * 1000 + F.col("item_ord")).alias("o"))
    return M.pairs(i, ["row_id"], "o").select("a.row_id", F.col("a.page").alias("page_a"), F.col("b.page").alias("page_b"))


@query(f"""WITH {ORDINALS} SELECT a.page, a.row_id AS row_a, b.row_id AS row_b FROM placed a JOIN placed b ON a.page = b.page AND a.row_id < b.row_id""")
def negative_pairs(spark, sf):
    i = items(spark, sf).select("row_id", "page")
    return M.pairs(i, ["page"], "row_id", "row_id").select("a.page", F.col("a.row_id").alias("row_a"), F.col("b.row_id").alias("row_b"))


RECTS = """rects AS (SELECT o_orderkey AS id, o_custkey AS doc, o_orderkey % 97 AS x0, o_orderkey % 89 AS y0, o_orderkey % 97 + 5 + o_custkey % 31 AS x1, o_orderkey % 89 + 5 + o_custkey % 29 AS y1 FROM orders)"""


@query(f"""WITH {RECTS} SELECT id, doc FROM rects a WHERE NOT EXISTS (SELECT 1 FROM rects b WHERE b.doc = a.doc AND b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1
  AND ((b.x1 - b.x0) * (b.y1 - b.y0) > (a.x1 - a.x0) * (a.y1 - a.y0) OR ((b.x1 - b.x0) * (b.y1 - b.y0) = (a.x1 - a.x0) * (a.y1 - a.y0) AND b.id < a.id)))""")
def containment_antijoin(spark, sf):
    o, k, c = read(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    r = o.select(k.alias("id"), c.alias("doc"), (k % 97).alias("x0"), (k % 89).alias("y0"), (k % 97 + 5 + c % 31).alias("x1"), (k % 89 + 5 + c % 29).alias("y1"))
    return M.outermost(r, "id", ["doc"]).select("id", "doc")


@query(f"""WITH {VECTORS}, m AS (SELECT slot, k, avg(embedding[k]::DOUBLE) AS v FROM e, (SELECT unnest(range(1, 65)) AS k) GROUP BY ALL),
l AS (SELECT slot, sqrt(sum(v * v)) AS l FROM m GROUP BY slot), c AS (SELECT slot, list(v / l ORDER BY k) AS centre FROM m JOIN l USING (slot) GROUP BY slot),
p AS (SELECT a.slot AS a, b.slot AS b, {DIST.format(a='a.centre', b='b.centre')} AS d FROM c a JOIN c b ON a.slot < b.slot)
SELECT a, b, round(d, 6) AS distance FROM p ORDER BY d, a, b LIMIT 20""")
def embedding_twins_topk(spark, sf):
    """The closest rows, by the centres of their vectors."""
    c = M.centres(_vectors(spark, sf), "slot", "embedding", 64)
    return M.twins(c, "slot", "centre", 20).select("a", "b", F.round("distance", 6).alias("distance"))


@query(f"""WITH {ITEMS} SELECT page, bool_or(a AND b) AS merged FROM (SELECT page, row_id, bool_or(l_linenumber % 2 = 0) AS a, bool_or(l_linenumber % 2 = 1) AS b FROM items GROUP BY ALL) GROUP BY page""")
def overlap_check(spark, sf):
    i = items(spark, sf).withColumn("side", F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b"))
    return M.sides_overlap(i, "page", "side", "row_id")


@query(f"""WITH {ORDINALS}, refs AS (SELECT o_orderkey AS page, o_custkey % 3 AS item_ord FROM orders) SELECT page, item_ord, row_id FROM refs JOIN placed USING (page, item_ord)""")
def key_lookup(spark, sf):
    refs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 3).alias("item_ord"))
    return M.lookup(refs, ordinals(items(spark, sf)), ["page", "item_ord"]).select("page", "item_ord", "row_id")


@query(f"""WITH {ORDINALS}, q AS (SELECT page, item_ord, qty, CASE WHEN (l_quantity::BIGINT % 2) = 0 THEN l_quantity::BIGINT END AS reread FROM placed)
SELECT page, item_ord, coalesce(qty, reread) AS qty, qty IS NULL AND reread IS NOT NULL AS filled FROM q""")
def fill_unread_only(spark, sf):
    q = F.col("l_quantity").cast("long")
    i = ordinals(items(spark, sf)).withColumn("reread", F.when(q % 2 == 0, q))
    return i.select("page", "item_ord", F.coalesce("qty", "reread").alias("qty"), (F.col("qty").isNull() & F.col("reread").isNotNull()).alias("filled"))


LABELS = f"""WITH {ORDINALS}, l AS (SELECT page, item_ord AS label_ord, (row_id % 50) AS lx, (box % 50) AS ly FROM placed WHERE l_linenumber <= 2),
p AS (SELECT page, item_ord, row_id % 47 AS x, box % 43 AS y FROM placed WHERE l_linenumber > 2),
c AS (SELECT page, item_ord, label_ord, abs(lx - x) + CASE WHEN ly - y < 0 THEN 3 * (y - ly) ELSE ly - y END AS cost FROM p JOIN l USING (page))
SELECT page, item_ord, cost, label_ord FROM (SELECT *, row_number() OVER (PARTITION BY page, item_ord ORDER BY cost, label_ord) AS k FROM c) WHERE k = 1"""


@query(LABELS)
def nearest_label(spark, sf):
    i = ordinals(items(spark, sf))
    labels = i.where("l_linenumber <= 2").select("page", F.col("item_ord").alias("label_ord"), (F.col("row_id") % 50).alias("lx"), (F.col("box") % 50).alias("ly"))
    rest = i.where("l_linenumber > 2").select("page", "item_ord", (F.col("row_id") % 47).alias("x"), (F.col("box") % 43).alias("y"))
    return M.nearest_label(rest, labels, ["page", "item_ord"], ["page"])


# Order-dependent -----------------------------------------------------------------------------------------------------

LEADERS = """WITH RECURSIVE v AS ({items}),
d AS MATERIALIZED (SELECT a.doc, a.i, b.i AS j, {dist} AS d FROM v a JOIN v b ON a.doc = b.doc AND b.i < a.i),
run AS (
  SELECT DISTINCT doc, 0::BIGINT AS i, []::BIGINT[] AS heads, NULL::BIGINT AS row_id FROM v
  UNION ALL
  SELECT run.doc, run.i + 1, CASE WHEN m.j IS NULL THEN list_append(heads, run.i + 1) ELSE heads END,
    CASE WHEN m.j IS NULL THEN len(heads) ELSE list_position(heads, m.j) - 1 END
  FROM run JOIN v ON v.doc = run.doc AND v.i = run.i + 1
  LEFT JOIN LATERAL (SELECT arg_min(d.j, (d.d, d.j)) AS j FROM d WHERE d.doc = run.doc AND d.i = run.i + 1 AND d.d <= {tolerance} AND list_contains(heads, d.j)) m ON true)
SELECT v.doc, v.id, run.row_id FROM run JOIN v USING (doc, i)"""


@query(LEADERS.format(items="SELECT label AS doc, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, vec_id AS id, embedding FROM embeddings", dist=DIST.format(a="a.embedding", b="b.embedding"), tolerance=1.3))
def leader_clusters(spark, sf):
    """Vectors of one label are one document."""
    e = read(spark, sf, "embeddings").withColumnsRenamed({"label": "doc", "vec_id": "id"})
    return C.leader_clusters(e, "doc", "id", "embedding", 1.3)


@query(LEADERS.format(items="SELECT p_size AS doc, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS i, p_partkey AS id, p_partkey * 2654435761 % 65536 AS bits FROM part", dist="bit_count(xor(a.bits, b.bits))", tolerance=4))
def leader_clusters_hamming(spark, sf):
    """Parts of one size are one document."""
    p = parts(spark, sf).select(F.col("size").alias("doc"), F.col("row_id").alias("id"), (F.col("row_id") * 2654435761 % 65536).alias("bits"))
    return C.leader_clusters_bits(p, "doc", "id", "bits", 4)


@query()
def two_means_split(spark, sf):
    return C.split_rows(read(spark, sf, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", "side", F.round("gap", 6).alias("gap"))


@query("""WITH RECURSIVE b AS (SELECT o_orderkey AS u, o_custkey + 1000000000 AS v FROM orders UNION SELECT o_custkey + 1000000000, o_orderkey FROM orders),
reach AS (SELECT u AS id, u AS r FROM b UNION SELECT reach.id, b.v FROM reach JOIN b ON b.u = reach.r)
SELECT id, min(r) AS component FROM reach GROUP BY id""")
def connected_components(spark, sf):
    from inventa.sources.shared import prepare

    prepare(spark)
    e = read(spark, sf, "orders").select(F.col("o_orderkey").alias("u"), (F.col("o_custkey") + 1_000_000_000).alias("v"))
    return C.connected_components(e, "u", "v")


@query("""WITH e AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT a.user_id, b.i - a.i AS lag, sum(a.v * b.v) AS c FROM e a JOIN e b ON a.user_id = b.user_id AND b.i >= a.i AND a.n >= 4 GROUP BY ALL),
x AS (SELECT user_id, lag, c / greatest(max(CASE WHEN lag = 0 THEN c END) OVER (PARTITION BY user_id), 1e-12::DOUBLE) AS r FROM r),
y AS (SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after FROM x WINDOW w AS (PARTITION BY user_id ORDER BY lag)),
z AS (SELECT user_id, lag, round(r, 6) AS value, row_number() OVER (PARTITION BY user_id ORDER BY round(r, 9) DESC, lag) AS place FROM y WHERE lag > 0 AND r > before AND r >= after AND r > 0.2::DOUBLE)
SELECT user_id, place, lag, value FROM z WHERE place <= 8""")
def autocorr_peaks(spark, sf):
    """A user's events in order are one series."""
    e = read(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    p = e.select("user_id", F.posexplode(K.series_peaks("v")).alias("i", "p"))
    return p.select("user_id", (F.col("i") + 1).cast("long").alias("place"), F.col("p.lag").cast("long").alias("lag"), F.round("p.value", 6).alias("value"))


# State ---------------------------------------------------------------------------------------------------------------


@query("""SELECT user_id, count(*) AS version, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""")
def state_last_write_wins(spark, sf):
    return ST.latest(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("""SELECT event_id, user_id, v FROM (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT event_id, user_id, ts, floor(value)::BIGINT AS v FROM events)) WHERE before IS NULL OR v > before""")
def monotonic_versions(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "ts", F.floor("value").alias("v"))
    return ST.monotonic(e, ["user_id"], ["ts", "event_id"], "v").select("event_id", "user_id", "v")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type""")
def once_per_key(spark, sf):
    return ST.changed(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""WITH s AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, round(epoch_us(now) / 1e6::DOUBLE - epoch_us(last_ts) / 1e6::DOUBLE, 6) AS age_s FROM s, n WHERE epoch_us(now) - epoch_us(last_ts) < 86400000000""")
def peers_last_seen(spark, sf):
    e = read(spark, sf, "events")
    seen = ST.last_seen(e, "user_id", "ts")
    now = e.agg(F.max("ts").alias("now"))
    both = seen.join(F.broadcast(now))  # one row
    return ST.fresh(both, F.col("now"), 86400).select("user_id", F.round("age_s", 6).alias("age_s"))


@query()
def session_upsert(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("mode"), F.unix_millis("ts").alias("updated"), "event_id")
    return ST.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "id", "updated").select("id", "mode", "updated")


SQL["session_upsert"] = """WITH e AS (SELECT user_id AS id, event_type AS mode, epoch_us(ts) // 1000 AS updated, event_id FROM events)
SELECT id, mode, updated FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated DESC, event_id % 2 DESC, mode DESC, event_id DESC) AS k FROM e) WHERE k = 1"""


@query("""SELECT c_custkey AS file_key FROM customer WHERE c_custkey NOT IN (SELECT coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END, o_orderkey) FROM orders WHERE o_orderstatus <> 'F')""")
def refcount_gc(spark, sf):
    files = read(spark, sf, "customer").select(F.col("c_custkey").alias("file_key"))
    sessions = read(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("file_key"))
    return ST.collect_garbage(files, sessions)


@query("""WITH f AS (SELECT user_id, event_type || '-' || (event_id % 17) AS item, min((ts, event_id)) AS first FROM events GROUP BY ALL)
SELECT user_id, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first DESC, item) AS rank FROM f) WHERE rank <= 12""")
def fifo_cache_12(spark, sf):
    e = read(spark, sf, "events").withColumn("item", F.concat("event_type", F.lit("-"), (F.col("event_id") % 17).cast("string")))
    return ST.fifo(e, ["user_id"], "item", ["ts", "event_id"]).select("user_id", "item", "rank")


@query("""SELECT o_custkey AS row_id, count(*) AS toggles FROM orders GROUP BY o_custkey HAVING count(*) % 2 = 1""")
def collected_toggle(spark, sf):
    return ST.toggle(read(spark, sf, "orders").withColumnRenamed("o_custkey", "row_id"), "row_id", ["o_orderkey"])


@query(f"""WITH {ORDINALS}, {PARTS}, i AS (SELECT *, CASE WHEN item_ord % 3 > 0 THEN floor((row_id % 997) / 997.0::DOUBLE * 10000 + 0.5) / 10000 END AS x FROM placed)
SELECT 'box ' || box AS name, i.row_id, sum(coalesce(qty, 1))::BIGINT AS c, bool_or(qty IS NULL) AS u, count(DISTINCT page) AS n_pages, count(*) AS entries, sum(qty)::BIGINT AS read, round(sum(x), 6) AS x,
  any_value(CASE WHEN size > 25 THEN size END)::INT AS long_side, any_value(r)::DOUBLE AS red, any_value(name) AS thumb FROM i JOIN parts USING (row_id) GROUP BY box, i.row_id""")
def results_json(spark, sf):
    """One payload for each box, and back: counts, entries with quantities and rectangles, sizes, colours and pictures."""
    k = F.col("row_id")
    rect = F.when(F.col("item_ord") % 3 > 0, F.struct((k % 997 / F.lit(997.0)).alias("x"), *[F.lit(0.25).alias(c) for c in "ywh"]))
    i = ordinals(items(spark, sf)).select(F.concat(F.lit("box "), F.col("box").cast("string")).alias("name"), "row_id", "page", "item_ord", "qty", rect.alias("rect"))
    size = F.when(F.col("size") > 25, F.array("size", F.lit(2)))
    rows = parts(spark, sf).select("row_id", F.col("name").alias("thumb"), size.alias("size"), F.array(*[F.col(c).cast("double") for c in "rgb"]).alias("colour"))
    out = V.adopt(V.publish(i, rows))
    add = lambda f: F.aggregate("e", F.lit(None).cast("double"), lambda t, x: F.when(f(x).isNull(), t).otherwise(F.coalesce(t, F.lit(0.0)) + f(x)))
    return out.select("name", "row_id", "c", "u", F.size("p").cast("long").alias("n_pages"), F.size("e").cast("long").alias("entries"), add(lambda x: x["q"].cast("double")).cast("long").alias("read"), F.round(add(lambda x: x["r"][0]), 6).alias("x"), F.get("s", F.lit(0)).alias("long_side"), F.col("a")[0].alias("red"), F.col("t").alias("thumb"))


@query("""SELECT c_custkey AS key, c_name AS body FROM customer UNION ALL
SELECT s_suppkey + 1000, s_name FROM supplier WHERE s_suppkey + 1000 NOT IN (SELECT c_custkey FROM customer)""")
def put_if_absent(spark, sf):
    stored = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("body"))
    new = read(spark, sf, "supplier").select((F.col("s_suppkey") + 1000).alias("key"), F.col("s_name").alias("body"))
    return ST.put_if_absent(stored, new, "key")
