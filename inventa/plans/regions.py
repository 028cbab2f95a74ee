"""Boxes, colours, stored records and sets: more queries beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inventa.functions.scalars import chebyshev, euclidean
from inventa.operators import aggregate as A
from inventa.operators import match as M
from inventa.operators import regions as R
from inventa.operators import state as ST
from inventa.operators import windows as WN
from inventa.plans.queries import DIST, ITEMS, ORDINALS, PARTS, query
from inventa.sources.items import items, ordinals, parts, read


def _rgb():
    return F.array("r", "g", "b")


@query(f"""WITH {PARTS} SELECT row_id, abs(r - 100) <= 60 AND abs(g - 100) <= 60 AND abs(b - 100) <= 60 AS near, greatest(abs(r - 100), abs(g - 100), abs(b - 100)) > 35 AS ink FROM parts""")
def colour_predicates(spark, sf):
    target = F.array(*[F.lit(100)] * 3)
    return parts(spark, sf).select("row_id", R.near_colour(_rgb(), target, 60).alias("near"), R.foreground(_rgb(), target).alias("ink"))


@query("""WITH b AS (SELECT o_orderkey AS id, o_orderkey % 200 AS w, o_custkey % 150 AS h, (o_orderkey % 11) / 10.0::DOUBLE AS fill, (o_custkey % 7) / 100.0::DOUBLE AS content, (o_orderkey % 10) / 10.0::DOUBLE AS edge FROM orders)
SELECT id FROM b WHERE w >= 60 AND h >= 60 AND w * h >= 900 AND w * h <= 0.55::DOUBLE * 40000 AND (fill >= 0.5::DOUBLE OR least(edge, 0.9::DOUBLE) >= 0.7::DOUBLE) AND content >= 0.02::DOUBLE""")
def box_filter(spark, sf):
    o, k, c = read(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    edge = (k % 10) / F.lit(10.0)
    frame = R.is_frame(edge, F.lit(0.9), edge, F.lit(0.9))
    ok = R.box_shape(k % 200, c % 150, F.lit(40000), (k % 11) / F.lit(10.0), frame, (c % 7) / F.lit(100.0))
    return o.where(ok).select(k.alias("id"))


@query(f"""WITH {PARTS}, learned AS (SELECT size, max(r) AS lr, max(g) AS lg, max(b) AS lb FROM parts WHERE size <= 25 GROUP BY size)
SELECT row_id FROM parts LEFT JOIN learned USING (size) WHERE coalesce(greatest(abs(r - lr), abs(g - lg), abs(b - lb)) <= 120, true)""")
def interior_filter(spark, sf):
    p = parts(spark, sf)
    learned = p.where("size <= 25").groupBy("size").agg(*[F.max(c).alias(f"l{c}") for c in "rgb"])
    ok = R.interior_ok([F.col(c) for c in "rgb"], [F.col(f"l{c}") for c in "rgb"], 120)
    return p.join(learned, "size", "left").where(ok).select("row_id")


@query("SELECT p_partkey AS row_id FROM part WHERE p_size >= 12 AND p_partkey % 60 >= 3 AND p_partkey % 60 <= 1.6::DOUBLE * p_size")
def glyph_size_filter(spark, sf):
    return parts(spark, sf).where(R.glyph_size(F.col("row_id") % 60, F.col("size"))).select("row_id")


@query(f"""WITH {ITEMS}, c AS (SELECT page, l_quantity AS ink, row_id % 200 AS d, box % 40 AS short FROM items), t AS (SELECT page, sum(ink) AS total FROM c GROUP BY page)
SELECT page, max(short) >= 13.5::DOUBLE AND sum(ink) >= 135 AND sum(CASE WHEN ink >= 0.05::DOUBLE * total AND d <= 95.7::DOUBLE THEN ink ELSE 0 END) < 0.55::DOUBLE * sum(ink) AS is_part FROM c JOIN t USING (page) GROUP BY page""")
def part_or_junk(spark, sf):
    i = items(spark, sf).select("page", F.col("l_quantity").alias("ink"), (F.col("row_id") % 200).alias("d"), (F.col("box") % 40).alias("short"))
    return R.part_or_junk(i, "page", "ink", "d", "short")


@query(f"""WITH {PARTS} SELECT a.row_id AS a, b.row_id AS b FROM parts a JOIN parts b ON a.size = b.size AND a.row_id < b.row_id
WHERE NOT (greatest(abs(a.r - b.r), abs(a.g - b.g), abs(a.b - b.b)) > 45 OR abs(ln(a.price / 1000) - ln(b.price / 1000)) > 0.09::DOUBLE)""")
def veto_predicate(spark, sf):
    p = parts(spark, sf).select("row_id", "size", "r", "g", "b", F.ln(F.col("price") / 1000).alias("aspect"))
    gap = lambda a, b: chebyshev([F.col(f"{a}.{c}") for c in "rgb"], [F.col(f"{b}.{c}") for c in "rgb"])
    near = lambda a, b: ~R.vetoed(gap(a, b), F.col(f"{a}.aspect") - F.col(f"{b}.aspect"))
    return M.near_pairs(p, ["size"], "row_id", ["r", "g", "b"], 45, near)


@query("""SELECT o_orderkey AS id, round((o_orderkey % 97) / 800.0::DOUBLE, 9) AS fx, round((o_orderkey % 89) / 600.0::DOUBLE, 9) AS fy, o_orderkey % 97 + 4 AS x0, o_orderkey % 89 + 4 AS y0
FROM orders WHERE o_custkey % 20 > 8 AND o_custkey % 15 > 8""")
def item_fractions(spark, sf):
    o, k, c = read(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    r = o.select(k.alias("id"), (k % 97).alias("x0"), (k % 89).alias("y0"), (k % 97 + c % 20).alias("x1"), (k % 89 + c % 15).alias("y1"), (k % 97).alias("x"), (k % 89).alias("y"), (c % 20).alias("w"), (c % 15).alias("h"))
    out = R.inset(R.fractions(r, F.lit(800.0), F.lit(600.0)))
    return out.select("id", F.round("fx", 9).alias("fx"), F.round("fy", 9).alias("fy"), "x0", "y0")


@query("""SELECT o_orderkey AS id, o_custkey % 30 AS doc, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY round_even((o_orderkey % 601) / 600.0::DOUBLE * 50, 0), o_custkey % 400, o_orderkey) - 1 AS place FROM orders""")
def reading_order(spark, sf):
    o, k, c = read(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    b = o.select(k.alias("id"), (c % 30).alias("doc"), (k % 601).alias("y"), (c % 400).alias("x"))
    return R.reading_order(b, "doc", F.col("y"), F.lit(600.0), "x", "id").select("id", "doc", "place")


@query(f"""WITH {ORDINALS}, b AS (SELECT page, item_ord AS band_ord, 8 + row_id % 40 AS height, box % 3 > 0 AS has_digit FROM placed),
s AS (SELECT x.page, x.band_ord AS seed, x.height AS ref, count(*) AS n, bool_or(y.has_digit) AS digit FROM b x JOIN b y ON x.page = y.page AND x.height <= 30 AND y.height <= 30 AND abs(y.height - x.height) <= 0.25::DOUBLE * x.height GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, seed) AS k FROM s) WHERE k = 1),
c AS (SELECT page, ref FROM best JOIN (SELECT page, count(*) AS bands FROM b GROUP BY page) USING (page) WHERE n >= 2 AND digit AND bands >= 3),
m AS (SELECT b.page, band_ord, coalesce(height <= 30 AND abs(height - ref) <= 0.25::DOUBLE * ref, false) AS is_label FROM b LEFT JOIN c USING (page))
SELECT page, band_ord, is_label, coalesce(sum(is_label::INT) OVER (PARTITION BY page ORDER BY band_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_in_box FROM m""")
def row_bands(spark, sf):
    b = ordinals(items(spark, sf)).select("page", F.col("item_ord").alias("band_ord"), (8 + F.col("row_id") % 40).alias("height"), (F.col("box") % 3 > 0).alias("has_digit"))
    return R.label_bands(b, ["page"]).select("page", "band_ord", "is_label", "row_in_box")


@query(f"""WITH {ORDINALS}, l AS (SELECT page, item_ord AS id, (row_id % 90) AS x0, box % 12 AS y0, row_id % 90 + 10 AS x1, box % 12 + 10 + row_id % 5 AS y1 FROM placed),
p AS (SELECT *, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, max(x1) OVER (PARTITION BY page ORDER BY x0, y0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rt FROM l WINDOW w AS (PARTITION BY page ORDER BY x0, y0, id)),
f AS (SELECT *, CASE WHEN coalesce(least(y1, py1) - greatest(y0, py0) > 0.4::DOUBLE * least(y1 - y0, py1 - py0) AND x0 - rt < 1.2::DOUBLE * least(y1 - y0, py1 - py0), false) THEN 0 ELSE 1 END AS n FROM p)
SELECT page, count(*) AS labels, sum(n)::BIGINT AS lines FROM f GROUP BY page""")
def label_lines(spark, sf):
    i = ordinals(items(spark, sf))
    labels = i.select("page", (F.col("row_id") % 90).alias("x0"), (F.col("box") % 12).alias("y0"), (F.col("row_id") % 90 + 10).alias("x1"), (F.col("box") % 12 + 10 + F.col("row_id") % 5).alias("y1"))
    return R.merge_lines(labels, ["page"]).groupBy("page").agg(F.count("*").alias("labels"), F.max("line").alias("lines"))


@query(f"""WITH {PARTS} SELECT size, CASE WHEN count(*) FILTER (r > 60) >= 5 THEN round(avg(r) FILTER (r > 60), 6) ELSE 60.0::DOUBLE END AS red FROM parts GROUP BY size""")
def mean_foreground(spark, sf):
    ink = F.when(F.col("r") > 60, F.col("r"))
    return parts(spark, sf).groupBy("size").agg(F.when(F.count(ink) >= 5, F.round(F.avg(ink), 6)).otherwise(F.lit(60.0)).alias("red"))


@query(f"""WITH {ITEMS} SELECT box, count(qty)::DOUBLE AS weight, round(avg(l_extendedprice) FILTER (qty IS NOT NULL), 4) AS fill FROM items GROUP BY box HAVING count(qty) >= 4 ORDER BY count(qty) DESC, box LIMIT 1""")
def interior_vote(spark, sf):
    i = items(spark, sf).withColumn("read", F.col("qty").isNotNull().cast("double"))
    return A.weighted_vote(i, "box", "read", "l_extendedprice", least=4).select("box", "weight", F.round("fill", 4).alias("fill"))


@query("WITH l AS (SELECT label, min(vec_id) AS head FROM embeddings GROUP BY label) SELECT e.vec_id, round(" + DIST.format(a="e.embedding", b="h.embedding") + ", 6) AS distance FROM embeddings e JOIN l USING (label) JOIN embeddings h ON h.vec_id = l.head")
def lattice_broadcast(spark, sf):
    """One measured thing of each group goes to all of its members."""
    e = read(spark, sf, "embeddings")
    head = e.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("h")).select("label", F.col("h.embedding").alias("head"))
    return e.join(head, "label").select("vec_id", F.round(euclidean(F.col("embedding"), F.col("head")), 6).alias("distance"))


@query("WITH p AS (SELECT vec_id, label, embedding, vec_id % 2 AS side FROM embeddings) SELECT a.label AS pair_id, round(min(" + DIST.format(a="a.embedding", b="b.embedding") + "), 6) AS gap FROM p a JOIN p b ON a.label = b.label AND a.side = 0 AND b.side = 1 GROUP BY a.label")
def truth_pair_gap(spark, sf):
    e = read(spark, sf, "embeddings")
    gaps = M.least_gaps(e, "label", "vec_id", "embedding", F.col("vec_id") % 2 == 0, F.col("vec_id") % 2 == 1)
    return gaps.select(F.col("label").alias("pair_id"), F.round("gap", 6).alias("gap"))


# Records and sets ----------------------------------------------------------------------------------------------------


@query("SELECT user_id AS id, max(epoch_us(ts)) AS updated, row_number() OVER (ORDER BY coalesce(max(CASE WHEN event_id % 3 > 0 THEN epoch_us(ts) END), 0) DESC, user_id) AS rank FROM events GROUP BY user_id")
def sessions_by_update(spark, sf):
    e = read(spark, sf, "events")
    s = e.groupBy(F.col("user_id").alias("id")).agg(F.max(F.unix_micros("ts")).alias("updated"), F.max(F.when(F.col("event_id") % 3 > 0, F.unix_micros("ts"))).alias("u"))
    return WN.global_rank(s, F.coalesce("u", F.lit(0)).desc(), "id").drop("u")


@query("SELECT c_custkey AS key, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS stored FROM customer")
def key_exists(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("key")).distinct().withColumn("hit", F.lit(True))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return c.join(o, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("stored"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def register_versions(spark, sf):
    return ST.numbered(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "version")


@query("SELECT DISTINCT o_custkey AS page FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def served_once(spark, sf):
    wanted = read(spark, sf, "orders").select(F.col("o_custkey").alias("page"))
    served = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("page"))
    return ST.served_once(wanted, served, "page")


@query("""WITH p AS (SELECT '10.0.' || (user_id % 3) || '.' || (user_id % 50) AS ip, max(ts) AS last FROM events GROUP BY 1)
SELECT ip FROM p WHERE NOT starts_with(ip, '10.0.0.') AND ip <> '10.0.1.7'""")
def peers_not_own(spark, sf):
    """Addresses that are neither local nor our own."""
    e = read(spark, sf, "events")
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 3).cast("string"), F.lit("."), (F.col("user_id") % 50).cast("string"))
    own = spark.createDataFrame([("10.0.1.7",)], "ip string")
    return e.select(ip.alias("ip")).where(~F.col("ip").startswith("10.0.0.")).distinct().join(own, "ip", "left_anti")


@query(f"""WITH {ITEMS}, a AS (SELECT page, row_id FROM items WHERE l_linenumber = 1), b AS (SELECT page, row_id FROM items WHERE l_linenumber = 2)
SELECT 'all' AS op, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'distinct', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'less', count(*) FROM (SELECT row_id FROM a EXCEPT ALL SELECT row_id FROM b)""")
def set_operations(spark, sf):
    i = items(spark, sf)
    a, b = (i.where(F.col("l_linenumber") == k).select("page", "row_id") for k in (1, 2))
    size = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    out = size("all", a.unionByName(b)).unionByName(size("distinct", a.unionByName(b).distinct())).unionByName(size("both", a.intersect(b)))
    return out.unionByName(size("only_first", a.subtract(b))).unionByName(size("less", a.select("row_id").exceptAll(b.select("row_id"))))


@query("""SELECT o_custkey AS doc, o_orderkey AS step, coalesce(lag(o_orderkey) OVER w, o_orderkey) AS before, coalesce(lead(o_orderkey) OVER w, o_orderkey) AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def step_neighbours(spark, sf):
    """Where back and forward lead from each step; they stay at the ends."""
    w, k = W.partitionBy("o_custkey").orderBy("o_orderkey"), F.col("o_orderkey")
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), k.alias("step"), F.coalesce(F.lag(k).over(w), k).alias("before"), F.coalesce(F.lead(k).over(w), k).alias("after"))


@query(f"""WITH {ITEMS} SELECT row_id, n, row_number() OVER (ORDER BY n, row_id) AS rank FROM (SELECT row_id, count(*) AS n FROM items GROUP BY row_id)""")
def fewest_confirmations(spark, sf):
    """The whole sheet, those first that are least sure."""
    n = items(spark, sf).groupBy("row_id").agg(F.count("*").alias("n"))
    return WN.global_rank(n, "n", "row_id")


@query("""SELECT o_custkey AS doc, list_sort(list(DISTINCT o_orderkey)) = list_sort(list(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey END)) AS same,
  len(list_intersect(list(DISTINCT o_orderkey), [2, 4, 6, 8, 10, 20, 30])) AS shared FROM orders GROUP BY o_custkey""")
def collected_sets(spark, sf):
    s = F.array_sort(F.collect_set("o_orderkey"))
    few = F.array(*[F.lit(x).cast("long") for x in (2, 4, 6, 8, 10, 20, 30)])
    g = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(s.alias("s"))
    return g.select("doc", (F.array_sort(F.array_union("s", "s")) == F.col("s")).alias("same"), F.size(F.array_intersect("s", few)).cast("long").alias("shared"))
