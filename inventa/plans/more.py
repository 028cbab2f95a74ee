"""Vetoes, state, labels and files: further queries beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from inventa.functions import scalars as S
from inventa.operators import aggregate as A
from inventa.operators import cluster as C
from inventa.operators import match as M
from inventa.operators import regions as R
from inventa.operators import scan as SC
from inventa.operators import state as ST
from inventa.operators import views as V
from inventa.plans.queries import DIST, ITEMS, LEADERS, ORDINALS, PARTS, VECTORS, _vectors, query
from inventa.sources import items as I
from inventa.sources.items import items, ordinals, parts, read
from inventa.sources.shared import scratch

# Order-dependent -----------------------------------------------------------------------------------------------------


@query(LEADERS.format(items="SELECT label AS doc, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, vec_id AS id, embedding, shade, aspect FROM (WITH " + VECTORS + " SELECT * FROM e)", dist=f"CASE WHEN abs(a.shade - b.shade) <= 120 AND abs(a.aspect - b.aspect) <= 0.8::DOUBLE THEN {DIST.format(a='a.embedding', b='b.embedding')} ELSE 99 END", tolerance=1.3))
def leader_clusters_veto(spark, sf):
    """As leader_clusters; leaders of another colour or shape are passed over before distances are looked at."""
    e = _vectors(spark, sf).select(F.col("label").alias("doc"), F.col("vec_id").alias("id"), "embedding", F.array("shade").alias("colour"), "aspect")
    return C.leader_clusters(e, "doc", "id", "embedding", 1.3, "colour", "aspect", 120, 0.8)


@query(LEADERS.format(items="SELECT p_size AS doc, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS i, p_partkey AS id, p_partkey * 2654435761 % 65536 AS bits FROM part", dist="bit_count(xor(a.bits, b.bits))", tolerance=5).replace("arg_min(d.j, (d.d, d.j))", "min(d.j)"))
def leader_clusters_first(spark, sf):
    """The first leader that is near enough, not the nearest."""
    p = parts(spark, sf).select(F.col("size").alias("doc"), F.col("row_id").alias("id"), (F.col("row_id") * 2654435761 % 65536).alias("bits"))
    return C.leader_clusters_bits(p, "doc", "id", "bits", 5, nearest=False)


@query()
def hue_families(spark, sf):
    """Parts of one size are one document."""
    p = parts(spark, sf).select(F.col("size").alias("doc"), "row_id", "r", "g", "b", (F.col("row_id") % 9 + 1).alias("count"))
    return V.hue_families(p, "doc").select("doc", "row_id", "family", F.round("family_order", 6).alias("family_order"), "place")


# Predicates and measures ---------------------------------------------------------------------------------------------


@query(f"""WITH {ITEMS}, q AS (SELECT box, page, row_id, l_quantity AS h, l_extendedprice AS base FROM items),
m AS (SELECT box, list_sort(list(h))[len(list(h)) // 2 + 1] AS mh, list_sort(list(base))[len(list(base)) // 2 + 1] AS mb FROM q GROUP BY box),
j AS (SELECT q.*, abs(h - mh) <= 0.3::DOUBLE * mh AND abs(base - mb) <= 0.35::DOUBLE * mb AS near FROM q JOIN m USING (box)), k AS (SELECT *, bool_or(near) OVER (PARTITION BY box) AS any_near FROM j)
SELECT box, page, row_id, h, base FROM k WHERE near OR NOT any_near""")
def signs_near_medians(spark, sf):
    """Signs whose height and baseline are both like the others'; all of a label where none is."""
    i = items(spark, sf).select("box", "page", "row_id", F.col("l_quantity").alias("h"), F.col("l_extendedprice").alias("base"))
    return A.near_medians(i, ["box"], {"h": 0.3, "base": 0.35})


@query("""SELECT o_orderkey AS id, o_orderkey % 7 AS x0, (o_orderkey % 7 + o_custkey % 14) AS x1 FROM orders WHERE o_custkey % 14 >= 8 AND o_orderkey % 9 >= 4""")
def slot_bounds(spark, sf):
    """Slots of eight pixels or more in bands of four or more."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = read(spark, sf, "orders").select(k.alias("id"), (k % 7).alias("x0"), (k % 7 + c % 14).alias("x1"), F.lit(0).alias("y0"), (k % 9).alias("y1"))
    return s.where(R.slot_ok(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).select("id", "x0", "x1")


@query("""WITH a AS (SELECT o_orderkey AS id, 50.0::DOUBLE * (1 + o_orderkey % 900) AS area, 1000.0::DOUBLE * (1 + o_custkey % 3000) AS box FROM orders),
k AS (SELECT id, box, least(4, greatest(1, sqrt(26000.0::DOUBLE / area))) AS k FROM a), z AS (SELECT id, CASE WHEN k > 1.05::DOUBLE THEN CASE WHEN box * k * k > 4.5e6::DOUBLE THEN sqrt(4.5e6::DOUBLE / box) ELSE k END END AS k FROM k)
SELECT id, round(CASE WHEN k > 1.05::DOUBLE THEN k END, 6) AS zoom FROM z""")
def zoom_factors(spark, sf):
    """How much each callout is enlarged, by its largest picture and its own area."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = read(spark, sf, "orders").select(k.alias("id"), (F.lit(50.0) * (1 + k % 900)).alias("area"), (F.lit(1000.0) * (1 + c % 3000)).alias("box"))
    return o.select("id", F.round(SC.zoom(F.col("area"), F.col("box")), 6).alias("zoom"))


@query(f"""WITH {PARTS}, g AS (SELECT row_id, 3.0::DOUBLE AS ux, 0.1::DOUBLE * (row_id % 5) AS uy, 0.2::DOUBLE * (row_id % 3) AS vx, 3.0::DOUBLE AS vy, row_id % 40 AS dx, row_id % 31 AS dy, 20.0::DOUBLE * (1 + row_id % 60) AS area FROM parts),
s AS (SELECT *, ux * -vy - -vx * uy AS det FROM g), w AS (SELECT *, abs((dx * -vy - -vx * dy) / det) AS w, abs((ux * dy - uy * dx) / det) AS l, abs(ux * vy - uy * vx) AS cell FROM s),
n AS (SELECT *, floor(w + 0.5)::INT AS kw, floor(l + 0.5)::INT AS kl FROM w), e AS (SELECT *, greatest(abs(w - kw), abs(l - kl)) AS err, kw * kl * cell / area AS face FROM n)
SELECT row_id, greatest(kw, kl) AS long_side, least(kw, kl) AS short_side, round(err, 6) AS err FROM e WHERE err <= 0.18::DOUBLE AND least(kw, kl) >= 2 AND greatest(kw, kl) <= 24 AND face BETWEEN 0.2::DOUBLE AND 1.25::DOUBLE
  AND CASE least(kw, kl) WHEN 2 THEN greatest(kw, kl) IN (2, 3) OR (greatest(kw, kl) <= 16 AND greatest(kw, kl) % 2 = 0) WHEN 3 THEN greatest(kw, kl) IN (3, 4, 6, 8) WHEN 4 THEN greatest(kw, kl) <= 12 AND greatest(kw, kl) % 2 = 0
    WHEN 6 THEN greatest(kw, kl) <= 16 AND greatest(kw, kl) % 2 = 0 WHEN 8 THEN greatest(kw, kl) IN (8, 11, 16) WHEN 16 THEN greatest(kw, kl) = 16 ELSE false END""")
def stud_sizes(spark, sf):
    """Sizes that pass all gates: near whole numbers, two or more each way, as large as the drawing, and made at all."""
    k = F.col("row_id")
    g = parts(spark, sf).select("row_id", F.lit(3.0).alias("ux"), (F.lit(0.1) * (k % 5)).alias("uy"), (F.lit(0.2) * (k % 3)).alias("vx"), F.lit(3.0).alias("vy"), (k % 40).alias("dx"), (k % 31).alias("dy"), (F.lit(20.0) * (1 + k % 60)).alias("area"))
    s = g.select("row_id", R.footprint("ux", "uy", "vx", "vy", "dx", "dy", "area").alias("s")).where("s is not null")
    return s.select("row_id", "s.long_side", "s.short_side", F.round("s.err", 6).alias("err"))


# Labels --------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS row_id, round(0.299::DOUBLE * (p_partkey * 37 % 256) + 0.587::DOUBLE * (p_partkey * 59 % 256) + 0.114::DOUBLE * (p_partkey * 83 % 256), 6) AS luminance,
  'set ' || p_size || ' (' || p_size || '-' || (p_size + 9) || ')' AS session, 'set%20' || p_size || '%2F%C3%A9.pdf' AS quoted, true AS own_id FROM part""")
def more_labels(spark, sf):
    """Luminance, names of sessions, file names for headers, and ids of their own."""
    n = F.col("size")
    name = F.concat(F.lit("set "), n.cast("string"))
    quoted = S.quoted(F.concat(name, F.lit("/é.pdf")))
    same = S.unquoted(quoted) == F.concat(name, F.lit("/é.pdf"))
    return parts(spark, sf).select("row_id", F.round(S.luminance(F.col("r"), F.col("g"), F.col("b")), 6).alias("luminance"), S.session_name(F.concat(name, F.lit(".PDF")), n, n + 9).alias("session"), quoted.alias("quoted"), (S.session_id().rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$") & same).alias("own_id"))


@query("""SELECT 'template' AS kind, chr(48 + k::INT) AS label, CASE WHEN k = 9 THEN '1011001000' ELSE reverse(substr('0001001101', 1 + k::INT) || substr('0001001101', 1, k::INT)) END AS bits
FROM (SELECT unnest(range(0, 10)) AS k)""".replace("CASE WHEN k = 9 THEN '1011001000' ELSE reverse(", "CASE WHEN k = 9 THEN reverse(substr('0001001101', 7) || substr('0001001101', 1, 6)) ELSE (").replace("substr('0001001101', 1, k::INT)) END", "substr('0001001101', 1, k::INT)) END"))
def template_table(spark, sf):
    """Templates written to a script and read again; the 9 is the 6 turned by half a circle."""
    own = [(str(k), [int(c) for c in "0001001101"[k:] + "0001001101"[:k]]) for k in range(9)]
    t = spark.createDataFrame(own, "label string, bits array<int>")
    path = scratch(spark, "templates")
    I.write_templates(I.with_nine(t), path)
    back = I.read_templates(spark, path)
    return back.select(F.lit("template").alias("kind"), "label", F.array_join(F.transform(S.bits_from_hex(F.col("bits"), 10), lambda b: b.cast("string")), "").alias("bits"))


@query(f"""WITH {ORDINALS} SELECT box, page, row_id, tile, tile // 3 AS line, tile % 3 AS "column" FROM (
  SELECT box, page, row_id, row_number() OVER (PARTITION BY box ORDER BY page, item_ord) - 1 AS tile FROM placed) WHERE tile < 7""")
def sheet_tiles(spark, sf):
    """What a contact sheet shows of each box."""
    return V.sheet(ordinals(items(spark, sf)), "box", ["page", "item_ord"], 7, 3).select("box", "page", "row_id", "tile", "line", "column")


# Files and state -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_values(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(f"""WITH {ORDINALS} SELECT page, box, item_ord AS item, qty_raw, 'p' || page || '_b' || box || '_i' || item_ord || '.png' AS thumb FROM (SELECT *, CASE WHEN qty IS NOT NULL THEN qty || 'x' END AS qty_raw FROM placed)""")
def dump_and_read(spark, sf):
    """Results as lines of JSON in the shared folder, and back."""
    i = ordinals(items(spark, sf)).withColumn("qty_raw", F.concat(F.col("qty").cast("string"), F.lit("x")))
    path = scratch(spark, "results")
    I.write_results(i, path)
    return I.read_results(spark, path)


@query(f"""WITH {ITEMS} SELECT row_id, count(*) AS n FROM items GROUP BY row_id""")
def cached_scan(spark, sf):
    """A table that is made once and then read."""
    path = scratch(spark, "cache")
    made = []

    def make():
        made.append(1)
        return items(spark, sf).groupBy("row_id").agg(F.count("*").alias("n"))

    first = I.cached(spark, path, make)
    again = I.cached(spark, path, make)
    assert len(made) == 1 and first.schema == again.schema
    return again


@query("""WITH w AS (SELECT DISTINCT user_id % 20 AS watch FROM events), t AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
s AS (SELECT watch, a + (b - a) // 20 * watch AS started, a + (b - a) // 20 * watch + 12000000 + 1000000 * watch AS now FROM w, t)
SELECT watch, now - started > 15000000 AND NOT EXISTS (SELECT 1 FROM events WHERE epoch_us(ts) <= now AND epoch_us(ts) > started - 20000000) AS alert FROM s""")
def silent_watchers(spark, sf):
    """Watchers that were opened at twenty moments, 12 to 31 seconds ago."""
    e = read(spark, sf, "events")
    t = e.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b"))
    w = e.select((F.col("user_id") % 20).alias("watch")).distinct().join(F.broadcast(t))  # one row
    started = F.col("a") + F.floor((F.col("b") - F.col("a")) / 20) * F.col("watch")
    w = w.select("watch", F.timestamp_micros(started).alias("started"), F.timestamp_micros(started + 12_000_000 + 1_000_000 * F.col("watch")).alias("now"))
    return ST.silent(e.select(F.col("user_id").alias("peer"), "ts"), w)


@query("""WITH r AS (SELECT o_custkey AS id, max(o_orderkey) AS version, arg_max(o_orderpriority, o_orderkey) AS mode FROM orders GROUP BY o_custkey),
l AS (SELECT c_custkey AS id, c_custkey * 10 AS version, c_mktsegment AS mode FROM customer)
SELECT l.id, coalesce(CASE WHEN r.version > l.version THEN r.version END, l.version) AS version, CASE WHEN r.version > l.version THEN r.mode ELSE l.mode END AS mode,
  '{"version":' || coalesce(CASE WHEN r.version > l.version THEN r.version END, l.version) || ',"mode":"' || CASE WHEN r.version > l.version THEN r.mode ELSE l.mode END || '"}' AS payload FROM l LEFT JOIN r USING (id)""")
def adopted_state(spark, sf):
    """What another device shared is taken over if it is newer, and shared on."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("mode"))
    remote = ST.latest(o.withColumnRenamed("version", "v"), ["id"], ["v"], ["v", "mode"]).select("id", F.col("v").alias("version"), "mode")
    local = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 10).alias("version"), F.col("c_mktsegment").alias("mode"))
    s = ST.payload(ST.adopt(local, remote, "id", "version"), {"version": "version", "mode": "mode"})
    return s.select("id", "version", "mode", F.to_json("data").alias("payload"))


@query("""SELECT 'peers' AS endpoint, count(DISTINCT user_id) AS rows FROM events UNION ALL SELECT 'state', count(DISTINCT user_id) FROM events
UNION ALL SELECT 'sessions', count(*) FROM customer UNION ALL SELECT 'pages', count(*) FROM orders""")
def endpoint_tables(spark, sf):
    """What a server would answer, as views."""
    from inventa.sources.endpoints import register

    views = register(spark, sf)
    size = lambda n: spark.table(views[n]).agg(F.count("*").alias("rows")).select(F.lit(n).alias("endpoint"), "rows")
    return size("peers").unionByName(size("state")).unionByName(size("sessions")).unionByName(size("pages"))
