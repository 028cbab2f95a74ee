"""Pictures: queries that draw from keys what they then measure, so that SQL can say the result from the keys alone.

A part's key decides rectangles, words in a font of dots, or a periodic pattern; no picture is stored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inventa.operators import kernels as K
from inventa.operators import pixels as P
from inventa.operators import regions as R
from inventa.plans.queries import PARTS, query
from inventa.sources import items

FONT = {
    "0": [".###.", "#...#", "#..##", "#.#.#", "##..#", "#...#", ".###."], "1": ["..#..", ".##..", "..#..", "..#..", "..#..", "..#..", ".###."],
    "2": [".###.", "#...#", "....#", "..##.", ".#...", "#....", "#####"], "3": [".###.", "#...#", "....#", "..##.", "....#", "#...#", ".###."],
    "4": ["...#.", "..##.", ".#.#.", "#..#.", "#####", "...#.", "...#."], "5": ["#####", "#....", "####.", "....#", "....#", "#...#", ".###."],
    "6": ["..##.", ".#...", "#....", "####.", "#...#", "#...#", ".###."], "7": ["#####", "....#", "...#.", "..#..", "..#..", "..#..", "..#.."],
    "8": [".###.", "#...#", "#...#", ".###.", "#...#", "#...#", ".###."], "9": [".###.", "#...#", "#...#", ".####", "....#", "...#.", ".##.."],
    "x": [".....", "#...#", "##.##", ".###.", ".###.", "##.##", "#...#"],
}
TEMPLATES = [(c, K.fit_glyph(P.line_of(c, FONT, 3, 0).astype(np.uint8))) for c in FONT]


def _rects(*rects):
    return F.array(*[F.array(*[v.cast("int") if hasattr(v, "cast") else F.lit(int(v)) for v in r]) for r in rects])


def _mask(df, width: int, height: int, *rects):
    return df.withColumns({"data": P.painted(F.lit(width), F.lit(height), _rects(*rects)), "width": F.lit(width)})


def _image(df, width: int, height: int, background, *rects):
    back = F.array(*[F.lit(v) for v in background])
    return df.withColumns({"data": P.painted(F.lit(width), F.lit(height), _rects(*rects), back), "width": F.lit(width), "back": back})


def parts(spark, sf):
    """Parts on all cores: pictures are much work for a small table."""
    return items.spread(items.parts(spark, sf))


def _k():
    return F.col("row_id")


@query(f"""WITH {PARTS} SELECT row_id, 2 AS x0, 3 AS y0, (5 + row_id % 5)::INT AS x1, (5 + row_id % 4)::INT AS y1, ((4 + row_id % 5) * (3 + row_id % 4))::INT AS n FROM parts
UNION ALL SELECT row_id, 20, 1, 22, (2 + row_id % 6)::INT, (3 * (2 + row_id % 6))::INT FROM parts""")
def mask_areas(spark, sf):
    """Two rectangles are two areas."""
    m = _mask(parts(spark, sf), 30, 12, (2, 3, 6 + _k() % 5, 6 + _k() % 4), (20, 1, 23, 3 + _k() % 6))
    return m.select("row_id", F.inline(P.areas(F.col("data"), F.col("width"))))


@query(f"WITH {PARTS} SELECT row_id, (2 + row_id % 7)::INT AS by_edge, 1 AS by_corner FROM parts")
def diagonal_areas(spark, sf):
    """A diagonal line is one area only if corners count."""
    n = 2 + _k() % 7
    m = _mask(parts(spark, sf), 10, 10, *[(i, i, F.when(n > i, i + 1).otherwise(i), i + 1) for i in range(9)])
    return m.select("row_id", F.size(P.areas(F.col("data"), F.col("width"))).alias("by_edge"), F.size(P.areas(F.col("data"), F.col("width"), True)).alias("by_corner"))


@query(f"""WITH {PARTS}, c AS (SELECT row_id, unnest(range(0, 3)) AS c, row_id % 6 AS p FROM parts)
SELECT row_id, (30 * c)::INT AS x0, (30 * c + 12)::INT AS x1, 0 AS top, ((15 + p + 20 + p) // 2)::INT AS split, (30 + p)::INT AS bottom FROM c WHERE c <= row_id % 3""")
def row_slots(spark, sf):
    """One to three columns of a picture and a text below it."""
    p = _k() % 6
    columns = []
    for c in range(3):
        right = F.when(_k() % 3 >= c, F.lit(30 * c + 12)).otherwise(F.lit(30 * c))
        columns += [(30 * c, 0, right, 15 + p), (30 * c, 20 + p, right, 30 + p)]
    m = _mask(parts(spark, sf), 90, 40, *columns)
    return m.select("row_id", F.inline(P.slots(F.col("data"), F.col("width"))))


@query(f"""WITH {PARTS}, c AS (SELECT row_id, unnest(range(0, 3)) AS c, row_id % 6 AS p FROM parts)
SELECT row_id, c::INT AS slot, (30 * c)::INT AS x0, 0 AS y0, (30 * c + 11)::INT AS x1, (14 + p + 2)::INT AS y1, 12 AS width, (17 + p)::INT AS height FROM c WHERE c <= row_id % 3 AND c <> 1""")
def icon_slots(spark, sf):
    """Slots with their pictures; the second picture is too low to count."""
    p = _k() % 6
    columns = []
    for c in range(3):
        right = F.when(_k() % 3 >= c, F.lit(30 * c + 12)).otherwise(F.lit(30 * c))
        columns += [(30 * c, 14 + p if c == 1 else 0, right, 15 + p), (30 * c, 18 + p if c == 1 else 20 + p, right, 30 + p)]
    m = _mask(parts(spark, sf).select("row_id"), 90, 40, *columns)
    return P.icons(m, "data", "width").select("row_id", "slot", "x0", "y0", "x1", "y1", "width", "height")


@query(f"WITH {PARTS} SELECT row_id, CASE WHEN row_id % 11 > 0 THEN 1 + row_id % 150 END AS qty, row_id % 11 = 0 AS unsure FROM parts")
def read_quantities(spark, sf):
    """Printed quantities; every eleventh is too large to be one."""
    text = F.concat(F.when(_k() % 11 > 0, 1 + _k() % 150).otherwise(201 + _k() % 700).cast("string"), F.lit("x"))
    t = parts(spark, sf).select("row_id", P.written(text, FONT).alias("t"))
    return t.select("row_id", P.quantity(F.col("t.data"), F.col("t.width"), TEMPLATES).alias("q")).select("row_id", "q.qty", "q.unsure")


@query(f"WITH {PARTS} SELECT row_id, row_id % 3 = 0 AS has_digit FROM parts")
def digit_bands(spark, sf):
    """Bands of a digit, of an x, and of dots."""
    t = parts(spark, sf).select("row_id", P.written(F.when(_k() % 3 == 0, (_k() % 10).cast("string")).otherwise(F.lit("x")), FONT).alias("t"))
    return t.select("row_id", P.band_has_digit(F.col("t.data"), F.col("t.width"), TEMPLATES).alias("has_digit"))


@query(f"""WITH {PARTS}, g AS (SELECT row_id, 3 + row_id % 30 AS w, 12 + row_id % 25 AS h FROM parts), k AS (SELECT *, least(18.0::DOUBLE / w, 26.0::DOUBLE / h) AS k FROM g)
SELECT row_id, (greatest(1, floor(w * k + 0.5)) * greatest(1, floor(h * k + 0.5)))::BIGINT AS ink FROM k""")
def glyph_frames(spark, sf):
    """A sign of any size fills its frame."""
    m = _mask(parts(spark, sf), 40, 40, (4, 2, 7 + _k() % 30, 14 + _k() % 25))
    frame = P.fitted(F.col("data"), F.col("width"))
    return m.select("row_id", F.length(F.replace(F.hex(frame), F.lit("00"), F.lit(""))).alias("n")).select("row_id", (F.col("n") / 2).cast("long").alias("ink"))


@query(f"WITH {PARTS} SELECT row_id, ((3 + row_id % 9) * (3 + row_id % 5))::BIGINT AS left_by_3, ((3 + row_id % 9) * (3 + row_id % 5) + 4)::BIGINT AS left_by_2 FROM parts")
def opened_masks(spark, sf):
    """Specks of one pixel always go, those of two stay for a square of two."""
    m = _mask(parts(spark, sf), 30, 20, (4, 4, 7 + _k() % 9, 7 + _k() % 5), (20, 2, 22, 4), (25, 15, 26, 16), (1, 18, 20, 19))
    ink = lambda size: (F.length(F.replace(F.hex(P.opened(F.col("data"), F.col("width"), size)), F.lit("00"), F.lit(""))) / 2).cast("long")
    return m.select("row_id", ink(3).alias("left_by_3"), ink(2).alias("left_by_2"))


@query(f"""WITH {PARTS}, b AS (SELECT row_id, 10 + row_id % 15 AS w, 9 + row_id % 8 AS h FROM parts)
SELECT row_id, (w - 4) * (h - 4) AS sampled, 60 * 40 - ((w + 4) * (h + 4) - (w - 4) * (h - 4)) AS around FROM b""")
def flat_counts(spark, sf):
    """A filled box is flat but for its rim."""
    i = _image(parts(spark, sf), 60, 40, (250, 250, 250), (10, 10, 20 + _k() % 15, 19 + _k() % 8, 120, 130, 140))
    return i.select("row_id", P.flatness(F.col("data"), F.col("width")).alias("f")).select("row_id", "f.sampled", "f.around")


@query(f"WITH {PARTS} SELECT row_id, 12 AS x0, 12 AS y0, (10 + 60 + row_id % 15 - 3)::INT AS x1, (10 + 50 + row_id % 8 - 3)::INT AS y1 FROM parts WHERE row_id % 4 > 0")
def candidate_rectangles(spark, sf):
    """Boxes with something drawn in them; every fourth is empty."""
    ink = F.when(_k() % 4 > 0, F.lit(40)).otherwise(F.lit(30))
    i = _image(parts(spark, sf), 130, 90, (250, 250, 250), (10, 10, 70 + _k() % 15, 60 + _k() % 8, 170, 210, 240), (30, 30, ink, 38, 20, 20, 20))
    return i.select("row_id", F.inline(P.candidates(F.col("data"), F.col("width"))))


@query(f"WITH {PARTS} SELECT row_id, greatest(0, row_id % 20 - 2)::INT AS x0, greatest(0, row_id % 11 - 2)::INT AS y0, least(59, row_id % 20 + 10 + row_id % 29 + 1)::INT AS x1, least(39, row_id % 11 + 8 + row_id % 20 + 1)::INT AS y1 FROM parts")
def crop_boxes(spark, sf):
    i = _image(parts(spark, sf), 60, 40, (215, 238, 254), (_k() % 20, _k() % 11, _k() % 20 + 10 + _k() % 29, _k() % 11 + 8 + _k() % 20, 90, 20, 20))
    return i.select("row_id", P.crop_box(F.col("data"), F.col("width"), F.col("back")).alias("b")).select("row_id", "b.*")


@query(f"""WITH {PARTS}, s AS (SELECT row_id, 20 + row_id % 150 AS w, 15 + row_id % 40 AS h FROM parts), k AS (SELECT *, least(1.0::DOUBLE, 110.0::DOUBLE / greatest(w, h)) AS k FROM s)
SELECT row_id, greatest(1, floor(w * k + 0.5))::INT AS width, greatest(1, floor(h * k + 0.5))::INT AS height, (3 * greatest(1, floor(w * k + 0.5)) * greatest(1, floor(h * k + 0.5)))::INT AS bytes FROM k""")
def thumbnail_sizes(spark, sf):
    w, h = (20 + _k() % 150).cast("int"), (15 + _k() % 40).cast("int")
    back = F.array(*[F.lit(9)] * 3)
    i = parts(spark, sf).select("row_id", P.painted(w, h, _rects((0, 0, 5, 5, 1, 2, 3)), back).alias("data"), w.alias("w"))
    return i.select("row_id", P.thumbnail(F.col("data"), F.col("w")).alias("t")).select("row_id", "t.width", "t.height", F.octet_length("t.data").alias("bytes"))


@query(f"""WITH {PARTS}, s AS (SELECT row_id, 20 + row_id % 30 AS w, 15 + row_id % 20 AS h, (row_id % 3) * 60 AS c FROM parts), k AS (SELECT *, least(10.0::DOUBLE / w, 10.0::DOUBLE / h) AS k FROM s)
SELECT row_id, c::DOUBLE AS red, round(ln(w / h::DOUBLE), 6) AS aspect, (greatest(1, floor(w * k + 0.5)) * greatest(1, floor(h * k + 0.5)))::BIGINT AS filled FROM k""")
def image_signatures(spark, sf):
    """Pictures filled with one colour."""
    w, h = (20 + _k() % 30).cast("int"), (15 + _k() % 20).cast("int")
    back, c = F.array(*[F.lit(v) for v in (215, 238, 254)]), (_k() % 3) * 60
    i = parts(spark, sf).select("row_id", P.painted(w, h, _rects((0, 0, 60, 60, c, 20, 30)), back).alias("data"), w.alias("w"), back.alias("back"))
    s = i.select("row_id", P.signature(F.col("data"), F.col("w"), F.col("back")).alias("s"))
    return s.select("row_id", F.col("s.colour")[0].alias("red"), F.round("s.aspect", 6).alias("aspect"), (F.length(F.replace(F.hex("s.filled"), F.lit("00"), F.lit(""))) / 2).cast("long").alias("filled"))


def _dots(spark, sf, least: int, step: int, size: int = 96):
    """Squares that repeat every least + key % step pixels both ways."""
    p = least + _k() % step
    n = size // least + 1
    dots = [(p * i + 2, p * j + 2, p * i + 5, p * j + 5) for i in range(n) for j in range(n)]
    return _mask(parts(spark, sf).withColumn("p", p.cast("int")), size, size, *dots)


@query(f"WITH {PARTS} SELECT row_id, (12 + row_id % 4)::DOUBLE AS first, (12 + row_id % 4)::DOUBLE AS second FROM parts")
def lattice_pitch(spark, sf):
    """The square lattice of repeats: spectrum, autocorrelation, peaks, the shortest basis and its score."""
    d = _dots(spark, sf, 12, 4)
    return d.select("row_id", P.lattice(F.col("data"), F.col("width")).alias("l")).select("row_id", F.round("l.first", 6).alias("first"), F.round("l.second", 6).alias("second"))


@query(f"WITH {PARTS} SELECT row_id, true AS along, false AS between FROM parts")
def overlap_supports(spark, sf):
    """A pattern resembles itself moved by its own pitch, not by half of it."""
    d = _dots(spark, sf, 12, 4)
    along = P.support(F.col("data"), F.col("width"), F.col("p"), F.lit(0)) >= 0.1
    between = P.support(F.col("data"), F.col("width"), F.floor(F.col("p") / 2).cast("int"), F.lit(0)) >= 0.1
    return d.select("row_id", along.alias("along"), between.alias("between"))


@query(f"WITH {PARTS} SELECT row_id, round(1 + row_id % 5 + 0.25::DOUBLE * (row_id % 4), 6) AS x, CASE WHEN row_id % 5 < 4 THEN round(3 * (1 + row_id % 5 + 0.25::DOUBLE * (row_id % 4)), 6) END AS value FROM parts")
def bilinear_samples(spark, sf):
    """A ramp of three a pixel, and nothing outside of it."""
    x = 1 + _k() % 5 + F.lit(0.25) * (_k() % 4)
    at = F.when(_k() % 5 < 4, x).otherwise(F.lit(99.0))
    ramp = F.unhex(F.lit("".join(f"{3 * i:02X}" for i in range(8)) * 3))
    return parts(spark, sf).select("row_id", F.round(x, 6).alias("x"), F.round(P.sampled(ramp, F.lit(8), at, F.lit(1.0)), 6).alias("value"))


@query(f"WITH {PARTS} SELECT row_id, CASE WHEN row_id % 6 > 0 THEN 3 END AS x0, CASE WHEN row_id % 6 > 0 THEN 5 END AS y0, CASE WHEN row_id % 6 > 0 THEN (3 + 20 + row_id % 15 - 1)::INT END AS x1, CASE WHEN row_id % 6 > 0 THEN 5 END AS y1 FROM parts")
def silhouette_tips(spark, sf):
    """Leftmost and rightmost pixels; every sixth mask is too small."""
    right = F.when(_k() % 6 > 0, 23 + _k() % 15).otherwise(F.lit(9))
    m = _mask(parts(spark, sf), 50, 30, (3, 5, right, 20))
    return m.select("row_id", P.tips(F.col("data"), F.col("width")).alias("t")).select("row_id", "t.*")


@query(f"WITH {PARTS} SELECT row_id, (4 * (1 + row_id % 3))::DOUBLE AS periods FROM parts")
def pitch_features(spark, sf):
    """Stripes across a square."""
    n = 4 * (1 + _k() % 3)
    m = _mask(parts(spark, sf), 64, 64, *[(i * F.floor(64 / n), 0, i * F.floor(64 / n) + F.floor(32 / n), 64) for i in range(12)])
    stripes = m.where("row_id % 3 <> 2").unionByName(_mask(parts(spark, sf).where("row_id % 3 = 2"), 64, 64, *[(round(i * 64 / 12), 0, round((i + 0.5) * 64 / 12), 64) for i in range(12)]))
    return stripes.select("row_id", P.pitch(F.col("data"), F.col("width")).alias("p")).select("row_id", F.round("p.periods", 6).alias("periods"))


@query(f"""WITH {PARTS}, g AS (SELECT row_id % 5 AS doc, row_id, CASE row_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN '2' ELSE '7' END AS label FROM parts),
n AS (SELECT doc, label, count(*) AS n FROM g GROUP BY ALL), ok AS (SELECT doc FROM n GROUP BY doc HAVING sum(n) >= 30 AND count(*) FILTER (n >= 4) >= 2)
SELECT doc, label, n FROM n JOIN ok USING (doc) WHERE n >= 4""")
def learned_glyphs(spark, sf):
    """Signs of a document that teach it its own digits."""
    label = F.when(_k() % 3 == 0, "x").when(_k() % 3 == 1, "2").otherwise("7")
    g = parts(spark, sf).select((_k() % 5).alias("doc"), "row_id", label.alias("c"), P.written(label, FONT, 3, 0).alias("t"))
    g = g.select("doc", "row_id", P.fitted(F.col("t.data"), F.col("t.width")).alias("bits"), (F.col("c") == "x").alias("last"))
    return R.learned_templates(g, "doc", "row_id", TEMPLATES).select("doc", "label", "n")


@query(f"WITH {PARTS} SELECT row_id, CASE WHEN row_id % 10 = 3 THEN '2' ELSE (row_id % 10)::VARCHAR END AS label, CASE WHEN row_id % 10 = 3 THEN 'learned' ELSE 'built in' END AS source FROM parts")
def learned_first(spark, sf):
    """Learned shapes and built-in ones together: the nearest wins, of equal ones the learned. Here a document draws its 2 like our 3."""
    from inventa.functions.scalars import hamming_words
    from inventa.operators.match import nearest_template

    bits = lambda t: [int("".join(map(str, w)), 2) for w in t.reshape(-1, 60).tolist()]
    learned = spark.createDataFrame([("learned", "2", bits(TEMPLATES[3][1]))], "source string, label string, bits array<long>")
    built_in = spark.createDataFrame([("built in", c, bits(t)) for c, t in TEMPLATES if c != "x"], learned.schema)
    both = learned.withColumn("ord", F.lit(0)).unionByName(built_in.withColumn("ord", F.ascii("label")))
    shapes = spark.createDataFrame([(c, bits(t)) for c, t in TEMPLATES], "c string, own array<long>")
    g = parts(spark, sf).select("row_id", (_k() % 10).cast("string").alias("c")).join(F.broadcast(shapes), "c")  # eleven shapes
    return nearest_template(g, both, ["row_id"], lambda x: hamming_words(F.col("own"), x["bits"]), ["label", "source"]).select("row_id", "label", "source")


@query("SELECT p_partkey AS row_id, 48 AS dim, 1.0::DOUBLE AS length FROM part")
def embed_pictures(spark, sf):
    """Unit vectors by a network whose weights are made from a seed, since none are published."""
    layers, head = network()
    i = _image(parts(spark, sf), 24, 20, (215, 238, 254), (3, 3, 10 + _k() % 12, 8 + _k() % 11, 90, _k() % 200, 20))
    e = i.select("row_id", P.embedding(F.col("data"), F.col("width"), layers, head).alias("v"))
    return e.select("row_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


def network(seed: int = 0) -> tuple[list, tuple]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(size=shape) * 0.3
    return [(draw(o, i, 3, 3), draw(o)) for o, i in ((8, 3), (16, 8), (32, 16), (32, 32))], (draw(48, 33), draw(48))


@query(f"""WITH {PARTS} SELECT row_id, (row_id % 7 * 18 + 153)::DOUBLE AS conv, (row_id % 7 * 2 + 37)::DOUBLE AS conv_bias, (row_id % 7 * 6 + 135)::DOUBLE AS dense, (row_id % 7 * 3 + 81)::DOUBLE AS dense_bias FROM parts""")
def weight_slices(spark, sf):
    """Blobs of 29 numbers, key % 7 and up, cut into one convolution and one dense layer."""
    blob = P.pandas_of(lambda c: pd.Series([(np.arange(29) + v % 7).astype("<f4").tobytes() for v in c]), T.BinaryType(), 1)(_k())
    s = parts(spark, sf).select("row_id", P.weight_sizes(blob, [(2, 1)], (3, 2)).alias("s"))
    return s.select("row_id", *[F.col("s")[k].alias(n) for k, n in enumerate(("conv", "conv_bias", "dense", "dense_bias"))])


@query()
def merged_labels(spark, sf):
    """Signs of a callout to lines of text; a customer's orders are one callout."""
    from inventa.sources.items import read

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = read(spark, sf, "orders").select(c.alias("box"), (k * 7 % 160).alias("x0"), (k * 13 % 60).alias("y0"), (k * 7 % 160 + 6).alias("x1"), (k * 13 % 60 + 12 + k % 4).alias("y1"), F.when(k % 3 == 0, "x").otherwise((k % 10).cast("string")).alias("label"))
    return R.merged_labels(s, "box")
