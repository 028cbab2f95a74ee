import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inventa.functions import scalars as S
from inventa.operators import aggregate as A
from inventa.operators import cluster as C
from inventa.operators import kernels as K
from inventa.operators import match as M
from inventa.operators import scan as SC
from inventa.operators import state as ST
from inventa.operators import views as V
from inventa.operators import windows as WN


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize(("bits", "gap", "expected"), [([1, 1, 0, 0, 0, 1, 1], 2, [(0, 2), (5, 7)]), ([1, 1, 0, 1, 1], 3, [(0, 5)]), ([0, 0, 0], 1, []), ([1, 0], 2, [(0, 2)]), ([1, 0, 0], 2, [(0, 1)])])
def test_runs(spark, bits, gap, expected):
    df = spark.createDataFrame([("d", i, b) for i, b in enumerate(bits)], "doc string, i long, b int")
    out = WN.runs(df, ["doc"], "i", F.col("b") == 1, gap).collect()
    assert sorted((r.start, r.end) for r in out) == expected


@pytest.mark.parametrize(("rgb", "expected"), [((10, 15, 27), "black"), ((54, 26, 12), "brown"), ((236, 212, 167), "brown"), ((255, 255, 255), "white"), ((128, 128, 128), "grey"), ((200, 0, 0), None)])
def test_colour_category(spark, rgb, expected):
    assert one(spark, S.colour_category(*map(F.lit, rgb))) == expected


@pytest.mark.parametrize(("text", "expected"), [("2x", 2), ("12X", 12), ("200xx", 200), ("201", None), ("0x", None), ("x", None), ("", None), ("a1", None), (None, None), ("9" * 40, None)])
def test_parse_quantity(spark, text, expected):
    assert one(spark, S.parse_quantity(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(("a", "b", "expected"), [("1.2.3", "1.2", True), ("1.2", "1.2.0", False), ("1.10", "1.9", True), ("0.9", "1", False), ("x", "0", False)])
def test_newer_version(spark, a, b, expected):
    assert one(spark, S.newer_version(F.lit(a), F.lit(b))) is expected


@pytest.mark.parametrize(("h", "expected"), [(1.0, "red"), (355.0, "red"), (90.0, "yellow-green"), (340.0, "magenta-red"), (220.0, "blue")])
def test_hue_name(spark, h, expected):
    assert one(spark, S.hue_name(F.lit(h))) == expected


def test_rounding_and_bounds(spark):
    assert one(spark, S.half_up(F.lit(-2.5))) == -2
    assert one(spark, S.half_up(F.lit(2.00005), 4)) == 2.0001
    assert one(spark, S.clamp(F.lit(9), 1, 5)) == 5
    assert one(spark, S.escape_html(F.lit("<a&'\">"))) == "&lt;a&amp;&#39;&quot;&gt;"
    assert one(spark, S.session_name(F.lit("x.PDF"), F.lit(1), F.lit(9))) == "x (1-9)"
    assert one(spark, S.progress(F.lit(0), F.lit(0))) is None
    assert one(spark, S.log_aspect(F.lit(2.0), F.lit(0.0))) is None
    assert one(spark, S.hamming(F.array(*map(F.lit, (1, 0, 1))), F.array(*map(F.lit, (1, 1, 1))))) == 1
    assert one(spark, S.euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 5


@pytest.mark.parametrize(("hexed", "n"), [("f0", 8), ("8", 3), ("00ff10", 24)])
def test_hex_bits(spark, hexed, n):
    bits = one(spark, S.bits_from_hex(F.lit(hexed), n))
    assert bits == [int(c) for c in bin(int("1" + hexed, 16))[3:]][:n]
    if n % 4 == 0:
        assert one(spark, S.hex_from_bits(F.array(*map(F.lit, bits)))) == hexed


def test_page_range_clamps(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "page")
    got = lambda a, b: [r.page for r in SC.page_range(df, a, b, 10).collect()]
    assert got(None, None) == [1] and got(8, 99) == [8, 9, 10] and got(7, 3) == [7] and got(0, 2) == [1, 2]


def test_upper_median_and_fallback(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 7.0)], "g string, v double")
    out = {r.g: r.m for r in A.upper_median_of(df, ["g"], F.col("v"), "m").collect()}
    assert out == {"a": 3.0, "b": 7.0}
    far = spark.createDataFrame([("a", 1.0), ("a", -5.0)], "g string, v double")
    assert A.near_median(far, ["g"], "v", -1.0).count() == 2


ITEM = [(1, 1, 0, 3), (1, 1, 1, 3), (2, 1, 0, 3), (2, 1, 1, 4), (3, 1, 0, 4), (1, 2, 0, 2), (1, 2, 1, 2), (1, 2, 2, 5), (1, 2, 3, 5)]


def test_votes_and_splits(spark):
    readings = spark.createDataFrame([(r, s, p * 100 + o, 0.5) for p, r, o, s in ITEM] + [(3, 6, 1, 0.09), (4, 6, 2, 0.15)], "row_id long, size int, ord long, err double")
    won = {r.row_id: r["size"] for r in A.size_vote(readings).collect()}
    assert won == {1: 3, 3: 6}  # row 2 is an even mix, row 4 a lone reading of large error
    splits = sorted((r.row_id, r["size"], r.new_row) for r in A.row_split(readings).collect())
    assert splits == [(1, 4, 5), (2, 5, 6)]


def test_split_moves_quantities(spark):
    """Rows come in the order of their first readings; what moves is counted anew, doubts and pages too."""
    items = spark.createDataFrame([(1, 0, 9, 2), (2, 0, 9, None), (3, 0, 9, 4), (4, 0, 9, 1), (1, 1, 5, 7), (2, 1, 5, 7), (3, 1, 5, 1), (4, 1, 5, 1), (9, 0, 5, 3)], "page long, item_ord long, row_id long, qty long")
    sizes = {(1, 0): 3, (2, 0): 4, (3, 0): 3, (4, 0): 4, (1, 1): 6, (2, 1): 6, (3, 1): 8, (4, 1): 8}
    readings = spark.createDataFrame([(p, o, 9 if o == 0 else 5, s, p * 100 + o) for (p, o), s in sizes.items()], "page long, item_ord long, row_id long, size int, ord long")
    out = {r.row_id: (r["count"], r.unsure, r.n_pages) for r in A.parts_list(A.split_items(items, readings, ["page", "item_ord"])).collect()}
    assert out == {9: (6, False, 2), 10: (2, True, 2), 5: (17, False, 3), 11: (2, False, 2)}


def test_quantiles_are_those_of_numpy(spark):
    rng = np.random.default_rng(0)
    for v in (rng.normal(size=700), rng.integers(0, 5, 300).astype(float), np.array([3.0]), np.concatenate([np.zeros(500), [1e9]])):
        df = spark.createDataFrame([(int(k % 2), float(x)) for k, x in enumerate(v)] + [(0, None)], "g int, v double")
        shares = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 0.999, "e": 1.0}
        r = A.quantiles(df, [], "v", shares).head()
        assert np.allclose([r[k] for k in shares], np.quantile(v, list(shares.values())))
        for r in A.quantiles(df, ["g"], "v", shares).collect():
            assert np.allclose([r[k] for k in shares], np.quantile(v[r.g :: 2], list(shares.values())))
        assert A.upper_median_of(df, [], F.col("v"), "m").head().m == sorted(v)[len(v) // 2]
    assert A.quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 7919 % 1000 // 3, i) for i in range(1000)], "v long, i long").repartition(5)
    got = WN.global_rank(df, F.desc("v"), "i").collect()
    assert [(r.v, r.i) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((r.v, r.i) for r in got), key=lambda x: (-x[0], x[1]))
    assert sorted(r["rank"] for r in got) == list(range(1, 1001)) and WN.global_rank(df.limit(0), "v").count() == 0


def test_twins_in_blocks(spark):
    x = np.random.default_rng(3).normal(size=(300, 9))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    d = sorted((float(np.linalg.norm(x[i] - x[j])), i, j) for i in range(300) for j in range(i + 1, 300))[:15]
    for block in (40, 1000):
        assert [(r.a, r.b) for r in M.twins(df, "k", "v", 15, block).collect()] == [(i, j) for _, i, j in d]


def test_parts_list_counts_unread_once(spark):
    df = spark.createDataFrame([(1, 7, None), (2, 7, 3), (2, 8, 1)], "page long, row_id long, qty long")
    out = {r.row_id: (r["count"], r.unsure, r.n_pages, r.first_page) for r in A.parts_list(df).collect()}
    assert out == {7: (4, True, 2, 1), 8: (1, False, 1, 2)}
    assert WN.remaining_after(df, 2).count() == 0
    rest = {(r.page, r.row_id): r.remaining for r in WN.remaining_all(df.withColumn("doc", F.lit(0)), "doc").collect()}
    assert rest == {(1, 7): 3, (1, 8): 1}


def test_publish_and_adopt(spark):
    df = spark.createDataFrame([("n", 7, 1, 0, None, (0.12345, 0.5, 1.0, 0.25)), ("n", 7, 2, 1, 3, None), ("n", 8, 2, 0, 2, None)], "name string, row_id long, page long, item_ord long, qty long, rect struct<x:double,y:double,w:double,h:double>")
    rows = spark.createDataFrame([(7, "pic", [4, 2], [1.0, 2.0, 3.5])], "row_id long, thumb string, size array<int>, colour array<double>")
    a, b = V.adopt(V.publish(df, rows)).orderBy("row_id").collect()
    assert (a.row_id, a.t, a.c, a.u, a.p, a.s, a.a) == (7, "pic", 4, True, [1, 2], [4, 2], [1.0, 2.0, 3.5])
    assert [(x.p, x.q, x.r) for x in a.e] == [(1, None, [0.1235, 0.5, 1.0, 0.25]), (2, 3, None)]
    assert (b.row_id, b.t, b.s, b.a) == (8, None, None, [128.0] * 3)


def plain_families(rows):
    """The hue families of one document by the rules, one step after the other."""
    import colorsys

    free = sorted((colorsys.rgb_to_hls(r / 255, g / 255, b / 255)[0] * 360, k, n) for k, r, g, b, n in rows)
    gaps = [(free[(i + 1) % len(free)][0] - h) % 360 if len(free) > 1 else 360 for i, (h, _, _) in enumerate(free)]
    cut = (gaps.index(max(gaps)) + 1) % len(free)
    turned, last, up = [], None, 0
    for h, k, n in free[cut:] + free[:cut]:
        if last is not None and h + up < last:
            up += 360
        last = h + up
        turned.append((last, k, n))
    clusters = [[turned[0]]]
    for x in turned[1:]:
        if x[0] - clusters[-1][-1][0] >= 22:
            clusters.append([])
        clusters[-1].append(x)
    centre = lambda c: sum(u * n for u, _, n in c) / sum(n for _, _, n in c) % 360
    i = len(clusters) - 1
    while i >= 0 and len(clusters) > 1:
        if "-" in C.name_of_hue(centre(clusters[i])) and len(clusters[i]) < 2:
            left = clusters[i][0][0] - clusters[i - 1][-1][0] if i else float("inf")
            right = clusters[i + 1][0][0] - clusters[i][-1][0] if i + 1 < len(clusters) else float("inf")
            to = i - 1 if left <= right else i + 1
            clusters[to] = sorted(clusters[to] + clusters[i])
            del clusters[i]
        i -= 1
    return {k: (C.name_of_hue(centre(c)), round(centre(c), 4)) for c in clusters for _, k, _ in c}


def test_hue_families(spark):
    import colorsys

    rng = np.random.default_rng(5)
    rows, folded = [], 0
    for doc in range(12):
        for k in range(int(rng.integers(1, 9))):
            r, g, b = (round(255 * x) for x in colorsys.hls_to_rgb(rng.random(), 0.5, 0.9))
            rows.append((doc, doc * 100 + k, r, g, b, int(rng.integers(1, 9))))
    rows += [(0, 990, 0, 0, 0, 5), (0, 991, 128, 128, 128, 5), (0, 992, 129, 128, 128, 9)]
    df = spark.createDataFrame(rows, "doc int, row_id long, r int, g int, b int, count long")
    out = {(r.doc, r.row_id): r for r in V.hue_families(df, "doc").collect()}
    assert len(out) == len(rows) and [out[0, k].family for k in (990, 991, 992)] == ["black", "grey", "grey"] and out[0, 992].place == 1 and out[0, 990].family_order == -4
    for doc in range(12):
        want = plain_families([x[1:] for x in rows if x[0] == doc and x[1] < 990 + 100 * 12 and x[1] not in (990, 991, 992)])
        least = {}
        for name, c in want.values():
            least[name] = min(least.get(name, 999), c)
        for k, (name, _) in want.items():
            assert out[doc, k].family == name and abs(out[doc, k].family_order - least[name]) < 0.01
            folded += "-" in name
    assert folded


def test_leader_clusters_invariants(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    rows = C.leaders(x, 1.0, C.l2)
    heads = [int(np.flatnonzero(rows == k)[0]) for k in range(rows.max() + 1)]
    for i, k in enumerate(rows):
        d = C.l2(x[[h for h in heads if h < i or h == i]], x[i])
        assert d[k] <= 1.0 and d[k] == d.min() or heads[k] == i
    df = spark.createDataFrame([(0, i, v.tolist(), [i % 2 * 90] * 3) for i, v in enumerate(x)], "doc int, i int, v array<double>, c array<int>")
    out = C.leader_clusters(df, "doc", "i", "v", 1.0).toPandas().sort_values("i")
    assert out.row_id.tolist() == rows.tolist()
    vetoed = C.leader_clusters(df, "doc", "i", "v", 9.0, "c").toPandas()
    assert (vetoed.i % 2 == vetoed.row_id).all()


def test_first_match_is_not_nearest():
    x = np.array([[0.0], [10.0], [9.0]])
    assert C.leaders(x, 9.0, C.l2, nearest=False).tolist() == [0, 1, 0]
    assert C.leaders(x, 9.0, C.l2).tolist() == [0, 1, 1]


def test_two_means_and_folding():
    side, gap = C.two_means(np.array([[1.0, 0], [0.99, 0.1], [0, 1.0]]))
    assert side[0] == side[1] != side[2] and gap > 1
    cluster = lambda k, n, low, high: {"n": n, "low": low, "high": high, "weight": n, "moment": n * (low + high) / 2, "members": [k]}
    out = C.fold_small([cluster(0, 5, 0.0, 20.0), cluster(1, 1, 91.0, 91.0), cluster(2, 4, 130.0, 131.0)])
    assert [c["members"] for c in out] == [[0], [2, 1]] and out[1]["low"] == 91.0
    x = np.random.default_rng(0).normal(size=(1300, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    i, j = C.farthest(x)
    assert abs(d[i, j] - d.max()) < 1e-9
    assert C.two_means(np.zeros((1, 2)))[1] == 0


def test_components(spark):
    from inventa.sources.shared import prepare

    prepare(spark)
    df = spark.createDataFrame([(5, 6), (6, 7), (1, 2), (9, 9)] + [(i, i + 1) for i in range(100, 160)], "u long, v long")
    out = {r.id: r.component for r in C.connected_components(df, "u", "v").collect()}
    assert out[7] == 5 and out[2] == 1 and out[9] == 9 and out[160] == 100


def test_containment(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 9, 9), (2, 0, 1, 1, 3, 3), (3, 0, 0, 0, 9, 9), (4, 1, 1, 1, 3, 3)], "id int, doc int, x0 int, y0 int, x1 int, y1 int")
    assert sorted(r.id for r in M.outermost(df, "id", ["doc"]).collect()) == [1, 4]


def test_state(spark):
    log = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 1, "z")], "key string, t int, v string")
    assert {r.key: (r.version, r.v) for r in ST.latest(log, ["key"], ["t"], ["v"]).collect()} == {"k": (3, "c"), "j": (1, "z")}
    puts = spark.createDataFrame([("c", str(i), i) for i in range(15)] + [("c", "0", 99)], "key string, item string, t int")
    assert {r["item"] for r in ST.fifo(puts, ["key"], "item", ["t"]).collect()} == {str(i) for i in range(3, 15)}
    files = spark.createDataFrame([("f1",), ("f2",)], "file_key string")
    sessions = spark.createDataFrame([("f2", None), ("s", "zz")], "id string, file_key string")
    assert [r.file_key for r in ST.collect_garbage(files, sessions).collect()] == ["f1"]


def test_kernels():
    y, x = np.mgrid[0:120, 0:120]
    img = np.cos(2 * np.pi * x / 12) + np.cos(2 * np.pi * y / 15)
    found = {(dx, dy) for dx, dy, _ in K.peaks(K.autocorrelation(img, 40))}
    assert {(12, 0), (0, 15)} <= found
    a, b = K.reduce_basis((12, 15), (24, 15))
    assert sorted([tuple(map(abs, a)), tuple(map(abs, b))]) == [(0.0, 15.0), (12.0, 0.0)]
    assert K.solve_size((10, 0), (0, 10), (40, 20))[:2] == (4, 2)
    assert K.solve_size((10, 0), (0, 10), (164.8, 4.9)) is None and K.solve_size((1, 0), (2, 0), (1, 1)) is None
    mask = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0]])
    assert len(K.components(mask)) == 2 and K.components(mask, True) == [(0, 0, 1, 1, 2)]
    speck = np.zeros((9, 9), bool)
    speck[4, 4] = True
    block = np.zeros((9, 9), bool)
    block[2:7, 2:7] = True
    assert not K.opening(speck).any() and (K.opening(block) == block).all()
    g = K.fit_glyph(block)
    assert g.shape == (30, 22) and g.any() and not K.fit_glyph(np.zeros((3, 3))).any()
    c = np.zeros((6, 6, 3), np.uint8)
    f = np.zeros((6, 6), bool)
    f[1:4, 1:4] = True
    assert K.grid_distance(c, c, f, np.roll(f, 2, 0)) == 0 and K.grid_distance(c, c, f, f) == 0
    assert K.sample(np.arange(4.0).reshape(2, 2), 0.5, 0.5) == 1.5 and K.sample(np.zeros((2, 2)), 5, 0) is None
    assert math.isclose(float(K.autocorrelation(img, 5)[5, 5]), 1.0)


def test_lattices():
    y, x = np.mgrid[0:120, 0:120]
    img = np.cos(2 * np.pi * x / 14) + np.cos(2 * np.pi * y / 15)
    r = K.autocorrelation(img, 40)
    a, b, score = K.best_lattice(r, K.peaks(r))
    assert sorted([tuple(map(abs, a)), tuple(map(abs, b))]) == [(0.0, 15.0), (14.0, 0.0)] and score > 0.5
    assert K.best_lattice(r, []) is None and K.best_lattice(r, [(10, 0, 1.0), (0, 20, 0.5)]) is None  # too long a side
    d = K.detail(img)
    assert K.overlap_support(d, 14, 0) > 0.9 > 0.1 > K.overlap_support(d, 7, 0) and K.overlap_support(d, 500, 0) == 0
    assert np.allclose(K.detail(np.ones((9, 9))), 0)
    mask = np.zeros((40, 40), bool)
    mask[10:30, 5:25] = True
    assert K.corners(mask) == ((5, 10), (24, 10)) and K.corners(mask[:15]) is None


def test_sources(spark, tmp_path):
    from inventa.sources import items as I

    (tmp_path / "t.json").write_text('{"pdf": "a", "note": "", "pairs": [{"row": 8, "gap": 0.1, "a": [[1, 0], [2, 1]], "b": [[3, 0]]}]}')
    got = sorted(tuple(r) for r in I.read_truth(spark, str(tmp_path / "t.json")).collect())
    assert got == [(0, "a", 1, 0), (0, "a", 2, 1), (0, "b", 3, 0)]
    (tmp_path / "g.js").write_text("const T = [{label: '1', bits: 'f0'}, {label: 'x', bits: '0a'}];")
    assert [(r.ord, r.label, r.bits) for r in I.read_templates(spark, str(tmp_path / "g.js")).collect()] == [(0, "1", "f0"), (1, "x", "0a")]
    (tmp_path / "a.ppm").write_bytes(b"P6\n2 1\n255\n" + bytes(range(6)))
    r = I.read_rasters(spark, str(tmp_path / "a.ppm")).head()
    assert (r.width, r.height, bytes(r["data"])) == (2, 1, bytes(range(6)))


def test_two_means_split_equals_all_pairs(spark, small):
    from inventa.plans.registry import queries

    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    got = {r.vec_id: (r.side, r.gap) for r in queries()["two_means_split"](spark, small).collect()}
    assert len(got) == len(rows)
    for label in {r.label for r in rows}:
        own = sorted((r.vec_id, r.embedding) for r in rows if r.label == label)
        x = np.array([v for _, v in own], float)
        d = [[float(np.linalg.norm(a - b)) for b in x] for a in x]
        _, i, j = max((round(d[i][j], 9), -i, -j) for i in range(len(x)) for j in range(i, len(x)))
        centres, side = [x[-i], x[-j]], None
        for _ in range(25):
            new = [0 if np.linalg.norm(v - centres[0]) <= np.linalg.norm(v - centres[1]) else 1 for v in x]
            if new == side:
                break
            side = new
            for k in (0, 1):
                if k in side:
                    m = np.mean([v for v, s in zip(x, side) if s == k], axis=0)
                    centres[k] = m / np.linalg.norm(m)
        gap = float(np.linalg.norm(centres[0] - centres[1]))
        assert [got[v][0] for v, _ in own] == side and all(abs(got[v][1] - gap) < 1e-5 for v, _ in own)


def test_files_come_back(spark, tmp_path):
    from inventa.sources import items as I

    with pytest.raises(ValueError, match="no templates"):
        (tmp_path / "none.js").write_text("const X = 1;")
        I.read_templates(spark, str(tmp_path / "none.js"))
    assert I.awaited(spark, str(tmp_path / "none.js")) and not I.awaited(spark, str(tmp_path / "never"), 2, 0.01)
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [I.cached(spark, str(tmp_path / "t"), make).count() for _ in (1, 2)] == [3, 3] and made == [1]
    t = spark.createDataFrame([("6", [1, 0, 0, 1, 1]), ("9", [1] * 5)], "label string, bits array<int>")
    assert {r.label: r.bits for r in I.with_nine(t).collect()} == {"6": [1, 0, 0, 1, 1], "9": [1, 1, 0, 0, 1]}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from inventa.sources import shared

    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://somewhere:7077")
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.prepare(fake)
