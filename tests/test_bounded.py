"""What large tables need: no step that holds, sends or looks at more than its share."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inventa.operators import kernels as K
from inventa.operators import match as M
from inventa.operators import pixels as P
from inventa.operators import regions as R
from inventa.plans import more, pixels, regions  # noqa: F401
from inventa.plans.queries import QUERIES
from inventa.sources import items as I


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [100_000, 0])
def test_bins_multiply_rows_not_items(spark, monkeypatch, most):
    """Counted rows may be broadcast; items and rows that were not are shuffled, however small their files are."""
    monkeypatch.setattr(M, "BROADCAST_ROWS", most)
    items = spark.createDataFrame([(k, k * 37 % 256) for k in range(200)], "item long, r int")
    rows = spark.createDataFrame([(k, k * 59 % 256) for k in range(9)], "row_id long, hr int")
    met = M.in_bins(items, rows, [("r", "hr")], 40)
    assert ("BroadcastHashJoin" in plan_of(met)) == (most > 0)
    wanted = {(i, j) for i in range(200) for j in range(9) if abs(i * 37 % 256 - j * 59 % 256) <= 40}
    got = [(x.item, x.row_id) for x in met.collect()]
    assert len(got) == len(wanted) and set(got) == wanted


def test_grid_gaps_of_many_pairs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (2, 7, 5, 5, 3)).astype(float)
    fa, fb = rng.random((2, 7, 5, 5)) < 0.6
    fa[3] = fb[3] = False
    want = [K.grid_distance(*x) for x in zip(a, b, fa, fb)]
    rows = [(i, x.ravel().tolist(), y.ravel().tolist(), p.ravel().tolist(), q.ravel().tolist()) for i, (x, y, p, q) in enumerate(zip(a, b, fa, fb))]
    rows.append((7, None, *rows[0][2:]))
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>, fa array<boolean>, fb array<boolean>")
    got = [r.d for r in df.select("i", K.grid_gap("a", "b", "fa", "fb").alias("d")).orderBy("i").collect()]
    assert got[3] is None and got[7] is None
    assert np.allclose([g for g in got if g is not None], [w for w in want if np.isfinite(w)])


def test_near_pairs_are_all_pairs(spark):
    """Blocks of three rows and tasks of ten pairs: nothing is lost or found twice."""
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(0, 2)), int(rng.integers(0, 90)), int(rng.choice([0, 45, 90])), float(rng.random())) for k in range(150)]
    df = spark.createDataFrame(rows, "k long, s int, r int, g int, x double")
    found = M.near_pairs(df, ["s"], "k", ["r", "g"], 45, lambda a, b: F.abs(F.col(f"{a}.x") - F.col(f"{b}.x")) <= 0.5, 3, 10)
    got = [tuple(r) for r in found.collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 45 and abs(a[3] - b[3]) <= 45 and abs(a[4] - b[4]) <= 0.5}
    assert len(got) == len(want) and set(got) == want


def test_vetoed_pairs_meet_in_bins(spark, small):
    assert "__bin" in plan_of(QUERIES["veto_predicate"](spark, small))


def pieces(run, back, *columns):
    return list(P.in_pieces(iter([tuple(columns)]), run, back))


def test_pictures_are_handed_on_in_pieces():
    """A batch of 3,000 pictures of 30 KB is not painted as a whole."""
    n = 3000
    out = pieces(lambda w, h, r, b: [P.paint(*v) for v in zip(w, h, r, b)], pa.binary(), pa.array([100] * n), pa.array([100] * n), pa.array([[[1, 2, 5, 9, 7, 8, k % 256]] for k in range(n)]), pa.array([[1, 2, 3]] * n))
    assert max(x.nbytes for x in out) < 2 * P.PIECE and sum(map(len, out)) == n
    k = [k for x in out for k in x.to_pylist()]
    assert [P.image_of(x, 100)[3, 2, 2] for x in k] == [i % 256 for i in range(n)]


def test_pictures_are_spread_by_rows(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    assert I.spread(spark.read.parquet(f"{tmp_path}/t"), 50).rdd.getNumPartitions() == 20


def test_lists_of_numbers():
    c = pa.array([[[1, 2], []], [], [[3], [4, 5]]])
    assert [P.values_of(c.slice(k)) for k in range(3)] == [c.slice(k).to_pylist() for k in range(3)]
    assert P.values_of(pa.array([[1, None], None])) == [[1, None], None]


def test_networks_multiply_matrices(monkeypatch):
    """One product of matrices a layer, as the sum over the window says."""
    monkeypatch.setattr(np, "einsum", None)
    rng = np.random.default_rng(2)
    x, w, b = rng.normal(size=(3, 7, 6)), rng.normal(size=(4, 3, 3, 3)), rng.normal(size=4)
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    want = [[[(p[:, i : i + 3, j : j + 3] * w[o]).sum() + b[o] for j in range(6)] for i in range(7)] for o in range(4)]
    assert np.allclose(R.conv3x3(x, w, b), want)
    assert np.allclose(R.pool(x), np.maximum(x[:, :6].reshape(3, 3, 2, 3, 2).max((2, 4)), 0))


def test_details_share_their_counts():
    """How many pixels lie around each is counted once for all pictures of a size."""
    K._cells.cache_clear()
    m = np.random.default_rng(1).random((20, 31)) < 0.4
    assert np.array_equal(K.detail(m), K.detail(m.copy())) and K._cells.cache_info().misses == 1
    p = np.pad(m.astype(float), 4)
    around = lambda x: np.array([[x[i : i + 9, j : j + 9].sum() for j in range(31)] for i in range(20)])
    assert np.allclose(K.detail(m), m - around(p) / around(np.pad(np.ones(m.shape), 4)))


def test_spectra_are_no_larger_than_they_must_be():
    assert [K.fast_size(n) for n in (192, 193, 7, 128)] == [192, 200, 8, 128]
    m = np.random.default_rng(4).random((11, 14))
    r, d = K.autocorrelation(m), m - m.mean()
    want = [[(d[max(0, y) : 11 + min(0, y), max(0, x) : 14 + min(0, x)] * d[max(0, -y) : 11 - max(0, y), max(0, -x) : 14 - max(0, x)]).sum() for x in range(-10, 11)] for y in range(-10, 11)]
    assert np.allclose(r, np.array(want) / (d * d).sum())


def test_signs_are_labelled_once(monkeypatch):
    calls, runs = [], K.labelled_runs
    monkeypatch.setattr(K, "labelled_runs", lambda *a: calls.append(1) or runs(*a))
    text = P.line_of("27x", pixels.FONT, 3, 1)
    assert R.read_quantity(text, pixels.TEMPLATES) == (27, False) and len(calls) == 1
    assert R.has_digit(text, pixels.TEMPLATES) and len(calls) == 2


def test_fullest_bins_without_a_sort(monkeypatch):
    monkeypatch.setattr(np, "unique", None)
    px = np.array([[9, 9, 9], [200, 1, 1], [8, 8, 10], [203, 2, 3], [90, 90, 90]], np.uint8)
    assert K.modal_colour(px).tolist() == [8.5, 8.5, 9.5] and K.modal_colour(px[1:]).tolist() == [201.5, 1.5, 2.0]
    img = np.full((30, 30, 3), 250, np.uint8)
    img[5:25, 5:25] = 120, 130, 140
    assert K.flat_pixels(img).sum() == 16 * 16 and K.flat_areas(img).sum() == 900 - (24 * 24 - 16 * 16)


def test_nearest_rows_without_pairs(spark):
    """No pair is a row that is sorted: rows of right are one array."""
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 64, 40).tolist(), rng.integers(0, 64, 9).tolist()
    left = spark.createDataFrame(list(enumerate(a)), "i int, x int")
    right = spark.createDataFrame([(j, y, f"t{j}") for j, y in enumerate(b)], "ord int, y int, label string")
    found = M.argmin(left, right, ["i"], lambda t: F.abs(F.col("x") - t["y"]), "ord", ["label"], lambda t: t["y"] % 2 == F.col("x") % 2)
    assert "Sort [" not in plan_of(found).split("BroadcastNestedLoopJoin")[1]
    want = {i: min((abs(x - y), j) for j, y in enumerate(b) if y % 2 == x % 2) for i, x in enumerate(a) if any(y % 2 == x % 2 for y in b)}
    assert {r.i: (r.distance, r.ord) for r in found.collect()} == want


def test_templates_are_met_by_spread_parts(spark, small):
    plan = plan_of(QUERIES["nearest_template_hamming"](spark, small))
    assert "RoundRobinPartitioning" in plan and "array_min" in plan


def test_least_gaps_meet_in_blocks(spark):
    """Blocks of three rows; a group with one side only is not there, one whose vectors have nothing in common has no gap."""
    rng = np.random.default_rng(8)
    rows = [(k, int(k % 5 > 2), rng.normal(size=4).round(3).tolist()) for k in range(60)] + [(100, 7, [1.0]), (101, 8, [1.0, None]), (102, 8, None), (103, 8, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "k long, g int, v array<float>")
    found = M.least_gaps(df, "g", "k", "v", F.col("k") % 2 == 0, F.col("k") % 2 == 1, 3)
    assert "CoGroup" in plan_of(found)
    got = {r.g: r.gap for r in found.collect()}
    f = lambda v: np.array(v, np.float32).astype(float)
    want = {g: min(np.linalg.norm(f(a[2]) - f(b[2])) for a in rows[:60] for b in rows[:60] if a[1] == b[1] == g and a[0] % 2 == 0 and b[0] % 2 == 1) for g in (0, 1)}
    assert set(got) == {0, 1, 8} and got[8] is None and all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_glyphs_are_learned_batch_by_batch(spark):
    """Documents that share a task keep apart, and each sign counts once, in its order."""
    bits = [t.ravel() for _, t in pixels.TEMPLATES]
    rows = [(d, k, bytearray(bits[(2, 7, 10)[k % 3]].tobytes()), k % 3 == 2) for d in (1, 2) for k in range(36 * d)] + [(3, k, bytearray(bits[2].tobytes()), False) for k in range(5)]
    df = spark.createDataFrame(rows, "doc int, k int, bits binary, last boolean").repartition(5)
    found = R.learned_templates(df, "doc", "k", pixels.TEMPLATES)
    assert "MapInArrow" in plan_of(found)
    assert {(r.doc, r.label, r.n) for r in found.collect()} == {(d, c, 12 * d) for d in (1, 2) for c in "27x"}


def test_callouts_share_batches(spark):
    signs = [(b, 10 * k, 0, 10 * k + 6, 14, str((b + k) % 10)) for b in range(40) for k in range(3)]
    out = R.merged_labels(spark.createDataFrame(signs, "box long, x0 long, y0 long, x1 long, y1 long, label string"), "box")
    assert "FlatMapGroups" not in plan_of(out)
    want = {(b, *line) for b in range(40) for line in R.merge_labels([s[1:] for s in signs if s[0] == b])}
    assert {tuple(r) for r in out.collect()} == want and len(want) == 40


PICTURES = ["image_signatures", "glyph_frames", "diagonal_areas", "thumbnail_sizes", "mask_areas", "digit_bands"]


@pytest.mark.parametrize("name", PICTURES)
def test_pictures_go_in_iterators(spark, small, name):
    """No UDF of a query takes or gives a batch as a whole (251 is an iterator over Arrow arrays, 200 was a frame)."""
    plan = plan_of(QUERIES[name](spark, small))
    assert ", 251" in plan and ", 200" not in plan
