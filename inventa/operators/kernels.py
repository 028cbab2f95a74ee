"""Dense numeric kernels of measured patterns, in numpy, and Arrow UDFs over array columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_PEAK, MOST_LAG, TOP = 0.20, 120, 8
PEAKS = T.ArrayType(T.StructType([T.StructField("lag", T.IntegerType()), T.StructField("value", T.DoubleType())]))
BOXES = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("x0", "y0", "x1", "y1", "n")]))


@lru_cache(256)
def fast_size(n: int) -> int:
    """The next size from n on that has no other prime factors than 2, 3 and 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def autocorrelation(img: np.ndarray, lag: int = MOST_LAG) -> np.ndarray:
    """Normalised autocorrelation for shifts of -lag..lag on both axes; zero padding keeps it from wrapping. Half of it is the other half turned, so only one is computed."""
    h, w = img.shape
    lag = min(lag, h - 1, w - 1)
    n, m = fast_size(2 * h), fast_size(2 * w)
    f = np.fft.fft(np.fft.rfft(img - img.mean(), m, axis=1), n, axis=0)
    half = np.fft.irfft(np.fft.ifft(f.real**2 + f.imag**2, axis=0)[: lag + 1], m, axis=1)
    r = np.empty((2 * lag + 1, 2 * lag + 1))
    r[lag:, lag:], r[lag:, :lag] = half[:, : lag + 1], half[:, m - lag :]
    r[:lag] = r[:lag:-1, ::-1]
    return r / max(r[lag, lag], 1e-12)


def peaks(r: np.ndarray, radius: int = 8, top: int = TOP) -> list[tuple[int, int, float]]:
    """Strongest local maxima of one half plane as (dx, dy, value)."""
    lag = r.shape[0] // 2
    half = r[lag - 1 :]  # dy of -1 and up
    inner = half[1:-1, 1:-1]
    rows = np.maximum(np.maximum(half[:-2], half[1:-1]), half[2:])
    around = np.maximum(np.maximum(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])
    y, x = np.nonzero((inner >= around) & (inner > 0))
    dx, dy = x + 1 - lag, y
    ok = ((dy > 0) | ((dy == 0) & (dx > 0))) & (dx * dx + dy * dy >= radius * radius) & (np.maximum(np.abs(dx), np.abs(dy)) <= lag - 2)
    out = list(zip(dx[ok].tolist(), dy[ok].tolist(), inner[y, x][ok].tolist()))
    best = max((p[2] for p in out), default=0.0)
    return sorted((p for p in out if p[2] >= LEAST_PEAK * best), key=lambda p: (-p[2], p[1], p[0]))[:top]


def reduce_basis(u: tuple[float, float], v: tuple[float, float], rounds: int = 50) -> tuple[tuple[float, float], tuple[float, float]]:
    """Shortest basis of the lattice of two vectors; halves round toward plus infinity."""
    (ax, ay), (bx, by) = map(float, u), map(float, v)
    for _ in range(rounds):
        if ax * ax + ay * ay > bx * bx + by * by:
            ax, ay, bx, by = bx, by, ax, ay
        square = ax * ax + ay * ay
        if square == 0:
            break
        k = math.floor((ax * bx + ay * by) / square + 0.5)
        if k == 0:
            break
        bx, by = bx - k * ax, by - k * ay
    return (ax, ay), (bx, by)


def sample(img: np.ndarray, x: float, y: float) -> float | None:
    """Bilinear value, or nothing outside."""
    if not (0 <= x <= img.shape[1] - 1 and 0 <= y <= img.shape[0] - 1):
        return None
    i, j = min(int(x), img.shape[1] - 2), min(int(y), img.shape[0] - 2)
    fx, fy = x - i, y - j
    return float((img[j, i] * (1 - fx) + img[j, i + 1] * fx) * (1 - fy) + (img[j + 1, i] * (1 - fx) + img[j + 1, i + 1] * fx) * fy)


def samples(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`sample` at many places; those outside go."""
    inside = (x >= 0) & (x <= img.shape[1] - 1) & (y >= 0) & (y <= img.shape[0] - 1)
    x, y = x[inside], y[inside]
    i, j = np.minimum(x.astype(int), img.shape[1] - 2), np.minimum(y.astype(int), img.shape[0] - 2)
    fx, fy = x - i, y - j
    return (img[j, i] * (1 - fx) + img[j, i + 1] * fx) * (1 - fy) + (img[j + 1, i] * (1 - fx) + img[j + 1, i + 1] * fx) * fy


@lru_cache(8)
def _steps(reach: int) -> tuple[np.ndarray, np.ndarray]:
    m, n = (v.ravel() for v in np.mgrid[-reach : reach + 1, -reach : reach + 1])
    return m[(m != 0) | (n != 0)], n[(m != 0) | (n != 0)]


def lattice_points(a: tuple[float, float], b: tuple[float, float], middle: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the points of a lattice around a middle, without it."""
    m, n = _steps(reach)
    return middle + m * a[0] + n * b[0], middle + m * a[1] + n * b[1]


def lattice_score(r: np.ndarray, a: tuple[float, float], b: tuple[float, float], found: list[tuple[int, int, float]], reach: int = 3, near: float = 2.5) -> float:
    """Mean value of an autocorrelation at the lattice points around its middle, times the share of peaks that lie on the lattice."""
    values = samples(r, *lattice_points(a, b, r.shape[0] // 2, reach))
    basis = np.array([a, b], float).T
    if not len(values) or not found or abs(np.linalg.det(basis)) < 1e-9:
        return 0.0
    points = np.array([p[:2] for p in found], float).T
    off = points - basis @ np.floor(np.linalg.solve(basis, points) + 0.5)
    return float(np.mean(values)) * float((np.hypot(*off) <= near).mean())


def best_lattice(r: np.ndarray, found: list[tuple[int, int, float]], sine: float = 0.3, ratio: float = 0.8) -> tuple[tuple[float, float], tuple[float, float], float] | None:
    """The square-like lattice of two peaks with the best score above 0; equal lattices are tried once."""
    best, seen = None, set()
    for i, p in enumerate(found):
        for q in found[i + 1 :]:
            a, b = reduce_basis(p[:2], q[:2])
            la, lb = math.hypot(*a), math.hypot(*b)
            key = tuple(sorted((tuple(round(abs(x)) for x in a), tuple(round(abs(x)) for x in b))))
            if min(la, lb) == 0 or key in seen:
                continue
            seen.add(key)
            if abs(a[0] * b[1] - a[1] * b[0]) / (la * lb) <= sine or min(la, lb) / max(la, lb) < ratio:
                continue
            score = lattice_score(r, a, b, found)
            if score > 0 and (best is None or score > best[2]):
                best = a, b, score
    return best


def _box(x: np.ndarray, radius: int) -> np.ndarray:
    """Sums over squares around each pixel."""
    (h, w), k = x.shape, 2 * radius + 1
    c = np.zeros((h + k, w + k), x.dtype)
    c[radius + 1 : radius + 1 + h, radius + 1 : radius + 1 + w] = x
    c = c.cumsum(0, dtype=x.dtype).cumsum(1, dtype=x.dtype)
    return c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]


@lru_cache(256)
def _cells(shape: tuple[int, int], radius: int) -> np.ndarray:
    return _box(np.ones(shape), radius)


def detail(img: np.ndarray, radius: int = 4) -> np.ndarray:
    """What is left of an image without its moving mean; at the rim the mean is over what is there. Masks are summed as whole numbers."""
    return img - _box(img.astype(np.int32 if img.dtype == bool else float), radius) / _cells(img.shape, radius)


def overlap_support(img: np.ndarray, dx: int, dy: int) -> float:
    """Correlation of an image with itself, moved by whole pixels, over the part that overlaps."""
    h, w = img.shape
    if abs(dx) >= w or abs(dy) >= h:
        return 0.0
    a = img[max(0, dy) : min(h, h + dy), max(0, dx) : min(w, w + dx)]
    b = img[max(0, -dy) : min(h, h - dy), max(0, -dx) : min(w, w - dx)]
    return float((a * b).sum() / max(np.sqrt((a * a).sum() * (b * b).sum()), 1e-12))


def corners(mask: np.ndarray, least: int = 200, width: int = 16) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """(x, y) of the leftmost and the rightmost pixel, the upper ones of several; None for masks that are too small."""
    ys, xs = np.nonzero(mask)
    if len(xs) < least or xs.max() - xs.min() + 1 < width:
        return None
    left, right = xs.min(), xs.max()
    return (int(left), int(ys[xs == left].min())), (int(right), int(ys[xs == right].min()))


def solve_size(a: tuple[float, float], b: tuple[float, float], span: tuple[float, float], most_error: float = 0.18) -> tuple[int, int, float] | None:
    """(long, short, error) of a grid of vectors a and b that spans a diagonal; None where it is no grid."""
    det = a[0] * b[1] - a[1] * b[0]
    if det == 0:
        return None
    x = abs((span[0] * b[1] - b[0] * span[1]) / det)
    y = abs((a[0] * span[1] - span[0] * a[1]) / det)
    nx, ny = int(np.floor(x + 0.5)), int(np.floor(y + 0.5))
    err = max(abs(x - nx), abs(y - ny))
    if err > most_error or not (2 <= max(nx, ny) <= 24 and 1 <= min(nx, ny) <= 24):
        return None
    return max(nx, ny), min(nx, ny), float(err)


def labelled_runs(mask: np.ndarray, eight: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, area) of all runs of true pixels; area is the number of the first run of the connected area.
    Runs of neighbouring rows that touch are edges, and labels sink along them by pointer jumping: no pixel is walked."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(bool).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    wide, reach = w + 2, int(eight)
    below = (y + 1) * wide
    low = np.searchsorted(y * wide + end, below + start + 1 - reach)
    high = np.searchsorted(y * wide + start, below + end - 1 + reach, "right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    area = np.arange(len(y))
    while len(a):
        least = np.minimum(area[a], area[b])
        np.minimum.at(area, area[a], least)
        np.minimum.at(area, area[b], least)
        area = area[area]
        live = area[a] != area[b]
        a, b = a[live], b[live]
    while (area != area[area]).any():
        area = area[area]
    return y, start, end, area


def components(mask: np.ndarray, eight: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, pixels) of connected areas, bounds inclusive, in order of their first pixel."""
    y, start, end, area = labelled_runs(mask, eight)
    if not len(y):
        return []
    order = np.argsort(area, kind="stable")
    at = np.flatnonzero(np.diff(area[order], prepend=-1))
    y, start, end = y[order], start[order], end[order]
    found = (np.minimum.reduceat(start, at), y[at], np.maximum.reduceat(end, at) - 1, np.maximum.reduceat(y, at), np.add.reduceat(end - start, at))
    return [tuple(c) for c in np.stack(found, 1).tolist()]


def component_masks(mask: np.ndarray, eight: bool = True) -> list[np.ndarray]:
    """Each connected area alone, cut to its bounds, in the order of `components`."""
    return [m for _, m in component_parts(mask, eight)]


def component_parts(mask: np.ndarray, eight: bool = True, wanted: Callable[[tuple], bool] | None = None) -> list[tuple[tuple[int, int, int, int, int], np.ndarray]]:
    """(what `components` says, the area alone) of each connected area, or of those that are wanted by their bounds."""
    y, start, end, area = labelled_runs(mask, eight)
    if not len(y):
        return []
    order = np.argsort(area, kind="stable")
    at = np.flatnonzero(np.diff(area[order], prepend=-1))
    y, start, end = y[order], start[order], end[order]
    found = np.stack((np.minimum.reduceat(start, at), y[at], np.maximum.reduceat(end, at) - 1, np.maximum.reduceat(y, at), np.add.reduceat(end - start, at)), 1)
    out = []
    for c, low, high in zip(map(tuple, found.tolist()), at.tolist(), [*at[1:].tolist(), len(y)]):
        if wanted is None or wanted(c):
            local = np.zeros((c[3] - c[1] + 1, c[2] - c[0] + 1), bool)
            for r, a, b in zip((y[low:high] - c[1]).tolist(), (start[low:high] - c[0]).tolist(), (end[low:high] - c[0]).tolist()):
                local[r, a:b] = True
            out.append((c, local))
    return out


def opening(mask: np.ndarray, size: int = 3) -> np.ndarray:
    """Erosion, then dilation, by a square; outside is empty."""
    def slide(m: np.ndarray, how, before: int, after: int) -> np.ndarray:
        for axis in (0, 1):  # a square is a column of rows
            h, w = m.shape
            p = np.zeros((h + before + after, w) if axis == 0 else (h, w + before + after), bool)
            if axis == 0:
                p[before : before + h] = m
                m = how.reduce([p[i : i + h] for i in range(size)])
            else:
                p[:, before : before + w] = m
                m = how.reduce([p[:, i : i + w] for i in range(size)])
        return m

    a, b = (size - 1) // 2, size // 2
    return slide(slide(mask.astype(bool), np.logical_and, a, b), np.logical_or, b, a)


def fit_glyph(mask: np.ndarray, width: int = 22, height: int = 30, pad: int = 2) -> np.ndarray:
    """A mask cut to its ink and put in the middle of a frame, nearest neighbour."""
    out = np.zeros((height, width), np.uint8)
    ys = np.flatnonzero(mask.any(1))
    if not len(ys):
        return out
    xs = np.flatnonzero(mask.any(0))
    m = mask[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
    k = min((width - 2 * pad) / m.shape[1], (height - 2 * pad) / m.shape[0])
    w, h = max(1, int(np.floor(m.shape[1] * k + 0.5))), max(1, int(np.floor(m.shape[0] * k + 0.5)))
    rows = np.minimum((np.arange(h) / k).astype(int), m.shape[0] - 1)
    cols = np.minimum((np.arange(w) / k).astype(int), m.shape[1] - 1)
    top, left = (height - h) // 2, (width - w) // 2
    out[top : top + h, left : left + w] = m[rows][:, cols]
    return out


def grid_distance(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray, reach: int = 2) -> float:
    """Least mean difference of two colour grids over shifts; a cell that only one of them fills costs all of its range."""
    h, w = fa.shape
    best = np.inf
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            sb, sf = np.zeros_like(b), np.zeros_like(fb, bool)
            ys, xs = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
            yt, xt = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
            sb[ys, xs], sf[ys, xs] = b[yt, xt], fb[yt, xt]
            either = fa.astype(bool) | sf
            if either.any():
                both = fa.astype(bool) & sf
                d = np.where(both[..., None], np.abs(a.astype(float) - sb), 255.0)
                best = min(best, float(d[either].mean()))
    return best


def grid_distances(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray, reach: int = 2) -> np.ndarray:
    """grid_distance of many pairs at once: (pairs, h, w, channels) and (pairs, h, w); nan where nothing is filled."""
    n, h, w, c = a.shape
    best = np.full(n, np.nan)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            sb, sf = np.zeros_like(b), np.zeros_like(fb)
            ys, xs = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
            yt, xt = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
            sb[:, ys, xs], sf[:, ys, xs] = b[:, yt, xt], fb[:, yt, xt]
            cells = (fa | sf).sum((1, 2))
            both = fa & sf
            total = (np.abs(a - sb).sum(3) * both).sum((1, 2)) + 255.0 * c * (cells - both.sum((1, 2)))
            best = np.fmin(best, np.where(cells > 0, total / np.maximum(cells * c, 1), np.nan))
    return best


@F.pandas_udf(T.DoubleType())
def _grid_gap(a: pd.Series, b: pd.Series, fa: pd.Series, fb: pd.Series) -> pd.Series:
    columns = [s.to_numpy() for s in (a, b, fa, fb)]
    out, alike = np.full(len(a), np.nan), {}
    for i, v in enumerate(zip(*columns)):
        if all(x is not None for x in v):
            alike.setdefault(tuple(map(len, v)), []).append(i)
    for (_, _, cells, _), rows in alike.items():
        n = round(cells**0.5)
        for s in range(0, len(rows), 1024):
            some = rows[s : s + 1024]
            grids = [np.stack([np.asarray(c[i], float) for i in some]).reshape(len(some), n, n, -1) for c in columns[:2]]
            filled = [np.stack([np.asarray(c[i], bool) for i in some]).reshape(len(some), n, n) for c in columns[2:]]
            out[some] = grid_distances(*grids, *filled)
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def grid_gap(a: str, b: str, fa: str, fb: str) -> Column:
    """grid_distance of square grids in array columns; null where nothing is filled."""
    return _grid_gap(a, b, fa, fb)


@F.pandas_udf(PEAKS)
def series_peaks(values: pd.Series) -> pd.Series:
    """Local maxima of the autocorrelation of a series, strongest first."""
    def one(v) -> list:
        x = np.asarray(v, float)
        if len(x) < 4:
            return []
        n = 1 << int(np.ceil(np.log2(2 * len(x))))
        f = np.fft.rfft(x - x.mean(), n)  # padded, so that nothing wraps
        r = np.fft.irfft(f * np.conj(f), n)[: len(x)]
        r = np.round(r / max(r[0], 1e-12), 12)
        at = [k for k in range(1, len(r) - 1) if r[k] > r[k - 1] and r[k] >= r[k + 1] and r[k] > LEAST_PEAK]
        return [{"lag": k, "value": round(float(r[k]), 9)} for k in sorted(at, key=lambda k: (-round(float(r[k]), 9), k))[:TOP]]

    return values.map(one)


@F.pandas_udf(BOXES)
def mask_components(data: pd.Series, width: pd.Series) -> pd.Series:
    """Connected areas of binary masks, one byte a pixel."""
    return pd.Series([[dict(zip(("x0", "y0", "x1", "y1", "n"), c)) for c in components(np.frombuffer(d, np.uint8).reshape(-1, w) > 0)] if d else [] for d, w in zip(data, width)])


def boxes(mask: Column, width: Column) -> Column:
    return F.inline(mask_components(mask, width))


def slide(img: np.ndarray, how, radius: int) -> np.ndarray:
    """`how` (np.maximum or np.minimum) over squares around each pixel; at the rim over what is there."""
    fill = -np.inf if how is np.maximum else np.inf
    for axis in (0, 1):
        n = img.shape[axis]
        wide = np.full(tuple(x + 2 * radius * (k == axis) for k, x in enumerate(img.shape)), fill)
        at = lambda k: (slice(k, k + n), slice(None)) if axis == 0 else (slice(None), slice(k, k + n))
        wide[at(radius)] = img
        img = wide[at(0)]
        for k in range(1, 2 * radius + 1):
            img = how(img, wide[at(k)])
    return img


def flat_areas(img: np.ndarray, radius: int = 2, tolerance: float = 8) -> np.ndarray:
    """Pixels of a colour image around which grey hardly changes."""
    grey = channel_sum(img) / 3
    return slide(grey, np.maximum, radius) - slide(grey, np.minimum, radius) <= tolerance


def channel_sum(img: np.ndarray) -> np.ndarray:
    return img[..., 0].astype(int) + img[..., 1] + img[..., 2]


def off_colour(img: np.ndarray, colour: np.ndarray) -> np.ndarray:
    """Largest difference over the channels."""
    d = np.abs(img[..., 0] - colour[0])
    for c in (1, 2):
        np.maximum(d, np.abs(img[..., c] - colour[c]), out=d)
    return d


def modal_colour(px: np.ndarray, shift: int = 3) -> np.ndarray:
    """Mean of the fullest bin of colours; of equally full bins the one seen first."""
    bits = 8 - shift
    key = ((px[:, 0].astype(np.int32) >> shift) << 2 * bits) | ((px[:, 1].astype(np.int32) >> shift) << bits) | (px[:, 2] >> shift)
    n = np.bincount(key)
    top = np.flatnonzero(n == n.max())
    best = top[0] if len(top) == 1 else key[np.argmax(np.isin(key, top))]
    return px[key == best].astype(float).mean(0)


def flat_pixels(img: np.ndarray, step: int = 2, tolerance: int = 24, apart: float = 12) -> np.ndarray:
    """Pixels whose four samples two pixels away have nearly their sum of channels, and that are not of the page's own colour."""
    total, page = channel_sum(img), modal_colour(img.reshape(-1, 3))
    out = np.zeros(total.shape, bool)
    inner = total[step:-step, step:-step]
    near = [total[2 * step :, step:-step], total[: -2 * step, step:-step], total[step:-step, 2 * step :], total[step:-step, : -2 * step]]
    out[step:-step, step:-step] = np.logical_and.reduce([np.abs(inner - x) <= tolerance for x in near])
    return out & (off_colour(img, page) > apart)


def candidate_rects(img: np.ndarray, k: float = 1.0, fill: float = 0.55, share: float = 0.55, content: float = 0.01, apart: float = 12) -> list[tuple[int, int, int, int]]:
    """Bounds of flat areas that are not the page: large enough, filled, no more than a share of it, with something drawn inside."""
    h, w = img.shape[:2]
    mask = flat_areas(img) & (off_colour(img, modal_colour(img.reshape(-1, 3))) > apart)

    def large(c: tuple) -> bool:
        bw, bh = c[2] - c[0] + 1, c[3] - c[1] + 1
        return not (bw < 40 * k or bh < 40 * k or bw * bh < 2000 * k * k or bw * bh > share * h * w or c[4] < fill * bw * bh)

    out = []
    for (x0, y0, x1, y1, _), own in component_parts(mask, False, large):
        box = img[y0 : y1 + 1, x0 : x1 + 1]
        if (off_colour(box, np.median(box[own], axis=0)) > 30).mean() >= content:
            out.append((x0, y0, x1, y1))
    return out


def cropped(ink: np.ndarray, pad: int = 2) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1) around what is drawn and a rim, bounds inclusive; all of it where nothing is drawn."""
    ys, xs = np.nonzero(ink)
    h, w = ink.shape
    if not len(ys):
        return 0, 0, w - 1, h - 1
    return max(0, int(xs.min()) - pad), max(0, int(ys.min()) - pad), min(w - 1, int(xs.max()) + pad), min(h - 1, int(ys.max()) + pad)


def resized(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest pixels."""
    h, w = img.shape[:2]
    return img[np.minimum((np.arange(height) + 0.5) * h / height, h - 1).astype(int)][:, np.minimum((np.arange(width) + 0.5) * w / width, w - 1).astype(int)]


def pitch_feature(grey: np.ndarray, size: int = 64, low: float = 2, high: float = 16) -> tuple[float, float]:
    """(periods across the picture, how far they stand out): the peak of the spectrum of a windowed square."""
    a = resized(grey, size, size).astype(float)
    a = (a - a.mean()) * np.outer(np.hanning(size), np.hanning(size))
    f = np.abs(np.fft.fftshift(np.fft.fft2(a)))
    y, x = np.mgrid[-size // 2 : size // 2, -size // 2 : size // 2]
    far = np.hypot(x, y)
    band = (far >= low) & (far <= high)
    if f[band].max() <= 0:
        return 0.0, 0.0
    k = int(np.argmax(np.where(band, f, -1)))
    return float(far.flat[k]), float(f.flat[k] / (f[band].mean() + 1e-9))
