"""Operators over pictures in columns, as Arrow UDFs.

A picture is a binary column and its width: one byte a pixel for masks, three for colours. All of a row's work is on
that row, so these are maps; what comes out are numbers, structs and smaller pictures. A batch is taken in pieces whose
values, read and made, are some PIECE bytes, and each piece is handed on before the next is made: what a worker holds
follows neither the number of rows in a batch nor the size of what is painted for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from inventa.operators import kernels as K
from inventa.operators import regions as R

INT, LONG, DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()


def struct(kind: T.DataType, *names: str) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


RECT = struct(INT, "x0", "y0", "x1", "y1")
AREA = struct(INT, "x0", "y0", "x1", "y1", "n")
PICTURE = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("width", INT), T.StructField("height", INT)])


def mask_of(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, width) > 0


def image_of(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, width, 3)


#: Bytes of values, and rows, that a worker has in hand at once.
PIECE, MOST_ROWS = 4 << 20, 512


def values_of(c: pa.Array) -> list:
    """c.to_pylist(), for lists of numbers without a value of their own for each."""
    if c.null_count == 0 and pa.types.is_list(c.type):
        inner, at = values_of(c.flatten()), (c.offsets.to_numpy() - c.offsets[0].as_py()).tolist()
        return [inner[a:b] for a, b in zip(at, at[1:])]
    if c.null_count == 0 and pa.types.is_integer(c.type):
        return c.to_numpy().tolist()
    return c.to_pylist()


def in_pieces(batches: Iterator[tuple], run: Callable[..., list], back: pa.DataType) -> Iterator[pa.Array]:
    """What `run` makes of lists of values, piece by piece; a piece is as large as the rows of the one before allow."""
    rows = 16
    for batch in batches:
        at = 0
        while at < len(batch[0]):
            part = [c.slice(at, rows) for c in batch]
            out = pa.array(run(*[values_of(c) for c in part]), back)
            n, size = len(out), out.nbytes + sum(c.nbytes for c in part)
            yield out
            at += n
            rows = max(1, min(MOST_ROWS, 2 * rows, PIECE * n // max(size, 1)))


def arrow_of(run: Callable[..., list], kind: T.DataType, n: int) -> Callable[..., Column]:
    """A UDF of n columns: `run` gets a list of values for each of them and gives a list."""
    back = to_arrow_type(kind)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_pieces(((b,) for b in batches), run, back)

    def more(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from in_pieces(batches, run, back)

    f = one if n == 1 else more
    f.__annotations__ = {"batches": Iterator[pa.Array] if n == 1 else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(f, kind)


def per_row(kind: T.DataType, f: Callable, read: Callable = mask_of) -> Callable[..., Column]:
    """A UDF over (data, width, ...): f gets the picture and the other values of the row; no picture gives null."""
    names = kind.names if isinstance(kind, T.StructType) else None

    def one(data, width, *more):
        r = None if data is None or width is None else f(read(data, int(width)), *more)
        return r if r is None or names is None else dict(zip(names, r))

    return lambda *columns: arrow_of(lambda *c: [one(*v) for v in zip(*c)], kind, len(columns))(*columns)


def pandas_of(run: Callable, kind: T.DataType, n: int):
    """pandas_udf of a function of n columns; the hints it goes by are written out."""
    names = ", ".join(f"a{i}: pd.Series" for i in range(n))
    space = {"pd": pd, "run": run}
    back = "pd.DataFrame" if isinstance(kind, T.StructType) else "pd.Series"
    exec(f"def f({names}) -> {back}:\n    return run({', '.join(f'a{i}' for i in range(n))})", space)
    return F.pandas_udf(space["f"], kind)


def picture(img: np.ndarray) -> tuple[bytes, int, int]:
    return np.ascontiguousarray(img, np.uint8).tobytes(), img.shape[1], img.shape[0]


def named(names: list[str], rows: list[tuple]) -> list[dict]:
    return [dict(zip(names, r)) for r in rows]


# Making pictures -----------------------------------------------------------------------------------------------------


def paint(width: int, height: int, rects: list | None, background: list | None = None) -> bytes:
    """Rectangles (x0, y0, x1, y1 exclusive, and a colour where there is a background), one over the other."""
    if background is None:
        img = np.zeros((height, width), np.uint8)
        for x0, y0, x1, y1, *_ in rects or ():
            img[y0:y1, x0:x1] = 1
    else:
        img = np.frombuffer(bytearray(bytes(background) * (width * height)), np.uint8).reshape(height, width, 3)
        for r in rects or ():
            img[r[1] : r[3], r[0] : r[2]] = r[4:7]
    return img.tobytes()


def painted(width: Column, height: Column, rects: Column, background: Column | None = None) -> Column:
    columns = [width, height, rects] + ([] if background is None else [background])
    return arrow_of(lambda *c: [paint(*v) for v in zip(*c)], T.BinaryType(), len(columns))(*columns)


def written(text: Column, font: dict[str, list[str]], scale: int = 3, gap: int = 1) -> Column:
    """(data, width, height) of a line of text in a font of dots."""
    return arrow_of(lambda c: [dict(zip(PICTURE.names, picture(line_of(t, font, scale, gap)))) if t else dict.fromkeys(PICTURE.names) for t in c], PICTURE, 1)(text)


def line_of(text: str, font: dict[str, list[str]], scale: int, gap: int = 1) -> np.ndarray:
    dots = []
    for c in text:
        sign = np.array([[x == "#" for x in row] for row in font[c]])
        dots += [sign, np.zeros((len(sign), gap), bool)]
    return np.hstack(dots).repeat(scale, 0).repeat(scale, 1)


# Measuring them ------------------------------------------------------------------------------------------------------


def areas(data: Column, width: Column, eight: bool = False) -> Column:
    """Connected areas of a mask."""
    return per_row(T.ArrayType(AREA), lambda m: named(AREA.names, K.components(m, eight)))(data, width)


def slots(data: Column, width: Column) -> Column:
    """Columns of a row of a callout: picture above, text below (`regions.slots`)."""
    return per_row(R.SLOT, lambda m: named(["x0", "x1", "top", "split", "bottom"], R.slots(m)))(data, width)


CROP = T.StructType([T.StructField("slot", INT), *RECT.fields, *PICTURE.fields])


def icons(df: DataFrame, data: str, width: str, least: int = 4) -> DataFrame:
    """One row for each slot of each box, with its picture cut to what is drawn and a rim; those below `least` pixels on a side go. df has a mask for each box."""
    def cut(mask: np.ndarray) -> list[dict]:
        out = []
        for k, (x0, x1, top, split, _) in enumerate(R.slots(mask)):
            part = mask[top:split, x0:x1]
            a, b, c, d = K.cropped(part)
            if c - a + 1 >= least and d - b + 1 >= least:
                out.append(dict(zip(CROP.names, (k, x0 + a, top + b, x0 + c, top + d, *picture(part[b : d + 1, a : c + 1])))))
        return out

    crops = per_row(T.ArrayType(CROP), cut)(F.col(data), F.col(width))
    return df.withColumn("__crop", F.explode(crops)).select(*[c for c in df.columns if c not in (data, width)], "__crop.*")


def fitted(data: Column, width: Column) -> Column:
    """The frame of a glyph, one byte a bit."""
    return per_row(T.BinaryType(), lambda m: K.fit_glyph(m.astype(np.uint8)).tobytes())(data, width)


def opened(data: Column, width: Column, size: int) -> Column:
    """The mask without what a square of that size does not fit in."""
    return per_row(T.BinaryType(), lambda m: K.opening(m, size).astype(np.uint8).tobytes())(data, width)


READ = T.StructType([T.StructField("qty", LONG), T.StructField("unsure", T.BooleanType())])


def quantity(data: Column, width: Column, templates: list[tuple[str, np.ndarray]]) -> Column:
    """(qty, unsure) of a text mask; templates are some dozens of frames, learned ones first."""
    return per_row(READ, lambda m: R.read_quantity(m, templates))(data, width)


def band_has_digit(data: Column, width: Column, templates: list[tuple[str, np.ndarray]]) -> Column:
    return per_row(T.BooleanType(), lambda m: R.has_digit(m, templates))(data, width)


def flatness(data: Column, width: Column) -> Column:
    """(sampled, around): how many pixels are flat by four samples and off the page's colour, and by their neighbourhood."""
    return per_row(struct(LONG, "sampled", "around"), lambda i: (int(K.flat_pixels(i).sum()), int(K.flat_areas(i).sum())), image_of)(data, width)


def candidates(data: Column, width: Column, k: float = 1.0) -> Column:
    """Rectangles that may be callouts."""
    return per_row(T.ArrayType(RECT), lambda i: named(RECT.names, K.candidate_rects(i, k)), image_of)(data, width)


def crop_box(data: Column, width: Column, background: Column, threshold: float = 35) -> Column:
    """Bounds of what is drawn, with a rim."""
    return per_row(RECT, lambda i, b: K.cropped(np.abs(i.astype(int) - np.array([*b])).max(2) > threshold), image_of)(data, width, background)


def thumbnail(data: Column, width: Column, most: int = 110) -> Column:
    """A picture that is no larger than `most` on its longer side."""
    def small(img: np.ndarray) -> tuple:
        k = min(1.0, most / max(img.shape[:2]))
        return picture(K.resized(img, *(max(1, int(np.floor(x * k + 0.5))) for x in (img.shape[1], img.shape[0]))))

    return per_row(PICTURE, small, image_of)(data, width)


SIGNATURE = T.StructType([T.StructField("colour", T.ArrayType(DOUBLE)), T.StructField("aspect", DOUBLE), T.StructField("grid", T.BinaryType()), T.StructField("filled", T.BinaryType())])


def signature(data: Column, width: Column, background: Column, size: int = 14, margin: int = 2, threshold: float = 35) -> Column:
    """Colour of the fullest bin of what is drawn (the background where nothing is), log aspect, and a small picture with the cells that are filled."""
    def sign(img: np.ndarray, back) -> tuple:
        back = np.array([*back])
        ink = np.abs(img.astype(int) - back).max(2) > threshold
        h, w = ink.shape
        k = min((size - 2 * margin) / w, (size - 2 * margin) / h)
        nw, nh = max(1, int(np.floor(w * k + 0.5))), max(1, int(np.floor(h * k + 0.5)))
        grid = np.tile(back.astype(np.uint8), (size, size, 1))
        x, y = (size - nw) // 2, (size - nh) // 2
        grid[y : y + nh, x : x + nw] = K.resized(img, nw, nh)
        filled = np.abs(grid.astype(int) - back).max(2) > threshold
        colour = K.modal_colour(img[ink]) if ink.any() else back.astype(float)
        return colour.tolist(), float(np.log(w / h)), grid.tobytes(), filled.astype(np.uint8).tobytes()

    return per_row(SIGNATURE, sign, image_of)(data, width, background)


def embedding(data: Column, width: Column, layers: list, head: tuple, size: int = 48) -> Column:
    """Unit vector of a picture, stretched to a square; the weights (some 70 KB) travel with the function."""
    def run(img: np.ndarray) -> list[float]:
        return R.embed(K.resized(img, size, size), float(np.log(img.shape[1] / img.shape[0])), layers, head).tolist()

    return per_row(T.ArrayType(DOUBLE), run, image_of)(data, width)


def lattice(data: Column, width: Column) -> Column:
    """(first, second, score): side lengths of the best square-like lattice of a mask's repeats; null where there is none."""
    def find(mask: np.ndarray) -> tuple | None:
        r = K.autocorrelation(K.detail(mask))
        best = K.best_lattice(r, K.peaks(r, 4))
        return None if best is None else (*sorted(float(np.hypot(*v)) for v in best[:2]), best[2])

    return per_row(struct(DOUBLE, "first", "second", "score"), find)(data, width)


def support(data: Column, width: Column, dx: Column, dy: Column) -> Column:
    """How a mask's detail resembles itself moved by whole pixels."""
    return per_row(DOUBLE, lambda m, x, y: K.overlap_support(K.detail(m), int(x), int(y)))(data, width, dx, dy)


def sampled(data: Column, width: Column, x: Column, y: Column) -> Column:
    """Bilinear value of one channel (one byte a pixel)."""
    return per_row(DOUBLE, lambda m, a, b: K.sample(m, a, b), lambda d, w: np.frombuffer(d, np.uint8).reshape(-1, w).astype(float))(data, width, x, y)


def tips(data: Column, width: Column) -> Column:
    """(x0, y0, x1, y1): the leftmost and the rightmost pixel; null for masks that are too small."""
    def find(mask: np.ndarray) -> tuple | None:
        c = K.corners(mask)
        return None if c is None else (*c[0], *c[1])

    return per_row(RECT, find)(data, width)


def pitch(data: Column, width: Column) -> Column:
    """(periods, strength) of the strongest repeat across a mask."""
    return per_row(struct(DOUBLE, "periods", "strength"), lambda m: K.pitch_feature(m.astype(float)))(data, width)


def weight_sizes(blob: Column, layers: list[tuple[int, int]], head: tuple[int, int]) -> Column:
    """Sums of the slices of a weight blob, in its order."""
    def run(c: pd.Series) -> pd.Series:
        out = []
        for b in c:
            convs, dense = R.slice_weights(b, layers, head)
            out.append([float(x.sum()) for pair in (*convs, dense) for x in pair])
        return pd.Series(out, dtype=object)

    return pandas_of(run, T.ArrayType(DOUBLE), 1)(blob)
