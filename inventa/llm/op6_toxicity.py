"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct hashed word unigrams, bigrams and skip-grams (one and two words between), words in
lower case with ASCII signs taken off. They are made on the executors; what is gathered for training are the hashed
features of a bounded sample of labelled rows: the first in the order of a hash of the id, of both classes in the
proportion they have, as long as they are no more than TRAIN_ROWS rows and TRAIN_FEATURES features together. FTRL keeps per-coordinate rates; its L1 term leaves few weights other than zero,
and those go back to the executors as two short arrays. Labels, language, source and id are no features.

Defined results: a null or empty text has no features and gets the score of the bias. A label that is null is no
label; of an id with several labels each row counts. With no labelled rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inventa.llm.common import keep, parallel, prepare, table, tidy
from inventa.llm.textscan import M3, U, mix, pieces, span_hash, spans, utf8

BITS, SKIPS = 22, 2
TRAIN_ROWS, TRAIN_FEATURES, EPOCHS, LEAST_ROWS = 16_000, 24_000_000, 8, 3
ALPHA_RATE, BETA, L1, L2 = 1.0, 1.0, 10.0, 1.0
PIECE_BYTES = 1 << 20
#: ASCII signs end a word, letters are made small; bytes of other letters stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BREAK = np.array([b < 0x80 and not (48 <= b < 58 or 97 <= b < 123 or 65 <= b < 91) for b in range(256)])


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS, skips: int = SKIPS, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all rows, row after row, and where each row starts (one entry more than rows).
    wanted: for each number whether it is of interest; the others are left out before anything is sorted."""
    folded = FOLD[data]
    starts, ends, first = spans(folded, off, BREAK)
    h, n = span_hash(folded, starts, ends, 6), len(starts)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(first))
    keys = []
    for gap in range(skips + 2):
        if n <= gap:
            break
        f = (h if gap == 0 else mix(h[:-gap] * M3 + h[gap:] + U(gap))) >> U(64 - bits)
        ok = row[gap:] == row[: n - gap]
        if wanted is not None:
            ok &= wanted[f.view(np.int64)]
        at = np.flatnonzero(ok)
        keys.append(f[at] | (row[at].astype(U) << U(bits)))
    k = np.unique(np.concatenate(keys)) if keys else np.zeros(0, U)
    return (k & U((1 << bits) - 1)).astype(np.uint32), np.searchsorted(k >> U(bits), np.arange(len(off)).astype(U))


def featurise(docs: DataFrame, text_col: str, out_col: str = "features", bits: int = BITS, skips: int = SKIPS) -> DataFrame:
    """All columns but the text, and the features of each row as little-endian unsigned 32-bit integers."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text_col, out_col)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(text_col))
            for i, j in pieces(off, PIECE_BYTES):
                f, at = features(data[off[i] : off[j]], off[i : j + 1] - off[i], bits, skips)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array([f[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=schema.names)

    return docs.select(*kept, text_col).mapInArrow(run, schema)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last coordinate is the bias, which has no L1."""

    def __init__(self, size: int, rate: float = ALPHA_RATE, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1, np.float32), np.zeros(size + 1, np.float32)
        self.rate, self.beta, self.l2 = rate, beta, l2
        self.l1 = l1

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, l1 = self.z[i], np.where(i == len(self.z) - 1, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[i])) / self.rate + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, i: np.ndarray, y: float) -> None:
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[i]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate
        self.z[i] += g - sigma * w
        self.n[i] = n + g * g


def train(examples: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 11, **rates: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and values of the weights that are not zero, and the bias. Features that fewer than LEAST_ROWS examples have are left out."""
    model, bias = Ftrl(1 << bits, **rates), np.array([1 << bits])
    times = np.zeros(1 << bits, np.int32)
    for f, _ in examples:
        times[f] += 1
    for k, (f, y) in enumerate(examples):  # in place: the driver holds one copy
        examples[k] = f[times[f] >= LEAST_ROWS], y
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            f, y = examples[k]
            model.learn(np.append(f.astype(np.int64), bias), y)
    every = np.flatnonzero(np.abs(model.z[:-1]) > model.l1)
    return every.astype(np.uint32), model.weights(every), float(model.weights(bias)[0])


def gather(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, rows: int = TRAIN_ROWS) -> list[tuple[np.ndarray, int]]:
    """Features of at most `rows` labelled documents, those of smallest hash; the labelled ids alone are ranked, and only the chosen ones meet the texts."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    total = known.count()
    if total == 0:
        return []
    chosen = known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(rows)
    texts = docs.select(F.col(id_col).alias("__id"), "text").join(F.broadcast(chosen), "__id")  # `rows` ids at most
    few = keep(featurise(texts, "text"), "features").select("__id", "__y", "features", F.xxhash64("__id").alias("h"), F.xxhash64("features").alias("f"), (F.octet_length("features") / 4).cast("int").alias("n"))
    room, taken = TRAIN_FEATURES, set()
    for r in few.select("h", "__id", "__y", "f", "n").orderBy("h", "__id", "__y", "f").limit(2 * rows).toLocalIterator():
        room -= r.n
        if room < 0 or len(taken) == rows:
            break
        taken.add((r["__id"], r["__y"], r.f))
    out = [(r["__id"], r["__y"], np.frombuffer(bytes(r.features), np.uint32)) for r in few.select("__id", "__y", "f", "features").toLocalIterator() if (r["__id"], r["__y"], r.f) in taken]
    out.sort(key=lambda x: (x[0], x[1], x[2].tobytes()))
    for k, (_, y, f) in enumerate(out):
        out[k] = f, y
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    examples = gather(docs, labels, id_col, label_col, rows)
    model = train(examples) if examples else (np.zeros(0, np.uint32), np.zeros(0), -40.0)
    del examples
    tidy()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", out_col: str = "score", bits: int = BITS, skips: int = SKIPS) -> DataFrame:
    """All columns of `docs`, then `out_col` in 0..1."""
    spark = prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c != out_col]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out_col, T.DoubleType())])
    shipped = spark.sparkContext.broadcast(model)  # as many weights as L1 leaves, 2 ** bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, values, bias = shipped.value
        w = np.zeros(1 << bits, np.float32)
        w[numbers] = values
        wanted = w != 0
        for batch in batches:
            data, off = utf8(batch.column(text_col))
            for i, j in pieces(off, PIECE_BYTES):
                f, at = features(data[off[i] : off[j]], off[i : j + 1] - off[i], bits, skips, wanted)
                total = np.concatenate([[0.0], np.cumsum(w[f], dtype=np.float64)])
                s = 1 / (1 + np.exp(-np.clip(total[at[1:]] - total[at[:-1]] + bias, -35, 35)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(np.round(s, 9))], names=schema.names)
        tidy()

    return docs.select(*kept).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parallel(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
