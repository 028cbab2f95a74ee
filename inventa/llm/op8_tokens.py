"""Token counts without moving a pre-token: a compact broadcast table first, then a worker's own cache.

Tier one is an open-addressing table of pre-tokens of at most 16 bytes and their token counts, kept as numpy arrays
and looked up for a whole batch at once; both lanes and the length are compared, so it has no false hits. It holds the
most frequent pre-tokens of a bounded sample of rows (SAMPLE_ROWS on average, TABLE_KEYS keys at most), so its size
does not depend on the input, and neither do the counts: what it lacks is encoded by the tokenizer library and
remembered in a bounded cache of the worker.

Defined results: a null or empty text has no tokens. A special token of the vocabulary inside a text counts as one
token and ends the text before it, which is what the library does by default.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inventa.llm.common import parallel, prepare, table
from inventa.llm.op1_bpe import tokenizer_path
from inventa.llm.pretokens import class_table, pretokens, sections
from inventa.llm.textscan import M1, M3, MASKS, U, mix, pieces, utf8

SAMPLE_ROWS, TABLE_KEYS, PROBES = 4000, 60_000, 4
PIECE_BYTES, CACHE_SLICES, CACHE_SLICE_BYTES = 1 << 20, 300_000, 64


@lru_cache(2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def specials(path: str) -> tuple[bytes, ...]:
    return tuple(t.content.encode() for t in library(path).get_added_tokens_decoder().values() if t.special)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library itself decides it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = np.array([*range(0xD800), *range(0xE000, 0x110000)], np.uint32)
    text = points.astype("<u4").tobytes().decode("utf-32-le")

    def ask(pattern: str) -> np.ndarray:
        hit = np.ones(len(points), bool)
        for _, (a, b) in Split(Regex(pattern), "removed").pre_tokenize_str(text):
            hit[a:b] = False
        return points[hit]

    return class_table(ask(r"\p{L}"), ask(r"\p{N}"), ask(r"\s"))


class Table:
    """Open addressing over (first lane, second lane, length); a key that finds no place in PROBES steps is left out."""

    def __init__(self, counts: dict[bytes, int]):
        size = 1 << max(4, (4 * len(counts)).bit_length())
        self.mask = U(size - 1)
        self.a, self.b = np.zeros(size, U), np.zeros(size, U)
        self.n, self.value = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        keys = [k for k, v in counts.items() if 0 < len(k) <= 16 and v < 256]
        if keys:
            a = np.array([int.from_bytes(k[:8], "little") for k in keys], U)
            b = np.array([int.from_bytes(k[8:], "little") for k in keys], U)
            n = np.array([len(k) for k in keys], np.int64)
            for k, i, x, y in zip(keys, self.slot(a, b, n).tolist(), a, b):
                for j in range(PROBES):
                    at = (i + j) & int(self.mask)
                    if not self.n[at]:
                        self.a[at], self.b[at], self.n[at], self.value[at] = x, y, len(k), counts[k]
                        break

    def slot(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix(a * M3 ^ mix(b + M1) ^ n.astype(U)) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Token counts; 0 where the table has no answer."""
        at = self.slot(a, b, n)
        out = np.zeros(len(a), np.int64)
        todo = np.flatnonzero(n <= 16)
        at, a, b, n = at[todo], a[todo], b[todo], n[todo]
        for _ in range(PROBES):
            hit = (self.a[at] == a) & (self.b[at] == b) & (self.n[at] == n)
            out[todo[hit]] = self.value[at[hit]]
            rest = ~hit & (self.n[at] > 0)
            todo, at, a, b, n = todo[rest], (at[rest] + U(1)) & self.mask, a[rest], b[rest], n[rest]
        return out


def segments(data: np.ndarray, off: np.ndarray, marks: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text without special strings: bytes, segment offsets, row of each segment, and special strings in each row."""
    raw, hits = data.tobytes(), []
    for mark in marks:
        at = raw.find(mark)
        while at >= 0:
            hits.append((at, at + len(mark)))
            at = raw.find(mark, at + len(mark))
    found = np.zeros(len(off) - 1, np.int64)
    if not hits:
        return data, off, np.arange(len(off) - 1), found
    edges, keep, stop = [*off.tolist()], np.ones(len(data), bool), 0
    for s, e in sorted(hits, key=lambda x: (x[0], -x[1])):
        row = int(np.searchsorted(off, s, "right")) - 1
        if e > off[row + 1] or s < stop:  # over the end of a row, or inside an earlier one
            continue
        stop = e
        found[row] += 1
        keep[s:e] = False
        edges += [s, e]
    edges = np.sort(np.array(edges))
    moved = np.concatenate([[0], np.cumsum(keep)])[edges]
    row = np.minimum(np.searchsorted(off, edges[:-1], "right") - 1, len(off) - 2)  # an empty segment at the end has no row of its own
    return data[keep], moved, row, found


class Counter8:
    def __init__(self, path: str, known: Table, table: np.ndarray | None = None):
        self.path, self.known, self.cache, self.lib = path, known, {}, library(path)
        self.table = classes() if table is None else table

    def misses(self, slices: list[bytes]) -> None:
        new = [*{s for s in slices if s not in self.cache}]
        if len(self.cache) + len(new) > CACHE_SLICES:
            self.cache.clear()
            new = [*set(slices)]
        for s, e in zip(new, self.lib.encode_batch_fast([s.decode() for s in new], add_special_tokens=False)):
            self.cache[s] = len(e.ids)

    def count(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        text, cuts, row, found = segments(data, off, specials(self.path))
        cut, first = pretokens(text, cuts, self.table)
        start, n = cut[:-1], np.diff(cut)
        lanes = np.ndarray((len(text) + 9,), "<u8", buffer=np.concatenate([text, np.zeros(16, np.uint8)]), strides=(1,))
        a = lanes[start] & MASKS[np.minimum(n, 8)]
        b = lanes[np.minimum(start + 8, len(text))] & MASKS[np.clip(n - 8, 0, 8)]
        got = self.known.find(a, b, n)
        rest = np.flatnonzero(got == 0)
        if len(rest):
            raw = text.tobytes()
            slices = [raw[s:e] for s, e in zip(start[rest].tolist(), cut[1:][rest].tolist())]
            self.misses(slices)
            got[rest] = [self.cache[s] for s in slices]
            for s in slices:
                if len(s) > CACHE_SLICE_BYTES:
                    self.cache.pop(s, None)
        total = np.concatenate([[0], np.cumsum(got)])
        np.add.at(found, row, total[first[1:]] - total[first[:-1]])
        return found

    def count_long(self, data: np.ndarray, limit: int = PIECE_BYTES) -> np.ndarray:
        """Tokens of one long text, section by section; a special string has no space, so none is cut."""
        return sum(self.count(part, np.array([0, len(part)])) for part in sections(data, limit))


#: Counters of this worker, by tokenizer file and table; a worker that is used again keeps its cache.
WORKER: dict[tuple, Counter8] = {}


def counter(path: str, name: str, known: dict[bytes, int], table: bytes) -> Counter8:
    """The worker's counter. Tasks call it by the module's name, so that all of a worker see one WORKER."""
    key = (path, name)
    if key not in WORKER:
        WORKER.clear()
        WORKER[key] = Counter8(path, Table(known), np.frombuffer(zlib.decompress(table), np.uint8))
    return WORKER[key]


def frequent(df: DataFrame, path: str, text_col: str, rows: int = SAMPLE_ROWS, keys: int = TABLE_KEYS, seed: int = 7) -> dict[bytes, int]:
    """Token counts of the most frequent short pre-tokens of about `rows` sampled rows; `keys` at most."""
    total = df.count()
    share = min(1.0, rows / max(total, 1))
    schema = "piece binary, times long"
    shipped = df.sparkSession.sparkContext.broadcast(zlib.compress(classes().tobytes()))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of = np.frombuffer(zlib.decompress(shipped.value), np.uint8)
        for batch in batches:
            data, off = utf8(batch.column(0))
            seen: Counter = Counter()
            for i, j in pieces(off, PIECE_BYTES):
                text, cuts, _, _ = segments(data[off[i] : off[j]], off[i : j + 1] - off[i], specials(path))
                cut = pretokens(text, cuts, class_of)[0].tolist()
                raw = text.tobytes()
                seen.update(raw[s:e] for s, e in zip(cut, cut[1:]) if e - s <= 16)
            yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.binary()), pa.array([*seen.values()], pa.int64())], names=["piece", "times"])

    sample = df.select(text_col) if share == 1 else df.select(text_col).sample(share, seed)
    top = sample.mapInArrow(tally, schema).groupBy("piece").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "piece").limit(keys).select("piece").collect()
    found = [bytes(r.piece) for r in top]
    lib = library(path)
    return {k: len(e.ids) for k, e in zip(found, lib.encode_batch_fast([k.decode() for k in found], add_special_tokens=False))}


def count_tokens(df: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """All columns of `df`, then `out_col`. Only tokenizers .json files of the byte-level kind are taken."""
    if not path.endswith(".json"):
        raise ValueError("a tokenizers .json file is asked for")
    spark = prepare(df.sparkSession)
    kept = [c for c in df.columns if c != out_col]
    shipped = spark.sparkContext.broadcast((uuid.uuid4().hex, frequent(df, path, text_col), zlib.compress(classes().tobytes())))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, *shipped.value)
        for batch in batches:
            data, off = utf8(batch.column(text_col))
            n = [own.count(data[off[i] : off[j]], off[i : j + 1] - off[i]) if off[j] - off[i] <= 2 * PIECE_BYTES else own.count_long(data[off[i] : off[j]]) for i, j in pieces(off, PIECE_BYTES)]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(n, pa.int64())], names=schema.names)

    return df.select(*kept).mapInArrow(run, schema)


def op8_tokens(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    docs = parallel(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    counted = count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    return counted.select(F.col("doc_id").cast("long"), F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
