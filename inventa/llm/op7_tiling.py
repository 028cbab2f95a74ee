"""Benchmark decontamination by greedy string tiling.

Items of a benchmark are indexed by Karp-Rabin hashes of SEED words (lower case, without ASCII signs). A document is
scanned once: its rolling hashes meet the index, but only where the words before differ, so that each diagonal gives
one hit for each maximal match and a run of one word meets another in as many hits as both have words, not as their
product. How far a match goes is found by bisection over Karp-Rabin hashes of prefixes. For each item the longest match
of words not yet taken is marked as a tile, again and again, until none of SEED words is left; what a tile has taken
shortens the matches that overlap it, and the remainders compete again. A document is contaminated by an item if its
tiles cover at least `threshold` of the item's words, so a passage whose sentences were moved about is found as well.
Items whose matches cannot cover that much are passed over before tiling.

The benchmark goes to the executors in blocks of at most BLOCK_BYTES of text, which is checked (an item that is larger
is a block of its own); a larger one is a few scans of the documents, so nothing broadcast grows with it.

Defined results: null or empty texts and items match nothing; neither do items of fewer than SEED words. Repeated
items and documents give a row each.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm.common import parallel, prepare, table
from inventa.llm.op6_toxicity import BREAK, FOLD
from inventa.llm.textscan import M3, U, gram_hash, inside, pieces, span_hash, spans, utf8

SEED, THRESHOLD, BLOCK_BYTES, PIECE_BYTES = 4, 0.5, 16 << 20, 2 << 20
TILES = "item_id long, n_item_words long, n_tiled long, coverage double, tiles array<struct<doc_word:int,item_word:int,n_words:int>>"


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    folded = FOLD[data]
    starts, ends, first = spans(folded, off, BREAK)
    return span_hash(folded, starts, ends, 7), first


class Prefixes:
    """Karp-Rabin hashes of all ranges of a list of word hashes."""

    INVERSE = U(pow(int(M3), -1, 1 << 64))

    def __init__(self, h: np.ndarray):
        power = np.cumprod(np.concatenate([np.ones(1, U), np.full(len(h), M3, U)]), dtype=U)
        self.back = np.cumprod(np.concatenate([np.ones(1, U), np.full(len(h), self.INVERSE, U)]), dtype=U)
        self.sum = np.concatenate([np.zeros(1, U), np.cumsum(h * power[:-1], dtype=U)])

    def hash(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sum[start + n] - self.sum[start]) * self.back[start]


def before(h: np.ndarray, first: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """The word before each place, `none` at the start of a row."""
    row = np.searchsorted(first, at, "right") - 1
    return np.where(at > first[row], h[np.maximum(at - 1, 0)], U(none))


class Index:
    """Seeds of the items of a block: sorted by hash and by the word before, and the place in the items of each."""

    def __init__(self, ids: list, texts: list[str | None], seed: int):
        self.ids, self.seed = ids, seed
        h, self.first = word_hashes(*utf8(pa.array(texts, pa.string())))
        self.prefixes = Prefixes(h)
        at = np.flatnonzero(inside(self.first, len(h), seed))
        key, prev = (gram_hash(h, seed)[at], before(h, self.first, at, 0)) if len(at) else (np.zeros(0, U), np.zeros(0, U))
        order = np.lexsort((prev, key))
        self.keys, self.at = key[order], at[order]
        self.item = np.searchsorted(self.first, self.at, "right") - 1
        self.size = np.diff(self.first)
        # Entries of one key and one word before are neighbours; both are numbered, so that a pair is one number.
        self.known, rank = np.unique(self.keys, return_inverse=True)
        self.words, word = np.unique(prev[order], return_inverse=True)
        self.code = rank * max(len(self.words), 1) + word

    def starts(self, key: np.ndarray, prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of key, entry of the index) of all pairs with equal seeds and other words before."""
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        word = np.minimum(np.searchsorted(self.words, prev), len(self.words) - 1)
        code = np.searchsorted(self.known, key) * len(self.words) + word
        same = self.words[word] == prev
        a = np.where(same, np.searchsorted(self.code, code), low)
        b = np.where(same, np.searchsorted(self.code, code, "right"), low)
        begin, n = np.stack([low, b], 1).ravel(), np.stack([a - low, high - b], 1).ravel()
        q = np.repeat(np.repeat(np.arange(len(key)), 2), n)
        return q, np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def tile(matches: list[tuple[int, int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling over maximal matches (doc word, item word, length): the longest first, earlier ones before later ones of that length."""
    heap = [(-n, p, q) for q, p, n in matches]
    heapq.heapify(heap)
    doc, item = np.zeros(max(q + n for q, _, n in matches), bool), np.zeros(max(p + n for _, p, n in matches), bool)
    left, out = len(item), []
    while heap and left >= seed:
        n, p, q = heapq.heappop(heap)
        n = -n
        taken = doc[q : q + n] | item[p : p + n]
        if not taken.any():
            out.append((q, p, n))
            doc[q : q + n] = item[p : p + n] = True
            left -= n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]))).tolist()  # starts and ends of what is free
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= seed:
                heapq.heappush(heap, (a - b, p + a, q + a))
    return sorted(out)


def match_rows(data: np.ndarray, off: np.ndarray, index: Index, threshold: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(row, item, tiles) of each pair that reaches the threshold."""
    h, first = word_hashes(data, off)
    at = np.flatnonzero(inside(first, len(h), index.seed))
    if not len(at) or not len(index.keys):
        return
    key = gram_hash(h, index.seed)[at]
    place = np.minimum(np.searchsorted(index.keys, key), len(index.keys) - 1)
    live = np.flatnonzero(index.keys[place] == key)
    if not len(live):
        return
    q, e = index.starts(key[live], before(h, first, at[live], 1))
    word, p, item = at[live][q], index.at[e], index.item[e]
    row = np.searchsorted(first, word, "right") - 1
    own = Prefixes(h)
    length, most = np.full(len(word), index.seed), np.minimum(first[row + 1] - word, index.first[item + 1] - p)
    while (open_ := np.flatnonzero(length < most)).size:
        n = (length[open_] + most[open_] + 1) // 2
        alike = own.hash(word[open_], n) == index.prefixes.hash(p[open_], n)
        length[open_] = np.where(alike, n, length[open_])
        most[open_] = np.where(alike, most[open_], n - 1)
    order = np.lexsort((item, row))
    word, p, item, row, length = word[order], p[order], item[order], row[order], length[order]
    pair = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]))
    enough = np.add.reduceat(length, pair) >= threshold * index.size[item[pair]]
    for a, b in zip(pair[enough], np.append(pair[1:], len(word))[enough]):
        need, base, start = threshold * index.size[item[a]], first[row[a]], index.first[item[a]]
        edges = np.zeros(index.size[item[a]] + 1, np.int64)
        np.add.at(edges, p[a:b] - start, 1)
        np.subtract.at(edges, p[a:b] - start + length[a:b], 1)
        if np.count_nonzero(np.cumsum(edges)) < need:  # words that any match covers
            continue
        tiles = tile([*zip((word[a:b] - base).tolist(), (p[a:b] - start).tolist(), length[a:b].tolist())], index.seed)
        if sum(t[2] for t in tiles) >= need:
            yield int(row[a]), int(item[a]), tiles


def tilings(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, item_id, n_item_words, n_tiled, coverage, tiles) of each document and item that reach the threshold; tiles count words from 0."""
    spark = prepare(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("length(text) > 0")
    items = items.groupBy("item_id", "text").agg(F.count("*").alias("times"))  # a row that repeats is sent once
    size = F.sum(F.octet_length("text")).alias("size")
    blocks = max(1, math.ceil((items.agg(size).head()[0] or 0) / BLOCK_BYTES))
    block_of = lambda blocks: F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    while blocks > 1 and not items.groupBy(block_of(blocks)).agg(size, F.count("*").alias("n")).where((F.col("size") > BLOCK_BYTES) & (F.col("n") > 1)).isEmpty():
        blocks += max(1, blocks // 2)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {TILES}, times long"

    def scan(block: int) -> DataFrame:
        rows = items.where(block_of(blocks) == block).orderBy("item_id", "text").collect()  # BLOCK_BYTES at most, or one item
        shipped = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows], [r.times for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts, times = shipped.value
            index = Index(ids, texts, seed)
            for batch in batches:
                data, off = utf8(batch.column(1))
                for i, j in pieces(off, PIECE_BYTES):
                    found = [*match_rows(data[off[i] : off[j]], off[i : j + 1] - off[i], index, threshold)]
                    if found:
                        n = [sum(t[2] for t in tiles) for _, _, tiles in found]
                        of = [int(index.size[k]) for _, k, _ in found]
                        spans_ = [[{"doc_word": q, "item_word": p, "n_words": m} for q, p, m in tiles] for _, _, tiles in found]
                        columns = [batch.column(0).take(pa.array([i + r for r, _, _ in found])), pa.array([index.ids[k] for _, k, _ in found], pa.int64()), pa.array(of, pa.int64()), pa.array(n, pa.int64()), pa.array([a / b for a, b in zip(n, of)], pa.float64()), pa.array(spans_, pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())]))), pa.array([times[k] for _, k, _ in found], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=[id_col, "item_id", "n_item_words", "n_tiled", "coverage", "tiles", "times"])

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    found = reduce(DataFrame.unionByName, [scan(b) for b in range(blocks)])
    names = [c for c in found.columns if c != "times"]
    return found.select(*names, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("again")).select(*names)


def op7_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parallel(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    out = tilings(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_item_words", "n_tiled", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))
