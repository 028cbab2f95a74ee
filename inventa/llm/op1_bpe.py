"""Byte-level BPE encoding and decoding.

Texts are cut into pre-tokens by `pretokens` (class arrays and an associative scan, no regular expression); each
distinct slice is merged once per worker and kept in a bounded cache; the byte offset of every token is kept, so any
range of tokens can be decoded on its own and a decoder can place all bytes at once.

Defined results: a null or empty text has no tokens; all its digests are those of the empty string. Ids are
independent of how rows are batched. Rows are never joined, so repeated ids or texts are separate results.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inventa.llm.common import parallel, prepare, table, tidy
from inventa.llm.pretokens import class_table, pretokens, sections
from inventa.llm.textscan import M1, M3, MASKS, U, mix, pieces, utf8

#: Text that is scanned at once, and slices that a worker keeps: both bound its memory.
PIECE_BYTES, CACHE_SLICES, CACHE_SLICE_BYTES = 1 << 20, 300_000, 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library itself decides it: it is asked once for each class."""
    import tiktoken

    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}

    def ask(pattern: str) -> np.ndarray:
        found = bytes(tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text))
        return np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)

    return class_table(ask(r"\p{L}"), ask(r"\p{N}"), ask(r"\s"))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until no pair is in the vocabulary: a heap over a linked list, n log n."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n < 200:
        get, none = ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(n)]
        rank = [get(piece[i : i + 2], none) for i in range(n - 1)]
        while rank and (low := min(rank)) < none:
            i = rank.index(low)
            parts[i] += parts.pop(i + 1)
            del rank[i]
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]
    end, prev, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or not alive[j] or end[j] != stop:
            continue
        end[i], alive[j] = stop, False
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def alike(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each slice's kind, one slice of each kind). Slices of up to 16 bytes are of one kind if their bytes, read
    as two integers, and their lengths are equal; hashes only sort them. Each longer slice is a kind of its own."""
    start, n = cut[:-1], np.diff(cut)
    lanes = np.ndarray((len(data) + 9,), "<u8", buffer=np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
    a = lanes[start] & MASKS[np.minimum(n, 8)]
    b = lanes[np.minimum(start + 8, len(data))] & MASKS[np.clip(n - 8, 0, 8)]
    order = np.argsort(mix(a * M3 ^ mix(b + M1) ^ n.astype(U)), kind="stable")
    x, y, k = a[order], b[order], n[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (k[1:] != k[:-1]) | (k[1:] > 16)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return which, order[new]


class Encoder:
    """One per worker process: ranks, token lengths and the cache of merged slices. table: the class of each code point."""

    def __init__(self, path: str, table: np.ndarray | None = None):
        self.ranks, self.table = load_ranks(path), classes() if table is None else table
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.begins = np.cumsum(self.lengths) - self.lengths
        # Two generations: when the younger one is full, it takes the place of the older one, so frequent slices stay.
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def slice_ids(self, piece: bytes) -> bytes:
        ids = self.older.get(piece) or np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= CACHE_SLICE_BYTES:
            if len(self.cache) >= CACHE_SLICES:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = ids
        return ids

    def encode(self, data: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
        """Ids of each row as little-endian unsigned 32-bit integers. Slices of one piece of text that are equal are looked up once."""
        cut, first = pretokens(data, off, self.table)
        raw, get = data.tobytes(), self.cache.get
        which, kinds = alike(data, cut)
        found = [get(x) or self.slice_ids(x) for x in [raw[s:e] for s, e in zip(cut[kinds].tolist(), cut[kinds + 1].tolist())]]
        size = np.array([len(x) for x in found], np.int64) // 4
        begin, n = np.cumsum(size) - size, size[which] if len(found) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(begin[which] - upto[:-1], n) + np.arange(upto[-1])] if len(found) else np.zeros(0, "<u4")
        for a, b in zip(upto[first[:-1]].tolist(), upto[first[1:]].tolist()):
            yield ids[a:b].tobytes()

    def encode_long(self, data: np.ndarray, limit: int = PIECE_BYTES) -> bytes:
        """Ids of one long text, section by section."""
        return b"".join(x for part in sections(data, limit) for x in self.encode(part, np.array([0, len(part)])))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each token starts."""
        n = self.lengths[ids]
        return np.cumsum(n) - n

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of tokens: each byte is gathered from the flat vocabulary by the offset at which its token starts."""
        if len(ids) == 0:
            return b""
        n = self.lengths[ids]
        shift = np.repeat(self.begins[ids] - (offsets.astype(np.int64) - int(offsets[0])), n)
        return self.flat[shift + np.arange(len(shift))].tobytes()


#: Encoders of this worker by file; one that is used again keeps its cache.
WORKER: dict[str, Encoder] = {}


def encoder(path: str, table: bytes) -> Encoder:
    if path not in WORKER:
        WORKER.clear()
        WORKER[path] = Encoder(path, np.frombuffer(zlib.decompress(table), np.uint8))
    return WORKER[path]


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """All columns of `df`, then `ids_col` and `offsets_col`: ids and starting bytes of the tokens, both little-endian
    unsigned 32-bit integers in a binary column. Columns of `df` with these two names are replaced."""
    shipped = prepare(df.sparkSession).sparkContext.broadcast(zlib.compress(classes().tobytes()))  # some KB: the library is asked once, here
    kept = [c for c in df.columns if c not in (ids_col, offsets_col)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids_col, T.BinaryType()), T.StructField(offsets_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, shipped.value)
        for batch in batches:
            data, off = utf8(batch.column(text_col))
            for i, j in pieces(off, PIECE_BYTES):
                ids = [*enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])] if off[j] - off[i] <= 2 * PIECE_BYTES else [enc.encode_long(data[off[i] : off[j]])]
                starts = [enc.offsets(np.frombuffer(x, "<u4")).astype("<u4").tobytes() for x in ids]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(ids, pa.binary()), pa.array(starts, pa.binary())], names=schema.names)
        tidy()

    return df.select(*kept).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", offsets_col: str = "offsets", out_col: str = "decoded") -> DataFrame:
    """All columns of `df` but the offsets, and `out_col`: the bytes of the tokens. The ids may be any range of tokens of
    a text, with the offsets of that range. Null ids give null."""
    shipped = prepare(df.sparkSession).sparkContext.broadcast(zlib.compress(classes().tobytes()))
    kept = [c for c in df.columns if c not in (out_col, offsets_col)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, shipped.value)
        for batch in batches:
            ids, starts = batch.column(ids_col), batch.column(offsets_col)
            out = [None if a.as_py() is None else enc.decode(np.frombuffer(a.as_py(), "<u4"), np.frombuffer(b.as_py(), "<u4")) for a, b in zip(ids, starts)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, pa.binary())], names=schema.names)
        tidy()

    return df.mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    docs = parallel(table(spark, sf_dir, "documents").select("doc_id", "text"))
    coded = decode(encode(docs, path).drop("text"), path)
    return coded.select(
        F.col("doc_id").cast("long"),
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
