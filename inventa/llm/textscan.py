"""Vectorised views of UTF-8 text in Arrow buffers: words, lines, hashes, sorted hash lists as compact blobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], U)
M1, M2, M3 = U(0xD6E8FEB86659FD93), U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and where each row starts (one entry more than rows); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes, one row at least; a row is never split."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * M1
    h ^= h >> U(32)
    h *= M1
    h ^= h >> U(32)
    return h


def spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes), and the first word of each row (one entry more than rows)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~space[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    close = solid.copy()
    close[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < n)]
    begin[edge] = solid[edge]
    close[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    rem = (ends - starts).astype(np.int64)
    h = mix(rem.astype(U) * M2 + U(seed & 0xFFFFFFFFFFFFFFFF))
    if len(rem) == 0:
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    live, pos = np.flatnonzero(rem > 0), starts
    first = True
    while len(live):
        r = rem[live] if not first or len(live) < len(rem) else rem
        p = pos[live] if not first or len(live) < len(rem) else pos
        lane = lanes[p] & MASKS[np.minimum(r, 8)]
        h[live] = mix((h[live] ^ lane) * M3 + M2)
        if first:
            pos, rem, first = pos.copy(), rem.copy(), False
        pos[live] += 8
        rem[live] -= 8
        live = live[r > 8]
    return h


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive entries, at every start that has k entries; rows are not looked at."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    acc = h[:n].copy()
    for i in range(1, k):
        acc *= M3
        acc += h[i : i + n]
    return mix(acc + U(k * int(M2) & 0xFFFFFFFFFFFFFFFF))


def inside(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """For the starts of gram_hash: whether all k words are of one row."""
    m = n - k + 1
    if m <= 0:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))[:m]
    return np.arange(k, m + k) <= last


def cover(marks: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n places are covered by marked windows of length k."""
    d = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(marks)
    d[at] += 1
    np.subtract.at(d, np.minimum(at + k, n), 1)
    return np.cumsum(d[:-1]) > 0


def squeeze(plane: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(plane.tobytes())


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned values as planes of bytes of their differences; only the highest plane is worth compressing."""
    n = len(values)
    if not n:
        return b""
    d = values.astype(U).copy()
    d[1:] -= values[:-1].astype(U)
    wide = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(n, 8)[:, :wide].T)
    top = squeeze(planes[-1])
    return bytes([wide]) + len(top).to_bytes(4, "little") + top + planes[:-1].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    wide, size = blob[0], int.from_bytes(blob[1:5], "little")
    top = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[5 : 5 + size]), np.uint8)
    out = np.zeros((len(top), 8), np.uint8)
    out[:, wide - 1] = top
    if wide > 1:
        out[:, : wide - 1] = np.frombuffer(blob, np.uint8, offset=5 + size).reshape(wide - 1, -1).T
    return np.cumsum(out.view(U).ravel(), dtype=U)


def pack_ints(values: np.ndarray) -> bytes:
    """Signed 64-bit integers as compressed planes of bytes."""
    n = len(values)
    if not n:
        return b""
    v = values.astype(np.int64).view(U)
    wide = max(1, (int(v.max()).bit_length() + 7) // 8)
    return bytes([wide]) + squeeze(np.ascontiguousarray(v.view(np.uint8).reshape(n, 8)[:, :wide].T))


def unpack_ints(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    wide = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(wide, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :wide] = planes.T
    return out.view(np.int64).ravel()


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def cuts(sorted_values: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of `bits`-bit values starts in a sorted list (one entry more than parts)."""
    edges = [((p << bits) + parts - 1) // parts for p in range(parts)]
    return np.append(np.searchsorted(sorted_values, np.array(edges, U)), len(sorted_values))
