"""Near-dedup of 256-bit SimHash fingerprints by a recursive search over coordinate strips.

1. Fingerprints of the distinct shingles (five words) of each text; equal word sequences are one node from here on.
2. In each repetition the coordinates are permuted anew and random centres are drawn on a strip. A fingerprint joins
   the list of each centre to which its partial weight (distance on the strip) is small, so near ones meet in lists
   far more often than others. With very many fingerprints a list is split by the centres of a second strip, and so on
   (`plan`), before anything is sent, so that the length of a list does not grow with the input. Where lists are still
   long by that plan, each is filtered again on another strip with centres of its own; what is left is searched by brute
   force, however long it is. Weights follow the number of fingerprints, and the number of repetitions follows from
   simulated pairs at the similarity asked for, through all filters that there are, so that the target recall is met.
3. A list gives a spanning forest of its pairs within RADIUS, not all pairs. All its members are sent. A list that near
   copies make longer than two tasks' share (LONGEST; found by a sample of the fingerprints) is cut into blocks, and each
   two blocks meet in a task of their own, so that no pair of the list is missed and no task grows with it.
4. The forest's components (found by large-star and small-star steps, in tables of the shared folder) are verified
   on shingle sets: a pair counts if its Jaccard similarity is at least `similarity`. Pairs inside a class that is
   already whole are skipped, so copies cost one comparison each. A component of more than BLOCK texts or BLOCK_WORDS
   words is verified in random blocks; their classes are joined by their leaders where these are similar, and what is
   left in different classes is compared across all blocks, so that no link inside a component is missed.
5. Fingerprints of short texts are rough: of pairs with 8 and 10 shingles, 8 in common, one in twelve is out of RADIUS.
   So sets of SHORT shingles at most are joined exactly with all that can be similar to them (`short_links`): each is sent
   by its rarest shingles, as many as two similar sets cannot both do without. These links join classes of the search.

Result: one row for each row of the input with its class, the smallest id of the class. Defined results: a text
without words, or with a null id, is alone (class is its own id). A text of fewer than five words matches only equal
word sequences. Rows with equal ids are judged by their texts: nodes are word sequences, and each has a key of its own
(its smallest id, or a hash where several word sequences have that id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm.common import keep, meet, parallel, prepare, table, tidy
from inventa.llm.textscan import M1, M2, M3, U, gram_hash, inside, mix, pieces, span_hash, spans, utf8

SHINGLE, SIMILARITY, BITS, STRIP = 5, 0.8, 256, 64
#: A pair of similarity 0.8 differs in 39 bits on average; unrelated pairs are within the radius with probability 2e-16.
RADIUS, RECALL, LIST, LEAF = 64, 0.999, 1000, 3000
#: The smallest share of fingerprints that a strip can pick out, the longest list that one strip may leave (and block of a list), and the length at which several strips aim.
SHARE, LONGEST, SPLIT = 0.0018, 200_000, 20_000
#: Nodes of a forest that are compared at a time, and the pairs that they may be.
NODES, PAIRS = 128, 1 << 22
BLOCK, BLOCK_WORDS = 1500, 1_500_000
#: Sets that are joined exactly, too; bytes of them in a task; members of a group, above which it is cut into blocks, and of one that is compared pair by pair; pairs at a time.
SHORT, SHORT_BYTES, SHORT_GROUP, SHORT_PAIRS, PAIRED = 64, 4 << 20, 10_000, 16, 16_384
#: A shingle is common if this many sets have it and this share of them; so few are common that every task may know them.
COMMON, COMMON_SHARE = 100, 1 / 10_000
PIECE_BYTES, CHUNK_ROWS = 1 << 20, 16384
PRINT = ("f0", "f1", "f2", "f3")
PRINT_COLUMNS = ", ".join(f"{c} long" for c in PRINT)
SPREAD = np.zeros(256, "<u8")  # the eight bits of a byte as eight bytes
for _i in range(8):
    SPREAD |= ((np.arange(256) >> _i & 1).astype("<u8")) << U(8 * _i)


# Shingles and fingerprints -------------------------------------------------------------------------------------------


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (44 bits) of each row in order, where each row starts, words of each row, and two hashes of its word sequence."""
    starts, ends, first = spans(data, off)
    h, n, rows = span_hash(data, starts, ends), np.diff(first), len(off) - 1
    at = np.flatnonzero(inside(first, len(h), k))
    row = np.searchsorted(first, at, "right") - 1
    keys = np.unique((row.astype(U) << U(44)) | (gram_hash(h, k)[at] >> U(20))) if len(at) else np.zeros(0, U)
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    whole = []
    for m in (M1, M3):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h * m ^ mix(place.astype(U) * M2 + m)), dtype=U)])
        whole.append(mix((total[first[1:]] - total[first[:-1]]) ^ n.astype(U)))
    return keys & U((1 << 44) - 1), np.searchsorted(keys >> U(44), np.arange(rows + 1).astype(U)), n, *whole


def fingerprints(shingle: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows x 4 unsigned 64-bit: bit i is set where more than half of the shingles' hashes have it; of half, the first shingle's bit counts."""
    rows = len(at) - 1
    out = np.zeros((rows, len(PRINT)), U)
    sizes = np.diff(at)
    live = np.flatnonzero(sizes)
    if not len(live):
        return out
    lanes = np.empty((len(shingle), BITS // 8), "<u8")
    bytes_ = np.stack([mix(shingle * M3 + M1), mix(shingle * M1 + M2), mix(shingle * M2 + M3), mix(shingle * M1 + M3)], 1).view(np.uint8)
    np.take(SPREAD, bytes_, out=lanes)
    cut = np.concatenate([np.arange(a, b, 255) for a, b in zip(at[:-1][live], at[1:][live])])  # a lane of a byte counts to 255
    part = np.add.reduceat(lanes, cut, axis=0).view(np.uint8).reshape(len(cut), BITS).astype(np.int32)
    ones = np.add.reduceat(part, np.searchsorted(cut, at[:-1][live]), axis=0)
    tie = lanes[at[:-1][live]].view(np.uint8).reshape(len(live), BITS)
    out[live] = np.packbits(2 * ones + tie > sizes[live][:, None], axis=1, bitorder="little").view("<u8")
    return out


def scan(docs: DataFrame, id_col: str, text_col: str, short: int = SHORT) -> DataFrame:
    """id, hash of the text (t), fingerprint (f0 to f3), hashes of the word sequence (s0, s1), n_words, and the shingles if they are `short` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in pieces(off, PIECE_BYTES):
                sh, at, n, s0, s1 = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
                f = fingerprints(sh, at).view(np.int64)
                size = np.diff(at)
                few = (size > 0) & (size <= short)
                ends = np.concatenate([[0], np.cumsum(np.where(few, size, 0))]).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(sh[np.repeat(few, size)].view(np.int64)), mask=pa.array(~few))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i)] + [pa.array(np.ascontiguousarray(x)) for x in (*f.T, s0.view(np.int64), s1.view(np.int64), n)] + [sets], names=["id", "t", *PRINT, "s0", "s1", "n_words", "few"])
        tidy()

    return texts_of(docs, id_col, text_col).mapInArrow(run, f"id long, t long, {PRINT_COLUMNS}, s0 long, s1 long, n_words long, few array<long>")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, and a hash that tells texts with equal ids apart."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))


# The search ----------------------------------------------------------------------------------------------------------


def tail(k: int, w: int) -> float:
    return sum(math.comb(k, i) for i in range(w + 1)) / 2**k


def weight_for(share: float, k: int = STRIP) -> int:
    """The largest weight that at most `share` of random fingerprints have."""
    w = 0
    while tail(k, w + 1) <= share:
        w += 1
    return w


def bits_of(f: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(len(f), 8 * f.shape[1]), axis=1, bitorder="little")


def memberships(bits: np.ndarray, strip: np.ndarray, centres: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, centre) where the partial weight is w at most. centres: +1 or -1, one row each."""
    signs = bits[:, strip].astype(np.float32) * 2 - 1
    rows, lists = [], []
    for i in range(0, len(signs), 4096):
        r, c = np.nonzero(signs[i : i + 4096] @ centres.T >= len(strip) - 2 * w)
        rows.append(r + i)
        lists.append(c)
    return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def draw(seed: list[int], share: float, lists: float, level: int = 0, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """Strip, centres and weight of a filter that puts a fingerprint on about `lists` lists. Levels of one seed have strips of their own."""
    order, w = np.random.default_rng(seed).permutation(bits), weight_for(share)
    n = max(1, math.ceil(lists / tail(STRIP, w)))
    centres = np.random.default_rng([*seed, level]).integers(0, 2, (n, STRIP)).astype(np.float32) * 2 - 1
    return order[STRIP * level : STRIP * (level + 1)], centres, w


def plan(n: int) -> list[tuple[float, float]]:
    """(share, lists) of each level of filters for n fingerprints: one strip while its lists are short enough, then as many as are needed."""
    levels = 1
    while n * SHARE**levels > LONGEST and levels < BITS // STRIP:
        levels += 1
    if levels == 1:
        return [(min(0.03, max(SHARE, LIST / max(n, 1))), 1.6)]
    return [(max(SHARE, (SPLIT / n) ** (1 / levels)), 1.6 if k == 0 else 3) for k in range(levels)]


def refined(n: int) -> float | None:
    """The share of the filter inside the lists of n fingerprints, if these are long by the plan."""
    left = n * math.prod(share for share, _ in plan(n))
    return 500 / left if left > LEAF else None


def repetitions(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Repetitions after which a pair at the similarity has met with the target probability, from simulated pairs."""
    rng, levels = np.random.default_rng(5), plan(n)
    pairs = 3000
    x = rng.integers(0, 2, (pairs, BITS)).astype(np.uint8)
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    y = x ^ (rng.random((pairs, BITS)) < angle)
    met = np.ones(pairs, bool)
    for k, (share, lists) in enumerate(levels):
        met &= together(x, y, [1, 0], share, lists, k)
    inside_lists = refined(n)
    if inside_lists:
        met &= together(x, y, [1, 1], inside_lists, 5)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - max(met.mean(), 1e-3))))


def together(x: np.ndarray, y: np.ndarray, seed: list[int], share: float, lists: float, level: int = 0) -> np.ndarray:
    strip, centres, w = draw(seed, share, lists, level)
    near = lambda b: (b[:, strip].astype(np.float32) * 2 - 1) @ centres.T >= STRIP - 2 * w
    return (near(x) & near(y)).any(1)


def lists_of(bits: np.ndarray, filters: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) over all levels: a list is a centre of each level."""
    rows, lists = memberships(bits, *filters[0])
    for strip, centres, w in filters[1:]:
        r, c = memberships(bits, strip, centres, w)
        start, stop = np.searchsorted(r, rows), np.searchsorted(r, rows, "right")  # rows of a filter come in order
        n = stop - start
        at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows, lists = np.repeat(rows, n), np.repeat(lists, n) * len(centres) + c[at]
    return rows, lists


def forest(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs within the radius. A block of nodes is compared with all that are left; most have
    nothing near and are done. From the others the component is walked: each of its nodes is compared once, with those not
    yet reached, so what a node reaches is never compared with each other. Shorter fingerprints have a radius in proportion."""
    radius = RADIUS * 64 * f.shape[1] // BITS
    left, a, b = np.arange(len(f)), [], []
    while len(left) > 1:
        block = left[: max(1, min(NODES, PAIRS // len(left)))]
        near = sum(np.bitwise_count(x[block, None] ^ x[left]).astype(np.int16) for x in f.T) <= radius
        busy = block[near.sum(1) > 1]
        left = left[len(block) :]
        if not len(busy):
            continue
        left = np.concatenate([busy, left])
        waiting = np.zeros(len(f), bool)
        waiting[busy] = True
        for root in busy.tolist():
            if not waiting[root]:
                continue
            stack = [root]
            left = left[left != root]
            waiting[root] = False
            while stack and len(left):
                some = max(1, min(NODES, PAIRS // len(left)))
                x = np.array(stack[-some:])
                del stack[-some:]
                near = sum(np.bitwise_count(c[x, None] ^ c[left]).astype(np.int16) for c in f.T) <= radius
                hit = near.any(0)
                if hit.any():
                    new = left[hit]
                    waiting[new] = False
                    a.append(x[near[:, hit].argmax(0)])
                    b.append(new)
                    stack += new.tolist()
                    left = left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def search(f: np.ndarray, seed: list[int], share: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of a list: filtered again on another strip if there is a share for that (`refined`), the rest by brute force.
    The share is not that of this list: a list longer than planned has longer parts, and no pair meets less often."""
    if len(f) <= LEAF or share is None:
        return forest(f)
    strip, centres, w = draw(seed, share, 5, bits=64 * f.shape[1])
    rows, lists = memberships(bits_of(f), strip, centres, w)
    order = np.argsort(lists, kind="stable")
    rows, lists, out = rows[order], lists[order], []
    for part in np.split(rows, np.flatnonzero(np.diff(lists)) + 1):
        a, b = forest(f[part])
        out.append((part[a], part[b]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


LISTED = f"list long, pair long, id long, {PRINT_COLUMNS}"
LISTED_SCHEMA = pa.schema([("list", pa.int64()), ("pair", pa.int64()), ("id", pa.int64()), *((c, pa.int64()) for c in PRINT)])


def crowded(listed: DataFrame, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of more than two blocks of LONGEST, in order, and how many blocks each has. listed: those of one fingerprint in `every`."""
    size = F.col("count") * every
    found = listed.groupBy("list").count().where(size > 2 * LONGEST).select("list", F.ceil(size / LONGEST).alias("blocks")).orderBy("list").toArrow()
    return found.column("list").to_numpy(), found.column("blocks").to_numpy().astype(np.int64)


def spread(key: np.ndarray, ids: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, pair of blocks) for members `ids` of the lists `key`: one row each, but one for each other block of a crowded list."""
    blocks = np.ones(len(key), np.int64)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], key), len(hot[0]) - 1)
        blocks = np.where(hot[0][at] == key, hot[1][at], 1)
    times = np.maximum(blocks - 1, 1)
    row = np.repeat(np.arange(len(key)), times)
    other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    many = blocks[row]
    own = (mix(ids.view(U))[row] % many.astype(U)).astype(np.int64)
    other += other >= own
    return row, np.where(many > 1, np.minimum(own, other) * many + np.maximum(own, other), 0)


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of the forests of all lists over nodes (id, fingerprint)."""
    n = nodes.count()
    levels, reps, share = plan(n), repetitions(n, similarity), refined(n)
    hot = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [[draw([2, r], share, lists, k) for k, (share, lists) in enumerate(levels)] for r in range(reps)]
        many = math.prod(len(centres) for _, centres, _ in filters[0])
        waiting: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            t = pa.Table.from_batches(waiting)
            waiting.clear()
            ids = t.column("id").to_numpy()
            f = np.stack([t.column(c).to_numpy().view(U) for c in PRINT], 1)
            bits = bits_of(f)
            for r, levels_of in enumerate(filters):
                rows, lists = lists_of(bits, levels_of)
                key = r * many + lists
                for i in range(0, len(rows), CHUNK_ROWS):
                    part = slice(i, i + CHUNK_ROWS)
                    at, pair = spread(key[part], ids[rows[part]], hot)
                    x = rows[part][at]
                    yield pa.RecordBatch.from_arrays([pa.array(key[part][at]), pa.array(pair), pa.array(ids[x]), *(pa.array(c[x].view(np.int64)) for c in f.T)], schema=LISTED_SCHEMA)

        held = 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held >= CHUNK_ROWS:
                yield from flush()
                held = 0
        yield from flush()
        tidy()

    def pairs(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x, y = search(np.stack([group.column(c).to_numpy().view(U) for c in PRINT], 1)[order], [4, group.column("list")[0].as_py()], share)
        return pa.table({"a": pa.array(np.minimum(ids[x], ids[y])), "b": pa.array(np.maximum(ids[x], ids[y]))})

    prints = nodes.select("id", *PRINT)
    if n > 2 * LONGEST:
        every = max(1, 2 * LONGEST // 100)
        hot = crowded(prints.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(every)) == 0).mapInArrow(route, LISTED), every)
    return prints.mapInArrow(route, LISTED).groupBy("list", "pair").applyInArrow(pairs, "a long, b long").where("a < b").distinct()


def connected(edges: DataFrame, limit: int = 50) -> DataFrame:
    """(id, root) of every node of the edges: large-star and small-star steps in turn until nothing changes, each step a
    table of the shared folder. Minima are aggregated before they meet the edges, so a hub is not gathered in one place."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.where("b < a")
        low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        met = near.join(low, "a")
        out = met.where("b > a").select(F.col("m").alias("a"), "b") if large else met.select(F.col("m").alias("a"), "b").unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b")))
        return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    e = keep(edges, "edges")
    seen = None
    for _ in range(limit):
        e = keep(star(star(e, True), False), "edges")
        state = tuple(e.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).head())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")).unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())


# Short texts ---------------------------------------------------------------------------------------------------------


def similar_pairs(flat: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (x, y) of sets are similar. Set i is flat[at[i] : at[i + 1]], 44 bits each."""
    ok = np.zeros(len(x), bool)
    size = np.diff(at)
    for i in range(0, len(x), PAIRED):
        part = [v[i : i + PAIRED] for v in (x, y)]
        keys = []
        for v in part:
            n = size[v]
            place = np.repeat(at[v] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            keys.append((np.repeat(np.arange(len(v)), n).astype(U) << U(44)) | flat[place])
        both = np.bincount((np.intersect1d(*keys, assume_unique=True) >> U(44)).astype(np.int64), minlength=len(part[0]))
        ok[i : i + PAIRED] = both >= similarity * (size[part[0]] + size[part[1]] - both) - 1e-9
    return ok


def similar_forest(flat: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs of similar sets: each set is compared, by what shingles they share, with those not yet reached."""
    size, n = np.diff(at), len(at) - 1
    known, token = np.unique(flat, return_inverse=True)
    row, left, a, b = np.repeat(np.arange(n), size), np.ones(n, bool), [], []
    rest = indexed = n

    def index() -> tuple[np.ndarray, np.ndarray]:
        live = np.flatnonzero(left[row])
        live = live[np.argsort(token[live], kind="stable")]
        return row[live], np.searchsorted(token[live], np.arange(len(known) + 1))

    rows, start = index()
    for root in range(n):
        if not left[root]:
            continue
        left[root], stack, rest = False, [root], rest - 1
        while stack and rest:
            if 2 * rest < indexed:
                (rows, start), indexed = index(), rest
            x = stack.pop()
            shared = np.bincount(np.concatenate([rows[start[t] : start[t + 1]] for t in token[at[x] : at[x + 1]].tolist()]), minlength=n)
            new = np.flatnonzero(left & (shared >= similarity * (size + size[x] - shared) - 1e-9))
            left[new], rest = False, rest - len(new)
            a.append(np.full(len(new), x))
            b.append(new)
            stack += new.tolist()
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def list_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists without nulls, and where each list starts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).view(U), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def short_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join all similar sets (id, few), exactly: two similar sets of n and m shingles share one of the first
    n - ceil(similarity n) + 1 and m - ceil(similarity m) + 1 in any one order of all shingles. Common ones come last in it."""
    total, held = sets.agg(F.count("*"), F.sum(F.size("few") * (F.size("few") * F.lit(1 - similarity) + 1) * 8)).head()
    if not total:
        return sets.sparkSession.createDataFrame([], "a long, b long")
    counted = sets.select(F.explode("few").alias("x")).groupBy("x").count().where(F.col("count") > max(COMMON, COMMON_SHARE * total)).orderBy("x").toArrow()
    common, times = counted.column("x").to_numpy().view(U), counted.column("count").to_numpy()
    tasks = int(held // SHORT_BYTES) + 1
    hot = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = list_column(batch.column(1))
            size = np.diff(at)
            row, weight = np.repeat(np.arange(len(size)), size), np.zeros(len(flat), np.int64)
            if len(common):
                place = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                weight = np.where(common[place] == flat, times[place], 0)
            order = np.lexsort((flat, weight, row))
            first = order[np.arange(len(flat)) - at[row] <= (size - np.ceil(similarity * size - 1e-9))[row]]
            key, x = flat[first].view(np.int64), row[first]
            again, pair = spread(key, batch.column(0).to_numpy()[x], hot)
            key, x = key[again], x[again]
            for i in range(0, len(key), 4096):
                part = slice(i, i + 4096)
                place = np.where(np.isin(key[part], hot[0]), tasks + np.searchsorted(hot[0], key[part]), key[part] % tasks)
                some = batch.take(pa.array(x[part]))
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(pair[part]), pa.array(key[part]), some.column(0), some.column(1)], names=["task", "pair", "key", "id", "few"])
        tidy()

    def links(group: pa.Table) -> pa.Table:
        key, ids = group.column("key").to_numpy(), group.column("id").to_numpy()
        flat, at = list_column(group.column("few"))
        order = np.lexsort((ids, key))
        start = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        n = np.diff(np.append(start, len(order)))
        a, b = [ids[:0]], [ids[:0]]
        for k in range(2, SHORT_PAIRS + 1):
            members = order[start[n == k][:, None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            x, y = members[:, i].ravel(), members[:, j].ravel()
            ok = similar_pairs(flat, at, x, y, similarity)
            a.append(ids[x[ok]])
            b.append(ids[y[ok]])
        for s, k in zip(start[n > SHORT_PAIRS].tolist(), n[n > SHORT_PAIRS].tolist()):
            some = order[s : s + k]
            size = at[some + 1] - at[some]
            ends = np.concatenate([[0], np.cumsum(size)])
            x, y = similar_forest(flat[np.repeat(at[some] - ends[:-1], size) + np.arange(ends[-1])], ends, similarity)
            a.append(ids[some[x]])
            b.append(ids[some[y]])
        x, y = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        tidy()
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    schema = "task long, pair long, key long, id long, few array<long>"
    if total > 2 * SHORT_GROUP:  # fewer cannot fill a group
        size = F.col("count")
        found = sets.select("id", "few").mapInArrow(firsts, schema).groupBy("key").count().where(size > 2 * SHORT_GROUP).select("key", F.ceil(size / SHORT_GROUP).alias("blocks")).orderBy("key").toArrow()
        hot = found.column("key").to_numpy(), found.column("blocks").to_numpy().astype(np.int64)
    return sets.select("id", "few").mapInArrow(firsts, schema).groupBy("task", "pair").applyInArrow(links, "a long, b long").distinct()


def joined_classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, leader) after links (a, b) of ids, which may have no label yet."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    labels = labels.unionByName(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("leader")))
    of = lambda c: labels.select(F.col("id").alias(c), F.col("leader").alias(f"{c}_leader"))
    apart = links.join(of("a"), "a").join(of("b"), "b").where("a_leader <> b_leader")
    apart = keep(apart.select(F.least("a_leader", "b_leader").alias("a"), F.greatest("a_leader", "b_leader").alias("b")).distinct(), "apart")
    if apart.isEmpty():
        return labels
    return labels.join(connected(apart).select(F.col("id").alias("leader"), F.col("root").alias("top")), "leader", "left").select("id", F.coalesce("top", "leader").alias("leader"))


# Verification --------------------------------------------------------------------------------------------------------


def classes(ids: np.ndarray, sets: list[np.ndarray], f: np.ndarray, similarity: float, known: np.ndarray | None = None) -> np.ndarray:
    """Smallest id of each one's class: pairs within the radius whose sets are similar, except those already in one class.
    known: the class of each one so far; then the smallest of these classes."""
    n = len(ids)
    label, size = np.arange(n), np.array([len(s) for s in sets])
    if known is not None:
        _, first, which = np.unique(known, return_index=True, return_inverse=True)
        label = first[which]
    flat = np.concatenate(sets) if n else np.zeros(0, U)
    begin = np.cumsum(size) - size
    degree = np.array([(np.bitwise_count(f ^ f[i]).sum(1, dtype=np.int16) <= RADIUS).sum() for i in range(n)]) if n <= 4096 else np.zeros(n)
    for x in np.lexsort((ids, -degree)):
        todo = np.flatnonzero((label != label[x]) & (np.bitwise_count(f ^ f[x]).sum(1, dtype=np.int16) <= RADIUS))
        todo = todo[np.minimum(size[todo], size[x]) >= similarity * np.maximum(size[todo], size[x]) - 1e-9]
        if not len(todo):
            continue
        own = sets[x]
        at = np.concatenate([np.arange(begin[i], begin[i] + size[i]) for i in todo])
        values = flat[at]
        place = np.minimum(np.searchsorted(own, values), len(own) - 1)
        both = np.add.reduceat((own[place] == values).astype(np.int64), np.cumsum(size[todo]) - size[todo])
        union = size[todo] + size[x] - both
        for y in todo[both >= similarity * union - 1e-9]:
            if label[y] != label[x]:
                low, high = sorted((label[x], label[y]))
                label[label == high] = low
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids if known is None else known)
    return least[label]


def sets_of(text: pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray]:
    """Shingle sets and fingerprints of texts."""
    data, off = utf8(text)
    sets: list[np.ndarray] = []
    f = []
    for i, j in pieces(off, PIECE_BYTES):
        sh, at, *_ = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
        sets += [sh[a:b] for a, b in zip(at[:-1], at[1:])]
        f.append(fingerprints(sh, at))
    return sets, np.concatenate(f)


def in_blocks(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (root, id, n_words, ...) of components of two or more, with the number of the component's blocks and a block."""
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_words") / BLOCK_WORDS)).alias("blocks")
    many = rows.groupBy("root").agg(parts, F.count("*").alias("members")).where("members > 1").drop("members")
    return rows.drop("blocks").join(many, "root").withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int"))


def verify(texts: DataFrame, similarity: float) -> DataFrame:
    """(root, id, leader, n_words, blocks, size, fingerprint, text) of texts (root, block, id, text, n_words, blocks), within each block; the text only where a component has several."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("id").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        ids, text, several = group.column("id").to_numpy(), group.column("text"), group.column("blocks")[0].as_py() > 1
        sets, f = sets_of(text)
        out = {"root": group.column("root"), "id": pa.array(ids), "leader": pa.array(classes(ids, sets, f, similarity)), "n_words": group.column("n_words"), "blocks": group.column("blocks"), "size": pa.array([len(s) for s in sets], pa.int64())}
        out |= {c: pa.array(np.ascontiguousarray(f[:, k]).view(np.int64)) for k, c in enumerate(PRINT)}
        return pa.table(out | {"text": text if several else pa.nulls(len(ids), pa.string())})

    rows = texts.select("root", "block", "id", "text", F.col("n_words").cast("long").alias("n_words"), F.col("blocks").cast("long").alias("blocks"))
    return rows.groupBy("root", "block").applyInArrow(run, f"root long, id long, leader long, n_words long, blocks long, size long, {PRINT_COLUMNS}, text string")


def moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """labels (root, id, leader) after moves (leader, top)."""
    return labels.join(moves, "leader", "left").select("root", "id", F.coalesce("top", "leader").alias("leader"))


def across(first: DataFrame, similarity: float) -> DataFrame:
    """(root, id, leader) of the components in several blocks, from the classes within the blocks.

    Leaders are compared in blocks of their own as long as that joins many: it makes copies of one text one class. Where
    more than one class stays, all members outside the largest class are compared with all members of the component, a task
    for each two blocks; of these only the texts go there that have a fingerprint of another class within the radius."""
    held = first.where("blocks > 1")
    labels, tops, seed = held.select("root", "id", "leader"), held.where("id = leader"), 0
    while True:
        seed += 1
        tried = keep(verify(in_blocks(tops, seed), similarity), "leaders")
        before, after = tried.agg(F.count("*"), F.count_if(F.expr("id = leader"))).head()
        labels = moved(labels, tried.where("id <> leader").select(F.col("id").alias("leader"), F.col("leader").alias("top")))
        tops = tried.where("blocks > 1 and id = leader")
        if after > 0.9 * before or tops.isEmpty():
            break
    labels = keep(labels, "labels")
    counted = labels.groupBy("root", "leader").agg(F.count("*").alias("n"))
    largest = counted.groupBy("root").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    rows = labels.join(largest, "root").withColumn("few", F.col("leader") != F.col("main")).drop("main").join(held.select("id", "n_words", "size", *PRINT), "id")
    rows = keep(rows, "open")
    if rows.isEmpty():
        return labels
    parts = lambda own: F.ceil(F.greatest(2 * F.count_if(own) / BLOCK, 2 * F.sum(F.when(own, F.col("n_words"))) / BLOCK_WORDS)).cast("int")
    rows = rows.join(rows.groupBy("root").agg(parts(F.col("few")).alias("p"), parts(~F.col("few")).alias("q")), "root")
    block = F.when(F.col("few"), F.pmod(F.xxhash64("id"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("id"), F.col("q"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("few"), F.col("p") + F.col("q")).otherwise(F.col("p")) - 1)
    paired = rows.withColumn("block", block).withColumn("x", F.explode(others)).withColumn("i", F.least("x", "block")).withColumn("j", F.greatest("x", "block"))

    def near(group: pa.Table) -> pa.Table:
        lead, size = group.column("leader").to_numpy(), group.column("size").to_numpy()
        f = [group.column(c).to_numpy().view(U) for c in PRINT]  # of a signed number the bits of its absolute value would be counted
        hit = np.zeros(len(lead), bool)
        for k in range(0, len(lead), 256):
            s = slice(k, k + 256)
            far = sum(np.bitwise_count(x[s, None] ^ x).astype(np.int16) for x in f)
            ok = (far <= RADIUS) & (lead[s, None] != lead) & (np.minimum(size[s, None], size) >= similarity * np.maximum(size[s, None], size) - 1e-9)
            hit[s] = ok.any(1)
        return group.select(["root", "i", "j", "id", "leader"]).filter(pa.array(hit))

    def link(group: pa.Table) -> pa.Table:
        sets, f = sets_of(group.column("text"))
        lead = group.column("leader").to_numpy()
        out = classes(group.column("id").to_numpy(), sets, f, similarity, lead)
        return pa.table({"a": pa.array(out[out != lead]), "b": pa.array(lead[out != lead])})

    wanted = paired.select("root", "i", "j", "id", "leader", "size", *PRINT).groupBy("root", "i", "j").applyInArrow(near, "root long, i int, j int, id long, leader long")
    met = held.select("id", "text").join(keep(wanted, "wanted").hint("shuffle_hash"), "id")
    links = keep(met.groupBy("root", "i", "j").applyInArrow(link, "a long, b long").distinct(), "links")
    if links.isEmpty():
        return labels
    return moved(labels, connected(links).select(F.col("id").alias("leader"), F.col("root").alias("top")))


def keyed(nodes: DataFrame) -> DataFrame:
    """nodes (id, t, ...) with the key of each: its id, or a hash where several nodes have that id."""
    shared = nodes.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id", F.lit(True).alias("shared"))
    key = F.when(F.col("shared"), F.xxhash64("id", "t", "s0", "s1")).otherwise(F.col("id"))
    return nodes.join(shared, "id", "left").withColumn("key", key).drop("shared")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id), one row for each row of `docs`."""
    prepare(docs.sparkSession)
    prints = keep(scan(docs, id_col, text_col, int(SHORT / similarity)), "prints")
    real = prints.where("n_words > 0 and id is not null")
    # The text of a node is that of the smallest id; of rows that share that id, too, any has the same words.
    nodes = keep(real.groupBy("s0", "s1", "n_words").agg(F.min("id").alias("id"), F.min_by("t", "id").alias("t"), *[F.first(c).alias(c) for c in PRINT], F.count("*").alias("n")), "nodes")
    unique = keep(keyed(nodes.where(F.col("n_words") >= SHINGLE)).select(F.col("key").alias("id"), F.col("id").alias("doc"), "t", *PRINT, "s0", "s1", "n_words"), "unique")
    groups = keep(connected(candidates(unique, similarity)), "groups")
    placed = in_blocks(groups.join(unique.select("id", "doc", "t", "n_words"), "id"), 0)
    # One way at every size: both sides are partitioned by id and text, the small one is built into a hash table. Of repeated rows one goes on.
    texts = texts_of(docs, id_col, text_col).withColumnRenamed("id", "doc")
    joined = texts.join(placed.hint("shuffle_hash"), ["doc", "t"]).groupBy("doc", "t", "id").agg(*[F.first(c).alias(c) for c in ("root", "block", "blocks", "n_words", "text")])
    first = keep(verify(joined, similarity), "leaders")
    if not first.where("blocks > 1").isEmpty():
        first = first.where("blocks = 1").select("root", "id", "leader").unionByName(across(first, similarity))
    short = real.where("few is not null").groupBy("s0", "s1", "n_words").agg(F.first("few").alias("few"))
    short = keep(short.join(unique.select("id", "s0", "s1", "n_words"), ["s0", "s1", "n_words"]).select("id", "few"), "short")
    labels = joined_classes(first.select("id", "leader"), keep(short_links(short, similarity), "links"))
    members = keep(labels.join(unique.select("id", "doc", "s0", "s1", "n_words"), "id"), "members")
    tops = members.groupBy("leader").agg(F.min("doc").alias("class"), F.count("*").alias("k")).where("k > 1")
    near = meet(members, tops, ["leader"], "k").where("class is not null").select("s0", "s1", "n_words", "class")
    # A class of copies of one text without near ones is that node's smallest id.
    classed = nodes.join(near, ["s0", "s1", "n_words"], "left").select("s0", "s1", "n_words", F.coalesce("class", "id").alias("class"), "n").where("n > 1 or class <> id")
    out = meet(prints.drop("few"), keep(classed, "classed"), ["s0", "s1", "n_words"], "n")
    return out.select("id", F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class_id"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parallel(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id")
