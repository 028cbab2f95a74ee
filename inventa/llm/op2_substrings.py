"""Exact substring dedup by fixed-block anchors.

With windows of `window` words and blocks of `block` <= (window + 1) / 2, any window of a text holds exactly one of
its own aligned blocks (window 13, block 7) or at least one. Aligned blocks of all documents are the index; every
rolling window of `block` words probes it. Where an anchor is hit by another occurrence, the match is extended: the
windows of `window` words that contain it are compared in full, by hashes of the whole window, and the one that starts
in the smallest id stays. Overlapping windows of a repeat are all found this way, so the removed words are the union
of the maximal exact repeats of at least `window` words.

Anchors travel as hash lists of buckets (see `buckets`), so no list of pairs is formed and a passage that a third of
all documents share costs one entry a bucket. An anchor hash that collides only adds windows to compare. Windows are
told apart by two hashes, of 63 and of 32 bits.

Defined results: a null or empty text has no words. A document with a null id never has the smaller id, so the others
keep their words. Rows with equal ids keep what they share with each other. Columns of the input named like the
results are replaced; the results' names are parameters. All other columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inventa.llm import buckets as B
from inventa.llm.common import fresh, table, tidy
from inventa.llm.textscan import M2, U, cover, cuts, gram_hash, inside, mix, pack, pack_bits, pack_ints, span_hash, spans, unpack, unpack_bits, unpack_ints, utf8

WINDOW, BLOCK = 13, 7


class Bucket:
    """Words of one bucket."""

    def __init__(self, group: pa.Table, id_col: str, text_col: str):
        self.group = B.ordered(group, id_col, text_col)
        self.ids = B.ids(self.group, id_col)
        self.data, self.off = utf8(self.group.column(text_col))
        self.starts, self.ends, self.first = spans(self.data, self.off)
        self.hash = span_hash(self.data, self.starts, self.ends)
        self.n = len(self.starts)

    def anchors(self, block: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of blocks that lie in one document, and their hashes."""
        at = np.flatnonzero(inside(self.first, self.n, block))
        return at, gram_hash(self.hash, block)[at] >> U(64 - bits)

    def aligned(self, at: np.ndarray, block: int) -> np.ndarray:
        row = np.searchsorted(self.first, at, "right") - 1
        return (at - self.first[row]) % block == 0

    def windows(self, marked: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the marked starts: places, the sorted hashes of the distinct windows and a second hash of each, which of them each place has, smallest id of each.
        Documents are in order of id, so that is the id of its first place."""
        at = np.flatnonzero(marked[: max(self.n - window + 1, 0)] & inside(self.first, self.n, window))
        if not len(at):
            return at, np.zeros(0, U), np.zeros(0, "<u4"), at, self.ids[:0]
        h, check = gram_hash(self.hash, window)[at] >> U(1), (gram_hash(mix(self.hash + M2), window)[at] >> U(32)).astype("<u4")
        order, start, which = alike(h, check)
        first = order[start]
        inverse = np.empty(len(at), np.int64)
        inverse[order] = which
        return at, h[first], check[first], inverse, self.ids[self.row(at[first])]

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def alike(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by both hashes that leaves equal ones as they are, where each distinct pair starts in it, and the number of the pair at each place of it."""
    order = np.lexsort((check, h))
    a, b = h[order], check[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def repeats(docs: DataFrame, id_col: str, text_col: str, window: int, block: int) -> tuple[DataFrame, DataFrame, int]:
    """Documents in buckets, and the answers about their windows."""
    docs, _, parts = B.spread(docs, id_col, text_col)
    bits = min(63, 34 + max(1, parts).bit_length())

    def ask_anchors(group: pa.Table) -> pa.Table:
        b = Bucket(group, id_col, text_col)
        at, h = b.anchors(block, bits)
        distinct, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        anchored = np.zeros(len(distinct), bool)
        anchored[inverse[b.aligned(at, block)]] = True
        many = times > 1
        bucket = group.column(B.BUCKET)[0].as_py()
        return B.rows(B.split(distinct, bits, parts, bucket, pack, lambda i, j: pack_bits(np.concatenate([anchored[i:j], many[i:j]]))), B.SENT_SCHEMA)

    def answer_anchors(group: pa.Table) -> pa.Table:
        """An anchor counts if it is a block of the index somewhere and occurs at least twice."""
        n, lists = group.column("n").to_pylist(), [unpack(k) for k in group.column("keys").to_pylist()]
        flags = [unpack_bits(x, 2 * k) for x, k in zip(group.column("extra").to_pylist(), n)]
        h = np.concatenate(lists)
        anchored, many = np.concatenate([f[:k] for f, k in zip(flags, n)]), np.concatenate([f[k:] for f, k in zip(flags, n)])
        index = np.unique(h[anchored])
        place = np.minimum(np.searchsorted(index, h), max(len(index) - 1, 0))
        hit = index[place] == h if len(index) else np.zeros(len(h), bool)
        times = np.bincount(place[hit], weights=1 + many[hit], minlength=max(len(index), 1))
        hit[hit] = times[place[hit]] > 1
        ends = np.cumsum(n)
        part = group.column(B.PART)[0].as_py()
        return B.rows([(bucket, part, 0, pack_bits(hit[e - k : e])) for bucket, k, e in zip(group.column(B.BUCKET).to_pylist(), n, ends) if hit[e - k : e].any()], B.ANSWER_SCHEMA)

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return B.SENT_SCHEMA.empty_table()
        b = Bucket(left, id_col, text_col)
        at, h = b.anchors(block, bits)
        distinct, inverse = np.unique(h, return_inverse=True)
        cut = cuts(distinct, bits, parts)
        flagged = np.zeros(len(distinct), bool)
        for p, reply in zip(right.column(B.PART).to_pylist(), right.column("reply").to_pylist()):
            flagged[cut[p] : cut[p + 1]] = unpack_bits(reply, cut[p + 1] - cut[p])
        marks = np.zeros(b.n, bool)
        marks[at[flagged[inverse]]] = True
        # A window that starts up to window - block words before an anchor contains it.
        reach = cover(marks[::-1], b.n, window - block + 1)[::-1]
        _, distinct, check, _, least = b.windows(reach, window)
        bucket = left.column(B.BUCKET)[0].as_py()
        out = B.split(distinct, 63, parts, bucket, pack, lambda i, j: check[i:j].tobytes() + pack_ints(least[i:j]))
        return B.rows([*out, (bucket % parts, bucket, 1, b.n, b"", pack_bits(reach))], B.SENT_SCHEMA)

    def answer_windows(group: pa.Table) -> pa.Table:
        """Whether a smaller id than the bucket's own smallest has the window."""
        out, asked, part = [], [], group.column(B.PART)[0].as_py()
        for bucket, kind, keys, extra in zip(*(group.column(c).to_pylist() for c in (B.BUCKET, "kind", "keys", "extra"))):
            if kind:
                out.append((bucket, part, 1, extra))
            else:
                h = unpack(keys)
                asked.append((bucket, h, np.frombuffer(extra, "<u4", len(h)), unpack_ints(extra[4 * len(h) :])))
        if asked:
            h, check, least = (np.concatenate([x[k] for x in asked]) for k in (1, 2, 3))
            order, start, which = alike(h, check)
            earlier, end = np.empty(len(h), bool), 0
            earlier[order] = np.minimum.reduceat(least[order], start)[which] < least[order]
            for bucket, x, *_ in asked:
                end += len(x)
                if earlier[end - len(x) : end].any():
                    out.append((bucket, part, 0, pack_bits(earlier[end - len(x) : end])))
        return B.rows(out, B.ANSWER_SCHEMA)

    by_bucket = docs.groupBy(B.BUCKET)
    anchors = by_bucket.applyInArrow(ask_anchors, B.SENT).groupBy(B.PART).applyInArrow(answer_anchors, B.ANSWER)
    asked = by_bucket.cogroup(anchors.groupBy(B.BUCKET)).applyInArrow(ask_windows, B.SENT)
    return docs, asked.groupBy(B.PART).applyInArrow(answer_windows, B.ANSWER), parts


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept", window: int = WINDOW, block: int = BLOCK, words_col: str = "n_words", removed_col: str = "n_removed") -> DataFrame:
    """All columns of `docs`, then `kept_col` (the words that stay, joined by one space), `words_col` and `removed_col` (counts of words)."""
    if 2 * block > window + 1:
        raise ValueError("a window must hold an aligned block")
    docs = docs.drop(kept_col, words_col, removed_col)
    ours = {c: fresh(docs, f"{c}_of_the_input")[0] for c in docs.columns if c.lower() in (B.BUCKET, B.PART)}
    docs = docs.withColumnsRenamed(ours)
    schema = T.StructType([*docs.schema.fields, T.StructField(kept_col, T.StringType()), T.StructField(words_col, T.LongType()), T.StructField(removed_col, T.LongType())])
    docs, answers, parts = repeats(docs, id_col, text_col, window, block)

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:  # the answers have no documents without them
            return left.drop_columns(B.BUCKET).append_column(kept_col, pa.array([], pa.string())).append_column(words_col, pa.array([], pa.int64())).append_column(removed_col, pa.array([], pa.int64()))
        b = Bucket(left, id_col, text_col)
        gone = np.zeros(b.n, bool)
        reach = B.replies(right, 1)
        if reach:
            at, distinct, _, inverse, least = b.windows(unpack_bits(reach[0], b.n), window)
            cut = cuts(distinct, 63, parts)
            earlier = np.zeros(len(distinct), bool)
            for p, kind, reply in zip(right.column(B.PART).to_pylist(), right.column("kind").to_pylist(), right.column("reply").to_pylist()):
                if not kind:
                    earlier[cut[p] : cut[p + 1]] = unpack_bits(reply, cut[p + 1] - cut[p])
            hit = earlier[inverse] | (least[inverse] < b.ids[b.row(at)])
            marks = np.zeros(b.n, bool)
            marks[at[hit]] = True
            gone = cover(marks, b.n, window)
        text, kept = b.data.tobytes(), []
        for i, j in zip(b.first[:-1].tolist(), b.first[1:].tolist()):
            stay = np.flatnonzero(~gone[i:j]) + i
            kept.append(b" ".join([text[s:e] for s, e in zip(b.starts[stay].tolist(), b.ends[stay].tolist())]).decode())
        total = np.concatenate([[0], np.cumsum(gone)])
        out = b.group.drop_columns(B.BUCKET)
        for name, column in ((kept_col, pa.array(kept, pa.string())), (words_col, pa.array(np.diff(b.first), pa.int64())), (removed_col, pa.array(total[b.first[1:]] - total[b.first[:-1]], pa.int64()))):
            out = out.append_column(name, column)
        tidy()
        return out

    return docs.groupBy(B.BUCKET).cogroup(answers.groupBy(B.BUCKET)).applyInArrow(cut_out, schema).withColumnsRenamed({v: k for k, v in ours.items()})


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM windows JOIN firsts USING (g) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
