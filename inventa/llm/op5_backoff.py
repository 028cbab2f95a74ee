"""Stupid-backoff scores of all documents against the counts of all other documents.

The n-gram count table is partitioned by hash; the exploded n-grams of the documents meet it as the sorted hash lists
of buckets (see `buckets`): a bucket sends each part its distinct n-grams with their local counts (combined before the
shuffle, so the most frequent word of the language is one entry a bucket), the part sums them over the whole corpus
and answers with what the other buckets have, and the bucket adds the logarithms up per document. A document's own occurrences are
taken off every count, so that a text does not vouch for itself.

S(w | context) is the count of the longest n-gram that other documents have, over the count of its context, times
BACKOFF for each word by which it was shortened; for a word that no other document has, FLOOR stands for its count.
N-grams are told apart by 44 bits of hash besides those that choose the part.

Defined results: a null or empty text has no words, log_prob 0 and a null score. Equal ids are different documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.llm import buckets as B
from inventa.llm.common import keep, table, tidy
from inventa.llm.textscan import U, cuts, gram_hash, inside, pack, pack_ints, span_hash, spans, unpack, unpack_ints, utf8

ORDER, BACKOFF, FLOOR = 3, 0.4, 0.5


class Grams:
    """n-grams of one bucket: for each order, places of the first words, rows and hashes."""

    def __init__(self, group: pa.Table, id_col: str, text_col: str, order: int, bits: int):
        self.group = B.ordered(group, id_col, text_col)
        data, off = utf8(self.group.column(text_col))
        starts, ends, self.first = spans(data, off)
        h = span_hash(data, starts, ends)
        self.n = len(h)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.at = [np.flatnonzero(inside(self.first, self.n, k)) for k in range(1, order + 1)]
        self.hash = [gram_hash(h, k)[a] >> U(64 - bits) if len(a) else np.zeros(0, U) for k, a in zip(range(1, order + 1), self.at)]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of all orders, which of them each n-gram has (order after order), how often its own row has it, and how often the bucket has each.
        One stable sort by hash leaves the places, and so the rows, of equal hashes in order."""
        h, row = np.concatenate(self.hash), np.concatenate([self.row[a] for a in self.at])
        order = np.argsort(h, kind="stable")
        s, r = h[order], row[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        new_row = new.copy()
        new_row[1:] |= r[1:] != r[:-1]
        which, own = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
        which[order] = np.cumsum(new) - 1
        start = np.flatnonzero(new_row)
        times = np.diff(np.append(start, len(s)))
        own[order] = np.repeat(times, times)
        return s[new], which, own, np.diff(np.append(np.flatnonzero(new), len(s)))


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = BACKOFF, floor: float = FLOOR) -> DataFrame:
    """(id_col, n_words, log_prob, score): sum of the logarithms and their mean per word, both without rounding."""
    docs, _, parts = B.spread(docs.select(id_col, text_col), id_col, text_col)
    bits = min(63, 44 + parts.bit_length())

    def ask(group: pa.Table) -> pa.Table:
        g = Grams(group, id_col, text_col, order, bits)
        distinct, times = np.unique(np.concatenate(g.hash), return_counts=True)
        return B.rows(B.split(distinct, bits, parts, group.column(B.BUCKET)[0].as_py(), pack, lambda i, j: pack_ints(times[i:j])), B.SENT_SCHEMA)

    def answer(group: pa.Table) -> pa.Table:
        lists = [unpack(x) for x in group.column("keys").to_pylist()]
        h, times = np.concatenate(lists), np.concatenate([unpack_ints(x) for x in group.column("extra").to_pylist()])
        order_ = np.argsort(h)
        s = h[order_]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(times[order_], start)
        out = np.empty(len(h), np.int64)
        out[order_] = np.repeat(total, np.diff(np.append(start, len(s))))
        out -= times  # what the other buckets have: mostly nothing, which packs well
        ends = np.cumsum([len(x) for x in lists])
        part = group.column(B.PART)[0].as_py()
        return B.rows([(b, part, 0, pack_ints(out[e - len(x) : e])) for b, x, e in zip(group.column(B.BUCKET).to_pylist(), lists, ends)], B.ANSWER_SCHEMA)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [id_col, "n_words", "n_floor", "partial"]
        if left.num_rows == 0:
            return pa.table([left.column(id_col), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        g = Grams(left, id_col, text_col, order, bits)
        distinct, which, own, here = g.counted()
        cut, total = cuts(distinct, bits, parts), np.zeros(len(distinct), np.int64)
        for p, reply in zip(right.column(B.PART).to_pylist(), right.column("reply").to_pylist()):
            total[cut[p] : cut[p + 1]] = unpack_ints(reply)
        rest = (total + here)[which] - own
        others, end = [], 0  # by order, at the place of the first word
        for at in g.at:
            c = np.zeros(g.n, np.int64)
            c[at] = rest[end : (end := end + len(at))]
            others.append(c)
        place = np.arange(g.n) - g.first[g.row]
        value, done = np.zeros(g.n), np.zeros(g.n, bool)
        for k in range(order, 0, -1):
            w = np.flatnonzero(~done & (place >= k - 1))  # the last word of the n-gram
            c = others[k - 1][w - (k - 1)]
            if k > 1:
                w, c = w[c > 0], c[c > 0]
                ratio = np.log(c) - np.log(others[k - 2][w - (k - 1)])
            else:
                ratio = np.log(np.maximum(c, floor))  # the size of the corpus is taken off when it is known
            value[w] = ratio + (np.minimum(place[w] + 1, order) - k) * np.log(alpha)
            done[w] = True
            if k == 1:
                single = np.zeros(g.n, np.int64)
                single[w] = 1
        add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[g.first])
        some = np.diff(g.first) > 0
        tidy()
        sums = np.zeros(len(some))
        if some.any():
            sums[some] = np.add.reduceat(value, g.first[:-1][some])
        return pa.table([g.group.column(id_col), pa.array(np.diff(g.first), pa.int64()), pa.array(add(single), pa.int64()), pa.array(sums, pa.float64())], names=names)

    by_bucket = docs.groupBy(B.BUCKET)
    answers = by_bucket.applyInArrow(ask, B.SENT).groupBy(B.PART).applyInArrow(answer, B.ANSWER)
    kind = docs.schema[id_col].dataType.simpleString()
    sums = keep(by_bucket.cogroup(answers.groupBy(B.BUCKET)).applyInArrow(add_up, f"`{id_col}` {kind}, n_words long, n_floor long, partial double"), "backoff")
    words = sums.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("corpus_words"))
    log_prob = F.col("partial") - F.col("n_floor") * F.ln(F.greatest(F.col("corpus_words") - F.col("n_words"), F.lit(1)))
    out = sums.crossJoin(F.broadcast(words)).select(id_col, "n_words", log_prob.alias("log_prob"))  # one row
    return out.withColumn("score", F.col("log_prob") / F.nullif(F.col("n_words"), F.lit(0)))


def op5_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return backoff_scores(docs).select("doc_id", "n_words", F.round("log_prob", 6).alias("log_prob"), F.round("score", 6).alias("score"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, w, len(w)::BIGINT AS n, unnest(range(1, len(w) + 1)) AS i FROM d),
p AS (
  SELECT doc_id, n, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] END AS c1,
    CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2,
    CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS c2,
    CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3
  FROM t),
own AS (
  SELECT doc_id, g, count(*) AS k FROM (
    SELECT doc_id, g1 AS g FROM p UNION ALL SELECT doc_id, g2 FROM p WHERE g2 IS NOT NULL
    UNION ALL SELECT doc_id, g3 FROM p WHERE g3 IS NOT NULL) GROUP BY ALL),
everywhere AS (SELECT g, sum(k) AS k FROM own GROUP BY g),
c AS (SELECT doc_id, g, everywhere.k - own.k AS k FROM own JOIN everywhere USING (g)),
size AS (SELECT sum(len(w)) AS words FROM d),
s AS (
  SELECT p.doc_id, CASE
    WHEN x3.k > 0 THEN ln(x3.k) - ln(y2.k)
    WHEN x2.k > 0 THEN ln(x2.k) - ln(y1.k) + (least(p.i, 3) - 2) * ln(0.4::DOUBLE)
    ELSE ln(greatest(x1.k, 0.5::DOUBLE)) - ln(greatest(words - p.n, 1)) + (least(p.i, 3) - 1) * ln(0.4::DOUBLE) END AS v
  FROM p CROSS JOIN size
  JOIN c x1 ON x1.doc_id = p.doc_id AND x1.g = p.g1
  LEFT JOIN c y1 ON y1.doc_id = p.doc_id AND y1.g = p.c1
  LEFT JOIN c x2 ON x2.doc_id = p.doc_id AND x2.g = p.g2
  LEFT JOIN c y2 ON y2.doc_id = p.doc_id AND y2.g = p.c2
  LEFT JOIN c x3 ON x3.doc_id = p.doc_id AND x3.g = p.g3)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, round(coalesce(sum(v), 0), 6) AS log_prob,
  round(sum(v) / nullif(len(any_value(d.w)), 0), 6) AS score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
