"""Quality rules with risk-controlled thresholds.

Every text gets the base counts of the contract and four signals: share of symbols, of repeated lines, of words in
repeated windows, and mean word length. Each signal may reject a document that lies beyond a cutoff, and each stratum
(language) has cutoffs of its own. Cutoffs are chosen on labelled holdout rows so that, with confidence 1 - DELTA over
all strata and signals together (Bonferroni), no more than ALPHA of the good documents (quality = 1) of the stratum
are rejected by all its signals together, each having an equal share of ALPHA: candidates on a fixed grid are tested
from the most lenient one on, each by the exact binomial upper bound, until one fails (fixed-sequence testing needs no
further correction, and any accepted candidate may be taken). The gain of a candidate is the share of bad documents
(quality = 0) that it rejects, less PRICE times its share of good ones; of the accepted ones the most lenient is taken
whose gain is within SLACK of the best, none if that is below SLACK. A stratum that
has too few labels to prove anything rejects nothing.

Only counts on the grid leave the executors: strata times signals times grid points, whatever the input. There may be
STRATA strata at most; the table of cutoffs that every document meets has a row for each.

Defined results: a null or empty text has no words and fails the base rules. A null stratum is a stratum. Labels that
are null or that repeat for a document count once for each row with quality 1; documents without a label don't count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inventa.llm.common import keep, parallel, prepare, table
from inventa.llm.textscan import SPACE, U, cover, gram_hash, inside, mix, pieces, span_hash, spans, utf8

REPEAT, ALPHA, DELTA, PRICE, SLACK, GRID, STRATA = 8, 0.05, 0.05, 5.0, 0.02, 40, 10_000
PIECE_BYTES = 2 << 20
SYMBOL = np.zeros(256, bool)
SYMBOL[[*b"#*$%&|<>"]] = True
NOT_NEWLINE = np.zeros(256, bool)
NOT_NEWLINE[0x0A] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def again(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its row has the key more than once, and whether it is not the first with it."""
    n = len(keys)
    many, later = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return many, later
    k = mix(keys ^ mix(row.astype(U) + U(0x51ED27)))
    order = np.argsort(k, kind="stable")
    s, r, o = k[order], row[order], keys[order]
    same = (s[1:] == s[:-1]) & (r[1:] == r[:-1]) & (o[1:] == o[:-1])
    later[order[1:]] = same
    many[order[1:]] |= same
    many[order[:-1]] |= same
    return many, later


def counts(data: np.ndarray, off: np.ndarray, repeat: int = REPEAT) -> np.ndarray:
    """COUNTS of each row."""
    rows = len(off) - 1
    starts, ends, first = spans(data, off)
    total = lambda flags, edges: np.diff(np.concatenate([[0], np.cumsum(flags)])[edges])
    out = np.zeros((len(COUNTS), rows), np.int64)
    out[0] = np.diff(first)
    out[1] = total(((data & 0xC0) != 0x80) & ~SPACE[data], off)
    out[2] = total(SYMBOL[data], off)
    a, b, lines = spans(data, off, NOT_NEWLINE)
    words = np.concatenate([[0], np.cumsum(~SPACE[data])]) if len(data) else np.zeros(1, np.int64)
    real = words[b] > words[a]
    line_row = np.repeat(np.arange(rows), np.diff(lines))
    later = np.zeros(len(a), bool)
    later[real] = again(span_hash(data, a[real], b[real], 1), line_row[real])[1]
    out[3], out[5] = total(later, lines), total(real, lines)
    at = np.flatnonzero(inside(first, len(starts), repeat))
    grams = gram_hash(span_hash(data, starts, ends), repeat)[at] if len(at) else np.zeros(0, U)
    row = np.searchsorted(first, at, "right") - 1
    marks = np.zeros(len(starts), bool)
    marks[at[again(grams, row)[0]]] = True
    out[4] = total(cover(marks, len(starts), repeat), first)
    return out


def measure(docs: DataFrame, text_col: str = "text", repeat: int = REPEAT) -> DataFrame:
    """All columns of `docs` but the text, and COUNTS."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (*COUNTS, text_col)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(text_col))
            for i, j in pieces(off, PIECE_BYTES):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(c) for c in counts(data[off[i] : off[j]], off[i : j + 1] - off[i], repeat)], names=schema.names)

    return docs.select(*kept, text_col).mapInArrow(run, schema)


def signals() -> dict[str, tuple[Column, list[float]]]:
    """Each signal, and its grid from the most lenient cutoff to the strictest: a document beyond (above) it goes."""
    share = lambda a, b: F.coalesce(F.col(a).cast("double") / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))
    even = [round(1 - i / GRID, 6) for i in range(1, GRID + 1)]
    return {
        "symbols": (share("n_symbols", "word_chars"), even),
        "lines": (share("n_dup_lines", "n_lines"), even),
        "repeats": (share("n_repeat_words", "n_words"), even),
        "long_words": (share("word_chars", "n_words"), [round(80 * 0.93**i, 6) for i in range(GRID)]),
        "short_words": (-share("word_chars", "n_words"), [round(-0.1 * 1.1**i, 6) for i in range(GRID)]),
    }


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a binomial share at confidence 1 - delta: the p at which k or fewer of n has probability delta."""
    if n <= 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)] if 0 < p < 1 else [0.0 if p <= 0 else -math.inf]
        top = max(terms)
        tail = math.exp(top) * sum(math.exp(t - top) for t in terms) if top > -math.inf else 0.0
        low, high = (p, high) if tail > delta else (low, p)
    return high


def passes(k: int, n: int, alpha: float, delta: float) -> bool:
    """Whether upper_bound(k, n, delta) <= alpha: k or fewer of n is unlikely enough at alpha itself."""
    if n <= 0 or k >= n:
        return False
    if k > alpha * n:
        return False
    term = total = n * math.log1p(-alpha)
    for i in range(1, k + 1):
        term += math.log((n - i + 1) / i) + math.log(alpha) - math.log1p(-alpha)
        total = max(total, term) + math.log1p(math.exp(-abs(total - term)))
    return total <= math.log(delta)


def cutoffs(found: list[tuple], grids: dict[str, list[float]], alpha: float = ALPHA, delta: float = DELTA, price: float = PRICE) -> dict[tuple, float]:
    """(stratum, signal) -> cutoff. found: (stratum, good and bad documents, {signal: good and bad ones beyond each grid point})."""
    each, share = delta / max(1, len(found) * len(grids)), alpha / len(grids)
    out = {}
    for stratum, good, bad, beyond in found:
        for name, grid in grids.items():
            gains = []
            for cut, (k, b) in zip(grid, beyond[name]):
                if not passes(k, good, share, each):
                    break
                gains.append((b / max(bad, 1) - price * k / good, cut))
            best = max((g for g, _ in gains), default=0.0)
            if best >= SLACK:
                out[stratum, name] = next(cut for g, cut in gains if g >= best - SLACK)
    return out


def learn(measured: DataFrame, labels: DataFrame, stratum_col: str, id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple, float]:
    """Cutoffs from all labelled rows; what comes to the driver are counts by stratum, signal and grid point."""
    sig = signals()
    strata = measured.select(stratum_col).distinct().limit(STRATA + 1).count()
    if strata > STRATA:
        raise ValueError(f"{stratum_col} has more than {STRATA} values")
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), (F.col(label_col) == 1).alias("__good"))
    held = measured.join(known, F.col(id_col) == F.col("__id"))
    passed = lambda v, grid: F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: v > c))
    places = F.explode(F.array(*[F.struct(F.lit(name).alias("signal"), passed(v, grid).alias("beyond")) for name, (v, grid) in sig.items()])).alias("x")
    rows = held.select(F.col(stratum_col).alias("stratum"), "__good", places).groupBy("stratum", "x.signal", "x.beyond", "__good").count().collect()
    table_: dict = {}
    for r in rows:  # a grid goes from lenient to strict: what is beyond its i-th point is beyond the later ones, too
        n = len(sig[r.signal][1])
        table_.setdefault(r.stratum, {name: np.zeros((2, n_ + 1), np.int64) for name, n_ in ((k, len(v[1])) for k, v in sig.items())})[r.signal][int(r["__good"]), n - r.beyond] += r["count"]
    first = next(iter(sig))
    found = [(st, int(t[first][1].sum()), int(t[first][0].sum()), {name: [*zip(np.cumsum(c[1])[:-1].tolist(), np.cumsum(c[0])[:-1].tolist())] for name, c in t.items()}) for st, t in table_.items()]
    return cutoffs(found, {name: grid for name, (_, grid) in sig.items()}, alpha, delta)


def verdict(measured: DataFrame, chosen: dict[tuple, float], stratum_col: str) -> DataFrame:
    """Adds base_failed and kept."""
    sig = signals()
    held = sorted({st for st, _ in chosen}, key=lambda x: (x is not None, x))
    cuts = measured.sparkSession.createDataFrame([(st, *(chosen.get((st, name)) for name in sig)) for st in held], ", ".join(["__stratum string", *(f"__{name} double" for name in sig)]))
    met = measured.join(F.broadcast(cuts), F.col(stratum_col).eqNullSafe(F.col("__stratum")), "left")  # STRATA rows at most
    bad = reduce(Column.__or__, [F.coalesce(v > F.col(f"__{name}"), F.lit(False)) for name, (v, _) in sig.items()])
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return met.withColumn("base_failed", base).withColumn("kept", ~base & ~bad).drop(*cuts.columns)


def filter_quality(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, stratum, COUNTS, base_failed and kept of each document."""
    measured = keep(measure(docs.select("doc_id", F.col(stratum_col).cast("string").alias("stratum"), "text")), "measured")
    return verdict(measured, learn(measured, labels, "stratum", alpha=alpha, delta=delta), "stratum")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parallel(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "lang", "text"))
    out = filter_quality(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
