"""Recall of the near-duplicate search on a whole table, against an exact similarity join that has nothing to do with it.

    python tests/llm/recall_simhash.py /root/testdata/check_s

The join is a prefix filter: with shingles in order of rarity, two sets of Jaccard similarity t share one of the first
n - ceil(t n) + 1. All pairs that do are compared. Prints how many links of distinct texts there are and how many of
them the classes of op9_simhash hold together.
"""

import math
import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
BAR = 0.8


def links(texts: list[str | None]) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of similar distinct word sequences, and the first text of each text's sequence."""
    from inventa.llm.op9_simhash import shingles
    from inventa.llm.textscan import utf8
    import pyarrow as pa

    word = re.compile(r"[^\x20\x09-\x0D]+")
    first, own = {}, []
    for i, t in enumerate(texts):
        own.append(first.setdefault(tuple(word.findall(t or "")), i))
    nodes = [i for w, i in first.items() if len(w) >= 5]
    sets = []
    for k in range(0, len(nodes), 500):
        sh, at, *_ = shingles(*utf8(pa.array([texts[i] for i in nodes[k : k + 500]])))
        sets += [sh[a:b] for a, b in zip(at[:-1], at[1:])]
    flat = np.concatenate(sets)
    known, rank, times = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.empty(len(known), np.int64)
    order[np.argsort(times, kind="stable")] = np.arange(len(known))
    ranks = np.split(order[rank], np.cumsum([len(s) for s in sets])[:-1])
    ranks = [np.sort(r) for r in ranks]
    posting = defaultdict(list)
    out = []
    for x in sorted(range(len(nodes)), key=lambda x: len(ranks[x])):
        r, seen = ranks[x], set()
        n = len(r)
        for token in r[: n - math.ceil(BAR * n - 1e-9) + 1].tolist():
            for y in posting[token]:
                if y not in seen:
                    seen.add(y)
                    s = ranks[y]
                    if len(s) >= BAR * n - 1e-9:
                        both = np.intersect1d(r, s, assume_unique=True).size
                        if both >= BAR * (n + len(s) - both) - 1e-9:
                            out.append((nodes[x], nodes[y]))
            posting[token].append(x)
    return out, own


def main(folder: str) -> None:
    from pyspark.sql import SparkSession

    from inventa.llm.op9_simhash import op9_simhash

    path = Path(folder) / "documents.parquet"
    parts = sorted(path.glob("*.parquet")) if path.is_dir() else [path]
    rows = [r for p in parts for r in pq.read_table(p, columns=["doc_id", "text"]).to_pylist()]
    found, _ = links([r["text"] for r in rows])
    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").getOrCreate()
    classes = {r.doc_id: r.class_id for r in op9_simhash(spark, folder).collect()}
    held = sum(classes[rows[a]["doc_id"]] == classes[rows[b]["doc_id"]] for a, b in found)
    print(f"{len(rows)} documents, {len(found)} links between different texts, {held} held ({held / max(len(found), 1):.6f})")


if __name__ == "__main__":
    main(sys.argv[1])
