"""Questions about hashes of all documents, asked in bulk.

Documents are spread over buckets by their id (and text, so that equal or null ids don't pile up); a bucket is one
bounded group that every pass meets again in the same order. A bucket sends each hash range of a table ("part") one
sorted, distinct, difference-coded list, so a hash that a third of all rows share arrives once a bucket, not once a
row; the part answers with one value for each entry of the list, in its order. No hash travels with its document.

There are as many buckets as the bytes of the texts ask for (BUCKET_BYTES each, so a group of rows in a worker is the
same size at any input), and a part for each PER_PART of them. A list that would be empty is not sent, so the rows sent
are as many as buckets times parts and never more than the distinct hashes of all buckets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inventa.llm.common import prepare

BUCKET, PART = "__bucket", "__part"
BUCKET_BYTES, PER_PART = 4 << 20, 2
#: Of a part's lists: `kind` 0 is a question, 1 something that is only passed on to its bucket.
SENT = f"{PART} int, {BUCKET} int, kind int, n long, keys binary, extra binary"
ANSWER = f"{BUCKET} int, {PART} int, kind int, reply binary"


def spread(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """Documents with their bucket, and how many buckets and parts there are."""
    prepare(docs.sparkSession)
    n = -(-(docs.agg(F.sum(F.octet_length(text_col))).head()[0] or 0) // BUCKET_BYTES) + 1
    # Rows without a text take part in no list and may be many: they go anywhere.
    where = F.when(F.coalesce(F.length(text_col), F.lit(0)) == 0, F.xxhash64(F.spark_partition_id())).otherwise(F.xxhash64(id_col, text_col))
    return docs.withColumn(BUCKET, F.pmod(where, F.lit(n)).cast("int")), n, -(-n // PER_PART)


def ordered(group: pa.Table, id_col: str, text_col: str) -> pa.Table:
    """A bucket in an order that does not depend on how its rows arrived; null ids come last."""
    return group.take(pc.sort_indices(group, sort_keys=[(id_col, "ascending"), (text_col, "ascending")], null_placement="at_end"))


def ids(group: pa.Table, id_col: str) -> np.ndarray:
    """Ids, of which a null is the largest."""
    return group.column(id_col).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()


def split(values: np.ndarray, bits: int, parts: int, bucket: int, pack: Callable, extra: Callable[[int, int], bytes]) -> list[tuple]:
    """Rows of SENT for a bucket's sorted distinct values."""
    from inventa.llm.textscan import cuts

    cut = cuts(values, bits, parts)
    return [(p, bucket, 0, int(b - a), pack(values[a:b]), extra(int(a), int(b))) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]


def rows(data: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in data], f.type) for i, f in enumerate(schema)], schema=schema)


SENT_SCHEMA = pa.schema([(PART, pa.int32()), (BUCKET, pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])
ANSWER_SCHEMA = pa.schema([(BUCKET, pa.int32()), (PART, pa.int32()), ("kind", pa.int32()), ("reply", pa.binary())])


def replies(right: pa.Table, kind: int = 0) -> list[bytes]:
    """Answers to a bucket, in the order of its parts."""
    t = right.filter(pc.equal(right.column("kind"), kind))
    t = t.take(pc.sort_indices(t, sort_keys=[(PART, "ascending")]))
    return t.column("reply").to_pylist()
