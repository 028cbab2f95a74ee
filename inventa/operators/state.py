"""Sessions, versioned registers and caches, over change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each change with its version."""
    return changes.withColumn("version", F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("long"))


def latest(changes: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last change of each key: an aggregate, so a busy key combines before the shuffle."""
    best = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("best")
    return changes.groupBy(*key).agg(best, F.count("*").alias("version")).select(*key, "version", *[F.col(f"best.{c}").alias(c) for c in keep])


def monotonic(df: DataFrame, key: list[str], order: list[str], version: str) -> DataFrame:
    """Changes whose version is above all that came before."""
    before = F.max(version).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(version) > F.col("__before"))).drop("__before")


def changed(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before: only the last one is remembered."""
    return df.withColumn("__was", F.lag(value).over(W.partitionBy(*key).orderBy(*order))).where(~F.col("__was").eqNullSafe(F.col(value))).drop("__was")


def last_seen(pings: DataFrame, key: str, ts: str) -> DataFrame:
    return pings.groupBy(key).agg(F.max(ts).alias("last_ts"))


def fresh(seen: DataFrame, now, age_s: float = 20) -> DataFrame:
    """Peers heard within the last seconds, youngest first by age."""
    return seen.withColumn("age_s", F.unix_micros(now) / 1e6 - F.unix_micros("last_ts") / 1e6).where(F.col("age_s") < age_s)


def known_peers(pings: DataFrame, watches: DataFrame, peer: str = "peer", ts: str = "ts", age_s: float = 20) -> DataFrame:
    """(watch, peers): the peers that each watcher heard while they were fresh, all that were so far. watches: watch, started, now."""
    seen = pings.join(F.broadcast(watches), (F.col(ts) <= F.col("now")) & (F.col(ts) > F.col("started") - F.make_dt_interval(secs=F.lit(float(age_s)))))  # the few watchers that are open
    return seen.groupBy("watch").agg(F.array_sort(F.collect_set(peer)).alias("peers"))


def silent(pings: DataFrame, watches: DataFrame, ts: str = "ts", wait_s: float = 15, age_s: float = 20) -> DataFrame:
    """(watch, alert): whether a watcher that has waited longer than `wait_s` heard no peer."""
    heard = known_peers(pings, watches, ts=ts, age_s=age_s).select("watch", F.lit(True).alias("heard"))
    late = F.unix_micros("now") - F.unix_micros("started") > wait_s * 1e6
    return watches.join(heard, "watch", "left").select("watch", (late & F.col("heard").isNull()).alias("alert"))


def adopt(local: DataFrame, remote: DataFrame, key: str, version: str) -> DataFrame:
    """Local rows, or the remote row of the same key where that has a higher version."""
    newer = remote.select(key, *[F.col(c).alias(f"__{c}") for c in local.columns if c != key])
    met = local.join(newer, key, "left")
    take = F.coalesce(F.col(f"__{version}") > F.col(version), F.lit(False))
    return met.select(*[F.col(c) if c == key else F.when(take, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in local.columns])


def payload(df: DataFrame, fields: dict[str, str], name: str = "data") -> DataFrame:
    """The state that is shared, as one struct: field names and the columns they come from."""
    return df.withColumn(name, F.struct(*[F.col(c).alias(f) for f, c in fields.items()]))


def put_if_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    once = new.dropDuplicates([key])
    return stored.unionByName(once.join(stored.select(key), key, "left_anti"))


def upsert(stored: DataFrame, new: DataFrame, key: str, updated: str) -> DataFrame:
    """One row a key, the one of the latest update; a new one wins over a stored one of the same time."""
    cols = stored.columns
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.coalesce(F.col(updated), F.lit(0)).desc(), F.desc("__new"), *[F.desc(c) for c in cols if c not in (key, updated)]))
    return both.withColumn("__r", rank).where("__r = 1").select(*cols)


def collect_garbage(files: DataFrame, sessions: DataFrame, file_key: str = "file_key", id_col: str = "id") -> DataFrame:
    """Files that no session refers to; a session without a key refers to its id."""
    used = sessions.select(F.coalesce(file_key, id_col).alias("__k"))
    return files.join(used, files[file_key] == F.col("__k"), "left_anti")


def fifo(puts: DataFrame, key: list[str], item: str, order: list[str], size: int = 12) -> DataFrame:
    """Cached items of each key: the last `size` by first insertion; putting one again keeps its place. An item that was evicted and put again counts by its first insertion."""
    first = puts.groupBy(*key, item).agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("first"), item)).cast("long")
    return first.withColumn("rank", rank).where(F.col("rank") <= size)


def served_once(requests: DataFrame, served: DataFrame, key: str) -> DataFrame:
    return requests.dropDuplicates([key]).join(served.select(key), key, "left_anti")


def toggle(collected: DataFrame, row: str, order: list[str]) -> DataFrame:
    """Rows that are on after all toggles: an odd number of them."""
    return collected.groupBy(row).agg(F.count("*").alias("toggles")).where(F.col("toggles") % 2 == 1)
