"""The same state operators over streams.

The batch forms in operators.state say what the result is; each query here is given a source with a schema and, run
until all of it is read, leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def changes(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def last_write(stream: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The latest value of each key and its version; output mode complete or update."""
    return stream.groupBy(key).agg(F.count("*").alias("version"), F.max(F.struct(*order, value)).alias("best")).select(key, "version", F.col(f"best.{value}").alias(value))


def peers(stream: DataFrame, key: str, ts: str) -> DataFrame:
    return stream.groupBy(key).agg(F.max(ts).alias("last_ts"))


def once_per_key(stream: DataFrame, key: list[str], ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each key; with `ts`, keys are forgotten after `late`."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key) if ts else stream.dropDuplicates(key)


def above_last(stream: DataFrame, key: str, version: str, order: list[str], forget: str | None = None):
    """Rows whose version is above all versions of their key that came before, as `state.monotonic` has it: rows of a
    batch are taken in their order of arrival, not of version. With `forget` (a duration) keys that are silent for so
    long lose their state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    wait = None if forget is None else round(pd.Timedelta(forget).total_seconds() * 1000)

    def step(_, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        top = state.get[0] if state.exists else None
        pdf = pd.concat([*batches]).sort_values(order)
        ok = []
        for v in pdf[version]:
            ok.append(top is None or v > top)
            top = v if top is None else max(top, v)
        state.update((top,))
        if wait:
            state.setTimeoutDuration(wait)
        yield pdf[pd.Series(ok, index=pdf.index)]

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(key).applyInPandasWithState(step, schema, f"top {kinds[version]}", "append", timeout)


def silence(stream: DataFrame, watch: str, kind: str, wait_s: float = 15):
    """(watch, alert): for each watcher, whose first row starts its clock, one row: false as soon as a peer is heard (a row
    of kind 'peer'), true if `wait_s` seconds pass without one. The batch form is `state.silent`."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.update((True,))
            yield pd.DataFrame({watch: [key[0]], "alert": [True]})
            return
        heard = any((pdf[kind] == "peer").any() for pdf in batches)
        if state.exists and state.get[0]:  # it was decided before
            return
        state.update((heard,))
        if heard:
            yield pd.DataFrame({watch: [key[0]], "alert": [False]})
        else:
            state.setTimeoutDuration(round(wait_s * 1000))

    return stream.groupBy(watch).applyInPandasWithState(step, f"`{watch}` {kinds[watch]}, alert boolean", "done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


POLL = "1500 milliseconds"


def polled(writer: DataStreamWriter, every: str = POLL) -> DataStreamWriter:
    """A stream that looks for news every so often."""
    return writer.trigger(processingTime=every)


class Runs:
    """Queries of which only the latest goes on: a new one stops the one before, whose results are stale."""

    def __init__(self):
        self.token, self.query = 0, None

    def start(self, writer: DataStreamWriter) -> int:
        """The token of the new run."""
        self.stop()
        self.query, self.token = writer.start(), self.token + 1
        return self.token

    def current(self, token: int) -> bool:
        return token == self.token and self.query is not None and self.query.isActive

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run until all that is there has been read, and give the result table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
