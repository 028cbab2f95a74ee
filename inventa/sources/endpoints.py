"""What the endpoints of a server answer, as views: each is a query over the tables, and nothing is served from here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventa.operators import state as ST
from inventa.sources.items import read


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events = read(spark, sf_dir, "events")
    return {
        "peers": ST.last_seen(events, "user_id", "ts"),
        "state": ST.latest(events, ["user_id"], ["ts", "event_id"], ["event_type", "value"]),
        "sessions": read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "pages": read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_totalprice").alias("total")),
    }


def register(spark: SparkSession, sf_dir: str, prefix: str = "api_") -> dict[str, str]:
    """Make the views; the name of each endpoint's view."""
    out = {}
    for name, df in tables(spark, sf_dir).items():
        out[name] = f"{prefix}{name}"
        df.createOrReplaceTempView(out[name])
    return out
