"""Items read from ordinary tables, explicit schemas, and sources of raw files."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from inventa.functions.scalars import hex_from_bits

RESULTS = T.StructType([T.StructField("name", T.StringType()), T.StructField("from", T.LongType()), T.StructField("to", T.LongType()), T.StructField("rows", T.ArrayType(T.StructType([
    T.StructField("c", T.LongType()), T.StructField("u", T.BooleanType()), T.StructField("p", T.ArrayType(T.LongType())), T.StructField("a", T.ArrayType(T.DoubleType())),
])))])
TRUTH = T.StructType([T.StructField("pdf", T.StringType()), T.StructField("note", T.StringType()), T.StructField("pairs", T.ArrayType(T.StructType([
    T.StructField("row", T.IntegerType()), T.StructField("gap", T.DoubleType()), T.StructField("a", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("b", T.ArrayType(T.ArrayType(T.IntegerType()))),
])))])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times without a zone are taken as those of the session (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in df.schema])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, item_ord (0-based within the page), row_id, qty (null where it could not be read), box, price."""
    li = read(spark, sf_dir, "lineitem")
    qty = F.when(F.col("l_quantity") <= 45, F.col("l_quantity").cast("long"))
    return li.select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("row_id"), qty.alias("qty"), F.col("l_suppkey").alias("box"), "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")


def ordinals(items: DataFrame) -> DataFrame:
    """item_ord: position within the page, with a tie-break over all that tells items apart."""
    w = W.partitionBy("page").orderBy("l_linenumber", "row_id", "box", "l_quantity", "l_shipdate", "l_extendedprice")
    return items.withColumn("item_ord", F.row_number().over(w).cast("long") - 1)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part rows with a colour that any engine derives alike."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("row_id"), (k * 37 % 256).cast("int").alias("r"), (k * 59 % 256).cast("int").alias("g"), (k * 83 % 256).cast("int").alias("b"), F.col("p_size").alias("size"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """`df`, a scan, with a task for each core at least and for each so many rows: a table may be few splits, and much work for each of its rows."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks) if df._jdf.queryExecution().toRdd().getNumPartitions() < tasks else df


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, side, page, ordinal) of a ground-truth file."""
    pairs = spark.read.schema(TRUTH).option("multiLine", True).json(path).select(F.posexplode("pairs").alias("pair_id", "p"))
    side = lambda s: pairs.select("pair_id", F.lit(s).alias("side"), F.explode(f"p.{s}").alias("x")).select("pair_id", "side", F.col("x")[0].alias("page"), F.col("x")[1].alias("ordinal"))
    return side("a").unionByName(side("b"))


TEMPLATE = r"label\W+(\w)\W+bits\W+([0-9a-fA-F]+)"


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(ord, label, bits as hex) found in a script file; the order is that of the file. A file without any is an error."""
    text = spark.read.option("wholetext", True).text(path)
    found = text.select(F.posexplode(F.regexp_extract_all("value", F.lit(TEMPLATE), F.lit(0))).alias("ord", "m"))
    one = lambda i: F.regexp_extract("m", TEMPLATE, i)
    out = found.select("ord", one(1).alias("label"), one(2).alias("bits"))
    if out.isEmpty():
        raise ValueError(f"no templates in {path}")
    return out


def with_nine(templates: DataFrame) -> DataFrame:
    """Templates (label, bits as an array) and a 9, which is the 6 turned by half a circle."""
    return templates.where("label <> '9'").unionByName(templates.where("label = '6'").select(F.lit("9").alias("label"), F.reverse("bits").alias("bits")))


def write_templates(templates: DataFrame, path: str) -> None:
    """One script file of templates (label, bits as an array) by label; they are some dozens."""
    line = F.concat(F.lit("  { label: \""), "label", F.lit("\", bits: \""), hex_from_bits(F.col("bits")), F.lit("\", n: "), F.size("bits").cast("string"), F.lit(" },"))
    lines = templates.select("label", line.alias("line")).groupBy().agg(F.array_sort(F.collect_list(F.struct("label", "line"))).alias("all"))
    lines.select(F.concat(F.lit("const TEMPLATES = [\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\n];")).alias("value")).coalesce(1).write.text(path)


DUMP = "page long, box long, item long, qty_raw string, thumb string"


def write_results(items: DataFrame, path: str) -> None:
    """A line of JSON for each item: page, box, place, the quantity as it was read, and the name of its picture."""
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_b"), F.col("box").cast("string"), F.lit("_i"), F.col("item_ord").cast("string"), F.lit(".png"))
    items.select("page", "box", F.col("item_ord").alias("item"), "qty_raw", name.alias("thumb")).write.json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DUMP).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path; it is made and written first if it is not there. A table that is not finished counts as none."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def awaited(spark: SparkSession, path: str, tries: int = 40, wait_s: float = 0.4) -> bool:
    """Whether a file that was asked for arrives in time."""
    for k in range(tries):
        if exists(spark, path):
            return True
        if k + 1 < tries:
            time.sleep(wait_s)
    return False


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, width, height, data) of binary P6 pixel files: header fields are cut out in the JVM, the pixels stay binary."""
    raw = spark.read.format("binaryFile").load(path)
    head = F.decode(F.substring("content", 1, 64), "ISO-8859-1")
    part = lambda i: F.regexp_extract(head, r"(?s)^P6\s+(\d+)\s+(\d+)\s+(\d+)\s", i)
    return raw.withColumn("skip", F.length(part(0))).select("path", "length", part(1).cast("int").alias("width"), part(2).cast("int").alias("height"), F.expr("substring(content, skip + 1)").alias("data"))
