"""Shared folder, text columns and graph steps that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
SHINGLE = 5
SIMILARITY = 0.8
#: Rows of the table of ranges (one for each group and partition) that may be broadcast; a longer one is joined by shuffling.
FEW_RANGES = 100_000
#: Lists that take down scratch paths, each thread its own.
_recorders: ContextVar[tuple] = ContextVar("recorders", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _recorders.get():
        made.append(path)
    return path


@contextmanager
def recording(made: list[str]) -> Iterator[None]:
    """Scratch paths that are named meanwhile go to `made` too."""
    before = _recorders.set((*_recorders.get(), made))
    try:
        yield
    finally:
        _recorders.reset(before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends here and outlives any executor."""
    df.write.parquet(path := new_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str], keep: DataFrame) -> None:
    """Delete scratch tables that the caller made and nobody reads any more, but none that `keep` reads."""
    read = keep.inputFiles()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if not any(path.split(":")[-1] in f for f in read):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """What runs meanwhile hands Python workers batches of so many rows: whole texts are long, and the default is 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, for columns that come and go."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        out.append(stem)
    return out


def id_columns(name: str = "doc_id") -> list[Column]:
    """An id on its way through pandas, where a null would turn its neighbours into floats: a number and a mark."""
    return [F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")).alias("id"), F.col(name).isNull().alias("none")]


def id_back(name: str = "doc_id") -> Column:
    return F.when(~F.col("none"), F.col("id")).alias(name)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def with_shingles(df: DataFrame, text: str, out: str, k: int = SHINGLE) -> DataFrame:
    """Add array<bigint> `out`: hashes of the k-word shingles in text order. A text of 1 to k-1 words has one, of all its words."""
    w, h = f"__{out}_w", f"__{out}_h"
    df = df.withColumn(w, words(F.col(text))).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    at = lambda i: F.get(F.col(h), i)
    many = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[at(i + j) for j in range(k)]))
    none = F.array().cast("array<bigint>")
    return df.withColumn(out, F.when(F.size(h) >= k, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none)).drop(w, h)


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, label): the least node of its connected component, for each node of links (a, b).

    Each round takes the least label among neighbours, then the label of that label, so chains shorten by half.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    for _ in range(64):
        label = written(label, f"{name}-labels")
        near = both.join(label.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("m"))
        low = label.join(near.withColumnRenamed("a", "node").hint("merge"), "node").select("node", "label", F.least("label", "m").alias("low"))
        at = label.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        step = written(low.join(at.hint("merge"), "low").select("node", F.col("label").alias("was"), F.least("low", "jump").alias("label")), f"{name}-step")
        label = step.select("node", "label")
        if step.where("was != label").isEmpty():
            return label
    raise RuntimeError("connected components did not settle")


def ranked(rows: DataFrame) -> DataFrame:
    """rows (tree, ord, hash, …) with their rank in the tree, from 0, and the tree's size n. Null ords come first; rows of
    one ord stand by hash, and rows equal in all are interchangeable, so they may be dealt over partitions."""
    at = [F.col("tree"), F.col("ord").asc_nulls_first(), F.col("hash"), F.col("nth")]
    rows = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*at).sortWithinPartitions(*at)
    rows = written(rows.withColumn("nth", F.monotonically_increasing_id()), "sorted")
    # Partitions follow one another in order, and a tree's rows stand side by side: one row for each tree and partition.
    part = F.shiftright("nth", 33).alias("part")
    ranges = rows.groupBy("tree", part).agg(F.min("nth").alias("first"), F.count("*").alias("rows"))
    sums = ranges.groupBy("tree").agg(F.sum("rows").alias("n"), F.sort_array(F.collect_list(F.struct("part", "first", "rows"))).alias("ranges"))
    before = F.transform("ranges", lambda x, i: F.struct(x["part"].alias("part"), (F.aggregate(F.slice("ranges", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["rows"]) - x["first"]).alias("shift")))
    ranges = written(sums.select("tree", "n", F.explode(before).alias("x")).select("tree", "n", "x.*"), "ranges")
    ranges = F.broadcast(ranges) if ranges.count() <= FEW_RANGES else ranges.hint("merge")
    return rows.withColumn("part", part).join(ranges, ["tree", "part"]).withColumn("rank", F.col("nth") + F.col("shift")).drop("part", "shift", "nth", "ord")
