"""Tables that are written in batches and read while they grow.

A batch's rows go to a folder of their own under `data`; then one small file under `commits`, named by the batch, names that
folder. The file is written under another name and renamed, so it is there whole or not at all. Readers follow the commits:
what a killed writer left behind is never seen, a batch that is written again changes nothing, and of two writers of one
batch the first to commit counts.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def commit_batch(df: DataFrame, path: str, batch: str, sort_by: str | None = None) -> bool:
    """Write a batch and commit it; False, and nothing is written, if it is committed already. Rows may be sorted within
    files by a column, whose values readers then skip by, in place of a folder for each value."""
    spark = df.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError("a batch is named by letters, digits, _ and -")
    fs, at = _store(spark, path)
    if fs.exists(at(f"{path}/commits/{batch}.json")):
        return False
    name = f"{batch}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(sort_by) if sort_by else df).write.parquet(f"{path}/data/{name}")
    return _publish(spark, path, batch, name, df.schema)


def _publish(spark: SparkSession, path: str, batch: str, name: str, schema: StructType) -> bool:
    fs, at = _store(spark, path)
    fs.mkdirs(at(f"{path}/commits"))
    own, final = at(f"{path}/commits/.{name}"), at(f"{path}/commits/{batch}.json")
    out = fs.create(own, True)
    out.write(bytearray(f"{name}\n{schema.json()}".encode()))
    out.close()
    if not fs.exists(final) and fs.rename(own, final):  # a rename onto a file that is there fails
        return True
    fs.delete(own, False)
    return False


def committed(spark: SparkSession, path: str) -> list[str]:
    """Committed batches, in order of their names (numbers by size)."""
    fs, at = _store(spark, path)
    if not fs.exists(at(f"{path}/commits")):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at(f"{path}/commits"))]
    names = [n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith(".")]
    return sorted(names, key=lambda n: (len(n), n) if n.isdigit() else (0, n))


def read_batches(spark: SparkSession, path: str, batches: list[str] | None = None) -> DataFrame | None:
    """Rows of the committed batches, all of them or those named; None if there are none. Columns that a later batch added are null before."""
    found = []
    for batch in committed(spark, path) if batches is None else batches:
        name, schema = spark.sparkContext.wholeTextFiles(f"{path}/commits/{batch}.json").values().first().split("\n", 1)
        found.append((name, schema))
    if not found:
        return None
    fields = {f.name: f for _, s in found for f in StructType.fromJson(json.loads(s)).fields}
    return spark.read.schema(StructType([*fields.values()])).parquet(*[f"{path}/data/{name}" for name, _ in found])
