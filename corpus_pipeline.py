"""A training corpus from raw documents: filter, deduplicate, decontaminate, mix and encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All but the last return the columns of documents, also columns that the stages don't know. Rows that repeat
stay or go together, but for near duplicates, of which one stays, and for the mix, which takes each row by itself; null ids
and texts are documents like others; an empty table passes through. A stage's result bears a mark in the metadata of doc_id,
which Parquet keeps. The stage that reads such a table begins by deleting the scratch tables of the very run that made it,
since that result has been written by then; it touches nothing that other runs or queries read. A stage that fails deletes its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from choicelens.llm import decontamination, mixing, near_duplicates, quality, token_output
from choicelens.llm.common import free_names, new_path, ranked, recording, release, shared_dir, written

MARK = "corpus_pipeline.scratch"
#: Scratch paths of this process's stages, by the mark of the result that reads them.
_made: dict[str, list[str]] = {}


def _key(name: str) -> Column:
    """Null-safe join key of an id or a source; neither '' nor a number's text stands for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _stage(f: Callable) -> Callable:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        known, mark, made = docs.schema["doc_id"].metadata, uuid.uuid4().hex, []
        release(spark, _made.pop(known.get(MARK), []), docs)
        try:
            with recording(made):
                out = f(spark, docs, sf_dir)
        except BaseException:
            release(spark, made, docs)
            raise
        _made[mark] = made
        return out.withMetadata("doc_id", {**known, MARK: mark})

    return run


@_stage
def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels of these documents, doesn't reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class; of rows with equal doc_id and text, one."""
    id_, md5 = free_names(docs, "__id", "__md5")
    found = near_duplicates.near_duplicates(docs)
    stay = found.where("doc_id <=> class_id AND text_md5 = class_text").select(_key("doc_id").alias(id_), F.col("text_md5").alias(md5)).distinct()
    at = docs.withColumns({id_: _key("doc_id"), md5: F.md5(F.coalesce("text", F.lit("")).cast("binary"))})
    return at.join(stay.hint("shuffle_hash"), [id_, md5], "left_semi").dropDuplicates([id_, md5]).drop(id_, md5)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    [id_] = free_names(docs, "__id")
    hits = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = hits.select(_key("doc_id").alias(id_)).distinct()
    return docs.withColumn(id_, _key("doc_id")).join(hits.hint("shuffle_hash"), id_, "left_anti").drop(id_)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    The mix tells rows of one id, source and size apart by nothing. Where it takes all of them equally often, as it must where
    ids differ, that holds for each; else they are ranked by their texts' MD5, and the first ones are taken more often."""
    id_, source, size, n, once, twice, copies = names = free_names(docs, "__id", "__source", "__size", "__rows", "__once", "__twice", "__copies")
    by = {id_: _key("doc_id"), source: _key("source")}
    count = lambda k: F.sum((F.col("copies") == k).cast("long"))
    mixed = mixing.mix(docs).withColumns(by).groupBy(id_, source, F.col("size").alias(size))
    mixed = written(mixed.agg(F.count("*").alias(n), count(1).alias(once), count(2).alias(twice)), "copies")
    alike = F.col(once).isin(0, F.col(n)) & F.col(twice).isin(0, F.col(n))
    at = docs.withColumns({**by, size: F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")})
    taken = at.join(mixed.where(alike).hint("shuffle_hash"), [id_, source, size]).withColumn(copies, F.when(F.col(twice) > 0, 2).when(F.col(once) > 0, 1).otherwise(0))
    if not mixed.where(~alike).isEmpty():
        tree = F.concat_ws("\0", id_, source, F.col(size).cast("string"))
        rest = at.join(mixed.where(~alike).hint("shuffle_hash"), [id_, source, size])
        rest = ranked(rest.select(tree.alias("tree"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("ord"), F.lit("").alias("hash"), F.struct("*").alias("row")))
        up = F.when(F.col("rank") < F.col(f"row.{twice}"), 2).when(F.col("rank") < F.col(f"row.{twice}") + F.col(f"row.{once}"), 1).otherwise(0)
        taken = taken.unionByName(rest.select("row.*", up.alias(copies)))
    [copy] = free_names(taken, "__copy")
    return taken.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).drop(copy, *names)


@_stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard files of token ids in a folder of their own under the shared one; returns what reading them back gives."""
    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    return token_output.read_ids(spark, folder, token_output.write_ids(docs, folder))


STAGES = [
    ("quality classifier", filter_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]

#: Order min-hash, pivotal rounding and tokenization have no SQL; tests/llm holds the stages against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := new_path(spark, "stage"))
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
