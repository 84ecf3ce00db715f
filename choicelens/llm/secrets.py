"""Secret scans over a ledger of text blobs.

Every version of a path is addressed by the SHA-256 of its content. A ledger table holds (blob, rule version) pairs that
have been scanned, with their findings; a scan reads only the blobs that have no entry for the current rule version, once
each however many paths hold them, and findings are joined back to all paths.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

#: kind, pattern, group whose length counts, least length. The first three are the base rules.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
]
BASE = [r[0] for r in RULES[:3]]
SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"
FINDINGS = f"blob string, version string, spans {SPAN}"


def _spans(text: Column, ord_: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches: what split() leaves between them gives their places in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    pieces = F.transform(found, lambda m, i: F.struct(F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(m).alias("n"), F.char_length(F.get(sized, i)).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        span = F.struct(begin.alias("start"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), (begin + p["n"]).alias("end"))
        return F.struct((begin + p["n"]).alias("at"), F.when(p["size"] >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pieces, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def version_of(rules: list = RULES) -> str:
    """The rules' own digest: a ledger tells findings of other rules apart by it."""
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


def scan(blobs: DataFrame, rules: list = RULES) -> DataFrame:
    """(blob, version, spans) for rows (blob, text)."""
    version = version_of(rules)
    spans = F.concat(*[_spans(F.col("text"), i, *r) for i, r in enumerate(rules)])
    return blobs.select("blob", F.lit(version).alias("version"), F.array_sort(spans).alias("spans"))


def address(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, text, blob); null text counts as empty."""
    docs = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return docs.withColumn("blob", F.sha2("text", 256))


def scan_into(docs: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules: list = RULES) -> DataFrame:
    """Scan what the ledger folder lacks, append it there, and return one row (path, blob, spans) per row of docs.

    docs may hold any number of versions of a path. A rerun, or a later batch with old blobs, scans nothing twice, and
    however many rows hold a blob, its text is scanned once. Null paths, repeated rows and columns with any other names
    are allowed; each row of docs gives one row back.
    """
    spark, version = docs.sparkSession, version_of(rules)
    at = address(docs, path, text)
    known = _ledger(spark, ledger)
    # One path stands for each blob: the scan then shuffles each text once at most and hot blobs send one row a task.
    key = F.coalesce(F.col("path").cast("string"), F.lit(""))
    at = at.withColumn("key", key)
    each = at.groupBy("blob", "key").agg(F.count("*").alias("n"))
    one = each.groupBy("blob").agg(F.min(F.struct("key", "n")).alias("o")).select("blob", "o.key", "o.n")
    if known is not None:
        one = one.join(known.where(F.col("version") == version).select("blob").distinct().hint("merge"), "blob", "left_anti")
    texts = at.join(one.hint("shuffle_hash"), ["blob", "key"]).select("blob", "text", "n")
    # Only where rows repeat both path and blob is there anything left to drop; both branches read the same shuffle.
    again = texts.where("n > 1").select("blob", "text").dropDuplicates(["blob"])
    scan(texts.where("n = 1").select("blob", "text").unionByName(again), rules).write.mode("append").parquet(ledger)
    return findings(at, ledger, version)


def findings(at: DataFrame, ledger: str, version: str) -> DataFrame:
    """Join the ledger's findings to all paths; blobs without findings need no partner, and what two writers entered at once counts once."""
    found = _ledger(at.sparkSession, ledger).where((F.col("version") == version) & (F.size("spans") > 0)).dropDuplicates(["blob"])
    return at.select("path", "blob").join(found.select("blob", "spans").hint("merge"), "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    return spark.read.schema(FINDINGS).parquet(ledger) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def _text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return found.select(F.col("path").alias("doc_id"), *map(count, BASE), F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(scan_into(docs, new_path(spark, "ledger")))
