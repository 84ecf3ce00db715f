"""Relational operators over findings, jobs and their dimensions.

Null keys join nothing, repeated rows count as often as they stand, ties go by id or code, and empty tables give empty
results (counts of 0 where a total is asked for). Columns that an operator doesn't name pass through or are left out whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import redact, redact_json
from ..plans.captures import clamp


#: Rows of a dimension that is broadcast; a longer one is met by salted keys. Bins of one round of a cut.
FEW, BINS = 10_000, 4096


def _meet(rows: DataFrame, dim: DataFrame, key: str, how: str) -> DataFrame:
    """rows ⋈ dim on one key with few values, of which one may hold most rows.

    A dimension of few rows (counted) is broadcast. Beyond that the rows are counted by key; a key that holds more than
    a partition's fair share is dealt over as many salts as it fills, and its dimension rows are repeated for each."""
    if dim.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(dim), key, how)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n")).first()[0] or 1
    # Fewer keys than partitions can hold more than a fair share each: the table of salts is small by that.
    salts = by.where(F.col("n") * parts > total).select(key, F.ceil(F.col("n") * parts / F.lit(total)).cast("int").alias("__salts"))
    salts = F.broadcast(salts)
    of = F.coalesce("__salts", F.lit(1))
    salted = rows.join(salts, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns) + F.spark_partition_id(), of).cast("int")).drop("__salts")
    again = dim.join(salts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), of - 1))).drop("__salts")
    return salted.join(again.hint("merge"), [key, "__salt"], how).drop("__salt")


def _cut(df: DataFrame, by: str, k: int) -> tuple[int | None, int]:
    """(v, above): the k-th greatest value of a long column, 1-based, and how many rows exceed it; (None, n) if there are fewer than k.

    Rounds of counting in at most 4,096 equal bins, each inside the bin where the k-th lies: no sort, and nothing but counts
    comes to the driver."""
    low, high, n = df.agg(F.min(by), F.max(by), F.count(by)).first()
    if n < k:
        return None, n
    above = 0
    while low < high:
        width = -(-(high - low + 1) // BINS)
        counts = df.where(F.col(by).between(low, high)).groupBy(F.expr(f"(cast({by} as decimal(38,0)) - {low}) div {width}").alias("bin")).agg(F.count("*").alias("n")).collect()
        for r in sorted(counts, key=lambda r: -r.bin):
            if above + r.n >= k:
                low, high = low + int(r.bin) * width, min(high, low + (int(r.bin) + 1) * width - 1)
                break
            above += r.n
    return low, above


def newest(jobs: DataFrame, k: int) -> Column:
    """Whether a job is among the newest k by (created_at, id), both as numbers; null times are the oldest, null ids the least of their time.

    The border is found by counting, so k may be any size; no task sorts or holds k rows."""
    least = F.lit(-(2**63))
    at = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), least)
    id_ = F.coalesce(F.col("id").cast("long"), least)
    keyed = jobs.select(at.alias("at"), id_.alias("key"))
    v, above = _cut(keyed, "at", k)
    if v is None:
        return F.lit(True)
    w, _ = _cut(keyed.where(F.col("at") == v), "key", k - above)
    return (at > v) | ((at == v) & (id_ >= w))


def dim_pattern(spark: SparkSession) -> DataFrame:
    """Thirteen rows: fit to broadcast."""
    return spark.createDataFrame([(c, *v) for c, v in lx.PATTERNS.items()], "pattern_code string, pattern_name string, tier string")


def tier_of(df: DataFrame) -> DataFrame:
    """Add the pattern's best tier; unknown codes are indicative."""
    dims = F.broadcast(dim_pattern(df.sparkSession))
    return df.drop("pattern_name", "tier").join(dims, "pattern_code", "left").withColumn("tier", F.coalesce("tier", F.lit("indicative")))


def clamp_confidence(df: DataFrame) -> DataFrame:
    return tier_of(df).withColumn("confidence", clamp(F.col("confidence"), F.col("tier")))


def dashboard_summary(jobs: DataFrame, violations: DataFrame) -> DataFrame:
    """(kind, pattern_code, n): jobs, violations, and violations by pattern."""
    total = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("pattern_code")).groupBy("kind", "pattern_code").agg(F.count("*").alias("n"))
    by = violations.groupBy("pattern_code").agg(F.count("*").alias("n")).select(F.lit("pattern").alias("kind"), "pattern_code", "n")
    return total(jobs, "jobs").union(total(violations, "violations")).union(by)


def pattern_ranking(violations: DataFrame) -> DataFrame:
    return violations.groupBy("pattern_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern_code")


def top_pattern(violations: DataFrame) -> DataFrame:
    return pattern_ranking(violations).limit(1)


def tier_counts(findings: DataFrame, by: str) -> DataFrame:
    tiers = ["provable", "corroborated", "indicative", "unstated"]
    counts = findings.withColumn("tier", F.coalesce("tier", F.lit("unstated"))).groupBy(by).pivot("tier", tiers).agg(F.count(F.lit(1)))
    return counts.select(by, *[F.coalesce(t, F.lit(0)).alias(t) for t in tiers])


def coverage_summary(violations: DataFrame) -> DataFrame:
    """(tier, patterns, codes, findings): what the detectors can say at each tier, and how often they did."""
    n = violations.groupBy("pattern_code").agg(F.count("*").alias("n"))
    all_ = dim_pattern(violations.sparkSession).join(n, "pattern_code", "left")
    return all_.groupBy("tier").agg(F.count("*").alias("patterns"), F.concat_ws(",", F.sort_array(F.collect_list("pattern_code"))).alias("codes"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


def list_audits(jobs: DataFrame, violations: DataFrame, limit: int = 50, offset: int = 0, after: tuple | None = None) -> DataFrame:
    """A page of jobs, newest first, each with its violations; the limit comes before the join, and 200 ids may be broadcast.

    A page begins `offset` jobs from the newest one, or behind the job `after` (created_at, id), the last of the page before:
    either way no task holds more than a page."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    rest = jobs.where(~newest(jobs, offset)) if offset else jobs
    if after is not None:
        rest = rest.where(F.struct("created_at", "id") < F.struct(F.lit(after[0]).cast(jobs.schema["created_at"].dataType), F.lit(after[1]).cast(jobs.schema["id"].dataType)))
    page = rest.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    held = violations.join(F.broadcast(page.select(F.col("id").alias("job_id"))), "job_id").groupBy("job_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pattern_code", "confidence"))).alias("violations"))
    return page.join(held, page["id"] == held["job_id"], "left").drop("job_id").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.desc("created_at"), F.desc("id"))


def get_audit(jobs: DataFrame, violations: DataFrame, id_: int) -> DataFrame:
    return jobs.where(F.col("id") == id_).join(violations.where(F.col("job_id") == id_), F.col("id") == F.col("job_id"), "left").drop("job_id")


def expired_jobs(jobs: DataFrame, now: Column, days: int, cap: int) -> DataFrame:
    """Ids of jobs older than `days`, or beyond the newest `cap`; 0 switches a rule off. Each id once."""
    old = jobs.where(F.col("created_at") < now - F.make_dt_interval(F.lit(days))) if days else jobs.limit(0)
    if not cap:
        return old.select("id").distinct()
    return old.select("id").union(jobs.where(~newest(jobs, cap)).select("id")).distinct()


def retention_split(jobs: DataFrame, violations: DataFrame, now: Column, days: int, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs kept, jobs purged, violations kept)."""
    gone = expired_jobs(jobs, now, days, cap)
    kept = violations.join(gone.withColumnRenamed("id", "job_id"), "job_id", "left_anti")
    return jobs.join(gone, "id", "left_anti"), jobs.join(gone, "id", "left_semi"), kept


def delete_audits(jobs: DataFrame, violations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs left, violations left, counts (kind, n) of what went) without the jobs of ids (id); unknown ids count nothing."""
    gone = ids.select("id").distinct()
    held = gone.withColumnRenamed("id", "job_id")
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    counts = n(jobs.join(gone, "id", "left_semi"), "jobs").union(n(violations.join(held, "job_id", "left_semi"), "violations"))
    return jobs.join(gone, "id", "left_anti"), violations.join(held, "job_id", "left_anti"), counts


def purge_all(jobs: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nothing is left; counts as in delete_audits."""
    return delete_audits(jobs, violations, jobs)


def cases_for_findings(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """findings ⋈ cases (case_id, pattern_codes array)."""
    return _meet(findings, cases.select("case_id", F.explode("pattern_codes").alias("pattern_code")), "pattern_code", "inner")


def case_counts(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, n): how many findings each case has, a finding once for each of the case's codes that it bears. Findings are counted by code
    before they meet the cases, so what is made grows with both tables' sum, not with their product."""
    by = findings.groupBy("pattern_code").agg(F.count("*").alias("n"))
    codes = cases.select("case_id", F.explode("pattern_codes").alias("pattern_code"))
    return _meet(codes, by, "pattern_code", "inner").groupBy("case_id").agg(F.sum("n").alias("n"))


def crosswalk_findings(findings: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """findings ⋈ crosswalk (pattern_code, other_codes array); a finding without an entry stays, with a null code."""
    return _meet(findings, crosswalk, "pattern_code", "left").withColumn("other_code", F.explode_outer("other_codes")).drop("other_codes")


def run_verdict(states: DataFrame, findings: DataFrame) -> DataFrame:
    """(trace_id, verdict, n): INCONCLUSIVE without a page of 200 characters, PARTIAL without a price, CLEAN, or FINDINGS."""
    seen = states.groupBy("trace_id").agg(*[F.bool_or(flag).alias(name) for name, flag in seen_flags().items()])
    n = findings.groupBy("trace_id").agg(F.count("*").alias("n"))
    return verdict_of(seen.join(n.hint("merge"), "trace_id", "left").withColumn("n", F.coalesce("n", F.lit(0))))


def seen_flags() -> dict[str, Column]:
    """What a state may show that a verdict rests on."""
    return {"text": F.length("full_text") >= 200, "priced": F.col("price").isNotNull()}


def verdict_of(got: DataFrame) -> DataFrame:
    """(trace_id, verdict, n) of (trace_id, n, text, priced), one row a trace."""
    return got.select("trace_id", F.when(~F.coalesce("text", F.lit(False)), "INCONCLUSIVE").when(~F.col("priced"), "PARTIAL").when(F.col("n") == 0, "CLEAN").otherwise("FINDINGS").alias("verdict"), "n")


def recall_by_label(labelled: DataFrame, label: str, hit: Column) -> DataFrame:
    return labelled.groupBy(label).agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("hits"), F.avg(hit.cast("int")).alias("recall"))


def false_positive_rate(findings: DataFrame, clean: DataFrame) -> DataFrame:
    hit = clean.join(findings.select("trace_id").distinct().withColumn("hit", F.lit(1)).hint("merge"), "trace_id", "left")
    return hit.agg(F.count("*").alias("traces"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.coalesce(F.sum("hit") / F.count("*"), F.lit(0.0)).alias("rate"))


def tier_cap_check(findings: DataFrame) -> DataFrame:
    """Findings that claim more than their tier allows: none, if all is well."""
    return findings.where(F.col("confidence") > clamp(F.lit(1.0), F.col("tier")))


def run_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys of findings that one of two runs lacks: appeared in b, or disappeared from a."""
    x, y = a.select(*key).distinct().withColumn("__a", F.lit(1)), b.select(*key).distinct().withColumn("__b", F.lit(1))
    return x.join(y, key, "full").where("__a IS NULL OR __b IS NULL").select(*key, F.when(F.col("__a").isNull(), "appeared").otherwise("disappeared").alias("change"))


def report_rows(findings: DataFrame) -> DataFrame:
    tier = F.coalesce(F.get_json_object("evidence", "$.evidence_tier"), F.lit("unstated"))
    rows = findings.select("trace_id", "pattern_code", "step_name", tier.alias("tier"), F.format_string("%.0f%%", F.col("confidence") * 100).alias("percent"), "explanation", "confidence")
    # Dealt first: the sort samples its input, and would run the detectors again for that.
    return rows.repartition("trace_id").orderBy(F.desc("confidence"), "trace_id", "pattern_code", "step_name").drop("confidence")


def redact_findings(findings: DataFrame) -> DataFrame:
    """Explanations and the texts in the evidence; numbers, names and steps stay."""
    return findings.withColumns({"explanation": redact(F.col("explanation")), "evidence": redact_json(F.col("evidence"))})


def write_findings(findings: DataFrame, path: str) -> None:
    """Redacted, by pattern: later reads of one pattern skip the others."""
    redact_findings(findings).write.mode("overwrite").partitionBy("pattern_code").parquet(path)


def evidence_link(findings: DataFrame, screenshots: DataFrame) -> DataFrame:
    """The screenshot of the first step that a finding names."""
    at = findings.withColumn("__step", F.split("step_name", " -> ")[0])
    return at.join(screenshots.select("trace_id", F.col("step_name").alias("__step"), "path").hint("merge"), ["trace_id", "__step"], "left").drop("__step").withColumn("has_screenshot", F.col("path").isNotNull())


def summary_json(states: DataFrame, findings: DataFrame) -> DataFrame:
    """(trace_id, json): each trace's verdict, number of findings and codes, as one JSON text."""
    codes = findings.groupBy("trace_id").agg(F.sort_array(F.collect_set("pattern_code")).alias("codes"))
    got = run_verdict(states, findings).join(codes.hint("merge"), "trace_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    return got.select("trace_id", F.to_json(F.struct("verdict", F.col("n").alias("findings"), "codes")).alias("json"))


def write_summary_json(states: DataFrame, findings: DataFrame, path: str) -> None:
    summary_json(states, findings).write.mode("overwrite").json(path)
