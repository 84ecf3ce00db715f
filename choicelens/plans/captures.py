"""Captured funnels as tables, and findings as rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import lexicon as lx

STATES = """trace_id bigint, site_name string, step_ord int, step_name string, capture_no int, url string, role string, price double,
price_source string, price_currency string, full_text string, raw_html string, urgency_hits array<string>,
line_items array<struct<name:string,price:double>>,
checkboxes array<struct<id:string,label_text:string,checked:boolean,is_prechecked:boolean,input_type:string,required:boolean>>,
buttons array<struct<text:string,role:string,bbox:struct<x:double,y:double,width:double,height:double>,font_size_px:double,bg_color:string,text_color:string,contrast_ratio:double>>,
disclosure_labels array<struct<text:string,font_size_px:double,contrast_ratio:double>>,
modals array<struct<signature:string,text:string,is_blocking:boolean,viewport_coverage:double,dismiss_controls:array<string>,contents_unreadable:boolean>>,
links array<struct<text:string,href:string,font_size_px:double,contrast_ratio:double>>,
form_fields array<struct<name:string,label_text:string,field_type:string,required:boolean>>"""
DISMISSALS = "trace_id bigint, step_name string, signature string"
FINDING = ["trace_id", "step_name", "pattern_code", "pattern_name", "layer", "tier", "confidence", "evidence", "explanation", "detector_ord", "step_ord", "elem_ord"]


#: Versions of the capture schema that this reader knows; version 1 called a state's text `text`.
VERSIONS = (1, 2)


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(states, quarantine) of captures in JSON lines, or in another format of the capture schema; order comes from step_ord,
    never from the files. What can't be used is in the quarantine, with the reason, and no row is in both or in neither."""
    if fmt == "json":
        return parse_captures(spark.read.text(path))
    rows = spark.read.schema(f"schema_version int, {STATES}").format(fmt).load(path)
    return _sorted_out(rows.withColumn("schema_version", F.coalesce("schema_version", F.lit(VERSIONS[-1]))), F.to_json(F.struct("*")))


def parse_captures(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, quarantine) of JSON texts (value). quarantine: (value, reason). A line without a version is of the latest one;
    unknown fields are ignored, blank lines are no captures."""
    schema = f"schema_version int, text string, {STATES}, _broken string"
    at = lines.where(F.trim("value") != "").select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}).alias("c"))
    rows = at.select("value", "c.*").withColumn("schema_version", F.coalesce("schema_version", F.lit(VERSIONS[-1])))
    rows = rows.withColumn("full_text", F.when(F.col("schema_version") == 1, F.coalesce("full_text", "text")).otherwise(F.col("full_text")))
    return _sorted_out(rows, F.col("value"))


def _sorted_out(rows: DataFrame, value: Column) -> tuple[DataFrame, DataFrame]:
    broken = F.col("_broken").isNotNull() if "_broken" in rows.columns else F.lit(False)
    reason = (
        F.when(broken, "not readable").when(~F.col("schema_version").isin(*VERSIONS), "unknown version").when(F.col("trace_id").isNull(), "no trace")
        .when(F.col("step_ord").isNull(), "no place in the trace").when(~F.coalesce("capture_no", F.lit(0)).isin(0, 1), "no first or second capture")
    )
    rows = rows.withColumn("reason", reason)
    names = [f.name for f in StructType.fromDDL(STATES).fields]
    good = rows.where("reason IS NULL").withColumn("capture_no", F.coalesce("capture_no", F.lit(0))).select(names)
    return good, rows.where("reason IS NOT NULL").select(value.alias("value"), "reason")


@dataclass
class Captures:
    """States (first captures and reloads) and the children that detectors share, each built on first use."""

    all_states: DataFrame
    dismissals: DataFrame | None = None
    #: Columns of the states that the source fills; all of them, if it doesn't say.
    given: frozenset[str] | None = None

    def has(self, column: str) -> bool:
        return self.dismissals is not None if column == "dismissals" else self.given is None or column in self.given

    @cached_property
    def states(self) -> DataFrame:
        return self.all_states.where("capture_no = 0")

    @cached_property
    def reloads(self) -> DataFrame:
        return self.all_states.where("capture_no = 1")

    def child(self, name: str, *more: str) -> DataFrame:
        """One row per element of an array column: (trace_id, step_ord, step_name, elem_ord, e, …)."""
        return self.states.select("trace_id", "step_ord", "step_name", *more, F.posexplode(name).alias("elem_ord", "e"))


def clamp(confidence: Column, tier: Column) -> Column:
    """A tier caps what may be claimed; an unknown tier counts as indicative."""
    cap = F.when(tier == "provable", lx.CAPS["provable"]).when(tier == "corroborated", lx.CAPS["corroborated"]).otherwise(lx.CAPS["indicative"])
    return F.round(F.least(confidence, cap), 2)


def findings(df: DataFrame, code: str, ord_: int, tier: str | Column, confidence: float | Column, explanation: Column, evidence: dict[str, Column], layer: int = 1, name: str | None = None, step: Column | None = None) -> DataFrame:
    """df's rows as findings; df has trace_id, step_ord, step_name, elem_ord."""
    tier = F.lit(tier) if isinstance(tier, str) else tier
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    ev = F.to_json(F.struct(tier.alias("evidence_tier"), *[c.alias(k) for k, c in evidence.items()]), {"ignoreNullFields": "false"})
    return df.select(
        "trace_id", (F.col("step_name") if step is None else step).alias("step_name"), F.lit(code).alias("pattern_code"), F.lit(name or lx.PATTERNS[code][0]).alias("pattern_name"),
        F.lit(layer).alias("layer"), tier.alias("tier"), clamp(confidence, tier).alias("confidence"), ev.alias("evidence"), explanation.alias("explanation"),
        F.lit(ord_).alias("detector_ord"), "step_ord", F.col("elem_ord").cast("int").alias("elem_ord"))
