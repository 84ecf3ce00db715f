"""Funnel discovery over tables of controls: (page_id, control_ord, text, target_page_id).

Null texts are no controls, null targets lead nowhere, ties go to the earlier control, repeated controls count once, and
empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import first_match, hits, java, redact, resolve_url, screen_url, url_host, url_key


def page_controls(states: DataFrame) -> DataFrame:
    """Controls of read pages (page_id, url, links, buttons): (page_id, control_ord, text, href, target_page_id).

    A link's href is resolved against its page and leads to the page that has the same url_key, the least page_id of several; links that
    leave the table and buttons lead nowhere. Links come first, in their order. A page that all others link to is one row of
    the index, so a hot target's links can be split."""
    none = F.array().cast("array<struct<text:string,href:string>>")
    buttons = F.transform(F.coalesce("buttons", F.array().cast(states.schema["buttons"].dataType)), lambda x: F.struct(x["text"].alias("text"), F.lit(None).cast("string").alias("href")))
    links = F.transform(F.coalesce("links", F.array().cast(states.schema["links"].dataType)), lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href")))
    at = states.select("page_id", "url", F.posexplode(F.concat(none, links, buttons)).alias("control_ord", "c")).select("page_id", "control_ord", "c.text", "c.href", url_key(resolve_url(F.col("c.href"), F.col("url"))).alias("key"))
    index = states.select(url_key(F.col("url")).alias("key"), "page_id").where("key IS NOT NULL").groupBy("key").agg(F.min("page_id").alias("target_page_id"))
    return at.join(index.hint("merge"), "key", "left").select("page_id", "control_ord", "text", "href", "target_page_id")


def forbidden_controls(controls: DataFrame) -> DataFrame:
    """Controls that a crawl must never click, with the words that say so; once per page and text."""
    low = F.lower(F.trim("text"))
    df = controls.where(F.length("text") <= 60).withColumn("matched", first_match(low, lx.NEVER_CLICK)).where("matched IS NOT NULL")
    w = Window.partitionBy("page_id", low).orderBy("control_ord")
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def next_controls(controls: DataFrame, patterns: list[str]) -> DataFrame:
    """Each page's control for a stage: first by intent, then by place; short and not forbidden."""
    low = F.lower(F.trim("text"))
    intent = reduce(lambda e, ip: F.when(low.rlike(java(ip[1])), F.lit(ip[0])).otherwise(e), reversed([*enumerate(patterns)]), F.lit(None).cast("int"))
    df = controls.where((F.length("text") <= 60) & ~hits(low, lx.NEVER_CLICK)).withColumn("intent", intent).where("intent IS NOT NULL")
    return df.groupBy("page_id").agg(F.min_by(F.struct("text", "target_page_id"), F.struct("intent", "control_ord")).alias("c")).select("page_id", "c.text", "c.target_page_id")


def discover_funnels(starts: DataFrame, controls: DataFrame) -> DataFrame:
    """(start, page_id at the end, reached, skipped): four bounded joins; a stage without a control that leads on is skipped.

    Each page is walked from once, however many starts name it. controls are read once for each stage: hand over a written table
    where they come from parsed pages."""
    walked = starts.select("page_id").distinct()
    df = walked.select(F.col("page_id").alias("start"), "page_id", F.array().cast("array<string>").alias("reached"), F.array().cast("array<string>").alias("skipped"))
    for name, patterns in lx.STAGES:
        step = next_controls(controls, patterns).where("target_page_id IS NOT NULL").select("page_id", "target_page_id")
        df = df.join(step.hint("merge"), "page_id", "left")
        found = F.col("target_page_id").isNotNull()
        df = df.select("start", F.coalesce("target_page_id", "page_id").alias("page_id"), F.when(found, F.array_append("reached", F.lit(name))).otherwise(F.col("reached")).alias("reached"), F.when(found, F.col("skipped")).otherwise(F.array_append("skipped", F.lit(name))).alias("skipped"))
    return starts.select(F.col("page_id").alias("start")).join(df.hint("merge"), "start")


def discovery_report(found: DataFrame, pages: DataFrame | None = None, refused: DataFrame | None = None) -> DataFrame:
    """Add a note on what was not reached. pages (page_id, full_text) tells near-empty start pages, refused (page_id, …) pages
    with controls that must not be clicked; each may be left out."""
    flags = [F.lit(False).alias("empty"), F.lit(False).alias("refused")]
    if pages is not None:
        empty = pages.where(F.char_length(F.trim(F.coalesce("full_text", F.lit("")))) < 200).select(F.col("page_id").alias("start"), F.lit(True).alias("empty")).distinct()
        found, flags[0] = found.join(empty.hint("merge"), "start", "left"), F.coalesce("empty", F.lit(False)).alias("empty")
    if refused is not None:
        no = refused.select(F.col("page_id").alias("start"), F.lit(True).alias("refused")).distinct()
        found, flags[1] = found.join(no.hint("merge"), "start", "left"), F.coalesce("refused", F.lit(False)).alias("refused")
    found = found.select(*[c for c in found.columns if c not in ("empty", "refused")], *flags)
    one = F.when(F.col("refused"), "Only the first page was seen: what leads on must not be clicked.").otherwise("Only the first page was seen.")
    reach = F.when(F.size("reached") == 0, one).when(F.size("skipped") > 0, F.concat(F.lit("Not reached: "), F.array_join("skipped", ", "))).otherwise("All stages reached.")
    return found.withColumn("note", F.concat_ws(" ", F.when(F.col("empty"), "The page held almost no text."), reach)).drop("empty", "refused")


def write_discovery(found: DataFrame, path: str) -> None:
    """One JSON object a start: stages reached and not found, and the redacted note."""
    found.select("start", F.col("reached").alias("stages_reached"), F.col("skipped").alias("stages_not_found"), redact(F.col("note")).alias("note")).write.mode("overwrite").json(path)


def blocked_targets(links: DataFrame) -> DataFrame:
    """(host, reason) of links (href) that a crawl may not follow, once per host; inert schemes are no targets."""
    df = links.where(~F.lower("href").rlike("^(data|blob|about|javascript):")).select(url_host(F.col("href")).alias("host"), screen_url(F.col("href")).alias("reason"))
    return df.where("reason IS NOT NULL").groupBy("host").agg(F.min("reason").alias("reason"))
