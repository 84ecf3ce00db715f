"""Extraction jobs: prices, line items, labels and overlays as columns of captured tables.

Null texts have no price and no items; empty arrays stay empty. Rows are read one by one, so repeated rows give repeated
results, and other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import MONEY, amount, hits, java, let, lines, modal_signature, quotes

ITEM = "array<struct<name:string,price:double>>"


def _first_amount(rows: Column) -> Column:
    """The first amount in an array of lines that isn't zero."""
    return F.get(F.filter(F.transform(rows, amount), lambda a: a.isNotNull() & (a != 0)), F.lit(0))


def price_of_lines(rows: Column, text: Column) -> Column:
    """The price that lines state, promises such as free delivery left out; a total first, where the text speaks of one."""
    said = F.filter(rows, lambda x: x.isNotNull() & ~x.rlike(java(lx.PROMO)))
    total = _first_amount(F.filter(said, lambda x: x.rlike(java(lx.TOTAL_WORDS))))
    return F.coalesce(F.when(F.coalesce(text, F.lit("")).rlike(java(lx.TOTAL_WORDS)), total), _first_amount(said))


def resolve_price(df: DataFrame, schema: str = "schema_price", data: str = "data_price", rows: str = "money_rows", text: str = "full_text") -> DataFrame:
    """Add price and price_source: what the page declares (schema_org), what it marks up (data_attribute), what it says (rendered_text), or not_found."""
    declared, marked = F.col(schema).try_cast("double"), F.col(data).try_cast("double")
    seen = F.concat(F.coalesce(rows, F.array().cast("array<string>")), F.filter(F.transform(lines(F.col(text)), lambda x: F.trim(x)), lambda x: x != ""))
    said = price_of_lines(seen, F.col(text))
    source = F.when(declared.isNotNull(), "schema_org").when(marked.isNotNull(), "data_attribute").when(said.isNotNull(), "rendered_text").otherwise("not_found")
    return df.withColumns({"price": F.coalesce(declared, marked, said), "price_source": source})


def _charge(row: Column) -> Column:
    """struct(name, price) of one row, null if it names no charge."""
    label = F.regexp_replace(row, java(lx.PERCENT_BADGE), " ")
    label = F.regexp_replace(label, MONEY, "")
    label = F.regexp_replace(label, java(lx.CURRENCY + r"(?![A-Za-z])"), " ")
    label = F.regexp_replace(label, java(lx.CTA_TAIL), " ")
    label = F.regexp_replace(label, r"\(\s*\)", " ")
    label = F.trim(F.regexp_replace(F.regexp_replace(label, "^[  \t\\-–—:]+|[  \t\\-–—:]+$", ""), "[\\s ]+", " "))
    def named(name: Column, value: Column) -> Column:
        sign = F.when(row.rlike(java(lx.NEGATIVE)), -F.abs(value)).otherwise(value)
        good = (F.char_length(name) <= 60) & name.rlike("[A-Za-z]") & ~F.lower(name).isin(lx.ATTRIBUTE_LABELS) & ~name.rlike(java(lx.TOTAL_WORDS))
        return F.when(good, F.struct(name.alias("name"), sign.alias("price")))

    # The label is made once, and only for rows that state an amount and promise nothing.
    return let(amount(row), lambda value: F.when(value.isNotNull() & ~row.rlike(java(lx.PROMO)), let(label, lambda name: named(name, value))))


def line_items_from_rows(rows: Column) -> Column:
    """Charges among rows that hold a label and an amount, in their order; discounts count negative."""
    return F.coalesce(F.filter(F.transform(rows, _charge), lambda x: x.isNotNull()), F.array().cast(ITEM))


def line_items(df: DataFrame, marked: str = "line_items", rows: str = "money_rows") -> DataFrame:
    """Charges that the page marks up; only where there are none, those its rows state."""
    return df.withColumn(marked, F.when(F.size(F.coalesce(marked, F.array().cast(ITEM))) > 0, F.col(marked)).otherwise(line_items_from_rows(F.col(rows))))


def is_disclosure(text: Column) -> Column:
    """Whether a short label marks an advertisement."""
    text = F.trim(text)
    return F.coalesce(text.rlike(java(lx.DISCLOSURE)) & (F.char_length(text) <= 20), F.lit(False))


def disclosure_labels(labels: Column) -> Column:
    """Of labels (text, font_size_px, contrast_ratio), those that mark an advertisement."""
    return F.filter(labels, lambda x: is_disclosure(x["text"]))


def dismiss_controls(controls: Column) -> Column:
    """Names of controls (text, aria_label) that close something: the text, or the label where there is none; 40 characters at most."""
    name = lambda x: F.trim(F.coalesce(F.nullif(F.trim(x["text"]), F.lit("")), x["aria_label"], F.lit("")))
    return F.filter(F.transform(controls, name), lambda t: (t != "") & (F.char_length(t) <= 40) & hits(t, lx.DISMISS))


def overlays(df: DataFrame) -> DataFrame:
    """Raw overlays (id, class, text, position, z_index, width, height, view_width, view_height, controls, has_frame) to the
    fields of a modal. A sticky or fixed place blocks, an absolute one above the page too; unknown geometry covers nothing."""
    share = F.col("width") * F.col("height") / F.greatest(F.col("view_width") * F.col("view_height"), F.lit(1.0))
    z = F.coalesce(F.col("z_index").try_cast("int"), F.lit(0))
    place = F.coalesce("position", F.lit(""))
    return df.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumns({
        "signature": modal_signature(F.col("id"), F.col("class"), F.col("text")),
        "is_blocking": place.isin("fixed", "sticky") | ((place == "absolute") & (z > 0)),
        "viewport_coverage": F.round(F.when(share.isNull(), 0.0).otherwise(F.least(share, F.lit(1.0))), 3),
        "dismiss_controls": dismiss_controls(F.col("controls")),
        "contents_unreadable": F.coalesce("has_frame", F.lit(True)),
        "text": F.substring("text", 1, 500),
    })


def urgency_hits(text: Column) -> Column:
    """Numbers, in list order, of the urgency expressions that occur."""
    each = [F.when(quotes(text).rlike(java(p)), F.lit(i)) for i, p in enumerate(lx.URGENCY)]
    return F.when(hits(text, lx.URGENCY), F.array_compact(F.array(*each))).otherwise(F.array().cast("array<int>"))


def capture_profile(states: DataFrame) -> DataFrame:
    """What was read on each step: lengths, counts and large blocking overlays, so that an empty page isn't taken for a clean one."""
    n = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0)) if isinstance(c, Column) else F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    ticked = F.when(F.col("checkboxes").isNull(), 0).otherwise(F.size(F.filter("checkboxes", lambda x: F.coalesce(x["is_prechecked"], F.lit(False)))))
    large = F.when(F.col("modals").isNull(), 0).otherwise(F.size(F.filter("modals", lambda m: F.coalesce(m["is_blocking"] & (m["viewport_coverage"] >= 0.1), F.lit(False)))))
    chars = F.char_length(F.coalesce("full_text", F.lit("")))
    return states.select(
        "trace_id", "step_ord", "step_name", chars.alias("chars"), (chars < 200).alias("nearly_empty"), "price", F.coalesce(F.nullif("price_source", F.lit("")), F.lit("not_found")).alias("price_source"),
        n("line_items").alias("items"), n("checkboxes").alias("boxes"), ticked.alias("ticked"), n("buttons").alias("buttons"), large.alias("large_overlays"))
