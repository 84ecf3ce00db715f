"""Capture tables derived from the order, customer, supplier, event and part tables by fixed column rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .captures import STATES, Captures

LABELS = [
    "Add gift wrap for ₹49", "Travel insurance", "Premium plan, billed monthly", "Send me marketing emails", "I acknowledge that delivery partners may call",
    "Do not send me order updates", "Uncheck this box if you do not wish to receive offers", "Remember me", "Share my data with partners", "Auto-renew my subscription",
    "Order protection", "I have read the privacy policy of our partners",
]
DECLINES = ["No thanks", "No, I don't want to save money", "Continue", "I'll risk it", "Skip for now", "I prefer to pay full price", "Decline", "Not interested in saving"]
EMPTY = {"price": "double", "full_text": "string", "raw_html": "string", "role": "string", "price_currency": "string"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A narrow table's rows by a key that few of them share, over all shuffle partitions. A table of few bytes comes in one or two row groups,
    and as many tasks would do all the work on what is derived from its rows; aggregations by that key then need no other shuffle.
    The number is given, as a small shuffle would be joined into few tasks again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _one(f: Callable) -> Callable[[Column], Column]:
    """f as a function of one argument, as transform() wants it."""
    return lambda e: f(e)


def captures(df: DataFrame, dismissals: DataFrame | None = None) -> Captures:
    return Captures(as_states(df), dismissals, frozenset(df.columns))


def as_states(df: DataFrame) -> DataFrame:
    """Fill up to the capture schema: absent strings are '', absent arrays empty, absent numbers null."""
    out = []
    for f in StructType.fromDDL(STATES):
        if f.name in df.columns and f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct" and len(df.schema[f.name].dataType.elementType) < len(f.dataType.elementType):
            have = {x.name for x in df.schema[f.name].dataType.elementType}
            whole = lambda e, have=frozenset(have), of=f.dataType.elementType: F.struct(*[(e[x.name] if x.name in have else F.lit(None)).cast(x.dataType).alias(x.name) for x in of])
            out.append(F.transform(F.col(f.name), _one(whole)).alias(f.name))
        elif f.name in df.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.dataType.typeName() == "array":
            out.append(F.array().cast(f.dataType).alias(f.name))
        else:
            out.append((F.lit("") if f.dataType.typeName() == "string" else F.lit(0 if f.name in ("capture_no", "step_ord") else None)).cast(f.dataType).alias(f.name))
    return df.select(*out)


def pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def money(cents: Column) -> Column:
    return F.concat(F.lit("₹"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def order_funnels(spark: SparkSession, sf_dir: str) -> Captures:
    """A listing and a checkout of each order: the checkout may add a fee, leave out the total, or not itemise it."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Item "), F.translate(F.col("l_partkey").cast("string"), "0123456789", "abcdefghij")).alias("name"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    per = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "name", "c"))).alias("i"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("c").alias("s"))
    o = table(spark, sf_dir, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    o = o.withColumns({"all": F.col("s") + F.when(urgent, 6000).otherwise(0), "names": F.transform("i", lambda x: x["name"])})
    first = F.concat_ws("\n", F.concat_ws("\n", "names"), F.when(F.col("o_custkey") % 3 == 0, "Platform Fee applies"), F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("Total: "), money(F.col("all")))))
    last = F.when(F.col("o_orderkey") % 11 == 0, "Your order").when(F.col("o_orderkey") % 7 == 0, "Order summary").otherwise(F.concat(F.lit("Total: "), money(F.col("all"))))
    items = F.transform("i", lambda x: F.struct(x["name"].alias("name"), (x["c"] / 100).alias("price")))
    items = F.when(urgent, F.array_append(items, F.struct(F.lit("Platform Fee").alias("name"), F.lit(60.0).alias("price")))).otherwise(items)
    none = F.array().cast("array<struct<name:string,price:double>>")
    step = lambda n, name, price, text, rows: F.struct(F.lit(n).alias("step_ord"), F.lit(name).alias("step_name"), (price / 100).alias("price"), text.alias("full_text"), rows.alias("line_items"))
    both = o.select(F.col("o_orderkey").alias("trace_id"), F.explode(F.array(step(1, "listing", F.col("lo"), first, none), step(2, "checkout", F.col("hi"), last, items))).alias("x"))
    return captures(both.select("trace_id", "x.*", F.lit("₹").alias("price_currency")))


def customer_controls(spark: SparkSession, sf_dir: str) -> Captures:
    """One checkbox of each customer, the same on three steps."""
    label = pick(LABELS, F.col("c_custkey"))
    box = F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), label.alias("label_text"), (F.col("c_custkey") % 2 == 0).alias("checked"), (F.col("c_custkey") % 2 == 0).alias("is_prechecked"), F.lit("checkbox").alias("input_type"), (F.col("c_custkey") % 3 == 0).alias("required"))
    df = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("trace_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step_ord"), F.array(box).alias("checkboxes"), label.alias("full_text"))
    return captures(df.withColumn("step_name", F.concat(F.lit("step_"), "step_ord")))


def supplier_buttons(spark: SparkSession, sf_dir: str) -> Captures:
    """An accept and a decline button of each supplier; every fourth accept button names a price, which the next page may not charge."""
    k = F.col("s_suppkey")
    button = lambda text, role, w, h, font, contrast: F.struct(text.alias("text"), F.lit(role).alias("role"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), w.cast("double").alias("width"), h.cast("double").alias("height")).alias("bbox"), font.cast("double").alias("font_size_px"), F.lit("").alias("bg_color"), F.lit("").alias("text_color"), contrast.cast("double").alias("contrast_ratio"))
    yes = button(F.when(k % 4 == 0, F.concat(F.lit("Buy now for ₹"), (k * 10).cast("string"))).otherwise(F.lit("Accept")), "accept", 80 + k % 5 * 20, F.lit(40), 14 + k % 3 * 4, F.lit(9))
    no = button(pick(DECLINES, k), "decline", 60 + k % 7 * 10, F.lit(30), 10 + k % 5 * 2, 1 + k % 6)
    df = dealt(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select(k.alias("trace_id"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("step_ord"), yes.alias("yes"), no.alias("no"), pick(DECLINES, k).alias("full_text"), k.alias("k"))
    df = df.withColumns({"step_name": F.concat(F.lit("step_"), "step_ord"), "buttons": F.when(F.col("step_ord") == 1, F.array("yes", "no")).otherwise(F.array().cast(df.select(F.array("yes")).schema[0].dataType)), "price": F.when(F.col("step_ord") == 2, F.col("k") * 10.0 + F.col("k") % 3 * 5)})
    return captures(df)


def event_overlays(spark: SparkSession, sf_dir: str) -> Captures:
    """Each event of a user shows an overlay; clicks dismiss it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumns({"step_ord": F.row_number().over(w), "sig": F.concat(F.lit("text:get "), (F.col("event_id") % 3).cast("string"), F.lit("#% off"))})
    e = e.withColumn("step_name", F.concat(F.lit("step_"), "step_ord"))
    modal = F.struct(F.col("sig").alias("signature"), F.lit("Sign up to get a discount").alias("text"), (F.col("event_type") != "view").alias("is_blocking"), F.least(F.col("value") / 400, F.lit(1.0)).alias("viewport_coverage"), F.when(F.col("event_type") == "click", F.array(F.lit("Close"))).otherwise(F.array().cast("array<string>")).alias("dismiss_controls"), F.lit(False).alias("contents_unreadable"))
    states = e.select(F.col("user_id").alias("trace_id"), "step_ord", "step_name", F.array(modal).alias("modals"))
    return captures(states, e.where("event_type = 'click'").select(F.col("user_id").alias("trace_id"), "step_name", F.col("sig").alias("signature")))


def part_reloads(spark: SparkSession, sf_dir: str) -> Captures:
    """Urgency texts of each part and what a reload shows: the same, less or more."""
    k, n = F.col("p_partkey"), F.col("p_size")
    clock = lambda s: F.concat(F.lit("Offer ends in: 00:"), F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    move = F.when(k % 3 == 0, 0).when(k % 3 == 1, -1).otherwise(1)
    text = lambda d: F.when(k % 4 == 0, F.concat(F.lit("Hurry! Only "), (n + 5 + d).cast("string"), F.lit(" left"))).when(k % 4 == 1, clock(n * 20 + 60 + d)).when(k % 4 == 2, F.lit("Sale ends Sunday. Hurry while stocks last")).otherwise(F.concat(F.lit("In stock: "), n.cast("string"), F.lit(" units")))
    df = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("trace_id"), F.lit("item").alias("step_name"), F.lit(1).alias("step_ord"), F.explode(F.array(F.struct(F.lit(0).alias("capture_no"), text(F.lit(0)).alias("full_text")), F.struct(F.lit(1).alias("capture_no"), text(move).alias("full_text")))).alias("x"))
    return captures(df.select("trace_id", "step_name", "step_ord", "x.*"))


def money_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, s): order totals in eight ways of writing, some of which are no money."""
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, cents = F.floor(c / 100).cast("string"), F.lpad((c % 100).cast("string"), 2, "0")
    full = F.concat(whole, F.lit("."), cents)
    ways = [F.concat(F.lit("₹ "), full), F.concat(F.lit("Rs. "), whole), F.concat(F.lit("Pay INR "), full, F.lit(" now")), F.concat(whole, F.lit("/-")), F.concat(F.lit("about "), full, F.lit(" USD")), F.concat(F.lit("SNEAKERS "), whole), F.concat(whole, F.lit("% on time")), F.concat(F.lit("US$ "), full)]
    k = F.col("o_orderkey") % 8
    s = F.lit(None).cast("string")
    for i, way in enumerate(ways):
        s = F.when(k == i, way).otherwise(s)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), s.alias("s"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("site-"), (F.col("o_custkey") % 50).cast("string")).alias("site_name"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("pending").alias("status"), F.col("o_orderdate").alias("created_at"))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("DP-"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("pattern_code"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_partkey").alias("step_id"))
