"""Golden funnels, near misses, value tables, finding operators and streaming twins."""

import datetime
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from choicelens.functions import lexicon as lx
from choicelens.functions import text as tx
from choicelens.operators import detectors as d
from choicelens.operators import discovery as w
from choicelens.operators import findings as r
from choicelens.plans import queries as q
from choicelens.plans.bridge import as_states
from choicelens.plans.captures import Captures
from choicelens.sources import html
from choicelens.streaming import ops as t


def cap(spark, rows, gone=None):
    """rows: dicts of a state's columns; absent ones take their defaults."""
    full = [{"trace_id": 1, "step_name": f"s{i}", "step_ord": i, "capture_no": 0} | x for i, x in enumerate(rows)]
    raw = spark.read.schema(spark.createDataFrame([], __import__("choicelens.plans.captures", fromlist=["STATES"]).STATES).schema).json(spark.sparkContext.parallelize([json.dumps(x) for x in full]))
    kept = set().union(*full)
    return Captures(as_states(raw.select(*kept)), spark.createDataFrame(gone, "trace_id long, step_name string, signature string") if gone else None)


def codes(df):
    return sorted((x.pattern_code, x.step_name) for x in df.collect())


def test_money(spark):
    cases = {"₹ 6,530": 6530, "Rs. 5,065": 5065, "INR 1,465": 1465, "6,530/-": 6530, "₹ 12,34,567": 1234567, "₹ 1,299.50": 1299.5, "US$ 1,299": 1299, "€40": 40, "19.99 USD": 19.99, "500 INR": 500, "SNEAKERS 55": None, "93% on time": None, "Tee$19.99": 19.99}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", tx.amount(F.col("s")).alias("a"), tx.money_mark(F.col("s")).alias("m")).collect()
    assert {x.s: x.a for x in got} == cases
    assert {x.s: x.m for x in got}["US$ 1,299"] == "US$"


def test_contrast(spark):
    pairs = [("#fff", "#000", 21.0), ("rgb(204,204,204)", "rgb(240,240,240)", 1.42), ("#ffffff", "rgba(0, 0, 0, 0)", 1.91)]
    got = spark.createDataFrame(pairs, "f string, b string, w double").select(tx.contrast(F.col("f"), F.col("b")).alias("c"), "w").collect()
    assert all(abs(x.c - x.w) < 0.06 for x in got)


def test_drip_pricing(spark):
    first = {"price": 299.0, "full_text": "Phone Case ₹299"}
    last = {"price": 299.0, "full_text": "Phone Case\nTotal: ₹457", "line_items": [{"name": "Phone Case", "price": 299.0}, {"name": "Protection", "price": 49.0}, {"name": "Fee", "price": 109.0}]}
    e = d.detect_drip_pricing(cap(spark, [first, last])).collect()
    assert len(e) == 1 and json.loads(e[0].evidence)["hidden_amount"] == 158.0 and e[0].confidence == 1.0
    for silent in ([first | {"full_text": "Phone Case ₹299, in all ₹457 with Protection"}, last], [first, last | {"full_text": "Phone Case ₹457"}], [first | {"full_text": "Phone Case, Protection, Fee"}, last]):
        assert d.detect_drip_pricing(cap(spark, silent)).count() == 0


def test_urgency(spark):
    def pair(a, b):
        c = cap(spark, [{"step_name": "p", "full_text": a}, {"step_name": "p", "full_text": b, "capture_no": 1}])
        return [(x.tier, x.confidence) for x in d.detect_fake_urgency(c).collect()]

    assert pair("Offer ends in: 00:04:59. Hurry!", "Offer ends in: 00:04:59. Hurry!") == [("corroborated", 0.9)]
    assert pair("Hurry! Only 2 left in stock!", "Hurry! Only 2 left in stock!") == [("indicative", 0.6)]
    for a, b in [("In stock: 42 units", "In stock: 42 units"), ("Sale ends Sunday. Hurry", "Sale ends Sunday. Hurry"), ("Offer ends in 00:04:59", "Offer ends in 00:04:10"), ("Hurry while stocks last", "Hurry while stocks last")]:
        assert pair(a, b) == []


def test_flow(spark):
    box = lambda label, **x: {"id": "i", "label_text": label, "checked": True, "is_prechecked": True, "input_type": "checkbox", "required": False} | x
    c = cap(spark, [{"checkboxes": [box("Insurance for ₹49"), box("billed monthly, renews automatically", id="j"), box("Remember me", id="k"), box("marketing emails", id="m", required=True, is_prechecked=False), box("delivery partners may call, I acknowledge", id="n", required=True, is_prechecked=False)], "line_items": [{"name": "", "price": 5.0}]}] * 2)
    assert codes(d.detect_basket_sneaking(c)) == [("DP-02", "s0")]
    assert codes(d.detect_saas_billing(c)) == [("DP-12", "s0")]
    assert codes(d.detect_forced_consent(c)) == [("DP-04", "s0"), ("DP-04", "s1")]
    wall = lambda sig, **x: {"signature": sig, "text": "Sign up to continue", "is_blocking": True, "viewport_coverage": 0.9, "dismiss_controls": [], "contents_unreadable": False} | x
    c = cap(spark, [{"modals": [wall("a")]}, {"modals": [wall("a", dismiss_controls=["Close"])]}, {"modals": [wall("b", contents_unreadable=True)]}], [(1, "s0", "a")])
    assert codes(d.detect_inescapable_overlay(c)) == [("DP-04", "s0")]
    assert codes(d.detect_nagging(c)) == [("DP-10", "s1")]
    button = lambda text, role="neutral": {"text": text, "role": role}
    c = cap(spark, [{"step_name": "offer", "role": "signup", "buttons": [button("Start free trial")], "full_text": "Great offer"}, {"step_name": "pay", "full_text": "renews: auto-renewal, monthly"}, *[{"step_name": f"c{i}", "role": "cancel"} for i in range(4)]])
    assert ("DP-05", "offer -> pay") in codes(d.detect_late_recurring_disclosure(c))
    assert d.detect_path_asymmetry(c).count() == 1 and d.detect_missing_cancel_route(c).count() == 0
    c = cap(spark, [{"buttons": [button("Subscribe")], "full_text": "our newsletter"}, {"full_text": "subscription"}])
    assert d.first_commitment_state(c).count() == 0 and d.detect_missing_cancel_route(c).count() == 0
    c = cap(spark, [{"full_text": "My Account: Was ₹4999 Now only ₹199!", "price": 199.0, "buttons": [button("Buy for ₹4999")], "links": [{"text": "Watch in HD", "href": "/player-setup.exe?x"}, {"text": "Download the installer", "href": "/a.exe"}]}, {"price": 6499.0, "modals": [wall("z", text="3 threats detected! Scan now")]}])
    assert [x[0] for x in codes(d.run_layer1(c))] == ["DP-07", "DPAF-OB-IA", "DPAF-SN-RP"]
    assert codes(d.detect_rogue_alert(c)) == [("DP-13", "s1")] and d.detect_disguised_executable(c).count() == 1


def test_language(spark):
    text = "No, I don’t want to save money. Uncheck this box if you do not wish to receive offers"
    c = cap(spark, [{"full_text": text, "buttons": [{"text": "No, I don’t want to save money", "role": "decline"}, {"text": "No thanks, continue", "role": "decline"}], "checkboxes": [{"id": "a", "label_text": "Uncheck this box if you do not wish to receive offers", "is_prechecked": True}]}])
    verdicts = spark.createDataFrame([(1, 0, "DP-03", "save money", "high"), (1, 0, "DP-03", "not on the page", "1"), (1, 0, "XX", "save", "1"), (1, 0, "", "box", "NaN")], "trace_id long, step_ord int, pattern_code string, quoted_text string, confidence string")
    got = d.run_layer3(c, verdicts).collect()
    assert sorted((x.pattern_code, x.confidence) for x in got) == [("DP-03", 0.6), ("DP-03", 0.6), ("DP-03", 0.6), ("DP-11", 0.7)]


def test_audit_is_clean_on_clean_and_stable(spark):
    c = cap(spark, [{"full_text": "A shop. Price ₹299", "price": 299.0, "buttons": [{"text": "Continue", "role": "accept", "font_size_px": 14.0, "contrast_ratio": 9.0}]}, {"full_text": "Total: ₹299", "price": 299.0}], [(1, "s0", "x")])
    assert d.audit(c).count() == 0
    cs = q.b.customer_controls(spark, "/root/testdata/sf0.001")
    one = codes(d.audit(cs))
    assert one and one == codes(d.audit(Captures(cs.all_states.repartition(7))))
    assert r.tier_cap_check(d.audit(cs)).count() == 0


def test_findings(spark):
    f = spark.createDataFrame([(1, "DP-08", 1.0, "provable"), (2, "DP-01", 0.99, "corroborated"), (3, "??", 0.9, None)], "trace_id long, pattern_code string, confidence double, tier string")
    assert [x.confidence for x in r.clamp_confidence(f).orderBy("trace_id").collect()] == [1.0, 0.9, 0.6]
    assert r.tier_cap_check(f.na.fill("indicative")).count() == 2
    assert sorted((x.trace_id, x.change) for x in r.run_diff(f.where("trace_id < 3"), f.where("trace_id > 1"), ["trace_id"]).collect()) == [(1, "disappeared"), (3, "appeared")]
    assert r.false_positive_rate(f, spark.range(1, 5).withColumnRenamed("id", "trace_id")).first().rate == 0.75
    assert r.cases_for_findings(f, spark.createDataFrame([("c", ["DP-08", "DP-01"])], "case_id string, pattern_codes array<string>")).count() == 2
    assert r.crosswalk_findings(f, spark.createDataFrame([("DP-08", ["A", "B"])], "pattern_code string, other_codes array<string>")).count() == 4


def test_redaction(spark):
    s = "mail a.b@c.in, PAN ABCDE1234F, call +91 98765 43210, pincode: 560001, id 1234 5678 9012"
    out = tx.redact_table(spark.createDataFrame([(s,), (None,)], "t string"), ["t"]).collect()
    assert out[0].t == "mail [EMAIL_REDACTED], PAN [ID_REDACTED], call [PHONE_REDACTED], pincode: 560001, id [ID_REDACTED]".replace("pincode: 560001", "[POSTAL_REDACTED]")
    assert out[1].t is None


def test_discovery_and_html(spark):
    c = spark.createDataFrame([(1, 0, "Pay now", 9), (1, 1, "View details", 2), (2, 0, "Add to cart", 3), (3, 0, "Checkout now", None)], "page_id long, control_ord int, text string, target_page_id long")
    got = w.discovery_report(w.discover_funnels(spark.createDataFrame([(1,)], "page_id long"), c)).first()
    assert (got.reached, got.skipped, got.page_id) == (["product", "cart"], ["checkout", "order_summary"], 3)
    assert [x.matched for x in w.forbidden_controls(c).collect()] == ["pay"]
    page = '<title>T</title><script>x<a href="no"></script><a href="/b">Go <b>on</b></a><input type=checkbox id=k checked><label for=k>Add cover</label><button class="btn accept">Yes</button><div data-name="Tea" data-price="3.5">Tea<script type="application/ld+json">{"offers":{"price":"7"}}</script>'
    s = html.extract_states(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "<a <<>")], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert s[0].links == [("Go on", "/b")] and s[0].checkboxes[0].label_text == "Add cover" and s[0].buttons[0].role == "accept" and s[0].schema_price == "7.0" and s[0].line_items == [("Tea", 3.5)]
    assert s[1].full_text == "" and len(s) == 3


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start().awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(t.live_pattern_counts(stream(), "event_type"), "live", "complete") == sorted(map(tuple, t.live_pattern_counts(e, "event_type").collect()))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", t.STATE_STORE)
    got = run(t.first_price_stream(stream().selectExpr("user_id AS key", "ts", "event_id", "value AS price")), "drip", "append")
    want = t.first_price_drip(e.withColumn("day", F.lit(1)), "user_id", "value").select("user_id", "event_id", "value", "first_price")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == sorted(map(tuple, want.collect()))


def test_admission(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("user_id % 5 AS key", "ts", "event_id")
    rows = sorted(e.collect(), key=lambda x: (x.key, x.ts, x.event_id))
    want, taken = {}, {}
    for x in rows:
        past = [y for y in taken.get(x.key, []) if y > x.ts - datetime.timedelta(hours=20)]
        want[(x.key, x.event_id)] = len(past) < 3
        taken[x.key] = [*past, x.ts] if len(past) < 3 else past
    got = {(x.key, x.event_id): x.admitted for x in t.admit_events(e, 3, 20 * 3600.0).collect()}
    assert got == want and not all(got.values())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) & set(q.ORACLES)))
def test_oracle(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = __spark_entry__.queries()[name](spark, sf)
    cols = sorted(found.columns)
    value = lambda v: round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v
    ours = sorted(str([value(x[c]) for c in cols]) for x in found.collect())
    c = con.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == cols
    assert ours == sorted(str([value(dict(zip(names, x, strict=True))[k]) for k in cols]) for x in c.fetchall())


def test_lists():
    assert [len(x) for x in (lx.RECURRING, lx.UNRELATED_CONSENT, lx.LAWFUL_CONTEXT, lx.SYSTEM_ALERT, lx.URGENCY, lx.GUILT, lx.NEVER_CLICK)] == [13, 16, 11, 11, 20, 16, 20]
