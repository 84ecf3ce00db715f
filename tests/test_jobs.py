"""Extraction jobs, screening, redaction, sinks and keyed streams on awkward rows; the rest without the llm folders."""

import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from choicelens.functions import lexicon as lx
from choicelens.functions import text as tx
from choicelens.operators import detectors as d
from choicelens.operators import discovery as w
from choicelens.operators import extraction as x
from choicelens.operators import findings as r
from choicelens.plans import bridge as b
from choicelens.plans import captures
from choicelens.plans import journeys as j
from choicelens.sources import committed, html
from choicelens.streaming import ops as t

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_stands_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    shutil.rmtree(copy / "choicelens" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    for name in ("with the pipeline's file", "without it"):
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'audit' in q and 'audit' in o and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
        got = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert got.returncode == 0, (name, got.stderr[-800:])
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


PAGE = """<html><title>Shop</title><body><div class="card"><h2>Blue Top</h2><span>₹ 1,299</span><button>Add to cart</button></div>
<table><tr class="fare"><td>Airline Taxes</td><td>₹ 1,465</td></tr><tr><td>Total</td><td>₹ 2,764</td></tr></table>
<p>Free shipping on orders over ₹500</p><form><label><input type=checkbox checked name=i> Add insurance for ₹99</label>
<input type=radio id=r2 required><label for=r2>Annual plan</label><input name=mail required></form><script>var p = "₹9";</script></body></html>"""


def test_pages_to_findings(spark):
    rows = [(1, "https://a.example/x", PAGE), (2, "https://a.example/y", None), (2, "https://a.example/y", None), (3, None, "<div data-name=Tea data-price=3.5>Tea ₹9</div><script type='application/ld+json'>{\"offers\": {\"price\": \"7\"}}</script>"), (4, "u", "<p>" * 3000 + "₹1")]
    extra = [(*y, "clash", "clash") for y in rows]
    got = html.page_captures(spark.createDataFrame(extra, "page_id long, url string, html string, price string, line_items string"))
    one = {y.trace_id: y for y in got.collect()}
    assert got.count() == 5
    assert (one[1].price, one[1].price_source) == (2764.0, "rendered_text")
    assert [(i.name, i.price) for i in one[1].line_items] == [("Blue Top", 1299.0), ("Airline Taxes", 1465.0), ("Add insurance for", 99.0)]
    assert [(c.label_text, c.is_prechecked) for c in one[1].checkboxes] == [("Add insurance for ₹99", True), ("Annual plan", False)]
    assert (one[3].price, one[3].price_source, one[3].line_items[0].name) == (7.0, "schema_org", "Tea")
    assert one[2].price is None and one[2].price_source == "not_found" and one[2].full_text == ""
    found = d.audit(b.captures(got)).collect()
    assert ("DP-02", 1) in {(f.pattern_code, f.trace_id) for f in found}
    profile = {p.trace_id: p for p in x.capture_profile(b.as_states(got)).collect()}
    assert profile[1].boxes == 2 and profile[1].ticked == 1 and profile[2].nearly_empty and not profile[1].large_overlays


def test_price_and_items(spark):
    one = lambda lines, **k: spark.createDataFrame([(k.get("s"), k.get("d"), lines, "\n".join(lines or []))], "schema_price string, data_price string, money_rows array<string>, full_text string")
    price = lambda df: tuple(x.resolve_price(df).select("price", "price_source").first())
    assert price(one(["Fare ₹100", "Total ₹150"])) == (150.0, "rendered_text")
    assert price(one(["Fare ₹0", "₹ 20"])) == (20.0, "rendered_text")
    assert price(one(["Spend over $75"])) == (None, "not_found") and price(one(None)) == (None, "not_found")
    assert price(one(["₹5"], s="x", d="4")) == (4.0, "data_attribute")
    items = lambda *rows: [tuple(i) for i in spark.createDataFrame([([*rows],)], "rows array<string>").select(x.line_items_from_rows(F.col("rows")).alias("i")).first().i]
    assert items("Cotton Tee$19.99$29.99", "₹89967% off", "Quantity: $19.99", "GST ( ₹ 10 )", "Less: coupon ₹5", None, "") == [("Cotton Tee", 19.99), ("GST", 10.0), ("Less: coupon", -5.0)]
    assert spark.createDataFrame([(None,)], "rows array<string>").select(F.size(x.line_items_from_rows(F.col("rows"))).alias("n")).first().n == 0


def test_overlays(spark):
    rows = [("", "", " Hi 12 ", "absolute", "5", 640.0, 900.0, [("", "Close"), ("x" * 41 + " close", None), ("×", None), ("More", None)], False), (None, None, "Text", None, "auto", None, 900.0, [], None), ("a", "", "  ", "fixed", "1", 1.0, 1.0, [], False)]
    df = spark.createDataFrame(rows, "id string, class string, text string, position string, z_index string, width double, height double, controls array<struct<text:string,aria_label:string>>, has_frame boolean")
    got = x.overlays(df.withColumns({"view_width": F.lit(1280.0), "view_height": F.lit(900.0)})).orderBy("text").collect()
    assert [(o.signature, o.is_blocking, o.viewport_coverage, o.dismiss_controls, o.contents_unreadable) for o in got] == [("text:hi #", True, 0.5, ["Close", "×"], False), ("text:text", False, 0.0, [], True)]
    labels = spark.createDataFrame([([("Ad", 9.0, 3.0), ("Advance", 9.0, 3.0), (None, 9.0, 3.0)],)], "l array<struct<text:string,font_size_px:double,contrast_ratio:double>>")
    assert [y.text for y in labels.select(x.disclosure_labels(F.col("l")).alias("l")).first().l] == ["Ad"]


def test_screen(spark):
    urls = [*zip(j.BAD_URLS, j.BAD_REASONS, strict=True), (None, "empty"), ("   ", "empty"), ("http://a.example/" + "x" * 2050, "too long"), ("HTTP://A.example.", None), ("http://999.1.1.1/", "private address")]
    got = spark.createDataFrame(urls, "u string, why string").select("u", "why", tx.screen_url(F.col("u")).alias("got")).collect()
    assert [(y.u, y.got) for y in got if y.got != y.why] == []


def test_typed_redaction(spark, tmp_path):
    ev = json.dumps({"final_total": 9876543210.0, "a": 1, "mail \"me\"": "x@y.in said \"call 9876543210\" \\ ok", "list": ["b@c.in", 4111111111111111], "none": None})
    rows = [(1, "9876543210 step", "DP-08", "write to a@b.in", ev), (2, "s", "DP-08", None, None)]
    df = spark.createDataFrame(rows, "trace_id long, step_name string, pattern_code string, explanation string, evidence string")
    r.write_findings(df, f"{tmp_path}/f")
    got = {y.trace_id: y for y in spark.read.parquet(f"{tmp_path}/f").collect()}
    e = json.loads(got[1].evidence)
    assert e == {"final_total": 9876543210.0, "a": 1, "mail \"me\"": "[EMAIL_REDACTED] said \"call [PHONE_REDACTED]\" \\ ok", "list": ["[EMAIL_REDACTED]", 4111111111111111], "none": None}
    assert got[1].step_name == "9876543210 step" and got[1].explanation == "write to [EMAIL_REDACTED]" and got[2].evidence is None
    write = t.findings_sink(f"{tmp_path}/sink")
    for _ in range(2):
        write(df, 3)
    assert sorted(y.step_name for y in committed.read_batches(spark, f"{tmp_path}/sink").collect()) == ["9876543210 step", "s"]


def test_redaction_guards(spark):
    """The quick test before a rule lets through all that the rule replaces."""
    texts = ["a@b.co", "4 1 1 1 1 1 1 1 1 1 1 1 1", "12345678-9012", "ABCDE1234F", "+91 9 8 7 6 5 4 3 2 1 0", "09876543210", "PIN: 560001", "Postal Code 560001", "", None, "no data 12 34"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    plain = F.col("s")
    for _, p, mark in lx.REDACTIONS:
        plain = F.regexp_replace(plain, p, mark)
    assert df.where(~plain.eqNullSafe(tx.redact(F.col("s")))).count() == 0
    assert tx.redact_table(df, ["s"]).join(df.select("i", plain.alias("want")), "i").where(~F.col("s").eqNullSafe(F.col("want"))).count() == 0


def test_words_of_patterns(spark):
    """A list with its quick test finds what the bare expressions find."""
    lists = [lx.RECURRING, lx.URGENCY, lx.GUILT, lx.DOUBLE_NEGATIVE, lx.OVERLAY_DEMAND, lx.SYSTEM_ALERT, lx.UNRELATED_CONSENT, lx.DISMISS, lx.NEVER_CLICK]
    texts = [*j.TEXTS, *j.MODALS, *j.BUTTONS, *b.LABELS, *b.DECLINES, *j.NAMES, "AUTO RENEWAL", "auto-renews", "Then $5", "I don’t want it", "ﬁnd", "ſubſcribe", "no, thanks", None, ""]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    for ps in lists:
        bare = F.coalesce(tx.quotes(F.col("s")).rlike("|".join(f"(?:{tx.java(p)})" for p in ps)), F.lit(False))
        assert df.where(bare != tx.hits(F.col("s"), ps)).count() == 0
        assert df.where(bare != tx.first_match(F.col("s"), ps).isNotNull()).count() == 0


def test_findings_tables(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, site_name string")
    v = spark.createDataFrame([(1, "DP-01"), (2, "DP-02"), (None, "DP-03")], "job_id long, pattern_code string")
    left, kept, n = r.delete_audits(jobs, v, spark.createDataFrame([(2,), (9,), (None,)], "id long"))
    assert [left.count(), kept.count()] == [1, 2] and {y.kind: y.n for y in n.collect()} == {"jobs": 2, "violations": 1}
    assert {y.kind: y.n for y in r.purge_all(jobs, v)[2].collect()} == {"jobs": 3, "violations": 2}
    assert r.coverage_summary(v.limit(0)).agg(F.sum("findings")).first()[0] == 0
    jobs = spark.createDataFrame([(i, f"2024-01-{1 + i % 5:02d}") for i in range(9)], "id long, created_at string")
    page = r.list_audits(jobs, v.withColumn("confidence", F.lit(1.0)), 4, 1).collect()
    assert [y.id for y in page] == [y[0] for y in sorted(((i, f"2024-01-{1 + i % 5:02d}") for i in range(9)), key=lambda y: (y[1], y[0]), reverse=True)][1:5]
    for bad in (0, 201):
        with pytest.raises(ValueError):
            r.list_audits(jobs, v, bad)
    states = b.as_states(spark.createDataFrame([(1, "x" * 300, 5.0), (2, "", None)], "trace_id long, full_text string, price double"))
    r.write_summary_json(states, v.selectExpr("job_id AS trace_id", "pattern_code"), f"{tmp_path}/s")
    assert {json.loads(y.json)["verdict"] for y in spark.read.json(f"{tmp_path}/s").collect()} == {"FINDINGS", "INCONCLUSIVE"}


def test_discovery_notes(spark, tmp_path):
    found = spark.createDataFrame([(1, [], ["product"]), (2, ["product"], ["cart"]), (3, ["a"], [])], "start long, reached array<string>, skipped array<string>")
    pages = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y" * 300), (3, None)], "page_id long, full_text string")
    got = {y.start: y.note for y in w.discovery_report(found, pages, spark.createDataFrame([(1,)], "page_id long")).collect()}
    assert got == {1: "The page held almost no text. Only the first page was seen: what leads on must not be clicked.", 2: "Not reached: cart", 3: "The page held almost no text. All stages reached."}
    w.write_discovery(w.discovery_report(found), f"{tmp_path}/d")
    assert spark.read.json(f"{tmp_path}/d").count() == 3


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text('text,label\n"two\nlines, ""quoted""",urgent\nplain,\n')
    assert [tuple(y) for y in html.read_labelled_csv(spark, f"{tmp_path}/l.csv").collect()] == [('two\nlines, "quoted"', "urgent"), ("plain", None)]


def _stream(spark, tmp_path, df, name, run, mode="append"):
    df.repartition(1).write.parquet(f"{tmp_path}/{name}-in")
    out = run(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}-in"))
    out.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}-c").start().awaitTermination()
    return spark.table(name)


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, t.STATE_STORE)
    yield
    spark.conf.unset(key)


def _restarted(spark, tmp_path, df, name, run, parts=4):
    """Rows of a stream over `parts` files in order of time, a micro-batch each, stopped half-way and begun again from its checkpoint."""
    at, order = f"{tmp_path}/{name}", df.select("ts").collect()
    cuts = sorted(x.ts for x in order)
    cuts = [cuts[len(cuts) * i // parts] for i in range(1, parts)]
    part = sum(((F.col("ts") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    for i in range(parts):
        df.where(part == i).repartition(1).write.mode("append").parquet(f"{at}/in")
        if i in (parts // 2 - 1, parts - 1):
            out = run(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"))
            q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
            q.awaitTermination()
            assert len([x for x in q.recentProgress if x["numInputRows"]]) >= parts // 2
    return spark.read.parquet(f"{at}/out"), q


def test_keyed_streams_equal_batches(spark, tmp_path, state_store):
    """First prices, admission and nagging over several micro-batches and a restart say what their batch twins say."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    some = e.selectExpr("IF(user_id % 5 = 4, NULL, user_id % 5 + 4611686018427387905) AS key", "ts", "event_id + 4611686018427387905 AS event_id", "value AS price")
    text = lambda df: sorted(map(str, df.collect()))
    got, _ = _restarted(spark, tmp_path, some.drop("price"), "admit", lambda s: t.admit_stream(s, 3, 20 * 3600.0))
    assert text(got) == text(t.admit_events(some.drop("price"), 3, 20 * 3600.0))
    got, q = _restarted(spark, tmp_path, some, "drip", lambda s: t.first_price_stream(s, ttl=86400 * 400))
    want = t.first_price_drip(some.withColumn("day", F.lit(1)), "key", "price").select("key", "event_id", "price", "first_price")
    assert text(got) == text(want) and got.count() > 100
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] >= 5  # one price for each key
    cap = b.event_overlays(spark, SF)
    step = cap.states.select("trace_id", "step_ord", "step_name", F.col("modals")[0]["signature"].alias("signature")).join(cap.dismissals.select("trace_id", "step_name", F.lit(True).alias("dismissed")), ["trace_id", "step_name"], "left")
    seen = step.select("trace_id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("step_ord"))).alias("ts"), "step_ord", "signature", F.coalesce("dismissed", F.lit(False)).alias("dismissed"))
    got, _ = _restarted(spark, tmp_path, seen, "nag", t.nagging_stream)
    j = lambda k: F.get_json_object("evidence", f"$.{k}")
    first = F.regexp_extract(j("dismissed_at_steps[0]"), r"(\d+)$", 1).cast("int")
    want = d.detect_nagging(cap).select("trace_id", "step_ord", j("modal_signature").alias("signature"), first.alias("first_gone"), j("times_dismissed").cast("long").alias("times"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_state_expires(spark, tmp_path, state_store):
    """A key that is silent for longer than its time starts anew, and its state is gone."""
    rows = [(1, "2024-01-01 00:00:00", 1, 10.0), (2, "2024-01-01 00:01:00", 2, 5.0), (2, "2024-01-01 06:00:00", 3, 5.0), (1, "2024-01-01 12:00:00", 4, 20.0), (1, "2024-01-01 12:00:01", 5, 30.0), (2, "2024-01-02 12:00:00", 6, 1.0)]
    df = spark.createDataFrame(rows, "key long, ts string, event_id long, price double").withColumn("ts", F.col("ts").cast("timestamp"))
    got, q = _restarted(spark, tmp_path, df, "gone", lambda s: t.first_price_stream(s, late="1 minute", ttl=3600), parts=6)
    assert [tuple(x) for x in got.collect()] == [(1, 5, 30.0, 20.0)]


def test_reload_stream_equals_batch(spark, tmp_path):
    say = lambda what, n: {"count": f"Hurry! Only {n} left", "clock": f"Offer ends in: 00:01:{n:02d}", "none": "In stock"}[what]
    rows = [(i % 3, f"step_{i % 2}", f"2024-01-01 0{i // 20}:{i % 20 * 3:02d}:00", say(("count", "clock", "none")[i % 3], i % 4 + 1), i % 5 < 2) for i in range(120)]
    df = spark.createDataFrame([*rows, (1, "step_1", "2024-01-01 00:00:00", None, True)], "trace_id long, step_name string, ts string, full_text string, again boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    both = lambda s: t.reload_staleness(s.where("NOT again").drop("again"), s.where("again").drop("again"), within="3 hours", late="30 minutes")
    want = sorted(map(str, both(df).collect()))
    got, _ = _restarted(spark, tmp_path, df, "reload", both)
    assert sorted(map(str, got.collect())) == want and len(want) > 10
    kinds = {(x.kind, x.value == x.again) for x in both(df).collect()}
    assert ("count", True) in kinds and ("countdown", False) in kinds and ("count", False) not in kinds


def test_overlays_of_a_long_trace(spark):
    """100,000 overlays and as many dismissals of one trace: one sort, no pairs."""
    n = 100_000
    steps = spark.range(n).select(F.lit(1).cast("long").alias("trace_id"), F.col("id").cast("int").alias("step_ord"), F.concat(F.lit("s"), "id").alias("step_name"), F.array(F.struct(F.concat(F.lit("sig"), (F.col("id") % 3).cast("string")).alias("signature"), F.lit("x").alias("text"), F.lit(True).alias("is_blocking"))).alias("modals"))
    gone = spark.range(n).select(F.lit(1).cast("long").alias("trace_id"), F.concat(F.lit("s"), "id").alias("step_name"), F.concat(F.lit("sig"), (F.col("id") % 3).cast("string")).alias("signature"))
    cap = b.captures(steps, gone)
    got = d.detect_nagging(cap).agg(F.count("*").alias("n"), F.max(F.get_json_object("evidence", "$.times_dismissed").cast("long")).alias("most")).first()
    assert (got.n, got.most) == (n - 3, (n - 1) // 3)
    assert d.detect_interruption_volume(cap).count() == 0


def test_patterns_are_screened_once(spark):
    """The plan makes the straight and the lower-case text once, however long the list."""
    def made(ps):
        plan = spark.createDataFrame([("x",)], "s string").select(tx.all_matches(F.col("s"), ps).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("translate("), plan.count("lower(")

    assert made(lx.URGENCY + lx.RECURRING) == made((lx.URGENCY + lx.RECURRING) * 3) == made(lx.URGENCY[:2]) == (2, 1)
    texts = ["commonly 3 left", "Only 3 left", "resubscribe monthly-ish", "per  month", "free trial then ₹5", "bi-monthly", "monthlyx", "émonthly", "auto renewals", None, ""]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    ps = lx.URGENCY + lx.RECURRING
    bare = F.array_compact(F.array(*[F.when(tx.quotes(F.col("s")).rlike(tx.java(p)), F.lit(i)) for i, p in enumerate(ps)]))
    assert df.where(~F.transform(tx.all_matches(F.col("s"), ps), lambda x: x["ord"]).eqNullSafe(F.when(F.col("s").isNotNull(), bare)) & F.col("s").isNotNull()).count() == 0


def test_an_audit_scans_states_once(spark):
    for cap in (b.order_funnels(spark, SF), b.customer_controls(spark, SF), b.supplier_buttons(spark, SF)):
        plan = d.audit(cap, ordered=False)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == cap.all_states._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_streams_of_columns(spark, tmp_path):
    """Page checks, duplicates and stale reloads say on a stream what they say on a table."""
    states = b.customer_controls(spark, SF).states.select(F.col("trace_id").alias("id"), "full_text", "checkboxes", "buttons", "links")
    got = _stream(spark, tmp_path, states, "flags", t.page_flags)
    assert sorted(map(str, got.collect())) == sorted(map(str, t.page_flags(states).collect())) != []
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("key"), "ts", (F.col("event_id") % 3).alias("value"))
    got = _stream(spark, tmp_path, e, "dedupe", lambda s: t.dedupe_evaluations(s, ["key", "value"], "400 days"))
    assert got.select("key", "value").distinct().count() == got.count() == t.dedupe_evaluations(e, ["key", "value"]).count()
    empty = spark.sql("SELECT 1L AS id, CAST(NULL AS STRING) AS full_text, * FROM (SELECT CAST(NULL AS array<struct<label_text:string,is_prechecked:boolean>>) AS checkboxes, CAST(NULL AS array<struct<text:string>>) AS buttons, CAST(NULL AS array<struct<text:string>>) AS links)")
    assert t.page_flags(empty).count() == 0


def test_links_between_pages(spark):
    base = "https://Shop.example:443/a/b.html?x=1#top"
    links = [("//shop.example/c/", "shop.example/c"), ("/c", "shop.example/c"), ("d", "shop.example/a/d"), ("../e?y=2#z", "shop.example/e?y=2"), ("?q", "shop.example/a/b.html?q"), ("#f", "shop.example/a/b.html?x=1"), ("", "shop.example/a/b.html?x=1"), ("http://OTHER.example", "other.example/"), ("./../../../g", "shop.example/g"), ("mailto:a@b.in", None), ("javascript:void(0)", None), (None, None)]
    df = spark.createDataFrame([(h, w) for h, w in links], "h string, want string")
    got = df.select("h", "want", tx.url_key(tx.resolve_url(F.col("h"), F.lit(base))).alias("got")).collect()
    assert [(x.h, x.got) for x in got if x.got != x.want] == []
    big = 2**62 + 1
    page = lambda *hrefs: "".join(f'<a href="{h}">to {i}</a>' for i, h in enumerate(hrefs)) + "<button>Pay now</button>"
    rows = [(big, "http://s.example/a", page("b", "#x", "/none")), (big + 1, "https://S.example/b/", page("/a?")), (big + 2, "https://s.example/b", None), (None, "http://s.example/c", page("a"))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string").coalesce(1)
    got = {(x.page_id, x.control_ord): (x.text, x.target_page_id) for x in w.page_controls(html.extract_states(pages)).collect()}
    assert got == {(big, 0): ("to 0", big + 1), (big, 1): ("to 1", big), (big, 2): ("to 2", None), (big, 3): ("Pay now", None), (big + 1, 0): ("to 0", None), (big + 1, 1): ("Pay now", None), (None, 0): ("to 0", big), (None, 1): ("Pay now", None)}
    steps = html.adhoc_steps(spark.createDataFrame([(7, ["http://s.example/a", "http://s.example/b", "http://s.example/nowhere", "http://s.example/a#again"])], "trace_id long, urls array<string>"))
    got = html.funnel_captures(steps, pages).orderBy("step_ord").collect()
    assert [(x.trace_id, x.step_ord, x.url) for x in got] == [(7, 1, "http://s.example/a"), (7, 2, "https://S.example/b/"), (7, 4, "http://s.example/a")]
    assert w.page_controls(html.extract_states(pages.limit(0))).count() == 0


def test_funnels_of_raw_pages(spark):
    """Detectors that compare steps see pages that were only given as HTML."""
    shop = lambda path, body: (hash(path) % 1000, f"https://s.example/{path}", f"<html><body>{body}</body></html>")
    pages = spark.createDataFrame([shop("list", "<div><p>Blue Top</p><p>₹ 1,000</p></div>"), shop("pay", "<table><tr><td>Blue Top</td><td>₹ 1,000</td></tr><tr><td>Handling fee</td><td>₹ 90</td></tr><tr><td>Total</td><td>₹ 1,090</td></tr></table>")], "page_id long, url string, html string")
    steps = html.adhoc_steps(spark.createDataFrame([(1, ["https://s.example/list", "https://s.example/pay"])], "trace_id long, urls array<string>"))
    found = d.audit(b.captures(html.funnel_captures(steps, pages))).collect()
    assert [(f.pattern_code, f.step_name) for f in found] == [("DP-08", "step_1 -> step_2")]


def test_committed_batches(spark, tmp_path):
    at = f"{tmp_path}/t"
    df = lambda *r: spark.createDataFrame([*r], "a long, b string")
    assert committed.read_batches(spark, at) is None
    assert committed.commit_batch(df((1, "x"), (2, "y")), at, "0") and not committed.commit_batch(df((9, "other")), at, "0")
    # A writer that was killed before it committed left rows and half a commit file behind.
    df((7, "lost")).write.parquet(f"{at}/data/1-lost")
    open(f"{at}/commits/.1-lost", "w").write("1-lo")
    assert committed.committed(spark, at) == ["0"]
    assert committed.commit_batch(df((3, "z")).withColumn("c", F.lit(5)), at, "1", sort_by="b") and committed.commit_batch(df().withColumn("c", F.lit(5)), at, "10")
    assert committed.committed(spark, at) == ["0", "1", "10"]
    assert sorted(map(tuple, committed.read_batches(spark, at).collect())) == [(1, "x", None), (2, "y", None), (3, "z", 5)]
    assert [tuple(y) for y in committed.read_batches(spark, at, ["1"]).collect()] == [(3, "z", 5)]
    with pytest.raises(ValueError):
        committed.commit_batch(df(), at, "a/b")
    # Two writers of one batch: the second to commit loses, and its rows are not read.
    df((8, "late")).write.parquet(f"{at}/data/10-late")
    assert not committed._publish(spark, at, "10", "10-late", df().schema) and committed.read_batches(spark, at).count() == 3


def test_reader_with_a_quarantine(spark, tmp_path):
    lines = ['{"trace_id": 1, "step_ord": 1, "full_text": "new", "unknown": [1]}', '{"schema_version": 1, "trace_id": 2, "step_ord": 2, "text": "old"}', '{"schema_version": 3, "trace_id": 3, "step_ord": 1}', '{"trace_id": 4', '{"trace_id": "x", "step_ord": 1}', '{"step_ord": 1}', '{"trace_id": 5}', '{"trace_id": 6, "step_ord": 1, "capture_no": 2}', "", "  ", "[]"]
    (tmp_path / "c.json").write_text("\n".join(lines))
    good, bad = captures.read_captures(spark, f"{tmp_path}/c.json", "json")
    assert sorted((y.trace_id, y.full_text, y.capture_no) for y in good.collect()) == [(1, "new", 0), (2, "old", 0)]
    why = {y.value: y.reason for y in bad.collect()}
    assert [why[x] for x in lines[2:8]] == ["unknown version", "not readable", "not readable", "no trace", "no place in the trace", "no first or second capture"] and len(why) + good.count() == 9
    good.write.parquet(f"{tmp_path}/p")
    again, none = captures.read_captures(spark, f"{tmp_path}/p")
    assert again.schema == good.schema and again.count() == 2 and none.count() == 0


def test_newest_by_counting(spark, monkeypatch):
    rows = [(i * 7919 % 1000, None if i % 50 == 0 else f"2024-01-{1 + i % 9:02d} 00:00:{i % 4:02d}") for i in range(1000)]
    jobs = spark.createDataFrame(rows, "id long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    order = [y.id for y in jobs.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    for bins in (2, 4096):
        monkeypatch.setattr(r, "BINS", bins)
        for k in (1, 2, 333, 985, 1000, 2000) if bins > 2 else (333,):
            assert {y.id for y in jobs.where(r.newest(jobs, k)).collect()} == {*order[:k]}, (bins, k)
    v = spark.createDataFrame([(order[3], "DP-01", 1.0)], "job_id long, pattern_code string, confidence double")
    page = r.list_audits(jobs, v, 5, 400).collect()
    assert [y.id for y in page] == order[400:405]
    after = r.list_audits(jobs, v, 5, after=(page[-1].created_at, page[-1].id)).collect()
    assert [y.id for y in after] == order[405:410]
    assert jobs.limit(0).where(r.newest(jobs.limit(0), 3)).count() == 0


def test_dimensions_of_hot_codes(spark, monkeypatch):
    """One code holds 90 % of the findings: salted, the largest task of the join has its fair share."""
    f = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("DP-"), F.col("id") % 7)).otherwise("DP-hot").alias("pattern_code"))
    dim = spark.createDataFrame([("DP-hot", i) for i in range(3)] + [("DP-1", 7), ("DP-none", 8)], "pattern_code string, other int")
    want = sorted(map(str, f.join(dim, "pattern_code", "left").collect()))
    assert sorted(map(str, r._meet(f, dim, "pattern_code", "left").collect())) == want
    monkeypatch.setattr(r, "FEW", 0)
    got = r._meet(f, dim, "pattern_code", "left")
    assert sorted(map(str, got.collect())) == want and {*got.columns} == {"pattern_code", "id", "other"}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [y.n for y in r._meet(f, dim, "pattern_code", "inner").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 0.4 * sum(sizes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
