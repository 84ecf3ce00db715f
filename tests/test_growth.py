"""Work that must grow no faster than the tables do."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from choicelens.operators import detectors as d
from choicelens.operators import extraction
from choicelens.operators import findings as r
from choicelens.plans import bridge as b
from choicelens.plans import journeys, queries
from choicelens.sources import html
from choicelens.streaming import ops

SMALL = "/root/testdata/sf0.001"


def test_cases_are_counted_by_code(spark, monkeypatch):
    found = spark.createDataFrame([("DP-01",)] * 40 + [("DP-02",)] * 3 + [(None,), ("DP-09",)], "pattern_code string")
    cases = spark.createDataFrame([("a", ["DP-01", "DP-02"]), ("b", ["DP-02", "DP-02"]), ("c", ["DP-03"]), ("d", None)], "case_id string, pattern_codes array<string>")
    want = {(x.case_id, x["count"]) for x in r.cases_for_findings(found, cases).groupBy("case_id").count().collect()}
    met, meet = [], r._meet
    monkeypatch.setattr(r, "_meet", lambda rows, dim, *how: met.append((rows.count(), dim.count())) or meet(rows, dim, *how))
    assert {(x.case_id, x.n) for x in r.case_counts(found, cases).collect()} == want == {("a", 43), ("b", 6)}
    assert met == [(5, 4)]  # the cases' codes meet one row a code


def test_false_positives_meet_funnels_that_pre_select(spark):
    (got,) = journeys.QUERIES["r16_false_positives"](spark, SMALL).collect()
    assert got.traces == spark.read.parquet(f"{SMALL}/customer.parquet").where("c_acctbal > 0").count()
    assert 0 < got.hits < got.traces and got.rate == round(got.hits / got.traces, 6)


def test_few_row_groups_become_many_tasks(spark):
    """Each small table comes in one row group: what is derived from it is dealt over all shuffle partitions, and gathering a trace needs no other shuffle."""
    for cap in (journeys.journeys, b.customer_controls, b.supplier_buttons, b.part_reloads):
        assert cap(spark, SMALL).states.select(F.spark_partition_id().alias("p")).distinct().count() > 1, cap
    plan = journeys.QUERIES["f1_commitment"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pages_are_read_in_pieces():
    """However many pages a batch holds, a worker holds the facts of a bounded part of them."""
    pages = pd.DataFrame({"page_id": [str(i) for i in range(9)], "url": "u", "html": ["x" * html.CHARS, None, "", *["<p>" + "y" * (html.CHARS // 3)] * 5, "z" * 3 * html.CHARS]})
    got = [*html._read(iter([pages, pages.iloc[:0], pages.iloc[:1]]))]
    assert [y for x in got for y in x["page_id"]] == [*map(str, range(9)), "0"]
    assert all(len(x) == 1 or x["raw_html"].str.len().sum() <= html.CHARS for x in got) and max(map(len, got)) < 4


def test_admission_carries_over_batches(spark):
    rows = [(None if i % 3 == 0 else i % 3, f"2024-01-01 00:00:{i % 60:02d}", i) for i in range(90)] + [(7, "2024-01-01 00:00:00", 90)]
    e = spark.createDataFrame(rows, "key long, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    read = lambda: sorted(map(str, ops.admit_events(e, 2, 20.0).collect()))
    want = read()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert read() == want and len(want) == 91
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = ops.admit_events(e, 2, 20.0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_a_charge_is_worked_out_once(spark):
    """A row's amount and label are made once, not again for each test on them."""
    df = spark.createDataFrame([(["Airline Taxes ₹5", "Total ₹7", "-Bag ₹3", "no amount"],)], "rows array<string>").select(extraction.line_items_from_rows(F.col("rows")).alias("i"))
    assert [tuple(x) for x in df.first().i] == [("Airline Taxes", 5.0), ("Bag", -3.0)]
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace") < 12


def test_sql_states_prices_and_short_pages(spark, tmp_path):
    """Pages that state a price, a charge or almost nothing: the SQL has the rule that the query has."""
    said = ["<p>nothing</p>", "<p>word$$$ 9 more</p>", "<p>fee $ 0</p>", "<p>Delivery fee ₹40</p><p>Delivery fee ₹40</p>", "<!-- $ 5 --><script>x = '$ 5'</script><p>a&amp;b</p>", "<p>key7cad0227</p>", "<p>free shipping, $ 5</p>", "", "<p>" + "long " * 60 + "</p><a href=\"/x\">Next</a>"]
    rows = [(i, f"https://s.example/{i}", x) for i, x in enumerate(said)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("s1_page_captures", "w3_discovery"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        got = [tuple(x) for x in df.collect()]
        assert sorted(got) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()), name
        if name == "w3_discovery":
            assert any(x[2].startswith("The page held almost no text.") for x in got)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_findings_are_made_once(spark):
    """no filter on findings or claims repeats the detectors' expressions below, and both plans on overlays shuffle the same rows."""
    for cap, detectors in ((b.customer_controls, d.LAYER1), (b.order_funnels, d.LAYER1)):
        assert "size(" not in "".join(x for x in _plan(d.run(cap(spark, SMALL), detectors)).split("\n") if "Filter" in x)
    assert _plan(d.detect_fake_urgency(b.part_reloads(spark, SMALL))).count("Only ") <= 8  # twice as many where claims are made again
    df = d.run(b.event_overlays(spark, SMALL), [d.NAGGING, d.VOLUME])
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_was_prices_in_any_letters(spark):
    """the quick test for a former price passes every way of writing that the expression does, and no number is no error."""
    said = ["Was ₹5000", "WAſ 5000", "mrp: 5,000", "ORIGİNAL 5000", "orıgınal 5000", "was cheap", "now 5000", "waſ: ,", None, "finally was ₹900"]
    df = spark.createDataFrame([(i, x, 1000.0) for i, x in enumerate(said)] + [(99, "was 5000", None)], "trace_id long, full_text string, price double")
    got = {x.trace_id for x in d.detect_reference_pricing(b.captures(df)).collect()}
    rule = r"(?iu)(?:was|mrp|original)[:\s ]*[₹$]?[\s ]?([\d,]+(?:\.\d+)?)"
    want = {x.trace_id for x in df.where(F.replace(F.regexp_extract("full_text", rule, 1), F.lit(","), F.lit("")).try_cast("double") > 3400).where("price > 0").collect()}
    assert got == want and {0, 2} <= want


def test_verdicts_in_one_pass(spark):
    """the count of findings and what a trace shows come from one scan of the states; the verdicts are those of the audit's findings."""
    for cap in (b.order_funnels(spark, SMALL), b.customer_controls(spark, SMALL), b.event_overlays(spark, SMALL), journeys.journeys(spark, SMALL)):
        want = sorted(map(tuple, r.run_verdict(cap.states, d.audit(cap, ordered=False)).collect()))
        assert sorted(map(tuple, r.verdict_of(d.tally(cap, r.seen_flags())).collect())) == want and want
    assert _plan(queries.QUERIES["r14_verdict"](spark, SMALL)).count("Relation [") == 2
