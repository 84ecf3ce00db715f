"""Queries over the given tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import detectors as d
from ..operators import discovery as w
from ..operators import findings as r
from ..sources import html
from ..streaming import ops as t
from . import bridge as b
from . import journeys as jr

KEYS = ["trace_id", "step_name", "pattern_code", "tier", "confidence"]


def keys(df: DataFrame) -> DataFrame:
    return df.select(*KEYS)


def _captures(spark: SparkSession, sf: str) -> list[b.Captures]:
    return [f(spark, sf) for f in (b.order_funnels, b.customer_controls, b.supplier_buttons, b.event_overlays, b.part_reloads)]


def audit(spark: SparkSession, sf: str) -> DataFrame:
    """All detectors over all derived funnels, strongest findings first."""
    found = [d.audit(cap, ordered=False).withColumn("part", F.lit(i)) for i, cap in enumerate(_captures(spark, sf))]
    # Dealt first: the sort samples its input, and would run every detector again for that.
    return reduce(DataFrame.unionByName, found).repartition("trace_id").orderBy(F.desc("confidence"), "detector_ord", "part", "trace_id", "step_ord", "elem_ord").select(*KEYS, "part")


def drip(spark: SparkSession, sf: str) -> DataFrame:
    e = d.detect_drip_pricing(b.order_funnels(spark, sf))
    num = lambda k: F.round(F.get_json_object("evidence", f"$.{k}").cast("double"), 2).alias(k)
    return e.select("trace_id", num("disclosed_price"), num("final_total"), num("hidden_amount"), "confidence")


def overlays(spark: SparkSession, sf: str) -> DataFrame:
    return keys(d.detect_nagging(b.event_overlays(spark, sf)))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "documents")


def redaction(spark: SparkSession, sf: str) -> DataFrame:
    return tx.redact_table(docs(spark, sf).select("doc_id", "text"), ["text"]).select("doc_id", F.md5("text").alias("text_md5"), *[F.col(f"text_redactions.{k}").cast("long").alias(k) for k, _, _ in lx.REDACTIONS])


def screened(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "pages").select("page_id", tx.screen_url(F.col("url")).alias("reason"))


def page_states(spark: SparkSession, sf: str) -> DataFrame:
    s = html.extract_states(b.table(spark, sf, "pages"))
    return s.select("page_id", F.size("links").cast("long").alias("n_links"), F.col("error").isNull().alias("fine"))


def shop_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The given pages, each with five links ahead of its own: stage and never-click wording by number, to the urls of the next
    pages as sites write them (with a fragment, without the scheme, by a host in capitals, through a folder and back), every fourth to no page."""
    texts = ["View details", "Add to cart", "Checkout now", "Review your order", "Pay now", "About us", "Subscribe"]
    p = b.table(spark, sf, "pages")
    nth = p.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("o"), (F.col("page_id") + F.col("o") + 1).alias("to"))
    ways = [F.col("u"), F.concat(F.regexp_replace("u", "#.*", ""), F.lit("#reviews")), F.regexp_replace("u", "^https?:", ""), F.concat(F.lit("HTTPS://"), F.upper(F.regexp_extract("u", "^https?://([^/]*)", 1)), F.regexp_extract("u", "^https?://[^/]*(.*)", 1)), F.regexp_replace("u", "^(https?://[^/]*)/", "$1/old/./../")]
    href = F.when((F.col("page_id") + F.col("o")) % 4 == 0, "mailto:shop@a.example")
    for i, way in enumerate(ways):
        href = href.when(F.col("o") == i, F.coalesce(way, F.lit("/gone")))
    link = F.concat(F.lit('<a href="'), href, F.lit('">'), b.pick(texts, F.col("page_id") + F.col("o") * 3), F.lit("</a> "))
    nav = nth.join(p.select(F.col("page_id").alias("to"), F.col("url").alias("u")).hint("merge"), "to", "left").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", link.alias("a")))), lambda x: x["a"]), "").alias("nav"))
    return p.join(nav.hint("merge"), "page_id").select("page_id", "url", F.concat("nav", F.coalesce("html", F.lit(""))).alias("html"))


def page_funnels(spark: SparkSession, sf: str) -> DataFrame:
    """Walks of three steps over those pages, by their urls, with what was read of each step's page: its planted links by text."""
    p = shop_pages(spark, sf)
    u = p.select(F.col("page_id").alias("at"), "url")
    walks = p.select(F.col("page_id").alias("trace_id"), F.explode(F.array(*[F.col("page_id") + i for i in range(3)])).alias("at")).join(u.hint("merge"), "at")
    steps = html.adhoc_steps(walks.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"]).alias("urls")))
    got = html.funnel_captures(steps, p)
    return got.select("trace_id", "step_ord", "step_name", "site_name", F.size("links").cast("long").alias("n_links"), F.array_join(F.transform(F.slice("links", 1, 5), lambda x: x["text"]), "|").alias("said"))


def controls(spark: SparkSession, sf: str) -> DataFrame:
    """All links and buttons of those pages, read from their HTML and joined to the pages that they lead to."""
    return w.page_controls(html.extract_states(shop_pages(spark, sf)))


def discovery(spark: SparkSession, sf: str) -> DataFrame:
    states = html.extract_states(shop_pages(spark, sf)).select("page_id", "url", "full_text", "links", "buttons").persist(StorageLevel.DISK_ONLY)
    c = w.page_controls(states)
    found = w.discovery_report(w.discover_funnels(states.select("page_id"), c), states, w.forbidden_controls(c))
    return found.select("start", "page_id", "note", F.array_join("reached", ",").alias("reached"), F.array_join("skipped", ",").alias("skipped"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "events")


def lexicon_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, each with a planted wording at its end, against two lists."""
    planted = F.concat_ws("\n", "text", b.pick(jr.TEXTS + ["Hurry! Only 3 left"], F.col("doc_id")))
    return tx.lexicon_scan(docs(spark, sf).select("doc_id", planted.alias("text")), "text", lx.URGENCY + lx.RECURRING).select("doc_id", "ord", "span")


def recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many labelled documents the urgency list finds, by label: whole texts, each with a planted wording, or a near miss, at its end."""
    labelled = b.table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", F.concat_ws("\n", "text", b.pick(jr.TEXTS + ["Hurry! Only 3 left"], F.col("doc_id"))).alias("said")), "doc_id")
    return r.recall_by_label(labelled, "quality", tx.hits(F.col("said"), lx.URGENCY)).select("quality", "n", "hits", F.round("recall", 6).alias("recall"))


def page_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What is read of charges and controls in the given pages, each with a form, a priced element and a row of money ahead of its own content."""
    k = F.col("page_id").cast("string")
    form = F.concat(F.lit('<form><label><input type="checkbox" checked> Add cover for ₹'), k, F.lit('</label><input type="radio" id="r'), k, F.lit('" required><label for="r'), k, F.lit('">Annual plan</label><input name="mail" aria-required="true"></form>'))
    priced = F.concat(F.lit('<div data-name="Tea '), k, F.lit('" data-price="'), (F.col("page_id") % 9).cast("string"), F.lit('.5">Tea</div><div data-name="Free" data-price="none">Free</div>'))
    row = F.concat(F.lit("<table><tr><td>Service tax</td><td>₹ "), k, F.lit('</td></tr></table><button class="btn accept">Yes</button><button class="decline">No</button>'))
    p = b.table(spark, sf, "pages").select("page_id", "url", F.concat(form, priced, row, F.coalesce("html", F.lit(""))).alias("html"))
    s = html.extract_states(p)
    text = lambda name, get: F.array_join(F.transform(F.slice(name, 1, 2), get), "|")
    return s.select(
        "page_id", text("checkboxes", lambda x: F.concat_ws(",", x["label_text"], x["is_prechecked"].cast("string"), x["required"].cast("string"))).alias("boxes"), text("buttons", lambda x: F.concat_ws(",", x["text"], x["role"])).alias("said"),
        F.col("form_fields")[0]["name"].alias("field"), F.array_join(F.transform("line_items", lambda x: F.concat_ws(",", x["name"], x["price"].cast("string"))), "|").alias("items"), F.exists("money_rows", lambda x: x == F.concat(F.lit("Service tax₹ "), F.col("page_id").cast("string"))).alias("row"))


def retention(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("1998-08-01").cast("timestamp_ntz")
    kept, gone, held = r.retention_split(b.jobs(spark, sf), b.violations(spark, sf), now, 365, 5000)
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(kept, "kept").union(n(gone, "purged")).union(n(held, "violations kept"))


QUERIES = {
    "audit": audit,
    "d08_drip_pricing": drip,
    "d02_basket_sneaking": lambda s, f: keys(d.detect_basket_sneaking(b.customer_controls(s, f))),
    "d04a_forced_consent": lambda s, f: keys(d.detect_forced_consent(b.customer_controls(s, f))),
    "d12_saas_billing": lambda s, f: keys(d.detect_saas_billing(b.customer_controls(s, f))),
    "d03_d11_wording": lambda s, f: keys(d.run_layer3(b.customer_controls(s, f)).unionByName(d.run_layer3(b.supplier_buttons(s, f)))),
    "d06_interference": lambda s, f: keys(d.detect_interface_interference(b.supplier_buttons(s, f))),
    "d07_bait_and_switch": lambda s, f: keys(d.detect_bait_and_switch(b.supplier_buttons(s, f))),
    "d04b_overlay": lambda s, f: keys(d.detect_inescapable_overlay(b.event_overlays(s, f))),
    "d10a_nagging": overlays,
    "d01_fake_urgency": lambda s, f: keys(d.detect_fake_urgency(b.part_reloads(s, f))),
    "e1_money": lambda s, f: b.money_strings(s, f).select("id", tx.amount(F.col("s")).alias("amount"), tx.money_mark(F.col("s")).alias("mark")),
    "l6_lexicon_scan": lexicon_docs,
    "r3_redaction": redaction,
    "e19_screen_urls": screened,
    "s2_page_states": page_states,
    "s3_page_funnels": page_funnels,
    "w3_discovery": discovery,
    "w1_forbidden": lambda s, f: w.forbidden_controls(controls(s, f)).select("page_id", "control_ord", "matched"),
    "r1_clamp": lambda s, f: r.clamp_confidence(b.violations(s, f)).groupBy("pattern_code", "tier").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 2).alias("total")),
    "r4_summary": lambda s, f: r.dashboard_summary(b.jobs(s, f), b.violations(s, f)),
    "r5_ranking": lambda s, f: r.pattern_ranking(b.violations(s, f)),
    "r6_tier_counts": lambda s, f: r.tier_counts(r.tier_of(b.violations(s, f)), "job_id"),
    "r8_list_audits": lambda s, f: r.list_audits(b.jobs(s, f), b.violations(s, f), 100, 20).select("id", "site_name", "n"),
    "r10_retention": retention,
    "r14_verdict": lambda s, f: r.verdict_of(d.tally(b.order_funnels(s, f), r.seen_flags())),
    "r15_recall": recall,
    "e7_e9_page_facts": page_facts,
    "e17_quotes": lambda s, f: b.table(s, f, "supplier").select("s_suppkey", tx.first_match(F.replace(b.pick(b.DECLINES, F.col("s_suppkey")), F.lit("'"), b.pick(["’", "‘", "'"], F.col("s_suppkey"))), lx.GUILT).alias("span")),
    "t2_first_price_drip": lambda s, f: t.first_price_drip(events(s, f).withColumn("day", F.to_date("ts")), "user_id", "value").select("event_id", "first_price"),
    "t3_debounced": lambda s, f: t.debounced_snapshots(events(s, f), "user_id", "30 minutes"),
    "t7_admission": lambda s, f: t.admit_events(events(s, f).select(F.col("user_id").alias("key"), "ts", "event_id"), 2, 3600.0),
    "t9_live_counts": lambda s, f: t.live_pattern_counts(events(s, f), "event_type"),
}


def _any(col: str, patterns: list[str]) -> str:
    each = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({col}, '(?i){each}')"


def _pick(values: list[str], by: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[{by} % {len(values)} + 1]"


_BOX = f"""SELECT c_custkey AS trace_id, {_pick(b.LABELS, 'c_custkey')} AS label, c_custkey % 2 = 0 AS pre, c_custkey % 3 = 0 AS must FROM customer"""
_BUTTON = f"""SELECT s_suppkey AS k, {_pick(b.DECLINES, 's_suppkey')} AS decline FROM supplier"""
_OVERLAY = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, event_id % 3 AS g FROM events"
_WHO = "'{code}' AS pattern_code, '{tier}' AS tier, {conf} AS confidence"
_EV = "SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events"
_JOBS = "SELECT o_orderkey AS id, 'site-' || CAST(o_custkey % 50 AS VARCHAR) AS site_name, o_orderdate AS created_at FROM orders"
_TIER = "CASE WHEN c IN ('DP-02','DP-04','DP-08','DP-10','DP-12') THEN 'provable' WHEN c IN ('DP-01','DP-05','DP-06','DP-07','DP-09','DP-11') THEN 'corroborated' ELSE 'indicative' END"
_VIOL = f"SELECT job_id, c AS pattern_code, confidence, {_TIER} AS tier FROM (SELECT l_orderkey AS job_id, 'DP-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS c, 1 - l_discount AS confidence FROM lineitem)"


def _who(code: str, tier: str, conf: float) -> str:
    return _WHO.format(code=code, tier=tier, conf=f"CAST({conf} AS DOUBLE)")


_RULES = [(k, p.replace("'", "''"), m) for k, p, m in lx.REDACTIONS]


def _redaction() -> str:
    at, cols, sub = "text", [], "SELECT doc_id, text AS t0 FROM documents"
    for i, (k, p, m) in enumerate(_RULES):
        sub = f"SELECT *, CAST(len(regexp_extract_all(t{i}, '{p}')) AS BIGINT) AS {k}, regexp_replace(t{i}, '{p}', '{m}', 'g') AS t{i + 1} FROM ({sub})"
        cols.append(k)
    return f"SELECT doc_id, md5(t{len(_RULES)}) AS text_md5, {', '.join(cols)} FROM ({sub})"


ORACLES = {
    "d08_drip_pricing": """WITH i AS (SELECT l_orderkey AS k, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS lo, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS hi, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey AS trace_id, lo, CASE WHEN o_orderkey % 7 = 0 AND n + 1 > 12 THEN hi ELSE s + 6000 END AS fin, o_orderkey % 7 = 0 AND n + 1 > 12 AS other, s + 6000 AS total, o_custkey FROM orders JOIN i ON k = o_orderkey
  WHERE o_orderpriority = '1-URGENT' AND o_custkey % 3 <> 0 AND o_orderkey % 11 <> 0)
SELECT trace_id, lo / 100.0::DOUBLE AS disclosed_price, round(fin / 100.0::DOUBLE, 2) AS final_total, round((fin - lo) / 100.0::DOUBLE, 2) AS hidden_amount, 1.0::DOUBLE AS confidence
FROM f WHERE fin > lo * 1.02 AND NOT (o_custkey % 5 = 0 AND fin = total)""",
    "d02_basket_sneaking": f"""SELECT trace_id, 'step_1' AS step_name, {_who('DP-02', 'provable', 1.0)} FROM ({_BOX}) WHERE pre AND NOT {_any('label', lx.RECURRING)} AND regexp_matches(label, '(?i)[₹$€£¥]|insurance|protection')""",
    "d04a_forced_consent": f"""SELECT trace_id, 'step_' || CAST(s AS VARCHAR) AS step_name, {_who('DP-04', 'provable', 1.0)} FROM ({_BOX}), (SELECT unnest([1, 2, 3]) AS s) WHERE must AND {_any('label', lx.UNRELATED_CONSENT)} AND NOT {_any('label', lx.LAWFUL_CONTEXT)}""",
    "d12_saas_billing": f"""SELECT trace_id, 'step_1' AS step_name, {_who('DP-12', 'provable', 1.0)} FROM ({_BOX}) WHERE pre AND {_any('label', lx.RECURRING)}""",
    "d03_d11_wording": f"""SELECT trace_id, 'step_' || CAST(s AS VARCHAR) AS step_name, 'DP-11' AS pattern_code, 'corroborated' AS tier, CASE WHEN {_any('label', lx.DOUBLE_NEGATIVE)} THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM ({_BOX}), (SELECT unnest([1, 2, 3]) AS s) WHERE {_any('label', lx.DOUBLE_NEGATIVE)} OR (pre AND {_any('label', lx.OPT_OUT)})
UNION ALL SELECT k AS trace_id, 'step_1' AS step_name, {_who('DP-03', 'indicative', 0.6)} FROM ({_BUTTON}) WHERE length(decline) > 8 AND {_any('decline', lx.GUILT)}""",
    "d06_interference": f"""SELECT s_suppkey AS trace_id, 'step_1' AS step_name, {_who('DP-06', 'corroborated', 0.9)} FROM supplier WHERE 1 + s_suppkey % 6 < 3 OR (80 + s_suppkey % 5 * 20) * 40.0 / ((60 + s_suppkey % 7 * 10) * 30.0) >= 2 OR (14 + s_suppkey % 3 * 4) / (10.0 + s_suppkey % 5 * 2) >= 1.5""",
    "d07_bait_and_switch": f"""SELECT s_suppkey AS trace_id, 'step_1' AS step_name, {_who('DP-07', 'corroborated', 0.7)} FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 3 * 5 > greatest(s_suppkey * 10 * 0.02, 1)""",
    "d04b_overlay": f"""SELECT user_id AS trace_id, 'step_' || CAST(o AS VARCHAR) AS step_name, {_who('DP-04', 'corroborated', 0.75)} FROM ({_OVERLAY}) WHERE event_type NOT IN ('view', 'click') AND least(value / 400, 1) >= 0.1""",
    "d10a_nagging": f"""SELECT user_id AS trace_id, 'step_' || CAST(o AS VARCHAR) AS step_name, {_who('DP-10', 'provable', 1.0)} FROM ({_OVERLAY}) a WHERE EXISTS (SELECT 1 FROM ({_OVERLAY}) z WHERE z.user_id = a.user_id AND z.g = a.g AND z.event_type = 'click' AND z.o < a.o)""",
    "d01_fake_urgency": """SELECT p_partkey AS trace_id, 'item' AS step_name, 'DP-01' AS pattern_code, CASE WHEN p_partkey % 4 = 0 THEN 'indicative' ELSE 'corroborated' END AS tier, CASE WHEN p_partkey % 4 = 0 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM part WHERE (p_partkey % 4 = 0 AND p_partkey % 3 = 0) OR (p_partkey % 4 = 1 AND p_partkey % 3 <> 1)""",
    "e1_money": """WITH m AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
SELECT id, CASE WHEN id % 8 IN (0, 2, 4, 7) THEN c / 100.0::DOUBLE WHEN id % 8 IN (1, 3) THEN CAST(c // 100 AS DOUBLE) END AS amount, ['₹', 'Rs.', 'INR', '', 'USD', '', '', 'US$'][id % 8 + 1] AS mark FROM m""",
    "r3_redaction": _redaction(),
    "e19_screen_urls": "SELECT page_id, CASE WHEN trim(coalesce(url, '')) = '' THEN 'empty' WHEN length(url) > 2048 THEN 'too long' WHEN NOT regexp_matches(url, '^(?i)https?://') THEN 'scheme' WHEN regexp_matches(url, '^[a-zA-Z]+://[^/?#]*@') THEN 'credentials' WHEN regexp_matches(url, '^[a-zA-Z]+://(localhost|[^/?#:]*\\.local)([/?#:]|$)') THEN 'local' END AS reason FROM pages",
    "s2_page_states": "SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS BIGINT) AS n_links, true AS fine FROM pages",
    "r1_clamp": f"SELECT pattern_code, tier, count(*) AS n, round(sum(round(least(confidence, CASE tier WHEN 'provable' THEN 1.0 WHEN 'corroborated' THEN 0.9 ELSE 0.6 END), 2)), 2) AS total FROM ({_VIOL}) GROUP BY ALL",
    "r4_summary": f"SELECT 'jobs' AS kind, NULL::VARCHAR AS pattern_code, count(*) AS n FROM orders UNION ALL SELECT 'violations', NULL, count(*) FROM lineitem UNION ALL SELECT 'pattern', pattern_code, count(*) FROM ({_VIOL}) GROUP BY ALL",
    "r5_ranking": f"SELECT pattern_code, count(*) AS n FROM ({_VIOL}) GROUP BY 1",
    "r6_tier_counts": f"SELECT job_id, count(*) FILTER (tier = 'provable') AS provable, count(*) FILTER (tier = 'corroborated') AS corroborated, count(*) FILTER (tier = 'indicative') AS indicative, 0::BIGINT AS unstated FROM ({_VIOL}) GROUP BY 1",
    "r8_list_audits": f"SELECT id, site_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = id) AS n FROM (SELECT * FROM ({_JOBS}) ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 20)",
    "r10_retention": f"""WITH j AS ({_JOBS}), g AS (SELECT id FROM j WHERE created_at < TIMESTAMP '1998-08-01' - INTERVAL 365 DAY UNION SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM j) WHERE n > 5000)
SELECT 'kept' AS kind, count(*) AS n FROM j WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'purged', count(*) FROM g UNION ALL SELECT 'violations kept', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g)""",
    "t2_first_price_drip": "SELECT event_id, first_price FROM (SELECT *, first_value(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS first_price FROM events) WHERE value > first_price * 1.02",
    "t3_debounced": f"""SELECT user_id, min(ts) AS start, arg_max(event_id, (ts, event_id)) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM ({_EV})) GROUP BY user_id, r""",
    "t9_live_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}


def _span(col: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({col}, '(?i){p.replace(chr(39), chr(39) * 2)}', 0), '')" for p in patterns) + ")"


_TEXTS = ["View details", "Add to cart", "Checkout now", "Review your order", "Pay now", "About us", "Subscribe"]
_KEY = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') || regexp_extract(url, '^https?://[^?#]*(\\?[^#]*)', 1)"
_CONTROLS = f"k AS (SELECT page_id, {_KEY} AS k, html FROM pages), i AS (SELECT k, min(page_id) AS target FROM k GROUP BY 1), c AS (SELECT x.page_id, o, {_pick(_TEXTS, '(x.page_id + o * 3)')} AS text, i.target FROM k x CROSS JOIN (SELECT unnest(range(5)) AS o) LEFT JOIN k z ON z.page_id = x.page_id + o + 1 AND (x.page_id + o) % 4 <> 0 LEFT JOIN i ON i.k = z.k)"


def _stage(i: int) -> str:
    intent = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN {n}" for n, p in enumerate(lx.STAGES[i][1]) if "(?=" not in p)
    return f"n{i} AS (SELECT page_id, arg_min(text, (i, o)) AS text, CASE WHEN bool_or(true) THEN (min_by(struct_pack(t := target), (i, o))).t END AS target FROM (SELECT *, CASE {intent} END AS i FROM c WHERE NOT {_any('text', lx.NEVER_CLICK)}) WHERE i IS NOT NULL GROUP BY page_id)"


def _lines(html_: str) -> str:
    """Lines of a page's text: no comments, scripts and styles, a break at each block, white space joined, no empty line."""
    block = "/?(?:" + "|".join(sorted(html.BLOCK, key=len, reverse=True)) + ")"
    steps = [("<!--.*?-->", ""), (r"<(?:script|style|noscript|template)\b.*?</(?:script|style|noscript|template)\s*>", ""), (rf"\s*<{block}(?:[\s/][^>]*)?>\s*", "\n"), ("<[!/a-zA-Z][^>]*>", ""), ("<[!/a-zA-Z][^>]*$", "")]
    text = f"coalesce({html_}, '')"
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by.replace(chr(10), '@@')}', 'gis')".replace("'@@'", "chr(10)")
    for name, by in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{by}', 'g')"
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(regexp_replace(x, '[\\s\u00a0]+', ' ', 'g'))), lambda x: x <> '')"


#: The first amount of money of a line, as text; '' if none.
_MONEY = rf"(?i)(?:₹|€|£|¥|\$|(?:^|[^A-Za-z])(?:Rs\.?|INR|US\$|A\$|C\$|S\$|USD|EUR|GBP|JPY|AUD|CAD|CHF|SGD|AED|SAR))\s*({lx.AMOUNT})|({lx.AMOUNT})\s*/-|({lx.AMOUNT})\s*{lx.CODE}\b"
_STATED = "coalesce(" + ", ".join(f"nullif(regexp_extract(x, '{_MONEY}', {g}), '')" for g in (1, 2, 3)) + ", '')"
#: Whether a line outside of promises states an amount that isn't zero.
_PRICED = f"len(list_filter(lines, lambda x: NOT regexp_matches(x, '(?i){lx.PROMO}') AND regexp_matches({_STATED}, '[1-9]'))) > 0"

_WORD = r"(?:Rs\.?|INR|US\$|A\$|C\$|S\$|USD|EUR|GBP|JPY|AUD|CAD|CHF|SGD|AED|SAR)"


def _replaced(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, '(?i){pattern}', '{by}', 'g')"
    return text


def _items() -> str:
    """Number of charges among a page's lines: rows of at most 220 characters that name something and state an amount, once each. (An element
    with an amount is one line in the given pages, which mark up no charges.)"""
    amount = [(rf"[₹€£¥$]\s*{lx.AMOUNT}", ""), (rf"(^|[^A-Za-z]){_WORD}\s*{lx.AMOUNT}", "\\1"), (rf"{lx.AMOUNT}\s*/-|{lx.AMOUNT}\s*{lx.CODE}\b", "")]
    mark = [("[₹€£¥$]([^A-Za-z]|$)", " \\1"), (rf"(^|[^A-Za-z]){_WORD}([^A-Za-z]|$)", "\\1 \\2"), (lx.CTA_TAIL, " "), (r"\(\s*\)", " "), (r"\s+", " "), (r"^[\s–—:-]+|[\s–—:-]+$", "")]
    name, label = f"trim({_replaced('x', [(lx.PERCENT_BADGE, ' '), *amount, *mark])})", f"trim({_replaced('x', [(lx.PERCENT_BADGE, ' '), *amount, (chr(92) + 's+', ' ')])})"
    row = f"length(x) <= 220 AND regexp_matches(x, '(?i)[₹€£¥$]\\s*[\\d,]|(?:^|[^A-Za-z]){_WORD}\\s*[\\d,]|\\d[\\d,\\s]*/-') AND length({label}) <= 80 AND regexp_matches({label}, '[A-Za-z]')"
    charge = f"{_STATED} <> '' AND NOT regexp_matches(x, '(?i){lx.PROMO}') AND length({name}) <= 60 AND regexp_matches({name}, '[A-Za-z]') AND lower({name}) NOT IN ({', '.join(map(jr._q, lx.ATTRIBUTE_LABELS))}) AND NOT regexp_matches({name}, '(?i){lx.TOTAL_WORDS}')"
    return f"CAST(len(list_distinct(list_filter(lines, lambda x: {row} AND {charge}))) AS INTEGER)"


def _walk() -> str:
    # With a page's own links behind the planted ones: to the page of their host and path, if there is one.
    own = """oc AS (SELECT page_id, 5 + i - 1 AS o, regexp_extract(a, '(?s)>(.*)</a', 1) AS text, k AS page_k, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM (SELECT page_id, k, unnest(l) AS a, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, k, regexp_extract_all(html, '(?s)<a [^>]*href=.*?</a') AS l FROM k)))"""
    controls = _CONTROLS.replace(", c AS (", ", planted AS (") + f", {own}, c AS (SELECT page_id, o, text, target FROM planted UNION ALL SELECT oc.page_id, o, text, i.target FROM oc LEFT JOIN i ON i.k = string_split(page_k, '/')[1] || rtrim(href, '/') WHERE length(text) <= 60)"
    out, at = [controls, *map(_stage, range(4))], "SELECT page_id AS start, page_id, '' AS reached, '' AS skipped FROM pages"
    for i, (name, _) in enumerate(lx.STAGES):
        at = f"SELECT start, coalesce(n.target, a.page_id) AS page_id, CASE WHEN n.target IS NOT NULL THEN reached || ',{name}' ELSE reached END AS reached, CASE WHEN n.target IS NULL THEN skipped || ',{name}' ELSE skipped END AS skipped FROM ({at}) a LEFT JOIN n{i} n ON n.page_id = a.page_id"
    no = f"SELECT DISTINCT page_id AS p FROM c WHERE {_any('lower(trim(text))', lx.NEVER_CLICK)}"
    note = "CASE WHEN reached = '' THEN 'Only the first page was seen' || CASE WHEN start IN (FROM no) THEN ': what leads on must not be clicked.' ELSE '.' END WHEN skipped <> '' THEN 'Not reached: ' || replace(ltrim(skipped, ','), ',', ', ') ELSE 'All stages reached.' END"
    few = f"SELECT page_id AS p FROM k JOIN (SELECT page_id, sum(length(text) + 1) AS n FROM planted GROUP BY 1) USING (page_id) WHERE n + length(array_to_string({_lines('html')}, chr(10))) < 200"
    return f"WITH {', '.join(out)}, no AS ({no}), few AS ({few}) SELECT start, page_id, ltrim(reached, ',') AS reached, ltrim(skipped, ',') AS skipped, CASE WHEN start IN (FROM few) THEN 'The page held almost no text. ' ELSE '' END || {note} AS note FROM ({at})"


_SCAN = " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, regexp_extract(t, '(?i){p}', 0) AS span FROM x WHERE regexp_matches(t, '(?i){p}')" for i, p in enumerate(lx.URGENCY + lx.RECURRING))
_FUNNEL = """i AS (SELECT l_orderkey AS k, string_agg('Item ' || translate(CAST(l_partkey AS VARCHAR), '0123456789', 'abcdefghij'), chr(10)) AS names, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey AS k, length(names) + CASE WHEN o_custkey % 3 = 0 THEN 21 ELSE 0 END + CASE WHEN o_custkey % 5 = 0 THEN 9 + length(CAST(((s + CASE WHEN o_orderpriority = '1-URGENT' THEN 6000 ELSE 0 END) // 100) AS VARCHAR)) + 3 ELSE 0 END >= 200 AS long FROM orders JOIN i ON k = o_orderkey)"""
_DIM = ", ".join(f"('{c}', '{tier}')" for c, (_, tier) in lx.PATTERNS.items())
_URLS = ", ".join("'" + u.replace("'", "''") + "'" for u in jr.BAD_URLS)
_WHY = ", ".join("NULL" if why is None else f"'{why}'" for why in jr.BAD_REASONS)


def _part(name: str, part: int) -> str:
    return f"SELECT trace_id, step_name, pattern_code, tier, confidence, {part} AS part FROM ({ORACLES[name]})"


QUERIES |= jr.QUERIES
ORACLES |= jr.ORACLES
ORACLES |= {
    "l6_lexicon_scan": f"WITH x AS (SELECT doc_id, concat_ws(chr(10), text, {_pick(jr.TEXTS + ['Hurry! Only 3 left'], 'doc_id')}) AS t FROM documents) {_SCAN}",
    "r15_recall": f"SELECT quality, count(*) AS n, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 6) AS recall FROM (SELECT quality, {_any('said', lx.URGENCY)} AS hit FROM (SELECT quality, concat_ws(chr(10), text, {_pick(jr.TEXTS + ['Hurry! Only 3 left'], 'doc_id')}) AS said FROM documents JOIN labels USING (doc_id))) GROUP BY 1",
    "e7_e9_page_facts": "SELECT page_id, 'Add cover for ₹' || page_id || ',true,false|Annual plan,false,true' AS boxes, 'Yes,accept|No,decline' AS said, 'mail' AS field, 'Tea ' || page_id || ',' || (page_id % 9) || '.5' AS items, true AS row FROM pages",
    "e17_quotes": f"SELECT s_suppkey, {_span('said', lx.GUILT)} AS span FROM (SELECT s_suppkey, {_pick(b.DECLINES, 's_suppkey')} AS said FROM supplier)",
    "w1_forbidden": f"WITH {_CONTROLS} SELECT page_id, CAST(min(o) AS INTEGER) AS control_ord, {_span('low', lx.NEVER_CLICK)} AS matched FROM (SELECT *, lower(trim(text)) AS low FROM c) WHERE {_any('low', lx.NEVER_CLICK)} GROUP BY page_id, low",
    "w2_next_controls": f"WITH {_CONTROLS}, {_stage(2)} SELECT page_id, text, target AS target_page_id FROM n2",
    "w3_discovery": _walk(),
    "s3_page_funnels": f"""WITH {_CONTROLS}, said AS (SELECT page_id, string_agg(text, '|' ORDER BY o) AS said FROM c GROUP BY 1), f AS (SELECT p.page_id AS trace_id, s + 1 AS step_ord, q.page_id AS at, q.url FROM pages p, (SELECT unnest(range(3)) AS s), pages q WHERE q.page_id = p.page_id + s),
g AS (SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY step_ord) AS INTEGER) AS step_ord, k.k, string_split(f.url, '/')[3] AS site_name FROM f JOIN k ON k.page_id = f.at)
SELECT trace_id, step_ord, 'step_' || step_ord AS step_name, site_name, CAST(5 + len(regexp_extract_all(k.html, '<a [^>]*href=')) AS BIGINT) AS n_links, said FROM g JOIN i ON i.k = g.k JOIN k ON k.page_id = i.target JOIN said ON said.page_id = i.target""",
    "w5_blocked_targets": f"""WITH x AS (SELECT [{_URLS}][page_id % {len(jr.BAD_URLS)} + 1] AS u, [{_WHY}][page_id % {len(jr.BAD_URLS)} + 1] AS reason FROM pages) SELECT rtrim(lower(regexp_extract(u, '^[a-zA-Z]+://(?:[^/?#]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1)), '.') AS host, min(reason) AS reason FROM x WHERE reason IS NOT NULL AND NOT starts_with(u, 'javascript:') GROUP BY 1""",
    "r7_coverage": f"SELECT tier, count(*) AS patterns, string_agg(code, ',' ORDER BY code) AS codes, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings FROM (VALUES {_DIM}) AS p(code, tier) LEFT JOIN (SELECT pattern_code, count(*) AS n FROM ({_VIOL}) GROUP BY 1) ON pattern_code = code GROUP BY 1",
    "r14_verdict": f"WITH {_FUNNEL}, h AS (SELECT trace_id FROM ({ORACLES['d08_drip_pricing']})) SELECT k AS trace_id, CASE WHEN NOT long THEN 'INCONCLUSIVE' WHEN k IN (FROM h) THEN 'FINDINGS' ELSE 'CLEAN' END AS verdict, CAST(k IN (FROM h) AS BIGINT) AS n FROM f",
    "r16_false_positives": f"SELECT count(*) AS traces, count(*) FILTER (hit) AS hits, CAST(round(count(*) FILTER (hit) / count(*), 6) AS DOUBLE) AS rate FROM (SELECT pre AND ({_any('label', lx.RECURRING)} OR regexp_matches(label, '(?i)[₹$€£¥]|insurance|protection')) AS hit FROM ({_BOX}) JOIN customer ON c_custkey = trace_id WHERE c_acctbal > 0)",
    "t1_page_flags": jr._flags_sql(),
    "t7_admission": """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, event_id, true AS admitted, [ts] AS acc FROM o WHERE n = 1 UNION ALL SELECT user_id, n, event_id, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, ts) ELSE live END FROM (SELECT o.user_id, o.n, o.event_id, o.ts, list_filter(r.acc, lambda x: x > o.ts - INTERVAL 1 HOUR) AS live FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1))
SELECT user_id AS key, event_id, admitted FROM r""",
}
_D10B = f"""WITH o AS ({_OVERLAY}), x AS (SELECT user_id, max(o) AS o FROM o WHERE event_type <> 'view' GROUP BY 1 HAVING count(DISTINCT g) >= 3), nag AS (SELECT DISTINCT a.user_id, a.g FROM o a JOIN o z ON z.user_id = a.user_id AND z.g = a.g AND z.event_type = 'click' AND z.o < a.o)
SELECT user_id AS trace_id, 'step_' || CAST(o AS VARCHAR) AS step_name, {_who('DP-10', 'indicative', 0.4)} FROM x WHERE NOT EXISTS (SELECT 1 FROM nag JOIN o y ON y.user_id = nag.user_id AND y.g = nag.g AND y.event_type <> 'view' WHERE nag.user_id = x.user_id)"""
ORACLES["d08_findings"] = f"SELECT trace_id, 'listing -> checkout' AS step_name, {_who('DP-08', 'provable', 1.0)} FROM ({ORACLES['d08_drip_pricing']})"
QUERIES["d08_findings"] = lambda s, f: keys(d.detect_drip_pricing(b.order_funnels(s, f)))
_WORDING = ORACLES["d03_d11_wording"].split("UNION ALL")
ORACLES["audit"] = " UNION ALL ".join([
    _part("d08_findings", 0), *[_part(n, 1) for n in ("d02_basket_sneaking", "d04a_forced_consent", "d12_saas_billing")], f"SELECT *, 1 AS part FROM ({_WORDING[0]})", f"SELECT *, 2 AS part FROM ({_WORDING[1]})",
    *[_part(n, 2) for n in ("d06_interference", "d07_bait_and_switch")], *[_part(n, 3) for n in ("d04b_overlay", "d10a_nagging")], f"SELECT *, 3 AS part FROM ({_D10B})", _part("d01_fake_urgency", 4)])
_READS = "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 1 END AS move, p_size AS n FROM part"
_SAID = "CASE WHEN k % 4 = 0 THEN 'Hurry! Only ' || (n + 5 + d) || ' left' WHEN k % 4 = 1 THEN 'Offer ends in: 00:' || lpad(CAST((n * 20 + 60 + d) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((n * 20 + 60 + d) % 60 AS VARCHAR), 2, '0') WHEN k % 4 = 2 THEN 'Sale ends Sunday. Hurry while stocks last' ELSE 'In stock: ' || n || ' units' END"
ORACLES["s1_page_captures"] = f"SELECT page_id AS trace_id, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS BIGINT) AS links, {_items()} AS items, CASE WHEN {_PRICED} THEN 'rendered_text' ELSE 'not_found' END AS price_source, len(lines) > 0 AS read FROM (SELECT page_id, html, {_lines('html')} AS lines FROM pages)"
_HITS = ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{i}' END" for i, p in enumerate(lx.URGENCY))
ORACLES["e16_urgency_hits"] = f"SELECT trace_id, capture_no, concat_ws(',', {_HITS}) AS hits FROM (SELECT k AS trace_id, capture_no, {_SAID} AS t FROM (SELECT k, n, 0 AS capture_no, 0 AS d FROM ({_READS}) UNION ALL SELECT k, n, 1, move FROM ({_READS})))"
ORACLES["s9_evidence_link"] = f"SELECT trace_id, step_name, CASE WHEN trace_id % 3 <> 0 AND 'step_' || (trace_id % 5 + 1) = string_split(step_name, ' -> ')[1] THEN '/shots/' || trace_id END AS path, trace_id % 3 <> 0 AND 'step_' || (trace_id % 5 + 1) = string_split(step_name, ' -> ')[1] AS has_screenshot FROM ({ORACLES['d05a_late_disclosure']})"
