"""Detectors: captured funnels in, findings out.

A page detector is a column: an array of findings made from one state alone. A funnel detector is a column too, over what one
aggregation by trace has gathered. An audit is therefore one scan of the states and at most one shuffle, whatever the number of
detectors: the page findings ride along with what the funnels need, and all are exploded once. Only reloads, which meet
their first capture by trace and step, and overlays, which meet dismissals by trace and signature, are plans of their own.

Null texts hit no list, null prices, sizes and flags prove nothing, empty tables give no findings. Order in a trace is that
of step_ord, then of the element; step_ord names a state of a trace, and states that repeat it may repeat findings.
Columns of other names pass by unread.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import all_matches, first_match, hits, java, let, mentions_amount, money_text, stated_total, states_total
from ..plans.captures import FINDING, Captures, clamp, findings

FOUND = """array<struct<step_name:string,pattern_code:string,pattern_name:string,layer:int,tier:string,confidence:double,evidence:string,explanation:string,
detector_ord:int,step_ord:int,elem_ord:int,once:string>>"""


def no_finding() -> Column:
    return F.array().cast(FOUND)


def found(code: str | Column, ord_: int, tier: str | Column, confidence: float | Column, explanation: Column | str, evidence: dict[str, Column], at: Column | None = None, elem: Column | int = 0, once: Column | None = None, layer: int = 1, name: str | Column | None = None, step: Column | None = None) -> Column:
    """One finding as a struct, at the state that the row or `at` is. Of findings that agree in `once`, the first of a trace stays."""
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    tier, code_ = lit(tier, "string"), lit(code, "string")
    name = lit(name if name is not None else lx.PATTERNS[code][0], "string")
    step_name, step_ord = (F.col("step_name"), F.col("step_ord")) if at is None else (at["step_name"], at["step_ord"])
    ev = F.to_json(F.struct(tier.alias("evidence_tier"), *[c.alias(k) for k, c in evidence.items()]), {"ignoreNullFields": "false"})
    parts = [step_name if step is None else step, code_, name, lit(layer, "int"), tier, clamp(lit(confidence, "double"), tier), ev, lit(explanation, "string"), lit(ord_, "int"), step_ord, lit(elem, "int"), lit(once, "string")]
    names = ["step_name", "pattern_code", "pattern_name", "layer", "tier", "confidence", "evidence", "explanation", "detector_ord", "step_ord", "elem_ord", "once"]
    return F.struct(*[c.alias(n) for c, n in zip(parts, names, strict=True)])


def each(array: str | Column, test: Callable[[Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    """Findings of the elements that pass a test; null arrays have none."""
    return F.coalesce(F.array_compact(F.transform(array, lambda e, i: F.when(test(e), make(e, i)))), no_finding())


def when(test: Column, finding: Column) -> Column:
    return F.when(test, F.array(finding)).otherwise(no_finding())


def _control(e: Column) -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    return F.concat_ws("\n", part(e["id"]), part(e["label_text"]))


# ---- Findings of one page -------------------------------------------------------------------------------------------


def page_basket_sneaking() -> Column:
    """A pre-ticked one-off charge: the label names a chargeable item of its page, a currency, insurance or protection."""
    def charge(e: Column) -> Column:
        label = F.lower(F.coalesce(e["label_text"], F.lit("")))
        named = F.coalesce(F.exists("line_items", lambda i: (i["price"] > 0) & (F.trim(F.coalesce(i["name"], F.lit(""))) != "") & label.contains(F.lower(i["name"]))), F.lit(False))
        return e["is_prechecked"] & (named | label.rlike("[₹$€£¥]|insurance|protection")) & ~hits(e["label_text"], lx.RECURRING)

    return each("checkboxes", charge, lambda e, i: found("DP-02", 2, "provable", 1.0, F.concat(F.lit("Pre-selected charge: "), F.coalesce(e["label_text"], F.lit(""))), {"checkbox_id": e["id"], "label_text": e["label_text"]}, elem=i, once=_control(e)))


def page_reference_pricing() -> Column:
    def claim(was: Column) -> Column:
        pct = (was - F.col("price")) / F.nullif(was, F.lit(0.0)) * 100
        return when((F.col("price") != 0) & (was > F.col("price")) & (pct > 70), found("DPAF-SN-RP", 4, "indicative", 0.5, F.concat(F.lit("Claimed discount of "), F.format_number(pct, 0), F.lit(" %")), {"claimed_was_price": was, "claimed_now_price": F.col("price"), "claimed_discount_pct": F.round(pct, 1)}, name="Reference Pricing (beyond CCPA-13)"))

    said = F.regexp_extract("full_text", r"(?iu)(?:was|mrp|original)[:\s ]*[₹$]?[\s ]?([\d,]+(?:\.\d+)?)", 1)
    was = lambda t: F.when(t != "", F.replace(t, F.lit(","), F.lit("")).try_cast("double"))
    # Most texts hold no part of these words that is written in one way only (ſ counts as s, ı as i): they run no expression.
    low = F.lower("full_text")
    there = F.col("price").isNotNull() & (low.contains("wa") | low.contains("mrp") | low.contains("nal"))
    return F.when(there, let(let(said, was), claim)).otherwise(no_finding())


def page_immortal_account() -> Column:
    any_ = lambda low, ws: reduce(Column.__or__, [low.contains(w) for w in ws])
    test = lambda low: any_(low, ["account settings", "my account", "profile settings"]) & ~any_(low, ["delete account", "close account", "delete my account", "remove account"])
    one = found("DPAF-OB-IA", 5, "indicative", 0.4, "Account settings without a way to delete the account.", {"page_type": F.lit("account"), "delete_option_found": F.lit(False)}, name="Immortal Accounts (beyond CCPA-13)")
    return when(let(F.lower("full_text"), test), one)


def page_comparison_prevention() -> Column:
    one = found("DPAF-OB-PC", 6, "indicative", 0.35, "Text selection is switched off.", {"css_or_js_blocking_selection": F.lit(True)}, name="Price Comparison Prevention (beyond CCPA-13)")
    return when(F.lower("raw_html").rlike("user-select: ?none"), one)


def page_forced_consent() -> Column:
    def required(name: str, id_: str, kind: Callable[[Column], Column], first: int) -> Column:
        test = lambda e: e["required"] & hits(e["label_text"], lx.UNRELATED_CONSENT) & ~hits(e["label_text"], lx.LAWFUL_CONTEXT)
        proof = lambda e: {"control_id": e[id_], "control_kind": kind(e), "label_text": e["label_text"], "matched_purpose": first_match(e["label_text"], lx.UNRELATED_CONSENT), "required_attribute_present": F.lit(True)}
        return each(name, test, lambda e, i: found("DP-04", 8, "provable", 1.0, F.concat(F.lit("Required: "), e["label_text"]), proof(e), elem=i + first))

    return F.concat(required("checkboxes", "id", lambda e: F.coalesce(e["input_type"], F.lit("checkbox")), 0), required("form_fields", "name", lambda e: e["field_type"], 10_000))


def page_inescapable_overlay() -> Column:
    """A blocking overlay of a tenth of the view that asks for something and offers no way out; null geometry gives no row."""
    none = F.array().cast("array<string>")
    shut = lambda e: e["is_blocking"] & (F.size(F.coalesce(e["dismiss_controls"], none)) == 0) & (e["viewport_coverage"] >= 0.1) & ~F.coalesce(e["contents_unreadable"], F.lit(False)) & hits(e["text"], lx.OVERLAY_DEMAND)
    proof = lambda e: {"modal_signature": e["signature"], "viewport_coverage": e["viewport_coverage"], "dismiss_controls_found": none, "quoted_text": F.substring(e["text"], 1, 200)}
    return each("modals", shut, lambda e, i: found("DP-04", 8, "corroborated", 0.75, "The overlay can't be dismissed.", proof(e), elem=i))


def page_saas_billing() -> Column:
    proof = lambda e: {"control_id": e["id"], "control_kind": F.coalesce(e["input_type"], F.lit("checkbox")), "label_text": e["label_text"], "matched_billing_term": first_match(e["label_text"], lx.RECURRING), "selected_on_first_load": F.lit(True)}
    return each("checkboxes", lambda e: e["is_prechecked"] & hits(e["label_text"], lx.RECURRING), lambda e, i: found("DP-12", 11, "provable", 1.0, F.concat(F.lit("Pre-selected recurring charge: "), e["label_text"]), proof(e), elem=i, once=_control(e)))


def page_rogue_alert() -> Column:
    test = lambda e: hits(e["text"], lx.SYSTEM_ALERT) & hits(e["text"], lx.INSTALL_CTA)
    alert = lambda e: first_match(e["text"], lx.SYSTEM_ALERT)
    proof = lambda e: {"source": F.lit("overlay"), "signature": e["signature"], "alert_framing_quote": alert(e), "install_cta_quote": first_match(e["text"], lx.INSTALL_CTA), "binary_analysis_performed": F.lit(False)}
    return each("modals", test, lambda e, i: found("DP-13", 12, "indicative", 0.6, F.concat(F.lit("Alert framing: "), alert(e)), proof(e), elem=i))


def page_disguised_executable() -> Column:
    honest = lambda e: F.lower(F.coalesce(e["text"], F.lit(""))).rlike(r"download|install|\.exe|\.apk|setup|installer")
    test = lambda e: F.lower(F.split(e["href"], r"\?")[0]).rlike(lx.EXECUTABLE) & ~honest(e)
    return each("links", test, lambda e, i: found("DP-13", 12, "indicative", 0.5, F.concat(F.lit("Leads to a program: "), e["href"]), {"anchor_text": e["text"], "href": e["href"], "binary_analysis_performed": F.lit(False)}, elem=i))


def page_interface_interference() -> Column:
    """The first decline button is fainter or smaller than the first accept button."""
    pick = lambda role: F.get(F.filter("buttons", lambda b: b["role"] == role), F.lit(0))
    area = lambda b: b["bbox"]["width"] * b["bbox"]["height"]

    def judged(x: Column) -> Column:
        a, d = x["a"], x["d"]
        reasons = F.array_compact(F.array(
            F.when(d["contrast_ratio"] < 3.0, "low contrast"), F.when((area(d) > 0) & (area(a) / F.nullif(area(d), F.lit(0.0)) >= 2), "smaller"),
            F.when(a["font_size_px"] / F.greatest(d["font_size_px"], F.lit(1.0)) >= 1.5, "smaller text")))
        one = found("DP-06", 13, "corroborated", 0.9, F.concat(F.lit("Decline button: "), F.array_join(reasons, ", ")), {"accept_text": a["text"], "decline_text": d["text"], "accept_contrast": a["contrast_ratio"], "decline_contrast": d["contrast_ratio"], "reasons": reasons}, layer=2)
        return when(a.isNotNull() & d.isNotNull() & (F.size(reasons) > 0), one)

    return let(F.struct(pick("accept").alias("a"), pick("decline").alias("d")), judged)


def page_disguised_ad() -> Column:
    def reasons(e: Column) -> Column:
        return F.array_compact(F.array(F.when(e["contrast_ratio"] < 4.5, "low contrast"), F.when((e["font_size_px"] < 10) & (e["font_size_px"] != 0), "small text")))

    proof = lambda e: {"disclosure_text": e["text"], "reasons": reasons(e), "contrast_ratio": e["contrast_ratio"], "font_size_px": e["font_size_px"]}
    return each("disclosure_labels", lambda e: F.size(reasons(e)) > 0, lambda e, i: found("DP-09", 14, "corroborated", 0.6, F.concat(F.lit("Ad label: "), F.array_join(reasons(e), ", ")), proof(e), elem=i, layer=2))


CANDIDATE = "array<struct<elem_ord:int,code:string,tier:string,conf:double,quote:string,source:string,turn:int>>"


def wording_candidates() -> Column:
    """Wordings of one page that may shame or trick: declines that lay guilt, double negatives, ticked boxes that mean no."""
    def candidates(array: str, test: Callable[[Column], Column], code: str, tier: str, conf: Callable[[Column], Column], quote: str, turn: int) -> Column:
        one = lambda e, i: F.struct(i.alias("elem_ord"), F.lit(code).alias("code"), F.lit(tier).alias("tier"), conf(e).cast("double").alias("conf"), e[quote].alias("quote"), F.lit("offline").alias("source"), F.lit(turn).alias("turn"))
        return F.coalesce(F.array_compact(F.transform(array, lambda e, i: F.when(test(e), one(e, i)))).cast(CANDIDATE), F.array().cast(CANDIDATE))

    twice = lambda e: hits(e["label_text"], lx.DOUBLE_NEGATIVE)
    return F.concat(
        candidates("buttons", lambda e: (e["role"] == "decline") & (F.length(e["text"]) > 8) & hits(e["text"], lx.GUILT), "DP-03", "indicative", lambda e: F.lit(0.6), "text", 0),
        candidates("checkboxes", lambda e: twice(e) | (F.coalesce(e["is_prechecked"], F.lit(False)) & hits(e["label_text"], lx.OPT_OUT)), "DP-11", "corroborated", lambda e: F.when(twice(e), 0.7).otherwise(0.8), "label_text", 1),
        candidates("buttons", lambda e: hits(e["text"], lx.DOUBLE_NEGATIVE), "DP-11", "corroborated", lambda e: F.lit(0.65), "text", 2))


def _names(code: Column) -> Column:
    return reduce(lambda e, c: F.when(code == c, lx.PATTERNS[c][0]).otherwise(e), lx.PATTERNS, F.lit(""))


def _wording_finding(c: Column, step_ord: Column, at: Column | None = None) -> Column:
    quote = F.lower(F.trim(c["quote"]))
    return found(c["code"], 15, c["tier"], c["conf"], F.concat(F.lit("Wording: "), c["quote"]), {"quoted_text": c["quote"], "source": c["source"], "pattern": c["code"]}, at=at, elem=c["turn"] * 10_000 + c["elem_ord"], once=F.concat_ws("\n", step_ord.cast("string"), c["code"], quote), layer=3, name=_names(c["code"]))


def page_wording() -> Column:
    """Candidates whose quote the page's own text holds, the first of each (code, quote)."""
    def grounded(x: Column) -> Column:
        def test(c: Column) -> Column:
            quote = F.lower(F.trim(c["quote"]))
            return (quote != "") & x["low"].contains(quote)

        return each(x["c"], test, lambda c, i: _wording_finding(c, F.col("step_ord")))

    return let(F.struct(wording_candidates().alias("c"), F.lower("full_text").alias("low")), grounded)


# ---- Findings of a funnel -------------------------------------------------------------------------------------------


def _end(pick: Callable, name: str) -> Column:
    s = F.struct("step_ord", "step_name", "price", "price_currency", "full_text", "line_items")
    return pick(F.when(F.col("price").isNotNull(), s), F.when(F.col("price").isNotNull(), F.col("step_ord"))).alias(name)


def funnel_drip_pricing() -> Column:
    """The last priced page states a total above the first price by more than 2 %, with a charge the first page doesn't name."""
    a, z = F.col("a"), F.col("z")
    names = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda i: F.lower(F.trim(F.coalesce(i["name"], F.lit("")))))))
    none = F.array().cast("array<struct<name:string,price:double>>")
    items, before = F.coalesce(z["line_items"], none), F.coalesce(a["line_items"], none)
    order = (F.size(items) > 0) & (F.size(items) <= 12) & ((F.size(before) == 0) | (names(before) != names(items)))
    total = F.aggregate(items, F.lit(0.0), lambda acc, i: acc + i["price"])
    hidden = lambda low: F.transform(F.filter(items, lambda i: i["name"].isNotNull() & (i["name"] != "") & (i["price"] > 0) & ~low.contains(F.lower(i["name"]))), lambda i: i["name"])

    def judged(x: Column) -> Column:
        final, mark = x["final"], F.coalesce(F.nullif(z["price_currency"], F.lit("")), a["price_currency"], F.lit(""))
        extra = F.round(final - a["price"], 2)
        drips = (final != 0) & (a["price"] != 0) & (final > a["price"] * 1.02) & (F.size(x["hidden"]) > 0) & ~mentions_amount(a["full_text"], final)
        text = F.concat(F.lit("From "), money_text(a["price"], mark), F.lit(" to "), money_text(final, mark), F.lit(": "), money_text(extra, mark), F.lit(" not shown at first."))
        return when(drips, found("DP-08", 1, "provable", 1.0, text, {"disclosed_price": a["price"], "final_total": final, "hidden_amount": extra, "undisclosed_line_items": x["hidden"]}, at=z, step=F.concat(a["step_name"], F.lit(" -> "), z["step_name"])))

    final = F.coalesce(stated_total(z["full_text"]), F.when(order, total), z["price"])
    low = F.lower(F.coalesce(a["full_text"], F.lit("")))
    # Hidden charges first: they are quick to see, and most funnels have none.
    some = lambda h: F.when((F.size(h) > 0) & states_total(z["full_text"]), let(F.struct(final.alias("final"), h.alias("hidden")), judged)).otherwise(no_finding())
    return F.when(a["step_ord"] < z["step_ord"], let(let(low, hidden), some)).otherwise(no_finding())


def _claims() -> Column:
    number = lambda t: F.when(t != "", F.replace(t, F.lit(","), F.lit("")).try_cast("double"))
    price = lambda e: let(F.regexp_extract(e["text"], r"[₹$][\s ]?([\d,]+(?:\.\d+)?)", 1), number)
    return F.filter(F.transform("buttons", lambda e, i: F.struct(i.alias("elem_ord"), e["text"].alias("text"), price(e).alias("claimed"))), lambda c: c["claimed"].isNotNull())


def funnel_bait_and_switch() -> Column:
    """A button's price differs from the next page's by more than 2 %, and by more than 1."""
    def of(s: Column, i: Column) -> Column:
        after = F.get("seq", i + 1)["price"]
        return each(s["claims"], lambda c: F.abs(after - c["claimed"]) > F.greatest(c["claimed"] * 0.02, F.lit(1.0)), lambda c, _: found("DP-07", 7, "corroborated", 0.7, F.concat(F.lit("Button: "), c["text"]), {"button_text": c["text"], "claimed_price": c["claimed"], "actual_price_on_next_page": after}, at=s, elem=c["elem_ord"]))

    return F.flatten(F.transform("seq", of))


def _commitment() -> Column:
    """The first button of a page that commits: a call to action that is no newsletter, on a page with a recurring price or without newsletter words."""
    fit = lambda e: hits(e["text"], lx.COMMITMENT_CTA) & ~hits(e["text"], lx.NON_COMMITMENT) & (hits(F.col("full_text"), lx.RECURRING_PRICE) | ~hits(F.col("full_text"), lx.NON_COMMITMENT))
    return F.get(F.filter("buttons", fit), F.lit(0))["text"]


def _recurs() -> Column:
    return first_match(F.col("full_text"), lx.RECURRING)


def funnel_late_disclosure() -> Column:
    def after(offer: Column) -> Column:
        def told(d: Column) -> Column:
            one = found("DP-05", 9, "corroborated", 0.85, F.concat(F.lit("Recurring charge first stated at "), d["step_name"]), {"offer_step": offer["step_name"], "offer_step_disclosed_recurring": F.lit(False), "disclosure_step": d["step_name"], "quoted_text": d["recurs"]}, at=d, step=F.concat(offer["step_name"], F.lit(" -> "), d["step_name"]))
            return when(offer["commit"].isNotNull() & offer["recurs"].isNull() & d["recurs"].isNotNull(), one)

        return let(F.get(F.filter("seq", lambda s: (s["step_ord"] > offer["step_ord"]) & s["recurs"].isNotNull()), F.lit(0)), told)

    return let(F.get(F.filter("seq", lambda s: s["commit"].isNotNull()), F.lit(0)), after)


def funnel_path_asymmetry() -> Column:
    steps = lambda role: F.array_distinct(F.transform(F.filter("seq", lambda s: s["role"] == role), lambda s: s["step_name"]))
    first = F.get(F.filter("seq", lambda s: s["role"].isin("signup", "cancel")), F.lit(0))

    def judged(x: Column) -> Column:
        up, down = x["up"], x["down"]
        ratio = F.size(down) / F.nullif(F.size(up), F.lit(0))
        one = found("DP-05", 9, "corroborated", F.least(0.6 + 0.1 * ratio, F.lit(0.9)), F.concat(F.lit("Cancelling takes more steps: "), F.size(down).cast("string")), {"signup_step_count": F.size(up), "cancel_step_count": F.size(down), "asymmetry_ratio": F.round(ratio, 2), "signup_steps": up, "cancel_steps": down}, at=x["at"], step=F.concat(F.get(up, F.lit(0)), F.lit(" -> "), F.try_element_at(down, F.lit(-1))))
        return when((F.size(up) >= 1) & (F.size(down) > F.size(up)), one)

    return let(F.struct(steps("signup").alias("up"), steps("cancel").alias("down"), first.alias("at")), judged)


def _way_out() -> Column:
    text = F.concat_ws("\n", "full_text", F.transform("links", lambda x: x["text"]))
    return hits(text, lx.CANCEL_ROUTE) | F.coalesce(F.col("role") == "cancel", F.lit(False))


def funnel_missing_cancel_route() -> Column:
    last = F.try_element_at("seq", F.lit(-1))
    no_way = F.exists("seq", lambda s: s["recurs"].isNotNull()) & ~F.exists("seq", lambda s: s["way"]) & F.exists("seq", lambda s: s["commit"].isNotNull())
    return when(no_way, found("DP-05", 9, "indicative", 0.45, "No way to cancel was seen.", {"recurring_commitment_present": F.lit(True), "cancellation_route_found": F.lit(False), "steps_searched": F.transform("seq", lambda s: s["step_name"])}, at=last))


# ---- Plans of their own: reloads, overlays, verdicts of a model -----------------------------------------------------


def _urgency_value(text: Column, pattern: str) -> Column:
    """What one pattern claims: a clock near a deadline word, else the last count in the match that is no price; '' if none."""
    span = F.regexp_substr(text, F.lit(java(pattern)))
    near = F.substring(text, F.regexp_instr(text, F.lit(java(pattern))), F.length(span) + 24)
    clock = F.replace(F.regexp_substr(near, F.lit(java(lx.CLOCK))), F.lit(" "), F.lit("")) if any(w in pattern for w in lx.DEADLINE_WORDS) else F.lit(None).cast("string")
    bare = F.regexp_replace(F.regexp_replace(span, java(r"(?:[₹$€£]|\brs\.?|\binr\b)\s*[\d,]*\d"), "¤"), r",\d+", "¤")
    count = F.try_element_at(F.regexp_extract_all(bare, F.lit(r"\b(\d{1,4})\b"), F.lit(1)), F.lit(-1))
    kind = F.when(clock.isNotNull(), "countdown").when(count.isNotNull(), "count").otherwise("")
    return F.struct(F.coalesce(clock, count, F.lit("")).alias("value"), kind.alias("kind"))


def urgency_claims(text: Column) -> Column:
    """array<struct<value,kind,span>> of the patterns that match, in list order; null text claims nothing."""
    claim = lambda t: lambda m: reduce(lambda e, x: F.when(m["ord"] == x[0], _urgency_value(t, x[1])).otherwise(e), enumerate(lx.URGENCY), F.lit(None))
    whole = lambda t: F.transform(all_matches(t, lx.URGENCY), lambda m: F.struct(claim(t)(m).alias("c"), m["span"].alias("span")))
    return F.transform(let(text, whole), lambda x: F.struct(x["c"]["value"].alias("value"), x["c"]["kind"].alias("kind"), x["span"].alias("span")))


def urgency_said(claims: Column) -> Column:
    """struct(value: distinct values sorted and joined, kind: of the first claim with one, spans)."""
    told = F.filter(claims, lambda x: x["value"] != "")
    return F.struct(F.concat_ws(" ", F.array_sort(F.array_distinct(F.transform(told, lambda x: x["value"])))).alias("value"), F.coalesce(F.get(told, F.lit(0))["kind"], F.lit("")).alias("kind"), F.transform(claims, lambda x: x["span"]).alias("spans"))


def seconds(clock: Column) -> Column:
    parts = F.split(clock, ":")
    return F.when(clock.rlike(r"^\d+(:\d+){1,2}$"), F.aggregate(parts, F.lit(0), lambda acc, x: acc * 60 + x.cast("int")))


def unchanged(kind: Column, first: Column, again: Column) -> Column:
    """Whether a claim is false after a reload: a countdown that hasn't gone down, or the same count."""
    return ((kind == "countdown") & (seconds(again) >= seconds(first))) | ((kind == "count") & (first == again))


def _fake_urgency(cap: Captures) -> DataFrame:
    # A row's claims come out of a generator: filters on them would else be pushed below, each with the claims made anew.
    told = lambda c: F.when(F.size(c) > 0, urgency_said(c))
    said = lambda df: df.withColumn("u", F.explode(F.array(let(urgency_claims(F.col("full_text")), told)))).where("u IS NOT NULL")
    one = said(cap.states.select("trace_id", "step_ord", "step_name", "full_text")).where("u.value != ''").select("trace_id", "step_ord", "step_name", F.lit(0).alias("elem_ord"), "u")
    two = said(cap.reloads.select("trace_id", "step_name", "full_text")).select("trace_id", "step_name", F.col("u.value").alias("again"))
    df = one.join(two.hint("merge"), ["trace_id", "step_name"]).withColumn("kind", F.col("u.kind")).where(unchanged(F.col("kind"), F.col("u.value"), F.col("again")))
    tier = F.when(F.col("kind") == "countdown", "corroborated").otherwise("indicative")
    return findings(df, "DP-01", 3, tier, F.when(F.col("kind") == "countdown", 0.9).otherwise(0.6), F.concat(F.lit("Unchanged after a reload: "), "u.value"), {"claim_kind": F.col("kind"), "urgency_language": F.col("u.spans"), "first_load_value": F.col("u.value"), "second_load_value_after_delay": F.col("again")})


def _overlays_and_dismissals(cap: Captures) -> DataFrame:
    """Overlays with what came before them in their trace: how often their signature was dismissed at an earlier step, first and last where.

    One sort by (trace, signature): dismissals and overlays are rows of one table, and a window keeps the first, the last and
    the number of dismissals so far. A repeated step name stands for its last occurrence. What an overlay is goes as one column, so
    that all plans on this table shuffle the same rows, which Spark then does once."""
    at = cap.states.groupBy("trace_id", "step_name").agg(F.max("step_ord").alias("step_ord"))
    gone = cap.dismissals.join(at.hint("merge"), ["trace_id", "step_name"]).select("trace_id", "signature", "step_ord", F.struct("step_ord", "step_name").alias("gone"))
    seen = cap.child("modals").select("trace_id", "step_ord", "step_name", "elem_ord", F.col("e.signature").alias("signature"), "e")
    seen = seen.select("trace_id", "signature", "step_ord", F.struct("step_name", "elem_ord", F.substring("e.text", 1, 200).alias("quote"), F.col("e.is_blocking").alias("blocks")).alias("o"))
    before = Window.partitionBy("trace_id", "signature").orderBy("step_ord").rangeBetween(Window.unboundedPreceding, -1)
    every = seen.unionByName(gone, allowMissingColumns=True)
    return every.withColumns({"first": F.min("gone").over(before), "last": F.max("gone").over(before), "times": F.count("gone").over(before)}).where("o IS NOT NULL")


def _nagging(cap: Captures) -> DataFrame:
    """An overlay dismissed at an earlier step that comes back."""
    df = _overlays_and_dismissals(cap).where("times > 0 AND signature IS NOT NULL").select("trace_id", "signature", "step_ord", "first", "last", "times", "o.*")
    steps = F.array_distinct(F.array("first.step_name", "last.step_name"))
    return findings(df, "DP-10", 10, "provable", 1.0, F.concat(F.lit("Dismissed before: "), "signature"), {"modal_signature": F.col("signature"), "dismissed_at_steps": steps, "times_dismissed": F.col("times"), "reappeared_at_step": F.col("step_name"), "quoted_text": F.col("quote")})


def _interruption_volume(cap: Captures) -> DataFrame:
    """Three or more different blocking overlays, none of which is reported as nagging."""
    by = _overlays_and_dismissals(cap).where("signature IS NOT NULL").groupBy("trace_id", "signature").agg(F.bool_or("o.blocks").alias("blocks"), F.bool_or(F.col("times") > 0).alias("nags"), F.max(F.when(F.col("o.blocks"), F.struct("step_ord", "o.step_name"))).alias("z")).where("blocks")
    df = by.groupBy("trace_id").agg(F.array_sort(F.collect_set("signature")).alias("s"), F.bool_or("nags").alias("nags"), F.max("z").alias("z")).where("size(s) >= 3 AND NOT nags").select("trace_id", "s", "z.*", F.lit(0).alias("elem_ord"))
    return findings(df, "DP-10", 10, "indicative", 0.4, F.lit("Repeated blocking interruptions."), {"distinct_blocking_interruptions": F.size("s"), "signatures": F.col("s")})


def external_candidates(cap: Captures, verdicts: DataFrame) -> DataFrame:
    """Verdicts of a model, a table (trace_id, step_ord, pattern_code, quoted_text, confidence text): unknown codes drop out, a missing code is DP-03, a bad confidence 0.6."""
    known = reduce(lambda e, c: F.when(F.col("code") == c, "corroborated" if c == "DP-11" else "indicative").otherwise(e), lx.PATTERNS, F.lit(None).cast("string"))
    conf = F.col("confidence").try_cast("double")
    sane = F.when(conf.isNull() | F.isnan(conf), 0.6).otherwise(F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)))
    df = verdicts.withColumn("code", F.coalesce(F.nullif("pattern_code", F.lit("")), F.lit("DP-03"))).withColumn("tier", known).where("tier IS NOT NULL")
    df = df.join(cap.states.select("trace_id", "step_ord", "step_name").hint("merge"), ["trace_id", "step_ord"])
    return df.select("trace_id", "step_ord", "step_name", F.lit(0).alias("elem_ord"), "code", "tier", sane.alias("conf"), F.col("quoted_text").alias("quote"), F.lit("external").alias("source"), F.lit(3).alias("turn"))


def ground_and_dedupe(cap: Captures, candidates: DataFrame, ord_: int = 15) -> DataFrame:
    """Keep candidates whose quote the page's text holds, the first of each (step, code, quote); what was found offline comes first."""
    quote = F.lower(F.trim("quote"))
    df = candidates.join(cap.states.select("trace_id", "step_ord", "full_text").hint("merge"), ["trace_id", "step_ord"])
    df = df.where((quote != "") & F.lower("full_text").contains(quote)).withColumn("__q", quote)
    w = Window.partitionBy("trace_id", "step_ord", "code", "__q").orderBy("turn", "elem_ord", F.desc("conf"), "quote")
    df = df.withColumn("__r", F.row_number().over(w)).where("__r = 1").withColumn("elem_ord", F.col("turn") * 10_000 + F.col("elem_ord"))
    out = findings(df, "DP-03", ord_, F.col("tier"), F.col("conf"), F.concat(F.lit("Wording: "), "quote"), {"quoted_text": F.col("quote"), "source": F.col("source"), "pattern": F.col("code")}, layer=3)
    return out.withColumn("pattern_code", F.get_json_object("evidence", "$.pattern")).withColumn("pattern_name", _names(F.col("pattern_code")))


# ---- The detectors and the pass -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Detector:
    """A column over a state (page) or over a trace's gathered states (funnel), or a plan; `needs` names the columns without
    which it finds nothing (one of several after a bar)."""

    needs: str
    page: Callable[[], Column] | None = None
    funnel: Callable[[], Column] | None = None
    plan: Callable[[Captures], DataFrame] | None = None

    def can(self, cap: Captures) -> bool:
        return all(any(cap.has(c) for c in one.split("|")) for one in self.needs.split())


DRIP = Detector("price full_text line_items", funnel=funnel_drip_pricing)
BASKET = Detector("checkboxes", page=page_basket_sneaking)
URGENCY = Detector("full_text capture_no", plan=_fake_urgency)
REFERENCE = Detector("price full_text", page=page_reference_pricing)
IMMORTAL = Detector("full_text", page=page_immortal_account)
COMPARISON = Detector("raw_html", page=page_comparison_prevention)
BAIT = Detector("buttons price", funnel=funnel_bait_and_switch)
CONSENT = Detector("checkboxes|form_fields", page=page_forced_consent)
OVERLAY = Detector("modals", page=page_inescapable_overlay)
LATE = Detector("buttons full_text", funnel=funnel_late_disclosure)
ASYMMETRY = Detector("role", funnel=funnel_path_asymmetry)
MISSING = Detector("buttons full_text", funnel=funnel_missing_cancel_route)
NAGGING = Detector("modals dismissals", plan=_nagging)
VOLUME = Detector("modals dismissals", plan=_interruption_volume)
SAAS = Detector("checkboxes", page=page_saas_billing)
ROGUE = Detector("modals", page=page_rogue_alert)
EXECUTABLE = Detector("links", page=page_disguised_executable)
INTERFERENCE = Detector("buttons", page=page_interface_interference)
AD = Detector("disclosure_labels", page=page_disguised_ad)
WORDING = Detector("buttons|checkboxes full_text", page=page_wording)

LAYER1 = [DRIP, BASKET, URGENCY, REFERENCE, IMMORTAL, COMPARISON, BAIT]
LAYER1_FLOW = [CONSENT, OVERLAY, LATE, ASYMMETRY, MISSING, NAGGING, VOLUME, SAAS, ROGUE, EXECUTABLE]
LAYER2 = [INTERFERENCE, AD]
LAYER3 = [WORDING]
#: What funnel detectors gather of each state; the rest of a state isn't shuffled.
GATHERED = {
    BAIT: {"price": lambda: F.col("price"), "claims": _claims}, LATE: {"commit": _commitment, "recurs": _recurs}, ASYMMETRY: {"role": lambda: F.col("role")},
    MISSING: {"commit": _commitment, "recurs": _recurs, "way": _way_out}, DRIP: {},
}


def run(cap: Captures, detectors: list[Detector]) -> DataFrame:
    """Findings of the detectors that have something to read: one scan of the states, and one aggregation where a funnel detector is among them."""
    able = [x for x in detectors if x.can(cap)]
    pages, funnels, plans = ([x for x in able if getattr(x, kind)] for kind in ("page", "funnel", "plan"))
    out = [x.plan(cap) for x in plans]
    if pages or funnels or not plans:
        local = _local(pages)
        rows = cap.states.select("trace_id", local.alias("found"))
        if funnels:
            rows = _gathered(cap, funnels, local)
        # From an inner explode a filter on the array's size would follow, and work out all detectors a second time for it.
        rows = rows.select("trace_id", F.explode_outer("found").alias("f")).where("f IS NOT NULL").select("trace_id", "f.*")
        if any(x in (BASKET, SAAS, WORDING) for x in pages):
            first = Window.partitionBy("trace_id", "detector_ord", "once").orderBy("step_ord", "elem_ord")
            rows = rows.withColumn("nth", F.row_number().over(first)).where("once IS NULL OR nth = 1")
        out.append(rows.select(FINDING))
    return reduce(DataFrame.unionByName, out)


def tally(cap: Captures, flags: dict[str, Column]) -> DataFrame:
    """(trace_id, n, …): the number of a trace's findings by all detectors, and whether any state has a flag; states are scanned and shuffled once."""
    able = [x for x in [*LAYER1, *LAYER1_FLOW, *LAYER2, *LAYER3] if x.can(cap)]
    pages, funnels, plans = ([x for x in able if getattr(x, kind)] for kind in ("page", "funnel", "plan"))
    once = F.array_distinct(F.transform(F.filter("found", lambda f: f["once"].isNotNull()), lambda f: F.struct(f["detector_ord"], f["once"])))
    n = F.size(F.filter("found", lambda f: f["once"].isNull())) + F.size(once)
    rows = _gathered(cap, funnels, _local(pages), flags).select("trace_id", n.cast("long").alias("n"), *flags)
    if not plans:
        return rows
    more = reduce(DataFrame.unionByName, [x.plan(cap).select("trace_id") for x in plans]).groupBy("trace_id").agg(F.count("*").alias("more"))
    return rows.join(more.hint("merge"), "trace_id", "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))).drop("more")


def _local(pages: list[Detector]) -> Column:
    return F.concat(no_finding(), *[x.page() for x in pages])


def _gathered(cap: Captures, funnels: list[Detector], local: Column, flags: dict[str, Column] | None = None) -> DataFrame:
    """(trace_id, found, …): a trace's page findings, and those of the funnel detectors over its states in order; flags that any state has."""
    flags = flags or {}
    more = {name: make for x in funnels for name, make in GATHERED[x].items()}
    slim = F.struct("step_ord", "step_name", *[make().alias(name) for name, make in more.items()])
    ends = ["price", "price_currency", "full_text", "line_items"] if DRIP in funnels else []
    states = cap.states.select("trace_id", "step_ord", "step_name", *ends, local.alias("local"), slim.alias("s"), *[flag.alias(name) for name, flag in flags.items()])
    gather = [F.flatten(F.collect_list("local")).alias("local")]
    gather += [F.array_sort(F.collect_list("s")).alias("seq")] if more else []
    gather += [_end(F.min_by, "a"), _end(F.max_by, "z")] if DRIP in funnels else []
    gather += [F.bool_or(name).alias(name) for name in flags]
    return states.groupBy("trace_id").agg(*gather).select("trace_id", F.concat("local", *[x.funnel() for x in funnels]).alias("found"), *flags)


def _alone(detector: Detector, doc: str | None = None) -> Callable[[Captures], DataFrame]:
    def detect(cap: Captures) -> DataFrame:
        return detector.plan(cap) if detector.plan else run(Captures(cap.all_states, cap.dismissals), [detector])

    detect.__doc__ = doc or (detector.page or detector.funnel or detector.plan).__doc__
    return detect


detect_drip_pricing, detect_basket_sneaking, detect_fake_urgency = _alone(DRIP), _alone(BASKET), _alone(URGENCY, "A countdown that hasn't gone down, or a count that is the same, after a reload.")
detect_reference_pricing, detect_immortal_account, detect_comparison_prevention = _alone(REFERENCE), _alone(IMMORTAL), _alone(COMPARISON)
detect_bait_and_switch, detect_forced_consent, detect_inescapable_overlay = _alone(BAIT), _alone(CONSENT), _alone(OVERLAY)
detect_late_recurring_disclosure, detect_path_asymmetry, detect_missing_cancel_route = _alone(LATE), _alone(ASYMMETRY), _alone(MISSING)
detect_nagging, detect_interruption_volume, detect_saas_billing = _alone(NAGGING), _alone(VOLUME), _alone(SAAS)
detect_rogue_alert, detect_disguised_executable = _alone(ROGUE), _alone(EXECUTABLE)
detect_interface_interference, detect_disguised_ad = _alone(INTERFERENCE), _alone(AD)


def first_commitment_state(cap: Captures) -> DataFrame:
    """(trace_id, step_ord, step_name, full_text, button) of each trace's first state with a button that commits."""
    df = cap.states.select("trace_id", "step_ord", "step_name", "full_text", _commitment().alias("button")).where("button IS NOT NULL")
    return df.groupBy("trace_id").agg(F.min_by(F.struct("step_ord", "step_name", "full_text", "button"), "step_ord").alias("s")).select("trace_id", "s.*")


def run_layer1(cap: Captures) -> DataFrame:
    return run(cap, LAYER1)


def run_layer1_flow(cap: Captures) -> DataFrame:
    return run(cap, LAYER1_FLOW)


def run_layer2(cap: Captures) -> DataFrame:
    return run(cap, LAYER2)


def run_layer3(cap: Captures, verdicts: DataFrame | None = None) -> DataFrame:
    """Wording found here, and verdicts of a model where a table of them is given."""
    if verdicts is None:
        return run(cap, LAYER3)
    own = cap.states.select("trace_id", "step_ord", "step_name", F.explode(wording_candidates()).alias("c"))
    own = own.select("trace_id", "step_ord", "step_name", *[f"c.{x}" for x in ("elem_ord", "code", "tier", "conf", "quote", "source", "turn")])
    return ground_and_dedupe(cap, own.union(external_candidates(cap, verdicts)))


def audit(cap: Captures, verdicts: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """All detectors; strongest first, then in the order of detectors, traces, steps and elements."""
    every = run(cap, [*LAYER1, *LAYER1_FLOW, *LAYER2, *([] if verdicts is not None else LAYER3)])
    if verdicts is not None:
        every = every.unionByName(run_layer3(cap, verdicts))
    # Dealt first: the sort samples its input, and would run every detector again for that.
    return every.repartition("trace_id").orderBy(F.desc("confidence"), "detector_ord", "trace_id", "step_ord", "elem_ord") if ordered else every
