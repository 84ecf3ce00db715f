"""Raw HTML pages to page states: static facts by the standard library's parser, one Arrow pass over each partition."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import url_key
from ..operators.extraction import line_items, resolve_price

PAGE = """page_id string, url string, title string, full_text string, links array<struct<text:string,href:string>>,
checkboxes array<struct<id:string,label_text:string,is_prechecked:boolean,input_type:string,required:boolean>>,
buttons array<struct<text:string,role:string>>, form_fields array<struct<name:string,label_text:string,field_type:string,required:boolean>>,
data_price string, line_items array<struct<name:string,price:double>>, money_rows array<string>, schema_price string, error string"""
WITH_HTML = PAGE + ", raw_html string"
BLOCK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table", "nav", "footer", "header", "form", "title"}
SILENT = {"script", "style", "noscript", "template"}


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# What makes a row one of money, and the longest row and label.
_MONEY = re.compile(rf"{lx.CURRENCY}\s*[\d,]|\d[\d,\s]*/-", re.IGNORECASE)
_AMOUNT = re.compile(rf"{lx.PERCENT_BADGE}|{lx.CURRENCY}\s*\d[\d,\s]*(?:\.\d{{1,2}})?|[\d,]+\s*/-", re.IGNORECASE)
ROW, LABEL = 220, 80


def is_money_row(text: str) -> bool:
    if len(text) > ROW or not _MONEY.search(text):
        return False
    label = " ".join(_AMOUNT.sub(" ", text).split())
    return len(label) <= LABEL and any(c.isascii() and c.isalpha() for c in label)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.size, self.quiet, self.open, self.title = [], 0, 0, [], ""
        self.links, self.inputs, self.buttons, self.labels, self.items, self.price, self.json, self.rows = [], [], [], {}, [], None, [], []
        self.ld = False

    def _say(self, text):
        self.text.append(text)
        self.size += len(text)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in SILENT:
            self.ld = tag == "script" and a.get("type") == "application/ld+json"
            self.quiet += 1
        if tag in BLOCK:
            self._say("\n")
        if "data-price" in a:
            self.price = self.price or a["data-price"]
            try:
                self.items.append((a["data-name"], float(a["data-price"])))
            except (KeyError, ValueError):
                pass
        if tag == "input":
            self.inputs.append(a)
            if self.open:
                self.open[-1][4].append(a)
        if tag not in VOID:
            self.open.append((tag, a, len(self.text), self.size, [], len(self.rows)))

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.quiet, self.ld = max(0, self.quiet - 1), False
        if any(x[0] == tag for x in self.open):
            while self._end() != tag:
                pass
        if tag in BLOCK:
            self._say("\n")

    def _end(self):
        """The innermost open element ends here."""
        tag, a, at, size, inputs, rows = self.open.pop()
        named = tag in ("a", "button", "label", "title")
        if named or inputs or self.size - size <= 4 * ROW:
            said = " ".join("".join(self.text[at:]).split())
            if tag == "a" and "href" in a:
                self.links.append((said[:200], a["href"]))
            elif tag == "button" and said:
                c = a.get("class", "")
                self.buttons.append((said, "accept" if "accept" in c else "decline" if "decline" in c else "neutral"))
            elif tag == "label":
                self.labels[a.get("for", "")] = said
            elif tag == "title":
                self.title = said
            for x in inputs:
                x["parent text"] = said
            # The innermost element with a label and an amount is the row.
            if len(self.rows) == rows and is_money_row(said):
                self.rows.append(said)
        return tag

    def close(self):
        super().close()
        while self.open:
            self._end()

    def handle_data(self, data):
        if self.ld:
            self.json.append(data)
        elif not self.quiet:
            self._say(data)


def _schema_price(blocks: list[str]) -> str | None:
    for b in blocks:
        try:
            price = json.loads(b)["offers"]["price"]
            return str(float(price))
        except (ValueError, KeyError, TypeError):
            continue
    return None


#: Characters of HTML read at once: a worker holds the facts of so much, and of one page more, whatever an Arrow batch holds.
CHARS = 1 << 20


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches' rows in their order, in pieces of at most CHARS characters of HTML, or of one page."""
    for b in batches:
        size = b["html"].str.len().fillna(0).cumsum() if len(b) else b["page_id"]
        begin, done = 0, 0
        while begin < len(b):
            end = max(begin + 1, int(size.searchsorted(done + CHARS, side="right")))
            yield b.iloc[begin:end]
            begin, done = end, size.iloc[end - 1]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _cut(batches):
        rows = []
        for page_id, url, html in zip(b["page_id"], b["url"], b["html"], strict=True):
            p, error = _Page(), None
            try:
                p.feed(html or "")
                p.close()
            except Exception as e:  # a corrupt page becomes a row that says so, never a failed task
                error = f"{type(e).__name__}: {e}"
            boxes, fields = [], []
            for a in p.inputs:
                kind, must = a.get("type", "text"), "required" in a or a.get("aria-required") == "true"
                label = p.labels.get(a["id"], "") if a.get("id") else ""
                label = label or a.get("parent text", "")
                if kind in ("checkbox", "radio"):
                    boxes.append({"id": a.get("id", ""), "label_text": label, "is_prechecked": "checked" in a, "input_type": kind, "required": must})
                elif must:
                    fields.append({"name": a.get("name", ""), "label_text": label[:200], "field_type": kind, "required": True})
            lines = (" ".join(x.split()) for x in "".join(p.text).split("\n"))
            rows.append((page_id, url, p.title, "\n".join(x for x in lines if x), [{"text": t, "href": h} for t, h in p.links], boxes, [{"text": t, "role": r} for t, r in p.buttons], fields, p.price, [{"name": n, "price": v} for n, v in p.items], [*dict.fromkeys(p.rows)], _schema_price(p.json), error, html))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("page_id url title full_text links checkboxes buttons form_fields data_price line_items money_rows schema_price error raw_html").split()])


def _read_facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _read(batches):
        yield b.drop(columns="raw_html")


def extract_states(pages: DataFrame, keep_html: bool = False) -> DataFrame:
    """(page_id, url, html) to page states. Rendered geometry stays unknown: only a crawler supplies it. Null pages are
    empty ones, broken pages say so in `error`, repeated rows stay."""
    pages = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")  # as text: beside a null, pandas turns numbers into floats
    got = pages.mapInPandas(_read, WITH_HTML) if keep_html else pages.mapInPandas(_read_facts, PAGE)
    return got.withColumn("page_id", F.col("page_id").cast("long"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Raw pages (page_id, url, html) as captured states, one trace of one step for each, with prices and charges resolved.

    The first reading of a page is its pre-ticked state; nothing is known of overlays, fonts and colours.
    """
    s = _captured(pages).withColumns({"trace_id": F.col("page_id"), "step_ord": F.lit(1), "step_name": F.lit("page"), "site_name": F.get(F.split("url", "/"), F.lit(2)), "role": F.lit(None).cast("string")})
    return s.select(*CAPTURED).drop("role")


CAPTURED = ["trace_id", "step_ord", "step_name", "capture_no", "site_name", "role", "url", "price", "price_source", "full_text", "raw_html", "line_items", "checkboxes", "buttons", "links", "form_fields"]


def funnel_captures(steps: DataFrame, pages: DataFrame) -> DataFrame:
    """Funnels from raw pages: steps (trace_id, site_name, step_ord, step_name, url, and role, if there) with the states of the
    pages that their urls name, however they are written; steps without a page are left out. A page of several steps is read
    once; of several pages of one url the one of least page_id counts."""
    s = _captured(pages).withColumn("key", url_key(F.col("url"))).where("key IS NOT NULL").groupBy("key").agg(F.min_by(F.struct("*"), F.coalesce("page_id", F.lit(2**63 - 1))).alias("s"))
    role = F.col("role") if "role" in steps.columns else F.lit(None).cast("string").alias("role")
    at = steps.select("trace_id", "site_name", "step_ord", "step_name", role, url_key(F.col("url")).alias("key"))
    return at.join(s.hint("merge"), "key").select(*[F.col(c) if c in ("trace_id", "site_name", "step_ord", "step_name", "role") else F.col(f"s.{c}").alias(c) for c in CAPTURED])


def _captured(pages: DataFrame) -> DataFrame:
    s = line_items(resolve_price(extract_states(pages, keep_html=True)))
    boxes = F.transform("checkboxes", lambda x: F.struct(x["id"].alias("id"), x["label_text"].alias("label_text"), x["is_prechecked"].alias("checked"), x["is_prechecked"].alias("is_prechecked"), x["input_type"].alias("input_type"), x["required"].alias("required")))
    return s.select("page_id", F.lit(0).alias("capture_no"), "url", "price", "price_source", "full_text", "raw_html", "line_items", boxes.alias("checkboxes"), "buttons", "links", "form_fields")


def adhoc_steps(urls: DataFrame) -> DataFrame:
    """(trace_id, urls array) to funnel steps (trace_id, site_name, step_ord, step_name, url)."""
    at = urls.select("trace_id", F.posexplode("urls").alias("pos", "url"))
    return at.select("trace_id", F.get(F.split("url", "/"), F.lit(2)).alias("site_name"), (F.col("pos") + 1).alias("step_ord"), F.concat(F.lit("step_"), F.col("pos") + 1).alias("step_name"), "url")


LABELLED = "text string, label string"


def read_labelled_csv(spark: SparkSession, path: str, schema: str = LABELLED) -> DataFrame:
    """Labelled texts from CSV with a header; texts may hold line breaks and quotes, broken rows have null columns."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
