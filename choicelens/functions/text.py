"""Column expressions over captured text: lexicon spans, money, contrast, URLs, redaction.

All of them stay inside the JVM. Patterns are literals, so each compiles once; `\\s` also stands for the no-break space.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as lx


def java(pattern: str) -> str:
    """Case-insensitive and Unicode-aware."""
    return "(?iu)" + pattern.replace(r"[\s-]", r"[\s -]").replace(r"\s", r"[\s ]").replace(r"[[\s ] -]", r"[\s -]")


def quotes(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("’"), F.lit("'")), F.lit("‘"), F.lit("'"))


@cache
def literal_of(pattern: str) -> str:
    """A word of lower-case ASCII letters that every match of the pattern holds, '' if none is plain to see."""
    rest, before = pattern, None
    while rest != before:  # innermost groups first, with what makes them optional
        before, rest = rest, re.sub(r"\((?:[^()\\]|\\.)*\)[?*]?(\{[^}]*\})?", " ", rest)
    if "|" in rest:
        return ""
    rest = re.sub(r"\\.|\[[^\]]*\]|\{[^}]*\}", " ", rest)
    return max(re.findall("[a-z]+", re.sub(r".[?*]", " ", rest)), key=len, default="")


@cache
def whole_word(pattern: str) -> bool:
    """Whether that word stands in every match between a boundary, white space or a slash on either side: a text's words then tell of it."""
    word = literal_of(pattern)
    return bool(word) and bool(re.search(rf"(?:\\b|\\s\+| |/){word}(?:\\b|\\s\+| |/)", pattern))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is made once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _low(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))


#: From so many patterns of whole words on, a text is split into its words once, and these meet the table of the patterns' words.
INDEXED = 12


def _screened(text: Column, patterns: list[str], body: Callable[[Column, list[Column]], Column]) -> Column:
    """body(straight text, whether each pattern matches): most texts lack a pattern's word, which is quick to see.

    An inverted index: the text's distinct words are looked up in a table of the words that patterns need, so what a text
    costs hardly grows with the list; a word that may be part of another is looked for in the lower-case text. Only patterns whose word is
    there run their expression."""
    index = sorted({literal_of(p) for p in patterns if whole_word(p)})
    def tests(s: Column) -> Column:
        out = []
        for p in patterns:
            word, test = literal_of(p), s["t"].rlike(java(p))
            there = F.array_contains(s["w"], word) if len(index) >= INDEXED and word in index else s["low"].contains(word)
            out.append(there & test if len(word) > 2 else test)
        return body(s["t"], out)

    def parts(t: Column) -> Column:
        if len(index) < INDEXED:
            return let(F.struct(t.alias("t"), _low(t).alias("low")), tests)
        found = lambda low: F.array_intersect(F.array(*map(F.lit, index)), F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)))
        return let(_low(t), lambda low: let(F.struct(t.alias("t"), low.alias("low"), found(low).alias("w")), tests))

    return let(quotes(text), parts)


def hits(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches."""
    return F.coalesce(_screened(text, patterns, lambda _, tests: reduce(Column.__or__, tests)), F.lit(False))


def first_match(text: Column, patterns: list[str]) -> Column:
    """Span of the first pattern in list order that matches, null if none does."""
    span = lambda t, p: F.regexp_substr(t, F.lit(java(p)))
    return _screened(text, patterns, lambda t, tests: F.coalesce(*[F.when(m, span(t, p)) for p, m in zip(patterns, tests, strict=True)]))


def all_matches(text: Column, patterns: list[str]) -> Column:
    """array<struct<ord,span>> of the patterns that match, in list order; null text matches none."""
    found = lambda t, i, p: F.struct(F.lit(i).alias("ord"), F.regexp_substr(t, F.lit(java(p))).alias("span"))
    return _screened(text, patterns, lambda t, tests: F.array_compact(F.array(*[F.when(m, found(t, i, p)) for i, (p, m) in enumerate(zip(patterns, tests, strict=True))])))


def lexicon_scan(df: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """One row (…, ord, span) for each pattern that occurs in `text`."""
    return df.withColumn("hit", F.explode(all_matches(F.col(text), patterns))).select(*[c for c in df.columns if c not in ("ord", "span")], "hit.*")


MONEY = java(rf"{lx.CURRENCY}\s*({lx.AMOUNT})|({lx.AMOUNT})\s*/-|({lx.AMOUNT})\s*{lx.CODE}\b").replace(r"[,[\s ] ]", r"[,\s ]")


def amount(text: Column) -> Column:
    """The first amount of money in a text, null if there is none."""
    raw = F.get(F.filter(F.array(*[F.regexp_extract(text, MONEY, g) for g in (1, 2, 3)]), lambda x: x != ""), F.lit(0))
    return F.regexp_replace(raw, r"[,\s ]", "").try_cast("double")


def money_mark(text: Column) -> Column:
    """The currency mark of that amount as written, '' if none."""
    return F.coalesce(F.regexp_substr(F.regexp_substr(text, F.lit(MONEY)), F.lit(java(lx.CURRENCY))), F.regexp_substr(F.regexp_substr(text, F.lit(MONEY)), F.lit(java(lx.CODE))), F.lit(""))


def money_text(value: Column, mark: Column) -> Column:
    mark = F.trim(F.coalesce(mark, F.lit("")))
    return F.when(mark.rlike("[A-Za-z]$"), F.concat(value.cast("string"), F.lit(" "), mark)).otherwise(F.concat(mark, value.cast("string")))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\R")


def states_total(text: Column) -> Column:
    return F.coalesce(text.rlike(java(lx.TOTAL)), F.lit(False))


def stated_total(text: Column) -> Column:
    """Amount of the first line with a total word and a non-zero amount."""
    found = F.filter(F.transform(F.filter(lines(text), lambda x: x.rlike(java(lx.TOTAL))), lambda x: amount(x)), lambda a: a.isNotNull() & (a != 0))
    return F.get(found, F.lit(0))


def mentions_amount(text: Column, value: Column) -> Column:
    """Whether a text states a figure, written whole or with cents, with or without thousands commas."""
    there = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]", "")
    whole = F.rint(value).cast("long")
    plain, comma = whole.cast("string"), F.format_number(whole, 0)
    ways = [plain, comma, F.replace(F.format_number(value, 2), F.lit(","), F.lit("")), F.concat(comma, F.lit(".00"))]
    return F.coalesce((value != 0) & reduce(Column.__or__, [there.contains(w) for w in ways]), F.lit(False))


def schema_org_price(html: Column) -> Column:
    """Price of the first JSON-LD block that is an object with an offer's price; broken blocks and lists are passed over."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))
    prices = F.transform(blocks, lambda b: F.get_json_object(b, "$.offers.price").try_cast("double"))
    return F.get(F.filter(prices, lambda p: p.isNotNull()), F.lit(0))


def luminance(colour: Column) -> Column:
    """Relative luminance of rgb(), rgba() or #hex; transparent or unknown counts as 0.5."""
    hex6 = F.when(colour.rlike("^#[0-9A-Fa-f]{3}$"), F.regexp_replace(colour, "([0-9A-Fa-f])", "$1$1")).otherwise(colour)
    rgb = [F.when(hex6.rlike("^#[0-9A-Fa-f]{6}$"), F.conv(F.substring(hex6, 2 + 2 * i, 2), 16, 10)).otherwise(
        F.nullif(F.regexp_extract(colour, r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)", i + 1), F.lit(""))).cast("double") / 255 for i in range(3)]
    clear = F.regexp_extract(colour, r"^rgba\([^)]*,\s*([\d.]+)\s*\)$", 1).try_cast("double") == 0
    part = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    value = 0.2126 * part(rgb[0]) + 0.7152 * part(rgb[1]) + 0.0722 * part(rgb[2])
    return F.when(F.coalesce(clear, F.lit(False)), 0.5).otherwise(F.coalesce(value, F.lit(0.5)))


def contrast(fg: Column, bg: Column) -> Column:
    a, b = luminance(fg), luminance(bg)
    return F.round((F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05), 2)


#: What a text must hold for a rule to have anything to do: a cheap test that skips the rule's own expression on most rows.
_GUARDS = {"email": "@", "card": r"\d[ -]*\d[ -]*\d", "id12": r"\d{4}[ -]?\d{4}", "pan": r"[A-Z]{5}\d", "mobile": r"[6-9][\s-]?\d[\s-]?\d", "postal": r"(?i)pin|postal"}


def redact(text: Column) -> Column:
    for kind, pattern, mark in lx.REDACTIONS:
        text = F.when(text.rlike(_GUARDS[kind]), F.regexp_replace(text, pattern, mark)).otherwise(text)
    return text


def _redaction(kind: str, pattern: str, mark: str) -> Callable[[Column], Column]:
    """One rule's step over a struct of the text and the rules' counts."""

    def step(x: Column) -> Column:
        there = F.coalesce(x["t"].rlike(_GUARDS[kind]), F.lit(False))
        text = F.when(there, F.regexp_replace(x["t"], pattern, mark)).otherwise(x["t"])
        n = F.when(there, F.regexp_count(x["t"], F.lit(pattern))).otherwise(F.lit(0))
        return F.struct(text.alias("t"), *[(n if k == kind else x[k]).alias(k) for k, _, _ in lx.REDACTIONS])

    return step


def redact_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Redact text columns and count what each kind of rule replaced, in the rules' order.

    One rule after the other over a struct that a higher-order function carries along, so that each step's text is made once.
    """
    for c in cols:
        none = F.struct(F.col(c).alias("t"), *[F.lit(0).alias(k) for k, _, _ in lx.REDACTIONS])
        state = F.array(none)
        for kind, pattern, mark in lx.REDACTIONS:
            state = F.transform(state, _redaction(kind, pattern, mark))
        df = df.withColumn("__r", F.get(state, F.lit(0)))
        df = df.withColumns({f"{c}_redactions": F.struct(*[F.col(f"__r.{k}").alias(k) for k, _, _ in lx.REDACTIONS]), c: F.col("__r.t")}).drop("__r")
    return df


def redact_json(json: Column) -> Column:
    """Redact the string values of JSON text; names and numbers stay as they are."""
    tokens = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"|[^"]+'), F.lit(0))
    value = lambda x, i: x.startswith('"') & ~F.coalesce(F.get(tokens, i + 1).startswith(":"), F.lit(False))
    return F.array_join(F.transform(tokens, lambda x, i: F.when(value(x, i), redact(x)).otherwise(x)), "")


def button_role(cls: Column) -> Column:
    return F.when(cls.contains("accept"), "accept").when(cls.contains("decline"), "decline").otherwise("neutral")


def modal_signature(id_: Column, cls: Column, text: Column) -> Column:
    """id:, else class: with its words sorted, else text: lower-cased, digits as #, 80 characters."""
    names = F.concat_ws(" ", F.array_sort(F.filter(F.split(F.coalesce(cls, F.lit("")), r"\s+"), lambda x: x != "")))
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), r"\d+", "#")
    return F.when(F.coalesce(id_, F.lit("")) != "", F.concat(F.lit("id:"), id_)).when(names != "", F.concat(F.lit("class:"), names)).otherwise(F.concat(F.lit("text:"), F.substring(plain, 1, 80)))


def _private_v4(n: list[Column]) -> Column:
    a, b, c = n[0], n[1], n[2]
    return (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 100) & b.between(64, 127))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )


def url_host(url: Column) -> Column:
    """Host of a url with a scheme, in lower case, without user, port and a closing dot; '' if it has none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)), r"\.$", "")


def screen_url(url: Column) -> Column:
    """Why a crawl must not follow a url, null if it may. Names aren't resolved; of IPv6 only public unicast may pass."""
    authority = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    scheme = F.lower(F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.-]*):", 1))
    host = url_host(url)
    octets = F.split(host, r"\.")
    dotted = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    number = host.rlike(r"^(0x[0-9a-f]+|\d+)(\.(0x[0-9a-f]+|\d+))*$")
    six = host.startswith("[")
    first, second = (F.conv(F.nullif(F.regexp_extract(host, r"^\[([0-9a-f]{1,4}):([0-9a-f]{0,4})", g), F.lit("")), 16, 10).cast("int") for g in (1, 2))
    second = F.coalesce(second, F.lit(0))
    public = first.between(0x2000, 0x3FFF) & ~((first == 0x2001) & ((second < 0x200) | (second == 0xDB8))) & (first != 0x2002) & ~((first == 0x3FFF) & (second < 0x1000))
    private = F.coalesce(_private_v4([F.get(octets, F.lit(i)).try_cast("int") for i in range(3)]), F.lit(True))
    return (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "empty").when(F.length(url) > 2048, "too long").when(~scheme.isin("http", "https"), "scheme")
        .when(authority.contains("@"), "credentials").when(host == "", "no host")
        .when((host == "localhost") | (host == "0.0.0.0") | host.endswith(".local"), "local")
        .when(dotted, F.when(private, "private address")).when(number, "numeric address").when(six & ~F.coalesce(public, F.lit(False)), "private address")
    )


def url_key(url: Column) -> Column:
    """What names a page, however a link writes its url: host in lower case without a default port, path without dots and a
    closing slash, and query; neither scheme nor fragment. Null where there is no host."""
    parts = [F.regexp_extract(url, r"(?i)^https?://(?:[^/?#]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?", i) for i in (1, 2, 3)]
    host = F.regexp_replace(F.regexp_replace(F.lower(parts[0]), r":(80|443)?$", ""), r"\.$", "")
    def walk(acc: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((s == ".") | (s == ""), acc).otherwise(F.array_append(acc, s))
    path = F.array_join(F.aggregate(F.split(parts[1], "/"), F.array().cast("array<string>"), walk), "/")
    return F.when(host != "", F.concat(host, F.lit("/"), path, parts[2]))


def resolve_url(href: Column, base: Column) -> Column:
    """The url that a link on the page `base` leads to; null for links that lead to no page (mailto:, javascript:, none)."""
    h, b = F.trim(href), F.regexp_replace(base, "#.*", "")
    origin, folder = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1), F.regexp_replace(F.regexp_replace(b, r"\?.*", ""), r"(://[^/]*)$|(?<=[^/:]/)[^/]*$", "$1")
    return (
        F.when(h.isNull(), F.lit(None)).when(h.rlike(r"(?i)^https?://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when((h == "") | h.startswith("#"), b).when(h.startswith("/"), F.concat(origin, h)).when(h.startswith("?"), F.concat(F.regexp_replace(b, r"\?.*", ""), h))
        .when(folder.endswith("/"), F.concat(folder, h)).otherwise(F.concat(folder, F.lit("/"), h))
    )


def normalise_url(url: Column, origin: Column) -> Column:
    """Trimmed; /path under the origin; a given scheme stays (host:port has none); else https://. Null if nothing is left."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(u == "", F.lit(None)).when(u.startswith("/"), F.concat(origin, u)).when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
