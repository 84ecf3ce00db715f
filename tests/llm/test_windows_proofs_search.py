"""Operators 11, 12 and 13 against brute force, on given and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from choicelens.llm import common, lexical_search, manifest, substrings

SF = "/root/testdata/sf0.001"
#: Columns beyond those that the operators read have names that they use themselves.
ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, none int, chunk int, tree string, ord int, hash string, path string, n int, rank string, nth string, tid int"
X = ("x", 1, 2, "t", 3, "h", "p", 4, "r", "n", 5)
BIG = 2**62 + 1


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *X) for r in rows], ODD).repartition(parts)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)] + ["É", "naïve", "数字", "A-B", "x" * 40, "x" * 39 + "y", "Ab9"]
    say = lambda n: " ".join(rng.choice(words, n))
    hot, line = say(30), say(13)
    rows = [(i, f"{say(i % 17)} {hot if i % 3 == 0 else say(20)}\n{line}\t {say(5)}", ["en", None, "de", ""][i % 4], f"s{i % 3}", 5) for i in range(90)]
    rows += [(200, None, "en", None, None), (201, "", None, "", 0), (202, " \n\t ", "en", "s", 1), (203, say(12), "fr", "s", 1), (204, (say(13) + " ") * 3000, "en", "s", 1), (205, "y" * 3_000_000, "en", "s", 1)]
    rows += [(3, hot, "en", "s", 2)] * 4 + [(None, hot, "en", "s", 2), (None, line, None, None, None), (None, None, "en", "s", 2)] + [(BIG, hot, "de", "s", 2), (BIG + 1, f"{hot} {line}", "de", "s", 2), (2**53 + 1, line, "de", "s", 2)]
    rows += [(i, f"{line} {say(9)}\x0b{hot}\x0c{line}", "en", "s", 3) for i in (-5, -4, 300)] + [(301, f"a b {line}\x1c {hot}", "en", "s", 3)]
    return table(spark, rows)


def ids(x):
    return [(v is not None, v) for v in x]


def kept_by_hand(rows):
    split = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    least = {}
    for r, w in zip(rows, split):
        for i in range(len(w) - 12) if r.doc_id is not None else ():
            key = tuple(w[i : i + 13])
            least[key] = min(least.get(key, r.doc_id), r.doc_id)
    out = collections.Counter()
    for r, w in zip(rows, split):
        gone = {j for i in range(len(w) - 12) if r.doc_id is not None and least[tuple(w[i : i + 13])] < r.doc_id for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substrings(corpus, odd):
    for t in (odd, corpus):
        got = collections.Counter(map(tuple, substrings.deduplicated(t, block=200).collect()))
        want = kept_by_hand(t.collect())
        assert got == want
        assert sum(n * r[2] for r, n in want.items()) > 500
    assert substrings.deduplicated(odd.limit(0)).count() == 0


def test_substrings_where_the_sketch_is_full(corpus, monkeypatch):
    """A sketch that can tell nothing lets all windows through; the result is the same."""
    maps, bits = substrings.sketch(corpus.select("text"), 16)
    assert bits == 16
    monkeypatch.setattr(substrings, "sketch", lambda rows, most: ([np.full_like(m, 255) for m in maps], bits))
    assert collections.Counter(map(tuple, substrings.deduplicated(corpus).collect())) == kept_by_hand(corpus.collect())


def test_sketch_loses_no_window(corpus):
    maps, bits = substrings.sketch(corpus.select("text"))
    texts = [(r.text or "").encode() for r in corpus.collect()]
    _, h, at, doc, m = substrings._windows(texts)
    key = substrings._runs(h, substrings.WINDOW, substrings._A)[at]
    _, inverse = np.unique(key, return_inverse=True)
    lo, hi = np.full(inverse.max() + 1, len(texts)), np.full(inverse.max() + 1, -1)
    np.minimum.at(lo, inverse, doc)
    np.maximum.at(hi, inverse, doc)
    some, across = substrings.maybe_repeated(m, maps, bits), (lo < hi)[inverse]
    assert some[across].all() and across.sum() > 1000 and some.mean() < across.mean() + 0.1


def test_word_hashes_in_slices(monkeypatch):
    text = ("ab cde\nf " * 500 + "z" * 700 + " end\t\tof it").encode()
    whole = substrings.word_hashes(text)
    monkeypatch.setattr(substrings, "SLICE", 64)
    assert (substrings.word_hashes(text) == whole).all() and len(whole) == len(text.split())
    assert len({*map(int, whole)}) == len({*text.split()}) and len(substrings.word_hashes(b"")) == 0


def proofs_by_hand(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def climb(nodes):
        """The root, and each node's siblings as (left, right) of each level."""
        at, paths, groups = nodes, [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(at) > 1:
            up, joined = [], []
            for a in range(0, len(at), 8):
                run = at[a : a + 8]
                for j in range(len(run)):
                    for i in groups[a + j]:
                        paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
                up.append(h(*run))
                joined.append([i for g in groups[a : a + 8] for i in g])
            at, groups = up, joined
        return at[0], paths

    by = collections.defaultdict(list)
    for r in rows:
        by[r.lang].append((r.doc_id is not None, r.doc_id, leaf(r, r.text), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda y: y[:3])
    tops = {x: climb([y[2] for y in by[x]]) for x in langs}
    root, above = climb([tops[x][0] for x in langs])
    out = []
    for i, x in enumerate(langs):
        for (_, _, own, r), path in zip(by[x], tops[x][1]):
            path = path + above[i]
            bent = own if r.doc_id is None or r.text is None or zlib.crc32(str(r.doc_id).encode()) % 3 else leaf(r, r.text.translate(lower))
            for left, right in path:
                bent = h(left, bent, right)
            out.append((r.doc_id, own, tops[x][0], root, h(*[y for s in path for y in s]), bent, bent == root))
    return sorted(out, key=lambda r: (ids(r[:1]), r[1:]))


def test_manifest(corpus, odd, monkeypatch):
    for t in (odd, corpus):
        got = sorted(map(tuple, manifest.tamper_check(t).collect()), key=lambda r: (ids(r[:1]), r[1:]))
        assert got == proofs_by_hand(t.collect())
        assert {r[-1] for r in got} == {True, False}
    assert manifest.tamper_check(odd.limit(0)).count() == 0
    one = odd.where("doc_id = 7")
    assert [tuple(r) for r in manifest.tamper_check(one).collect()] == proofs_by_hand(one.collect())


def test_manifest_in_small_blocks(spark, corpus, monkeypatch):
    """Several rounds of blocks, and the table of ranges joined by shuffling."""
    monkeypatch.setattr(manifest, "DIGITS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    monkeypatch.setattr(common, "FEW_RANGES", 0)
    got = sorted(map(tuple, manifest.tamper_check(corpus).collect()))
    assert got == proofs_by_hand(corpus.collect())


def test_ranks_of_hot_rows(spark):
    """Rows equal in all are dealt over partitions, and ranks have no gap."""
    rows = [("a", 1, "h")] * 3000 + [("a", None, "g")] * 10 + [("b", 5, "h")]
    got = common.ranked(spark.createDataFrame(rows, "tree string, ord long, hash string")).collect()
    assert sorted(r.rank for r in got if r.tree == "a") == list(range(3010)) and {r.n for r in got if r.tree == "b"} == {1}
    assert {r.rank for r in got if r.hash == "g"} == set(range(10))


def ranks_by_hand(docs, items, top=50):
    split = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    tf = [collections.Counter(split(r.text)) for r in docs]
    n = [sum(c.values()) for c in tf]
    some, total = sum(x > 0 for x in n), sum(n)
    df = collections.Counter(t for c in tf for t in c)
    of = collections.defaultdict(set)
    for r in items:
        of[r.item_id] |= {*split(r.text)}
    out = set()
    for item, terms in of.items():
        best = []
        for r, c, k in zip(docs, tf, n):
            m = 50 + 50 * k * some // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                best.append((-s, r.doc_id is None, r.doc_id))
        out |= {(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(best)[:top])}
    return out


def test_search(spark, corpus, odd, monkeypatch):
    given = spark.read.parquet(f"{SF}/benchmark.parquet")
    own = spark.createDataFrame([(1, "w3 W7 naïve", 1, "x"), (1, "w9", 1, "x"), (None, "w3 É 数字", 1, "x"), (2, None, 1, "x"), (3, "...", 1, "x"), (BIG, "Ab9 y", 1, "x"), (5, "nowhere", 1, "x")], "item_id long, text string, slot int, term string")
    for d, i in ((odd, own), (corpus, given)):
        got = [*map(tuple, lexical_search.search(d, i, block=32).collect())]
        assert len(got) == len({*got}) and {*got} == ranks_by_hand(d.collect(), i.collect())
    # More terms than one slice of the vocabulary, more items than a group, no bounds, no broadcast: the same rows.
    for name, value in (("FEW_TERMS", 300), ("GROUP", 8), ("FEW_ITEMS", 0)):
        monkeypatch.setattr(lexical_search, name, value)
    assert {*map(tuple, lexical_search.search(corpus, given, held=500).collect())} == {*got}
    for d, i in ((odd.limit(0), given), (corpus, given.limit(0)), (odd.where("text IS NULL"), given)):
        assert lexical_search.search(d, i).count() == 0


def test_bounds_drop_only_what_cannot_win(spark, corpus, monkeypatch):
    """With few documents to select, items close early and bundles shrink; the best stay the same."""
    given, sizes, own = spark.read.parquet(f"{SF}/benchmark.parquet"), [], lexical_search._bounds
    monkeypatch.setattr(lexical_search, "OWNERS", (0.02, 0.1, 1.0))

    def spy(*a):
        least, closed = own(*a)
        sizes.append(len(closed.value))
        return least, closed

    monkeypatch.setattr(lexical_search, "_bounds", spy)
    got = {*map(tuple, lexical_search.search(corpus, given, 2, 64).collect())}
    assert got == ranks_by_hand(corpus.collect(), given.collect(), 2) and max(sizes) > 0


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_manifest", "op13_lexical_search"])
def test_queries_agree_with_their_sql(spark, name):
    from choicelens.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[x] for x in want.columns) for r in got.collect()) == sorted(want.fetchall())
