"""Operators 5 and 8 against brute force, on planted copies and awkward rows."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from choicelens.llm import decontamination, near_duplicates

SCHEMA = "doc_id long, text string, key string, n int, label string, sh string, w string"


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text):
    w = tokens(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def aligned(a, b):
    """Ordered similarity by the plain quadratic table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1] / (len(a) + len(b) - row[-1])


def classes(docs, linked):
    """Least doc_id of each row's class, by all pairs of different texts that are `linked` (two lists of words)."""
    kinds = collections.defaultdict(list)
    for i, (_, t) in enumerate(docs):
        kinds[tuple(tokens(t)) or ("", t or "")].append(i)
    up = {k: k for k in kinds}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(kinds, 2):
        if a[0] and b[0] and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and linked(a, b):
            up[top(a)] = top(b)
    groups = collections.defaultdict(list)
    for k, rows in kinds.items():
        groups[top(k)] += rows
    return {i: min((docs[j][0] for j in rows if docs[j][0] is not None), default=None) for rows in groups.values() for i in rows}


def by_words(a, b):
    return len(set(a) & set(b)) >= 0.5 * min(len(set(a)), len(set(b))) and aligned(a, b) >= 0.8


def by_shingles(a, b):
    x, y = shingles(" ".join(a)), shingles(" ".join(b))
    return bool(set(x) & set(y)) and aligned(x, y) >= 0.8


def variant(rng, words, edits):
    words = [*words]
    for _ in range(edits):
        i = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.6:
            words[i] = f"v{rng.randrange(10**6)}"
        elif kind < 0.8:
            del words[i]
        else:
            words.insert(i, "new")
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 40, 150, 300]))] for _ in range(60)]
    out = [" ".join(w) for w in base]
    for w in base:
        if len(w) > 30:
            out += [variant(rng, w, rng.randrange(0, 8)) for _ in range(3)]
    hot = [f"h{rng.randrange(300)}" for _ in range(200)]
    out += [variant(rng, hot, rng.randrange(0, 5)) for _ in range(60)]  # near copies that are not all near each other
    shared = " ".join(f"s{i}" for i in range(60))
    out += [f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(70))} {shared}" for _ in range(80)]  # one passage, no copies
    out += ["  ", "", None, "...", "...", "?!", "x" * 3000, " ".join(["again"] * 800), " ".join(["again"] * 790), out[0].upper() + "!", out[5], out[5]]
    rng.shuffle(out)
    return [*enumerate(out), (7, out[7]), (None, "all alone with no id at all here"), (None, "all alone with no id at all here")]


def test_near_duplicates(spark, texts):
    """Classes join nothing but links by words, all links by shingles, and nearly all by words."""
    docs = spark.createDataFrame([(i, t, "k", 1, "l", "s", "w") for i, t in texts], SCHEMA).repartition(4)
    got = near_duplicates.near_duplicates(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in texts)
    mine = collections.defaultdict(set)
    for r in got:
        mine[r.doc_id, r.text_md5].add((r.class_id, r.class_text))
    assert all(len(c) == 1 for c in mine.values())
    of = [next(iter(mine[i, hashlib.md5((t or "").encode()).hexdigest()])) for i, t in texts]
    assert all(c == min(texts[j][0] for j, x in enumerate(of) if x == (c, k)) for c, k in of if c is not None)
    words, whole = classes(texts, by_words), classes(texts, by_shingles)
    group = lambda by: {frozenset(j for j in by if by[j] == c) for c in set(by.values())}
    ours = group(dict(enumerate(of)))
    assert all(any(g <= w for w in group(words)) for g in ours)
    assert all(any(g <= w for w in ours) for g in group(whole))
    assert len(ours) <= 1.03 * len(group(words))
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_buckets(spark, texts, monkeypatch):
    """Nodes that meet at rare words, here in all buckets of over two nodes, find the same links."""
    monkeypatch.setattr(near_duplicates, "LARGE", 2)
    test_near_duplicates(spark, texts)


def test_short_texts_by_length(spark):
    """All pairs of similarity 0.8 or more are found among texts of up to 25 words, by two edits at most here."""
    rng, rows, want = random.Random(12), [], {}
    for n in range(3, 41):
        for edits in (1, 2):
            for _ in range(12):
                a = [f"{n}x{rng.randrange(10**6)}" if rng.random() < 0.7 else f"the{rng.randrange(5)}" for _ in range(n)]
                b = variant(rng, a, edits).split()
                if a != b and b:
                    i = len(rows)
                    rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
                    want[i] = (n, aligned(a, b) >= 0.8)
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, (n, near) in want.items():
        assert (got[i] == got[i + 1]) == near or n > 25, (rows[i], rows[i + 1])
    far = [got[i] == got[i + 1] for i, (n, near) in want.items() if near and n > 25]
    assert sum(want[i][1] for i in want if want[i][0] <= 25) > 200 and sum(far) >= 0.95 * len(far)


def test_alignment():
    rng = random.Random(4)
    for _ in range(200):
        a = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(8, 120))]
        b = variant(rng, a, rng.randrange(0, 6)).split() or ["x"]
        code = lambda ws: np.array([hash(w) & 0xFFFFFFFF for w in ws], "<u4").tobytes()
        exact = aligned(a, b)
        ours = near_duplicates.alignment(code(a), code(b))
        assert (ours >= 0.8) == (exact >= 0.8) and (exact < 0.8 or ours == pytest.approx(exact))


def weighted(a, b):
    a, b = collections.Counter(a), collections.Counter(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: f"t{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 9, 12, 15, 20, 24, 33, 45, 59, 80, 120] * 3)]
    items += [(100, " ".join(["la"] * 30)), (101, "too few words"), (102, None), (103, ""), (None, "an item that has no id at all")]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 50, 400])))) for i in range(120)]
    plant = [(200 + i, f"{' '.join(word() for _ in range(rng.randrange(60)))} {items[i][1].upper()}, {' '.join(word() for _ in range(rng.randrange(60)))}") for i in range(36)]
    plant += [(300 + i, f"{' '.join(word() for _ in range(40))} {variant(rng, items[i][1].split(), 1)} {word()}") for i in range(36)]
    plant += [(400 + i, " ".join(items[i][1].split()[: -max(1, len(items[i][1].split()) // 9)])) for i in range(36)]
    plant += [(500, "la " * 400), (501, " ".join(["la"] * 30)), (502, None), (503, ""), (None, items[9][1])]
    rows = docs + plant + [plant[0]]
    table = spark.createDataFrame([(i, t, "k", 1, "l", "s", "w") for i, t in rows], SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(table, bench).collect()}
    want, whole = {}, set()
    for d, t in rows:
        for i, b in items:
            x, y = shingles(t), shingles(b)
            if i is None or len(tokens(b)) < 5 or len(tokens(t)) < 5:
                continue
            best = max(weighted(x[s : s + len(y)], y) for s in range(max(1, len(x) - int(0.75 * len(y)))))
            if best >= 0.8:
                want[(d, i)] = max(best, want.get((d, i), 0))
            if max(weighted(x[s : s + len(y)], y) for s in range(max(1, len(x) - len(y) + 1))) >= 0.8:
                whole.add((d, i))  # by a window of the item's size, or all of a shorter text
    assert whole <= set(got) <= set(want)
    assert all(got[k] <= want[k] + 1e-9 for k in got)
    assert all(got[(200 + i, i)] == 1.0 for i in range(36))
    assert decontamination.contaminated(table.limit(0), bench).count() == 0
    assert decontamination.contaminated(table, bench.limit(0)).count() == 0


def test_exchanged_halves(spark):
    """Passages whose parts changed places: the whole of each is a window that shares most shingles with its item."""
    rng = random.Random(6)
    word = lambda: f"t{rng.randrange(3000)}"
    items = [(i, [word() for _ in range(n)]) for i, n in enumerate([45, 59, 120, 200] * 5)]
    items.append((20, [f"r{k % 12}" for k in range(60)]))
    rows = []
    for i, ws in items:
        cut = len(ws) // 2 if i < 20 else 3
        rows.append((i, " ".join([word() for _ in range(rng.randrange(70))] + ws[cut:] + ws[:cut] + [word() for _ in range(rng.randrange(70))])))
    rows += [(0, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # Another text under an item's id, of the same length, changes nothing.
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in [*items, (1, ["twin", *items[1][1][1:]][::-1])]], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {(i, i) for i, _ in items} | {(None, 1)}
    for (d, i), r in got.items():
        x, y = shingles(rows[1 if d is None else d][1]), shingles(" ".join(items[i][1]))
        best = [weighted(x[s : s + len(y)], y) for s in range(len(x))]
        assert r.similarity == pytest.approx(max(best)) and r.start == best.index(max(best)) and r.words == min(len(y), len(x) - r.start) + 4


def test_similar_texts_meet_at_their_first_shared_word(monkeypatch):
    """op5, pipeline: texts of similarity 0.8 share an early word, also where few bins count all words; the first word that heads share is one of them."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(near_duplicates, "BINS", 64)
    rng = np.random.default_rng(3)
    for n in (6, 20, 60, 300):
        a = rng.integers(0, 2 * n, n).astype("<u4")
        b = a.copy()
        b[rng.choice(n, n // 9, replace=False)] = rng.integers(5 * n, 6 * n, n // 9)
        assert near_duplicates.alignment(a.tobytes(), b.tobytes()) >= 0.8
        two = pd.DataFrame({"key": [1, 2], "w": [a.tobytes(), b.tobytes()]})
        [c] = near_duplicates._binned(iter([two]))
        count = np.zeros(64, np.int64)
        count[c["bin"]] = c["n"]
        assert count.sum() == 2 * n
        [got] = near_duplicates._placed(count, 0.8)(iter([two]))
        x, y = ({r["word"] for r in at} for at in got["at"])
        shared = [w for w in got["head"][0] if w in set(got["head"][1])]
        assert x & y and (not shared or shared[0] in x & y)


def test_texts_just_too_far_apart_do_not_meet(spark, monkeypatch):
    """op5, pipeline: of a crowd of texts at similarity 0.75 or so to one another, few pairs are compared, and those similar enough are linked."""
    monkeypatch.setattr(near_duplicates, "LARGE", 2)
    rng = random.Random(8)
    base = [f"b{min(rng.randrange(500), rng.randrange(500))}" for _ in range(400)]
    texts = [[rng.choice(base) if rng.random() < 0.1 else w for w in base] for _ in range(60)]
    texts = [*enumerate(" ".join(w) for w in [*texts, [*texts[5][:390], *(f"t{i}" for i in range(10))]])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    made, write = [], near_duplicates.written

    def counted(df, name):
        out = write(df, name)
        made.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(near_duplicates, "written", counted)
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()}
    want = classes(texts, lambda a, b: near_duplicates.alignment(*(np.array([*map(hash, w)]).astype("<u4").tobytes() for w in (a, b))) >= 0.8)
    assert got[60] == got[5] and got == want
    assert len(made) == 3 and made[2] < 61 * 60 // 2 // 4


def test_long_texts_meet_once(monkeypatch):
    """op5, pipeline: long texts whose heads share nothing meet at the first word they share and hardly at others; parities let every similar pair pass."""
    import pandas as pd

    rng = np.random.default_rng(4)
    for n in (60, 300, 900, 3000):
        a = rng.integers(0, 4 * n, n).astype("<u4")
        b = a.copy()
        b[rng.choice(n, n // 9, replace=False)] = rng.integers(5 * n, 6 * n, n // 9)
        two = pd.DataFrame({"key": [1, 2], "w": [a.tobytes(), b.tobytes()]})
        [got] = near_duplicates._placed(np.full(near_duplicates.BINS, 2), 0.8)(iter([two]))
        x, y = ({r["word"]: set(r["before"]) for r in at} for at in got["at"])
        shared = [w for w in x if w in y]
        meet = [w for w in shared if not x[w] & y[w]]
        assert shared[0] in meet and len(meet) <= 3
        assert sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(*got["parity"], strict=True)) <= 2 * (n // 9)
