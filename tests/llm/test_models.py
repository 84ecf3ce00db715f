"""Operators 1, 3 and 4 and the pipeline against brute force, on awkward rows."""

import math
import zlib
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from choicelens.llm import neighbours, quality, url_filters

SF = "/root/testdata/sf0.001"


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 16)) + 2 * rng.standard_normal((5, 16))[rng.integers(0, 5, 300)]
    rows = [(i, x.tolist(), "l", 1) for i, x in enumerate(v)] + [(1000 + i, v[7].tolist(), "l", 1) for i in range(40)]
    rows += [(2000, None, "l", 1), (2020, [0.0] * 16, "l", 1), (2040, [math.nan] + [1.0] * 15, "l", 1), (2060, [None] + [1.0] * 15, "l", 1), (2080, [1.0], "l", 1), (None, [1.0] * 16, "l", 1), (5, v[5].tolist(), "l", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, score int").repartition(3)
    got = neighbours.nearest(table, F.col("id") % 20 == 0).collect()
    good = {i: np.array(x) for i, x, *_ in rows if i is not None and x and len(x) == 16 and None not in x and np.isfinite(x).all() and any(x)}
    hit = want = 0
    for q in (i for i in good if i % 20 == 0):
        best = sorted(((-float(good[q] @ x), i) for i, x in good.items() if i != q))[:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == [*range(1, 21)]
        assert all(s == pytest.approx(float(good[q] @ good[i]), abs=1e-9) for _, i, s in mine)
        hit, want = hit + len({i for _, i in best} & {i for _, i, _ in mine}), want + 20
    assert hit / want >= 0.95
    few = neighbours.nearest(table.where("vec_id IN (0, 1, 2)"), F.col("id") % 20 == 0)
    assert few.count() == 2 and neighbours.nearest(table.limit(0), F.col("id") % 20 == 0).count() == 0


def shares_found(spark, v):
    """Share of the true 20 nearest found, over the rows of v whose number is divisible by 20."""
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(table, F.col("id") % 20 == 0).collect()}
    s = v[::20] @ v.T
    s[np.arange(len(s)), np.arange(len(s)) * 20] = -np.inf
    want = {(20 * q, int(i)) for q, best in enumerate(np.argsort(-s, axis=1)[:, :20]) for i in best}
    assert len(got) == len(want)
    return len(got & want) / len(want)


def test_nearest_without_clusters(spark):
    v = np.random.default_rng(3).standard_normal((6000, 64))
    assert shares_found(spark, v / np.linalg.norm(v, axis=1)[:, None]) >= 0.97


@pytest.mark.parametrize("noise", [0.1, 0.01])
def test_nearest_among_near_copies(spark, noise):
    """A third of all rows in one group; scores with two bytes a component tell its members apart."""
    rng = np.random.default_rng(5)
    near = rng.standard_normal(64) + noise / 8 * rng.standard_normal((1500, 64))
    assert shares_found(spark, np.concatenate([near, rng.standard_normal((1500, 64))])) >= 0.97


def test_nearest_with_hubs(spark):
    """Vectors of very different length: a few are the neighbours of nearly all."""
    rng = np.random.default_rng(6)
    assert shares_found(spark, rng.standard_normal((3000, 32)) * rng.lognormal(0, 1, 3000)[:, None]) >= 0.97


def test_nearest_ties_at_the_last_rank(spark):
    """30 different vectors with the same product with the query's: the least ids win."""
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(i, [5.0, float(i), float(-i), 1.0]) for i in range(1, 31)] + [(31, [9.0, 0.0, 0.0, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>"), F.col("id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [31, *range(1, 20)]


def shuffled(spark, run):
    """The rows that tasks write to shuffles meanwhile."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    ids = lambda all_: [all_.apply(i) for i in range(all_.size())]
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = max((x.stageId() for x in ids(stages())), default=-1)
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(x.shuffleWriteRecords() for x in ids(stages()) if x.stageId() > before)


def test_nearest_shuffles_no_row_for_each_edge(spark):
    """24 neighbours and circles of 40: a row for each edge, member or find would be some hundred for each vector."""
    v = np.random.default_rng(7).standard_normal((3000, 16))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert shuffled(spark, lambda: neighbours.nearest(table, F.col("id") % 20 == 0).collect()) < 40 * len(v)


@pytest.mark.parametrize("hot", [0, 1200])
def test_nearest_over_many_blocks(spark, monkeypatch, hot):
    """Small blocks and cells, of which near copies fill several: what a node finds lies in other blocks."""
    monkeypatch.setattr(neighbours, "BLOCK", 256)
    monkeypatch.setattr(neighbours, "CELL", 128)
    rng = np.random.default_rng(8)
    near = rng.standard_normal(32) + 0.01 * rng.standard_normal((hot, 32))
    assert shares_found(spark, np.concatenate([near, rng.standard_normal((3000 - hot, 32))])) >= 0.95


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    odd = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "", 1), (2, " \n", 0), (3, "word " * 30000, 1), (4, "👍 \x00", 0)], "doc_id long, text string, quality int")
    assert quality.classify(odd, labels.limit(0)).where("score = 0.5").count() == 6
    assert quality.classify(odd.limit(0), labels).count() == 0
    assert quality.classify(odd, labels).where("isnan(score)").count() == 0


def test_url_filter(spark):
    page = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">t</a><a href="/own">o</a>' for h in hosts)
    rows = [
        (1, "https://Good.example.net/en/1?x#y", page("friend.example.info"), "h"), (2, "http://friend.example.info/a", page("second.info"), "h"), (3, "http://second.info", "", "h"),
        (4, "https://bad.net/", page("victim.info"), "h"), (5, "http://farm.info/z", page("bad.net", "BAD.net"), "h"), (6, "http://victim.info/de/", None, "h"),
        (7, "https://shop.example.com/de/x", "", "h"), (8, "https://a.org/fr/", "", "h"), (9, "https://a.org/en/", "", "h"), (10, None, None, "h"), (11, "no scheme", "<a href=", "h"), (12, "http://x.net?q=/en/", "", "h"), (12, "http://x.net?q=/en/", "", "h"),
    ]
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert [got[i].rule for i in range(1, 13)] == ["example.net/en/", None, None, "net/", None, None, "example.com/de/", "org/fr/", None, None, None, None]
    assert [got[i].verdict for i in range(1, 13)] == ["allow", "allow", "allow", "block", "block", "allow", "block", "allow", "allow", "allow", "allow", "allow"]
    assert got[2].trust > got[3].trust > 0 and got[5].distrust > 0 and got[6].distrust == 0
    for r in got.values():
        u = urlsplit(rows[r.page_id - 1][1] or "") if "://" in (rows[r.page_id - 1][1] or "") else urlsplit("")
        assert (r.host, r.path) == (u.netloc.lower(), u.path)
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_propagation(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("a", "c", 1), ("x", "b", 1)]
    got = {r.host: r for r in url_filters.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("a", "trust", 1.0), ("c", "distrust", 1.0)], "host string, kind string, mass double")).collect()}
    for kind, seed, es in (("trust", "a", edges), ("distrust", "c", [(b, a, n) for a, b, n in edges])):
        total = {s: sum(n for a, _, n in es if a == s) for s, _, _ in es}
        move = {seed: 0.15}
        rank = dict(move)
        for _ in range(url_filters.ROUNDS):
            new = {}
            for a, b, n in es:
                new[b] = new.get(b, 0) + 0.85 * move.get(a, 0) * n / total[a]
            move = new
            for k, m in new.items():
                rank[k] = rank.get(k, 0) + m
        assert all(got[h][kind] == pytest.approx(m) for h, m in rank.items())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        out.write.parquet(path := corpus_pipeline.new_path(spark, "test-stage"))
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] > seen[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == seen[4]
