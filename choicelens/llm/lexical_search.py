"""Ranked lexical search by pipelined term partitioning.

Terms have owners by how frequent they are; items visit the owners one after another, the owner of the rarest terms first. A
bundle holds, for one item and one block of documents, the documents met so far with their scores. At each stage a cogroup
by block brings bundles and the owner's postings together, which adds whole numbers, and the bundles travel on; after the
last stage each block selects its best, and these meet in one selection per item.

Postings are lists of a term's documents in one block of 4,096, made where the texts are read, so no row is shuffled for
each word. After a stage the 50th best score so far is a bound from below for each item, and the weights of the terms ahead
are one from above: a document that can't reach the first any more leaves its bundle, and an item whose terms ahead can't
reach it takes no new documents. Both are exact. Without the bounds (where there are too many items to hand them to all
tasks) bundles are only larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_columns, ranked, small_batches, written

#: Documents of a block and items of a group: what one cogrouped pair of groups can hold. Documents selected for an item.
DOCS, GROUP, TOP = 4096, 256, 50
#: A term belongs to the first owner whose share of the documents its document frequency doesn't exceed.
OWNERS = (1 / 1000, 1 / 100, 1 / 10, 1.0)
#: Bounds of what is broadcast: terms of a slice of the vocabulary, items with bounds.
FEW_TERMS, FEW_ITEMS = 500_000, 100_000
#: Postings that a task holds before it hands them on.
HELD = 2_000_000
POSTINGS = "block long, tid long, docs binary, tfs binary, ids binary, nulls binary, n_docs long, n_terms long, most long"
BUNDLE = "block long, grp long, slot int, docs binary, scores binary, top array<long>"
_SPLIT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII, as UTF-8; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_SPLIT).split()


def _item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, none, t.decode("utf-8", "replace")) for i, none, text in zip(b["id"], b["none"], b["text"], strict=True) for t in {*terms(text)}]
        yield pd.DataFrame(rows, columns=["id", "none", "term"])


def _postings(vocabulary, size: int, most: int):
    """Lists of one block's documents for each term, and one row of the documents themselves (tid -1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tid, block, held, parts, docs = vocabulary.value, None, 0, [], []

        def flush() -> pd.DataFrame:
            nonlocal held, parts, docs
            at, n, ids, nulls = (np.array(x) for x in zip(*docs, strict=True))
            some = int((n > 0).sum())
            rows = [(block, -1, at.astype("<u2").tobytes(), n.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), some, int(n.sum()), 0)]
            if parts:
                t, tf, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(t, kind="stable")
                t, tf, doc = t[order], tf[order], doc[order]
                cuts = np.flatnonzero(np.r_[True, t[1:] != t[:-1], True])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    rows.append((block, int(t[a]), doc[a:b].astype("<u2").tobytes(), tf[a:b].astype("<u4").tobytes(), None, None, int(b - a), 0, int(tf[a:b].max())))
            held, parts, docs = 0, [], []
            return pd.DataFrame(rows, columns=["block", "tid", "docs", "tfs", "ids", "nulls", "n_docs", "n_terms", "most"])

        for b in batches:
            for nth, id_, none, text in zip(b["nth"].tolist(), b["id"].tolist(), b["none"].tolist(), b["text"], strict=True):
                if docs and (nth // size != block or held > most):
                    yield flush()
                block = nth // size
                found = terms(text)
                docs.append((nth % size, len(found), id_, none))
                mine = np.array([x for x in map(tid.get, found) if x is not None], np.int64)
                if len(mine):
                    t, tf = np.unique(mine, return_counts=True)
                    parts.append((t, tf, np.full(len(t), nth % size)))
                    held += len(t)
        if docs:
            yield flush()

    return run


def _visit(n_docs: int, n_terms: int, closed, top: int, last: bool):
    """One owner's stage for the bundles (left) and postings (right) of one block and group of items.

    closed: (group, slot) of items that take no new documents. At the last stage each block selects its `top` documents."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block, grp = int(key[0]), int(key[1])
        own = right[right["tid"] < 0]
        ids, nulls, m = np.zeros(DOCS, np.int64), np.zeros(DOCS, bool), np.ones(DOCS, np.int64)
        for at, n, i, none in zip(own["docs"], own["tfs"], own["ids"], own["nulls"], strict=True):
            at = np.frombuffer(at, "<u2")
            ids[at], nulls[at] = np.frombuffer(i, "<i8"), np.frombuffer(none, np.uint8) > 0
            m[at] = 50 + 50 * np.frombuffer(n, "<i8") * n_docs // n_terms
        acc = np.zeros((GROUP, DOCS), np.int64)
        for slot, docs, scores in zip(left["slot"], left["docs"], left["scores"], strict=True):
            acc[slot, np.frombuffer(docs, "<u2")] = np.frombuffer(scores, "<i8")
        shut = [s for s in range(GROUP) if (grp, s) in closed.value] if closed else []
        met = acc[shut] > 0
        post = right[right["tid"] >= 0]
        for docs, tfs, weight, slots in zip(post["docs"], post["tfs"], post["weight"], post["slots"], strict=True):
            at, tf = np.frombuffer(docs, "<u2").astype(np.int64), np.frombuffer(tfs, "<u4").astype(np.int64)
            acc[np.ix_(np.asarray(slots, np.int64), at)] += int(weight) * (1_000_000_000 * tf // (1000 * tf + 20 * m[at]))
        if shut:
            acc[shut] *= met
        rows = []
        for s in np.flatnonzero(acc.any(1)):
            at = np.flatnonzero(acc[s])
            score = acc[s, at]
            if not last:
                rows.append((block, grp, s, at.astype("<u2").tobytes(), score.astype("<i8").tobytes(), np.sort(score)[::-1][:top].tolist()))
                continue
            order = np.lexsort((ids[at], nulls[at], -score))[:top]
            rows += [(grp, s, ids[d], nulls[d], acc[s, d]) for d in at[order]]
        return pd.DataFrame(rows, columns=["grp", "slot", "id", "none", "score"] if last else ["block", "grp", "slot", "docs", "scores", "top"])

    return run


def _leave(bounds):
    """Bundles without the documents that can't reach their item's bound any more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = bounds.value
        for b in batches:
            rows = []
            for block, grp, slot, docs, scores in zip(b["block"], b["grp"], b["slot"], b["docs"], b["scores"], strict=True):
                score = np.frombuffer(scores, "<i8")
                stay = score >= least.get((grp, slot), 0)
                if stay.any():
                    rows.append((block, grp, slot, np.frombuffer(docs, "<u2")[stay].tobytes(), score[stay].tobytes()))
            yield pd.DataFrame(rows, columns=["block", "grp", "slot", "docs", "scores"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = DOCS, held: int = HELD) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` best documents with a score above 0, ties by doc_id, null ids last.

    docs (doc_id, text), items (item_id, text). Null texts have no terms; an item without terms, or whose terms no document
    holds, has no rows. Rows of one item_id are one item, null too, with the terms of all. Repeated documents are documents
    of their own. Other columns are ignored; empty tables give no rows. Very long texts count whole.
    """
    with small_batches(docs.sparkSession):
        return _search(docs, items, top, block, held)


def _search(docs: DataFrame, items: DataFrame, top: int, block: int, held: int) -> DataFrame:
    spark = docs.sparkSession
    has = written(items.select(*id_columns("item_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_item_terms, "id long, none boolean, term string").distinct(), "item-terms")
    each = ranked(has.select("id", "none").distinct().select(F.lit("").alias("tree"), F.struct("none", "id").alias("ord"), F.lit("").alias("hash"), "id", "none"))
    each = written(each.select("id", "none", F.expr(f"rank div {GROUP}").alias("grp"), F.expr(f"cast(rank % {GROUP} as int)").alias("slot")), "items")
    n_items = each.count()
    words = written(has.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    posts, n_docs, n_terms = _posted(docs, words, block, held)
    if not n_docs or not n_items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # Weights, owners and places of the terms.
    df = posts.where("tid >= 0").groupBy("tid").agg(F.sum("n_docs").alias("df"), F.max("most").alias("most"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    owner = sum((F.col("df") > share * n_docs).cast("int") for share in OWNERS[:-1])
    # A term adds no more than this: its greatest frequency in a document of the least length factor.
    most = weight * F.expr("1000000000 * most div (1000 * most + 1000)")
    df = df.select("tid", weight.alias("weight"), owner.alias("owner"), most.alias("most"))
    at = has.join(words.hint("shuffle_hash"), "term").join(each.hint("shuffle_hash"), ["id", "none"]).join(df.hint("merge"), "tid").where("weight > 0")
    at = written(at.select("tid", "grp", "slot", "weight", "owner", "most"), "item-places")
    lists = at.groupBy("owner", "tid", "grp", "weight").agg(F.collect_list("slot").alias("slots"))
    lists = written(lists, "owners")
    few = lists.count() <= FEW_TERMS
    groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_items - 1) // GROUP).cast("long"))).alias("grp")
    own = posts.where("tid < 0").select("*", groups, F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<int>").alias("slots"))
    bundles, closed = spark.createDataFrame([], BUNDLE).drop("top"), None
    cols = ["block", "grp", "tid", "docs", "tfs", "ids", "nulls", "weight", "slots"]
    for stage in range(len(OWNERS)):
        mine = lists.where(F.col("owner") == stage).drop("owner")
        met = posts.where("tid >= 0").join(F.broadcast(mine) if few else mine.hint("merge"), "tid").select(cols)
        right = met.unionByName(own.select(cols))
        last = stage + 1 == len(OWNERS)
        pairs = bundles.groupBy("block", "grp").cogroup(right.groupBy("block", "grp"))
        got = pairs.applyInPandas(_visit(n_docs, n_terms, closed, top, last), "grp long, slot int, id long, none boolean, score long" if last else BUNDLE)
        if last:
            break
        bundles = written(got, "bundles")
        least, closed = _bounds(bundles, at, stage, top) if n_items <= FEW_ITEMS else (None, None)
        bundles = bundles.drop("top")
        if least:
            bundles = bundles.mapInPandas(_leave(least), BUNDLE.replace(", top array<long>", ""))
    best = Window.partitionBy("grp", "slot").orderBy(F.desc("score"), "none", "id")
    best = got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    best = best.withColumnsRenamed({"id": "doc", "none": "doc_none"}).join(each.hint("merge"), ["grp", "slot"])
    null = lambda c, none: F.when(~F.col(none), F.col(c))
    return best.select(null("id", "none").alias("item_id"), "rank", null("doc", "doc_none").alias("doc_id"), "score")


def _posted(docs: DataFrame, words: DataFrame, block: int, held: int) -> tuple[DataFrame, int, int]:
    """Postings of all terms, the number of documents with terms, and that of their terms."""
    spark, rows = docs.sparkSession, docs.select(*id_columns(), F.coalesce("text", F.lit("")).alias("text")).withColumn("nth", F.monotonically_increasing_id())
    slices = max(1, -(-words.count() // FEW_TERMS))
    if slices > 1:  # texts are read once for each slice of the vocabulary, under the same numbers
        rows = written(rows, "numbered")
    out = None
    for k in range(slices):
        part = words.where(F.pmod(F.xxhash64("term"), F.lit(slices)) == k) if slices > 1 else words
        vocabulary = spark.sparkContext.broadcast({r.term.encode(): r.tid for r in part.toLocalIterator()})
        got = written(rows.mapInPandas(_postings(vocabulary, block, held), POSTINGS), "postings")
        if out is None:
            n = got.where("tid < 0").agg(F.sum("n_docs"), F.sum("n_terms")).first()
        out = got if out is None else out.union(got.where("tid >= 0"))
    return out, n[0] or 0, n[1] or 0


def _bounds(bundles: DataFrame, at: DataFrame, stage: int, top: int):
    """Broadcast, by item: the least score that can still get among the best, and the items that no new document can enter."""
    nth = Window.partitionBy("grp", "slot").orderBy(F.desc("v"))
    theta = bundles.select("grp", "slot", F.explode("top").alias("v")).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") == top).select("grp", "slot", "v")
    ahead = at.groupBy("grp", "slot").agg(F.sum(F.when(F.col("owner") > stage, F.col("most")).otherwise(F.lit(0))).alias("ahead"))
    rows = theta.join(ahead.hint("merge"), ["grp", "slot"]).collect()
    share = bundles.sparkSession.sparkContext.broadcast
    return share({(r.grp, r.slot): r.v - r.ahead for r in rows}), share({(r.grp, r.slot) for r in rows if r.ahead < r.v})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


def oracle() -> str:
    """DuckDB SQL of the query."""
    got = lambda t: rf"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {got("text")} AS ts FROM documents),
n AS (SELECT count(*) AS nn, sum(len(ts)) AS ll FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({got("text")}) AS term FROM benchmark),
v AS (SELECT DISTINCT term FROM q),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM d) JOIN v USING (term) GROUP BY k, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * nn + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM tf, n GROUP BY term, nn),
m AS (SELECT k, doc_id, 100 - 50 + ((50 * CAST(len(ts) AS BIGINT) * nn) // CAST(ll AS BIGINT)) AS m FROM d, n),
s AS (SELECT q.item_id, m.k, m.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m))) AS score
FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (k) GROUP BY q.item_id, m.k, m.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM
(SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""
