"""Near duplicates by order min-hash and banded alignment.

A text is its sequence of words; its k-mers are the five-word shingles, each labelled with how often it has occurred
before. A sketch hashes all labelled shingles, takes the two least and keeps them in text order; texts that agree on one of
32 sketches become candidates. Two texts are near duplicates when the words aligned in order make up 0.8 of all words of
both: with the longest common subsequence L of n and m words, L / (n + m - L) >= 0.8. Texts of up to 32 words also meet
at pairs of their rarest words, which every such pair of texts shares, so of pairs with a text of up to 25 words none is missed. In
longer ones, where edits are so dense that few shingles stay whole, sketches may miss a pair: of texts that also share 0.8 of their shingles none in practice (less than
once in 10^13), of long texts with every ninth word changed, just similar enough, about once in 160. Classes are connected components of links.

Groups of copies stay linear. Texts with the same words are one node. In a bucket all nodes meet one pivot; only where a
bucket still holds several components do its nodes meet a second pivot, the one in the most crowded buckets, which a group
of near copies has in its middle. Only the nodes that remain apart after that meet one another across components. Nodes of
crowded buckets meet where they share one of their rarest words, labelled likewise, which every pair of similarity 0.8 does
(the order is that of all nodes in crowded buckets, by counts of their words in BINS bins, and the places in it bound the overlap), so a
passage that many texts hold brings few of them together and no pair is lost: any one order of all words would do. Of all words that
two nodes share they meet at the first one only, which is the earliest in both; where that lies beyond the heads that nodes carry, also at a later one
that follows many words of which they share none. They meet only if the parities of their words in PARITY bins, which count no word that both have, allow the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILARITY, components, id_back, id_columns, small_batches, words, written

SKETCHES, LEAST, LARGE, HEAD = 32, 2, 200, 32
#: Bins in which the words of crowded nodes are counted; a word's order by rarity is that of its bin, then its own.
BINS = 1 << 20
#: Bits of a node's parities, and the words before a place that go with it.
PARITY, BEFORE = 1024, 16
#: Texts of so many words also meet by pairs of rare words, exactly: edits leave them too few whole shingles.
SHORT = 32
_SEEDS = np.random.default_rng(5).integers(1, 2**63, SKETCHES, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _B
    x = (x ^ (x >> _SHIFT)) * _B
    return x ^ (x >> _SHIFT)


def shingles(word: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles; a shorter text is one shingle."""
    word, k = word.astype(np.uint64), min(SHINGLE, len(word))
    n = len(word) - k + 1 if k else 0
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = _mix(out * _A + word[j : j + n] + np.uint64(j + 1))
    return out


def _labelled(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    first = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
    seen = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
    out = np.empty_like(x)
    out[order] = _mix(x[order] + seen.astype(np.uint64) * _A)
    return out


def sketch(word: np.ndarray) -> np.ndarray:
    """One bucket for each sketch; a text without words has none."""
    x = shingles(word)
    if not len(x):
        return np.zeros(0, np.int64)
    x = _labelled(x)
    h = x[None, :] ^ _SEEDS[:, None]
    h *= _B
    h ^= h >> _SHIFT
    h *= _A
    at = np.zeros((SKETCHES, min(LEAST, len(x))), np.int64)
    for j in range(at.shape[1]):
        at[:, j] = h.argmin(1)
        h[np.arange(SKETCHES), at[:, j]] = np.iinfo(np.uint64).max
    at.sort(axis=1)
    out = _SEEDS.copy()
    for j in range(at.shape[1]):
        out = _mix(out * _A + x[at[:, j]])
    return out.view(np.int64)


def _bits(w: np.ndarray) -> int:
    """A bit for each word, of 64: what one text has and another lacks is at least the bits that it alone has."""
    return int(np.bitwise_or.reduce(np.uint64(1) << (w.astype(np.uint64) & np.uint64(63)), initial=np.uint64(0)).view(np.int64))


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        w = [np.asarray(x, np.int64).view(np.uint64).astype("<u4") for x in b["h"]]
        yield pd.DataFrame({"id": b["id"], "none": b["none"], "text_md5": b["text_md5"], "key": b["key"], "n": [*map(len, w)], "w": [x.tobytes() for x in w], "bits": [_bits(x) for x in w], "sketch": [sketch(x) for x in w]})


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for key, w in zip(b["key"], b["w"], strict=True):
            if w:
                x = _labelled(np.frombuffer(w, "<u4").astype(np.uint64))
                yield pd.DataFrame({"key": [key] * len(x), "word": x.view(np.int64)})


def _short_ids(w: bytes) -> np.ndarray:
    """A text's words, labelled, as numbers of four bytes. Two that fall together do so in all texts, which only lets more pairs meet."""
    return (_labelled(np.frombuffer(w, "<u4").astype(np.uint64)) >> _SHIFT).astype(np.int64)


def _parities(x: np.ndarray) -> list[int]:
    """For each bin, whether it holds an odd number of these words, as numbers of 64 bits: texts differ in no more bits than words that only one of them has."""
    return np.packbits(np.bincount(x & (PARITY - 1), minlength=PARITY) & 1).view("<i8").tolist()


def _binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each bin occurs in a partition: one row a bin, not one a word."""
    count = np.zeros(BINS, np.int64)
    for b in batches:
        for w in b["w"]:
            np.add.at(count, _short_ids(w) & (BINS - 1), 1)
    bins = np.flatnonzero(count)
    yield pd.DataFrame({"bin": bins.astype(np.int32), "n": count[bins]})


def _placed(count: np.ndarray, least: float):
    """A node's parities, its first words by rarity, and those early enough for a partner to share one of them, with their places from 1 and the words before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            head, at, parity = [], [], []
            for w in b["w"]:
                x = _short_ids(w)
                parity.append(_parities(x))
                often = count[x & (BINS - 1)]
                order = np.lexsort((x, often))
                x, often = x[order].astype("<u4").view("<i4"), often[order]
                early = min(len(x), int(len(x) + 1 - least * len(x) + 1e-9))
                # What heads share counts each number once: a text that holds one twice goes without, and meets at all words.
                head.append(x[:HEAD] if len(np.unique(x)) == len(x) else x[:0])
                at.append([{"place": int(i) + 1, "word": int(x[i]), "before": x[max(0, i - BEFORE) : i]} for i in np.flatnonzero(often[:early] > 1)])
            yield pd.DataFrame({"key": b["key"], "parity": parity, "head": head, "at": at})

    return run


def _common(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose pairs are at most `band` apart: one row of bits for each of b."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, window = (1 << len(a)) - 1, (1 << (2 * band + 1)) - 1
    rest = full
    for j, x in enumerate(b):
        if hit := at.get(x, 0) & (window << (j - band) if j > band else window >> (band - j)):
            u = rest & hit
            rest = ((rest + u) | (rest - u)) & full
    return len(a) - rest.bit_count()


def alignment(x: bytes, y: bytes, least: float = SIMILARITY) -> float:
    """Similarity of two word sequences; below `least` only an upper bound of it."""
    a, b = (np.frombuffer(w, "<u4") for w in (x, y))
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    ratio = lambda c: c / (n + m - c)
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(a[::-1][: k - head] != b[::-1][: k - head])
    tail = int(differ[0]) if len(differ) else k - head
    a, b = a[head : n - tail], b[head : m - tail]
    if ratio(head + tail + min(len(a), len(b))) < least or ratio(head + tail + min(np.isin(a, b).sum(), np.isin(b, a).sum())) < least:
        return 0.0
    spare = n + m - 2 * int(np.floor(least * (n + m) / (1 + least)))  # more unaligned words than this: below least
    return ratio(head + tail + _common(a.tolist(), b.tolist(), spare + 1))


def _verify(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [alignment(x, y, least) >= least for x, y in zip(b["wa"], b["wb"], strict=True)]
            yield b.loc[ok, ["a", "b"]]

    return run


def _may_align(n: str, m: str, x: str, y: str, least: float) -> Column:
    """Whether texts of n and m words with these bits may be that similar: neither may have more words of its own than that leaves."""
    n, m, x, y = map(F.col, (n, m, x, y))
    common = (n + m) * (least / (1 + least)) - 1e-9
    own = lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))
    return (F.least(n, m) >= least * F.greatest(n, m)) & (own(x, y) <= n - common) & (own(y, x) <= m - common)


def _rare_pairs(nodes: DataFrame, least: float) -> DataFrame:
    """Buckets (key, n, bucket) of short texts, by pairs of their rarest words: no pair of texts of that similarity shares none.

    A partner has at least c = least * n of a text's n words in common with it. With words in one order by rarity, the first
    n - c + 2 of both then share two words; those, as a pair, are a bucket of both."""
    of = nodes.select("key", "bits")
    each = written(nodes.select("key", "w").mapInPandas(_occurrences, "key long, word long"), "short-words")
    often = each.groupBy("word").agg(F.count("*").alias("df"))
    by = each.join(often.hint("merge"), "word").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("by"))
    n = F.size("by")
    head = by.select("key", n.alias("n"), F.slice("by", 1, n - F.ceil(least * n - 1e-9).cast("int") + 2).alias("head"))
    both = lambda x, i: F.transform(F.slice("head", i + 2, SHORT), lambda y: F.xxhash64(x["word"], y["word"]))
    return head.join(of.hint("merge"), "key").select("key", "n", "bits", F.explode(F.flatten(F.transform("head", both))).alias("bucket"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_md5, class_id, class_text), one row per row of docs: class_id is the least doc_id of the class, class_text
    the least MD5 of its texts under that id (they name one row, but for repeated ones).

    Case, punctuation and white space don't count. Texts without words are copies only of equal texts; null counts as
    empty. Repeated rows fall in one class; a class of null ids has a null class_id. Other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        return _classes(docs, least)


def _classes(docs: DataFrame, least: float) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    w = docs.select(*id_columns(), F.md5(text.cast("binary")).alias("text_md5"), words(F.col("text")).alias("words"))
    key = F.when(F.size("words") > 0, F.md5(F.concat_ws(" ", "words").cast("binary"))).otherwise(F.concat(F.lit("-"), F.col("text_md5")))
    w = w.select("id", "none", "text_md5", F.unhex(F.replace(key, F.lit("-"), F.lit("00"))).alias("key"), F.transform("words", lambda x: F.xxhash64(x)).alias("h"))
    base = w.mapInPandas(_sketches, "id long, none boolean, text_md5 string, key binary, n int, w binary, bits long, sketch array<long>")
    base = written(base.select(id_back(), "text_md5", "key", "n", "w", "bits", "sketch"), "words")
    # Nodes are numbered in a written table: from here on, tables and shuffles hold a number in place of a hash.
    nodes = base.groupBy(F.col("key").alias("hash")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch"), F.first(F.when(F.col("n") <= SHORT, F.col("w"))).alias("w"))
    nodes = written(nodes.withColumn("key", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.select("key", "n", "bits", F.explode("sketch").alias("bucket")).unionByName(_rare_pairs(nodes.where(F.col("n").between(2, SHORT)), least))
    several = written(buckets.groupBy("bucket").agg(F.min("key").alias("least"), F.count("*").alias("size")).where("size > 1"), "several")
    shared = written(buckets.join(several.hint("merge"), "bucket"), "shared")

    def pairs(rows: DataFrame) -> DataFrame:
        """rows (a, b, na, nb, sa, sb) whose lengths and words' bits allow the similarity, each pair once."""
        return rows.where(_may_align("na", "nb", "sa", "sb", least) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # The words of nodes that share a bucket, one text each: no other text is ever compared.
    one = nodes.join(shared.select("key").distinct().hint("merge"), "key", "left_semi").select("key", "hash", "rep.*")
    one = one.select("key", "hash", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text_md5")
    rows = base.select(F.col("key").alias("hash"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text_md5", "w")
    texts = written(rows.join(one.hint("shuffle_hash"), ["hash", "id", "text_md5"]).select("key", "w").dropDuplicates(["key"]), "texts")

    def verified(todo: DataFrame) -> DataFrame:
        side = lambda x: texts.select(F.col("key").alias(x), F.col("w").alias(f"w{x}")).hint("merge")
        return written(todo.join(side("b"), "b").join(side("a"), "a").mapInPandas(_verify(least), "a long, b long"), "links")

    n_of = nodes.select(F.col("key").alias("least"), F.col("n").alias("na"), F.col("bits").alias("sa"))
    first = shared.where("key != least").join(n_of.hint("merge"), "least").select(F.col("least").alias("a"), F.col("key").alias("b"), "na", F.col("n").alias("nb"), "sa", F.col("bits").alias("sb"))
    tried = written(pairs(first), "pairs")
    links = verified(tried)
    label = components(links, "near")

    reach = shared.groupBy("key").agg(F.sum("size").alias("reach"))

    def apart() -> DataFrame:
        """Rows of buckets that hold several components yet: (bucket, key, n, label, size)."""
        at = shared.join(reach.hint("merge"), "key").join(label.withColumnRenamed("node", "key").hint("merge"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        at = written(at.drop("least"), "labelled")
        mixed = written(at.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("reach", "key", "n", "label", "bits")).alias("pivot")).where("lo != hi").select("bucket", "pivot"), "mixed")
        return at.join(mixed.hint("merge"), "bucket")

    def sides(at: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
        """The nodes of each place outside its main component, with l_ before their columns, and all of them with `main`; places of one component are left out."""
        here, own = Window.partitionBy(by), Window.partitionBy(by, "label")
        at = at.repartition(by).withColumn("of", F.count("*").over(own))
        at = at.withColumns({"main": F.max(F.struct("of", "label")).over(here)["label"], "lo": F.min("label").over(here), "hi": F.max("label").over(here)})
        at = written(at.where("lo != hi").drop("of", "lo", "hi"), "sides")
        return at.where("label != main").select(*[F.col(c).alias(f"l_{c}") for c in at.columns]), at

    #: Two components, each pair from one side; nodes of a main component don't meet one another.
    common = F.array_sort(F.array_intersect("l_mine", "mine"))
    fit = _may_align("l_n", "n", "l_bits", "bits", least)
    across = (F.col("l_label") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("l_label") < F.col("label"))) & fit

    def meeting(at: DataFrame) -> DataFrame:
        """Pairs of the rows (bucket, key, n, label, mine), each in the least bucket that they share."""
        left, right = sides(at, "bucket")
        return left.join(right.hint("merge"), (F.col("l_bucket") == F.col("bucket")) & across & (F.get(common, F.lit(0)) == F.col("bucket"))).select("l_key", "key", "l_n", "n", "l_bits", "bits")

    def meeting_rarely(crowd: DataFrame) -> DataFrame:
        """Pairs of the nodes (key, n, label, mine), at words that are early enough in both nodes' order by rarity."""
        # The order is made where a text's words are: no row for each word of a node is shuffled, but for those early ones.
        of = written(texts.join(crowd.select("key").hint("merge"), "key", "left_semi").where("length(w) > 0"), "crowded")
        count = np.zeros(BINS, np.int64)
        often = of.select("w").mapInPandas(_binned, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
        count[often["bin"].to_numpy(np.int64)] = often["n"].to_numpy(np.int64)
        at = of.mapInPandas(_placed(count, least), "key long, parity array<long>, head array<int>, at array<struct<place:int,word:int,before:array<int>>>")
        nodes = crowd.withColumn("mine", F.transform("mine", lambda x: F.hash(x))).join(at.hint("merge"), "key")
        left, right = sides(nodes.select("key", "n", "label", "bits", "mine", "parity", "head", F.explode("at").alias("x")).select("*", "x.*").drop("x"), "word")
        # What both may share: from here on in both orders; and no fewer words are in one of them only than bits in which they differ.
        both = (F.col("l_n") + F.col("n")) * (least / (1 + least)) - 1e-9
        rest = F.least(F.col("l_n") - F.col("l_place"), F.col("n") - F.col("place")) + 1
        own = sum(F.bit_count(F.get("l_parity", F.lit(i)).bitwiseXOR(F.get("parity", F.lit(i)))) for i in range(PARITY // 64))
        enough = (rest >= both) & (own <= F.col("l_n") + F.col("n") - 2 * both)
        # Of the words that the nodes share they meet at the first, which is early in both: never after another one that both have
        # shortly before; and where both heads share words, at the first of them only.
        first = F.get(F.array_intersect("l_head", "head"), F.lit(0))
        here = ~F.arrays_overlap("l_before", "before") & F.coalesce(first == F.col("word"), F.lit(True))
        return left.join(right.hint("merge"), (F.col("l_word") == F.col("word")) & across & enough & here & F.arrays_overlap("l_mine", "mine")).select("l_key", "key", "l_n", "n", "l_bits", "bits")

    for turn in ("pivot", "across"):
        rest = written(apart(), "apart")
        if rest.isEmpty():
            break
        if turn == "pivot":
            more = rest.where("label != pivot.label").select(F.col("pivot.key").alias("a"), F.col("key").alias("b"), F.col("pivot.n").alias("na"), F.col("n").alias("nb"), F.col("pivot.bits").alias("sa"), F.col("bits").alias("sb"))
        else:
            # Two nodes that share buckets, each of them mixed, meet in the least one; if that is crowded, at a rare word.
            side = rest.select("bucket", "key", "n", "label", "bits")
            mine = side.groupBy("key").agg(F.sort_array(F.collect_list("bucket")).alias("mine"))
            size = side.groupBy("bucket").agg(F.count("*").alias("size"))
            side = written(side.join(mine.hint("merge"), "key").join(size.hint("merge"), "bucket"), "mixed-nodes")
            both = meeting(side.where(F.col("size") <= LARGE).drop("size"))
            crowd = side.where(F.col("size") > LARGE).select("key", "n", "label", "bits", "mine").dropDuplicates(["key"])
            both = both.unionByName(meeting_rarely(crowd))
            more = both.select(F.col("l_key").alias("a"), F.col("key").alias("b"), F.col("l_n").alias("na"), F.col("n").alias("nb"), F.col("l_bits").alias("sa"), F.col("bits").alias("sb"))
        fresh = written(pairs(more).join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(fresh)
        links = links.union(verified(fresh))
        label = components(links, "near")

    at = nodes.join(label.withColumnRenamed("node", "key").hint("merge"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least_of = at.groupBy("label").agg(F.min("rep").alias("class"))
    of = written(at.select(F.col("hash").alias("key"), "label").join(least_of.hint("merge"), "label").select("key", "class"), "classes")
    got = base.select("doc_id", "text_md5", "key").join(of.hint("merge"), "key")
    return got.select("doc_id", "text_md5", F.col("class.doc_id").alias("class_id"), F.col("class.text_md5").alias("class_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")
