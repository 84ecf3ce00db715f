"""Benchmark decontamination by SimHash windows.

An item's windows, at every offset, get a 64-bit SimHash over their five-word shingles: each bit is the majority of the
shingles' bits. Windows have an odd number of shingles, at most half of the item's (1, 3 or 7), so that few sizes serve
all items. Texts get the same windows on a grid, half a window apart: any passage of two thirds of an item holds at least
one whole grid window. Fingerprints meet on four 16-bit blocks; of two within three bits at least one block is equal, so
none within that radius is missed. Once a text and an item have met, all windows of the item's size in the text are
compared exactly, by shingles weighted with their multiplicity. Items of one to four words have no shingle: they are
found where a text holds just these words in a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILARITY, WORD, with_shingles, words, written

WINDOWS = (1, 3, 7)
RADIUS, BLOCKS = 3, 4
#: An index of this many rows may be broadcast (some tens of MB); beyond, both sides are dealt by block.
BROADCAST_ROWS = 500_000


def stride(w: int) -> int:
    return (w + 1) // 2


def window_of(n: Column) -> Column:
    """Windows of w shingles fit an item of n when a grid window lies in any half of it."""
    return reduce(lambda e, w: F.when(n >= 2 * (w + stride(w) - 1), w).otherwise(e), WINDOWS[1:], F.lit(1))


def _majority(df: DataFrame, bits: list[str], out: str) -> DataFrame:
    """Add the bits that most of 2^k - 1 columns have: carry-save addition, whose top digit is the majority."""
    made, own = 0, [*bits]
    while len(bits) > 1:
        carries = []
        while len(bits) > 1:
            (a, b, c), rest = map(F.col, bits[:3]), bits[3:]
            s, k, made = f"__s{made}", f"__c{made}", made + 1
            half = a.bitwiseXOR(b)
            df = df.withColumns({s: half.bitwiseXOR(c), k: a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(half))})
            carries, bits = [*carries, k], [*rest, s]
        bits = carries
    return df.withColumn(out, F.col(bits[0])).drop(*own, *[f"__{x}{i}" for x in "sc" for i in range(made)])


def _windows(rows: DataFrame, keys: list[str], sizes: list[int], step) -> DataFrame:
    """(keys, p, w, fp): the fingerprint of each window of w shingles, for w in sizes, that starts at a multiple of step(w).

    One row for each place of `sh` with the shingles from there on; the array itself goes no further, so work is linear.
    """
    shifted = F.arrays_zip(*[F.slice("sh", k + 1, F.size("sh")) for k in range(max(sizes))])
    at = rows.select(*keys, F.posexplode(shifted).alias("p", "z"))
    names = [f.name for f in at.schema["z"].dataType]
    at = at.select(*keys, "p", *[F.col("z").getField(n).alias(f"__x{k}") for k, n in enumerate(names)])
    for w in sizes:
        at = at.withColumns({f"__w{w}_{k}": F.col(f"__x{k}") for k in range(w)})
        at = _majority(at, [f"__w{w}_{k}" for k in range(w)], f"__fp{w}")
    each = [F.when(F.col(f"__x{w - 1}").isNotNull() & (F.col("p") % step(w) == 0), F.struct(F.lit(w).alias("w"), F.col(f"__fp{w}").alias("fp"))) for w in sizes]
    return at.select(*keys, "p", F.explode(F.array_compact(F.array(*each))).alias("f")).select(*keys, "p", "f.w", "f.fp")


def _blocks(df: DataFrame) -> DataFrame:
    width = 64 // BLOCKS
    part = lambda b: F.shiftrightunsigned("fp", width * b).bitwiseAND(F.lit((1 << width) - 1)) + (F.col("w") * BLOCKS + b).cast("long") * (1 << width)
    return df.withColumn("block", F.explode(F.array(*map(part, range(BLOCKS)))))


def benchmark_index(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(items, windows by block, window sizes in use). Items of fewer than five words are left to `short_hits`; null ids or texts take no part."""
    whole = benchmark.where(F.col("item_id").isNotNull() & (F.regexp_count(F.lower("text"), F.lit(WORD)) >= SHINGLE)).select("item_id", "text")
    items = with_shingles(whole.dropDuplicates(), "text", "sh").select("item_id", "sh", F.size("sh").alias("n"))
    items = written(items.withColumn("w", window_of(F.col("n")).cast("int")), "items")
    sizes = sorted(r.w for r in items.select("w").distinct().collect())  # 3 at most
    if not sizes:
        return items, items.selectExpr("item_id", "w", "n AS offset", "0L AS fp", "0L AS block"), [1]
    at = _windows(items.select("item_id", "sh", F.col("w").alias("own")), ["item_id", "own"], sizes, lambda w: 1).where("w = own")
    index = _blocks(at).select("item_id", "w", F.col("p").alias("offset"), "fp", "block")
    return items, written(index, "windows"), sizes


def windows(docs: DataFrame, items: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, words, similarity) for the item-sized windows (shorter at the end of a text) among which each
    pair (doc_id, h, item_id) of hits has its best; docs: (doc_id, h, text). Similarity is the sum of the lesser
    multiplicities over the sum of the greater ones.

    A shingle that an item has c times counts at place j in the windows that start after its c-th place before j: so each
    place adds one to a range of starts, and a running sum over the ends of ranges gives what every window shares.
    """
    held = lambda d: F.broadcast(d) if d.count() <= BROADCAST_ROWS else d.hint("merge")
    same = lambda d: F.col("doc_id").eqNullSafe(d["other_id"]) & (F.col("h") == d["other_h"])
    pairs = held(hits.withColumnsRenamed({"doc_id": "other_id", "h": "other_h"}))
    rows = docs.join(pairs, same(pairs), "left_semi").dropDuplicates(["doc_id", "h"])
    rows = with_shingles(rows, "text", "sh").select("doc_id", "h", "sh")
    at = rows.join(pairs, same(pairs)).select("doc_id", "h", "item_id", F.size("sh").alias("m"), F.posexplode("sh").alias("j", "x"))
    # Texts under the same item_id are items of their own.
    counts = items.select("item_id", F.xxhash64("sh").alias("item"), "n", F.explode("sh").alias("x")).groupBy("item_id", "item", "n", "x").agg(F.count("*").cast("int").alias("c"))
    key = ["doc_id", "h", "item_id", "item", "m", "n"]
    places = at.join(held(written(counts, "counts")), ["item_id", "x"]).groupBy(*key, "x", "c").agg(F.sort_array(F.collect_list("j")).alias("js"))
    first = lambda j, i: F.greatest(F.coalesce(F.get("js", i - F.col("c")), F.lit(-1)), j - F.col("n")) + 1
    ranges = F.transform("js", lambda j, i: F.array(F.struct(first(j, i).alias("s"), F.lit(1).alias("d")), F.struct((j + 1).alias("s"), F.lit(-1).alias("d"))))
    ends = places.select(*key, F.explode(F.flatten(ranges)).alias("e")).groupBy(*key, F.col("e.s").alias("s")).agg(F.sum("e.d").alias("d"))
    by = Window.partitionBy(*key).orderBy("s")
    shared = ends.select(*key, "s", F.sum("d").over(by).alias("shared"), (F.lead("s").over(by) - 1).alias("last")).where("shared > 0")
    # The windows from s to `last` share as much; at the end of the text the last of them is the shortest.
    each = shared.withColumn("start", F.explode(F.array("s", "last"))).withColumn("long", F.least("n", F.col("m") - F.col("start")))
    return each.select("doc_id", "item_id", "start", (F.col("long") + (SHINGLE - 1)).alias("words"), (F.col("shared") / (F.col("long") + F.col("n") - F.col("shared"))).alias("similarity"))


def short_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, words, similarity) for items of one to four words and the texts that hold exactly these words."""
    text = words(F.col("text"))
    items = benchmark.where("item_id IS NOT NULL").select("item_id", text.alias("ws")).withColumn("words", F.size("ws")).where(F.col("words").between(1, SHINGLE - 1))
    items = written(items.select("item_id", "words", F.array_join("ws", " ").alias("gram")).distinct(), "short-items")
    sizes = sorted(r.words for r in items.select("words").distinct().collect())  # 4 at most
    texts = docs.select("doc_id", text.alias("ws"))

    def grams_of(n: int) -> DataFrame:
        grams = F.transform(F.sequence(F.lit(0), F.size("ws") - n), lambda i: F.array_join(F.slice("ws", i + 1, n), " "))
        return texts.where(F.size("ws") >= n).select("doc_id", F.posexplode(grams).alias("start", "gram")).withColumn("words", F.lit(n))

    none = texts.select("doc_id", F.lit(0).alias("start"), F.lit("").alias("gram"), F.lit(0).alias("words")).limit(0)
    found = reduce(DataFrame.unionByName, map(grams_of, sizes), none).groupBy("doc_id", "gram", "words").agg(F.min("start").alias("start"))
    return found.join(items.hint("shuffle_hash"), ["gram", "words"]).select("doc_id", "item_id", "start", "words", F.lit(1.0).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, words, similarity): for each document and item whose best window reaches `least`, the
    word where it starts (from 0), its length in words and its similarity.

    Texts are whole and of any length; null texts and texts without words hold nothing. Rows with equal doc_id
    count as one document, null being an id as any other. Other columns are ignored; empty tables give no rows.
    """
    items, index, sizes = benchmark_index(benchmark)
    small = index.count() <= BROADCAST_ROWS
    held = (lambda d: F.broadcast(d)) if small else (lambda d: d.hint("merge"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    sh = with_shingles(texts, "text", "sh").select("doc_id", "h", "sh")
    probes = _blocks(_windows(sh, ["doc_id", "h"], sizes, stride)).drop("p")
    near = probes.join(held(index.withColumnRenamed("fp", "other").drop("w")), "block").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS)
    hits = written(near.select("doc_id", "h", "item_id").distinct(), "hits")
    scored = windows(texts, items, hits)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "words")).alias("b")
    long = scored.groupBy("doc_id", "item_id").agg(best).where(F.col("b.similarity") >= least).select("doc_id", "item_id", (-F.col("b.before")).alias("start"), "b.words", "b.similarity")
    # Texts under one item_id may be short and long.
    both = long.unionByName(short_hits(docs, benchmark)).groupBy("doc_id", "item_id")
    return both.agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "words")).alias("b")).select("doc_id", "item_id", (-F.col("b.before")).alias("start"), "b.words", "b.similarity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
