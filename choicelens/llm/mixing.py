"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target t and size s should be taken t/s times. The whole part is sure; the fractions are
rounded by the pivotal method: two documents meet, and one of them passes its probability on until one of the two is
integral. Documents meet within blocks of their source in order of size, so neighbours trade like for like; what is left
of each block (one fraction at most) meets in the next level of a reduction tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 256
#: Rows of the lists of sources and of blocks that may be broadcast; longer lists are joined by shuffling.
FEW_SOURCES, FEW_BLOCKS = 10_000, 100_000
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
EPS = 1e-9
UNIT = "struct<p:double,doc:struct<doc_id:bigint,size:bigint,source:string,whole:int,nth:bigint>>"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size counts runs of anything but ASCII white space; null text has size 0."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target), one row per source.

    Weights repeat over the sources by code point, null last. Targets share `share` of all sizes by weight; none exceeds
    `most` times its source's size. Resharing the excess until no target is above ends at min(most * size, rate * weight)
    with one common rate: sorted by size/weight, the first sources reach their limit and the others divide the rest.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on: the tables are as long as the list of sources.
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", w.cast("double"))
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    left = share * total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    by = by.withColumn("rate", left / F.sum("weight").over(rest)).withColumn("full", F.col("rate") * F.col("weight") >= most * F.col("source_size"))
    # The rate of the first source that stays under its limit holds for all after it; an all-full table has none.
    rate = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("weight")).alias("k"), "rate"))).over(Window.partitionBy())["rate"]
    return by.select("source", "source_size", F.coalesce(F.least(most * F.col("source_size"), rate * F.col("weight")), most * F.col("source_size")).alias("target"))


def _uniform(seed: int, *ids: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _fold(units: Column, seed: int) -> Column:
    """(carry, done): the units of one block after each has met what the ones before it left."""
    unit, done = UNIT, "array<struct<doc:struct<doc_id:bigint,size:bigint,source:string,whole:int,nth:bigint>,up:int>>"
    settled = lambda doc, up: F.struct(doc.alias("doc"), F.lit(up).alias("up"))

    def meet(acc: Column, b: Column) -> Column:
        a, out = acc["carry"], acc["out"]
        s = a["p"] + b["p"]
        u = _uniform(seed, a["doc"]["doc_id"], b["doc"]["doc_id"], a["doc"]["size"], b["doc"]["size"], a["doc"]["nth"], b["doc"]["nth"])
        # s < 1: one keeps all, the other 0. s >= 1: one becomes 1, the other keeps s - 1.
        a_wins = F.when(s < 1 - EPS, u * s < a["p"]).otherwise(u * (2 - s) < 1 - b["p"])
        p = F.when(s < 1 - EPS, s).otherwise(s - 1)
        win, lose = F.when(a_wins, a["doc"]).otherwise(b["doc"]), F.when(a_wins, b["doc"]).otherwise(a["doc"])
        on = F.when(s < 1 - EPS, win).otherwise(lose)
        off = F.when(s < 1 - EPS, settled(lose, 0)).otherwise(settled(win, 1))
        carry = F.when(p > EPS, F.struct(p.alias("p"), on.alias("doc")))
        out = F.array_append(out, off)
        both = F.struct(carry.cast(unit).alias("carry"), F.when(p > EPS, out).otherwise(F.array_append(out, settled(on, 0))).alias("out"))
        return F.when(a.isNull(), F.struct(b.cast(unit).alias("carry"), acc["out"].alias("out"))).otherwise(both)

    return F.aggregate(units, F.struct(F.lit(None).cast(unit).alias("carry"), F.array().cast(done).alias("out")), meet)


def mix(docs: DataFrame, seed: int = 17, block: int = BLOCK, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per row of docs.

    Null or empty texts have size 0 and copies as their source's rate says; a source without any words has target 0 and
    copies 0. A null source is a source. Repeated rows are documents of their own; their copies may differ, so they are
    told apart by nothing but their count. Reruns give the same copies to the same table. Other columns play no part.
    """
    sized = written(sizes(docs), "sizes")
    goal = written(targets(sized, **how), "targets")
    if goal.count() <= FEW_SOURCES:
        goal = F.broadcast(goal)
    else:
        goal = goal.hint("merge")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    # Equal rows are numbered through, so that they are dealt over blocks as others are; counting them needs no row apart.
    equal = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("c"))
    some = equal.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(block).cast("long"))))
    each = some.withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("c"), F.col("from") + block) - 1)))
    unit = each.select("doc_id", "source", "size", "nth").withColumn("key", key).join(goal.select(key.alias("key"), "source_size", "target"), "key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + EPS).cast("int")
    p = F.when(rate - whole > EPS, rate - whole).otherwise(F.lit(0.0))
    doc = F.struct("doc_id", "size", "source", whole.alias("whole"), "nth")
    unit = unit.select("key", F.struct(p.alias("p"), doc.alias("doc")).cast(UNIT).alias("u"))
    sure = unit.where("u.p = 0").select("u.doc", F.lit(0).alias("up"))
    todo, out, n = unit.where("u.p > 0"), [sure], None
    while True:
        # Blocks of a size class keep like with like; at the top the classes of a source meet.
        band = F.floor(F.log2(F.col("u.doc.size") + 1)) if n is None or n > 1 else F.lit(0)
        todo = todo.withColumn("band", band.cast("int"))
        many = written(todo.groupBy("key", "band").agg(F.count("*").alias("n")), "blocks")
        n = many.agg(F.max("n")).first()[0] or 0
        many = F.broadcast(many) if many.count() <= FEW_BLOCKS else many.hint("merge")
        at = F.pmod(F.xxhash64(F.lit(seed), "u.doc.doc_id", "u.doc.size", "u.doc.nth"), F.ceil(F.col("n") / block))
        groups = todo.join(many, ["key", "band"]).groupBy("key", "band", at.alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("u.doc.size", "u.doc.doc_id", "u.p", "u"))).alias("us"))
        met = written(groups.select("key", _fold(F.transform("us", lambda x: x["u"]), seed).alias("r")), "met")
        out.append(met.select(F.explode("r.out").alias("x")).select("x.doc", "x.up"))
        todo = met.where("r.carry IS NOT NULL").select("key", F.col("r.carry").alias("u"))
        left = todo.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if left <= 1:
            break
        n = left if left > block else 1
    last = todo.select("u.doc", (_uniform(seed, F.col("u.doc.doc_id"), F.col("u.doc.size"), F.col("u.doc.nth")) < F.col("u.p")).cast("int").alias("up"))
    done = out[0]
    for x in [*out[1:], last]:
        done = done.union(x)
    got = done.select("doc.*", "up").withColumn("key", key).join(goal.select(key.alias("key"), "source_size", "target"), "key")
    return got.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("up")).alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
