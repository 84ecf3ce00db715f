"""Merkle manifest of a dataset: a root, and for each row a proof that it stands where it does.

Rows of a group (say, a language) are leaves in order; runs of eight nodes become a node, up to the group's subroot, and the
subroots in order become the root the same way. Ranks in base eight say which nodes meet: within blocks of 512 nodes the
digits are grouped away one by one, each time nesting the children in their parent, after one shuffle by block. The blocks'
nodes are leaves of the next round. On the way down each block gets its path as one more row of its group, and transform and
explode unfold the nested children with their siblings, so proofs come without joins. No group is larger than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, written

FAN, DIGITS = 8, 3
BLOCK = FAN**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(values: list[Column]) -> Column:
    """SHA-256 of fields that tell their length: '-' for null, else bytes, ':' and the value."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]).cast("binary"), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", **more: Column) -> DataFrame:
    """(tree, ord, hash, and what `more` names) of each row; tree sorts as the group does, null first."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col(order).alias("ord"), digest([F.col(f) for f in fields]).alias("hash"), *[c.alias(k) for k, c in more.items()])


def _joined(kids: Column) -> Column:
    return F.concat_ws("", F.transform(kids, lambda x: x["hash"]))


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, block, n, hash, kids) of nodes (tree, rank, n, hash, payload): one row for each 512 nodes of a tree.

    A level is built where a tree has more than one node there; else the node goes up as it is."""
    digit = lambda k: F.expr(f"cast(rank div {FAN**k} % {FAN} as tinyint)")
    rows = nodes.withColumns({"block": F.expr(f"rank div {BLOCK}"), **{f"d{k}": digit(k) for k in range(DIGITS)}}).repartition("tree", "block")
    kid = F.struct(F.col("d0").alias("d"), "hash", *payload)
    for k in range(DIGITS):
        rows = rows.groupBy("tree", "block", "n", *[f"d{j}" for j in range(DIGITS - 1, k, -1)]).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        up = F.sha2(_joined(F.col("kids")).cast("binary"), 256)
        rows = rows.withColumn("hash", F.when(F.col("n") > FAN**k, up).otherwise(F.col("kids")[0]["hash"]))
        kid = F.struct(F.col(f"d{k + 1}").alias("d"), "hash", "kids") if k + 1 < DIGITS else None
    return rows


def _unfolded(blocks: DataFrame, payload: list[str], keep: list[str]) -> DataFrame:
    """Rows (tree, keep, path, hash, payload) of blocks that know the path above them."""
    for k in reversed(range(DIGITS)):
        step = lambda i: F.struct(_joined(F.slice("kids", 1, i)).alias("left"), _joined(F.slice("kids", i + 2, FAN)).alias("right"))
        each = F.explode(F.transform("kids", lambda x, i: F.struct(x.alias("kid"), step(i).alias("step"))))  # noqa: B023
        rows = blocks.select("tree", "n", *keep, "path", each.alias("x"))
        path = F.when(F.col("n") > FAN**k, F.concat(F.array("x.step"), F.col("path"))).otherwise(F.col("path"))
        below = ["hash", *payload] if k == 0 else ["kids"]
        blocks = rows.select("tree", "n", *keep, path.alias("path"), *[F.col(f"x.kid.{c}").alias(c) for c in below])
    return blocks.drop("n")


def _folded(nodes: DataFrame, payload: list[str], top, keep: list[str]) -> DataFrame:
    """(tree, keep, path, hash, payload) of each node. top() takes the trees' last nodes (tree, hash) and returns (tree, path, keep)."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    rounds, below = [], payload
    while True:
        rounds.append(written(_blocks(nodes, below), "blocks"))
        nodes = rounds[-1].select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), "hash", F.col("block").alias("child"))
        most, below = -(-most // BLOCK), ["child"]
        if most <= 1:
            break
    path = top(nodes.select("tree", "hash")).withColumn("block", F.lit(0).cast("long"))
    for i in reversed(range(len(rounds))):
        # A block's path comes as one more row of its group.
        own = rounds[i].select("tree", "block", "n", "kids").unionByName(path.select("tree", "block", *keep, "path"), allowMissingColumns=True)
        at = own.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", *keep, "path")])
        path = _unfolded(at, ["child"] if i else payload, keep)
        path = written(path.drop("hash").withColumnRenamed("child", "block"), "paths") if i else path
    return path


def proofs(rows: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, hash, payload, path, subroot, root) of each of the leaves (tree, ord, hash, payload).

    path lists, from the leaf up to the root, what stands left and right of the node in its run, as joined hex digests. A
    group of one leaf has that leaf for its subroot. An empty table has no rows and no root.
    """

    def roots(tops: DataFrame) -> DataFrame:
        """The subroots' own tree: all groups are leaves of one tree, in order."""
        tops = ranked(tops.select(F.lit("").alias("tree"), F.col("tree").alias("ord"), "hash", F.col("tree").alias("group")))
        last = lambda t: t.select("tree", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
        return _folded(tops, ["group"], last, ["root"]).select(F.col("group").alias("tree"), "path", F.col("hash").alias("subroot"), "root")

    return _folded(ranked(written(rows, "leaves")), payload, roots, ["subroot", "root"])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def path_digest(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))).cast("binary"), 256)


def small_letters(text: Column) -> Column:
    """A-Z alone lower-cased; in ASCII texts lower() does just that."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def tamper_check(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of docs: the proofs of a manifest held
    against a copy in which the texts of a third of the rows (by the id's CRC-32) are lower-cased.

    Null fields have their own mark, so a null differs from an empty text; null texts and rows of null ids are not tampered
    with. Null ids come first in their language, rows of one id by digest; repeated rows are leaves of their own, with
    siblings as they fall. Other columns are ignored.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = digest([small_letters(F.col(f)) if f == "text" else F.col(f) for f in FIELDS])
    got = proofs(leaves(docs, doc_id=F.col("doc_id"), changed=F.when(hit & F.col("text").isNotNull(), changed)), ["doc_id", "changed"])
    got = got.withColumn("folded_root", fold(F.coalesce("changed", "hash"), F.col("path")))
    return got.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(deep: int = 8, wide: int = 3) -> str:
    """DuckDB SQL of the query for languages of up to 8**deep rows and up to 8**wide languages."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    whole = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    bytes_ = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda a, b: {bits}), 4294967295)"
    out = [f"leaf AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {whole('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {whole(low)} END AS changed FROM documents)"]
    out.append("a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY tree) AS n FROM leaf)")
    out.append("n0 AS (SELECT tree, r, n, leaf AS h FROM a0)")

    def levels(name: str, of: int) -> None:
        for k in range(of):
            out.append(f"{name}{k + 1} AS (SELECT tree, r // 8 AS r, n, CASE WHEN n > {8**k} THEN sha256(string_agg(h, '' ORDER BY r)) ELSE min(h) END AS h FROM {name}{k} GROUP BY tree, r // 8, n)")
            out.append(f"{name}s{k} AS (SELECT x.tree, x.r, CASE WHEN x.n > {8**k} THEN coalesce(string_agg(y.h, '' ORDER BY y.r) FILTER (y.r < x.r), '') END AS lt, CASE WHEN x.n > {8**k} THEN coalesce(string_agg(y.h, '' ORDER BY y.r) FILTER (y.r > x.r), '') END AS rt FROM {name}{k} x JOIN {name}{k} y ON x.tree = y.tree AND x.r // 8 = y.r // 8 GROUP BY x.tree, x.r, x.n)")

    levels("n", deep)
    out.append(f"m0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS r, count(*) OVER () AS n, h, tree AS g FROM n{deep})")
    levels("m", wide)
    joins, lefts, rights = "", [], []
    for k in range(deep):
        joins += f" JOIN ns{k} ON ns{k}.tree = a0.tree AND ns{k}.r = a0.r // {8**k}"
        lefts.append(f"ns{k}.lt")
        rights.append(f"ns{k}.rt")
    joins += " JOIN m0 ON m0.g = a0.tree"
    for k in range(wide):
        joins += f" JOIN ms{k} ON ms{k}.r = m0.r // {8**k}"
        lefts.append(f"ms{k}.lt")
        rights.append(f"ms{k}.rt")
    steps = ", ".join(f"{a} AS l{k}, {b} AS r{k}" for k, (a, b) in enumerate(zip(lefts, rights, strict=True)))
    out.append(f"p AS (SELECT a0.doc_id, a0.leaf, coalesce(a0.changed, a0.leaf) AS f, m0.h AS subroot, (SELECT min(h) FROM m{wide}) AS root, {steps} FROM a0{joins})")
    cols = ", ".join(f"l{k}, r{k}" for k in range(deep + wide))
    at = "p"
    for k in range(deep + wide):
        out.append(f"f{k} AS (SELECT doc_id, leaf, subroot, root, {cols}, CASE WHEN l{k} IS NULL THEN f ELSE sha256(l{k} || f || r{k}) END AS f FROM {at})")
        at = f"f{k}"
    proof = " || ".join(f"coalesce(l{k}, '') || coalesce(r{k}, '')" for k in range(deep + wide))
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f AS folded_root, f = root AS verified FROM {at}"
