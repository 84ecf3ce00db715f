"""Nearest neighbours by inner product: a neighbour graph by NN-descent, queries by greedy search on it.

Equal vectors are one node, so groups of copies neither fill the neighbour lists nor hide what lies around them. The graph
starts from cells, in which all nodes meet, and improves by local joins: a node brings its neighbours, and some of the nodes
it is a neighbour of, together, and each of them keeps whom it finds nearer. Rounds go on until few neighbours change, and a
query walks until no node among the best it has found is unvisited; lists and beams widen with the logarithm of the
number of nodes, since neighbours of neighbours tell less the more nodes there are. Vectors have two bytes a component
there; the scores of what a search ends with are computed in double precision on the original vectors.

Nodes lie in blocks of some thousand, a row for each block, and blocks send each other letters, a row for each pair of
blocks and step: ids first, then a vector once for each block that asks for it, however many circles it is in there. So a
node that is everybody's neighbour costs a letter's entry for each block, and no step has a row for each edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import recording, release, small_batches, written

#: Neighbours of a node for each doubling of the nodes, and fewest; finds a node keeps from one circle.
PER_DOUBLING, LEAST_DEGREE, FINDS = 3, 24, 8
#: Nodes of a block and of a cell, at most or so; cells that a node is in.
BLOCK, CELL, TREES = 4096, 2048, 12
#: The descent ends with a round that changes less than this share of all neighbours, the search with one that walks nowhere.
SETTLED = 0.02
#: Nodes a search keeps, as a multiple of the degree.
BEAM = 4
#: A node's place is its block, shifted by so many bits, and its number there.
BITS = 20
WITHIN = (1 << BITS) - 1
#: Queries of a block whose candidates are gathered at once; rows of blocks or letters that a Python worker is handed at once.
SOME, HANDED = 256, 16

FOUND = "query long, node long, score double"
STATE = "block long, hs binary, near binary, score binary, new binary, fresh long, held long"
BEAMS = "block long, query binary, qh binary, near binary, score binary, new binary, fresh long"


def usable(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, v): vectors of the commonest length (ties: the longer) without null or non-finite components, zero vectors left out, each row once."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    ok = vectors.select(F.col(key).alias("id"), F.col(vec).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(fine)
    sizes = ok.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "size"))["size"]).first()[0]
    return ok.where(F.size("v") == (sizes or 0))


def nodes_and_members(ok: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(node, v) for distinct vectors, node being the least id, and (node, id) with the `most` least ids of each: a search
    never returns more of one node. The limit applies to each task's rows first, so hot vectors shuffle few."""
    w = Window.partitionBy("v").orderBy("id")
    ranked = ok.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).withColumn("node", F.min("id").over(Window.partitionBy("v")))
    table = written(ranked.select("node", "id", "r", F.when(F.col("r") == 1, F.col("v")).alias("v")), "members")
    return table.where("r = 1").select("node", "v"), table.select("node", "id")


def _packed(x: np.ndarray) -> np.ndarray:
    """Rows of bytes: a 4-byte scale and two signed bytes for each component."""
    scale = (np.abs(x).max(1) / 32767).astype("<f4")
    scale[scale == 0] = np.finfo("<f4").tiny
    code = np.clip(np.rint(x / scale[:, None].astype(float)), -32767, 32767).astype("<i2")
    return np.concatenate([scale[:, None].view(np.uint8), code.view(np.uint8)], axis=1)


def _vectors(raw: np.ndarray) -> np.ndarray:
    """The vectors of packed ones."""
    return raw[:, 4:].copy().view("<i2").astype(np.float32) * raw[:, :4].copy().view("<f4")


def _read(column: pa.ChunkedArray | pa.Array, kind: str, *shape: int) -> np.ndarray:
    """What a binary column holds, end to end."""
    got = [np.zeros(0, np.uint8)]
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c) and c.buffers()[2] is not None:
            ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            got.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(got).view(kind).reshape(-1, *shape)


def _cut(ends: np.ndarray, rows: np.ndarray) -> pa.Array:
    """A binary column of the rows between ends."""
    rows = np.ascontiguousarray(rows)
    wide = rows.itemsize * int(np.prod(rows.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * wide).astype(np.int32)), pa.py_buffer(rows)])


def _letters(to: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """A row for each block in `to`: the block, and from each of columns what goes there."""
    order = np.argsort(to, kind="stable")
    blocks, first = np.unique(to[order], return_index=True)
    ends = np.append(first, len(order))
    return [pa.array(blocks, pa.int64()), *(_cut(ends, c[order]) for c in columns)]


def _whole(*columns: np.ndarray) -> list[pa.Array]:
    return [_cut(np.array([0, len(c)]), c) for c in columns]


def _table(schema: str, columns: list[pa.Array]) -> pa.Table:
    return pa.Table.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])


def _each(f: Callable[[pa.RecordBatch], list[pa.Array]], schema: str):
    """For mapInArrow: f on each row alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                yield from _table(schema, f(b.slice(i, 1))).to_batches()

    return run


def _ranks(rows: np.ndarray) -> np.ndarray:
    """Each entry's number, from 0, among the equal ones beside it."""
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, int)
    return np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))


def _once(row: np.ndarray, place: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where each (row, place) stands first, false `last` before true, in order; none for place -1."""
    order = np.lexsort((last, place, row))
    r, p = row[order], place[order]
    new = np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])) if len(r) else np.zeros(0, bool)
    return order[new & (p >= 0)]


def _kept(row: np.ndarray, place: np.ndarray, score: np.ndarray, fresh: np.ndarray, n: int, k: int) -> tuple[np.ndarray, ...]:
    """For rows 0 to n - 1 their k best (place, score, fresh), best first, a place once, filled up with place -1."""
    at = _once(row, place, fresh)
    at = at[np.lexsort((-score[at], row[at]))]
    rank = _ranks(row[at])
    at, rank = at[rank < k], rank[rank < k]
    out = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32), np.zeros((n, k), bool)
    for x, y in zip(out, (place, score, fresh), strict=True):
        x[row[at], rank] = y[at]
    return out


def _some(node: np.ndarray, other: np.ndarray, new: np.ndarray, most: int) -> np.ndarray:
    """At most so many entries of each node, new ones first, else as a hash has it."""
    mix = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ other.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.lexsort((mix, ~new, node))
    return order[_ranks(node[order]) < most]


def _spots(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)


def _placing(centres: np.ndarray, trees: list[np.ndarray], rough: int):
    """(node, v, h, code, codes): the nearest of centres, and a random cell and the nearest centre of each tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b["v"].tolist(), float)
                codes = np.stack([pd.util.hash_array(b["node"].to_numpy(np.int64)) % np.uint64(rough), *(_spots(x.astype(np.float32), c) for c in trees)], axis=1).astype(np.int64)
                h = [r.tobytes() for r in _packed(x)]
                yield pd.DataFrame({"node": b["node"], "v": b["v"], "h": h, "code": _spots(x.astype(np.float32), centres), "codes": codes.tolist()})

    return run


def _best_of(s: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)


MET = "block long, place binary, near binary, score binary"


def _meet(k: int, dim: int):
    """All nodes of a cell (place, h) against each other."""

    def run(cell: pa.Table) -> pa.Table:
        place, x = cell["place"].to_numpy(), _vectors(_read(cell["h"], "u1", 4 + 2 * dim))
        near, score = np.full((len(x), k), -1, np.int64), np.full((len(x), k), -np.inf, np.float32)
        for lo in range(0, len(x), 512):
            s = x[lo : lo + 512] @ x.T
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
            best = _best_of(s, k)
            got = np.take_along_axis(s, best, 1)
            near[lo : lo + 512, : best.shape[1]] = np.where(got > -np.inf, place[best], -1)
            score[lo : lo + 512, : best.shape[1]] = got
        return _table(MET, _letters(place >> BITS, place, near, score))

    return run


def _state(block: int, hs: np.ndarray, near: np.ndarray, score: np.ndarray, new: np.ndarray) -> pa.Table:
    counts = [pa.array([int(x)], pa.int64()) for x in (new.sum(), (near >= 0).sum())]
    return _table(STATE, [pa.array([block], pa.int64()), *_whole(hs, near, score, new), *counts])


def _first_lists(degree: int, dim: int):
    def run(own: pa.Table, met: pa.Table) -> pa.Table:
        own = own.sort_by("place")
        near, score = _read(met["near"], "i8"), _read(met["score"], "f4")
        place = _read(met["place"], "i8")
        row = np.repeat(place & WITHIN, len(near) // max(1, len(place)))
        return _state(own["block"][0].as_py(), _read(own["h"], "u1", 4 + 2 * dim), *_kept(row, near, score, np.ones(len(row), bool), own.num_rows, degree))

    return run


BACK = "to long, node binary, back binary, new binary"


def _backs(degree: int, most: int):
    """Who has a node among its neighbours, told to the node's block."""

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        near, new = _read(b["near"], "i8", degree), _read(b["new"], "?", degree)
        row, col = np.nonzero(near >= 0)
        node, back, new = near[row, col], (b["block"][0].as_py() << BITS) + row, new[row, col]
        at = _some(node, back, new, most)
        return _letters(node[at] >> BITS, node[at], back[at], new[at])

    return _each(run, BACK)


CIRCLES = "block long, row binary, member binary, new binary"


def _circles(degree: int, most: int):
    """A node's neighbours and some that have it as theirs; only circles with a new member."""

    def run(own: pa.Table, backs: pa.Table) -> pa.Table:
        near, new = _read(own["near"], "i8", degree), _read(own["new"], "?", degree)
        node, back, young = _read(backs["node"], "i8"), _read(backs["back"], "i8"), _read(backs["new"], "?")
        at = _some(node, back, young, most)
        row = np.concatenate([np.repeat(np.arange(len(near)), degree), node[at] & WITHIN])
        member, new = np.concatenate([near.ravel(), back[at]]), np.concatenate([new.ravel(), young[at]])
        at = _once(row, member, ~new)
        at = at[(np.bincount(row[at], new[at], minlength=len(near)) > 0)[row[at]]]
        return _table(CIRCLES, [own["block"].combine_chunks(), *_whole(row[at].astype(np.int32), member[at], new[at])])

    return run


WANTS = "to long, place binary, asker long"


def _wants(places: Callable[[pa.RecordBatch], np.ndarray]):
    def run(b: pa.RecordBatch) -> list[pa.Array]:
        place = np.unique(places(b))
        letters = _letters(place >> BITS, place)
        return [*letters, pa.array(np.full(len(letters[0]), b["block"][0].as_py()), pa.int64())]

    return _each(run, WANTS)


def _answer(schema: str, columns: Callable[[pa.Table, np.ndarray], list[np.ndarray]]):
    """To each letter (place, asker) one to the asker with what columns say of its places."""

    def run(wants: pa.Table, own: pa.Table) -> pa.Table:
        wants = wants.combine_chunks()
        sizes = [len(x.as_buffer()) // 8 for x in wants["place"]]
        place = _read(wants["place"], "i8")
        ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
        return _table(schema, [wants["asker"].combine_chunks(), _cut(ends, place), *(_cut(ends, c) for c in columns(own, place & WITHIN))]) if sizes else _table(schema, _letters(place, place, *columns(own, place)))

    return run


FINDS_MADE = "block long, node binary, near binary, score binary"


def _join_locally(dim: int):
    """For each circle pairs of which one is new there, kept where they beat the receiver's worst neighbour."""

    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        place = _read(got["place"], "i8")
        order = np.argsort(place)
        place, x, worst = place[order], _vectors(_read(got["h"], "u1", 4 + 2 * dim)[order]), _read(got["worst"], "f4")[order]
        row, member, new = _read(own["row"], "i4"), np.searchsorted(place, _read(own["member"], "i8")), _read(own["new"], "?")
        starts = np.flatnonzero(_ranks(row) == 0)
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))]
        for lo, hi in zip(starts, np.append(starts[1:], len(row)), strict=True):
            at, young = member[lo:hi], new[lo:hi]
            y = x[at]
            s = y @ y.T
            ok = s > worst[at][:, None]
            if not young.all():
                ok &= young[:, None] | young[None, :]
            np.fill_diagonal(ok, False)
            crowded = np.flatnonzero(ok.sum(1) > FINDS)
            if len(crowded):
                t = np.where(ok[crowded], s[crowded], -np.inf)
                ok[crowded] = False
                ok[crowded[:, None], _best_of(t, FINDS)] = True
            i, j = np.nonzero(ok)
            found.append((at[i], at[j], s[i, j]))
        a, b, score = map(np.concatenate, zip(*found, strict=True))
        _, first = np.unique(a * len(place) + b, return_index=True)
        a, b = place[a[first]], place[b[first]]
        return _table(FINDS_MADE, _letters(a >> BITS, a, b, score[first]))

    return run


def _improve(degree: int, dim: int):
    def run(own: pa.Table, finds: pa.Table) -> pa.Table:
        near, score = _read(own["near"], "i8", degree), _read(own["score"], "f4", degree)
        row = np.concatenate([np.repeat(np.arange(len(near)), degree), _read(finds["node"], "i8") & WITHIN])
        place, fresh = np.concatenate([near.ravel(), _read(finds["near"], "i8")]), np.arange(len(row)) >= near.size
        kept = _kept(row, place, np.concatenate([score.ravel(), _read(finds["score"], "f4")]), fresh, len(near), degree)
        return _state(own["block"][0].as_py(), _read(own["hs"], "u1", 4 + 2 * dim), *kept)

    return run


def _best(edges: DataFrame, k: int, by: str = "node", other: str = "near") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), other)
    return edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def degree_of(n: int) -> int:
    return max(LEAST_DEGREE, PER_DOUBLING * max(1, n).bit_length())


def neighbour_graph(nodes: DataFrame, degree: int, n: int, dim: int) -> tuple[DataFrame, DataFrame]:
    """(node, v, place, block, h) of each of nodes (node, v), and the graph by blocks: hs, the packed vectors, and near, the
    places of about the `degree` nearest nodes of each, with their scores by packed vectors."""
    few, many = -(-2 * n // BLOCK), -(-2 * n // CELL)
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(few + 4 * many).select("v").collect()
    pool, rng = np.array([r.v for r in drawn], np.float32).reshape(-1, dim), np.random.default_rng(11)
    trees = [pool[rng.choice(len(pool), min(many, len(pool)), replace=False)] for _ in range(TREES - 1)] if n > CELL else []
    shape = nodes.schema["v"].dataType.simpleString()
    codes = nodes.mapInPandas(_placing(pool[: max(1, few)] if len(pool) else np.zeros((1, dim), np.float32), trees, max(1, -(-n // CELL))), f"node long, v {shape}, h binary, code long, codes array<long>")
    codes = written(codes, "codes")
    # A crowded block or cell is dealt into several by hash.
    parts = codes.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    block = F.shiftleft("code", 16) + F.pmod(F.xxhash64("node"), F.col("parts"))
    at = codes.join(F.broadcast(parts), "code").select("node", "v", "h", "codes", block.alias("block"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1
    placed = written(at.withColumn("place", F.shiftleft("block", BITS) + nth), "placed")
    cells = placed.select("place", "h", F.posexplode("codes").alias("tree", "code"))
    parts = cells.groupBy("tree", "code").agg(F.ceil(F.count("*") / CELL).alias("parts"))
    cells = cells.join(F.broadcast(parts), ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("place", "tree"), F.col("parts")))
    met = cells.groupBy("tree", "code", "part").applyInArrow(_meet(degree // 2 if trees else degree, dim), MET)
    graph = placed.select("block", "place", "h").groupBy("block").cogroup(met.groupBy("block")).applyInArrow(_first_lists(degree, dim), STATE)
    with recording(old := []):
        graph = written(graph, "graph")
    most = degree * 2 // 3
    vectors = "to long, place binary, h binary, worst binary"
    known = lambda own, at: [_read(own["hs"], "u1", 4 + 2 * dim)[at], _read(own["score"], "f4", degree)[at, -1]]
    while True:
        with recording(old), small_batches(nodes.sparkSession, HANDED):
            backs = graph.select("block", "near", "new").mapInArrow(_backs(degree, most), BACK)
            circles = graph.select("block", "near", "new").groupBy("block").cogroup(backs.groupBy("to")).applyInArrow(_circles(degree, most), CIRCLES)
            circles = written(circles, "circles")
            wants = circles.mapInArrow(_wants(lambda b: _read(b["member"], "i8")), WANTS)
            told = wants.groupBy("to").cogroup(graph.select("block", "hs", "score").groupBy("block")).applyInArrow(_answer(vectors, known), vectors)
            finds = circles.groupBy("block").cogroup(told.groupBy("to")).applyInArrow(_join_locally(dim), FINDS_MADE)
            graph = graph.select("block", "hs", "near", "score").groupBy("block").cogroup(finds.groupBy("block")).applyInArrow(_improve(degree, dim), STATE)
            graph = written(graph, "graph")
        release(nodes.sparkSession, old, graph)
        fresh, held = graph.agg(F.sum("fresh"), F.sum("held")).first()
        if (fresh or 0) <= SETTLED * (held or 0):
            return placed, graph


def _beams(block: int, query: np.ndarray, qh: np.ndarray, near: np.ndarray, score: np.ndarray, new: np.ndarray) -> pa.Table:
    return _table(BEAMS, [pa.array([block], pa.int64()), *_whole(query, qh, near, score, new), pa.array([int(new.sum())], pa.int64())])


def _set_out(degree: int, dim: int, beam: int):
    """A query starts at its own node, which it has visited, and with that node's neighbours."""

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        query = np.sort(asked["place"].to_numpy())
        if not len(query):
            return _table(BEAMS, [*_letters(query, query, query, query, query, query), pa.array(query)])
        at = query & WITHIN
        place = np.concatenate([query[:, None], _read(own["near"], "i8", degree)[at]], axis=1)
        score = np.concatenate([np.full((len(at), 1), np.inf, np.float32), _read(own["score"], "f4", degree)[at]], axis=1)
        row, fresh = np.repeat(np.arange(len(at)), degree + 1), place != query[:, None]
        return _beams(own["block"][0].as_py(), query, _read(own["hs"], "u1", 4 + 2 * dim)[at], *_kept(row, place.ravel(), score.ravel(), fresh.ravel(), len(at), beam))

    return run


CALLS = "to long, place binary, query binary, asker binary, qh binary, low binary"


def _call(degree: int, dim: int, beam: int):
    """The neighbours of the nodes walked on, where the beam doesn't have them: each query to the blocks that hold some."""

    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        query, near = _read(own["query"], "i8"), _read(own["near"], "i8", beam)
        place, lists = _read(got["place"], "i8"), _read(got["near"], "i8", degree)
        order, new = np.argsort(place), _read(own["new"], "?", beam)
        found = [(np.zeros(0, int), np.zeros(0, np.int64))]
        for lo in range(0, len(query), SOME):
            has = near[lo : lo + SOME]
            row, col = np.nonzero(new[lo : lo + SOME])
            there = lists[order[np.searchsorted(place[order], has[row, col])]]
            rows = np.concatenate([np.repeat(np.arange(len(has)), beam), np.repeat(row, degree)])
            places, fresh = np.concatenate([has.ravel(), there.ravel()]), np.arange(len(rows)) >= has.size
            at = _once(rows, places, fresh)
            at = at[fresh[at]]
            found.append((rows[at] + lo, places[at]))
        row, place = map(np.concatenate, zip(*found, strict=True))
        block, who = np.divmod(np.unique((place >> BITS) * len(query) + row), max(1, len(query)))
        low, qh = _read(own["score"], "f4", beam)[who, -1], _read(own["qh"], "u1", 4 + 2 * dim)[who]
        return _table(CALLS, [*_letters(place >> BITS, place, query[row]), *_letters(block, query[who], qh, low)[1:]])

    return run


HITS = "block long, query binary, near binary, score binary"


def _score(dim: int):
    """Places scored where they beat the worst that the query keeps."""

    def run(calls: pa.Table, own: pa.Table) -> pa.Table:
        place, query, asker = (_read(calls[x], "i8") for x in ("place", "query", "asker"))
        x, order = _vectors(_read(own["hs"], "u1", 4 + 2 * dim)), np.argsort(asker)
        q, low = _vectors(_read(calls["qh"], "u1", 4 + 2 * dim)[order]), _read(calls["low"], "f4")[order]
        at, score = np.searchsorted(asker[order], query), np.zeros(len(query), np.float32)
        for lo in range(0, len(at), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            score[part] = np.einsum("ij,ij->i", q[at[part]], x[place[part] & WITHIN])
        ok = score >= low[at]
        return _table(HITS, _letters(query[ok] >> BITS, query[ok], place[ok], score[ok]))

    return run


def _advance(dim: int, beam: int):
    def run(own: pa.Table, hits: pa.Table) -> pa.Table:
        query, near, score = _read(own["query"], "i8"), _read(own["near"], "i8", beam), _read(own["score"], "f4", beam)
        row = np.concatenate([np.repeat(np.arange(len(near)), beam), np.searchsorted(query, _read(hits["query"], "i8"))])
        place, fresh = np.concatenate([near.ravel(), _read(hits["near"], "i8")]), np.arange(len(row)) >= near.size
        kept = _kept(row, place, np.concatenate([score.ravel(), _read(hits["score"], "f4")]), fresh, len(near), beam)
        return _beams(own["block"][0].as_py(), query, _read(own["qh"], "u1", 4 + 2 * dim), *kept)

    return run


def _close(dim: int, beam: int, k: int, longest: float):
    """(query, place) of those that may be among the k best beside the query's own node, as the error of packed scores has it."""

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        query, near, score = _read(b["query"], "i8"), _read(b["near"], "i8", beam), _read(b["score"], "f4", beam)
        norm = np.linalg.norm(_vectors(_read(b["qh"], "u1", 4 + 2 * dim)).astype(float), axis=1)
        # A component is off by half a 32,767th of the largest, a sum of floats by 2^-24 a term.
        off = 2 * longest * norm * (dim**0.5 / 32767 + dim / 2**22)
        row, col = np.nonzero((near >= 0) & ~(score < (score[:, k].astype(float) - off)[:, None]))
        return [pa.array(query[row]), pa.array(near[row, col])]

    return _each(run, "query long, place long")


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            q, v = np.array(b["q"].tolist(), float), np.array(b["v"].tolist(), float)
            yield pd.DataFrame({"query": b["query"], "node": b["node"], "score": np.einsum("ij,ij->i", q, v)})


def search(queries: DataFrame, placed: DataFrame, graph: DataFrame, degree: int, dim: int, beam: int, k: int, longest: float) -> DataFrame:
    """(query, node, score): the k best nodes beside its own, its own, and any within the error of packed scores, of the `beam`
    that a greedy search finds for each query (query, a node), scored on the vectors of placed. longest: no vector is longer.

    A query starts at its node and walks on from all nodes in its beam that it hasn't walked on from yet, until there are none.
    """
    asked = placed.join(queries.hint("merge"), F.col("node") == F.col("query"), "left_semi").select("block", "place")
    at = asked.groupBy("block").cogroup(graph.select("block", "hs", "near", "score").groupBy("block"))
    with recording(old := []):
        state = written(at.applyInArrow(_set_out(degree, dim, beam), BEAMS), "beams")
    ways = "to long, place binary, near binary"
    known = lambda own, at: [_read(own["near"], "i8", degree)[at]]
    while not state.where("fresh > 0").isEmpty():
        wants = state.select("block", "near", "new").mapInArrow(_wants(lambda b: _read(b["near"], "i8")[_read(b["new"], "?")]), WANTS)
        told = wants.groupBy("to").cogroup(graph.select("block", "near").groupBy("block")).applyInArrow(_answer(ways, known), ways)
        calls = state.groupBy("block").cogroup(told.groupBy("to")).applyInArrow(_call(degree, dim, beam), CALLS)
        hits = calls.groupBy("to").cogroup(graph.select("block", "hs").groupBy("block")).applyInArrow(_score(dim), HITS)
        with recording(old), small_batches(placed.sparkSession, HANDED):
            state = written(state.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(_advance(dim, beam), BEAMS), "beams")
        release(placed.sparkSession, old, state)
    last = state.select("query", "qh", "near", "score").mapInArrow(_close(dim, beam, k, longest), "query long, place long")
    v = placed.select("place", "node", "v")
    last = last.join(v.hint("merge"), "place").withColumnRenamed("query", "from")
    last = last.join(v.select(F.col("place").alias("from"), F.col("node").alias("query"), F.col("v").alias("q")).hint("merge"), "from")
    return last.select("query", "node", "q", "v").mapInPandas(_exact, FOUND)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `is_query` (a condition on `id`) picks, about the k nearest other
    rows by inner product, fewer where there are no more; ties go to the lesser id.

    Null, zero or non-finite vectors, vectors of another length than most, and null ids take no part. Equal vectors are
    found together. An id with several vectors is searched and found by each, its best score counts. Other columns are
    ignored; an empty table gives no rows.
    """
    ok = written(usable(vectors, key, vec), "vectors")
    nodes, members = nodes_and_members(ok, k + 1)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, dim, longest = nodes.agg(F.count("*"), F.max(F.size("v")), F.sqrt(F.max(square))).first()
    degree, dim = degree_of(n), dim or 1
    asked = ok.where(is_query).join(nodes.select("node", "v").hint("merge"), "v").select(F.col("id").alias("query_id"), "node").distinct()
    asked = written(asked, "asked")
    with small_batches(vectors.sparkSession):
        placed, graph = neighbour_graph(nodes, degree, n, dim)
        found = search(asked.select(F.col("node").alias("query")).distinct(), placed, graph, degree, dim, max(int(BEAM * degree), 2 * k), k, longest or 0.0)
    # The k + 1 nearest rows of a query's node hold the k nearest others of any of its rows.
    rows = found.join(members.hint("merge"), "node").select("query", "id", "score")
    near = _best(rows, k + 1, "query", "id").groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id"))).alias("near"))
    each = asked.withColumnRenamed("node", "query").join(near.hint("merge"), "query").select("query_id", F.explode("near").alias("x"))
    each = each.where("query_id != x.id").groupBy("query_id", F.col("x.id").alias("vec_id")).agg((-F.min("x.s")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
