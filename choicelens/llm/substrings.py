"""Substring deduplication: words that a window of 13 covers which also stands in an earlier document.

A count-min sketch says which windows may be repeated. Each window is counted by the least hash among its seven-word grams,
once for a run of windows that share it (a quarter of the entries, and never less than the window's own count). Partitions
sketch what they read as sorted cells, at most two a cell; the cells are merged by segments, and of the merged table one bit a
cell is broadcast: counted twice or more. A second pass over the texts keeps only windows that all rows of the sketch take for
repeated, and groups those exactly, by 96 bits of hash: each block of windows sends one once, with the least id it has there,
so a passage that a third of all documents hold is as many rows as there are blocks. What comes back is a few places for each
document, and texts are shuffled once, to meet them.

The sketch has eight cells for an entry up to 2^28 cells a row (two bitmaps of 32 MB); beyond, some 800 million words, it
lets more and more windows through to the exact pass, and loses none. `most_bits` raises the bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_back, id_columns, recording, release, small_batches, written

WINDOW, GRAM = 13, 7
ROWS, LEAST_BITS, MOST_BITS, SEGMENT = 2, 16, 28, 16
#: Bytes of text (roughly) for an entry of the sketch, and cells for each; bytes hashed, entries held and windows of a block at once.
PER_ENTRY, PER_CELL, SLICE, HELD, BLOCK = 24, 8, 1 << 20, 2_000_000, 1_000_000
_RNG = np.random.default_rng(11)
_BYTES = _RNG.integers(0, 2**64, (32, 256), dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
READ = "block long, id long, md5 binary, at binary, nth binary, h1 array<long>, h2 array<int>, least array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _B
    x = (x ^ (x >> _HALF)) * _A
    return x ^ (x >> _HALF)


def _slice_hashes(raw: np.ndarray) -> np.ndarray:
    word = ~_SPACE[raw]
    begin = np.flatnonzero(word & np.r_[True, ~word[:-1]])
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = np.flatnonzero(word & np.r_[~word[1:], True]) + 1 - begin
    at = np.flatnonzero(word)
    place = at - np.repeat(begin, size)
    v = _BYTES[place & 31, raw[at]]
    if len(far := np.flatnonzero(place > 31)):
        v[far] = _mix(v[far] + (place[far] >> 5).astype(np.uint64) * _A)
    return _mix(np.add.reduceat(v, np.cumsum(size) - size) + size.astype(np.uint64) * _A)


def word_hashes(raw: bytes) -> np.ndarray:
    """One hash for each word, in slices that end at white space, so that a very long text takes no more room."""
    a, out, at = np.frombuffer(raw, np.uint8), [], 0
    while at < len(a):
        end = min(len(a), at + SLICE)
        while end < len(a) and not _SPACE[a[end]]:
            rest = np.flatnonzero(_SPACE[a[end : end + SLICE]])
            end = end + int(rest[0]) if len(rest) else min(len(a), end + SLICE)
        out.append(_slice_hashes(a[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _runs(h: np.ndarray, k: int, a: np.uint64) -> np.ndarray:
    """Hashes of k words in a row."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k if len(out) else 0):
        out = out * a + h[j : j + len(out)]
    return _mix(out)


def counted(h: np.ndarray) -> np.ndarray:
    """What each window of the words is counted by: the least hash of its grams."""
    m = _runs(h, GRAM, _A)
    for step in (1, 2, 3):  # of 2, 4 and 7 grams
        m = np.minimum(m[:-step], m[step:]) if len(m) > step else m[:0]
    return m


def _entries(m: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where runs of windows that are counted alike begin."""
    return np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]) if len(m) else np.zeros(0, np.int64)


def _windows(texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of words; hashes of all words; of each window its first word's place, its document and what it is counted by."""
    hashes = [word_hashes(t) for t in texts]
    n = [*map(len, hashes)]
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    m, doc = counted(h), np.repeat(np.arange(len(n)), n)
    last = max(0, len(h) - WINDOW + 1)
    ok = np.flatnonzero(doc[:last] == doc[WINDOW - 1 :][:last])
    return n, h, ok, doc[ok], m[ok]


def _cells(m: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((m * _ODD[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(bits: int):
    """Cells (row, segment, cells) of what a partition holds, each at most twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            m, rows = np.concatenate(held), []
            held.clear()
            for row in range(ROWS):
                c = np.sort(_cells(m, row, bits))
                c = c[np.r_[True, True, c[2:] != c[:-2]][: len(c)]]
                seg = c >> SEGMENT
                cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True])
                rows += [(row, int(seg[a]), (c[a:b] & 0xFFFF).astype("<u2").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pd.DataFrame(rows, columns=["row", "segment", "cells"])

        for texts in (t for b in batches for t in _portions(x.encode("utf-8", "replace") for x in b["text"])):
            _, _, _, doc, m = _windows(texts)
            if len(m):
                held.append(m[_entries(m, doc)])
            if sum(map(len, held)) > HELD:
                yield flush()
        if held:
            yield flush()

    return run


def _portions(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of about as many bytes as are hashed at once."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size > SLICE:
            yield out
            out, size = [], 0
    if out:
        yield out


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(row, segment, bits) of the segments in a partition: which cells were counted twice or more."""
    once: dict[tuple, np.ndarray] = {}
    twice: dict[tuple, np.ndarray] = {}
    for b in batches:
        for row, segment, cells in zip(b["row"], b["segment"], b["cells"], strict=True):
            key, c = (row, segment), np.frombuffer(cells, "<u2")
            if key not in once:
                once[key], twice[key] = np.zeros(1 << SEGMENT, bool), np.zeros(1 << SEGMENT, bool)
            again = c[1:][c[1:] == c[:-1]]
            twice[key][c[once[key][c]]] = True
            twice[key][again] = True
            once[key][c] = True
    rows = [(r, s, np.packbits(x, bitorder="little").tobytes()) for (r, s), x in twice.items() if x.any()]
    yield pd.DataFrame(rows, columns=["row", "segment", "bits"])


def sketch(rows: DataFrame, most_bits: int = MOST_BITS) -> tuple[list[np.ndarray], int]:
    """A bitmap for each row of the sketch over rows (text), and the bits of a cell's number."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, PER_CELL * size / PER_ENTRY))), LEAST_BITS, most_bits))
    cells = rows.select("text").mapInPandas(_sketch(bits), "row int, segment int, cells binary")
    full = cells.repartition("row", "segment").mapInPandas(_merged, "row int, segment int, bits binary")
    maps = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)]
    part = 1 << (SEGMENT - 3)
    for r in full.toLocalIterator():  # at most ROWS * 2^bits / 8 bytes
        maps[r.row][r.segment * part : (r.segment + 1) * part] = np.frombuffer(r.bits, np.uint8)
    return maps, bits


def maybe_repeated(m: np.ndarray, maps: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.ones(len(m), bool)
    for row, bitmap in enumerate(maps):
        c = _cells(m, row, bits)
        out &= (bitmap[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
    return out


def _read(shared, bits: int, windows: int):
    """Windows that may be repeated: rows of documents (at: their places, nth: their numbers in the block, or -1 where the block
    itself has one earlier), and one row for each block of its distinct windows with the least id of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps, ctx, number, held, ids, keys, size = shared.value, TaskContext.get(), 0, [], [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal number, held, ids, keys, size
            block, number = (ctx.partitionId() << 32) + number, number + 1
            h1, h2, places, docs = (np.concatenate(x) for x in zip(*held, strict=True))
            own = np.array(ids, np.int64)
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            # Numbers follow the first places, so that they mostly go up by one and pack well.
            turn = np.argsort(np.minimum.reduceat(order, cuts), kind="stable")
            least, one, rank = np.minimum.reduceat(own[docs[order]], cuts)[turn], cuts[turn], np.empty(len(cuts), np.int64)
            rank[turn] = np.arange(len(cuts))
            nth = np.empty(len(order), np.int64)
            nth[order] = np.repeat(rank, np.diff(np.r_[cuts, len(order)]))
            nth[own[docs] > least[nth]] = -1
            rows = [(block, None, None, None, None, a[one].view(np.int64), b[one].view(np.int32), least)]
            cut = np.searchsorted(docs, np.arange(len(ids) + 1))
            rows += [(block, i, k, _packed(places[x:y]), _packed(nth[x:y]), None, None, None) for i, k, x, y in zip(ids, keys, cut[:-1], cut[1:], strict=True) if y > x]
            held, ids, keys, size = [], [], [], 0
            return pd.DataFrame(rows, columns=["block", "id", "md5", "at", "nth", "h1", "h2", "least"], dtype=object)

        for b in batches:
            base = 0
            for part in _portions(x.encode("utf-8", "replace") for x in b["text"]):
                count, h, at, doc, m = _windows(part)
                begin = _entries(m, doc)
                some = np.repeat(maybe_repeated(m[begin], maps, bits), np.diff(np.r_[begin, len(m)]))
                at, doc = at[some], doc[some]
                if len(at):
                    held.append((_runs(h, WINDOW, _A)[at], (_runs(h, WINDOW, _B)[at] >> _HALF).astype(np.uint32), at - (np.cumsum(count) - count)[doc], doc + len(ids)))
                    size += len(at)
                ids += b["id"].iloc[base : base + len(part)].tolist()
                keys += b["md5"].iloc[base : base + len(part)].tolist()
                base += len(part)
                if size > windows:
                    yield flush()
        if held:
            yield flush()

    return run


def _packed(x: np.ndarray) -> bytes:
    return np.diff(x, prepend=0).astype("<i4").tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, "<i4").astype(np.int64))


def _covered(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Places of windows that are removed in the documents of one block; right: numbers of windows that other blocks have earlier."""
    mine = [_unpacked(x) for x in left["nth"]]
    earlier = np.zeros(max((int(x.max()) for x in mine), default=-1) + 2, bool)
    for nths in right["nths"]:
        earlier[np.asarray(nths, np.int64)] = True
    earlier[-1] = True  # for -1
    rows = []
    for i, key, at, nth in zip(left["id"], left["md5"], left["at"], mine, strict=True):
        gone = earlier[nth]
        if gone.any():
            rows.append((i, key, _packed(_unpacked(at)[gone])))
    return pd.DataFrame(rows, columns=["id", "md5", "at"])


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, none, text, at in zip(b["id"], b["none"], b["text"], b["at"], strict=True):
            words = text.encode("utf-8", "replace").split()
            depth = np.zeros(len(words) + 1, np.int64)
            if at is not None:
                begin = _unpacked(at)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + WINDOW, -1)
            stay = np.cumsum(depth)[:-1] == 0
            kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            rows.append((i, none, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pd.DataFrame(rows, columns=["id", "none", "n_words", "n_removed", "kept_sha256"])


def deduplicated(docs: DataFrame, most_bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of docs.

    Null texts have no words. A null doc_id comes neither before nor after another: such rows lose nothing, and nothing is
    lost for them. Rows of one doc_id don't count as earlier than one another, nor do windows of one text. Texts of fewer
    than 13 words lose nothing. Other columns are ignored; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        return _deduplicated(docs, most_bits, block)


def _deduplicated(docs: DataFrame, most_bits: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("md5"), text.alias("text"))
    some = rows.where("id IS NOT NULL")
    maps, bits = sketch(some, most_bits)
    shared = spark.sparkContext.broadcast(maps)
    scratch: list[str] = []
    with recording(scratch):
        read = written(some.mapInPandas(_read(shared, bits, block), READ), "windows")
    each = read.where("id IS NULL").select("block", F.posexplode(F.arrays_zip("h1", "h2", "least")).alias("nth", "x")).select("block", "nth", "x.*")
    first = F.min("least").over(Window.partitionBy("h1", "h2"))
    later = each.withColumn("first", first).where("least > first").groupBy("block").agg(F.collect_list("nth").alias("nths"))
    mine = read.where("id IS NOT NULL").select("block", "id", "md5", "at", "nth")
    gone = mine.groupBy("block").cogroup(later.groupBy("block")).applyInPandas(_covered, "id long, md5 binary, at binary")
    gone = written(gone, "covered")
    release(spark, scratch, gone)  # before texts are shuffled
    # Rows equal in id and text have equal places; rows without an id meet none.
    gone = gone.dropDuplicates(["id", "md5"])
    met = rows.join(gone.hint("shuffle_hash"), ["id", "md5"], "left")
    met = met.select(*id_columns("id"), "text", "at")
    got = written(met.mapInPandas(_kept, "id long, none boolean, n_words long, n_removed long, kept_sha256 string"), "deduplicated")
    return got.select(id_back(), "n_words", "n_removed", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL of the query."""
    return r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT k, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
lo AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 13)) AS p FROM win JOIN lo USING (h) WHERE doc_id > lo),
word AS (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT k, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (k, p) GROUP BY k),
n AS (SELECT k, count(*) AS n FROM gone GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN n USING (k) LEFT JOIN kept USING (k)"""
