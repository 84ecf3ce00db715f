"""Token ids in binary shards.

Ids are renumbered by frequency, so the frequent ones fit in one byte, and coded with 1 to 4 bytes each; the lengths of
four ids share a control byte in a stream of its own, so a reader finds all lengths by one table lookup. A shard file is

    magic "CSV1" | documents u64 | ids u64 | doc_id i64 ... | has doc_id u8 ... | ids of the document u32 ... | control | data

and the folder's `ranks` file holds the vocabulary's ids by rank (u32). Files are in ascending order of doc_id.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from string import punctuation

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_back, id_columns, new_path, small_batches, written
from .token_counts import tokenizer

MODEL, END = "word_bpe_49k.json", 2
#: Ids in a file and in a partition of the writer at most (but a document stays whole), chunks a worker remembers (twice),
#: characters of text that it cuts at a time (but a text stays whole), chunks that it puts together at a time.
FILE_IDS, PART_IDS, REMEMBER, CUT, TOGETHER = 4_000_000, 16_000_000, 340_000, 8_000_000, 200_000
MAGIC = b"CSV1"
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


class Chunks(dict):
    """Ids of the chunks between white space, as bytes. This tokenizer drops white space and merges nothing across it, so
    a chunk is encoded when it is first met; nor does it merge letters with punctuation, so a word and the marks
    behind it are encoded apart. A form of a word is remembered once its word has been met before."""

    def __init__(self, path: str):
        super().__init__()
        self.tok, self.old = tokenizer(path), {}
        # Lower-case Latin letters: normalization leaves them alone, and the byte table turns them into these.
        letters = [c for c in map(chr, range(256)) if c.isalpha() and c.islower() and c not in "ªº"]
        self.table = {ord(c): self.tok.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        self.plain = frozenset(letters)
        self.latin = self.plain.union(c for c in map(chr, range(256)) if c.lower() != c and c.lower() in self.plain)

    def _encode(self, c: str) -> bytes:
        if self.plain.issuperset(c):
            return array("I", [t.id for t in self.tok.model.tokenize(c.translate(self.table))]).tobytes()
        return array("I", self.tok.encode(c, add_special_tokens=False).ids).tobytes()

    def __missing__(self, c: str) -> bytes:
        if (got := self.old.get(c)) is None:
            word = rest if (rest := c.rstrip(punctuation)).isalpha() else c
            mark = c[len(word) :]
            # Capitals of Latin words, and of other ASCII chunks: special strings keep theirs.
            if self.latin.issuperset(word) or (word.isascii() and "<|" not in word):
                word = word.lower()
            if word == c:
                got = self._encode(c)
            else:
                known = word in self or word in self.old
                got = self[word] + (self[mark] if mark else b"")
                if not known:
                    return got
        if len(self) >= REMEMBER:  # what is in use comes back from the old ones
            self.old = dict(self)
            self.clear()
        self[c] = got
        return got

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Arrow cuts the texts and finds their distinct chunks; only these are looked up here. It cuts
        at ASCII white space; a chunk that holds other white space is encoded whole, which comes to the same."""
        low = pa.array([t.lower() if t.isascii() and "<|" not in t else t for t in texts], pa.large_string())
        cut = pc.ascii_split_whitespace(low)
        ends, chunks = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        ids = [self[c] for c in chunks.dictionary.to_pylist()]
        size = np.array([len(x) // 4 for x in ids], np.int64)
        first, flat, at = np.cumsum(size) - size, np.frombuffer(b"".join(ids), np.uint32), chunks.indices.to_numpy()
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield np.concatenate([_gather(flat, first, size, at[i : min(b, i + TOGETHER)]) for i in range(a, max(b, a + 1), TOGETHER)])


def _gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """flat[first : first + size] of each of `at`, one after the other."""
    n = size[at]
    end = np.cumsum(n)
    return flat[np.repeat(first[at] - end + n, n) + np.arange(end[-1] if len(end) else 0)]


@cache
def _chunks(path: str) -> Chunks:
    """One for each worker process: what it has encoded serves its later tasks."""
    return Chunks(path)


def _encode(path: str, end: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, tail, held, size = _chunks(path), np.array([end], np.uint32), [], 0

        def flush() -> pd.DataFrame:
            nonlocal held, size
            x, held, size = pd.concat(held), [], 0
            got = [_narrow(np.concatenate([g, tail])) for g in ids(x["text"].tolist())]
            return pd.DataFrame({"id": x["id"], "none": x["none"], "n": [len(g) // g[0] for g in got], "ids": got})

        for b in batches:
            # Rows whose texts start in the same stretch of CUT characters.
            for _, x in b.groupby((b["text"].str.len().cumsum() - b["text"].str.len()) // CUT):
                held.append(x)
                size += int(x["text"].str.len().sum())
                if size >= CUT:
                    yield flush()
        if held:
            yield flush()

    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit; the first byte says which."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\4" + ids.astype("<u4").tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.uint32)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for i in range(0, len(b), TOGETHER // 2000):  # a count is as long as the vocabulary, so one for many rows
            c = np.bincount(np.concatenate([*map(_wide, b["ids"].iloc[i : i + TOGETHER // 2000])]))
            if len(c) > len(total):
                total, c = c, total
            total[: len(c)] += c
    at = np.flatnonzero(total)
    yield pd.DataFrame({"id": at.astype(np.int64), "n": total[at]})


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit integers."""
    v = values.astype(np.uint32)
    n = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = n - 1
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    at, data = np.cumsum(n) - n, np.zeros(int(n.sum()), np.uint8)
    for k in range(n.max(initial=0)):
        m = n > k
        data[at[m] + k] = (v[m] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    n = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    at, raw = np.cumsum(n) - n, np.frombuffer(data, np.uint8)
    v = np.zeros(count, np.uint32)
    for k in range(n.max(initial=0)):
        m = n > k
        v[m] |= raw[at[m] + k].astype(np.uint32) << np.uint32(8 * k)
    return v


def _put(uri: str, payload: bytes) -> None:
    """Write under another name, then rename: a lost or doubled attempt leaves no half file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    task = TaskContext.get()
    own = f"{path}.attempt-{task.taskAttemptId() if task else 0}"
    with fs.open_output_stream(own) as f:
        f.write(payload)
    fs.move(own, path)


def _get(uri: str, size: int | None = None) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return f.read(size) if size else f.read()


def _write(folder: str, rank: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, files, docs, none, ids, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal files, docs, none, ids, held
            control, data = pack(rank[np.concatenate(ids)])
            head = MAGIC + np.array([len(docs), held], "<u8").tobytes() + np.array(docs, "<i8").tobytes()
            head += (~np.array(none, bool)).astype(np.uint8).tobytes() + np.array([*map(len, ids)], "<u4").tobytes()
            name = f"shard-{part:06d}-{files:06d}.ids"
            _put(f"{folder}/{name}", head + control + data)
            out = pd.DataFrame({"part": [part], "file": [name], "docs": [len(docs)], "n": [held]})
            files, docs, none, ids, held = files + 1, [], [], [], 0
            return out

        for b in batches:
            for d, null, x in zip(b["id"].tolist(), b["none"].tolist(), b["ids"], strict=True):
                docs.append(d)
                none.append(null)
                ids.append(_wide(x))
                held += len(ids[-1])
                if held >= FILE_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, folder: str, model: str = MODEL, end: int = END) -> DataFrame:
    """Encode docs (doc_id, text) into shard files in `folder`, a shared one; return (part, file, docs, n) of the files.

    Null texts are empty: the end id alone. Null doc_ids come first, repeated ones stand side by side. Other columns are
    ignored. An empty table leaves a folder with ranks only.
    """
    spark, path = docs.sparkSession, public_tokenizers.path(model)
    with small_batches(spark):
        return _written_ids(spark, docs, folder, path, end)


def _written_ids(spark: SparkSession, docs: DataFrame, folder: str, path: str, end: int) -> DataFrame:
    rows = docs.select(*id_columns(), F.coalesce("text", F.lit("")).alias("text"))
    # Rows are numbered in the written table: rows of one id, or of none, can then be dealt over files too.
    enc = rows.mapInPandas(_encode(path, end), "id long, none boolean, n long, ids binary").withColumn("nth", F.monotonically_increasing_id())
    enc = written(enc, "encoded")
    # As many counts as the vocabulary has ids, at most.
    freq = {r.id: r.n for r in enc.select("ids").mapInPandas(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    by = np.array(sorted(freq, key=lambda i: (-freq[i], i)), np.uint32)
    rank = np.zeros(int(by.max()) + 1 if len(by) else 1, np.uint32)
    rank[by] = np.arange(len(by), dtype=np.uint32)
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    _put(f"{folder}/ranks", by.astype("<u4").tobytes())
    n = max(1, -(-sum(freq.values()) // PART_IDS), spark.sparkContext.defaultParallelism)
    order = [F.col("none").desc(), F.col("id"), F.col("nth")]
    ordered = enc.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "none", "ids")
    return written(ordered.mapInPandas(_write(folder, rank), "part int, file string, docs long, n long"), "shards")


def _read(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = np.frombuffer(_get(f"{folder}/ranks"), "<u4")
        for file, base in ((f, n) for b in batches for f, n in zip(b["file"], b["base"], strict=True)):
            raw = _get(f"{folder}/{file}")
            if raw[:4] != MAGIC:
                raise ValueError(f"{file} is no shard of token ids")
            docs, count = (int(x) for x in np.frombuffer(raw, "<u8", 2, 4))
            at = 20
            doc = np.frombuffer(raw, "<i8", docs, at)
            has = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).astype(bool)
            n = np.frombuffer(raw, "<u4", docs, at + 9 * docs).astype(np.int64)
            at += 13 * docs
            ids = by[unpack(raw[at : at + -(-count // 4)], raw[at + -(-count // 4) :], count)].astype("<u4")
            first = np.cumsum(n) - n
            view, crc = memoryview(ids.tobytes()), []
            for a, k in zip(first.tolist(), n.tolist(), strict=True):
                crc.append(zlib.crc32(view[4 * a : 4 * (a + k)]))
            yield pd.DataFrame({"id": doc, "none": ~has, "start": base + first, "n_tokens": n, "ids_crc32": np.array(crc, np.int64)})

    return run


def read_ids(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the shard files: start counts the ids of all documents before."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each partition of the writer, then the files of each.
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("first_of"))
    at = files.join(parts.hint("merge"), "part").select("file", (F.col("first_of") + before(Window.partitionBy("part").orderBy("file"))).alias("base"))
    spread = at.repartition(max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism)))
    got = spread.mapInPandas(_read(folder), "id long, none boolean, start long, n_tokens long, ids_crc32 long").select(id_back(), "start", "n_tokens", "ids_crc32")
    with small_batches(spark):
        return written(got, "read-back")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-ids")
    return read_ids(spark, folder, write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder))
