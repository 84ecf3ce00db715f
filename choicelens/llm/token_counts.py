"""Token counts without token ids.

A byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens have pieces. Pieces are
counted by the library once per distinct pre-token of the corpus and joined to each document's pre-token frequencies. The
frequent pre-tokens (a fixed number) meet their documents through a broadcast table, the long tail through a shuffle join.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches, written

MODEL = "byte_bpe_50k.json"
#: Fixed value: the pre-tokenizer's pattern, as the vocabulary file's kind (byte-level, use_regex) has it.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bounds of the broadcast table (longer pieces stand there by their digest) and of what a task gathers before it hands rows on.
HEAD, HEAD_CHARS, GATHER = 100_000, 64, 50_000


@cache
def tokenizer(path: str) -> Tokenizer:
    """One for each worker process, however many tasks it runs."""
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _specials(tok: Tokenizer) -> regex.Pattern | None:
    names = [t.content for t in tok.get_added_tokens_decoder().values()]
    return regex.compile("|".join(regex.escape(x) for x in sorted(names, key=len, reverse=True))) if names else None


@cache
def _newer(path: str) -> tuple[frozenset, regex.Pattern]:
    """Letters and numbers that `regex` knows from a later Unicode than the library, which takes them for neither: the
    library is asked about each one that Python's own tables lack."""
    split = tokenizer(path).pre_tokenizer.pre_tokenize_str
    known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, range(sys.maxunicode + 1))))
    new = [c for c in known if unicodedata.category(c) == "Cn" and len(split(f"a{c}")) > 1 and len(split(f"1{c}")) > 1]
    these = f"[{''.join(new)}]"
    pattern = PRETOKEN.pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{these}]")
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(f" ?{kind}", f" ?[{kind}--{these}]")
    return frozenset(new), regex.compile(pattern, regex.V1)


def _split(text: str, path: str) -> list[str]:
    try:
        text.encode("latin-1")  # the quick way to see that all is old
    except UnicodeEncodeError:
        new, careful = _newer(path)
        if not new.isdisjoint(text):
            return careful.findall(text)
    return PRETOKEN.findall(text)


def pretokens(text: str, special: regex.Pattern | None, path: str) -> tuple[list[str], int]:
    """Pre-tokens of a text, and the number of special strings in it, which count as one token each."""
    if special is None or "<" not in text or not special.search(text):
        return _split(text, path), 0
    between = special.split(text)
    return [p for x in between for p in _split(x, path)], len(between) - 1


def _frequencies(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        special, seen = _specials(tokenizer(path)), Counter()
        out = lambda: pd.DataFrame({"piece": list(seen.keys()), "freq": list(seen.values())})
        for b in batches:
            for text in b["text"]:
                seen.update(pretokens(text, special, path)[0])
                if len(seen) > GATHER:
                    yield out()
                    seen.clear()
        yield out()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        for b in batches:
            yield b.assign(pieces=[len(e.ids) for e in tok.encode_batch_fast(b["piece"].tolist(), add_special_tokens=False)])

    return run


def _digest(piece: str) -> str | bytes:
    return piece if len(piece) <= HEAD_CHARS else hashlib.md5(piece.encode()).digest()


def _per_document(path: str, head):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        special, known = _specials(tokenizer(path)), head.value
        for b in batches:
            key, doc, size, piece, n = [], [], [], [], []
            for k, d, s, text in zip(b["key"], b["doc"], b["n_bytes"], b["text"], strict=True):
                found, sure = pretokens(text, special, path)
                got = [*map(known.get, found)]
                rare = {}
                if None in got:
                    missed = Counter(p for p, t in zip(found, got, strict=True) if t is None)
                    for p in [p for p in missed if len(p) > HEAD_CHARS and _digest(p) in known]:
                        sure += known[_digest(p)] * missed.pop(p)
                    rare = missed
                key += [k] * (1 + len(rare))
                doc += [d] + [None] * len(rare)
                size += [s] + [0] * len(rare)
                piece += [None, *rare]
                n += [sum(filter(None, got)) + sure, *rare.values()]
            yield pd.DataFrame({"key": key, "doc": doc, "n_bytes": size, "piece": piece, "n": n})

    return run


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of docs, as the library's encode() without added tokens.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and null ids keep their own rows; other columns are ignored.
    """
    spark, path = docs.sparkSession, public_tokenizers.path(model)
    text = F.coalesce("text", F.lit("")).alias("text")
    freq = docs.select(text).mapInPandas(_frequencies(path), "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    with small_batches(spark):
        counted = written(freq.mapInPandas(_pieces(path), "piece string, freq long, pieces int"), "pieces")
    top = counted.orderBy(F.desc("freq"), "piece").limit(HEAD)
    top = top.select("pieces", F.when(F.char_length("piece") <= HEAD_CHARS, F.col("piece")).alias("short"), F.when(F.char_length("piece") > HEAD_CHARS, F.unhex(F.md5(F.col("piece").cast("binary")))).alias("long"))
    head = spark.sparkContext.broadcast({r.short if r.long is None else bytes(r.long): r.pieces for r in top.toLocalIterator()})
    # Everything about a row leaves this one pass under one key, so that it doesn't matter how a later pass would number rows.
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("string").alias("doc"), F.octet_length("text").cast("long").alias("n_bytes"), text)
    rows = rows.withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0).cast("long")))
    parts = rows.mapInPandas(_per_document(path, head), "key long, doc string, n_bytes long, piece string, n long")
    own = F.concat(F.lit("\0"), F.col("key").cast("string"))  # what the head has counted needs no partner: dealt evenly
    rare = parts.withColumn("by", F.coalesce("piece", own)).join(counted.select(F.col("piece").alias("by"), "pieces").hint("merge"), "by", "left")
    tokens = F.sum(F.col("n") * F.when(F.col("piece").isNull(), F.lit(1)).otherwise(F.col("pieces")))
    total = rare.groupBy("key").agg(F.max("doc").alias("doc"), F.sum("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
    kind = docs.schema["doc_id"].dataType
    with small_batches(spark):
        return written(total.select(F.col("doc").cast(kind).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")), "token-counts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
