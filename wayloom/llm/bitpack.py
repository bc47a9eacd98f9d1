"""Token ids in fixed-width bit packing.

Each id takes the minimum bits of the largest id; packing a larger one is an error, never a wrong id. Ids lie
in blocks of whole documents; a block has its payload and the offsets of its documents, so numpy unpacks it at
once, and any document can be read alone. Blocks are rows of Parquet files in the shared folder (shard, block,
first id's place in the shard, width, n_tokens, doc ids, offsets, payload), so the writer's commit protocol
survives lost executors, and shards are in ascending doc_id order. Readers add the totals of the shards before,
one number for each writing task.

Nulls count as the empty text, which has only the end id. Null doc_ids come first; equal doc_ids are ordered by
the hash of their text, then by text, and may lie in several shards. Ids are taken as bigint; others become null.
Other columns are ignored, so their names cannot clash. An empty table gives no file rows and no result rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import groups
from .common import lean, small_side

#: Ids in one block, about; a longer document is a block of its own.
BLOCK_IDS = 500_000
LANES = 32
#: What the last token of a word ends with, in this kind of vocabulary (fixed value).
WORD_END = "</w>"
STOPS = (".", ",")
#: Characters of texts encoded together: more of them share their new words.
GROUP_CHARS = 2_000_000
#: New words encoded in one call.
TOGETHER = 200
#: Words kept per worker, and the longest kept; the table is emptied when full, which costs time only.
KEPT_WORDS, KEPT_CHARS = 1_200_000, 48
BLOCKS = "shard int, block int, first bigint, width int, n_tokens bigint, n_docs int, n_null int, doc_ids binary, offsets binary, payload binary"


def width_of(vocabulary_size: int) -> int:
    """The least bits that hold ids below vocabulary_size."""
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids in `width` (1 to 32) bits each, low bits first; the last word is padded with zeros."""
    n = len(ids)
    if n and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} does not fit in {width} bits")
    if width in (8, 16, 32):  # whole bytes: the same layout without shifts
        out = np.zeros(-(-n // LANES) * LANES, dtype=f"<u{width // 8}")
        out[:n] = ids
        return out.tobytes()
    rows = np.zeros((-(-n // LANES), LANES), dtype=np.uint64)
    rows.reshape(-1)[:n] = ids
    out = np.zeros((len(rows), width + 1), dtype=np.uint64)
    for j in range(LANES):
        word, shift = divmod(j * width, 32)
        wide = rows[:, j] << np.uint64(shift)
        out[:, word] |= wide & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= wide >> np.uint64(32)
    return out[:, :width].astype("<u4").tobytes()


def unpack(payload: bytes, width: int, n: int, first: int = 0) -> np.ndarray:
    """n ids from place `first` on, as unsigned 32-bit integers; only their rows of the payload are read."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{width // 8}", count=n, offset=first * width // 8).astype(np.uint32)
    a, b = first // LANES, -(-(first + n) // LANES)
    words = np.frombuffer(payload, dtype="<u4", count=(b - a) * width, offset=a * width * 4).reshape(-1, width)
    wide = np.zeros((len(words), width + 1), dtype=np.uint64)
    wide[:, :width] = words
    out = np.empty((len(words), LANES), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(LANES):
        word, shift = divmod(j * width, 32)
        out[:, j] = (((wide[:, word] | (wide[:, word + 1] << np.uint64(32))) >> np.uint64(shift)) & mask).astype(np.uint32)
    return out.reshape(-1)[first - a * LANES :][:n]


class WordEncoder:
    """A tokenizer of the tokenizers library whose tokens never span white space: each piece between blanks is encoded once.

    New words are encoded many in one call. Words of letters, alone or before a stop or comma, have one or two tokens
    that end a word, so the ids of such a call fall apart again; where that count fails, each word is encoded alone.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}

    def alone(self, words: list[str]) -> dict[str, bytes]:
        return {w: array("I", e.ids).tobytes() for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True)}

    def together(self, words: list[str], ends: list[int]) -> dict[str, bytes]:
        """The ids of words with so many word ends each."""
        out: dict[str, bytes] = {}
        cuts = range(0, len(words), TOGETHER)
        said = self.tokenizer.encode_batch_fast([" ".join(words[i : i + TOGETHER]) for i in cuts], add_special_tokens=False)
        for i, e in zip(cuts, said, strict=True):
            some, ids = words[i : i + TOGETHER], array("I", e.ids)
            last = np.cumsum(ends[i : i + TOGETHER]) - 1
            end = np.flatnonzero(self.ends[ids])
            if len(end) != last[-1] + 1:
                out |= self.alone(some)
                continue
            flat, at = ids.tobytes(), 0
            for w, b in zip(some, (end[last] * 4 + 4).tolist(), strict=True):
                out[w] = flat[at:b]
                at = b
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        plain = [w for w in words if w.isalpha()]
        marked = [w for w in words if w[-1:] in STOPS and w[:-1].isalpha()]
        rest = list(words.difference(plain, marked))
        return self.together(plain + marked, [1] * len(plain) + [2] * len(marked)) | self.alone(rest)

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        found = [list(map(known.get, p)) for p in parts]
        gaps = [[i for i, x in enumerate(f) if x is None] for f in found]
        got = self.learn({p[i] for p, g in zip(parts, gaps, strict=True) for i in g})
        for p, f, g in zip(parts, found, gaps, strict=True):
            for i in g:
                f[i] = got[p[i]]
        for w in [w for w in got if len(w) > KEPT_CHARS]:
            del got[w]
        known.update(got)
        return [b"".join(f) for f in found]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def blocks(docs: DataFrame, path: str, end_id: int | None, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The blocks of all documents; shards are ranges of the key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, shard, block, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        end = b"" if end_id is None else np.uint32(end_id).tobytes()
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pd.DataFrame:
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("<i8")
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            doc_ids = np.array([0 if k is None else k for k in keys], dtype="<i8")  # null ids come first
            return pd.DataFrame({"shard": [shard], "block": [block], "first": [before], "width": [width], "n_tokens": [len(flat)], "n_docs": [len(keys)], "n_null": [sum(k is None for k in keys)], "doc_ids": [doc_ids.tobytes()], "offsets": [offsets.tobytes()], "payload": [pack(flat, width)]})

        for b in batches:
            texts, at = ["" if t is None else t for t in b["t"]], 0
            ks = [None if null else k for k, null in zip(b["k"].tolist(), b["no_key"].tolist(), strict=True)]
            for some in groups(texts, GROUP_CHARS):
                for k, x in zip(ks[at : at + len(some)], enc.encode(some), strict=True):
                    if held and held + len(x) // 4 > BLOCK_IDS:
                        yield flush()
                        block, before, keys, ids, held = block + 1, before + held, [], [], 0
                    keys.append(k)
                    ids.append(x + end)
                    held += len(x + end) // 4
                at += len(some)
        if keys:
            yield flush()

    own = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    dealt = own.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t")
    return dealt.select(F.coalesce("k", F.lit(0)).alias("k"), F.col("k").isNull().alias("no_key"), "t").mapInPandas(lean(run), BLOCKS)


def write_ids(docs: DataFrame, tokenizer: str, out: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Encodes whole texts and writes their ids to folder `out` in ascending key order."""
    largest = max(encoder(tokenizer).tokenizer.get_vocab().values(), default=0)
    width = width_of(1 + max(largest, end_id or 0))
    blocks(docs, tokenizer, end_id, width, key, text).write.parquet(out)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with `start`, the ids of all blocks before: those of earlier shards, and of the shard's own blocks before."""
    b = spark.read.schema(BLOCKS).parquet(folder)
    totals = b.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row a shard: as many as writing tasks, whatever the documents
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return b.join(small_side(base, totals.count()), "shard").withColumn("start", F.col("base") + F.col("first"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids = unpack(r.payload, r.width, r.n_tokens).astype("<u4")
                at = np.frombuffer(r.offsets, dtype="<i8")
                doc = np.frombuffer(r.doc_ids, dtype="<i8")
                crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": doc, "no_id": np.arange(len(doc)) < r.n_null, "start": at[:-1] + r.start, "n_tokens": np.diff(at), "ids_crc32": crc})

    read = read_blocks(spark, folder).select("start", "width", "n_tokens", "n_null", "doc_ids", "offsets", "payload").mapInPandas(lean(run), "doc_id bigint, no_id boolean, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def read_span(spark: SparkSession, folder: str, start: int, n: int) -> np.ndarray:
    """n ids from place `start` of the whole sequence; only blocks that hold some are read."""
    b = read_blocks(spark, folder)
    hit = b.filter((F.col("start") < start + n) & (F.col("start") + F.col("n_tokens") > start)).orderBy("start")
    parts = []
    for r in hit.select("start", "n_tokens", "width", "payload").toLocalIterator():
        first = max(start, r["start"]) - r["start"]
        parts.append(unpack(bytes(r["payload"]), r["width"], min(start + n, r["start"] + r["n_tokens"]) - r["start"] - first, first))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
