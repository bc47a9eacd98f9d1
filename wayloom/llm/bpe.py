"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every word merges its lowest-rank
pair; ranks are found by binary search over the sorted pair keys. Words come from the usual
byte-level split pattern; a bounded per-worker table keeps the ids of words met before.

Nulls count as the empty text. Empty texts have no ids and decode to the empty text. Any other
column is left alone, so its name cannot clash. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .common import lean

#: The split pattern of byte-level BPE vocabularies (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
NO_RANK = np.int64(2**62)
#: Words kept per worker, and the longest kept; the table is emptied when full, which costs time only.
KEPT_WORDS, KEPT_CHARS = 200_000, 48
#: Symbols that one batch of merge rounds works on.
BATCH_SYMBOLS = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def unassigned() -> bytes:
    """For each code point whether Python's or the regex library's Unicode tables don't assign it, in which libraries may differ."""
    out = bytearray(unicodedata.category(chr(c)) == "Cn" for c in range(0x110000))
    for first in range(0, 0x110000, 0x1000):
        if not 0xD800 <= first < 0xE000:
            for c in regex.findall(r"\p{Cn}", "".join(map(chr, range(first, first + 0x1000)))):
                out[ord(c)] = 1
    return bytes(out)


class ByteBpe:
    """A byte-level BPE vocabulary read from a tokenizer file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        #: True if no merge can enable one of lower rank: then all equal pairs of a word may merge in one round.
        first = np.full(max(vocab.values()) + 1, -1, dtype=np.int64)
        np.maximum.at(first, made, np.arange(len(made)))
        self.monotone = bool((np.maximum(first[left], first[right]) < np.arange(len(made))).all())
        alphabet = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        back = {c: b for b, c in enumerate(alphabet)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.token_bytes |= {i: t.encode() for t, i in special.items()}
        self.special = {t: np.uint32(i).tobytes() for t, i in special.items()}
        self.special_at = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.split = regex.compile(SPLIT)
        self.late = re.compile("[\u0378-\U0010ffff]")  # those before are all assigned
        self.newer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.known: dict[str, bytes] = {}

    def rank_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place in the sorted keys of each pair, or -1."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), n)
        done_ids, done_word = [], []

        def pair_ranks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = at[at + 1 < len(ids)]
            ok = ok[word[ok] == word[ok + 1]]
            where = self.rank_at(ids[ok], ids[ok + 1])
            return ok[where >= 0], where[where >= 0]

        place = np.full(len(ids), -1, dtype=np.int64)
        at, where = pair_ranks(np.arange(len(ids)))
        place[at] = where
        while len(ids):
            rank = np.where(place >= 0, self.ranks[place], NO_RANK)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(ids)])
            live = lowest < NO_RANK
            if not live.all():  # these words are ready
                keep = np.repeat(live, size)
                done_ids.append(ids[~keep])
                done_word.append(word[~keep])
                ids, word, place, rank, size, lowest = ids[keep], word[keep], place[keep], rank[keep], size[live], lowest[live]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            if self.monotone:  # of overlapping equal pairs, every other one from the left
                run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
                odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2
                hit = hit[odd == 0]
            else:
                hit = hit[np.r_[True, word[hit][1:] != word[hit][:-1]]]
            ids[hit] = self.made[place[hit]]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            new = np.cumsum(keep)[hit] - 1
            ids, word, place = ids[keep], word[keep], place[keep]
            changed = np.unique(np.r_[new, new[new > 0] - 1])
            place[changed] = -1
            at, where = pair_ranks(changed)
            place[at] = where
        ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        out, size = ids[order].astype("<u4").tobytes(), np.bincount(word, minlength=len(words))
        end = np.cumsum(size) * 4
        return [out[a:b] for a, b in zip((end - size * 4).tolist(), end.tolist(), strict=True)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words, in batches of a bounded number of symbols."""
        found, some, symbols = {}, [], 0
        for w in words:
            some.append(w)
            symbols += len(w)
            if symbols > BATCH_SYMBOLS:
                found.update(zip(some, self.merged([x.encode() for x in some]), strict=True))
                some, symbols = [], 0
        if some:
            found.update(zip(some, self.merged([x.encode() for x in some]), strict=True))
        return found

    def words(self, text: str) -> list[str]:
        """The text by the split pattern. Characters too new for the regex library's tables are classed by the tokenizers library."""
        if text.isascii() or not self.late.search(text) or not any(map(unassigned().__getitem__, map(ord, set(text)))):
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.newer.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        parts = []
        for t in texts:
            if self.special_at and any(s in t for s in self.special):
                parts.append([w for x in self.special_at.split(t) if x for w in ([x] if x in self.special else self.words(x))])
            else:
                parts.append(self.words(t))
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        if not known:
            known.update(self.special)
        new = set().union(*parts).difference(known)
        long = self.learn({w for w in new if len(w) > KEPT_CHARS})
        known.update(self.learn(new.difference(long)))
        if not long:
            return [b"".join(map(known.__getitem__, p)) for p in parts]
        return [b"".join([known[w] if w in known else long[w] for w in p]) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def groups(texts: list[str], most: int = 300_000) -> Iterator[list[str]]:
    """Consecutive texts of about `most` characters."""
    some, chars = [], 0
    for t in texts:
        if some and chars + len(t) > most:
            yield some
            some, chars = [], 0
        some.append(t)
        chars += len(t)
    if some:
        yield some


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary): the ids of each whole text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        for b in batches:
            texts, at = ["" if t is None else t for t in b["t"]], 0
            for some in groups(texts):
                yield pd.DataFrame({"k": b["k"].iloc[at : at + len(some)], "ids": bpe.encode(some)})
                at += len(some)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(lean(run), f"k {kind}, ids binary").withColumnRenamed("k", key)


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the decoded text of each row's ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        for b in batches:
            for first in range(0, len(b), 500):
                some = b.iloc[first : first + 500]
                yield pd.DataFrame({"k": some["k"], "text": [bpe.decode(x or b"") for x in some["i"]]})

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInPandas(lean(run), f"k {kind}, text string").withColumnRenamed("k", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            texts, n, enc, dec = ["" if t is None else t for t in b["t"]], [], [], []
            for some in groups(texts):
                for ids in bpe.encode(some):
                    n.append(len(ids) // 4)
                    enc.append(sha(ids))
                    dec.append(sha(bpe.decode(ids).encode("utf-8")))
            yield pd.DataFrame({"k": b["k"], "n_tokens": n, "ids_sha256": enc, "decoded_sha256": dec})

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(lean(run), schema).withColumnRenamed("k", key)
