"""64-bit hashes of words and word shingles, for whole batches of texts at once in numpy."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: Bytes hashed at once. A longer word is hashed by another function, so memory stays bounded.
PORTION = 1 << 18
BASE = 0x9E3779B97F4A7C15
#: Multipliers of a published 64-bit mixing function (fixed values).
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: A-Z to lower case, white space (0x20, 0x09-0x0D) to the blank.
FOLD = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Letters and digits as they are, all other ASCII to the blank.
LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, and an odd random number for each byte."""
    n = PORTION + 1

    def row(b: int) -> np.ndarray:
        out = np.full(n, b, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return row(BASE), row(pow(BASE, -1, 1 << 64)), mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def _piece(data: bytes, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """Hashes of the blank-separated words of at most PORTION bytes; with prefixes a column more for the first so many bytes of each."""
    up, down, of_byte = powers()
    a = np.frombuffer(data, dtype=np.uint8)
    word = np.zeros(len(a) + 2, dtype=np.int8)
    word[1:-1] = a != 32
    edge = np.diff(word)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(of_byte[a] * up[: len(a)], out=total[1:])
    h = mixed((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))
    if not prefixes:
        return h
    parts = [np.minimum(end, first + p) for p in prefixes]
    return np.stack([h, *(mixed((total[x] - total[first]) * down[first] + np.uint64(1000 + p)) for x, p in zip(parts, prefixes, strict=True))], axis=1)


def word_hashes(data: bytes, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """Hashes of the words of folded data, in order; with prefixes also those of each word's beginnings."""
    out, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > PORTION:
            end = data.rfind(b" ", at, at + PORTION) + 1
            if not end:  # one word of more than PORTION bytes
                end = data.find(b" ", at + PORTION) % (len(data) + 1)
                one = np.frombuffer(hashlib.blake2b(data[at:end].rstrip(b" "), digest_size=8).digest(), dtype="<u8")
                out.append(np.repeat(one, 1 + len(prefixes))[None] if prefixes else one)
                at = end
                continue
        out.append(_piece(data[at:end], prefixes))
        at = end
    return np.concatenate(out) if out else np.zeros((0, 1 + len(prefixes)) if prefixes else 0, dtype=np.uint64)


def words_and_counts(texts: list[str], prefixes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (of 2**bits) of the words of all texts, lower-cased and without ASCII punctuation, and the words of each text."""
    folded = [t.lower().encode("utf-8", "surrogatepass").translate(LETTERS) for t in texts]
    data = b" ".join(folded)
    return (word_hashes(data, prefixes) >> np.uint64(64 - bits)).astype(np.uint32), np.array(_counts(folded, data), dtype=np.int64)


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words the whole sequence is one."""
    folded = [(t or "").encode("utf-8", "surrogatepass").translate(FOLD) for t in texts]
    out: list[np.ndarray] = []
    first = held = 0
    for i, f in enumerate(folded):
        held += len(f) + 1
        if held >= PORTION // 2 or i + 1 == len(folded):
            out += _sets(folded[first : i + 1], words)
            first, held = i + 1, 0
    return out


def _sets(folded: list[bytes], words: int) -> list[np.ndarray]:
    data = b" ".join(folded)
    h = word_hashes(data)
    count = _counts(folded, data)
    many = np.uint64(BASE)
    s = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
    for j in range(words):
        s = s * many + h[j : j + len(s)]
    s = mixed(s)
    out, at = [], 0
    for n in count:
        if n >= words:
            out.append(np.unique(s[at : at + n - words + 1]))
        elif n:
            one = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in h[at : at + n]:
                    one = one * many + x
            out.append(mixed(np.array([one], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def _counts(folded: list[bytes], data: bytes) -> list[int]:
    """Words of each text."""
    a = np.frombuffer(data, dtype=np.uint8)
    word = a != 32
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = np.cumsum([len(f) + 1 for f in folded])
    before = np.concatenate([[0], np.cumsum(start)])
    return np.diff(before[np.minimum(np.r_[0, end], len(a))]).tolist()
