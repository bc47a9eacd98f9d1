"""N-gram Jaccard join of documents: every pair of texts whose shingle sets are similar enough, and their groups.

Two sets link when 100 * |A and B| >= percent * |A or B|. The join is exact up to equal 64-bit hashes.
1. Equal sets are one class, by digest; only its smallest doc_id goes on.
2. A similar pair shares one of the first n - ceil(percent * n / 100) + 1 shingles of either set in any
   common order. The order is rare first, by a count sketch of fixed size over all documents, so common
   passages seldom count. These shingles deal the documents into tiles, sorted by size. All that a pair
   shares stands at or after the first shingle it shares, so the places there bound its overlap.
3. In each tile, neighbours by size are candidates. Fixed per-size bitmaps bound their overlap from above;
   the rest are decided by intersecting the sorted arrays.
4. Tiles whose documents are all in one component by now have nothing left to find. In the others, every
   pair from two components within the size band is held against the place and bitmap bounds, in numpy blocks.
   A tile of more than TILE_ROWS rows is cut into size bands, and these into blocks: each pair of blocks that can
   hold similar pairs is a unit of its own, so no task has a whole large tile. Documents with a pair that passes
   are gathered by their units' smallest component, in parts of bounded rows and bytes, where pairs are decided
   exactly, the most alike first, until what belongs together is joined. Rows move by document, never by pair,
   and no link between components is lost.

Null texts and texts without words have the empty set, which links with nothing. Rows without a doc_id
have no component. Rows that share a doc_id count as one document, each of its texts being compared; n_links
counts such a document once for each of its texts. Ids are taken as bigint; others become null. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import groups
from .common import lean, removed, small_side, written
from .components import components
from .shingles import shingle_sets

#: Counters of the sketch that orders shingles by frequency: its size never grows with the input; and chunks summed at once.
SKETCH_BITS, SKETCH_CHUNK, FAN_IN = 20, 1 << 14, 64
#: Documents for each range of shingle hashes, the most ranges (beyond, ranges grow), and postings gathered before they are dealt out.
RANGE_DOCS, MOST_RANGES, FLUSH = 400, 1 << 18, 1_000_000
#: Bytes of sets and rows that one smallest component brings to a part, beyond which its units are spread.
PART_BYTES, PART_ROWS = 8_000_000, 2000
#: Rows of a tile that are one unit, and of a block of a larger one.
TILE_ROWS, TILE_BLOCK = 2000, 1000
#: A class of more rows than this, and than one in so many of all rows, is hot: its rows are not gathered by their class.
HOT_ROWS, HOT_SHARE = 500, 1_000_000
#: Classes of a component that are one block when links are counted; with more, blocks grow and multiply by the square root.
BLOCK = 256
OPEN = "p bigint, lo bigint, u bigint, side int, own boolean, y bigint, n bigint, q bigint, label bigint"
PAIR = "a bigint, b bigint"


def signature(s: np.ndarray) -> bytes:
    """A bitmap of the set, with one to two bits for each of up to 2n places by size."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length()) if len(s) else 64
    out = np.zeros(bits, dtype=np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(m: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) at a smaller power of two."""
    while m.shape[-1] > words:
        half = m.shape[-1] // 2
        m = m[..., :half] | m[..., half:]
    return m


def least_overlap_ok(na: np.ndarray, nb: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of na and nb shingles that differ in at least `differ` can still be similar."""
    return (100 + percent) * (na + nb - differ) >= 2 * percent * (na + nb)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _by_class(rows: DataFrame, classes: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """rows, left-joined with a table that has one row a class. Rows of the hot classes, whose few keys are broadcast, stay where they are."""
    few = F.broadcast(hot.select(key))
    own = classes.join(few, key, "left_semi")
    return rows.join(few, key, "left_semi").join(F.broadcast(own), key, "left").unionByName(rows.join(few, key, "left_anti").join(classes, key, "left"))


def _features(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: a document's set size, digest and bitmap; kind 1: a chunk of a task's sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for b in batches:
            texts, at = ["" if t is None else t for t in b["t"]], 0
            for some in groups(texts):
                sets = shingle_sets(some, words)
                low = np.concatenate(sets) & np.uint64(len(sketch) - 1)
                sketch += np.bincount(low.astype(np.int64), minlength=len(sketch)).astype(np.uint32)
                yield pd.DataFrame({"kind": 0, "k": b["k"].iloc[at : at + len(some)], "n": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "body": [signature(s) for s in sets]})
                at += len(some)
        chunks = [(i, c) for i, c in enumerate(sketch.reshape(-1, SKETCH_CHUNK)) if c.any()]
        yield pd.DataFrame({"kind": 1, "k": [i for i, _ in chunks], "n": TaskContext.get().partitionId(), "digest": b"", "body": [c.astype("<u4").tobytes() for _, c in chunks]})

    return docs.mapInPandas(lean(run), "kind int, k bigint, n bigint, digest binary, body binary")


def _sketch(features: DataFrame) -> np.ndarray:
    """The summed sketch: FAN_IN tasks' chunks at a time, round by round; as many rows come back as it has chunks, whatever the input."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH_CHUNK, dtype=np.uint64)
        for x in rows["body"]:
            total += np.frombuffer(x, dtype="<u4")
        return pd.DataFrame({"k": [key[0]], "n": [key[1]], "body": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})

    chunks = features.filter("kind = 1").select("k", "n", "body")
    tasks = 1 + (chunks.agg(F.max("n")).first()[0] or 0)
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        chunks = chunks.withColumn("n", F.floor(F.col("n") / FAN_IN)).groupBy("k", "n").applyInPandas(add, "k bigint, n bigint, body binary")
    out = np.zeros((1 << SKETCH_BITS) // SKETCH_CHUNK * SKETCH_CHUNK, dtype=np.uint32).reshape(-1, SKETCH_CHUNK)
    for r in chunks.toLocalIterator():
        out[r["k"]] = np.frombuffer(r["body"], dtype="<u4")
    return out.reshape(-1)


def _postings(docs: DataFrame, sketch: np.ndarray, ranges: int, words: int, percent: int) -> DataFrame:
    """The first shingles of each document in rare-first order with their places, packed by range of the shingle hash."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = shared.value
        hs: list[np.ndarray] = []
        ks: list[int] = []
        ns: list[int] = []
        held = 0

        def flush() -> pd.DataFrame:
            h = np.concatenate(hs)
            size = [len(x) for x in hs]
            k, n = np.repeat(np.array(ks, dtype=np.int64), size), np.repeat(np.array(ns, dtype=np.uint32), size)
            q = np.concatenate([np.arange(x, dtype=np.uint32) for x in size])
            r = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(r, kind="stable")
            h, k, n, q, r = h[by], k[by], n[by], q[by], r[by]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            cut = list(zip(first.tolist(), [*first[1:].tolist(), len(r)], strict=True))
            return pd.DataFrame({"r": r[first], "h": [h[x:y].tobytes() for x, y in cut], "k": [k[x:y].tobytes() for x, y in cut], "n": [n[x:y].tobytes() for x, y in cut], "q": [q[x:y].tobytes() for x, y in cut]})

        for b in batches:
            texts, at = ["" if t is None else t for t in b["t"]], 0
            keys = b["k"].tolist()
            for some in groups(texts):
                for k, s in zip(keys[at : at + len(some)], shingle_sets(some, words), strict=True):
                    if not len(s):
                        continue
                    p = prefix_length(len(s), percent)
                    rare = np.argsort(order[(s & np.uint64(len(order) - 1)).astype(np.int64)], kind="stable")[:p]
                    hs.append(s[rare])
                    ks.append(k)
                    ns.append(len(s))
                    held += p
                    if held >= FLUSH:
                        yield flush()
                        hs, ks, ns, held = [], [], [], 0
                at += len(some)
        if hs:
            yield flush()

    return docs.mapInPandas(lean(run), "r bigint, h binary, k binary, n binary, q binary")


def places_ok(na: np.ndarray, nb: np.ndarray, qa: np.ndarray, qb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets whose first common shingle is at places qa and qb can still be similar."""
    return (100 + percent) * np.minimum(na - qa, nb - qb) >= percent * (na + nb)


def _tiles(postings: DataFrame, ranges: int, percent: int) -> DataFrame:
    """kind 0: (x shingle, y document, n size, q place) of tiles with several documents; kind 1: (x, y) candidates, neighbours by size."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(rows["h"]), dtype=np.uint64)
        k = np.frombuffer(b"".join(rows["k"]), dtype=np.int64)
        n, q = (np.frombuffer(b"".join(rows[c]), dtype=np.uint32).astype(np.int64) for c in "nq")
        by = np.lexsort((k, n, h))
        h, k, n, q = h[by], k[by], n[by], q[by]
        same = h[1:] == h[:-1]
        several = np.r_[False, same] | np.r_[same, False]
        near = same & (k[1:] != k[:-1]) & (100 * n[:-1] >= percent * n[1:]) & places_ok(n[:-1], n[1:], q[:-1], q[1:], percent)
        pairs = np.unique(np.stack([np.minimum(k[:-1][near], k[1:][near]), np.maximum(k[:-1][near], k[1:][near])]), axis=1)
        return pd.concat([pd.DataFrame({"kind": 0, "x": h[several].view(np.int64), "y": k[several], "n": n[several], "q": q[several]}), pd.DataFrame({"kind": 1, "x": pairs[0], "y": pairs[1], "n": 0, "q": 0})])

    return postings.repartition(ranges_partitions(postings, ranges), "r").groupBy("r").applyInPandas(run, "kind int, x bigint, y bigint, n bigint, q bigint")


def ranges_partitions(df: DataFrame, ranges: int) -> int:
    """Shuffle partitions as the session has them, or more where ranges outgrow them."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges // 32)


def _bounded(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bitmap bound leaves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for na, nb, sa, sb in zip(b["na"], b["nb"], b["sa"], b["sb"], strict=True):
                x, y = np.frombuffer(sa, dtype="<u8"), np.frombuffer(sb, dtype="<u8")
                words = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                keep.append(100 * min(na, nb) >= percent * max(na, nb) and least_overlap_ok(na, nb, differ, percent))
            yield b.loc[np.array(keep, dtype=bool), ["a", "b"]]

    one = bitmaps.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("body").alias("sa"))
    two = bitmaps.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("body").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInPandas(lean(run), PAIR)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sorted arrays of distinct hashes overlap enough."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(k, n, s): the sorted arrays of the wanted documents and their sizes, as a written table."""

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, at = ["" if t is None else t for t in b["t"]], 0
            for some in groups(texts):
                sets = shingle_sets(some, words)
                yield pd.DataFrame({"k": b["k"].iloc[at : at + len(some)], "n": [len(s) for s in sets], "s": [s.tobytes() for s in sets]})
                at += len(some)

    wanted, _ = written(wanted.distinct(), "wanted")
    return written(docs.join(small_side(wanted, wanted.count()), "k", "left_semi").mapInPandas(lean(arrays), "k bigint, n bigint, s binary"), "sets")[0]


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sorted arrays overlap enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [similar(np.frombuffer(sa, dtype="<u8"), np.frombuffer(sb, dtype="<u8"), percent) for sa, sb in zip(b["sa"], b["sb"], strict=True)]
            yield b.loc[np.array(keep, dtype=bool), ["a", "b"]]

    one, two = sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), sets.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInPandas(lean(run), PAIR)


def _bands(n: Column, percent: int) -> Column:
    """Size bands: similar sets are in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / (math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9)).cast("bigint")


def _units(rows: DataFrame, percent: int) -> DataFrame:
    """rows with u, side and own: a small tile is one unit (own: all its pairs count). A large one is cut into bands of size and these into
    blocks by document; a unit is then a block with itself, or two blocks of one band or of neighbouring ones, whose pairs of two sides count."""
    large, _ = written(rows.groupBy("x").count().filter(F.col("count") > TILE_ROWS).select("x"), "large-tiles")
    n_large = large.count()
    whole = rows.join(small_side(large, n_large), "x", "left_anti").withColumns({"u": F.col("x"), "side": F.lit(0), "own": F.lit(True)}).drop("x")
    if not n_large:
        return whole
    cut = rows.join(small_side(large, n_large), "x", "left_semi").withColumn("k", _bands(F.col("n"), percent))
    blocks, _ = written(cut.groupBy("x", "k").agg(F.ceil(F.count("*") / TILE_BLOCK).cast("bigint").alias("nb")), "bands")
    n_blocks = blocks.count()

    def beside(by: int, name: str) -> DataFrame:
        return small_side(blocks.select("x", (F.col("k") - by).alias("k"), F.col("nb").alias(name)), n_blocks)

    cut = cut.join(beside(0, "nb"), ["x", "k"]).join(beside(1, "up"), ["x", "k"], "left").join(beside(-1, "down"), ["x", "k"], "left").withColumn("i", F.pmod(F.xxhash64("y"), F.col("nb")))
    upto = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)).otherwise(F.array().cast("array<bigint>"))
    unit = lambda k1, k2, i1, i2, side: F.struct(F.xxhash64("x", k1, k2, i1, i2).alias("u"), side.cast("int").alias("side"), ((k1 == k2) & (i1 == i2)).alias("own"))
    k, i = F.col("k"), F.col("i")
    every = F.concat(
        F.transform(upto("nb"), lambda j: unit(k, k, F.least(i, j), F.greatest(i, j), i > j)),
        F.transform(upto("up"), lambda j: unit(k, k + 1, i, j, F.lit(0))),
        F.transform(upto("down"), lambda j: unit(k - 1, k, j, i, F.lit(1))),
    )
    return whole.unionByName(cut.withColumn("e", F.explode(every)).select("lo", "y", "n", "q", "label", "e.u", "e.side", "e.own"))


def _open_rows(tiles: DataFrame, labels: DataFrame, parts: int, percent: int) -> DataFrame:
    """(p, lo, u, side, own, y, n, q, label): rows of the tiles that hold several components, by unit. Tiles with one smallest component
    (lo) go to one part, so a pair that meets in many tiles meets there; a lo of more than PART_BYTES or PART_ROWS goes to
    several, its large units each to one of their own and the small ones dealt over as many as it needs."""
    named = tiles.join(labels, tiles["y"] == labels["node"], "left").select("x", "y", "n", "q", F.coalesce("label", "y").alias("label"))
    still = named.groupBy("x").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("x", "lo")
    rows, _ = written(named.join(still, "x"), "open")
    rows, _ = written(_units(rows, percent), "units")
    much = F.ceil(F.greatest(F.sum("n") * 8 / PART_BYTES, F.count("*") / PART_ROWS))
    large, _ = written(rows.groupBy("lo").agg(much.alias("k")).filter("k > 1"), "large")
    rows = rows.join(small_side(large, large.count()), "lo", "left")
    alone, _ = written(rows.filter("k > 1").groupBy("u").count().filter(F.col("count") >= PART_ROWS / 2).select("u", F.lit(True).alias("alone")), "alone")
    rows = rows.join(small_side(alone, alone.count()), "u", "left")
    spread = F.when(F.col("alone"), F.col("u")).otherwise(F.pmod(F.xxhash64("u", F.lit(1)), F.col("k")))
    part = F.when(F.col("k") > 1, parts + F.pmod(F.xxhash64("lo", spread), F.lit(4 * parts))).otherwise(F.pmod(F.xxhash64("lo"), F.lit(parts)))
    return written(rows.select(part.cast("bigint").alias("p"), "lo", "u", "side", "own", "y", "n", "q", "label"), "spread")[0]


def _tile_pairs(rows: pd.DataFrame, body: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each unit and row: (at, i, j): the places in rows of a unit's documents; the later documents j, within the size band of i
    and of another component, that the place and bitmap bounds leave, the most alike first. rows has `at`, the place of its bitmap in body."""
    rows = rows.drop_duplicates(["u", "side", "at"]).sort_values(["u", "n", "at"], kind="stable")
    u, side, own, at, n, q, label = (rows[c].to_numpy() for c in ("u", "side", "own", "at", "n", "q", "label"))
    cut = np.flatnonzero(np.r_[True, u[1:] != u[:-1], True])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        ls, ns, qs, ss = label[a:b], n[a:b], q[a:b], side[a:b]
        if (ls == ls[0]).all() or (not own[a] and (ss == ss[0]).all()):
            continue
        bodies = [body[k] for k in at[a:b].tolist()]
        sizes = np.array([len(x) for x in bodies])
        for w in np.unique(sizes):  # documents whose bitmap has w words against those with w or more
            mine = np.flatnonzero(sizes == w)
            end = np.searchsorted(ns, ns[mine] * 100 // percent, side="right")
            wide = np.stack([folded(bodies[j], w) for j in range(mine[0], max(int(end.max()), mine[0] + 1))])
            for i, e in zip(mine.tolist(), end.tolist(), strict=True):
                j = np.arange(i + 1, e)
                ok = (ls[j] != ls[i]) & places_ok(ns[i], ns[j], qs[i], qs[j], percent)
                if not own[a]:
                    ok &= ss[j] != ss[i]
                j = j[ok]
                if not len(j):
                    continue
                differ = np.bitwise_count(wide[j - mine[0]] ^ wide[i - mine[0]]).sum(axis=1, dtype=np.int64)
                ok = least_overlap_ok(ns[i], ns[j], differ, percent)
                if ok.any():
                    yield rows.index.to_numpy()[a:b], np.int64(i), j[ok][np.argsort(differ[ok], kind="stable")]


def _placed(rows: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
    """rows with `at`, the place of their set in docs (k, n); a doc_id with several texts of one size has a row for each."""
    return rows.reset_index(drop=True).merge(pd.DataFrame({"y": docs["k"].to_numpy(), "n": docs["n"].to_numpy(), "at": np.arange(len(docs))}), on=["y", "n"])


def _with_sets(rows: DataFrame, sets: DataFrame, body: str) -> DataFrame:
    """(part, k, n, body) of the documents of each part, to be grouped with it."""
    return rows.select(F.col("p").alias("part"), F.col("y").alias("k")).distinct().join(sets.select("k", "n", F.col(body).alias("body")), "k").select("part", "k", "n", "body")


def _still_open(rows: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The rows of documents that have a candidate in another component. rows is a written table."""

    def run(key: tuple, rows: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.drop_duplicates(["k", "n", "body"])
        body = [np.frombuffer(b, dtype="<u8") for b in docs["body"]]
        rows = _placed(rows, docs)
        hit = np.zeros(len(rows), dtype=bool)
        for at, i, j in _tile_pairs(rows, body, percent):
            hit[at[j]] = hit[at[i]] = True
        found = rows[hit][["lo", "at"]].drop_duplicates()  # with all units of their component, for other ways to join it
        return rows.merge(found, on=["lo", "at"])[[c.split()[0] for c in OPEN.split(", ")]]

    return rows.groupBy("p").cogroup(_with_sets(rows, bitmaps, "body").groupBy("part")).applyInPandas(run, OPEN)


def _resolved(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, decided exactly: as many as join what belongs together, not all pairs. rows is a written table."""

    def run(key: tuple, rows: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.drop_duplicates(["k", "n", "body"])
        arrays = [np.frombuffer(s, dtype="<u8") for s in docs["body"]]
        rows = _placed(rows, docs)
        ys, ls, places = (rows[c].to_numpy() for c in ("y", "label", "at"))
        root: dict[int, int] = {}
        apart: set[tuple[int, int]] = set()
        links = []

        def find(k: int) -> int:
            while (up := root.get(k, k)) != k:
                root[k] = root.get(up, up)
                k = up
            return k

        for at, i, js in _tile_pairs(rows, [np.frombuffer(signature(s), dtype="<u8") for s in arrays], percent):
            r = at[i]
            a, la = int(places[r]), int(ls[r])
            for s in at[js].tolist():
                b, lb = int(places[s]), int(ls[s])
                pair = (min(a, b), max(a, b))
                if find(la) == find(lb) or pair in apart:
                    continue
                if similar(arrays[a], arrays[b], percent):
                    links.append((min(ys[r], ys[s]), max(ys[r], ys[s])))
                    root[max(find(la), find(lb))] = min(find(la), find(lb))
                else:
                    apart.add(pair)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.groupBy("p").cogroup(_with_sets(rows, sets, "s").groupBy("part")).applyInPandas(run, PAIR)


def overlaps(x: np.ndarray, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The size of x's intersection with each of several sets, which lie in flat from `first` on."""
    at = np.searchsorted(x, flat)
    at[at == len(x)] = 0
    return np.add.reduceat((x[at] == flat).astype(np.int64), first)


def _counted(nodes: DataFrame, sets: DataFrame, sizes: DataFrame, parts: int, percent: int) -> DataFrame:
    """(class_id, n): for each class the documents of other classes that link with it. nodes: (k, label); sizes: (k, docs).

    Linked classes share a component. One of c classes, more than BLOCK, is cut into sqrt(c) / 4 blocks, and each pair of blocks is one unit
    of work, so a large component is spread over tasks, and a set is copied as often as there are blocks; only sums leave them."""
    many = F.ceil(F.when(F.count("*") > BLOCK, F.sqrt(F.count("*") / 16.0)).otherwise(1.0))
    blocks = nodes.groupBy("label").agg(many.cast("int").alias("nb"))
    own = nodes.join(blocks, "label").withColumn("i", F.pmod(F.xxhash64("k"), F.col("nb")).cast("int"))
    own = own.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    own = own.select("k", "label", "i", F.least("i", "x").alias("lo"), F.greatest("i", "x").alias("hi"))
    own = own.join(sizes, "k").join(sets, "k").withColumn("p", F.pmod(F.xxhash64("label", "lo", "hi"), F.lit(parts)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi), g in rows.groupby(["label", "lo", "hi"], sort=False):
            g = g.sort_values(["n", "k"], kind="stable")
            sets = [np.frombuffer(x, dtype="<u8") for x in g["s"]]
            k, i, docs, n = (g[c].to_numpy() for c in ("k", "i", "docs", "n"))
            flat = np.concatenate(sets)
            first = np.cumsum(n) - n
            marks = [np.frombuffer(signature(x), dtype="<u8") for x in sets]
            width = np.array([len(m) for m in marks])
            found = np.zeros(len(k), dtype=np.int64)
            for w in np.unique(width):
                mine = np.flatnonzero(width == w)
                end = np.searchsorted(n, n[mine] * 100 // percent, side="right")
                wide = np.stack([folded(marks[j], w) for j in range(mine[0], int(end.max()))])
                for a, e in zip(mine.tolist(), end.tolist(), strict=True):
                    b = np.arange(a + 1, e)
                    if lo != hi:
                        b = b[i[b] != i[a]]  # others met where the block meets itself
                    differ = np.bitwise_count(wide[b - mine[0]] ^ wide[a - mine[0]]).sum(axis=1, dtype=np.int64)
                    b = b[least_overlap_ok(n[a], n[b], differ, percent)]
                    if not len(b):
                        continue
                    size = n[b]
                    start = np.cumsum(size) - size
                    whole = flat[np.repeat(first[b] - start, size) + np.arange(size.sum())]
                    both = overlaps(sets[a], whole, start)
                    b = b[100 * both >= percent * (n[a] + size - both)]
                    found[a] += docs[b].sum()
                    found[b] += docs[a]
            out.append(pd.DataFrame({"class_id": k, "n": found}))
        return pd.concat(out).query("n > 0")

    return own.select("p", "label", "lo", "hi", "i", "k", "n", "docs", "s").groupBy("p").applyInPandas(run, "class_id bigint, n bigint").groupBy("class_id").agg(F.sum("n").alias("n"))


def _with_links(members: DataFrame, labels: DataFrame, docs: DataFrame, hot: DataFrame, parts: int, words: int, percent: int) -> DataFrame:
    """members with n_links."""
    sizes = members.filter("n > 0 and k is not null").groupBy("class_id").agg(F.count("*").alias("docs"))
    nodes, _ = written(labels.select(F.col("node").alias("k"), "label").union(labels.select(F.col("label").alias("k"), "label")).distinct(), "nodes")
    other, _ = written(_counted(nodes, _sets(docs, nodes.select("k"), words), sizes.withColumnRenamed("class_id", "k"), parts, percent), "counts")
    own = sizes.join(other, "class_id", "left").select("class_id", (F.col("docs") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    linked = F.when((F.col("n") > 0) & F.col("k").isNotNull(), F.col("n_links"))
    return _by_class(members, own, hot, "class_id").withColumn("n_links", F.coalesce(linked, F.lit(0).cast("bigint")))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, count_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """(membership, links): (doc_id, n_shingles, class_id, component_id) of each row, and verified links (a, b) between classes
    that together connect every component; class_id is the smallest doc_id with the same set. With count_links membership also
    has n_links, the documents that a row links with, copies included."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    features, _ = written(_features(own, words), "features")
    rows = features.filter("kind = 0")
    n = rows.count()
    classes = rows.filter("n > 0 and k is not null").groupBy("digest").agg(F.min("k").alias("class_id"), F.count("*").alias("docs"))
    hot, _ = written(classes.filter(F.col("docs") > max(HOT_ROWS, n // HOT_SHARE)).select("digest", "class_id"), "hot")  # at most HOT_SHARE rows
    hot_ids = hot.select("class_id").distinct()
    sized = rows.select("k", "n", "digest")
    named = _by_class(sized.filter("n > 0"), classes.drop("docs"), hot, "digest").select("k", "n", "digest", F.coalesce("class_id", "k").alias("class_id"))
    members, _ = written(named.unionByName(sized.filter("n = 0").withColumn("class_id", F.col("k"))), "members")  # empty sets are no class
    copies = members.filter("k is not null").groupBy("k").agg(F.min(F.when(F.col("class_id") == F.col("k"), 0).otherwise(1)).alias("copy"), F.min("digest").alias("d"), F.max("digest").alias("e"))
    copies, copies_at = written(copies, "copies")
    equal = copies.filter("copy = 1").select("k")
    single = own.filter("k is not null").join(small_side(equal, equal.count()), "k", "left_anti")

    ranges = max(64, min(MOST_RANGES, n // RANGE_DOCS))
    tiles, tiles_at = written(_tiles(_postings(single, _sketch(features), ranges, words, percent), ranges, percent), "tiles")
    bitmaps = rows.select("k", "n", "body")
    first, first_at = written(_bounded(tiles.filter("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), bitmaps, percent), "first")
    wanted = first.select(F.col("a").alias("k")).union(first.select(F.col("b").alias("k")))
    links, _ = written(_exact(first, _sets(single, wanted, words), percent), "links")
    shared_ids = copies.filter("d != e").select("k").join(members, "k").select(F.col("k").alias("a"), F.col("class_id").alias("b"))
    labels = components(links.unionByName(shared_ids))
    rest, rest_at = written(_still_open(_open_rows(tiles.filter("kind = 0").select("x", "y", "n", "q"), labels, ranges, percent), bitmaps, percent), "rest")
    more_links, _ = written(_resolved(rest, _sets(single, rest.select(F.col("y").alias("k")), words), percent), "more-links")
    every = links.unionByName(more_links)
    if not more_links.isEmpty():
        labels = components(every.unionByName(shared_ids))
    if count_links:
        members = _with_links(members, labels, single, hot_ids, ranges, words, percent)
    member = _by_class(members, labels.withColumnRenamed("node", "class_id"), hot_ids, "class_id").select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "class_id", F.coalesce("label", "class_id").alias("component_id"), *(["n_links"] if count_links else []))
    member, _ = written(member, "member")
    removed(spark, tiles_at, first_at, rest_at, copies_at)
    return member, every
