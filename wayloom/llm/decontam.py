"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of each sliding window of w k-gram hashes the least is kept, for documents and benchmark items alike; with
k + w - 1 = the window of words that counts, every shared span that long has a kept hash in common. Documents
that hold a kept hash of an item are extended around it: their windows whose least hash is an item's are joined
with the distinct windows of all items, word by word, so equal hashes alone never count. Items shorter than the
window count as one window, met by the hash of all their words.

A window that many items share is one row, and windows of the same items share one list, so rows are documents' windows,
never documents times items; items are listed once for each set of lists that documents have. Windows of the benchmark are broadcast
when their rows and bytes are counted as few, else joined by their words.

Nulls and texts without words have no words and no hits. Items without words or id are ignored. Rows without
a doc_id are told apart by their text, and so are rows that share a doc_id. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, row_key, small_side, written

#: What separates words, once A-Z are lower case (fixed value).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """The words of a text; only A-Z are lowered. Where all characters are single bytes, lower() does that faster."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def grams(words: str, k: int) -> Column:
    """The hash of each k consecutive words, in order."""
    n = F.size(words)
    one = lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k)))
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), one)).otherwise(F.array().cast("array<bigint>"))


def leasts(hashes: str, w: int) -> Column:
    """The least hash of each window of w, in order."""
    n = F.size(hashes)
    one = lambda i: F.least(*(F.get(hashes, i + j) for j in range(w))) if w > 1 else F.get(hashes, i)
    return F.when(n >= w, F.transform(F.sequence(F.lit(0), n - w), one)).otherwise(F.array().cast("array<bigint>"))


def items_of(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    rows = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words_of(text).alias("v"))
    return rows.withColumn("len", F.size("v")).filter("len > 0").distinct()


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (w words, g, and their list of items la, lb) and the lists (la, lb, item): windows of the same items share a list, which
    two hashes over its items and their number name."""
    w = F.least(F.lit(window), F.col("len"))
    each = items.select("item", w.alias("w"), F.explode(F.transform(F.sequence(F.lit(1), F.col("len") - w + 1), lambda i: F.slice("v", i, w))).alias("g")).distinct()
    named = each.groupBy("w", "g").agg(F.xxhash64(F.bit_xor(F.xxhash64("item")), F.count("*")).alias("la"), F.bit_xor(F.xxhash64("item", F.lit(1))).alias("lb"))
    named, _ = written(named, "benchmark-windows")
    lists, _ = written(each.join(named, ["w", "g"]).select("la", "lb", "item").distinct(), "benchmark-lists")
    return named, lists


def _prints(items: DataFrame, window: int, k: int) -> DataFrame:
    """(hash): the kept hashes of items."""
    long = items.filter(F.col("len") >= window).withColumn("h", grams("v", k)).select(F.explode(leasts("h", window - k + 1)).alias("hash"))
    for r in items.filter(F.col("len") < window).select("len").distinct().collect():  # below window
        long = long.unionByName(items.filter(F.col("len") == r["len"]).select(F.explode(grams("v", r["len"])).alias("hash")))
    return long.distinct()


def hit_windows(docs: DataFrame, items: DataFrame, windows: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """(key, s, w, la, lb): each window of w words of an item that stands at word s of a document, with its list of items. docs: key, text."""
    prints, _ = written(_prints(items, window, k), "benchmark-prints")
    n_prints = prints.count()
    lengths = [r[0] for r in windows.select("w").distinct().sort("w").collect()]  # up to window
    if not lengths:
        return docs.sparkSession.createDataFrame([], "key string, s int, w int, la bigint, lb bigint")
    marks = lambda n: leasts("h", window - k + 1) if n == window else grams("words", n)
    split = docs.withColumn("words", words_of("text"))
    arrays = [F.array_distinct(marks(n)) for n in lengths]
    marked = split.withColumn("h", grams("words", k)).select("key", F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("hash"))
    met, _ = written(marked.join(small_side(prints, n_prints), "hash", "left_semi").select("key").distinct(), "met")
    found, _ = written(split.join(small_side(met, met.count()), "key", "left_semi").select("key", "words").distinct(), "found")

    places = None
    for n in lengths:
        at = found.withColumn("h", grams("words", k)).select("key", "words", F.posexplode(marks(n)).alias("s", "hash"))
        at = at.join(small_side(prints, n_prints), "hash", "left_semi").select("key", "s", F.lit(n).alias("w"), F.slice("words", F.col("s") + 1, F.lit(n)).alias("g"))
        places = at if places is None else places.unionByName(at)
    n, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("g", " "))), F.lit(0))).first()
    return places.join(small_side(windows, n if size <= BROADCAST_BYTES else BROADCAST_ROWS + 1), ["w", "g"]).select("key", "s", "w", "la", "lb")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs."""
    own = docs.select(F.col(key).alias("id"), row_key(key, text).alias("key"), F.col(text).alias("text"))
    items, _ = written(items_of(benchmark, item, item_text), "items")
    windows, lists = item_windows(items, window)
    hits, _ = written(hit_windows(own.select("key", "text"), items, windows, window, k), "hits")
    ends = hits.groupBy("key", "s").agg(F.max(F.col("s") + F.col("w")).alias("e"))
    before = F.max("e").over(Window.partitionBy("key").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("e") - F.greatest(F.col("s"), F.coalesce(before, F.col("s")))
    covered = ends.withColumn("new", F.greatest(F.lit(0), new)).groupBy("key").agg(F.sum("new").cast("bigint").alias("n_hit"))
    sets, _ = written(hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("la", "lb"))).alias("ls")), "list-sets")
    distinct = sets.select("ls").distinct().select("ls", F.explode("ls").alias("l")).select("ls", "l.la", "l.lb")
    listed = distinct.join(lists, ["la", "lb"]).groupBy("ls").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = listed.select("ls", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("sha"))
    said = covered.join(sets.join(listed, "ls").drop("ls"), "key")
    rows = own.select("id", "key", F.size(words_of("text")).cast("bigint").alias("n_words")).join(said, "key", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.select(F.col("id").alias(key), "n_words", count("n_hit"), count("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
