"""Document fingerprints as threshold-scaled sketches, in DataFrame functions only.

A fingerprint keeps every distinct hash (32 bits) of two consecutive words that is below a fixed fraction, 5/8, of the
range. The shared hashes over those of the smaller sketch estimate containment, however unequal the texts: 1 where the
smaller text stands in the larger, 0 (up to equal hashes) where no pair of words is shared. The union of two sketches is
the sketch of the union. Equal texts have equal fingerprints.

A text of n distinct pairs has no hash below the fraction with chance 0.375^n: 0.7 % at six words, 5 % at four, 37 % at
two. It keeps its least hash as a stand-in, which tells equal from unequal texts but is no evidence of containment: without
evidence likeness is 1 if the fingerprints are equal and 0 if not, and `evidence` is 0. That chance for short texts is why
pairs of words and a dense fraction are taken: a sketch that sees six words in a long text has to keep most of a pair's
hash for each word. Sparser ones (`words`, `part`) serve longer texts.

Null texts count as empty; texts without words have an empty fingerprint, like (1) another empty one and unlike (0) all
others. With fewer words than a shingle has, the whole sequence is one. Ids are taken as bigint; others become null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLANKS = r"[\x20\x09-\x0D]+"
#: Words of a shingle, and the part of the hash range that is kept.
WORDS, PART = 2, 0.625
#: Documents for each range of ids in which neighbours are found, and the most ranges (beyond, ranges grow).
RANGE_DOCS, MOST_RANGES = 2000, 65536
#: An id with more rows than this many ranges hold, and more than one in so many of all rows, is cut into ranges of its own.
HEAVY_RANGES, HEAVY_SHARE = 4, 4096


def below(part: float) -> int:
    """Kept hashes are less than this."""
    return int(-(2**31) + 2**32 * part)


def sketch(text: Column, words: int = WORDS, part: float = PART) -> Column:
    """The kept hashes, sorted, as array<int>."""

    def of_words(w: Column) -> Column:
        n = F.size(w)
        one = lambda i: F.shiftright(F.xxhash64(*(F.get(w, i + j) for j in range(words))), 32).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - words)), one)).otherwise(F.array().cast("array<int>"))

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < F.lit(below(part)))
        return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(low)

    split = F.array_remove(F.split(F.lower(text), BLANKS), "")
    # transform over one element names what is used several times, so it is computed once
    return F.transform(F.array(F.transform(F.array(split), of_words)[0]), kept)[0]


def merged(a: Column, b: Column, part: float = PART) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.sort_array(F.array_union(a, b))
    low = F.filter(both, lambda x: x < F.lit(below(part)))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def evidence(a: Column, b: Column, part: float = PART) -> Column:
    """How many hashes the likeness rests on: those of the smaller sketch, 0 if either has a stand-in only."""
    n = lambda x: F.when(F.get(x, F.lit(0)) < below(part), F.size(x)).otherwise(0)
    return F.least(n(a), n(b)).cast("bigint")


def likeness(a: Column, b: Column, part: float = PART) -> Column:
    """Estimated containment of the smaller in the larger, 0 to 1; without evidence whether they are equal."""
    n = evidence(a, b, part)
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).when(a == b, 1.0).otherwise(0.0)


def as_text(s: Column) -> Column:
    """A sketch as text: eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def _range_of(key: str, bounds: list[int]) -> Column:
    """How many bounds (descending) are greater than key: found among every so-manyth bound, then among those between."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    lead = bounds[::step]
    inner = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*(F.lit(x).cast("bigint") for x in xs))
    above = F.when(F.col(key).isNull(), F.lit(len(lead))).otherwise(F.size(F.filter(longs(lead), lambda b: b > F.col(key))))
    rest = F.transform(F.array(above), lambda a: F.when(a == 0, F.lit(0)).otherwise((a - 1) * step + F.size(F.filter(F.get(F.array(*map(longs, inner)), a - 1), lambda b: F.coalesce(b > F.col(key), F.lit(True))))))
    return rest[0]


def _ranges(docs: DataFrame, key: str, tie: str) -> Column:
    """The range of a row, ascending as keys descend: between bounds of the keys; null keys in one of their own; a key with very many rows in
    several by `tie` (descending)."""
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_DOCS))
    most = max(HEAVY_RANGES * RANGE_DOCS, n // HEAVY_SHARE)
    heavy = {r[0]: min(MOST_RANGES, -(-r[1] // RANGE_DOCS)) for r in docs.groupBy(key).count().filter(F.col("count") > most).collect()}  # at most HEAVY_SHARE rows
    bounds = {b for k in heavy if k is not None for b in (k, min(k + 1, 2**63 - 1))}
    if ranges > 1:
        cuts = docs.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
        bounds |= set(cuts or [])
    at = F.when(F.col(key).isNull(), F.lit(len(bounds) + 1)).otherwise(_range_of(key, sorted(bounds, reverse=True))).cast("bigint") * MOST_RANGES
    share = F.lit(0.5) - F.col(tie) / F.lit(2.0**64)  # 0 to 1 as the tie descends
    for k, parts in heavy.items():
        at = at + F.when(F.col(key).eqNullSafe(F.lit(k).cast("bigint")), F.least(F.lit(parts - 1), F.floor(share * parts))).otherwise(0)
    return at


def with_next(docs: DataFrame, made: dict[str, Column], key: str = "k", text: str = "text") -> DataFrame:
    """docs and the columns `made` of each row, with text and `made` of the next row as next_* (descending key, null keys
    last, equal keys by their texts' hashes, descending); after the last comes the first. Keys are cut into ranges, each of
    which gets a copy of the next range's first row."""
    own = docs.withColumn("tie", F.xxhash64(text))
    own = own.withColumn("range", _ranges(own, key, "tie"))
    firsts = own.groupBy("range").agg(F.max(F.struct(key, "tie")).alias("f")).collect()  # a row for each range: two numbers
    columns = [text, *made]
    if not firsts:
        return docs.withColumns(made).select(*docs.columns, *made, *(F.col(c).alias(f"next_{c}") for c in columns))
    order = sorted(r["range"] for r in firsts)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first range's copy goes to the last one
    spark = docs.sparkSession
    at = spark.createDataFrame([(r["range"], before[r["range"]], r["f"][key], r["f"]["tie"]) for r in firsts], "range bigint, goes_to bigint, first bigint, first_tie bigint")
    heads = own.join(F.broadcast(at), "range").filter(F.col(key).eqNullSafe(F.col("first")) & (F.col("tie") == F.col("first_tie")))  # at has a row for each range
    heads = heads.groupBy("range").agg(F.max(F.struct(key, text, *(c for c in docs.columns if c not in (key, text)), "tie")).alias("r"), F.first("goes_to").alias("goes_to"))
    heads, _ = written(heads.select("r.*", F.col("goes_to").alias("range")), "heads")
    rows = own.withColumn("ghost", F.lit(False)).unionByName(heads.withColumn("ghost", F.lit(True))).withColumns(made)
    w = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last(key), F.desc("tie"), F.desc_nulls_last(text))
    return rows.select(*docs.columns, *made, *(F.lead(c).over(w).alias(f"next_{c}") for c in columns), "ghost").filter("not ghost").drop("ghost")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, part: float = PART) -> DataFrame:
    """(key, fp) of each row."""
    return docs.select(key, sketch(F.coalesce(F.col(text), F.lit("")), words, part).alias("fp"))


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, part: float = PART) -> DataFrame:
    """Each text's fingerprint, that of its edited text (its second half replaced by the next document's beginning), their
    likeness, that to the next document's, and the evidence of both."""
    own = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(own, {"fp": sketch(F.col("text"), words, part)})
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("k", n.cast("bigint").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    rows = rows.select("k", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), words, part).alias("edited_fp"))
    fp, edited_fp, next_fp = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    near = (likeness(fp, edited_fp, part).alias("near_edited"), likeness(fp, next_fp, part).alias("near_next"), evidence(fp, edited_fp, part).alias("evidence_edited"), evidence(fp, next_fp, part).alias("evidence_next"))
    return rows.select(F.col("k").alias(key), "n_chars", "edited_sha256", as_text(fp).alias("fingerprint"), as_text(edited_fp).alias("edited_fingerprint"), *near)
