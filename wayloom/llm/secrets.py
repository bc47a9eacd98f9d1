"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans stand alone: assignments to secret names, access identifiers, long hexadecimal runs. Weak candidates
(short or unusual identifiers and secrets, endpoints) are reported only where complementary parts co-occur: a weak
identifier needs a secret, a weak secret an identifier, an endpoint both. A part counts as company if it stands in the
same scope, does not overlap the candidate, and begins or ends within `reach` characters of it. Scopes are a text's
blocks: runs of lines without an empty line between them.

Two interval joins do this, both on bins of positions, so their work is that of the parts near each other: parts with the
scope that contains them, and candidates with the ends of parts before them and the beginnings of parts after them.

Places are found by splitting a text at a pattern: lengths of the pieces and matches add up to code-point offsets.
Null texts count as empty; texts without parts have no spans. Rows without a doc_id are told apart by their text.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, small_side, written

#: The patterns of base spans and the least length of their decisive part (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Weak parts: identifiers and endpoints by name, opaque runs with a digit.
WEAK_ID = r"""(?i:access_?key_?id|key_?id|client_?id|user_?name|user_?id|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})"""
OPAQUE = r"(?<![A-Za-z0-9+/])((?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2})"
ENDPOINT = r"""(https?://[^\x20\x09-\x0D"'<>]+)"""
#: Kinds in the order that breaks ties of position.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
#: What separates scopes, and characters between parts that belong together, at most.
BLANK_LINES = r"\n[\x20\t\r]*\n\s*"
REACH = 200
#: Code points of a bin in which parts meet their scope.
BIN = 4096
#: One of these words is in every text with an assignment, or a weak identifier, in lower case (from the patterns).
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ID_WORDS = ("keyid", "key_id", "client", "user", "login")
#: Names of columns that are added for a while; no table has them.
ROW, SPANS = "_wayloom_row", "_wayloom_spans"


def _found(texts: DataFrame, pattern: str) -> DataFrame:
    """(key, start, end, part): leftmost non-overlapping matches in code points, and the length of their decisive part."""
    here = texts.filter(F.col("text").rlike(pattern))
    p = F.lit(pattern)
    zipped = F.arrays_zip(F.split("text", pattern, -1).alias("piece"), F.regexp_extract_all("text", p, F.lit(0)).alias("whole"), F.regexp_extract_all("text", p, F.lit(1)).alias("part"))
    rows = here.select("key", F.posexplode(zipped).alias("i", "m")).filter("m.whole is not null")
    rows = rows.select("key", "i", F.length("m.piece").alias("gap"), F.length("m.whole").alias("size"), F.length("m.part").alias("part"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("key").orderBy("i"))
    return rows.select("key", (end - F.col("size")).alias("start"), end.alias("end"), "part")


def parts_of(texts: DataFrame) -> DataFrame:
    """(key, start, end, kind, role, strong): base spans and weak candidates. texts: key, text, one row a key."""

    def of(pattern: str, kind: Column, role: str, strong: Column) -> DataFrame:
        return _found(texts, pattern).select("key", "start", "end", kind.alias("kind"), F.lit(role).alias("role"), strong.alias("strong"))

    kind = lambda name: F.lit(KINDS.index(name))
    long = F.col("part") >= LEAST_ASSIGN
    rows = of(ASSIGN, F.when(long, kind("assign")).otherwise(kind("key")), "secret", long)
    long = F.col("part") >= LEAST_ACCESS
    rows = rows.unionByName(of(ACCESS, F.when(long, kind("access")).otherwise(kind("id")), "id", long))
    rows = rows.unionByName(of(HEX, kind("hex"), "secret", F.lit(True)))
    rows = rows.unionByName(of(WEAK_ID, kind("id"), "id", F.lit(False)))
    rows = rows.unionByName(of(OPAQUE, kind("key"), "secret", F.lit(False)))
    return rows.unionByName(of(ENDPOINT, kind("endpoint"), "endpoint", F.lit(False)))


def scopes_of(texts: DataFrame) -> DataFrame:
    """(key, s, e): the blocks of each text, as intervals of code points."""
    pieces = F.arrays_zip(F.split("text", BLANK_LINES, -1).alias("piece"), F.regexp_extract_all("text", F.lit(BLANK_LINES), F.lit(0)).alias("gap"))
    rows = texts.select("key", F.posexplode(pieces).alias("i", "m")).select("key", "i", F.length("m.piece").alias("size"), F.coalesce(F.length("m.gap"), F.lit(0)).alias("gap"))
    end = F.sum(F.col("size") + F.col("gap")).over(Window.partitionBy("key").orderBy("i")) - F.col("gap")
    return rows.select("key", (end - F.col("size")).alias("s"), end.alias("e"))


def scoped(parts: DataFrame, scopes: DataFrame) -> DataFrame:
    """parts with `scope`, the beginning of the block that they stand in: an interval join by bins of positions."""
    bins = scopes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / BIN), F.floor(F.col("e") / BIN))))
    here = parts.withColumn("bin", F.floor(F.col("start") / BIN))
    return here.join(bins, ["key", "bin"]).filter((F.col("start") >= F.col("s")) & (F.col("start") < F.col("e"))).withColumn("scope", F.col("s")).select(*parts.columns, "scope")


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The parts to report: strong ones, and weak ones with complementary parts near them. parts has the column scope; near_id and near_secret are added.

    A candidate looks for ends of parts in the `reach` characters before it and for beginnings in those after it, which no overlapping part has."""
    bin_of = lambda c: F.floor(c / reach)
    side = lambda after, place: F.struct(F.lit(after).alias("after"), bin_of(place).alias("bin"), place.cast("bigint").alias("place"))
    ends = parts.filter("role in ('id', 'secret')").select("key", "scope", "role", F.explode(F.array(side(False, F.col("end")), side(True, F.col("start")))).alias("e")).select("key", "scope", "role", "e.*").distinct()
    look = lambda after, lo, hi, b: F.struct(F.lit(after).alias("after"), b.alias("bin"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    start, end = F.col("start"), F.col("end")
    looks = F.array(*(look(False, start - reach, start, bin_of(start) - i) for i in (0, 1)), *(look(True, end, end + reach, bin_of(end) + i) for i in (0, 1)))
    weak = parts.filter("not strong").select("key", "scope", "start", "end", "kind", F.explode(looks).alias("w")).select("key", "scope", "start", "end", "kind", "w.*").distinct()
    met = weak.join(ends, ["key", "scope", "after", "bin"]).filter("place between lo and hi")
    near = met.groupBy("key", "start", "end", "kind").agg(F.bool_or(F.col("role") == "id").alias("near_id"), F.bool_or(F.col("role") == "secret").alias("near_secret"))
    named = parts.join(near, ["key", "start", "end", "kind"], "left").fillna(False, ["near_id", "near_secret"])
    needs = F.when(F.col("role") == "id", F.col("near_secret")).when(F.col("role") == "secret", F.col("near_id")).otherwise(F.col("near_id") & F.col("near_secret"))
    return named.filter(F.col("strong") | needs)


def _reported(texts: DataFrame, reach: int) -> DataFrame:
    """The parts to report of texts, a written table."""
    parts, _ = written(parts_of(texts), "parts")
    weak = parts.filter("not strong").select("key").distinct()
    some, _ = written(scoped(parts, scopes_of(texts.join(weak, "key", "left_semi"))), "scoped")
    found = linked(some, reach).select("key", "kind", "start", "end", "strong")
    return found.unionByName(parts.filter("strong").select(found.columns)).distinct()


def _names(rows: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(rows), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text), one row for each row key, of texts that can hold spans: a base pattern, or an identifier and a secret."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(row_key(key, text).alias("key"), t.alias("text"))
    has = lambda p: F.col("text").rlike(p)
    low = F.lower("text")
    named = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))  # noqa: E731  # cheaper than a pattern, and true wherever it matches
    some = F.col("text").contains("AKIA") | (named(ASSIGN_WORDS) & has(ASSIGN)) | has(HEX) | (named(ID_WORDS) & has(WEAK_ID) & has(OPAQUE))
    return own.filter(some).dropDuplicates(["key"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of each row of docs."""
    texts, _ = written(candidates(docs, key, text), "candidates")
    rows = _reported(texts, reach).select("key", "kind", "start", "end", (F.col("strong") & (F.col("kind") <= 2)).alias("base")).distinct()
    span = F.struct("start", "kind", "end")
    count = lambda k: F.count_if(F.col("base") & (F.col("kind") == k))
    said = rows.groupBy("key").agg(count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.collect_list(F.when(F.col("base"), span)).alias("b"), F.collect_list(span).alias("a"), F.count_if(~F.col("base")).alias("n_linked"))
    said = said.select("key", "n_assign", "n_access", "n_hex", "n_linked", _names(F.col("b")).alias("b"), _names(F.col("a")).alias("spans"))
    every = docs.select(F.col(key).alias("id"), row_key(key, text).alias("key")).join(said, "key", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return every.select(F.col("id").alias(key), none("n_assign"), none("n_access"), none("n_hex"), F.sha2(F.coalesce("b", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), none("n_linked"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH, mark: str = "[secret]") -> DataFrame:
    """docs with every reported span of the text replaced by `mark`; texts without spans are as they were, and not shuffled."""
    texts, _ = written(candidates(docs, key, text), "candidates")
    found = _reported(texts, reach).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(SPANS))
    found, _ = written(found.withColumnRenamed("key", ROW), "spans")
    ids = small_side(found.select(ROW), found.count())
    own = docs.withColumn(ROW, row_key(key, text))
    clean = own.join(ids, ROW, "left_anti").drop(ROW)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]  # overlapping spans share one mark
        before = F.substr(F.col(text), (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int"))
        out = F.when(fresh, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rebuilt = F.aggregate(SPANS, start, cut, lambda acc: F.concat(acc["out"], F.substr(F.col(text), (acc["at"] + 1).cast("int"))))
    dirty = own.join(ids, ROW, "left_semi").join(found, ROW).withColumn(text, rebuilt)
    return clean.unionByName(dirty.select(*docs.columns))
