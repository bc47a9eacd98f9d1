"""One query for each operator of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, bpe, decontam, fracminhash, jaccard, quality, secrets, toxicity, transcripts, url_filters
from .common import fresh_path, table, written

#: Tokenizer files of the installed package, the same on every machine.
WORD_BPE, BYTE_BPE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a fetch day (the tables have none): day 7919 * page_id mod 366 of 2024."""
    day = F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def host_list(captures: DataFrame) -> DataFrame:
    """A dated list (the tables have none), by the hash of each host: hosts, whole domains and paths of one to six segments that
    come, go and come back. The deeper paths are the beginnings of the host's least URL."""
    hosts = captures.select(url_filters.host_of(F.col("url")).alias("host"), "url").filter("host is not null").groupBy("host").agg(F.min("url").alias("url"))
    of = lambda a: F.conv(F.substring(F.md5("host"), a, 2), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    rows = hosts.select("host", of(1).alias("h"), of(3).alias("a"), of(5).alias("b"), F.array_remove(F.split(F.regexp_extract("url", url_filters.PATH, 1), "/"), "").alias("s"))
    event = lambda kind, entry, action, since: F.struct(F.lit(kind).alias("kind"), entry.alias("entry"), F.lit(action).alias("action"), since.alias("since"))
    host, parent = F.col("host"), F.regexp_replace("host", r"^[^.]+\.", "")
    under = lambda path: F.concat_ws("/", host, path)
    a, b = F.col("a"), F.col("a") + F.col("b") + 1
    some = F.when(F.col("h") < 64, F.array(event("host", host, "add", day(a)), event("host", host, "remove", day(b)), event("host", host, "add", day(b + 30))))
    some = some.when(F.col("h") < 72, F.array(event("domain", parent, "add", day(a)), event("domain", parent, "remove", day(b))))
    some = some.when(F.col("h") < 100, F.array(event("prefix", under(F.lit("en")), "add", day(a))))
    some = some.when(F.col("h") < 160, F.array(event("prefix", under(F.slice("s", F.lit(1), 1 + F.col("h") % 3)), "add", day(a)), event("prefix", under(F.lit("en/1/2/3/4/5")), "add", day(a))))
    return rows.select(F.explode(some).alias("e")).select("e.*")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL held against the list entries that were active on its fetch day."""
    captures = page_captures(spark, sf_dir)
    return url_filters.temporal_join(captures, host_list(captures))


def op3_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as raw lines in several marker styles, parsed back into roles and canonical turns."""
    lines, _ = written(transcripts.raw_lines(table(spark, sf_dir, "conversations")), "lines")
    block = transcripts.TURN_ROOM * transcripts.BLOCK_TURNS
    model = transcripts.train(lines, "role", "opens", block=block)
    decoded, _ = written(transcripts.decode(lines, model, block=block), "decoded")
    turns = transcripts.turns(decoded, block=block)
    return turns.select("conv_id", F.col("turn_line").alias("line_no"), "role", "text", transcripts.rendered().alias("canonical"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every whole text."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, with linked weak candidates."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as ids in bit-packed files, read back; id 2 ends each document."""
    out = fresh_path(spark, "token-ids")
    bitpack.write_ids(table(spark, sf_dir, "documents"), WORD_BPE, out, end_id=2)
    return bitpack.read_documents(spark, out)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of texts that share four fifths of their five-word shingles."""
    member, _ = jaccard.jaccard_join(table(spark, sf_dir, "documents"), count_links=True)
    return member.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each document that stand in a ten-word window of a benchmark item."""
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text."""
    return fracminhash.compare_edited(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every whole text."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_transcripts": op3_transcripts,
    "op4_secret_scan": op4_secret_scan,
    "op5_token_files": op5_token_files,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_decontaminate": op8_decontaminate,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality": op10_quality,
}
OP1_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id * 7919) % 366 + 366) % 366 AS INTEGER) AS fetched_at,
    nullif(rtrim(lower(regexp_extract(url, '^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)', 1)), '.'), '') AS host,
    list_filter(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x != '') AS s
  FROM pages),
hosts AS (
  SELECT host, s, ('0x' || substr(md5(host), 1, 2))::INT AS h, ('0x' || substr(md5(host), 3, 2))::INT AS a, ('0x' || substr(md5(host), 5, 2))::INT AS b
  FROM (SELECT host, arg_min(s, url) AS s FROM captures WHERE host IS NOT NULL GROUP BY host)),
list AS (
  SELECT 'host' AS kind, host, host AS entry, DATE '2024-01-01' + a AS since, DATE '2024-01-01' + (a + b + 1) AS until FROM hosts WHERE h < 64
  UNION ALL SELECT 'host', host, host, DATE '2024-01-01' + (a + b + 31), NULL FROM hosts WHERE h < 64
  UNION ALL SELECT 'prefix', host, host || '/en', DATE '2024-01-01' + a, NULL FROM hosts WHERE h BETWEEN 72 AND 99
  UNION ALL SELECT 'prefix', host, array_to_string(list_prepend(host, s[1:1 + h % 3]), '/'), DATE '2024-01-01' + a, NULL FROM hosts WHERE h BETWEEN 100 AND 159
  UNION ALL SELECT 'prefix', host, host || '/en/1/2/3/4/5', DATE '2024-01-01' + a, NULL FROM hosts WHERE h BETWEEN 100 AND 159),
events AS (
  SELECT regexp_replace(host, '^[^.]+\.', '') AS entry, DATE '2024-01-01' + a AS since, 0 AS off FROM hosts WHERE h BETWEEN 64 AND 71
  UNION ALL SELECT regexp_replace(host, '^[^.]+\.', ''), DATE '2024-01-01' + (a + b + 1), 1 FROM hosts WHERE h BETWEEN 64 AND 71),
one AS (SELECT entry, since, max(off) AS off FROM events GROUP BY ALL),
turns AS (SELECT * FROM (SELECT *, lag(off, 1, 1) OVER (PARTITION BY entry ORDER BY since) AS was FROM one) WHERE off != was),
domains AS (SELECT entry, since, until FROM (SELECT *, lead(since) OVER (PARTITION BY entry ORDER BY since) AS until FROM turns) WHERE off = 0),
met AS (
  SELECT url, fetched_at, kind || ':' || entry AS name, since FROM captures c JOIN list l ON c.host = l.host AND since <= fetched_at AND (until IS NULL OR fetched_at < until)
    AND (kind = 'host' OR starts_with(array_to_string(list_prepend(c.host, c.s), '/') || '/', entry || '/'))
  UNION ALL SELECT url, fetched_at, 'domain:' || entry, since FROM captures JOIN domains ON (host = entry OR ends_with(host, '.' || entry) AND NOT regexp_matches(host, '^(\[.*|[0-9]+(\.[0-9]+){3})$')) AND since <= fetched_at AND (until IS NULL OR fetched_at < until)),
said AS (SELECT url, fetched_at, list_sort(list_distinct(list(name))) AS names, max(since) AS since FROM met GROUP BY ALL)
SELECT page_id, url, host, fetched_at, coalesce(len(names), 0)::BIGINT AS n_active, coalesce(array_to_string(names, ','), '') AS active, since, names IS NOT NULL AS blocked
FROM captures LEFT JOIN said USING (url, fetched_at)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id != b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY list_sort(s)) ELSE doc_id END AS class_id FROM s)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, k.class_id, (SELECT count(*) FROM links l WHERE l.a = n.doc_id) AS n_links FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = n.doc_id JOIN classes k ON k.doc_id = n.doc_id
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS size, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda p: array_to_string(w[p:p+9], ' '))) AS g FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS p, unnest(list_transform(range(1, len(w) - size + 2), lambda q: array_to_string(w[q:q+size-1], ' '))) AS g FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, item, p, dw.size FROM dw JOIN iw ON iw.g = dw.g AND iw.size = dw.size),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS at FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

#: The others fit models, call tokenizer libraries or use hashes that DuckDB lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_url_filters": OP1_SQL, "op6_jaccard_join": OP6_SQL, "op8_decontaminate": OP8_SQL}
