"""URL filters by a temporal list join (operator 8), in DataFrame functions only.

A list is a history: dated entries that block, allow or remove a pattern. A pattern is a host, which covers its subdomains, and
may have a path prefix; hosts are compared in lower case, paths as they are written, and an address in brackets is one host
without parents. An entry holds from its date until the pattern's next entry; of entries of one pattern and date the
last of allow, block, remove counts. Every capture is joined as of its fetch date with the intervals of its host and all
parent domains. Of the entries active then the most specific decides: most labels in the host, then the longest path.

Equal captures are put together first and judged once. The intervals are broadcast only if they were counted and are few;
otherwise the join shuffles, and the one host that holds a large share of the captures is split by adaptive skew handling.

Input: captures (page_id, url, fetched_on), entries (pattern, action, dated). Result: a row for each capture: page_id,
fetched_on, host, verdict (block, allow or none), pattern (of the deciding entry), valid_from, valid_to (null: still valid),
n_active. Null or hostless URLs and null dates are captures with verdict none. Entries with a null pattern or date, or another
action, are ignored. Null page_ids and repeated rows are kept. Empty tables are fine. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.common import BROADCAST_ROWS

#: The host and the path of a URL.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, domain, prefix, verdict, valid_from, valid_to: when each entry holds; removals leave no interval."""
    rows = entries.select(F.regexp_replace("pattern", r"^[^/]*", "").alias("prefix"), F.lower(F.regexp_extract("pattern", r"^[^/]*", 0)).alias("domain"), F.lower("action").alias("verdict"), F.col("dated").cast("date").alias("valid_from"))
    rows = rows.where(F.col("domain").isNotNull() & F.col("valid_from").isNotNull() & F.col("verdict").isin("allow", "block", "remove")).withColumn("pattern", F.concat("domain", "prefix"))
    rows = rows.groupBy("pattern", "domain", "prefix", "valid_from").agg(F.max("verdict").alias("verdict"))
    rows = rows.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from")))
    return rows.where("verdict <> 'remove'").select("pattern", "domain", "prefix", "verdict", "valid_from", "valid_to")


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The verdict on every capture by the entries that were active when it was fetched."""
    rows = captures.select("page_id", "url", F.col("fetched_on").cast("date").alias("fetched_on")).groupBy("page_id", "url", "fetched_on").agg(F.count("*").alias("times"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("path", F.regexp_extract("url", PATH, 1))
    labels = F.when(F.col("host").startswith("["), F.array("host")).otherwise(F.split("host", r"\."))
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    held = intervals(entries)
    few = held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    spread = rows.withColumn("parent", F.explode(parents))
    active = (F.col("parent") == F.col("domain")) & (F.col("fetched_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))) & F.col("path").startswith(F.col("prefix"))
    met = spread.join(F.broadcast(held) if few else held, active, "left")
    rank = F.when(F.col("domain").isNotNull(), F.struct(F.size(F.split("domain", r"\.")).alias("labels"), F.length("prefix").alias("length"), "pattern", "verdict", "valid_from", "valid_to"))
    out = met.groupBy("page_id", "url", "fetched_on", "host", "times").agg(F.max(rank).alias("top"), F.count("domain").alias("n_active"))
    out = out.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select("page_id", "fetched_on", "host", F.coalesce("top.verdict", F.lit("none")).alias("verdict"), F.col("top.pattern").alias("pattern"), F.col("top.valid_from").alias("valid_from"), F.col("top.valid_to").alias("valid_to"), "n_active")


def dated_pages(pages: DataFrame) -> DataFrame:
    """Captures from pages, which have no fetch date: a day of 2024 by page_id stands in for it."""
    return pages.select("page_id", "url", F.expr("date_add(DATE '2024-01-01', CAST(pmod(page_id * 37, 365) AS INT))").alias("fetched_on"))


def sample_history(pages: DataFrame) -> DataFrame:
    """A list history over the pages' own hosts and their parent domains, for there is no list among the tables; which
    patterns are listed when follows from a digest of the pattern."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    patterns = hosts.select(F.explode(F.array("host", F.regexp_replace("host", r"^[^.]+\.", ""))).alias("pattern")).distinct()
    n = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 6), 16, 10).cast("int")
    listed = patterns.withColumn("n", n)
    event = lambda action, day, path="": F.struct(F.concat("pattern", F.lit(path)).alias("pattern"), F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("dated"))
    n = F.col("n")
    events = [(n % 4 == 0, event("block", n % 200)), (n % 4 == 0, event("remove", n % 200 + 60)), (n % 12 == 0, event("allow", n % 200 + 90)), (n % 5 == 1, event("block", n % 300, "/en"))]
    return listed.select(F.explode(F.array_compact(F.array(*(F.when(c, e) for c, e in events)))).alias("e")).select("e.*")


SQL = r"""
WITH cap AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INT) AS DATE) AS fetched_on,
    rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)', 1)), '.') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row_id
  FROM pages
), pat AS (
  SELECT DISTINCT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS INT) AS n
  FROM (SELECT unnest([host, regexp_replace(host, '^[^.]+\.', '')]) AS pattern FROM cap WHERE host <> '')
), entry AS (
  SELECT pattern, 'block' AS action, DATE '2024-01-01' + n % 200 AS dated FROM pat WHERE n % 4 = 0
  UNION ALL SELECT pattern, 'remove', DATE '2024-01-01' + (n % 200 + 60) FROM pat WHERE n % 4 = 0
  UNION ALL SELECT pattern, 'allow', DATE '2024-01-01' + (n % 200 + 90) FROM pat WHERE n % 12 = 0
  UNION ALL SELECT pattern || '/en', 'block', DATE '2024-01-01' + n % 300 FROM pat WHERE n % 5 = 1
), once AS (
  SELECT pattern, CAST(dated AS DATE) AS dated, max(action) AS action FROM entry GROUP BY ALL
), span AS (
  SELECT pattern, action, dated AS valid_from, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS valid_to,
    CASE WHEN instr(pattern, '/') > 0 THEN substr(pattern, 1, instr(pattern, '/') - 1) ELSE pattern END AS domain,
    CASE WHEN instr(pattern, '/') > 0 THEN substr(pattern, instr(pattern, '/')) ELSE '' END AS prefix
  FROM once
), parent AS (
  SELECT *, array_to_string(list_slice(string_split(host, '.'), i, 1000), '.') AS domain FROM (SELECT *, unnest(generate_series(1, len(string_split(host, '.')))) AS i FROM cap)
), met AS (
  SELECT p.row_id, s.*, row_number() OVER (PARTITION BY p.row_id ORDER BY len(string_split(s.domain, '.')) DESC, length(s.prefix) DESC, s.pattern DESC) AS r, count(*) OVER (PARTITION BY p.row_id) AS n_active
  FROM parent p JOIN span s ON s.domain = p.domain AND s.action <> 'remove' AND p.fetched_on >= s.valid_from AND (s.valid_to IS NULL OR p.fetched_on < s.valid_to) AND starts_with(p.path, s.prefix)
)
SELECT c.page_id, CAST(c.fetched_on AS VARCHAR) AS fetched_on, c.host, coalesce(m.action, 'none') AS verdict, m.pattern, CAST(m.valid_from AS VARCHAR) AS valid_from, CAST(m.valid_to AS VARCHAR) AS valid_to, coalesce(m.n_active, 0) AS n_active
FROM cap c LEFT JOIN met m ON m.row_id = c.row_id AND m.r = 1
"""
