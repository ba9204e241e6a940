"""Queries over the relational cores, with the SQL that says what each must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.operators import evaluate, geometry, quality, records, regions, render, values
from foliomill.plans.text_queries import SPACE_SQL, TURN, conversation_blocks, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("SPACE", SPACE_SQL)
        return f

    return add


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1")
def digest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.canonical(digests(spark, sf_dir), "digest", "doc_id")


@query(
    """
WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents), o AS (SELECT digest, min(doc_id) AS first, count(*) AS n FROM d GROUP BY 1)
SELECT doc_id, digest, CASE WHEN n > 1 THEN first END AS first, CASE WHEN n > 1 THEN n END AS n FROM d JOIN o USING (digest)
"""
)
def digest_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digests(spark, sf_dir).drop("source")
    return records.replay(rows, records.canonical(rows, "digest", "doc_id").where("n > 1"), "digest")


def warning_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a fifth of the users as one document's warnings each."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("doc_id"), F.col("event_type").alias("code"), F.col("event_id").alias("seq"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"))


def bounded_sql(summary_code: str, told: str) -> str:
    return f"""
WITH w AS (SELECT user_id % 5 AS doc_id, event_type AS code, event_id AS seq, 'event ' || event_id AS message FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY seq) AS rank FROM w)
SELECT doc_id, code, rank::INT AS rank, message FROM r WHERE rank <= 20
UNION ALL SELECT doc_id, {summary_code}, 21, {told} FROM w GROUP BY doc_id, code HAVING count(*) > 20
"""


@query(bounded_sql("'office_warnings_truncated'", "'suppressed ' || (count(*) - 20) || ' additional ' || code || ' warnings'"))
def bounded_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.bounded(warning_stream(spark, sf_dir))


@query(bounded_sql("code", "(count(*) - 20) || ' additional ' || code || ' warnings suppressed'"))
def sheet_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.bounded(warning_stream(spark, sf_dir).distinct(), same_code=True)


@query(
    r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '[SPACE]+', '', 'g') AS d FROM documents),
c AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(d, '')) AS c FROM t) WHERE c <> '' GROUP BY ALL),
m AS (SELECT doc_id, max(n) AS top FROM c GROUP BY 1)
SELECT doc_id, length(d) AS n_chars, round((length(d) - length(regexp_replace(regexp_replace(d, '\(cid:[0-9]+\)', '', 'g'), '[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}\x{FDD0}-\x{FDEF}]', '', 'g'))) / greatest(length(d), 1), 9) AS bad_ratio,
  round(coalesce(top, 0) / greatest(length(d), 1), 9) AS repeated_ratio, NOT (length(d) >= 40 AND coalesce(top, 0) / greatest(length(d), 1) > 0.35) AS reliable FROM t LEFT JOIN m USING (doc_id)
"""
)
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.measured(table(spark, sf_dir, "documents")).withColumn("reliable", quality.reliable())
    return out.select("doc_id", "n_chars", F.round("bad_ratio", 9).alias("bad_ratio"), F.round("repeated_ratio", 9).alias("repeated_ratio"), "reliable")


@query(
    r"""
WITH l AS (SELECT source AS doc, doc_id AS page, e.edge, e.t AS text FROM (SELECT source, doc_id, unnest([{'edge': 'top', 't': string_split(text, chr(10))[1]}, {'edge': 'bottom', 't': string_split(text, chr(10))[-1]}]) AS e FROM documents)),
n AS (SELECT *, regexp_replace(lower(regexp_replace(text, '[SPACE]+', ' ', 'g')), '^ | $', '', 'g') AS norm FROM l),
p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY 1), s AS (SELECT doc, edge, norm, count(DISTINCT page) AS k FROM n GROUP BY ALL)
SELECT doc, page, edge, norm, k >= greatest(3, ceil(pages * 60 / 100)) OR (edge = 'bottom' AND regexp_matches(norm, '^(?:page[SPACE]+)?[0-9]+(?:[SPACE]+(?:of|/)[SPACE]+[0-9]+)?$')) AS suppressed
FROM n JOIN p USING (doc) JOIN s USING (doc, edge, norm) WHERE norm <> ''
"""
)
def repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("text", "\n", -1)
    ends = F.explode(F.array(F.struct(F.lit("top").alias("edge"), F.get(parts, F.lit(0)).alias("text")), F.struct(F.lit("bottom").alias("edge"), F.element_at(parts, -1).alias("text"))))
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), ends.alias("e")).select("doc", "page", "e.edge", "e.text")
    return quality.edge_lines(lines).select("doc", "page", "edge", "norm", "suppressed")


FONT = "l_quantity / 3.0"


@query(
    f"""
WITH w AS (SELECT l_orderkey, round_even({FONT} * 2, 0) / 2 AS half, sum(length(CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR))) AS w FROM lineitem GROUP BY ALL)
SELECT l_orderkey, arg_min(half, (-w, half)) AS body FROM w GROUP BY 1
"""
)
def body_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(FONT.replace("3.0", "3.0D")).alias("size"), F.length(F.round("l_extendedprice").cast("long").cast("string")).alias("weight"))
    return quality.body_size(words, "l_orderkey")


@query(
    """
WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity AS size, l_shipmode_text AS text FROM (SELECT *, 'Line ' || l_linenumber || CASE WHEN l_linenumber % 3 = 0 THEN '.' ELSE '' END AS l_shipmode_text FROM lineitem)),
b AS (SELECT l_orderkey, arg_min(half, (-w, half)) AS body FROM (SELECT l_orderkey, round_even(size * 2, 0) / 2 AS half, sum(length(text)) AS w FROM w GROUP BY ALL) GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN text LIKE '%.' OR size / body < 1.25 AND NOT (size / body >= 1.12 AND l_linenumber % 2 = 0) THEN NULL WHEN size / body >= 1.8 THEN 1 WHEN size / body >= 1.45 THEN 2 ELSE 3 END AS level FROM w JOIN b USING (l_orderkey)
"""
)
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, ".").otherwise(""))
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("size"), text.alias("text"), F.length(text).alias("weight"), F.when(F.col("l_linenumber") % 2 == 0, "Sans-Bold").alias("font"))
    both = words.join(quality.body_size(words, "l_orderkey"), "l_orderkey")
    return both.select("l_orderkey", "l_linenumber", quality.heading_level(F.col("size"), F.col("body"), F.col("text"), F.col("font")).alias("level"))


MARKED = "CASE doc_id % 4 WHEN 0 THEN '- ' WHEN 1 THEN (doc_id % 50) || '. ' WHEN 2 THEN '• ' ELSE '' END"


@query(
    rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
t AS (SELECT doc_id, n::INT AS n, {MARKED} || part AS line FROM l)
SELECT doc_id, n AS line, CASE WHEN regexp_matches(line, '^[•◦▪‣⁃*+-][SPACE]+.+$') THEN 'bullet' WHEN regexp_matches(line, '^[0-9]{{1,9}}[.)][SPACE]+.+$') THEN 'ordered' END AS kind,
  TRY_CAST(nullif(regexp_extract(line, '^([0-9]{{1,9}})[.)][SPACE]+(.+)$', 1), '') AS BIGINT) AS ordinal,
  coalesce(nullif(regexp_extract(line, '^[•◦▪‣⁃*+-][SPACE]+(.+)$', 1), ''), nullif(regexp_extract(line, '^([0-9]{{1,9}})[.)][SPACE]+(.+)$', 2), '')) AS content FROM t
"""
)
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text, counted from 0."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "text"))
    text = F.concat(F.expr(MARKED.replace("(doc_id % 50) || ", "CAST(doc_id % 50 AS STRING) || ")), F.col("text"))
    return lines.select("doc_id", "line", quality.list_marker(text).alias("m")).select("doc_id", "line", "m.kind", "m.ordinal", "m.content")


@query(
    r"""
WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(\p{Ll}{9})(\p{Ll}{3})', '\1-' || chr(10) || '\2', 'g'), chr(10)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, coalesce(list_reduce(l, lambda a, b: CASE
  WHEN ends_with(a, chr(173)) AND regexp_matches(b, '^[a-z]+(?:[^\p{L}\p{N}_]|$)') OR regexp_matches(a, '[A-Za-z]{2}-$') AND regexp_matches(b, '^([a-z]*(?:SUFFIX))(?:[^\p{L}\p{N}_]|$)') THEN a[:-2] || b
  WHEN regexp_matches(a, '[- \n]$') OR regexp_matches(b, '^[,.;:!?)\]}，。；：！？]') THEN a || b ELSE a || ' ' || b END), '') AS paragraph
FROM t WHERE l IS NOT NULL AND len(l) > 0 UNION ALL SELECT doc_id, CASE WHEN text IS NOT NULL THEN '' END FROM documents WHERE text IS NULL OR len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) = 0
""".replace("SUFFIX", "|".join(quality.SUFFIXES))
)
def paragraph_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.split(F.regexp_replace("text", r"(\p{Ll}{9})(\p{Ll}{3})", "$1-\n$2"), "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", quality.join_lines(broken).alias("paragraph"))


BOX = "least(x1, x2) AS l, least(y1, y2) AS t, greatest(x1, x2) AS r, greatest(y1, y2) AS b FROM (SELECT vec_id, label, round((embedding[1]::DOUBLE + 1) / 2, 3) AS x1, round((embedding[2]::DOUBLE + 1) / 2, 3) AS y1, round((embedding[3]::DOUBLE + 1) / 2, 3) AS x2, round((embedding[4]::DOUBLE + 1) / 2, 3) AS y2 FROM embeddings)"


def nearest(x: Column, places: int) -> Column:
    """`x`, not negative, rounded as the SQL's round() does it: its product with a power of ten to the nearest whole number, halves up.
    F.round goes by the decimal digits of `x`, which now and then ends in another last place and takes longer."""
    power = F.lit(10.0**places)
    whole = F.rint(x * power)  # halves to even
    return (whole + F.when(x * power - whole == 0.5, 1.0).otherwise(0.0)) / power


def vector_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, box: the first four components of a vector as two corners."""
    at = lambda i: F.round((F.col("embedding")[i].cast("double") + 1) / 2, 3)
    low, high = (lambda i, j: F.least(at(i), at(j))), (lambda i, j: F.greatest(at(i), at(j)))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.struct(low(0, 2).alias("left"), low(1, 3).alias("top"), high(0, 2).alias("right"), high(1, 3).alias("bottom")).alias("box"))


PAIRS = f"""
WITH v AS (SELECT vec_id, label, {BOX}),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, greatest(least(a.r, b.r) - greatest(a.l, b.l), 0) * greatest(least(a.b, b.b) - greatest(a.t, b.t), 0) AS i, (a.r - a.l) * (a.b - a.t) + (b.r - b.l) * (b.b - b.t) AS s
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id)
"""


@query(PAIRS + "SELECT a, b, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 9) AS iou FROM p WHERE i > 0")
def bbox_pairs_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = geometry.overlapping(vector_boxes(spark, sf_dir), "label", "vec_id")
    return both.select("a", "b", nearest(geometry.iou(F.col("x"), F.col("y")), 9).alias("iou"))


@query(
    f"""
WITH v AS (SELECT vec_id, label, {BOX})
SELECT vec_id, label FROM v WHERE NOT EXISTS (SELECT 1 FROM v t WHERE t.label = v.label AND t.vec_id <> v.vec_id AND (v.l + v.r) / 2 BETWEEN t.l AND t.r AND (v.t + v.b) / 2 BETWEEN t.t AND t.b)
"""
)
def center_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box is a word, and a table to all others of its label."""
    v = vector_boxes(spark, sf_dir)
    return geometry.unowned(v, v, ["label"], apart="vec_id").select("vec_id", "label")


@query(
    f"""
WITH v AS (SELECT vec_id, label, {BOX}), e AS (SELECT DISTINCT label, unnest([l, r]) AS x FROM v),
s AS (SELECT label, x, lead(x) OVER (PARTITION BY label ORDER BY x) AS u FROM e),
h AS (SELECT s.label, s.x, s.u, v.t, v.b, max(v.b) OVER (PARTITION BY s.label, s.x ORDER BY v.t, v.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s JOIN v ON v.label = s.label AND v.l <= s.x AND v.r >= s.u WHERE s.u IS NOT NULL)
SELECT label, round(sum((u - x) * greatest(b - greatest(t, coalesce(reach, t)), 0)), 9) AS area FROM h GROUP BY 1
"""
)
def union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.union_area(vector_boxes(spark, sf_dir), "label").select("label", F.round("area", 9).alias("area"))


@query(
    """
WITH l AS (SELECT item_id AS k, c, count(*) AS a FROM (SELECT item_id, unnest(string_split(regexp_replace(text, '[SPACE]+', '', 'g'), '')) AS c FROM benchmark) WHERE c <> '' GROUP BY ALL),
r AS (SELECT doc_id AS k, c, count(*) AS b FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[SPACE]+', '', 'g'), '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL)
SELECT k AS item_id, round(sum(least(a, coalesce(b, 0))) / sum(a), 9) AS ratio FROM l LEFT JOIN r USING (k, c) GROUP BY 1
"""
)
def multiset_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return quality.captured(left, right, "item_id").select("item_id", F.round("ratio", 9).alias("ratio"))


@query(
    """
WITH p AS (SELECT doc_id, doc_id % 29 = 0 AS failed, doc_id % 7 > 0 AS has_text, n_chars % 5 > 0 AS reliable, (n_chars % 20) / 20.0 AS image_share, doc_id % 6 AS regions, (n_chars % 10) / 10.0 AS area FROM documents)
SELECT doc_id, CASE WHEN failed THEN 'full_vision' WHEN NOT has_text AND regions = 0 THEN 'blank' WHEN NOT has_text OR NOT reliable OR image_share >= 0.85 OR regions > 4 OR area >= 0.6 THEN 'full_vision' WHEN regions > 0 THEN 'hybrid' ELSE 'native' END AS route,
  CASE WHEN failed THEN 'native_text_unreliable' WHEN NOT has_text AND regions = 0 THEN 'no_text_or_visual_objects' WHEN NOT has_text THEN 'visual_only_page' WHEN NOT reliable THEN 'native_text_unreliable' WHEN image_share >= 0.85 THEN 'full_page_image' WHEN regions > 4 OR area >= 0.6 THEN 'visual_regions_cover_page' WHEN regions > 0 THEN 'localized_visual_regions' ELSE 'native_content_reliable' END AS reason FROM p
"""
)
def page_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_chars")
    r = geometry.route(d % 29 == 0, d % 7 > 0, n % 5 > 0, (n % 20) / 20.0, d % 6, (n % 10) / 10.0)
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.route", "r.reason")


GRID = "SELECT DISTINCT event_type AS sheet, user_id::INT AS row, (event_id % 37)::INT AS col FROM events"


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell for every event: rows by user, so that the grid stays sparse."""
    cells = table(spark, sf_dir, "events")
    return cells.select(F.col("event_type").alias("sheet"), F.col("user_id").cast("int").alias("row"), (F.col("event_id") % 37).cast("int").alias("col")).distinct()


COMPONENTS = f"""
RECURSIVE g AS ({GRID}), reach AS (
  SELECT sheet, row, col, row AS r0, col AS c0 FROM g
  UNION SELECT g.sheet, g.row, g.col, reach.r0, reach.c0 FROM reach JOIN g ON g.sheet = reach.sheet AND abs(g.row - reach.row) + abs(g.col - reach.col) = 1
), seed AS (SELECT sheet, row, col, min(r0::BIGINT * 1000 + c0) AS s FROM reach GROUP BY ALL), lab AS (SELECT sheet, row, col, (dense_rank() OVER (PARTITION BY sheet ORDER BY s) - 1)::INT AS region FROM seed)
"""


@query(f"WITH {COMPONENTS} SELECT * FROM lab")
def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.components(sheet_cells(spark, sf_dir), "sheet")


@query(
    f"""
WITH {COMPONENTS}, box AS (SELECT sheet, region, min(row) AS top, min(col) AS lft, max(row) AS bottom, max(col) AS rgt FROM lab GROUP BY ALL HAVING count(*) > 2),
s AS (SELECT sheet, region, unnest(generate_series(top, bottom)) AS row, lft, rgt FROM box), c AS (SELECT sheet, region, row, unnest(generate_series(lft, rgt)) AS col FROM s),
f AS (SELECT c.sheet, c.region, c.row, c.col, coalesce(c.row || ',' || g.col, '') AS text FROM c LEFT JOIN g ON g.sheet = c.sheet AND g.row = c.row AND g.col = c.col),
l AS (SELECT sheet, region, row, string_agg(text, '|' ORDER BY col) AS line FROM f GROUP BY ALL)
SELECT sheet, region, string_agg(line, chr(10) ORDER BY row) AS grid FROM l GROUP BY ALL
"""
)
def region_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sheet_cells(spark, sf_dir)
    found = regions.boxes(regions.components(cells, "sheet"), "sheet").where("n > 2")
    texts = cells.withColumn("text", F.concat_ws(",", "row", "col"))
    return regions.dense(found, texts, "sheet").select("sheet", "region", F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "\n").alias("grid"))


RANGES = [(0, 10, 1, 200, 3), (1, 50, 2, 90, 6), (2, 1, 4, 500, 4), (0, 300, 5, 400, 7)]


@query(
    f"""
WITH c AS (SELECT l_orderkey % 3 AS sheet, l_partkey AS row, l_linenumber AS col, l_orderkey FROM lineitem), r(sheet, t, l, b, r) AS (VALUES {", ".join(map(str, RANGES))})
SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM r WHERE r.sheet = c.sheet AND c.row BETWEEN r.t AND r.b AND c.col BETWEEN r.l AND r.r)
"""
)
def range_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).alias("sheet"), F.col("l_partkey").alias("row"), F.col("l_linenumber").alias("col"), "l_orderkey")
    ranges = spark.createDataFrame(RANGES, "sheet long, top long, left long, bottom long, right long")
    return geometry.covered_cells(cells, F.broadcast(ranges), "sheet")  # four literal rows


@query(
    """
WITH p AS (SELECT p_partkey, (p_partkey * 7 % 18278 + 1) AS n FROM part)
SELECT p_partkey, n, CASE WHEN n <= 26 THEN chr((64 + n)::INT) WHEN n <= 702 THEN chr((65 + (n - 27) // 26)::INT) || chr((65 + (n - 27) % 26)::INT) ELSE chr((65 + (n - 703) // 676)::INT) || chr((65 + (n - 703) // 26 % 26)::INT) || chr((65 + (n - 703) % 26)::INT) END AS letters, n AS back FROM p
"""
)
def a1_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_partkey") * 7 % 18278 + 1).alias("n")
    rows = table(spark, sf_dir, "part").select("p_partkey", n).withColumn("letters", records.column_letters(F.col("n")))
    return rows.withColumn("back", records.column_number(F.col("letters")))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 10, l_suppkey % 4, l_linenumber % 3, l_linenumber)::INT AS object_index FROM lineitem")
def slot_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 10).alias("row"), (F.col("l_suppkey") % 4).alias("col"), (F.col("l_linenumber") % 3).alias("kind_rank"), F.col("l_linenumber").alias("ordinal"))
    return records.ordinals(slots, "l_orderkey").select("l_orderkey", "l_linenumber", "object_index")


FORMATS = ["$#,##0.00", "0.0%", "#,##0,;(#,##0)", "0.###", "General", "0.00E+00", '€#,##0.00;[Red]-#', "0"]
AMOUNT = "CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END * l_extendedprice"


@query(
    f"""
WITH v AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 8 AS f, CAST(round({AMOUNT}, 2) AS DECIMAL(18, 4)) AS v FROM lineitem),
r AS (SELECT *, rtrim(rtrim(CAST(v AS VARCHAR), '0'), '.') AS raw, CASE WHEN v < 0 THEN '-' ELSE '' END AS sign, abs(v) AS a FROM v)
SELECT l_orderkey, l_linenumber, CASE f WHEN 0 THEN sign || '$' || format('{{:,}}', CAST(trunc(a) AS BIGINT)) || '.' || lpad(CAST(CAST(round((a - trunc(a)) * 100) AS INT) AS VARCHAR), 2, '0')
  WHEN 1 THEN sign || CAST(CAST(round(a * 100, 1) AS DECIMAL(18, 1)) AS VARCHAR) || '%' WHEN 2 THEN CASE WHEN v < 0 THEN '(' || format('{{:,}}', CAST(round(a, 0) AS BIGINT)) || ')' ELSE format('{{:,}}', CAST(round(a / 1000, 0) AS BIGINT)) END
  WHEN 3 THEN raw WHEN 7 THEN sign || CAST(CAST(round(a, 0) AS BIGINT) AS VARCHAR) ELSE raw END AS text, f IN (5, 6) AS unsupported FROM r
"""
)
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = F.array(*(F.lit(f) for f in FORMATS))[((F.col("l_orderkey") + F.col("l_linenumber")) % 8).cast("int")]
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.expr(AMOUNT), 2).cast("decimal(18,4)").alias("value"), fmt.alias("fmt"))
    return values.format_numbers(cells, F.broadcast(values.specs(spark, FORMATS))).select("l_orderkey", "l_linenumber", "text", "unsupported")


@query(
    """
SELECT o_orderkey, strftime(DATE '1899-12-30' + (o_orderkey % 60000 + 61)::INT, '%Y-%m-%d') AS date1900, strftime(DATE '1904-01-01' + (o_orderkey % 60000)::INT, '%Y-%m-%d') AS date1904,
  CASE WHEN o_custkey % 24 % 12 = 0 THEN '12' ELSE CAST(o_custkey % 24 % 12 AS VARCHAR) END || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || CASE WHEN o_custkey % 24 < 12 THEN ' AM' ELSE ' PM' END AS clock FROM orders
"""
)
def date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, shown = (F.col("o_orderkey") % 60000).cast("double"), lambda x: F.date_format(x, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", shown(values.from_serial(k + 61.25)).alias("date1900"), shown(values.from_serial(k + 0.5, True)).alias("date1904"), values.clock(F.col("o_custkey") % 24, F.col("o_orderkey") % 60, F.lit(0), "h:mm AM/PM").alias("clock"))


@query(
    """
WITH g AS (SELECT event_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events)
SELECT event_id, (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS hours, (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS minutes, CAST(s AS VARCHAR) AS seconds FROM g WHERE s IS NOT NULL
"""
)
def elapsed_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    gaps = table(spark, sf_dir, "events").select("event_id", (at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("s")).where("s IS NOT NULL")
    return gaps.select("event_id", *(values.elapsed(F.col("s").cast("double"), f).alias(n) for n, f in (("hours", "[h]:mm:ss"), ("minutes", "[m]:ss"), ("seconds", "[s]"))))


#: Bytes that a cell, a grid cell and a character of text cost on the wire.
WEIGHTS = {"n_cells": 256, "grid": 128, "chars": 8}


@query("SELECT l_orderkey AS doc, CAST(count(*) * 256 + sum(l_quantity::BIGINT) * 128 + sum(l_partkey) * 8 AS BIGINT) AS cost, count(*) * 256 + sum(l_quantity::BIGINT) * 128 + sum(l_partkey) * 8 > 8000 AS over_budget FROM lineitem GROUP BY 1")
def budget_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("n_cells"), F.col("l_quantity").cast("long").alias("grid"), F.col("l_partkey").alias("chars"))
    return records.dot(counters, WEIGHTS, "doc").withColumn("over_budget", F.col("cost") > 8000)


@query(
    """
WITH o AS (SELECT l.doc_id, lang AS category, m.metric, m.v AS num FROM (SELECT doc_id, unnest([{'metric': 'quality', 'v': quality}, {'metric': 'toxic', 'v': toxic}]) AS m FROM labels) l JOIN documents d USING (doc_id)),
p(metric, lo, hi) AS (VALUES ('quality', 0.8, NULL), ('toxic', NULL, 0.2), ('unseen', 0.5, NULL)), c AS (SELECT DISTINCT lang AS category FROM documents),
s AS (SELECT p.metric, c.category, sum(num) AS num, count(num) AS den, CASE WHEN count(num) = 0 THEN 1 ELSE 0 END AS open FROM p CROSS JOIN c LEFT JOIN o ON o.metric = p.metric AND o.category = c.category GROUP BY ALL),
b AS (SELECT metric, category, sum(num) AS num, sum(den) AS den, sum(open) AS open FROM s GROUP BY GROUPING SETS ((metric), (metric, category))),
r AS (SELECT b.metric, b.category, round(CASE WHEN den > 0 THEN num / den END, 9) AS ratio, open::BIGINT AS unresolved, coalesce(CASE WHEN lo IS NOT NULL THEN num / den >= lo ELSE num / den <= hi END, false) AS alone FROM b JOIN p USING (metric))
SELECT metric, category, ratio, unresolved, CASE WHEN category IS NULL THEN bool_and(alone) OVER (PARTITION BY metric) ELSE alone END AS passed FROM r
"""
)
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"))
    marks = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("metric"), F.col("quality").alias("v")), F.struct(F.lit("toxic").alias("metric"), F.col("toxic").alias("v")))).alias("m"))
    observed = marks.join(docs, "doc_id").select(F.col("doc_id").alias("item_id"), "category", "m.metric", F.col("m.v").alias("numerator"), F.lit(1).alias("denominator"), F.lit(False).alias("unresolved"))
    policy = spark.createDataFrame([("quality", 0.8, None), ("toxic", None, 0.2), ("unseen", 0.5, None)], "metric string, minimum double, maximum double")
    return evaluate.metrics(observed, policy, docs.select("category").distinct()).withColumn("ratio", F.round("ratio", 9))


@query("SELECT sha256(text) AS digest, count(DISTINCT source) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def manifest_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.crossing(digests(spark, sf_dir), "digest", "source")


@query(
    f"""
WITH {TURN}, d AS (SELECT conv_id AS doc_id, string_agg(value, chr(10) || chr(10) ORDER BY turn) || chr(10) || '| a | b |' || chr(10) || '| --- | :---: |' || chr(10) AS md, list(regexp_extract(value, '\\p{{L}}{{4,}}') ORDER BY turn) AS w FROM turns GROUP BY 1)
SELECT doc_id, 1 AS tables, len(list_filter(w, lambda a: strpos(md, a) = 0)) = 0 AND list_transform(w, lambda a: strpos(md, a)) = list_sort(list_transform(w, lambda a: strpos(md, a))) AS in_order FROM d
"""
)
def checklist_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = render.rendered(conversation_blocks(spark, sf_dir))
    parts = F.array_sort(F.collect_list(F.struct("block_index", "value")))
    docs = turns.groupBy("doc_id").agg(parts.alias("p"))
    docs = docs.select("doc_id", F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "\n\n"), F.lit("\n| a | b |\n| --- | :---: |\n")).alias("md"), F.transform("p", lambda x: F.regexp_extract(x["value"], r"\p{L}{4,}", 0)).alias("w"))
    return docs.select("doc_id", evaluate.table_count(F.col("md")).alias("tables"), evaluate.anchors_in_order(F.col("md"), F.col("w")).alias("in_order"))


@query(
    f"""
WITH {TURN}, l AS (SELECT conv_id, turn, unnest(string_split(value, chr(10))) AS line, generate_subscripts(string_split(value, chr(10)), 1) AS i FROM turns),
k AS (SELECT conv_id, turn, i, regexp_replace(line, '^[SPACE]+|[SPACE]+$', '', 'g') AS line FROM l)
SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1)::INT AS position, sha256(line) AS digest FROM k WHERE line <> ''
"""
)
def line_anchor_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.anchor_hashes(render.render(conversation_blocks(spark, sf_dir)))


@query("SELECT width, height, i AS tile, error_code, CASE WHEN error_code IS NULL THEN i * step END AS top, CASE WHEN error_code IS NULL THEN least(i * step + size, height) END AS bottom FROM (SELECT *, unnest(generate_series(0, CASE WHEN n > 32 THEN 0 ELSE n - 1 END)) AS i, CASE WHEN n > 32 THEN 'limit_exceeded' END AS error_code FROM (SELECT *, CASE WHEN size >= height THEN 1 ELSE CAST(ceil((height - size) / step) AS BIGINT) + 1 END AS n FROM (SELECT *, size - greatest(1, CAST(round_even(size * 0.1, 0) AS BIGINT)) AS step FROM (SELECT width, height, CASE WHEN height / width >= 3 AND width * least(1.0, 2048 / greatest(width, height)) < 768 THEN least(height, greatest(2048, width * 2)) ELSE height END AS size FROM (SELECT p_partkey % 900 + 100 AS width, p_partkey * 41 % 70000 + 10 AS height FROM part)))))")
def tile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").select((F.col("p_partkey") % 900 + 100).alias("width"), (F.col("p_partkey") * 41 % 70000 + 10).alias("height"))
    return geometry.tiles(images).select("width", "height", "tile", "error_code", "top", "bottom")


LOG = "'user ' || user_id || ' TOKEN=abc' || event_id || ' opened /srv/data/' || event_type || '.txt at a/b, prompt=x' || chr(10)"


@query(
    rf"SELECT event_id, regexp_replace(regexp_replace({LOG}, '(?i)\b(api_key|token|provider_payload|prompt)=\S+', '\1=[REDACTED]', 'g'), '(^|[^\p{{L}}\p{{N}}_.])/[^\s]+', '\1[REDACTED]', 'g') AS message FROM events"
)
def redact_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" TOKEN=abc"), F.col("event_id").cast("string"), F.lit(" opened /srv/data/"), F.col("event_type"), F.lit(".txt at a/b, prompt=x\n"))
    return table(spark, sf_dir, "events").select("event_id", records.redact(shown).alias("message"))


@query(
    """
WITH i AS (SELECT user_id % 20 AS worker, epoch_us(ts) AS start, epoch_us(ts) + 3600000000 AS stop FROM events),
e AS (SELECT worker, t, d, sum(d) AS s FROM (SELECT worker, start AS t, 1 AS d FROM i UNION ALL SELECT worker, stop, -1 FROM i) GROUP BY ALL)
SELECT worker, CAST(max(o) AS BIGINT) AS peak FROM (SELECT worker, sum(s) OVER (PARTITION BY worker ORDER BY t, d) AS o FROM e) GROUP BY 1
"""
)
def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("worker"), at.alias("start"), (at + 3600000000).alias("stop"))
    return records.peak(spans, "worker")


@query("SELECT conv_id AS doc_id, true AS stable FROM conversations GROUP BY 1")
def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = render.render(conversation_blocks(spark, sf_dir)).select("doc_id", "markdown")
    again = render.render(conversation_blocks(spark, sf_dir).repartition(7, "kind")).select("doc_id", "markdown")
    return evaluate.same_outcome(once.unionByName(again))


@query(
    """
SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
FROM (SELECT event_id, user_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events)
"""
)
def list_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events")
    return quality.islands(rows, ["user_id"], "event_id", F.col("event_type") == F.lag("event_type").over(by)).select("event_id", "island")
