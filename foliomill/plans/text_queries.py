"""Queries over texts, sources and rendering, with the SQL that says what each must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import pytext as T
from foliomill.operators import detect, render, text

QUERIES, ORACLE_SQL = {}, {}
SPACE_SQL = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def query(sql: str = ""):
    """Registers a query under its function's name; `sql` may be empty where SQL cannot say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("SPACE", SPACE_SQL)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def esc_sql(x: str) -> str:
    """escape() in DuckDB's dialect."""
    out = rf"regexp_replace({x}, '([\\`*_\[\]<>])', '\\\1', 'g')"
    out = rf"regexp_replace({out}, '(?m)^([ \t]{{0,3}})([#>])', '\1\\\2', 'g')"
    out = rf"regexp_replace({out}, '(?m)^([ \t]{{0,3}})([-+])([SPACE])', '\1\\\2\3', 'g')"
    return rf"regexp_replace({out}, '(?m)^([ \t]{{0,3}})(\p{{Nd}}+)([.)])([SPACE])', '\1\2\\\3\4', 'g')"


LF = "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
PARAS = r"list_filter(regexp_split_to_array(" + LF + r", '\n(?:[ \t]*\n)+'), lambda p: regexp_matches(p, '[^SPACE]'))"


@query(
    f"""
WITH b AS (SELECT doc_id, list_transform({PARAS.format("coalesce(text, '')")}, lambda p: {esc_sql("rtrim(p, chr(10))")}) AS r FROM documents)
SELECT doc_id, CASE WHEN len(r) > 0 THEN array_to_string(r, chr(10) || chr(10)) || chr(10) END AS markdown, len(r)::INT AS n_blocks, 0 AS n_warnings,
  CASE WHEN len(r) = 0 THEN 'no_usable_content' END AS error_code FROM b
"""
)
def text_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.to_markdown(table(spark, sf_dir, "documents"))


@query(
    f"""
SELECT doc_id, (generate_subscripts(ps, 1))::INT AS block_index, 'text' AS kind, unnest(ps) AS text FROM (SELECT doc_id, {PARAS.format("replace(text, chr(10), chr(10) || chr(10))")} AS ps FROM documents)
"""
)
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return text.blocks(docs)


@query(f"SELECT doc_id, {esc_sql('text')} AS escaped FROM documents")
def escape_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.escape(F.col("text")).alias("escaped"))


@query(f"SELECT page_id, {LF.format('html')} AS text, true AS valid, length({LF.format('html')}) AS n_chars, strlen(html) AS n_bytes FROM pages")
def utf8_newline_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("html").cast("binary")
    pages = table(spark, sf_dir, "pages").withColumn("t", T.newlines("html"))
    return pages.select("page_id", F.col("t").alias("text"), F.is_valid_utf8(raw.cast("string")).alias("valid"), F.length("t").cast("long").alias("n_chars"), F.octet_length("html").cast("long").alias("n_bytes"))


@query("SELECT page_id, CASE WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https', 's3', 'oss') THEN 'invalid_source' WHEN strlen(html) > 100000000 THEN 'limit_exceeded' END AS error_code FROM pages")
def source_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", detect.source_error(F.col("url"), F.octet_length("html")).alias("error_code"))


NAMES = ["a.txt", "b.MD", "c.markdown", "d.pdf", "e.png", "f.docx", "g.xlsx", "h.html", "noext", ".hidden", "x.tar.txt"]
#: What each of NAMES gives for plain text, by position.
FOUND = [("text", None), ("markdown", None), ("markdown", None), (None, "document_type_mismatch"), (None, "document_type_mismatch"), (None, "document_type_mismatch"), (None, "document_type_mismatch"), (None, "unsupported_document"), ("text", None), ("text", None), ("text", None)]


def _cases(k: int) -> str:
    return " ".join(f"WHEN {i} THEN '{f[k]}'" for i, f in enumerate(FOUND) if f[k])


@query(f"SELECT doc_id, CASE doc_id % 11 {_cases(0)} END AS document_type, CASE doc_id % 11 {_cases(1)} END AS error_code FROM documents")
def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.array(*(F.lit(n) for n in NAMES))[(F.col("doc_id") % 11).cast("int")]
    docs = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.col("text").cast("binary").alias("content"))
    return detect.detect(docs).select("doc_id", "document_type", "error_code")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'unsupported_document' END AS error_code, CASE WHEN page_id % 2 = 1 THEN 'text' END AS document_type FROM pages")
def html_as_text_or_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "page.html").alias("name"), F.col("html").cast("binary").alias("content"))
    return detect.detect(pages).select("page_id", "error_code", "document_type")


STRIP = "regexp_replace({0}, '^[SPACE]+|[SPACE]+$', '', 'g')"
TURN = f"""
turns AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN regexp_replace('## ' || rtrim({esc_sql("text")}, chr(10)), '[SPACE]+$', '')
  WHEN 'user' THEN '- ' || replace(rtrim({esc_sql("text")}, chr(10)), chr(10), chr(10) || '  ') ELSE rtrim({esc_sql("text")}, chr(10)) END AS value, role = 'user' AS is_item FROM conversations)
"""


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn is a block: of the system a heading, of the user an item of a list, else a paragraph."""
    kind = F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "list_item").otherwise("paragraph")
    inlines = F.array(F.struct("text", F.lit(None).cast("string").alias("target")))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("block_index"), kind.alias("kind"), inlines.alias("inlines"), F.when(kind == "heading", 2).otherwise(0).alias("level"))


@query(f"WITH {TURN} SELECT conv_id AS doc_id, turn + 1 AS block_index, value FROM turns")
def render_headings_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.rendered(conversation_blocks(spark, sf_dir)).select("doc_id", F.col("block_index").cast("long").alias("block_index"), "value")


def _assembled(budget: int) -> str:
    return f"""
WITH {TURN}, gaps AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN is_item AND lag(is_item) OVER w THEN chr(10) ELSE chr(10) || chr(10) END AS gap FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), fit AS (
  SELECT *, sum(length(value) + length(gap)) OVER (PARTITION BY conv_id ORDER BY turn) + 1 <= {budget} AS fits FROM gaps
), doc AS (
  SELECT conv_id, string_agg(gap || value, '' ORDER BY turn) FILTER (WHERE fits) || chr(10) AS markdown, count(*) FILTER (WHERE fits) AS n, min(turn + 1) FILTER (WHERE NOT fits) AS stop FROM fit GROUP BY conv_id
)
SELECT conv_id AS doc_id, markdown, n::INT AS n_blocks, CASE WHEN stop IS NOT NULL AND n > 0 THEN 'output stopped before block ' || stop END AS warning, CASE WHEN n = 0 THEN 'limit_exceeded' END AS error_code FROM doc
"""


def _truncated(spark: SparkSession, sf_dir: str, budget: int) -> DataFrame:
    out = render.render(conversation_blocks(spark, sf_dir), budget)
    return out.select("doc_id", "markdown", "n_blocks", F.get("warnings", F.lit(0))["message"].alias("warning"), "error_code")


@query(_assembled(1000))
def truncate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir, 1000)


@query(_assembled(120))
def truncation_limit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir, 120)


@query(_assembled(400_000))
def conversations_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir, 400_000)


CELL = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(92), chr(92) || chr(92)), '|', chr(92) || '|')"


def nation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of all nations for each region: a header and a row for each nation in order."""
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("body"))
    return rows.select(F.col("n_regionkey").alias("doc_id"), F.lit(1).alias("block_index"), F.lit("table").alias("kind"), F.concat(F.array(F.array(F.lit("key"), F.lit("name | <b>"))), "body").alias("grid"), "body")


@query(
    f"""
SELECT n_regionkey AS doc_id, '| key | name ' || chr(92) || '| &lt;b&gt; |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || {CELL.format("n_name")} || ' |', chr(10) ORDER BY n_nationkey) AS value FROM nation GROUP BY 1
"""
)
def render_pipe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.rendered(nation_grid(spark, sf_dir).withColumn("header_rows", F.lit(1))).select(F.col("doc_id").cast("int").alias("doc_id"), "value")


HTML_ROWS = "string_agg('<tr><td>' || n_nationkey || '</td><td>' || replace(replace(n_name, '&', '&amp;'), '<', '&lt;') || '</td></tr>', chr(10) ORDER BY n_nationkey)"


@query(f"SELECT n_regionkey AS doc_id, '<table>' || chr(10) || '<tbody>' || chr(10) || {HTML_ROWS} || chr(10) || '</tbody>' || chr(10) || '</table>' AS value FROM nation GROUP BY 1")
def render_html_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nation_grid(spark, sf_dir).drop("grid").withColumnRenamed("body", "grid").withColumn("header_rows", F.lit(0))
    return render.rendered(rows).select(F.col("doc_id").cast("int").alias("doc_id"), "value")


@query(
    """
WITH c AS (SELECT r_name, n_nationkey, n_name, r_regionkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY r_regionkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_regionkey AS doc_id, '<table>' || chr(10) || '<tbody>' || chr(10) || string_agg('<tr>' || CASE WHEN i = 1 THEN '<td' || CASE WHEN n > 1 THEN ' rowspan="' || n || '"' ELSE '' END || '>' || r_name || '</td>' ELSE '' END || '<td>' || n_name || '</td></tr>', chr(10) ORDER BY i) || chr(10) || '</tbody>' || chr(10) || '</table>' AS value
FROM c GROUP BY r_regionkey
"""
)
def render_spanned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    held = both.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    n, one = F.size("ns"), F.lit(1)
    cell = lambda row, column, rows, columns, t: F.struct(row.alias("row"), F.lit(column).alias("column"), rows.alias("row_span"), columns.alias("column_span"), t.alias("text"))
    cells = F.concat(F.array(cell(F.lit(0), 0, n, one, F.col("r_name"))), F.transform("ns", lambda x, i: cell(i, 1, one, one, x["n_name"])))
    rows = held.select(F.col("r_regionkey").alias("doc_id"), F.lit(1).alias("block_index"), F.lit("spanned_table").alias("kind"), cells.alias("cells"), n.alias("row_count"), F.lit(0).alias("header_rows"))
    return render.rendered(rows).select(F.col("doc_id").cast("int").alias("doc_id"), "value")


LINKS = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'javascript:alert(1)' WHEN 2 THEN '#part(' || page_id || ')' WHEN 3 THEN 'MAILTO:a@b.c' ELSE 'ftp://x/' || page_id END"


@query(
    rf"""
WITH p AS (SELECT page_id, {LINKS} AS target FROM pages)
SELECT page_id, CASE WHEN starts_with(target, '#') OR lower(regexp_extract(target, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto') THEN '[a\*b](' || regexp_replace(target, '([\\()])', '\\\1', 'g') || ')' ELSE 'a\*b' END AS value,
  NOT (starts_with(target, '#') OR lower(regexp_extract(target, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto')) AS unsafe FROM p
"""
)
def link_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").withColumn("target", F.expr(LINKS))
    return links.select("page_id", T.link(F.lit("a*b"), F.col("target")).alias("value"), (~T.safe_target(F.col("target"))).alias("unsafe"))


PORTABLE = "CASE part.p_partkey % 7 WHEN 0 THEN 'con.txt' WHEN 1 THEN 'a' || p_partkey || '.md' WHEN 2 THEN 'x/y' WHEN 3 THEN 'end. ' WHEN 4 THEN 'COM1' WHEN 5 THEN 'q?.md' ELSE p_name END"


@query(
    rf"""
WITH n AS (SELECT p_partkey, {PORTABLE} AS name FROM part)
SELECT p_partkey, name, length(name) > 0 AND NOT regexp_matches(name, '[\x00-\x1f\x7f<>:"/\\|?*]|[ .]$') AND NOT regexp_matches(upper(rtrim(string_split(name, '.')[1])), '^(?:CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|(?:COM|LPT)[1-9¹²³])$') AS portable FROM n
"""
)
def portable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.expr(PORTABLE.replace("part.", "")).alias("name"))
    return names.select("p_partkey", "name", detect.portable(F.col("name")).alias("portable"))


@query(
    """
WITH c AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' ```x```` y' WHEN 1 THEN '`' ELSE '' END AS t FROM documents),
r AS (SELECT doc_id, t, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0) AS n FROM c)
SELECT doc_id, repeat('`', greatest(3, n + 1)::INT) || chr(10) || t || chr(10) || repeat('`', greatest(3, n + 1)::INT) AS code FROM r
"""
)
def fenced_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, " ```x```` y").when(F.col("doc_id") % 3 == 1, "`").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", T.fenced(F.concat("text", tail)).alias("code"))
