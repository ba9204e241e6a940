"""Benchmark decontamination by template canonicalisation (operator 3), in DataFrame functions only.

1. Texts and benchmark items become tokens: numbers, words, unit signs. In the template of a text a number is written 0, a
   capitalised word 1, a unit 2; every other token is its lower case.
2. Templates are cut into windows of `WIDTH` tokens (an item shorter than that is one window), which are hashed and joined.
   Windows of items of which over half the tokens are placeholders say too little and are left out. Windows of plain lower-case
   tokens are made of every item as well: they find copies whose case was changed, of which the templates differ.
3. Matches on one alignment of a document with an item are put together, and their slots checked: each value of the item must
   stand for one value in the document throughout (two values of the item may become the same one). Alignments that fail are
   no leak, by plain windows neither.
4. A document leaks an item if alignments that pass hold at least `COVERAGE` of the item's template windows or of its plain ones.

Texts are scanned once for windows of all lengths. What was found is counted: if it is little, it is broadcast to the texts for
the check of slots, else both sides are shuffled.

Input: documents (doc_id, text), benchmark (item_id, text). Result: a row for each document and item leaked: doc_id, item_id,
n_windows (of the item), n_matched (distinct), coverage, exact (every slot has the item's own value), by templates if these
reach `COVERAGE`, else by plain windows, which are exact but for case. Null and empty texts leak nothing and are not leaked.
Null ids are kept; documents are told apart by 128 bits of id and text. Items with the same text are all reported; a repeated
row of an item counts once, and so does a repeated row of a document. Empty tables give an empty table. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import few, slots, written

WIDTH, COVERAGE = 8, 0.5
#: What a token is, and the words taken for units.
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+|[$€£%°]"
UNITS = "mm cm km kg mg ml mph kmh miles mile metres meters feet inches pounds ounces grams litres liters hours minutes seconds days weeks months years dollars euros cents percent degrees $ € £ % °".split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def template(token: Column) -> Column:
    """What stands for a token in a template: 0 a number, 2 a unit, 1 a capitalised word, else its lower case."""
    return F.when(F.substring(token, 1, 1).between("0", "9"), F.lit("0")).when(F.lower(token).isin(UNITS), F.lit("2")).when(token.rlike(r"^[\p{Lu}\p{Lt}]"), F.lit("1")).otherwise(F.lower(token))


def is_slot(token: Column) -> Column:
    return template(token).isin("0", "1", "2")


def templates(text: Column) -> Column:
    """`template` of every token, made on the whole text by three replacements before it is divided: much cheaper than by token."""
    inside = r"[\p{L}\p{M}]"
    out = F.regexp_replace(text, r"[0-9]+(?:[.,][0-9]+)*", "0")
    signs, names = [u for u in UNITS if not u.isalpha()], [u for u in UNITS if u.isalpha()]
    out = F.regexp_replace(out, f"(?<!{inside})(?iu:{'|'.join(names)})(?!{inside})|[{''.join(signs)}]", "2")
    out = F.regexp_replace(out, rf"(?<!{inside})[\p{{Lu}}\p{{Lt}}]{inside}*", "1")
    return F.regexp_extract_all(F.lower(out), F.lit(inside + "+|[0-2]"), F.lit(0))


def with_hashes(rows: DataFrame, tokens_: Column, widths: list[int], name: str) -> DataFrame:
    """`rows` with a column `name`_w for each width w: hashes of the w tokens from each position on. Hashes of longer windows are
    made of those of shorter ones, and each length is a column of its own, so that none is computed twice. Explode them by an
    outer function: an inner one brings a filter on their size, which is pushed down and computes every length anew."""
    rows, k = rows.withColumn(f"{name}_step", F.transform(tokens_, lambda t: F.xxhash64(t))), 1
    done = dict.fromkeys(widths, 0)
    while True:
        for w in widths:
            if w & k:
                rows = rows.withColumn(f"{name}_{w}", joined(f"{name}_{w}", f"{name}_step", done[w]) if done[w] else F.col(f"{name}_step"))
                done[w] += k
        if all(done[w] == w for w in widths):
            return rows.drop(f"{name}_step")
        rows, k = rows.withColumn(f"{name}_step", joined(f"{name}_step", f"{name}_step", k)), 2 * k


def joined(left: str, right: str, by: int) -> Column:
    n = F.greatest(F.size(right) - by, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, by + 1, n), lambda a, b: F.xxhash64(a, b))


def item_windows(items: DataFrame, width: int, plain: bool) -> DataFrame:
    """item, at, hash, telling: the windows of some items with their tokens."""
    slots_ = F.transform("tokens", lambda t: is_slot(t).cast("int"))
    rows = with_hashes(items.select("item", slots_.alias("slots"), F.transform("tokens", lambda t: F.lower(t) if plain else template(t)).alias("written")), F.col("written"), [width], "h")
    rows = rows.select("item", "slots", F.posexplode_outer(f"h_{width}").alias("at", "hash"))
    few_ = F.aggregate(F.slice("slots", F.col("at") + 1, width), F.lit(0), lambda s, x: s + x)
    return rows.where("hash IS NOT NULL").select("item", "at", "hash", (F.lit(plain) | (2 * few_ <= width)).alias("telling"))


def numbered(benchmark: DataFrame, width: int) -> DataFrame:
    """item (a number of its own), item_id, tokens, width (of its windows), templates (whether any template window tells enough);
    written, for it is small and looked at many times."""
    rows = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    rows = written(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0))
    slots_ = F.aggregate(F.transform("tokens", lambda t: is_slot(t).cast("int")), F.lit(0), lambda s, x: s + x)
    brief = rows.where(F.size("tokens") < width).select("item", (2 * slots_ <= F.size("tokens")).alias("templates"))
    long = item_windows(rows.where(F.size("tokens") >= width), width, False).groupBy("item").agg(F.bool_or("telling").alias("templates"))
    return written(rows.join(brief.unionByName(long), "item").select("item", "item_id", "tokens", F.least(F.size("tokens"), F.lit(width)).alias("width"), "templates"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """slot, mark, item, n_windows, diagonal, ats, width, plain: the windows found, by document, item and alignment."""
    kinds = items.select("width", F.explode(F.array(F.lit(True), ~F.col("templates"))).alias("plain")).distinct()
    kinds = sorted((r.plain, r.width) for r in kinds.collect())  # at most 2 x WIDTH
    windows = None
    for number, (plain, width) in enumerate(kinds):
        some = items.where((F.col("width") == width) & (F.col("templates") | F.lit(plain)))
        part = item_windows(some, width, plain).where("telling").select("item", "at", "hash", F.lit(number).alias("kind"), F.lit(width).alias("width"), F.lit(plain).alias("plain"))
        windows = part if windows is None else windows.unionByName(part)
    windows = few(written(windows.join(windows.groupBy("item", "kind").agg(F.count("*").alias("n_windows")), ["item", "kind"])))
    rows = docs.select("slot", "mark", "text")
    for plain in sorted({p for p, _ in kinds}):
        rows = rows.withColumn("written", tokens(F.lower("text")) if plain else templates(F.col("text")))
        rows = with_hashes(rows, F.col("written"), [w for p, w in kinds if p == plain], "plain" if plain else "template")
    hashes = [f"{'plain' if p else 'template'}_{w}" for p, w in kinds]
    sizes = [F.greatest(F.size(h), F.lit(0)).alias(f"n_{i}") for i, h in enumerate(hashes)]
    found = rows.select("slot", "mark", *sizes, F.posexplode_outer(F.concat(*hashes)).alias("pos", "hash"))
    kind, before = F.lit(0), F.lit(0)  # of which kind a window is follows from its place
    start = F.lit(0)
    for i in range(len(kinds) - 1):
        before = before + F.col(f"n_{i}")
        kind, start = F.when(F.col("pos") >= before, i + 1).otherwise(kind), F.when(F.col("pos") >= before, before).otherwise(start)
    hits = found.select("slot", "mark", "hash", kind.alias("kind"), (F.col("pos") - start).alias("pos")).join(windows, ["hash", "kind"])
    return hits.groupBy("slot", "mark", "item", "n_windows", "width", "plain", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))


def aligned(found: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `found` on alignments whose slots are consistent, with doc_id, item_id and `exact`."""
    by_doc = docs.join(few(found), ["slot", "mark"]).select("doc_id", *found.columns, tokens(F.col("text")).alias("doc_tokens"))
    both = by_doc.join(few(items.select("item", "item_id", "tokens")), "item")
    held = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("width") - 1))))
    pairs = F.transform(held, lambda p: F.struct(F.get("tokens", p).alias("a"), F.get("doc_tokens", p + F.col("diagonal")).alias("b")))
    pairs = F.array_distinct(F.filter(pairs, lambda x: ~F.col("plain") & is_slot(x["a"])))
    both = both.withColumn("pairs", pairs)
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"])))
    row = F.struct("plain", "n_windows", "ats", F.forall("pairs", lambda x: x["a"] == x["b"]).alias("exact"))
    whole = both.groupBy("slot", "mark", "doc_id", "item", "item_id", "diagonal").agg(F.bool_and(consistent).alias("consistent"), F.collect_set(row).alias("rows"))
    return whole.where("consistent").select("slot", "mark", "doc_id", "item", "item_id", F.explode("rows").alias("row")).select("slot", "mark", "doc_id", "item", "item_id", "row.*")


def leaks(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and benchmark item that it leaks."""
    docs, items = slots(documents), numbered(benchmark, width)
    if items.isEmpty():
        kind = benchmark.schema["item_id"].dataType.simpleString()
        return documents.sparkSession.createDataFrame([], f"doc_id long, item_id {kind}, n_windows long, n_matched int, coverage double, exact boolean, slot long, mark long")
    rows = aligned(written(matches(docs, items)), docs, items)
    kinds = rows.groupBy("slot", "mark", "doc_id", "item", "item_id", "plain", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n_matched"), F.bool_and("exact").alias("exact"))
    share = F.col("n_matched") / F.col("n_windows")
    reached = kinds.where(share >= coverage).withColumn("coverage", F.round(share, 6))
    best = reached.groupBy("slot", "mark", "doc_id", "item", "item_id").agg(F.min_by(F.struct("n_windows", "n_matched", "coverage", "exact"), "plain").alias("best"))
    return best.select("doc_id", "item_id", "best.*", "slot", "mark")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `documents` that leak no item, with all their columns."""
    whole = slots(documents, F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("whole")).select("slot", "mark", "whole")
    found = written(leaks(documents, benchmark).select("slot", "mark").distinct())
    return whole.join(few(found), ["slot", "mark"], "left_anti").select("whole.*")


#: Items of `WIDTH` tokens and more; shorter ones are tested beside.
SQL = r"""
WITH item_tok AS (
  SELECT DISTINCT item_id, text, regexp_extract_all(text, 'TOKEN') AS tok FROM benchmark WHERE text IS NOT NULL
), doc_tok AS (
  SELECT doc_id, regexp_extract_all(text, 'TOKEN') AS tok FROM documents WHERE text IS NOT NULL
), items AS (
  SELECT item_id, text, tok, TEMPLATE AS tpl FROM item_tok WHERE len(tok) >= 8
), docs AS (
  SELECT doc_id, tok, TEMPLATE AS tpl FROM doc_tok WHERE len(tok) >= 8
), item_at AS (
  SELECT item_id, text, tok, tpl, unnest(generate_series(1, len(tpl) - 7)) AS p FROM items
), item_win AS (
  SELECT item_id, text, p, false AS plain, array_to_string(list_slice(tpl, p, p + 7), ' ') AS w FROM item_at
  WHERE 2 * len(list_filter(list_slice(tpl, p, p + 7), lambda x: x IN ('0', '1', '2'))) <= 8
  UNION ALL SELECT item_id, text, p, true, lower(array_to_string(list_slice(tok, p, p + 7), ' ')) FROM item_at
), n_win AS (
  SELECT item_id, text, plain, count(*) AS n_windows FROM item_win GROUP BY ALL
), doc_at AS (
  SELECT doc_id, tok, tpl, unnest(generate_series(1, len(tpl) - 7)) AS p FROM docs
), doc_win AS (
  SELECT doc_id, p, false AS plain, array_to_string(list_slice(tpl, p, p + 7), ' ') AS w FROM doc_at
  UNION ALL SELECT doc_id, p, true, lower(array_to_string(list_slice(tok, p, p + 7), ' ')) FROM doc_at
), hit AS (
  SELECT d.doc_id, i.item_id, i.text, plain, i.p AS at, d.p - i.p AS diagonal FROM doc_win d JOIN item_win i USING (w, plain)
), pair AS (
  SELECT DISTINCT h.doc_id, h.item_id, h.text, h.diagonal, i.tok[h.at + k.k] AS a, d.tok[h.at + k.k + h.diagonal] AS b
  FROM hit h CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS k) k JOIN items i ON i.item_id = h.item_id AND i.text = h.text JOIN docs d ON d.doc_id = h.doc_id
  WHERE NOT h.plain AND i.tpl[h.at + k.k] IN ('0', '1', '2')
), good AS (
  SELECT h.doc_id, h.item_id, h.text, h.diagonal, coalesce(bool_and(p.a = p.b), true) AS exact
  FROM (SELECT DISTINCT doc_id, item_id, text, diagonal FROM hit) h LEFT JOIN pair p USING (doc_id, item_id, text, diagonal)
  GROUP BY ALL HAVING count(p.a) = count(DISTINCT p.a)
), kind AS (
  SELECT h.doc_id, h.item_id, h.text, plain, n.n_windows, count(DISTINCT h.at)::INT AS n_matched, round(count(DISTINCT h.at) / n.n_windows, 6) AS coverage, bool_and(plain OR g.exact) AS exact
  FROM hit h JOIN good g USING (doc_id, item_id, text, diagonal) JOIN n_win n USING (item_id, text, plain)
  GROUP BY h.doc_id, h.item_id, h.text, plain, n.n_windows HAVING count(DISTINCT h.at) / n.n_windows >= 0.5
)
SELECT doc_id, item_id, n_windows, n_matched, coverage, exact FROM kind QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, text ORDER BY plain) = 1
""".replace("TOKEN", TOKEN).replace("TEMPLATE", r"list_transform(tok, lambda t: CASE WHEN t[1] BETWEEN '0' AND '9' THEN '0' WHEN list_contains(string_split('UNITS', ' '), lower(t)) THEN '2' WHEN regexp_matches(t, '^[\p{Lu}\p{Lt}]') THEN '1' ELSE lower(t) END)").replace("UNITS", " ".join(UNITS))
