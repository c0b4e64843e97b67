"""Line dedup by a log-template tree of fixed depth; DataFrame functions only.

A line's path is its token count and its first DEPTH tokens, with tokens that hold a digit as variables. Within a leaf, a
token that too few different texts have at its position is a variable field too; what is left is the line's template. A
template recurs if LEAST_DOCS different texts hold it, however many lines of one text do.

Copies of a text share all their lines, so those recur as well; whether copies go is for document dedup to decide. The
evidence is the carriers: texts most of whose characters are in lines that don't recur. A recurring template is boilerplate
if LEAST_DOCS carriers hold it, and is then dropped from every document, whatever share of it is left. The body of a copied
text has no carriers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import small, staged

DEPTH = 3
#: Different texts in which a template must occur.
LEAST_DOCS = 10
#: Percent of a template's tokens that must be constant.
CONSTANT = 60
#: A text is a carrier if its recurring lines hold at most this percent of its characters, line breaks included.
SHARE = 50
FIELD = "<*>"
_SPACE = r"[\x20\x09-\x0D]+"


def _mask(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), size (its characters and 1), line (from 0), chars (its own and 1), tokens, leaf, for
    lines with a token."""
    text = F.col("text").cast("string")
    each = docs.select("doc_id", F.xxhash64(text).alias("h"), (F.length(text) + 1).alias("size"), F.posexplode(F.split(text, "\n", -1)).alias("line", "x"))
    each = each.withColumn("chars", F.length("x") + 1).withColumn("x", F.btrim("x", F.lit(" \t\n\x0b\x0c\r"))).where("x <> ''").withColumn("tokens", F.split("x", _SPACE)).drop("x")
    return each.withColumn("leaf", F.xxhash64(F.size("tokens"), *(_mask(F.get("tokens", F.lit(k))) for k in range(DEPTH))))


def _common(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """leaf, at, token that LEAST_DOCS texts have. texts: leaf, variant, h, each once; tokens: leaf, variant, tokens.

    Texts with one variant in a leaf are counted by variant first; only those with several are told apart by token.
    """
    of = texts.groupBy("leaf", "h").agg(F.collect_set("variant").alias("vs"))
    spread = lambda df, *keys: df.join(tokens, ["leaf", "variant"]).select("leaf", *keys, F.posexplode("tokens").alias("at", "token")).where(F.col("token") != FIELD)
    one = of.where(F.size("vs") == 1).groupBy("leaf", F.get("vs", F.lit(0)).alias("variant")).agg(F.count("*").alias("n"))
    several = spread(of.where(F.size("vs") > 1).select("leaf", "h", F.explode("vs").alias("variant")), "h").distinct()
    n = spread(one, "n").unionByName(several.groupBy("leaf", "at", "token").agg(F.count("*").alias("n")))
    return n.groupBy("leaf", "at", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS).select("leaf", "at", "token")


def recurring(docs: DataFrame) -> DataFrame:
    """doc_id, h, line of each line whose template is boilerplate."""
    all_lines = lines(docs)
    leaves = staged(all_lines.select("leaf", "h").distinct().groupBy("leaf").count().where(F.col("count") >= LEAST_DOCS).select("leaf"), "leaves")
    own = all_lines.join(small(leaves), "leaf", "left_semi").withColumn("tokens", F.transform("tokens", _mask))
    own = staged(own.withColumn("variant", F.xxhash64("tokens")), "lines")
    texts = staged(own.select("leaf", "variant", "h").distinct(), "texts")
    tokens = staged(own.groupBy("leaf", "variant").agg(F.first("tokens").alias("tokens")), "variants")
    each = tokens.select("leaf", "variant", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "token")).where(F.col("token") != FIELD)
    constant = each.join(_common(texts, tokens), ["leaf", "at", "token"])
    kept = F.sort_array(F.collect_list(F.struct("at", "token")))
    templates = constant.groupBy("leaf", "variant", "size").agg(F.xxhash64(kept).alias("template"), F.count("*").alias("n")).where(F.col("n") * 100 >= F.col("size") * CONSTANT)
    templates = staged(templates.select("leaf", "variant", "template"), "templates")
    held = staged(texts.join(small(templates), ["leaf", "variant"]).select("leaf", "template", "h").distinct(), "held")
    often = lambda df: df.groupBy("leaf", "template").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS).select("leaf", "template")
    again = staged(templates.join(often(held), ["leaf", "template"]), "recurring")
    found = staged(own.select("doc_id", "h", "size", "line", "chars", "leaf", "variant").join(small(again), ["leaf", "variant"]), "found")
    share = found.select("h", "size", "line", "chars").distinct().groupBy("h").agg(F.sum("chars").alias("n"), F.max("size").alias("size"))
    full = staged(share.where(F.col("n") * 100 > F.col("size") * SHARE).select("h"), "full")
    boilerplate = staged(often(held.join(small(full), "h", "left_anti")), "boilerplate")
    return found.join(small(boilerplate), ["leaf", "template"], "left_semi").select("doc_id", "h", "line")


def deduplicated(docs: DataFrame) -> DataFrame:
    """r (the row of docs as a struct) and d: text (without the dropped lines), n_lines, dropped (line numbers).

    A null text has no lines and stays null; an empty one stays empty; a text of boilerplate only becomes empty. A very long
    text is taken whole, as one row among its lines. Repeated rows, and rows with one doc_id and text, are treated alike; a
    document counts by its text, so exact copies make nothing recur.
    """
    gone = recurring(docs).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"))
    text = F.col("r.text").cast("string")
    j = row.join(gone, F.col("r.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("h")), "left")
    parts = F.split(text, "\n", -1)
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    result = F.struct(left.alias("text"), F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("dropped"))
    return j.select("r", result.alias("d"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, n_lines, n_dropped, dropped (line numbers joined by a comma), text.

    Null, empty and very long texts, repeated rows and clashing names: as of deduplicated; an empty table gives an empty
    result.
    """
    d = deduplicated(docs.select("doc_id", "text"))
    return d.select("r.doc_id", F.col("d.n_lines").cast("long").alias("n_lines"), F.size("d.dropped").cast("long").alias("n_dropped"), F.array_join("d.dropped", ",").alias("dropped"), "d.text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without their recurring lines; n_chars follows the text."""
    d = deduplicated(docs)
    new = {"text": F.col("d.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(F.col("d.text")).cast(docs.schema["n_chars"].dataType)
    return d.select(*((new[c] if c in new else F.col("r")[c]).alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), each AS (
  SELECT doc_id, text, unnest(range(len(l))) AS line, unnest(l) AS x FROM raw
), tok AS (
  SELECT doc_id, text, line, length(x) + 1 AS chars, list_transform(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS t FROM each
), path AS (
  SELECT doc_id, text, line, chars, t, array_to_string([len(t)::VARCHAR] || t[1:3], ' ') AS leaf FROM tok WHERE len(t) > 0
), leaves AS (
  SELECT leaf FROM path GROUP BY leaf HAVING count(DISTINCT text) >= 10
), own AS (
  SELECT doc_id, text, line, chars, leaf, array_to_string(t, ' ') AS v, t FROM path SEMI JOIN leaves USING (leaf)
), texts AS (
  SELECT leaf, v, text, any_value(t) AS t FROM own GROUP BY leaf, v, text
), common AS (
  SELECT leaf, pos, token FROM (SELECT leaf, text, unnest(range(len(t))) AS pos, unnest(t) AS token FROM texts) WHERE token <> '<*>' GROUP BY leaf, pos, token HAVING count(DISTINCT text) >= 10
), marked AS (
  SELECT t.*, c.token IS NOT NULL AS constant FROM (SELECT leaf, v, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT leaf, v, any_value(t) AS t FROM texts GROUP BY ALL)) t LEFT JOIN common c USING (leaf, pos, token)
), templates AS (
  SELECT leaf, v, string_agg(CASE WHEN constant THEN token ELSE '<*>' END, ' ' ORDER BY pos) AS template FROM marked GROUP BY leaf, v
  HAVING count(*) FILTER (constant) * 100 >= count(*) * 60
), often AS (
  SELECT leaf, template FROM texts JOIN templates USING (leaf, v) GROUP BY leaf, template HAVING count(DISTINCT text) >= 10
), found AS (
  SELECT doc_id, text, line, chars, leaf, template FROM own JOIN templates USING (leaf, v) SEMI JOIN often USING (leaf, template)
), carriers AS (
  SELECT text FROM (SELECT DISTINCT text, line, chars FROM found) GROUP BY text HAVING sum(chars) * 100 <= (length(text) + 1) * 50
), boilerplate AS (
  SELECT leaf, template FROM found SEMI JOIN carriers USING (text) GROUP BY leaf, template HAVING count(DISTINCT text) >= 10
), gone AS (
  SELECT doc_id, list(line ORDER BY line) AS g FROM (SELECT DISTINCT doc_id, line FROM found SEMI JOIN boilerplate USING (leaf, template)) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(r.l), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_dropped, coalesce(array_to_string(g, ','), '') AS dropped,
  CASE WHEN g IS NULL THEN d.text ELSE array_to_string(list_filter(r.l, lambda x, i: NOT list_contains(g, i - 1)), chr(10)) END AS text
FROM documents d LEFT JOIN raw r USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
