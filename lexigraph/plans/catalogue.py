"""Named queries over the driver's tables, each with its SQL where SQL can express it.

The tables stand in for a social graph: documents are tweets (the source's number is the user), lineitem gives follows
(supplier followed by part) and, with orders, retweets; orders are posts, customers have names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import crawl, graph, ir, sampling, search
from ..sources import logs, stores
from ..storage import read_table, shared_dir
from . import pipelines, porter_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TERMS = ["thing", "from!", "Thth"]
PLAIN = search.parse_query(TERMS, stemmed=False)
ROUNDS = 3


def _table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = read_table(spark, f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def tweets(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").selectExpr("CAST(substr(source, 4) AS BIGINT) AS uid", "doc_id AS tid", "text")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").selectExpr("l_suppkey AS user_id", "l_partkey AS follower_id")


def retweets(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders").selectExpr("o_orderkey AS tid", "o_custkey AS author_id")
    return _table(spark, d, "lineitem").selectExpr("l_orderkey AS tid", "l_suppkey AS retweeter").join(orders, "tid")


def posts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").selectExpr("o_custkey AS uid", "o_orderkey AS tid")


def names(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").selectExpr("c_custkey AS user_id", "c_name AS screen_name")


_VIEWS = r"""
tweets AS (SELECT CAST(substr(source, 4) AS BIGINT) AS uid, doc_id AS tid, text FROM documents),
edges AS (SELECT l_suppkey AS user_id, l_partkey AS follower_id FROM lineitem),
retweets AS (SELECT l_orderkey AS tid, o_custkey AS author_id, l_suppkey AS retweeter FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
posts AS (SELECT o_custkey AS uid, o_orderkey AS tid FROM orders),
names AS (SELECT c_custkey AS user_id, c_name AS screen_name FROM customer),
rawtok AS (SELECT uid, tid, row_number() OVER () AS r, regexp_split_to_array(text, '[\s\x0b]+') AS w FROM tweets),
tok AS (SELECT uid, tid, r, lower(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')) AS stem FROM (SELECT uid, tid, r, unnest(w) AS x FROM rawtok)),
tokens AS (SELECT uid, tid, r, stem FROM tok WHERE stem <> '' AND stem NOT IN (STOPS)),
tf AS (SELECT stem, uid, tid, count(*) AS tf FROM tokens GROUP BY ALL),
df AS (SELECT stem, count(DISTINCT r) AS df FROM tokens GROUP BY stem),
idf AS (SELECT stem, ln((SELECT count(*) FROM tweets)::DOUBLE / df) AS idf FROM df),
tfidf AS (SELECT stem, tid, tf * idf AS tfidf FROM tf JOIN idf USING (stem)),
deg AS (SELECT user_id, sum(n)::BIGINT AS followers FROM (SELECT user_id, 1 AS n FROM edges UNION ALL SELECT follower_id, 0 FROM edges) GROUP BY user_id)
""".replace("STOPS", ", ".join(f"'{w}'" for w in tx.STOP_WORDS))


#: The same with stems, by a stemmer written in SQL. A query's words are stemmed by it too.
_STEMMED = f""", words AS (SELECT stem AS word FROM tok WHERE stem <> '' UNION SELECT unnest({[search.parse_query([t], stemmed=False)[0] for t in TERMS]!r})),
{porter_sql.stems("words")},
stokens AS (SELECT uid, tid, r, s.stem FROM tok JOIN stems s ON s.word = tok.stem WHERE s.stem <> '' AND s.stem NOT IN (STOPS)),
stf AS (SELECT stem, uid, tid, count(*) AS tf FROM stokens GROUP BY ALL),
sdf AS (SELECT stem, count(DISTINCT r) AS df FROM stokens GROUP BY stem),
stfidf AS (SELECT stem, tid, tf * ln((SELECT count(*) FROM tweets)::DOUBLE / df) AS tfidf FROM stf JOIN sdf USING (stem)),
asked AS (SELECT DISTINCT stem FROM stems WHERE word IN (SELECT unnest({[search.parse_query([t], stemmed=False)[0] for t in TERMS]!r}))),
shits AS (SELECT tid, sum(score) AS score FROM (SELECT stem, tid, max(tfidf) AS score FROM stfidf WHERE stem IN (FROM asked) GROUP BY stem, tid) GROUP BY tid HAVING count(*) = (SELECT count(*) FROM asked))
""".replace("STOPS", ", ".join(f"'{w}'" for w in tx.STOP_WORDS))


def _path(spark: SparkSession, name: str) -> str:
    """A new path among the staged tables, which go with them."""
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {_VIEWS}{sql}" if sql.startswith(",") else f"WITH {_VIEWS} {sql}"
        return f

    return add


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    """tid, turank: a stand-in for ranks, over all tweets."""
    return tweets(spark, d).select("tid", (F.col("tid") % 97 + 0.25).cast("double").alias("turank"))


def _unstemmed(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.score_terms(tweets(spark, d), stemmed=False).withColumnRenamed("score", "tfidf")


def _combined(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.score_terms(tweets(spark, d), _scaled(spark, d), tfidf_bounds=ir.TFIDF_BOUNDS, stemmed=False)


_COMBINED = """, ranks AS (SELECT tid, (tid % 97 + 0.25)::DOUBLE AS turank FROM tweets),
norm AS (SELECT stem, tid, CASE WHEN tfidf >= 494.130787450104 THEN 1.0::DOUBLE WHEN tfidf <= 2.011063703278 THEN 0.0::DOUBLE ELSE (tfidf - 2.011063703278::DOUBLE) / (494.130787450104::DOUBLE - 2.011063703278::DOUBLE) END AS tfidf FROM tfidf),
combined AS (SELECT stem, tid, CASE WHEN turank >= 81.62800157711727 THEN 1.0::DOUBLE WHEN turank <= 0.18503099884985902 THEN 0.0::DOUBLE ELSE (turank - 0.18503099884985902::DOUBLE) / (81.62800157711727::DOUBLE - 0.18503099884985902::DOUBLE) END + tfidf AS score FROM norm JOIN ranks USING (tid))
"""


@registered("SELECT user_id, followers FROM deg")
def follower_counts(spark: SparkSession, d: str) -> DataFrame:
    return sampling.follower_counts(edges(spark, d))


@registered("SELECT followers, count(*) AS users FROM deg GROUP BY followers")
def follower_histogram(spark: SparkSession, d: str) -> DataFrame:
    return sampling.follower_histogram(sampling.follower_counts(edges(spark, d)))


@registered("SELECT user_id, screen_name FROM names WHERE user_id IN (SELECT user_id FROM deg)")
def screen_name_filter(spark: SparkSession, d: str) -> DataFrame:
    return sampling.screen_name_filter(names(spark, d), sampling.follower_counts(edges(spark, d)))


@registered("SELECT DISTINCT user_id, follower_id FROM edges")
def distinct_edges(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_distinct(edges(spark, d), 1, 1)


@registered("SELECT DISTINCT user_id, follower_id FROM edges WHERE ('0x' || substr(md5(user_id || chr(9) || follower_id || chr(9) || '42'), 1, 8))::BIGINT % 10 = 0")
def sample_edges(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: one in ten edges, by hash and seed."""
    return sampling.sample_distinct(edges(spark, d), 10, 1, seed=42)


@registered("SELECT screen_name FROM (SELECT screen_name FROM names UNION ALL SELECT user_id::VARCHAR FROM names) WHERE TRY_CAST(screen_name AS BIGINT) IS NULL")
def non_numeric_names(spark: SparkSession, d: str) -> DataFrame:
    """Half of the names are numbers."""
    n = names(spark, d)
    both = n.select("screen_name").unionByName(n.select(F.col("user_id").cast("string").alias("screen_name")))
    return sampling.non_numeric(both, "screen_name")


@registered("SELECT uid, tid, stem, count(*) AS n FROM tokens GROUP BY ALL")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return tx.tokenize(tweets(spark, d), stemmed=False).groupBy("uid", "tid", "stem").agg(F.count("*").alias("n"))


@registered("SELECT stem, uid, tid, tf FROM tf")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return ir.term_frequency(tweets(spark, d), stemmed=False)


@registered("SELECT stem, df FROM df")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return ir.document_frequency(tweets(spark, d), stemmed=False)


@registered("SELECT stem, round(idf, 6) AS idf FROM idf")
def idf(spark: SparkSession, d: str) -> DataFrame:
    t = tweets(spark, d)
    return ir.idf(ir.document_frequency(t, stemmed=False), t.count()).select("stem", F.round("idf", 6).alias("idf"))


@registered("SELECT stem, tid, round(tfidf, 6) AS tfidf FROM tfidf")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _unstemmed(spark, d).select("stem", "tid", F.round("tfidf", 6).alias("tfidf"))


@registered(_STEMMED + "SELECT stem, tid, round(tfidf, 6) AS tfidf FROM stfidf")
def tfidf_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.score_terms(tweets(spark, d)).select("stem", "tid", F.round("score", 6).alias("tfidf"))


@registered(_STEMMED + "SELECT uid, tid, stem, count(*) AS n FROM stokens GROUP BY ALL")
def tokens_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return tx.tokenize(tweets(spark, d)).groupBy("uid", "tid", "stem").agg(F.count("*").alias("n"))


@registered(_STEMMED + "SELECT stem, uid, tid, tf FROM stf")
def term_frequency_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return ir.term_frequency(tweets(spark, d))


@registered(_STEMMED + "SELECT stem, df FROM sdf")
def document_frequency_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return ir.document_frequency(tweets(spark, d))


@registered(_STEMMED + "SELECT stem, round(ln((SELECT count(*) FROM tweets)::DOUBLE / df), 6) AS idf FROM sdf")
def idf_stemmed(spark: SparkSession, d: str) -> DataFrame:
    t = tweets(spark, d)
    return ir.idf(ir.document_frequency(t), t.count()).select("stem", F.round("idf", 6).alias("idf"))


@registered(_STEMMED + "SELECT word, stem FROM stems")
def stems(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct word and its stem; the query's words among them."""
    asked = spark.createDataFrame([(search.parse_query([t], stemmed=False)[0],) for t in TERMS], "word string")
    words = tweets(spark, d).select(F.explode(F.array_distinct(tx.cleaned_tokens("text"))).alias("word")).unionByName(asked).where("word <> ''").distinct()
    return words.select("word", tx.stem("word").alias("stem"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    """stem, tid, score over stems, in whole thousandths, so that sums don't depend on their order."""
    return pipelines.score_terms(tweets(spark, d)).withColumn("score", F.floor(F.col("score") * 1000).cast("double"))


@registered(_STEMMED + ", ix AS (SELECT stem, tid, sum(1) AS n, floor(tfidf * 1000)::BIGINT AS score FROM stfidf GROUP BY ALL) SELECT stem, string_agg(tid::VARCHAR || ':' || score::VARCHAR, ',' ORDER BY tid, score) AS postings FROM ix GROUP BY stem")
def inverted_index_stemmed(spark: SparkSession, d: str) -> DataFrame:
    index = ir.build_index(_index(spark, d).withColumn("score", F.col("score").cast("long")))
    return index.select("stem", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["tid"].cast("string"), p["score"].cast("string"))), ",").alias("postings"))


@registered(_COMBINED + "SELECT stem, tid, round(tfidf, 6) AS tfidf FROM norm")
def tfidf_minmax(spark: SparkSession, d: str) -> DataFrame:
    return ir.normalise_tfidf(_unstemmed(spark, d)).select("stem", "tid", F.round("tfidf", 6).alias("tfidf"))


@registered(_COMBINED + "SELECT stem, tid, round(score, 6) AS score FROM combined")
def score_combined(spark: SparkSession, d: str) -> DataFrame:
    return _combined(spark, d).select("stem", "tid", F.round("score", 6).alias("score"))


@registered(_COMBINED + "SELECT turank, min(tid) AS tid FROM ranks GROUP BY turank ORDER BY turank")
def score_sort_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ir.sort_dedupe(_scaled(spark, d), score="turank")


@registered(_COMBINED + "SELECT turank, min(tid) AS tid FROM ranks GROUP BY turank ORDER BY turank::VARCHAR")
def score_sort_text(spark: SparkSession, d: str) -> DataFrame:
    return ir.sort_dedupe(_scaled(spark, d), score="turank", as_text=True)


@registered(_COMBINED + "SELECT stem, string_agg(tid::VARCHAR || ':' || (floor(score * 1000))::BIGINT::VARCHAR, ',' ORDER BY tid) AS postings FROM combined GROUP BY stem")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    whole = _combined(spark, d).withColumn("score", F.floor(F.col("score") * 1000))
    index = ir.build_index(whole)
    return index.select("stem", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["tid"].cast("string"), p["score"].cast("string"))), ",").alias("postings"))


@registered(_COMBINED + "SELECT stem, count(*) AS postings, sum(tid)::BIGINT AS tids FROM combined GROUP BY stem")
def chunked_index(spark: SparkSession, d: str) -> DataFrame:
    """The index with the postings of frequent stems in several rows, read again."""
    index = ir.build_index(_combined(spark, d), chunk=100)
    return ir.explode_index(index).groupBy("stem").agg(F.count("*").alias("postings"), F.sum("tid").alias("tids"))


@registered(r"""SELECT tid, translate(text, '"''' || chr(10) || chr(9), '') AS text FROM tweets""")
def text_store(spark: SparkSession, d: str) -> DataFrame:
    return ir.text_store(tweets(spark, d))


@registered("SELECT tid, text_line FROM (SELECT tid, translate(text, chr(10) || chr(13) || chr(9), '   ') AS text_line FROM tweets)")
def one_line_text(spark: SparkSession, d: str) -> DataFrame:
    return tweets(spark, d).select("tid", tx.one_line(F.col("text")).alias("text_line"))


_PARTS = """, codes AS (SELECT stem, CASE WHEN length(stem) > 5 THEN substr(stem, length(stem) - 5, 5) ELSE stem END AS k FROM df),
h AS (SELECT stem, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) & 4294967295) AS h FROM codes)
SELECT stem, 'part-r-' || CASE WHEN s < 0 THEN lpad(s::VARCHAR, 5, '0') ELSE lpad(s::VARCHAR, 5, '0') END AS part
FROM (SELECT stem, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 1000 AS s FROM h)"""


@registered(_PARTS)
def index_parts(spark: SparkSession, d: str) -> DataFrame:
    """The export part that holds each stem."""
    return ir.document_frequency(tweets(spark, d), stemmed=False).select("stem", stores.part_name(tx.index_partition(F.col("stem"))).alias("part"))



_SEARCH = f"""hits AS (SELECT tid, sum(score) AS score FROM (SELECT stem, tid, max(tfidf) AS score FROM tfidf WHERE stem IN ({", ".join(f"'{t}'" for t in PLAIN)}) GROUP BY stem, tid) GROUP BY tid HAVING count(*) = {len(PLAIN)})"""


@registered(f", {_SEARCH} SELECT tid, round(score, 6) AS score FROM hits ORDER BY score DESC, tid")
def search_and(spark: SparkSession, d: str) -> DataFrame:
    hits = search.search(_unstemmed(spark, d).withColumnRenamed("tfidf", "score"), PLAIN)
    return hits.select("tid", F.round("score", 6).alias("score"))


_WHOLE = "(SELECT tid, sum(score) AS score FROM (SELECT stem, tid, max(floor(tfidf * 1000)) AS score FROM stfidf WHERE stem IN (FROM asked) GROUP BY stem, tid) GROUP BY tid HAVING count(*) = (SELECT count(*) FROM asked))"


@registered(f"{_STEMMED} SELECT max(tid) AS tid, score FROM {_WHOLE} GROUP BY score")
def search_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Of equal scores one hit, as the source system's result map has it."""
    return search.search(_index(spark, d), search.parse_query(TERMS), collapse_ties=True)


@registered(rf"""{_STEMMED} SELECT h.tid, score, translate(text, '"''' || chr(10) || chr(9), '') AS text FROM {_WHOLE} h LEFT JOIN tweets t ON t.tid = h.tid""")
def search_tables(spark: SparkSession, d: str) -> DataFrame:
    """The index, text store and term index are written, bucketed, and a query reads the buckets that it needs."""
    out = _path(spark, "search")
    pipelines.write_search_tables(spark, _index(spark, d), tweets(spark, d), out, buckets=50)
    return pipelines.query(spark, out, ":".join(TERMS), buckets=50)


@registered(_STEMMED + "SELECT stem, tid, floor(tfidf * 1000)::DOUBLE AS score FROM stfidf WHERE stem = (SELECT stem FROM stems WHERE word = 'thing')")
def term_index(spark: SparkSession, d: str) -> DataFrame:
    out = _path(spark, "terms")
    stores.write_terms(_index(spark, d), out)
    return stores.read_term(spark, out, search.parse_query("thing")[0])


@registered(rf""", {_SEARCH} SELECT h.tid, round(score, 6) AS score, translate(text, '"''' || chr(10) || chr(9), '') AS text FROM hits h LEFT JOIN tweets t ON t.tid = h.tid""")
def search_with_text(spark: SparkSession, d: str) -> DataFrame:
    index = _unstemmed(spark, d).withColumnRenamed("tfidf", "score")
    found = search.with_text(search.search(index, PLAIN), ir.text_store(tweets(spark, d)))
    return found.select("tid", F.round("score", 6).alias("score"), "text")


@registered(_STEMMED + "SELECT tid, round(score, 6) AS score FROM shits ORDER BY score DESC, tid")
def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return search.search(pipelines.score_terms(tweets(spark, d)), search.parse_query(TERMS)).select("tid", F.round("score", 6).alias("score"))


@registered(f""", {_SEARCH} SELECT format('<p>{{}} {{}} {{}}</p>', round(score * 1000)::BIGINT, h.tid, replace(replace(replace(replace(translate(text, '"''' || chr(10) || chr(9), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS line FROM hits h LEFT JOIN tweets t ON t.tid = h.tid""")
def search_html(spark: SparkSession, d: str) -> DataFrame:
    index = _unstemmed(spark, d).withColumnRenamed("tfidf", "score")
    found = search.with_text(search.search(index, PLAIN), ir.text_store(tweets(spark, d)))
    return stores.html_lines(found.withColumn("score", F.round(F.col("score") * 1000).cast("long")))


_PR = """, e AS (SELECT follower_id AS src, user_id AS dst FROM edges),
v AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
w AS (SELECT src, dst, count(*)::DOUBLE / max(n) AS w FROM (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM e) GROUP BY src, dst),
r0 AS (SELECT node, 1.0::DOUBLE AS rank FROM v),
""" + ",\n".join(f"r{k} AS (SELECT v.node, coalesce(g, 0) + (1 - 0.85::DOUBLE) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank * 0.85::DOUBLE * w) AS g FROM r{k - 1} JOIN w ON node = src GROUP BY dst) x ON x.dst = v.node)" for k in range(1, ROUNDS + 1))  # fmt: skip


@registered(_PR + f" SELECT node AS user_id, round(rank, 6) AS rank FROM r{ROUNDS}")
def pagerank_k3(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(edges(spark, d), max_iter=ROUNDS, tol=None).select("user_id", F.round("rank", 6).alias("rank"))


#: Rounds until the residual is below 1. prev holds the last round with its scores and the ones before.
_UNTIL = "1 <= (SELECT coalesce(sum(floor(change * 100 + 0.5)), 1) FROM it)"
_LAST = "k = (SELECT max(k) FROM it)"


@registered(_PR + f""", it AS (SELECT 0 AS k, node, 1.0::DOUBLE AS rank, NULL::DOUBLE AS change FROM v UNION ALL
SELECT o.k + 1, o.node, coalesce(g, 0) + (1 - 0.85::DOUBLE), abs(o.rank - (coalesce(g, 0) + (1 - 0.85::DOUBLE)))
FROM it o LEFT JOIN (SELECT dst, sum(rank * 0.85::DOUBLE * w) AS g FROM it JOIN w ON node = src GROUP BY dst) x ON x.dst = o.node WHERE {_UNTIL})
SELECT node AS user_id, round(rank, 6) AS rank FROM it WHERE {_LAST}""")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    """To convergence."""
    return graph.pagerank(edges(spark, d)).select("user_id", F.round("rank", 6).alias("rank"))


_HITS = """, e AS (SELECT author_id AS src, retweeter AS dst, count(*) AS n FROM retweets GROUP BY ALL),
v AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
s0 AS (SELECT node, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS auth FROM v),
""" + ",\n".join(f"""a{k} AS (SELECT dst AS node, sum(hub * n) AS auth FROM s{k - 1} JOIN e ON node = src GROUP BY dst),
h{k} AS (SELECT src AS node, sum(auth * n) AS hub FROM s{k - 1} JOIN e ON node = dst GROUP BY src),
s{k} AS (SELECT v.node, coalesce(hub, 0) / (SELECT sqrt(sum(hub * hub)) FROM h{k}) AS hub, coalesce(auth, 0) / (SELECT sqrt(sum(auth * auth)) FROM a{k}) AS auth FROM v LEFT JOIN a{k} ON a{k}.node = v.node LEFT JOIN h{k} ON h{k}.node = v.node)""" for k in range(1, ROUNDS + 1))  # fmt: skip


@registered(_HITS + f" SELECT node, round(hub, 6) AS hub, round(auth, 6) AS auth FROM s{ROUNDS}")
def hits_k3(spark: SparkSession, d: str) -> DataFrame:
    e = graph.retweet_edges(retweets(spark, d))
    return graph.hits(e, max_iter=ROUNDS, tol=None).select("node", F.round("hub", 6).alias("hub"), F.round("auth", 6).alias("auth"))


_TU = """, owned AS (SELECT tid, uid AS author_id FROM posts UNION ALL SELECT DISTINCT tid, author_id FROM retweets),
e AS (SELECT 'user' AS sk, follower_id AS s, 'user' AS dk, user_id AS t, 0.2::DOUBLE AS w, 'follow' AS kind FROM edges
  UNION ALL SELECT 'user', author_id, 'tweet', tid, 0.8::DOUBLE, 'post' FROM owned
  UNION ALL SELECT 'tweet', tid, 'user', min(author_id), 0.6::DOUBLE, 'posted' FROM owned GROUP BY tid
  UNION ALL SELECT 'user', retweeter, 'tweet', tid, 0.2::DOUBLE, 'rt' FROM retweets),
v AS (SELECT sk AS k, s AS id FROM e UNION SELECT dk, t FROM e),
w AS (SELECT sk, s, dk, t, sum(w / n) AS w FROM (SELECT *, count(*) OVER (PARTITION BY sk, s, kind) AS n FROM e) GROUP BY sk, s, dk, t),
r0 AS (SELECT k, id, 1.0::DOUBLE AS rank FROM v),
""" + ",\n".join(f"r{k} AS (SELECT v.k, v.id, coalesce(g, 0) + (1 - 0.85::DOUBLE) AS rank FROM v LEFT JOIN (SELECT dk, t, sum(rank * 0.85::DOUBLE * w) AS g FROM r{k - 1} JOIN w ON k = sk AND id = s GROUP BY dk, t) x ON x.dk = v.k AND x.t = v.id)" for k in range(1, ROUNDS + 1))  # fmt: skip


def _turank(spark: SparkSession, d: str, **kw) -> DataFrame:
    return graph.turank(posts(spark, d), retweets(spark, d), edges(spark, d), **kw)


@registered(_TU + f" SELECT id AS tid, round(rank, 6) AS turank FROM r{ROUNDS} WHERE k = 'tweet'")
def turank_k3(spark: SparkSession, d: str) -> DataFrame:
    return graph.tweet_ranks(_turank(spark, d, max_iter=ROUNDS, tol=None)).select("tid", F.round("turank", 6).alias("turank"))


@registered(_TU + f" SELECT id AS user_id, round(rank, 6) AS rank FROM r{ROUNDS} WHERE k = 'user'")
def turank_users_k3(spark: SparkSession, d: str) -> DataFrame:
    ranks = _turank(spark, d, max_iter=ROUNDS, tol=None)
    return ranks.where("node.kind = 'user'").select(F.col("node.id").alias("user_id"), F.round("rank", 6).alias("rank"))


@registered(_HITS + f""", it AS (SELECT 0 AS k, node, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS auth, NULL::DOUBLE AS change FROM v UNION ALL
SELECT o.k + 1, o.node, coalesce(h / nh, 0), coalesce(a / na, 0), abs(o.hub - coalesce(h / nh, 0)) + abs(o.auth - coalesce(a / na, 0)) FROM it o
LEFT JOIN (SELECT dst, a, sqrt(sum(a * a) OVER ()) AS na FROM (SELECT dst, sum(hub * n) AS a FROM it JOIN e ON node = src GROUP BY dst)) x ON x.dst = o.node
LEFT JOIN (SELECT src, h, sqrt(sum(h * h) OVER ()) AS nh FROM (SELECT src, sum(auth * n) AS h FROM it JOIN e ON node = dst GROUP BY src)) y ON y.src = o.node WHERE {_UNTIL})
SELECT node, round(hub, 6) AS hub, round(auth, 6) AS auth FROM it WHERE {_LAST}""")
def hits(spark: SparkSession, d: str) -> DataFrame:
    """To convergence."""
    return graph.hits(graph.retweet_edges(retweets(spark, d))).select("node", F.round("hub", 6).alias("hub"), F.round("auth", 6).alias("auth"))


@registered(_TU + f""", it AS (SELECT 0 AS step, k, id, 1.0::DOUBLE AS rank, NULL::DOUBLE AS change FROM v UNION ALL
SELECT o.step + 1, o.k, o.id, coalesce(g, 0) + (1 - 0.85::DOUBLE), abs(o.rank - (coalesce(g, 0) + (1 - 0.85::DOUBLE)))
FROM it o LEFT JOIN (SELECT dk, t, sum(rank * 0.85::DOUBLE * w) AS g FROM it JOIN w ON k = sk AND id = s GROUP BY dk, t) x ON x.dk = o.k AND x.t = o.id WHERE {_UNTIL})
SELECT id AS tid, round(rank, 6) AS turank FROM it WHERE k = 'tweet' AND step = (SELECT max(step) FROM it)""")
def turank(spark: SparkSession, d: str) -> DataFrame:
    """To convergence."""
    return graph.tweet_ranks(_turank(spark, d)).select("tid", F.round("turank", 6).alias("turank"))


@registered("SELECT sqrt(sum(followers * followers::DOUBLE)) AS followers FROM deg")
def l2_norms(spark: SparkSession, d: str) -> DataFrame:
    return graph.l2_norms(sampling.follower_counts(edges(spark, d)).withColumn("followers", F.col("followers").cast("double")), "followers")


@registered(_PR + " SELECT sum(floor(abs(a.rank - b.rank) * 100 + 0.5))::BIGINT AS residual FROM r1 a JOIN r0 b USING (node)")
def residual_counter(spark: SparkSession, d: str) -> DataFrame:
    one = graph.pagerank(edges(spark, d), max_iter=1, tol=None).withColumn("old", F.lit(1.0))
    return spark.createDataFrame([(graph.residual(one, ("rank", "old")),)], "residual bigint")


@registered("SELECT follower_id AS src, user_id AS dst, count(*) AS n FROM edges GROUP BY ALL")
def follow_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.follow_edges(edges(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@registered("SELECT follower_id AS src, count(*) AS degree FROM edges GROUP BY follower_id")
def out_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_degrees(graph.follow_edges(edges(spark, d)))


@registered("SELECT follower_id AS src, string_agg(user_id::VARCHAR, ',' ORDER BY user_id) AS targets FROM edges GROUP BY follower_id")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(graph.follow_edges(edges(spark, d))).select("src", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@registered("SELECT tid, author_id, retweeter FROM retweets WHERE retweeter IN (SELECT user_id FROM names)")
def known_user_semi(spark: SparkSession, d: str) -> DataFrame:
    return crawl.known_only(retweets(spark, d), names(spark, d), "retweeter").select("tid", "author_id", "retweeter")


@registered("SELECT user_id, follower_id FROM edges WHERE follower_id IN (SELECT user_id FROM names)")
def known_follower_semi(spark: SparkSession, d: str) -> DataFrame:
    """Follows by users with a name; some have none."""
    return crawl.known_only(edges(spark, d), names(spark, d), "follower_id").select("user_id", "follower_id")


@registered("SELECT user_id FROM names WHERE user_id NOT IN (SELECT user_id FROM edges)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Who is left to crawl, by a crawl log that is written in two parts and read again."""
    log, done = _path(spark, "crawl"), edges(spark, d).select(F.col("user_id").alias("uid")).distinct()
    todo = names(spark, d).select("user_id")
    assert logs.crawled_users(spark, log).isEmpty()
    logs.write_log(done.where("uid <= 50"), "crawl_log", log)
    logs.write_log(done.where("uid > 50"), "crawl_log", log, mode="append")
    return crawl.to_crawl(todo, logs.crawled_users(spark, log))


@registered("SELECT uid, tid FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY tid DESC) AS r FROM tweets) WHERE r <= 20")
def per_user_cap(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20 of each user: the cap is the operator."""
    return crawl.first_per_user(tweets(spark, d)).select("uid", "tid")


@registered("SELECT user_id, ((row_number() OVER (ORDER BY user_id) - 1) % 7)::INTEGER AS shard FROM names")
def shard_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return crawl.shard_round_robin(names(spark, d), 7)


@registered("SELECT (row_number() OVER (ORDER BY user_id) - 1) // 100 AS batch, user_id FROM names")
def user_batches(spark: SparkSession, d: str) -> DataFrame:
    return crawl.user_batches(names(spark, d)).select("batch", F.explode("user_ids").alias("user_id"))


@registered("SELECT DISTINCT user_id FROM edges INTERSECT SELECT follower_id FROM edges")
def mutual_ends(spark: SparkSession, d: str) -> DataFrame:
    """Users who are followed and follow (SET3)."""
    e = edges(spark, d)
    return e.select("user_id").intersect(e.select("follower_id"))


def _written(spark: SparkSession, df: DataFrame, log: str) -> str:
    path = _path(spark, log)
    logs.write_log(df, log, path)
    return path


@registered("SELECT uid, tid, translate(text, chr(10) || chr(13) || chr(9), '   ') AS text FROM tweets")
def log_tweets(spark: SparkSession, d: str) -> DataFrame:
    """The tweet log as text, read again."""
    rows = tweets(spark, d).select("uid", "tid", tx.one_line(F.col("text")).alias("text"))
    return logs.read_log(spark, "tweets", _written(spark, rows, "tweets"))[0]


@registered("SELECT tid, author_id, retweeter FROM retweets")
def log_retweets(spark: SparkSession, d: str) -> DataFrame:
    """Lists with a trailing comma, read again."""
    lists = retweets(spark, d).groupBy("tid", "author_id").agg(F.collect_list("retweeter").alias("retweeters"))
    rows, _ = logs.read_log(spark, "retweets", _written(spark, lists, "retweets"))
    return rows.select("tid", "author_id", F.explode("retweeters").alias("retweeter"))


@registered("SELECT stem, uid, tid, tf FROM tf")
def log_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Fields joined by colons, read again."""
    return logs.read_log(spark, "tf", _written(spark, ir.term_frequency(tweets(spark, d), stemmed=False), "tf"))[0]


@registered("SELECT user_id || chr(9) || screen_name AS line FROM names")
def log_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Lines that aren't of a log's types: names where followers are expected, among good ones."""
    paths = _written(spark, names(spark, d), "screen_names"), _written(spark, edges(spark, d), "social_graph")
    return logs.read_log(spark, "social_graph", *paths)[1]


@registered("SELECT k AS key, count(*) AS n, min(v) AS value FROM (SELECT user_id::VARCHAR AS k, follower_id::VARCHAR AS v FROM edges UNION ALL SELECT user_id::VARCHAR, screen_name FROM names UNION ALL SELECT user_id::VARCHAR, '' FROM names) GROUP BY k")
def key_values(spark: SparkSession, d: str) -> DataFrame:
    """Three folders in one scan, the last without tabs."""
    ids = names(spark, d).select(F.col("user_id").alias("uid"))
    paths = _written(spark, edges(spark, d), "social_graph"), _written(spark, names(spark, d), "screen_names"), _written(spark, ids, "crawl_log")
    return logs.read_key_values(spark, *paths).groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("value"))


@registered("SELECT line, count(*) AS n FROM (SELECT user_id || chr(9) || follower_id AS line FROM edges UNION ALL SELECT user_id || chr(9) || follower_id FROM edges) GROUP BY line")
def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whole lines of a log that was overwritten, then appended to."""
    path = _written(spark, names(spark, d), "screen_names")
    logs.write_log(edges(spark, d), "social_graph", path)
    logs.write_log(edges(spark, d), "social_graph", path, mode="append")
    return logs.read_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@registered("SELECT user_id::VARCHAR AS key, followers::DOUBLE AS value FROM deg")
def sequence_file(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "sequence")
    logs.write_sequence(sampling.follower_counts(edges(spark, d)), path)
    return logs.read_sequence(spark, path)


@registered("SELECT DISTINCT user_id FROM edges")
def known_users_log(spark: SparkSession, d: str) -> DataFrame:
    return logs.known_users(spark, _written(spark, edges(spark, d), "social_graph"))


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) & 4294967295)"
_SIGNED = "(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 1000"
_POSTINGS = "SELECT stem, string_agg(tid::VARCHAR || ':' || score::VARCHAR, ',' ORDER BY tid, score) AS postings FROM (SELECT stem, tid, floor(tfidf * 1000)::BIGINT AS score FROM tfidf) GROUP BY stem"


def _export(spark: SparkSession, d: str) -> DataFrame:
    index = ir.build_index(_unstemmed(spark, d).select("stem", "tid", F.floor(F.col("tfidf") * 1000).alias("score")))
    return stores.index_lines(index)


@registered(f""", i AS ({_POSTINGS}), p AS (SELECT *, {_HASH.format("CASE WHEN length(stem) > 5 THEN substr(stem, length(stem) - 5, 5) ELSE stem END")} AS h FROM i)
SELECT 'part-r-' || lpad(({_SIGNED})::VARCHAR, 5, '0') AS part, chr(9) || '"' || stem || '" : "' || postings || '",' AS line FROM p""")
def index_export(spark: SparkSession, d: str) -> DataFrame:
    """The index as lines in parts by a hash of the stem, read back with their parts."""
    path = _path(spark, "export")
    stores.write_parts(_export(spark, d), path)
    return spark.read.text(path).select("part", F.col("value").alias("line"))


@registered(f""", p AS (SELECT tid, translate(text, '"''' || chr(10) || chr(9), '') AS text, {_HASH.format("left(tid::VARCHAR, 5)")} AS h FROM tweets)
SELECT 'part-r-' || lpad(({_SIGNED})::VARCHAR, 5, '0') AS part, chr(9) || '"' || tid || '" : "' || text || '",' AS line FROM p WHERE text NOT LIKE '%' || chr(13) || '%'""")
def text_export(spark: SparkSession, d: str) -> DataFrame:
    """The texts as lines in parts by a hash of the id."""
    path = _path(spark, "texts")
    store = ir.text_store(tweets(spark, d)).where(~F.col("text").contains("\r"))
    stores.write_parts(stores.text_lines(store), path)
    return spark.read.text(path).select("part", F.col("value").alias("line"))


@registered("SELECT tid, floor(tfidf * 1000)::DOUBLE AS score FROM tfidf WHERE stem = 'thing'")
def export_postings(spark: SparkSession, d: str) -> DataFrame:
    """A stem's part, alone written here, is found by its hash, its line by its key, and the postings are parsed."""
    path = _path(spark, "part")
    part = spark.range(1).select(stores.part_name(tx.index_partition(F.lit("thing")))).first()[0]
    stores.write_parts(_export(spark, d).where(F.col("part") == part), path)
    return stores.parse_postings(stores.read_part(spark, path, part, "thing"))


_STATUSES = """, statuses AS (SELECT o_custkey AS uid, o_orderstatus = 'P' AS protected, o_orderkey AS tid, o_orderpriority || chr(10) || o_orderstatus AS text, '{"id": ' || o_orderkey || '}' AS raw,
  o_orderkey % 3 AS favorite_count, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey - 1 END AS retweet_of, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 20 END AS retweet_author FROM orders),
todo AS (SELECT * FROM statuses WHERE NOT protected AND uid NOT IN (SELECT user_id FROM edges)),
own AS (SELECT * FROM todo WHERE retweet_of IS NULL QUALIFY row_number() OVER (PARTITION BY uid ORDER BY tid DESC) <= 20)
SELECT 'tweets' AS log, uid AS a, tid AS b, replace(text, chr(10), ' ') AS s FROM own
UNION ALL SELECT 'retweets', retweet_of, retweet_author, uid::VARCHAR FROM todo WHERE retweet_of IS NOT NULL AND retweet_author IN (SELECT user_id FROM names)
UNION ALL SELECT 'retweets', tid, uid, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) FROM own JOIN lineitem ON l_orderkey = tid WHERE l_partkey IN (SELECT user_id FROM names) GROUP BY tid, uid
UNION ALL SELECT 'favorites', tid, favorite_count, '' FROM own WHERE favorite_count > 0
UNION ALL SELECT 'full_tweets', tid, 0, raw FROM own
UNION ALL SELECT 'crawl_log', uid, 0, '' FROM (SELECT DISTINCT uid FROM todo)"""


@registered(_STATUSES)
def crawl_routes(spark: SparkSession, d: str) -> DataFrame:
    """The five logs of a crawl: orders are statuses, every fourth a retweet; parts are who retweeted them."""
    by = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("tid")).agg(F.collect_list("l_partkey").alias("retweeters"))
    again = "CASE WHEN o_orderkey % 4 = 0 THEN {} END AS {}"
    statuses = _table(spark, d, "orders").selectExpr("o_custkey AS uid", "o_orderstatus = 'P' AS protected", "o_orderkey AS tid", "concat(o_orderpriority, '\n', o_orderstatus) AS text", "concat('{\"id\": ', o_orderkey, '}') AS raw", "o_orderkey % 3 AS favorite_count", again.format("o_orderkey - 1", "retweet_of"), again.format("o_custkey + 20", "retweet_author"))
    got = crawl.route(statuses.join(by, "tid", "left"), names(spark, d), edges(spark, d).select("user_id").distinct())
    row = lambda log, a, b, s: got[log].select(F.lit(log).alias("log"), F.col(a).alias("a"), b.cast("long").alias("b"), s.alias("s"))
    none, empty = F.lit(0), F.lit("")
    parts = [row("tweets", "uid", F.col("tid"), F.col("text")), row("retweets", "tid", F.col("author_id"), F.array_join(F.transform("retweeters", lambda x: x.cast("string")), ",")), row("favorites", "tid", F.col("favorite_count"), empty), row("full_tweets", "tid", none, F.col("raw")), row("crawl_log", "uid", none, empty)]
    return reduce(DataFrame.unionByName, parts)
