"""Substring dedup by hashing lines and their sentences: normalise, group digests globally, keep the first, remove the rest.

Texts are cut at line breaks and sentence ends. A unit is a piece of LEAST_WORDS words or more, or as many neighbouring
pieces, on or back from each, as have so many words, also over lines; so a passage gives the same units wherever it stands
and however short its lines and sentences are. A digest is of a unit's words in lower case without punctuation. The
earliest unit of a digest by (doc_id, start) stays; the others are joined, where they touch, into runs, and a run of
LEAST_RUN words or more is removed. Shorter ones recur by chance or are boilerplate lines, which line dedup knows better.
Only digests and positions are shuffled; groups are reduced on the map side, and the join back is split where a digest is
hot. Original offsets are kept, so removal can be undone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import textvec as tv
from .runtime import fresh, ship, staged

#: Words of a unit, and of what is removed, at least. A word counts once, and eight characters of a piece as a word, so
#: that scripts without spaces have units too.
LEAST_WORDS, LEAST_RUN = 8, 16
WORD_CHARS = 8
UNITS = "i int, j int, start int, stop int, before int, upto int, d1 long, d2 long"
_NAMES = [x.split()[0] for x in UNITS.split(", ")]
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


def _units_of(size: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last piece of each unit, for pieces of the given sizes (1 or more) and texts, in order."""
    sums = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(len(size))
    on = np.searchsorted(sums, sums[:-1] + least, "left") - 1
    back = np.searchsorted(sums, sums[1:] - least, "right") - 1
    first, last = np.concatenate([at, back]), np.concatenate([on, at])
    inside = (first >= 0) & (last < len(size))
    first, last = first[inside], last[inside]
    inside = text[first] == text[last]
    pairs = np.unique(np.stack([first[inside], last[inside]]), axis=1)
    return pairs[0], pairs[1]


def _emit(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tv.filled(batch.column("text"))
            for at, to in tv.slices(texts):
                w = tv.Words(texts.slice(at, to - at), tv.ALNUM, lower="latin")
                raw = w.bytes
                after = np.zeros(len(raw), bool)
                after[1:] = _END[raw[:-1]] & (raw[1:] == 32)
                start, end = tv.runs((raw != 10) & ~after, w.offsets)
                n = np.bincount(np.searchsorted(start, w.start, "right") - 1, minlength=len(start))
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                start, end, n = start[some], end[some], n[some]
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
                word = np.cumsum(n) - n  # each piece's first word
                text = w.row[word]
                size = np.maximum(n, (chars[end] - chars[start]) // WORD_CHARS)
                sums = np.concatenate([[0], np.cumsum(size)])
                a, b = _units_of(size, text, least)
                if not len(a):
                    continue
                row, head = text[a], np.searchsorted(text, np.arange(to - at))
                begin, k = w.offsets[row], head[row]
                cols = [a - k, b - k, chars[start[a]] - chars[begin], chars[end[b]] - chars[begin], sums[a] - sums[k], sums[b + 1] - sums[k]]
                digests = [w.spans(word[a], word[b] + n[b], salt).view(np.int64) for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
                ids = [batch.column(c).take(pa.array(at + row)) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c.astype(np.int32)) for c in cols), *map(pa.array, digests)], ["doc_id", "text_hash", *_NAMES])

    return run


def units(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Each unit: doc_id, text_hash, i, j (its first and last piece, counted in the text), start, stop (characters), before,
    upto (words of the text before it, and to its end), d1, d2 (a 128-bit digest)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return text.mapInArrow(_emit(least_words), f"doc_id {kind}, text_hash long, {UNITS}")


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, least_run: int = LEAST_RUN) -> DataFrame:
    """The runs to remove: doc_id, text_hash, start, stop (character offsets in the original text), n_words, first_doc_id,
    first_start (the earliest place of the run's first unit).

    Rank is (doc_id, start), rows without a doc_id last, and for different texts under one doc_id the text's hash between
    the two; of equal units the least stays, also among those of one text, where a unit that overlaps with its first
    stays too. Of repeated rows (one doc_id, one text) units have equal rank and all stay. Null, empty and wordless texts
    have no units; a very long text is taken whole; other columns are ignored; an empty table gives an empty result.
    """
    u = units(docs, least_words)  # cut twice: that costs less than a table of them, most of which are no repeats
    firsts = u.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    j = staged(u.join(firsts, ["d1", "d2"]), "repeated")
    earliest = F.col("doc_id").eqNullSafe(F.col("first_doc_id"))
    lead = j.where(earliest).groupBy("d1", "d2").agg(F.min(F.struct("text_hash", "start", "stop")).alias("lead"))
    other = ~earliest | (F.col("text_hash") != F.col("lead.text_hash")) | (F.col("start") >= F.col("lead.stop"))
    gone = j.join(lead, ["d1", "d2"]).where(other).drop("d1", "d2")
    text = W.partitionBy("doc_id", "text_hash").orderBy("i", "j")
    reach = F.max("j").over(text.rowsBetween(W.unboundedPreceding, -1))
    gone = gone.withColumn("fresh", (F.col("i") > F.coalesce(reach, F.lit(-2)) + 1).cast("int")).withColumn("run", F.sum("fresh").over(text))
    run = gone.groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("upto") - F.min("before")).alias("n_words"), F.min(F.struct("i", "j", "first_doc_id", "lead.start")).alias("first"))
    return run.where(F.col("n_words") >= least_run).select("doc_id", "text_hash", "start", "stop", "n_words", "first.first_doc_id", F.col("first.start").alias("first_start"))


def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, s in zip(text, spans):
        if t is not None and s is not None and len(s):
            parts, at = [], 0
            for x in sorted(s, key=lambda x: x["start"]):
                parts.append(t[at : x["start"]])
                at = max(at, x["stop"])
            t = "".join(parts) + t[at:]
        out.append(t)
    return pd.Series(out, dtype=object)


def removed(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with the runs in gone (as of repeats) cut out of the texts that they are from."""
    k, h, g = fresh(docs, "cut_id"), fresh(docs, "cut_hash"), fresh(docs, "cut")
    lists = gone.groupBy(F.col("doc_id").alias(k), F.col("text_hash").alias(h)).agg(F.collect_set(F.struct("start", "stop")).alias(g))
    ship(docs.sparkSession)
    cut = F.pandas_udf(_cut, StringType())
    same = F.col("doc_id").eqNullSafe(F.col(k)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h))
    return docs.join(lists, same, "left").withColumn("text", cut(F.col("text"), F.col(g))).drop(k, h, g)


#: Lower case differs from the operator's beyond the Latin-1 letters.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), line_at AS (
  SELECT doc_id, line, x, (sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(x) - 1) AS start FROM lines
), parts AS (
  SELECT doc_id, line, start, unnest(range(len(p))) AS k, unnest(p) AS x FROM (SELECT doc_id, line, start, string_split(regexp_replace(x, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS p FROM line_at)
), part_at AS (
  SELECT doc_id, line, k, x, start + (sum(length(x) + 1) OVER (PARTITION BY doc_id, line ORDER BY k) - length(x) - 1) AS start FROM parts
), segments AS (
  SELECT doc_id, start, start + length(x) AS stop, w, greatest(len(w), length(x) // 8) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS i
  FROM (SELECT *, regexp_extract_all(lower(x), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM part_at) WHERE len(w) > 0
), sums AS (
  SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM segments
), ends AS (
  SELECT a.doc_id, a.i AS i, min(b.i) AS j FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i < a.i + 8 AND b.upto - a.upto + a.size >= 8 GROUP BY a.doc_id, a.i
  UNION SELECT a.doc_id, max(b.i), a.i FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.i <= a.i AND b.i > a.i - 8 AND a.upto - b.upto + b.size >= 8 GROUP BY a.doc_id, a.i
), units AS (
  SELECT e.doc_id, e.i, e.j, min(s.start) AS start, max(s.stop) AS stop, flatten(list(s.w ORDER BY s.i)) AS w FROM ends e JOIN sums s ON s.doc_id = e.doc_id AND s.i BETWEEN e.i AND e.j GROUP BY ALL
), ranked AS (
  SELECT *, first_value(doc_id) OVER g AS first_doc_id, first_value(start) OVER g AS first_start, first_value(stop) OVER g AS first_stop FROM units WINDOW g AS (PARTITION BY w ORDER BY doc_id, start, stop)
), gone AS (
  SELECT * FROM ranked WHERE doc_id <> first_doc_id OR start >= first_stop
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i, j) AS run FROM (SELECT *, (i > coalesce(max(j) OVER (PARTITION BY doc_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1)::INTEGER AS fresh FROM gone)
), runs AS (
  SELECT doc_id, run, min(i) AS i, max(j) AS j, min(start) AS start, max(stop) AS stop, arg_min(first_doc_id, (i, j)) AS first_doc_id, arg_min(first_start, (i, j)) AS first_start FROM islands GROUP BY ALL
)
SELECT r.doc_id, r.start::INTEGER AS start, r.stop::INTEGER AS stop, (b.upto - a.upto + a.size)::INTEGER AS n_words, first_doc_id, first_start::INTEGER AS first_start
FROM runs r JOIN sums a ON a.doc_id = r.doc_id AND a.i = r.i JOIN sums b ON b.doc_id = r.doc_id AND b.i = r.j
WHERE b.upto - a.upto + a.size >= 16
"""
