"""Benchmark decontamination by spaced seeds: masks that ignore some positions, a join of hashes, verified overlaps.

A seed hashes the words under a fixed mask at one position, so a substituted word under none of the mask's ones changes
nothing. The masks are chosen so that every overlap that counts holds a seed of one of them, for items of any length
(tests enumerate the patterns). The benchmark's seeds, while they are few, are a sorted array in each worker, in which
every position of every document is looked up; those of a larger benchmark are joined as a table to the documents' seeds
that pass a filter of fixed size. Each hit fixes an alignment; along it the segment with most matches of those with at
most one mismatch in five words is found, and counts if it holds enough matching words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import fresh, ship, small, staged, table

#: For items of 16 words or more: of 13 or more matches with at most one mismatch in five, some window fits one of these.
#: Enumerated for 13 to 25 matches; an overlap of more can be cut in two of 13 or more, one of which is within the rule.
MASKS = ("111011011", "11010100111", "1111111", "1111001101", "11110101001", "11110010011")
#: For items of 10 to 15 words: the same for matches of four fifths of the item's words.
MEDIUM = ("1111011", "110010111", "110101011", "11111001", "11001111", "111111")
#: Items of up to so many words may have one mismatch; their seeds leave out one word each.
SHORT, MIDDLE = 9, 15
#: A run of this many matching words counts, or four fifths of a shorter item; items of fewer words than LEAST never do.
ENOUGH = 13
LEAST = 5
#: Words of a benchmark whose seeds are held in each worker; those of a larger one are joined as a table.
BLOCK_WORDS = 250_000
#: Bits of the filter that seeds pass before they are joined to a table, as a power of two.
FILTER_BITS = 27
FOUND = "item_id long, matched int, overlap int, item_words int, doc_start int, item_start int"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _words(texts: pa.Array) -> tv.Words:
    return tv.Words(pc.utf8_lower(texts), tv.ALNUM, lower=False)


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _but_one(n: int) -> list[str]:
    """Masks that leave out one of n words each: the first or last, then each other."""
    return ["1" * (n - 1), *("1" * k + "0" + "1" * (n - 1 - k) for k in range(1, n - 1))]


#: Each mask with the least and greatest size of the items it is for.
_FOR = [*((m, MIDDLE + 1, 1 << 30) for m in MASKS), *((m, SHORT + 1, MIDDLE) for m in MEDIUM), *((m, n, n) for n in range(LEAST, SHORT + 1) for m in _but_one(n))]


def _seeds(h: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each placement of the mask within one text."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, np.uint64(int(mask, 2)))
    for k in _offsets(mask):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
        out ^= out >> np.uint64(32)
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    return tv.mix(out[at]), at


def _segment(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the segment with most matches of those with at most one mismatch in five."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    matches = np.concatenate([[0], np.cumsum(same)])
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")  # for each end the first start that is allowed
    end = int((matches - matches[starts]).argmax())
    start, matched = int(starts[end]), int(matches[end] - matches[starts[end]])
    return (start + int(same[start:].argmax()) if matched else end), end, matched


def _item_seeds(w: tv.Words) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Mask, hashes and first words of the seeds of the items, masks without seeds left out."""
    for mask, least, most in _FOR:
        seed, at = _seeds(w.hash, w.row, mask)
        size = w.count[w.row[at]]
        own = (size >= least) & (size <= most)
        if own.any():
            yield mask, seed[own], at[own]


def _overlap(doc: tv.Words, row: int, begin: int, item: np.ndarray) -> tuple | None:
    """Of an item whose first word lies at word `begin` of doc.hash, the overlap with text `row` if it counts: matched,
    length, item's words, first word in the text, in the item."""
    size, first = len(item), int(doc.first[row])
    lo, hi = max(0, first - begin), min(size, first + int(doc.count[row]) - begin)
    start, end, matched = _segment(item[lo:hi] == doc.hash[begin + lo : begin + hi])
    if size < LEAST or matched < min(ENOUGH, -(-4 * size // 5)):
        return None
    return matched, end - start, size, begin + lo + start - first, lo + start


class Block:
    """Some benchmark items: their words' hashes, and the sorted seeds of each mask."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = _words(pa.array(texts, pa.string()))
        self.ids, self.hash, self.first, self.count = np.array(ids, np.int64), w.hash, w.first, w.count
        self.tables = []
        for mask, seed, at in _item_seeds(w):
            order = np.argsort(seed, kind="stable")
            seed, at = seed[order], at[order]
            seen = np.zeros(1 << 20, bool)
            seen[seed >> np.uint64(44)] = True
            self.tables.append((mask, seed, at.astype(np.int32), w.row[at].astype(np.int32), seen))

    def overlaps(self, texts: pa.Array) -> dict[tuple[int, int], tuple]:
        """(text, item) -> the best overlap (most matches, then first): as of _overlap."""
        w = _words(texts)
        pairs = [np.zeros((0, 3), np.int64)]
        for mask, seeds, at, item, seen in self.tables:
            h, pos = _seeds(w.hash, w.row, mask)
            maybe = np.flatnonzero(seen[h >> np.uint64(44)])
            lo, hi = np.searchsorted(seeds, h[maybe], "left"), np.searchsorted(seeds, h[maybe], "right")
            n = hi - lo
            where = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc = np.repeat(pos[maybe], n)
            pairs.append(np.stack([w.row[doc], item[where], doc - (at[where] - self.first[item[where]])], axis=1))
        best: dict[tuple[int, int], tuple] = {}
        for row, item, begin in np.unique(np.concatenate(pairs), axis=0).tolist():
            first = int(self.first[item])
            got = _overlap(w, row, begin, self.hash[first : first + int(self.count[item])])
            if got and ((row, item) not in best or got[0] > best[row, item][0]):
                best[row, item] = got
        return best


def items(benchmark: DataFrame) -> DataFrame:
    """i, t: ids and texts of the benchmark, repeated rows once, null texts not."""
    return benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t IS NOT NULL").distinct()


def block(benchmark: DataFrame) -> Block | None:
    """The whole benchmark as a block, or None if it has more than BLOCK_WORDS words."""
    own = items(benchmark)
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > 2 * BLOCK_WORDS:  # a word and its gap take two bytes or more
        return None
    rows = own.orderBy("i", "t").collect()
    return Block([r.i for r in rows], [r.t for r in rows])


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            texts = tv.filled(batch.column("text"))
            for at, to in tv.slices(texts):
                got = block.overlaps(texts.slice(at, to - at))
                if got:
                    rows = sorted(got.items())
                    ids = batch.column("doc_id").take(pa.array([at + r for (r, _), _ in rows]))
                    cols = [pa.array([v[k] for _, v in rows], pa.int32()) for k in range(5)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(block.ids[[i for (_, i), _ in rows]]), *cols], ["doc_id", *_NAMES])

    return run


def _seeds_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in tv.slices(batch.column("t")):
            w = _words(batch.column("t").slice(at, to - at))
            for mask, seed, pos in _item_seeds(w):
                row = w.row[pos]
                yield pa.RecordBatch.from_arrays([pa.array([mask] * len(pos)), pa.array(seed.view(np.int64)), batch.column("k").take(pa.array(at + row)), pa.array(pos - w.first[row])], ["mask", "seed", "k", "at"])


def _seeds_of_texts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, bits = shared.value
        for batch in batches:
            texts = tv.filled(batch.column("text"))
            for at, to in tv.slices(texts):
                w = _words(texts.slice(at, to - at))
                for mask in masks:
                    h, pos = _seeds(w.hash, w.row, mask)
                    cell = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    hit = np.flatnonzero((bits[cell >> 6] >> (cell & 63)) & 1)
                    if len(hit):
                        row = w.row[pos[hit]]
                        ids = [batch.column(c).take(pa.array(at + row)) for c in ("doc_id", "th")]
                        yield pa.RecordBatch.from_arrays([*ids, pa.array(h[hit].view(np.int64)), pa.array(pos[hit] - w.first[row])], ["doc_id", "th", "seed", "pos"])

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tv.filled(batch.column("text"))
        for at, to in tv.slices(texts):
            d, b = _words(texts.slice(at, to - at)), _words(batch.column("t").slice(at, to - at))
            found = []
            for row, begins in enumerate(batch.column("begins").slice(at, to - at).to_pylist()):
                item = b.hash[b.first[row] : b.first[row] + b.count[row]]
                got = [x for x in (_overlap(d, row, int(d.first[row]) + k, item) for k in sorted(begins)) if x]
                if got:
                    found.append((at + row, max(got, key=lambda x: x[0])))
            if found:
                which = pa.array([r for r, _ in found])
                cols = [pa.array([v[k] for _, v in found], pa.int32()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(which) for c in ("doc_id", "th", "i")), *cols], ["doc_id", "th", *_NAMES])


def joined(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What contaminated gives, and th (a hash of the text), each text of a doc_id once, for a benchmark of any size: seeds
    are a table, joined to those of the documents that pass a filter, and texts are moved only to confirm hits."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    bench = staged(items(benchmark).withColumn("k", F.struct(F.xxhash64("i", "t").alias("a"), F.xxhash64("t", "i").alias("b"))), "items")
    seeds = staged(bench.select("k", "t").mapInArrow(_seeds_of_items, "mask string, seed long, k struct<a:long,b:long>, at long"), "seeds")
    cell = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = seeds.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    at = words.toPandas()  # of a size that FILTER_BITS bounds
    bits[at["w"].to_numpy(np.int64)] = at["b"].to_numpy(np.int64)
    masks = [m for m in dict.fromkeys(m for m, _, _ in _FOR) if m in {r.mask for r in seeds.select("mask").distinct().collect()}]
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("th", F.xxhash64("text"))
    hits = own.mapInArrow(_seeds_of_texts(spark.sparkContext.broadcast((masks, bits))), f"doc_id {kind}, th long, seed long, pos long")
    pairs = hits.join(seeds, "seed").select("doc_id", "th", "k", (F.col("pos") - F.col("at")).alias("begin")).distinct()
    pairs = staged(pairs.groupBy("doc_id", "th", "k").agg(F.collect_list("begin").alias("begins")).withColumnsRenamed({"doc_id": "d", "th": "h"}), "hits")
    rows = own.join(pairs, (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))).join(bench, "k")
    return rows.select("doc_id", "th", "text", "i", "t", "begins").mapInArrow(_confirm, f"doc_id {kind}, th long, {FOUND}")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text) and item of benchmark (item_id, text) that overlap enough, with the best
    overlap (most matches, then first in the text): matched words, its length, the item's words, and where it begins in
    both, in words.

    Words are runs of letters and digits in lower case. Null and empty texts have none; a very long text is taken whole;
    items of fewer than five words match nothing; repeated rows of docs are found each, of the benchmark once; other
    columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    held = block(benchmark)
    if held is None:
        return joined(docs, benchmark).drop("th")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_find(spark.sparkContext.broadcast(held)), f"doc_id {kind}, {FOUND}")


def _clean(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            texts = tv.filled(batch.column(text))
            keep = np.ones(batch.num_rows, bool)
            for at, to in tv.slices(texts):
                for row, _ in block.overlaps(texts.slice(at, to - at)):
                    keep[at + row] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that overlap with no item. While the benchmark's seeds fit a worker, nothing is moved
    between tasks."""
    spark = docs.sparkSession
    ship(spark)
    held = block(benchmark)
    if held is not None:
        return docs.mapInArrow(_clean(spark.sparkContext.broadcast(held), "text"), docs.schema)
    d, t = fresh(docs, "of_id"), fresh(docs, "of_text")
    gone = staged(joined(docs, benchmark).select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct(), "contaminated")
    return docs.join(small(gone), F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t)), "left_anti")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that overlap with a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


#: Looks at every alignment, also those that no seed hits, and at every segment along it.
ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents)
), bl AS (
  SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS j FROM bl WHERE len(w) >= 5
), aligned AS (
  SELECT doc_id, item_id, n, pos - j AS shift FROM dw JOIN bw USING (w) GROUP BY ALL HAVING count(*) >= least(13, (4 * n + 4) // 5)
), same AS (
  SELECT a.doc_id, a.item_id, a.n, a.shift, b.j, (d.w = b.w)::INTEGER AS eq FROM aligned a JOIN bw b ON b.item_id = a.item_id JOIN dw d ON d.doc_id = a.doc_id AND d.pos = a.shift + b.j
), sums AS (
  SELECT *, sum(CASE WHEN eq = 1 THEN 1 ELSE -4 END) OVER g AS s, sum(eq) OVER g AS m, row_number() OVER g AS k, min(j) OVER (PARTITION BY doc_id, item_id, shift) AS lo
  FROM same WINDOW g AS (PARTITION BY doc_id, item_id, shift ORDER BY j)
), prefix AS (
  SELECT doc_id, item_id, n, shift, lo, k, s, m FROM sums UNION ALL SELECT DISTINCT doc_id, item_id, n, shift, lo, 0, 0, 0 FROM sums
), spans AS (
  SELECT e.doc_id, e.item_id, e.n, e.shift, e.lo, p.k AS start, e.k AS stop, e.m - p.m AS matched
  FROM prefix e JOIN prefix p ON p.doc_id = e.doc_id AND p.item_id = e.item_id AND p.shift = e.shift AND p.k < e.k AND p.s <= e.s
), best AS (
  SELECT * FROM spans WHERE matched >= least(13, (4 * n + 4) // 5)
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, shift, stop, start DESC) = 1
)
SELECT doc_id, item_id, matched::INTEGER AS matched, (stop - start)::INTEGER AS overlap, n::INTEGER AS item_words, (shift + lo + start)::INTEGER AS doc_start, (lo + start)::INTEGER AS item_start
FROM best
"""
