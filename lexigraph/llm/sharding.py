"""Shards of nearly equal bytes by histogram sort; DataFrame functions only.

A row's key is a hash of its text, then one of its doc_id, 120 bits in ten digits; so equal texts lie together. Splitters
are found without moving rows: each round counts the exact bytes below 4096 candidate boundaries within the stretch in
which a splitter's target lies, partly on the map side. A splitter is done when a boundary meets its target within the
tolerance; else its probes are refined within the one stretch between two boundaries, as often as it takes. Only a text
whose rows hold more than TORN of a shard gets split, by doc_id. Then each row's shard is a comparison with the splitters,
and one exchange numbers the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .runtime import small, staged

#: Bits of a digit, and digits of the text's and of the doc_id's hash each.
BITS, DIGITS = 12, 5
SHARDS = 8
#: How far a splitter may lie from its target, as a share of a shard's bytes. Beyond it only where one row is larger.
TOLERANCE = 0.002
#: Rows of one text stay together, at the nearer end of them, unless they hold more than this share of a shard's bytes.
TORN = 0.02
#: Rows that one task numbers at a time, about.
BIN_ROWS = 1_000_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and th, dh: the key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = lambda h: F.shiftrightunsigned(h, 64 - BITS * DIGITS)
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), cut(F.xxhash64(text)).alias("th"), cut(F.xxhash64("doc_id")).alias("dh"))


@dataclass
class Splitter:
    """A boundary is sought in the stretch of all keys that begin with `prefix`, `depth` digits; below: bytes before it."""

    target: int
    prefix: int = 0
    depth: int = 0
    below: int = 0
    at: int | None = None
    #: Bytes below the boundary.
    found: int = 0

    def probe(self, counts: list[tuple[int, int, int]], share: float) -> None:
        """Take the nearest boundary, or refine. counts: digit, bytes and rows of the stretch's digits, in order; share: a
        shard's bytes."""
        before = self.below
        for digit, size, rows in counts:
            if before + size >= self.target:
                break
            before += size
        last = self.depth + 1 == 2 * DIGITS or self.depth + 1 == DIGITS and size <= TORN * share
        low, high = self.target - before, before + size - self.target
        if min(low, high) > TOLERANCE * share and rows > 1 and not last:
            self.prefix, self.depth, self.below = self.prefix << BITS | digit, self.depth + 1, before
            return
        left = BITS * (2 * DIGITS - self.depth - 1)
        self.at = (self.prefix << BITS | digit) + (low > high) << left
        self.found = before + (size if low > high else 0)


def _digit(depth: int) -> Column:
    return F.shiftright("th" if depth < DIGITS else "dh", BITS * (DIGITS - 1 - depth % DIGITS)).bitwiseAND(F.lit(2**BITS - 1))


def _inside(prefix: int, depth: int) -> Column:
    """Whether a row's key begins with the prefix."""
    if depth <= DIGITS:
        return F.shiftright("th", BITS * (DIGITS - depth)) == prefix if depth else F.lit(True)
    rest = BITS * (depth - DIGITS)
    return (F.col("th") == prefix >> rest) & (F.shiftright("dh", BITS * DIGITS - rest) == prefix & (1 << rest) - 1)


def splitters(rows: DataFrame, shards: int = SHARDS) -> list[Splitter]:
    """The shards - 1 splitters of rows (as of sized, written before). To the driver come, in a round, as many counts as
    there are splitters times boundaries."""
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    found = [Splitter(-(-total * k // shards)) for k in range(1, shards)]
    while todo := [s for s in found if s.at is None]:
        depth = todo[0].depth  # all that aren't done have the same
        prefixes = sorted({s.prefix for s in todo})
        which = F.lit(None).cast("int")
        for k, p in enumerate(prefixes):
            which = F.when(_inside(p, depth), k).otherwise(which)
        bins = rows.select(which.alias("which"), _digit(depth).alias("digit"), "size").where("which IS NOT NULL").groupBy("which", "digit").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        counts: dict[int, list] = {p: [] for p in prefixes}
        for r in sorted(bins.collect()):
            counts[prefixes[r.which]].append((r.digit, r.bytes, r.rows))
        for s in todo:
            s.probe(counts[s.prefix], total / shards)
    return found


def shard_of(found: list[Splitter]) -> Column:
    """How many splitters a row's key isn't below."""
    out = F.lit(0)
    for s in found:
        th, dh = s.at >> BITS * DIGITS, s.at & (1 << BITS * DIGITS) - 1
        out = out + ((F.col("th") > th) | ((F.col("th") == th) & (F.col("dh") >= dh))).cast("int")
    return out.cast("int")


def placed(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows (as of sized, written before) with shard and slot, instead of the key.

    Rows are dealt to bins by their whole key, so that a text of many copies fills many; slots follow from the bins' counts.
    """
    named = rows.withColumn("shard", shard_of(splitters(rows, shards)))
    bins = -(-rows.count() // (shards * BIN_ROWS))
    named = named.withColumn("bin", F.pmod(F.xxhash64("th", "dh"), F.lit(max(bins, 1))))
    per = named.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    bases = staged(per.select("shard", "bin", (F.sum("n").over(W.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("base")), "slots")
    number = F.row_number().over(W.partitionBy("shard", "bin").orderBy("th", "dh", "doc_id"))
    return named.join(small(bases), ["shard", "bin"]).withColumn("slot", (F.col("base") + number - 1).cast("long")).drop("bin", "base", "th", "dh")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard (null).

    The law is `bytes`: each splitter lies within TOLERANCE of its target, or as near as single rows and the rows of one
    text let it. Equal texts share a shard unless they hold more than TORN of one. A null text counts as an empty one; a very long text is one row;
    rows that share a doc_id and text share a shard, in slots of any order; other columns are ignored; an empty table
    gives an empty result.
    """
    out = placed(staged(sized(docs), "sized"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write docs under path, a folder a shard, with one exchange of the texts. Needs unique doc_ids."""
    at = shard_documents(docs, shards).select("doc_id", "shard", "slot")
    docs.join(at, "doc_id").repartition("shard", F.pmod(F.col("slot"), F.lit(64))).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
