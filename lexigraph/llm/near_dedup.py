"""Near duplicates by SetSketch registers: sketch, band, estimate jointly by likelihood, verify, connect.

A document's set is its distinct k-word shingles. A SetSketch keeps, for each of m registers, the least of the set's
exponentially distributed points, on a logarithmic scale and truncated to 16 bits; registers merge by maximum, and two
sets' registers agree with a probability near their Jaccard similarity. Documents that agree on a band of registers are
candidates. A candidate pair goes to verification unless the joint likelihood of its registers rules the similarity out;
verification compares the full sets.

Hot groups: documents with equal sets (by a 128-bit digest) are one class, a numbered node. A bucket's pairs are never made at
once: in each round a few of its members are pivots, eight times as many as the last time, and only members in another
component than the pivot are paired with it; then components are formed anew, and buckets of one component are left. So a
group of copies takes a round or two however large it is. A bucket that keeps more than CROWD members in several
components (texts that share boilerplate, but are unlike) is banded again, by rare shingles: sets with a similarity of t
share a shingle among the n - ceil(t n) + 1 rarest of each, in any order, so no link is lost, and boilerplate is never
among the rarest. Sets that such buckets connect are a family. Where a family's pairs are not many more than those in its
buckets (copies with edits, mostly short of the threshold), it isn't paired: its hashed sets are cut into sides, each two
sides are one task, and that counts all overlaps at once, so a set is sent once a tile instead of a text once a pair; sides
of one component are left. A pivot with many members is salted, and no pair within a component is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import bytes_of
from . import textvec as tv
from .runtime import fresh, ship, small, staged

M = 128
BAND = 4
B, A, Q = 1.001, 20.0, 65534
#: A pair is ruled out when its registers are e^12 times likelier under a lower similarity than at the threshold.
RULED_OUT = 12.0
#: Pivots a bucket in the first round, and how many times as many in each further one.
PIVOTS, GROWTH = 1, 8
#: A bucket of more members that is left after two rounds is banded again.
CROWD = 64
SALT_ROWS = 2000
RANKS = 1 << 62
#: Counters that estimate how many sets hold a shingle; their number doesn't depend on the data.
CELL_BITS = 18
#: A family is compared in tiles where its pairs are at most so many times those in its buckets.
DENSE = 8
#: Edges of at most this many bytes on disk (a million or so) are connected by one task.
EDGE_BYTES = 8 << 20
#: Shingles of a side of a tile, with LEAD more for each set.
SIDE, LEAD = 1 << 20, 512
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def registers(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """SetSketch registers (n x M, uint16) of n sets; h: distinct element hashes, row: their set."""
    least = np.full(n * M, np.inf)
    seed = tv.mix(h ^ np.uint64(0xA0761D6478BD642F))
    first, step = (seed & np.uint64(M - 1)).astype(np.int64), ((seed >> np.uint64(20)) & np.uint64(M - 1) | np.uint64(1)).astype(np.int64)
    x = np.zeros(len(h))
    for j in range(M):
        u = (tv.mix(h + np.uint64((j + 1) * int(_GOLDEN) % 2**64)) >> np.uint64(11)).astype(np.float64)
        x = x - np.log((u + 1) * 2.0**-53) / (A * (M - j))
        np.minimum.at(least, row * M + ((first + j * step) & (M - 1)), x)
        keep = np.flatnonzero(x < least.reshape(n, M).max(axis=1)[row])
        if not len(keep):
            break
        if len(keep) < 0.9 * len(h):
            h, row, first, step, x = h[keep], row[keep], first[keep], step[keep], x[keep]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least) / np.log(B))
    return np.clip(k, 0, Q + 1).astype("<u2").reshape(n, M)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tv.filled(batch.column("text"))
            for at, to in tv.slices(texts):
                n = to - at
                h, row = tv.distinct(*tv.Words(texts.slice(at, n)).shingles(shingle))
                size = np.bincount(row, minlength=n)
                ends, digest = np.cumsum(size), np.zeros((n, 2), ">u8")
                for k, salt in enumerate((np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))):
                    sums = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(tv.mix(h ^ salt), out=sums[1:])
                    digest[:, k] = sums[ends] - sums[ends - size]
                some = size.tolist()
                cols = [[x.tobytes() if s else None for x, s in zip(of, some)] for of in (digest, registers(h, row, n))]
                own = [batch.column(c).slice(at, n) for c in ("doc_id", "th")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size.astype(np.int64)), *(pa.array(c, pa.binary()) for c in cols)], ["doc_id", "th", "n_shingles", "digest", "registers"])

    return run


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), text: what tells the rows of docs apart."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")


def sketches(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, th, n_shingles, digest (of the set, 128 bits), registers (both null for an empty set)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return hashed(docs).mapInArrow(_sketch(shingle), f"doc_id {kind}, th long, n_shingles long, digest binary, registers binary")


def band_keys(column: Column) -> Column:
    """One 64-bit key a band, for registers as bytes."""
    return F.array(*(F.xxhash64(F.substring(column, 2 * BAND * i + 1, 2 * BAND), F.lit(i)) for i in range(M // BAND)))


def log_likelihood(above: np.ndarray, below: np.ndarray, u: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of similarity j; above, below: registers of the first set that are greater, less; u: its share of both sizes."""
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B), 1e-9, 1)
    a, b = p(u - (1 - u) * j), p((1 - u) - u * j)
    return above * np.log(a) + below * np.log(b) + (M - above - below) * np.log(np.clip(1 - a - b, 1e-9, 1))


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood similarity, and by how much its log-likelihood exceeds that of the threshold."""
    above, below, u = (ra > rb).sum(axis=1)[:, None], (ra < rb).sum(axis=1)[:, None], (na / (na + nb))[:, None]
    most = np.minimum(u / (1 - u), (1 - u) / u)
    grid = np.linspace(0, 1, 65)[None, :] * most
    ll = log_likelihood(above, below, u, grid)
    best = ll.argmax(axis=1)
    return np.take_along_axis(grid, best[:, None], 1)[:, 0], ll.max(axis=1) - log_likelihood(above, below, u, np.minimum(threshold, most))[:, 0]


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ra, rb = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, M) for c in ("ra", "rb"))
                na, nb = (part.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                best, excess = estimate(ra, rb, na, nb, percent / 100)
                keep = pa.array((best >= percent / 100) | (excess <= RULED_OUT))
                yield part.select(["pivot", "member"]).filter(keep)

    return run


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (pivot, member) that sizes and registers don't rule out."""
    side = lambda key, r, n: reps.select(F.col("node").alias(key), F.col("registers").alias(r), F.col("n_shingles").alias(n))
    both = pairs.join(side("pivot", "ra", "na"), "pivot").join(side("member", "rb", "nb"), "member")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return both.select("pivot", "member", "ra", "na", "rb", "nb").mapInArrow(_likely(percent), "pivot long, member long")


def _verify(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, sets = None, []
        for batch in batches:
            texts = tv.filled(batch.column("text"))
            keys = list(zip(batch.column("pivot").to_pylist(), batch.column("salt").to_pylist()))
            members = batch.column("member").to_pylist()
            roles = batch.column("role").to_pylist()
            for at, to in tv.slices(texts):
                h, row = tv.distinct(*tv.Words(texts.slice(at, to - at)).shingles(shingle))
                ends = np.searchsorted(row, np.arange(to - at + 1))
                found: list[tuple[int, int]] = []
                for i in range(at, to):
                    own = h[ends[i - at] : ends[i - at + 1]]
                    if keys[i] != pivot:
                        pivot, sets = keys[i], []
                    if roles[i] == 0:
                        sets.append(own.copy())
                    else:
                        for other in sets:
                            both = len(np.intersect1d(own, other, assume_unique=True))
                            if both and 100 * both >= percent * (len(own) + len(other) - both):
                                found.append((pivot[0], members[i]))
                                break
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _texts(needs: DataFrame, docs: DataFrame) -> DataFrame:
    """needs (at: doc_id and th of a text) with the text."""
    d = hashed(docs)
    return d.join(small(staged(needs, "needs")), (d["th"] == F.col("at.th")) & d["doc_id"].eqNullSafe(F.col("at.doc_id"))).drop("doc_id", "th", "at")


def verified(pairs: DataFrame, at: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) among the pairs (pivot, member), by their full sets. at: node, at (where a text with this set is).

    Each text goes to the task of its pair's pivot and salt; texts stream by, and only the pivot's set is held.
    """
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(SALT_ROWS)).alias("salts"))
    salted = pairs.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("member"), F.col("salts")).alias("salt"), "member")
    members = salted.withColumn("role", F.lit(1)).unionByName(salted.select("pivot", "salt", F.col("pivot").alias("member"), F.lit(0).alias("role")).distinct())
    needs = members.join(at.withColumnRenamed("node", "member"), "member")
    rows = _texts(needs, docs).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role").select("pivot", "salt", "role", "member", "text")
    return rows.mapInArrow(_verify(shingle, percent), "a long, b long")


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tv.filled(batch.column("text"))
            for at, to in tv.slices(texts):
                h, row = tv.distinct(*tv.Words(texts.slice(at, to - at)).shingles(shingle))
                ends = np.searchsorted(row, np.arange(to - at + 1))
                own = [h[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, to - at), pa.array(np.diff(ends)), pa.array(own, pa.binary())], ["node", "n", "h"])

    return run


def _hashes(sets: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of sets as bytes, and the set of each."""
    return np.frombuffer(b"".join(sets.to_pylist()), np.uint64), np.repeat(np.arange(len(n)), n.to_numpy())


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        h, _ = _hashes(batch.column("h"), batch.column("n"))
        total += np.bincount((h >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])


def _rarest(shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            h, row = _hashes(batch.column("h"), batch.column("n"))
            order = np.lexsort((h, counts[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)], row))
            h, row = h[order], row[order]
            size = batch.column("n").to_numpy()
            place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            keep = place < (size - -(-percent * size // 100) + 1)[row]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(row[keep])), pa.array(size[row[keep]]), pa.array(h[keep].view(np.int64))], ["node", "n", "key"])

    return run


def rare_buckets(nodes: DataFrame, at: DataFrame, docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """key, node, n: each set under its rarest shingles, as many as two sets with the similarity must share one of; and the
    sets (node, n, h: their hashes), staged."""
    texts = _texts(nodes.join(at, "node"), docs)
    sets = staged(texts.mapInArrow(_sets(shingle), "node long, n long, h binary").dropDuplicates(["node"]), "sets")
    cells = sets.mapInArrow(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for r in cells.collect():  # at most 2 to the CELL_BITS rows
        counts[r.cell] = r.n
    shared = nodes.sparkSession.sparkContext.broadcast(counts)
    return staged(sets.mapInArrow(_rarest(shared, percent), "node long, n long, key long"), "rare"), sets


def overlaps(ha: np.ndarray, ra: np.ndarray, hb: np.ndarray, rb: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many hashes each of shape[0] sets (ha, of sets ra) shares with each of shape[1] sets (hb, of rb): of hashes in many
    sets by products of 0-1 matrices, of others pair by pair."""
    known, of = np.unique(np.concatenate([ha, hb]), return_inverse=True)
    ta, tb = of[: len(ha)], of[len(ha) :]
    fa, fb = (np.bincount(t, minlength=len(known)) for t in (ta, tb))
    often = fa * fb * 200 > shape[0] * shape[1]
    out, place = np.zeros(shape), np.where(often, np.cumsum(often) - 1, -1)
    for at in range(0, many := int(often.sum()), 4096):
        parts, width = [], min(4096, many - at)
        for t, r, n in ((place[ta], ra, shape[0]), (place[tb], rb, shape[1])):
            k = (t >= at) & (t < at + width)
            parts.append(np.zeros((n, width), np.float32))
            parts[-1][r[k], t[k] - at] = 1
        out += parts[0] @ parts[1].T
    k = np.flatnonzero(~often[ta] & (fb[ta] > 0))
    ta, ra, rb, first = ta[k], ra[k], rb[np.argsort(tb, kind="stable")], np.cumsum(fb) - fb
    ends = np.cumsum(fb[ta])
    for at in range(0, int(ends[-1]) if len(k) else 0, 1 << 22):
        cut = slice(*np.searchsorted(ends, [at, at + (1 << 22)], "right"))
        n = fb[ta[cut]]
        b = np.repeat(first[ta[cut]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out += np.bincount(np.repeat(ra[cut], n) * shape[1] + rb[b], minlength=out.size).reshape(shape)
    return out


def _tile(percent: int):
    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        all_ = pa.Table.from_batches(rows).combine_chunks()
        sides = []
        for role in (0, 1):
            t = all_.filter(pc.equal(all_["role"], role))
            sides.append((*_hashes(t["h"], t["n"]), t["n"].to_numpy(), t["label"].to_numpy()))
        if not len(sides[1][2]):
            sides[1] = sides[0]
        (ha, ra, na, la), (hb, rb, nb, lb) = sides
        both = overlaps(ha, ra, hb, rb, (len(na), len(nb)))
        (la, ca), (lb, cb) = (np.unique(x, return_inverse=True) for x in (la, lb))
        i, j = np.nonzero((100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (la[ca][:, None] != lb[cb][None, :]))
        once = np.unique(ca[i] * len(lb) + cb[j])
        return pa.RecordBatch.from_arrays([pa.array(la[once // len(lb)]), pa.array(lb[once % len(lb)])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            of = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j"))))
            cuts = [0, *(k for k in range(1, len(of)) if of[k] != of[k - 1]), len(of)]
            for at, to in zip(cuts[:-1], cuts[1:]):
                if at < to:
                    if held and of[at] != tile:
                        yield links(held)
                        held = []
                    tile = of[at]
                    held.append(batch.slice(at, to - at))
        if held:
            yield links(held)

    return run


def families(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dense families of the buckets keyed (key, node, n): node, n, family; and the buckets of the other ones."""
    buckets = staged(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1"), "buckets")
    labels = components(keyed.join(buckets, "key").select(F.col("node").alias("a"), F.col("first").alias("b")))
    family = F.coalesce("label", "node").alias("family")
    nodes = staged(keyed.select("node", "n").distinct().join(labels, "node", "left").select("node", "n", family), "families")
    pairs = buckets.withColumnRenamed("first", "node").join(labels, "node", "left").select(family, (F.col("size") * (F.col("size") - 1.0)).alias("pairs"))
    pairs = pairs.groupBy("family").agg(F.sum("pairs").alias("pairs"))
    sizes = nodes.groupBy("family").agg(F.count("*").cast("double").alias("size"))
    dense = staged(sizes.join(pairs, "family").where(F.col("size") * (F.col("size") - 1) <= DENSE * F.col("pairs")).select("family"), "dense")
    inside = nodes.join(dense, "family")
    return inside, keyed.join(inside.select("node"), "node", "left_anti")


def tiled(inside: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components (label: node, label) that families (inside: node, n, family) hold, one each two
    components and tile."""
    order = Window.partitionBy("family").orderBy("label", "node")
    side = F.floor(F.sum(F.col("n") + LEAD).over(order) / SIDE)
    placed = staged(inside.join(label, "node").select("node", "family", "label", side.alias("side")), "sides")
    sides = placed.groupBy("family", "side").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    one = sides.select("family", F.col("side").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
    two = sides.select("family", F.col("side").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    tiles = one.join(two, "family").where((F.col("i") <= F.col("j")) & (F.least("lo_i", "lo_j") < F.greatest("hi_i", "hi_j")))
    ends = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("side"), F.lit(0).alias("role"))))
    ends = ends.otherwise(F.array(F.struct(F.col("i").alias("side"), F.lit(0).alias("role")), F.struct(F.col("j").alias("side"), F.lit(1).alias("role"))))
    tiles = staged(tiles.select("family", "i", "j", F.explode(ends).alias("o")).select("family", "i", "j", "o.side", "o.role"), "tiles")
    rows = placed.join(tiles, ["family", "side"]).join(sets, "node").select("family", "i", "j", "role", "label", "n", "h")
    return rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(_tile(percent), "a long, b long")


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not parts:
        return
    nodes, of = np.unique(np.concatenate([x for p in zip(*parts) for x in p]), return_inverse=True)
    u, v = np.split(of, 2)
    label = np.arange(len(nodes))
    while len(u):  # an edge's greater root goes to the other, then all to their roots
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]
        u, v = label[u], label[v]
        apart = u != v
        u, v = u[apart], v[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component. Edges of at most EDGE_BYTES on disk go to one task; more,
    by alternating large and small stars, written each round until all are stars: no node but a centre has two neighbours,
    and no centre has one below it."""
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if bytes_of(e) <= EDGE_BYTES:
        return staged(e.coalesce(1).mapInArrow(_connected, "node long, label long"), "labels")

    def stars() -> bool:
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("below")), F.struct(F.col("v").alias("x"), F.lit(0).alias("below")))).alias("o"))
        odd = (F.sum("o.below") > 1) | ((F.sum("o.below") > 0) & (F.min("o.below") == 0))
        return ends.groupBy("o.x").agg(odd.alias("odd")).where("odd").isEmpty()

    while not stars():
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        e = staged(star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def sized(keyed: DataFrame) -> DataFrame:
    """key, node, n of buckets of two members or more, with size and rank, a hash of the node from 0 to RANKS."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return staged(keyed.join(sizes, "key").withColumn("rank", F.shiftrightunsigned(F.xxhash64("node", F.lit(7)), 2)), "members")


def mixed(labelled: DataFrame) -> DataFrame:
    """labelled (key, node, n, size, rank, label) without buckets of one component, and p_node, p_n, p_rank, p_label of the
    bucket's member that ranks first."""
    first = [F.min_by(c, "rank").alias(f"p_{c}") for c in ("node", "n", "label")]
    of = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("rank").alias("p_rank"), *first)
    return labelled.join(of.where("lo < hi").drop("lo", "hi"), "key")


def star_pairs(live: DataFrame, pivots: int, percent: int) -> DataFrame:
    """(pivot, member), each pair once: in each bucket of live (as of mixed) its first `pivots` members (about as many) with
    those that rank behind them, lie in another component, and aren't ruled out by the sets' sizes."""
    names = ("rank", "node", "n", "label")
    pairs = live
    if pivots > 1:
        first = F.col("rank").cast("double") * F.col("size") < float(pivots) * RANKS
        pairs = live.select("key", *names).join(live.where(first).select("key", *(F.col(c).alias(f"p_{c}") for c in names)), "key")
    near = F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent
    pairs = pairs.where((F.col("p_rank") < F.col("rank")) & (F.col("label") != F.col("p_label")) & near)
    once = pairs.select(F.least("p_node", "node").alias("x"), F.greatest("p_node", "node").alias("y"), F.col("p_node").alias("pivot")).groupBy("x", "y").agg(F.min("pivot").alias("pivot"))
    return once.select("pivot", F.when(F.col("pivot") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("member"))


def grouped(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n_shingles, digest) and classes (digest, at: the least doc_id that has the set, with its text's
    hash; label: the least node of the component), both staged."""
    sk = staged(sketches(docs, shingle), "sketch")
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    of = sk.where("n_shingles > 0").groupBy("digest").agg(F.min(where).alias("at"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = staged(of.withColumn("node", F.monotonically_increasing_id()), "classes")
    at = classes.select("node", F.struct("at.doc_id", "at.th").alias("at"))
    members = sized(classes.select("node", "n", F.explode(band_keys(F.col("registers"))).alias("key")))
    # Registers are joined to pairs in each round; only those of members are needed.
    reps = staged(classes.select("node", F.col("n").alias("n_shingles"), "registers").join(members.select("node").distinct(), "node", "left_semi"), "registers")

    edges = labels = tested = None
    pivots, again = PIVOTS, True
    while True:
        own = members.withColumn("label", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        live = staged(mixed(own), "live")
        largest = live.agg(F.max("size")).first()[0]
        if largest is None:
            break
        if again and pivots > PIVOTS * GROWTH and largest > CROWD:
            # The other buckets stay, as do those of families that aren't dense; in this round all members of the small ones
            # are pivots, and tested pairs aren't made again.
            again = False
            crowd = staged(live.where(F.col("size") > CROWD).select("node", "label").distinct(), "crowd")
            rest = live.where(F.col("size") <= CROWD).select("key", "node", "n")
            keyed, sets = rare_buckets(crowd.select("node"), at, docs, shingle, percent)
            inside, other = families(keyed)
            found = staged(tiled(inside, sets, crowd, percent), "links")
            if not found.isEmpty():
                edges = found if edges is None else edges.unionByName(found)
                labels = components(edges)
            members = sized(rest.unionByName(other.select(*rest.columns)))
            continue
        pairs = star_pairs(live, pivots, percent)
        if tested is not None:
            pairs = pairs.join(tested, (F.least("pivot", "member") == F.col("x")) & (F.greatest("pivot", "member") == F.col("y")), "left_anti")
        pairs = staged(pairs, "pairs")
        if not pairs.isEmpty():
            done = pairs.select(F.least("pivot", "member").alias("x"), F.greatest("pivot", "member").alias("y"))
            tested = done if tested is None else tested.unionByName(done)
            found = staged(verified(staged(likely(pairs, reps, percent), "likely"), at, docs, shingle, percent), "links")
            if not found.isEmpty():
                edges = found if edges is None else edges.unionByName(found)
                labels = components(edges)
        if largest <= pivots:
            break
        # Buckets whose members have all been pivots are done, and a bucket of one component stays one.
        members = live.where(F.col("size") > pivots).select("key", "node", "n", "size", "rank")
        pivots *= GROWTH
    groups = classes.select("digest", "node", F.struct("at.none", "at.doc_id", "at.th").alias("at"))
    groups = groups.withColumn("label", F.col("node")) if labels is None else groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return sk, staged(groups.drop("node"), "groups")


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are maximal runs of characters other than ASCII white space, with A-Z in lower case. Documents are linked when
    100 * intersection >= percent * union of their sets; component_id is the least doc_id that can be reached. A null or
    empty text, or one without words, has an empty set and is linked with nothing. doc_id may have any type that can be
    ordered. Different texts under one doc_id are documents of their own; repeated rows share their component. A row
    without a doc_id has its component's least doc_id, or none. A very long text is taken whole. Other columns are ignored;
    an empty table gives an empty result.
    """
    sk, groups = grouped(docs, shingle, percent)
    least = groups.groupBy("label").agg(F.min("at.doc_id").alias("component"))
    nodes = staged(groups.join(least, "label").select("digest", "component"), "components")
    out = sk.select("doc_id", "n_shingles", "digest").join(nodes, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (five-word shingles, similarity 0.8) one row stays.

    That is the row of the least doc_id (rows without one come last), then of the least text hash; of repeated rows of
    this doc_id and text the one of the least hash over all its columns. Different texts under one doc_id are told
    apart. Texts without words are in no group and all stay.
    """
    sk, groups = grouped(docs, 5, 80)
    first = groups.groupBy("label").agg(F.min("at").alias("first"))
    nodes = staged(groups.join(first, "label").select("digest", "first"), "firsts")
    rows = sk.where("digest IS NOT NULL").groupBy("digest", "doc_id", "th").agg(F.count("*").alias("n")).join(nodes, "digest")
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))
    rows = rows.select("doc_id", "th", other.alias("gone"), "n").where("gone OR n > 1")
    d, t, g = (fresh(docs, x) for x in ("of_id", "of_text", "gone"))
    rows = staged(rows.select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("gone").alias(g)), "gone")
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t))
    left = docs.join(small(rows), same, "left_anti")
    again = rows.where(~F.col(g))
    if again.isEmpty():
        return left
    columns = [F.col(f"`{c}`") for c in docs.columns]
    twice = docs.join(small(staged(again, "again")), same).groupBy(d, t).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(g))
    return left.unionByName(twice.select(f"{g}.*"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT x, b FROM reached JOIN links ON y = a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least AS component_id, d.doc_id = least AS kept
FROM documents d JOIN (SELECT x, min(y) AS least FROM reached GROUP BY x) ON x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
