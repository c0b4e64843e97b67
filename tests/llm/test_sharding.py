import random
import zlib
from collections import Counter, defaultdict

from lexigraph.llm import queries, sharding

from .helpers import no_docs, odd_docs


def laws(rows, texts, slack):
    size, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None for r in rows)
    if slack is not None:
        share = sum(size.values()) / 8
        assert all(abs(size[k] - share) <= slack + 0.01 * share for k in range(8)), size


def test_query(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op7_sharding(spark, sf).collect()
    laws(rows, texts, max(len(t.encode()) for _, t in texts))


def test_a_third_of_all_rows_is_one_text(spark):
    rng = random.Random(1)
    texts = [(i, "hot text " * 20) for i in range(3000)] + [(i, "x" * rng.randrange(1, 400) + str(i)) for i in range(3000, 9000)]
    laws(sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts, 400)


def test_many_rows_in_a_bin(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BIN_ROWS", 5)
    texts = [(i, f"t{i % 50}") for i in range(2000)]
    laws(sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts, 20)


def test_splitters_against_brute_force(spark):
    """Each splitter is within the tolerance of its target, or at an end of the one row that is in the way."""
    rng = random.Random(2)
    for texts in ([(i, "a" * rng.randrange(60)) for i in range(3000)], [(i, "hot " * 9 if i % 3 else f"t{i}") for i in range(3000)], [(i, "x" * 10 ** (i % 6)) for i in range(60)], [(1, "one")]):
        rows = sharding.sized(spark.createDataFrame(texts, "doc_id long, text string")).cache()
        keys = sorted((r.th << 60 | r.dh, r.size) for r in rows.collect())
        total = sum(n for _, n in keys)
        found = sharding.splitters(rows)
        assert [s.at for s in found] == sorted(s.at for s in found)
        for k, s in enumerate(found, 1):
            below = sum(n for key, n in keys if key < s.at)
            ends = [sum(n for _, n in keys[:j]) for j in range(len(keys) + 1)]
            one = Counter()
            for key, n in keys:
                one[key >> 60] += n
            torn = [n for n in one.values() if n <= sharding.TORN * total / 8]
            assert s.found == below and s.target == -(-total * k // 8)
            assert abs(below - s.target) <= max(sharding.TOLERANCE * total / 8, min(abs(e - s.target) for e in ends), max(torn, default=0) / 2)
        got = {(r.th << 60 | r.dh): r.shard for r in rows.withColumn("shard", sharding.shard_of(found)).collect()}
        assert got == {key: sum(key >= s.at for s in found) for key, _ in keys}


def test_equal_texts_stay_together(spark):
    texts = [(i, f"text {i // 4} " * 5) for i in range(4000)]
    by = defaultdict(set)
    of = dict(texts)
    for r in sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        by[of[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by.values())


def test_odd_rows(spark):
    docs = odd_docs(spark)
    laws(sharding.shard_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], None)
    assert sharding.shard_documents(no_docs(spark)).count() == 0


def test_written_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").select(docs.columns).exceptAll(docs).count() == 0
