import random

from lexigraph.llm import decontamination as dc
from lexigraph.llm import queries

from .helpers import no_docs, odd_docs, overlaps

ITEM = "item_id long, text string"


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, sf).collect()}
    assert got == {(d, i) for d, t in docs for i, b in items if overlaps(t, b)} and got


def test_substitutions(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**5)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 18, 30, 6, 4, 60])]
    docs = []
    for i, t in items:
        for k in (0, 1, 2, 3):
            w = t.split()
            for p in rng.sample(range(len(w)), k * len(w) // 20):
                w[p] = word()
            docs.append((10 * i + k, " ".join([word() for _ in range(50)] + [x.upper() + "," for x in w] + [word() for _ in range(9)])))
    docs += [(900, " ".join(word() for _ in range(300))), (901, None), (902, "")]
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)).collect()}
    want = {(d, i) for d, t in docs if t for i, b in items if overlaps(t, b)}
    assert got == want and {(10 * i, i) for i in (0, 1, 2, 3, 5)} <= got and not any(i == 4 for _, i in got)


def test_join_gives_the_same(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    short = spark.createDataFrame([(900, "Ends here"), (901, "the and attion to thanedble other")], ITEM)
    bench = bench.unionByName(short)
    one = sorted(map(tuple, dc.contaminated(docs, bench).collect()))
    clean = sorted(map(tuple, dc.decontaminated(docs, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_WORDS", 1500)
    assert dc.block(bench) is None
    assert sorted(map(tuple, dc.contaminated(docs, bench).collect())) == one and len({r[1] for r in one}) > 3
    assert sorted(map(tuple, dc.decontaminated(docs, bench).collect())) == clean and len(clean) == docs.count() - len({r[0] for r in one})
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and then it runs far " * 300), (1, "quick brown fox jumps over the lazy dog and then it runs far"), (1, "quick brown fox jumps over the lazy dog and then it runs far")], ITEM)
    got = sorted((r.doc_id or -1) for r in dc.contaminated(docs, items).collect())
    left = dc.decontaminated(docs, items)
    assert set(got) == {-1, 5, 6, 7} and left.columns == docs.columns and left.count() == 8


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and then it runs far"), (2, None), (3, "")], ITEM)
    docs = odd_docs(spark)
    assert sorted((r.doc_id or -1) for r in dc.contaminated(docs, items).collect()) == [-1, 5, 5, 6, 7]
    left = dc.decontaminated(docs, items)
    assert left.columns == docs.columns and left.count() == 8
    assert dc.contaminated(no_docs(spark), items).count() == 0 and dc.decontaminated(docs, items.where("false")).count() == 13
    assert dc.contaminated(docs, items.where("false")).count() == 0
