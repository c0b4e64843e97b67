"""The pipeline against a brute-force version of all its stages."""

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lexigraph.llm import line_dedup, quality_rules

from .helpers import components, no_docs, odd_docs, overlaps


def test_against_brute_force(spark, sf):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text, lang, source FROM '{sf}/documents.parquet'").df()
    con.register("documents", docs)
    kept = con.execute(f"SELECT doc_id FROM ({quality_rules.ORACLE_SQL}) WHERE kept").df()
    con.unregister("documents")
    con.register("documents", docs.merge(kept, on="doc_id"))
    lines = con.execute(f"SELECT doc_id, text FROM ({line_dedup.ORACLE_SQL})").fetchall()
    tops, _ = components(lines, 5)
    items = [t for (t,) in con.execute(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    left = {d: t for d, t in lines if tops[d] == d and not any(overlaps(t, b) for b in items)}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {d: t.encode(x, add_special_tokens=False).ids for d, x in left.items()}
    assert 0 < len(left) < len(docs)


def test_stages_keep_columns(spark, sf):
    for docs in (odd_docs(spark), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "tokens"]


def test_run_on_odd_and_empty_tables(spark, sf, tmp_path):
    """The whole pipeline over nulls, repeated rows, ties and clashing names, and over no rows."""
    for name, docs in (("odd", odd_docs(spark)), ("none", no_docs(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted(r.doc_id for r in rows) == ([4, 5] if name == "odd" else [])
        assert all(r.n_tokens == len(r.ids) > 0 for r in rows)
