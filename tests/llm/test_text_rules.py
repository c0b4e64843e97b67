"""Quality rules and line dedup against their SQL, on odd rows too."""

import pandas as pd
import pytest

from lexigraph.llm import line_dedup, quality_rules, queries

from ..conftest import same_as_sql
from .helpers import no_docs, odd_docs


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(name, spark, sf, duck):
    same_as_sql(queries.QUERIES[name](spark, sf), duck, queries.ORACLE_SQL[name])


def fixture(spark, rows):
    import duckdb

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), con


def test_rules_on_odd_rows(spark):
    rows = [r[:4] for r in map(tuple, odd_docs(spark).collect()) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(100, "a b c d e f g h i " * 30, "en", "a"), (101, "a b c d e f g h\nx\n" * 3 + "\x0b\x0c\r", "en", None)]
    df, con = fixture(spark, rows)
    same_as_sql(quality_rules.quality_rules(df), con, quality_rules.ORACLE_SQL)
    assert quality_rules.quality_rules(odd_docs(spark)).count() == 13
    assert quality_rules.quality_rules(no_docs(spark)).count() == 0


def test_thresholds_adapt(spark):
    plain = " ".join(["word"] + [f"w{i}" for i in range(30)])
    noisy = " ".join(f"w{i}#" if i % 2 else f"w{i}" for i in range(30))
    loud = " ".join(f"w{i}###" for i in range(30))
    rows = [(i, plain, "en", "prose") for i in range(300)] + [(1000 + i, noisy, "en", "code") for i in range(300)] + [(5000, noisy, "en", "prose"), (5001, noisy, "en", "code"), (5002, loud, "en", "code")]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept[0] and kept[1000] and not kept[5000] and kept[5001] and not kept[5002]


def test_limits_come_from_the_sketches(spark):
    """On rows of eight sources no constant cutoff gives the verdicts: a rate that is normal in one fails in another; a
    source of few texts is judged mostly as its language is."""
    text = lambda i, k: " ".join(f"w{i % 7}x{j}" + "#" * (j < k) for j in range(60))
    rows = [(100 * s + i, text(i, 4 * s + i % 3), "en", f"s{s}") for s in range(8) for i in range(90)]
    rows += [(9000 + 100 * s + k, text(1, k), "en", f"s{s}") for s in range(8) for k in range(0, 61, 4)] + [(9900 + k, text(1, k), "en", "few") for k in (0, 60)]
    df, con = fixture(spark, rows)
    same_as_sql(quality_rules.quality_rules(df), con, quality_rules.ORACLE_SQL)
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert len({got[9000 + 100 * s].limit_symbols for s in range(8)}) >= 6
    verdicts = {(r.n_symbols, r.kept) for d, r in got.items() if 9000 <= d < 9900}
    both = [n for n, kept in verdicts if (n, not kept) in verdicts]
    assert len(both) >= 4  # the same text, other verdicts
    assert got[9900].kept and got[9900].limit_symbols > 0


def test_limits_differ_by_group(spark):
    """On the small table too each language and source has a limit of its own."""
    rows = quality_rules.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert len({r.limit_capitals for r in rows}) > 5


def test_sketches_merge(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    measured = docs.select("lang", "source", quality_rules.measures(docs.text).alias("m")).cache()
    whole = quality_rules.merged(quality_rules.sketch(measured, "m"))
    halves = quality_rules.sketch(measured.where("source < 'src2'"), "m").unionByName(quality_rules.sketch(measured.where("source >= 'src2'"), "m"))
    assert sorted(whole.collect()) == sorted(quality_rules.merged(halves).collect())


def test_rules_stage(spark):
    docs = odd_docs(spark)
    out = quality_rules.stage(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {None, 4, 5, 6, 7}
    assert quality_rules.stage(spark, no_docs(spark), "").count() == 0


def boiler(n):
    own = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{c}" for c in "qwertyuiopasdfghjkl")
    rows = [(i, f"{own(i)}\nPosted by user{i} on page {i * 7} of the board\n{own(i + 500)} again", "en", "s") for i in range(n)]
    return rows + [(900, "Posted by userX7 on page 5 of the board\nonly here is this line of text", "en", "s"), (901, None, "en", "s"), (902, "", "en", "s")]


def test_templates_with_fields(spark):
    df, con = fixture(spark, boiler(30))
    same_as_sql(line_dedup.line_dedup(df), con, line_dedup.ORACLE_SQL)
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert got[3].dropped == "1" and "Posted" not in got[3].text and got[3].text.count("\n") == 1
    assert got[900].text == "only here is this line of text" and got[901].text is None and got[902].text == ""
    few = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(fixture(spark, boiler(8))[0]).collect()}
    assert set(few.values()) == {0}


def test_copies_make_nothing_recur(spark):
    df, _ = fixture(spark, [(i, "a line that is copied\nwith another line below", "en", "s") for i in range(50)])
    assert line_dedup.line_dedup(df).where("n_dropped > 0").count() == 0


def test_near_copies_keep_their_bodies(spark):
    """Twenty texts that share four of five lines have no carriers of these; the boilerplate among them still goes."""
    body = "\n".join(" ".join(f"{a}{b}" for b in "qwertyuiop") for a in "abcd")
    rows = boiler(30) + [(1000 + i, f"{body}\nPosted by user{i} on page 3 of the board\nan end {chr(97 + i)} that no other of the copies has", "en", "s") for i in range(20)]
    df, con = fixture(spark, rows)
    same_as_sql(line_dedup.line_dedup(df), con, line_dedup.ORACLE_SQL)
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert got[1003].dropped == "4" and got[1003].text.startswith(body)


def test_variants_within_one_text_are_one(spark):
    """Twelve lines of one template, and of twelve first tokens that hold digits, in one text: neither recurs."""
    lines = "\n".join(f"item number {i} was seen over here" for i in range(12)) + "\n" + "\n".join(f"{i} some of the {chr(97 + i)} things" for i in range(12))
    df, con = fixture(spark, [(1, lines, "en", "s"), *((i, f"item number {i} was\n{i} other of {i}", "en", "s") for i in range(2, 20))])
    same_as_sql(line_dedup.line_dedup(df), con, line_dedup.ORACLE_SQL)
    assert [r.n_dropped for r in line_dedup.line_dedup(df).where("doc_id = 1").collect()] == [0]


def test_line_stage(spark):
    docs = odd_docs(spark)
    out = line_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 13 and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert line_dedup.stage(spark, no_docs(spark), "").count() == 0 and line_dedup.line_dedup(no_docs(spark)).count() == 0
