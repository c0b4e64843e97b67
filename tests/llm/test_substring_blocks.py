"""Repeated passages of short lines and sentences: blocks of neighbours."""

import re

from lexigraph.llm import substring_dedup as sd

VERSE = [f"line {a} of the {b}" for a, b in zip("one two three four five six seven eight nine ten eleven twelve".split(), "sea sky sun fog oak ash elm fir bay cove reef isle".split())]
LONG = "and one sentence among the others that is long enough to be a unit of its own."


def left(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: r.text for r in sd.removed(df, sd.repeats(df)).collect()}


def test_short_lines_go(spark):
    verse = "\n".join(VERSE)
    assert len(verse.split()) > 50 and max(len(x.split()) for x in VERSE) < sd.LEAST_WORDS
    out = left(spark, [(1, f"first of all\n{verse}\nends here"), (2, f"some other words to begin\nmore\n{verse}\nlast")])
    assert verse in out[1] and out[2].split() == "some other words to begin more last".split()


def test_short_sentences_within_a_line_go(spark):
    passage = ". ".join(VERSE) + f". {LONG} Then it ends. "
    out = left(spark, [(1, f"Own start here. {passage}Tail of one."), (2, f"Another thing. And so. {passage}Other tail of two.")])
    assert passage in out[1] and out[2].split() == "Another thing. And so. Other tail of two.".split()


def test_a_passage_set_in_other_lines(spark):
    out = left(spark, [(1, "\n".join(VERSE)), (2, ". ".join(VERSE) + ".")])
    assert out[1] == "\n".join(VERSE) and not re.search(r"\w", out[2])


def test_short_lines_by_chance_stay(spark):
    docs = [(1, "see also\nown words of the first text\nthanks"), (2, "see also\nthe second says other things\nthanks")]
    assert left(spark, docs) == dict(docs)


def test_a_repeating_text_keeps_a_first_block(spark):
    out = left(spark, [(1, "one two three\n" * 40), (2, "ha ha ha. " * 3)])
    assert len(out[1].split()) >= sd.LEAST_WORDS and out[2] == "ha ha ha. " * 3


def test_every_word_keeps_a_copy(spark):
    pieces = [f"{w} {v}" for w in ("red", "green", "blue") for v in ("a", "b", "c")]
    docs = [(i, "\n".join(pieces[(i * k + k * k) % 9] for k in range(60))) for i in range(20)]
    before = {w for _, t in docs for w in t.split()}
    assert {w for t in left(spark, docs).values() for w in t.split()} == before
