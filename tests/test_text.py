import pytest
from pyspark.sql import functions as F

from lexigraph.functions import text as tx

GOLDEN = dict(p.split(":") for p in "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre disabled:disabl matting:mat mating:mate meetings:meet relational:relat conditional:condit hopeful:hope goodness:good adjustment:adjust adoption:adopt controll:control running:run happy:happi generalizations:gener 2014s:2014 ion:ion aed:a being:be willing:will this:thi was:wa are:ar they:thei ins:in".split())


@pytest.mark.parametrize("word", GOLDEN)
def test_stem(word):
    assert tx.porter_stem(word) == GOLDEN[word]


def test_tokenize(spark):
    df = spark.createDataFrame([(1, 10, "  This was\tthe being, http://t.co/Ab RUNNING é!  runs")], "uid long, tid long, text string")
    assert sorted(r.stem for r in tx.tokenize(df).collect()) == ["httptcoab", "run", "run", "thi", "wa"]
    assert sorted(r.stem for r in tx.tokenize(df, stemmed=False).collect()) == ["being", "httptcoab", "running", "runs"]


def test_distinct_terms(spark):
    df = spark.createDataFrame([("Runs running the",), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(tx.distinct_terms("text")).collect()]
    assert got == [["run"], [], None]


def test_cleaning_and_hash(spark):
    r = spark.range(1).select(tx.clean_text(F.lit("a\"b'c\nd\te")), tx.one_line(F.lit("a\nb\rc\td")), tx.string_hash(F.lit("hello")), tx.string_hash(F.lit("zzzzzz")), tx.index_partition(F.lit("abcdefg")), tx.text_partition(F.lit(1234567)), tx.part_name(F.lit(42))).first()
    h = lambda s: __import__("functools").reduce(lambda a, c: (a * 31 + ord(c)) & 0xFFFFFFFF, s, 0)
    assert tuple(r) == ("abcde", "a b c d", 99162322, h("zzzzzz") - (2**32 if h("zzzzzz") >= 2**31 else 0), h("bcdef") % 1000, h("12345") % 1000, "part-r-00042")
