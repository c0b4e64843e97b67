"""Tokens: splitting, normalising, stemming, stop words, and the hash of the text exports."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from string import ascii_letters, digits

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..storage import ship

#: Tested after stemming, so some inflected forms pass and some stems are dropped (quirk 2).
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: Neither ASCII letter, digit nor white space. Spelt out, the class is one bit set in the JVM; as ranges it is a chain of
#: predicates whose type checks contend between an executor's threads (2 s of 25 MB on one thread, 3 s on eight; now 0.1 s).
_OTHER = f"[^{ascii_letters}{digits} \\t\\n\\x0b\\f\\r]+"
_VOWELS = frozenset("aeiou")


class _Stem:
    """Porter's algorithm over b[0..k], in the variant with bli -> ble and logi -> log; digits count as consonants."""

    def __init__(self, word: str):
        self.b, self.j = word, 0

    def consonant(self, i: int) -> bool:
        c = self.b[i]
        if c in _VOWELS:
            return False
        return c != "y" or i == 0 or not self.consonant(i - 1)

    def measure(self) -> int:
        """Vowel-consonant sequences in b[0..j]."""
        kinds = [self.consonant(i) for i in range(self.j + 1)]
        return sum(not a and b for a, b in zip(kinds, kinds[1:]))

    def vowel_in_stem(self) -> bool:
        return any(not self.consonant(i) for i in range(self.j + 1))

    def double(self, i: int) -> bool:
        return i >= 1 and self.b[i] == self.b[i - 1] and self.consonant(i)

    def cvc(self, i: int) -> bool:
        return i >= 2 and self.consonant(i) and not self.consonant(i - 1) and self.consonant(i - 2) and self.b[i] not in "wxy"

    def ends(self, s: str) -> bool:
        if len(s) > len(self.b) or not self.b.endswith(s):
            return False
        self.j = len(self.b) - len(s) - 1
        return True

    def to(self, s: str) -> None:
        self.b = self.b[: self.j + 1] + s

    def first_rule(self, rules: tuple[tuple[str, str], ...]) -> None:
        for suffix, new in rules:
            if self.ends(suffix):
                if self.measure() > 0:
                    self.to(new)
                return

    def run(self) -> str:
        if len(self.b) <= 2:
            return self.b
        self.plurals()
        if len(self.b) > 1 and self.ends("y") and self.vowel_in_stem():
            self.b = self.b[:-1] + "i"
        for by_letter, at in ((_DOUBLE, -2), (_FULL, -1)):
            if len(self.b) > 1:
                self.first_rule(by_letter.get(self.b[at], ()))
        self.drop()
        self.last()
        return self.b

    def plurals(self) -> None:
        if self.b.endswith("s"):
            if self.ends("sses") or self.ends("ies"):
                self.b = self.b[:-2]
            elif self.b[-2:-1] != "s":
                self.b = self.b[:-1]
        if self.ends("eed"):
            if self.measure() > 0:
                self.b = self.b[:-1]
        elif (self.ends("ed") or self.ends("ing")) and self.vowel_in_stem():
            self.b = self.b[: self.j + 1]
            if self.ends("at") or self.ends("bl") or self.ends("iz"):
                self.j = len(self.b) - 1
                self.to("e")
            elif self.double(len(self.b) - 1):
                if self.b[-1] not in "lsz":
                    self.b = self.b[:-1]
            elif self.measure() == 1 and self.cvc(len(self.b) - 1):
                self.j = len(self.b) - 1
                self.to("e")

    def drop(self) -> None:
        if len(self.b) < 2:
            return
        for suffix in _DROP.get(self.b[-2], ()):
            if self.ends(suffix) and (suffix != "ion" or (self.j >= 0 and self.b[self.j] in "st")):
                if self.measure() > 1:
                    self.b = self.b[: self.j + 1]
                return

    def last(self) -> None:
        self.j = len(self.b) - 1
        if self.b[-1:] == "e":
            m = self.measure()
            if m > 1 or (m == 1 and not self.cvc(len(self.b) - 2)):
                self.b = self.b[:-1]
        if self.b[-1:] == "l" and self.double(len(self.b) - 1) and self.measure_upto() > 1:
            self.b = self.b[:-1]

    def measure_upto(self) -> int:
        """measure with j from before the final e went, as far as b reaches."""
        j, self.j = self.j, min(self.j, len(self.b) - 1)
        m = self.measure()
        self.j = j
        return m


_DOUBLE = {
    "a": (("ational", "ate"), ("tional", "tion")), "c": (("enci", "ence"), ("anci", "ance")), "e": (("izer", "ize"),),
    "l": (("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous")), "o": (("ization", "ize"), ("ation", "ate"), ("ator", "ate")),
    "s": (("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous")), "t": (("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), "g": (("logi", "log"),),
}
_FULL = {"e": (("icate", "ic"), ("ative", ""), ("alize", "al")), "i": (("iciti", "ic"),), "l": (("ical", "ic"), ("ful", "")), "s": (("ness", ""),)}
_DROP = {
    "a": ("al",), "c": ("ance", "ence"), "e": ("er",), "i": ("ic",), "l": ("able", "ible"), "n": ("ant", "ement", "ment", "ent"), "o": ("ion", "ou"),
    "s": ("ism",), "t": ("ate", "iti"), "u": ("ous",), "v": ("ive",), "z": ("ize",),
}


@lru_cache(200_000)
def porter_stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two characters stay."""
    return _Stem(word).run()


#: Lists whose words are stemmed together; what a Python worker holds beyond an Arrow batch doesn't grow with the batch.
LISTS = 1000


def _stems(words: pa.Array) -> pa.Array:
    """Only the distinct words become Python strings."""
    coded = words.dictionary_encode()
    return pa.array([porter_stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def _stem_lists(lists: pa.Array) -> pa.Array:
    parts = [lists[k : k + LISTS] for k in range(0, len(lists), LISTS)]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    stems = pa.concat_arrays([_stems(x.flatten().cast(pa.string())) for x in parts] or [pa.array([], pa.string())])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), stems, mask=lists.is_null())


_stem_udf = F.arrow_udf(_stems, StringType())
_stem_lists_udf = F.arrow_udf(_stem_lists, ArrayType(StringType()))


def stem(words: Column | str) -> Column:
    """porter_stem of each distinct word of an Arrow batch; null stays null."""
    ship(SparkSession.active())
    return _stem_udf(words)


def cleaned_tokens(text: Column | str) -> Column:
    """The list of a text's tokens, normalised but not stemmed. One pass over the text instead of one a token: what
    isn't a letter, digit or white space goes, then lower case, then the split."""
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.lower(F.regexp_replace(text, _OTHER, "")), r"\s+")


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(items: Column) -> Column:
    """The distinct items of a list and how often each is in it, as structs (stem, n), by a sort of the list: no rows are
    moved to count them."""
    last = lambda s: F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i > 0) & ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
    runs = lambda s, ends: F.transform(ends, lambda e, k: F.struct(F.get(s, e - 1).alias("stem"), (e - F.coalesce(F.get(ends, k - 1), F.lit(0))).cast("long").alias("n")))
    return _bind(F.sort_array(items), lambda s: _bind(last(s), lambda ends: runs(s, ends)))


def distinct_terms(text: Column | str, stemmed: bool = True) -> Column:
    """The distinct telling terms of a text, as a list: no rows are moved to find them."""
    terms = F.array_distinct(cleaned_tokens(text))
    if stemmed:
        ship(SparkSession.active())
        terms = F.array_distinct(_stem_lists_udf(F.array_remove(terms, "")))
    return F.array_except(terms, F.array(*(F.lit(w) for w in ("", *STOP_WORDS))))


def normalised(token: Column, stemmed: bool = True) -> Column:
    """A token without characters other than ASCII letters and digits, in lower case, stemmed."""
    t = F.lower(F.regexp_replace(token, _OTHER.replace(" \\t\\n\\x0b\\f\\r", ""), ""))
    return stem(t) if stemmed else t


def telling(token: Column) -> Column:
    """Neither empty nor a stop word."""
    return (token != "") & ~token.isin(*STOP_WORDS)


def term_lists(text: Column | str, stemmed: bool = True) -> Column:
    """The list of a text's tokens, stemmed a list at a time: each distinct word of an Arrow batch once."""
    tokens = cleaned_tokens(text)
    if stemmed:
        ship(SparkSession.active())
        return _stem_lists_udf(F.array_remove(tokens, ""))
    return tokens


def tokenize(tweets: DataFrame, stemmed: bool = True) -> DataFrame:
    """tweets (text and keys) -> a row a token: the keys, stem (T1: split, normalise, stem, then filter)."""
    keys = [c for c in tweets.columns if c != "text"]
    tokens = tweets.select(*keys, F.explode(term_lists("text", stemmed)).alias("stem"))
    return tokens.where(telling(F.col("stem")))


def clean_text(text: Column) -> Column:
    """Without quotes, apostrophes, line breaks and tabs."""
    return F.translate(text, "\"'\n\t", "")


def one_line(text: Column) -> Column:
    """Line breaks and tabs as spaces."""
    return F.translate(text, "\n\r\t", "   ")


def string_hash(s: Column) -> Column:
    """The 32-bit signed string hash of the text exports: 31 h + c over UTF-16 units (F15; text of the basic plane)."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(4294967295)))
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h).cast("int")


#: Characters that the exports' partitions are hashed from, at most.
_HASHED = 5


def _short_hash(s: Column) -> Column:
    """string_hash of up to _HASHED characters without a walk over a list: it is taken of every row of an index."""
    size = F.length(s)
    h = sum((F.when(size > k, F.ascii(F.substr(s, size - k, F.lit(1))).cast("long") * 31**k).otherwise(0) for k in range(_HASHED)), F.lit(0).cast("long"))
    h = h.bitwiseAND(F.lit(4294967295))
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h).cast("int")


def index_partition(word: Column, n: int = 1000) -> Column:
    """Partition of a word in the index export: of its last 6 characters but one if longer than 5."""
    part = F.when(F.length(word) > 5, F.substr(word, F.length(word) - 5, F.lit(5))).otherwise(word)
    return (_short_hash(part) % n).cast("int")


def text_partition(tid: Column, n: int = 1000) -> Column:
    """Partition of an id in the text export: of its first 5 characters."""
    s = tid.cast("string")
    return (_short_hash(F.when(F.length(s) > 5, F.substr(s, F.lit(1), F.lit(5))).otherwise(s)) % n).cast("int")


def part_name(partition: Column) -> Column:
    """part-r-00042."""
    return F.concat(F.lit("part-r-"), F.lpad(partition.cast("string"), 5, "0"))
