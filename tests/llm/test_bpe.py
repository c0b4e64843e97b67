import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexigraph.llm import bpe, queries

from .helpers import LONG, no_docs, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(library, texts):
    own = bpe.compiled(PATH)
    for text, ids, want in zip(texts, own.encoded(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids == b"".join(i.to_bytes(4, "little") for i in want.ids), text
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == own.decode(want.ids)


def test_special_cases(library):
    check(library, ["", " ", "aaaa aaa aa " + "a" * 50, "<|startoftext|>hi<|endoftext|> <|endoftext|", "ΣΑΣ İI ǅ", "é <|endoftext|>́x", "don't I'll we'Ve 'S", "\x1c\x1d\x85᠎​﻿ a", "x" * 3000, "!?!?!!!....????", "12345 ½ ²", LONG[:20000], "՘₝"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_latin_texts(texts):
    check(Tokenizer.from_file(PATH), texts)


def test_every_code_point_newer_than_the_interpreter(library):
    """Each between letters, between digits and twice in a row; of older ones those whose class could be mistaken."""
    new = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn"]
    some = [c for k, c in enumerate(new) if regex.match(r"\P{Cn}", c) or k % 97 == 0]
    check(library, ["\u0530".join(f"a{c}a 1{c}1 {c}{c}" for c in some[k : k + 200]) for k in range(0, len(some), 200)])


def test_every_letter_and_mark(library):
    old = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]) if unicodedata.category(c) not in ("Cn", "Co") and not "\uac00" < c < "\ud7a3" and not "\u4e00" < c < "\u9fff"]
    check(library, ["x".join(f"a{c}a 1{c}1" for c in old[k : k + 500]) for k in range(0, len(old), 500)])


def test_random_merges(library):
    rng = random.Random(2)
    check(library, ["".join(rng.choice(["a", "b", "e", "th", "in", "ing", "!", ".", "_", "-", "ou"]) for _ in range(rng.randrange(1, 60))) for _ in range(3000)])


def test_small_automaton():
    """By hand: merges aa, ab, aab; only what BPE can produce is accepted."""
    vocab = {"a": 0, "b": 1, "a</w>": 2, "b</w>": 3, "aa": 4, "ab": 5, "aaab": 6}
    m = bpe.Automaton(vocab, [("a", "a"), ("a", "b"), ("aa", "ab")], "</w>")
    allowed = lambda x, y: bool((m.bits[m.state[vocab[x]], m.label[vocab[y]] >> 3] >> (m.label[vocab[y]] & 7)) & 1)
    assert not allowed("a", "a") and allowed("aa", "a") and not allowed("a", "aa") and not allowed("a", "b") and allowed("b", "a") and not allowed("aa", "ab")
    ids, begin = m.encode([b"aaaab", b"ba", b"aaaba"])
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [[4, 4, 3], [1, 2], [6, 2]]


def test_query(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, library):
    rows = bpe.encode_documents(odd_docs(spark), PATH).collect()
    assert len(rows) == 13 and all(r.ids == library.encode("", add_special_tokens=False).ids == [] and r.decoded == "" for r in rows if r.doc_id in (1, 2, 3))
    assert bpe.encode_documents(no_docs(spark), PATH).count() == 0


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
