"""BPE as a deterministic automaton: compiled merge by merge, run by table, decoded from arc labels.

The automaton reads token sequences and accepts exactly those that BPE can produce. It starts with one state and a loop
for each base symbol. Each merge (a, b) -> ab, in order of rank, adds its gadget: the state behind a is split so that b
can't follow a any more, and wherever a then b led, an arc ab now leads to the same place. The state behind an arc depends
only on the arc's label, and arcs of labels that came from one symbol leave the same states; so the transition table is a
bit matrix of state classes by label classes. Since a prefix of a BPE encoding is the encoding of a prefix, an encoder
needs, for each position of a word, the only token that ends there and that the table allows behind the token before it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from . import unicode16
from .runtime import ship

#: Words kept with their encodings, in each worker.
CACHE_WORDS = 150_000
_HASH = 0x9E3779B97F4A7C15


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(i) if i in set(plain) else chr(next(rest)) for i in range(256)]


class Bits:
    """A growing bit matrix in which rows and columns are cloned."""

    def __init__(self):
        self.cells, self.rows, self.cols = np.zeros((64, 8), np.uint8), 1, 2
        self.cells[0, 0] = 1  # row 0: the start; column 0: every symbol; column 1: never

    def get(self, r: int, c: int) -> int:
        return (self.cells[r, c >> 3] >> (c & 7)) & 1

    def clear(self, r: int, c: int) -> None:
        self.cells[r, c >> 3] &= 255 ^ (1 << (c & 7))

    def clone_row(self, r: int, onto: int | None) -> int:
        if onto is None:
            if self.rows == len(self.cells):
                self.cells = np.concatenate([self.cells, np.zeros_like(self.cells)])
            onto, self.rows = self.rows, self.rows + 1
        self.cells[onto] = self.cells[r]
        return onto

    def clone_col(self, c: int, onto: int | None) -> int:
        if onto is None:
            if self.cols == 8 * self.cells.shape[1]:
                self.cells = np.concatenate([self.cells, np.zeros_like(self.cells)], axis=1)
            onto, self.cols = self.cols, self.cols + 1
        bit = (self.cells[: self.rows, c >> 3] >> (c & 7)) & 1
        at = self.cells[: self.rows, onto >> 3]
        at &= 255 ^ (1 << (onto & 7))
        at |= bit << (onto & 7)
        return onto


class Automaton:
    """The compiled tables: state (row) behind each token, label class (column) of each token, and the bits between."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        n = max(vocab.values()) + 1
        self.labels = [""] * n
        for t, i in vocab.items():
            self.labels[i] = t
        bits, state, label = Bits(), [0] * n, [0] * n
        states, labels = {0: n + 1}, {0: n}  # how many tokens use each class; the start state counts too
        free_rows: list[int] = []
        free_cols: list[int] = []

        def drop(uses: dict[int, int], k: int, free: list[int]) -> None:
            uses[k] -= 1
            if not uses[k]:
                free.append(k)

        for x, y in merges:
            a, b, ab = vocab[x], vocab[y], vocab[x + y]
            possible = bits.get(state[a], label[b])
            drop(states, state[ab], free_rows)
            state[ab] = state[b]
            states[state[ab]] += 1
            if not possible:
                drop(labels, label[ab], free_cols)
                label[ab] = 1
                labels[1] = labels.get(1, 0) + 1
                continue
            if a != b:
                drop(labels, label[ab], free_cols)
                label[ab] = label[a]
                labels[label[ab]] += 1
            if states[state[a]] > 1:
                new = bits.clone_row(state[a], free_rows.pop() if free_rows else None)
                states[state[a]] -= 1
                state[a], states[new] = new, 1
            if labels[label[b]] > 1:
                new = bits.clone_col(label[b], free_cols.pop() if free_cols else None)
                labels[label[b]] -= 1
                label[b], labels[new] = new, 1
            bits.clear(state[a], label[b])
            if a == b:  # a then aa can't be: the leftmost pair merges first
                drop(labels, label[ab], free_cols)
                label[ab] = label[a]
                labels[label[ab]] += 1
        self.bits = np.ascontiguousarray(bits.cells[: bits.rows, : (bits.cols + 7) // 8])
        self.state, self.label = np.array(state, np.int32), np.array(label, np.int32)
        self._arcs(vocab, suffix)

    def _arcs(self, vocab: dict[str, int], suffix: str) -> None:
        """A trie over the tokens' bytes as one open-addressed table: (node, symbol) -> node; symbol: byte, plus 256 at a word's end."""
        byte = {c: i for i, c in enumerate(byte_chars())}
        nodes: dict[tuple[int, int], int] = {}
        token_at: dict[int, int] = {}
        for t, i in vocab.items():
            if i >= len(self.labels) or not t:
                continue
            end = t.endswith(suffix) and len(t) > len(suffix)
            body = t[: -len(suffix)] if end else t
            if any(c not in byte for c in body):
                continue
            at = 0
            for k, c in enumerate(body):
                at = nodes.setdefault((at, byte[c] + 256 * (end and k == len(body) - 1)), len(nodes) + 1)
            token_at[at] = i
        self.token = np.full(len(nodes) + 1, -1, np.int32)
        for k, i in token_at.items():
            self.token[k] = i
        size = 1 << (len(nodes) * 3).bit_length()
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.keys, self.next = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        for (node, sym), to in nodes.items():
            key = node * 512 + sym
            slot = (key * _HASH % 2**64) >> int(self.shift)
            while self.keys[slot] >= 0:
                slot = (slot + 1) % size
            self.keys[slot], self.next[slot] = key, to

    def step(self, node: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """The next trie node, or -1."""
        key = node.astype(np.int64) * 512 + sym
        slot = ((key.view(np.uint64) * np.uint64(_HASH)) >> self.shift).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            got = self.keys[slot]
            hit = got == key
            out[open_[hit]] = self.next[slot[hit]]
            go = ~hit & (got >= 0)
            open_, key, slot = open_[go], key[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words end to end, and where each word's begin (one more at the end). Words aren't empty."""
        size = np.array([len(w) for w in words])
        begin = np.concatenate([[0], np.cumsum(size)])
        sym = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        sym[begin[1:] - 1] += 256
        offset = np.arange(len(sym)) - np.repeat(begin[:-1], size)
        left = np.repeat(size, size) - offset
        at, node, length = np.arange(len(sym)), np.zeros(len(sym), np.int32), 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            node = self.step(node, sym[at + length])
            alive = node >= 0
            at, node = at[alive], node[alive]
            length += 1
            token = self.token[node]
            is_token = token >= 0
            found.append((at[is_token], token[is_token], np.full(int(is_token.sum()), length)))
            more = left[at] > length
            at, node = at[more], node[more]
        start, token, length = (np.concatenate(x) for x in zip(*found))
        ends = offset[start] + length
        order = np.argsort(ends, kind="stable")
        start, token, length, ends = start[order], token[order], length[order], ends[order]
        cut = np.searchsorted(ends, np.arange(1, int(size.max()) + 2))
        last = np.full(len(sym), -1, np.int32)  # the token that ends with this symbol
        col, rows = self.label[token], self.state
        for lo, hi in zip(cut[:-1], cut[1:]):
            s, t, c = start[lo:hi], token[lo:hi], col[lo:hi]
            before = last[s - 1]
            row = np.where(offset[s] == 0, 0, rows[before])
            ok = ((self.bits[row, c >> 3] >> (c & 7).astype(np.uint8)) & 1).astype(bool)
            last[s[ok] + length[lo:hi][ok] - 1] = t[ok]
        bytes_of = self._bytes()
        head, where, ids = np.arange(len(words)), begin[1:] - 1, []
        while len(head):
            t = last[where]
            ids.append((head, t))
            where = where - bytes_of[t]
            go = where >= begin[head]
            head, where = head[go], where[go]
        count = np.bincount(np.concatenate([h for h, _ in ids]), minlength=len(words))
        stop = np.cumsum(count)
        out = np.zeros(int(stop[-1]), np.uint32)
        for k, (h, t) in enumerate(ids):
            out[stop[h] - 1 - k] = t
        return out, np.concatenate([[0], stop])

    def _bytes(self) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            self._sizes = np.array([len(t.removesuffix("</w>")) if t else 0 for t in self.labels])
        return self._sizes


class Tokenizer:
    """A tokenizer file's rules around the automaton: special strings, normalising, pre-splitting; ids and labels out.

    Takes files whose normaliser is NFC, white space to a space, lower case; whose splitter is one regular expression
    before the byte-level alphabet; and whose model is BPE with a word-end suffix.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        model = d["model"]
        kinds = [x["type"] for x in d["normalizer"]["normalizers"]], [x["type"] for x in d["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or d.get("decoder"):
            raise ValueError(f"{path}: not a tokenizer of the kind that is compiled here")
        self.suffix = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in d["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or are normalised aren't supported")
        self.pattern = d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        vocab = model["vocab"]
        self.automaton = Automaton(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], self.suffix)
        self._ready()

    def _ready(self) -> None:
        self._split = regex.compile(self.pattern)
        # Beyond these, letters and digits are as Unicode 16 has them.
        self._beyond = regex.compile("[\u0530-\U0010ffff]")
        self._careful: regex.Pattern | None = None
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._ids: dict[str, bytes] = {}
        self._labels = np.full(1 + max([len(self.automaton.labels) - 1, *self.special.values()]), "", object)
        self._labels[: len(self.automaton.labels)] = self.automaton.labels
        for content, i in self.special.items():
            self._labels[i] = content

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_split", "_beyond", "_careful", "_special", "_ids", "_labels")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def words(self, text: str) -> list[str]:
        """The pre-split words of a text; special strings among them as they are."""
        if self._special and "<" in text and len(parts := self._special.split(text)) > 1:
            return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.words(p))]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self._beyond.search(text):
                return self._carefully().findall(text.lower().translate(unicode16.LOWER))
        return self._split.findall(text.lower())

    def _carefully(self) -> regex.Pattern:
        """The splitting pattern with letters and numbers as in Unicode 16: those of 15.1 that the interpreter has, and the
        additions of the table; what newer data of the regular expressions hold besides counts as a symbol."""
        if self._careful is None:
            kinds = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0x530, 0xD800), *range(0xE000, 0x110000)])))
            known = {c for a, b in (*unicode16.LETTERS, *unicode16.NUMBERS) for c in range(a, b + 1)}
            new = "".join(regex.escape(c) for c in kinds if unicodedata.category(c)[0] not in "LN" and ord(c) not in known)
            letters, numbers = unicode16.in_class(unicode16.LETTERS), unicode16.in_class(unicode16.NUMBERS)
            less = f"--[{new}]" if new else ""
            wide = {"L": rf"[[\p{{L}}{letters}]{less}]", "N": rf"[[\p{{N}}{numbers}]{less}]"}
            other = rf"[[^\s]--{wide['L']}--{wide['N']}]"
            narrow = self.pattern.replace(r"[^\s\p{L}\p{N}]", other).replace(r"[\p{L}]", wide["L"]).replace(r"[\p{N}]", wide["N"])
            self._careful = regex.compile(narrow, regex.V1)
        return self._careful

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids (unsigned 32-bit, little-endian)."""
        split = [self.words(t) for t in texts]
        new = list(set().union(*split) - self._ids.keys())
        if len(self._ids) + len(new) > CACHE_WORDS:
            self._ids.clear()
            new = list(set().union(*split))
        plain = [w for w in new if w not in self.special]
        for w in new:
            if w in self.special:
                self._ids[w] = self.special[w].to_bytes(4, "little")
        if plain:
            ids, begin = self.automaton.encode([w.encode("utf-8", "surrogatepass") for w in plain])
            raw, begin = ids.astype("<u4").tobytes(), begin.tolist()
            for k, w in enumerate(plain):
                self._ids[w] = raw[4 * begin[k] : 4 * begin[k + 1]]
        for words in split:
            yield b"".join(map(self._ids.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encoded([text])), "<u4").tolist()

    def decode(self, ids: bytes | list[int]) -> str:
        """The arc labels in order, joined by a space; ids as encoded gives them, or a list."""
        at = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.array(ids, np.int64)
        return " ".join(self._labels[at].tolist())


@lru_cache(2)
def compiled(path: str) -> Tokenizer:
    return Tokenizer(path)


def _run(shared, ids_digest: bool, text_digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        for batch in batches:
            texts = tv.filled(batch.column("text"))
            for at, to in tv.slices(texts):
                ids = list(tokenizer.encoded(texts.slice(at, to - at).to_pylist()))
                labels = map(tokenizer.decode, ids)
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                first = pa.array([hashlib.sha256(x).hexdigest() for x in ids]) if ids_digest else pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
                second = pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() if text_digest else x for x in labels], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), n, first, second], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, path: str, ids_digest: bool = False, text_digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of each row of docs (doc_id, text), or SHA-256 digests of those in hex.

    A null or empty text has no tokens and decodes to an empty one; a very long text is taken whole. Rows aren't matched with one another, so repeated rows and
    ids just give a row each; other columns are ignored; an empty table gives an empty result. path: a tokenizer file
    on the driver. What is broadcast is the compiled table, whose size the vocabulary bounds, not the data.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(compiled(path))
    kind = dict(docs.dtypes)["doc_id"]
    ids = "string" if ids_digest else "array<int>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_run(shared, ids_digest, text_digest), f"doc_id {kind}, n_tokens long, ids {ids}, decoded string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, n_tokens, ids, and the digest of the decoded text."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), text_digest=True).withColumnRenamed("decoded", "decoded_sha256")
