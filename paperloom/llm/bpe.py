"""Byte-level BPE with word ends, encoded through a segment tree.

The leaves of the tree hold, for each symbol and its right neighbour, the rank
of their merge and the place; inner nodes hold the minimum. The root is thus
the leftmost of the merges of lowest rank. A merge changes three leaves, each
in logarithmic time, until the root says that no pair can be merged.

The vocabulary is a file of the tokenizers library, found by name among the
public tokenizers or given as a path; nothing is trained. Results equal those
of the library with ``add_special_tokens=False``: its special tokens in a text
become their ids, everything else is normalised (NFC, white space to one
space, lower case), split into words and merged. Without a decoder in the
file, decoding joins the tokens by spaces.

Distribution: a narrow pass in Arrow batches; each worker keeps a bounded
table of encoded words, so a repeated word costs a lookup.

Defined cases: a null or empty text has no tokens and decodes to nothing; rows
are encoded alone, so ties, repeated rows and clashing column names change
nothing; a long unbroken word costs n log n; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, texts_of

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker keeps before it starts anew, and the longest kept.
KEPT_WORDS, KEPT_LENGTH = 400_000, 40
#: Texts that a worker encodes before it passes them on.
TEXTS = 128
#: White space by the Unicode property.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it is
    printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTree:
    """Segment tree over adjacent pair ranks of a list of symbols."""

    NONE = 1 << 62

    def __init__(self, symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]):
        n = len(symbols)
        self.symbols, self.ranks = symbols, ranks
        self.right, self.left = [*range(1, n), -1], [-1, *range(n - 1)]
        self.base = base = 1 << max(n - 1, 1).bit_length()
        self.tree = tree = [self.NONE] * (2 * base)
        get = ranks.get
        for i in range(n - 1):
            found = get((symbols[i], symbols[i + 1]))
            if found:
                tree[base + i] = found[0] << 32 | i
        for i in range(base - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def put(self, i: int, value: int) -> None:
        tree, i = self.tree, i + self.base
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            value = value if value < other else other
            i >>= 1
            if tree[i] == value:
                return
            tree[i] = value

    def rank(self, i: int) -> int:
        j = self.right[i]
        found = self.ranks.get((self.symbols[i], self.symbols[j])) if j >= 0 else None
        return found[0] << 32 | i if found else self.NONE

    def run(self) -> list[int]:
        """Merge until nothing can be merged; the symbols that are left."""
        symbols, left, right, tree = self.symbols, self.left, self.right, self.tree
        while (top := tree[1]) != self.NONE:
            i = top & 0xFFFFFFFF
            j = right[i]
            symbols[i] = self.ranks[symbols[i], symbols[j]][1]
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            self.put(j, self.NONE)
            self.put(i, self.rank(i))
            if left[i] >= 0:
                self.put(left[i], self.rank(left[i]))
        out, i = [], 0
        while i >= 0:
            out.append(symbols[i])
            i = right[i]
        return out


class WordBpe(dict):
    """An encoder. As a dict it maps a word to its ids and tokens as text."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.vocab, self.names = vocab, {i: t for t, i in vocab.items()}
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", SPACES)).findall
        self.letters = byte_letters()

    def ids(self, word: str) -> list[int]:
        symbols = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        if not symbols:
            return []
        symbols[-1] += self.end
        found = [self.vocab[s] for s in symbols if s in self.vocab]
        return PairTree(found, self.ranks).run() if len(found) > 1 else found

    def __missing__(self, word: str) -> tuple[str, str]:
        ids = self.ids(word)
        out = " ".join(map(str, ids)), " ".join(self.names[i] for i in ids)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= KEPT_LENGTH:
            self[word] = out
        return out

    def words(self, text: str) -> list[str]:
        # One capital sigma is lowered alike wherever it stands in a word.
        return self.split(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encoded(self, text: str) -> tuple[str, str]:
        """Ids and tokens of a text, each joined by spaces."""
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append((str(self.special[part]), part))
            elif part:
                out += map(self.__getitem__, self.words(part))
        return " ".join([a for a, _ in out if a]), " ".join([b for a, b in out if a])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encoded(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids if i in self.names)


def vocabulary_path(name: str) -> str:
    """A path as it is; another name among the public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(name: str = VOCABULARY) -> WordBpe:
    found = WordBpe(vocabulary_path(name))
    CACHES.append(found.clear)
    return found


def _numbers(ids: str):
    import numpy as np

    return np.array(ids.split(), np.int32)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array of int) and decoded text, a row a document."""
    return _mapped(docs, vocabulary, "doc_id long, ids array<int>, decoded string", lambda bpe, ids, dec: (_numbers(ids), dec))


def encode_report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The contract's view: number of tokens, digests of ids and of the text
    decoded from them."""

    def digests(bpe, ids, dec):
        return ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(dec.encode("utf-8")).hexdigest()

    return _mapped(docs, vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs: DataFrame, vocabulary: str, schema: str, row) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        bpe = encoder(vocabulary)
        for batch in batches:
            # Few texts at a time: what a task holds doesn't grow with the batch.
            for i in range(0, batch.num_rows, TEXTS):
                few = batch.slice(i, TEXTS)
                cols = list(zip(*[row(bpe, *bpe.encoded(t)) for t in texts_of(few.column(1))]))
                yield pa.RecordBatch.from_arrays([few.column(0), *[pa.array(list(c), type=t) for c, t in zip(cols, types())]], names)

    def types():
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
        return [kinds[c.split()[1]] for c in schema.split(", ")[1:]]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
