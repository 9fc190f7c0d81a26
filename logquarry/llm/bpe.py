"""BPE encoding and decoding with word ends.

Inside a word, a segment tree lies over the ranks of adjacent pairs: a leaf holds (rank, position) of the pair that
begins there, an inner node the smaller of its children, so the root is the leftmost pair of lowest rank. A merge
changes three leaves, each mended in logarithmic time. Words are encoded once for each Python worker and remembered.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

NONE = 1 << 62  # a pair that doesn't merge
#: Most words a worker remembers, and the longest of them; beyond it the memory starts afresh, results stay the same.
WORDS, LONGEST = 400_000, 64


def byte_letters() -> list[str]:
    """Byte-level BPE writes each byte as one letter: printable Latin-1 as itself, the others as U+0100 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = [""] * 256, 0
    for b in plain:
        letters[b] = chr(b)
    for b in range(256):
        if not letters[b]:
            letters[b] = chr(256 + n)
            n += 1
    return letters


def merge_word(ids: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Merge adjacent ids, leftmost pair of lowest rank first, until no pair merges. merges: first << 32 | second -> (rank << 32, id)."""
    n = len(ids) - 1
    if n < 1:
        return ids
    ids, size, get, none = list(ids), 1 << (n - 1).bit_length(), merges.get, (NONE, 0)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    tree = [NONE] * (2 * size)
    left = ids[0]
    for i in range(n):
        right = ids[i + 1]
        tree[size + i] = get(left << 32 | right, none)[0] | i
        left = right
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    while (root := tree[1]) < NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        left = ids[i] = get(ids[i] << 32 | ids[j])[1]
        k = after[i] = after[j]
        if k <= n:
            before[k] = i
            changed = [(i, get(left << 32 | ids[k], none)[0] | i), (j, NONE)]
        else:
            changed = [(i, NONE)]
        if (h := before[i]) >= 0:
            changed.append((h, get(ids[h] << 32 | left, none)[0] | h))
        for leaf, value in changed:
            leaf += size
            tree[leaf] = value
            while leaf > 1:
                other = tree[leaf ^ 1]
                if other < value:
                    value = other
                leaf >>= 1
                if tree[leaf] == value:
                    break
                tree[leaf] = value
    out, i = [], 0
    while i <= n:
        out.append(ids[i])
        i = after[i]
    return out


class WordBpe:
    """The codec of a tokenizer file whose model is BPE with word ends over byte-level letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.merges = {self.vocab[a] << 32 | self.vocab[b]: (rank << 32, self.vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.letters = byte_letters()
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.packed: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def word(self, word: str) -> list[int]:
        letters = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        letters[-1] += self.suffix
        return merge_word([self.vocab[x] for x in letters], self.merges)

    def normal(self, text: str) -> str:
        """NFC, then each character's own lower case (a final sigma has none of its own)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and the text that they decode to."""
        ids: list[bytes] = []
        shown: list[str] = []
        for k, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if k % 2:
                ids.append(self.special[part].to_bytes(4, "little"))
                shown.append(part)
                continue
            words, start = self.find(self.normal(part)), len(ids)
            try:
                ids += map(self.packed.__getitem__, words)
            except KeyError:
                del ids[start:]
                new = self.learn(words)
                ids += map(self.packed.__getitem__, words)
                shown += map(self.shown.__getitem__, words)
                for word in new:
                    if len(word) > LONGEST:
                        del self.packed[word], self.shown[word]
            else:
                shown += map(self.shown.__getitem__, words)
        return b"".join(ids), " ".join(shown)

    def learn(self, words: list[str]) -> set[str]:
        """Encode the words that aren't remembered."""
        if len(self.packed) >= WORDS:
            self.packed.clear()
            self.shown.clear()
        new = set(words).difference(self.packed)
        for word in new:
            got = self.word(word)
            self.packed[word] = struct.pack(f"<{len(got)}I", *got)
            self.shown[word] = " ".join([self.tokens[i] for i in got])
        return new

    def decode(self, packed: bytes) -> str:
        return " ".join(self.tokens[int.from_bytes(packed[k : k + 4], "little")] for k in range(0, len(packed), 4))


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string).

    `tokenizer` is a path that every executor has. Null and empty texts have no ids and decode to ''. Repeated rows
    give repeated results, an empty table an empty one; other columns aren't read. No shuffle.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            ids, shown = [], []
            for text in batch.column(1):
                a, b = bpe.encode(text.as_py())
                ids.append(a)
                shown.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(shown, pa.string())], ["doc_id", "ids", "decoded"])

    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return kept.mapInArrow(encode, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return encode_documents(docs, tokenizer).select("doc_id", F.expr("CAST(octet_length(ids) div 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
