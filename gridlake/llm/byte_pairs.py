"""Byte-pair encoding and decoding (operator 13).

A text is split into words by the byte-level pattern, a word's bytes become a doubly linked list of symbols, and
a priority queue of (merge rank, place) joins neighbours: an entry whose symbols have changed since is stale and skipped.
The ids of short words are remembered per Python worker. Decoding concatenates the vocabulary's byte strings. Vocabulary
and merges come from a tokenizer file given by its path, which every executor must be able to read.

Strings of added tokens inside a text become those tokens, the leftmost and longest first. Cases: a null text is empty
and has no ids; a null id stays; repeated rows give equal results; an empty table gives an empty result. Texts are encoded
whole, whatever their length; other columns are not read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import Remembered

#: Fixed value: the published splitting pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the pattern tells apart, and an ASCII stand-in for each class.
STAND_INS = {"letter": "a", "number": "1", "space": "\t", "other": "!"}


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes in their order for what follows code point 255.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splits, add = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        plain = not (spec["normalizer"] or spec["post_processor"] or model["dropout"] or model["ignore_merges"] or model["byte_fallback"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"])
        if model["type"] != "BPE" or splits["type"] != "ByteLevel" or splits["add_prefix_space"] or not splits["use_regex"] or not plain:
            raise ValueError("only plain byte-level vocabularies without a leading space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in add):
            raise ValueError("added tokens must match as they are")
        letters = byte_letters()
        vocabulary: dict[str, int] = model["vocab"]
        self.of_byte = [vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left id, right id) -> (rank, id of both)
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in add}
        self.strings = {i: bytes(letters[c] for c in s) for s, i in vocabulary.items()} | {i: s.encode() for s, i in self.added.items()}
        self.words = regex.compile(WORDS)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known = Remembered(lambda word: array("I", self.merge(word.encode("utf-8", "surrogatepass"))).tobytes())
        self.settled = {chr(i) for i in range(128)}
        self.stand_ins: dict[int, str] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: always the neighbours of least rank first, the leftmost among equals."""
        ids = [self.of_byte[b] for b in word]
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, found[1]))
        heapify(queue)
        while queue:
            _, i, joint = heappop(queue)
            right = after[i]
            # stale: this symbol is gone, is last by now, or it or its neighbour has become another
            if ids[i] < 0 or right < 0 or (found := merges.get((ids[i], ids[right]))) is None or found[1] != joint:
                continue
            ids[i], ids[right] = joint, -1
            after[i] = following = after[right]
            if following >= 0:
                before[following] = i
                if found := merges.get((joint, ids[following])):
                    heappush(queue, (found[0], i, found[1]))
            if (left := before[i]) >= 0 and (found := merges.get((ids[left], joint))):
                heappush(queue, (found[0], left, found[1]))
        return [x for x in ids if x >= 0]

    def _settle(self, characters: set[str]) -> None:
        """Compare how this pattern and the tokenizer library class new characters: their Unicode versions may differ."""
        from tokenizers import pre_tokenizers

        split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        for c in characters:
            own, theirs = "space", "space"
            for name, stand_in in STAND_INS.items():
                if name != "space":
                    own = name if len(self.words.findall(stand_in + c)) == 1 else own
                    theirs = name if len(split(stand_in + c)) == 1 else theirs
            if own != theirs:
                self.stand_ins[ord(c)] = STAND_INS[theirs]
        self.settled |= characters

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            new = set(text) - self.settled
            if new:
                self._settle(new)
            if self.stand_ins and (plain := text.translate(self.stand_ins)) != text:
                return [text[m.start() : m.end()] for m in self.words.finditer(plain)]
        return self.words.findall(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.marks is None or not any(s in text for s in self.added):
            return b"".join(map(self.known.__getitem__, self.split(text)))
        out, start = [], 0
        for found in self.marks.finditer(text):
            out.append(b"".join(map(self.known.__getitem__, self.split(text[start : found.start()]))))
            out.append(array("I", [self.added[found.group()]]).tobytes())
            start = found.end()
        out.append(b"".join(map(self.known.__getitem__, self.split(text[start:]))))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        numbers = array("I")
        numbers.frombytes(ids or b"")
        return b"".join(map(self.strings.__getitem__, numbers)).decode("utf-8", "replace")


@cache
def byte_pairs(path: str) -> BytePairs:
    """One per Python worker: what a task has learned serves the next one."""
    return BytePairs(path)


def _mapped(rows: DataFrame, key: str, column: str, kind: str, out: str, function, type_out: pa.DataType) -> DataFrame:
    name = {pa.binary(): "binary", pa.string(): "string"}[type_out]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([function(v.as_py()) for v in batch.column(1)], type_out)
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["key", "value"])

    picked = rows.select(F.col(key).alias("key"), F.col(column).cast(kind).alias("value"))
    found = picked.mapInArrow(over, f"key {rows.schema[key].dataType.simpleString()}, value {name}")
    return found.select(F.col("key").alias(key), F.col("value").alias(out))


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``ids``: binary, four bytes an id, little-endian."""
    return _mapped(docs, key, text, "string", "ids", lambda t: byte_pairs(path).encode(t), pa.binary())


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ``text`` of rows with ``ids`` as above."""
    return _mapped(encoded, key, ids, "binary", "text", lambda b: byte_pairs(path).decode(b), pa.string())


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``ids`` and the text ``decoded`` from them; the decoder sees the ids alone."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = pa.array([byte_pairs(path).decode(b.as_py()) for b in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), decoded], names=["key", "ids", "decoded"])

    encoded = encode_documents(docs, path, key, text).withColumnRenamed(key, "key")
    kind = docs.schema[key].dataType.simpleString()
    return encoded.mapInArrow(over, f"key {kind}, ids binary, decoded string").withColumnRenamed("key", key)


def digests(trip: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of tokens, hash of the ids and hash of the decoded text."""
    return trip.select(
        key, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
