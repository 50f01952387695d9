"""Best-fit packing by minimum bin slack (operator 3).

Documents become token ids (tokenizer file given by path) and one end id; only longer ones are cut, into
pieces of exactly ``capacity``. Minimum bin slack fills one bin at a time with the fullest feasible
combination of the remaining lengths, found by a bitset subset-sum programme, the larger lengths
preferred among equals. A combination stays the fullest one for as long as its lengths last, so it
is applied that many times at once: the result equals the bin-by-bin run, and the plan needs the
count of pieces per length only (at most ``capacity`` numbers, whatever the size of the corpus).

Pieces never travel: each task numbers its pieces per length as it writes them, counts per (length,
task) give every piece its rank among all of that length, and the plan maps ranks to places.

Cases: null text is empty and becomes the end id alone; repeated rows are packed once each; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.llm.common import task_number
from gridlake.session import materialise

CAPACITY = 4096
END = 1
#: Characters of text whose new chunks are encoded together.
PART = 4_000_000
#: Chunks a task remembers (about 200 bytes each) before it starts afresh.
REMEMBERED = 1_000_000
MARKS = ".,;:!?"
ODD_SPACE = re.compile("[\x1c-\x1f]")


class Lengths:
    """The available lengths and how many of each; finds the fullest feasible combination.

    ``reach[i]`` is the set of sums (bits of an integer) of the ``i`` smallest lengths. It is kept between
    rounds up to the smallest length whose usable number has changed, and ends where all sums are reached.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.everything = capacity, (1 << (capacity + 1)) - 1
        self.lengths = sorted(x for x, n in counts.items() if n)
        self.counts = [counts[x] for x in self.lengths]
        self.reach = [1]

    def usable(self, i: int) -> int:
        return min(self.counts[i], self.capacity // self.lengths[i])

    def below(self, i: int) -> int:
        return self.reach[i] if i < len(self.reach) else self.everything

    def fullest(self) -> list[tuple[int, int]]:
        """(index, how many) of the combination with the least slack, larger lengths preferred."""
        while len(self.reach) <= len(self.lengths) and self.reach[-1] != self.everything:
            i, r, step = len(self.reach) - 1, self.reach[-1], 1
            length, left = self.lengths[i], self.usable(i)
            while left:
                n = min(step, left)
                r |= (r << (n * length)) & self.everything
                left, step = left - n, step * 2
            self.reach.append(r)
        best, out, i = self.below(len(self.lengths)).bit_length() - 1, [], len(self.lengths)
        while best:
            i = min(i, bisect_right(self.lengths, best)) - 1
            n = min(self.counts[i], best // self.lengths[i])
            while n and not (self.below(i) >> (best - n * self.lengths[i])) & 1:
                n -= 1
            if n:
                out.append((i, n))
                best -= n * self.lengths[i]
        return out

    def take(self, pattern: list[tuple[int, int]], times: int) -> None:
        # indices fall, so deletions do not move what comes later
        for i, n in pattern:
            before = self.usable(i)
            self.counts[i] -= n * times
            if self.usable(i) != before:
                del self.reach[i + 1 :]
            if not self.counts[i]:
                del self.lengths[i], self.counts[i]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[dict[int, int], int]]:
    """Combinations and how many bins each fills; every round uses up at least one length."""
    left = Lengths(counts, capacity)
    while left.lengths:
        pattern = left.fullest()
        times = min(left.counts[i] // n for i, n in pattern)
        yield {left.lengths[i]: n for i, n in pattern}, times
        left.take(pattern, times)


def place_table(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Rows (length, first rank, first sequence, bins, first offset): which places a length's ranks take."""
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, times in plan_bins(counts, capacity):
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((length, used[length], sequence, times, offset))
            used[length] += pattern[length] * times
            offset += pattern[length] * length
        sequence += times
    table = pd.DataFrame(rows, columns=["length", "rank", "sequence", "bins", "offset"], dtype="int64")
    return table.sort_values(["length", "rank"], ignore_index=True)


class Encoder:
    """Whole-text ids of a tokenizer that never joins characters across white space.

    Chunks between white space are remembered; those of a batch that are new are encoded together. A
    run of letters with one mark behind it is put together from the ids of both, so the tokenizer
    sees few distinct strings. A text that could hold one of its special tokens, or a control character
    that only Python takes for white space, is encoded as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower = self.tokenizer.encode("Aa", add_special_tokens=False).ids == self.tokenizer.encode("aa", add_special_tokens=False).ids
        self.parts = self.tokenizer.encode("a.", add_special_tokens=False).ids == [
            x for t in ("a", ".") for x in self.tokenizer.encode(t, add_special_tokens=False).ids]
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bool:
        return ODD_SPACE.search(text) is not None or any(x in text for x in self.specials)

    def _split(self, chunk: str) -> tuple[str, str]:
        """Letters (lower case if the tokenizer has it so) and a final mark, or the chunk as it is."""
        stem, mark = (chunk[:-1], chunk[-1]) if self.parts and chunk[-1] in MARKS else (chunk, "")
        if stem.isascii() and stem.isalpha():
            return (stem.lower() if self.lower else stem), mark
        return (stem, mark) if stem.isalpha() else (chunk, "")

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*texts).difference(self.known)
        split = {c: self._split(c) for c in new}
        wanted = sorted({x for pair in split.values() for x in pair if x}.difference(self.known))
        for start in range(0, len(wanted), 4096):
            part = wanted[start : start + 4096]
            for chunk, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[chunk] = array("I", found.ids).tobytes()
        for chunk, (stem, mark) in split.items():
            if mark or stem != chunk:
                self.known[chunk] = self.known[stem] + (self.known[mark] if mark else b"")

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; null is empty. Texts are taken in parts of bounded size."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size < PART):
                size += len(texts[end] or "")
                end += 1
            part = [t if isinstance(t, str) else "" for t in texts[start:end]]
            odd = [self.whole(t) for t in part]
            chunks = [[] if x else t.split() for t, x in zip(part, odd, strict=True)]
            self.learn(chunks)
            for text, own, alone in zip(part, chunks, odd, strict=True):
                if alone:
                    yield np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                else:
                    yield np.frombuffer(b"".join(map(self.known.__getitem__, own)), np.uint32)
            start = end


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker: what a task has learned serves the next one."""
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: key, piece, start, length, ids_crc32, and the ids themselves unless left out."""
    fields = [docs.schema[key], *[T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("_task", T.LongType()), ("_nth", T.LongType()))]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches):
        encode, seen, task = encoder(tokenizer_path), np.zeros(capacity + 1, np.int64), task_number()
        for batch in batches:
            rows = []
            for k, found in zip(batch[key], encode(batch[text].tolist()), strict=True):
                ids = np.append(found, np.uint32(end)).astype("<u4")
                for i, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((k, i, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)], *([part.astype(np.int32)] if with_ids else [])))
                    seen[len(part)] += 1
            yield pd.DataFrame(rows, columns=[f.name for f in fields])

    return docs.select(key, text).mapInPandas(cut, T.StructType(fields))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for written pieces with ``length, _task, _nth``."""
    cells = materialise(pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = place_table(counts, capacity)
    lengths, ranks = places["length"].to_numpy(), places["rank"].to_numpy()
    most = int(max(counts.values(), default=0)) + 1
    joint = lengths.astype(object) * most + ranks if capacity * most > 1 << 62 else lengths * most + ranks
    columns = {c: places[c].to_numpy() for c in ("rank", "sequence", "bins", "offset")}
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = pieces.join(starts, ["length", "_task"]).withColumn("_rank", F.col("_start") + F.col("_nth")).drop("_task", "_nth", "_start")
    out = T.StructType([f for f in ranked.schema.fields if f.name != "_rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            at = np.searchsorted(joint, length * most + rank, side="right") - 1
            nth = rank - columns["rank"][at]
            batch["sequence_id"] = columns["sequence"][at] + nth % columns["bins"][at]
            batch["offset"] = columns["offset"][at] + nth // columns["bins"][at] * length
            yield batch[[f.name for f in out.fields]]

    return ranked.mapInPandas(place, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; tokens are counted in one pass and never shuffled."""
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity, end, with_ids=with_ids), "pieces")
    return pack(pieces, capacity)
