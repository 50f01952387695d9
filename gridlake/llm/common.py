"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes one Python worker remembers at a time.
REMEMBERED = 400_000


class Remembered(dict):
    """A memo of ``function(key)``; emptied when it holds ``REMEMBERED`` keys, so memory is bounded."""

    def __init__(self, function: Callable, longest: int = 64):
        super().__init__()
        self.function, self.longest = function, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


@cache
def word_memo() -> Remembered:
    """64-bit hash of a word given as bytes; one memo per Python worker."""
    return Remembered(xxhash.xxh3_64_intdigest)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int, memo: Remembered) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text of fewer words has one shingle,
    its whole word sequence; a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    out = h[: len(h) - span + 1].copy()
    for i in range(1, span):
        out = out * MULTIPLIER + h[i : len(h) - span + 1 + i]
    if span < width:
        out = out + np.uint64(span)
    return np.unique(mix(out))


def sorted_runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The runs of equal ``key`` in a sorted stream of batches; a run may span batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[key].to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        if held and held[-1][key].iloc[-1] != values[0]:
            yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            held = []
        start = 0
        for cut in cuts:
            held.append(batch.iloc[start:cut])
            yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            held, start = [], cut
        held.append(batch.iloc[start:])
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def map_runs(df: DataFrame, key: str, function: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Apply ``function`` to all rows of each ``key``; only one bounded run is in memory at a time.

    The caller keeps runs bounded (hot keys are split into blocks beforehand).
    """

    def over(batches):
        for run in sorted_runs(batches, key):
            out = function(run)
            if out is not None and len(out):
                yield out

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInPandas(over, schema)


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def unit_hash(key: Column, salt: str) -> Column:
    """A number in (0, 1) from the md5 of ``key`` and ``salt``; any SQL engine can compute the same."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{salt}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def crc_fold(key: str, modulus: int) -> Column:
    """``crc32`` of the id's text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % F.lit(modulus)


def word_count(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
