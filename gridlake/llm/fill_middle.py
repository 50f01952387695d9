"""Fill-in-middle transformation over a learned rank index (operator 11).

A text is cut into units: white space with the word behind it, or white space at the end. ``RankIndex`` holds
where unit ``i`` ends as error-bounded straight segments over the rank plus one small residual per rank: a cut is
predicted by its segment and put right by the stored residual, so lookups are exact. Two cuts drawn from a
hash of the document's id make prefix, middle and suffix, which are written in one of the two marked orders.

Cases: a null text is empty; an empty text, one that already holds a mark, and one the draw leaves out stay as they
are (``plain``, null lengths); a null id is drawn like an id of no digits; repeated rows give equal results; an empty table
gives an empty result. Texts are handled whole, whatever their length; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 documents, how many are transformed, and of 100 of those, how many start with the suffix.
TRANSFORMED, SUFFIX_FIRST = 50, 80
#: Greatest error of a segment's prediction, in characters; residuals with rounding fit one signed byte.
ERROR = 100
#: Ranks a segment is first tried on.
TRIED = 256


def unit_ends(text: str) -> np.ndarray:
    """Code-point offsets 0, end of the first unit, ..., end of the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(1, np.int64)
    blank = (codes == 32) | ((codes - np.uint32(9)) <= 4)
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.concatenate([[0], ends, [len(codes)]])


@dataclass
class RankIndex:
    """Offsets as ``base + round(slope * (rank - first)) + residual`` of the segment that holds the rank."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """Longest segments from the left: a cone of slopes that keeps all ranks so far within ``error``."""
        n = len(offsets)
        first, slope, start = [], [], 0
        while start < n:
            low, high, done, width, best = -np.inf, np.inf, start, TRIED, 0.0
            while done + 1 < n:
                end = min(n, done + 1 + width)
                run = np.arange(done + 1 - start, end - start)
                rise = offsets[done + 1 : end] - offsets[start]
                lows = np.maximum.accumulate(np.maximum(low, (rise - error) / run))
                highs = np.minimum.accumulate(np.minimum(high, (rise + error) / run))
                good = lows <= highs
                fits = len(run) if good[-1] else int(np.argmin(good))
                if fits:
                    low, high, done = lows[fits - 1], highs[fits - 1], done + fits
                    best = (low + high) / 2
                if fits < len(run):
                    break
                width *= 2
            first.append(start)
            slope.append(best)
            start = done + 1
        at, steep = np.array(first, np.int64), np.array(slope)
        index = cls(at, offsets[at] if n else np.empty(0, np.int64), steep, np.zeros(n, np.int8))
        missed = offsets - index.predict(np.arange(n)) if n else np.empty(0, np.int64)
        index.residual = missed.astype(np.int8)
        if (index.residual != missed).any():
            raise ArithmeticError("a residual beyond the error bound")
        return index

    def predict(self, rank: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[segment] + np.rint(self.slope[segment] * (rank - self.first[segment])).astype(np.int64)

    def __getitem__(self, rank) -> np.ndarray:
        """Exact offsets of the given ranks."""
        rank = np.asarray(rank)
        return self.predict(rank) + self.residual[rank]


def draws(key: object, seed: int) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers from the id and the seed."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in range(0, 32, 8))


def transform(key: object, text: str | None, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and middle, output) of one document."""
    text = text or ""
    ends = unit_ends(text)
    units = len(ends) - 1
    one, two, three, four = draws(key, seed)
    if not text or three % 100 >= TRANSFORMED or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return units, "plain", None, None, text
    cuts = sorted((one % (units + 1), two % (units + 1)))
    start, end = RankIndex.fit(ends)[cuts].tolist()
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if four % 100 < SUFFIX_FIRST:
        return units, "spm", start, end - start, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return units, "psm", start, end - start, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """One row per document: key, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output``."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows = [transform(k.as_py(), t.as_py(), seed) for k, t in zip(keys, texts, strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([keys, *arrays], names=["key", *names])

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = picked.mapInArrow(over, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("key", key)


def restored(output: str = "output", form: str = "form") -> Column:
    """The document's text, rebuilt from its output and form alone.

    The parts hold no mark, and no mark can start in a part and end in the mark behind it, so the first
    occurrence of each mark is the written one.
    """
    out, size = F.col(output), len(PREFIX)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(out, F.lit(size + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + size + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + size + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_2, prefix_2, middle_2 = parts(SUFFIX, PREFIX)
    return (
        F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix))
        .when(F.col(form) == "spm", F.concat(prefix_2, middle_2, suffix_2))
        .otherwise(out)
    )


def digests(transformed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Output and restored text as hashes."""
    return transformed.select(
        key, "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode(restored(), "UTF-8"), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM d),
f AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS a,
    CAST(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p),
x AS (
  SELECT *, strpos(output, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS i, strpos(output, '<M>') AS m FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, 4, i - 4) || substr(output, m + 3) || substr(output, i + 3, m - i - 3)
    ELSE substr(output, i + 3, m - i - 3) || substr(output, m + 3) || substr(output, 4, i - 4) END) AS restored_sha256
FROM x
"""
