"""Language identification by language-bitmask n-gram filters (operator 5).

Learning: words (runs of letters, lower case, padded by a space at both ends) of the labelled texts are
counted per language, their character n-grams follow from the distinct words. An n-gram belongs to every
language whose rate for it is at least ``share`` of the greatest rate. One Bloom filter holds all
languages in bit slices: slot -> bitmask of languages; the AND of an n-gram's ``HASHES`` slots has the
bits of all languages that contain it.

Prediction: per language the set bits of a text's n-grams are counted and corrected for false positives,
``(hits - n * f) / (1 - f)`` with ``f = fill ** HASHES``. The filter has the same number of slots and the same least rate of
an n-gram in its language for inputs of any size; as rates add up to ``len(SIZES)`` at most, what reaches that rate fills one
half of the slots at most. The greatest corrected count wins (ties: first language in order); the score is its share of the n-grams.

Cases: null text or no letter gives ``und`` with score 0, as does a model without labelled rows; null
languages are not learned; repeated rows are predicted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.llm.common import Remembered, crc_fold
from gridlake.session import materialise

LETTERS = re.compile(r"[^\W\d_]+")
SIZES = (2, 3, 4)
HASHES = 3
#: Slots of the filter; with 8 bytes a slot they bound what is collected and broadcast.
SLOTS = 1 << 22
#: Share of slots a language may fill; filters are sized for one half.
MOST_FILL = 0.6
SHARE = 0.25
#: Languages in one mask word.
LANES = 62
#: Distinct words a task counts before it hands them on.
COUNTED = 200_000
#: Characters of text whose new chunks are looked up together, and chunks remembered before starting afresh.
PART = 4_000_000
KEPT = 400_000
UNKNOWN = "und"


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1)]


def gram_hash(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass"))


def slots_of(hashed: int, slots: int) -> list[int]:
    step = (hashed >> 32) | 1
    return [((hashed & 0xFFFFFFFF) + i * step) % slots for i in range(HASHES)]


@dataclass(frozen=True)
class LanguageFilter:
    """``masks[word, slot]``: languages ``word * LANES + bit`` with that bit set."""

    languages: tuple[str, ...]
    masks: np.ndarray

    @cached_property
    def false_rate(self) -> np.ndarray:
        fill = [np.count_nonzero(self.masks[i // LANES] >> (i % LANES) & 1) / self.masks.shape[1] for i in range(len(self.languages))]
        if max(fill, default=0) > MOST_FILL:
            raise ValueError(f"language filter too small: {max(fill):.2f} of its slots are set for one language")
        return np.array(fill) ** HASHES

    def vector(self, joint: tuple[int, ...]) -> np.ndarray:
        """1 for each language in the mask words ``joint``."""
        return np.array([joint[i // LANES] >> (i % LANES) & 1 for i in range(len(self.languages))], np.int32)

    def lookup(self, hashed: int) -> tuple[int, ...]:
        """The mask words of all languages that contain the n-gram: one AND over its slots."""
        out = []
        for lane in self.masks:
            joint = -1
            for slot in slots_of(hashed, len(lane)):
                joint &= int(lane[slot])
            out.append(joint)
        return tuple(out)


def letter_runs(chunk: str) -> list[str]:
    if chunk.isalpha():
        return [chunk]
    # the pattern also takes number characters such as ² and ½, which are no letters
    pieces = LETTERS.findall(chunk)
    return pieces if chunk.isascii() or all(map(str.isalpha, pieces)) else [w for p in pieces for w in "".join(c if c.isalpha() else " " for c in p).split()]


def _gram_counts(batches):
    """Occurrences of every n-gram per language in the words of a task, handed on in bounded parts."""
    chunks: defaultdict[str, Counter] = defaultdict(Counter)

    def flush():
        for language, counted in chunks.items():
            words: Counter = Counter()
            for chunk, n in counted.items():
                for word in letter_runs(chunk):
                    words[word] += n
            out: defaultdict[str, int] = defaultdict(int)
            for word, n in words.items():
                for gram in grams(word):
                    out[gram] += n
            if out:
                keys = np.fromiter(map(gram_hash, out), np.uint64, len(out)).view(np.int64)
                yield pd.DataFrame({"gram": keys, "lang": language, "n": list(out.values())})
        chunks.clear()

    for batch in batches:
        for language, text in zip(batch["lang"], batch["text"], strict=True):
            chunks[language].update(text.lower().split())
            if sum(map(len, chunks.values())) >= COUNTED:
                yield from flush()
    yield from flush()


def least_rate(slots: int) -> float:
    """The rate in a language that lets at most as many n-grams through as fill one half of ``slots``."""
    return len(SIZES) * HASHES / (np.log(2) * slots)


def learn(rows: DataFrame, slots: int = SLOTS, share: float = SHARE, most: int | None = None) -> LanguageFilter:
    """Fit on all ``lang, text`` rows without nulls. Only the language list, a count per language and the filter reach the driver.

    ``slots`` (a power of two) is the size of the filter, ``most`` replaces it; the rows do not change it.
    """
    slots = slots if most is None else most
    counts = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInPandas(
        _gram_counts, "gram long, lang string, n long"
    ).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang").agg(
        F.sum(F.length("text") + 1).alias("n")).collect()}
    languages = tuple(sorted(totals))
    lanes = max(1, -(-len(languages) // LANES))
    if not languages:
        return LanguageFilter(languages, np.zeros((lanes, slots), np.int64))
    known = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.struct(F.lit(i).alias("i"), F.lit(float(totals[lang])).alias("total")))])
    rated = counts.select("gram", known[F.col("lang")].alias("k"), "n").select("gram", F.struct((F.col("n") / F.col("k.total")).alias("rate"), F.col("k.i").alias("i")).alias("r"))
    # at most one entry per language
    listed = rated.groupBy("gram").agg(F.collect_list("r").alias("rs"), F.max("r.rate").alias("most"))
    kept = materialise(listed.select("gram", F.explode("rs").alias("r"), "most").where(
        F.col("r.rate") >= F.greatest(share * F.col("most"), F.lit(float(least_rate(slots))))).select("gram", "r"), "grams")
    masks = np.zeros((lanes, slots), np.int64)
    positions = F.array(*[
        F.pmod(F.col("gram").bitwiseAND(0xFFFFFFFF) + F.lit(i) * F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1)), F.lit(slots)) for i in range(HASHES)
    ])
    bits = kept.select(
        F.explode(positions).alias("slot"), F.floor(F.col("r.i") / LANES).cast("int").alias("word"),
        F.expr(f"shiftleft(1L, r.i % {LANES})").alias("bit"),
    ).groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toPandas()
    masks[bits["word"].to_numpy(int), bits["slot"].to_numpy(int)] = bits["mask"].to_numpy(np.int64)
    return LanguageFilter(languages, masks)


class _Scorer:
    """n-gram hits per language of the chunks between white space, remembered as rows of one matrix.

    New chunks of a bounded part of a batch are looked up together; row 0 is a chunk without letters.
    """

    def __init__(self, model: LanguageFilter):
        self.model, self.false = model, model.false_rate
        self.masks: dict[tuple[int, ...], int] = {}
        self.vectors = np.zeros((0, len(model.languages)), np.int32)
        self.grams = Remembered(self._mask_row)
        self.reset()

    def _mask_row(self, gram: str) -> int:
        """Distinct masks are few; each is spread into a row once."""
        joint = self.model.lookup(gram_hash(gram))
        if joint not in self.masks:
            self.masks[joint] = len(self.vectors)
            self.vectors = np.vstack([self.vectors, self.model.vector(joint)])
        return self.masks[joint]

    def reset(self):
        self.rows: dict[str, int] = {}
        self.hits = np.zeros((1, len(self.model.languages) + 1), np.int32)

    def _add(self, words: list[str]) -> None:
        """Rows of new words: the sum of their n-grams' rows, and how many n-grams they have."""
        flat, sizes = [], []
        for word in words:
            parts = grams(word)
            flat.extend(map(self.grams.__getitem__, parts))
            sizes.append(len(parts))
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        hits = np.add.reduceat(self.vectors[flat], at, axis=0)
        for i, word in enumerate(words):
            self.rows[word] = len(self.hits) + i
        self.hits = np.vstack([self.hits, np.column_stack([hits, np.array(sizes, np.int32)])])

    def _learn(self, texts: list[list[str]]) -> None:
        new = {c: letter_runs(c) for c in set().union(*texts).difference(self.rows)}
        if words := sorted({w for runs in new.values() for w in runs}.difference(self.rows)):
            self._add(words)
        joint = []
        for chunk, runs in new.items():
            if not runs:
                self.rows[chunk] = 0
            elif len(runs) == 1:
                self.rows[chunk] = self.rows[runs[0]]
            else:
                joint.append(self.hits[[self.rows[w] for w in runs]].sum(axis=0))
                self.rows[chunk] = len(self.hits) + len(joint) - 1
        if joint:
            self.hits = np.vstack([self.hits, joint])

    def _decide(self, chunks: list[str]) -> tuple[str, float]:
        at = np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))
        *hits, n = self.hits[at].sum(axis=0, dtype=np.int64)
        if not n:
            return UNKNOWN, 0.0
        # (hits - n * f) / (1 - f), exactly n where every n-gram is hit
        corrected = n - (n - np.array(hits)) / (1 - self.false)
        best = int(corrected.argmax())
        return self.model.languages[best], float(min(1.0, max(0.0, corrected[best] / n)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, start = [], 0
        while start < len(texts):
            part, size = [], 0
            while start < len(texts) and (not part or size < PART):
                text = texts[start] if isinstance(texts[start], str) else ""
                part.append(text.lower().split())
                size, start = size + len(text), start + 1
            if not self.model.languages:
                out += [(UNKNOWN, 0.0)] * len(part)
                continue
            if len(self.rows) > KEPT:
                self.reset()
            self._learn(part)
            out += map(self._decide, part)
        return out


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score under ``names``; whole texts, no shuffle."""
    language, score = names
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])
    _ = model.false_rate  # travels with the model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def over(batches):
        scorer = _Scorer(shared.value)
        for batch in batches:
            found = scorer(batch[text].tolist())
            batch[language] = [x[0] for x in found]
            batch[score] = [x[1] for x in found]
            yield batch

    return docs.select(*kept).mapInPandas(over, schema)


def held_out(key: str = "doc_id") -> Column:
    return crc_fold(key, 3) == 1


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out, predict all; text stays behind."""
    model = learn(docs.where(~held_out()))
    scored = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


def recognised(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without those whose language is unknown or fewer than ``least`` of whose n-grams it has."""
    model = learn(docs.where(~held_out()))
    found = predict(docs, model, names=("_lang_pred", "_lang_score"))
    return found.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= least)).select(*docs.columns)
