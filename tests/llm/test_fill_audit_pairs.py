"""Fill-in-middle, divergence audit and byte pairs against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridlake.llm import byte_pairs, divergence, fill_middle

SCHEMA = "doc_id long, text string, lang string, source string, ids binary, n string, output int, key string, value double"
AWKWARD = [
    None, "", " ", "\n \t", "one", " one", "one ", "a  b\tc\n\nd ", "x<P>y", "<M>", "a <S> b", "< P> <", "é ü ñ 漢字 😀👩‍👩‍👧", " wide \u0085 next",
    "it's we'll I'd 're 'S <|endoftext|> <|endoftext|><|endoftext|x", "՘՘a \U0003d000 1᛽  ", "0123456789" * 30, "zebra " * 4000, "aA" * 20_000, "\x00 nul\x1c\x1d end",
]


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "n", 3, "k", 0.5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    letters = "abcdeàß 漢\n\t .,;!?'0129<PSM>|"
    out = [(i, t, ("xx", None)[i % 2], "s") for i, t in enumerate(AWKWARD)]
    out += [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 400))), "xx", "s") for i in range(150)]
    return [*out, (5, AWKWARD[5], None, None), (5, AWKWARD[5], None, None), (None, "no id at all here", "xx", "s")]


# --- fill in middle ---------------------------------------------------------------------------------


def brute_fill(key, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digits = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark, rows):
    found = fill_middle.fill_in_middle(table(spark, rows))
    got = Counter(map(tuple, found.collect()))
    assert got == Counter((k, *brute_fill(k, t)) for k, t, *_ in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = fill_middle.digests(found).select("doc_id", "restored_sha256").collect()
    assert Counter(map(tuple, back)) == Counter((k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t, *_ in rows)
    assert fill_middle.digests(fill_middle.fill_in_middle(table(spark, []))).count() == 0


def test_marks_that_parts_could_fake(spark):
    """Parts that end or start with pieces of a mark come back whole."""
    texts = [" ".join(random.Random(i).choice(["<", "P>", "<S", "M", ">", "S>", "<<", "a"]) for _ in range(12)).replace(" ", "") + " <\n<S <P >P> M>" for i in range(80)]
    found = fill_middle.fill_in_middle(table(spark, [(i, t, None, None) for i, t in enumerate(texts)]))
    back = {r[0]: r[1] for r in fill_middle.digests(found).select("doc_id", "restored_sha256").collect()}
    assert back == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}


@pytest.mark.parametrize("error", [1, 7, 100])
def test_rank_index(error):
    rng = np.random.default_rng(error)
    for steps in (rng.integers(1, 12, 5000), rng.integers(1, 300, 900), np.ones(3000, int), np.r_[np.ones(40, int), 100_000, np.full(400, 7), 5_000_000], np.array([], int)):
        offsets = np.concatenate([[0], np.cumsum(steps)])
        index = fill_middle.RankIndex.fit(offsets, error)
        assert (index[np.arange(len(offsets))] == offsets).all()
        assert abs(index.residual.astype(int)).max() <= error + 1
    even = fill_middle.RankIndex.fit(np.arange(0, 70_000, 7), error)
    assert len(even.first) == 1
    wordy = fill_middle.RankIndex.fit(np.concatenate([[0], np.cumsum(rng.integers(1, 12, 100_000))]))
    assert len(wordy.first) < 1000


# --- divergence -------------------------------------------------------------------------------------


def brute_divergence(rows, least, top):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, count, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(word.findall((text or "").translate(lower)))
        for term, n in found.items():
            held[lang, term] += 1
            count[lang, source, term] += n
            count[lang, None, term] += n
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in held.items() if x == lang and n >= least)
        own = [s for x, s in groups if x == lang]
        p = {}
        for s in [*own, None]:
            total = sum(count[lang, s, t] for t in kept)
            p[s] = [1 + 1_000_000_000 * (count[lang, s, t] + 5) // (total + 5 * len(kept)) for t in kept]
        for s in own:
            parts = {"pair": [(o, sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True))) for o in own if o != s],
                     "term": [(t, x - q) for t, x, q in zip(kept, p[s], p[None], strict=True) if count[lang, s, t] and x > q]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < top]
    return out


@pytest.fixture(scope="module")
def sourced():
    rng = random.Random(5)
    out = []
    for i in range(500):
        lang = rng.choice(["xx", "xx", "yy", None])
        source = "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 9)}"
        words = [f"w{chr(97 + min(int(rng.expovariate(0.2)), 25))}{rng.choice('éÉABab')}" for _ in range(rng.randint(0, 30))]
        out.append((i, rng.choice([" ", ", ", "7"]).join(words), lang, source))
    out += [(600, None, "xx", "silent"), (601, "", "xx", None), (602, "12 34", "lone", "only"), (603, None, None, None), (604, "rare words", "zz", "a"), (605, "other words", "zz", "b"), (1, out[1][1], "xx", "hot"), (1, out[1][1], "xx", "hot")]
    return out


@pytest.mark.parametrize(("least", "top", "terms", "sources"), [(1, 5, 16, 3), (12, 50, 1024, 256), (10_000, 5, 8, 2)])
def test_divergence(spark, sourced, least, top, terms, sources):
    got = divergence.source_divergence(table(spark, sourced), least=least, top=top, terms=terms, sources=sources)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_divergence(sourced, least, top))


def test_divergence_rows_in_any_order(spark, sourced, monkeypatch):
    """Executors fetch the rows of a shard in any order; each shard here gets them in an order of its own."""
    summed = divergence._pair_sums

    def shuffled(rows):
        return summed(rows.take(np.random.default_rng(rows["shard"][0].as_py()).permutation(rows.num_rows)))

    monkeypatch.setattr(divergence, "_pair_sums", shuffled)
    got = divergence.source_divergence(table(spark, sourced), least=1, top=5, terms=16, sources=4)
    assert Counter(map(tuple, got.collect())) == Counter(brute_divergence(sourced, 1, 5))


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(table(spark, [])).count() == 0


def test_probability_beyond_long(spark):
    row = spark.sql("SELECT 30000000000L AS n, 70000000000007L AS t, 12345L AS v").select(divergence.probability(F.col("n"), F.col("t"), F.col("v"))).first()
    assert row[0] == 1 + 1_000_000_000 * 30000000005 // (70000000000007 + 5 * 12345)


# --- byte pairs -------------------------------------------------------------------------------------

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def test_byte_pairs(spark, rows, library):
    got = byte_pairs.round_trip(table(spark, rows), FILE)
    want = []
    for key, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    assert Counter((k, bytes(i), d) for k, i, d in got.collect()) == Counter(want)
    shown = {r["doc_id"]: r for r in byte_pairs.digests(got).collect()}
    assert shown[12]["n_tokens"] == len(library.encode(AWKWARD[12]).ids) and shown[0]["n_tokens"] == 0
    assert shown[12]["ids_sha256"] == hashlib.sha256(next(i for k, i, _ in want if k == 12)).hexdigest()
    assert byte_pairs.round_trip(table(spark, []), FILE).count() == 0


def test_every_character(library):
    """Each code point alone, behind a letter and behind a space; the library's Unicode version decides."""
    pairs = byte_pairs.BytePairs(FILE)
    points = [chr(c) for c in [*range(0x3000), *range(0xA640, 0xA830), *range(0x10900, 0x11000), *range(0x1E600, 0x1E700), *range(0x1F300, 0x1F400), 0x3D000, 0x10FFFF]]
    for start in range(0, len(points), 512):
        text = "".join(f"{c}a{c} {c}{c}1\n" for c in points[start : start + 512])
        ids = library.encode(text, add_special_tokens=False).ids
        own = pairs.encode(text)
        assert own == struct.pack(f"<{len(ids)}I", *ids)
        assert pairs.decode(own) == text == library.decode(ids, skip_special_tokens=False)


def brute_merge(pairs, word):
    ids = [pairs.of_byte[b] for b in word]
    while True:
        found = [(pairs.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs.merges]
        if not found:
            return ids
        _, i = min(found)
        ids[i : i + 2] = [pairs.merges[ids[i], ids[i + 1]][1]]


def test_queue_against_rescans():
    pairs, rng = byte_pairs.BytePairs(FILE), random.Random(2)
    for alphabet in ("ab", "aeiounst", " theraion", "\xc3\xa9\xe2\x80"):
        for _ in range(150):
            word = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))).encode("latin-1")
            assert pairs.merge(word) == brute_merge(pairs, word)
    start = time.perf_counter()
    assert len(pairs.merge(b"ab" * 300_000)) > 0
    assert time.perf_counter() - start < 30


def test_broken_bytes_and_other_files():
    pairs = byte_pairs.BytePairs(FILE)
    lone = struct.pack("<3I", pairs.of_byte[0xE2], pairs.of_byte[0x82], pairs.of_byte[ord("x")])
    assert pairs.decode(lone) == b"\xe2\x82x".decode("utf-8", "replace")
    with pytest.raises(ValueError, match="byte-level"):
        byte_pairs.BytePairs(public_tokenizers.path("word_bpe_49k.json"))
