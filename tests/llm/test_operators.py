"""The dealt operators against brute force and on awkward tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridlake.llm import html_text, jaccard, language, lines, mixing, near_vectors, packing, quality, sharding, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, size string"
SYLLABLES = {"xx": ["ba", "lo", "mi", "tu"], "yy": ["zgr", "kwe", "hny", "oth"]}


def words(rng, n, lang="xx"):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def rows_of_documents():
    rng = random.Random(4)
    out = []
    for i in range(60):
        lang = ("xx", "yy")[i % 2]
        text = "\n".join(" ".join(words(rng, 14, lang)) for _ in range(4))
        out.append((i, text, lang, f"s{i % 3}"))
    out += [(100 + i, out[7][1], "yy", "s0") for i in range(40)]  # a group of copies with two fifths of the rows
    edited = out[4][1].split(" ")
    out += [(200 + i, " ".join([*edited[:i], "changed", *edited[i + 1 :]]), "xx", None) for i in range(6)]
    out += [(300, None, "xx", "s1"), (301, "", None, None), (302, "  \n ", "yy", "s2"), (303, "1234 5678", "xx", "s2"), (304, "babalo", None, "s2")]
    out += [(305, " ".join(words(rng, 9000)), "xx", "s1"), (12, out[12][1], "xx", "s0"), (12, out[12][1], "xx", "s0"), (None, out[9][1], "yy", "s1"), (None, None, None, None)]
    return [(*r, None if r[1] is None else len(r[1]), 0.5, "c", "z") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of_documents(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, shards=7).toPandas()
    assert len(got) == docs.count() and sharding.shard_documents(none).count() == 0
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert set(got["grown_shard"][got["grown_shard"] != got["shard"]]) <= {7}
    more = sharding.shard_documents(docs, shards=8).toPandas()
    key = lambda d, c: sorted(zip(d["doc_id"].fillna(-1), d[c], strict=True))
    assert key(got, "grown_shard") == key(more, "shard")
    empty = got[got["size"] == 16]
    assert len(empty) == 3 and set(empty["text_crc32"]) == {0}


def test_rendezvous_weights(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    share = dict(sharding.rendezvous(rows, "k", [1.0, 3.0]).groupBy("shard").count().collect())
    assert abs(share[1] / 20_000 - 0.75) < 0.02


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target = {s: i % 3 + 1 for i, s in enumerate(order)}, {}
    total, free = sum(sizes.values()), list(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    return target


def test_mixing(docs, none):
    got = mixing.mix_documents(docs).toPandas()
    assert len(got) == docs.count() and mixing.mix_documents(none).count() == 0
    sizes = got.groupby("source", dropna=False)["size"].sum().to_dict()
    sizes = {s if isinstance(s, str) else None: n for s, n in sizes.items()}
    target = brute_targets(sizes)
    for s, own in got.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert np.allclose(own["target"], target[s])
        assert abs(own["taken"].sum() - target[s]) <= own["size"].max()
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix_documents(docs).toPandas()
    assert sorted(got["taken"]) == sorted(again["taken"])
    copies = mixing.repeat_copies(docs)
    assert copies.columns == docs.columns and copies.count() == got["copies"].sum()


def test_unequal_odds_follow_the_weights(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("source"))
    odds = F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(3.0)
    got = mixing.pareto_mix(rows.where("source = '0'").unionByName(rows.where("source = '1'")), F.lit(1), weight=odds, most=1)
    assert got.agg(F.sum("taken")).first()[0] == 4000
    half = mixing.pareto_mix(rows.withColumn("source", F.lit(None).cast("string")), F.when(F.col("doc_id") < 2000, 1).otherwise(1), weight=odds)
    assert half.where("copies > 2").count() == 0


def test_fullest_combination_and_plan():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        own = packing.Lengths(counts, 50)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= 50}
        assert sum(own.lengths[i] * n for i, n in own.fullest()) == max(sums)
        used: dict[int, int] = {}
        for pattern, times in packing.plan_bins(counts, 50):
            assert sum(x * n for x, n in pattern.items()) <= 50
            for x, n in pattern.items():
                used[x] = used.get(x, 0) + n * times
        assert used == counts


def test_packing(docs, none):
    pieces = packing.pack_documents(docs, TOKENIZER, capacity=512, with_ids=True)
    got = pieces.toPandas()
    assert packing.pack_documents(none, TOKENIZER).count() == 0
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = []
    for doc_id, text, *_ in rows_of_documents():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc_id if doc_id is not None else -1, i, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes())) for i, s in enumerate(range(0, len(ids), 512))]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got[cols].fillna(-1).astype("int64").itertuples(index=False, name=None)) == sorted(want)
    assert all(zlib.crc32(np.asarray(x, "<u4").tobytes()) == c for x, c in zip(got["ids"], got["ids_crc32"], strict=True))
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert list(own["offset"]) == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 512
    bins: list[int] = []  # first fit decreasing, for comparison
    for n in sorted(got["length"], reverse=True):
        at = next((i for i, x in enumerate(bins) if x + n <= 512), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    assert got["sequence_id"].nunique() <= len(bins)


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = ["Don't STOP, it's e.g. fine!", "a\x1cb \x1d", "İstanbul ΣΑΣ ß", "x<|endoftext|>y", "éa b　c", "12.5% ... ?!", None, "naïve. Ünï,"]
    got = [x.tolist() for x in packing.Encoder(TOKENIZER)(texts)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_language(docs, none):
    got = language.identify(docs).toPandas().set_index("doc_id")
    assert len(got) == docs.count() and language.identify(none).count() == 0
    assert (got.loc[list(range(60)), "lang_pred"] == [("xx", "yy")[i % 2] for i in range(60) if i != 12 or True for _ in range(3 if i == 12 else 1)]).all()
    for i in (300, 301, 302, 303):
        assert tuple(got.loc[i, ["lang_pred", "score"]]) == ("und", 0.0)
    assert got.loc[304, "lang_pred"] == "xx" and got["score"].between(0, 1).all()
    kept = language.recognised(docs)
    assert kept.columns == docs.columns and kept.where(F.col("doc_id").between(300, 303)).count() == 0
    assert kept.where("doc_id < 60").count() == 62


def test_language_unlabelled(docs):
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_filter_does_not_follow_the_input(spark):
    """A language has the same slots whatever else, and however much of it, is learned beside it."""
    rng = random.Random(29)
    few = [("xx", " ".join(words(rng, 60, "xx"))) for _ in range(10)]
    more = few + [("zz", " ".join("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(8)) for _ in range(2000))) for _ in range(10)]
    small, large = (language.learn(spark.createDataFrame(rows, "lang string, text string"), slots=1 << 14) for rows in (few, more))
    assert small.masks.shape == large.masks.shape == (1, 1 << 14)
    assert ((small.masks & 1) == (large.masks & 1)).all()


@pytest.mark.parametrize("most", [1 << 20, 1 << 14])
def test_language_of_very_many_grams(spark, most):
    rng = random.Random(23)
    noise = lambda n: " ".join("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(8)) for _ in range(n))
    rows = [(lang, " ".join(words(rng, 60, lang))) for lang in ("xx", "yy") for _ in range(20)] + [("zz", noise(500)) for _ in range(10)]
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"), slots=1 << 12, most=most)
    assert model.masks.shape[1] <= most and (model.false_rate <= 0.6**language.HASHES).all()
    score = language._Scorer(model)
    assert [x for x, _ in score([" ".join(words(rng, 30, lang)) for lang in ("xx", "yy") for _ in range(5)])] == ["xx"] * 5 + ["yy"] * 5
    if most == 1 << 20:
        assert score([rows[-1][1]]) == [("zz", 1.0)] and score([noise(50)])[0][1] < 0.3
    with pytest.raises(ValueError):
        language.LanguageFilter(("a",), np.ones((1, 64), np.int64)).false_rate  # noqa: B018


def test_bloom_members_and_correction():
    masks = np.zeros((2, 64), np.int64)
    names = tuple(f"l{i:02}" for i in range(70))
    for slot in language.slots_of(language.gram_hash("ab"), 64):
        masks[1, slot] |= 1 << 3
    model = language.LanguageFilter(names, masks)
    assert model.vector(model.lookup(language.gram_hash("ab"))).nonzero()[0].tolist() == [65]
    assert np.isclose(model.false_rate[65], (np.count_nonzero(masks[1]) / 64) ** language.HASHES)


def test_quality(spark, docs, none):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, 60)) if i % 3 else " ".join(w + "%%" for w in words(rng, 60))) for i in range(300)]
    texts = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(texts, marks).toPandas().set_index("doc_id")
    held = got[got["held_out"] & (got.index < 900)]
    assert len(got) == 302 and len(held) > 30
    assert (held["predicted"] == (held.index % 3 > 0)).all() and got["score"].between(0, 1).all()
    one = quality.classify(texts, marks.where("quality = 1"))
    assert one.select("score").distinct().count() == 1
    assert quality.classify(none, marks).count() == 0 and quality.classify(texts, marks.where("false")).count() == 302


def test_hinge_fit_separates():
    rows = [np.array([0, i % 5 + 2]) if i % 2 else np.array([1, i % 5 + 2]) for i in range(60)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(60)])
    w, b = quality.fit_hinge(rows, [np.ones(2)] * 60, y, 8)
    assert all((w[x].sum() + b) * t > 0.9 for x, t in zip(rows, y, strict=True))


def brute_components(sets, percent):
    ids = list(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [512, 8])
def test_jaccard(docs, none, block):
    got = jaccard.jaccard_components(docs, 4, 85, block=block).toPandas()
    assert len(got) == docs.count()
    sets = {}
    for doc_id, text, *_ in rows_of_documents():
        if doc_id is not None:
            w = (text or "").lower().split()
            sets[doc_id] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    want = brute_components(sets, 85)
    known = got[got["doc_id"].notna()]
    assert {int(i): int(c) for i, c in zip(known["doc_id"], known["component_id"], strict=True)} == want
    assert {int(i): int(n) for i, n in zip(known["doc_id"], known["n_shingles"], strict=True)} == {i: len(s) for i, s in sets.items()}
    if block == 512:
        assert jaccard.jaccard_components(none, 4, 85).count() == 0
        kept = jaccard.one_of_each(docs, 4, 85)
        assert kept.columns == docs.columns
        own = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
        assert sorted(own) == sorted(i for i, c in want.items() if i == c)


def test_jaccard_long_and_chained(spark):
    rng = random.Random(1)
    base, rows = words(rng, 3000), []
    for i in range(30):  # every text is near its neighbours only
        base = [w if rng.random() > 0.008 else "new" + str(rng.random()) for w in base]
        rows.append((i, " ".join(base)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).toPandas()
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(2997)} for i, t in rows}
    assert dict(zip(got["doc_id"], got["component_id"], strict=True)) == brute_components(sets, 85)


def test_one_of_each_without_usable_ids(spark):
    rng = random.Random(21)
    texts = [" ".join(words(rng, 40)) for _ in range(6)]
    near = texts[1] + " end"
    rows = [(None, texts[0]), (None, texts[1]), (None, near), (7, texts[2]), (7, texts[3]), (8, texts[3] + " end"), (9, texts[4]), (9, texts[4]), (None, texts[5]), (3, texts[5]), (None, None), (None, ""), (7, None)]
    left = [tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(left) == 9 and sum(r in left for r in ((None, texts[1]), (None, near))) == 1
    assert {(None, texts[0]), (7, texts[2]), (7, texts[3]), (9, texts[4]), (3, texts[5]), (None, None), (None, ""), (7, None)} <= set(left)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited_pairs(n):
    rng = random.Random(5)
    for _ in range(n):
        a = [rng.choice("abcé") for _ in range(rng.randint(20, 70))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(("", "z", "a"))
        yield "".join(a), "".join(b)


def test_banded_distance_and_segments():
    pairs = [(a, b) for a, b in edited_pairs(400) if min(len(a), len(b)) >= 20]
    exact = np.array([distance(a, b) for a, b in pairs])
    for k in (1, 2, 3):
        got = lines.within_edits([a for a, _ in pairs], [b for _, b in pairs], np.full(len(pairs), k), k)
        assert (got == (exact <= k)).all()
    for (a, b), d in zip(pairs, exact, strict=True):
        if d <= 2:
            number, key, indexed = lines.segment_keys([a, b])
            own = lambda i, only: set(key[(number == i) & (indexed | (not only))])
            assert own(0, True) & own(1, False) or own(1, True) & own(0, False)


def test_lines(spark, docs, none):
    pairs = list(edited_pairs(40))
    rows = [(i, "\n".join([a, b, "", "short", f"line {i} with nothing like it {i * 7919}"])) for i, (a, b) in enumerate(pairs)]
    rows += [(50, pairs[0][0]), (51, pairs[0][0]), (52, None), (53, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))
    got = sorted(map(tuple, lines.line_classes(table).select("doc_id", "line_no", "class_doc_id", "class_line_no", "n_links").collect()))
    every = [(i, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    link = lambda a, b: len(a) >= 8 and len(b) >= 8 and (a == b or distance(a, b) <= min(2, min(len(a), len(b)) // 20))
    root = list(range(len(every)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(every)
    for i in range(len(every)):
        for j in range(i):
            if abs(len(every[i][2]) - len(every[j][2])) <= 2 and link(every[i][2], every[j][2]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == [(i, k, *every[find(n)][:2], links[n]) for n, (i, k, _) in enumerate(every)]
    assert lines.line_classes(none).count() == 0
    left = lines.without_repeated_lines(docs)
    assert left.columns == docs.columns
    by_id = {r["doc_id"]: r for r in left.collect()}
    assert by_id[7]["text"] == rows_of_documents()[7][1] and not any(100 <= (i or 0) < 140 for i in by_id)
    assert all(r["n_chars"] == len(r["text"]) for r in by_id.values() if r["text"] is not None)


def test_lines_of_any_length(spark):
    rng = random.Random(24)
    base, rows = [], []
    for n in (20, 45, 75, 79, 80, 130, 300, 330, 500, 700):
        base.append("".join(rng.choice("abcdefgh ") for _ in range(n)).replace("  ", "ab").ljust(n, "x"))
        rows.append(base[-1])
        for edits in (n // 20, n // 20 + 1, n // 40):  # evenly spread, so that no long stretch is left alone
            b = list(base[-1])
            for i in range(edits):
                at = int((i + 0.5) * n / edits)
                b[at] = rng.choice(("Z", "", b[at] + "Y"))
            rows.append("".join(b))
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(map(tuple, lines.line_classes(table, most=None).select("doc_id", "class_doc_id", "n_links").collect()))
    near = [[i != j and (rows[i] == rows[j] or distance(rows[i], rows[j]) <= min(len(rows[i]), len(rows[j])) // 20)
             if abs(len(rows[i]) - len(rows[j])) <= 35 else False for j in range(len(rows))] for i in range(len(rows))]
    root = lines.roots(len(rows), *np.nonzero(near))
    assert got == [(i, root[i], sum(near[i])) for i in range(len(rows))]
    assert lines.whole_distance(rows[-4], rows[-1]) == distance(rows[-4], rows[-1])


def test_repeated_lines_without_usable_ids(spark):
    rng = random.Random(22)
    a, b, c, d, e, f, same = (" ".join(words(rng, 14)) for _ in range(7))
    rows = [(1, same), (None, f"{a}\n{same}"), (None, f"{b}\n{c}"), (5, f"{d}\n{same}"), (5, f"{e}\n{f}"), (None, c)]
    left = lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] or 0, r["text"]) for r in left)
    assert [x for x in got if x[0]] == sorted([(1, same), (5, d), (5, f"{e}\n{f}")])
    # which of the two rows without an id keeps the line they share is left to their hashes
    assert got[: len(left) - 3] in (sorted([(0, a), (0, f"{b}\n{c}")]), sorted([(0, a), (0, b), (0, c)]))


PAGE = (
    '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/x">Home page</a></nav>'
    '<div class="cookie-notice">We use cookies and more words here</div><article><h1>Title &amp; more</h1><p>First   <b>bold</b>\n text &lt;x&gt;.<p>Second 1 &lt; 2'
    '<div class="ad">buy buy buy buy</div></article><section id="comments"><p>Reader says a great many words that are not the article at all</p></section>'
    "<aside>Side</aside><footer>&copy; me</footer></body></html>"
)
TEXT = "Title & more\nFirst bold text <x>.\nSecond 1 < 2"


def test_html(spark):
    bare = PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>")
    rows = [(i, f"u{i}", PAGE) for i in range(5)] + [(10, None, None), (11, "u", ""), (12, "u", "<p>"), (13, "u", bare), (14, "u", "plain words < only"), (15, "u", PAGE[: PAGE.index("</article>")])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = {r["page_id"]: r for r in html_text.extract_pages(pages).collect()}
    assert {got[i]["text"] for i in (0, 1, 2, 3, 4, 13, 15)} == {TEXT}
    assert [got[i]["text"] for i in (10, 11, 12, 14)] == ["", "", "", "plain words < only"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract_pages(pages.where("false")).count() == 0


def test_best_region():
    rng = random.Random(2)
    for _ in range(50):
        scores = [rng.randint(-5, 5) for _ in range(12)]
        best = max(sum(scores[i:j]) for i in range(12) for j in range(i + 1, 13))
        found = html_text.best_region(scores)
        assert (sum(scores[slice(*found)]) if found else 0) == max(best, 0)


def vector_rows():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    near = np.concatenate([base[:6] + rng.standard_normal((6, 16)) * s for s in (0.02, 0.1, 0.14) for _ in range(12)])
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 2) if i < 60 else 1) for i, v in enumerate(np.concatenate([base, near]))]
    n = len(rows)
    rows += [(n + i, rows[3][1], 1) for i in range(8)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    return rows + [(1000 + i, v, 1) for i, v in enumerate(bad)] + [(1100, rows[0][1], None), (1101, rows[0][1], 0)]


def test_near_vectors(spark):
    rows = vector_rows()
    got = {r["vec_id"]: r for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.98).collect()}
    good = [(i, np.array(v), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: {j for j, w, z in good if j != i and z == y and len(w) == len(v) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98} for i, v, y in good}
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(rows) and all(r["n_links"] <= len(links.get(i, ())) for i, r in got.items())
    assert found >= 0.97 * sum(map(len, links.values()))
    assert all(r["component_id"] == i and r["kept"] for i, r in got.items() if i >= 1000 and i != 1101)
    assert all(got[i]["component_id"] == 3 for i, v, y in good if v.tolist() == rows[3][1] and y == 1)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors.near_duplicates(empty).count() == 0


def test_collision_count_is_calibrated():
    n = near_vectors.least_count(0.98)
    rng = np.random.default_rng(0)
    apart = np.abs(rng.standard_normal((4000, near_vectors.POOL)) * np.sqrt(0.04)) <= near_vectors.WINDOW
    assert (apart.sum(1) >= n).mean() > 0.999 and 0 < n < near_vectors.POOL


def test_topk(spark):
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, topk.search(table, every=10, k=5).select("query_id", "rank", "vec_id", "score").collect()))
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()]
    want = []
    for i, v in good:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i and len(w) == len(v))[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.search(table.where("false")).count() == 0


def test_pivot_bounds_hold():
    rng = np.random.default_rng(3)
    rows = rng.integers(-200, 200, (300, 8))
    greatest = float((rows * rows).sum(1).max())
    cell = topk._Cell(np.arange(300), rows, rows[:16], greatest)
    assert (cell.bounds(rows[:40]) >= rows[:40] @ rows.T).all()
