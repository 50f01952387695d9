"""Cases of the contracts that earlier versions missed."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from gridlake.llm import html_text, language, mixing, near_vectors


def test_repeated_vector_ids_and_extreme_sizes(spark):
    base = [1.0, 2.0, -3.0, 0.5, 4.0, -1.0]
    rows = [(1, base), (1, [-x for x in base[::-1]]), (2, [x * 1.0001 for x in base]), (3, [x * 1e200 for x in base]), (4, [x * 1e-200 for x in base]), (5, [0.0] * 6), (5, None)]
    table = spark.createDataFrame([(i, "a", v) for i, v in rows], "vec_id long, label string, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_duplicates(table).collect())
    assert got == [(1, 0, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 0, 5), (5, 0, 5)]


def test_texts_without_a_letter(spark):
    rows = [(i, "alpha beta gamma delta", "xx", "s") for i in range(30)] + [(100, "² ½ ① ٣ _", None, "s"), (101, "½alpha²beta", None, "s"), (102, "", None, "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.lang_pred for r in language.identify(table).collect()}
    assert got[100] == got[102] == "und" and got[101] == "xx"


ARTICLE = "<h1>A title of the page</h1><p>First words of the text.<p>Second words of it."


def test_names_that_speak_of_others_and_closed_tags(spark):
    plain = f"<html><body><nav><a href='/'>Home and more</a></nav><article>{ARTICLE}</article><footer>foot words</footer></body></html>"
    shapes = [
        f"<body><nav>Home and more</nav><div class='post no-sidebar'>{ARTICLE}</div><footer>foot words</footer></body>",
        f"<body><nav>Home and more</nav><div class='with-sidebar has-comments'>{ARTICLE}</div><div class='sidebar'>side words here</div></body>",
        f"<body><nav>Home and more</nav><article>{ARTICLE.replace('First', '<svg/>First')}</article></body>",
    ]
    rows = [(i, "u", plain) for i in range(5)] + [(10 + i, "u", s) for i, s in enumerate(shapes)] + [(20, "u", "<article><p>sum of <math><mi>x</mi></math> words</article>")]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in (0, 10, 11, 12)} == {"A title of the page\nFirst words of the text.\nSecond words of it."}
    assert got[20] == "sum of x words"


def test_hostile_pages_take_linear_time():
    for piece in ("<div>", "<a ", "</b>", "<!", "<script ", '<a "'):
        start = time.perf_counter()
        html_text.parse(piece * (400_000 // len(piece)))
        assert time.perf_counter() - start < 10, piece


def test_rank_bins_are_even(spark):
    """Whatever the fractional part of a source's copies, no bin holds much more than its share."""
    for part in (0.0001, 0.3, 0.999, 2.9988):
        p = part % 1
        u = (F.col("id") + 0.5) / 40_000
        rank = (u / (1 - u)) / (p / (1 - p))
        sizes = [r["count"] for r in spark.range(40_000).groupBy(mixing.rank_bin(rank, F.lit(part)).alias("b")).count().collect()]
        assert max(sizes) < 400 and len(sizes) > 1000
