"""Source divergence audit (operator 12).

Inside tasks an Arrow compute pipeline (``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode``, hash ``group_by``)
turns documents into partial counts per (language, source, term); Spark adds them up. A language keeps the terms
that enough of its documents hold; every source of it and the language itself give each kept term a smoothed probability in billionths,
whole numbers computed with decimals. Sources are compared pairwise by the sum of absolute differences:
the kept counts are dealt into columnar shards of about ``TERMS`` terms by ``SOURCES`` sources of one language, a shard
becomes a dense matrix of whole numbers and gives partial sums per pair, which add up over shards. Terms that a pair of blocks
never holds differ by the sources' probabilities of a count of zero, times their number.

Cases: null text, language and source are read as empty strings; texts without a term still give their group a row
in the comparison; a language that keeps no term has value 0 for every pair and no term rows; repeated rows count
each time; an empty table gives an empty result; a language with one source has no pairs. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.session import materialise

#: What stands between terms: ASCII other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that must hold a term, pseudo-count, scale, term rows per group.
LEAST_DOCUMENTS, PSEUDO, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text that are split at a time.
PART = 16_000_000
#: Terms and sources of one shard (about).
TERMS, SOURCES = 1024, 256


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        limit = (size[start - 1] if start else 0) + PART
        end = max(start + 1, int(np.searchsorted(size, limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def count_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``lang, source, term, n, docs`` of some documents; a null term marks that the group occurs."""
    groups = [pc.fill_null(batch.column(c), "").dictionary_encode() for c in ("lang", "source")]
    lang, source = (g.indices.to_numpy().astype(np.int64) for g in groups)
    group = lang * max(1, len(groups[1].dictionary)) + source
    pieces = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), pattern=BETWEEN)
    terms = pc.list_flatten(pieces).dictionary_encode()
    row, word = pc.list_parent_indices(pieces).to_numpy(), terms.indices.to_numpy()
    # before the first and behind the last separator a piece may be empty
    blank = pc.index(terms.dictionary, "").as_py()
    if blank >= 0:
        row, word = row[word != blank], word[word != blank]
    wide = max(1, len(terms.dictionary))
    in_row = pa.table({"cell": row.astype(np.int64) * wide + word}).group_by("cell").aggregate([([], "count_all")])
    cell = in_row["cell"].to_numpy()
    in_group = pa.table({"cell": group[cell // wide] * wide + cell % wide, "n": in_row["count_all"]}).group_by("cell").aggregate(
        [("n", "sum"), ([], "count_all")])
    cell, seen = in_group["cell"].to_numpy(), np.unique(group)
    own = np.concatenate([cell // wide, seen])
    columns = [
        pc.take(groups[0].dictionary, pa.array(own // max(1, len(groups[1].dictionary)))),
        pc.take(groups[1].dictionary, pa.array(own % max(1, len(groups[1].dictionary)))),
        pc.take(terms.dictionary, pa.array(np.concatenate([cell % wide, np.zeros(len(seen), np.int64)]), mask=np.arange(len(own)) >= len(cell))),
        pa.array(np.concatenate([in_group["n_sum"].to_numpy(), np.zeros(len(seen), np.int64)])),
        pa.array(np.concatenate([in_group["count_all"].to_numpy(), np.zeros(len(seen), np.int64)])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def partial_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts per task and part; sum them by (lang, source, term)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield count_terms(part)

    picked = docs.select(*[F.col(c).cast("string").alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    return picked.mapInArrow(over, "lang string, source string, term string, n long, docs long")


def probability(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + PSEUDO) / (total + PSEUDO * kept))`` in whole numbers of any size."""
    wide = "decimal(19,0)"
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(PSEUDO)).cast(wide)
    below = (total + F.lit(PSEUDO) * kept).cast(wide)
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _pair_sums(table: pa.Table) -> pa.Table:
    """``lang, a, b, part, terms`` of one shard: sums of absolute differences over its terms for each pair of sources."""
    names = table["source"].combine_chunks().dictionary_encode()
    code = names.indices.to_numpy()
    s = len(names.dictionary)
    base, side = np.zeros(s, np.int64), np.zeros(s, np.int64)
    base[code], side[code] = table["base"].to_numpy(), table["side"].to_numpy()
    filled = table["term"].is_valid().to_numpy()
    terms = table["term"].filter(pa.array(filled)).combine_chunks().dictionary_encode()
    t = len(terms.dictionary)
    matrix = np.repeat(base[:, None], t, axis=1)
    matrix[code[filled], terms.indices.to_numpy()] = table["p"].to_numpy()[filled]
    # a block with itself has one side; two blocks meet across
    across = table["one"][0] != table["two"][0]
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(s), np.arange(s))
    found = [(np.empty(0, np.int64),) * 3]
    for i in left.tolist():
        others = right if across else right[right > i]
        sums = np.abs(matrix[others] - matrix[i]).sum(axis=1)
        found.append((np.full(len(others), i), others, sums))
    a, b, sums = (np.concatenate(x) for x in zip(*found, strict=True))
    lang = pa.array([table["lang"][0].as_py()] * len(a), pa.string())
    return pa.table({
        "lang": lang, "a": pc.take(names.dictionary, pa.array(a)), "b": pc.take(names.dictionary, pa.array(b)),
        "part": pa.array(sums, pa.int64()), "terms": pa.array(np.full(len(a), t), pa.int64()),
    })


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources of the language (``pair``) and outstanding terms (``term``)."""
    counts = materialise(
        partial_counts(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(
        F.col("docs") >= least).select("lang", "term", "lang_n")
    kept = materialise(kept, "kept")
    held = materialise(counts.where(F.col("term").isNotNull()).join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "held")
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(size, "lang", "left").join(own, ["lang", "source"], "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "lang_total", "total")])
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / sources).cast("int").alias("blocks"))
    groups = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = groups.withColumn("base", F.when(F.col("kept") > 0, probability(F.lit(0), F.col("total"), F.col("kept"))))
    groups = materialise(groups.withColumn("shards", F.ceil(F.col("kept") / terms).cast("int")), "groups")
    rated = held.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("kept")))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    lang_p = probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    outstanding = rated.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - lang_p).alias("value")).where(
        F.col("value") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # every shard has a row of each of its sources, then their counts; rows go to each pair of blocks they belong to
    marks = groups.where(F.col("shards") > 0).select(
        "lang", "source", "block", "blocks", "base", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(None).cast("string").alias("term"),
        F.lit(0).cast("long").alias("p"))
    cells = rated.select("lang", "source", "block", "blocks", "base", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "term", "p")
    met = marks.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", "shard", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "source", "base", "term", "p")
    sums = met.groupBy("lang", "shard", "one", "two").applyInArrow(_pair_sums, "lang string, a string, b string, part long, terms long")
    # a shard lists its sources in the order its rows came in
    sums = sums.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("part").alias("part"), F.sum("terms").alias("terms"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), F.col("part").alias("_sum"), "terms").select(
        "lang", "x.*", "_sum", "terms")
    # the result itself: each source against each other one of its language
    wanted = groups.select("lang", "source", "kept", "base").join(groups.select("lang", F.col("source").alias("item"), F.col("base").alias("_q")), "lang").where(F.col("source") != F.col("item"))
    away = (F.col("kept") - F.coalesce("terms", F.lit(0))) * F.abs(F.coalesce(F.col("base") - F.col("_q"), F.lit(0)))
    pairs = wanted.join(both, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("_sum", F.lit(0)) + away).alias("value")).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(outstanding)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
occ AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (v.lang_total + 5 * v.v)::HUGEINT AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (
  SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 50
"""
