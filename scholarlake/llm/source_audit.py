"""Operator 12: how far each source's words diverge from those of the other sources of its language.

1. A task counts terms of its documents per (lang, source) with the number of documents;
   sums are dealt by (lang, term), so no source or language is one task's load.
2. A language keeps the terms of at least ``least_docs`` documents. A kept term is a row of
   nonzero counts in source order, already as the sources' smoothed shares p; equal rows are one with a multiplicity.
3. Between two sources the divergence is a sum over all kept terms. Where neither has a
   term the summand is one constant, where one has it the sum follows from that
   source's histogram of p. What is left are corrections of terms that both have: the rows,
   sorted, are inserted into frequent-pattern trees, a node for each distinct prefix, and
   each pair (node, ancestor) adds its correction once, times the rows below. Rows of a tree
   are neighbours of a range partitioning, so they share long prefixes.
4. Integers throughout: p, its squares and their sums stay below 2^62.

Defined results: null text, lang and source are ''; every row is a document, repeated ids
too; a group without kept terms has p of zero counts, and in a language without kept
terms all pairs have 0; ties go by item; texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, near, read_table
from .words import numbered, separators, slices

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Bytes of terms: a-z (A-Z lowered) and all beyond ASCII.
TERM_BYTES = separators(bytes(range(97, 123)) + bytes(range(128, 256)), lower=True)
#: Cells (rows x longest row) of the sorted rows that make a tree.
CELLS = 1 << 20
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed over the blocks of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=16 << 20):
                numbers, lengths, words = numbered(part.column("text"), TERM_BYTES)
                if not len(words):
                    continue
                found: dict[tuple[str, str], int] = {}
                group = np.array([found.setdefault(g, len(found)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)])
                cells, times = np.unique(np.repeat(np.arange(len(lengths)), lengths) * len(words) + numbers, return_counts=True)
                doc, term = np.divmod(cells, len(words))
                cells, back, docs_ = np.unique(group[doc] * len(words) + term, return_inverse=True, return_counts=True)
                n = np.zeros(len(cells), np.int64)
                np.add.at(n, back, times)
                group, term = np.divmod(cells, len(words))
                langs, sources = (pa.array(x, pa.string()) for x in zip(*found, strict=True))
                terms = pa.array(words, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(group)), sources.take(pa.array(group)), terms.take(pa.array(term)), pa.array(n), pa.array(docs_.astype(np.int64))],
                    names=["lang", "source", "term", "n", "docs"],
                )

    counted = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # one exchange serves the sums per source and, below, those per term
    return counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / size), exact beyond 64 bits."""
    return 1 + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), size.cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_corrections(paths: DataFrame) -> DataFrame:
    """(lang, a, b, value): of each part of the sorted rows, what terms that sources a and b both have add to the sum with a's p over b's.

    ``paths``: lang, path (array of number, p, zero: the source's number, its p of the term and of a zero count), copies.
    """

    def tree(lang: str, lists: pa.Array, copies: np.ndarray) -> Iterator[pa.RecordBatch]:
        lengths = np.asarray(lists.value_lengths()).astype(np.int64)
        values = lists.flatten()
        depth = int(lengths.max())
        row, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        fields = {}
        for name in ("number", "p", "zero"):
            fields[name] = np.zeros((len(lengths), depth), np.int64)
            fields[name][row, place] = np.asarray(values.field(name))
        number, p, zero = fields["number"], fields["p"], fields["zero"]
        sums: dict[int, int] = {}
        new = np.arange(len(lengths)) == 0
        for d in range(depth):
            # a row starts a node where its prefix differs from that of the row before
            new = new | np.concatenate([[True], (number[1:, d] != number[:-1, d]) | (p[1:, d] != p[:-1, d])])
            there = lengths > d
            nodes = np.flatnonzero(new & there)
            if not d or not len(nodes):
                continue
            # rows of a prefix are neighbours; those that end before are not among them
            times = np.add.reduceat(np.where(there, copies, 0), nodes)
            b, pb, zb, a, pa_, za = number[nodes, d, None], p[nodes, d, None], zero[nodes, d, None], number[nodes, :d], p[nodes, :d], zero[nodes, :d]
            width = int(number.max()) + 1
            for left, right, x, zx, y, zy in ((a, b, pa_, za, pb, zb), (b, a, pb, zb, pa_, za)):
                value = divergences(x, y) - divergences(x, zy) - divergences(zx, y) + divergences(zx, zy)
                cells, back = np.unique((left * width + right).ravel(), return_inverse=True)
                total = np.zeros(len(cells), np.int64)
                np.add.at(total, back, (value * times[:, None]).ravel())
                for cell, t in zip(cells.tolist(), total.tolist(), strict=True):
                    sums[cell] = sums.get(cell, 0) + t
            if len(sums) > CELLS:
                yield batch_of(lang, sums, width)
                sums = {}
        if sums:
            yield batch_of(lang, sums, int(number.max()) + 1)

    def batch_of(lang: str, sums: dict[int, int], width: int) -> pa.RecordBatch:
        a, b = np.divmod(np.fromiter(sums, np.int64, len(sums)), width)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), pa.array(a), pa.array(b), pa.array(list(sums.values()), pa.int64())], names=["lang", "a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lists, copies = batch.column("lang"), batch.column("path"), np.asarray(batch.column("copies"))
            same = np.asarray(langs.dictionary_encode().indices)
            lengths, at = np.asarray(lists.value_lengths()), 0
            while at < len(same):
                end = at + int((np.append(same[at:], -1) != same[at]).argmax())
                longest = np.maximum.accumulate(lengths[at:end]).astype(np.int64) * np.arange(1, end - at + 1)
                end = at + max(1, int(np.searchsorted(longest, CELLS, side="right")))
                yield from tree(langs[at].as_py(), lists.slice(at, end - at), copies[at:end])
                at = end

    return paths.mapInArrow(run, "lang string, a long, b long, value long")


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, source, n, total) of the terms that a language keeps."""
    per_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).select("*", F.sum("docs").over(per_term).alias("all_docs"), F.sum("n").over(per_term).alias("total"))
    return materialize(counts.filter(F.col("all_docs") >= least_docs).drop("docs", "all_docs"), "kept-terms")


def numbered_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, number, size, lang_size, terms, zero): every group; size N + V, ``zero`` its p of a zero count, ``number`` its place among the language's sources."""
    sizes = kept.groupBy(*GROUP).agg(F.sum("n").alias("n"))
    # each kept term once per language: its rows all carry its total
    langs = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n"))
    groups = docs.select(*GROUP).distinct().join(sizes, GROUP, "left").join(langs, "lang", "left")
    terms = F.coalesce("terms", F.lit(0)).cast("long")
    # a row per source of a language, as many as each row of the result's ``pair`` part ranks
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = groups.select(*GROUP, number.alias("number"), terms.alias("terms"), (F.coalesce("n", F.lit(0)) + terms).alias("size"), (F.coalesce("lang_n", F.lit(0)) + terms).alias("lang_size"))
    return materialize(groups.withColumn("zero", F.when(F.col("size") > 0, share(F.lit(0), F.col("size")))), "groups")


def divergent_terms(items: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group has more often than its language, up to rank ``top``."""
    q = share(F.col("total"), F.col("lang_size"))
    rows = items.withColumn("q", q).filter("p > q").select(*GROUP, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    # Spark keeps the first ``top`` of each task before the exchange
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top)


def source_pairs(items: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other one of its language. ``count`` groups."""
    entry = F.struct("number", "p", "zero")
    rows = items.groupBy("lang", "term").agg(F.array_sort(F.collect_list(entry)).alias("path"))
    paths = rows.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("copies"))
    corrections = pair_corrections(paths.orderBy("lang", "path"))
    # what a term that only one of the two has adds to the constant of a term that neither has
    histogram = items.groupBy("lang", "number", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "number").agg(F.collect_list(F.struct("p", "n")).alias("histogram"))
    others = groups.filter("terms > 0").groupBy("lang").agg(F.collect_list(F.struct("number", "zero")).alias("others"))
    own = groups.filter("terms > 0").select("lang", "number", "zero", "terms").join(near(count)(histogram), ["lang", "number"], "left").join(near(count)(others), "lang")
    other = F.explode("others").alias("other")
    zero, far = F.col("zero"), F.col("other.zero")

    def singles(value) -> Column:
        return F.aggregate(F.coalesce("histogram", F.array().cast("array<struct<p:bigint,n:bigint>>")), F.lit(0).cast("long"), lambda sum_, x: sum_ + x["n"] * value(x["p"]))

    each = own.select("*", other).filter(F.col("number") != F.col("other.number")).select(
        "lang", "number", F.col("other.number").alias("far"),
        singles(lambda p: divergence(p, far) - divergence(zero, far)).alias("as_p"), singles(lambda p: divergence(far, p) - divergence(far, zero)).alias("as_q"),
        (F.col("terms") * divergence(zero, far)).alias("base"),
    )
    parts = each.select("lang", F.explode(F.array(
        F.struct(F.col("number").alias("a"), F.col("far").alias("b"), (F.col("as_p") + F.col("base")).alias("value")), F.struct(F.col("far").alias("a"), F.col("number").alias("b"), F.col("as_q").alias("value")),
    )).alias("x")).select("lang", "x.*")
    sums = parts.unionByName(corrections).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "number", "source")
    named = sums.join(near(count)(names.withColumnRenamed("number", "a")), ["lang", "a"])
    return named.join(near(count)(names.select("lang", F.col("number").alias("b"), F.col("source").alias("item"))), ["lang", "b"]).select(*GROUP, "item", "value")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` ranks a group's other sources, part ``term`` its most divergent terms."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = kept_terms(docs, least_docs)
    groups = numbered_groups(docs, kept)
    count = groups.count()
    items = kept.join(near(count)(groups), GROUP).withColumn("p", share(F.col("n"), F.col("size")))
    terms = divergent_terms(items, top)
    # sources of a language without kept terms are as near as can be
    bare = groups.filter("terms = 0").select("lang", "source")
    nothing = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = source_pairs(items, groups, count).unionByName(nothing.select(*GROUP, "item", "value"))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    both = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select(*GROUP, "part", "item", "value", "rank")


def op12_source_audit(spark, sf_dir):
    return source_divergence(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), terms AS (
  SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), vocabulary AS (
  SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM vocabulary GROUP BY lang
), counts AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN vocabulary USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT d.lang, d.source, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) d
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) s ON d.lang = s.lang AND d.source = s.source
), shares AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + l.v)::HUGEINT)::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (v.n + 1)) // (l.n + l.v)::HUGEINT)::HUGEINT AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN vocabulary v ON g.lang = v.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (
    SELECT * FROM all_pairs UNION ALL
    SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
  )
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
