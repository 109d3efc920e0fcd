"""Operator 2: drop lines that many documents share.

Lines are exploded to hashes (never their text), counted per distinct document
with partial aggregation, and lines over the threshold are dropped by position
from every document but the one that keeps them.

Defined results: a null or empty text is one empty line; a null doc_id counts as
one document, sorts below every other and never keeps a line unless all holders
are null; rows repeated with the same doc_id are one document; texts of any length are
split whole; an empty table gives none; columns beside doc_id and text pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, BROADCAST_ROWS, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


#: A line found more often than this is met apart from the others.
HOT_LINES = 100_000


def frequent_hits(lines: DataFrame, frequent: DataFrame, rows: int) -> DataFrame:
    """Rows of ``lines`` whose key is in ``frequent`` (h1, h2, n, keeper; ``rows`` rows), a hot key never in one task."""
    keys = ["h1", "h2"]
    if rows <= BROADCAST_ROWS:
        return lines.join(F.broadcast(frequent.drop("n")), keys)
    # keys that hold over ``hot`` lines are at most BROADCAST_ROWS, whatever the table's size
    hot = max(HOT_LINES, (frequent.agg(F.sum("n")).first()[0] or 0) // BROADCAST_ROWS)
    common, rest = frequent.filter(F.col("n") > hot).drop("n"), frequent.filter(F.col("n") <= hot).drop("n")
    others = lines.join(F.broadcast(common.select(*keys)), keys, "left_anti")
    return lines.join(F.broadcast(common), keys).unionByName(others.join(rest, keys))


def dropped_positions(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, positions): the lines that each document loses, counted from 0."""
    lines = (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.length("key") >= min_chars)
        # two hashes with different seeds: 128 bits, so that distinct lines of a huge corpus do not meet
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), F.col("key")).alias("h2"))
    )
    lines = materialize(lines, "lines")  # read twice below
    frequent = (
        lines.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("here"))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.sum("here").alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("docs") >= min_docs).drop("docs")
    )
    frequent = materialize(frequent, "frequent-lines")
    hits = frequent_hits(lines, frequent, frequent.count())
    return (
        hits.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("positions"))
    )


RESULTS = ("kept_text", "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The columns of ``docs`` with kept text in ``kept_text``, and n_lines, n_dropped.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents loses all its lines except in the largest doc_id that holds it. Columns of
    ``docs`` that have the name of a result give way to it.
    """
    passed = [c for c in docs.columns if c.lower() not in RESULTS]
    rows = docs.select("doc_id", "text", F.struct(*passed).alias("row"))
    drops = dropped_positions(rows, min_chars, min_docs).withColumnRenamed("doc_id", "drop_id")
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.xxhash64("text") == F.col("text_hash")), "left")
    lines = text_lines(F.col("text"))
    n_lines = F.size(lines)
    keep = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("positions"))  # hashed, in order, linear
    # the text is split once and bound, not once per kept line
    kept = F.transform(F.array(lines), lambda all_: F.array_join(F.transform(keep, lambda i: F.get(all_, i)), "\n"))[0]
    out = joined.select(
        "row",
        F.when(F.col("positions").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(kept).alias("kept_text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out.select(*[F.col("row").getField(c).alias(c) for c in passed], *RESULTS)


def op2_line_dedup(spark, sf_dir):
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (f.key IS NOT NULL AND k.doc_id <> f.keeper) AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
