"""Operator 13: importance resampling of documents towards a target distribution.

1. Features are the runs of one and two words of a text. In a task the distinct features
   of a block of texts are grouped by their length in bytes into matrices of uint8, a row a
   feature; the CRCs of all rows are updated column by column, and the buckets scattered
   back to where the features stand. Bytes beyond ``LONG`` are cut into blocks of
   that length, which are rows of one more matrix; their CRCs are joined by the
   operator that appends as many zero bytes, so a long word costs no long loop.
2. A task returns each document's bucket counts and one row of sums over all it read.
   The sums give each bucket a gain; the model is ``buckets`` numbers, whatever the corpus.
3. A document's weight is the mean gain of its features; with Gumbel noise from a hash of
   its id, the highest scores are a draw without replacement in proportion to exp(weight).
   Ranks come from a range partitioning of slim rows and the row counts of its partitions,
   so no task sorts all scores.

Defined results: a null or empty text has no features and weight 0; a null doc_id counts as
the empty text in the hash and comes after all others in a tie; repeated rows are documents of
their own (equal scores, neighbouring ranks); no target, or no documents, gives gains of
which all documents get the same share; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table
from .words import numbered, ragged, separators, slices

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Bytes of words: digits, a-z (A-Z lowered) and all beyond ASCII.
WORD_BYTES = separators(bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)), lower=True)
#: Longer features are cut into blocks of so many bytes.
LONG = 256
#: Cells of a matrix of features that are filled at once.
CELLS = 1 << 19
ALL_ONES = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    """The 256 remainders of the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


TABLE = crc_table()


def updated(states: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The CRC registers ``states`` after the rows of a uint8 matrix, column by column."""
    for column in matrix.T:
        states = TABLE[(states ^ column) & np.uint32(255)] ^ (states >> np.uint32(8))
    return states


def zeros_appended() -> np.ndarray:
    """(4, 256): what each byte of a register becomes under LONG zero bytes; registers are linear in their bits."""
    starts = np.arange(256, dtype=np.uint32)
    return np.stack([updated(starts << np.uint32(8 * k), np.zeros((256, LONG), np.uint8)) for k in range(4)])


ZEROS = zeros_appended()


def crcs(buffer: np.ndarray, first: np.ndarray, first_len: np.ndarray, second: np.ndarray, second_len: np.ndarray) -> np.ndarray:
    """CRC32 of each feature: ``first_len`` bytes of ``buffer`` at ``first`` and, where ``second`` >= 0, a space and those at ``second``.

    The byte of ``buffer`` at its end is a space.
    """
    space = len(buffer) - 1
    total = first_len + np.where(second >= 0, second_len + 1, 0)

    def matrix(rows: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
        """Bytes ``begin`` to ``begin + length`` of the features ``rows``, a row each; columns lie together in memory."""
        at = begin + np.arange(length)[:, None]
        own = first_len[rows]
        return buffer[np.where(at < own, first[rows] + at, np.where(at == own, space, second[rows] + at - own - 1))].T

    head = np.where(total > LONG, total % LONG, total)  # the rest is whole blocks
    states = np.full(len(total), ALL_ONES, np.uint32)
    order = np.argsort(head, kind="stable")
    for length, rows in zip(*grouped(head[order], order), strict=True):
        step = max(1, CELLS // max(1, length))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            states[part] = updated(states[part], matrix(part, np.zeros(len(part), np.int64), int(length)))
    for k in np.flatnonzero(total > LONG):
        state = int(states[k])
        begins = np.arange(head[k], total[k], LONG)
        for at in range(0, len(begins), CELLS // LONG):
            part = begins[at : at + CELLS // LONG]
            blocks = updated(np.zeros(len(part), np.uint32), matrix(np.full(len(part), k), part, LONG))
            for block in blocks.tolist():
                state = int(ZEROS[0, state & 255] ^ ZEROS[1, state >> 8 & 255] ^ ZEROS[2, state >> 16 & 255] ^ ZEROS[3, state >> 24]) ^ block
        states[k] = state
    return states ^ ALL_ONES


def grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct sorted ``keys`` and the run of ``values`` of each."""
    distinct, starts = np.unique(keys, return_index=True)
    return distinct, np.split(values, starts[1:]) if len(distinct) else []


def block_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of the texts."""
    numbers, lengths, words = numbered(texts, WORD_BYTES)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    buffer = np.frombuffer(b"".join(words) + b" ", np.uint8)
    none = np.full(len(words), -1, np.int64)
    single = crcs(buffer, starts, sizes, none, none) % np.uint32(buckets)
    row, position = ragged(lengths)
    follows = np.flatnonzero(position > 0)
    pairs, back = np.unique(numbers[follows - 1] * max(len(words), 1) + numbers[follows], return_inverse=True)
    a, b = np.divmod(pairs, max(len(words), 1))
    double = crcs(buffer, starts[a], sizes[a], starts[b], sizes[b]) % np.uint32(buckets)
    return np.concatenate([row, row[follows]]), np.concatenate([single[numbers], double[back]]).astype(np.int64)


def featurized(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, n_features, found, counts): a row per document with its distinct buckets and their counts, as uint32 bytes.

    A task adds one row without ``n_features``, whose ``sums`` are the counts of all buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kind = np.zeros(buckets, np.int64), None
        for batch in batches:
            kind = batch.column("doc_id").type
            for part in slices(batch):
                row, bucket = block_buckets(part.column("text"), buckets)
                sums += np.bincount(bucket, minlength=buckets)
                cells, times = np.unique(row * buckets + bucket, return_counts=True)
                row, bucket = np.divmod(cells, buckets)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                n = np.add.reduceat(np.append(times, 0), ends[:-1]) * (np.diff(ends) > 0)
                found, counts = bucket.astype("<u4"), times.astype("<u4")
                as_bytes = lambda x, ends=ends: pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), as_bytes(found), as_bytes(counts), pa.nulls(part.num_rows, pa.list_(pa.int64()))],
                    names=["doc_id", "n_features", "found", "counts", "sums"],
                )
        if kind is not None:
            empty = [pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["doc_id", "n_features", "found", "counts", "sums"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_features long, found binary, counts binary, sums array<long>")


def bucket_sums(features: DataFrame) -> DataFrame:
    """(bucket, n) over all documents; a row per bucket and task is summed."""
    rows = features.filter("sums is not null").select(F.posexplode("sums").alias("bucket", "n"))
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, ``buckets`` numbers: floor(1000 * ln of the ratio of smoothed shares)."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    rows = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).collect()  # at most ``buckets`` rows
    all_s, all_t = sum(r.s for r in rows), sum(r.t for r in rows)
    gains = np.full(buckets, math.floor(1000 * math.log((all_s + buckets) / (all_t + buckets))), np.int64)
    for r in rows:
        gains[r.bucket] = math.floor(1000 * math.log(float(r.t + 1) * (all_s + buckets) / (float(r.s + 1) * (all_t + buckets))))
    return gains


def weighed(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight): the floored mean gain of a document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for n, found, counts in zip(*(batch.column(c).to_pylist() for c in ("n_features", "found", "counts")), strict=True):
                total = gains[np.frombuffer(found, "<u4")] @ np.frombuffer(counts, "<u4").astype(np.int64)
                weights.append(int(total) // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_features"), pa.array(weights, pa.int64())], names=["doc_id", "n_features", "weight"])

    kind = features.schema["doc_id"].dataType.simpleString()
    rows = features.filter("n_features is not null").select("doc_id", "n_features", "found", "counts")
    return rows.mapInArrow(run, f"doc_id {kind}, n_features long, weight long")


def numbered_in_order(rows: DataFrame, *order) -> DataFrame:
    """Adds ``place`` (1, 2, ...) in the given order over all rows, from ranges of rows and their sizes."""
    mask = (1 << 33) - 1
    sorted_ = materialize(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # a row per partition of the sort
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    joined = sorted_.withColumn("_part", part).join(starts, "_part")
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND(mask) + 1).alias("place"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; ``rank`` is null where it is not drawn.

    Of the documents with at least ``least_words`` words, ``share`` percent are drawn.
    """
    features = materialize(featurized(docs, buckets), "features")
    gains = bucket_gains(bucket_sums(features), bucket_sums(featurized(target.select(F.lit(0).alias("doc_id"), "text"), buckets)), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = weighed(features, gains).withColumn("score", F.col("weight") + noise)
    # a text of n words has 2n - 1 features
    rows = materialize(rows.withColumn("eligible", F.col("n_features") + 1 >= 2 * least_words), "weighed")
    drawn = rows.filter("eligible").count() * share // 100
    placed = numbered_in_order(rows, F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"))
    rank = F.when(F.col("eligible") & (F.col("place") <= drawn), F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance_resampling(spark, sf_dir):
    documents, benchmark = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resample(documents, benchmark)


#: CRC32 of the distinct features, byte by byte over the table that the polynomial gives.
OP13_SQL = r"""
WITH RECURSIVE bits(i, step, v) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE step < 8
), tab AS (
  SELECT list(v ORDER BY i) AS t FROM bits WHERE step = 8
), texts AS (
  SELECT 'd' AS part, doc_id::BIGINT AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark
), words AS (
  SELECT part, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT part, id, unnest(w) AS f FROM words
  UNION ALL SELECT part, id, w[i] || ' ' || w[i + 1] FROM (SELECT part, id, w, unnest(range(1, len(w))) AS i FROM words)
), counted AS (
  SELECT part, id, f, count(*) AS n FROM features GROUP BY ALL
), bytes AS (
  SELECT f, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::UBIGINT) AS b
  FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(t[((xor(c, x) & 255) + 1)::BIGINT], c >> 8)), 4294967295::UBIGINT) % 10000 AS bucket
  FROM bytes, tab
), cells AS (
  SELECT part, id, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (f) GROUP BY ALL
), gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM cells WHERE part = 'd') + 10000)
           / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM cells WHERE part = 'b'), 0) + 10000))))::BIGINT AS gain
  FROM (SELECT bucket, sum(n) AS n FROM cells WHERE part = 'd' GROUP BY bucket) s
  LEFT JOIN (SELECT bucket, sum(n) AS n FROM cells WHERE part = 'b' GROUP BY bucket) t ON s.bucket = t.bucket
), weights AS (
  SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
  FROM cells JOIN gains USING (bucket) WHERE part = 'd' GROUP BY id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM documents d LEFT JOIN weights ON d.doc_id = weights.id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 39 AND place <= (SELECT count(*) FROM scored WHERE n_features >= 39) * 25 // 100 THEN place END::BIGINT AS rank
FROM placed
"""
