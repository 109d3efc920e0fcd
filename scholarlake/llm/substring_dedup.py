"""Operator 11: remove word sequences that occur elsewhere, by difference-cover anchors.

A window is ``width`` consecutive words. Let D be a difference cover modulo ``period``: for
any two positions i and j there is a shift below the period that brings both to positions of
D. So two equal windows hold, at the same shift, equal anchors (windows of width - period + 1
words) that both start at positions of D, and only those need be compared.

1. Anchors at cover positions are hashed, dealt to bins by hash, and those found twice come
   back as positions of their documents. A task sends what it found itself several times
   only once, so a passage of a third of all documents is one entry a task in its bin.
2. Each shared anchor extends to the windows around it, ``period`` at most; they are hashed
   in 64 bits beside a bin that an independent hash gives, and shared ones come back
   alike. An anchor shared by chance costs a few windows and changes nothing.
3. Shared windows become runs of covered words per text, which meet the texts again. Anchors
   and runs grow with the corpus, so the texts are shuffled to them, twice, at every size.

Work is linear in the words, whatever the size of a group of copies: no pair is formed.

Defined results: a null or empty text has no words and keeps ''; rows with a null or
repeated doc_id are documents of their own, so repeated rows of at least ``width`` words lose all their
words; texts of any length are read whole; an empty table gives none; columns beside text pass through unread, those that have the name of a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table
from .words import hashes, numbered, ragged, separators, slices

WIDTH, PERIOD = 35, 13
#: A perfect difference set for each of these periods.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: All bytes but the six ASCII white-space ones belong to words.
WORD_BYTES = separators(bytes(b for b in range(256) if b not in b"\x20\x09\x0a\x0b\x0c\x0d"), lower=False)
#: A bin stands for so many bytes of text; there are at least ``LEAST_BINS``.
BIN_BYTES, LEAST_BINS = 128 << 20, 64
#: Entries that a task gathers before it deals them out.
FLUSH = 2_000_000
FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))
KEYS = ("k1", "k2")
DEALT = "bin int, hashes binary, k1 array<long>, k2 array<long>, counts array<int>, positions array<int>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def inverse(factor: np.uint64) -> np.uint64:
    """The inverse of an odd number modulo 2^64."""
    return np.uint64(pow(int(factor), -1, 1 << 64))


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """Hash of the ``width`` word hashes from each start: differences of running sums of word * factor^place."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(words)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, factor, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:n], dtype=np.uint64)])
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(starts.max()), inverse(factor), np.uint64)]))
    return mixed((sums[starts + width] - sums[starts]) * back[starts])


class Dealer:
    """Gathers (hash, bin hash, key, position) entries and deals them out as rows of ``DEALT``, a few per bin.

    Of entries with one hash only one goes to the hash's bin, without positions, and the
    positions, known to be shared, to bins that only pass them on.
    """

    def __init__(self, bins: int, kind: str):
        self.bins, self.kind, self.parts, self.n = bins, kind, [], 0

    def add(self, main: np.ndarray, other: np.ndarray, k1: np.ndarray, k2: np.ndarray, positions: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((main, other, k1, k2, positions))
        self.n += len(main)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        main, other, k1, k2, positions = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        _, first, back, times = np.unique(main, return_index=True, return_inverse=True, return_counts=True)
        known = times[back] > 1
        bin_ = (other % np.uint64(self.bins)).astype(np.int64)
        hashes_ = main.astype(self.kind)
        rows = []
        single = np.flatnonzero(~known)
        single = single[np.argsort(bin_[single], kind="stable")]
        for at in runs_of(bin_[single]):
            rows.append((int(bin_[single[at[0]]]), hashes_[single[at]].tobytes(), single[at]))
        shared = first[times > 1]
        shared = shared[np.argsort(bin_[shared], kind="stable")]
        for at in runs_of(bin_[shared]):
            rows.append((int(bin_[shared[at[0]]]), hashes_[shared[at]].tobytes(), None))
        passed = np.flatnonzero(known)
        for at in range(0, len(passed), 1 << 16):
            part = passed[at : at + (1 << 16)]
            rows.append((int(bin_[part[0]]), None, part))
        for at in range(0, len(rows), 64):
            yield dealt_batch(rows[at : at + 64], k1, k2, positions)


def runs_of(keys: np.ndarray) -> list[np.ndarray]:
    """Index ranges of equal neighbouring keys."""
    return np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1) if len(keys) else []


def dealt_batch(rows: list[tuple], k1: np.ndarray, k2: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    columns = [[], [], [], [], [], []]
    for bin_, hashes_, at in rows:
        values = [bin_, hashes_, None, None, None, None]
        if at is not None:
            change = np.flatnonzero(np.concatenate([[True], (np.diff(k1[at]) != 0) | (np.diff(k2[at]) != 0)]))
            values[2:] = k1[at][change], k2[at][change], np.diff(np.append(change, len(at))), positions[at]
        for column, value in zip(columns, values, strict=True):
            column.append(value)
    types = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bin", "hashes", *KEYS, "counts", "positions"])


def shared_positions(dealt: DataFrame, kind: str) -> DataFrame:
    """(k1, k2, positions) of the entries whose hash occurs at least twice in its bin, a row per document."""

    def meet(table: pa.Table) -> pa.Table:
        found = [None if h is None else np.frombuffer(h, kind) for h in table.column("hashes").to_pylist()]
        lists = {c: table.column(c).combine_chunks() for c in (*KEYS, "counts", "positions")}
        known = [h is not None and not p.is_valid for h, p in zip(found, lists["positions"], strict=True)]
        there = [h for h in found if h is not None]
        everything = np.concatenate(there) if there else np.empty(0, kind)
        _, back, times = np.unique(everything, return_inverse=True, return_counts=True)
        if any(known):  # found twice by one task
            ends = np.cumsum([len(h) for h in there])
            flags = np.repeat([k for k, h in zip(known, found, strict=True) if h is not None], np.diff(ends, prepend=0))
            times += np.bincount(back[flags], minlength=len(times))
        twice, at, out = times[back] > 1, 0, []
        for k, h in enumerate(found):
            own = None if h is None else twice[at : at + len(h)]
            at += 0 if h is None else len(h)
            if known[k] or own is not None and not own.any():
                continue
            k1, k2, counts, positions = (np.asarray(lists[c][k].values) for c in (*KEYS, "counts", "positions"))
            if own is not None:
                which = np.repeat(np.arange(len(counts)), counts)[own]
                positions = positions[own]
                counts = np.bincount(which, minlength=len(counts))
                k1, k2, counts = k1[counts > 0], k2[counts > 0], counts[counts > 0]
            out.append((k1, k2, counts, positions))
        if not out:
            return pa.table({"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int64()), "positions": pa.array([], pa.list_(pa.int32()))})
        k1, k2, counts, positions = (np.concatenate(x) for x in zip(*out, strict=True))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.table({"k1": k1, "k2": k2, "positions": pa.ListArray.from_arrays(pa.array(offsets), pa.array(positions.astype(np.int32)))})

    met = dealt.groupBy("bin").applyInArrow(meet, "k1 long, k2 long, positions array<int>")
    return met.groupBy(*KEYS).agg(F.flatten(F.collect_list("positions")).alias("positions"))


def text_keys(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row's id and text: rows with equal ones are copies and have equal results."""
    id_ = [F.col("doc_id").cast("string")] if "doc_id" in docs.columns else []
    return [F.xxhash64(*id_, "text").alias("k1"), F.xxhash64(F.lit(17), "text", *id_).alias("k2")]


def anchors(docs: DataFrame, width: int, period: int, bins: int) -> DataFrame:
    """Rows of ``DEALT`` for the windows of width - period + 1 words at cover positions; 32 bits and the bin tell them apart."""
    length, cover = width - period + 1, np.zeros(period, bool)
    cover[list(COVERS[period])] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(bins, "<u4")
        for batch in batches:
            for part in slices(batch):
                numbers, lengths, words = numbered(part.column("text"), WORD_BYTES)
                row, position = ragged(lengths)
                starts = np.flatnonzero(cover[position % period] & (position + length <= lengths[row]) & (lengths[row] >= width))
                h = window_hashes(hashes(words)[numbers], starts, length, FACTORS[0])
                k1, k2 = (np.asarray(part.column(c))[row[starts]] for c in KEYS)
                yield from dealer.add(h, h >> np.uint64(32), k1, k2, position[starts])
        yield from dealer.flush()

    return docs.select(*text_keys(docs), "text").mapInArrow(run, DEALT)


def windows(docs: DataFrame, width: int, period: int, bins: int) -> DataFrame:
    """Rows of ``DEALT`` for the windows around the shared anchors, which start at ``positions`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(bins, "<u8")
        for batch in batches:
            for part in slices(batch):
                numbers, lengths, words = numbered(part.column("text"), WORD_BYTES)
                first = np.cumsum(lengths) - lengths
                lists = part.column("positions")
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                begin = np.asarray(lists.flatten()).astype(np.int64)[:, None] - np.arange(period)
                fits = (begin >= 0) & (begin + width <= lengths[row][:, None])
                starts = np.unique((begin + first[row][:, None])[fits])
                row = np.searchsorted(first, starts, side="right") - 1
                own = hashes(words)[numbers]
                main, other = (window_hashes(own, starts, width, f) for f in FACTORS)
                k1, k2 = (np.asarray(part.column(c))[row] for c in KEYS)
                yield from dealer.add(main, other, k1, k2, starts - first[row])
        yield from dealer.flush()

    return docs.mapInArrow(run, DEALT)


def covered_runs(starts: pd.Series, width: int) -> pd.Series:
    """[begin, end, begin, end, ...] of the words that the windows at ``starts`` cover."""

    def one(s: np.ndarray) -> np.ndarray:
        s = np.unique(s)
        cut = np.flatnonzero(np.diff(s) > width)
        return np.stack([s[np.concatenate([[0], cut + 1])], s[np.concatenate([cut, [len(s) - 1]])] + width], 1).ravel()

    return starts.map(one)


def shared_runs(docs: DataFrame, width: int = WIDTH, period: int = PERIOD) -> DataFrame:
    """(k1, k2, runs) of the texts that share a window: begins and ends of their covered runs of words."""
    held = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bins = max(LEAST_BINS, -(-held // BIN_BYTES))
    near = materialize(shared_positions(anchors(docs, width, period, bins), "<u4"), "shared-anchors")
    texts = docs.select(*text_keys(docs), "text").join(near, list(KEYS))
    shared = shared_positions(windows(texts, width, period, bins), "<u8")

    @F.pandas_udf("array<int>")
    def runs(starts: pd.Series) -> pd.Series:
        return covered_runs(starts, width)

    return materialize(shared.select(*KEYS, runs("positions").alias("runs")), "shared-runs")


RESULTS = ("kept_text", "n_words", "n_removed")


def dedup_substrings(docs: DataFrame, width: int = WIDTH, period: int = PERIOD) -> DataFrame:
    """The columns of ``docs`` with the words that stay in ``kept_text``, joined by one space, and n_words, n_removed."""
    passed = [c for c in docs.columns if c.lower() not in RESULTS]
    runs = shared_runs(docs.select(*[c for c in ("doc_id", "text") if c in docs.columns]), width, period)
    rows = docs.select(*text_keys(docs), "text", F.struct(*passed).alias("row"))
    joined = rows.join(runs, list(KEYS), "left")

    @F.arrow_udf("kept_text string, n_words long, n_removed long")
    def kept(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, cut in zip(texts.cast(pa.binary()), lists, strict=True):
            words, removed = (text.as_py() or b"").split(), 0
            n = len(words)
            for begin, end in reversed(np.asarray(cut.values).reshape(-1, 2).tolist() if cut.is_valid else []):
                del words[begin:end]
                removed += end - begin
            out.append((b" ".join(words).decode(), n, removed))
        texts_, n, removed = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(texts_, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=list(RESULTS))

    out = joined.select("row", kept("text", "runs").alias("out"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in passed], *[F.col("out").getField(c).alias(c) for c in RESULTS])


def op11_substring_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), words AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS key
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM split WHERE len(words) >= 35)
), shared AS (
  SELECT doc_id, i FROM windows WHERE key IN (SELECT key FROM windows GROUP BY key HAVING count(*) > 1)
), marked AS (
  SELECT w.doc_id, w.i, word,
         coalesce(max(s.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS UNBOUNDED PRECEDING) >= w.i - 34, false) AS removed
  FROM words w LEFT JOIN shared s ON w.doc_id = s.doc_id AND w.i = s.i
)
SELECT d.doc_id, count(m.i)::BIGINT AS n_words, (count(*) FILTER (WHERE removed))::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY m.i) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""
