"""Operator 1: join of documents by Jaccard similarity of their word 5-grams.

1. Texts are lower-cased and split at white space. Texts with the same word sequence
   form a text class; the smallest doc_id stands for it.
2. MinHash signatures are cut into bands of ``rows`` values; the number of bands
   follows from the target recall at the threshold. Only band hashes are shuffled.
   Bands that hold exactly the same documents are one bucket.
3. Large buckets are cut into chunks by hash, and every pair of chunks is compared in
   one task on the documents' whole n-gram sets. A pair that shares several buckets is
   compared in the first of them. A task returns sums and a spanning forest of the
   links it found, never the pairs, so its output is linear in the documents it read.
4. Spanning edges are closed into groups by alternating star contraction on slim
   (node, node) tables, in shared files. A node is the number of a text class, so that
   different texts of one doc_id are nodes of their own.

Defined results: a text with fewer than five words has one shingle, all its words; a
null or empty text has none and links only to copies of no words' class, which is no
class: it stays alone with 0 links. Repeated rows of one (doc_id, text) count as copies;
each different text of a repeated doc_id has its own links and group. Rows with a null doc_id take no part: null class_id, 0 links. Other columns are not read.
``one_of_each`` numbers the rows first, so there rows with a null doc_id take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, read_table, unused

WIDTH, THRESHOLD, ROWS, RECALL = 5, 0.8, 5, 0.9999
#: A chunk pair holds at most about so many documents and n-grams on either side.
CHUNK_DOCS, CHUNK_GRAMS = 1024, 800_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: What tells text classes apart: two hashes and the number of n-grams.
SEQUENCE = ["seq1", "seq2", "grams"]


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The least number of bands with which a pair at the threshold meets with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """The sorted distinct n-gram hashes of a text, and a hash of its word sequence."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64), 0
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    powers = np.multiply.accumulate(np.full(len(h), MIX, np.uint64))
    sequence = int(mixed((h * powers).sum(dtype=np.uint64)[None] + np.uint64(len(h)))[0] >> np.uint64(1))
    w = min(width, len(h))
    grams = h[: len(h) - w + 1].copy()
    for k in range(1, w):
        grams *= MIX
        grams += h[k : len(h) - w + 1 + k]
    return np.unique(mixed(grams)), sequence


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(grams: np.ndarray, factors: np.ndarray, rows: int) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):  # stays in cache, whatever the length of the text
        np.minimum(least, (grams[at : at + 512, None] * factors).min(axis=0), out=least)
    least = mixed(least).reshape(-1, rows)
    out = least[:, 0].copy()
    for k in range(1, rows):
        out = out * MIX + least[:, k]
    return mixed(out + np.arange(len(out), dtype=np.uint64)).view(np.int64)


def second_hash(grams: np.ndarray) -> int:
    """Another hash of a text, of its n-gram set; 0 without n-grams."""
    return int(mixed(np.bitwise_xor.reduce(grams)[None] + grams.sum(dtype=np.uint64))[0] >> np.uint64(1)) if len(grams) else 0


def signatures(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, seq1, seq2, grams, bands): word-sequence hashes, number of n-grams, band hashes."""
    factors = multipliers(rows * bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, sizes, hashes = [], [], [], []
            for text in batch.column("text"):
                grams, sequence = shingles(text.as_py(), width)
                first.append(sequence)
                second.append(second_hash(grams))
                sizes.append(len(grams))
                hashes.append(band_hashes(grams, factors, rows) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["doc_id", "seq1", "seq2", "grams", "bands"],
            )

    rows_ = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return rows_.mapInArrow(run, "doc_id long, seq1 long, seq2 long, grams long, bands array<long>")


#: A band of more documents than this meets its row by broadcast.
HOT_BAND = 1000


def by_band(members: DataFrame, bands: DataFrame, size: str) -> DataFrame:
    """Members joined to the rows of their bands (``size`` members each); a hot band is not dealt to one task."""
    largest, held = bands.agg(F.max(size), F.sum(size)).first()
    hot = max(HOT_BAND, (held or 0) // BROADCAST_ROWS)  # so that at most BROADCAST_ROWS bands are hot
    if (largest or 0) <= hot:
        return members.join(bands, "band")
    common = F.broadcast(bands.filter(F.col(size) > hot))
    rest = members.join(F.broadcast(bands.filter(F.col(size) > hot).select("band")), "band", "left_anti")
    return members.join(common, "band").unionByName(rest.join(bands.filter(F.col(size) <= hot), "band"))


def candidate_buckets(reps: DataFrame) -> DataFrame:
    """(bucket, node, grams, chunks): members of each distinct bucket of two or more."""
    banded = reps.select("node", "grams", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(shared, "shared")
    banded = materialize(by_band(banded, shared, "n"), "shared-bands")  # all further work is on documents that meet another
    # order-free fingerprints of a bucket's members: summed on the map side, no member list
    prints = banded.groupBy("band", "n").agg(
        F.sum("grams").alias("all_grams"), F.min("node").alias("least"),
        F.expr("bit_xor(xxhash64(node))").alias("p1"), F.expr("bit_xor(xxhash64(node, 7L))").alias("p2"),
    )
    distinct = prints.groupBy("n", "least", "p1", "p2").agg(F.min("band").alias("band"), F.first("all_grams").alias("all_grams"))
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK_DOCS), F.ceil(F.col("all_grams") / CHUNK_GRAMS)).cast("int")
    distinct = materialize(distinct.select("band", "n", "all_grams", chunks.alias("chunks")), "buckets")
    return by_band(banded.drop("n"), distinct, "n").withColumnRenamed("band", "bucket")


def links_within(sets: list[np.ndarray], other: np.ndarray, owner: np.ndarray, buckets: list[np.ndarray], bucket: int, threshold: float, both: bool):
    """Pairs (i, j), i < j, of similar sets, as arrays; only pairs across ``owner`` when ``both``.

    Overlaps come from products of 0/1 matrices over the n-grams that at least two sets share.
    """
    sizes = np.array([len(s) for s in sets])
    n = len(sets)
    if n == 2:
        common = np.array([[sizes[0], 0], [0, sizes[1]]], float)
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        row = np.repeat(np.arange(n), sizes)
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        everywhere = counts == n
        common = np.full((n, n), float(everywhere.sum()))
        shared = (counts > 1) & ~everywhere
        number = np.cumsum(shared) - 1
        keep = shared[inverse]
        row, column = row[keep], number[inverse[keep]]
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        for at in range(0, int(shared.sum()), 2048):
            lo, hi = np.searchsorted(column, [at, at + 2048])
            block = np.zeros((n, 2048), np.float32)
            block[row[lo:hi], column[lo:hi] - at] = 1
            common += block @ block.T
    jaccard = common / np.maximum(sizes[:, None] + sizes[None] - common, 1)
    i, j = np.nonzero(np.triu(jaccard >= threshold - 1e-12, 1))
    if both:
        across = owner[i] != owner[j]
        i, j = i[across], j[across]
    # a pair counts in the first bucket that it shares: one with no smaller bucket in common
    smaller = [b[b < bucket] for b in buckets]
    lengths = np.array([len(b) for b in smaller])
    if len(i) and lengths.any():
        row = np.repeat(np.arange(n), lengths)
        distinct, column = np.unique(np.concatenate(smaller), return_inverse=True)
        met = np.zeros((n, n), np.float32)
        for at in range(0, len(distinct), 4096):
            inside = (column >= at) & (column < at + 4096)
            block = np.zeros((n, min(4096, len(distinct) - at)), np.float32)
            block[row[inside], column[inside] - at] = 1
            met += block @ block.T
        first = met[i, j] == 0
        i, j = i[first], j[first]
    return i, j


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    parent, out = list(range(n)), []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def verified(members: DataFrame, texts: DataFrame, width: int, threshold: float, bins: int) -> DataFrame:
    """(node, links, to_node): a row per node and task with links, and one per spanning edge (to_node not null)."""

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column("text")]
            numbers = [[sequence for _, sequence in found], [second_hash(grams) for grams, _ in found], [len(grams) for grams, _ in found]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in numbers], pa.array([grams.tobytes() for grams, _ in found], pa.binary())],
                names=["doc_id", *SEQUENCE, "set"],
            )

    # different texts may share a doc_id: the set belongs to the text class
    sets = texts.mapInArrow(grams_of, "doc_id long, seq1 long, seq2 long, grams long, set binary")
    # a member of chunk c meets every chunk of its bucket in the unordered pair (c, other)
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    placed = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("node", "doc_id", *SEQUENCE, "copies", "buckets", "bucket", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    placed = placed.join(sets, ["doc_id", *SEQUENCE]).drop("doc_id", *SEQUENCE).withColumn("bin", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(bins)))

    def compare(table: pa.Table) -> pa.Table:
        ids, copies, bucket, own, lo, hi = (table.column(c).to_numpy() for c in ("node", "copies", "bucket", "own", "lo", "hi"))
        lists, sets_ = table.column("buckets").combine_chunks(), table.column("set")
        order = np.lexsort((ids, hi, lo, bucket))
        edges = np.flatnonzero(np.r_[True, (np.diff(bucket[order]) != 0) | (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0), True])
        a_ids, a_links, a_to = [], [], []
        for s, e in zip(edges, edges[1:], strict=False):
            at = order[s:e]
            at = at[np.r_[True, np.diff(ids[at]) != 0]] if len(at) > 1 else at
            if len(at) < 2:
                continue
            grams = [np.frombuffer(sets_[int(k)].as_py(), np.uint64) for k in at]
            buckets = [np.asarray(lists[int(k)].as_py()) for k in at]
            i, j = links_within(grams, at, own[at], buckets, bucket[at[0]], threshold, bool(lo[at[0]] != hi[at[0]]))
            if not len(i):
                continue
            links = np.zeros(len(at), np.int64)
            np.add.at(links, i, copies[at[j]])
            np.add.at(links, j, copies[at[i]])
            some = np.flatnonzero(links)
            a_ids += ids[at[some]].tolist()
            a_links += links[some].tolist()
            a_to += [None] * len(some)
            for a, b in forest(i, j, len(at)):
                a_ids.append(int(ids[at[a]]))
                a_links.append(0)
                a_to.append(int(ids[at[b]]))
        return pa.table({"node": pa.array(a_ids, pa.int64()), "links": pa.array(a_links, pa.int64()), "to_node": pa.array(a_to, pa.int64())})

    return placed.groupBy("bin").applyInArrow(compare, "node long, links long, to_node long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each node's connected component, for nodes with edges.

    Alternating large-star and small-star contraction: minima are partial aggregates,
    and the joins back are on slim rows. Every round starts at files, not at lineage;
    rounds end when a round changes nothing.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialize(small.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, text_class): a row per row of ``docs``.

    ``class_id`` is the smallest doc_id of the group that links connect, ``n_links``
    the number of other rows with similarity >= ``threshold``, ``text_class`` the
    smallest doc_id with the same word sequence.
    """
    bands = bands_for(threshold, rows, recall)
    signed = materialize(signatures(docs, width, rows, bands), "signatures")
    classes = signed.filter("grams > 0").groupBy(*SEQUENCE).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = signed.select("doc_id", "bands", *SEQUENCE).join(
        classes.select(F.col("rep").alias("doc_id"), "node", *SEQUENCE), ["doc_id", *SEQUENCE]
    ).dropDuplicates(["node"])
    members = candidate_buckets(reps.select("node", "grams", "bands")).drop("grams")
    own = members.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))  # at most one per band
    named = classes.select("node", F.col("rep").alias("doc_id"), *SEQUENCE, "copies")
    members = materialize(members.join(own, "node").join(named, "node"), "members")
    total = members.agg(F.sum(F.col("grams") * F.col("chunks"))).first()[0] or 0
    ids = members.select("doc_id").distinct()
    if members.count() <= BROADCAST_ROWS:  # so the texts of the corpus need no shuffle; beyond the bound they take one
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    found = materialize(verified(members, texts, width, threshold, max(8, total // 1_000_000)), "links")
    roots = components(found.filter("to_node is not null").select(F.col("node").alias("a"), F.col("to_node").alias("b")))
    roots = roots.select(F.col("id").alias("node"), "root")
    least = roots.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_id"))
    links = found.filter("to_node is null").groupBy("node").agg(F.sum("links").alias("links"))
    per_class = (
        classes.join(links, "node", "left").join(roots.join(least, "root"), "node", "left")
        .select(*SEQUENCE, F.col("rep").alias("text_class"), F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    out = signed.select("doc_id", *SEQUENCE).join(per_class, SEQUENCE, "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("text_class", "doc_id").alias("text_class"))
    null = F.lit(None).cast("long")
    nameless = docs.filter(F.col("doc_id").isNull()).select(null.alias("doc_id"), null.alias("class_id"), F.lit(0).cast("long").alias("n_links"), null.alias("text_class"))
    return out.unionByName(nameless)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, then text hash; null ids come last.

    Rows are numbered first, so rows with a null doc_id and each different text of a
    repeated doc_id take part like any other. A text without words is no copy of
    another's; repeated rows of one (doc_id, text) are kept once.
    """
    row = unused("row", docs.columns)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = ngram_join(numbered.select(F.col(row).alias("doc_id"), "text"), **options)
    groups = groups.select(F.col("doc_id").alias("row"), F.col("class_id").alias("class"))
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    first = F.struct(
        F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(17), F.col("text")).alias("h2"),
        F.xxhash64(*plain).alias("h"), F.col(row).alias("row"),
    )
    kept = numbered.select(F.col(row).alias("row"), first.alias("first")).join(groups, "row").groupBy("class").agg(F.min("first").alias("first"))
    nameless_row = F.when(F.col("first.nameless"), F.col("first.row"))
    kept = kept.groupBy("first.id", "first.h1", "first.h2", nameless_row.alias("other")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def op1_ngram_join(spark, sf_dir):
    return ngram_join(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
