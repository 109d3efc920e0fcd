"""Operator 8: approximate nearest neighbours by a hash-prefix forest.

Every tree writes a vector as a long string: each of its symbols is the random direction
(of ``SIDES`` and their opposites) that the vector lies closest to. A tree is the sorted
table of all rows' strings, cut by prefix; the forest is one for the whole table. A query
descends to the longest prefixes, and then all trees ascend at the same pace: at each pace
a tree gives up its next best prefix of that length, by how close the query lies to its
directions, and when those of a length are used up, prefixes one symbol shorter, down to
single symbols, all of which together hold every row. It stops at the first pace at which
what the prefixes hold counts ``hits``. Their rows are ranked by exact cosine on the
original vectors.

A query only meets the prefixes that it descends to or ascends through: joins on (tree,
prefix), where counts come before pairs and a hot prefix is split. ``hits`` grows as
the rows to the power of 0.7, so work stays far below queries x rows. Pairs are never rows: a
cell's row carries the list of the queries of a block that take it, and a task ranks the rows
of one part for one block, of which the ``k`` best of each query leave it. Copies of one vector beyond
``k + 1`` cannot be among the k nearest and need not be candidates.

Joins on cells and on rows are shuffled by a hint: their sides are lists and files that grow some
thousand times as they are read, so that Spark's estimate would broadcast them through the driver.

Defined results: vectors that are null, empty, all zero or hold null or non-finite
components take no part; vectors of another length are no candidates; a repeated vec_id
counts once, with its smallest vector; a null vec_id takes no part; a query with fewer
candidates than k returns them all; ties go to the smaller vec_id; vectors are scaled by a
power of two before products, so that large components do not overflow; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, read_table

#: Directions per symbol, each with its opposite: 128 symbols, 7 bits.
SIDES, BITS = 64, 7
SYMBOLS = 2 * SIDES
LONGEST = 8
#: Symbols of a place that longer prefixes are made of.
BEST = 16
#: A prefix of more rows is split among tasks.
HOT_PREFIX = 20_000
#: Queries of a block, whose lists a row carries; rows of a part, which a task ranks for one block.
BLOCK_QUERIES, PART_ROWS = 16384, 8192
#: Hits of a row in a block, and pairs of a part and a block, on average; beyond them there are more blocks, or parts.
BLOCK_HITS, PART_PAIRS = 1 << 13, 1 << 22
#: Pairs whose products are held at once.
PAIRS = 1 << 12


@lru_cache(maxsize=4)
def directions(dim: int, trees: int, length: int) -> np.ndarray:
    return np.random.default_rng((977, dim)).standard_normal((trees, length, SIDES, dim)).astype(np.float32)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, with components of at most 1."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def closeness(vectors: np.ndarray, trees: int, length: int) -> np.ndarray:
    """By row, tree and place: how close the row lies to each direction."""
    planes = directions(vectors.shape[1], trees, length)
    return (scaled(vectors).astype(np.float32) @ planes.reshape(-1, vectors.shape[1]).T).reshape(len(vectors), trees, length, SIDES)


def strings(vectors: np.ndarray, trees: int, length: int) -> np.ndarray:
    """By row and tree: the symbols of the string, the first in the highest bits."""
    out = np.empty((len(vectors), trees), np.int64)
    for at in range(0, len(vectors), 256):
        near = closeness(vectors[at : at + 256], trees, length)
        side = np.abs(near).argmax(-1)
        symbol = side + SIDES * (np.take_along_axis(near, side[..., None], -1)[..., 0] < 0)
        out[at : at + 256] = (symbol.astype(np.int64) << (BITS * np.arange(length - 1, -1, -1))).sum(-1)
    return out


def prefixes(vectors: np.ndarray, trees: int, length: int, level: int, paces: int) -> np.ndarray:
    """By row, tree and pace: prefixes of ``level`` symbols, the closest first."""
    out = np.empty((len(vectors), trees, paces), np.int64)
    for at in range(0, len(vectors), 64):
        near = closeness(vectors[at : at + 64], trees, length)[:, :, :level]
        both = np.concatenate([near, -near], -1)
        code, score = np.zeros((*both.shape[:2], 1), np.int64), np.zeros((*both.shape[:2], 1), np.float32)
        for place in range(level):
            most = min(BEST if level > 1 else SYMBOLS, SYMBOLS)
            best = np.argsort(-both[:, :, place], axis=-1, kind="stable")[..., :most]
            gain = np.take_along_axis(both[:, :, place], best, -1)
            score = (score[..., :, None] + gain[..., None, :]).reshape(*both.shape[:2], -1)
            code = ((code[..., :, None] << BITS) + best[..., None, :]).reshape(*both.shape[:2], -1)
            order = np.argsort(-score, axis=-1, kind="stable")[..., :paces]
            score, code = np.take_along_axis(score, order, -1), np.take_along_axis(code, order, -1)
        out[at : at + 64] = code
    return out


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of each length of vector in a batch."""
    held = batch.column(column)
    sizes = held.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        some = held if len(rows) == len(sizes) else held.take(pa.array(rows))
        yield rows, some.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), dim)


def usable_vectors(table: DataFrame, is_query: Column) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = table.filter(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asked").alias("asked")).withColumn("dim", F.size("embedding"))


def row_strings(points: DataFrame, trees: int, length: int) -> DataFrame:
    """(vec_id, dim, codes): a row's string in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in matrices(batch, "embedding"):
                codes = strings(vectors, trees, length)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * trees, pa.int32()), pa.array(codes.ravel()))
                dims = pa.array(np.full(len(rows), vectors.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), dims, lists], names=["vec_id", "dim", "codes"])

    return points.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, codes array<long>")


def query_prefixes(queries: DataFrame, trees: int, length: int, level: int, paces: int) -> DataFrame:
    """(query_id, dim, pace, cell): the prefixes of a level that each query ascends through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in matrices(batch, "embedding"):
                cells = prefixes(vectors, trees, length, level, paces) * trees + np.arange(trees)[None, :, None]
                n = trees * paces
                ids = np.repeat(batch.column("vec_id").take(pa.array(rows)).to_numpy(), n)
                pace = np.tile(np.arange(paces, dtype=np.int32), len(rows) * trees)
                dims = np.full(len(ids), vectors.shape[1], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(dims), pa.array(pace), pa.array(cells.ravel())], names=["query_id", "dim", "pace", "cell"])

    return queries.select("vec_id", "embedding").mapInArrow(run, "query_id long, dim int, pace int, cell long")


def by_count(rows: int, table: DataFrame) -> DataFrame:
    """``table`` of so many rows of a few numbers, for a join: broadcast up to BROADCAST_ROWS, else shuffled."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("merge")


def block_of(query_id: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int")


def rows_of_cells(taken: DataFrame, entries: DataFrame, counts: DataFrame, blocks: int) -> DataFrame:
    """(dim, vec_id, block, queries): the rows of the cells that queries take, with those queries; a hot cell is split by rows."""
    keys = ["dim", "cell"]
    out = ["dim", "vec_id", "block", "queries"]
    taken = taken.groupBy(*keys, block_of("query_id", blocks).alias("block")).agg(F.collect_list("query_id").alias("queries"))
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    hot = max(HOT_PREFIX, (total or 0) // BROADCAST_ROWS)  # so that at most BROADCAST_ROWS cells are hot
    if (largest or 0) <= hot:
        return taken.join(entries.hint("merge"), keys).select(*out)
    parts = F.broadcast(counts.filter(F.col("n") > hot).select(*keys, F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    parts_of = F.coalesce("parts", F.lit(1))
    left = taken.join(parts, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts_of - 1))).drop("parts")
    right = entries.join(parts, keys, "left").withColumn("part", F.pmod(F.xxhash64("vec_id"), parts_of).cast("int")).drop("parts")
    return left.join(right.hint("merge"), [*keys, "part"]).select(*out)


def candidates(points: DataFrame, queries: DataFrame, rows: int, asked: int, trees: int, paces: int, hits: int) -> tuple[DataFrame, int, int]:
    """(dim, vec_id, block, queries): each row with the queries of a block that rank it; the number of blocks; at most how many pairs these are."""
    base = min(LONGEST - 1, max(1, round(math.log(max(rows, 2), SYMBOLS))))  # prefixes of a few rows each
    length = base + 1  # where rows lie densely the longer prefix may do
    held = materialize(row_strings(points, trees, length), "strings")
    entries = held.select("vec_id", "dim", F.posexplode("codes").alias("tree", "code"))
    open_, left, ends, met_hits, pairs = queries, asked, [], 0, 0
    for level in range(length, 0, -1):
        cell = F.shiftright("code", BITS * (length - level)) * trees + F.col("tree")
        at = entries.select("vec_id", "dim", cell.alias("cell"))
        counts = materialize(at.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
        sought = query_prefixes(open_, trees, length, level, SYMBOLS if level == 1 else paces if level <= base else 1)
        met = materialize(sought.join(counts.hint("merge"), ["dim", "cell"]), "met")  # counts, no pairs yet
        sums = met.groupBy("query_id", "pace").agg(F.sum("n").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("query_id").orderBy("pace"))
        reached = F.col("so_far") >= hits
        enough = sums.withColumn("so_far", so_far).groupBy("query_id").agg(F.min(F.when(reached, F.col("pace"))).alias("last"), F.coalesce(F.min(F.when(reached, F.col("so_far"))), F.max("so_far")).alias("hits"))
        # the last level holds every row: a query that never has enough takes all of it
        enough = enough.withColumn("last", F.coalesce("last", F.lit(SYMBOLS))) if level == 1 else enough.filter("last is not null")
        enough = materialize(enough, "enough")
        closed, *more = enough.agg(F.count(F.lit(1)), F.coalesce(F.sum("hits"), F.lit(0)), F.coalesce(F.sum(F.least("hits", F.lit(rows))), F.lit(0))).first()
        left, met_hits, pairs = left - closed, met_hits + more[0], pairs + more[1]
        if closed or not left or level == 1:
            taken = met.join(by_count(closed, enough), "query_id").filter("pace <= last").select("query_id", "dim", "cell")
            ends.append((taken, at, counts))
        if not left:
            break
        if closed:
            open_ = materialize(open_.join(by_count(closed, enough), open_["vec_id"] == enough["query_id"], "left_anti"), "open")
    blocks = max(1, -(-asked // BLOCK_QUERIES), -(-met_hits // (max(rows, 1) * BLOCK_HITS)))
    found = reduce(DataFrame.unionByName, (rows_of_cells(*end, blocks) for end in ends))
    # dealt by row before they are gathered, as a task has few cells of one row; the join with the rows' vectors stays where they are
    lists = found.repartition("vec_id").groupBy("dim", "vec_id", "block").agg(F.array_distinct(F.flatten(F.collect_list("queries"))).alias("queries"))
    return lists.withColumn("queries", F.array_remove("queries", F.col("vec_id"))), blocks, pairs


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best of each query, ties to the smaller id; by query, the best first."""
    order = np.lexsort((ids, -score, query))
    first = np.flatnonzero(np.diff(query[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < keep]


def cosines(rows: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): of each query the ``keep`` best rows of each part, ties to the smaller vec_id.

    ``rows`` are (dim, block, part, vec_id, embedding, queries, keep): the rows to rank with their
    queries, and each query of the block itself, without ``queries``.
    """

    def run(group: pa.Table) -> pa.Table:
        ids, keep = group["vec_id"].to_numpy(), group["keep"][0].as_py()
        vectors = scaled(group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1))
        norms = np.sqrt((vectors * vectors).sum(1))
        own = group["queries"].is_null().to_numpy()
        asked = np.flatnonzero(own)[np.argsort(ids[own], kind="stable")]
        names = ids[asked]
        # places in asked, rows and scores of the best so far and of those not compared yet; the score of a query's last one
        held, floor = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), np.full(len(asked), -np.inf)
        wait, before = [held], 0

        def compared() -> tuple[np.ndarray, ...]:
            both = tuple(map(np.concatenate, zip(*wait, strict=True)))
            best = best_of(both[0], ids[both[1]], both[2], keep)
            return tuple(x[best] for x in both)

        for lists in group["queries"].chunks:  # each flattened alone, as together they may be most of a task's memory
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for a in range(0, len(flat), PAIRS):
                asks = np.searchsorted(names, flat[a : a + PAIRS])
                x, y = before + np.searchsorted(ends, np.arange(a, a + len(asks)), "right"), asked[asks]
                score = (vectors[x] * vectors[y]).sum(1) / (norms[x] * norms[y])
                some = np.flatnonzero(score >= floor[asks])
                wait.append((asks[some], x[some], score[some]))
                if sum(len(w[0]) for w in wait) >= 2 * max(PAIRS, keep * len(asked)):
                    held = compared()
                    wait = [held]
                    full = np.flatnonzero(held[0][keep - 1 :] == held[0][: max(0, len(held[0]) - keep + 1)])
                    floor[held[0][full]] = held[2][full + keep - 1]
            before += len(lists)
        held = compared()
        return pa.table({"query_id": names[held[0]], "vec_id": ids[held[1]], "score": held[2]})

    return rows.groupBy("dim", "block", "part").applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(table: DataFrame, is_query: Column, k: int = 5, trees: int = 64, paces: int = 24, hits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``table`` (vec_id, embedding) that ``is_query`` picks.

    ``hits`` is by default twice the number of rows to the power of 0.7. A row may count
    once per tree, so it is at least ``k`` rows in all trees, and the query's own on top.
    """
    vectors = materialize(usable_vectors(table, is_query), "vectors")
    rows, asked = vectors.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    points = vectors.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1).select("vec_id", "embedding")
    points = materialize(points, "points")
    queries = vectors.filter("asked").select("vec_id", "embedding")
    ranked, blocks, pairs = candidates(points, queries, rows, asked, trees, paces, max(hits or math.ceil(2 * rows**0.7), k * trees) + trees)
    parts = max(1, -(-rows // PART_ROWS), -(-pairs // (blocks * PART_PAIRS)))
    columns = ["dim", "block", "part", "vec_id", "embedding", "queries", F.lit(k).alias("keep")]
    ranked = ranked.join(points.hint("merge"), "vec_id").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).select(*columns)
    own = queries.withColumns({"dim": F.size("embedding"), "block": block_of("vec_id", blocks), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "queries": F.lit(None).cast("array<long>")}).select(*columns)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = cosines(ranked.unionByName(own)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann_forest(spark, sf_dir):
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
