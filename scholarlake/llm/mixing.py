"""Operator 6: mix sources to target weights by entropy balancing, in DataFrame operations only.

A document of ``size`` words gets the rate r = 2 / (1 + exp(-lambda_s * size / mean_s)),
the tilt of the base rate 1 that has the least sum of r ln r + (2 - r) ln(2 - r), the
relative entropy of both halves, among rates in [0, 2] for which each source's words
sum to its target. (A plain exponential exp(lambda * size) has no upper end and would
give long documents more than two copies.) lambda_s solves the convex dual by Newton
steps, kept within a bracket.

Rates depend on (source, size) alone, so documents are counted per (source, size)
before anything else: a distributed, partially aggregated pass. Each source's histogram
is then one array, on which all its steps run in one expression; so do the rounding
into copies and the correction of what rounding leaves, in a number of jobs that
depends on neither sources nor sizes. Documents only meet again to be numbered
within their cell, where a hash-blocked rank splits hot cells.

Defined results: null text has size 0 and takes 0 words; null source sorts last and
is a source of its own; rows repeated with the same doc_id are documents each; an
empty table gives an empty mix. All float sums are rounded before they decide, and
ties are broken by hash of doc_id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE_RE, blocked_prefix_sum, let, materialize, near, read_table

#: Rates are rounded to this many parts, so that running sums are exact integers.
PARTS = 1 << 20
#: Newton and halving steps at most: every third of them halves a bracket of 128, so 1e-12 is reached within 141.
STEPS = 150
#: About so many rows of a (source, size) cell are ranked in one task.
CELL_ROWS = 250_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, ASCII_SPACE_RE, -1), "")), F.lit(0)).cast("long")


def numbered_sources(sums: DataFrame) -> DataFrame:
    """``sums`` (a row per source) with ``turn``: the source's number by code point, null last; ranges of sources are numbered apart."""
    parts = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sums.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "mix-sources")
    start, before = F.lit(0), 0
    for part, n in sorted(ranged.groupBy("part").count().collect()):  # a row per range, of which there are ``parts`` at most
        start = F.when(F.col("part") == part, F.lit(before)).otherwise(start)
        before += n
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("turn", start + within).drop("part")


def _targets(cells: DataFrame, weights: Sequence[int], share: float, cap: float) -> tuple[DataFrame, tuple[int, int, int]]:
    """The targets, and the numbers of sources and of cells and the rows of the largest cell."""
    sums = cells.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.count(F.lit(1)).alias("cells"), F.max("n").alias("hottest")
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    sums = materialize(numbered_sources(sums).withColumn("weight", weight).drop("turn"), "mix-weights")
    level, stopped = 0.0, -1
    while True:
        full = F.lit(cap) * F.col("source_size") < F.col("weight") * level
        n, used, open_, everything, *facts = sums.agg(
            F.count_if(full), F.sum(F.when(full, F.lit(cap) * F.col("source_size")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.sum("source_size"), F.count(F.lit(1)), F.coalesce(F.sum("cells"), F.lit(0)), F.coalesce(F.max("hottest"), F.lit(0)),
        ).first()
        if n == stopped or not open_:
            break
        level, stopped = (share * (everything or 0) - used) / open_, n
    target = F.least(F.lit(cap) * F.col("source_size"), F.col("weight") * F.lit(float(level) if open_ else float("inf")))
    return sums.select("source", "source_size", target.alias("target")), tuple(facts)


def source_targets(cells: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): shares by weight, stopped at ``cap`` times the size.

    Every source has min(cap * size, weight * level) with one common level. Sharing the
    excess again raises the level and can only stop more sources, so a few sums over the
    sources find it.
    """
    return _targets(cells, weights, share, cap)[0]


def _with_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on a null-safe source; ``right`` has one row per source and may be marked for broadcast."""
    r = right.withColumnRenamed("source", "_source")
    return left.join(r, left["source"].eqNullSafe(r["_source"]), "left").drop("_source")


def _newton(cells: Column, mean: Column, target: Column, cap: float, going: Column) -> Column:
    """The tilt of one source from its histogram: Newton's method on the dual, kept within a bracket.

    A step that leaves the bracket, and every third one, halves it instead, so STEPS are
    enough for the width 1e-12 from 128. Settled sources skip their remaining steps.
    """

    def sums(tilt: Column) -> Column:
        def add(acc: Column, cell: Column) -> Column:
            rate = F.lit(cap) / (1 + F.exp(-tilt * cell["size"] / mean))
            words = cell["n"] * cell["size"] * rate
            return F.struct((acc["words"] + words).alias("words"), (acc["slope"] + words * cell["size"] / mean * (1 - rate / cap)).alias("slope"))

        return F.aggregate(cells, F.struct(F.lit(0.0).alias("words"), F.lit(0.0).alias("slope")), add)

    def move(at: Column, step: Column) -> Column:
        def body(x: Column) -> Column:
            over = x["words"] - target
            settled = (F.abs(over) <= 1e-7 * target + 1e-6) | (at["high"] - at["low"] < 1e-12)
            low = F.when(over < 0, at["tilt"]).otherwise(at["low"])
            high = F.when(over > 0, at["tilt"]).otherwise(at["high"])
            newton = at["tilt"] - over / F.greatest(x["slope"], F.lit(1e-12))
            moved = F.when((newton > low) & (newton < high) & (step % 3 != 0), newton).otherwise((low + high) / 2)
            return F.struct(F.when(settled, at["tilt"]).otherwise(moved).alias("tilt"), low.alias("low"), high.alias("high"), (~settled).alias("going"))

        return F.when(at["going"], let(sums(at["tilt"]), body)).otherwise(at)

    start = F.struct(F.lit(0.0).alias("tilt"), F.lit(-64.0).alias("low"), F.lit(64.0).alias("high"), going.alias("going"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, move)["tilt"]


def solve_tilts(cells: DataFrame, targets: DataFrame, cap: float, per_source=lambda table: table) -> DataFrame:
    """(source, source_size, target, mean, tilt, cells): each source's histogram as one array, and the tilt solved in its row.

    All steps of all sources are one job. A source of w words has at most sqrt(2 w)
    different sizes (3 million for 5 * 10**12 words), so its array is bounded whatever
    number of documents it has. A source whose target is its cap has no finite tilt;
    its rate is the cap itself (see copies_by_cell).
    """
    held = cells.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("size", "n"))).alias("cells"),
        F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("with_words"),
    )
    going = (F.col("target") < F.lit(cap) * F.col("source_size")) & (F.col("source_size") > 0)
    mean = F.coalesce(F.col("source_size") / F.col("with_words"), F.lit(1.0))
    state = _with_source(held, per_source(targets)).withColumn("mean", mean)
    tilt = _newton(F.col("cells"), F.col("mean"), F.col("target"), cap, F.coalesce(going, F.lit(False)))
    return materialize(state.select("source", "source_size", "target", "mean", tilt.alias("tilt"), "cells"), "mix-state")


def copies_by_cell(state: DataFrame, cap: int) -> DataFrame:
    """(source, size, n, copies, source_size, target): how many copies the documents of a cell have together.

    Rates are summed along a source's sizes and cut to whole copies where the running sum
    passes a whole number, so what a source misses is about one document. That
    remaining difference to its target is spent on whole copies of the largest size that
    fits, until none does: one walk down the sizes, as a size that does not fit never fits again.
    """
    tilted = F.lit(float(cap)) / (1 + F.exp(-F.round("tilt", 9) * F.col("size") / F.col("mean")))
    rate = F.when(F.col("target") >= F.lit(cap) * F.col("source_size"), F.lit(float(cap))).otherwise(tilted)
    parts = F.when(F.col("size") > 0, F.round(rate * PARTS)).otherwise(0).cast("long")
    w = state.select("source", "source_size", "target", "mean", "tilt", F.inline("cells")).withColumn("parts", parts * F.col("n"))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("parts").over(smaller), F.lit(0))
    copies = F.floor((before + F.col("parts")) / PARTS) - F.floor(before / PARTS)
    cut = w.withColumn("copies", F.least(copies, F.lit(cap) * F.col("n")).cast("long"))
    whole = Window.partitionBy("source")
    gap = F.round("target").cast("long") - F.sum(F.col("size") * F.col("copies")).over(whole)
    rounded = materialize(cut.withColumn("gap", gap).select("source", "size", "n", "copies", "source_size", "target", "gap"), "mix-rounded")

    def walk(acc: Column, cell: Column) -> Column:
        room = F.when(acc["gap"] > 0, F.lit(cap) * cell["n"] - cell["copies"]).otherwise(cell["copies"])
        moved = F.least(room, F.floor(F.abs(acc["gap"]) / cell["size"])) * F.signum(acc["gap"]).cast("long")
        new = lambda m: F.struct(
            (acc["gap"] - m * cell["size"]).cast("long").alias("gap"),
            F.when(m != 0, F.concat(acc["moves"], F.array(F.struct(cell["size"].alias("size"), m.cast("long").alias("move"))))).otherwise(acc["moves"]).alias("moves"),
        )
        return F.when(acc["gap"] == 0, acc).otherwise(let(moved, new))

    # only sizes that can fit are walked
    fit = rounded.filter((F.col("size") > 0) & (F.col("size") <= F.abs("gap")))
    lists = fit.groupBy("source").agg(F.first("gap").alias("gap"), F.reverse(F.array_sort(F.collect_list(F.struct("size", "n", "copies")))).alias("cells"))
    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<struct<size:bigint,move:bigint>>").alias("moves"))
    moves = lists.select("source", F.inline(F.aggregate("cells", start, walk)["moves"]))
    added = moves.select("source", "size", F.lit(0).cast("long").alias("n"), F.col("move").alias("copies"))
    both = rounded.drop("gap").unionByName(added, allowMissingColumns=True)
    return both.groupBy("source", "size").agg(*[F.sum(c).alias(c) for c in ("n", "copies")], *[F.max(c).alias(c) for c in ("source_size", "target")])


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2, row: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row per row of ``docs``.

    A column ``row`` is carried along, to tell rows with null or repeated ids apart;
    then ties of doc_id go by hash of the text. No other column is read.
    """
    own_columns = [F.col(row).alias("_own_row"), F.xxhash64("text").alias("_text")] if row else []
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *own_columns), "mix-sizes")
    cells = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    targets, (n_sources, n_cells, hottest) = _targets(cells, weights, share, float(cap))
    per_source, per_cell = near(n_sources), near(n_cells)
    state = solve_tilts(cells, targets, float(cap), per_source)
    copies = copies_by_cell(state, cap)
    # a hot cell is ranked in as many blocks as keep each near CELL_ROWS rows
    blocks = max(32, -(-hottest // CELL_ROWS))
    # hashed order: which documents of a cell get the extra copy does not depend on their ids' order
    numbered = blocked_prefix_sum(
        sized.withColumn("_order", F.xxhash64("doc_id")), ["source", "size"], ["_order", "doc_id", *(["_text"] if row else [])], F.lit(1), "rank", blocks
    ).drop("_order")
    c = per_cell(copies.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", F.col("copies").alias("all_copies"), "source_size", "target"))
    joined = numbered.join(c, numbered["source"].eqNullSafe(c["_s"]) & (numbered["size"] == c["_z"]), "left")
    own = F.floor(F.col("all_copies") / F.col("n")) + F.when(F.col("rank") < F.col("all_copies") % F.col("n"), 1).otherwise(0)
    joined = joined.withColumn("copies", own.cast("long"))
    return joined.select(
        "doc_id", *([F.col("_own_row").alias(row)] if row else []), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def op6_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
