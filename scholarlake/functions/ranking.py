"""Percent ranks in two forms: a window sort, and counts of values that never sort a coarse group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import store


#: Ranks (a row per distinct value of a group) are broadcast up to so many rows; beyond it only the most frequent are.
BROADCAST_RANKS = 500_000

Specs = list[tuple[list[str], dict[str, str]]]


def _metrics(specs: Specs) -> list[tuple[int, list[str], str, str]]:
    """(number, keys, out, value) of every metric."""
    return [(i, keys, out, value) for i, (keys, out, value) in enumerate((k, o, v) for k, metrics in specs for o, v in metrics.items())]


def _width(specs: Specs) -> int:
    return max(len(keys) for keys, _ in specs)


def _entries(df: DataFrame, specs: Specs) -> Column:
    """An array of (m, g0, g1, ..., v), an entry per metric; groups with fewer keys are filled with nulls."""
    kinds = {f"g{i}": next(df.schema[k[i]].dataType for k, _ in specs if i < len(k)) for i in range(_width(specs))}
    entry = lambda m, keys, value: F.struct(F.lit(m).alias("m"), *[(F.col(keys[i]) if i < len(keys) else F.lit(None)).cast(kind).alias(g) for i, (g, kind) in enumerate(kinds.items())], F.col(value).alias("v"))
    return F.array(*[entry(m, keys, value) for m, keys, _, value in _metrics(specs)])


def value_counts(df: DataFrame, specs: Specs) -> DataFrame:
    """(m, g0, ..., v, n): how often each value of each metric occurs in its group, in one pass with partial aggregation."""
    rows = df.select(F.explode(_entries(df, specs)).alias("e")).select("e.*")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def patched_counts(counts: DataFrame, old: DataFrame, new: DataFrame, specs: Specs) -> DataFrame:
    """Counts after the rows ``old`` have become ``new``: subtracted and added, so only changed rows are read beside the counts."""
    keys = [c for c in counts.columns if c != "n"]
    both = counts.unionByName(value_counts(old, specs).withColumn("n", -F.col("n"))).unionByName(value_counts(new, specs))
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")


def ranks_of(counts: DataFrame) -> DataFrame:
    """(m, g0, ..., v, n, r): (rows of the group strictly below) / (rows - 1), 0 alone. Null values rank lowest, null keys form a group."""
    window = Window.partitionBy(*[c for c in counts.columns if c not in ("v", "n")])
    below = F.coalesce(F.sum("n").over(window.orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(window)
    return counts.withColumn("r", F.when(total > 1, below / (total - 1)).otherwise(0.0))


def _looked_up(df: DataFrame, ranks: DataFrame, specs: Specs) -> DataFrame:
    """``df`` with each metric's rank from broadcast ``ranks``, null where it is not among them."""
    for m, keys, out, value in _metrics(specs):
        own = ranks.filter(F.col("m") == m).select(*[F.col(f"g{i}").alias(f"_g{i}") for i in range(len(keys))], F.col("v").alias("_v"), F.col("r").alias(out))
        match = F.col(value).eqNullSafe(F.col("_v"))
        for i, k in enumerate(keys):
            match = match & F.col(k).eqNullSafe(F.col(f"_g{i}"))
        df = df.join(F.broadcast(own), match, "left").drop("_v", *[f"_g{i}" for i in range(len(keys))])
    return df


def with_ranks(df: DataFrame, ranks: DataFrame, specs: Specs, bound: int = BROADCAST_RANKS) -> DataFrame:
    """``df`` with the rank of each metric out of stored ``ranks``.

    Up to ``bound`` ranks are broadcast, and ``df`` is not shuffled. Beyond it the values
    that hold more than 1 / ``bound`` of all entries (fewer than ``bound``) are broadcast;
    entries of rarer values meet their ranks on slim rows of a row's number, so no key
    holds more than that share, and come back to ``df`` in one shuffle for all metrics.
    """
    rows, held = ranks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if rows <= bound:
        return _looked_up(df, ranks, specs)
    hot = F.col("n") * max(bound, 1) > held
    columns, metrics = df.columns, _metrics(specs)
    numbered = store(df.withColumn("_row", F.monotonically_increasing_id()))
    found = _looked_up(numbered, ranks.filter(hot), specs) if bound else numbered.withColumns({out: F.lit(None).cast("double") for _, _, out, _ in metrics})
    found = store(found)
    open_ = F.array(*[F.col(out).isNull() for _, _, out, _ in metrics])
    slim = found.select("_row", F.explode(F.filter(F.arrays_zip(_entries(df, specs).alias("e"), open_.alias("open")), lambda x: x["open"])).alias("x")).select("_row", "x.e.*")
    cold = ranks.filter(~hot).select(*[F.col(c).alias(f"_{c}") for c in ranks.columns if c not in ("n", "r")], "r")
    same = F.lit(True)
    for c in slim.columns[1:]:
        same = same & slim[c].eqNullSafe(cold[f"_{c}"])
    met = slim.join(cold, same).groupBy("_row").agg(*[F.max(F.when(F.col("m") == m, F.col("r"))).alias(f"_r{m}") for m, *_ in metrics])
    out = found.join(met, "_row", "left")
    return out.select(*columns, *[F.coalesce(name, f"_r{m}").alias(name) for m, _, name, _ in metrics])


def percent_ranks(df: DataFrame, specs: Specs, mode: str = "histogram", population: DataFrame | None = None, bound: int = BROADCAST_RANKS) -> DataFrame:
    """Add ``out``: (rows of the group strictly below) / (rows - 1), for each out -> value of each (keys, metrics) of ``specs``.

    ``population`` is what is counted, where it is simpler than ``df`` itself (df without columns that joins have added).
    """
    if mode == "window":
        for keys, metrics in specs:
            df = df.withColumns({out: F.percent_rank().over(Window.partitionBy(*keys).orderBy(F.col(v).asc_nulls_first())) for out, v in metrics.items()})
        return df
    if mode != "histogram":
        raise ValueError(f"unknown mode {mode}")
    return with_ranks(df, store(ranks_of(value_counts(df if population is None else population, specs))), specs, bound)


def percent_rank_by(df: DataFrame, keys: list[str], metrics: dict[str, str], mode: str = "histogram", population: DataFrame | None = None, bound: int = BROADCAST_RANKS) -> DataFrame:
    """``percent_ranks`` of one grouping."""
    return percent_ranks(df, [(keys, metrics)], mode, population, bound)


def eligible(as_of_year: int, citations: bool = True) -> Column:
    """1950 < pub_year <= as_of_year, and cited."""
    ok = (F.col("pub_year") > 1950) & (F.col("pub_year") <= as_of_year)
    return ok & (F.col("num_citations") > 0) if citations else ok
