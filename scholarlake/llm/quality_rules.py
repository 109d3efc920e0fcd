"""Operator 5: quality rules with robust multivariate outliers, in DataFrame operations only.

Fixed rules fail a document first (too few words, too much repetition). The rest are
judged by a minimum-covariance-determinant estimate per language and source: from a
coordinate-wise median start, concentration steps take the share ``core`` of documents
with the smallest Mahalanobis distance and estimate centre and covariance from them
again, until no group's determinant falls; a document is rejected if its distance to the
final estimate passes ``cutoff``.

Statistics are transformed to logarithms and rounded to 1/256, so that the moments are
exact integer sums and reruns agree. ``FLOOR`` is the least standard deviation that a
statistic is credited with; many statistics are zero for most documents. A group's sums
are joined by those of ``prior`` documents of its language's core, and a language's by as
many of all, so that small groups lean on their parent by degrees. Estimates are partial
aggregates (a hot group is combined before the shuffle), one row per group.

Defined results: null text has no words and fails the base rules; null lang and null
source are groups of their own; repeated rows count each; texts of any length count
whole; an empty table gives none; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ASCII_SPACE_RE, let, materialize, read_table

SYMBOLS = "#*$%&|<>"
SCALE = 256
#: Least standard deviations (natural logarithms) of the five statistics below.
FLOOR = (0.15, 0.4, 0.8, 1.2, 0.5)
#: Squared distance that rejects: far beyond the 0.9999 quantile of chi-squared with 5 degrees of freedom (25.7).
CUTOFF = 30.0
#: chi-squared, 5 degrees of freedom: what makes the covariance of the core 75 % consistent for all.
CONSISTENCY = 1.41


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE_RE, -1), "")


def count_in(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def n_repeat_words(words: Column, width: int = 8) -> Column:
    """Words inside ``width``-word windows that occur at least twice in the text."""

    def covered(h: Column) -> Column:
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        repeated = let(at, lambda s: F.filter(s, lambda x, j: same(s, j, j - 1) | same(s, j, j + 1)))
        places = F.array_sort(F.transform(repeated, lambda x: x["i"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))),
                F.lit(0), lambda a, b: a + b,
            ),
        )

    def doubled(h: Column, step: int) -> Column:
        """Hashes of runs twice as long: each hash with the one ``step`` further on."""
        return let(h, lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(a, i + step))))

    hashes, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < width:
        hashes, step = doubled(hashes, step), step * 2
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(some)


def statistics(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, and the base statistics of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = lambda line: F.length(F.btrim(line, F.lit(ASCII_SPACE))) > 0
    base = let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    dups = let(F.filter(F.split(text, "\n", -1), worded), lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("d")))
    out = docs.withColumn("_w", base).withColumn("_l", dups).select(
        *[c for c in docs.columns if c != "text"],
        F.col("_w.n_words").alias("n_words"),
        (F.length(text) - count_in(text, ASCII_SPACE)).cast("long").alias("word_chars"),
        count_in(text, SYMBOLS).cast("long").alias("n_symbols"),
        F.col("_l.d").cast("long").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        F.col("_l.n").cast("long").alias("n_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
    )
    return out


def base_failed(min_words: int, max_repeat: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, as integers in 1/256."""
    share = lambda part, whole: F.log1p(100.0 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    mean_length = F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))
    logs = [mean_length, share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars")]
    return [F.round(x * SCALE).cast("long") for x in logs]


#: Tables with a row per group are broadcast up to this many groups (some 300 bytes each); beyond it they are shuffled.
BROADCAST_GROUPS = 50_000
DIMS = len(FLOOR)
X = [f"x{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _precision(moments: DataFrame, scale: float) -> DataFrame:
    """(key, logdet, m*, p*_*): centre and inverse covariance from a group's sums, by Cholesky's method."""
    g = moments.select(
        "key",
        *[(F.col(f"s{i}") / F.col("n") / SCALE).alias(f"m{i}") for i in range(DIMS)],
        *[(F.lit(scale) * (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")) / SCALE**2 + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}") for i, j in PAIRS],
    )
    for i, j in PAIRS:  # lower triangle of the root
        rest = F.col(f"c{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        g = g.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}"))
    g = materialize(g.select("key", *[f"m{i}" for i in range(DIMS)], *[f"l{i}_{j}" for i, j in PAIRS]), "roots")
    for i, j in PAIRS:  # and its inverse
        if i == j:
            g = g.withColumn(f"v{i}_{j}", 1 / F.col(f"l{i}_{i}"))
        else:
            rest = F.lit(0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"v{k}_{j}")
            g = g.withColumn(f"v{i}_{j}", rest / F.col(f"l{i}_{i}"))
    logdet = sum((2 * F.log(F.col(f"l{i}_{i}")) for i in range(DIMS)), F.lit(0.0))
    return g.select("key", logdet.alias("logdet"), *[f"m{i}" for i in range(DIMS)], *[sum((F.col(f"v{k}_{i}") * F.col(f"v{k}_{j}") for k in range(i, DIMS)), F.lit(0.0)).alias(f"p{i}_{j}") for i, j in PAIRS])


def distance() -> Column:
    """Squared Mahalanobis distance, rounded to 1/64; needs x*, m* and p*."""
    d = [F.col(f"x{i}") / SCALE - F.col(f"m{i}") for i in range(DIMS)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + F.col(f"p{i}_{j}") * d[i] * d[j] * (1.0 if i == j else 2.0)
    return F.least(F.round(total * 64), F.lit(1 << 20)).cast("long")


SUMS = [f"s{i}" for i in range(DIMS)] + [f"s{i}_{j}" for i, j in PAIRS]


def concentrate(vectors: DataFrame, core: float = 0.75, steps: int | None = None, per_group=lambda table: table) -> DataFrame:
    """(key, n, s*): the sums over the core of each group of ``vectors`` (key, x*) with the least determinant.

    From a coordinate-wise median start, steps go on in each group until its determinant
    no longer falls (by a ten-thousandth at least), or for ``steps`` steps. ``per_group``
    marks the tables with a row per group before they are joined.
    """
    middle = vectors.groupBy("key").agg(*[F.expr(f"percentile(x{i}, 0.5)").alias(f"q{i}") for i in range(DIMS)])
    spread = vectors.join(per_group(middle), "key").groupBy("key").agg(
        *[F.first(f"q{i}").alias(f"q{i}") for i in range(DIMS)],
        *[F.expr(f"percentile(abs(x{i} - q{i}), 0.5)").alias(f"d{i}") for i in range(DIMS)],
    )
    now = spread.select(
        "key", *[(F.col(f"q{i}") / SCALE).alias(f"m{i}") for i in range(DIMS)],
        *[(1 / (F.pow(1.4826 * F.col(f"d{i}") / SCALE, 2) + FLOOR[i] ** 2) if i == j else F.lit(0.0)).alias(f"p{i}_{j}") for i, j in PAIRS],
        F.lit(float("inf")).alias("logdet"),
    )
    now, best, step = materialize(now, "mcd"), None, 0
    while True:
        at = vectors.join(per_group(now.drop("logdet")), "key").select("key", *X, distance().alias("d"))
        cut = at.groupBy("key").agg(F.expr(f"percentile(d, {core})").alias("cut"))
        moments = at.join(per_group(cut), "key").filter(F.col("d") <= F.col("cut")).groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS],
        )
        # groups whose determinant fell; the others keep what they have and take no further part
        moments = materialize(moments, "mcd-moments")
        fit = materialize(_precision(moments, CONSISTENCY), "mcd-fit")  # a filter must not repeat its long expressions
        fallen = moments.join(per_group(fit.join(now.select("key", F.col("logdet").alias("before")), "key")), "key")
        fallen = materialize(fallen.filter(F.col("logdet") < F.col("before") - 1e-4).drop("before"), "mcd")
        step += 1
        kept = best.join(fallen.select("key"), "key", "left_anti") if best is not None else None
        best = materialize(fallen.select("key", "n", *SUMS) if kept is None else fallen.select("key", "n", *SUMS).unionByName(kept), "mcd-best")
        if step == steps or fallen.isEmpty():
            return best
        now = fallen.drop("n", *SUMS)


def estimates(vectors: DataFrame, core: float = 0.75, steps: int | None = None, per_group=lambda table: table) -> DataFrame:
    """(key, m*, p*_*, logdet): the minimum-covariance-determinant estimate of each group of ``vectors`` (key, x*)."""
    return _precision(concentrate(vectors, core, steps, per_group), CONSISTENCY)


def shrunk(groups: DataFrame, cores: DataFrame, prior: float, per_group) -> DataFrame:
    """(keys, m*, p*_*) by (language, source): its core joined by ``prior`` documents of its language's core, that by as many of all."""
    out = groups
    for level in (2, 1, 0):  # all, language, language and source
        part = per_group(cores.select(F.col("key").alias("_key"), F.struct("n", *SUMS).alias(f"g{level}")))
        out = out.join(part, F.get("keys", F.lit(level)) == F.col("_key"), "left").drop("_key")
    of = lambda level, c: F.coalesce(F.col(f"g{level}.{c}"), F.lit(0)).cast("double")
    total = {c: of(2, c) for c in ("n", *SUMS)}
    for level in (1, 0):
        total = {c: of(level, c) + F.lit(prior) * total[c] / total["n"] for c in total}
    out = out.filter("g2 is not null").select(F.col("keys").alias("key"), *[total[c].alias(c) for c in total])
    return _precision(materialize(out, "pooled"), CONSISTENCY).withColumnRenamed("key", "keys").drop("logdet")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "base_failed", "distance", "kept")


def judge(
    docs: DataFrame, min_words: int = 20, max_repeat: int = 30, prior: float = 50, cutoff: float = CUTOFF, core: float = 0.75, steps: int | None = None
) -> DataFrame:
    """The columns of ``docs`` but text, the base statistics, base_failed, distance and kept.

    Columns of ``docs`` that have the name of a result give way to it.
    """
    passed = [c for c in docs.columns if c.lower() not in (*RESULTS, "text")]
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    keys = F.array(F.concat(F.lit("2"), F.to_json(F.array(lang, source))), F.concat(F.lit("1"), lang), F.lit("0"))
    rows = docs.select(F.struct(*passed).alias("row"), keys.alias("keys"), "text")
    stats = statistics(rows).withColumn("base_failed", base_failed(min_words, max_repeat))
    stats = materialize(stats.select("*", *[v.alias(x) for v, x in zip(vector(), X, strict=True)]), "stats")
    vectors = stats.filter(~F.col("base_failed")).select(F.explode("keys").alias("key"), *X)
    groups = materialize(stats.select("keys").distinct(), "groups")
    # with few groups no row of a hot group is shuffled to meet its estimate
    per_group = F.broadcast if groups.count() <= BROADCAST_GROUPS else (lambda table: table)
    fits = materialize(shrunk(groups, concentrate(vectors, core, steps, per_group), prior, per_group), "fits")
    judged = stats.join(per_group(fits), "keys", "left").withColumn("distance", distance() / 64.0)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return judged.select(*[F.col("row").getField(c).alias(c) for c in passed], *RESULTS[:-1], kept.alias("kept"))


def op5_quality_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
