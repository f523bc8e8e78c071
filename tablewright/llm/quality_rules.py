"""Quality rules: base rules, then robust multivariate outliers by minimum-covariance-determinant estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, Scratch, or_empty, table

NGRAM = 5
#: Share of a group's rows that the estimate fits, as is usual for MCD between 0.5 and 1.
SUPPORT = 0.75
C_STEPS = 4
#: Starting estimates of the search.
STARTS = 3
#: Rows that the estimate over all groups counts for in each group's own: a group of many rows is on its own, one of few leans on all.
PRIOR_ROWS = 50
#: Least standard deviation of each transformed statistic; most are constant over clean text, where MCD is singular.
FLOORS = {"mean_word": 0.10, "symbols": 0.10, "dup_lines": 0.10, "repeats": 0.10, "upper": 0.10}
#: Squared distance beyond which a row is rejected: nine standard deviations. Set by hand, as statistics of short texts have longer tails than
#: a normal: between it and the 0.9999 quantile of chi-squared at 5 degrees (25.7) lie some clean texts and no bad ones of the test tables.
CUTOFF = 81.0


def repeated_words(words: Column, n: int = NGRAM) -> Column:
    """Words that lie in n-word windows found twice or more in the same text, the first occurrence included. Windows are
    64-bit hashes; texts whose windows all differ, the common case, need no sort."""

    def of_hashes(h):
        grams = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)]))
        return F.get(F.transform(F.array(grams), of_grams), F.lit(0))

    def of_grams(g):
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(F.get(F.transform(F.array(ordered), of_ordered), F.lit(0)))

    def of_ordered(o):
        twice = F.filter(o, lambda x, j: (x["g"] == F.get(o, j - 1)["g"]) | (x["g"] == F.get(o, j + 1)["g"]))
        return F.get(F.transform(F.array(F.array_sort(F.transform(twice, lambda x: x["i"]))), covered), F.lit(0))

    def covered(at):
        return F.aggregate(F.transform(at, lambda x, j: F.least(F.coalesce(F.get(at, j + 1) - x, F.lit(n)), F.lit(n))), F.lit(0), lambda a, x: a + x)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.get(F.transform(F.array(hashes), of_hashes), F.lit(0)).cast("long")


def statistics(docs: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    text = or_empty(F.col(text_col))
    group = F.concat_ws("\x1f", *[F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), or_empty(F.col(c).cast("string"))) for c in group_cols])
    rows = docs.select(F.col(id_col).alias("_id"), group.alias("_group"), text.alias("_text"))
    # one array of words serves all word statistics
    rows = rows.withColumn("_words", F.filter(F.split("_text", SPACE + "+"), lambda w: w != ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    return rows.select(
        "_id", "_group", F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"), F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("_upper"), F.size("_lines").cast("long").alias("_n_lines"),
    )


def transformed(s: DataFrame) -> DataFrame:
    """Ratios to the number of words, characters or lines, log-transformed, so that each is near a normal with few values
    far out; each is shrunk by a few words, characters or lines towards its usual value, so that short texts don't vary more than long ones."""
    n = F.col("n_words")
    return s.withColumns({
        "mean_word": F.log((F.col("word_chars") + 5.0 * 20) / (n + 20)),
        "symbols": F.log1p(10.0 * F.col("n_symbols") / (n + 20)),
        "dup_lines": F.log1p(2.0 * F.col("n_dup_lines") / (F.col("_n_lines") + 5)),
        "repeats": F.log1p(5.0 * F.col("n_repeat_words") / (n + 20)),
        "upper": F.log1p(5.0 * F.col("_upper") / (F.col("word_chars") + 100)),
    })


DIMS = tuple(FLOORS)


PAIRS = [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]


def _factor(est: DataFrame, s: int) -> DataFrame:
    """Replaces start s's covariance by the Cholesky factor of it plus the floors' variances, and adds the log of its determinant."""
    for i, j in PAIRS:
        rest = F.col(f"c{s}_{i}_{j}") + F.lit(FLOORS[DIMS[i]] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l{s}_{i}_{k}") * F.col(f"l{s}_{j}_{k}")
        est = est.withColumn(f"l{s}_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{s}_{j}_{j}"))
    return est.withColumn(f"det{s}", sum((2 * F.log(f"l{s}_{i}_{i}") for i in range(len(DIMS))), F.lit(0.0))).drop(*[f"c{s}_{i}_{j}" for i, j in PAIRS])


def _distance(s: int) -> Column:
    """The squared Mahalanobis distance of the row's statistics from start s's estimate beside them, by forward substitution."""
    zs: list[Column] = []
    for i, d in enumerate(DIMS):
        z = F.col(d) - F.col(f"m{s}_{i}")
        for k, before in enumerate(zs):
            z = z - F.col(f"l{s}_{i}_{k}") * before
        zs.append(z / F.col(f"l{s}_{i}_{i}"))
    return sum((z * z for z in zs), F.lit(0.0))


def _steadied(moments: DataFrame, prior: int) -> DataFrame:
    """Moments of each group (n, m, c of each start), drawn towards those over all groups as by `prior` rows more. One row per group."""
    names = [(s, n) for s in range(STARTS) for n in ([f"m{s}_{i}" for i in range(len(DIMS))] + [f"c{s}_{i}_{j}" for i, j in PAIRS])]
    every = moments.agg(F.lit(1).alias("_one"), *[(F.sum(F.col(n) * F.col(f"n{s}")) / F.sum(f"n{s}")).alias(f"all_{n}") for s, n in names])
    both = moments.withColumn("_one", F.lit(1)).join(every, "_one").drop("_one")
    both = both.withColumns({n: (F.coalesce(n, F.lit(0.0)) * F.col(f"n{s}") + F.col(f"all_{n}") * prior) / (F.col(f"n{s}") + prior) for s, n in names})
    for s in range(STARTS):
        both = _factor(both, s)
    return both.drop(*[f"all_{n}" for _, n in names])


def mcd(rows: DataFrame, scratch: Scratch, support: float = SUPPORT, c_steps: int = C_STEPS, prior: int = PRIOR_ROWS) -> DataFrame:
    """rows (_key, statistics) to one row per key: centre m0_i, Cholesky factor l0_i_j and log-determinant det0 of the best estimate found.

    Deterministic starts: medians with the floors, medians with interquartile ranges, means with covariances. From each, c_steps times the `support`
    share of a group's rows at the least distance gives new moments (the C-step of MCD); of the ends the one of least determinant is
    taken. Without floors, prior and approximate percentiles no C-step would increase the determinant; with them one may, by little.
    All starts go through the same passes: two aggregates a step over the statistics, with partial sums in each task, beside a table of one row per
    group, whose size Spark knows as it is written. No group is gathered.
    """
    quarter = lambda d: F.percentile_approx(d, [0.25, 0.5, 0.75], 1000)
    seen = scratch.write(rows.groupBy("_key").agg(F.count("*").cast("double").alias("n"), *[quarter(d).alias(f"q_{i}") for i, d in enumerate(DIMS)], *[F.avg(d).alias(f"a_{i}") for i, d in enumerate(DIMS)], *[F.covar_pop(DIMS[i], DIMS[j]).alias(f"v_{i}_{j}") for i, j in PAIRS]))
    first = {f"n{s}": F.col("n") for s in range(STARTS)}
    for i in range(len(DIMS)):
        first |= {f"m0_{i}": F.get(f"q_{i}", F.lit(1)), f"m1_{i}": F.get(f"q_{i}", F.lit(1)), f"m2_{i}": F.col(f"a_{i}")}
    for i, j in PAIRS:
        spread = (F.get(f"q_{i}", F.lit(2)) - F.get(f"q_{i}", F.lit(0))) / 1.349
        first |= {f"c0_{i}_{j}": F.lit(0.0), f"c1_{i}_{j}": spread * spread if i == j else F.lit(0.0), f"c2_{i}_{j}": F.coalesce(f"v_{i}_{j}", F.lit(0.0))}
    est = scratch.write(_steadied(seen.select("_key", *[c.alias(n) for n, c in first.items()]), prior))
    for _ in range(c_steps):
        near = rows.join(est, "_key").select("_key", *DIMS, *[_distance(s).alias(f"d{s}") for s in range(STARTS)])
        radius = scratch.write(near.groupBy("_key").agg(*[F.percentile_approx(f"d{s}", support, 1000).alias(f"r{s}") for s in range(STARTS)]))
        inner = near.join(radius, "_key")
        aggs = []
        for s in range(STARTS):
            take = lambda d, s=s: F.when(F.col(f"d{s}") <= F.col(f"r{s}"), F.col(d))
            aggs += [F.count(take(DIMS[0])).cast("double").alias(f"n{s}"), *[F.avg(take(d)).alias(f"m{s}_{i}") for i, d in enumerate(DIMS)], *[F.covar_pop(take(DIMS[i]), take(DIMS[j])).alias(f"c{s}_{i}_{j}") for i, j in PAIRS]]
        new = scratch.write(_steadied(inner.groupBy("_key").agg(*aggs), prior))
        scratch.drop(est, radius)
        est = new
    scratch.drop(seen)
    pick = lambda name: F.coalesce(*[F.when(F.col(f"det{s}") == F.least(*[f"det{k}" for k in range(STARTS)]), F.col(name.format(s=s))) for s in range(STARTS)])
    names = [f"m{{s}}_{i}" for i in range(len(DIMS))] + [f"l{{s}}_{i}_{j}" for i, j in PAIRS] + ["det{s}"]
    return est.select("_key", *[pick(n).alias(n.format(s=0)) for n in names])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), support: float = SUPPORT, c_steps: int = C_STEPS, prior: int = PRIOR_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of docs: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance
    (squared; null if base_failed) and kept.

    Words are runs without ASCII white space (null text: none). Texts of fewer than 10 words, or with over 20% of their
    words in repeated 5-word windows, fail the base rules. For the others, each group (language and source, nulls being
    values of their own) gets a robust centre and scatter of the transformed statistics (see mcd), drawn towards that of all groups as by `prior`
    rows. Rows beyond the cutoff are rejected.

    Texts are read once into a table of counts; the steps run on that. Medians and the support's radius are approximate
    percentiles of bounded size. Repeated rows count each time. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.write(statistics(docs, id_col, text_col, list(group_cols)))
    stats = stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    good = transformed(stats.filter("not base_failed")).withColumnRenamed("_group", "_key")
    est = scratch.write(mcd(good.select("_key", *DIMS), scratch, support, c_steps, prior))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = good.join(est, "_key").withColumn("distance", _distance(0)).select("_id", *counts, "distance", (F.col("distance") <= cutoff).alias("kept"))
    failed = stats.filter("base_failed").select("_id", *counts, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return out.unionAll(failed).withColumnRenamed("_id", id_col)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
