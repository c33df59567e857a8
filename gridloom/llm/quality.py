"""Quality rules: base rules, and robust multivariate outliers per language and source.

Every document gets a vector of transformed statistics.  For each (language,
source) a minimum-covariance-determinant estimate of centre and scatter is
found by concentration steps from several starts: the h documents nearest in
Mahalanobis distance give the next mean and covariance, until no determinant
falls; the smallest one is kept.  Documents far from that estimate are rejected.  Only DataFrame expressions are used: quantiles come from
counts over fixed bins, so a hot source is aggregated before any shuffle, and
the linear algebra of a group is a handful of column expressions.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import scratch_dir, written

from .common import private, public

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Statistics of the vector; smallest standard deviations that count (they keep the scatter regular).
NAMES = ("word_length", "symbols", "dup_lines", "repeats")
FLOOR = (0.35, 0.12, 0.08, 0.05)
#: Share of a group that the estimate rests on, least group, chance of rejecting a Gaussian document.
SUBSET, LEAST_GROUP, ALPHA = 0.75, 40, 1e-5
#: Fall of a determinant's logarithm below which a start has converged; most rows of parameters that are broadcast.
LEAST_FALL, MOST_PARAMS = 1e-6, 50_000
#: Group of the documents that have no large enough group in their language; other names have a separator.
REST = "*"
#: Bins a unit of a statistic, and a factor 2 of a distance.
BINS, LOG_BINS = 256, 32


def chi2_cdf(x: float, dof: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, dof // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < q else (lo, mid)
    return lo


#: Makes the scatter of the nearest SUBSET of a Gaussian sample consistent.
CONSISTENT = SUBSET / chi2_cdf(chi2_quantile(SUBSET, len(NAMES)), len(NAMES) + 2)
CUTOFF = chi2_quantile(1 - ALPHA, len(NAMES))


def statistics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (long). Null text is empty.

    Windows are compared by 64-bit hashes of their words.  Arrays that a lambda
    reads at many places are columns of their own, so that they are made once a row.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns]
    n = F.size("_words")
    df = docs.select(*own, F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    marks = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("_words", i, 5)))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        marks.alias("_marks"),
    )
    kept = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    by_hash = F.when(F.size(F.array_distinct("_marks")) < F.size("_marks"), F.array_sort(F.transform("_marks", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)
    df = df.select(*own, *kept, by_hash.alias("_by"))
    same = lambda k, step: F.get("_by", k + step).h
    again = F.filter("_by", lambda s, k: F.coalesce(same(k, -1) == s.h, F.lit(False)) | F.coalesce(same(k, 1) == s.h, F.lit(False)))
    df = df.select(*own, *kept, F.array_sort(F.transform(again, lambda s: s.i)).alias("_at"))
    widths = F.transform("_at", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_at", k + 1) - p, F.lit(5))))
    return df.select(*own, *kept, F.aggregate(widths, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, each of about unit range."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(1 + F.col("word_chars") / n) * 4,
        F.log(1 + 10 * F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
        F.col("n_repeat_words") / n,
    ]


def _binned_quantile(df: DataFrame, q: float, columns: list[str], bins: int = BINS) -> DataFrame:
    """Per group the least bin at which each column's count reaches q of the group: counts are partial before the shuffle."""
    p = len(columns)
    long = df.select("group", F.posexplode(F.array(*[F.floor(F.col(c) * bins) for c in columns])).alias("j", "bin"))
    counts = long.groupBy("group", "j", "bin").count()
    w = Window.partitionBy("group", "j")
    run = counts.withColumn("upto", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
    return run.where(F.col("upto") >= F.ceil(q * F.col("all"))).groupBy("group").agg(*[F.min(F.when(F.col("j") == j, F.col("bin"))).alias(f"q{j}") for j in range(p)])


def _beside(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` with the written ``params`` of their group, which are broadcast if they are few."""
    few = params.limit(MOST_PARAMS + 1).count() <= MOST_PARAMS
    return rows.join(F.broadcast(params) if few else params, "group")


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. under the Cholesky factor l00, l10, ...: forward substitution."""
    z: list[Column] = []
    for i in range(p):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    out = z[0] * z[0]
    for x in z[1:]:
        out = out + x * x
    return out


def _with_factor(params: DataFrame, p: int) -> DataFrame:
    """Replaces covariances c00, c10, ... by their Cholesky factor."""
    for i in range(p):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(v) if i == j else v / F.col(f"l{j}{j}"))
    return params.drop(*[f"c{i}{j}" for i in range(p) for j in range(i + 1)])


def _moments(df: DataFrame, p: int) -> DataFrame:
    """Mean and Cholesky factor per group and start, with the logarithm of the determinant; the covariance is made consistent and raised to the floor."""
    sums = df.groupBy("group", "start").agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"e{i}{j}") for i in range(p) for j in range(i + 1)]
    )
    cov = [((F.col(f"e{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENT + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    out = _with_factor(sums.select("group", "start", *[f"m{i}" for i in range(p)], *cov), p)
    return out.withColumn("size", sum((2 * F.log(f"l{i}{i}") for i in range(p)), F.lit(0.0)))


def _bin_of_distance() -> Column:
    return F.floor(F.log2(F.col("d2") + 1e-9) * LOG_BINS)


def robust_estimates(vectors: DataFrame, path: str) -> DataFrame:
    """Minimum-covariance-determinant mean and factor per group from (group, x0, ...), with ``size``, the determinant's logarithm.

    Starts: medians with MADs; mean and covariance of all; medians with a round
    scatter.  Each start steps on until no determinant falls any more; of all
    estimates on the way that of the smallest determinant is the group's.
    """
    p = len(NAMES)
    xs, ms = [f"x{i}" for i in range(p)], [f"m{i}" for i in range(p)]
    ls = [f"l{i}{j}" for i in range(p) for j in range(i + 1)]
    med = written(_binned_quantile(vectors, 0.5, xs).select("group", *[((F.col(f"q{i}") + 0.5) / BINS).alias(f"m{i}") for i in range(p)]), f"{path}/median")
    off = _beside(vectors, med).select("group", *[F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"x{i}") for i in range(p)])
    mad = _binned_quantile(off, 0.5, xs)
    plain = lambda diagonal: [(diagonal(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(p) for j in range(i + 1)]
    one = med.join(mad, "group").select("group", F.lit(0).alias("start"), *ms, *plain(lambda i: F.sqrt((1.4826 * (F.col(f"q{i}") + 0.5) / BINS) ** 2 + FLOOR[i] ** 2)))
    two = _moments(vectors.withColumn("start", F.lit(1)), p).drop("size")
    three = med.select("group", F.lit(2).alias("start"), *ms, *plain(lambda i: F.lit(1.0)))
    params = written(one.unionByName(two).unionByName(three), f"{path}/start")
    best = None
    for step in itertools.count():
        far = _beside(vectors, params).withColumn("d2", _distance(p)).select("group", "start", *xs, _bin_of_distance().alias("bin"))
        w = Window.partitionBy("group", "start")
        run = far.groupBy("group", "start", "bin").count().withColumn("upto", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
        cut = run.where(F.col("upto") >= F.ceil(SUBSET * F.col("all"))).groupBy("group", "start").agg(F.min("bin").alias("cut"))
        held = written(params.select("group", "start", *ms, *ls).join(cut, ["group", "start"]), f"{path}/cut{step}")
        near = _beside(vectors, held).withColumn("d2", _distance(p)).where(_bin_of_distance() <= F.col("cut")).select("group", "start", *xs)
        params = written(_moments(near, p), f"{path}/step{step}")
        if best is None:
            best = params.withColumn("fell", F.lit(True))
        else:
            last = best.select("group", "start", *[F.col(c).alias(f"o_{c}") for c in (*ms, *ls, "size")])
            fell = F.col("size") < F.col("o_size") - LEAST_FALL
            best = params.join(last, ["group", "start"]).select("group", "start", *[F.when(fell, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in (*ms, *ls, "size")], fell.alias("fell"))
        best = written(best, f"{path}/best{step}")
        if best.where("fell").isEmpty():
            return best.groupBy("group").agg(F.min(F.struct("size", "start", *ms, *ls)).alias("s")).select("group", "s.*").drop("start")


def apply_rules(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_group: int = LEAST_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` with the statistics, base_failed, distance (squared; null where not judged) and kept.

    Documents that fail a base rule are not kept and do not enter an estimate.  A
    (language, source) with fewer than ``least_group`` others is pooled with the
    small ones of its language, a pool still smaller with those of all languages;
    if these are too few as well, they are judged by the estimate of all documents,
    however few these are.  Null language or source is a value like any other; null
    and empty texts have no words and fail; repeated rows each count; an empty
    table gives no rows; extra columns come through, and a result whose name one of
    them has gets an underscore.
    """
    spark = docs.sparkSession
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "distance", "kept"]
    docs, names = private(docs)
    text_col, lang_col, source_col = names[text_col], names[lang_col], names[source_col]
    path = scratch_dir(spark)
    p = len(NAMES)
    df = statistics(docs, text_col=text_col).withColumn("base_failed", base_failed())
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    df = df.withColumns({"_lang": key(lang_col), "_source": key(source_col)} | {f"x{i}": v for i, v in enumerate(vector())})
    df = written(df, f"{path}/statistics")
    good = df.where(~F.col("base_failed"))
    sizes = good.groupBy("_lang", "_source").count()
    pool = F.when(F.col("count") >= least_group, F.col("_source")).otherwise("*")
    groups = sizes.select("_lang", "_source", F.concat_ws("\x1f", "_lang", pool).alias("group"), "count")
    size = F.sum("count").over(Window.partitionBy("group"))
    groups = groups.withColumn("size", size).select("_lang", "_source", F.when(F.col("size") >= least_group, F.col("group")).otherwise(REST).alias("group"), "count")
    groups = written(groups, f"{path}/groups")
    rest = groups.agg(F.coalesce(F.sum(F.when(F.col("group") == REST, F.col("count"))), F.lit(0))).first()[0]
    groups = groups.drop("count")
    xs = [f"x{i}" for i in range(p)]
    few = groups.limit(MOST_PARAMS + 1).count() <= MOST_PARAMS
    vectors = good.join(F.broadcast(groups) if few else groups, ["_lang", "_source"]).select("group", *xs)
    if 0 < rest < least_group:
        vectors = vectors.where(F.col("group") != REST).unionByName(good.select(F.lit(REST).alias("group"), *xs))
    params = robust_estimates(vectors, path)
    judged = written(groups.join(params, "group").drop("group", "size"), f"{path}/judged")
    few = judged.limit(MOST_PARAMS + 1).count() <= MOST_PARAMS
    out = df.join(F.broadcast(judged) if few else judged, ["_lang", "_source"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance(p)))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False)))
    return public(out, names, made)
