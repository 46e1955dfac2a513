"""Quality rules with robust outlier detection, in DataFrame operations alone.

Fixed rules look at one document. The method compares a document with its
language and source: counts become a vector of smoothed log rates, each group
gets a minimum-covariance-determinant estimate of centre and scatter (the
covariance of the tightest ``share`` of its rows, found by concentration steps
from two starts), and documents beyond a Mahalanobis distance are rejected.

Rates are kept as integers, so sums do not depend on the order of rows and reruns
agree. A concentration step counts rows per distance bin and takes the lowest
bins, so a group that holds a third of the table is summed like any other: no
sort, no group in one task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import written

_SPACE = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
#: rates are counted in units of 1 / SCALE
SCALE = 10_000
#: distances are binned by powers of 2 ** (1 / BINS)
_BINS = 32

STATS = ("word_length", "symbols", "repeats", "capitals", "line_repeats")
#: standard deviation added to each log rate: differences below it mean nothing
FLOORS = (0.05, 0.25, 0.35, 0.25, 0.35)


def chi2_cdf(x: float, d: int) -> float:
    """Chi-square distribution with ``d`` degrees of freedom, by its series."""
    if x <= 0:
        return 0.0
    a, half = d / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= half / k
        total += term
    return total * math.exp(a * math.log(half) - half - math.lgamma(a))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, d) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def with_counts(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (as the struct ``row``) with its counts.

    ``n_words`` and ``word_chars``; ``n_symbols``; ``n_lines`` with a word and
    ``n_dup_lines`` equal to an earlier one; ``n_repeat_words`` inside windows of
    five words that occur twice or more in the text; ``n_capitals``. NULL and
    empty texts have zeros. Windows are compared by a 64-bit hash. Work and
    memory of a row follow its own length times a logarithm.
    """
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).withColumn("t", text)
    bare = F.btrim("t", F.lit(_BLANKS))
    none = F.array().cast("array<string>")
    cut = rows.select(
        "row",
        F.when(bare == "", none).otherwise(F.split(bare, _SPACE + "+")).alias("words"),
        F.filter(F.split("t", "\n", -1), lambda line: F.btrim(line, F.lit(_BLANKS)) != "").alias("lines"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_capitals"),
    )
    window = f"xxhash64({', '.join(f'get(words, i + {k})' for k in range(5))})"
    hashed = cut.select(
        "row",
        "n_symbols",
        "n_capitals",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "case when size(words) >= 5 then transform(sequence(0, size(words) - 5), "
            f"i -> {window}) else cast(array() as array<bigint>) end"
        ).alias("windows"),
    )
    # texts without a repeated window (nearly all) are done by the distinct count
    placed = hashed.withColumn(
        "placed",
        F.expr(
            "case when size(array_distinct(windows)) < size(windows) then "
            "array_sort(transform(windows, (h, p) -> struct(h, p))) "
            "else cast(array() as array<struct<h:bigint,p:int>>) end"
        ),
    ).drop("windows")
    found = placed.withColumn(
        "at",
        F.expr(
            "array_sort(transform(filter(placed, (x, j) -> "
            "get(placed, j - 1).h <=> x.h or get(placed, j + 1).h <=> x.h), x -> x.p))"
        ),
    ).drop("placed")
    covered = (
        "aggregate(at, named_struct('n', 0L, 'end', 0L), (s, p) -> named_struct("
        "'n', s.n + p + 5L - greatest(cast(p as bigint), s.end), 'end', p + 5L), s -> s.n)"
    )
    return found.withColumn("n_repeat_words", F.expr(covered)).drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_rates(counted: DataFrame) -> DataFrame:
    """Add ``rates``: the transformed statistics in units of 1 / SCALE.

    Each is the log of a rate, smoothed by a constant so that short texts, whose
    rates vary most, stay near the middle.
    """
    n, chars = F.col("n_words"), F.col("word_chars")
    logs = (
        F.ln((chars + 300) / (n + 50)),
        F.ln(1 + 100 * F.col("n_symbols") / (chars + 100)),
        F.ln(1 + 100 * F.col("n_repeat_words") / (n + 20)),
        F.ln(1 + 100 * F.col("n_capitals") / (chars + 100)),
        F.ln(1 + 100 * F.col("n_dup_lines") / (F.col("n_lines") + 4)),
    )
    return counted.withColumn("rates", F.array(*[F.round(x * SCALE).cast("long") for x in logs]))


# --- estimates --------------------------------------------------------------


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _moments(rows: DataFrame, keys: list[str], d: int) -> DataFrame:
    """``n``, means ``m_i`` and covariances ``c_i_j`` of the rates per group."""
    x = [F.col("rates")[i] for i in range(d)]
    big = "decimal(20,0)"
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(x[i]).alias(f"s_{i}") for i in range(d)],
        *[F.sum((x[i] * x[j]).cast(big)).alias(f"p_{i}_{j}") for i, j in _pairs(d)],
    )
    return sums.select(
        *keys,
        "n",
        *[(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(d)],
        *[
            (
                F.col(f"p_{i}_{j}").cast("double") / F.col("n")
                - (F.col(f"s_{i}") / F.col("n")) * (F.col(f"s_{j}") / F.col("n"))
            ).alias(f"c_{i}_{j}")
            for i, j in _pairs(d)
        ],
    )


def _factored(est: DataFrame, keys: list[str], d: int, prior: float, widen: float) -> DataFrame:
    """Cholesky factor ``l_i_j`` of the widened, shrunken, floored covariance.

    Small groups lean on a prior of ``prior`` rows with three times the floors;
    the floors make every matrix positive definite.
    """
    out = est
    for i, j in _pairs(d):
        fixed = (3 * FLOORS[i] * SCALE) ** 2 * prior if i == j else 0.0
        floor = (FLOORS[i] * SCALE) ** 2 if i == j else 0.0
        value = (F.col("n") * widen * F.col(f"c_{i}_{j}") + fixed) / (F.col("n") + prior) + floor
        for k in range(j):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        value = F.sqrt(F.greatest(value, F.lit(1e-3))) if i == j else value / F.col(f"l_{j}_{j}")
        out = out.withColumn(f"l_{i}_{j}", value)
    logdet = reduce(lambda a, b: a + b, [F.ln(f"l_{i}_{i}") for i in range(d)])
    return out.withColumn("logdet", logdet).select(
        *keys, "logdet", *[f"m_{i}" for i in range(d)], *[f"l_{i}_{j}" for i, j in _pairs(d)]
    )


def _matched(rows: DataFrame, est: DataFrame, groups: list[str]) -> DataFrame:
    """Rows beside their group's estimates; a NULL group is a group."""
    names = {g: f"_of_{g}" for g in groups}
    est = est.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(names[g])) for g in groups])
    return rows.join(est, same, "left").drop(*names.values())


def _distance(matched: DataFrame, d: int) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance, by forward substitution."""
    out = matched
    for i in range(d):
        value = F.col("rates")[i] - F.col(f"m_{i}")
        for j in range(i):
            value = value - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        out = out.withColumn(f"y_{i}", value / F.col(f"l_{i}_{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(d)])
    made = [f"y_{i}" for i in range(d)] + [f"m_{i}" for i in range(d)]
    return out.withColumn("d2", d2).drop(*made, *[f"l_{i}_{j}" for i, j in _pairs(d)])


def _median_bins(long: DataFrame, keys: list[str]) -> DataFrame:
    """Median of ``v`` per group (to a bin of 20 units), from value counts."""
    counts = long.withColumn("b", F.floor(F.col("v") / 20)).groupBy(*keys, "b").agg(
        F.count(F.lit(1)).alias("k")
    )
    up = Window.partitionBy(*keys)
    upto = counts.withColumn("upto", F.sum("k").over(up.orderBy("b"))).withColumn(
        "n", F.sum("k").over(up)
    )
    return upto.filter("2 * upto >= n and 2 * (upto - k) < n").select(
        *keys, "n", (F.col("b") * 20 + 10).alias("median")
    )


def _melted(rows: DataFrame, groups: list[str]) -> DataFrame:
    return rows.select(*groups, F.posexplode("rates").alias("i", "v"))


def _robust_start(rows: DataFrame, groups: list[str], d: int) -> DataFrame:
    """Medians and scaled median deviations as a diagonal start."""
    long = _melted(rows, groups)
    middle = written(_median_bins(long, [*groups, "i"]), "medians")
    beside = _matched(long, middle.drop("n"), [*groups, "i"])
    spread = _median_bins(
        beside.withColumn("v", F.abs(F.col("v") - F.col("median"))).drop("median"), [*groups, "i"]
    ).withColumnRenamed("median", "mad")
    both = _matched(middle, spread.drop("n"), [*groups, "i"])

    def pick(i: int, value: Column) -> Column:
        return F.max(F.when(F.col("i") == i, value)).cast("double")

    return both.groupBy(*groups).agg(
        F.max("n").alias("n"),
        *[pick(i, F.col("median")).alias(f"m_{i}") for i in range(d)],
        *[
            (pick(i, F.pow(1.4826 * F.col("mad"), 2)) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}")
            for i, j in _pairs(d)
        ],
    )


def robust_estimates(
    rows: DataFrame, groups: list[str], share: float = 0.75, steps: int = 3, prior: float = 10.0
) -> DataFrame:
    """Centre ``m_i`` and Cholesky factor ``l_i_j`` of every group of ``rows``.

    ``rows`` (written, for it is passed over often) has ``groups`` and ``rates``.
    """
    d = len(STATS)
    keys = [*groups, "start"]
    # a normal sample's tightest share has a smaller covariance, by this factor
    widen = share / chi2_cdf(chi2_quantile(share, d), d + 2)
    first = _robust_start(rows, groups, d).withColumn("start", F.lit(1))
    plain = _moments(rows, groups, d).withColumn("start", F.lit(2))
    est = written(_factored(first.unionByName(plain), keys, d, prior, 1.0), "estimates")
    for _ in range(steps):
        near = _distance(_matched(rows, est.drop("logdet"), groups), d)
        binned = near.withColumn("bin", F.floor(_BINS * F.log2(F.col("d2") + 1e-9)).cast("int"))
        counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("k"))
        group = Window.partitionBy(*keys)
        upto = counts.withColumn("upto", F.sum("k").over(group.orderBy("bin"))).withColumn(
            "n", F.sum("k").over(group)
        )
        # the lowest bins that hold the share of the group
        cuts = upto.filter(F.col("upto") - F.col("k") < F.ceil(share * F.col("n"))).groupBy(*keys).agg(
            F.max("bin").alias("cut")
        )
        within = _matched(binned.drop("d2"), written(cuts, "cuts"), keys).filter("bin <= cut")
        est = written(
            _factored(_moments(within, keys, d), keys, d, prior, widen), "estimates"
        )
    best = est.groupBy(*groups).agg(
        F.min_by(F.struct(*[c for c in est.columns if c not in groups]), F.struct("logdet", "start")).alias("e")
    )
    return best.select(*groups, "e.*").drop("start", "logdet")


def judge(
    docs: DataFrame, tail: float = 1e-9, share: float = 0.75, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """Every row of ``docs`` (as the struct ``row``) with its counts,
    ``base_failed``, ``distance`` (squared) and ``kept``.

    A document is kept if the fixed rules pass and its distance is below the
    chi-square quantile at ``1 - tail``. ``keep`` names the columns of ``docs`` that
    ``row`` is to have (all by default): rows are written once. NULL and empty texts fail the fixed
    rules; NULL languages and sources are groups of their own; a group of one
    document rejects nothing. Repeated rows are judged alike.
    """
    counted = with_rates(with_counts(docs))
    kept = [F.col(f"row.`{c}`").alias(c) for c in keep or ()]
    rows = written(
        counted.select(
            F.struct(*kept).alias("row") if keep else "row",
            F.col("row.lang").alias("lang"),
            F.col("row.source").alias("source"),
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "rates",
        ),
        "judged",
    )
    groups = ["lang", "source"]
    fit = rows.select(*groups, "rates")
    est = written(robust_estimates(fit, groups, share), "estimates")
    limit = chi2_quantile(1 - tail, len(STATS))
    return (
        _distance(_matched(rows, est, groups), len(STATS))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= limit))
        .withColumnRenamed("d2", "distance")
        .drop("rates", *groups)
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns."""
    return judge(docs).filter("kept").select("row.*")
