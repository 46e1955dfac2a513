"""Row checks of the feature schema."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.features import settled
from packetloom.schemas import COUNTERS, FEATURES, NON_NEGATIVE

_INF = float("inf")
VIOLATIONS = "array<struct<feature:string,reason:string>>"


def violations(nonneg: Iterable[str] = NON_NEGATIVE, whole: Iterable[str] = ()) -> Column:
    """The broken rules of a row: array of (feature, reason)."""
    nonneg, whole = set(nonneg), set(whole)
    found = []
    for name in FEATURES:
        value = F.col(name).cast("double")
        reason = F.when(value.isNull(), "null").when(F.isnan(value), "nan")
        reason = reason.when(F.abs(value) == _INF, "inf")
        if name in nonneg:
            reason = reason.when(value < 0, "negative")
        if name in whole:
            reason = reason.when(value != F.floor(value), "not_integer")
        found.append(F.struct(F.lit(name).alias("feature"), reason.alias("reason")))
    return F.filter(F.array(*found), lambda v: v["reason"].isNotNull())


def is_clean(nonneg: Iterable[str] = NON_NEGATIVE, whole: Iterable[str] = ()) -> Column:
    """True when a row breaks no rule; cheaper than listing the broken ones."""
    rules = []
    for name in FEATURES:
        value = F.col(name).cast("double")
        # NaN sorts above infinity
        rule = (value if name in nonneg else F.abs(value)) < _INF
        if name in nonneg:
            rule = rule & (value >= 0)
        if name in whole:
            rule = rule & (value == F.floor(value))
        rules.append(rule)
    return F.coalesce(reduce(Column.__and__, rules), F.lit(False))


def check_schema(df: DataFrame) -> None:
    """All 30 features present and numeric, else ValueError."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    missing = [f for f in FEATURES if f not in kinds]
    if missing:
        raise ValueError(f"expected {len(FEATURES)} features, missing: {', '.join(missing)}")
    wrong = [f for f in FEATURES if not isinstance(kinds[f], T.NumericType)]
    if wrong:
        raise ValueError(f"features must be numeric: {', '.join(wrong)}")


def validate_features(
    df: DataFrame,
    mode: str = "flag",
    nonneg: Iterable[str] = NON_NEGATIVE,
    whole: Iterable[str] = (),
) -> DataFrame:
    """Check every row.

    ``flag`` adds the column ``violations``; ``valid`` keeps the clean rows;
    ``quarantine`` keeps the broken ones with their violations; ``fail`` stops
    the job at the first broken row.
    """
    check_schema(df)
    nonneg, whole = set(nonneg), set(whole)
    # the checks read each feature several times
    ready = settled(df, {f: F.col(f) for f in FEATURES}).select(*df.columns)
    clean = is_clean(nonneg, whole)
    if mode == "valid":
        return ready.filter(clean)
    broken = violations(nonneg, whole)
    if mode == "flag":
        none = F.array().cast(VIOLATIONS)
        return ready.withColumn("violations", F.when(clean, none).otherwise(broken))
    if mode == "quarantine":
        return ready.filter(~clean).withColumn("violations", broken)
    if mode == "fail":
        text = F.concat(F.lit("invalid features: "), F.to_json(broken))
        return ready.filter(
            F.when(clean, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
        )
    raise ValueError(f"unknown mode: {mode}")


def validate_requests(df: DataFrame, mode: str = "flag") -> DataFrame:
    """The stricter boundary check: nothing negative, counters whole."""
    return validate_features(df, mode, nonneg=FEATURES, whole=COUNTERS)
