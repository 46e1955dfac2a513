"""From raw flow rows to the fixed feature schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.alerts import iso_now
from packetloom.functions.values import clean_number, coerce_long, parse_double, sanitize
from packetloom.schemas import (
    COUNTERS,
    FEATURE_HEADERS,
    FEATURES,
    FLOW_SCHEMA,
    IDENTITY_ALIASES,
)


def settled(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that later steps find computed.

    A filter on a computed column is otherwise pushed below the computation
    and repeats it, which costs a second pass of a model, or of 30 checks, per
    row. The one-row generator keeps the two apart.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], made)


def strip_headers(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


class _Columns:
    """Input columns by exact (stripped) name.

    Raw headers hold dots and slashes and may differ only in case, so columns
    are addressed by position.
    """

    def __init__(self, df: DataFrame):
        self.names = [c.strip() for c in df.columns]
        self.types = [f.dataType for f in df.schema.fields]
        self.frame = df.toDF(*[f"_in{i}" for i in range(len(self.names))])
        self._at = {}
        for i, name in enumerate(self.names):
            self._at.setdefault(name, i)

    def __contains__(self, name: str) -> bool:
        return name in self._at

    def get(self, name: str) -> Column:
        return F.col(f"_in{self._at[name]}")

    def kind(self, name: str) -> T.DataType:
        return self.types[self._at[name]]

    def kept(self, keep: Sequence[str] | None) -> list[Column]:
        return [self.get(c).alias(c) for c in keep or () if c in self]

    def feature(self, name: str) -> Column | None:
        """Raw header first, then the canonical name."""
        for candidate in (FEATURE_HEADERS[name], name):
            if candidate in self:
                return self.get(candidate), self.kind(candidate)
        return None, None


def _parsed(value: Column | None, kind: T.DataType | None) -> Column:
    """A feature as a double that may still be NULL, NaN or infinite."""
    if value is None:
        return F.lit(0.0)
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return parse_double(value.cast("string"))
    return value.cast("double")


def clean_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL, NaN and infinite values of numeric columns become 0."""
    fields = df.schema.fields
    chosen = set(columns or [f.name for f in fields if isinstance(f.dataType, T.NumericType)])
    return df.select(
        *[
            _cleaned(f).alias(f.name) if f.name in chosen else F.col(f"`{f.name}`")
            for f in fields
        ]
    )


def _cleaned(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return clean_number(column)
    return F.coalesce(column, F.lit(0).cast(field.dataType))


def engineer_features(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Batch form: the 30 features as clean doubles, absent ones as 0.

    ``keep`` names input columns to carry along in front of the features.
    """
    cols = _Columns(df)
    kept = cols.kept(keep)
    parsed = [_parsed(*cols.feature(f)).alias(f) for f in FEATURES]
    names = [c for c in keep or () if c in cols]
    # in two steps, so that a number is parsed once and checked as a column
    return cols.frame.select(*kept, *parsed).select(
        *[F.col(f"`{c}`") for c in names], *[clean_number(F.col(f)).alias(f) for f in FEATURES]
    )


def first_present(cols, names: Sequence[str], default: Column | None) -> Column:
    """First of the named columns that is neither NULL nor empty."""
    found = [F.nullif(cols.get(n).cast("string"), F.lit("")) for n in names if n in cols]
    return F.coalesce(*found, *([] if default is None else [default]), F.lit(None).cast("string"))


def identity_columns(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The six identity fields, resolved from their aliases, as text."""
    cols = _Columns(df)
    return cols.frame.select(*cols.kept(keep), *[c.alias(n) for n, c in _identity(cols).items()])


def _identity(cols: _Columns) -> dict[str, Column]:
    out = {}
    for name, (aliases, default) in IDENTITY_ALIASES.items():
        fallback = iso_now() if default is None else F.lit(default)
        out[name] = first_present(cols, aliases, fallback)
    return out


def to_flows(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Record form, for streams and replays: all 36 fields of a flow.

    Text is read leniently, counters are cut to whole numbers, and missing
    identity fields get their defaults. Works on batch and streaming frames.
    """
    cols = _Columns(df)
    kept = cols.kept(keep)
    names = [c for c in keep or () if c in cols]
    identity = {
        n: coerce_long(c) if n.endswith("_port") else c for n, c in _identity(cols).items()
    }
    parsed = [_parsed(*cols.feature(f)).alias(f) for f in FEATURES]
    rows = cols.frame.select(*kept, *[c.alias(n) for n, c in identity.items()], *parsed)
    numbers = []
    for name in FEATURES:
        number = clean_number(F.col(name))
        if name in COUNTERS:
            number = F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))
        numbers.append(number.alias(name))
    return rows.select(*[F.col(f"`{c}`") for c in names], *identity, *numbers)


def flows_from_json(df: DataFrame, column: str) -> DataFrame:
    """Typed flow records from a JSON text column."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.from_json(column, FLOW_SCHEMA).alias("_flow")).select(*kept, "_flow.*")


def feature_array() -> Column:
    """The features of a row in model order."""
    return F.array(*[F.col(f).cast("double") for f in FEATURES])


def feature_map() -> Column:
    """The features of a row by name."""
    return F.map_from_arrays(F.array(*[F.lit(f) for f in FEATURES]), feature_array())


def parse_event_time(df: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """Add ``ts`` from the text field ``timestamp`` (NULL when unreadable)."""
    tries = [F.try_to_timestamp("timestamp")]
    tries += [F.try_to_timestamp("timestamp", F.lit(f)) for f in formats]
    return df.withColumn("ts", F.coalesce(*tries))


def sanitize_strings(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 1000) -> DataFrame:
    """Sanitise text columns; other columns stay as they are."""
    return df.select(
        *[
            sanitize(F.col(f"`{f.name}`"), limit).alias(f.name)
            if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail before any job runs when a column is missing."""
    missing = [n for n in names if n not in [c.strip() for c in df.columns]]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
