"""The label vocabulary as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.values import strip
from packetloom.schemas import LABELS, NORMAL


def map_labels(raw: Column, unknown: str = "Data Exfiltration") -> Column:
    """Category of a raw label. The first rule that matches decides."""
    exact = strip(raw)
    text = F.lower(exact)
    return (
        F.when((exact == NORMAL) | (text == "benign"), NORMAL)
        .when(text.startswith("dos") | text.isin("ddos", "heartbleed"), "DoS")
        .when(text.isin("portscan", "port scan"), "Port Scan")
        .when(text.contains("patator") | text.contains("brute force"), "Brute Force")
        .when(
            text.startswith("web attack")
            | text.isin("infiltration", "bot")
            | text.contains("sql injection")
            | text.contains("xss"),
            "Data Exfiltration",
        )
        .otherwise(unknown)
    )


def _literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(item) for item in chain.from_iterable(pairs)])


def encode_label(category: Column) -> Column:
    """Fixed id of a category; 0 when it is none of the vocabulary."""
    ids = _literal_map((name, i) for i, name in enumerate(LABELS))
    return F.coalesce(F.try_element_at(ids, category), F.lit(0))


def decode_label(label_id: Column, prefix: str = "") -> Column:
    """Category of an id; an unknown id becomes its own text."""
    names = _literal_map(enumerate(LABELS))
    return F.coalesce(
        F.try_element_at(names, label_id.cast("int")),
        F.concat(F.lit(prefix), label_id.cast("string")),
    )


def is_attack(category: Column) -> Column:
    return category != NORMAL
