"""Personal data: patterns propose, checksums confirm, context adjusts the score.

Base kinds are e-mail, ip, card (Luhn) and phone. The method adds bank account
numbers (IBAN form, confirmed by the remainder modulo 97) and national ids of
the form 3-2-4 digits, which have no checksum: they count only when a word that
names them stands nearby. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns (those without a checksum are bounded by it).
# A possessive quantifier keeps the match and spares the search for others.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id")

# Words that make a kind likelier, and the score without them.
CONTEXT = {
    "email": (0.9, ("mail", "email", "contact", "write")),
    "ip": (0.6, ("ip", "host", "server", "address", "login")),
    "card": (0.7, ("card", "credit", "debit", "visa", "payment", "number")),
    "phone": (0.7, ("phone", "tel", "telephone", "call", "mobile", "fax")),
    "iban": (0.8, ("iban", "account", "bank", "konto", "cuenta", "compte")),
    "national_id": (0.2, ("ssn", "social", "security", "national", "passport")),
}
_BONUS = 0.3
_CONFIRMED = 0.5
_NEARBY = 40  # code points looked at before and after a span
_WORD = re.compile(r"[A-Za-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        # leftmost: all local characters before the sign, after the last match
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            yield first, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _proposed(text: str):
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(_small(p) for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield "iban", m.start(), m.end()
    for m in _NATIONAL.finditer(text):
        yield "national_id", m.start(), m.end()


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of a text with their scores, by kind, then start."""
    if not text:
        return []
    out = []
    for kind, a, b in _proposed(text):
        score, words = CONTEXT[kind]
        near = text[max(0, a - _NEARBY) : a] + " " + text[b : b + _NEARBY]
        if not {w.lower() for w in _WORD.findall(near)}.isdisjoint(words):
            score = min(1.0, score + _BONUS)
        if kind in BASE_KINDS or score >= _CONFIRMED:
            out.append((kind, a, b, round(score, 6)))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def with_pii(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (as the struct ``row``) with ``spans``: kind, start,
    stop and score, by kind in the order of ``KINDS``, then start.

    Spans of one kind never overlap; spans of different kinds may. NULL and
    empty texts have none. One pass, no shuffle; repeated rows give repeated
    results.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("t"))
    kind = rows.schema["row"].dataType.simpleString()
    names = ("kind", "start", "stop", "score")
    types = (pa.string(), pa.int64(), pa.int64(), pa.float64())
    item = pa.struct(list(zip(names, types)))

    def scan(batches):
        for batch in batches:
            found = [[dict(zip(names, s)) for s in find_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(item))], ["row", "spans"]
            )

    out = "array<struct<kind:string,start:long,stop:long,score:double>>"
    return rows.mapInArrow(scan, f"row {kind}, spans {out}")


def redact(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents with each span of score ``least`` or more replaced by its
    kind in angle brackets; overlapping spans become one, named by the first."""
    found = with_pii(docs)
    names = docs.columns
    kept = F.array_sort(
        F.transform(
            F.filter("spans", lambda s: s["score"] >= least),
            lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b"), s["kind"].alias("k")),
        )
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))
    text = F.col("row.text")

    def step(state, s):
        piece = F.substring(text, state["done"] + 1, s["a"] - state["done"])
        return F.when(s["a"] < state["done"], F.struct(
            state["out"].alias("out"), F.greatest(state["done"], s["b"]).alias("done")
        )).otherwise(F.struct(
            F.concat(state["out"], piece, F.lit("<"), s["k"], F.lit(">")).alias("out"),
            s["b"].alias("done"),
        ))

    cut = F.aggregate(kept, start, step)
    rest = F.concat(cut["out"], F.substring(text, cut["done"] + 1, F.length(text)))
    return found.select(
        *[rest if c == "text" else F.col(f"row.`{c}`") for c in names]
    ).toDF(*names)
