"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own counts and those of the
lines beside it; neighbouring labels are linked by transition weights. Marginals
from the forward and backward pass, weighted by line length, are averaged to a
document's score.

The model is fitted on a bounded sample of labelled documents (``max_documents``,
and only those of at most ``max_lines`` lines); every line of such a document
carries the document's label. Scoring runs in the tasks, over whole texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.words import SPACED, Texts, Words, text_chunks

THRESHOLD = 0.3
FOLDS = 5
_WINDOW = 3
_NEWLINE = 10


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


# The byte classes whose shares of a line are features.
_CLASSES = {
    "symbol": _members(b"#*$%&|<>"),
    "upper": _members(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "exclaim": _members(b"!?"),
    "pipe": _members(b"|"),
    "digit": _members(b"0123456789"),
    "other": np.arange(256) >= 128,
    "comma": _members(b",;:"),
}
OWN = (*_CLASSES, "length", "words", "word_length", "repeated_line", "repeated_words", "closed")


@dataclass
class Lines:
    """Lines of consecutive rows; every row has at least one."""

    features: np.ndarray  # lines x OWN
    lengths: np.ndarray  # bytes of each line
    rows: np.ndarray  # first line of each row, and the number of lines


def line_features(texts: Texts) -> Lines:
    """Features of all lines that hold a word; a row without any has one line
    of zeros."""
    data, bounds = texts.data, texts.bounds
    size = len(data)
    words = Words(texts, SPACED)
    breaks = np.flatnonzero(data == _NEWLINE)
    filled = np.flatnonzero(bounds[:-1] < bounds[1:])
    starts = np.unique(np.concatenate([bounds[:-1][filled], breaks + 1]))
    starts = starts[starts < size]
    row = np.searchsorted(bounds, starts, side="right") - 1
    following = np.append(starts[1:], size)
    ends = np.minimum(following, bounds[row + 1])
    first, last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    kept = last > first
    starts, ends, row, first, last = starts[kept], ends[kept], row[kept], first[kept], last[kept]
    n = len(starts)
    length = (ends - starts).astype(np.float64)
    out = np.zeros((n, len(OWN)))

    def per_line(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])
        return (sums[ends] - sums[starts]).astype(np.float64)

    for k, members in enumerate(_CLASSES.values()):
        out[:, k] = np.sqrt(per_line(members[data]) / np.maximum(length, 1))
    n_words = (last - first).astype(np.float64)
    bare = per_line(SPACED[data])
    at = len(_CLASSES)
    out[:, at] = np.log1p(length) / 4
    out[:, at + 1] = np.log1p(n_words) / 4
    out[:, at + 2] = np.log(np.maximum(bare, 1) / np.maximum(n_words, 1)) / 2
    if n:
        out[:, at + 3] = _repeated_lines(words, first, last, row)
        out[:, at + 4] = _repeated_words(words, first, last)
        closing = data[words.ends[last - 1] - 1]
        out[:, at + 5] = np.isin(closing, np.frombuffer(b".!?", np.uint8))
    # rows without a line get one of zeros
    bare_rows = np.setdiff1d(np.arange(len(texts)), row)
    place = np.searchsorted(row, bare_rows)
    out = np.insert(out, place, 0.0, axis=0)
    length = np.insert(length, place, 0.0)
    row = np.insert(row, place, bare_rows)
    limits = np.searchsorted(row, np.arange(len(texts) + 1))
    return Lines(out, length, limits)


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def _of_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (hashes + row.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) ^ row.astype(np.uint64)


def _repeated_lines(words: Words, first, last, row) -> np.ndarray:
    each = words.hashes()
    powers = np.cumprod(np.full(len(each), 0x9E3779B97F4A7C15, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * powers)])
    down = np.cumprod(np.full(len(each), pow(0x9E3779B97F4A7C15, -1, 2**64), dtype=np.uint64))
    return _seen_before(_of_row((sums[last] - sums[first]) * down[first], row)).astype(np.float64)


def _repeated_words(words: Words, first, last) -> np.ndarray:
    """Share of a line's word windows that stand earlier in the same text."""
    windows = words.window_hashes(words.hashes(), _WINDOW)
    if not len(windows):
        return np.zeros(len(first))
    begin = np.arange(len(windows))
    row = words.row_of(begin)
    whole = row == words.row_of(begin + _WINDOW - 1)
    again = _seen_before(_of_row(windows, row)) & whole
    sums = np.concatenate([[0], np.cumsum(again)])
    a, b = np.minimum(first, len(windows)), np.minimum(last, len(windows))
    return np.sqrt((sums[b] - sums[a]) / np.maximum(b - a, 1))


def with_neighbours(lines: Lines) -> np.ndarray:
    """Own features, those of the lines before and after, and whether they exist."""
    own = lines.features
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[lines.rows[:-1]] = True
    tail[lines.rows[1:] - 1] = True
    before[head], after[tail] = 0.0, 0.0
    return np.column_stack([own, before, after, ~head, ~tail, np.ones(n)])


# --- the chain --------------------------------------------------------------


class Chains:
    """Sequences of different length, stepped through side by side."""

    def __init__(self, limits: np.ndarray):
        sizes = np.diff(limits)
        order = np.argsort(-sizes, kind="stable")
        self.first, self.sizes = limits[:-1][order], sizes[order]
        self.active = [
            int(np.searchsorted(-self.sizes, -t, side="left")) for t in range(int(self.sizes[0]))
        ]

    def marginals(self, unary: np.ndarray, link: np.ndarray):
        """P(good) of every line, the log partition functions, and the expected
        number of each transition."""
        n = len(unary)
        score = np.column_stack([np.zeros(n), unary])
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        for t, k in enumerate(self.active):
            at = self.first[:k] + t
            if t == 0:
                alpha[at] = score[at]
                continue
            step = alpha[at - 1][:, :, None] + link[None]
            alpha[at] = np.logaddexp(step[:, 0], step[:, 1]) + score[at]
        for t in range(len(self.active) - 2, -1, -1):
            at = self.first[: self.active[t + 1]] + t
            step = link[None] + (score[at + 1] + beta[at + 1])[:, None, :]
            beta[at] = np.logaddexp(step[:, :, 0], step[:, :, 1])
        ends = self.first + self.sizes - 1
        total = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
        z = np.empty(n)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        where = np.repeat(self.first - np.cumsum(self.sizes) + self.sizes, self.sizes) + np.arange(n)
        z[where] = total[owner]
        both = alpha + beta - z[:, None]
        head = np.zeros(n, bool)
        head[self.first] = True
        later = np.flatnonzero(~head)
        pair = (
            alpha[later - 1][:, :, None]
            + link[None]
            + (score[later] + beta[later])[:, None, :]
            - z[later][:, None, None]
        )
        return np.exp(np.minimum(both[:, 1], 0.0)), total, np.exp(pair).sum(axis=0)


@dataclass
class LineModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    link: np.ndarray

    def line_scores(self, lines: Lines) -> np.ndarray:
        x = (with_neighbours(lines) - self.mean) / self.scale
        good, _, _ = Chains(lines.rows).marginals(x @ self.weights, self.link)
        return good

    def document_scores(self, lines: Lines) -> np.ndarray:
        """Mean of the lines' P(good), weighted by length; of a document
        without text, that of its one empty line."""
        good = self.line_scores(lines)
        weight = np.maximum(lines.lengths, 1.0)
        total = np.add.reduceat(good * weight, lines.rows[:-1])
        return np.clip(total / np.add.reduceat(weight, lines.rows[:-1]), 0.0, 1.0)


def fit_lines(
    lines: Lines, labels: np.ndarray, rounds: int = 120, rate: float = 0.05, ridge: float = 1e-3
) -> LineModel:
    """Maximum likelihood (with a ridge) by adaptive gradient steps; documents
    count alike, whatever their length."""
    x = with_neighbours(lines)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0.0, 1.0
    x = (x - mean) / scale
    chains, sizes = Chains(lines.rows), np.diff(lines.rows)
    y = np.repeat(labels, sizes).astype(np.float64)
    n = len(y)
    head = np.zeros(n, bool)
    head[lines.rows[:-1]] = True
    later = np.flatnonzero(~head)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[later - 1].astype(int), y[later].astype(int)), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        good, _, moved = chains.marginals(x @ theta[:-4], theta[-4:].reshape(2, 2))
        slope = np.concatenate([x.T @ (y - good), (seen - moved).ravel()]) / n
        slope -= ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineModel(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


# --- Spark ------------------------------------------------------------------


def fold_of(doc_id):
    """crc32 of the id as text, modulo ``FOLDS``; fold 0 is never fitted."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_documents: int = 3_000,
    max_lines: int = 2_000,
    seed: int = 42,
) -> LineModel:
    """Fit on at most ``max_documents`` labelled documents outside fold 0, chosen
    by a hash of the id. Labels that are NULL are skipped. Raises ``ValueError``
    when no labelled document is left."""
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .filter("quality in (0, 1)")
        .filter(fold_of(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(max_documents)
    )
    # at most max_documents rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )

    def lines_of(batches):
        for batch in batches:
            out = {"doc_id": [], "quality": [], "lines": [], "lengths": []}
            at = 0
            for row, texts in text_chunks(batch.column(1)):
                found = line_features(texts)
                for i in range(len(texts)):
                    a, b = found.rows[i], found.rows[i + 1]
                    at = row + i
                    if b - a <= max_lines:
                        out["doc_id"].append(batch.column(0)[at].as_py())
                        out["quality"].append(batch.column(2)[at].as_py())
                        out["lines"].append(found.features[a:b].astype("<f4").tobytes())
                        out["lengths"].append(found.lengths[a:b].astype("<f4").tobytes())
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out.values(), kinds)], list(out)
            )

    schema = "doc_id long, quality int, lines binary, lengths binary"
    sample = rows.select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(lines_of, schema)
    found = sorted(map(tuple, sample.collect()), key=lambda r: (r[0], bytes(r[2])))[:max_documents]
    if not found:
        raise ValueError("no labelled document to learn from")
    parts = [np.frombuffer(r[2], "<f4").reshape(-1, len(OWN)) for r in found]
    limits = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    lengths = np.concatenate([np.frombuffer(r[3], "<f4") for r in found])
    lines = Lines(np.concatenate(parts).astype(np.float64), lengths.astype(np.float64), limits)
    return fit_lines(lines, np.array([r[1] for r in found]))


def score(docs: DataFrame, model: LineModel) -> DataFrame:
    """Every row of ``docs`` (as the struct ``row``) with ``score``, 0 to 1.

    NULL, empty and blank texts count as one empty line. Repeated rows get
    equal scores. One pass, no shuffle.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("t"))
    kind = rows.schema["row"].dataType.simpleString()
    # plain arrays: executors need not know the class by name
    plain = (model.mean, model.scale, model.weights, model.link)
    spread = docs.sparkSession.sparkContext.broadcast(plain)

    def scan(batches):
        fitted = LineModel(*spread.value)
        for batch in batches:
            found = [fitted.document_scores(line_features(t)) for _, t in text_chunks(batch.column(1))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["row", "score"])

    return rows.mapInArrow(scan, f"row {kind}, score double")


def held_out(doc_id: int | None) -> bool:
    """Plain version of ``fold_of(...) == 0``."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == 0
