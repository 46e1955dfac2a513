"""Licence scan: template markup compiled to token automata.

Each template becomes an automaton over words. Optional regions are bypassed by
an empty move, replaceable ones are chains of any-word states with an exit at
each. A text has the licence where the automaton reaches its end, so mandatory
wording must match word for word. The state set is one integer, a bit a state.

Only places that can begin a match are tried: every template has one mandatory
word (its longest) which must occur, at a known distance range from the start.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.license_texts import PHRASES, TEMPLATES
from packetloom.llm.words import FOLDED, Words, text_chunks

_MARK = re.compile(r"<<(beginOptional|endOptional|var;(\d+),(\d+))>>")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

Node = tuple  # ("word", w) | ("any", low, high) | ("opt", [nodes])


def _fold(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def parse_template(text: str) -> list[Node]:
    """The regions of a template; optional regions may nest."""
    stack: list[list[Node]] = [[]]
    done = 0
    for mark in [*_MARK.finditer(text), None]:
        piece = text[done : mark.start() if mark else None]
        stack[-1] += [("word", w) for w in _WORD.findall(_fold(piece))]
        if mark is None:
            break
        done = mark.end()
        if mark[1] == "beginOptional":
            stack.append([])
        elif mark[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            if inner:
                stack[-1].append(("opt", inner))
        else:
            low, high = int(mark[2]), int(mark[3])
            if low > high:
                raise ValueError(f"empty range in {mark[0]}")
            stack[-1].append(("any", low, high))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    if not any(n[0] == "word" for n in stack[0]):
        raise ValueError("a template needs mandatory words")
    return stack[0]


class Automaton:
    """States 0..n in reading order; state n accepts."""

    def __init__(self, label: str, nodes: list[Node]):
        self.label = label
        self.words: dict[str, int] = {}
        self.any = 0
        self.jumps: list[tuple[int, int]] = []
        self.size = 0
        mandatory: list[tuple[str, int, int]] = []  # word, least and most words before it
        span = self._add(nodes, (0, 0), mandatory)
        self.mandatory = len(mandatory)
        self.longest = span[1]
        self.anchor, self.nearest, self.furthest = max(mandatory, key=lambda m: len(m[0]))

    def _add(self, nodes, span, mandatory, optional=False):
        low, high = span
        for node in nodes:
            if node[0] == "word":
                if not optional:
                    mandatory.append((node[1], low, high))
                self.words[node[1]] = self.words.get(node[1], 0) | 1 << self.size
                self.size += 1
                low, high = low + 1, high + 1
            elif node[0] == "any":
                _, least, most = node
                for k in range(most):
                    self.any |= 1 << self.size
                    if k >= least:
                        self.jumps.append((self.size, self.size + most - k))
                    self.size += 1
                low, high = low + least, high + most
            else:
                at = self.size
                _, high = self._add(node[1], (low, high), mandatory, True)
                self.jumps.append((at, self.size))
        return low, high

    def _closed(self, states: int) -> int:
        for source, target in self.jumps:  # sorted by source: jumps only lead forward
            if states >> source & 1:
                states |= 1 << target
        return states

    def compiled(self) -> Automaton:
        self.jumps.sort()
        self.begin = self._closed(1)
        return self

    def match(self, word_at, first: int, stop: int) -> bool:
        """Whether a match starts at word ``first``; words end before ``stop``."""
        states, accept = self.begin, 1 << self.size
        for i in range(first, min(stop, first + self.longest)):
            states = self._closed((states & (self.words.get(word_at(i), 0) | self.any)) << 1)
            if states & accept:
                return True
            if not states:
                return False
        return False


def compile_templates(templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[Automaton]:
    return [Automaton(label, parse_template(text)).compiled() for label, text in templates]


_FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, templates array<struct<label:string,word:long>>"
)


def _positions(texts, words: Words, word: str) -> np.ndarray:
    """Word numbers of the places where ``word`` stands."""
    raw = word.encode()
    at = np.array([m.start() for m in re.finditer(re.escape(raw), texts.data)], dtype=np.int64)
    if not len(at):
        return at
    index = np.minimum(np.searchsorted(words.starts, at), len(words) - 1)
    whole = (words.starts[index] == at) & (words.ends[index] == at + len(raw))
    return index[whole]


def _scan_texts(texts, automata: list[Automaton], phrases) -> list[tuple]:
    texts = texts.lower()
    words = Words(texts, FOLDED)
    rows = [([], []) for _ in range(len(texts))]  # base (word, label), template (label, word)

    def word_at(i: int) -> str:
        return texts.data[words.starts[i] : words.ends[i]].tobytes().decode()

    for phrase, label in phrases:
        parts = phrase.split(" ")
        for last in _positions(texts, words, parts[-1]).tolist():
            first = last - len(parts) + 1
            row = int(words.row_of(last))
            if first >= words.rows[row] and all(
                word_at(first + k) == p for k, p in enumerate(parts[:-1])
            ):
                rows[row][0].append((first - int(words.rows[row]), label))
    for automaton in automata:
        found: dict[int, set[int]] = {}
        for place in _positions(texts, words, automaton.anchor).tolist():
            row = int(words.row_of(place))
            low, stop = int(words.rows[row]), int(words.rows[row + 1])
            tried = found.setdefault(row, set())
            for first in range(
                max(low, place - automaton.furthest), place - automaton.nearest + 1
            ):
                if first not in tried:
                    tried.add(first)
                    if automaton.match(word_at, first, stop):
                        rows[row][1].append((automaton.label, first - low))
    weight = {a.label: a.mandatory / (a.mandatory + 2) for a in automata}
    out = []
    for n, (base, made) in zip(words.counts().tolist(), rows):
        base_labels = sorted({label for _, label in base})
        score = max(
            [0.0, *(weight[label] for label, _ in made), *([0.5] if base else [])]
        )
        places = [p for p, _ in base]
        out.append(
            (
                n,
                len(base),
                min(places, default=None),
                max(places, default=None),
                ",".join(base_labels),
                ",".join(sorted({*base_labels, *(label for label, _ in made)})),
                score,
                [{"label": a, "word": b} for a, b in sorted(made, key=lambda m: (m[1], m[0]))],
            )
        )
    return out


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
) -> DataFrame:
    """Every row of ``docs`` (as the struct ``row``) with its licences.

    Base phrases: ``n_base`` places, ``first_word`` and ``last_word`` (smallest
    and largest start, NULL without any) and ``base_labels``. ``templates``
    lists label and first word of every place where an automaton matches;
    ``labels`` are both kinds, distinct, sorted, comma-joined. ``score`` is the
    largest m / (m + 2) over the matched templates of m mandatory words, 0.5 for
    a base phrase, 0 for none. NULL and empty texts have no words and no labels.
    One pass, no shuffle; repeated rows give repeated results.
    """
    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    pairs, texts_of = list(templates), list(phrases)
    struct = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), struct]
    names = [part.split()[0] for part in _FOUND.split(", ")]

    def scan(batches):
        automata = compile_templates(pairs)
        for batch in batches:
            out = []
            for _, texts in text_chunks(batch.column(1)):
                out += _scan_texts(texts, automata, texts_of)
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["row", *names],
            )

    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(scan, f"row {kind}, {_FOUND}")
