"""Kneser-Ney language models of characters, counted by Spark and kept in sorted hash arrays.

A model knows some classes (languages). For each order it has the union of the classes' n-grams
as a sorted array of 64-bit hashes, and for each a row of probabilities, one for each class, so
that one lookup answers for all of them. What the classes share is one directory by leading bits.

Counting covers every document and is exact: no two n-grams share a count. Tasks count what they
read, Spark adds up by class and n-gram, and a task holds a bounded number of counts. The model grows
with the distinct n-grams of the corpus; the driver gathers all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import U64, buffers, chunks, mix
from tidemark.session import arrow_map

#: Rows of new counts at which a task merges them, and distinct n-grams at which it sends what it has.
HELD, FLUSH = 250_000, 1_000_000
BLANK = 32
_M = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_FOLD: dict[str, np.ndarray] = {}


def _fold_table(letters_only: bool) -> np.ndarray:
    """Lower-cased code points of the basic plane; white space, and with letters_only all but letters, as a blank."""
    name = str(letters_only)
    if name not in _FOLD:
        table = np.arange(0x10000, dtype=np.uint32)
        for c in range(0x10000):
            ch = chr(c)
            low = ch.lower()
            if ch.isspace() or c < 32 or letters_only and not ch.isalpha():
                table[c] = BLANK
            elif len(low) == 1:
                table[c] = ord(low)
        _FOLD[name] = table
    return _FOLD[name]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of whole documents, and their offsets. Broken UTF-8 counts as U+FFFD."""
    data = raw.tobytes()
    try:
        text = data.decode()
    except UnicodeDecodeError:
        parts = [data[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), lead[offsets]


def folded(raw: np.ndarray, offsets: np.ndarray, pad: int, letters_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters with ``pad`` blanks before each document; where the own characters are; their documents.

    Runs of blanks count as one, and none stands at a document's start.
    """
    points, at = code_points(raw, offsets)
    table = _fold_table(letters_only)
    if len(points) and points.max() > 0xFFFF:
        low = np.where(points > 0xFFFF, BLANK, points)
        out = table[low]
        high = points > 0xFFFF
        kinds = np.unique(points[high])
        keep = kinds[[not letters_only or chr(c).isalpha() for c in kinds]]
        out[high] = np.where(np.isin(points[high], keep), points[high], BLANK)
    else:
        out = table[points]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    blank = out == BLANK
    first = np.zeros(len(out) + 1, bool)
    first[at] = True
    keep = ~blank
    if len(out):
        keep[1:] |= ~blank[:-1] & ~first[1:-1]
    out, doc = out[keep], doc[keep]
    place = np.arange(len(out)) + (doc + 1) * pad
    line = np.full(len(out) + (len(at) - 1) * pad, BLANK, np.uint32)
    line[place] = out
    return line, place, doc


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams, given their characters from first to last."""
    with np.errstate(over="ignore"):
        h = np.full(len(columns[0]) if columns else 1, U64(len(columns)), U64)
        for k, c in enumerate(columns):
            h = h + (c.astype(U64) + U64(1)) * _M[len(columns) - 1 - k]
        return mix(h)


def letters_in(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    raw, offsets = buffers(column)
    out = np.zeros(len(column), bool)
    for i, j, part, at in chunks(raw, offsets):
        line, place, doc = folded(part, at, 0, True)
        out[i + doc[line[place] != BLANK]] = True
    return out


class _Tally:
    """Exact counts of packed n-grams, as parts that are merged whenever they have HELD new rows."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.new = 0

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(_summed(*part))
        self.new += len(self.parts[-1][0])
        if self.new > HELD:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [_summed(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))]
        self.new = 0

    def full(self) -> bool:
        return bool(self.parts) and len(self.parts[0][0]) > FLUSH

    def out(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for _, n, a, b in self.parts:
            for k in range(0, len(n), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (n, a, b)], ["n", "a", "b"])
        self.parts, self.new = [], 0


def _summed(h: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of equal (a, b) as one with the sum of n, in order of their hash. Two n-grams of one hash are never one row."""
    order = np.argsort(h)
    h, n, a, b = h[order], n[order], a[order], b[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(h)])
    return h[first], np.add.reduceat(n, first) if len(first) else n, a[first], b[first]


def count(docs: DataFrame, order: int, classes: list[str], *, letters_only: bool) -> DataFrame:
    """(count, class and n-gram as two longs) of each distinct n-gram of a class, over all rows of (text, label).

    A task sends each n-gram once, or again whenever it holds over ``FLUSH`` of them.
    """
    number = {c: i for i, c in enumerate(classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            label = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            raw, offsets = buffers(batch.column(0))
            for i, _, part, at in chunks(raw, offsets):
                line, place, doc = folded(part, at, order - 1, letters_only)
                who = label[i + doc]
                place, who = place[who >= 0], who[who >= 0]
                cols = [line[place - order + 1 + k] for k in range(order)]
                with np.errstate(over="ignore"):
                    h = mix(gram_hash(cols) + who.astype(U64) * U64(0x9E3779B97F4A7C15))
                tally.add(h, np.ones(len(h), np.int64), *_packed(cols, who))
                if tally.full():
                    yield from tally.out()
        yield from tally.out()

    got = arrow_map(docs.select(F.col("text").cast("string"), F.col("label").cast("string")), run, "n long, a long, b long")
    return got.groupBy("a", "b").agg(F.sum("n").alias("n")).select("n", "a", "b")


def _packed(cols: list[np.ndarray], who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to five characters of 21 bits in two longs, the class in the upper bits of the second."""
    wide = [np.zeros(len(who), np.int64)] * (5 - len(cols)) + [c.astype(np.int64) for c in cols]
    return wide[0] << 42 | wide[1] << 21 | wide[2], who << 42 | wide[3] << 21 | wide[4]


def _unpacked(a: np.ndarray, b: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    low = (1 << 21) - 1
    wide = [a >> 42, a >> 21 & low, a & low, b >> 21 & low, b & low]
    return wide[5 - order :], b >> 42


@dataclass
class HashArray:
    """Rows of values by sorted 64-bit key, found through a directory of leading bits."""

    keys: np.ndarray
    values: np.ndarray
    shift: int = 0
    directory: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int32))

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> HashArray:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], np.ascontiguousarray(values[order])
        bits = max(1, int(len(keys)).bit_length() + 1)
        edges = np.arange(1 << bits, dtype=U64) << U64(64 - bits)
        return cls(keys, values, 64 - bits, np.r_[np.searchsorted(keys, edges), len(keys)].astype(np.int32))

    def find(self, key: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        bucket = (key >> U64(self.shift)).astype(np.int64)
        at, end = self.directory[bucket], self.directory[bucket + 1]
        out = np.full(len(key), -1, np.int32)
        if not len(self.keys):
            return out
        here = np.minimum(at, len(self.keys) - 1)
        hit = (at < end) & (self.keys[here] == key)
        out[hit] = at[hit]
        rest = np.flatnonzero(~hit & (at + 1 < end))
        step = 1
        while len(rest):
            p = at[rest] + step
            good = self.keys[p] == key[rest]
            out[rest[good]] = p[good]
            step += 1
            rest = rest[~good & (p + 1 < end[rest])]
        return out


@dataclass
class CharModel:
    """log2 probabilities of each order and log2 back-off weights of each context, by class."""

    classes: list[str]
    order: int
    letters_only: bool
    grams: list[HashArray]
    contexts: list[HashArray]
    floor: np.ndarray

    def log2(self, cols: list[np.ndarray]) -> np.ndarray:
        """Rows of log2 p(last | before) for each class."""
        n = len(cols)
        if not n:
            return np.broadcast_to(self.floor, (1, len(self.classes)))
        at = self.grams[n - 1].find(gram_hash(cols))
        out = self.grams[n - 1].values[np.maximum(at, 0)] if len(self.grams[n - 1].keys) else np.zeros((len(at), len(self.classes)), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            part = [c[miss] for c in cols]
            if n == 1:
                out[miss] = self.floor
            else:
                lower = self.log2(part[1:])
                ctx = self.contexts[n - 1].find(gram_hash(part[:-1]))
                weight = np.zeros_like(lower)
                weight[ctx >= 0] = self.contexts[n - 1].values[ctx[ctx >= 0]]
                out[miss] = lower + weight
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters of each text, and sums of -log2 p and of its square for each class, over the whole text."""
        raw, offsets = buffers(column)
        size = np.zeros(len(column), np.int64)
        bits = np.zeros((len(column), len(self.classes)))
        square = np.zeros_like(bits)
        for i, j, part, at in chunks(raw, offsets):
            line, place, doc = folded(part, at, self.order - 1, self.letters_only)
            if not len(place):
                continue
            p = -self.log2([line[place - self.order + 1 + k] for k in range(self.order)])
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            who = i + doc[first]
            size[who] = np.diff(np.r_[first, len(doc)])
            bits[who] = np.add.reduceat(p, first, axis=0, dtype=np.float64)
            square[who] = np.add.reduceat(p * p, first, axis=0, dtype=np.float64)
        return size, bits, square

    def score_words(self, column: pa.Array, own: np.ndarray, others: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and its -log2 p by words: each by the class ``own``, or by one of ``others`` (a flag for each class) for ``switch`` bits."""
        raw, offsets = buffers(column)
        size, bits = np.zeros(len(column), np.int64), np.zeros(len(column))
        for i, _, part, at in chunks(raw, offsets):
            line, place, doc = folded(part, at, self.order - 1, self.letters_only)
            if not len(place):
                continue
            p = -self.log2([line[place - self.order + 1 + k] for k in range(self.order)])
            new = np.r_[True, doc[1:] != doc[:-1]]
            size[i + doc[new]] = np.diff(np.r_[np.flatnonzero(new), len(doc)])
            word = np.flatnonzero(new | np.r_[False, line[place][:-1] == BLANK])
            each, who = np.add.reduceat(p, word, axis=0, dtype=np.float64), i + doc[word]
            best = np.where(others[who], each + switch, np.inf).min(axis=1, initial=np.inf)
            best = np.minimum(best, np.where(own[who] >= 0, each[np.arange(len(who)), np.maximum(own[who], 0)], np.inf))
            bits += np.bincount(who, weights=best, minlength=len(bits))
        return size, bits


def _discounts(c: np.ndarray, modified: bool) -> np.ndarray:
    """The discount of a count of 1, 2 and 3 or more."""
    n = [max(1, int((c == k).sum())) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    if not modified:
        return np.array([0, y, y, y])
    return np.clip([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])


def build(counted: DataFrame, order: int, classes: list[str], *, letters_only: bool, modified: bool) -> CharModel:
    """The interpolated model of counted n-grams, which the driver gathers."""
    table = counted.toArrow()
    n, a, b = (table.column(k).to_numpy().astype(np.int64) for k in range(3))
    cols, who = _unpacked(a, b, order)
    L = len(classes)
    levels = []  # from the highest order down: characters, class, count
    for k in range(order, 0, -1):
        levels.append((cols, who, n))
        if k > 1:
            h = gram_hash([*cols[1:], who])
            _, first, n = np.unique(h, return_index=True, return_counts=True)
            cols, who = [c[first] for c in cols[1:]], who[first]
    seen = len(np.unique(levels[-1][0][0])) if len(who) else 0
    floor = np.full(L, 1 / (seen + 1), np.float64)
    grams, contexts = [], []
    below_keys, below = None, None
    for k, (cols, who, n) in enumerate(levels[::-1], 1):
        keys, first, row = np.unique(gram_hash(cols), return_index=True, return_inverse=True)
        ctx_keys, ctx = np.unique(gram_hash(cols[:-1]) if k > 1 else np.zeros(len(who), U64), return_inverse=True)
        total, weight, part = np.zeros((len(ctx_keys), L)), np.zeros((len(ctx_keys), L)), np.zeros((len(keys), L))
        discount = np.zeros(len(n))
        for c in range(L):
            own = who == c
            discount[own] = _discounts(n[own], modified)[np.minimum(n[own], 3)]
        np.add.at(total, (ctx, who), n)
        np.add.at(weight, (ctx, who), discount)
        part[row, who] = (n - discount) / total[ctx, who]
        gamma = np.where(total > 0, weight / np.maximum(total, 1), 1.0)
        of_key = ctx[first]
        if k == 1:
            lower = np.broadcast_to(floor, (len(keys), L))
        else:
            lower = below[np.searchsorted(below_keys, gram_hash([c[first] for c in cols[1:]]))]
        p = part + gamma[of_key] * lower
        grams.append(HashArray.of(keys, np.log2(p).astype(np.float32)))
        contexts.append(HashArray.of(ctx_keys, np.log2(gamma).astype(np.float32)))
        if k == 1:
            floor = floor * (gamma[0] if len(gamma) else 1)
        below_keys, below = keys, p
    return CharModel(classes, order, letters_only, grams, contexts, np.log2(floor).astype(np.float32))
