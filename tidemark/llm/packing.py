"""Bounded-space online packing of tokenised documents into fixed-length sequences.

Each task reads its rows once and keeps ``open_windows`` unfinished sequences. A document's
full stretches of ``length`` ids become sequences of their own; its remainder goes to the open
window that it fits best. When it fits none and no further window may be opened, the fullest
window is emitted: a gap of ``min_piece`` ids or more is first filled from the remainder, a
smaller one is padding. At the end of the task the leftover windows are merged: the emptiest
are cut to fill the fullest, and the one that stays unfilled is cut at powers of two, which
need no padding. Nothing is shuffled and nothing but the open windows is held.

Defined cases: a null text is empty, and an empty document is its end mark alone; where a text spells
out an added token, such as an end mark, it has that token's id, as the tokenizer gives it; repeated
rows are packed once for each row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import arrow_map

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

#: Words whose ids a worker remembers before it starts anew.
CACHE_WORDS = 250_000


def _latin(kind: str) -> str:
    return "".join(chr(c) for c in range(0x21, 0x250) if unicodedata.category(chr(c))[0] == kind)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + other.index(b)) for b in range(256)]


class WordTokens(dict):
    """Ids of texts under the lower-casing word BPE, looked up word by word; maps a word to its ids' bytes.

    The vocabulary splits a text into letters, single digits and other runs before any merge, so
    ids of a text are those of its pieces joined. The split is done here for texts within Latin
    blocks; any other text, and one that spells out an added token, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        letters, digits = re.escape(_latin("L")), re.escape(_latin("N"))
        self.pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\t\n\r {letters}{digits}]+").findall
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.foreign = re.compile("|".join(["[^\t\n\r\x20-\x7e\u00a1-\u024f]", *added]), re.IGNORECASE).search
        self.letters = dict(enumerate(_byte_letters()))

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = self[word] = np.array([t.id for t in self.merge(text)], "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if self.foreign(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, self.pieces(text.lower())))


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each worker process, which serves many tasks."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


class _Window:
    __slots__ = ("fill", "pieces")

    def __init__(self) -> None:
        self.fill, self.pieces = 0, []

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc, start, ids, total))
        self.fill += len(ids) // 4


class OnlinePacker:
    """The windows of one task. ``emit(pieces)`` gets each finished sequence."""

    def __init__(self, length: int, open_windows: int, min_piece: int, emit: Callable[[list], None]):
        self.length, self.most, self.min_piece, self.emit = length, open_windows, min_piece, emit
        self.open: list[tuple[int, int, _Window]] = []  # by gap, then age
        self.made = 0

    def _put(self, window: _Window) -> None:
        if window.fill == self.length:
            self.emit(window.pieces)
        else:
            self.made += 1
            insort(self.open, (self.length - window.fill, self.made, window), key=lambda x: x[:2])

    def add(self, doc: int | None, ids: bytes) -> None:
        total, width = len(ids) // 4, 4 * self.length
        at = 0
        while len(ids) - at >= width:
            self.emit([(doc, at // 4, ids[at : at + width], total)])
            at += width
        while at < len(ids):
            need = (len(ids) - at) // 4
            best = bisect_left(self.open, need, key=lambda x: x[0])
            if best < len(self.open):
                window, take = self.open.pop(best)[2], need
            elif len(self.open) < self.most:
                window, take = _Window(), need
            else:
                gap, _, window = self.open.pop(0)
                if gap < self.min_piece:
                    self.emit(window.pieces)
                    continue
                take = gap
            window.add(doc, at // 4, ids[at : at + 4 * take], total)
            at += 4 * take
            self._put(window)

    def finish(self) -> None:
        """Merge the leftovers: pieces of the emptiest windows fill the fullest."""
        left = [x[2] for x in self.open]
        self.open = []
        while len(left) > 1:
            target = left.pop(0)
            while left and target.fill < self.length:
                donor = left[-1]
                doc, start, ids, total = donor.pieces.pop()
                donor.fill -= len(ids) // 4
                take = 4 * min(self.length - target.fill, len(ids) // 4)
                target.add(doc, start, ids[:take], total)
                if take < len(ids):
                    donor.add(doc, start + take // 4, ids[take:], total)
                if not donor.pieces:
                    left.pop()
            if target.fill == self.length:
                self.emit(target.pieces)
            else:
                left.insert(0, target)
        for window in left:
            self._powers(window)

    def _powers(self, window: _Window) -> None:
        pieces = window.pieces[::-1]
        fill = window.fill
        while fill:
            size = 1 << (fill.bit_length() - 1)
            fill -= size
            out = []
            while size:
                doc, start, ids, total = pieces.pop()
                take = min(size, len(ids) // 4)
                out.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    pieces.append((doc, start + take, ids[4 * take :], total))
                size -= take
            self.emit(out)


def pack(docs: DataFrame, tokenizer: str, *, length: int = 4096, end_id: int = 2, open_windows: int = 64, min_piece: int = 32) -> DataFrame:
    """One row for each piece: its document, place in the document, sequence, offset and ids (little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        state = {"next": base, "bytes": 0}

        def emit(pieces: list) -> None:
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, total, state["next"], at, ids))
                at += len(ids) // 4
                state["bytes"] += len(ids)
            state["next"] += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            rows.clear()
            state["bytes"] = 0
            return out

        packer = OnlinePacker(length, open_windows, min_piece, emit)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, tokens.encode(text.as_py() or "") + end)
                if state["bytes"] > 4 << 20:
                    yield flush()
        packer.finish()
        if rows:
            yield flush()

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)
