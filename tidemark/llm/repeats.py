"""Removal of long byte strings that an earlier document has, by run-length indexes.

A byte goes when it is covered by a string of ``width`` bytes that also starts in a document with a
smaller doc_id. One index of a whole corpus can't be built in bounded memory, so what may match is
first dealt into buckets that can be: each string
is found by its anchor: of the GRAM-byte grams inside it, those of least hash. Equal strings have
equal anchors at equal places, so they meet where their anchor's hash is dealt; about one byte in
sixteen is an anchor. An anchor carries a hash of its context, all bytes of any string that it
could anchor. Of equal contexts the earliest document's stands for all: the others are covered,
each task says so of its own before anything is shuffled, and a hot passage sends one entry a
task. Only where contexts differ, and yet share all bytes next to the anchor on one side, are their
bytes fetched and indexed.

The index of some contexts is their run-compressed Burrows-Wheeler transform, with the suffix array
sampled at the runs' starts. Within a run, a suffix matches the one before it in order by one byte less
than the suffix a byte further left, so match lengths are compared byte by byte at the samples alone and
streamed through the text from there. Suffixes that match by ``width`` or more are marked and grouped, and in
each group all but the earliest document's are covered.

Entries travel as packed arrays, many to a row, in buckets whose number follows from the bytes of the input. Results are
exact but for contexts of one gram, of different bytes and yet of one 64-bit hash.

Defined cases: a null text is empty; a text shorter than ``width`` keeps all; rows of one doc_id
aren't smaller than each other, and rows without doc_id count as later than all others; repeated
rows are judged alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import U64, Powers, buffers, chunks, mix
from tidemark.session import arrow_groups, arrow_map, materialize

GRAM = 20
#: Covered stretches are broadcast up to so many bytes together; beyond, texts are joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: Anchors that a task packs at once.
ENTRIES = 400_000
#: Bytes of text for each bucket, and contexts that are indexed together (more if of one anchor).
BUCKET_BYTES, INDEXED = 8 << 20, 20_000
LAST = (1 << 63) - 1
_ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((k, pa.binary()) for k in "dvisehc")])
_DDL = "bucket int, kind int, d binary, v binary, i binary, s binary, e binary, h binary, c binary"
#: What a row's entries are: anchors to compare, covered contexts, contexts to fetch, covered stretches.
ANCHOR, COVERED, FETCH, STRETCH = range(4)


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each run of n entries, at the run's first place; n - 1 entries fewer."""
    size, out = 1, x
    while size * 2 <= n:
        out = f(out[: len(out) - size], out[size:])
        size *= 2
    rest = n - size
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def _prefix(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
    return total, down


def _spans(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, down = prefix
    with np.errstate(over="ignore"):
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def anchors(raw: np.ndarray, offsets: np.ndarray, width: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Hash, context hash, sides, document and place in it of each anchor of some documents.

    Sides are 16 bits each of the hashes of the bytes next to the anchor, to either side so many
    that a string with both anchors has all of one side.
    """
    size = len(raw)
    none = np.zeros(0, np.int64)
    if size < width:
        return none.astype(U64), none.astype(U64), none, none, none
    prefix = _prefix(raw, powers)
    total, down = prefix
    with np.errstate(over="ignore"):
        grams = mix((total[GRAM:] - total[:-GRAM]) * down[: size - GRAM + 1])
    inside = width - GRAM + 1
    least = _sliding(grams, inside, np.minimum)  # of the string that starts here
    doc_end = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    least[np.arange(len(least)) + width > doc_end] = 0
    padded = np.concatenate((np.zeros(inside - 1, U64), least, np.zeros(inside - 1, U64)))
    at = np.flatnonzero((_sliding(padded, inside, np.maximum) == grams) & (grams != 0))
    doc = np.searchsorted(offsets, at, side="right") - 1
    start = np.maximum(at - (inside - 1), offsets[doc])
    end = np.minimum(at + width, offsets[doc + 1])
    with np.errstate(over="ignore"):
        context = mix(_spans(prefix, start, end) + (at - start).astype(U64))
    half = (width - GRAM + 1) // 2
    left = _spans(prefix, np.maximum(at - half, offsets[doc]), at)
    right = _spans(prefix, at + GRAM, np.minimum(at + GRAM + half, offsets[doc + 1]))
    sides = (left >> U64(48) << U64(16) | right >> U64(48)).astype(np.int64)
    return grams[at], context, sides, doc, at - offsets[doc]


def _classes(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by (h, c), where each pair begins, the least document of each, and whether an entry (in order) has it."""
    with np.errstate(over="ignore"):
        order = np.argsort(mix(h) + c, kind="stable")
    one, two = h[order], c[order]
    first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(doc[order], first) if len(one) else doc
    lead = doc[order] == np.repeat(low, np.diff(np.r_[first, len(one)]))
    return order, first, low, lead


def suffix_order(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All suffixes of some strings in order, as places row * width + column; equal ones in order of their rows.

    ``rows`` holds a string a row, of ``length`` bytes; a string's end comes before every byte.
    """
    n, width = rows.shape
    inside = np.arange(width) < length[:, None]
    symbol = np.where(inside, rows.astype(np.uint64) + U64(1), U64(0))
    key, reach = symbol, 1
    after = lambda x, k: np.concatenate((x[:, k:], np.zeros((n, min(k, width)), x.dtype)), axis=1)[:, :width]
    for _ in range(6):  # seven symbols in a long
        key = key * U64(257) + after(symbol, reach)
        reach += 1
    while True:
        rank = np.unique(key, return_inverse=True)[1].reshape(n, width).astype(np.uint64)
        if reach >= width:
            break
        rank += U64(1)
        rank[~inside] = 0
        key = rank << U64(32) | after(rank, reach)
        reach *= 2
    place = np.flatnonzero(inside.ravel())
    return place[np.argsort(rank.ravel()[place], kind="stable")]


def match_lengths(rows: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes each suffix has in common with the one before it in ``order``.

    The run-compressed transform is all that is kept of the order: a suffix that doesn't start a
    run is preceded by the byte that precedes the one before it, so the same holds of the suffixes
    one byte further left, and its match is one byte shorter than theirs.
    """
    n, width = rows.shape
    flat = np.ascontiguousarray(rows).ravel()
    column = order % width
    before = np.where(column > 0, flat[np.maximum(order - 1, 0)].astype(np.int32), -1)
    start = np.r_[True, (before[1:] != before[:-1]) | (before[1:] < 0)]  # of a run of the transform; each string's first suffix is one
    heads = np.flatnonzero(start)
    sample, other = order[heads], order[np.maximum(heads - 1, 0)]
    most = np.minimum(length[sample // width] - sample % width, length[other // width] - other % width)
    most[0] = 0
    common, live, step = np.zeros(len(heads), np.int64), np.flatnonzero(most > 0), 0
    while len(live):
        live = live[flat[sample[live] + step] == flat[other[live] + step]]
        step += 1
        common[live] = step
        live = live[most[live] > step]
    # in text order, from one sample to the next
    at = np.full(n * width, -1, np.int64)
    at[sample] = np.arange(len(sample))
    text = np.sort(order)
    last = np.maximum.accumulate(np.where(at[text] >= 0, np.arange(len(text)), 0))
    streamed = np.zeros(n * width, np.int64)
    streamed[text] = common[at[text[last]]] - (text - text[last])
    return streamed[order]


def repeated(rows: np.ndarray, length: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each start of a ``width``-byte string that a row of a smaller document has too."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_order(rows, length)
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.flatnonzero(match_lengths(rows, length, order) < width)
    owner = doc[order // rows.shape[1]]
    low = np.repeat(np.minimum.reduceat(owner, group), np.diff(np.r_[group, len(order)]))
    hit = order[owner > low]
    return hit // rows.shape[1], hit % rows.shape[1]


def _several(key: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which entries share their key with one of another document."""
    out = np.zeros(len(key), bool)
    if len(key):
        by = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        out[by] = np.repeat(np.minimum.reduceat(low[by], start) != np.maximum.reduceat(low[by], start), np.diff(np.r_[start, len(by)]))
    return out


def _rows(kind: int, bucket: np.ndarray, doc: np.ndarray, version: np.ndarray, s: np.ndarray, e: np.ndarray | None = None, h: np.ndarray | None = None, c: np.ndarray | None = None) -> Iterator[tuple]:
    """A row of packed arrays for each bucket; documents are listed once and numbered."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
        part = order[a:b]
        pair = np.empty(len(part), [("d", np.int64), ("v", np.int64)])
        pair["d"], pair["v"] = doc[part], version[part]
        listed, number = np.unique(pair, return_inverse=True)
        pack = lambda x, kind: None if x is None else x[part].astype(kind).tobytes()
        yield int(bucket[part[0]]), kind, listed["d"].tobytes(), listed["v"].tobytes(), number.astype("<u4").tobytes(), pack(s, "<u4"), pack(e, "<u4"), pack(h, "<u8"), pack(c, "<u8")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ROW), _ROW, strict=True)], schema=_ROW)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 32)):
        yield _batch(part)


def _unpacked(table: pa.Table, names: str) -> list[np.ndarray]:
    """Documents, versions and the named arrays of all entries of some rows."""
    kinds = {"s": "<u4", "e": "<u4", "h": "<u8", "c": "<u8"}
    doc, version, out = [], [], {k: [] for k in names}
    for row in table.select(["d", "v", "i", *names]).to_pylist():
        number = np.frombuffer(row["i"], "<u4")
        doc.append(np.frombuffer(row["d"], np.int64)[number])
        version.append(np.frombuffer(row["v"], np.int64)[number])
        for k in names:
            out[k].append(np.frombuffer(row[k], kinds[k]))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return [join(doc, np.int64), join(version, np.int64), *(join(out[k], kinds[k]) for k in names)]


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.view(U64)) % U64(buckets)).astype(np.int64)


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of some that may overlap or touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]] if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return start[first], end[np.r_[first[1:] - 1, len(end) - 1]] if len(first) else end


def _find(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Rows of covered contexts, and of contexts to fetch, by document bucket."""

    def packed(got: list[tuple], ids: np.ndarray, versions: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, c, sides, row, p = (np.concatenate(x) for x in zip(*got, strict=True))
        doc, version = ids[row], versions[row]
        order, _, _, lead = _classes(h, c, doc)
        own, out = np.sort(order[lead]), np.sort(order[~lead])
        yield from _batches(_rows(ANCHOR, (h[own] % U64(buckets)).astype(np.int64), doc[own], version[own], p[own], sides[own], h[own], c[own]))
        yield from _batches(_rows(COVERED, buckets + _doc_bucket(doc[out], buckets), doc[out], version[out], p[out]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            versions = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, offsets = buffers(batch.column(2))
            got, held = [], 0
            for i, _, part, at in chunks(raw, offsets):
                h, c, e, d, p = anchors(part, at, width, powers)
                got.append((h, c, e, i + d, p))
                held += len(h)
                if held >= ENTRIES:
                    yield from packed(got, ids, versions)
                    got, held = [], 0
            if got:
                yield from packed(got, ids, versions)

    def meet(table: pa.Table) -> pa.Table:
        if not len(table) or table.column("bucket")[0].as_py() >= buckets:
            doc, version, p = _unpacked(table, "s")
            return pa.Table.from_batches([_batch(list(_rows(COVERED, _doc_bucket(doc, buckets), doc, version, p)))])
        doc, version, p, sides, h, c = _unpacked(table, "sehc")
        order, first, low, lead = _classes(h, c, doc)
        out = order[~lead]
        # contexts of one anchor and one side in common, whose earliest documents differ
        head, side = h[order[first]], sides[order[first]].astype(U64)
        with np.errstate(over="ignore"):
            many = _several(mix(head + (side >> U64(16))), low) | _several(mix(mix(head) + (side & U64(0xFFFF))), low)
        size = np.diff(np.r_[first, len(order)])
        ask = order[lead & np.repeat(many, size)]
        rows = [*_rows(COVERED, _doc_bucket(doc[out], buckets), doc[out], version[out], p[out]), *_rows(FETCH, _doc_bucket(doc[ask], buckets), doc[ask], version[ask], p[ask], h=h[ask])]
        return pa.Table.from_batches([_batch(rows)])

    return arrow_groups(arrow_map(docs, emit, _DDL).repartition(buckets, "bucket"), ["bucket"], meet, _DDL)


def _by_document(found: DataFrame, kinds: list[int], width: int, buckets: int, fetch: bool) -> DataFrame:
    """(d, v, a, b): for each document the packed places and hashes to fetch, or its merged covered stretches."""
    reach = width - GRAM

    def gather(table: pa.Table) -> pa.Table:
        if fetch:
            doc, version, a, b = _unpacked(table, "sh")
        else:
            doc, version, a = _unpacked(table.filter(pa.compute.equal(table["kind"], COVERED)), "s")
            more = _unpacked(table.filter(pa.compute.equal(table["kind"], STRETCH)), "se")
            start, end = np.maximum(a.astype(np.int64) - reach, 0), a.astype(np.int64) + width
            doc, version = np.r_[doc, more[0]], np.r_[version, more[1]]
            a, b = np.r_[start, more[2]].astype("<u4"), np.r_[end, more[3]].astype("<u4")
        order = np.lexsort((a, version, doc))
        doc, version, a, b = doc[order], version[order], a[order], b[order]
        cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])]) if len(doc) else np.zeros(0, np.int64)
        one, two = [], []
        for x, y in zip(cut, np.r_[cut[1:], len(doc)], strict=True):
            s, e = (a[x:y], b[x:y]) if fetch else _merged(a[x:y].astype(np.int64), b[x:y].astype(np.int64))
            one.append(s.astype("<u4").tobytes())
            two.append(e.astype("<u8" if fetch else "<u4").tobytes())
        return pa.table({"d": pa.array(doc[cut]), "v": pa.array(version[cut]), "a": pa.array(one, pa.binary()), "b": pa.array(two, pa.binary())})

    return arrow_groups(found.filter(F.col("kind").isin(kinds)).repartition(buckets, "bucket"), ["bucket"], gather, "d long, v long, a binary, b binary")


def _compare(docs: DataFrame, per: DataFrame, width: int, buckets: int) -> DataFrame:
    """Rows of stretches that differing contexts have in common with those of earlier documents, by an index of them."""
    reach = width - GRAM

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part: list[tuple] = []
            for d, v, text, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer((text or "").encode(errors="surrogateescape"), np.uint8)
                p = np.frombuffer(a, "<u4").astype(np.int64)
                place = p[:, None] + np.arange(-reach, width)
                ok = (place >= 0) & (place < len(raw))
                ctx = np.where(ok, raw[np.clip(place, 0, max(len(raw) - 1, 0))], 0).astype(np.uint8)
                part.append((np.full(len(p), d), np.full(len(p), v), p, np.minimum(len(raw), p + width), np.frombuffer(b, "<u8"), ctx))
            if not part:
                continue
            doc, version, p, end, h, ctx = (np.concatenate(x) for x in zip(*part, strict=True))
            bucket = (h % U64(buckets)).astype(np.int64)
            yield from _batches((*row[:8], ctx[bucket == row[0]].tobytes()) for row in _rows(ANCHOR, bucket, doc, version, p, end, h))

    def meet(table: pa.Table) -> pa.Table:
        doc, version, p, end, h = _unpacked(table, "seh")
        ctx = np.frombuffer(b"".join(x.as_py() for x in table["c"]), np.uint8).reshape(len(doc), width + reach)
        p, end = p.astype(np.int64), end.astype(np.int64)
        shift = np.maximum(reach - p, 0)  # a context at a document's start has blanks before it
        length = end - np.maximum(p - reach, 0)
        by = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.r_[True, h[by][1:] != h[by][:-1], True])  # anchors stay together
        start, who, k = [], [], 0
        while k < len(edge) - 1:
            j = max(k + 1, int(np.searchsorted(edge, edge[k] + INDEXED, side="right")) - 1)
            part = by[edge[k] : edge[j]]
            place = np.minimum(np.arange(width + reach) + shift[part][:, None], width + reach - 1)
            row, column = repeated(np.take_along_axis(ctx[part], place, axis=1), length[part], doc[part], width)
            who.append(part[row])
            start.append(np.maximum(p[part[row]] - reach, 0) + column)
            k = j
        who, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, start))
        stop = start + width
        rows = list(_rows(STRETCH, _doc_bucket(doc[who], buckets), doc[who], version[who], start, stop))
        return pa.Table.from_batches([_batch(rows)])

    # nearly every document has an edge of some passage, so this join is a shuffle at every size
    texts = docs.join(per.hint("merge"), ["d", "v"]).select("d", "v", "text", "a", "b")
    return arrow_groups(arrow_map(texts, fetch, _DDL).repartition(buckets, "bucket"), ["bucket"], meet, _DDL)


def remove_repeats(docs: DataFrame, *, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of each row."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("v"), F.col("text").cast("string").alias("text"))
    found = materialize(_find(base, width, buckets), "found")
    asked = materialize(_by_document(found, [FETCH], width, buckets, True), "asked")
    common = materialize(_compare(base, asked, width, buckets), "common")
    spans = materialize(_by_document(found.unionByName(common), [COVERED, STRETCH], width, buckets, False), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, count, kept = [], [], [], []
            raw, offsets = buffers(batch.column(1))
            for k, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                text = raw[offsets[k] : offsets[k + 1]]
                s, e = (np.frombuffer(x or b"", "<u4").astype(np.int64) for x in (a, b))
                e = np.minimum(e, len(text))
                parts = [text[x:y] for x, y in zip(np.r_[0, e], np.r_[s, len(text)], strict=True)]
                size.append(len(text))
                gone.append(int((e - s).sum()))
                count.append(len(s))
                kept.append(b"".join(x.tobytes() for x in parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    size = spans.agg(F.sum(F.octet_length("a") + F.octet_length("b") + 64)).first()[0] or 0
    joined = base.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, ["d", "v"], "left").select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "text", "a", "b")
    return arrow_map(joined, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
