"""Near-duplicate documents by SuperMinHash, banding, verification and union of links.

A text's words are lower-cased (A-Z) and cut at ASCII white space; its set is its distinct
shingles. SuperMinHash ranks all components of a signature by one random permutation for each
shingle, so components are negatively correlated and the estimate has less variance; a document
stops as soon as no later rank can lower any component, which for long texts is after the first.
Signatures are made for a chunk of documents in lock step, rank by rank.

Documents of equal sets become one item first. Items that agree in a band of their signatures
meet in a bucket; ``linking`` compares them without all pairs, and every link is confirmed on full
sets. Before items of different groups are compared, a bound that no link fails rules most out: each
set keeps the parity of its shingles in PARITY_BITS classes, and two sets differ in at least as many
shingles as their parities differ in bits. The number of rows a band is chosen so that a pair at the threshold
escapes all bands with a probability below ``MISS``; there is no cap on buckets or candidates, and buckets of any
size are compared in full: items that agree in a band are in one group or have been compared.

Defined cases: a text that is null or has no word has an empty set and is linked with nothing; a
text of fewer words than a shingle has its whole sequence as one; rows without doc_id are linked
with nothing and kept; rows that share a doc_id are one document; repeated rows are judged alike;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import LOWER, U64, Powers, buffers, chunks, distinct, mix, shingles, span_hashes, words
from tidemark.llm.linking import link
from tidemark.session import arrow_map, materialize

COMPONENTS, MISS = 128, 1e-6
PARITY_BITS = 512
#: Candidates' ids are broadcast up to so many (8 bytes each); beyond, texts are joined by a shuffle.
BROADCAST_IDS = 500_000
_STEP = U64(0x9E3779B97F4A7C15)


def band_rows(threshold: float, components: int = COMPONENTS, miss: float = MISS) -> int:
    """The most rows a band with which a pair at the threshold is missed with probability under ``miss``."""
    for rows in range(components, 0, -1):
        if (1 - threshold**rows) ** (components // rows) <= miss:
            return rows
    return 1


def signatures(values: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """SuperMinHash components, rank in the upper and randomness in the lower 40 bits; rows of empty documents are all ones."""
    top = np.iinfo(np.int64).max
    sig = np.full(docs * m, top, np.int64)
    base, where = mix(values), doc * m
    permuted: np.ndarray | None = None
    counts = np.bincount(doc, minlength=docs)
    done = counts == 0
    for j in range(m):
        if not len(base):
            break
        with np.errstate(over="ignore"):
            r = mix(base + U64(j + 1) * _STEP)
        k = j + ((r & U64(0xFFFFFF)) * U64(m - j) >> U64(24)).astype(np.int64)
        if permuted is None:
            slot = k
        else:
            rows = np.arange(len(base))
            slot = permuted[rows, k].astype(np.int64)
            permuted[rows, k] = permuted[rows, j]
        np.minimum.at(sig, where + slot, np.int64(j) << 40 | (r >> U64(24)).astype(np.int64))
        now = sig.reshape(docs, m).max(axis=1) < (np.int64(j + 1) << 40)
        if (now & ~done).any():
            done |= now
            stay = ~done[where // m]
            base, where = base[stay], where[stay]
            if permuted is None:
                k = k[stay]
            else:
                permuted = permuted[stay]
        if permuted is None:
            permuted = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(base), 1))
            permuted[np.arange(len(base)), k] = 0
    return sig.reshape(docs, m)


def _sets(raw: np.ndarray, offsets: np.ndarray, width: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk's documents and their documents."""
    low = LOWER[raw]
    starts, ends, doc = words(low, offsets)
    return distinct(*shingles(span_hashes(low, starts, ends, powers), doc, width))


def sketch(docs: DataFrame, width: int, rows: int, components: int = COMPONENTS) -> DataFrame:
    """doc_id, number of shingles, identity of the set (two longs), hashes of the bands and parities of each text."""
    bands = components // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            n = len(batch)
            raw, offsets = buffers(batch.column(1))
            size, one, two = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
            keys, parity = np.zeros((n, bands), np.int64), np.zeros((n, PARITY_BITS // 64), np.int64)
            for i, j, part, at in chunks(raw, offsets):
                values, doc = _sets(part, at, width, powers)
                if not len(values):
                    continue
                size[i:j] = np.bincount(doc, minlength=j - i)
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                with np.errstate(over="ignore"):
                    one[i + doc[first]] = np.add.reduceat(mix(values), first)
                    two[i + doc[first]] = np.add.reduceat(mix(values + _STEP), first)
                    sig = signatures(values, doc, j - i, components)[:, : bands * rows].reshape(j - i, bands, rows).astype(U64)
                    key = np.zeros((j - i, bands), U64)
                    for r in range(rows):
                        key = mix(key + sig[:, :, r] + U64(r + 1) * _STEP)
                keys[i:j] = key.view(np.int64)
                odd = np.bincount(doc * PARITY_BITS + (values % U64(PARITY_BITS)).astype(np.int64), minlength=(j - i) * PARITY_BITS) & 1
                parity[i:j] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(j - i, -1)
            lists, odds = (pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (keys, parity))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists, odds], ["doc_id", "n", "s1", "s2", "bands", "parity"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n long, s1 long, s2 long, bands array<long>, parity array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, set): each text's distinct shingles as sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for i, j, part, at in chunks(raw, offsets):
                values, doc = _sets(part, at, width, powers)
                edge = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32) * 8
                data = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(values.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), data], ["id", "set"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "id long, set binary")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["id"], "left_semi")


def confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` for which 100 * intersection >= percent * union, on full sets."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidates")
    sets = materialize(full_sets(_texts(docs, ids), width), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return arrow_map(joined.select("a", "b", "x", "y"), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept of each row."""
    rows = band_rows(percent / 100)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = materialize(sketch(base, width, rows), "sketches")
    items = sketched.filter("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("parity").alias("parity"))
    items = materialize(items, "items")
    members = items.select("id", "n", "bands", F.posexplode("bands").alias("band", "h"))
    members = members.select("id", "n", "band", "h", F.when(F.col("band") > 0, F.get("bands", F.col("band") - 1)).alias("before"))
    near_sized = lambda a, b: 100 * F.least(f"{a}_n", f"{b}_n") >= percent * F.greatest(f"{a}_n", f"{b}_n")
    differ = lambda a, b: sum(F.bit_count(F.get(f"{a}_extra", F.lit(k)).bitwiseXOR(F.get(f"{b}_extra", F.lit(k)))) for k in range(PARITY_BITS // 64))
    enough = lambda a, b: (100 + percent) * differ(a, b) <= (100 - percent) * (F.col(f"{a}_n") + F.col(f"{b}_n"))
    sizes = {"least": F.min("n"), "most": F.max("n")}
    groups = link(members, ["band", "h"], lambda pairs: confirm(base, pairs, width, percent), near_sized, ["n"], alone=sizes, couple=f"100 * least >= {percent} * most", before="before", extra=items.select("id", F.col("parity").alias("extra")), bound=enough)
    roots = items.select("n", "s1", "s2", "id").join(groups, F.col("id") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("root", "id").alias("root"))
    out = sketched.select("doc_id", "n", "s1", "s2").join(roots, ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def oracle(width: int, percent: int) -> str:
    """DuckDB SQL for the groups of ``documents``: pairs that share a shingle are counted, and links followed."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cut = f"list_filter(string_split_regex({low}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    grams = f"CASE WHEN len(w) >= {width} THEN list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: hash(w[i:i + {width - 1}]))) WHEN len(w) > 0 THEN [hash(w)] ELSE [] END"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {cut} AS w FROM documents)),
same AS (SELECT list_sort(g) AS g, min(doc_id) AS id, len(any_value(g)) AS n FROM d WHERE len(g) > 0 GROUP BY list_sort(g)),
e AS (SELECT id, n, unnest(g) AS s FROM same),
c AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.s = b.s AND a.id < b.id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
r(id, root) AS (SELECT id, id FROM same UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id AND r.root <= l.b),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT doc_id, CAST(len(d.g) AS BIGINT) AS n_shingles, coalesce(m.root, doc_id) AS component_id, coalesce(m.root, doc_id) = doc_id AS kept FROM d LEFT JOIN same ON same.g = list_sort(d.g) LEFT JOIN m ON m.id = same.id"""
