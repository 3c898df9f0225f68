"""Quality rules: counts of words, symbols, repeats, and the perplexity of an n-gram model.

The model is a modified Kneser-Ney model of character n-grams of order ``ORDER`` for each
language, counted by Spark and kept in sorted hash arrays (see charlm). It counts the documents that
are labelled good, or all of a language that has none such, and a text is judged by a model that has
not counted it or its copies: texts are dealt into ``FOLDS``, and each fold is judged by a model of
the others. A word that another language's model finds likelier by SWITCH_BITS is judged by that one, so that
passages in other languages cost little. A document is rejected when its perplexity lies outside its language's band; bands come
from the quartiles of the good documents' log-perplexities, widened for short texts.

Defined cases: a null text has no words, fails the base rules and isn't kept; a null language is
a language of its own; a text of a language without a text in another fold has no bits and is left
to the base rules; repeated rows are judged alike; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import charlm
from tidemark.llm.arrowtext import U64, Powers, buffers, chunks, mix, shingles, span_hashes, words
from tidemark.session import arrow_map, broadcast_up_to, materialize

ORDER = 5
NO_LANGUAGE = "und"
#: Each text is judged by a model of the other folds.
FOLDS = 2
#: Ids of good documents are broadcast up to so many; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bands reach this many interquartile ranges and bits beyond the quartiles; a text of n characters gets LENGTH_BITS / sqrt(n) more.
BAND_IQR, BAND_BITS, LENGTH_BITS = 4.0, 0.35, 12.0
#: What a word costs more by the model of another language than its document's.
SWITCH_BITS = 2.0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeats(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have an equal key in their own document, given a hash of each."""
    with np.errstate(over="ignore"):
        own = mix(keys + mix(doc.astype(U64)))
    order = np.argsort(own, kind="stable")
    run = own[order]
    same = np.zeros(len(run), bool)
    if len(run) > 1:
        equal = run[1:] == run[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    out = np.zeros(len(run), bool)
    out[order] = same
    return out


def _later(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one of their own document."""
    with np.errstate(over="ignore"):
        own = mix(keys + mix(doc.astype(U64)))
    order = np.argsort(own, kind="stable")
    out = np.zeros(len(own), bool)
    if len(own) > 1:
        out[order[1:]] = own[order][1:] == own[order][:-1]
    return out


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """The STATS of each whole text."""
    raw, offsets = buffers(column)
    n = len(column)
    out = {k: np.zeros(n, np.int64) for k in STATS}
    powers = Powers()
    for i, j, part, at in chunks(raw, offsets):
        m = j - i
        starts, ends, doc = words(part, at)
        if not len(starts):
            continue
        count = np.bincount(doc, minlength=m)
        out["n_words"][i:j] = count
        size = len(part)
        # code points and symbols of words: prefix sums over bytes
        lead = np.zeros(size + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=lead[1:])
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out["word_chars"][i + doc[first]] = np.add.reduceat(lead[ends] - lead[starts], first)
        symbol = np.zeros(size + 1, np.int64)
        np.cumsum(_SYMBOL[part], out=symbol[1:])
        out["n_symbols"][i:j] = symbol[at[1:]] - symbol[at[:-1]]
        # lines that have a word
        feeds = np.flatnonzero(part == 10)
        line_start = np.unique(np.r_[at[:-1], feeds + 1])
        line_start = line_start[line_start < size]
        edge = np.r_[line_start[1:], size]
        cut = np.zeros(size + 1, bool)
        cut[feeds + 1] = True
        inner = np.zeros(size + 1, bool)
        inner[at] = True
        line_end = np.where(cut[edge], edge - 1, edge)
        both = cut[edge] & (line_end < line_start)
        line_end[both] = line_start[both]
        inked = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
        s, e = line_start[inked], line_end[inked]
        line_doc = np.searchsorted(at, s, side="right") - 1
        dup = _later(span_hashes(part, s, e, powers), line_doc)
        out["n_dup_lines"][i:j] = np.bincount(line_doc[dup], minlength=m)
        # words in 3-word windows found twice
        h = span_hashes(part, starts, ends, powers)
        if len(h) >= 3:
            full = np.flatnonzero(doc[2:] == doc[:-2])
            window, _ = shingles(h, doc, 3)
            hit = full[_repeats(window[: len(full)], doc[full])]
            mark = np.zeros(len(h), bool)
            for k in range(3):
                mark[hit + k] = True
            out["n_repeat_words"][i:j] = np.bincount(doc[mark], minlength=m)
    return out


def marked(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, text, lang, good, fold) of each row: whether it's labelled good, or no row of its language is, and its fold.

    Equal texts are of one fold, so that a model of the other has counted none of them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    rows = rows.withColumn("fold", (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % FOLDS).cast("int"))
    if labels is None:
        return rows.withColumn("good", F.lit(True))
    ids = materialize(labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("__good")).dropDuplicates(["doc_id"]), "good")
    rows = rows.join(broadcast_up_to(ids, BROADCAST_ROWS), "doc_id", "left").withColumn("good", F.col("__good").isNotNull()).drop("__good")
    known = [r[0] for r in rows.filter("good and text is not null").select("lang").distinct().collect()]
    return rows.withColumn("good", F.col("good") | ~F.col("lang").isin(known))


def fit(rows: DataFrame) -> charlm.CharModel:
    """The perplexity models of ``marked`` rows, from the good ones: for each language and fold, one that has counted the other folds alone."""
    own = F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(FOLDS - 1)), F.col("fold"))).alias("of")
    taught = rows.filter("good and text is not null").select("text", "lang", own).select("text", F.concat_ws(":", "of", "lang").alias("label"))
    classes = sorted(r[0] for r in taught.select("label").distinct().collect())
    return charlm.build(charlm.count(taught, ORDER, classes, letters_only=False), ORDER, classes, letters_only=False, modified=True)


def measure(rows: DataFrame, model: charlm.CharModel) -> DataFrame:
    """doc_id, language, good, the STATS, characters and bits a character (the log2 of the perplexity; null without a model) of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        number = {c: i for i, c in enumerate(model.classes)}
        fold_of = np.array([int(c.split(":")[0]) for c in model.classes], np.int64)
        for batch in batches:
            stats = text_stats(batch.column(1))
            lang = batch.column(2)
            fold = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.array([number.get(f"{f}:{x}", -1) for f, x in zip(fold.tolist(), lang.to_pylist(), strict=True)], np.int64)
            size, bits = model.score_words(batch.column(1), own, (fold_of == fold[:, None]) & (own >= 0)[:, None], SWITCH_BITS) if len(model.classes) else (np.zeros(len(own), np.int64), np.zeros(len(own)))
            value = np.where(own >= 0, bits, 0.0) / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, batch.column(3), *(pa.array(stats[k]) for k in STATS), pa.array(size), pa.array(value, pa.float64(), mask=own < 0)], ["doc_id", "lang", "good", *STATS, "n_chars", "bits"])

    return arrow_map(rows.select("doc_id", "text", "lang", "good", "fold"), run, "doc_id long, lang string, good boolean, " + ", ".join(f"{k} long" for k in STATS) + ", n_chars long, bits double")


def judge(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``measure`` with base_failed, the band (low_bits, high_bits) and kept. ``labels`` (doc_id, quality 0/1) name good documents."""
    rows = marked(docs, labels)
    measured = materialize(measure(rows, fit(rows)), "quality")
    bands = (
        measured.filter("good and n_words > 0")
        .groupBy("lang")
        .agg(F.percentile_approx("bits", [0.25, 0.75], 1000).alias("q"))
        .select("lang", (F.col("q")[0] - BAND_BITS - BAND_IQR * (F.col("q")[1] - F.col("q")[0])).alias("low_bits"), (F.col("q")[1] + BAND_BITS + BAND_IQR * (F.col("q")[1] - F.col("q")[0])).alias("high_bits"))
    )
    slack = LENGTH_BITS / F.sqrt(F.greatest(F.col("n_chars"), F.lit(1)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        measured.drop("good").join(F.broadcast(bands), "lang", "left")  # a row for each language of the model
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & F.coalesce(F.col("bits").between(F.col("low_bits") - slack, F.col("high_bits") + slack), F.lit(True)))
    )
