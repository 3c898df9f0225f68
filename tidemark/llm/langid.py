"""Language identification by interpolated Kneser-Ney character models.

One model of order ``ORDER`` for each language, counted by Spark over all training rows and kept
in sorted hash arrays (see charlm). A text goes to the language of the lowest cross-entropy per
character. Rejection is calibrated on training rows held out from the counts: a text is rejected
when its lowest cross-entropy is far above what its language's own texts of that length have.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected; training
rows without text or language are left out; with no training rows every text is ``und``; of equal
cross-entropies the language first in order wins; repeated rows are judged alike; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import charlm
from tidemark.session import arrow_map, ship, trim

ORDER = 4
#: A training row in this many (by the key's checksum) calibrates and isn't counted.
CALIBRATION_SHARE = 30
#: Rejection lies this many standard deviations above the mean; evidence beyond SURE characters adds no certainty to a score.
REJECT_SIGMA, REJECT_BITS, SURE = 6.0, 2.0, 100
UNKNOWN = "und"


@dataclass
class LanguageModel:
    chars: charlm.CharModel
    #: By language: mean bits a character, their deviation between texts, and from character to character.
    mean: np.ndarray
    between: np.ndarray
    within: np.ndarray

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits a character and rejection of each text."""
        languages = self.chars.classes
        known = charlm.letters_in(texts)
        if not languages:
            n = len(texts)
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        size, bits, _ = self.chars.score(texts)
        length = np.maximum(size, 1)[:, None]
        cross = bits / length
        best = cross.argmin(axis=1)
        low = cross[np.arange(len(best)), best]
        score = 1 / np.exp2(-(cross - low[:, None]) * np.minimum(length, SURE)).sum(axis=1)
        limit = self.mean[best] + REJECT_BITS + REJECT_SIGMA * np.sqrt(self.between[best] ** 2 + self.within[best] ** 2 / length[:, 0])
        rejected = ~known | (low > limit)
        return [languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], np.where(known, score, 0.0), np.where(known, low, 0.0), rejected


def train(labelled: DataFrame) -> LanguageModel:
    """A model from rows of (key, text, label). Keys only choose the rows that calibrate."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("label").cast("string").alias("label"), (F.crc32(F.coalesce(F.col("key").cast("string"), F.lit(""))) % CALIBRATION_SHARE == 0).alias("held")).filter("text is not null and label is not null")
    languages = sorted(r[0] for r in rows.select("label").distinct().collect())
    model = charlm.build(charlm.count(rows.filter("not held"), ORDER, languages, letters_only=True), ORDER, languages, letters_only=True, modified=False)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, bits, square = model.score(batch.column(0))
            own = np.array([languages.index(x) for x in batch.column(1).to_pylist()], np.int64)
            ok = size >= 20
            pick = np.arange(len(size))[ok], own[ok]
            yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(size[ok]), pa.array(bits[pick]), pa.array(square[pick])], ["c", "n", "bits", "sq"])

    held = arrow_map(rows.filter("held").select("text", "label"), measure, "c long, n long, bits double, sq double")
    per = held.withColumn("x", F.col("bits") / F.col("n")).groupBy("c").agg(F.percentile_approx("x", [0.25, 0.5, 0.75], 1000).alias("q"), (F.sum("sq") / F.sum("n") - F.pow(F.sum("bits") / F.sum("n"), 2)).alias("v"))
    mean, between, within = (np.zeros(len(languages)) for _ in range(3))
    mean[:], within[:], between[:] = 6.0, 3.0, 1.0  # a language without calibration rows
    for r in per.collect():
        mean[r.c], between[r.c], within[r.c] = r.q[1], (r.q[2] - r.q[0]) / 1.349, max(r.v, 0.0) ** 0.5
    return LanguageModel(model, mean, between, within)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with lang_pred, lang_score, lang_bits and lang_rejected (which replace columns of those names)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, lang_score double, lang_bits double, lang_rejected boolean")
    def judged(texts: pa.Array) -> pa.Array:
        lang, score, bits, rejected = shared.value.judge(texts)
        trim()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected)], ["lang_pred", "lang_score", "lang_bits", "lang_rejected"])

    rest = docs.drop("lang_pred", "lang_score", "lang_bits", "lang_rejected")
    return rest.select(F.struct("*").alias("__row"), judged(F.col("text").cast("string")).alias("__judged")).select("__row.*", "__judged.*")
