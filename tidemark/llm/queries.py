"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, licenses, linededup, neardup, packing, quality, repeats, secrets, sharding

TOKENIZER = "word_bpe_49k.json"
SHARDS = 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_sentences", "n_unmatched")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.training_samples(spark, docs)))
    mark = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(mark(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        mark(F.col("spans")).alias("spans"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    cut = sharding.shard(docs, SHARDS, carry=("text_crc32",))
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.train(docs.filter(part != 1).select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label")))
    judged = langid.identify(docs.select("doc_id", "text", F.coalesce(part == 1, F.lit(False)).alias("held_out")), model)
    return judged.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_bits").alias("bits"), F.col("lang_rejected").alias("rejected"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits", "low_bits", "high_bits")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_sharding": op4_sharding,
    "op5_langid": op5_langid,
    "op6_decontam": op6_decontam,
    "op7_linededup": op7_linededup,
    "op8_repeats": op8_repeats,
    "op9_quality": op9_quality,
    "op10_neardup": op10_neardup,
}
ORACLES: dict[str, str] = {
    "op1_licenses": licenses.oracle(),
    "op4_sharding": sharding.oracle(SHARDS),
    "op6_decontam": decontam.oracle(),
    "op10_neardup": neardup.oracle(3, 85),
}
