"""Benchmark decontamination: containment of short items in long documents.

A document holds an item when it has at least ``percent`` of the item's distinct shingles. Items
are dealt into partitions by size, a power of two each, and sketched by bottom-k MinHash: their k
shingles of least hash, with one k for a partition. A document is searched for the partitions of which
it has shingles enough for the smallest item, and its share of an item's sketch estimates the containment. The
bound on that estimate loses nothing: who holds an item lacks so few of its shingles that it has at
least SURE of the sketch, or all it needs of a small item. Each candidate is then verified by counting the item's
shingles in the whole document.

Everything is DataFrame functions. A text's shingles are exploded as hashes and joined with the
sketches, which are broadcast up to a number of rows and else joined by a shuffle. Texts are
read once more for the candidates alone.

Defined cases: a null text has no shingle; a text of fewer words than a shingle has its whole
sequence as one; an item without words is in no document; rows of one doc_id and equal text are
one document, and a doc_id's row with several texts counts the best of them; a null doc_id is a
document of its own name; items of one item_id are one item with all their shingles; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import broadcast_up_to, materialize

#: ASCII white space, as a class for Java's and DuckDB's expressions.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Candidates are broadcast up to so many rows (three longs each); beyond, texts are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Shingles of a sketch that a document with the item has at least, and rows of sketches broadcast at most (24 bytes each).
SURE, SKETCH_ROWS = 3, 1_000_000


def shingle_hashes(rows: DataFrame, text: str, out: str, width: int) -> DataFrame:
    """``rows`` with ``out``, the hashes of all word shingles of ``text``; repeated shingles repeat.

    Explode it with explode_outer: the filter that Spark infers for explode would be pushed below
    the projections here and evaluate the words anew for each shingle.
    """
    clean = rows.withColumn("__c", F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), BLANKS, " ")))
    hashed = clean.withColumn("__w", F.when(F.col("__c") == "", F.array().cast("array<long>")).otherwise(F.transform(F.split("__c", " "), lambda w: F.xxhash64(w))))
    hashed = hashed.withColumn("__n", F.size("__w"))
    at = lambda i, k: F.get(F.col("__w"), i + k)
    full = F.transform(F.sequence(F.lit(0), F.col("__n") - width), lambda i: F.xxhash64(*(at(i, k) for k in range(width))))
    value = F.when(F.col("__n") >= width, full).when(F.col("__n") > 0, F.array(F.xxhash64("__w"))).otherwise(F.array().cast("array<long>"))
    return hashed.withColumn(out, value).drop("__c", "__w", "__n")


def item_shingles(items: DataFrame, width: int, percent: int) -> DataFrame:
    """(item_id, s, n, need, part, hits, in_sketch): each distinct shingle of an item, its size, how many of them and of the sketch are needed."""
    rows = shingle_hashes(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), "text", "__s", width)
    each = rows.select("item_id", F.explode_outer("__s").alias("s")).filter("s is not null").distinct()
    own = Window.partitionBy("item_id")
    ranked = each.withColumn("n", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("s")))
    needed = lambda n: F.ceil(n * percent / 100)
    sized = ranked.withColumn("need", needed(F.col("n"))).withColumn("part", F.floor(F.log2("n")).cast("int"))
    largest = F.pow(F.lit(2), F.col("part") + 1).cast("long") - 1
    k = F.least(F.col("n"), largest - needed(largest) + SURE)
    return sized.withColumn("hits", k - (F.col("n") - F.col("need"))).withColumn("in_sketch", F.col("rank") <= k).drop("rank")


def _candidates(rows: DataFrame, each: DataFrame, width: int, percent: int) -> DataFrame:
    """(d, version, item_id) of documents that have enough of an item's sketch."""
    sketches = materialize(each.filter("in_sketch").select("item_id", "s", "part", "hits"), "sketches")
    texts = shingle_hashes(rows, "text", "__s", width).select("doc_id", "version", F.size("__s").alias("size"), F.explode_outer("__s").alias("s"))
    met = texts.join(broadcast_up_to(sketches, SKETCH_ROWS), "s").filter(F.col("size") >= F.ceil(F.pow(F.lit(2), "part") * percent / 100))
    met = met.groupBy(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "version", "item_id", "s").agg(F.first("hits").alias("hits"))
    return met.groupBy("d", "version", "item_id").agg(F.count("*").alias("met"), F.first("hits").alias("hits")).filter("met >= hits").select("d", "version", "item_id")


def contained(docs: DataFrame, items: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) of each item that a document holds."""
    each = materialize(item_shingles(items, width, percent), "items")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    candidates = materialize(_candidates(rows, each, width, percent), "candidates")
    texts = candidates.select("d", "version").distinct()
    few = texts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keyed = rows.withColumn("d", F.coalesce("doc_id", F.lit(-(2**63))))
    chosen = keyed.join(F.broadcast(texts) if few else texts, ["d", "version"], "left_semi").dropDuplicates(["d", "version"])
    whole = shingle_hashes(chosen, "text", "__s", width).select("doc_id", "d", "version", F.explode_outer(F.array_distinct("__s")).alias("s"))
    counts = whole.join(each.select("s", "item_id", "n", "need"), "s").groupBy("doc_id", "d", "version", "item_id").agg(F.count("*").alias("n_shared"), F.first("n").alias("n_shingles"), F.first("need").alias("need"))
    held = counts.filter("n_shared >= need").join(candidates, ["d", "version", "item_id"], "left_semi")
    return held.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n_shingles"))


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no item."""
    ids = materialize(found.select("doc_id").distinct(), "held")
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = ids.withColumnRenamed("doc_id", "__held")
    return docs.join(F.broadcast(named) if few else named, docs["doc_id"].eqNullSafe(F.col("__held")), "left_anti")


def oracle(width: int = 5, percent: int = 80) -> str:
    """DuckDB SQL for the items that ``documents`` hold."""
    cut = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    grams = f"CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""
WITH i AS (SELECT DISTINCT item_id, unnest({grams}) AS s FROM (SELECT item_id, {cut} AS w FROM benchmark)),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, unnest({grams}) AS s FROM (SELECT doc_id, {cut} AS w FROM documents))
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles FROM d JOIN i USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= {percent} * n_shingles"""
