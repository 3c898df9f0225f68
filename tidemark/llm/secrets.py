"""Secret scans: patterns, and two character Markov models compared by log-likelihood ratio.

Patterns give the base spans. Further candidates are runs of token characters; a candidate is a
secret when the model of random strings explains its character pairs better than the model of
ordinary identifiers, on average by ``MIN_RATIO`` natural units a pair. Both models are trained
from labelled samples, as counts of character pairs, at most ALPHABET squared for each.

Samples of ordinary strings are made from words of documents, as identifiers in several styles,
slugs and paths, and by rule: dates, numbers, runs of one character, and the alphabet.

Spans come from SQL functions alone: the gaps between matches (split) and the matches
(regexp_extract_all) interleave, so running lengths give places in code points. They are summed in
blocks of BLOCK and of its square, so that a match costs a few blocks' sums and not one of all matches
before it. The scan is one projection with no shuffle; the ratios are one literal array.

Defined cases: a null text is empty and has no span; equal starts are ordered by kind; repeated
rows are scanned alike; an empty table gives no rows; with no samples the ratios are 0 and only
base spans are found; a very long run of token characters is one candidate, scored in one pass; further
columns are kept, except that ``spans`` replaces one of that name.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, in the order of kinds.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "[0-9a-f]{24,}+"
KINDS = ["assign", "access", "hex", "markov"]

#: Candidates are whole runs of token characters, of at least so many.
MIN_LENGTH = 20
CANDIDATE = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}+"
MIN_RATIO = 0.5
#: Characters are told apart by their code below this; any other counts as 0.
ALPHABET = 128
#: Labelled samples: so many generated random strings of each alphabet, and the words of so many documents of least key hash.
RANDOM_SAMPLES, ORDINARY_DOCUMENTS = 2000, 500
#: Ordinary samples made by rule: so many dates and numbers, and so many copies of each run of a character and of the alphabet.
RULED_SAMPLES, RULED_COPIES = 4000, 400
#: Running lengths are summed in blocks of so many, and blocks in blocks.
BLOCK = 64
#: Added to each character's count; weight of single characters against pairs.
SMOOTHING, BACKOFF = 0.5, 4.0


def _with_spans(base: DataFrame, pattern: str, kind: int) -> DataFrame:
    """``base`` with __{kind}: spans of all leftmost matches in __text, as (start, kind number, end, matched text)."""
    text, f, g, t, u, v = F.col("__text"), *(f"__{x}{kind}" for x in "fgtuv")
    none = F.array().cast("array<int>")
    some = text.rlike(pattern)
    base = base.withColumn(f, F.when(some, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>")))
    base = base.withColumn(g, F.when(F.size(f) > 0, F.transform(F.split(text, pattern, -1), F.length)).otherwise(none))
    # each array is read by name in two places, so that no lambda holds the expression that makes it
    step = lambda x, i: F.get(g, i) + F.when(i > 0, F.length(F.get(f, i - 1))).otherwise(0)
    base = base.withColumn(t, F.when(F.size(g) > 0, F.transform(f, step)).otherwise(none))
    total = lambda array, at, n: F.aggregate(F.slice(array, at + 1, n), F.lit(0), lambda a, x: a + x)
    for low, high in ((t, u), (u, v)):
        blocks = F.sequence(F.lit(0), F.floor(F.size(low) / BLOCK).cast("int"))
        base = base.withColumn(high, F.when(F.size(low) > 0, _block_sums(low, blocks)).otherwise(none))
    two, one = BLOCK * BLOCK, BLOCK
    div = lambda i, n: F.floor(i / n).cast("int")
    start = lambda i: total(F.col(v), F.lit(0), div(i, two)) + total(F.col(u), div(i, two) * BLOCK, div(i, one) - div(i, two) * BLOCK) + total(F.col(t), div(i, one) * BLOCK, i % one + 1)
    placed = F.transform(f, lambda x, i: F.struct(start(i).alias("start"), F.lit(kind).alias("kind"), x.alias("text")))
    full = F.transform(placed, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), (s["start"] + F.length(s["text"])).alias("end"), s["text"].alias("text")))
    return base.withColumn(f"__{kind}", F.when(F.size(v) > 0, full).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,text:string>>"))).drop(f, g, t, u, v)


def _block_sums(array: str, blocks: Column) -> Column:
    return F.transform(blocks, lambda j: F.aggregate(F.slice(array, j * BLOCK + 1, BLOCK), F.lit(0), lambda a, x: a + x))


def training_samples(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(text, is_random): strings generated by rule, and the words of a bounded sample of documents with joined pairs of them."""
    key = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    made = F.array(F.substring(key, 1, 40), F.translate(F.base64(F.unhex(key)), "=", ""), F.upper(F.conv(F.substring(key, 1, 15), 16, 36)), F.translate(F.base64(F.unhex(F.sha2(key, 256))), "+/=", "xQ"))
    random = spark.range(0, RANDOM_SAMPLES, 1, 4).select(F.explode(made).alias("text"), F.lit(True).alias("is_random"))
    chosen = docs.filter("text is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(ORDINARY_DOCUMENTS)
    sample = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    tokens = sample.select(F.array_distinct(F.filter(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), 0), lambda w: F.length(w) >= 3)).alias("w"))
    three = lambda i: F.slice("w", i + 1, 3)
    camel = lambda x: F.array_join(F.transform(x, F.initcap), "")
    styles = F.array(
        F.transform("w", lambda w, i: F.lower(F.array_join(three(i), "_"))), F.transform("w", lambda w, i: F.upper(F.array_join(three(i), "_"))), F.transform("w", lambda w, i: camel(three(i))),
        F.transform("w", lambda w, i: F.lower(F.array_join(three(i), "-"))), F.transform("w", lambda w, i: F.concat(F.lit("/"), F.array_join(three(i), "/"))), F.transform("w", lambda w, i: F.concat(w, (i % 100).cast("string"))),
        F.transform("w", lambda w, i: F.concat(F.lower(w), F.lit("="), F.upper(F.get("w", i + 1)))), F.col("w"),
    )
    return random.unionByName(tokens.select(F.explode(F.flatten(styles)).alias("text"), F.lit(False).alias("is_random")).filter("text is not null")).unionByName(_ruled(spark))


def _ruled(spark: SparkSession) -> DataFrame:
    """Ordinary strings that hold no words: dates, numbers, runs of one character, and the alphabet in order."""
    i = F.col("id").cast("int")
    day = F.timestamp_seconds(F.lit(946_684_800) + F.col("id") * 7_654_321 % 1_000_000_000)
    number = F.pmod(F.xxhash64("id"), F.lit(10**15)).cast("string")
    made = F.array(F.date_format(day, "yyyy-MM-dd-HH-mm-ss-SSS"), F.date_format(day, "/yyyy/MM/dd/HHmmss"), F.date_format(day, "yyyyMMddHHmmss"), F.lpad(i.cast("string"), 20, "0"), F.concat(number, F.lit("-"), number), F.concat(number, number))
    dated = spark.range(0, RULED_SAMPLES, 1, 4).select(F.explode(made).alias("text"))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    fixed = F.array(letters, F.lower(letters), F.lit("0123456789"), F.concat(letters, F.lower(letters), F.lit("0123456789+/")))
    runs = F.transform(F.split(F.concat(letters, F.lower(letters), F.lit("0123456789+/_=-")), ""), lambda c: F.repeat(c, 40))
    repeated = spark.range(0, RULED_COPIES, 1, 4).select(F.explode(F.concat(fixed, runs)).alias("text"))
    return dated.unionByName(repeated).withColumn("is_random", F.lit(False))


def train(samples: DataFrame) -> list[float]:
    """log p_random(b|a) - log p_ordinary(b|a) at a * ALPHABET + b, from counts of character pairs."""
    text = F.col("text")
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.ascii(text.substr(i, F.lit(1))) * 1024 + F.ascii(text.substr(i + 1, F.lit(1))))
    rows = samples.filter(F.length("text") >= 2).select("is_random", F.explode(pairs).alias("p")).groupBy("is_random", "p").count()
    bounded = lambda c: c if 0 < c < ALPHABET else 0
    count: dict[bool, dict[tuple[int, int], int]] = {True: {}, False: {}}
    one = F.when(F.floor(F.col("p") / 1024) < ALPHABET, F.floor(F.col("p") / 1024)).otherwise(0)
    two = F.when(F.col("p") % 1024 < ALPHABET, F.col("p") % 1024).otherwise(0)
    for r in rows.groupBy("is_random", one.alias("a"), two.alias("b")).agg(F.sum("count").alias("n")).collect():  # at most 2 * ALPHABET ** 2 rows
        k = (bounded(int(r.a)), bounded(int(r.b)))
        count[r.is_random][k] = count[r.is_random].get(k, 0) + r.n
    if not count[True] or not count[False]:
        return [0.0] * ALPHABET**2
    symbols = {b for table in count.values() for pair in table for b in pair}
    before: dict[bool, dict[int, int]] = {True: {}, False: {}}
    single: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for label, table in count.items():
        for (a, b), n in table.items():
            before[label][a] = before[label].get(a, 0) + n
            single[label][b] = single[label].get(b, 0) + n
    total = {label: sum(x.values()) for label, x in single.items()}
    alone = lambda label, b: (single[label].get(b, 0) + SMOOTHING) / (total[label] + SMOOTHING * len(symbols))
    log = lambda label, a, b: math.log((count[label].get((a, b), 0) + BACKOFF * alone(label, b)) / (before[label].get(a, 0) + BACKOFF))
    return [log(True, a, b) - log(False, a, b) for a in range(ALPHABET) for b in range(ALPHABET)]


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """All columns of ``docs`` with spans, an array of (start, end, kind, text, ratio) by start, then kind; ratio is null for base spans."""
    base = docs.drop("spans").select(F.struct("*").alias("__row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    for k, pattern in enumerate([ASSIGN, ACCESS, HEX, CANDIDATE]):
        base = _with_spans(base, pattern, k)
    value = lambda s: F.regexp_extract(s["text"], ASSIGN, 1)
    base = base.withColumn("__0", F.filter("__0", lambda s: F.length(value(s)) >= 6))
    base = base.withColumn("__base", F.array_sort(F.concat("__0", "__1", "__2")))
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    codes = lambda s: F.transform(F.split(s, ""), lambda c: F.when(F.ascii(c) < ALPHABET, F.ascii(c)).otherwise(0))
    pairs = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.get(table, a * ALPHABET + b))
    mean = lambda c: F.aggregate(pairs(c), F.lit(0.0), lambda a, x: a + x) / (F.size(c) - 1)
    ratio = lambda s: F.get(F.transform(F.array(codes(s)), mean), F.lit(0))
    free = F.filter("__3", lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    scored = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text"), ratio(s["text"]).alias("ratio")))
    base = base.withColumn("__more", F.when(F.size("__3") > 0, F.filter(scored, lambda s: s["ratio"] >= MIN_RATIO)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,text:string,ratio:double>>")))
    known = F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text"), F.lit(None).cast("double").alias("ratio")))
    names = F.array(*[F.lit(k) for k in KINDS])
    both = F.transform(F.array_sort(F.concat(known, F.col("__more"))), lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), F.get(names, s["kind"]).alias("kind"), s["text"].alias("text"), s["ratio"].alias("ratio")))
    return base.select("__row.*", both.alias("spans"))
