"""Price segments, their features, and how labels agree with them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.schema import KEYS, UNKNOWN, micros, seconds

SEGMENT = [*KEYS, "segment_id"]


def characterise(bars: DataFrame, timeframe: str, n_atr: int = 14) -> DataFrame:
    """Features of each segment; those of an invalid one, or one with a hole, are null. A segment that isn't one run is an error."""
    valid = F.coalesce(F.col("is_valid"), F.lit(False)) if "is_valid" in bars.columns else F.lit(True)
    step = seconds(timeframe) * 1_000_000
    rows = bars.withColumn("__valid", valid).withColumn("true_range", W.true_range()).withColumn("__atr", W.atr(n_atr)).withColumn("__n", F.row_number().over(W.series()))
    rows = rows.withColumn("__ret", W.log_return())
    order = F.col("ts")
    out = rows.groupBy(*SEGMENT).agg(
        F.min("ts").alias("debut"),
        F.max("ts").alias("fin"),
        F.count("*").alias("n"),
        (F.max_by("close", order) - F.min_by("close", order)).alias("pente"),
        (F.max("high") - F.min("low")).alias("amplitude"),
        F.stddev_samp(F.when(F.col("__n") > 1, F.col("__ret"))).alias("vol"),
        F.avg("__atr").alias("__atr"),
        F.min("__valid").alias("is_valid"),
        (F.max("__n") - F.min("__n") + 1).alias("__span"),
    )
    torn = F.raise_error(F.concat(F.lit("segment is not one run: "), F.col("segment_id").cast("string")))
    out = out.withColumn("n", F.when(F.col("__span") != F.col("n"), torn).otherwise(F.col("n")))
    holes = (micros(F.col("fin")) - micros(F.col("debut"))) / step + 1 != F.col("n")
    out = out.withColumn("is_valid", F.col("is_valid") & ~holes)
    known = lambda c: F.when(F.col("is_valid"), c)
    efficiency = F.when(F.col("amplitude") > 0, F.least(F.abs("pente") / F.col("amplitude"), F.lit(1.0))).otherwise(0.0)
    return out.select(
        *SEGMENT, "debut", "fin", "n", known(F.signum("pente")).alias("signe"), known(F.col("pente")).alias("pente"), known(F.col("amplitude")).alias("amplitude"),
        known(efficiency).alias("efficience"), known(F.col("vol")).alias("vol"), known(F.try_divide("pente", F.when(F.col("__atr") > 0, F.col("__atr")))).alias("pente_atr"), "is_valid",
    )


def project(bars: DataFrame, segments: DataFrame) -> DataFrame:
    """Bars with the features of their segment."""
    return bars.drop("is_valid").join(segments.drop("debut", "fin"), SEGMENT)


def cross(methods: dict[str, DataFrame]) -> DataFrame:
    """<method>_regime and <method>_confidence of each bar, side by side; invalid labels are null."""
    from tidemark.operators.detectors import validity

    rows = None
    for name, df in methods.items():
        ok = validity(df)
        own = df.select(*KEYS, "ts", F.when(ok, F.col("regime")).alias(f"{name}_regime"), F.when(ok, F.col("confidence")).alias(f"{name}_confidence"))
        rows = own if rows is None else rows.join(own, [*KEYS, "ts"], "full")
    return rows


def purity(rows: DataFrame, label: str = "regime") -> DataFrame:
    """Per segment: labelled bars, dominant label (the least of equals), its share, number of labels, and all counts."""
    each = rows.filter((F.col(label) != UNKNOWN) & F.col(label).isNotNull()).groupBy(*SEGMENT, label).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct(F.col(label).alias("x")), F.struct("n", F.transform(F.split(F.col(label), ""), lambda c: -F.ascii(c))))
    out = each.groupBy(*SEGMENT).agg(F.sum("n").alias("total"), best.alias("b"), F.max("n").alias("m"), F.count("*").alias("n_regimes"), F.map_from_entries(F.collect_list(F.struct(F.col(label), "n"))).alias("regimes"))
    return out.select(*SEGMENT, "total", F.col("b.x").alias("dominant"), (F.col("m") / F.col("total")).alias("purete"), "n_regimes", "regimes")


def overall_purity(found: DataFrame) -> DataFrame:
    """Per series: purity weighted by length, and the mean number of labels in a segment."""
    return found.groupBy(*KEYS).agg((F.sum(F.col("purete") * F.col("total")) / F.sum("total")).alias("purete"), F.avg("n_regimes").alias("regimes_moyens"), F.count("*").alias("n_segments"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))


def adjusted_scores(counts: Sequence[tuple[str, str, int]]) -> dict[str, float]:
    """Adjusted Rand index and adjusted mutual information (arithmetic mean) of a contingency table."""
    rows, cols = sorted({a for a, _, _ in counts}), sorted({b for _, b, _ in counts})
    table = np.zeros((len(rows), len(cols)), int)
    for a, b, n in counts:
        table[rows.index(a), cols.index(b)] += n
    n, p, q = int(table.sum()), table.sum(axis=1), table.sum(axis=0)
    pairs = lambda x: float((x * (x - 1) / 2).sum())
    every = n * (n - 1) / 2
    chance = pairs(p) * pairs(q) / every if every else 0.0
    most = (pairs(p) + pairs(q)) / 2
    rand = 1.0 if most == chance else (pairs(table) - chance) / (most - chance)
    lg = [0.0, 0.0]
    for k in range(2, n + 1):
        lg.append(lg[-1] + math.log(k))
    mutual = sum(c / n * math.log(n * c / (p[i] * q[j])) for (i, j), c in np.ndenumerate(table) if c)
    entropy = lambda x: -sum(v / n * math.log(v / n) for v in x if v)
    expected = 0.0
    for a in p.tolist():
        for b in q.tolist():
            for c in range(max(1, a + b - n), min(a, b) + 1):
                weight = lg[a] + lg[b] + lg[n - a] + lg[n - b] - lg[n] - lg[c] - lg[a - c] - lg[b - c] - lg[n - a - b + c]
                expected += c / n * math.log(n * c / (a * b)) * math.exp(weight)
    middle = (entropy(p) + entropy(q)) / 2
    information = 1.0 if abs(middle - expected) < 1e-15 else (mutual - expected) / (middle - expected)
    return {"ari": rand, "ami": information}


def compare(rows: DataFrame, methods: list[str]) -> list[dict]:
    """How each method's labels agree with the segments, on the bars where all of them have one."""
    shared = rows
    for m in methods:
        shared = shared.filter(F.col(m).isNotNull() & (F.col(m) != UNKNOWN))
    out = []
    for m in methods:
        held = purity(shared, m)
        total = held.agg(F.sum(F.col("purete") * F.col("total")) / F.sum("total"), F.avg("n_regimes"), F.count("*"), F.sum("total")).first()
        counts = [tuple(r) for r in contingency(shared, "segment_id", m).collect()]
        if not counts:
            out.append({"method": m, "n": 0})
            continue
        labels: dict[str, int] = {}
        for _, b, n in counts:
            labels[b] = labels.get(b, 0) + n
        n = sum(labels.values())
        base = max(labels.values()) / n
        whole = 1 < len(labels) < n and 1 < len({a for a, _, _ in counts}) < n
        out.append({"method": m, "n": n, "n_segments": total[2], "purete": total[0], "regimes_moyens": total[1], "n_labels": len(labels), "majorite": base, "gain": total[0] - base, "degenere": not whole, **(adjusted_scores(counts) if whole else {"ari": None, "ami": None})})
    return out


def adjacency(rows: DataFrame) -> DataFrame:
    """Segment numbers of runs, from a flag at each run's first bar."""
    return rows.withColumn("segment_id", (F.sum(F.col("starts").cast("int")).over(Window.partitionBy(*KEYS).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
