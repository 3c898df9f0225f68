"""Forward targets of bars on their expected grid: a hole never shortens a horizon."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators.bars import on_grid
from tidemark.operators.detectors import validity
from tidemark.schema import KEYS, InputError

EXCURSIONS = ("mfe_long", "mae_long", "mfe_short", "mae_short")
EXTREMES = ("close_min", "close_max", "dd", "ru")
FAMILIES = ("ret", "vol", *EXTREMES, *EXCURSIONS, *(f"time_{x}" for x in EXCURSIONS))


def parse(name: str) -> tuple[str, int]:
    """Family and horizon of a target's name, such as ret_fwd_5."""
    found = re.fullmatch(r"([a-z_]+)_fwd_(\d+)", name)
    if not found or found[1] not in FAMILIES:
        raise InputError(f"{name!r} is no target; families: {', '.join(FAMILIES)}")
    horizon = int(found[2])
    if horizon < (2 if found[1] == "vol" else 1):
        raise InputError(f"{name!r}: the horizon is too short")
    return found[1], horizon


def _path(family: str, k: int) -> tuple[str, bool, int]:
    """Column of the path, whether its greatest value counts, and the sign."""
    return {"mfe_long": ("high", True, 1), "mae_long": ("low", False, 1), "mfe_short": ("low", False, -1), "mae_short": ("high", True, -1)}[family]


def expression(family: str, k: int) -> Column:
    """A target from rows 0 to k of a full grid."""
    close = F.col("close")
    if family == "ret":
        return F.ln(F.try_divide(W.lead("close", k), close))
    if family == "vol":
        return F.stddev_samp("__ret").over(W.ahead(k))
    if family in EXTREMES:
        f = F.min if family in ("dd", "close_min") else F.max
        return F.try_divide(f("close").over(W.ahead(k, True)), close) - 1
    column, greatest, sign = _path(family.removeprefix("time_"), k)
    if family.startswith("time_"):
        # the start counts as step 0, so a bar must go strictly beyond the close and what came before
        steps = [F.struct((F.col("close") if j == 0 else W.lead(column, j)).alias("v"), F.lit(j).alias("j")) for j in range(k + 1)]
        path = F.array(*steps)
        best = F.aggregate(path, path[0], lambda a, x: F.when((x["v"] > a["v"]) if greatest else (x["v"] < a["v"]), x).otherwise(a))
        return best["j"].cast("double")
    end = (F.greatest(close, F.max(column).over(W.ahead(k))) if greatest else F.least(close, F.min(column).over(W.ahead(k)))) / close - 1
    return sign * end


def forward(bars: DataFrame, timeframe: str, names: list[str]) -> DataFrame:
    """keys, ts, and each target with the time at which it is known (<target>_end); null where any of its bars is missing or not valid."""
    grid = on_grid(bars, timeframe)
    grid = grid.withColumn("__ok", (F.col("present") & validity(grid)).cast("int")).withColumn("__ret", W.log_return())
    out, made = grid, []
    for name in names:
        family, k = parse(name)
        whole = F.sum("__ok").over(W.ahead(k, True)) == k + 1
        out = out.withColumn(name, F.when(whole, expression(family, k))).withColumn(f"{name}_end", F.when(whole, W.lead("ts", k)))
        made += [name, f"{name}_end"]
    return out.filter("present").select(*KEYS, "ts", *made)
