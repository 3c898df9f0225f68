"""python -m tidemark.cli INPUT OUTPUT --timeframes H1 H4 --methods ofi adx: regimes of a file of ticks or bars."""

from __future__ import annotations

import argparse
import json
import sys

from tidemark import __version__, config
from tidemark.operators import bars as B
from tidemark.operators import report
from tidemark.operators.context import uniform
from tidemark.operators.detectors import REGISTRY
from tidemark.schema import TIMEFRAMES, InputError
from tidemark.session import local_session
from tidemark.sources import tables as T


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?")
    p.add_argument("--timeframes", nargs="+", default=["H1"], type=str.upper)
    p.add_argument("--methods", nargs="+", default=[n for n, d in REGISTRY.items() if d.availability == "bar_close"], choices=list(REGISTRY))
    p.add_argument("--source-timeframe", default=None)
    p.add_argument("--asset")
    p.add_argument("--side", default="bid", choices=["bid", "ask", "mid"])
    p.add_argument("--fill-seconds", type=int)
    p.add_argument("--profile")
    p.add_argument("--allow-lookahead", action="store_true")
    p.add_argument("--show-config", action="store_true")
    p.add_argument("--report", action="store_true", help="write a text report of the labels too")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        frames = list(dict.fromkeys(args.timeframes))
        if odd := [t for t in frames if t not in TIMEFRAMES]:
            raise InputError(f"unknown timeframes: {', '.join(odd)}")
        profile = config.load(open(args.profile).read(), args.profile) if args.profile else None
        chosen = {(m, t): config.resolve(m, t, profile) for m in args.methods for t in frames}
        if args.show_config:
            print(json.dumps({f"{m}.{t}": {"values": v, "origin": o} for (m, t), (v, o) in chosen.items()}, indent=1))
            return 0
        if not args.input or not args.output:
            print("an input and an output are needed", file=sys.stderr)
            return 2
        spark = local_session("*", 8)
        loaded = T.load(spark, args.input, asset=args.asset, side=args.side, timeframe=args.source_timeframe, fill_seconds=args.fill_seconds)
        out = []
        for t in frames:
            bars = loaded.df if t == loaded.meta.timeframe else B.resample(loaded.df, loaded.meta.timeframe or "M1", t)
            for m in args.methods:
                values, _ = chosen[m, t]
                found = REGISTRY[m].detect(bars, t, allow_lookahead=args.allow_lookahead, **values)
                out.append(uniform(found, REGISTRY[m], params_hash=config.params_hash(m, values), parameters=values, price_side=args.side, source=args.input))
        T.write_long(out, f"{args.output}/regimes.parquet")
        T.write_meta(spark, f"{args.output}/run_meta.json", {"version": __version__, "asset": loaded.meta.asset, "timeframes": frames, "methods": {f"{m}.{t}": {"values": v, "origin": o} for (m, t), (v, o) in chosen.items()}})
        if args.report:
            T.write_text(spark, f"{args.output}/report.txt", report.full(spark.read.parquet(f"{args.output}/regimes.parquet")))
        return 0
    except (InputError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
