"""Command line: analyse a bar table and write its tables, or compare strategies over recent windows."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidegauge.config import Config, available_profiles, with_profile
from tidegauge.plans import walk_forward
from tidegauge.plans.analysis import Engine, Overlays
from tidegauge.sources import sinks
from tidegauge.sources.bars import requested


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidegauge", description=__doc__)
    parser.add_argument("bars", help="path of the bars (symbol, ts, open, high, low, close, volume)")
    parser.add_argument("--symbols", nargs="*")
    parser.add_argument("--start")
    parser.add_argument("--end")
    parser.add_argument("--period", help="without --start: how far back from --end, or from now, as 3mo or 1y")
    parser.add_argument("--profile", choices=available_profiles())
    parser.add_argument("--source-type", choices=("auto", "stock", "crypto"), default="auto", help="which defaults: by each symbol's form, or one for all")
    parser.add_argument("--crypto", action="store_const", const="crypto", dest="source_type", help="as --source-type crypto")
    parser.add_argument("--vol-quotes", help="path of bars of volatility indices, the second channel of --markov")
    parser.add_argument("--vol-tolerance", type=int, default=0, metavar="DAYS", help="how old a quote may be")
    parser.add_argument("--horizons", nargs="+", type=int, default=[5, 10])
    for overlay in ("adaptive", "ewma", "markov", "consensus"):
        parser.add_argument(f"--{overlay}", action="store_true")
    parser.add_argument("--bocpd", choices=("standard", "dsm"))
    parser.add_argument("--min-dwell", type=int, default=1)
    parser.add_argument("--no-fuzzy", action="store_true")
    parser.add_argument("--output", help="folder for the tables")
    parser.add_argument("--walk-forward", metavar="GROUP=SYMBOL,...", nargs="*", help="compare strategies over recent windows")
    parser.add_argument("--cost-bps", type=float, default=5.0)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    from dataclasses import replace

    requested(args.period, args.start, args.end)
    if args.vol_quotes and not (args.markov or args.consensus):
        raise ValueError("--vol-quotes needs --markov or --consensus")

    def configured(cfg: Config) -> Config:
        return replace(with_profile(cfg, args.profile) if args.profile else cfg, horizons=tuple(args.horizons), min_dwell=args.min_dwell)

    cfg, crypto = configured(Config()), configured(Config.crypto())
    spark = SparkSession.builder.appName("tidegauge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, crypto if args.source_type == "crypto" else cfg)
    bars = engine.read(args.bars, required=True, symbols=args.symbols, start=args.start, end=args.end, period=args.period)
    overlays = Overlays(not args.no_fuzzy, args.adaptive, args.ewma, args.markov, args.bocpd, args.consensus)
    channel = {"quotes": engine.read(args.vol_quotes), "tolerance_days": args.vol_tolerance} if args.vol_quotes else {}
    if args.source_type == "auto":
        analysed = engine.analyse_by_source(bars, crypto, overlays, **channel).persist()
    else:
        analysed = engine.analyse(bars, overlays, **channel).persist()
    tables = engine.summaries(analysed)
    if args.walk_forward is not None:
        groups = {g: tuple(m.split(",")) for g, m in (x.split("=", 1) for x in args.walk_forward)}
        found = walk_forward.report(analysed, groups, cost_bps=args.cost_bps)
        tables |= {"walk_forward": found["comparison"], "walk_forward_summary": found["summary"]}
        tables["walk_forward_promotion"] = found["promotion"].withColumn("reasons", F.array_join("reasons", "; "))
    print(sinks.report(tables))
    if args.output:
        sinks.export_all(tables, analysed, args.output, not args.no_fuzzy)


if __name__ == "__main__":
    main()
