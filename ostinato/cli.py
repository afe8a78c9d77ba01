"""Command line: preprocess, dct, and the instrument formatters.

usage: python -m ostinato.cli preprocess INPUT OUTPUT -w WellName -t Timepoint
"""

from __future__ import annotations

import argparse
import logging

from .plans.dct import dct_process_file
from .plans.preprocess import preprocess_to_clean_signal
from .session import build_session
from .sources.envision import format_envision
from .sources.harmony import process_harmony


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="ostinato", description=__doc__)
    commands = root.add_subparsers(dest="command", required=True)

    pre = commands.add_parser("preprocess", help="summarise cells and detrend the summaries")
    pre.add_argument("input")
    pre.add_argument("output", help="ends in .parquet or .csv")
    pre.add_argument("-w", "--wellname", action="append", required=True, help="well column; may be repeated")
    pre.add_argument("-t", "--timepoint", required=True)
    pre.add_argument("--window", type=int, default=8, help="timepoints of the moving average")
    pre.add_argument("-f", "--format", action="store_true", help="only summarise")

    dct = commands.add_parser("dct", help="detect periods with a discrete cosine transform")
    dct.add_argument("data")
    dct.add_argument("platemap")
    dct.add_argument("outdir")
    dct.add_argument("-w", "--well", required=True)
    dct.add_argument("-t", "--timepoint", required=True)
    dct.add_argument("-e", "--expression", required=True)
    dct.add_argument("-g", "--groupings", action="append", required=True, help="platemap column; may be repeated")
    dct.add_argument("-i", "--interval", type=float, default=1.0, help="hours between reads")
    dct.add_argument("--period-min", type=float, default=16)
    dct.add_argument("--period-max", type=float, default=48)

    formats = commands.add_parser("formatter", help="bring instrument exports into one form")
    kinds = formats.add_subparsers(dest="kind", required=True)
    envision = kinds.add_parser("envision")
    envision.add_argument("input")
    envision.add_argument("output")
    envision.add_argument("-s", "--sampling-interval", type=float, default=1.0)
    harmony = kinds.add_parser("harmony")
    harmony.add_argument("input")
    harmony.add_argument("outdir")
    harmony.add_argument("-t", "--timepoint", required=True)
    harmony.add_argument("-s", "--sampling-interval", type=float, required=True)
    harmony.add_argument("--header-index", type=int, default=9)
    harmony.add_argument("-i", "--intermediate")
    harmony.add_argument("--replace", action="store_true", help="empty the output folder first")
    return root


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s - [%(levelname)s]: %(message)s")
    spark = build_session(f"ostinato-{args.command}")
    if args.command == "preprocess":
        preprocess_to_clean_signal(
            spark, args.input, args.wellname, args.timepoint, args.output, not args.format, args.window
        )
    elif args.command == "dct":
        dct_process_file(
            spark,
            args.data,
            args.platemap,
            args.outdir,
            args.well,
            args.timepoint,
            args.expression,
            args.groupings,
            args.interval,
            (args.period_min, args.period_max),
        )
    elif args.kind == "envision":
        for gap in format_envision(spark, args.input, args.output, args.sampling_interval).collect():
            logging.info(
                "between %s (%sh) and %s (%sh) are missing: %s",
                gap.after_file,
                gap.after_hour,
                gap.before_file,
                gap.before_hour,
                gap.missing_hours,
            )
    else:
        process_harmony(
            spark,
            args.input,
            args.outdir,
            args.timepoint,
            args.sampling_interval,
            args.header_index,
            args.intermediate,
            args.replace,
        )


if __name__ == "__main__":
    main()
