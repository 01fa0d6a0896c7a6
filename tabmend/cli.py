"""The command line: python -m tabmend -i INPUT -o OUTPUT -f FORMAT -t TARGET."""

from __future__ import annotations

import argparse
import sys

from tabmend.options import ConversionError, Options


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabmend", description="Repair and convert tabular files on Spark.")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", default="output")
    p.add_argument("-f", "--format", default="csv")
    p.add_argument("-t", "--target", default="sqlite")
    p.add_argument("-d", "--delimiter")
    p.add_argument("-e", "--encoding")
    p.add_argument("--fallback-encoding")
    p.add_argument("--no-headers", action="store_true", default=None)
    p.add_argument("--columns")
    p.add_argument("--no-quote", dest="quoting", action="store_false", default=None)
    p.add_argument("--no-repair", dest="repair", action="store_false", default=None)
    p.add_argument("--trailing-delimiter", action="store_true", default=None)
    p.add_argument("--join-lines", action="store_true", default=None)
    p.add_argument("--realign", action="store_true", default=None)
    p.add_argument("--fix-mojibake", nargs="?", const="windows-1252")
    p.add_argument("--trim")
    p.add_argument("--max-field", type=int)
    p.add_argument("--strict", action="store_true", default=None)
    p.add_argument("--infer-types", action="store_true", default=None)
    p.add_argument("--infer-rows", type=int)
    p.add_argument("-n", "--table")
    p.add_argument("-x", "--drop-table", action="store_true", default=None)
    p.add_argument("--sqlite-mode", choices=["fts5", "typed"])
    p.add_argument("--codec")
    p.add_argument("--level", type=int)
    p.add_argument("--row-group", type=int)
    p.add_argument("--single-file", action="store_true", default=None)
    p.add_argument("--count", action="store_true", default=None)
    p.add_argument("--doctor", action="store_true")
    p.add_argument("--no-auto-fix", action="store_true")
    p.add_argument("--progress", action="store_true", help="show Spark's job progress")
    p.add_argument("--log-level", choices=["ERROR", "WARN", "INFO", "DEBUG"], default="WARN")
    p.add_argument("-y", "--yes", action="store_true", help="do not ask after the preview")
    return p


_OWN = {"input", "output", "format", "target", "doctor", "no_auto_fix", "progress", "log_level", "yes"}


def options_of(args: argparse.Namespace) -> Options:
    given = {k: v for k, v in vars(args).items() if k not in _OWN and v is not None}
    return Options(**given, explicit=set(given))


def main(argv: list[str] | None = None, spark=None, ask=input) -> int:
    """0: clean; 2: something was repaired, dropped or did not fit; 1: an error."""
    argv = sys.argv[1:] if argv is None else argv
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from tabmend.plans.convert import convert
    from tabmend.plans.doctor import apply_safe, examine, suggested_command

    try:
        options = options_of(args)
        spark = spark or SparkSession.builder.appName("tabmend").config("spark.ui.showConsoleProgress", str(args.progress).lower()).getOrCreate()
        spark.sparkContext.setLogLevel(args.log_level)
        if args.doctor:
            report = examine(spark, args.input, options)
            for f in report.findings:
                print(f"{f.level}: {f.message}")
            _, rest = apply_safe(options, report, auto=False)
            print(suggested_command(["tabmend", *argv], rest))
            return 0
        if args.format in ("csv", "txt") and not args.no_auto_fix:
            options, _ = apply_safe(options, examine(spark, args.input, options))

        def confirm(preview) -> bool:
            preview.show(truncate=32)
            return args.yes or ask("Continue? [Y/n] ").strip().lower() in ("", "y", "yes")

        outcome = convert(spark, args.input, args.output, args.format, args.target, options, confirm)
    except ConversionError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    if outcome is None:
        print("nothing was written")
        return 0
    for message in outcome.messages:
        print(f"warning: {message}", file=sys.stderr)
    print(f"{outcome.metrics.rows} rows written to {outcome.path}; {outcome.metrics.counts}")
    return outcome.metrics.exit_code
