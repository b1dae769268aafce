"""Command line: write, validate, query."""

from __future__ import annotations

import argparse
import json
import sys

from .functions.curves import Extent


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="curvelake", description="Prepare, check and query vector datasets stored as Parquet.")
    sub = p.add_subparsers(dest="command", required=True)
    w = sub.add_parser("write", help="rewrite a dataset")
    w.add_argument("input")
    w.add_argument("--input-format")
    w.add_argument("-o", "--output", required=True)
    w.add_argument("-p", "--partitions", type=int)
    w.add_argument("--memory", type=int, help="GiB for Spark")
    w.add_argument("--sort-concurrency", type=int, help="shuffle partitions")
    w.add_argument("--cores", type=int)
    w.add_argument("--compression", default="snappy")
    w.add_argument("--start", type=int, default=0)
    w.add_argument("--num", type=int)
    w.add_argument("-l", "--layer")
    w.add_argument("--geometry-column")
    w.add_argument("--in-sr", type=int)
    w.add_argument("--out-sr", type=int, default=4326)
    w.add_argument("--normalization-extent", help="xmin,ymin,xmax,ymax")
    w.add_argument("--cluster-depth", type=int, default=20)
    w.add_argument("--covering", action="store_true")
    w.add_argument("--strip-z", action="store_true")
    w.add_argument("--strip-m", action="store_true")
    w.add_argument("-w", "--overwrite", action="store_true")
    w.add_argument("--row-group-size", type=int, default=131_072)
    w.add_argument("--page-size", type=int)
    w.add_argument("--no-progress", action="store_true")
    w.add_argument("--no-optimization", action="store_true")
    w.add_argument("--no-write-sop", action="store_true", help="leave out the display metadata")
    w.add_argument("--write-extensions", action="store_true")
    w.add_argument("--multiscale-encoding", choices=("pbf", "wkb", "native"), default="pbf")
    v = sub.add_parser("validate", help="check a dataset")
    v.add_argument("input")
    v.add_argument("--full", action="store_true", help="check every geometry")
    q = sub.add_parser("query", help="features in a viewport, as GeoJSON lines")
    q.add_argument("input")
    q.add_argument("--extent", required=True, help="west,south,east,north")
    q.add_argument("--zoom", type=float, default=10)
    q.add_argument("--limit", type=int, default=650_000)
    return p


def numbers(text: str) -> Extent:
    try:
        v = [float(x) for x in text.split(",")]
        return Extent(*v)
    except (TypeError, ValueError):
        raise ValueError(f"expected four numbers, found {text!r}") from None


def session(args):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.appName("curvelake").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.caseSensitive", "true")
    if getattr(args, "cores", None):
        b = b.master(f"local[{args.cores}]")
    if getattr(args, "memory", None):
        b = b.config("spark.driver.memory", f"{args.memory}g")
    if getattr(args, "sort_concurrency", None):
        b = b.config("spark.sql.shuffle.partitions", args.sort_concurrency)
    b = b.config("spark.ui.showConsoleProgress", str(not getattr(args, "no_progress", True)).lower())
    return b.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "write":
            from .plans.convert import InputOptions, OutputOptions, convert

            if args.num is not None and args.num < 1:
                raise ValueError("--num must be 1 or more")
            i = InputOptions(args.input, args.input_format, args.start, args.num, args.layer, args.geometry_column, args.in_sr)
            o = OutputOptions(
                args.output, not args.no_optimization, args.partitions, args.compression, args.row_group_size, args.page_size, args.out_sr, numbers(args.normalization_extent) if args.normalization_extent else None, args.cluster_depth,
                args.covering, args.overwrite, args.strip_z, args.strip_m, args.multiscale_encoding, not args.no_write_sop, args.write_extensions,
            )
            got = convert(session(args), i, o)
            for x in got.warnings:
                print(f"warning: {x}", file=sys.stderr)
            print(f"{got.rows_written} of {got.rows_expected} rows in {len(got.files)} files")
        elif args.command == "validate":
            from .plans.validate import validate

            r = validate(session(args), args.input, "full" if args.full else "sample")
            print(r.text(), file=sys.stderr if r.has_errors() else sys.stdout)
            return int(r.has_errors())
        else:
            from .operators.query import viewport

            e = numbers(args.extent)
            rows, limited = viewport(session(args), args.input, (e.xmin, e.ymin, e.xmax, e.ymax), args.zoom, args.limit)
            for x in rows.toLocalIterator():
                print(json.dumps({"type": "Feature", "geometry": json.loads(x["geojson"]), "properties": {}}))
            if limited:
                print("the limit was met", file=sys.stderr)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
