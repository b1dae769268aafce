"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], then rewrites of wide inputs of $BENCH_INPUT_MIB each (512 is the suite's own size; 0 leaves them out); prints one JSON line."""

import json
import os
import struct
import sys
import tempfile
import time

REPO = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from curvelake.functions import columns as C  # noqa: E402
from curvelake.plans import convert, registry  # noqa: E402
from curvelake.sources.footers import SourceMetadata  # noqa: E402

HEADLINE = [
    "point_z_code", "bbox_xz_code", "dataset_extent", "z_clustered_order", "partition_sorted_check", "quantized_points", "collinear_merge_counts", "pbf_roundtrip", "viewport_xz_query",
    "viewport_antimeridian", "viewport_z_query", "viewport_lod_features", "wkb_point_roundtrip", "wkb_bounds", "web_mercator_points", "code_order_violations", "range_overlaps", "row_group_focus_extent",
]


def rewrite(spark, sf_dir: str, kind: str, parts: int | None) -> int:
    """A whole rewrite: keys, order, levels and files."""
    if kind == "points":
        df = registry.points(spark, sf_dir).select("id", C.make_point(F.col("x"), F.col("y")).alias("geometry"))
        types = ["Point"]
    else:
        df = registry.boxes(spark, sf_dir).select("id", C.make_box(*registry.box_columns().values()).alias("geometry"))
        types = ["Polygon"]
    with tempfile.TemporaryDirectory() as d:
        src = os.path.join(d, "in")
        df.write.parquet(src)
        source = spark.read.parquet(src)
        meta = SourceMetadata(source.count(), "geometry", types, None, 4326, True)
        o = convert.OutputOptions(os.path.join(d, "out" if parts else "out.parquet"), parts=parts, covering=True, overwrite=True)
        i = convert.InputOptions(src)
        return convert._write(spark, convert.resolve(source, meta, i), meta, i, o, meta.rows).rows_written


SEED = 0x5A171A1CD15C0DE5  # fixed value of the suite


def shapes_of(kind: str):
    """Adds the geometry of each id: a point, or a closed ring of 64 sides."""
    turn = np.linspace(0, 2 * np.pi, 65)
    turn[-1] = 0.0

    def run(batches):
        for b in batches:
            i = b.column(0).to_numpy()
            x, y = -179 + (i * 37 % 358000) / 1000, -89 + (i * 53 % 178000) / 1000
            at = np.stack([x, y], -1)[:, None, :]
            head = struct.pack("<BI", 1, 1)
            if kind == "polygon":
                r = (0.005 + i % 16 * 0.0005)[:, None, None]
                at, head = at + r * np.stack([np.cos(turn), np.sin(turn)], -1), struct.pack("<BIII", 1, 3, 1, 65)
            body = np.ascontiguousarray(at, "<f8").reshape(len(i), -1).view(np.uint8)
            whole = np.concatenate([np.broadcast_to(np.frombuffer(head, np.uint8), (len(i), len(head))), body], 1)
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(whole.shape[1]), len(i), [None, pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), fixed.cast(pa.binary())], names=["id", "geometry"])

    return run


def suite_input(spark, kind: str, wide: bool, mib: int, path: str) -> int:
    """Writes an uncompressed input of about that size, attributes mixed from ids; returns its bytes."""
    numbers, texts = (185, 21) if wide else (45, 5)
    row = 8 + numbers * 8 + texts * 24 + (1053 if kind == "polygon" else 21)
    df = spark.range(max(8192, mib * 2**20 // row), numPartitions=spark.sparkContext.defaultParallelism).mapInArrow(shapes_of(kind), "id long, geometry binary")
    mixed = [(F.xxhash64("id", F.lit(SEED + k)) / 2.0**40).alias(f"value_{k:02}") for k in range(numbers)]
    said = [F.concat(F.lit("text "), F.hex(F.xxhash64("id", F.lit(SEED - 1 - k)))).alias(f"text_{k:02}") for k in range(texts)]
    df.select("id", *mixed, *said, "geometry").write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))


def suite(spark, mib: int) -> dict[str, dict[str, float]]:
    """Input MiB a second of whole rewrites, one of each: snappy, covering, default depth."""
    out = {}
    for name, kind, wide, cases in (("point", "point", False, (None, 8)), ("polygon", "polygon", False, (None, 8)), ("polygon_wide_4x", "polygon", True, (None,))):
        with tempfile.TemporaryDirectory() as d:
            src = os.path.join(d, "in")
            size = suite_input(spark, kind, wide, mib, src) / 2**20
            for parts in cases:
                o = convert.OutputOptions(os.path.join(d, "out" if parts else "out.parquet"), parts=parts, covering=True, overwrite=True)
                t = time.time()
                convert.convert(spark, convert.InputOptions(src, geometry_column="geometry", in_sr=4326), o)
                took = time.time() - t
                out[f"{name}/optimized_{'partitioned_8' if parts else 'single'}"] = {"sec": round(took, 2), "input_mib": round(size, 1), "mib_per_sec": round(size / took, 2)}
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, took = registry.queries(), {}
    runs = {n: (lambda f=found[n]: f(spark, sf_dir).write.format("noop").mode("overwrite").save()) for n in HEADLINE}
    runs |= {f"rewrite_{k}_{'single' if not p else p}": (lambda k=k, p=p: rewrite(spark, sf_dir, k, p)) for k in ("points", "polygons") for p in (None, 8)}
    found["dataset_extent"](spark, sf_dir).collect()  # start the workers
    for name, run in runs.items():
        t = time.time()
        run()
        took[name] = round(time.time() - t, 3)
    mib = int(os.environ.get("BENCH_INPUT_MIB", "128"))
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "writer": suite(spark, mib) if mib else {}}))


if __name__ == "__main__":
    main()
