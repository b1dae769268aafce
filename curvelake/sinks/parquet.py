"""Parquet files with footer metadata, page indexes and chosen encodings, written by the tasks and put in place by the driver.

Each task attempt writes files of its own names into a staging folder beside the destination; only files that a finished task reports are moved, so
lost executors and retries leave nothing behind. The destination must be a folder that all executors reach.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..sources.footers import NATIVE_KEY

CODECS = {"snappy": "snappy", "gzip": "gzip", "brotli": "brotli", "lz4": "lz4", "lz4_raw": "lz4", "zstd": "zstd", "uncompressed": "none"}
ROW_GROUP = 131_072


@dataclass(frozen=True)
class FileOptions:
    compression: str = "snappy"
    row_group_size: int = ROW_GROUP
    page_size: int | None = None
    native: bool = False
    #: the geometry column and its EPSG code, written with the GEOMETRY logical type.
    geometry: tuple[str, int] | None = None


class Wkb(pa.ExtensionType):
    """What makes the Parquet writer give a binary column the GEOMETRY type and its row groups bounds. It is registered nowhere: readers see the binary."""

    def __init__(self, wkid: int = 4326) -> None:
        self.wkid = wkid
        super().__init__(pa.binary(), "geoarrow.wkb")

    def __arrow_ext_serialize__(self) -> bytes:
        return json.dumps({"crs": f"srid:{self.wkid}"}).encode()

    @classmethod
    def __arrow_ext_deserialize__(cls, storage, serialized):
        return cls(int(json.loads(serialized)["crs"].removeprefix("srid:")))


def annotated(t: pa.Table, o: FileOptions) -> pa.Table:
    if not o.geometry:
        return t
    name, wkid = o.geometry
    at, kind = t.schema.get_field_index(name), Wkb(wkid)
    chunks = [pa.ExtensionArray.from_storage(kind, c.cast(pa.binary())) for c in t.column(at).chunks]
    return t.set_column(at, pa.field(name, kind), pa.chunked_array(chunks, kind))


def native_schema(schema: StructType) -> dict[str, str]:
    """The entry by which Spark knows the columns: without it, Spark refuses a file with the GEOMETRY type."""
    return {NATIVE_KEY: schema.json()}


def check_codec(name: str) -> str:
    try:
        return CODECS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown compression {name!r}; known: {', '.join(CODECS)}") from None


def prepare(path: str, parts: int | None, overwrite: bool, folder: bool | None = None) -> str:
    """"file" or "folder", by the path's extension; what is there must be of that kind and may be replaced if asked. Nothing is deleted yet."""
    kind = "folder" if folder or (folder is None and not os.path.splitext(path)[1]) else "file"
    if kind == "file" and parts not in (None, 1):
        raise ValueError("a file output has one part; name a folder for more")
    if kind == "folder" and (parts is None or parts < 1):
        raise ValueError("a folder output needs a number of parts")
    if os.path.exists(path):
        if os.path.isdir(path) != (kind == "folder"):
            raise ValueError(f"{path} exists and is of another kind")
        if not overwrite:
            raise FileExistsError(f"{path} exists; pass overwrite")
    return kind


def _leaf_paths(field: pa.Field, prefix: str = "") -> list[tuple[str, pa.DataType]]:
    t, name = field.type, prefix + field.name
    if pa.types.is_struct(t):
        return [p for i in range(t.num_fields) for p in _leaf_paths(t.field(i), name + ".")]
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return _leaf_paths(pa.field("list.element", t.value_type), name + ".")
    return [(name, t)]


def open_writer(path: str, schema: pa.Schema, o: FileOptions) -> pq.ParquetWriter:
    schema = annotated(schema.empty_table(), o).schema
    leaves = [x for f in schema for x in _leaf_paths(f)]
    split = [n for n, t in leaves if o.native and n.startswith("geolod.") and pa.types.is_float64(t)]
    more = {"data_page_size": o.page_size, "write_batch_size": 1} if o.page_size else {}
    return pq.ParquetWriter(
        path, schema, compression=check_codec(o.compression), use_dictionary=[n for n, t in leaves if pa.types.is_string(t) or pa.types.is_large_string(t)], write_page_index=True, data_page_version="2.0",
        use_byte_stream_split=split or False, store_schema=False, **more,
    )


def write(df: DataFrame, staging: str, metadata: dict[str, str], options: FileOptions, partition: str | None = None) -> list[tuple[str, int]]:
    """Writes df's partitions as they are, rows in their order; a new file at each new value of the partition column, which isn't stored. Returns relative paths and rows."""

    kept = df.drop(partition).schema if partition else df.schema
    metadata = metadata | native_schema(kept)

    def run(batches):
        writer, value, path, rows, waiting, size = None, None, None, 0, [], 0

        def put(all_: bool):
            nonlocal waiting, size
            if waiting and (all_ or size >= options.row_group_size):
                t = pa.Table.from_batches(waiting)
                whole = len(t) if all_ else len(t) // options.row_group_size * options.row_group_size
                writer.write_table(annotated(t.slice(0, whole), options), row_group_size=options.row_group_size)
                rest = t.slice(whole)
                waiting, size = rest.to_batches(), len(rest)

        def close():
            put(True)
            writer.add_key_value_metadata(metadata)
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rows], pa.int64())], names=["path", "rows"])

        for b in batches:
            runs = [(None, b)]
            if partition:
                at = b.schema.get_field_index(partition)
                keys = b.column(at).to_pylist()
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                bare = pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at], schema=pa.schema([f for i, f in enumerate(b.schema) if i != at]))
                runs = [(keys[s], bare.slice(s, e - s)) for s, e in zip(cuts[:-1], cuts[1:]) if e > s]
            for key, part in runs:
                if writer is not None and key != value:
                    yield close()
                    writer = None
                if writer is None:
                    folder = f"{partition}={key}/" if partition else ""
                    value, rows, path = key, 0, f"{folder}part-{uuid.uuid4().hex}.parquet"
                    os.makedirs(os.path.join(staging, folder), exist_ok=True)
                    writer = open_writer(os.path.join(staging, path), part.schema, options)
                waiting.append(part)
                size += len(part)
                rows += len(part)
                put(False)
        if writer is not None:
            yield close()

    os.makedirs(staging, exist_ok=True)
    return [tuple(r) for r in df.mapInArrow(run, "path string, rows long").collect()]


def empty_file(path: str, schema: pa.Schema, metadata: dict[str, str], options: FileOptions) -> None:
    w = open_writer(path, schema, options)
    w.add_key_value_metadata(metadata)
    w.close()


def commit(staging: str, files: list[tuple[str, int]], path: str, kind: str) -> None:
    """Puts the reported files in place of what was there. The old output goes only once the new one is whole."""
    if kind == "file":
        (only, _), = files
        os.replace(os.path.join(staging, only), path)
        shutil.rmtree(staging)
        return
    kept = {f for f, _ in files}
    for top, _, names in os.walk(staging):
        for n in names:
            if os.path.relpath(os.path.join(top, n), staging) not in kept:
                os.remove(os.path.join(top, n))
    old = f"{path}.old-{uuid.uuid4().hex}"
    if os.path.exists(path):
        os.rename(path, old)
    os.rename(staging, path)
    shutil.rmtree(old, ignore_errors=True)
