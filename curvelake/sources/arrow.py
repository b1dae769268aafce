"""In-memory Arrow tables as input, with a declaration of their geometry."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa

from ..functions.batch import simple
from ..functions.wkb import NAMES, header
from .footers import SourceMetadata, parse_type


@dataclass(frozen=True)
class GeometryDeclaration:
    column: str
    types: tuple[str, ...]
    wkid: int


def read(spark, batches: list[pa.RecordBatch] | pa.Table, geometry: GeometryDeclaration):
    """A DataFrame and its metadata. Batches must share a schema, and every geometry must be as declared."""
    t = batches if isinstance(batches, pa.Table) else None
    if t is None:
        if any(not b.schema.equals(batches[0].schema) for b in batches):
            raise ValueError("Arrow batches differ in their schema")
        t = pa.Table.from_batches(batches)
    if geometry.column not in t.schema.names:
        raise ValueError(f"no geometry column {geometry.column!r}")
    allowed = {parse_type(x) for x in geometry.types}
    for chunk in t[geometry.column].chunks:
        rows = chunk.drop_null().to_pylist()
        some = simple(rows)
        for kind, z, m in {(some.kind, some.has_z, some.has_m)} if some else set(map(header, rows)):
            if (NAMES[kind], z, m) not in allowed:
                raise ValueError(f"geometry {NAMES[kind]} is not one of the declared types {', '.join(geometry.types)}")
    return spark.createDataFrame(t), SourceMetadata(len(t), geometry.column, sorted(geometry.types), None, geometry.wkid, True)
