"""GeoPackage as a Spark data source: one layer of a local file, read in ranges of row ids with the standard library's SQLite."""

from __future__ import annotations

import sqlite3

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SAMPLE = 64
_ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def wkb(blob: bytes | None) -> bytes | None:
    """The geometry in a GeoPackage blob; null for an empty one."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    flags = blob[3]
    if flags & 0x10:
        return None
    return bytes(blob[8 + _ENVELOPES[(flags >> 1) & 7] :])


def layers(path: str) -> list[dict]:
    """name, geometry column and type, Z and M, system and number of features of each layer."""
    with _open(path) as db:
        rows = db.execute(
            "SELECT c.table_name, g.column_name, g.geometry_type_name, g.z, g.m, g.srs_id FROM gpkg_contents c JOIN gpkg_geometry_columns g ON c.table_name = g.table_name WHERE c.data_type = 'features' ORDER BY c.table_name"
        ).fetchall()
        return [dict(zip(("name", "geometry", "type", "z", "m", "srs_id"), r)) | {"features": db.execute(f"SELECT count(*) FROM {_q(r[0])}").fetchone()[0]} for r in rows]


def choose(path: str, layer: str | None = None) -> dict:
    """The layer of that name, or the only one."""
    found = layers(path)
    listing = "\n".join(f"- {x['name']} (geometry: {x['type']}, features: {x['features']:,})" for x in found)
    if layer is not None:
        for x in found:
            if x["name"] == layer:
                return x
        raise ValueError(f"no layer {layer!r}; layers:\n{listing}")
    if len(found) != 1:
        raise ValueError(f"choose a layer with --layer; layers:\n{listing}")
    return found[0]


def wkid(path: str, srs_id: int) -> int | None:
    with _open(path) as db:
        row = db.execute("SELECT organization, organization_coordsys_id FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (srs_id,)).fetchone()
    return int(row[1]) if row and str(row[0]).upper() == "EPSG" else None


def sampled_types(path: str, layer: dict) -> list[str]:
    """The layer's type; of a layer of any geometry that of its first features, if they are of one type."""
    from ..functions.wkb import NAMES, header

    named = {n.upper(): n for n in NAMES.values()}
    if layer["type"].upper() in named:
        return [named[layer["type"].upper()]]
    with _open(path) as db:
        rows = db.execute(f"SELECT {_q(layer['geometry'])} FROM {_q(layer['name'])} WHERE {_q(layer['geometry'])} IS NOT NULL LIMIT {SAMPLE}").fetchall()
    kinds = {NAMES[header(g)[0]] for (b,) in rows if (g := wkb(b))}
    return sorted(kinds) if len(kinds) == 1 else []


_TYPES = {"BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "MEDIUMINT": T.IntegerType(), "INT": T.LongType(), "INTEGER": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))
        self.low, self.high = low, high


def splits(path: str, layer: str, parts: int) -> list[tuple[int | None, int | None]]:
    """Half-open ranges of row ids with about equally many rows each; one for a small or odd table."""
    with _open(path) as db:
        n = db.execute(f"SELECT count(*) FROM {_q(layer)}").fetchone()[0]
        if n < 2 or parts < 2:
            return [(None, None)]
        cuts = [db.execute(f"SELECT rowid FROM {_q(layer)} ORDER BY rowid LIMIT 1 OFFSET {n * i // parts}").fetchone()[0] for i in range(1, parts)]
    cuts = sorted(set(cuts))
    return list(zip([None, *cuts], [*cuts, None]))


class _Reader(DataSourceReader):
    def __init__(self, path: str, layer: dict, schema: T.StructType, parts: int):
        self.path, self.layer, self.schema, self.parts = path, layer, schema, parts

    def partitions(self):
        return [_Range(*s) for s in splits(self.path, self.layer["name"], self.parts)]

    def read(self, partition):
        names = [f.name for f in self.schema.fields]
        where = " AND ".join(f"rowid {op} {v}" for op, v in ((">=", partition.low), ("<", partition.high)) if v is not None)
        at = names.index(self.layer["geometry"])
        flags = [i for i, f in enumerate(self.schema.fields) if isinstance(f.dataType, T.BooleanType)]
        with _open(self.path) as db:
            for row in db.execute(f"SELECT {', '.join(map(_q, names))} FROM {_q(self.layer['name'])}" + (f" WHERE {where}" if where else "") + " ORDER BY rowid"):
                row = list(row)
                row[at] = wkb(row[at])
                for i in flags:
                    row[i] = None if row[i] is None else bool(row[i])
                yield tuple(row)


class GeoPackage(DataSource):
    """spark.read.format("geopackage").option("path", ...).option("layer", ...).option("splits", ...): a layer's columns without its row id, the geometry as WKB."""

    @classmethod
    def name(cls):
        return "geopackage"

    def _layer(self) -> dict:
        return choose(self.options["path"], self.options.get("layer"))

    def schema(self):
        x = self._layer()
        with _open(self.options["path"]) as db:
            cols = db.execute(f"PRAGMA table_info({_q(x['name'])})").fetchall()
        fields = []
        for _, name, kind, _, _, key in cols:
            if key:
                continue
            base = kind.upper().split("(")[0].strip()
            fields.append(T.StructField(name, T.BinaryType() if name == x["geometry"] else _TYPES.get(base, T.StringType())))
        return T.StructType(fields)

    def reader(self, schema):
        return _Reader(self.options["path"], self._layer(), schema, int(self.options.get("splits", "8")))


def read(spark, path: str, layer: str | None = None, parts: int = 8):
    spark.dataSource.register(GeoPackage)
    r = spark.read.format("geopackage").option("path", path).option("splits", str(parts))
    return (r.option("layer", layer) if layer else r).load()


