"""The JSON that output footers carry: `geo` and `geodisplay`."""

from __future__ import annotations

import json

from .. import __version__
from ..functions.curves import Extent
from ..functions.lod import Level

#: Fixed values of the file format: versions, and the names that encodings have in it.
VERSION, GEO_VERSION, WRITER = "0.1", "2.0.0", "curvelake"
ENCODINGS = {"pbf": "esriPBF", "wkb": "wkb", "native": "native"}

#: PROJJSON of the two systems that are written.
CRS = {
    4326: {
        "$schema": "https://proj.org/schemas/v0.7/projjson.schema.json", "type": "GeographicCRS", "name": "WGS 84",
        "datum": {"type": "GeodeticReferenceFrame", "name": "World Geodetic System 1984", "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563}},
        "coordinate_system": {"subtype": "ellipsoidal", "axis": [{"name": "Longitude", "abbreviation": "lon", "direction": "east", "unit": "degree"}, {"name": "Latitude", "abbreviation": "lat", "direction": "north", "unit": "degree"}]},
        "id": {"authority": "EPSG", "code": 4326},
    },
    3857: {
        "$schema": "https://proj.org/schemas/v0.7/projjson.schema.json", "type": "ProjectedCRS", "name": "WGS 84 / Pseudo-Mercator",
        "base_crs": {"name": "WGS 84", "datum": {"type": "GeodeticReferenceFrame", "name": "World Geodetic System 1984", "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563}}},
        "conversion": {"name": "Popular Visualisation Pseudo-Mercator", "method": {"name": "Popular Visualisation Pseudo Mercator", "id": {"authority": "EPSG", "code": 1024}}},
        "coordinate_system": {"subtype": "Cartesian", "axis": [{"name": "Easting", "abbreviation": "X", "direction": "east", "unit": "metre"}, {"name": "Northing", "abbreviation": "Y", "direction": "north", "unit": "metre"}]},
        "id": {"authority": "EPSG", "code": 3857},
    },
}


def typed(name: str, z: bool, m: bool) -> str:
    return name + (" " + "Z" * z + "M" * m if z or m else "")


def geo(column: str, types: list[str], wkid: int, bbox: list[float] | None, covering: bool, ordering: dict | None = None, lod: dict | None = None) -> dict:
    col: dict = {"encoding": "WKB", "geometry_types": types, "crs": CRS[wkid]}
    if bbox:
        col["bbox"] = bbox
    if covering:
        col["covering"] = {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    out: dict = {"version": GEO_VERSION, "primary_column": column, "columns": {column: col}}
    return out | ({"ordering": ordering} if ordering else {}) | ({"lod": lod} if lod else {})


def _common(kind: str, wkid: int, extent: Extent | None) -> dict:
    out = {"type": kind, "version": VERSION, "writer": {"name": WRITER, "version": __version__}, "code": "geokey", "wkid": wkid}
    if extent:
        out["fullExtent"] = dict(zip(("xmin", "ymin", "xmax", "ymax"), extent.as_list()))
    return out


def display_z(wkid: int, extent: Extent | None, depth: int, has_z: bool, has_m: bool) -> dict:
    out = _common("z", wkid, extent) | {"xColumn": ["sop_geometry", "x"], "yColumn": ["sop_geometry", "y"], "coordinatePrecision": depth, "geometryType": "point", "hasZ": has_z, "hasM": has_m}
    return out | ({"zColumn": ["sop_geometry", "z"]} if has_z else {}) | ({"mColumn": ["sop_geometry", "m"]} if has_m else {})


def transform(x: Level) -> dict:
    return {"scale": [x.resolution, x.resolution, 0.0001, 0.0001], "translate": [0.0, 0.0, 0.0, 0.0]}


def display_xz(wkid: int, extent: Extent | None, depth: int, family: str, encoding: str, levels: list[Level], has_z: bool, has_m: bool) -> dict:
    stored = [
        {"column": ["geolod", x.column], "level": x.level, "resolution": x.resolution, "scale": x.scale, "transform": transform(x)} for x in levels
    ]
    return _common("xz", wkid, extent) | {"encoding": ENCODINGS[encoding], "geometryType": family, "maxLevel": depth, "hasZ": has_z, "hasM": has_m, "levels": stored}


def ordering(kind: str, column: str, extent: Extent, depth: int) -> dict:
    return {"type": kind, "geometry_column": column, "extent": extent.as_list()} | ({"bit_width": depth} if kind == "z" else {"max_level": depth})


def lod(family: str, column: str, levels: list[Level]) -> dict:
    stored = [{"column": ["geolod", x.column], "resolution": x.resolution, "transform": transform(x)} for x in levels]
    return {"geometry_column": column, "encoding": "pbf"} | ({"orientation": "clockwise"} if family == "polygon" else {}) | {"levels": stored}


def dumps(v: dict) -> str:
    return json.dumps(v, separators=(",", ":"))
