"""Which format an input has, and which files it is made of."""

from __future__ import annotations

import os
import re
from urllib.parse import urlparse

FORMATS = {"gpkg": "gpkg", "geopackage": "gpkg", "parquet": "parquet", "geoparquet": "parquet"}


def parse_format(name: str) -> str:
    try:
        return FORMATS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown input format {name!r}; known: {', '.join(FORMATS)}") from None


def resolve_format(location: str, override: str | None = None) -> str:
    """An override first; a local folder is Parquet; else the extension, of a URL's path without its query."""
    if override:
        return parse_format(override)
    if os.path.isdir(location):
        return "parquet"
    path = urlparse(location).path if "://" in location else location
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    if ext in FORMATS:
        return FORMATS[ext]
    raise ValueError(f"cannot tell the format of {location}; pass --input-format")


def parquet_files(location: str, recursive: bool = False) -> list[str]:
    """Sorted .parquet files of a folder (symbolic links aren't followed), or the one file."""
    if not os.path.isdir(location):
        return [location]
    found = []
    for top, dirs, names in os.walk(location):
        if not recursive:
            dirs.clear()
        dirs[:] = [d for d in dirs if not os.path.islink(os.path.join(top, d))]
        found += [p for n in names if n.lower().endswith(".parquet") and not os.path.islink(p := os.path.join(top, n))]
    if not found:
        raise FileNotFoundError(f"no Parquet files in {location}")
    return sorted(found)


def partition_of(path: str, root: str) -> tuple[str, int] | None:
    """Family and lower bound that a path's folder names, z_order=<n> or xz_order=<n>; more than one is an error."""
    parts = re.findall(r"(?:^|/)(z_order|xz_order)=([^/]*)(?=/)", "/" + os.path.relpath(path, root))
    if len(parts) > 1:
        raise ValueError(f"more than one partition folder in {path}")
    return (parts[0][0].removesuffix("_order"), int(parts[0][1])) if parts else None
