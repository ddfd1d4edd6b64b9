"""File systems that Python tasks reach by themselves."""

from __future__ import annotations

import re

from pyarrow import fs

# Schemes with a pyarrow file system; paths in other stores are for Spark's own readers.
REACHED = ("file", "hdfs", "s3", "gs")


def reached(path: str) -> bool:
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", path)
    return scheme is None or scheme[1] in REACHED


def store(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path within it, and what to put before such a path to name it again."""
    if not reached(path):
        raise ValueError(f"not in a store that Python tasks reach: {path}")
    local = re.sub(r"^file:/+", "/", path)
    if "://" not in local:
        if not local.startswith("/"):
            raise ValueError(f"not an absolute path: {path}")
        return fs.LocalFileSystem(), local, "file://"
    system, inside = fs.FileSystem.from_uri(local)
    scheme, rest = local.split("://", 1)
    # hdfs names a host outside its paths, object stores have the bucket in them
    host = rest.split("/", 1)[0] if scheme == "hdfs" else ""
    return system, inside, f"{scheme}://{host}"
