"""What lies in a folder, from its listing alone, and tables that change in one step.

Listings go through Hadoop's file system, so a folder may lie in any store Spark reads. A
manifest names the folders that make up a state. Its versions are numbered, a version is
written beside its place and renamed into it, and a rename never replaces: of two writers of
one version one fails, and a reader sees the old state or the new one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

MANIFEST = "_manifest"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, root: str) -> list[str]:
    """Names of the entries of a folder, sorted; none where there is no folder."""
    files = _files(spark, root)
    if not files.exists(_path(spark, root)):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(_path(spark, root)))


def partition_values(spark: SparkSession, root: str, column: str) -> list[str]:
    """The values of a partition column, from the names of its folders."""
    head = f"{column}="
    return [n.removeprefix(head) for n in names(spark, root) if n.startswith(head)]


def delete(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


@dataclass(frozen=True)
class Manifest:
    version: int
    entries: dict


def _versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in names(spark, f"{root}/{MANIFEST}") if n.endswith(".json")]


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """The newest state, or that of a version; version -1 is the empty state."""
    versions = _versions(spark, root)
    if not versions:
        return Manifest(-1, {})
    version = versions[-1] if version is None else version
    path = f"{root}/{MANIFEST}/{version:012d}.json"
    stream = _files(spark, path).open(_path(spark, path))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(version, json.loads(text))


def commit(spark: SparkSession, root: str, after: Manifest, entries: dict) -> Manifest:
    """Make ``entries`` the state that follows ``after``; fails if another one did."""
    version = after.version + 1
    path = f"{root}/{MANIFEST}/{version:012d}.json"
    beside = f"{root}/{MANIFEST}/.{version:012d}-{uuid.uuid4().hex}"
    files = _files(spark, path)
    stream = files.create(_path(spark, beside), False)
    stream.write(bytearray(json.dumps(entries, sort_keys=True).encode()))
    stream.close()
    if files.exists(_path(spark, path)) or not files.rename(_path(spark, beside), _path(spark, path)):
        files.delete(_path(spark, beside), False)
        raise RuntimeError(f"another writer made version {version} of {root}")
    return Manifest(version, entries)


def vacuum(spark: SparkSession, root: str, folders: dict[str, set[str]], keep: int = 2) -> None:
    """Delete what no kept version names.

    ``folders`` has, for each parent folder, the names that the ``keep`` newest versions use.
    Versions before those go as well.
    """
    for version in _versions(spark, root)[:-keep]:
        delete(spark, f"{root}/{MANIFEST}/{version:012d}.json")
    for parent, used in folders.items():
        for name in names(spark, parent):
            if name not in used and not name.startswith("_"):
                delete(spark, f"{parent}/{name}")
