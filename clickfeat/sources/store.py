"""Stage results kept in the shared folder, addressed by what they were computed from.

A result's key covers its specification, the library's own source code, and the
path, length and modification time of every input file; a change of any of them
misses. A result is written under a name of its own and published by one
rename, so a half-written one is never read, and of two jobs that compute the
same one, the first to publish wins. A job marks the results it reads; results
that no job marks can be swept once they are old enough.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

_SKIP = ("llm", "__pycache__")


@lru_cache(maxsize=1)
def code_version() -> str:
    """Hash of the library's source files."""
    out = hashlib.sha256()

    def walk(folder, name: str) -> None:
        for f in sorted(folder.iterdir(), key=lambda f: f.name):
            if f.is_dir() and f.name not in _SKIP:
                walk(f, f"{name}/{f.name}")
            elif f.name.endswith(".py"):
                out.update(f"{name}/{f.name}".encode() + b"\0" + f.read_bytes() + b"\0")

    walk(resources.files(__package__.split(".")[0]), "")
    return out.hexdigest()[:16]


def fingerprint(spec: object, inputs: Sequence[str]) -> str:
    """Key of a computation: its specification, the code and the identity of its inputs."""
    text = json.dumps({"spec": repr(spec), "code": code_version(), "inputs": list(inputs)}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def input_identity(spark: SparkSession, *paths: str) -> list[str]:
    """Path, length and modification time of every file under ``paths``."""
    out = []
    for path in paths:
        fs, hpath = _fs(spark, path)
        files = fs.listFiles(hpath, True)
        while files.hasNext():
            f = files.next()
            out.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return sorted(out)


def _folder(spark: SparkSession, folder: str | None) -> str:
    return f"{(folder or checkpoint_dir(spark)).rstrip('/')}/features"


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return fs.exists(hpath)


def cached_table(spark: SparkSession, name: str, key: str, compute: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
    """The result stored for ``key``; computed and published if there is none. This application is marked as its reader."""
    base = _folder(spark, folder)
    path = f"{base}/{name}-{key}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        own = f"{base}/_writing-{uuid.uuid4().hex}"
        compute().write.parquet(own)
        _publish(spark, own, path)
    fs, mark = _fs(spark, f"{base}/_readers/{name}-{key}/{spark.sparkContext.applicationId}")
    fs.create(mark, True).close()
    return spark.read.parquet(path)


def _publish(spark: SparkSession, own: str, path: str) -> None:
    fs, source = _fs(spark, own)
    _, target = _fs(spark, path)
    if fs.exists(target) and not _exists(spark, f"{path}/_SUCCESS"):
        fs.delete(target, True)  # left by a writer that did not rename
    if not fs.exists(target):
        fs.rename(source, target)
    # Another job may have published in between; a rename onto its folder ends inside it.
    for left in (own, f"{path}/{own.rsplit('/', 1)[1]}"):
        f, p = _fs(spark, left)
        f.delete(p, True)


def release(spark: SparkSession, folder: str | None = None) -> int:
    """Takes this application's marks away; returns their number."""
    fs, readers = _fs(spark, f"{_folder(spark, folder)}/_readers")
    n = 0
    for entry in fs.listStatus(readers) if fs.exists(readers) else []:
        n += bool(fs.delete(_fs(spark, f"{entry.getPath()}/{spark.sparkContext.applicationId}")[1], False))
    return n


def sweep(spark: SparkSession, older_than: float = 86_400.0, folder: str | None = None) -> list[str]:
    """Removes results that no application marks, and unfinished writes, last changed ``older_than`` seconds ago or earlier."""
    base = _folder(spark, folder)
    fs, root = _fs(spark, base)
    gone = []
    for entry in fs.listStatus(root) if fs.exists(root) else []:
        name = entry.getPath().getName()
        if name == "_readers" or time.time() - entry.getModificationTime() / 1000 < older_than:
            continue
        _, marks = _fs(spark, f"{base}/_readers/{name}")
        if fs.exists(marks) and len(fs.listStatus(marks)):
            continue
        fs.delete(entry.getPath(), True)
        fs.delete(marks, True)
        gone.append(name)
    return sorted(gone)
