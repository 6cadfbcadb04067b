"""Small files and renames on any store that Spark reaches; local paths need no session."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file://")


def local(path: str) -> Path:
    return Path(path.removeprefix("file://"))


def uri(path: str) -> str:
    """The path as Spark takes it, whatever its default store is."""
    return f"file://{local(path).absolute()}" if is_local(path) else path


def _remote(path: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise OSError(f"a session is needed for {path}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.sparkContext._jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(path: str) -> bool:
    if is_local(path):
        return local(path).exists()
    _, store, at = _remote(path)
    return store.exists(at)


def read_text(path: str) -> str | None:
    """UTF-8 text with or without a byte order mark; null if there is no such file."""
    if not exists(path):
        return None
    if is_local(path):
        return local(path).read_text("utf-8-sig")
    jvm, store, at = _remote(path)
    stream = store.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8-sig")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Written whole or not at all."""
    part = f"{path}.part-{uuid.uuid4().hex}"
    if is_local(path):
        local(path).parent.mkdir(parents=True, exist_ok=True)
        local(part).write_text(text)
        os.replace(local(part), local(path))
        return
    jvm, store, at = _remote(part)
    stream = store.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    delete(path)
    rename(part, path)


def rename(old: str, new: str) -> None:
    if is_local(old):
        os.rename(local(old), local(new))
        return
    jvm, store, at = _remote(old)
    if not store.rename(at, jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} can't be renamed to {new}")


def delete(path: str) -> None:
    """The file, or the directory with all in it, if it is there."""
    if is_local(path):
        if local(path).is_dir():
            shutil.rmtree(local(path), ignore_errors=True)
        else:
            local(path).unlink(missing_ok=True)
        return
    _, store, at = _remote(path)
    store.delete(at, True)


def children(path: str) -> list[str]:
    if not exists(path):
        return []
    if is_local(path):
        return [str(p) for p in local(path).iterdir()]
    _, store, at = _remote(path)
    return [str(s.getPath()) for s in store.listStatus(at)]
