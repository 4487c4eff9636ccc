"""Versions of a folder: data is written beside what readers see, and one small file switches to it.

``_versions/<number>.json`` names the data folders of a version. It is written under another name and then renamed without
overwriting, so a version exists as a whole or not at all, a writer that dies leaves only unnamed folders, and of two writers
that start from the same version the later one fails instead of losing the other's changes. Readers take the highest number.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_VERSIONS = "_versions"


class VersionConflict(RuntimeError):
    """Another writer published the version this one was about to publish."""


@dataclass(frozen=True)
class Version:
    """Number of a version (0: none yet) and the data folders by name, relative to the folder."""

    number: int
    folders: dict[str, str]


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder() -> str:
    """Name of a data folder that no version names yet; Spark's readers pass over it."""
    return f"_data/{uuid.uuid4().hex}"


def current(spark: SparkSession, folder: str, number: int | None = None) -> Version:
    """The newest version of a folder, or the given one."""
    system = file_system(spark, folder)
    versions = _path(spark, f"{folder}/{_VERSIONS}")
    if number is None:
        if not system.exists(versions):
            return Version(0, {})
        names = [status.getPath().getName() for status in system.listStatus(versions)]
        number = max((int(name[:-5]) for name in names if name.endswith(".json")), default=0)
        if number == 0:
            return Version(0, {})
    stream = system.open(_path(spark, f"{folder}/{_VERSIONS}/{number}.json"))
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return Version(number, json.loads(text))


def switch(spark: SparkSession, folder: str, base: Version, folders: dict[str, str]) -> Version:
    """Publish ``folders`` as the version after ``base``."""
    jvm, number = spark.sparkContext._jvm, base.number + 1
    system = file_system(spark, folder)
    staged = _path(spark, f"{folder}/{_VERSIONS}/.{uuid.uuid4().hex}.tmp")
    stream = system.create(staged, False)
    try:
        stream.write(json.dumps(folders, ensure_ascii=False, sort_keys=True).encode())
    finally:
        stream.close()
    kept = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kept, 1)
    options[0] = kept.valueOf("NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        system.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    target = _path(spark, f"{folder}/{_VERSIONS}/{number}.json")
    try:
        context.rename(system.makeQualified(staged), system.makeQualified(target), options)
    except Py4JJavaError as error:
        system.delete(staged, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise VersionConflict(f"version {number} of {folder} was published by another writer") from error
        raise
    return Version(number, folders)


def forget(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete versions older than the newest ``keep`` and the data folders that no kept version names.

    Call it while no writer is at work: a folder that is still being written has no version yet.
    """
    system, newest = file_system(spark, folder), current(spark, folder).number
    numbers = range(max(1, newest - keep + 1), newest + 1)
    named = {data for number in numbers for data in current(spark, folder, number).folders.values()}
    for status in system.listStatus(_path(spark, f"{folder}/{_VERSIONS}")):
        name = status.getPath().getName()
        if name.endswith(".json") and int(name[:-5]) not in numbers:
            system.delete(status.getPath(), False)
    data = _path(spark, f"{folder}/_data")
    for status in system.listStatus(data) if system.exists(data) else ():
        own = f"_data/{status.getPath().getName()}"
        if not any(path == own or path.startswith(f"{own}/") for path in named):
            system.delete(status.getPath(), True)
            continue
        for part in system.listStatus(status.getPath()) if own not in named else ():
            if part.isDirectory() and f"{own}/{part.getPath().getName()}" not in named:
                system.delete(part.getPath(), True)
